import re
from collections import Counter

from panelloom.llm import attribution as A, linededup as D, linequality as Q

from .samples import EDGES, frame, prose, words

MANY = [prose(1, 30) + ".\n" + prose(2, 8) + ".\n\n" + prose(3, 9) + ".\r\n" + prose(4, 6) + "!", prose(5, 9) + "\n" + prose(2, 8) + ".\n" + prose(3, 9) + ".\n" + prose(4, 6) + "!\nend.",
        "\n".join([prose(6, 5) + "."] * 9), "a b c " * 30, "Home\nAbout | Contact | Login\nAll rights reserved.\n" + (prose(7, 60) + ".\n") * 2, "# * $ % & | < > " * 20,
        "LOUD WORDS!! " * 40, prose(8, 70) + "."]


def dedup_by_hand(rows):
    """clean texts by (id, text), windows of three filled lines, first occurrence by (id, place)."""
    first, places = {}, []
    for key in sorted({(-1 if i is None else i, t) for i, t in rows if t is not None}):
        lines = [(n, x.strip(" \t\r")) for n, x in enumerate(key[1].split("\n"))]
        filled = [(n, x) for n, x in lines if x]
        for k in range(len(filled) - 2):
            three = filled[k:k + 3]
            places.append((key, [n for n, _ in three], tuple(x for _, x in three)))
    gone = {}
    for key, numbers, text in places:
        if text in first:
            gone.setdefault(key, set()).update(numbers)
        else:
            first[text] = key
    return {key: "\n".join(x for n, x in enumerate(key[1].split("\n")) if n not in g) for key, g in gone.items()}, gone


def test_line_dedup(spark):
    texts = EDGES[:9] + MANY + [MANY[0], (40, MANY[1]), (40, MANY[1])]
    df = frame(spark, texts)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    clean, gone = dedup_by_hand(rows)
    assert len(gone) > 3
    got = D.dedup_lines(df).collect()
    assert len(got) == len(rows) and set(df.columns) <= set(got[0].asDict())
    for r in got:
        key = (-1 if r["doc_id"] is None else r["doc_id"], r["text"])
        assert r["clean_text"] == clean.get(key, r["text"]), r
        assert r["n_removed"] == len(gone.get(key, ()))
        assert r["n_lines"] == sum(bool(x.strip(" \t\r")) for x in (r["text"] or "").split("\n"))
    assert D.dedup_lines(df.limit(0)).collect() == []


def base_counts(t):
    t = t or ""
    w = words(t)
    three = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    inside = {i + k for i in range(len(w) - 2) if three[tuple(w[i:i + 3])] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in t.split("\n"):
        if words(line):
            again += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), again, len(inside), len(w) < 50 or 100 * len(inside) > 50 * len(w))


def test_line_quality(spark):
    df = frame(spark, EDGES + MANY)
    got = Q.line_quality(df, with_text=True).collect()
    want = [(r["doc_id"], *base_counts(r["text"])) for r in df.collect()]
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    order = lambda x: (x[0] is None, x)
    assert sorted([tuple(r[c] for c in names) for r in got], key=str) == sorted(want, key=str)
    for r in got:
        assert not (r["base_failed"] and r["kept"]) and r["kept"] == (not r["base_failed"] and r["fault"] is None)
    by_id = {r["doc_id"]: r for r in got}
    n = len(EDGES)
    assert by_id[n + 7]["kept"] and by_id[n + 7]["clean_text"] == MANY[7]
    assert by_id[n + 4]["clean_text"] == (prose(7, 60) + ".\n") * 2 and by_id[n + 4]["n_lines_dropped"] == 3
    assert by_id[n + 6]["fault"] == "capitals" and by_id[n + 5]["fault"] is not None
    assert Q.line_quality(df.limit(0)).collect() == []


def test_section_tokens(spark):
    df = frame(spark, EDGES + MANY)
    for rule in A.RULES:
        got = A.section_tokens(df, rule=rule).collect()
        total = Counter()
        for r in got:
            total[r["doc_id"], r["doc_tokens"]] += r["n_tokens"]
        repeated = Counter((r["doc_id"], r["doc_tokens"]) for r in got if r["section"] == 0)
        for (i, n), s in total.items():
            assert abs(s - n * repeated[i, n]) < 1e-6
        assert sum(repeated.values()) == len(EDGES + MANY)
    encoding, lengths = A.encoder(A.public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for r in (r for r in A.section_tokens(df).collect() if r["doc_id"] == len(EDGES)):
        text, at, n, crossing = MANY[0].encode(), 0, 0, 0
        for t in encoding.encode_ordinary(MANY[0]):
            end = at + len(encoding.decode_single_token_bytes(t))
            n += r["start_byte"] <= at < r["end_byte"]
            crossing += at < r["end_byte"] and end > r["start_byte"] and (at < r["start_byte"] or end > r["end_byte"])
            at = end
        assert (r["n_tokens"], r["n_crossing"]) == (n, crossing) and at == len(text)
    assert A.section_tokens(df.limit(0)).collect() == []


def test_a_crossing_token_by_each_rule():
    import numpy as np
    ends, starts, tokens = np.array([3, 10]), np.array([0, 3]), np.array([2, 6, 10])     # the second token: one byte and three
    assert A.allocate(tokens, starts, ends, "first")[0].tolist() == [2, 1]
    assert A.allocate(tokens, starts, ends, "most")[0].tolist() == [1, 2]
    assert A.allocate(tokens, starts, ends, "share")[0].tolist() == [1.25, 1.75]
    assert A.allocate(tokens, starts, ends, "first")[1].tolist() == [1, 1]
