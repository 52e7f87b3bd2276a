import hashlib
import random
import zlib

import numpy as np

from panelloom.llm import periodic as P

from .samples import EDGES, frame, prose, words


def plain_runs(t):
    """All runs (start, end, smallest period) by comparing at every distance."""
    found = {}
    for p in range(1, len(t) // 2 + 1):
        i = 0
        while i + p < len(t):
            j = i
            while j + p < len(t) and t[j] == t[j + p]:
                j += 1
            if j - i >= p:
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((a, b, p) for (a, b), p in found.items())


def same(t):
    assert sorted(map(tuple, P.runs_of(np.array(t, np.int64)).tolist())) == plain_runs(t), t


def test_random_words():
    r = random.Random(1)
    for n in range(45):
        for letters in (1, 2, 2, 2, 3, 5):
            same([r.randrange(letters) for _ in range(n)])


def test_words_with_many_runs():
    a, b = [0], [0, 1]
    while len(b) < 500:
        a, b = b, b + a
    same(b[:500])
    same([bin(i).count("1") % 2 for i in range(300)])
    same([0] * 200)
    same([0, 1] * 100)


def test_squares_of_periodic_regions():
    """Periods whose square is made of two regions of a small period, which no selected position proposes."""
    r = random.Random(2)
    for _ in range(250):
        u = [r.randrange(3) for _ in range(r.randrange(1, 4))]
        v = u * r.randrange(1, 16) + u[:r.randrange(len(u) + 1)]
        w = v + [r.randrange(3)] * r.randrange(2) + v * r.randrange(1, 4)
        same((w * r.randrange(1, 3) + [r.randrange(3) for _ in range(r.randrange(6))])[:500])


def test_selection_is_local():
    """Equal contexts give equal decisions, wherever they stand."""
    r = np.random.default_rng(3)
    letters = r.integers(0, 2, 600).astype(np.uint64)
    t, hashes = 4, None
    hashes = P.mix(letters * P._STEP)
    for w in (1, 2):
        hashes = P.mix(hashes[:-w] * P._STEP + hashes[w:])
    chosen = set(P.synchronising(hashes, t, np.zeros(600, bool)).tolist())
    by_context = {}
    for i in range(len(letters) - 2 * t):
        by_context.setdefault(tuple(letters[i:i + 2 * t]), set()).add(i in chosen)
    assert all(len(v) == 1 for v in by_context.values()) and 0 < len(chosen) < 600


def plain_row(doc_id, text):
    w = [x.encode("utf-8") for x in words(text)]
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = [(s, e - s, q) for s, e, q in plain_runs(w) if e - s >= max(12, 2 * q)]
    runs.sort(key=lambda r: (r[0], r[2]))
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in dropped)).hexdigest())


def test_query_rows(spark):
    texts = [e for e in EDGES if not (isinstance(e, str) and len(e) > 50_000)] + [prose(k, 20 + 9 * k, 5 + k) for k in range(40)]
    texts += [" ".join([f"w{k % 7}" for k in range(40)] + ["end"]), "a b " * 30 + "c " + "a b " * 30, "x " * 200, "é ü " * 9]
    texts += [(k, prose(k, 60)) for k in range(1000, 1060)]
    df = frame(spark, texts)
    got = sorted(map(tuple, P.periodic_runs(df).collect()), key=str)
    want = sorted((plain_row(r["doc_id"], r["text"]) for r in df.collect()), key=str)
    assert got == want
    assert sum(r[1] > 0 for r in want) > 10


def test_long_texts(spark):
    df = frame(spark, ["long " * 300_000, " ".join(f"w{k}" for k in range(150_000)) * 2, "x" * 2_000_000])
    rows = {r["doc_id"]: r for r in P.periodic_runs(df).collect()}
    assert (rows[0]["n_runs"], rows[0]["period"], rows[0]["length"]) == (1, 1, 300_000)
    assert rows[1]["n_runs"] == 0 and rows[2]["n_runs"] == 0          # the halves meet in one word
    assert P.periodic_runs(df.limit(0)).collect() == []
