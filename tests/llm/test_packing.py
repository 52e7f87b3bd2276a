import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from panelloom.llm import mixpack as M

from .samples import EDGES, frame, prose

PATH = public_tokenizers.path("word_bpe_49k.json")


TOKENIZER = Tokenizer.from_file(PATH)


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [1]


def test_word_ids_equal_the_tokenizer(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    encode = M.WordIds(PATH)
    for t in 2 * [r["text"] for r in rows] + [e[1] if isinstance(e, tuple) else e for e in EDGES] + ["it's don't I'LL a\x1cb a b ...?! x.y (z) été. ÀÉ! µ ß ﬁ Å"]:
        assert np.frombuffer(encode.text(t or ""), "<u2").tolist() == ids_of(t)[:-1]


def holds(texts, rows, window=2048):
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_window[r["sequence_id"]].append((r["offset"], r["length"]))
    total = 0
    want = defaultdict(list)
    for i, t in texts:
        want[i].append(ids_of(t))
        total += len(want[i][-1])
    for i, lists in want.items():
        if len(lists) == 1:
            at = 0
            for r in sorted(by_doc[i], key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(lists[0])
                assert r["ids_crc32"] == zlib.crc32(np.array(lists[0][at:at + r["length"]], "<u4").tobytes())
                at += r["length"]
            assert at == len(lists[0])
        assert sum(r["length"] for r in by_doc[i]) == sum(map(len, lists))
    for w, parts in by_window.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at == (window if w < max(by_window) else total - window * max(by_window))
    assert set(by_window) == set(range(-(-total // window)))


@pytest.mark.parametrize("weights", [None, {"s0": 5, "s1": 1}, {"s0": 1, "s1": 1, "s2": 1000000}])
def test_round_trip(spark, weights):
    df = frame(spark, EDGES + [prose(k, 10 + 40 * (k % 9)) for k in range(60)])
    texts = [(r["doc_id"], r["text"]) for r in df.collect()]
    holds(texts, M.pack(df, weights=weights).collect())
    holds(texts, M.pack(df.repartition(7), weights=weights, window=100).collect(), 100)


def test_every_window_has_the_target_mix(spark):
    hot = lambda i: "hot" if i % 3 == 0 else f"s{i % 7}"
    df = frame(spark, [prose(k, 300) for k in range(90)], hot)
    rows = M.pack(df, window=500).collect()
    got, total = defaultdict(lambda: defaultdict(int)), defaultdict(int)
    for r in rows:
        got[r["sequence_id"]][r["queue"]] += r["length"]
        total[r["queue"]] += r["length"]
    n = sum(total.values())
    carried = defaultdict(float)
    for w in sorted(got)[:-1]:
        for q in total:
            assert abs(got[w][q] - 500 * total[q] / n) < 2
            carried[q] += got[w][q] - 500 * total[q] / n
            assert abs(carried[q]) < 1.001              # the deficit carries over


def test_every_source_keeps_its_share(spark):
    """A thousand sources, one with a third of the documents: each is served within a burst or two of its share."""
    source = lambda i: "hot" if i % 3 == 0 else f"s{i % 1000 if i % 5 else i % 30}"
    df = frame(spark, [prose(k, 12) for k in range(3000)], source)
    rows = M.pack(df.repartition(5), window=1024, quantum=16).collect()
    holds([(r["doc_id"], r["text"]) for r in df.collect()], rows, 1024)
    total, by_window = defaultdict(int), defaultdict(lambda: defaultdict(int))
    for r in rows:
        total[r["queue"]] += r["length"]
        by_window[r["sequence_id"]][r["queue"]] += r["length"]
    n, seen = sum(total.values()), defaultdict(int)
    assert len(total) > 600 and n > 100 * 1024
    for w in range(max(by_window)):
        for q, length in by_window[w].items():
            seen[q] += length
        for q in total:
            share = 1024 * (w + 1) * total[q] / n
            assert abs(seen[q] - share) < (1.001 if q == "hot" else 16 + 0.2 * total[q]), (q, w)


def test_small_tail(spark):
    """Sources with less than a token a window together."""
    source = lambda i: "tiny" if i == 7 else f"s{i % 2}"
    df = frame(spark, ["one" if k == 7 else prose(k, 900) for k in range(40)], source)
    holds([(r["doc_id"], r["text"]) for r in df.collect()], M.pack(df, window=256).collect(), 256)
    holds([(r["doc_id"], r["text"]) for r in df.collect()], M.pack(df, weights={"s0": 1, "tiny": 1}, window=256).collect(), 256)


def test_weighted_sources_first(spark):
    df = frame(spark, [prose(k, 50) for k in range(60)], lambda i: f"s{i % 6}")
    rows = M.pack(df, weights={"s1": 3, "s4": 1}, window=64).collect()
    holds([(r["doc_id"], r["text"]) for r in df.collect()], rows, 64)
    last = max(r["sequence_id"] for r in rows if r["queue"] in ("s1", "s4"))
    assert {r["queue"] for r in rows if r["sequence_id"] < last} == {"s1", "s4"}
    with pytest.raises(ValueError, match="nowhere"):
        M.pack(df, weights={"s1": 1, "nowhere": 2})


def test_schedule_serves_everything():
    for sizes, weights in [({1: 10, 2: 1}, {1: 1, 2: 100}), ({0: 3, 1: 7, 2: 10 ** 15}, None), ({1: 5}, {}), ({1: 1, 2: 1, 3: 1}, {1: 7, 2: 11, 3: 13})]:
        phases = M.schedule(sizes, weights)
        assert sum(p.length for p in phases) == sum(sizes.values())
        if sum(sizes.values()) < 1000:
            seen = set()
            for q, n in sizes.items():
                for _, length, w, offset in M.pieces(phases, q, 0, n, 4):
                    span = set(range(4 * w + offset, 4 * w + offset + length))
                    assert not span & seen
                    seen |= span
            assert seen == set(range(sum(sizes.values())))


def test_empty(spark):
    assert M.pack(frame(spark, []).limit(0)).collect() == []
