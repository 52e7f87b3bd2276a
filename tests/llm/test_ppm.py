import math
import zlib
from collections import Counter, defaultdict

import numpy as np

from panelloom.llm import ppm
from panelloom.llm.common import read

from .samples import EDGES, frame, prose


def plain_bits(texts, text):
    """Code length of a text by walking the contexts of the given texts byte by byte."""
    seen = defaultdict(Counter)
    for t in texts:
        for j in range(len(t)):
            for k in range(min(ppm.DEPTH, j) + 1):
                seen[t[j - k:j]][t[j]] += 1
    bits = 0.0
    for j in range(len(text)):
        for k in range(min(ppm.DEPTH, j), -1, -1):
            c = seen.get(text[j - k:j])
            if not c:
                continue
            n, d = sum(c.values()), len(c)
            if text[j] in c:
                bits -= math.log2(c[text[j]] / (n + d))
                break
            bits -= math.log2(d / (n + d))
        else:
            bits += 8
    return bits


def test_exact_code_lengths():
    by = {"a": [b"abracadabra", b"ab\0ra", b"x"], "b": ["zwölf Boxkämpfer".encode(), b"", b"bracket"], "c": [prose(1, 200).encode()]}
    trees = ppm.fit([t for v in by.values() for t in v], [k for k, v in by.items() for _ in v])
    queries = [b"", b"a", b"abra", b"\0", b"\xff\xfe", b"cadabracket", "zwölf".encode() * 9, prose(2, 60).encode(), b"w1 w2 w3"]
    together, alone = trees.code_lengths(queries), np.concatenate([trees.code_lengths([q]) for q in queries])
    assert trees.languages == ["a", "b", "c"] and np.abs(together - alone).max() < 1e-6
    for q, row in zip(queries, together):
        for name, bits in zip(trees.languages, row):
            want = plain_bits(by[name], q)
            assert abs(bits - want) < 1e-4 * (1 + want), (q, name)


def test_pruned_trees_code_every_byte():
    texts = [prose(k, 300).encode() for k in range(4)]
    trees = ppm.fit(texts, ["a", "a", "b", "b"], most=200)
    assert len(trees.follow) < 2 + len(ppm.fit(texts, ["a", "a", "b", "b"]).follow)
    bits = trees.code_lengths([texts[0], b"\x01" * 50])
    assert np.isfinite(bits).all() and bits[0].max() < 8 * len(texts[0]) and bits[1].min() >= 8 * 50


def test_held_out_accuracy(spark):
    docs = read(spark, "/root/testdata/sf0.1", "documents")
    rows = ppm.predicted(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows) and len(rows) == docs.count()
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_label_of_held_out_rows_does_not_matter(spark):
    df = spark.createDataFrame([(k, prose(k % 2, 30 + k, 50).replace("w", "ab"[k % 2]), "xy"[k % 2], "s") for k in range(40)],
                               "doc_id long, text string, lang string, source string")
    other = df.selectExpr("doc_id", "text", "case when pmod(crc32(encode(string(doc_id), 'utf-8')), 4) = 2 then 'zz' else lang end as lang", "'t' as source")
    a, b = ({r["doc_id"]: r for r in ppm.predicted(d).collect()} for d in (df, other))
    assert a == b and {r["lang_pred"] for r in a.values()} == {"x", "y"}
    assert all(r["lang_pred"] == "xy"[k % 2] for k, r in a.items())


def test_edges(spark):
    df = frame(spark, EDGES + ["123 -- 456", "ǆ", "long ø text " * 200_000])
    got = {(r["doc_id"], r["lang_pred"], r["score"]) for r in ppm.predicted(df).collect()}
    assert len(ppm.predicted(df).collect()) == len(EDGES) + 3
    by_id = {(a, b) for a, b, _ in got}
    n = len(EDGES)
    assert {(0, "und"), (1, "und"), (2, "und"), (n, "und"), (n + 1, "en"), (n + 2, "en"), (3, "en")} <= by_id
    unlabelled = df.drop("lang").selectExpr("*", "cast(null as string) as lang")
    assert {(r["lang_pred"], r["score"]) for r in ppm.predicted(unlabelled).collect()} == {("und", 0.0)}
    assert ppm.predicted(df.limit(0)).collect() == []


def test_a_hot_copy_counts_once(spark):
    df = spark.createDataFrame([(k, "one text", "a") for k in range(200)] + [(500 + k, prose(k, 20), "a") for k in range(30)],
                               "doc_id long, text string, lang string")
    got = [t for t, _ in ppm.sample(df, 100)]
    assert len(got) == len(set(got)) > 10
