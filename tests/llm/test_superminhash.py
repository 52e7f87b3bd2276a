import numpy as np
import pytest

from panelloom.llm import superminhash as S
from panelloom.llm.components import components

from .samples import EDGES, edited, frame, prose, shingles


def brute(rows, n, percent=80):
    """component of each id by comparing all pairs of distinct sets."""
    sets = {}
    for i, t in rows:
        s = frozenset(shingles(t, n))
        if s:
            sets.setdefault(s, set()).add(-1 if i is None else i)
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    group = list(sets.items())
    for s, ids in group:
        for x in ids:
            parent[find(x)] = find(min(ids))
    for a in range(len(group)):
        for b in range(a):
            x, y = group[a][0], group[b][0]
            if 100 * len(x & y) >= percent * len(x | y):
                parent[find(min(group[a][1]))] = find(min(group[b][1]))
    least = {}
    for x in list(parent):
        least[find(x)] = min(least.get(find(x), x), x)
    return {x: least[find(x)] for x in list(parent)}


def result(spark, texts, **more):
    df = frame(spark, texts)
    return [(r["doc_id"], r["text"]) for r in df.collect()], S.near_duplicates(df, **more).collect()


def holds(texts, rows, n):
    want = brute(texts, n)
    assert len(rows) == len(texts)
    assert sorted((r["doc_id"] is None, r["doc_id"], r["n_shingles"]) for r in rows if r["doc_id"] is not None) == sorted(
        (False, i, len(shingles(t, n))) for i, t in texts if i is not None)
    for r in rows:
        i = -1 if r["doc_id"] is None else r["doc_id"]
        c = -1 if r["component_id"] is None else r["component_id"]
        assert c == want.get(i, i), r
        assert r["kept"] == (i == c)


def test_edges(spark):
    texts, rows = result(spark, EDGES)
    holds(texts, rows, 4)


@pytest.mark.parametrize("n", [4, 5])
def test_groups_of_copies_and_chains(spark, n):
    base = [prose(k, 120) for k in range(6)]
    texts = list(base)
    for k in range(150):                        # more than one block of near copies, at all distances
        texts.append(edited(base[0], k, 0.002 * (k % 40)))
    step = base[1]
    for k in range(12):                         # a chain whose ends are not linked
        step = edited(step, 1000 + k, 0.02)
        texts.append(step)
    texts += [base[2]] * 40 + [base[2].upper()] + [prose(100 + k, 5 + k) for k in range(40)]
    texts, rows = result(spark, texts, words=n)
    holds(texts, rows, n)


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "SMALL", 8)
    monkeypatch.setattr(S, "BLOCK", 16)
    base = prose(5, 100)
    texts, rows = result(spark, [edited(base, k, 0.004 * (k % 30)) for k in range(120)])
    holds(texts, rows, 4)


def test_empty(spark):
    assert S.near_duplicates(frame(spark, []).limit(0)).collect() == []


def test_signature_is_superminhash():
    """Level by level gives what the element by element algorithm gives, and the estimate is close."""
    r = np.random.default_rng(0)
    a = np.sort(r.integers(0, 2 ** 63, 40, dtype=np.uint64))
    size = S.SIZE
    want = np.full(size, 2 ** 64 - 1, np.uint64)
    for e in a:
        place = list(range(size))
        for j in range(size):
            z = S.mix(np.array([e], np.uint64) ^ S._LEVEL[j])[0]
            k = j + int(((z & S._LOW) * np.uint64(size - j)) >> S._HALF)
            place[j], place[k] = place[k], place[j]
            want[place[j]] = min(want[place[j]], (np.uint64(j) << S._HALF) | (z >> S._HALF))
    assert (S.signatures([a])[0] == want).all()
    x = np.sort(r.integers(0, 2 ** 63, 1000, dtype=np.uint64))
    y = np.sort(np.concatenate([x[:800], r.integers(0, 2 ** 63, 200, dtype=np.uint64)]))
    s = S.signatures([x, y])
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.15


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 200), (200, 100), (7, 7), (None, 3), (500, 500)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(edges).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 200: 100}
