import numpy as np
import pytest

from panelloom.llm import whitening as W

from panelloom.llm.common import read


def close(held, x):
    c = x.astype(float) - x.astype(float).mean(axis=0)
    v = c.T @ c
    scale = max(1.0, np.abs(v).max())
    assert held.n == len(x) and held.sums == x.sum(axis=0).tolist()
    assert np.abs(held.vectors @ np.diag(held.values) @ held.vectors.T - v).max() < 1e-11 * scale
    assert np.abs(held.vectors.T @ held.vectors - np.eye(x.shape[1])).max() < 1e-12


RNG = np.random.default_rng(5)
TABLES = [RNG.integers(-50, 50, (300, 8)), RNG.integers(-200, 200, (200, 64)), np.repeat(RNG.integers(-3, 3, (5, 6)), 20, axis=0), np.eye(10, dtype=int) * 7,
          np.zeros((5, 3), int), RNG.integers(-2, 2, (200, 5)) * np.array([1, 0, 0, 10 ** 6, 1]), np.ones((7, 4), int) * 5, RNG.integers(-9, 9, (50, 1)),
          np.diag([1, 2, 3, 4]).repeat(30, axis=0)]


@pytest.mark.parametrize("x", TABLES)
def test_rank_one_updates(x):
    whole, left, right = (W.Spectrum(x.shape[1]) for _ in range(3))
    whole.add(x)
    close(whole, x)
    left.add(x[:len(x) // 3])
    right.add(x[len(x) // 3:])
    left = W.Spectrum.of(left.row())
    left.combine(right)
    close(left, x)


def test_roots_lie_between_the_poles():
    for k in (2, 3, 40):
        for _ in range(50):
            d = np.sort(RNG.normal(size=k)) * 10.0 ** RNG.integers(-3, 4)
            z2 = RNG.random(k) * 10.0 ** RNG.integers(-10, 3, k)
            origin, offset = W.secular_roots(d, z2)
            want = np.linalg.eigvalsh(np.diag(d) + np.outer(np.sqrt(z2), np.sqrt(z2)))
            assert np.abs(np.sort(d[origin] + offset) - want).max() < 1e-11 * np.abs(want).max()


def check(rows, vectors):
    """Rows against a plain computation in whole numbers and one dense eigendecomposition."""
    d = max((len(v) for _, v in vectors if v is not None), default=0)
    kept = [(i, [int(np.floor(256 * np.float64(np.float32(c)))) for c in v] + [0] * (d - len(v))) for i, v in vectors
            if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in fit], float)
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    k = int((e[:4] > 1e-12 * e[0]).sum())
    assert len(rows) == k * len(kept)
    deviation = {i: sum((n * a - s) ** 2 for a, s in zip(x, sums)) for i, x in kept}
    for c in range(1, k + 1):
        got = {r["vec_id"]: r for r in rows if r["component"] == c}
        white = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for _, x in kept], float) @ u[:, c - 1] / np.sqrt(e[c - 1])
        mine = np.array([got[i]["whitened"] for i, _ in kept])
        assert min(np.abs(mine - white).max(), np.abs(mine + white).max()) < 1e-9
        assert all(r["n"] == n and r["identity_error"] < 1e-9 and abs(r["explained"] - e[c - 1] / e.sum()) < 1e-9 for r in got.values())
        assert all((r["deviation"] if r["deviation"] is not None else int(r["deviation_exact"])) == deviation[i] for i, r in got.items())


SCHEMA = "vec_id long, embedding array<float>, label int, x int, part int, n long"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 0, 1, 2, 3) for i, v in vectors], SCHEMA)


def test_given_table(spark):
    df = read(spark, "/root/testdata/sf0.01", "embeddings")
    check(W.whiten(df.repartition(40)).collect(), [(r["vec_id"], r["embedding"]) for r in df.collect()])


def test_edges(spark):
    scale = np.array([9, 7, 5, 3, 1.0])
    plain = [(i, (RNG.normal(size=5) * scale).astype(np.float32).tolist()) for i in range(40)]
    odd = [(100, None), (101, [1.0, None, 2.0, 3.0, 4.0]), (102, [float("nan")] * 5), (103, [1.0, 2.0, 3.0, 4.0, float("inf")]), (104, plain[0][1]), (105, [-0.0] * 5),
           (106, [1.0, 2.0]), (107, [])]
    check(W.whiten(table(spark, plain + odd)).collect(), plain + odd)
    two = [(1, [1.0, 2.0]), (2, [3.0, 5.0]), (3, [3.0, 5.0])]
    check(W.whiten(table(spark, two)).collect(), two)
    big = [(i, [float(v) * 1e12 for v in x]) for i, x in plain]
    check(W.whiten(table(spark, big)).collect(), big)
    assert W.whiten(table(spark, [(1, [1.0, 2.0])] * 3)).collect() == []
    assert W.whiten(table(spark, [(1, None), (2, [])])).collect() == []
    empty = W.whiten(table(spark, []))
    assert empty.collect() == [] and empty.columns == W.whiten(table(spark, two)).columns
    huge = W.whiten(table(spark, [(None, [1e30, 1.0]), (None, [-1e30, 2.0]), (7, [3.0, 3.0])])).collect()
    assert len(huge) == 3 * len({r["component"] for r in huge})
