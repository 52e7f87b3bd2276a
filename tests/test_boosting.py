"""Trees grown together against one plain loop for each model."""
import numpy as np
import pytest

from panelloom.operators import boosting as B

from test_logistic import rows_with_labels
from test_ridge_blocks import CATEGORICAL, NUMERIC, SCHEMA, folds


def plain_trees(bins, g_of, y, w, check, steps, least):
    """Scores of ``check`` after plain boosting; one node after the other, every cut tried."""
    score, out = None, None
    base, g_of = g_of
    score, out = np.full(len(y), base), np.full(len(check), base)

    def split(rows, depth, g, h, w):
        cuts = []
        total = (w[rows] @ g[rows], w[rows] @ h[rows])
        if depth < B.DEPTH and len(rows):
            for f in range(bins.shape[1]):
                for cut in range(B.BINS):
                    left = rows[bins[rows, f] <= cut]
                    right = rows[bins[rows, f] > cut]
                    if len(left) < least or len(right) < least:
                        continue
                    a, b = (w[left] @ g[left], w[left] @ h[left]), (w[right] @ g[right], w[right] @ h[right])
                    gain = a[0] ** 2 / a[1] + b[0] ** 2 / b[1] - total[0] ** 2 / total[1]
                    if gain > 1e-12:
                        cuts.append((gain, f, cut, left, right))
        best = next((c for c in cuts if c[0] >= max(c[0] for c in cuts) * (1 - 1e-9)), None)
        if best is None:
            value = -B.RATE * total[0] / total[1] if len(rows) and total[1] > 0 else 0.0
            return lambda x: value
        a, b = split(best[3], depth + 1, g, h, w), split(best[4], depth + 1, g, h, w)
        return lambda x, f=best[1], cut=best[2]: a(x) if x[f] <= cut else b(x)

    for _ in range(steps):
        g, h = g_of(score, y)
        tree = split(np.arange(len(y)), 0, g, h, w)
        score = score + np.array([tree(x) for x in bins])
        out = out + np.array([tree(x) for x in check])
    return out


@pytest.fixture(scope="module")
def data(spark):
    rows = rows_with_labels()
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in [*names, "e", "rare"]) for r in rows], SCHEMA + ", e double, rare double").repartition(4)


@pytest.mark.parametrize("loss", ["square", "log"])
def test_trees_of_all_folds(data, monkeypatch, loss):
    monkeypatch.setattr(B, "LEAST_ROWS", 8)
    target = "y" if loss == "square" else "e"
    rows, features = B.binned(data, NUMERIC, CATEGORICAL, [target])
    models = B.grow(rows, features, B.declared(rows, [target]), loss, steps=4)
    pred = B.predictions(rows, models, [target], lambda m: "t", "g", loss)
    got = {(r["split_name"], r["heldout_fold"], r["cell_id"], r["checkup_k"]): r["y_pred"] for r in pred.collect()}
    held = rows.collect()
    x, y = np.array([r["_b"] for r in held]), np.array([np.nan if r["_y"][0] is None else r["_y"][0] for r in held])
    seen = 0
    for s, f in folds([{k.lstrip("_"): v for k, v in r.asDict().items()} for r in held]):
        fold = np.array([r[f"_{s}"] for r in held])
        train, test = np.flatnonzero((fold != f) & ~np.isnan(y)), np.flatnonzero((fold == f) & ~np.isnan(y))
        if not len(train):
            continue
        mean = y[train].mean()
        if loss == "square":
            want = plain_trees(x[train], (mean, lambda s, y: (s - y, np.ones(len(y)))), y[train], np.ones(len(train)), x[test], 4, 8)
        else:
            sig = lambda v: 1 / (1 + np.exp(-v))
            want = sig(plain_trees(x[train], (np.log(mean / (1 - mean)), lambda s, y: (sig(s) - y, sig(s) * (1 - sig(s)))), y[train], np.ones(len(train)), x[test], 4, 8))
        for i, v in zip(test, want):
            assert abs(got[s, f, held[i]["cell_id"], held[i]["checkup_k"]] - v) < 1e-9
            seen += 1
    assert seen == len(got) > 50


def test_weight_settings_and_quantiles(data, monkeypatch):
    monkeypatch.setattr(B, "LEAST_ROWS", 8)
    p = B.run_weighted(data, ["y"], NUMERIC, CATEGORICAL, "g", bags=2, steps=3).collect()
    arms = {r["model_level"] for r in p}
    assert arms == {"R0_reference", "R1_condition_balanced", "R2_stressor_balanced", "R3_bagged"}
    plain = {(r["split_name"], r["heldout_fold"], r["cell_id"], r["checkup_k"]): r["y_pred"] for r in B.run_trees(data, ["y"], NUMERIC, CATEGORICAL, "g", steps=3).collect()}
    r0 = {(r["split_name"], r["heldout_fold"], r["cell_id"], r["checkup_k"]): r["y_pred"] for r in p if r["model_level"] == "R0_reference"}
    assert r0.keys() == plain.keys() and all(abs(r0[k] - v) < 1e-9 for k, v in plain.items())
    r1 = {(r["split_name"], r["heldout_fold"], r["cell_id"], r["checkup_k"]): r["y_pred"] for r in p if r["model_level"] == "R1_condition_balanced"}
    assert r1.keys() == r0.keys() and any(abs(r1[k] - r0[k]) > 1e-6 for k in r0)
    q = [r for r in B.run_trees(data, ["y"], NUMERIC, CATEGORICAL, "g", quantile_model="q", steps=3).collect() if r["model_level"] == "q"]
    assert len(q) == len(plain) and all(r["y_pred_q10"] <= r["y_pred_q50"] <= r["y_pred_q90"] for r in q)


def test_one_class_and_no_rows(data):
    p = B.run_trees(data, ["rare"], ["x1"], [], "g", loss="log", steps=2).collect()
    assert p and all(0 <= r["y_pred"] <= 1 for r in p)
    assert B.run_trees(data.limit(0), ["y"], ["x1"], [], "g", steps=2).collect() == []


def test_scores_of_many_trees_at_once():
    """A forest gives each row base and leaf values, nodes without a cut and a number of trees that fills no group included."""
    rng = np.random.default_rng(3)
    bins = rng.integers(0, B.BINS + 1, (5, 203)).astype(np.uint8)
    feature, at, value = rng.integers(-1, 5, (2, 7, 7)), rng.integers(0, B.BINS, (2, 7, 7)), rng.normal(size=(2, 7, 8))
    forest = B.Forest(feature, at, value, np.array([0.5, -1.0]))
    for i in range(2):
        want = np.full(203, forest.base[i])
        for r in range(203):
            for f, a, v in zip(feature[i], at[i], value[i]):
                node = 0
                for _ in range(B.DEPTH):
                    node = 2 * node + 1 + (f[node] >= 0 and bins[f[node], r] > a[node])
                want[r] += v[node - 7]
        assert np.allclose(forest.score(i, forest.planes(bins), 203), want, atol=1e-12)


def test_features_are_counted_in_groups():
    """Sums by (node, feature, bin) come from fewer counts than there are features, in whole and in blocks of rows."""
    rng = np.random.default_rng(4)
    bins = np.array([rng.integers(0, k, 500) for k in (33, 33, 33, 4, 2, 2, 1)]).astype(np.uint8)
    g, node = rng.normal(size=500), rng.integers(0, 4, 500)
    groups, lines = B._joint(bins)
    assert len(groups) <= 3 and sorted(f for members, _ in groups for f in members) == list(range(7))
    got = B._histograms(groups, lines, node, 4, (g, None), 7)
    for n in range(4):
        for f in range(7):
            for k, w in enumerate((g, np.ones(500))):
                assert np.allclose(got[k, n, f], np.bincount(bins[f][node == n], w[node == n], B.BINS + 1), atol=1e-12)


def test_rows_in_blocks(data, monkeypatch):
    monkeypatch.setattr(B, "LEAST_ROWS", 8)
    rows, features = B.binned(data, NUMERIC, CATEGORICAL, ["y"])
    (chunk,) = [c for b in [B.packed(rows.coalesce(1)).coalesce(1).toArrow().to_batches()] for c in B._chunks(b, 5)][:1]
    whole = list(B._parts(chunk, dict(enumerate(B.declared(rows, ["y"]))), B.SPLITS))
    monkeypatch.setattr(B, "BLOCK", 16)
    blocks = list(B._parts(chunk, dict(enumerate(B.declared(rows, ["y"]))), B.SPLITS))
    assert len(blocks) > len(whole) == 1 and sum(len(p.code) for p, _ in blocks) == len(whole[0][0].code)
    assert sum(len(at) for _, sides in blocks for at, _ in sides) == sum(len(at) for _, sides in whole for at, _ in sides)


def test_bags_are_averaged_in_tasks(data):
    """No shuffle for the mean of the bags; rows that come twice are still one."""
    p = B.run_weighted(data, ["y"], NUMERIC, CATEGORICAL, "g", bags=2, steps=1)
    assert "Exchange" not in p._jdf.queryExecution().executedPlan().toString()
    key = ["split_name", "heldout_fold", "model_level", "cell_id", "checkup_k"]
    once, twice = p.groupBy(*key).count().collect(), B.run_weighted(data.union(data), ["y"], NUMERIC, CATEGORICAL, "g", bags=2, steps=1).groupBy(*key).count().collect()
    assert {r["count"] for r in once} == {r["count"] for r in twice} == {1} and len(once) == len(twice)


def test_trees_with_equal_cuts_are_one():
    feature, at = np.full((1, 6, 7), -1), np.zeros((1, 6, 7), int)
    feature[0, :5, 0], at[0, :5, 0] = 1, 4
    forest = B.Forest(feature, at, np.ones((1, 6, 8)), np.zeros(1))
    assert len(forest.place[0]) == len(forest.value[0]) == B.TOGETHER and forest.value[0].sum() == 48
    bins = np.arange(20, dtype=np.uint8).reshape(2, 10)
    assert (forest.score(0, forest.planes(bins), 10) == 6).all()


def test_predictions_are_not_stored(data):
    """Queries fold them at once."""
    assert "MapInArrow" in B.run_trees(data, ["y"], ["x1"], [], "g", steps=1)._jdf.queryExecution().executedPlan().toString()
