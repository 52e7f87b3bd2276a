"""Sequence ridges of all folds against a plain fit for each; calibration frames run from one end only."""
import numpy as np
from pyspark.sql import functions as F

from panelloom.operators import boosting as B, logistic as L, models as M
from panelloom.operators.splits import SPLITS


def rows_of(n=160, width=3, places=4):
    r = np.random.default_rng(5)
    out = []
    for i in range(n):
        unit, events = i % 12, int(r.integers(0, places + 1))
        vector = [float(v) for v in r.normal(size=events * width)]
        x = [None if i % 17 == j else float(r.normal()) for j in range(2)]
        y = None if i % 29 == 0 else float(sum(vector[:width]) + (x[0] or 0) + unit / 10 + r.normal() / 10)
        out.append((f"c{i // 4}", unit, i % 4, *x, [None, "a", "b", "b"][unit % 4], y, vector, unit % 3, unit % 2, unit % 2, None if unit == 5 else unit % 4, 0))
    return out


def plain(train, test, alpha):
    """Ridge on imputed, standardised numbers and padded vectors, and on flags of the labels."""
    def raw(rows):
        return (np.array([[np.nan if v is None else v for v in r[3:5]] for r in rows], float), [r[5] for r in rows], np.array([r[7] + [0.0] * (12 - len(r[7])) for r in rows]))
    (a, la, va), (b, lb, vb) = raw(train), raw(test)
    mean = np.nanmean(a, axis=0)
    a, b = (np.column_stack([np.where(np.isnan(x), mean, x), v]) for x, v in ((a, va), (b, vb)))
    m, s = a.mean(axis=0), a.std(axis=0, ddof=1)
    one = lambda x, lab: np.column_stack([(x - m) / s, *[[float(v == c) for v in lab] for c in ("a", "b")]])
    a, b = one(a, la), one(b, lb)
    y = np.array([r[6] for r in train])
    c = a.mean(axis=0)
    beta = np.linalg.solve((a - c).T @ (a - c) + alpha * np.eye(a.shape[1]), (a - c).T @ (y - y.mean()))
    return (b - c) @ beta + y.mean()


def test_sequence_ridges(spark, monkeypatch):
    rows = rows_of()
    df = spark.createDataFrame(rows, "cell_id string, parameter_set int, checkup_k int, x1 double, x2 double, lab string, y double, vec array<double>, " + ", ".join(f"{s} int" for s in SPLITS)).repartition(3)
    # only coefficients reach the driver, no fit runs there
    monkeypatch.setattr(M, "ridge", None)
    for held in (64 << 20, 1):
        monkeypatch.setattr(M.rg, "HELD_BYTES", held)
        got = {(r["split_name"], r["heldout_fold"], r["cell_id"], r["checkup_k"]): r["y_pred"] for r in M.sequence_ridges(df, "y", {"vec": "m"}, ["x1", "x2"], ["lab"]).collect()}
        want = {}
        for i, s in enumerate(SPLITS):
            for f in {r[8 + i] for r in rows} - {None}:
                if f == 0 and s != "condition_fold":
                    continue
                train, test = [r for r in rows if r[8 + i] not in (None, f) and r[6] is not None], [r for r in rows if r[8 + i] == f and r[6] is not None]
                want |= {(s, f, r[0], r[2]): v for r, v in zip(test, plain(train, test, 10.0))}
        assert got.keys() == want.keys() and len(got) > 300
        assert max(abs(got[k] - want[k]) for k in got) < 1e-8


def test_calibration_frames_run_from_one_end(spark):
    rows = spark.range(4000).select(F.lit("g").alias("g"), (F.col("id") / 1_100_000).alias("p"), "id")
    steps = spark.createDataFrame([("g", 0.0, 0.001, 0.1), ("g", 0.002, 0.003, 0.2)], "g string, lo double, hi double, value double")
    out = L.apply_isotonic(rows, steps, ["g"])
    plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "rangeframe" in plan and "currentrow$(), unboundedfollowing$()" not in plan
    got = {r["id"]: r["p_calibrated"] for r in out.collect()}
    assert all(abs(v - np.interp(i / 1_100_000, [0, .001, .002, .003], [.1, .1, .2, .2])) < 1e-12 for i, v in got.items())


def test_tree_passes_send_cuts_only(spark, monkeypatch):
    """A pass brings a few numbers a node to the driver, not the sums of every bin."""
    sizes, own = [], B._totals
    monkeypatch.setattr(B, "_totals", lambda *a, **k: (lambda found: sizes.extend(len(v) for v in found.values()) or found)(own(*a, **k)))
    df = spark.createDataFrame(rows_of(), "cell_id string, parameter_set int, checkup_k int, x1 double, x2 double, lab string, y double, vec array<double>, " + ", ".join(f"{s} int" for s in SPLITS))
    assert B.run_trees(df, ["y"], ["x1", "x2"], ["lab"], "g", steps=1).count() > 0
    assert sizes and max(sizes) <= 8 * 2 ** (B.DEPTH - 1)
