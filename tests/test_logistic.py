"""Joint logistic fits and calibration against plain fits."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.operators import logistic as L

from test_ridge_blocks import CATEGORICAL, GROUPS, NUMERIC, SCHEMA, encoded, folds, panel


def rows_with_labels():
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    out = []
    for r in panel():
        d = dict(zip(names, r))
        d["e"] = None if d["y"] is None else float(d["y"] > 2.2)
        d["rare"] = float(d["parameter_set"] == 5 and d["checkup_k"] < 2)
        out.append(d)
    return out


def plain_logistic(x, y, penalty):
    """Newton with halving on one design."""
    a = np.column_stack([np.ones(len(x)), x])
    b, p = np.zeros(a.shape[1]), np.diag(np.r_[0.0, np.full(a.shape[1] - 1, penalty)])
    loss = lambda b: np.logaddexp(0, a @ b).sum() - y @ (a @ b) + 0.5 * b @ p @ b
    for _ in range(200):
        q = 1 / (1 + np.exp(-a @ b))
        step = -np.linalg.lstsq(a.T @ (a * (q * (1 - q))[:, None]) + p, a.T @ (q - y) + p @ b, rcond=1e-12)[0]
        while loss(b + step) > loss(b) + 1e-12 and np.abs(step).max() > 1e-12:
            step = step / 2
        b = b + step
        if np.abs(step).max() < 1e-11:
            break
    return b


@pytest.fixture(scope="module")
def data(spark):
    rows = rows_with_labels()
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in [*names, "e", "rare"]) for r in rows], SCHEMA + ", e double, rare double").repartition(4), rows


@pytest.mark.parametrize("aside", [False, True])
def test_logistic_arms(spark, data, aside):
    df, rows = data
    left = [("condition_fold", 0, "e", 1), ("condition_fold", 0, "e", 6), ("temperature_holdout_fold", 1, "rare", 2)] if aside else []
    table = spark.createDataFrame(left, "split_name string, heldout_fold int, target string, parameter_set int") if aside else None
    pred = L.logistic_arms(df, ["e", "rare"], GROUPS, leave_out=table)
    got = {(r["split_name"], r["heldout_fold"], r["feature_group"], r["target"], r["cell_id"], r["checkup_k"]): (r["y_pred"], r["calibration"]) for r in pred.collect()}
    seen = 0
    for s, f in folds(rows):
        for t in ("e", "rare"):
            out = {p for a, b, c, p in left if (a, b, c) == (s, f, t)}
            train = [r for r in rows if r[s] != f and r["parameter_set"] not in out and r[t] is not None]
            check = [r for r in rows if r[t] is not None and (r[s] == f or r["parameter_set"] in out)]
            y = np.array([r[t] for r in train])
            for name, (numeric, categorical) in GROUPS.items():
                if 0 < y.mean() < 1:
                    b = plain_logistic(encoded(train, train, numeric, categorical), y, 1.0)
                    p = 1 / (1 + np.exp(-(encoded(train, check, numeric, categorical) @ b[1:] + b[0])))
                else:
                    p = np.full(len(check), y.mean())
                for r, v in zip(check, p):
                    value, marked = got[s, f, name, t, r["cell_id"], r["checkup_k"]]
                    assert abs(value - v) < 1e-6 and marked == (r[s] != f), (s, f, name, t, value, v)
                    seen += 1
    assert seen == len(got) and (NUMERIC, CATEGORICAL) == GROUPS["full"]


def plain_isotonic(p, y):
    order = np.argsort(p, kind="stable")
    xs = sorted(set(p))
    blocks = []
    for x in xs:
        at = [i for i in order if p[i] == x]
        blocks.append([x, x, float(np.mean([y[i] for i in at])), len(at)])
        while len(blocks) > 1 and blocks[-2][2] >= blocks[-1][2]:
            a, b = blocks[-2:]
            blocks[-2:] = [[a[0], b[1], (a[2] * a[3] + b[2] * b[3]) / (a[3] + b[3]), a[3] + b[3]]]
    return blocks


def sample(n, seed, ties):
    r = np.random.default_rng(seed)
    p = r.random(n)
    p = np.round(p, 1) if ties else p
    return p, (r.random(n) < p ** 2).astype(int)


def test_isotonic_steps_in_chunks(spark):
    rows = []
    for k, (n, ties) in enumerate([(400, False), (300, True), (5, False), (900, True)]):
        p, y = sample(n, k, ties)
        rows += [(f"g{k}", float(a), int(b)) for a, b in zip(p, y)]
    base = spark.createDataFrame(rows, "g string, p double, y int").repartition(6)
    for chunk in (10, 100_000):
        got = sorted(map(tuple, L.isotonic(base, ["g"], chunk).collect()))
        want = sorted((g, a, b, m) for g in {r[0] for r in rows} for a, b, m, _ in plain_isotonic([r[1] for r in rows if r[0] == g], [r[2] for r in rows if r[0] == g]))
        assert len(got) == len(want)
        assert all(a[0] == b[0] and np.allclose(a[1:], b[1:], atol=1e-12) for a, b in zip(got, want))
    steps = L.isotonic(base, ["g"])
    grid = spark.createDataFrame([(f"g{k}", i / 57, i) for k in range(4) for i in range(58)], "g string, p double, extra int")
    for r in L.apply_isotonic(grid, steps, ["g"]).collect():
        own = plain_isotonic([x[1] for x in rows if x[0] == r["g"]], [x[2] for x in rows if x[0] == r["g"]])
        xs, vs = [v for a, b, _, _ in own for v in (a, b)], [m for _, _, m, _ in own for _ in (0, 1)]
        assert abs(r["p_calibrated"] - np.interp(r["p"], xs, vs)) < 1e-12


def test_calibrated(spark):
    rows, want = [], {}
    for k, n in enumerate((300, 200, 12)):
        p, y = sample(n, 10 + k, k == 1)
        p = np.clip(p, 0.02, 0.98)
        if k == 2:
            y[:] = 0
        rows += [(f"g{k}", i, float(a), int(b), i % 3 > 0) for i, (a, b) in enumerate(zip(p, y))]
    df = spark.createDataFrame(rows, "g string, i int, p double, y int, calibration boolean")
    got = {(r["g"], r["i"], r["method"]): (r["p_calibrated"], r["applied"]) for r in L.calibrated(df, ["g"]).collect()}
    for g in ("g0", "g1"):
        base = [(r[2], r[3]) for r in rows if r[0] == g and r[4]]
        logit = lambda v: np.log(v / (1 - v))
        b = plain_logistic(logit(np.array([a for a, _ in base]))[:, None], np.array([float(y) for _, y in base]), 0.0)
        steps = plain_isotonic([a for a, _ in base], [y for _, y in base])
        xs, vs = [v for a, c, _, _ in steps for v in (a, c)], [m for _, _, m, _ in steps for _ in (0, 1)]
        for r in rows:
            if r[0] == g and not r[4]:
                want[g, r[1], "raw"] = r[2]
                want[g, r[1], "platt"] = 1 / (1 + np.exp(-(b[0] + b[1] * logit(r[2]))))
                want[g, r[1], "isotonic"] = np.interp(r[2], xs, vs)
    for r in rows:
        if r[0] == "g2" and not r[4]:
            want |= {("g2", r[1], m): r[2] for m in ("raw", "platt", "isotonic")}
    assert got.keys() == want.keys()
    assert all(abs(got[k][0] - v) < 1e-6 for k, v in want.items())
    assert {a for (g, _, _), (_, a) in got.items() if g == "g2"} == {"raw"}
    assert L.calibrated(df.where(F.lit(False)), ["g"]).collect() == []
