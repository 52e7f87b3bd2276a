"""Ridge arms from summed blocks against plain row-level fits."""
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.operators import ridge as R
from panelloom.operators.splits import SPLITS

SCHEMA = ("cell_id string, parameter_set int, checkup_k int, condition_fold int, temperature_holdout_fold int, c_rate_holdout_fold int, "
          "profile_holdout_fold int, voltage_window_holdout_fold int, nominal_temperature_C double, nominal_charge_C_rate double, "
          "nominal_discharge_C_rate double, voltage_window_family string, profile_label string, aging_mode string, x1 double, x2 double, "
          "x3 double, y double, w double")
NUMERIC, CATEGORICAL = ["x1", "x2", "x3", "nominal_temperature_C"], ["voltage_window_family", "aging_mode"]
GROUPS = {"small": (["x1"], []), "full": (NUMERIC, CATEGORICAL)}


def panel():
    r = np.random.default_rng(7)
    rows = []
    for p in range(12):
        t, c, w = [10.0, 25.0, 40.0][p % 3], [0.5, 1.0, 1.667][p // 4], ["a", "b", None][p % 3 if p != 5 else 0]
        folds = (p % 5, [1, 0, 2][p % 3], int(c > 1.5), int(p % 6 == 0), 1 + p % 2)
        mode, profile = ["cyc", "cal"][p % 4 == 0], f"f{p % 2}"
        for k in range(4 + 3 * (p % 4)):
            x1 = None if (p + k) % 7 == 0 else float(1e6 + 50 * r.normal())          # far from zero
            x2, x3 = float(r.normal()), 3.0 if p % 2 else float("nan")
            y = None if k == 2 and p % 3 == 0 else 0.01 * ((x1 or 1e6) - 1e6) + 0.5 * x2 + 0.1 * t + float(r.normal()) * 0.1
            aux = None if k % 3 == 1 else 0.3 * x2 + float(r.normal()) * 0.2
            rows.append((f"c{p}", p, k, *folds, t, c, 1.0, w, profile, mode, x1, x2, x3, y, aux))
    return rows


@pytest.fixture(scope="module")
def data(spark):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame(panel(), SCHEMA).repartition(5), [dict(zip(names, r)) for r in panel()]


def encoded(train, rows, numeric, categorical):
    out = np.zeros((len(rows), 0))
    num = lambda v: v if v is not None and np.isfinite(v) else np.nan
    for c in numeric:
        a = np.array([num(r[c]) for r in train])
        a = a[~np.isnan(a)]
        mean, std = (a.mean(), a.std()) if len(a) else (0.0, 0.0)
        std = std if std > 1e-9 else 1.0
        b = np.array([num(r[c]) for r in rows])
        out = np.column_stack([out, np.where(np.isnan(b), 0.0, (b - mean) / std)])
    for c in categorical:
        for v in sorted({str(r[c]) for r in train}):
            out = np.column_stack([out, [float(str(r[c]) == v) for r in rows]])
    return out


def ridge(train, rows, numeric, categorical, target="y", weights=None, alpha=1.0, extra=None, extra_rows=None):
    train_kept = [i for i, r in enumerate(train) if r[target] is not None]
    kept = [train[i] for i in train_kept]
    a, b = encoded(kept, kept, numeric, categorical), encoded(kept, rows, numeric, categorical)
    if extra is not None:
        e = extra[train_kept]
        m, s = e.mean(), e.std() or 1.0
        a, b = np.column_stack([a, (e - m) / s]), np.column_stack([b, (extra_rows - m) / s])
    y = np.array([r[target] for r in kept])
    w = np.ones(len(y)) if weights is None else weights[train_kept]
    m, my = np.average(a, axis=0, weights=w), np.average(y, weights=w)
    beta = np.linalg.solve((a - m).T @ ((a - m) * w[:, None]) + alpha * np.eye(a.shape[1]), (a - m).T @ ((y - my) * w))
    return (b - m) @ beta + my


def folds(rows):
    return [(s, f) for s in SPLITS for f in sorted({r[s] for r in rows}) if s == "condition_fold" or f != 0]


def compared(data, arms, want, targets=("y",), extra=()):
    df, rows = data
    pred, _ = R.run(df, list(targets), arms, NUMERIC, CATEGORICAL, extra_targets=extra)
    got = {(r["split_name"], r["heldout_fold"], r["model_level"], r["feature_group"], r["target"], r["cell_id"], r["checkup_k"]): (r["y_pred"], r["y_true"]) for r in pred.collect()}
    seen = 0
    for s, f in folds(rows):
        train, test = [r for r in rows if r[s] != f], [r for r in rows if r[s] == f and r["y"] is not None]
        if not train or not test:
            continue
        for (model, group), values in want(train, test, s, f).items():
            for r, v in zip(test, values):
                p, y = got[(s, f, model, group, "y", r["cell_id"], r["checkup_k"])]
                assert abs(p - v) < 1e-7 and y == r["y"], (s, f, model, group, p, v)
                seen += 1
    assert seen == len(got) > 100


def test_plain_and_bias_corrected(data):
    def want(train, test, s, f):
        out = {}
        for name, (numeric, categorical) in GROUPS.items():
            p, own = ridge(train, test, numeric, categorical), ridge(train, train, numeric, categorical)
            key = lambda r: (r["nominal_temperature_C"], r["voltage_window_family"], "<1" if r["nominal_charge_C_rate"] < 1 else "<1.5" if r["nominal_charge_C_rate"] < 1.5 else "more")
            res = [(key(r), r["y"] - v) for r, v in zip(train, own) if r["y"] is not None]
            every = np.mean([e for _, e in res])
            bias = [np.mean([e for k, e in res if k == key(r)]) if any(k == key(r) for k, _ in res) else every for r in test]
            out["L1_ridge", name], out["L1_ridge_bias_corrected", name] = p, p + np.array(bias)
        return out
    compared(data, R.corrected_arms(GROUPS), want)


def test_hierarchical(data):
    attributes = ["nominal_temperature_C", "nominal_charge_C_rate", "voltage_window_family", "profile_label", "aging_mode"]

    def want(train, test, s, f):
        out = {}
        for name, (numeric, categorical) in GROUPS.items():
            p, own = ridge(train, test, numeric, categorical), ridge(train, train, numeric, categorical)
            res = [(r, r["y"] - v) for r, v in zip(train, own) if r["y"] is not None]
            offset = []
            for r in test:
                hits = [e for c in attributes for e in [[e for q, e in res if q[c] == r[c]]] if len(e) >= 3]
                hits = [np.mean(e) * len(e) / (len(e) + 5.0) for e in hits]
                offset.append(np.mean(hits) if hits else np.mean([e for _, e in res]))
            out["H0_global_train_mean", name] = np.full(len(test), np.mean([r["y"] for r in train if r["y"] is not None]))
            out["H1_state_time_ridge", name], out["H2_partial_pooling_ridge", name] = p, p + np.array(offset)
        return out
    compared(data, R.hierarchical_arms(GROUPS), want)


def weights_of(train, group, strength):
    kept = [r for r in train if r["y"] is not None]
    count = {g: sum(group(r) == g for r in kept) for g in {group(r) for r in kept}}
    return np.array([1 + strength * (len(kept) / (count[group(r)] * len(count)) - 1) if group(r) in count else 0.0 for r in train])


def test_condition_weights_and_bags(data):
    def want(train, test, s, f):
        out = {("R0_reference", "full"): ridge(train, test, NUMERIC, CATEGORICAL),
               ("R1_condition_balanced", "full"): ridge(train, test, NUMERIC, CATEGORICAL, weights=weights_of(train, lambda r: r["parameter_set"], 1.0))}
        units = sorted({str(r["parameter_set"]) for r in train if r["y"] is not None})
        bags = []
        for b in range(3):
            draws = [units[int(hashlib.md5(f"42|{b}|{s}|{f}|{i}".encode()).hexdigest()[:12], 16) % len(units)] for i in range(len(units))]
            drawn = [r for r in train if str(r["parameter_set"]) in draws]
            bags.append(ridge(drawn, test, NUMERIC, CATEGORICAL, weights=np.array([float(draws.count(str(r["parameter_set"]))) for r in drawn])))
        out["R3_bagged", "full"] = np.mean(bags, axis=0)
        return out

    def arms(side):
        return [r for r in R.weighted_arms("full", NUMERIC, CATEGORICAL, bags=3)(side) if r["model_level"] != "R2_stressor_balanced"]
    compared(data, arms, want)


def test_stacking(data):
    def want(train, test, s, f):
        units = sorted({str(r["parameter_set"]) for r in train + test if r["y"] is not None})
        every = sorted({str(r["parameter_set"]) for r in data[1] if r["y"] is not None})
        key = lambda u: (int(hashlib.md5(f"42|{u}".encode()).hexdigest()[:12], 16), u)
        fold = {u: i % 3 for i, u in enumerate(sorted(every, key=key))}
        assert set(units) <= set(fold)
        full = ridge(train, test, NUMERIC, CATEGORICAL, target="w")
        aux = np.zeros(len(train))
        for i in range(3):
            at = [j for j, r in enumerate(train) if fold[str(r["parameter_set"])] == i]
            rest = [r for r in train if fold[str(r["parameter_set"])] != i]
            if at:
                known = rest if any(r["w"] is not None for r in rest) else train
                aux[at] = ridge(known, [train[j] for j in at], NUMERIC, CATEGORICAL, target="w")
        return {("D0_without_state", "full"): ridge(train, test, NUMERIC, CATEGORICAL),
                ("D1_auxiliary_state", "full"): ridge(train, test, NUMERIC, CATEGORICAL, extra=aux, extra_rows=full)}
    compared(data, R.stacked_arms("w", "full", NUMERIC, CATEGORICAL), want, extra=["w"])


def test_nested_selection(data):
    df, rows = data
    settings = [("R0_reference", "R0", 0.0), ("R1_half", "R1", 0.5), ("R1_full", "R1", 1.0)]
    arms = R.nested_arms("full", NUMERIC, CATEGORICAL, settings=settings, seeds=(42, 43))
    scores = R.run_nested(df, ["y"], arms, NUMERIC, CATEGORICAL)
    got = {(r["split_name"], r["heldout_fold"], r["seed"], r["setting"]): r for r in scores.collect()}
    for s, f in folds(rows):
        train = [r for r in rows if r[s] != f]
        if not train or all(r[s] == f for r in rows):
            continue
        for seed in (42, 43):
            units = sorted({str(r["parameter_set"]) for r in train if r["y"] is not None})
            key = lambda u: (int(hashlib.md5(f"{seed}|{u}".encode()).hexdigest()[:12], 16), u)
            fold = {u: i % 3 for i, u in enumerate(sorted(units, key=key))}
            for name, _, strength in settings:
                means, worst = [], 0.0
                for i in range(3):
                    fit = [r for r in train if fold[str(r["parameter_set"])] != i]
                    check = [r for r in train if fold[str(r["parameter_set"])] == i and r["y"] is not None]
                    p = ridge(fit, check, NUMERIC, CATEGORICAL, weights=weights_of(fit, lambda r: r["parameter_set"], strength))
                    errors = [np.mean([abs(v - r["y"]) for r, v in zip(check, p) if r["parameter_set"] == u]) for u in {r["parameter_set"] for r in check}]
                    means.append(np.mean(errors))
                    worst = max(worst, max(errors))
                r = got[s, f, seed, name]
                assert abs(r["mean_condition_mae"] - np.mean(means)) < 1e-8 and abs(r["worst_condition_mae"] - worst) < 1e-8
    picks = R.chosen(scores, "worst").collect()
    assert len(picks) == len({k[:3] for k in got})
    for r in picks:
        best = min((got[k]["worst_condition_mae"], got[k]["mean_condition_mae"], k[3]) for k in got if k[:3] == (r["split_name"], r["heldout_fold"], r["seed"]))
        assert r["setting"] == best[2]
    for policy in ("max_gain_guarded", "conservative_guarded"):
        for r in R.adaptive_selection(scores, policy, limit=0.05).collect():
            mine = {k[3]: got[k]["by_fold"] for k in got if k[:3] == (r["split_name"], r["heldout_fold"], r["seed"])}
            ref = mine["R0_reference"]
            info = {n: (np.mean([ref[i] - m[i] for i in ref]), max((m[i] - ref[i]) / ref[i] for i in ref)) for n, m in mine.items() if n != "R0_reference"}
            ok = {n for n, (gain, loss) in info.items() if loss <= 0.05 and gain > 0}
            want = ((max(ok, key=lambda n: info[n][0]) if policy == "max_gain_guarded" else min(ok)) if ok else
                    min(info, key=lambda n: info[n][1]) if policy == "max_gain_guarded" else min(info))
            assert r["setting"] == want and r["guarded"] == bool(ok)


def test_hot_condition_and_many_partials(spark, data):
    """A condition that holds most rows, on many partitions, gives the blocks of one partition."""
    df, _ = data
    hot = df.union(df.where("parameter_set = 3").crossJoin(spark.range(40)).drop("id")).repartition(150)
    places = R.layout(hot, NUMERIC, CATEGORICAL)
    key = lambda t: {(r["unit"], r["target"]): np.array(r["block"]) for r in t.collect()}
    a = key(R.blocks(R.designed(hot, places, ["y", "w"]), ["y", "w"]))
    b = key(R.blocks(R.designed(hot.coalesce(1), places, ["y", "w"]), ["y", "w"]))
    assert a.keys() == b.keys() and all(np.abs(a[k] - b[k]).max() < 1e-9 * max(1, np.abs(b[k]).max()) for k in a)


def test_no_rows(data):
    df, _ = data
    pred, models = R.run(df.where(F.lit(False)), ["y"], R.plain_arms(GROUPS), NUMERIC, CATEGORICAL)
    assert pred.collect() == [] and models.collect() == []
