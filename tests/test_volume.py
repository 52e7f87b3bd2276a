"""What is shuffled: rows move once and narrow, small frames move to them, and the results stay."""
import random

import pytest
from pyspark.sql import functions as F

from panelloom.functions.ordered import carry
from panelloom.operators import contrasts as co, knee as kn, metrics as me, rules as ru, trajectories as tr

META = ("aging_mode string, nominal_temperature_C double, voltage_window_family string, nominal_charge_C_rate double, "
        "nominal_discharge_C_rate double, profile_label string")
FOLDS = ", ".join(f"{f} int" for f in tr.FOLDS)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_small_joins(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def panel(spark, cells=3, n=40):
    """Points of cells with a gap in the check-up numbers."""
    rng = random.Random(4)
    rows = []
    for c in range(cells):
        t, e = 0.0, 0.0
        for i in range(n):
            k = i + (i > 20)
            rows.append((f"c{c}", c, 1, k, i, t, e, 3 - .01 * k - .02 * max(0, k - 15) + rng.random() / 50, 1.0))
            t, e = t + rng.choice([0.0, 1.0, 2.5]), e + rng.random()
    d = spark.createDataFrame(rows, "cell_id string, parameter_set int, replicate_id int, k int, idx int, calendar_days_since double, cum_efc double, "
                                    "capacity_Ah double, soh double")
    more = {c: F.lit(1.0) for c in ("t_s", "cum_q", "cum_h", "cum_days", "cum_efc_raw", "cum_q_raw", "prior_delta", "prior_slope")}
    more |= {c: F.lit(1) for c in ("n_efc", "n_q", "cum_rows", "cf0", "cf1", "cf2")}
    more |= {x.split()[0]: F.lit("m" if "string" in x else 1).cast(x.split()[1]) for x in (META + ", " + FOLDS).split(", ")}
    return d.withColumns(more), rows


def test_sums_after_and_totals(spark):
    rows = [(g, i, float(v)) for g in "ab" for i, v in enumerate(random.Random(1).choices(range(9), k=50))]
    d = spark.createDataFrame(rows, "g string, i int, v double").withColumn("c", F.floor(F.col("i") / 7))
    for r in carry(d, ["g"], "c", ["i"], sums_after={"rest": "v"}, totals={"all": "v"}).collect():
        own = [(i, v) for g, i, v in rows if g == r["g"]]
        assert r["rest"] == sum(v for i, v in own if i >= r["i"]) and r["all"] == sum(v for _, v in own)


def test_line_fits_move_points_once(spark):
    points, rows = panel(spark)
    fits = kn.line_fits(points, block=8)
    assert "Exchange" not in plan(fits).split("Generate explode")[0]   # series come after the last shuffle

    def sse(pts):
        n, mx, my = len(pts), sum(x for x, _ in pts) / len(pts), sum(y for _, y in pts) / len(pts)
        sxx = sum((x - mx) ** 2 for x, _ in pts)
        if n < 2 or len({x for x, _ in pts}) < 2:
            return float("inf")
        return sum((y - my) ** 2 for _, y in pts) - sum((x - mx) * (y - my) for x, y in pts) ** 2 / sxx
    axis = {"checkup_index": 3, "calendar_days": 5, "log_age_efc_cumulative": 6}
    got = fits.collect()
    assert len(got) == 6 * len(rows)
    for r in got:
        own = [x for x in rows if x[0] == r["cell_id"]]
        ys = [x[7] for x in own]
        if r["smoothing_policy"] == "rolling_3":
            ys = [ys[0], *[sum(ys[i - 1:i + 2]) / 3 for i in range(1, len(ys) - 1)], ys[-1]]
        pts = [(x[axis[r["x_axis"]]], y) for x, y in zip(own, ys)]
        assert r["pre_sse"] == pytest.approx(sse(pts[:r["idx"] + 1]), abs=1e-9) and r["post_sse"] == pytest.approx(sse(pts[r["idx"]:]), abs=1e-9)
        assert r["py"] == (pytest.approx(pts[r["idx"] - 1][1]) if r["idx"] else None)
        assert r["distinct_x"] == len({x for x, _ in pts})


def test_stability_counts_pairs_of_conditions_once(spark):
    rng = random.Random(2)
    rows = [(f"c{i}", i % 3, k, k, 3.0 - rng.randrange(6) / 4 * (k > 0)) for i in range(24) for k in range(3)]
    points = spark.createDataFrame(rows, "cell_id string, parameter_set int, k int, idx int, capacity_Ah double")
    reg = [(f"{f}_{a}_{b}", f, a, b, "matched_triplets") for f, a, b in (("t", 0, 1), ("v", 0, 1), ("t", 2, 0))]
    reg = spark.createDataFrame(reg, "contrast_id string, contrast_family string, arm_a_parameter_set int, arm_b_parameter_set int, support_quality string")
    out = co.observed_stability(reg, points)
    assert "hashpartitioning(contrast_id" not in plan(out)
    got = out.collect()
    assert len(got) == 6
    for r in got:
        a, b = ([3.0 - c for _, p, k, _, c in rows if p == r[f"arm_{s}_parameter_set"] and k == r["checkup_k"]] for s in "ab")
        assert r["wins"] == sum(y > x for x in a for y in b) and (r["arm_a_replicates"], r["arm_b_replicates"]) == (len(a), len(b))
        assert r["effect_b_minus_a"] == pytest.approx(sum(b) / len(b) - sum(a) / len(a))


def test_horizon_reads_points_once(spark, no_small_joins):
    points, rows = panel(spark)
    h = tr.horizon_table(points)
    assert "Exchange" not in plan(h).split("Generate explode")[0]
    own = {(c, k): i for c, _, _, k, i, *_ in rows}
    want = {(c, k, s) for (c, k), i in own.items() for s in tr.HORIZONS if own.get((c, k + s)) == i + s}
    assert {(r["cell_id"], r["checkup_k"], r["horizon_checkups"]) for r in h.collect()} == want
    # train means go to the test rows, which are not dealt by split and fold
    assert "BroadcastExchange" in plan(ru.horizon_predictions(h))


def test_diagnostic_horizon_repeats_no_points(spark):
    points, rows = panel(spark)
    state = points.filter("k % 3 <> 1").select("cell_id", "k", F.col("k").cast("double").alias("v")).withColumnRenamed("k", "checkup_k").withColumn("quality_flags", F.lit("OK"))
    out = tr.diagnostic_horizon(points, {"pulse": (state, ["v"])})
    assert not [x for x in plan(out).splitlines() if "Generate explode" in x and "nominal_temperature_C" in x]
    own = {(c, k) for c, _, _, k, *_ in rows}
    want = {(c, k, s) for c, k in own for s in tr.HORIZONS if (c, k + s) in own and (k + s) % 3 != 1}
    got = out.collect()
    assert {(r["cell_id"], r["checkup_k"], r["horizon_checkups"]) for r in got} == want and len(got) == len(want)
    assert all((r["diagnostic_value_k"] is None) == (r["checkup_k"] % 3 == 1) for r in got)


def test_best_arm_from_condition_errors(spark):
    rows = [("primary", "s", f, m, "g", "t", p, y, 0.0) for f in (0, 1) for m, e in (("L0_persistence", 2.0), ("L1_mean", 1.0)) for p, y in ((1, e), (1, 3 * e), (2, e + f))]
    d = spark.createDataFrame(rows, "run_scope string, split_name string, heldout_fold int, model_level string, feature_group string, target string, parameter_set int, y_pred double, y_true double")
    c = me.condition_errors(d)
    r = me.best_against_baseline(me.leaderboard(me.metrics_of(c)), c).first()
    assert (r["best_model_level"], r["worst_parameter_set"], r["worst_parameter_set_mae"]) == ("L1_mean", 1, 2.0)
