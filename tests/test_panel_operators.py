"""Fixtures for diagnostics, labels, rankings, splits, estimators and contracts."""
import random

import pytest
from pyspark.sql import functions as F

from panelloom.contracts import CONTRACTS
from panelloom.operators import audit as au, contrasts as co, diagnostics as dg, metrics as me, rules as ru, sequences as sq, splits as sp, uncertainty as un
from panelloom.sources import files as fl, ingest as ing


def test_nearest_checkup_equals_brute_force(spark):
    rng = random.Random(3)
    chk = [("a", float(t), k) for k, t in enumerate(sorted(rng.sample(range(0, 900000, 100), 40)))] + [("b", 500.0, 0)]
    pts = [(rng.choice("abz"), float(rng.randrange(0, 1000000, 50)), i) for i in range(200)]
    got = dg.nearest_checkup(spark.createDataFrame(pts, "cell_id string, timestamp double, point_id long"),
                             spark.createDataFrame(chk, "cell_id string, timestamp double, checkup_k int")).collect()
    assert len(got) == 200
    for r in got:
        own = [(abs(t - r["timestamp"]), k) for c, t, k in chk if c == r["cell_id"]]
        want = min(own) if own else (0.0, 0)
        assert (r["alignment_delta_s"], r["checkup_k"]) == want


def test_pulse_targets(spark):
    rows = [(f"P00{p}_{r}", k, 50.0, "RT", d, .010 + .001 * k, .020 + .002 * k, 0.0) for p in (1, 2) for r in (1, 2, 3) for k in range(3) for d in ("charge", "discharge")]
    s = spark.createDataFrame(rows, "cell_id string, checkup_k int, soc_percent double, temperature_context string, pulse_direction string, pulse_10ms_resistance double, pulse_1s_resistance double, alignment_delta_s double")
    iv = spark.createDataFrame([(f"P00{p}_{r}", p, r, k, k + 1) for p in (1, 2) for r in (1, 2, 3) for k in (0, 1)], "cell_id string, parameter_set int, replicate_id int, checkup_k int, checkup_k_next int")
    out = dg.pulse_targets(iv, s).orderBy("cell_id", "checkup_k").collect()
    assert len(out) == 12 and out[0]["quality_flags"] == "OK"
    assert out[0]["pulse_1s_resistance_k"] == pytest.approx(.020) and out[0]["delta_pulse_1s_resistance"] == pytest.approx(.002)


def test_kendall_matches_pairs(spark):
    rng = random.Random(5)
    rows = [("g", i, float(rng.randrange(8)), float(rng.randrange(6))) for i in range(60)]
    got = co.kendall_tau_b(spark.createDataFrame(rows, "g string, id int, x double, y double"), ["g"], "x", "y").first()["kendall_tau_b"]
    c = d = tx = ty = 0
    for i in range(60):
        for j in range(i):
            a, b = rows[i][2] - rows[j][2], rows[i][3] - rows[j][3]
            tx, ty = tx + (a != 0), ty + (b != 0)
            c, d = c + (a * b > 0), d + (a * b < 0)
    assert got == pytest.approx((c - d) / (tx * ty) ** .5)


def test_pareto_matches_pairs(spark):
    rng = random.Random(7)
    rows = [(f"m{i}", rng.randrange(6) / 10, rng.randrange(-3, 6) / 10) for i in range(40)]
    got = {r["model_setting_id"]: r["is_nondominated"] for r in un.pareto_frontier(spark.createDataFrame(rows, "model_setting_id string, gain double, degradation double")).collect()}
    for n, g, c in rows:
        assert got[n] == (not any(b >= g and d <= c and (b > g or d < c) for _, b, d in rows))


def test_auroc_with_ties_and_one_class(spark):
    rows = [("a", .5, 1), ("a", .5, 0), ("a", .9, 1), ("a", .1, 0), ("b", .3, 0)]
    got = {r["g"]: r["auroc"] for r in me.auroc(spark.createDataFrame(rows, "g string, p double, y int"), ["g"]).collect()}
    assert got["a"] == pytest.approx(.875) and got["b"] is None


def test_event_selection_keeps_ends_and_count(spark):
    for n in (3, 6, 7, 50, 1001):
        d = spark.range(n).select(F.col("id").alias("event_index"), F.lit(n).alias("event_count"))
        got = [r[0] for r in d.filter(sq.is_selected(F.col("event_index"), F.col("event_count"), 6)).collect()]
        assert sorted(got) == (list(range(n)) if n <= 6 else sorted({round(i * (n - 1) / 5) for i in range(6)}))


def test_split_registry_groups_replicates(spark):
    cells = spark.createDataFrame([(f"P{p:03d}_{r}", p, r, "cyclic", float(40 * (p % 2)), "approx_0_100", 1.0, 1.0) for p in range(11) for r in (1, 2, 3)],
                                  "cell_id string, parameter_set int, replicate_id int, aging_mode string, nominal_temperature_C double, voltage_window_family string, nominal_charge_C_rate double, nominal_discharge_C_rate double")
    reg = sp.split_registry(cells)
    assert reg.groupBy("parameter_set").agg(F.countDistinct("condition_fold").alias("n")).filter("n > 1").count() == 0
    sizes = [r["n"] for r in reg.groupBy("condition_fold").agg(F.countDistinct("parameter_set").alias("n")).collect()]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == 11
    assert sp.fold_overlap(reg).count() == 0


def test_weights_have_mean_one_and_leak_guard(spark):
    d = spark.createDataFrame([("x", i % 3 if i < 6 else 0) for i in range(20)], "s string, g int")
    w = ru.balanced_weights(d, ["s"], F.col("g"), .7).agg(F.avg("weight")).first()[0]
    assert w == pytest.approx(1.0)
    with pytest.raises(ValueError):
        ru.fit_encoder(d, ["g"], [], ["g"])


def test_ridge_matches_closed_form(spark):
    import numpy as np
    from pyspark.ml.feature import VectorAssembler
    from panelloom.operators.models import ridge
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 3))
    x = (x - x.mean(0)) / x.std(0)
    y = x @ [1.0, -2.0, .5] + rng.normal(size=120)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, c double, y double")
    m = ridge(VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df), "y", 1.0)
    want = np.linalg.solve(x.T @ x + np.eye(3), x.T @ (y - y.mean()))
    assert np.allclose(m.coefficients.toArray(), want, atol=1e-6)


def test_digest_ignores_order_and_sees_changes(spark):
    a = spark.range(50).withColumn("v", F.col("id") * 2)
    same = au.compare_products(a, a.orderBy(F.desc("id")), ["id", "v"]).first()
    other = au.compare_products(a, a.withColumn("v", F.when(F.col("id") == 7, 0).otherwise(F.col("v"))), ["id", "v"]).first()
    assert same["digest_equal"] and not other["digest_equal"] and other["rows_equal"]
    assert au.differences(a, a.filter("id <> 3"), ["id", "v"]).first().asDict() == {"only_current": 1, "only_rebuilt": 0}


def test_contracts():
    assert len(CONTRACTS) == 28
    assert len(CONTRACTS["intervals"].fields) == 58 and len(CONTRACTS["stress"].fields) == 70
    assert len(CONTRACTS["run_events"].fields) == 34 and len(CONTRACTS["eis_features"].fields) == 49
    assert all(len(set(c.names)) == len(c.names) for c in CONTRACTS.values())


def test_raw_ingest_and_inventory(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "log_age_P001_2.csv").write_text("timestamp_s;v_raw_V;i_raw_A;EFC\n1;3.5;nan;0.1\n2;NULL;1.5;0.2\n")
    (tmp_path / "log" / "log_age_bad.csv").write_text("timestamp_s;v_raw_V;i_raw_A;EFC\n1;3;1;0\n")
    raw = ing.read_raw(spark, str(tmp_path / "log"))
    cohort = spark.createDataFrame([("P001_2",)], "cell_id string")
    rows = ing.log_table(raw, cohort).orderBy("timestamp_s").collect()
    assert [(r["cell_id"], r["v_raw_V"], r["i_raw_A"]) for r in rows] == [("P001_2", 3.5, None), ("P001_2", None, 1.5)]
    assert ing.excluded(raw, cohort, "log").first()["reason"] == "Malformed cell ID pattern"
    inv = {r["name"]: r for r in fl.inventory(spark, str(tmp_path)).collect()}
    assert inv["log_age_P001_2.csv"]["modality"] == "log_age" and inv["log_age_P001_2.csv"]["cell_id"] == "P001_2"
    import zipfile
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("cell_eis_P003_1.csv", "a;b")
    m = fl.members(spark, str(tmp_path)).first()
    assert (m["modality"], m["cell_id"], m["uncompressed_size_bytes"]) == ("eis", "P003_1", 3)
