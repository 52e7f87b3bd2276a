"""Hand-made fixtures with known results for the log operators."""
import random

import pytest
from pyspark.sql import functions as F

from panelloom.functions.ordered import carry, quantiles, ranks, row_numbers
from panelloom.operators import dwell, events as ev, intervals as iv

T = [10, 20, 50, 100, 130, 160, 190, 220]
V = [3.2, 3.4, 3.7, 4.0, 4.2, 4.2, 3.5, 3.2]
I = [0.0, 3.2, 4.7, 5.2, -3.2, -4.7, 5.2, 0.0]
TEMP = [0.0, 10.0, 20.0, 35.0, 45.0, 0.0, 10.0, 25.0]
SOC = [10.0, 30.0, 60.0, 85.0, 90.0, 85.0, 30.0, 10.0]


def dwell_log(spark):
    rows = [("P001_1", i, float(t), v, a, c, q, 1 if t <= 100 else 2, 0.0 if t <= 100 else 100.0) for i, (t, v, a, c, q) in
            enumerate(zip(T, V, I, TEMP, SOC))]
    return spark.createDataFrame(rows, "cell_id string, seq long, timestamp_s double, v_raw_V double, i_raw_A double, t_cell_degC double, "
                                 "soc_est double, checkup_k int, window_start_s double")


def test_dwell_sums_match_observed_and_runs(spark):
    for chunk in (7.0, 45.0, 86400.0):
        lim = dwell.DwellLimits(chunk_s=chunk)
        gaps = dwell.capped_gaps(dwell_log(spark), lim)
        s = dwell.dwell_sums(gaps, lim).filter("checkup_k = 1").first()
        assert abs(s["stress_observed_duration_h"] * 3600 - 100) < 1e-9
        for bins in (dwell.VOLTAGE_BINS, dwell.TEMPERATURE_BINS, dwell.SOC_BINS):
            assert abs(sum(s[b[0]] for b in bins) * 3600 - 100) < 1e-9
        assert abs((s["charge_time_h"] + s["discharge_time_h"] + s["rest_time_h"]) * 3600 - 100) < 1e-9
        r = dwell.stress_runs(gaps, lim).filter("checkup_k = 1").first()
        assert r["n_charge_events"] == 1
        assert abs(r["max_charge_event_h"] * 3600 - 90) < 1e-9
        assert abs(r["max_abs_current_ge_1p5C_event_h"] * 3600 - 80) < 1e-9


def test_run_events(spark):
    t, a = [120, 180, 240, 300, 360, 420], [0.0, 5.0, 5.2, 0.0, -5.1, -5.0]
    rows = [("P001_1", i, float(x), 4.2, c, 8.0 if abs(c) > 1 else 25.0, 50.0, float(i), float(i), 1, 1, 0, 1) for i, (x, c) in enumerate(zip(t, a))]
    log = spark.createDataFrame(rows, "cell_id string, seq long, timestamp_s double, v_raw_V double, i_raw_A double, t_cell_degC double, soc_est double, "
                                "delta_q_Ah double, EFC double, parameter_set int, replicate_id int, checkup_k int, checkup_k_next int")
    want = [("rest", 1), ("charge", 2), ("rest", 1), ("discharge", 2)]
    for chunk in (50.0, 130.0, 86400.0):
        e = ev.run_events(log, ev.EventLimits(chunk_s=chunk)).orderBy("event_index").collect()
        assert [(r["event_type"], r["source_rows"]) for r in e] == want
        assert any(r["cold_high_current_event"] for r in e)
        assert e[0]["quality_flags"] == "zero_duration"


def test_range_join_bounds_and_buckets(spark):
    spine = spark.createDataFrame([("a", 0, 1, 0.0, 100.0), ("a", 1, 2, 100.0, 200000.0)], "cell_id string, checkup_k int, checkup_k_next int, window_start_s double, window_end_s double")
    pts = spark.createDataFrame([("a", 0.0), ("a", 100.0), ("a", 100.5), ("a", 200000.0), ("a", 200001.0), ("b", 50.0)], "cell_id string, timestamp_s double")
    got = {(r["timestamp_s"], r["checkup_k"]) for r in iv.range_join(pts, spine).collect()}
    assert got == {(100.0, 0), (100.5, 1), (200000.0, 1)}


def test_monotonicity_uses_stored_order(spark):
    rows = [("a", "f", 0, 20.0, 10.0), ("a", "f", 1, 80.0, 11.0), ("a", "f", 2, 70.0, 10.5), ("a", "f", 3, 200.0, 13.0)]
    log = spark.createDataFrame(rows, "cell_id string, source_file string, seq long, timestamp_s double, EFC double")
    for block in (1, 2, 65536):
        v = iv.monotonicity_violations(log, block=block).collect()
        assert [(r["seq"], r["violation_type"], r["timestamp_drop_s"], r["efc_drop"]) for r in v] == [(2, "both", 10.0, 0.5)]


def test_chunked_windows_equal_plain_loops_with_a_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < .7 else f"k{rng.randrange(9)}", i, float(rng.randrange(20)), float(rng.randrange(5))) for i in range(600)]
    df = spark.createDataFrame(rows, "key string, id long, x double, y double")
    got = carry(df.withColumn("c", F.floor(F.col("id") / 37)), ["key"], "c", ["id"], prev={"p": "x"}, nxt={"n": "x"}, sums={"s": "x"},
                sums_before={"b": F.lit(1)}, folds={"m": (F.max, "x")}).collect()
    by = {}
    for r in sorted(rows, key=lambda r: r[1]):
        by.setdefault(r[0], []).append(r)
    for r in got:
        seq = by[r["key"]]
        i = next(j for j, s in enumerate(seq) if s[1] == r["id"])
        xs = [s[2] for s in seq]
        assert r["p"] == (xs[i - 1] if i else None) and r["n"] == (xs[i + 1] if i + 1 < len(xs) else None)
        assert r["s"] == sum(xs[:i + 1]) and r["b"] == i and r["m"] == max(xs[:i + 1])
    rn = {(r["id"]): r["rn"] for r in row_numbers(df, ["key"], "x", "id", tie_bits=4).collect()}
    rk = {(r["id"]): r["rank"] for r in ranks(df, ["key"], "x").collect()}
    for seq in by.values():
        order = sorted(seq, key=lambda s: (s[2], s[1]))
        for pos, s in enumerate(order, 1):
            assert rn[s[1]] == pos
            same = [p for p, t in enumerate(order, 1) if t[2] == s[2]]
            assert rk[s[1]] == sum(same) / len(same)
    q = {r["key"]: r["q"] for r in quantiles(df, ["key"], "x", {"q": .3}).collect()}
    for k, seq in by.items():
        xs = sorted(s[2] for s in seq)
        p = .3 * (len(xs) - 1)
        want = xs[int(p)] + (p - int(p)) * (xs[min(int(p) + 1, len(xs) - 1)] - xs[int(p)])
        assert abs(q[k] - want) < 1e-9


def test_raw_files_with_another_header_are_an_error(spark, tmp_path):
    from panelloom.sources import ingest
    (tmp_path / "a_P001_1.csv").write_text("timestamp_s;v_raw_V\n1;3.5\n2;3.6\n")
    assert [r["v_raw_V"] for r in ingest.read_raw(spark, str(tmp_path)).orderBy("timestamp_s").collect()] == ["3.5", "3.6"]
    (tmp_path / "b_P001_2.csv").write_text("v_raw_V;timestamp_s\n3.7;3\n")
    with pytest.raises(Exception, match="CSV header does not conform"):
        ingest.read_raw(spark, str(tmp_path)).collect()


def test_ties_null_keys_and_hot_values(spark):
    from pyspark.sql import functions as F
    from panelloom.functions.ordered import attach, carry, quantiles, ranks, row_numbers
    rows = [(None if i % 5 == 0 else f"k{i % 2}", None if i % 7 == 0 else (0.5 if i % 3 else float(i)), i) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, x double, i long").withColumn("h", F.shiftrightunsigned(F.xxhash64("i"), 16))
    got = {r["i"]: r["rn"] for r in row_numbers(df, ["k"], "x", "h").collect()}
    order = {r["i"]: r["h"] for r in df.collect()}
    for key in (None, "k0", "k1"):
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0.0, order[r[2]]))
        assert [got[r[2]] for r in mine] == list(range(1, len(mine) + 1))
    assert ranks(df, ["k"], "x").count() == 600
    assert {r["k"] for r in quantiles(df, ["k"], "x", {"m": .5}).collect()} == {None, "k0", "k1"}
    small = spark.createDataFrame([(None, 1)], "k string, v int")
    assert attach(df, small, ["k"]).where("v = 1").count() == 120
    # a third of the rows share one value; no block of the tie holds more than a few of them
    d = df.where("x = 0.5").groupBy("k", F.shiftright("h", 38)).count()
    assert d.agg(F.max("count")).first()[0] < 20
    seen = carry(df.withColumn("c", F.floor(F.col("i") / 50)), ["k"], "c", ["i"], prev={"p": "i"}, nxt={"n": "x"}, sums={"s": F.lit(1)}).collect()
    for key in (None, "k0", "k1"):
        mine = sorted((r for r in seen if r["k"] == key), key=lambda r: r["i"])
        assert [r["p"] for r in mine] == [None] + [r["i"] for r in mine[:-1]]
        assert [r["n"] for r in mine] == [r["x"] for r in mine[1:]] + [None] and [r["s"] for r in mine] == list(range(1, len(mine) + 1))
