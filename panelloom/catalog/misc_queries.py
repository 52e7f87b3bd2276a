"""Queries over sequences, text functions, audits and digests."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..contracts import CONTRACTS
from ..functions import scalar as S
from ..operators import audit as au, sequences as sq, splits as sp, trajectories as tr
from . import features as fe
from .base import Q, table

LIMITS = {"v1": sq.MAX_EVENTS_V1, "v2": sq.MAX_EVENTS_V2}


def _f(name: str) -> str:
    if name.startswith("event_type_"):
        return f"(event_type = '{name.removeprefix('event_type_')}')::INT::DOUBLE"
    if name == "log1p_event_duration_h":
        return "ln(1 + greatest(0.0, event_duration_h))"
    if name == "normalized_event_position":
        return "event_index / greatest(1, n - 1)::DOUBLE"
    return f"{name}::INT::DOUBLE" if name.endswith("_event") else f"coalesce({name}, 0.0)::DOUBLE"


table("evn", "SELECT *, count(*) OVER (PARTITION BY cell_id, checkup_k) AS n FROM runev")
for _t, _lay in (("v1", sq.VECTOR_V1), ("v2", sq.TENSOR_V2)):
    table(f"ev{_t}", f"SELECT cell_id, checkup_k, event_index, n, [{', '.join(_f(x) for x in _lay)}] AS vec FROM evn")
_sum = lambda c: F.aggregate(F.col(c), F.lit(0.0), lambda a, b: a + b)
_chk = "list_sum(list_transform(vec, lambda x, i: x * i))"
for _n, _t, _lay in (("T03_event_vector", "v1", sq.VECTOR_V1), ("T04_tensor_vector", "v2", sq.TENSOR_V2)):
    Q(_n, lambda v, _lay=_lay: sq.event_vectors(v.run_events, _lay).withColumns({"width": F.size("vector"), "weighted": sq.checksum("vector")}), "cell_id checkup_k:i event_index:i width:i weighted:r",
      f"SELECT *, len(vec) AS width, {_chk} AS weighted FROM ev{_t}")
for _t, _l in LIMITS.items():
    table(f"evsel{_t}", f"""SELECT * FROM evn e WHERE e.n <= {_l} OR e.event_index IN (
      SELECT round_even(i * (e.n - 1) / {_l - 1}.0::DOUBLE, 0) FROM (SELECT unnest(range({_l})) AS i))""")
Q("W23_event_sampling", lambda v: sq.selected_events(sq.event_vectors(v.run_events)), "cell_id checkup_k:i event_index:i event_count:i", "SELECT cell_id, checkup_k, event_index, n AS event_count FROM evselv1")


def _flat(t, lay):
    w = len(lay)
    return f"""SELECT s.cell_id, s.checkup_k, coalesce(max(e.n), 0) AS event_count, count(e.event_index) AS selected_event_count, coalesce(max(e.n), 0) - count(e.event_index) AS truncated_event_count, {LIMITS[t] * w} AS vector_size,
      coalesce(sum(list_sum(list_transform(v.vec, lambda x, i: x * (i + {w} * e.r)))), 0.0) AS weighted FROM spine s LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY cell_id, checkup_k ORDER BY event_index) - 1 AS r FROM evsel{t}) e USING (cell_id, checkup_k)
      LEFT JOIN ev{t} v ON v.cell_id = e.cell_id AND v.checkup_k = e.checkup_k AND v.event_index = e.event_index GROUP BY ALL"""


SEQ = "cell_id checkup_k:i event_count:i selected_event_count:i truncated_event_count:i vector_size:i weighted:r"
for _n, _t, _lay in (("T06_event_sequence_table", "v1", sq.VECTOR_V1), ("T07_event_tensor_table", "v2", sq.TENSOR_V2), ("T05_pad_flatten_mask", "v1", sq.VECTOR_V1)):
    Q(_n, lambda v, _lay=_lay, _t=_t: sq.sequence_table(v.spine, v.run_events, _lay, LIMITS[_t]).withColumns({"vector_size": F.size("true_sequence_vector"), "weighted": sq.checksum("true_sequence_vector"),
      "mask_on": F.size(F.filter("event_mask", lambda x: x == 1))}), SEQ + (" mask_on:i" if "T05" in _n else ""), f"SELECT *, selected_event_count AS mask_on FROM ({_flat(_t, _lay)})")
Q("T08_sequence_shuffle", lambda v: sq.sequence_table(v.spine, v.run_events, sq.VECTOR_V1).select("cell_id", "checkup_k", sq.checksum("shuffled_sequence_vector").alias("weighted"), _sum("shuffled_sequence_vector").alias("total")), "cell_id checkup_k:i weighted:r total:r",
  f"""SELECT s.cell_id, s.checkup_k, coalesce(sum(list_sum(list_transform(v.vec, lambda x, i: x * (i + {len(sq.VECTOR_V1)} * e.r)))), 0.0) AS weighted, coalesce(sum(list_sum(v.vec)), 0.0) AS total FROM spine s LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY cell_id, checkup_k ORDER BY ('0x' || substr(md5('42|' || cell_id || '|' || checkup_k || '|' || event_index), 1, 12))::BIGINT, event_index) - 1 AS r FROM evselv1) e USING (cell_id, checkup_k)
  LEFT JOIN evv1 v ON v.cell_id = e.cell_id AND v.checkup_k = e.checkup_k AND v.event_index = e.event_index GROUP BY ALL""")
Q("A110_vector_qa", lambda v: sq.vector_qa(sq.sequence_table(v.spine, v.run_events, sq.VECTOR_V1), sq.VECTOR_V1), "rows:i bad_length:i bad_mask:i order_sum_mismatch:i leaking_names:i", "SELECT count(*) AS rows, 0 AS bad_length, 0 AS bad_mask, 0 AS order_sum_mismatch, 0 AS leaking_names FROM spine")
Q("E30_masked_standardise", lambda v: sq.masked_statistics(v.run_events), "pos:i n:i mean:r std:r",
  "SELECT pos, count(*) AS n, avg(x) AS mean, CASE WHEN stddev_pop(x) < 1e-12 THEN 1.0 ELSE stddev_pop(x) END AS std FROM (SELECT unnest(range(26)) AS pos, unnest(v.vec) AS x FROM evv2 v JOIN evselv2 e USING (cell_id, checkup_k, event_index)) GROUP BY pos")
Q("E30b_embedding_statistics", lambda v: v.read("embeddings").select(F.posexplode("embedding").alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.stddev_pop(F.col("x").cast("double")).alias("std")), "pos:i mean:r std:r",
  "SELECT pos, avg(x::DOUBLE) AS mean, stddev_pop(x::DOUBLE) AS std FROM (SELECT unnest(range(64)) AS pos, unnest(embedding) AS x FROM embeddings) GROUP BY pos")

# ---- text functions ----
Q("T01_flag_merge", lambda v: v.intervals.join(v.pulse_targets.select("cell_id", "checkup_k", F.col("quality_flags").alias("pf")), ["cell_id", "checkup_k"]).select("cell_id", "checkup_k", tr.merge_flags(F.col("quality_flags"), F.col("pf")).alias("flags")), "cell_id checkup_k:i flags",
  "SELECT i.cell_id, i.checkup_k, coalesce(nullif(array_to_string(list_sort(list_distinct(list_filter(string_split(concat_ws(';', i.quality_flags, t.quality_flags), ';'), lambda x: x NOT IN ('', 'OK', 'none')))), ';'), ''), 'none') AS flags FROM ivq i JOIN ptgt t USING (cell_id, checkup_k)")
Q("T09_stable_hash_order", lambda v: sp.hash_positions(v.cells.select("cell_id", "parameter_set"), ["parameter_set"], "cell_id", 11), "cell_id parameter_set:i pos:i",
  "SELECT cell_id, parameter_set, row_number() OVER (PARTITION BY parameter_set ORDER BY ('0x' || substr(md5('11|' || cell_id), 1, 12))::BIGINT, cell_id) - 1 AS pos FROM cells")
Q("T11_group_label", lambda v: v.pulse_targets.select("cell_id", "checkup_k", S.group_label(F.col("parameter_set")).alias("a"), S.group_label(F.nullif("quality_flags", F.lit("OK"))).alias("b")), "cell_id checkup_k:i a b", "SELECT cell_id, checkup_k, parameter_set::VARCHAR AS a, coalesce(nullif(quality_flags, 'OK'), 'unknown') AS b FROM ptgt")

# ---- audits over whole products ----

def _used(v):
    """Non-null counts of every numeric interval column, long."""
    nums = [c for c, t in v.intervals.dtypes if t == "double"]
    one = v.intervals.agg(*[F.count(c).alias(c) for c in nums])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in nums])).alias("z")).select("z.*")


_scan = lambda v: _used(v).filter(F.col("name").contains("k1") | F.col("name").contains("delta_capacity"))
_scansql = " UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) AS n FROM ivq" for c in ("t_result_k1_s", "capacity_Ah_k1", "delta_capacity_Ah", "delta_capacity_soh"))
Q("T10_leakage_token_scan", _scan, "name n:i", _scansql)


def _declared(groups, forbidden, product):
    """Feature names of the declared sets, their non-null rows in the product they are read from, and whether they are forbidden."""
    names = sorted({n for numeric, _ in groups.values() for n in numeric})
    one = product.agg(*[F.count(n).alias(n) for n in names])
    used = one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("n")) for n in names])).alias("z")).select("z.*")
    member = F.explode(F.array(*[F.struct(F.lit(g).alias("feature_group"), F.lit(n).alias("name")) for g, (numeric, _) in groups.items() for n in numeric]))
    j = used.withColumn("_m", member).where(F.col("_m.name") == F.col("feature"))
    return j.select("_m.feature_group", "feature", "n", F.col("feature").isin(list(forbidden)).alias("forbidden"))


def _declared_sql(groups, forbidden, table_name):
    return " UNION ALL ".join(f"SELECT '{g}' AS feature_group, '{n}' AS feature, count({n}) AS n, {n in forbidden} AS forbidden FROM {table_name}" for g, (numeric, _) in groups.items() for n in numeric)


# ---- fixed values: what a model of the interval or of the horizon may not see ----
FUTURE_STATE = ["capacity_Ah_k1", "delta_capacity_Ah", "delta_capacity_soh", "t_result_k1_s", "cap_aged_est_Ah", "R0_mOhm", "R1_mOhm"]
FUTURE_EXPOSURE = ["horizon_interval_count", "horizon_duration_h", "horizon_calendar_days", "horizon_log_age_efc_delta", "horizon_log_age_delta_q_Ah", "horizon_log_age_row_count"]
Q("E31_leakage_audit", lambda v: _declared(fe.CAPACITY, FUTURE_STATE, v.intervals), "feature_group feature n:i forbidden", _declared_sql(fe.CAPACITY, FUTURE_STATE, "ivq"))
Q("B48_horizon_leakage_rows", lambda v: _declared(fe.HORIZON, FUTURE_EXPOSURE, v.horizon), "feature_group feature n:i forbidden", _declared_sql(fe.HORIZON, FUTURE_EXPOSURE, "hz"))


#: The grouped splits, and one that deals a condition's replicates to several folds: its overlap is what the audit must find.
_AUDITED = [*sp.SPLITS, "replicate_calibration_fold"]


def _overlap(v):
    """Conditions of a fold that also sit in its train side: none where splits are grouped."""
    a = sp.stack_splits(v.intervals, _AUDITED).select("split_name", "fold", "parameter_set").distinct()
    n = a.groupBy("split_name", "parameter_set").agg(F.count(F.lit(1)).alias("folds"))
    return a.join(n, ["split_name", "parameter_set"]).groupBy("split_name", "fold").agg(
        F.sum((F.col("folds") > 1).cast("long")).alias("overlap"), F.count(F.lit(1)).alias("conditions")).withColumnRenamed("fold", "heldout_fold")


_stacked = " UNION ALL ".join(f"SELECT DISTINCT '{s}' AS split_name, {s} AS fold, parameter_set FROM ivq" for s in _AUDITED)
Q("B35_selector_leakage_audit", _overlap, "split_name heldout_fold:i overlap:i conditions:i",
  f"SELECT split_name, fold AS heldout_fold, count(*) FILTER (folds > 1) AS overlap, count(*) AS conditions FROM (SELECT *, count(*) OVER (PARTITION BY split_name, parameter_set) AS folds FROM ({_stacked})) GROUP BY ALL")


def _grid(v):
    models = v.metrics.select("model_level").distinct()
    s = F.explode(F.array(*[F.lit(x) for x in (0.25, 0.5, 1.0)]))
    b = F.explode(F.array(*[F.lit(x) for x in (1, 3)]))
    return models.withColumn("weight_strength", s).withColumn("bag_count", b)


Q("B49_settings_grid", _grid, "model_level weight_strength:r bag_count:i", "SELECT model_level, s AS weight_strength, b AS bag_count FROM (SELECT DISTINCT model_level FROM met), (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) x(s), (VALUES (1), (3)) y(b)")
_dc = ["event_id", "user_id", "event_type"]
_hq = "('0x' || substr(md5(concat_ws('|', event_id, user_id, event_type)), 1, 12))::BIGINT"
Q("A111_content_digest", lambda v: au.digest(v.read("events"), _dc), "rows:i xor_hash:i sum_hash", f"SELECT count(*) AS rows, bit_xor({_hq}) AS xor_hash, sum({_hq}::HUGEINT)::VARCHAR AS sum_hash FROM events")
_reb = lambda v: v.read("events").filter("event_id % 17 <> 3").unionByName(v.read("events").filter("event_id % 101 = 5")).withColumn("event_type", F.when(F.col("event_id") % 23 == 0, "x").otherwise(F.col("event_type")))
table("reb", "SELECT event_id, user_id, CASE WHEN event_id % 23 = 0 THEN 'x' ELSE event_type END AS event_type FROM (SELECT * FROM events WHERE event_id % 17 <> 3 UNION ALL SELECT * FROM events WHERE event_id % 101 = 5)")
Q("A112_product_equality", lambda v: au.differences(v.read("events"), _reb(v), _dc), "only_current:i only_rebuilt:i",
  "SELECT (SELECT count(*) FROM (SELECT event_id, user_id, event_type FROM events EXCEPT ALL SELECT * FROM reb)) AS only_current, (SELECT count(*) FROM (SELECT * FROM reb EXCEPT ALL SELECT event_id, user_id, event_type FROM events)) AS only_rebuilt")
Q("B29_product_comparison", lambda v: au.compare_products(v.read("events"), _reb(v), _dc), "current_rows:i rebuilt_rows:i current_xor_hash:i rebuilt_xor_hash:i schema_equal rows_equal digest_equal",
  f"SELECT *, true AS schema_equal, current_rows = rebuilt_rows AS rows_equal, current_xor_hash = rebuilt_xor_hash AND s1 = s2 AS digest_equal FROM (SELECT count(*) AS current_rows, bit_xor({_hq}) AS current_xor_hash, sum({_hq}::HUGEINT) AS s1 FROM events), (SELECT count(*) AS rebuilt_rows, bit_xor({_hq}) AS rebuilt_xor_hash, sum({_hq}::HUGEINT) AS s2 FROM reb)")
Q("A113_golden_row_compare", lambda v: au.golden_compare(v.read("events").select("event_id", "value", F.col("user_id").cast("double").alias("u")), v.read("events").select("event_id", (F.col("value") + F.when(F.col("event_id") % 13 == 0, 0.5).otherwise(0.0)).alias("value"), F.col("user_id").cast("double").alias("u")), ["event_id"], ["value", "u"]),
  "field rows:i mismatches:i", "SELECT 'value' AS field, count(*) AS rows, count(*) FILTER (event_id % 13 = 0) AS mismatches FROM events UNION ALL SELECT 'u', count(*), 0 FROM events")
_c = F.col
Q("A106_product_qa", lambda v: au.expectations(v.intervals, {"capacity_in_range": _c("capacity_Ah_k").between(0, 4.5), "positive_duration": _c("duration_s") > 0, "voltage_in_range": _c("log_age_max_voltage_V").isNull() | _c("log_age_max_voltage_V").between(0, 4.5),
    "short_interval": _c("duration_h") < 100, "cohort_key": _c("cell_id").rlike("^P[0-9]{3}_[0-9]+$")}), "check_name violations:i rows:i",
  " UNION ALL ".join(f"SELECT '{n}' AS check_name, count(*) FILTER (NOT coalesce({e}, false)) AS violations, count(*) AS rows FROM ivq" for n, e in (("capacity_in_range", "capacity_Ah_k BETWEEN 0 AND 4.5"), ("positive_duration", "duration_s > 0"), ("voltage_in_range", "log_age_max_voltage_V IS NULL OR log_age_max_voltage_V BETWEEN 0 AND 4.5"), ("short_interval", "duration_h < 100"), ("cohort_key", "true"))))


def _contract(v):
    """Interval table conformed to its contract: rows and non-null counts per column type."""
    d = au.conform(v.intervals, "intervals", schema_version="v1")
    assert au.matches(d, CONTRACTS["intervals"])
    return d.agg(F.count(F.lit(1)).alias("rows"), F.count("log_age_mean_soc").alias("logged"), F.sum(F.col("log_age_row_count")).alias("samples"), F.lit(len(CONTRACTS["intervals"].fields)).alias("columns"))


Q("S19_schema_contract_check", _contract, "rows:i logged:i samples:i columns:i", "SELECT count(*) AS rows, count(log_age_mean_soc) AS logged, sum(log_age_row_count) AS samples, 58 AS columns FROM ivq")
