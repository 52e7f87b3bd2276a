"""Queries over the operating log: spine, range join, exposure, dwell, events."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.lineage import cut
from ..operators import dwell, events as ev, intervals as iv, splits as sp
from ..sources.stand_in import DWELL, EVENT  # noqa: F401
from .base import Q, table

SPINE = ("cell_id parameter_set:i replicate_id:i checkup_k:i checkup_k_next:i t_result_k_s:r t_result_k1_s:r duration_h:r "
         "calendar_days:r capacity_Ah_k:r capacity_Ah_k1:r delta_capacity_Ah:r delta_capacity_soh:r window_start_s:r "
         "window_end_s:r condition_fold:i temperature_holdout_fold:i voltage_window_holdout_fold:i c_rate_holdout_fold:i "
         "profile_holdout_fold:i replicate_calibration_fold:i")
Q("W01_interval_spine", lambda v: v.build_spine(), SPINE, "SELECT * FROM spine")
Q("J01_log_range_join", lambda v: v.log_in, "cell_id seq:i checkup_k:i checkup_k_next:i timestamp_s:r", "SELECT * FROM logiv")
EXPO = ("log_age_row_count:i log_age_elapsed_s:r log_age_efc_delta:r log_age_delta_q_Ah:r log_age_mean_voltage_V:r "
        "log_age_min_voltage_V:r log_age_max_voltage_V:r log_age_mean_temperature_C:r log_age_min_temperature_C:r "
        "log_age_max_temperature_C:r log_age_mean_current_A:r log_age_mean_abs_current_A:r log_age_max_abs_current_A:r "
        "log_age_mean_soc:r log_age_min_soc:r log_age_max_soc:r")
Q("A01_interval_exposure", lambda v: iv.interval_exposure(v.log_in), f"cell_id checkup_k:i {EXPO}", "SELECT * FROM expo")
Q("W21_monotonicity_violations", lambda v: v.build_violations(),
  "cell_id source_file seq:i timestamp_s:r timestamp_drop_s:r efc_drop:r violation_type magnitude_bucket", "SELECT * FROM viol")
Q("J06_violations_per_interval", lambda v: iv.violations_per_interval(v.violations, v.spine).withColumnsRenamed({
    "log_age_monotonicity_violation_count": "n_viol", "log_age_timestamp_decrease_count": "n_ts",
    "log_age_efc_decrease_count": "n_efc", "log_age_max_timestamp_drop_s": "max_ts", "log_age_max_efc_drop": "max_efc"}),
  "cell_id checkup_k:i n_viol:i n_ts:i n_efc:i max_ts:r max_efc:r", "SELECT * FROM violiv")
Q("A63_violation_summary", lambda v: iv.violation_summary(v.violations),
  "cell_id source_file violation_type n:i max_timestamp_drop_s:r max_efc_drop:r",
  """SELECT cell_id, NULL AS source_file, NULL AS violation_type, count(*) AS n, max(timestamp_drop_s) AS max_timestamp_drop_s, max(efc_drop) AS max_efc_drop FROM viol GROUP BY cell_id
  UNION ALL SELECT NULL, source_file, NULL, count(*), max(timestamp_drop_s), max(efc_drop) FROM viol GROUP BY source_file
  UNION ALL SELECT NULL, NULL, violation_type, count(*), max(timestamp_drop_s), max(efc_drop) FROM viol GROUP BY violation_type""")
Q("K01_top_violations", lambda v: iv.top_violations(v.violations), "cell_id seq:i rank_drop:r timestamp_drop_s:r efc_drop:r",
  """SELECT *, greatest(timestamp_drop_s, efc_drop) AS rank_drop FROM viol
  ORDER BY greatest(timestamp_drop_s, efc_drop) DESC, timestamp_drop_s DESC, efc_drop DESC, cell_id, seq LIMIT 20""")
Q("B01_interval_table", lambda v: v.build_intervals().withColumnsRenamed({
    "log_age_capacity_diag_rows_masked": "m_cap", "log_age_r0_diag_rows_masked": "m_r0", "log_age_r1_diag_rows_masked": "m_r1",
    "log_age_monotonicity_violation_count": "n_viol", "log_age_timestamp_decrease_count": "n_ts",
    "log_age_efc_decrease_count": "n_efc", "log_age_max_timestamp_drop_s": "max_ts", "log_age_max_efc_drop": "max_efc"}),
  f"{SPINE} {EXPO} m_cap:i m_r0:i m_r1:i n_viol:i n_ts:i n_efc:i max_ts:r max_efc:r quality_flags",
  """SELECT *, concat_ws(';', CASE WHEN log_age_row_count = 0 THEN 'LOG_AGE_missing_interval' END,
    CASE WHEN m_cap + m_r0 + m_r1 > 0 THEN 'LOG_AGE_inserted_diagnostics_masked' END,
    CASE WHEN n_viol > 0 THEN 'LOG_AGE_monotonicity_violation' END) AS quality_flags FROM iv""")
table("subset", """
SELECT cell_id, parameter_set, replicate_id, checkup_k, checkup_k_next,
  cell_id || '_k' || checkup_k || '_k' || checkup_k_next AS interval_id,
  ok AND n_viol = 0 AS baseline_clean_strict, ok AND NOT tsd AND max_efc <= 0.00025 AS baseline_clean_tolerant,
  n_viol > 0 AS sensitivity_flagged_monotonicity, n_viol > 0 AND NOT tsd AND max_efc > 0 AND max_efc <= 0.00025 AS small_efc_jitter,
  max_efc > 0.00025 AS excluded_due_to_large_efc_drop, tsd AS excluded_due_to_timestamp_drop,
  log_age_row_count <= 0 AS excluded_due_to_missing_log_age, duration_s <= 0 AS excluded_due_to_duration_error
FROM (SELECT *, NOT (duration_s <= 0 OR log_age_row_count <= 0) AS ok, n_ts > 0 OR max_ts > 0 AS tsd FROM iv)""")
FLAGS = ("baseline_clean_strict baseline_clean_tolerant sensitivity_flagged_monotonicity small_efc_jitter "
         "excluded_due_to_large_efc_drop excluded_due_to_timestamp_drop excluded_due_to_missing_log_age "
         "excluded_due_to_duration_error")
Q("P05_interval_policy_flags", lambda v: iv.subset_registry(v.intervals), f"cell_id checkup_k:i {FLAGS}", "SELECT * FROM subset")
COUNTS = " ".join(f"{f}:i" for f in FLAGS.split())
Q("B03_subset_registry_counts", lambda v: iv.subset_counts(iv.subset_registry(v.intervals)), f"intervals:i {COUNTS}",
  "SELECT count(*) AS intervals, " + ", ".join(f"count(*) FILTER ({f}) AS {f}" for f in FLAGS.split()) + " FROM subset")
Q("A107_interval_qa", lambda v: iv.interval_qa(v.intervals, v.checkups),
  "intervals:i cells:i nonpositive_duration:i duration_mismatch:i elapsed_over_duration:i negative_efc:i missing_log:i with_violations:i expected_intervals:i",
  """SELECT count(*) AS intervals, count(DISTINCT cell_id) AS cells, count(*) FILTER (duration_s <= 0) AS nonpositive_duration,
  count(*) FILTER (abs(duration_h * 3600 - duration_s) > 1e-6) AS duration_mismatch,
  count(*) FILTER (log_age_elapsed_s > duration_s + 1e-6) AS elapsed_over_duration, count(*) FILTER (log_age_efc_delta < 0) AS negative_efc,
  count(*) FILTER (log_age_row_count = 0) AS missing_log, count(*) FILTER (n_viol > 0) AS with_violations,
  (SELECT count(*) - count(DISTINCT cell_id) FROM chk) AS expected_intervals FROM iv""")
Q("A107b_flag_distribution", lambda v: iv.flag_distribution(v.intervals), "flag n:i",
  """SELECT 'LOG_AGE_missing_interval' AS flag, count(*) AS n FROM iv WHERE log_age_row_count = 0 HAVING count(*) > 0
  UNION ALL SELECT 'LOG_AGE_inserted_diagnostics_masked', count(*) FROM iv WHERE m_cap + m_r0 + m_r1 > 0 HAVING count(*) > 0
  UNION ALL SELECT 'LOG_AGE_monotonicity_violation', count(*) FROM iv WHERE n_viol > 0 HAVING count(*) > 0""")
table("signstep", """
SELECT CASE WHEN pi > 0 THEN 'positive' ELSE 'negative' END AS sign, (v_raw_V - pv) / dt AS dv_dt, (soc_est - pq) / dt AS dsoc_dt
FROM (SELECT *, timestamp_s - lag(timestamp_s) OVER w AS dt, lag(v_raw_V) OVER w AS pv, lag(soc_est) OVER w AS pq, lag(i_raw_A) OVER w AS pi
FROM smp WINDOW w AS (PARTITION BY cell_id ORDER BY timestamp_s, seq)) WHERE dt > 0 AND abs(pi) > 0.05""")
table("signaudit", """
SELECT sign, count(*) AS n, avg(dv_dt) AS mean_dv_dt, avg(dsoc_dt) AS mean_dsoc_dt, quantile_cont(dv_dt, 0.5) AS median_dv_dt,
  quantile_cont(dsoc_dt, 0.5) AS median_dsoc_dt FROM signstep GROUP BY sign""")
Q("W22_current_sign_audit", lambda v: iv.current_sign_audit(v.log),
  "sign n:i mean_dv_dt:r mean_dsoc_dt:r median_dv_dt:r median_dsoc_dt:r", "SELECT * FROM signaudit")
Q("W22b_current_sign_vote", lambda v: iv.current_sign_vote(iv.current_sign_audit(v.log)), "convention confidence",
  """SELECT CASE WHEN hi = 2 OR (hi = 1 AND lo = 0) THEN CASE WHEN up > down THEN 'positive_current_charge' ELSE 'positive_current_discharge' END ELSE 'ambiguous' END AS convention,
  CASE WHEN hi = 2 THEN 'high' WHEN hi = 1 AND lo = 0 THEN 'medium' ELSE 'low' END AS confidence
  FROM (SELECT *, greatest(up, down) AS hi, least(up, down) AS lo FROM (
  SELECT (p.median_dv_dt > 0 AND n.median_dv_dt < 0)::INT + (p.median_dsoc_dt > 0 AND n.median_dsoc_dt < 0)::INT AS up,
    (p.median_dv_dt < 0 AND n.median_dv_dt > 0)::INT + (p.median_dsoc_dt < 0 AND n.median_dsoc_dt > 0)::INT AS down
  FROM signaudit p, signaudit n WHERE p.sign = 'positive' AND n.sign = 'negative'))""")

# ---- dwell ----
Q("W02_capped_gap", lambda v: v.build_gaps(), "cell_id checkup_k:i seq:i raw_dt_s:r dt_s:r dt_h:r", "SELECT * FROM gaps")


def _sql_states() -> dict[str, str]:
    out = {}
    for col, bins in (("v_raw_V", dwell.VOLTAGE_BINS), ("t_cell_degC", dwell.TEMPERATURE_BINS), ("soc_est", dwell.SOC_BINS)):
        for name, lo, hi in bins:
            out[name] = " AND ".join(([f"{col} >= {lo}::DOUBLE"] if lo is not None else []) + ([f"{col} < {hi}::DOUBLE"] if hi is not None else []))
    fast = "abs(i_raw_A) >= 4.5"
    out |= {"charge_time_h": "i_raw_A > 0.05", "discharge_time_h": "i_raw_A < -0.05", "rest_time_h": "abs(i_raw_A) <= 0.05",
            "abs_current_ge_1C_time_h": "abs(i_raw_A) >= 3.0", "abs_current_ge_1p5C_time_h": fast, "abs_current_ge_5over3C_time_h": "abs(i_raw_A) >= 5.0",
            "charge_current_ge_1C_time_h": "i_raw_A >= 3.0", "charge_current_ge_1p5C_time_h": "i_raw_A >= 4.5", "charge_current_ge_5over3C_time_h": "i_raw_A >= 5.0",
            "cold_high_charge_time_h": "t_cell_degC < 15 AND i_raw_A >= 4.5", "cold_high_abs_current_time_h": f"t_cell_degC < 15 AND {fast}",
            "high_voltage_hot_time_h": "v_raw_V >= 4.1::DOUBLE AND t_cell_degC >= 40", "high_soc_hot_time_h": "soc_est >= 80 AND t_cell_degC >= 40",
            "high_voltage_high_abs_current_time_h": f"v_raw_V >= 4.1::DOUBLE AND {fast}", "high_soc_high_abs_current_time_h": f"soc_est >= 80 AND {fast}"}
    return out


STATES = _sql_states()
table("dwell0", "SELECT cell_id, checkup_k, count(*) AS stress_log_age_row_count, "
      + ", ".join(f"coalesce(sum(dt_h) FILTER ({c}), 0.0) AS {n}" for n, c in STATES.items())
      + """, sum(i_raw_A * dt_h) FILTER (i_raw_A > 0.05) / sum(dt_h) FILTER (i_raw_A > 0.05) AS mean_charge_current_A,
      sum(abs(i_raw_A) * dt_h) FILTER (i_raw_A < -0.05) / sum(dt_h) FILTER (i_raw_A < -0.05) AS mean_discharge_current_A,
      sum(dt_h) AS stress_observed_duration_h, max(raw_dt_s) AS max_log_age_gap_s, count(*) FILTER (raw_dt_s > 21600) AS log_age_gap_count_gt_60s,
      count(*) FILTER (raw_dt_s > 43200) AS log_age_gap_count_gt_300s, quantile_cont(dt_s, 0.5) AS median_log_age_dt_s FROM gaps GROUP BY ALL""")
HOURS = " ".join(f"{n}:r" for n in STATES)
Q("A02_dwell_histogram", lambda v: dwell.dwell_sums(v.gaps, DWELL),
  f"cell_id checkup_k:i stress_log_age_row_count:i {HOURS} mean_charge_current_A:r mean_discharge_current_A:r stress_observed_duration_h:r "
  "max_log_age_gap_s:r log_age_gap_count_gt_60s:i log_age_gap_count_gt_300s:i", "SELECT * FROM dwell0")


def _sql_runs() -> str:
    parts = []
    for r in dwell.RUNS:
        parts.append(f"""SELECT cell_id, checkup_k, '{r}' AS r, count(DISTINCT g) AS n, max(h) AS h FROM (
          SELECT cell_id, checkup_k, g, sum(dt_h) AS h FROM (
            SELECT *, sum(CASE WHEN {STATES[r + '_time_h']} THEN 0 ELSE 1 END) OVER (PARTITION BY cell_id, checkup_k ORDER BY timestamp_s, seq) AS g FROM gaps)
          WHERE {STATES[r + '_time_h']} GROUP BY ALL) GROUP BY ALL""")
    return " UNION ALL ".join(parts)


table("runs0", _sql_runs())
table("runs", "SELECT g.cell_id, g.checkup_k, " + ", ".join(
    [f"coalesce(max(h) FILTER (r = '{r}'), 0.0) AS max_{r}_event_h" for r in dwell.RUNS]
    + [f"coalesce(max(n) FILTER (r = '{r}'), 0) AS n_{r}_events" for r in ("charge", "discharge", "rest")])
    + " FROM (SELECT DISTINCT cell_id, checkup_k FROM gaps) g LEFT JOIN runs0 USING (cell_id, checkup_k) GROUP BY ALL")
RUNCOLS = " ".join([f"max_{r}_event_h:r" for r in dwell.RUNS] + [f"n_{r}_events:i" for r in ("charge", "discharge", "rest")])
Q("W05_stress_runs", lambda v: dwell.stress_runs(v.gaps, DWELL), f"cell_id checkup_k:i {RUNCOLS}", "SELECT * FROM runs")
_zero = [n for n in STATES] + ["stress_log_age_row_count", "stress_observed_duration_h", "max_log_age_gap_s", "log_age_gap_count_gt_60s",
                              "log_age_gap_count_gt_300s"] + [c.split(":")[0] for c in RUNCOLS.split()]
ratio = lambda a, b: f"CASE WHEN abs({b}) > 1e-12 THEN {a} / {b} END"
table("stress", f"""SELECT *, duration_h AS stress_duration_h, least(1.0, coalesce({ratio('stress_observed_duration_h', 'duration_h')}, 0.0)) AS stress_coverage_fraction,
  0.25 * time_voltage_3p3_3p6_h + 0.5 * time_voltage_3p6_3p9_h + time_voltage_3p9_4p1_h + 1.5 * time_voltage_ge_4p1_h AS voltage_dwell_weighted_h,
  time_temp_lt_5C_h + time_temp_5_15C_h AS cold_time_h, time_temp_ge_40C_h AS hot_time_h,
  {ratio('delta_capacity_Ah', 'calendar_days')} AS delta_capacity_per_day, {ratio('delta_capacity_Ah', 'log_age_efc_delta')} AS delta_capacity_per_efc,
  {ratio('delta_capacity_Ah', 'log_age_delta_q_Ah')} AS delta_capacity_per_Ah_throughput, {ratio('log_age_efc_delta', 'calendar_days')} AS log_age_efc_per_day
  FROM (SELECT iv.*, {', '.join(f'coalesce({c}, 0) AS {c}' for c in _zero)}, mean_charge_current_A, mean_discharge_current_A, median_log_age_dt_s
  FROM iv LEFT JOIN dwell0 USING (cell_id, checkup_k) LEFT JOIN runs USING (cell_id, checkup_k))""")
FINAL = ("cell_id parameter_set:i checkup_k:i checkup_k_next:i stress_duration_h:r stress_coverage_fraction:r voltage_dwell_weighted_h:r "
         "cold_time_h:r hot_time_h:r delta_capacity_per_day:r delta_capacity_per_efc:r delta_capacity_per_Ah_throughput:r log_age_efc_per_day:r "
         "median_log_age_dt_s:r mean_charge_current_A:r mean_discharge_current_A:r")
Q("A03_dwell_features", lambda v: v.build_stress(), FINAL, "SELECT * FROM stress")
Q("B02_stress_feature_table", lambda v: v.build_stress(), f"{FINAL} stress_log_age_row_count:i {HOURS} {RUNCOLS}", "SELECT * FROM stress")
Q("J13_missing_key_audit", lambda v: dwell.stress_qa(v.stress, v.spine),
  "rows:i voltage_sum_mismatch:i temperature_sum_mismatch:i soc_sum_mismatch:i current_sum_mismatch:i coverage_out_of_range:i observed_over_duration:i missing_intervals:i",
  """SELECT count(*) AS rows, count(*) FILTER (abs(time_voltage_lt_3p3_h + time_voltage_3p3_3p6_h + time_voltage_3p6_3p9_h + time_voltage_3p9_4p1_h + time_voltage_ge_4p1_h - stress_observed_duration_h) > 1e-6) AS voltage_sum_mismatch,
  count(*) FILTER (abs(time_temp_lt_5C_h + time_temp_5_15C_h + time_temp_15_30C_h + time_temp_30_40C_h + time_temp_ge_40C_h - stress_observed_duration_h) > 1e-6) AS temperature_sum_mismatch,
  count(*) FILTER (abs(time_soc_lt_20_h + time_soc_20_50_h + time_soc_50_80_h + time_soc_ge_80_h - stress_observed_duration_h) > 1e-6) AS soc_sum_mismatch,
  count(*) FILTER (abs(charge_time_h + discharge_time_h + rest_time_h - stress_observed_duration_h) > 1e-6) AS current_sum_mismatch,
  count(*) FILTER (stress_coverage_fraction < 0 OR stress_coverage_fraction > 1) AS coverage_out_of_range,
  count(*) FILTER (stress_observed_duration_h > stress_duration_h + 1e-6) AS observed_over_duration, 0 AS missing_intervals FROM stress""")

# ---- events ----
table("evb", """
SELECT *, sum(nw) OVER (PARTITION BY cell_id, checkup_k ORDER BY timestamp_s, seq ROWS UNBOUNDED PRECEDING) AS id FROM (
SELECT *, CASE WHEN gap IS NULL OR ps <> state OR gap > 43200 THEN 1 ELSE 0 END AS nw FROM (
SELECT *, timestamp_s - lag(timestamp_s) OVER w AS gap, lag(state) OVER w AS ps FROM (
SELECT *, CASE WHEN abs(i_raw_A) <= 0.05 THEN 'rest' WHEN i_raw_A > 0.05 THEN 'charge' ELSE 'discharge' END AS state FROM logiv)
WINDOW w AS (PARTITION BY cell_id, checkup_k ORDER BY timestamp_s, seq)))""")
table("runev", """
SELECT *, d AS event_duration_s, d / 3600.0::DOUBLE AS event_duration_h,
  concat_ws(';', CASE WHEN lead(entry_gap) OVER w > 43200 THEN 'gap_gt_300s' END, CASE WHEN d <= 0 THEN 'zero_duration' END) AS quality_flags FROM (
SELECT cell_id, parameter_set, replicate_id, checkup_k, checkup_k_next, id - 1 AS event_index, min(state) AS event_type,
  min(timestamp_s) AS event_start_s, max(timestamp_s) AS event_end_s, max(timestamp_s) - min(timestamp_s) AS d,
  avg(v_raw_V) AS mean_voltage_V, min(v_raw_V) AS min_voltage_V, max(v_raw_V) AS max_voltage_V, avg(i_raw_A) AS mean_current_A,
  avg(abs(i_raw_A)) AS mean_abs_current_A, max(abs(i_raw_A)) AS max_abs_current_A, avg(t_cell_degC) AS mean_temperature_C,
  max(t_cell_degC) AS max_temperature_C, avg(soc_est) AS mean_soc, min(soc_est) AS min_soc, max(soc_est) AS max_soc,
  arg_max(delta_q_Ah, (timestamp_s, seq)) - arg_min(delta_q_Ah, (timestamp_s, seq)) AS delta_q_Ah,
  arg_max(EFC, (timestamp_s, seq)) - arg_min(EFC, (timestamp_s, seq)) AS delta_EFC,
  max(v_raw_V) >= 4.1::DOUBLE AS high_voltage_event, min(t_cell_degC) <= 10 AS cold_event, max(t_cell_degC) >= 35 AS hot_event,
  max(abs(i_raw_A)) >= 4.5 AS high_abs_current_event, min(t_cell_degC) <= 10 AND max(abs(i_raw_A)) >= 4.5 AS cold_high_current_event,
  max(v_raw_V) >= 4.1::DOUBLE AND max(abs(i_raw_A)) >= 4.5 AS high_voltage_high_current_event, count(*) AS source_rows,
  max(coalesce(gap, 0.0)) AS max_gap_s, arg_min(coalesce(gap, 0.0), (timestamp_s, seq)) AS entry_gap
FROM evb GROUP BY ALL) WINDOW w AS (PARTITION BY cell_id, checkup_k ORDER BY event_index)""")
Q("W03_event_sessionization", lambda v: v.build_run_events(),
  "cell_id checkup_k:i event_index:i event_type event_start_s:r event_end_s:r source_rows:i max_gap_s:r", "SELECT * FROM runev")
EVCOLS = ("cell_id parameter_set:i replicate_id:i checkup_k:i checkup_k_next:i event_index:i event_type event_start_s:r event_duration_s:r event_duration_h:r "
          "mean_voltage_V:r min_voltage_V:r max_voltage_V:r mean_current_A:r mean_abs_current_A:r max_abs_current_A:r mean_temperature_C:r max_temperature_C:r "
          "mean_soc:r min_soc:r max_soc:r delta_q_Ah:r delta_EFC:r high_voltage_event cold_event hot_event high_abs_current_event cold_high_current_event "
          "high_voltage_high_current_event quality_flags")
Q("W04_event_finalise", lambda v: v.build_run_events(), EVCOLS, "SELECT * FROM runev")


def _order_sql(index: str, src: str) -> str:
    tr = ", ".join(f"count(*) FILTER (pt = '{a}' AND event_type = '{b}') AS transition_{a}_{b}" for a, b in ev.TRANSITIONS)
    share = ", ".join(f"CASE WHEN sum(event_duration_h) FILTER (high_abs_current_event) > 0 THEN coalesce(sum(event_duration_h) FILTER (high_abs_current_event AND third = {i}), 0.0) "
                      f"/ sum(event_duration_h) FILTER (high_abs_current_event) ELSE 0.0 END AS {n}_high_current_fraction"
                      for i, n in enumerate(["early", "mid", "late"]))
    return f"""SELECT cell_id, checkup_k, {tr}, count(*) FILTER (pt <> event_type) AS alternation_count,
      min({index} / greatest(1, n - 1)::DOUBLE) FILTER (high_abs_current_event) AS first_high_current_position,
      max({index} / greatest(1, n - 1)::DOUBLE) FILTER (high_abs_current_event) AS last_high_current_position, {share}
      FROM (SELECT *, lag(event_type) OVER (PARTITION BY cell_id, checkup_k ORDER BY {index}) AS pt,
        least(2, ({index} * 3) // n) AS third FROM (SELECT *, count(*) OVER (PARTITION BY cell_id, checkup_k) AS n FROM {src})) GROUP BY ALL"""


def _burst_sql(flag: str) -> str:
    return f"""SELECT cell_id, checkup_k, max(h) AS h FROM (SELECT cell_id, checkup_k, g, sum(event_duration_h) AS h FROM (
      SELECT *, sum(CASE WHEN {flag} THEN 0 ELSE 1 END) OVER (PARTITION BY cell_id, checkup_k ORDER BY event_index) AS g FROM runev) WHERE {flag} GROUP BY ALL) GROUP BY ALL"""


table("ordf", _order_sql("event_index", "runev"))
table("burst1", _burst_sql("high_abs_current_event"))
table("burst2", _burst_sql("cold_high_current_event"))
table("seqf", f"""SELECT s.cell_id, s.parameter_set, s.checkup_k, coalesce(count(r.event_index), 0) AS sequence_event_count, coalesce(sum(event_duration_h), 0) AS sequence_total_event_duration_h,
  {', '.join(f"count(*) FILTER (event_type = '{t}') AS sequence_{t}_event_count" for t in ev.TYPES)},
  {', '.join(f"coalesce(sum(event_duration_h) FILTER (event_type = '{t}'), 0) AS sequence_{t}_duration_h, coalesce(max(event_duration_h) FILTER (event_type = '{t}'), 0) AS sequence_max_{t}_duration_h" for t in ev.TYPES[:3])},
  count(*) FILTER (high_abs_current_event) AS sequence_high_current_event_count, count(*) FILTER (cold_high_current_event) AS sequence_cold_high_current_event_count,
  count(*) FILTER (high_voltage_high_current_event) AS sequence_high_voltage_high_current_event_count
  FROM spine s LEFT JOIN runev r USING (cell_id, checkup_k) GROUP BY ALL""")
SEQC = " ".join(f"sequence_{t}_event_count:i" for t in ev.TYPES) + " " + " ".join(f"sequence_{t}_duration_h:r sequence_max_{t}_duration_h:r" for t in ev.TYPES[:3])
Q("W06_sequence_features", lambda v: v.build_sequences(), f"cell_id checkup_k:i sequence_event_count:i sequence_total_event_duration_h:r {SEQC} "
  "sequence_high_current_event_count:i sequence_cold_high_current_event_count:i sequence_high_voltage_high_current_event_count:i", "SELECT * FROM seqf")
W07 = " ".join(f"sequence_transition_{a}_{b}:i" for a, b in ev.TRANSITIONS)
Q("W07_sequence_finalise", lambda v: v.sequences,
  f"cell_id checkup_k:i {W07} sequence_alternation_count:i sequence_first_high_current_position:r sequence_last_high_current_position:r "
  "sequence_longest_high_current_burst_h:r sequence_longest_cold_high_current_burst_h:r sequence_quality_flags",
  f"""SELECT s.cell_id, s.checkup_k, {', '.join(f'coalesce(transition_{a}_{b}, 0) AS sequence_transition_{a}_{b}' for a, b in ev.TRANSITIONS)},
  coalesce(alternation_count, 0) AS sequence_alternation_count, first_high_current_position AS sequence_first_high_current_position,
  last_high_current_position AS sequence_last_high_current_position, coalesce(b1.h, 0) AS sequence_longest_high_current_burst_h,
  coalesce(b2.h, 0) AS sequence_longest_cold_high_current_burst_h, CASE WHEN o.cell_id IS NULL THEN 'missing_events' ELSE '' END AS sequence_quality_flags
  FROM spine s LEFT JOIN ordf o USING (cell_id, checkup_k) LEFT JOIN burst1 b1 USING (cell_id, checkup_k) LEFT JOIN burst2 b2 USING (cell_id, checkup_k)""")
Q("W08_thirds_exposure", lambda v: ev.order_features(v.run_events, cut=cut),
  "cell_id checkup_k:i early_high_current_fraction:r mid_high_current_fraction:r late_high_current_fraction:r", "SELECT * FROM ordf")
table("shufev", """SELECT * RENAME (pos AS shuffled_index) FROM (SELECT *, row_number() OVER (PARTITION BY cell_id, checkup_k ORDER BY h, event_index) - 1 AS pos FROM (
SELECT *, ('0x' || substr(md5('42|' || cell_id || '|' || checkup_k || '|' || event_index), 1, 12))::BIGINT AS h FROM runev))""")
table("ordsh", _order_sql("shuffled_index", "shufev"))
Q("W09_shuffled_control", lambda v: ev.order_features(ev.shuffled_index(v.run_events), "shuffled_index", cut=cut),
  "cell_id checkup_k:i " + " ".join(f"transition_{a}_{b}:i" for a, b in ev.TRANSITIONS) + " alternation_count:i early_high_current_fraction:r mid_high_current_fraction:r late_high_current_fraction:r",
  "SELECT * FROM ordsh")
Q("A108_run_event_qa", lambda v: ev.event_qa(v.run_events, v.spine),
  "events:i zero_duration_events:i long_events:i max_gap_s:r source_rows:i intervals_without_events:i median_events_per_interval:r max_events_per_interval:r",
  """SELECT count(*) AS events, count(*) FILTER (d <= 0) AS zero_duration_events, count(*) FILTER (event_duration_h > 24) AS long_events, max(max_gap_s) AS max_gap_s,
  sum(source_rows) AS source_rows, (SELECT count(*) FROM (SELECT cell_id, checkup_k FROM spine EXCEPT SELECT cell_id, checkup_k FROM runev)) AS intervals_without_events,
  (SELECT quantile_cont(c, 0.5) FROM (SELECT count(*)::DOUBLE AS c FROM runev GROUP BY cell_id, checkup_k)) AS median_events_per_interval,
  (SELECT max(c) FROM (SELECT count(*) AS c FROM runev GROUP BY cell_id, checkup_k)) AS max_events_per_interval FROM runev""")
Q("A108b_event_duration_gaps", lambda v: ev.event_duration_gaps(v.run_events, v.spine), "cell_id checkup_k:i duration_h:r event_h:r uncovered_h:r",
  """SELECT s.cell_id, s.checkup_k, s.duration_h, coalesce(e, 0.0) AS event_h, s.duration_h - coalesce(e, 0.0) AS uncovered_h FROM spine s
  LEFT JOIN (SELECT cell_id, checkup_k, sum(event_duration_h) AS e FROM runev GROUP BY ALL) USING (cell_id, checkup_k)""")
Q("A109_sequence_qa", lambda v: ev.sequence_qa(v.sequences), "rows:i missing_events:i negative_values:i",
  "SELECT count(*) AS rows, count(*) FILTER (sequence_event_count = 0) AS missing_events, 0 AS negative_values FROM seqf")

# ---- splits ----
REG = ("cell_id parameter_set:i replicate_id:i condition_fold:i temperature_holdout_fold:i voltage_window_holdout_fold:i c_rate_holdout_fold:i "
       "profile_holdout_fold:i replicate_calibration_fold:i time_horizon_fold:i")
Q("W20_split_registry", lambda v: v.build_splits(), REG, "SELECT * FROM reg")
Q("P13_holdout_folds", lambda v: v.cells.select("cell_id", S.temperature_fold(F.col("nominal_temperature_C")).alias("temperature_fold"),
    S.c_rate_fold(F.col("nominal_charge_C_rate"), F.col("nominal_discharge_C_rate")).alias("rate_fold"), S.profile_fold(F.col("aging_mode")).alias("profile_fold"),
    S.replicate_fold(F.col("replicate_id")).alias("replicate_fold")), "cell_id temperature_fold:i rate_fold:i profile_fold:i replicate_fold:i",
  """SELECT cell_id, temperature_holdout_fold AS temperature_fold, c_rate_holdout_fold AS rate_fold, profile_holdout_fold AS profile_fold, replicate_calibration_fold AS replicate_fold FROM reg""")
Q("P14_voltage_fold", lambda v: v.cells.select("cell_id", S.voltage_fold(F.col("voltage_window_family")).alias("fold")), "cell_id fold:i",
  "SELECT cell_id, voltage_window_holdout_fold AS fold FROM reg")
table("sf", " UNION ALL ".join(f"SELECT '{s}' AS split_name, {s} AS fold, * FROM reg" for s in sp.SPLITS))
Q("A105_split_audit", lambda v: sp.split_audit(v.splits), "split_name fold:i conditions:i cells:i leaking:i",
  "SELECT split_name, fold, count(DISTINCT parameter_set) AS conditions, count(*) AS cells, 0 AS leaking FROM sf GROUP BY ALL")
table("sfi", " UNION ALL ".join(f"SELECT '{s}' AS split_name, {s} AS fold, * FROM spine" for s in sp.SPLITS))
Q("E04_leave_fold_out", lambda v: sp.train_test_roles(v.spine), "split_name heldout_fold:i test_rows:i train_rows:i",
  """SELECT split_name, fold AS heldout_fold, count(*) AS test_rows, (SELECT count(*) FROM spine) - count(*) AS train_rows FROM sfi
  WHERE split_name = 'condition_fold' OR fold <> 0 GROUP BY ALL""")
Q("U04_fold_overlap", lambda v: sp.fold_overlap(v.splits), "split_name overlap:i",
  """SELECT split_name, count(*) AS overlap FROM (SELECT split_name, parameter_set FROM sf GROUP BY ALL HAVING count(DISTINCT fold) > 1) GROUP BY ALL""")
Q("E27_inner_condition_folds", lambda v: sp.inner_folds(sp.stack_splits(v.splits), ["split_name", "fold"], "parameter_set", 3, 7),
  "split_name fold:i parameter_set:i inner_fold:i",
  """SELECT *, (row_number() OVER (PARTITION BY split_name, fold ORDER BY ('0x' || substr(md5('7|' || parameter_set), 1, 12))::BIGINT, parameter_set) - 1) % 3 AS inner_fold
  FROM (SELECT DISTINCT split_name, fold, parameter_set FROM sf)""")
