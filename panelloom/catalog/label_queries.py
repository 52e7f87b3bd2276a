"""Queries over trajectories: horizons, prior shape, knees, thresholds, warnings."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..operators import knee as kn, trajectories as tr
from .base import Q, table

META = "aging_mode, nominal_temperature_C, voltage_window_family, nominal_charge_C_rate, nominal_discharge_C_rate, profile_label"
FOLDS = "condition_fold, temperature_holdout_fold, c_rate_holdout_fold, profile_holdout_fold, voltage_window_holdout_fold"
table("ivq", """SELECT *, concat_ws(';', CASE WHEN log_age_row_count = 0 THEN 'LOG_AGE_missing_interval' END,
  CASE WHEN m_cap + m_r0 + m_r1 > 0 THEN 'LOG_AGE_inserted_diagnostics_masked' END,
  CASE WHEN n_viol > 0 THEN 'LOG_AGE_monotonicity_violation' END) AS quality_flags FROM iv""")
table("pts", f"""
SELECT *, capacity_Ah / first_value(capacity_Ah) OVER w AS soh, (t_s - first_value(t_s) OVER w) / 86400.0::DOUBLE AS day,
  sum(greatest(0.0, coalesce(efc, 0.0))) OVER w AS cum_efc, sum(greatest(0.0, coalesce(q, 0.0))) OVER w AS cum_q,
  row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY cell_id) AS np,
  coalesce(capacity_Ah - lag(capacity_Ah) OVER w, 0.0) AS rise, CASE WHEN abs(prior_days) > 1e-12 THEN prior_delta / prior_days END AS prior_slope
FROM (SELECT cell_id, parameter_set, replicate_id, {META}, {FOLDS}, checkup_k_next AS k, t1 AS t_s, capacity_Ah_k1 AS capacity_Ah,
    delta_capacity_Ah AS prior_delta, calendar_days AS prior_days, log_age_efc_delta AS efc, log_age_delta_q_Ah AS q FROM ivq
  UNION ALL SELECT cell_id, parameter_set, replicate_id, {META}, {FOLDS}, checkup_k, t0, capacity_Ah_k, NULL, NULL, NULL, NULL FROM ivq
  QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY checkup_k) = 1)
WINDOW w AS (PARTITION BY cell_id ORDER BY k ROWS UNBOUNDED PRECEDING)""")
Q("W10_capacity_trajectory", lambda v: v.build_points(),
  "cell_id k:i idx:i capacity_Ah:r soh:r calendar_days_since:r cum_efc:r cum_q:r prior_delta:r prior_slope:r",
  "SELECT *, day AS calendar_days_since FROM pts")
table("tflag", """SELECT cell_id, concat_ws(';', CASE WHEN max(np) < 6 THEN 'few_checkups' END,
  CASE WHEN max(rise) > 0.02 THEN 'capacity_increase_gt_0p02Ah' END) AS tf FROM pts GROUP BY cell_id""")
Q("W10b_trajectory_flags", lambda v: tr.trajectory_flags(v.points), "cell_id n_points:i trajectory_flags",
  "SELECT cell_id, max(np) AS n_points, max(tf) AS trajectory_flags FROM pts JOIN tflag USING (cell_id) GROUP BY cell_id")
table("hz", f"""
SELECT a.cell_id, a.parameter_set, a.replicate_id, a.k AS checkup_k, a.k + h AS target_checkup_k, h AS horizon_checkups, a.capacity_Ah AS capacity_Ah_k,
  b.capacity_Ah AS capacity_Ah_kh, b.capacity_Ah - a.capacity_Ah AS delta_capacity_Ah_h, a.soh AS soh_k, b.soh AS soh_kh, a.day AS calendar_day_k,
  (b.t_s - a.t_s) / 86400.0::DOUBLE AS horizon_days, a.cum_efc AS cumulative_efc_k, a.cum_q AS cumulative_q_Ah_k, a.prior_delta AS prior_delta_capacity_Ah,
  a.prior_slope AS prior_capacity_slope_per_day, {', '.join('a.' + c.strip() for c in (META + ',' + FOLDS).split(','))}, s.*
FROM pts a, (VALUES (1), (2), (3), (5)) t(h), pts b, LATERAL (SELECT count(*) AS horizon_interval_count, sum(duration_h) AS horizon_duration_h,
    sum(calendar_days) AS horizon_calendar_days, sum(log_age_efc_delta) AS horizon_log_age_efc_delta, sum(log_age_delta_q_Ah) AS horizon_log_age_delta_q_Ah,
    sum(log_age_row_count) AS horizon_log_age_row_count, string_agg(quality_flags, ';') AS allflags
  FROM ivq i WHERE i.cell_id = a.cell_id AND i.checkup_k >= a.k AND i.checkup_k < a.k + h) s
WHERE b.cell_id = a.cell_id AND b.k = a.k + h AND s.horizon_interval_count = h""")
HZ = ("cell_id parameter_set:i checkup_k:i target_checkup_k:i horizon_checkups:i capacity_Ah_k:r capacity_Ah_kh:r delta_capacity_Ah_h:r soh_k:r soh_kh:r "
      "calendar_day_k:r horizon_days:r cumulative_efc_k:r cumulative_q_Ah_k:r prior_delta_capacity_Ah:r prior_capacity_slope_per_day:r")
Q("W11_horizon_state", lambda v: v.build_horizon(), HZ, "SELECT * FROM hz")
FULLHZ = HZ + (" horizon_interval_count:i horizon_duration_h:r horizon_calendar_days:r horizon_log_age_efc_delta:r horizon_log_age_delta_q_Ah:r "
               "horizon_log_age_row_count:i c_rate_holdout_fold:i quality_flags")
table("hzq", """SELECT *, coalesce(nullif(array_to_string(list_sort(list_distinct(list_filter(string_split(concat_ws(';', allflags,
  CASE WHEN prior_delta_capacity_Ah IS NULL THEN 'no_prior_delta' END), ';'), lambda x: x <> ''))), ';'), ''), 'none') AS quality_flags FROM hz""")
Q("J07_horizon_self_join", lambda v: v.build_horizon(), "cell_id checkup_k:i target_checkup_k:i horizon_checkups:i delta_capacity_Ah_h:r horizon_interval_count:i", "SELECT * FROM hz")
Q("B04_horizon_table", lambda v: v.build_horizon(), FULLHZ, "SELECT * FROM hzq")
HOLD = "cells:i parameter_sets:i c_rate_holdout_rows:i c_rate_holdout_parameter_sets:i profile_holdout_rows:i profile_holdout_parameter_sets:i"
HOLDSQL = """count(DISTINCT cell_id) AS cells, count(DISTINCT parameter_set) AS parameter_sets, count(*) FILTER (c_rate_holdout_fold <> 0) AS c_rate_holdout_rows,
  count(DISTINCT parameter_set) FILTER (c_rate_holdout_fold <> 0) AS c_rate_holdout_parameter_sets, count(*) FILTER (profile_holdout_fold <> 0) AS profile_holdout_rows,
  count(DISTINCT parameter_set) FILTER (profile_holdout_fold <> 0) AS profile_holdout_parameter_sets"""
table("poss", """SELECT h, count(*) AS possible FROM ivq i, (VALUES (1), (2), (3), (5)) t(h) WHERE EXISTS (SELECT 1 FROM pts p WHERE p.cell_id = i.cell_id AND p.k = i.checkup_k + h) GROUP BY h""")
Q("A66_horizon_coverage", lambda v: tr.horizon_coverage(v.horizon, v.points), f"horizon_checkups:i possible_start_rows:i row_count:i missing_or_censored_rows:i {HOLD}",
  f"""SELECT horizon_checkups, max(possible) AS possible_start_rows, count(*) AS row_count, greatest(max(possible) - count(*), 0) AS missing_or_censored_rows, {HOLDSQL}
  FROM hz JOIN poss ON h = horizon_checkups GROUP BY horizon_checkups""")
Q("B26_horizon_qa_duplicates", lambda v: v.horizon.groupBy("cell_id", "checkup_k", "horizon_checkups").count().filter("count > 1"), "cell_id checkup_k:i horizon_checkups:i",
  "SELECT cell_id, checkup_k, horizon_checkups FROM hz GROUP BY ALL HAVING count(*) > 1")
table("tj", """
SELECT h.cell_id, h.parameter_set, h.checkup_k, h.target_checkup_k, h.horizon_checkups, z.* EXCLUDE (cell_id, k) FROM hz h JOIN (
SELECT cell_id, k, n AS prior_history_length, l1 AS prior_capacity_delta_lag1, l2 AS prior_capacity_delta_lag2, l3 AS prior_capacity_delta_lag3,
  m3 AS prior_delta_mean_3, s3 AS prior_delta_std_3, mn3 AS prior_delta_min_3, mx3 AS prior_delta_max_3, ma AS prior_delta_mean_all, sa AS prior_delta_std_all,
  sm3 AS prior_slope_per_day_mean_3, ss3 AS prior_slope_per_day_std_3, l1 - l2 AS prior_capacity_curvature_lag1, am3 AS prior_capacity_acceleration_mean_3,
  inc AS prior_capacity_increase_count, CASE WHEN n > 0 THEN inc / n::DOUBLE END AS prior_capacity_increase_fraction,
  CASE WHEN n > 0 THEN cmax - cmin END AS prior_capacity_range_Ah_all, amax AS prior_delta_abs_max_all,
  CASE WHEN n = 0 THEN 'no_prior_history' WHEN n < 3 THEN 'short_prior_history' ELSE 'none' END AS trajectory_quality_flags
FROM (SELECT *, avg(acc) OVER r3 AS am3 FROM (
  SELECT cell_id, k, prior_delta AS l1, lag(prior_delta) OVER w AS l2, lag(prior_delta, 2) OVER w AS l3, prior_delta - lag(prior_delta) OVER w AS acc,
    avg(prior_delta) OVER r3 AS m3, stddev_pop(prior_delta) OVER r3 AS s3, min(prior_delta) OVER r3 AS mn3, max(prior_delta) OVER r3 AS mx3,
    avg(prior_slope) OVER r3 AS sm3, stddev_pop(prior_slope) OVER r3 AS ss3, avg(prior_delta) OVER a AS ma, stddev_pop(prior_delta) OVER a AS sa,
    count(prior_delta) OVER a AS n, coalesce(sum(CASE WHEN prior_delta > 0 THEN 1 ELSE 0 END) OVER a, 0) AS inc, max(capacity_Ah) OVER a AS cmax,
    min(capacity_Ah) OVER a AS cmin, max(abs(prior_delta)) OVER a AS amax FROM pts
  WINDOW w AS (PARTITION BY cell_id ORDER BY k), r3 AS (PARTITION BY cell_id ORDER BY k ROWS 2 PRECEDING), a AS (PARTITION BY cell_id ORDER BY k ROWS UNBOUNDED PRECEDING))
  WINDOW r3 AS (PARTITION BY cell_id ORDER BY k ROWS 2 PRECEDING))) z ON z.cell_id = h.cell_id AND z.k = h.checkup_k""")
TJ = ("cell_id checkup_k:i horizon_checkups:i prior_history_length:i prior_capacity_delta_lag1:r prior_capacity_delta_lag2:r prior_capacity_delta_lag3:r prior_delta_mean_3:r "
      "prior_delta_std_3:r prior_delta_min_3:r prior_delta_max_3:r prior_delta_mean_all:r prior_delta_std_all:r prior_slope_per_day_mean_3:r prior_slope_per_day_std_3:r "
      "prior_capacity_curvature_lag1:r prior_capacity_acceleration_mean_3:r prior_capacity_increase_count:i prior_capacity_increase_fraction:r prior_capacity_range_Ah_all:r "
      "prior_delta_abs_max_all:r trajectory_quality_flags")
for _n in ("W12_prior_trajectory_shape", "B05_trajectory_features"):
    Q(_n, lambda v: tr.trajectory_features(v.horizon, v.points), TJ if _n[0] == "W" else TJ + " target_checkup_k:i parameter_set:i", "SELECT * FROM tj")
Q("A67_trajectory_coverage", lambda v: tr.trajectory_coverage(tr.trajectory_features(v.horizon, v.points), v.horizon),
  "horizon_checkups:i expected_horizon_rows:i row_count:i zero_prior_history_rows:i min_prior_history_length:i max_prior_history_length:i median_prior_history_length:r cells:i parameter_sets:i",
  """SELECT horizon_checkups, (SELECT count(*) FROM hz WHERE hz.horizon_checkups = tj.horizon_checkups) AS expected_horizon_rows, count(*) AS row_count,
  count(*) FILTER (prior_history_length = 0) AS zero_prior_history_rows, min(prior_history_length) AS min_prior_history_length, max(prior_history_length) AS max_prior_history_length,
  quantile_cont(prior_history_length::DOUBLE, 0.5) AS median_prior_history_length, count(DISTINCT cell_id) AS cells, count(DISTINCT parameter_set) AS parameter_sets FROM tj GROUP BY horizon_checkups""")
Q("J20_trajectory_sidecar_join", lambda v: v.horizon.join(tr.trajectory_features(v.horizon, v.points).drop("parameter_set", "replicate_id"),
  ["cell_id", "checkup_k", "target_checkup_k", "horizon_checkups"]), "cell_id checkup_k:i horizon_checkups:i delta_capacity_Ah_h:r prior_delta_mean_3:r",
  "SELECT h.*, t.prior_delta_mean_3 FROM hz h JOIN tj t USING (cell_id, checkup_k, target_checkup_k, horizon_checkups)")

# ---- knees ----
table("smo", """SELECT *, CASE WHEN idx > 0 AND idx < np - 1 THEN avg(capacity_Ah) OVER w ELSE capacity_Ah END AS ysm,
  CASE WHEN idx > 0 AND idx < np - 1 THEN avg(soh) OVER w ELSE soh END AS ssm FROM pts
  WINDOW w AS (PARTITION BY cell_id ORDER BY k ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""")
Q("W13_rolling_smoother", lambda v: kn.smoothed(v.points), "cell_id k:i capacity_Ah_smooth:r soh_smooth:r", "SELECT *, ysm AS capacity_Ah_smooth, ssm AS soh_smooth FROM smo")
table("ser", " UNION ALL ".join(f"SELECT cell_id, idx, k, np, '{a}' AS x_axis, '{s}' AS smoothing_policy, {c}::DOUBLE AS x, {y} AS y, {z} AS s FROM smo"
                                for a, c in (("checkup_index", "k"), ("calendar_days", "day"), ("log_age_efc_cumulative", "cum_efc"))
                                for s, y, z in (("none", "capacity_Ah", "soh"), ("rolling_3", "ysm", "ssm"))))
table("fit", """SELECT *, CASE WHEN nl < 2 OR dl < 2 THEN 'inf'::DOUBLE ELSE greatest(0.0, yl - xyl * xyl / xl) END AS ssel, CASE WHEN nl >= 2 AND dl >= 2 THEN xyl / xl END AS pre,
  CASE WHEN nr < 2 OR dr < 2 THEN 'inf'::DOUBLE ELSE greatest(0.0, yr - xyr * xyr / xr) END AS sser, CASE WHEN nr >= 2 AND dr >= 2 THEN xyr / xr END AS post
FROM (SELECT *, count(*) OVER p AS nl, count(DISTINCT x) OVER p AS dl, regr_sxx(y, x) OVER p AS xl, regr_sxy(y, x) OVER p AS xyl, regr_syy(y, x) OVER p AS yl,
  count(*) OVER f AS nr, count(DISTINCT x) OVER f AS dr, regr_sxx(y, x) OVER f AS xr, regr_sxy(y, x) OVER f AS xyr, regr_syy(y, x) OVER f AS yr,
  lag(x) OVER o AS px, lag(y) OVER o AS py, lead(x) OVER o AS nx, lead(y) OVER o AS ny FROM ser
  WINDOW o AS (PARTITION BY cell_id, x_axis, smoothing_policy ORDER BY idx), p AS (PARTITION BY cell_id, x_axis, smoothing_policy ORDER BY idx ROWS UNBOUNDED PRECEDING),
    f AS (PARTITION BY cell_id, x_axis, smoothing_policy ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""")
KEY = "cell_id, x_axis, smoothing_policy"
table("kcand", f"""
WITH two AS (SELECT {KEY}, arg_min(idx, (round(ssel + sser, 9), idx)) AS i FROM fit WHERE idx >= 2 AND idx <= np - 3 AND ssel + sser < 'inf'::DOUBLE
    AND np >= 6 AND ({KEY}) IN (SELECT {KEY} FROM ser GROUP BY ALL HAVING count(DISTINCT x) >= 5) GROUP BY ALL),
  ends AS (SELECT {KEY}, arg_min(x, idx) AS x0, arg_max(x, idx) AS x1, arg_min(y, idx) AS y0, arg_max(y, idx) AS y1, max(np) AS n, count(DISTINCT x) AS dx FROM ser GROUP BY ALL),
  far0 AS (SELECT f.*, n, sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) AS den, abs((y1 - y0) * x - (x1 - x0) * y + x1 * y0 - y1 * x0) AS num FROM fit f JOIN ends USING ({KEY})),
  far AS (SELECT {KEY}, arg_min(idx, (-round(num / den, 9), idx)) AS i FROM far0 WHERE den > 0 GROUP BY ALL),
  sl AS (SELECT *, CASE WHEN abs(x - px) > 1e-12 THEN (y - py) / (x - px) END AS sin, CASE WHEN abs(nx - x) > 1e-12 THEN (ny - y) / (nx - x) END AS sout FROM fit),
  bend AS (SELECT {KEY}, arg_min(idx, (-round(abs(sout - sin), 9), idx)) FILTER (sin IS NOT NULL AND sout IS NOT NULL) AS i, count(sin) AS ns FROM sl GROUP BY ALL),
  cr AS (SELECT {KEY}, f, min(idx) FILTER (s <= f) AS i FROM ser, (VALUES (0.8::DOUBLE), (0.7::DOUBLE), (0.6::DOUBLE)) t(f) GROUP BY ALL),
  arms AS (
    SELECT {KEY}, d AS detector_name, CASE WHEN n >= 5 THEN i END AS i, CASE WHEN n < 5 THEN 'too_few_points' WHEN n < 6 OR dx < 5 THEN 'too_few_unique_points' WHEN i IS NULL THEN 'no_valid_split' ELSE '' END AS flag
      FROM ends LEFT JOIN two USING ({KEY}), (VALUES ('piecewise_linear_bic'), ('two_line_l_method')) t(d)
    UNION ALL SELECT {KEY}, 'max_chord_distance', CASE WHEN n >= 5 AND i NOT IN (0, n - 1) THEN i END, CASE WHEN n < 5 THEN 'too_few_points' WHEN i IS NULL THEN 'degenerate_chord' WHEN i IN (0, n - 1) THEN 'edge_knee' ELSE '' END FROM ends LEFT JOIN far USING ({KEY})
    UNION ALL SELECT {KEY}, 'slope_change_threshold', CASE WHEN n >= 5 AND ns >= 4 THEN i END, CASE WHEN n < 5 THEN 'too_few_points' WHEN ns < 4 THEN 'too_few_slopes' WHEN i IS NULL THEN 'no_slope_change' ELSE 'BEND' END FROM ends LEFT JOIN bend USING ({KEY})
    UNION ALL SELECT {KEY}, 'capacity_threshold_' || CAST(round(f * 100) AS INTEGER), CASE WHEN n >= 5 THEN i END, CASE WHEN n < 5 THEN 'too_few_points' WHEN i IS NULL THEN 'threshold_not_reached' ELSE 'threshold_reference' END FROM ends LEFT JOIN cr USING ({KEY}))
SELECT a.cell_id, p.parameter_set, p.replicate_id, {', '.join('p.' + c.strip() for c in META.split(','))}, a.x_axis, a.smoothing_policy, a.detector_name, f.k AS knee_checkup_k, f.x AS knee_x_value, f.y AS knee_capacity_Ah, f.s AS knee_soh,
  f.pre AS pre_knee_slope, f.post AS post_knee_slope, abs(f.post) / greatest(abs(f.pre), 1e-12) AS slope_change_ratio,
  concat_ws(';', nullif(tf, ''), nullif(CASE WHEN flag <> 'BEND' THEN flag WHEN abs(f.post) / greatest(abs(f.pre), 1e-12) < 1.25 THEN 'weak_slope_change' ELSE '' END, '')) AS detector_quality_flags
FROM arms a JOIN pts p ON p.cell_id = a.cell_id AND p.idx = 0 JOIN tflag t ON t.cell_id = a.cell_id
LEFT JOIN fit f ON f.cell_id = a.cell_id AND f.x_axis = a.x_axis AND f.smoothing_policy = a.smoothing_policy AND f.idx = a.i""")
KC = ("cell_id x_axis smoothing_policy detector_name knee_checkup_k:i knee_x_value:r knee_capacity_Ah:r knee_soh:r pre_knee_slope:r post_knee_slope:r detector_quality_flags")
for _n, _w in (("W14_two_line_knee", "detector_name IN ('piecewise_linear_bic', 'two_line_l_method')"), ("W15_max_chord_knee", "detector_name = 'max_chord_distance'"),
               ("W16_slope_change_knee", "detector_name = 'slope_change_threshold'")):
    Q(_n, lambda v, w=_w: kn.knee_candidates(v.points).filter(w), KC, f"SELECT * FROM kcand WHERE {_w}")
Q("W17_detector_grid", lambda v: v.build_candidates(), "parameter_set:i replicate_id:i " + KC, "SELECT * FROM kcand")
Q("B09_knee_report", lambda v: v.candidates.groupBy("detector_name", "x_axis", "smoothing_policy").agg(F.count(F.lit(1)).alias("n"), F.count("knee_checkup_k").alias("valid"),
  F.avg("knee_checkup_k").alias("mean_k")), "detector_name x_axis smoothing_policy n:i valid:i mean_k:r",
  "SELECT detector_name, x_axis, smoothing_policy, count(*) AS n, count(knee_checkup_k) AS valid, avg(knee_checkup_k) AS mean_k FROM kcand GROUP BY ALL")
Q("A96_detector_agreement", lambda v: kn.detector_agreement(v.candidates),
  "x_axis smoothing_policy detector_a detector_b n_cells:i agreement_within_1_checkup:r agreement_within_2_checkups:r mean_abs_disagreement_checkups:r median_abs_disagreement_checkups:r",
  """SELECT a.x_axis, a.smoothing_policy, a.detector_name AS detector_a, b.detector_name AS detector_b, count(*) AS n_cells, avg((abs(a.knee_checkup_k - b.knee_checkup_k) <= 1)::INT) AS agreement_within_1_checkup,
  avg((abs(a.knee_checkup_k - b.knee_checkup_k) <= 2)::INT) AS agreement_within_2_checkups, avg(abs(a.knee_checkup_k - b.knee_checkup_k)) AS mean_abs_disagreement_checkups,
  quantile_cont(abs(a.knee_checkup_k - b.knee_checkup_k)::DOUBLE, 0.5) AS median_abs_disagreement_checkups
  FROM kcand a JOIN kcand b ON a.cell_id = b.cell_id AND a.x_axis = b.x_axis AND a.smoothing_policy = b.smoothing_policy AND a.detector_name < b.detector_name
  WHERE a.knee_checkup_k IS NOT NULL AND b.knee_checkup_k IS NOT NULL GROUP BY ALL""")
_prim = "detector_name = 'piecewise_linear_bic' AND x_axis = 'checkup_index' AND smoothing_policy = 'none'"


def _sens(keys, name):
    return (f"(SELECT count(*) AS {name}_comparisons, avg(d) AS {name}_mean_disagreement, avg((d <= 2)::INT) AS {name}_within_2 FROM (SELECT max(knee_checkup_k) - min(knee_checkup_k) AS d "
            f"FROM kcand WHERE knee_checkup_k IS NOT NULL GROUP BY {keys} HAVING count(*) >= 2))")


Q("A97_label_stability", lambda v: kn.label_stability(v.candidates),
  "candidate_rows:i valid_candidate_rows:i primary_rows:i primary_valid_rows:i axis_comparisons:i axis_mean_disagreement:r axis_within_2:r smoothing_comparisons:i smoothing_mean_disagreement:r smoothing_within_2:r",
  f"""SELECT * FROM (SELECT count(*) AS candidate_rows, count(knee_checkup_k) AS valid_candidate_rows, count(*) FILTER ({_prim}) AS primary_rows, count(knee_checkup_k) FILTER ({_prim}) AS primary_valid_rows FROM kcand),
  {_sens('cell_id, detector_name, smoothing_policy', 'axis')}, {_sens('cell_id, detector_name, x_axis', 'smoothing')}""")
Q("A98_knee_by_condition", lambda v: kn.knee_by_condition(v.candidates), "parameter_set:i detector_name x_axis smoothing_policy n_cells:i n_valid_knees:i median_knee_checkup_k:r knee_checkup_spread:r aging_mode nominal_temperature_C:r",
  """SELECT parameter_set, detector_name, x_axis, smoothing_policy, count(*) AS n_cells, count(knee_checkup_k) AS n_valid_knees, quantile_cont(knee_checkup_k::DOUBLE, 0.5) AS median_knee_checkup_k,
  max(knee_checkup_k) - min(knee_checkup_k) AS knee_checkup_spread, arg_min(aging_mode, cell_id) AS aging_mode, arg_min(nominal_temperature_C, cell_id) AS nominal_temperature_C FROM kcand GROUP BY ALL""")
Q("A99_replicate_consistency", lambda v: kn.replicate_consistency(v.candidates), "parameter_set:i detector_name x_axis smoothing_policy n_replicates:i n_valid_knees:i knee_spread_checkups:r replicate_consistent_within_2_checkups",
  """SELECT parameter_set, detector_name, x_axis, smoothing_policy, count(DISTINCT cell_id) AS n_replicates, count(knee_checkup_k) AS n_valid_knees, max(knee_checkup_k) - min(knee_checkup_k) AS knee_spread_checkups,
  coalesce(max(knee_checkup_k) - min(knee_checkup_k) <= 2, false) AS replicate_consistent_within_2_checkups FROM kcand GROUP BY ALL""")
table("stab", f"""SELECT *, CASE WHEN n_valid_knees < 2 THEN 'insufficient_label' WHEN knee_spread_checkups <= 2 AND NOT has_severe_qa_flags THEN 'stable' ELSE 'unstable' END AS stability_status FROM (
  SELECT parameter_set, count(DISTINCT cell_id) AS n_replicates, count(knee_checkup_k) AS n_valid_knees, max(knee_checkup_k) - min(knee_checkup_k) AS knee_spread_checkups,
  quantile_cont(knee_checkup_k::DOUBLE, 0.5) AS median_knee_checkup_k, bool_or(detector_quality_flags LIKE '%few_checkups%' OR detector_quality_flags LIKE '%capacity_increase_gt%') AS has_severe_qa_flags,
  coalesce(nullif(array_to_string(list_sort(list_distinct(list_filter(string_split(string_agg(detector_quality_flags, ';'), ';'), lambda x: x <> ''))), ';'), ''), 'none') AS quality_flags,
  {', '.join(f'arg_min({c.strip()}, cell_id) AS {c.strip()}' for c in META.split(','))} FROM kcand WHERE {_prim} GROUP BY parameter_set)""")
SR = "parameter_set:i stability_status n_replicates:i n_valid_knees:i knee_spread_checkups:r median_knee_checkup_k:r has_severe_qa_flags quality_flags"
Q("A100_stable_registry", lambda v: kn.stable_registry(v.candidates), SR, "SELECT * FROM stab")
Q("B10_stable_knee_registry", lambda v: kn.stable_registry(v.candidates), SR + " aging_mode nominal_temperature_C:r voltage_window_family nominal_charge_C_rate:r profile_label", "SELECT * FROM stab")
_cov = lambda f: (f"SELECT '{f}' AS group_field, {f}::VARCHAR AS v, count(*) AS n_conditions, count(*) FILTER (stability_status = 'stable') AS stable_conditions, count(*) FILTER (stability_status = 'unstable') AS unstable_conditions, "  # noqa: E731
                  f"count(*) FILTER (stability_status = 'insufficient_label') AS insufficient_label_conditions, avg((stability_status = 'stable')::INT) AS stable_fraction FROM stab GROUP BY {f}")
Q("A101_stable_coverage", lambda v: kn.stable_coverage(kn.stable_registry(v.candidates)),
  "group_field group_value n_conditions:i stable_conditions:i unstable_conditions:i insufficient_label_conditions:i stable_fraction:r",
  "SELECT *, v AS group_value FROM (" + " UNION ALL ".join(_cov(f) for f in ("aging_mode", "nominal_temperature_C", "nominal_charge_C_rate", "voltage_window_family", "profile_label")) + ")")
for _n in ("A102_inconsistent_conditions",):
    Q(_n, lambda v: kn.knee_inconsistent(v.candidates, v.points), "parameter_set:i n:i knee_spread_checkups:i knee_spread_days:r knee_spread_efc:r trajectory_qa_flags",
      f"""SELECT c.parameter_set, count(*) AS n, max(knee_checkup_k) - min(knee_checkup_k) AS knee_spread_checkups, max(day) - min(day) AS knee_spread_days, max(cum_efc) - min(cum_efc) AS knee_spread_efc,
      coalesce(nullif(concat_ws(';', CASE WHEN bool_or(detector_quality_flags LIKE '%capacity_increase%') THEN 'capacity_increase_gt_0p02Ah' END, CASE WHEN bool_or(detector_quality_flags LIKE '%few_checkups%') THEN 'few_checkups' END), ''), 'none') AS trajectory_qa_flags
      FROM kcand c JOIN pts p ON p.cell_id = c.cell_id AND p.k = knee_checkup_k WHERE {_prim} AND knee_checkup_k IS NOT NULL GROUP BY c.parameter_set HAVING count(*) >= 2 AND max(knee_checkup_k) - min(knee_checkup_k) > 2""")
Q("W19b_knee_risk_labels", lambda v: kn.knee_risk(v.candidates, v.intervals), "cell_id checkup_k:i knee_within_1_checkup knee_within_2_checkups knee_within_3_checkups time_to_knee_checkups:i knee_label_quality",
  f"""SELECT i.cell_id, i.checkup_k, coalesce(d > 0 AND d <= 1, false) AS knee_within_1_checkup, coalesce(d > 0 AND d <= 2, false) AS knee_within_2_checkups, coalesce(d > 0 AND d <= 3, false) AS knee_within_3_checkups,
  d AS time_to_knee_checkups, 'exploratory;' || detector_quality_flags AS knee_label_quality FROM (SELECT i.cell_id, i.checkup_k, knee_checkup_k - i.checkup_k AS d, detector_quality_flags FROM ivq i JOIN kcand c ON c.cell_id = i.cell_id AND {_prim}) i""")

# ---- thresholds and warnings ----
table("thr", """SELECT t.cell_id, t.parameter_set, l.threshold_label, f AS threshold_fraction, p.k AS threshold_event_checkup_k, p.day AS threshold_event_days, p.cum_efc AS threshold_event_efc, CASE tf WHEN '' THEN 'none' ELSE tf END AS target_quality_flags
FROM (SELECT cell_id, parameter_set, f, min(idx) FILTER (soh <= f) AS i FROM pts, (VALUES (0.8::DOUBLE), (0.7::DOUBLE), (0.6::DOUBLE)) t(f) GROUP BY ALL) t
JOIN tflag USING (cell_id) LEFT JOIN pts p ON p.cell_id = t.cell_id AND p.idx = t.i,
LATERAL (SELECT unnest(['soh_below_' || CAST(round(f * 100) AS INTEGER), 'capacity_below_' || CAST(round(f * 100) AS INTEGER) || 'pct_initial']) AS threshold_label) l""")
Q("W18_first_threshold_crossing", lambda v: kn.threshold_events(v.points), "cell_id threshold_label threshold_fraction:r threshold_event_checkup_k:i threshold_event_days:r threshold_event_efc:r target_quality_flags", "SELECT * FROM thr")
table("lab", """SELECT i.cell_id, i.parameter_set, i.checkup_k, i.checkup_k_next, t.* EXCLUDE (cell_id, parameter_set), threshold_event_checkup_k - i.checkup_k AS time_to_event_checkups,
  coalesce(threshold_event_checkup_k - i.checkup_k BETWEEN 1 AND 1, false) AS event_within_1_checkup, coalesce(threshold_event_checkup_k - i.checkup_k BETWEEN 1 AND 2, false) AS event_within_2_checkups,
  coalesce(threshold_event_checkup_k - i.checkup_k BETWEEN 1 AND 3, false) AS event_within_3_checkups, threshold_event_days - p.day AS time_to_event_days
FROM ivq i JOIN thr t USING (cell_id) JOIN pts p ON p.cell_id = i.cell_id AND p.k = i.checkup_k""")
LB = "cell_id checkup_k:i threshold_label threshold_event_checkup_k:i time_to_event_checkups:i event_within_1_checkup event_within_2_checkups event_within_3_checkups time_to_event_days:r"
Q("W19_time_to_event_labels", lambda v: v.build_labels(), LB, "SELECT * FROM lab")
Q("B07_threshold_labels", lambda v: v.build_labels(), LB + " parameter_set:i checkup_k_next:i threshold_event_days:r threshold_event_efc:r target_quality_flags", "SELECT * FROM lab")
table("tbc", """SELECT threshold_label, threshold_fraction, parameter_set, count(*) AS n_replicates, count(threshold_event_checkup_k) AS n_reaching_threshold, quantile_cont(threshold_event_checkup_k::DOUBLE, 0.5) AS median_event_checkup_k,
  max(threshold_event_checkup_k) - min(threshold_event_checkup_k) AS event_spread_checkups FROM thr GROUP BY ALL""")
Q("A104_threshold_by_condition", lambda v: kn.threshold_by_condition(v.points), "threshold_label parameter_set:i n_replicates:i n_reaching_threshold:i median_event_checkup_k:r event_spread_checkups:r replicate_consistent_within_1_checkup replicate_consistent_within_2_checkups",
  "SELECT *, coalesce(event_spread_checkups <= 1, false) AS replicate_consistent_within_1_checkup, coalesce(event_spread_checkups <= 2, false) AS replicate_consistent_within_2_checkups FROM tbc")
Q("A103_threshold_stability", lambda v: kn.threshold_stability(v.intervals, v.points),
  "threshold_label threshold_fraction:r cells_reaching_threshold:i cell_coverage_fraction:r conditions_with_at_least_2_events:i condition_coverage_fraction:r replicate_consistency_within_1_checkup:r replicate_consistency_within_2_checkups:r "
  "median_spread_checkups:r median_event_checkup_k:r event_within_1_checkup_rows:i event_within_2_checkups_rows:i event_within_3_checkups_rows:i",
  """SELECT threshold_label, threshold_fraction, sum(n_reaching_threshold) AS cells_reaching_threshold, sum(n_reaching_threshold) / sum(n_replicates)::DOUBLE AS cell_coverage_fraction, count(*) FILTER (n_reaching_threshold >= 2) AS conditions_with_at_least_2_events,
  count(*) FILTER (n_reaching_threshold >= 2) / count(*)::DOUBLE AS condition_coverage_fraction, avg((event_spread_checkups <= 1)::INT) FILTER (n_reaching_threshold >= 2) AS replicate_consistency_within_1_checkup,
  avg((event_spread_checkups <= 2)::INT) FILTER (n_reaching_threshold >= 2) AS replicate_consistency_within_2_checkups, quantile_cont(event_spread_checkups::DOUBLE, 0.5) FILTER (n_reaching_threshold >= 2) AS median_spread_checkups,
  (SELECT quantile_cont(threshold_event_checkup_k::DOUBLE, 0.5) FROM thr WHERE thr.threshold_label = tbc.threshold_label) AS median_event_checkup_k,
  (SELECT count(*) FROM lab WHERE lab.threshold_label = tbc.threshold_label AND event_within_1_checkup) AS event_within_1_checkup_rows, (SELECT count(*) FROM lab WHERE lab.threshold_label = tbc.threshold_label AND event_within_2_checkups) AS event_within_2_checkups_rows,
  (SELECT count(*) FROM lab WHERE lab.threshold_label = tbc.threshold_label AND event_within_3_checkups) AS event_within_3_checkups_rows FROM tbc GROUP BY threshold_label, threshold_fraction""")
table("warn", f"""SELECT i.cell_id, i.parameter_set, i.replicate_id, i.checkup_k, i.capacity_Ah_k, p.soh AS soh_k, p.day AS calendar_day_k, p.cum_efc AS cumulative_efc_k, {', '.join('i.' + c.strip() for c in (META + ',' + FOLDS).split(','))},
  l.threshold_event_checkup_k AS event_checkup_k, time_to_event_checkups, event_within_1_checkup, event_within_2_checkups, event_within_3_checkups, l.threshold_event_checkup_k IS NOT NULL AS event_observed, 'exploratory;' || target_quality_flags AS label_quality
FROM ivq i JOIN lab l ON l.cell_id = i.cell_id AND l.checkup_k = i.checkup_k AND threshold_label = 'soh_below_80' JOIN pts p ON p.cell_id = i.cell_id AND p.k = i.checkup_k""")
Q("B08_warning_table", lambda v: v.build_warning(), "cell_id parameter_set:i checkup_k:i capacity_Ah_k:r soh_k:r calendar_day_k:r cumulative_efc_k:r condition_fold:i event_checkup_k:i time_to_event_checkups:i event_within_1_checkup event_within_2_checkups event_within_3_checkups event_observed label_quality",
  "SELECT * FROM warn")
table("warnt", " UNION ALL ".join(f"SELECT '{t}' AS target, {t}::INT AS y, {h} AS hor, * FROM warn" for t, h in kn.TARGETS.items()))
table("warnts", " UNION ALL ".join(f"SELECT '{s.strip()}' AS split_name, {s} AS heldout_fold, * FROM warnt" + ("" if "condition" in s else f" WHERE {s} <> 0") for s in FOLDS.split(",")))
BAL = "row_count:i positive_count:i negative_count:i positive_rate:r parameter_sets:i"
BALS = "count(*) AS row_count, sum(y) AS positive_count, count(*) - sum(y) AS negative_count, avg(y) AS positive_rate, count(DISTINCT parameter_set) AS parameter_sets"
Q("A64_class_balance", lambda v: kn.class_balance(v.warning), f"target {BAL} cells:i", f"SELECT target, {BALS}, count(DISTINCT cell_id) AS cells FROM warnt GROUP BY target")
Q("A65_split_coverage", lambda v: kn.split_coverage(v.warning), f"target split_name heldout_fold:i {BAL}", f"SELECT target, split_name, heldout_fold, {BALS} FROM warnts GROUP BY ALL")
Q("B27_warning_qa", lambda v: v.warning.agg(F.count(F.lit(1)).alias("rows"), F.sum((F.col("soh_k") <= 0).cast("long")).alias("bad_soh"),
  F.sum(F.col("event_observed").cast("long")).alias("observed")), "rows:i bad_soh:i observed:i", "SELECT count(*) AS rows, count(*) FILTER (soh_k <= 0) AS bad_soh, count(*) FILTER (event_observed) AS observed FROM warn")
