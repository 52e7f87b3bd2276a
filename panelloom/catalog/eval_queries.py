"""Queries over grouped evaluation: rule arms, metrics, leaderboards, probability scores."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.lineage import cut
from ..operators import diagnostics as dg, knee as kn, metrics as me, rules as ru
from ..operators.splits import SPLITS, stack_splits, test_rows
from .base import Q, table
from .label_queries import META
from .state_queries import SKEY, _case, _lead, _pd, _prox, _soh

_ivt = " UNION ALL ".join(f"SELECT '{s}' AS split_name, {s} AS fold, * FROM ivq" for s in SPLITS)
table("ivs", _ivt)
table("folds", "SELECT DISTINCT split_name, fold AS heldout_fold FROM ivs WHERE split_name = 'condition_fold' OR fold <> 0")
table("tmean", "SELECT f.split_name, f.heldout_fold, avg(capacity_Ah_k1) AS mean_level, avg(delta_capacity_Ah) AS mean_delta FROM folds f JOIN ivs i ON i.split_name = f.split_name AND i.fold <> f.heldout_fold GROUP BY ALL")
table("tgrp", "SELECT f.split_name, f.heldout_fold, nominal_charge_C_rate, avg(delta_capacity_Ah) AS g FROM folds f JOIN ivs i ON i.split_name = f.split_name AND i.fold <> f.heldout_fold GROUP BY ALL")
_ROWC = "cell_id, parameter_set, replicate_id, checkup_k, checkup_k_next"
table("ptest", f"""SELECT i.*, f.heldout_fold, m.mean_level AS M, m.mean_delta AS D, coalesce(g.g, m.mean_delta) AS G FROM folds f JOIN ivs i ON i.split_name = f.split_name AND i.fold = f.heldout_fold
JOIN tmean m ON m.split_name = f.split_name AND m.heldout_fold = f.heldout_fold LEFT JOIN tgrp g ON g.split_name = f.split_name AND g.heldout_fold = f.heldout_fold AND g.nominal_charge_C_rate = i.nominal_charge_C_rate""")
_pc = f"split_name, heldout_fold, {_ROWC}, {META}, capacity_Ah_k, n_viol"
_arms = []
for _m, _g, _l, _d, _q in (("L0_persistence", ru.GROUPS[0], "capacity_Ah_k", "0.0", 0), ("L1_mean", ru.GROUPS[1], "M", "D", 0), ("L2_rule", ru.GROUPS[2], "capacity_Ah_k + D", "G", 0),
                           ("L2_rule", ru.GROUPS[3], "capacity_Ah_k + G", "(D + G) / 2", 0), ("L3_quantile", ru.GROUPS[3], "capacity_Ah_k + G", "G", 1)):
    for _t, _p, _y in ((ru.LEVEL, _l, "capacity_Ah_k1"), (ru.DELTA, _d, "delta_capacity_Ah")):
        _qs = f"{_p} - 0.1::DOUBLE AS y_pred_q10, {_p} AS y_pred_q50, {_p} + 0.05::DOUBLE AS y_pred_q90" if _q else "NULL::DOUBLE AS y_pred_q10, NULL::DOUBLE AS y_pred_q50, NULL::DOUBLE AS y_pred_q90"
        _arms.append(f"SELECT {_pc}, '{_m}' AS model_level, '{_g}' AS feature_group, '{_t}' AS target, {_y} AS y_true, ({_p})::DOUBLE AS y_pred, {_qs} FROM ptest")
table("preds0", " UNION ALL ".join(_arms))
table("preds", "SELECT 'primary' AS run_scope, *, y_pred - y_true AS e FROM preds0 UNION ALL SELECT 'sensitivity_excluding_monotonicity', *, y_pred - y_true FROM preds0 WHERE n_viol = 0")
ARM = "run_scope split_name heldout_fold:i model_level feature_group target"
_ARMQ = "run_scope, split_name, heldout_fold, model_level, feature_group, target"
PR = f"{ARM} cell_id checkup_k:i y_true:r y_pred:r"
Q("E05_persistence", lambda v: v.build_preds().filter("model_level = 'L0_persistence'"), PR, "SELECT * FROM preds WHERE model_level = 'L0_persistence'")
Q("E07_global_mean", lambda v: v.build_preds().filter("model_level = 'L1_mean'"), PR, "SELECT * FROM preds WHERE model_level = 'L1_mean'")
Q("E32_evaluation_grid", lambda v: v.build_preds().groupBy("run_scope", "split_name", "heldout_fold", "model_level", "feature_group", "target").agg(F.count(F.lit(1)).alias("n"), F.avg("y_pred").alias("mean_pred")),
  f"{ARM} n:i mean_pred:r", f"SELECT {_ARMQ}, count(*) AS n, avg(y_pred) AS mean_pred FROM preds GROUP BY ALL")
table("cerr", f"SELECT {_ARMQ}, parameter_set, avg(abs(e)) AS condition_mae FROM preds GROUP BY ALL")
table("met", f"""SELECT * FROM (SELECT {_ARMQ}, count(*) AS test_rows, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, avg(e) AS bias FROM preds GROUP BY ALL)
JOIN (SELECT {_ARMQ}, count(*) AS test_parameter_sets, avg(condition_mae) AS condition_mean_mae, quantile_cont(condition_mae, 0.5) AS condition_median_mae, max(condition_mae) AS worst_condition_mae FROM cerr GROUP BY ALL) USING ({_ARMQ})""")
MET = "test_rows:i test_parameter_sets:i mae:r rmse:r bias:r condition_mean_mae:r condition_median_mae:r worst_condition_mae:r"
Q("A08_regression_metrics", lambda v: v.build_metrics(), f"{ARM} {MET}", "SELECT * FROM met")
Q("A11_worst_conditions", lambda v: v.metrics.select(*ru.ARM, "worst_condition_mae", "condition_mean_mae", "condition_median_mae", "test_parameter_sets"), f"{ARM} worst_condition_mae:r condition_mean_mae:r condition_median_mae:r test_parameter_sets:i", "SELECT * FROM met")
_QM = """CASE WHEN ok THEN c END AS q10_q90_interval_coverage, CASE WHEN ok THEN w END AS q10_q90_interval_width_mean, CASE WHEN ok THEN p1 END AS pinball_loss_q10, CASE WHEN ok THEN p5 END AS pinball_loss_q50, CASE WHEN ok THEN p9 END AS pinball_loss_q90"""
Q("A09_quantile_metrics", lambda v: me.quantile_metrics(v.preds), f"{ARM} q10_q90_interval_coverage:r q10_q90_interval_width_mean:r pinball_loss_q10:r pinball_loss_q50:r pinball_loss_q90:r",
  f"""SELECT {_ARMQ}, {_QM} FROM (SELECT {_ARMQ}, bool_and(y_pred_q10 IS NOT NULL) AS ok, avg((y_true BETWEEN y_pred_q10 AND y_pred_q90)::INT) AS c, avg(y_pred_q90 - y_pred_q10) AS w,
  avg(greatest(0.1 * (y_true - y_pred_q10), -0.9 * (y_true - y_pred_q10))) AS p1, avg(greatest(0.5 * (y_true - y_pred_q50), -0.5 * (y_true - y_pred_q50))) AS p5, avg(greatest(0.9 * (y_true - y_pred_q90), -0.1 * (y_true - y_pred_q90))) AS p9 FROM preds GROUP BY ALL)""")
table("board", """SELECT run_scope, model_level, feature_group, target, split_name, count(*) AS fold_count, avg(mae) AS mean_mae, avg(rmse) AS mean_rmse, avg(condition_mean_mae) AS condition_mean_mae, avg(condition_median_mae) AS condition_median_mae,
  max(worst_condition_mae) AS worst_condition_mae, sum(test_rows) AS test_rows, sum(test_parameter_sets) AS test_parameter_sets FROM met GROUP BY ALL""")
BD = "run_scope model_level feature_group target split_name fold_count:i mean_mae:r mean_rmse:r condition_mean_mae:r condition_median_mae:r worst_condition_mae:r test_rows:i test_parameter_sets:i"
Q("A10_leaderboard", lambda v: v.build_board(), BD, "SELECT * FROM board")
Q("B33_robust_leaderboards", lambda v: me.leaderboard(v.metrics.withColumn("model_setting_id", F.concat_ws("|", "model_level", "feature_group")), ["run_scope", "model_setting_id", "target", "split_name"]),
  "run_scope model_setting_id target split_name fold_count:i condition_mean_mae:r worst_condition_mae:r", "SELECT *, model_level || '|' || feature_group AS model_setting_id FROM board")
Q("A12_feature_gain", lambda v: me.adjacent_gains(v.board), "run_scope model_level target split_name from_feature_group to_feature_group condition_mean_mae_gain:r worst_condition_mae_gain:r",
  """SELECT a.run_scope, a.model_level, a.target, a.split_name, a.feature_group AS from_feature_group, b.feature_group AS to_feature_group, a.condition_mean_mae - b.condition_mean_mae AS condition_mean_mae_gain, a.worst_condition_mae - b.worst_condition_mae AS worst_condition_mae_gain
  FROM board a JOIN board b USING (run_scope, model_level, target, split_name) WHERE model_level <> 'L0_persistence' AND ((a.feature_group = 'F1_nominal' AND b.feature_group = 'F2_state') OR (a.feature_group = 'F2_state' AND b.feature_group = 'F4_state_log_age_scalar'))""")
Q("A13_sensitivity_delta", lambda v: me.scope_deltas(v.metrics), "model_level feature_group target split_name heldout_fold:i primary_mae:r sensitivity_mae:r primary_minus_sensitivity_mae:r primary_minus_sensitivity_condition_mean_mae:r",
  """SELECT p.model_level, p.feature_group, p.target, p.split_name, p.heldout_fold, p.mae AS primary_mae, s.mae AS sensitivity_mae, p.mae - s.mae AS primary_minus_sensitivity_mae, p.condition_mean_mae - s.condition_mean_mae AS primary_minus_sensitivity_condition_mean_mae
  FROM met p JOIN met s USING (model_level, feature_group, target, split_name, heldout_fold) WHERE p.run_scope = 'primary' AND s.run_scope LIKE 'sens%'""")
GK = ["run_scope", "target", "split_name"]
GAIN = "run_scope target split_name candidate_model_level candidate_feature_group reference_model_level reference_feature_group gain:r relative_gain:r beats_reference"


def _gains(name, cand_sql, ref_sql, keys=GK, src="board", value="condition_mean_mae", frame=lambda v: v.board, extra=""):
    on = ", ".join(keys)
    Q(name, lambda v: me.arm_gains(frame(v), keys, F.expr(cand_sql.replace("@", "")), F.expr(ref_sql.replace("@", "")), value), GAIN.replace("run_scope target split_name", " ".join(k + (":i" if k in ("heldout_fold", "parameter_set", "horizon_checkups") else "") for k in keys)),
      f"""SELECT {', '.join('c.' + k for k in keys)}, c.model_level AS candidate_model_level, c.feature_group AS candidate_feature_group, r.model_level AS reference_model_level, r.feature_group AS reference_feature_group,
      r.{value} - c.{value} AS gain, CASE WHEN abs(r.{value}) > 1e-12 THEN (r.{value} - c.{value}) / r.{value} END AS relative_gain, r.{value} - c.{value} > 1e-12::DOUBLE AS beats_reference
      FROM {src} c JOIN {src} r USING ({on}) WHERE {cand_sql.replace('@', 'c.')} AND {ref_sql.replace('@', 'r.')}""")


F4 = ru.GROUPS[3]
_gains("A22_stress_ablation_gain", "@model_level = 'L2_rule' AND @feature_group = 'F2_state'", f"@model_level = 'L2_rule' AND @feature_group = '{F4}'")
_gains("A23_stress_gain_vs_references", f"@feature_group = '{F4}'", "@model_level IN ('L0_persistence', 'L1_mean')")
_gains("A125_degradation_by_split", "@model_level <> 'L0_persistence'", "@model_level = 'L0_persistence'", value="worst_condition_mae")
CK = ["run_scope", "split_name", "heldout_fold", "target", "parameter_set"]
for _n in ("J08_candidate_reference_pairing", "A125b_condition_degradation"):
    _gains(_n, "@model_level <> 'L0_persistence'", "@model_level = 'L0_persistence'", CK, "cerr", "condition_mae", lambda v: v.cerr)
Q("A14_rate_target_comparison", lambda v: me.error_summary(v.preds.filter("run_scope = 'primary' AND model_level = 'L2_rule'").withColumn("path", F.when(F.col("target") == ru.DELTA, "rate").otherwise("direct")), ["split_name", "feature_group", "path"]).groupBy("split_name", "feature_group").agg(
    F.max(F.when(F.col("path") == "direct", F.col("mae"))).alias("direct_mae"), F.max(F.when(F.col("path") == "rate", F.col("mae"))).alias("rate_mae")), "split_name feature_group direct_mae:r rate_mae:r",
  f"SELECT split_name, feature_group, avg(abs(e)) FILTER (target = '{ru.LEVEL}') AS direct_mae, avg(abs(e)) FILTER (target = '{ru.DELTA}') AS rate_mae FROM preds WHERE run_scope = 'primary' AND model_level = 'L2_rule' GROUP BY ALL")
table("best", "SELECT target, split_name, arg_min(model_level, (round(condition_mean_mae, 12), round(worst_condition_mae, 12), model_level, feature_group)) AS best_model_level, arg_min(feature_group, (round(condition_mean_mae, 12), round(worst_condition_mae, 12), model_level, feature_group)) AS best_feature_group, min(condition_mean_mae) AS best_condition_mean_mae FROM board WHERE run_scope = 'primary' GROUP BY ALL")
BEST = "target split_name best_model_level best_feature_group best_condition_mean_mae:r"
for _n in ("K02_best_arm", "A123_target_comparison"):
    Q(_n, lambda v: me.best_arm(v.board.filter("run_scope = 'primary'")), BEST, "SELECT * FROM best")
Q("A16_best_by_target_split", lambda v: me.best_against_baseline(v.board, v.cerr), f"{BEST} l0_condition_mean_mae:r condition_mean_mae_improvement_vs_l0:r worst_parameter_set_mae:r",
  """SELECT b.*, l.condition_mean_mae AS l0_condition_mean_mae, l.condition_mean_mae - best_condition_mean_mae AS condition_mean_mae_improvement_vs_l0, w.m AS worst_parameter_set_mae FROM best b
  JOIN board l ON l.target = b.target AND l.split_name = b.split_name AND l.model_level = 'L0_persistence' AND l.run_scope = 'primary' JOIN (SELECT target, split_name, model_level, feature_group, max(c) AS m FROM (
  SELECT target, split_name, model_level, feature_group, parameter_set, avg(abs(e)) AS c FROM preds WHERE run_scope = 'primary' GROUP BY ALL) GROUP BY ALL) w ON w.target = b.target AND w.split_name = b.split_name AND w.model_level = best_model_level AND w.feature_group = best_feature_group""")
ES = "n:i mae:r rmse:r bias:r median_abs_error:r parameter_sets:i"
_es = "count(*) AS n, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, avg(e) AS bias, quantile_cont(abs(e), 0.5) AS median_abs_error, count(DISTINCT parameter_set) AS parameter_sets"


def _errors(name, keys, where="run_scope = 'primary'", kinds="", cols=None, sql_cols=None):
    sql_cols = sql_cols or {}
    sel = ", ".join(f"{sql_cols[k]} AS {k}" if k in sql_cols else k for k in keys)
    ints = {"heldout_fold", "parameter_set", "horizon_checkups"}
    Q(name, lambda v: me.error_summary(v.preds.filter(where).withColumns(cols() if cols else {}), keys), " ".join(k + (":i" if k in ints else ":r" if k.startswith("nominal") else "") for k in keys) + " " + ES,
      f"SELECT {sel}, {_es} FROM preds WHERE {where} GROUP BY ALL")


_cr = "run_scope = 'primary' AND split_name = 'c_rate_holdout_fold'"
_errors("A78_hotspots", ["model_level", "feature_group", "target", "parameter_set"], _cr)
_errors("A79_metric_summary", ["model_level", "feature_group", "target"], _cr)
_errors("A21_residual_groups", ["target", "voltage_window_family"], _cr + " AND model_level = 'L2_rule'")
_errors("A20_residual_diagnostics", ["target", "parameter_set", "level_bucket"], _cr + " AND model_level = 'L2_rule'", cols=lambda: {"level_bucket": S.cut(F.col("capacity_Ah_k"), [(1.5, "low"), (2.0, "mid"), (2.5, "high")], "top")},
        sql_cols={"level_bucket": _case("capacity_Ah_k", [(1.5, "low"), (2.0, "mid"), (2.5, "high")], "top")})
_errors("A87_path_error_decomposition", ["split_name", "parameter_set", "target"], "run_scope = 'primary' AND model_level = 'L2_rule' AND feature_group = 'F2_state'")
_gf = ["nominal_temperature_C", "voltage_window_family", "target", "parameter_set"]
Q("A17_grouped_error_summaries", lambda v: me.grouped_errors(v.preds.filter(_cr).withColumn("nominal_temperature_C", F.col("nominal_temperature_C").cast("int")), ["model_level", "feature_group"], _gf), f"model_level feature_group grouping group_value {ES}",
  " UNION ALL ".join(f"SELECT model_level, feature_group, '{g}' AS grouping, {g + ('::INT' if 'temp' in g else '')}::VARCHAR AS group_value, {_es} FROM preds WHERE {_cr} GROUP BY ALL" for g in _gf))
Q("J15_common_coverage", lambda v: me.common_keys(v.preds.filter("run_scope = 'primary'"), ["F1_nominal", F4]), "target split_name cell_id checkup_k:i checkup_k_next:i",
  f"SELECT target, split_name, cell_id, checkup_k, checkup_k_next FROM preds WHERE run_scope = 'primary' AND feature_group = 'F1_nominal' INTERSECT SELECT target, split_name, cell_id, checkup_k, checkup_k_next FROM preds WHERE run_scope = 'primary' AND feature_group = '{F4}'")
Q("U02_key_intersection", lambda v: v.pulse_targets.filter("quality_flags = 'OK'").select("cell_id", "checkup_k").intersect(v.eis_targets.filter("quality_flags = 'OK'").select("cell_id", "checkup_k")), "cell_id checkup_k:i",
  "SELECT cell_id, checkup_k FROM ptgt WHERE quality_flags = 'OK' INTERSECT SELECT cell_id, checkup_k FROM eist WHERE quality_flags = 'OK'")
Q("U01_union_of_reports", lambda v: v.preds.filter("model_level = 'L1_mean'").drop("y_pred_q10").unionByName(v.hpreds.filter("model_level = 'MH2_mean'"), allowMissingColumns=True).groupBy("target", "model_level", "feature_group").agg(F.count(F.lit(1)).alias("n")),
  "target model_level feature_group n:i", "SELECT target, model_level, feature_group, count(*) AS n FROM preds WHERE model_level = 'L1_mean' GROUP BY ALL UNION ALL SELECT target, model_level, feature_group, count(*) FROM hp WHERE model_level = 'MH2_mean' GROUP BY ALL")
Q("U05_dedup_base_rows", lambda v: v.horizon.select("cell_id", "checkup_k", "capacity_Ah_k").dropDuplicates(["cell_id", "checkup_k"]), "cell_id checkup_k:i capacity_Ah_k:r", "SELECT DISTINCT cell_id, checkup_k, capacity_Ah_k FROM hz")
Q("J16_condition_lookup", lambda v: v.spine.groupBy("parameter_set").agg(*[F.min_by(c, F.struct("cell_id", "checkup_k")).alias(c) for c in ("aging_mode", "nominal_temperature_C", "voltage_window_family")]), "parameter_set:i aging_mode nominal_temperature_C:r voltage_window_family",
  "SELECT DISTINCT parameter_set, aging_mode, nominal_temperature_C, voltage_window_family FROM spine")
Q("J18_residual_coupling_join", lambda v: v.preds.filter("run_scope = 'primary' AND target = 'delta_capacity_Ah' AND model_level = 'L2_rule'").join(v.pulse_targets.filter("delta_pulse_1s_resistance IS NOT NULL").select("cell_id", "checkup_k", "delta_pulse_1s_resistance"), ["cell_id", "checkup_k"]).withColumn("residual", F.col("y_pred") - F.col("y_true")),
  "split_name heldout_fold:i feature_group cell_id checkup_k:i residual:r delta_pulse_1s_resistance:r", "SELECT p.*, e AS residual, delta_pulse_1s_resistance FROM preds p JOIN ptgt t USING (cell_id, checkup_k) WHERE run_scope = 'primary' AND target = 'delta_capacity_Ah' AND model_level = 'L2_rule' AND delta_pulse_1s_resistance IS NOT NULL")

# ---- horizon arms ----
table("hzs", " UNION ALL ".join(f"SELECT '{s}' AS split_name, {s} AS fold, * FROM hz" for s in SPLITS))
table("hfolds", "SELECT DISTINCT split_name, fold AS heldout_fold FROM hzs WHERE split_name = 'condition_fold' OR fold <> 0")
table("hmean", "SELECT f.*, horizon_checkups, avg(delta_capacity_Ah_h) AS md, avg(CASE WHEN horizon_duration_h > 0 THEN delta_capacity_Ah_h / horizon_duration_h END) AS mr FROM hfolds f JOIN hzs h ON h.split_name = f.split_name AND h.fold <> f.heldout_fold GROUP BY ALL")
table("htest", "SELECT h.*, f.heldout_fold, m.md, m.mr FROM hfolds f JOIN hzs h ON h.split_name = f.split_name AND h.fold = f.heldout_fold JOIN hmean m ON m.split_name = f.split_name AND m.heldout_fold = f.heldout_fold AND m.horizon_checkups = h.horizon_checkups")
table("hp", " UNION ALL ".join(f"SELECT 'primary' AS run_scope, 'capacity_Ah_kh' AS target, '{a}' AS model_level, '{g}' AS feature_group, *, capacity_Ah_kh AS y_true, {p} AS y_pred, {p} - capacity_Ah_kh AS e FROM htest" for a, g, p in (
    ("MH0_persistence", "persistence", "capacity_Ah_k"), ("MH1_prior_slope", "prior_slope", "capacity_Ah_k + coalesce(prior_delta_capacity_Ah, 0) * horizon_checkups"), ("MH2_mean", "K2_state_exposure", "capacity_Ah_k + md"),
    ("MH2_mean", "K3_oracle_exposure_diagnostic", "capacity_Ah_k + coalesce(mr * horizon_duration_h, md)"), ("MH2_mean", "K4_trajectory_shape", "capacity_Ah_k + md / 2 + coalesce(prior_delta_capacity_Ah, 0) * horizon_checkups / 2"))))
HPC = f"{ARM} horizon_checkups:i cell_id checkup_k:i y_true:r y_pred:r"
Q("E06_prior_slope", lambda v: v.build_hpreds().filter("model_level = 'MH1_prior_slope'"), HPC, "SELECT * FROM hp WHERE model_level = 'MH1_prior_slope'")
_HK = _ARMQ + ", horizon_checkups"
table("hmet", f"""SELECT * FROM (SELECT {_HK}, count(*) AS test_rows, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, avg(e) AS bias FROM hp GROUP BY ALL)
JOIN (SELECT {_HK}, count(*) AS test_parameter_sets, avg(c) AS condition_mean_mae, quantile_cont(c, 0.5) AS condition_median_mae, max(c) AS worst_condition_mae FROM (SELECT {_HK}, parameter_set, avg(abs(e)) AS c FROM hp GROUP BY ALL) GROUP BY ALL) USING ({_HK})""")
Q("B40_horizon_metrics", lambda v: v.build_hmetrics(), f"{ARM} horizon_checkups:i {MET}", "SELECT * FROM hmet")
HG = ["target", "split_name", "heldout_fold", "horizon_checkups"]
for _n, _c, _r in (("A114_horizon_reference_gain", "model_level = 'MH2_mean'", "model_level IN ('MH0_persistence', 'MH1_prior_slope')"), ("A115_oracle_exposure_gain", "feature_group = 'K3_oracle_exposure_diagnostic'", "feature_group = 'K2_state_exposure'"),
                   ("A116_trajectory_shape_gain", "feature_group = 'K4_trajectory_shape'", "feature_group <> 'K4_trajectory_shape'")):
    _gains(_n, "@" + _c, "@" + _r, HG, "hmet", frame=lambda v: v.hmetrics)
Q("A118_horizon_condition_errors", lambda v: me.error_summary(v.hpreds.filter("split_name = 'c_rate_holdout_fold'"), ["model_level", "feature_group", "horizon_checkups", "parameter_set"]), f"model_level feature_group horizon_checkups:i parameter_set:i {ES}",
  f"SELECT model_level, feature_group, horizon_checkups, parameter_set, {_es} FROM hp WHERE split_name = 'c_rate_holdout_fold' GROUP BY ALL")


def _slope_bins(v):
    d = v.hpreds.withColumns({"abs_error": F.abs(F.col("y_pred") - F.col("y_true")), "bin": S.prior_delta_bin(F.col("prior_delta_capacity_Ah")), "soh_bin": S.soh_bin(F.col("soh_k"))})
    keys = ["split_name", "heldout_fold", "cell_id", "checkup_k", "horizon_checkups", "bin", "soh_bin"]
    a = d.filter("model_level = 'MH1_prior_slope'").select(*keys, F.col("abs_error").alias("slope_error"))
    b = d.filter("feature_group = 'K2_state_exposure'").select(*keys, F.col("abs_error").alias("model_error"))
    return a.join(b, keys).groupBy("horizon_checkups", "bin", "soh_bin").agg(F.count(F.lit(1)).alias("n"), F.avg("slope_error").alias("slope_mae"), F.avg("model_error").alias("model_mae"),
                                                                           F.avg((F.col("model_error") < F.col("slope_error")).cast("double")).alias("win_fraction"))


Q("A117_prior_slope_failure_bins", _slope_bins, "horizon_checkups:i bin soh_bin n:i slope_mae:r model_mae:r win_fraction:r",
  f"""SELECT horizon_checkups, bin, soh_bin, count(*) AS n, avg(abs(s)) AS slope_mae, avg(abs(m)) AS model_mae, avg((abs(m) < abs(s))::INT) AS win_fraction FROM (
  SELECT horizon_checkups, {_pd} AS bin, {_soh} AS soh_bin, capacity_Ah_k + coalesce(prior_delta_capacity_Ah, 0) * horizon_checkups - capacity_Ah_kh AS s, capacity_Ah_k + md - capacity_Ah_kh AS m FROM htest) GROUP BY ALL""")
# ---- diagnostic horizon arms ----
_dk = ["diagnostic_family", "target_name", "horizon_checkups"]


def _dpred(v):
    d = test_rows(v.diagnostic.filter("diagnostic_value_k IS NOT NULL"))
    m = ru.train_means(v.diagnostic.filter("diagnostic_value_k IS NOT NULL"), {"mean_value": F.col("diagnostic_value_kh")}, ["diagnostic_family", "target_name", "horizon_checkups"])
    d = d.join(F.broadcast(m), ["split_name", "heldout_fold", *_dk])
    arms = F.array(*[F.struct(F.lit(a).alias("model_level"), p.alias("y_pred")) for a, p in (("DM0_persistence", F.col("diagnostic_value_k")), ("DM1_mean", F.col("mean_value")), ("DM3_blend", (F.col("mean_value") + F.col("diagnostic_value_k")) / 2))])
    return d.withColumn("_a", F.explode(arms)).select("*", "_a.model_level", "_a.y_pred").withColumns({"y_true": F.col("diagnostic_value_kh"), "feature_group": F.lit("DH0")}).drop("_a")


_dhs = " UNION ALL ".join(f"SELECT '{s}' AS split_name, {s} AS fold, * FROM dhz WHERE diagnostic_value_k IS NOT NULL" for s in SPLITS)
table("dhs", _dhs)
table("dpt", """WITH f AS (SELECT DISTINCT split_name, fold FROM dhs WHERE split_name = 'condition_fold' OR fold <> 0),
m AS (SELECT f.split_name, f.fold, diagnostic_family, target_name, horizon_checkups, avg(diagnostic_value_kh) AS mv FROM f JOIN dhs d ON d.split_name = f.split_name AND d.fold <> f.fold GROUP BY ALL)
SELECT d.*, d.fold AS heldout_fold, m.mv FROM dhs d JOIN m USING (split_name, fold, diagnostic_family, target_name, horizon_checkups)""")
table("dp", " UNION ALL ".join(f"SELECT *, '{a}' AS model_level, 'DH0' AS feature_group, {p} - diagnostic_value_kh AS e FROM dpt" for a, p in (("DM0_persistence", "diagnostic_value_k"), ("DM1_mean", "mv"), ("DM3_blend", "(mv + diagnostic_value_k) / 2"))))
_DK = "split_name, heldout_fold, model_level, feature_group, diagnostic_family, target_name, horizon_checkups"
table("dmet", f"SELECT * FROM (SELECT {_DK}, count(*) AS test_rows, avg(abs(e)) AS mae FROM dp GROUP BY ALL) JOIN (SELECT {_DK}, avg(c) AS condition_mean_mae FROM (SELECT {_DK}, parameter_set, avg(abs(e)) AS c FROM dp GROUP BY ALL) GROUP BY ALL) USING ({_DK})")
_dm = lambda v: me.regression_metrics(_dpred(v), ["split_name", "heldout_fold", "model_level", "feature_group", *_dk], cut)
Q("B41_diagnostic_metrics", _dm, "split_name heldout_fold:i model_level diagnostic_family target_name horizon_checkups:i test_rows:i mae:r condition_mean_mae:r", "SELECT * FROM dmet")
_gains("A119_diagnostic_gains", "@model_level = 'DM3_blend'", "@model_level <> 'DM3_blend'", [*_dk, "split_name", "heldout_fold"], "dmet", frame=_dm)
Q("A121_diagnostic_hotspots", lambda v: me.error_summary(_dpred(v), ["split_name", "model_level", "target_name", "parameter_set"]), f"split_name model_level target_name parameter_set:i {ES}", f"SELECT split_name, model_level, target_name, parameter_set, {_es} FROM dp GROUP BY ALL")


def _ceiling(v):
    x, y = F.col("diagnostic_value_kh"), F.col("diagnostic_value_kh") - F.col("diagnostic_value_k")
    d = v.diagnostic.filter("diagnostic_value_k IS NOT NULL").withColumn("_c", F.abs(y))
    g = d.groupBy(*_dk).agg(F.avg(x).alias("target_mean"), F.stddev_pop(x).alias("target_std"), (F.max(x) - F.min(x)).alias("target_range"), F.avg("_c").alias("mean_abs_change"),
                            F.avg(F.when(F.col("c_rate_holdout_fold") != 0, F.col("_c"))).alias("c_rate_persistence_mae"))
    from ..functions.ordered import quantiles
    return g.join(quantiles(d, _dk, "_c", {"median_abs_change": 0.5}), _dk)


Q("A120_persistence_ceiling", _ceiling, "diagnostic_family target_name horizon_checkups:i target_mean:r target_std:r target_range:r mean_abs_change:r median_abs_change:r c_rate_persistence_mae:r",
  """SELECT diagnostic_family, target_name, horizon_checkups, avg(diagnostic_value_kh) AS target_mean, stddev_pop(diagnostic_value_kh) AS target_std, max(diagnostic_value_kh) - min(diagnostic_value_kh) AS target_range, avg(c) AS mean_abs_change,
  quantile_cont(c, 0.5) AS median_abs_change, avg(c) FILTER (c_rate_holdout_fold <> 0) AS c_rate_persistence_mae FROM (SELECT *, abs(diagnostic_value_kh - diagnostic_value_k) AS c FROM dhz WHERE diagnostic_value_k IS NOT NULL) GROUP BY ALL""")

# ---- warning arms ----
table("wl", "SELECT *, soh_k - 0.8 AS margin_soh, CASE WHEN checkup_k > 0 THEN (capacity_Ah_k - capacity_Ah_k / soh_k) / checkup_k ELSE 0 END AS slope, CASE WHEN y = 1 THEN 'positive_observed' WHEN coalesce(time_to_event_checkups > hor, false) OR event_observed THEN 'negative_observed' ELSE 'right_censored_unknown' END AS label_status FROM warnt")
table("wls", " UNION ALL ".join(f"SELECT '{s}' AS split_name, {s} AS fold, * FROM wl" for s in SPLITS))
table("wfolds", "SELECT DISTINCT split_name, fold AS heldout_fold FROM wls WHERE split_name = 'condition_fold' OR fold <> 0")
table("wtrain", "SELECT f.heldout_fold, w.* FROM wfolds f JOIN wls w ON w.split_name = f.split_name AND w.fold <> f.heldout_fold")
table("wprior", "SELECT split_name, heldout_fold, target, avg(y) AS prior FROM wtrain GROUP BY ALL")
table("wlimit", "SELECT split_name, heldout_fold, target, max(margin_soh) AS lim FROM (SELECT *, row_number() OVER (PARTITION BY split_name, heldout_fold, target ORDER BY margin_soh) - 1 AS i, count(*) OVER (PARTITION BY split_name, heldout_fold, target) AS n FROM wtrain WHERE y = 1) WHERE i = CAST(floor(0.9::DOUBLE * (n - 1)) AS BIGINT) GROUP BY ALL")
table("wtest", "SELECT w.*, f.heldout_fold, prior, coalesce(lim, 0.0) AS lim FROM wfolds f JOIN wls w ON w.split_name = f.split_name AND w.fold = f.heldout_fold JOIN wprior p ON p.split_name = f.split_name AND p.heldout_fold = f.heldout_fold AND p.target = w.target LEFT JOIN wlimit l ON l.split_name = f.split_name AND l.heldout_fold = f.heldout_fold AND l.target = w.target")
table("wp", " UNION ALL ".join(f"SELECT *, '{a}' AS model_level, ({p})::DOUBLE AS p, ('0x' || substr(md5(cell_id || '|' || checkup_k), 1, 12))::BIGINT AS row_id FROM wtest" for a, p in (
    ("B0_prior", "prior"), ("B1_distance_rule", "CASE WHEN margin_soh <= lim THEN 0.75 ELSE greatest(0.01, 0.25 * prior) END"),
    ("B2_extrapolation", "CASE WHEN slope >= 0 THEN greatest(0.01, 0.2 * prior) WHEN margin_soh / abs(slope) <= hor THEN 0.8 ELSE greatest(0.01, 0.3 * prior) END"))))
WK = ["split_name", "heldout_fold", "target", "model_level"]
WS = "split_name heldout_fold:i target model_level"
_WK = ", ".join(WK)
Q("E13_distance_rule", lambda v: v.build_wpreds().filter("model_level = 'B1_distance_rule'"), f"{WS} cell_id checkup_k:i y:i p:r", "SELECT * FROM wp WHERE model_level = 'B1_distance_rule'")
Q("E14_extrapolation_rule", lambda v: v.build_wpreds().filter("model_level = 'B2_extrapolation'"), f"{WS} cell_id checkup_k:i y:i p:r", "SELECT * FROM wp WHERE model_level = 'B2_extrapolation'")
_clip = "greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, p))"
_z = f"ln({_clip} / (1 - {_clip}))"
table("wpt", f"SELECT {_WK}, count(*) AS n, sum(y) AS positives, avg((p - y) * (p - y)) AS brier, avg(-(y * ln({_clip}) + (1 - y) * ln(1 - {_clip}))) AS log_loss, CASE WHEN var_pop({_z}) > 1e-12 THEN covar_pop({_z}, y) / var_pop({_z}) END AS calibration_slope, "
      f"CASE WHEN var_pop({_z}) > 1e-12 THEN avg(y) - avg({_z}) * covar_pop({_z}, y) / var_pop({_z}) END AS calibration_intercept FROM wp GROUP BY ALL")
for _n, _c in (("A47_brier", "brier:r"), ("A48_log_loss", "log_loss:r"), ("A54_calibration_line", "calibration_slope:r calibration_intercept:r")):
    Q(_n, lambda v: me.point_scores(v.wpreds, WK), f"{WS} n:i {_c}", "SELECT * FROM wpt")
table("wauc", f"""SELECT {_WK}, CASE WHEN sum(y) > 0 AND sum(y) < count(*) THEN (sum(y * r) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * (count(*) - sum(y))) END AS auroc FROM (
  SELECT *, rank() OVER (PARTITION BY {_WK} ORDER BY p) + (count(*) OVER (PARTITION BY {_WK}, p) - 1) / 2.0::DOUBLE AS r FROM wp) GROUP BY ALL""")
Q("A49_auroc", lambda v: me.auroc(v.wpreds, WK), f"{WS} auroc:r", "SELECT * FROM wauc")
table("wpr", f"""SELECT {_WK}, CASE WHEN sum(y) > 0 THEN coalesce(sum(CASE WHEN y = 1 THEN tp / rn::DOUBLE END), 0) / sum(y) END AS auprc FROM (SELECT *, sum(y) OVER w AS tp, row_number() OVER w AS rn FROM wp
  WINDOW w AS (PARTITION BY {_WK} ORDER BY p DESC, row_id ROWS UNBOUNDED PRECEDING)) GROUP BY ALL""")
Q("A50_auprc", lambda v: me.auprc(v.wpreds, WK, "row_id"), f"{WS} auprc:r", "SELECT * FROM wpr")
table("wrel", f"SELECT {_WK}, least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS observed_rate FROM wp GROUP BY ALL")
Q("A53_reliability_bins", lambda v: me.reliability_bins(v.wpreds, WK), f"{WS} bin:i n:i mean_p:r observed_rate:r", "SELECT * FROM wrel")
table("wece", f"SELECT {_WK}, sum(n * abs(mean_p - observed_rate)) / sum(n) AS ece FROM wrel GROUP BY ALL")
Q("A51_ece_fixed", lambda v: me.ece(v.wpreds, WK), f"{WS} ece:r", "SELECT * FROM wece")
table("weqf", f"""SELECT {_WK}, sum(abs(sp - sy)) / sum(m) AS ece_equal_frequency FROM (SELECT {_WK}, b, count(*) AS m, sum(p) AS sp, sum(y) AS sy FROM (SELECT *, row_number() OVER (PARTITION BY {_WK} ORDER BY p, y) - 1 AS i, count(*) OVER (PARTITION BY {_WK}) AS n FROM wp),
  (SELECT unnest(range(10)) AS b) WHERE i >= b * n // 10 AND i < (b + 1) * n // 10 GROUP BY ALL) GROUP BY ALL""")
Q("A52_ece_equal_frequency", lambda v: me.ece_equal_frequency(v.wpreds, WK), f"{WS} ece_equal_frequency:r", "SELECT * FROM weqf")
table("wall", f"""SELECT * FROM wpt JOIN wauc USING ({_WK}) JOIN wpr USING ({_WK}) JOIN wece USING ({_WK}) JOIN weqf USING ({_WK}) JOIN (SELECT {_WK}, avg(b) AS condition_mean_brier, max(b) AS worst_condition_brier FROM (
  SELECT {_WK}, parameter_set, avg((p - y) * (p - y)) AS b FROM wp GROUP BY ALL) GROUP BY ALL) USING ({_WK})""")
WM = "n:i positives:i brier:r log_loss:r calibration_slope:r auroc:r auprc:r ece:r ece_equal_frequency:r condition_mean_brier:r worst_condition_brier:r"
Q("A55_warning_metrics", lambda v: me.warning_metrics(v.wpreds, WK), f"{WS} {WM}", "SELECT * FROM wall")
Q("B37_calibration_leaderboard", lambda v: me.warning_metrics(v.wpreds, WK).groupBy("target", "model_level", "split_name").agg(F.count(F.lit(1)).alias("folds"), *[F.avg(c).alias(c) for c in ("brier", "ece", "ece_equal_frequency", "auroc")]),
  "target model_level split_name folds:i brier:r ece:r ece_equal_frequency:r auroc:r", "SELECT target, model_level, split_name, count(*) AS folds, avg(brier) AS brier, avg(ece) AS ece, avg(ece_equal_frequency) AS ece_equal_frequency, avg(auroc) AS auroc FROM wall GROUP BY ALL")


def _perf(v):
    from ..operators.diagnostics import grouped
    d = v.wpreds.withColumns({"lead_time": S.lead_time_bin(F.col("margin_soh"), F.col("time_to_event_checkups")), "proximity": S.proximity_bin(F.col("soh_k"))})
    d = grouped(d, ["lead_time", "proximity"])
    keys = ["split_name", "target", "model_level", "grouping", "group_value"]
    return me.point_scores(d, keys).join(me.auroc(d, keys), keys).join(me.ece(d, keys), keys)


_g = "split_name, target, model_level, grouping, group_value"
table("wgrp", f"SELECT *, 'lead_time' AS grouping, {_lead} AS group_value FROM wp UNION ALL SELECT *, 'proximity', {_prox} FROM wp")
for _n in ("A56_grouped_performance",):
    Q(_n, _perf, "split_name target model_level grouping group_value n:i brier:r auroc:r ece:r",
      f"""SELECT * FROM (SELECT {_g}, count(*) AS n, avg((p - y) * (p - y)) AS brier, CASE WHEN sum(y) > 0 AND sum(y) < count(*) THEN (sum(y * r) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * (count(*) - sum(y))) END AS auroc FROM (
      SELECT *, rank() OVER (PARTITION BY {_g} ORDER BY p) + (count(*) OVER (PARTITION BY {_g}, p) - 1) / 2.0::DOUBLE AS r FROM wgrp) GROUP BY ALL) JOIN (SELECT {_g}, sum(m * abs(mp - my)) / sum(m) AS ece FROM (SELECT {_g}, least(floor(p * 10), 9) AS b, count(*) AS m, avg(p) AS mp, avg(y) AS my FROM wgrp GROUP BY ALL) GROUP BY ALL) USING ({_g})""")
Q("A57_censoring_by_split", lambda v: stack_splits(v.warn_long).groupBy("target", "split_name", "fold").pivot("label_status", ["positive_observed", "negative_observed", "right_censored_unknown"]).agg(F.count(F.lit(1))).fillna(0),
  "target split_name fold:i positive_observed:i negative_observed:i right_censored_unknown:i", "SELECT target, split_name, fold, " + ", ".join(f"count(*) FILTER (label_status = '{s}') AS {s}" for s in ("positive_observed", "negative_observed", "right_censored_unknown")) + " FROM wls GROUP BY ALL")
for _n in ("A58_censoring_policy_comparison",):
    Q(_n, lambda v: __import__("functools").reduce(lambda a, b: a.unionByName(b), [ru.with_policy(v.wpreds, p).groupBy("target", "model_level", "split_name").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("p") - F.col("y")) ** 2).alias("brier")).withColumn("label_policy", F.lit(p))
                                                      for p in ("all_rows", "verified_only", "censored_as_negative")]), "label_policy target model_level split_name n:i brier:r",
      " UNION ALL ".join(f"SELECT '{p}' AS label_policy, target, model_level, split_name, count(*) AS n, avg((p - y) * (p - y)) AS brier FROM wp {w} GROUP BY ALL" for p, w in (("all_rows", ""), ("verified_only", "WHERE label_status <> 'right_censored_unknown'"), ("censored_as_negative", ""))))
Q("P19_label_policy_filter", lambda v: ru.with_policy(v.warn_long, "verified_only"), "target cell_id checkup_k:i label_status", "SELECT * FROM wl WHERE label_status <> 'right_censored_unknown'")
Q("E16_calibration_partition", lambda v: ru.calibration_partition(v.warn_long), "split_name heldout_fold:i target parameter_set:i calibration",
  """SELECT split_name, heldout_fold, target, parameter_set, (r < ceil(0.3 * n) OR pb < 1 OR nb < 1) AND r < n - 1 AS calibration FROM (SELECT *, row_number() OVER w - 1 AS r, count(*) OVER (PARTITION BY split_name, heldout_fold, target) AS n,
  coalesce(sum(pos) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pb, coalesce(sum(neg) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM (
  SELECT split_name, heldout_fold, target, parameter_set, sum(y) AS pos, sum(1 - y) AS neg, ('0x' || substr(md5('42|' || parameter_set), 1, 12))::BIGINT AS h FROM wtrain GROUP BY ALL) WINDOW w AS (PARTITION BY split_name, heldout_fold, target ORDER BY h, parameter_set))""")

# ---- pooling, weights, encoders ----
_res = lambda v: v.preds.filter("run_scope = 'primary' AND target = 'delta_capacity_Ah' AND model_level = 'L1_mean'").withColumn("residual", F.col("y_true") - F.col("y_pred"))
table("res", "SELECT *, -e AS residual FROM preds WHERE run_scope = 'primary' AND target = 'delta_capacity_Ah' AND model_level = 'L1_mean'")
_rbp = "CASE parameter_set % 4 WHEN 0 THEN '<1C' WHEN 1 THEN '1C-1.5C' WHEN 2 THEN '1.5C-5over3C' ELSE '>=5over3C' END"
table("resl", " UNION ALL ".join(f"SELECT split_name, '{p}' AS pool, {e} AS pool_value, cell_id, checkup_k, residual FROM res" for p, e in (("temperature", "nominal_temperature_C::VARCHAR"), ("rate", _rbp), ("window", "voltage_window_family"), ("profile", "profile_label"), ("mode", "aging_mode"))))
table("poolt", "SELECT split_name, pool, pool_value, avg(residual) AS mean, count(*) AS n, avg(residual) * count(*) / (count(*) + 5.0::DOUBLE) AS shrunk_offset FROM resl GROUP BY ALL HAVING count(*) >= 3")
Q("E23_partial_pooling", lambda v: ru.residual_pool(_res(v), ["split_name"]), "split_name pool pool_value mean:r n:i shrunk_offset:r", "SELECT split_name, pool, pool_value, mean, n, shrunk_offset FROM poolt")
Q("E23b_pooled_offset", lambda v: ru.pooled_offset(_res(v), ru.residual_pool(_res(v), ["split_name"]), _res(v).groupBy("split_name").agg(F.avg("residual").alias("global_offset")), ["split_name"], ["cell_id", "checkup_k"]).withColumnRenamed("pooled_offset", "pooled"), "split_name cell_id checkup_k:i hits:i pooled:r",
  "SELECT split_name, cell_id, checkup_k, count(p.shrunk_offset) AS hits, coalesce(avg(p.shrunk_offset), max(g.m)) AS pooled FROM resl r LEFT JOIN poolt p USING (split_name, pool, pool_value) JOIN (SELECT split_name, avg(residual) AS m FROM res GROUP BY ALL) g USING (split_name) GROUP BY ALL")
Q("E24_replicate_radius", lambda v: ru.replicate_radius(_res(v), _res(v).groupBy("split_name", "parameter_set", "checkup_k_next").agg((F.max("y_true") - F.min("y_true")).alias("spread"), F.count(F.lit(1)).alias("c")).filter("c >= 2"), ["split_name"]), "split_name r90:r s90:r radius:r",
  """SELECT split_name, r90, s90, greatest(r90, s90 / 2) AS radius FROM (SELECT split_name, quantile_cont(abs(residual), 0.9) AS r90 FROM res GROUP BY ALL) JOIN (SELECT split_name, quantile_cont(s, 0.9) AS s90 FROM (
  SELECT split_name, max(y_true) - min(y_true) AS s FROM res GROUP BY split_name, parameter_set, checkup_k_next HAVING count(*) >= 2) GROUP BY ALL) USING (split_name)""")


def _bias(v):
    g, glob = ru.bias_correction(_res(v), ["split_name"])
    return g.join(glob, "split_name")


Q("E25_bias_correction", _bias, "split_name nominal_temperature_C:r voltage_window_family rate_bucket group_bias:r global_bias:r",
  f"SELECT * FROM (SELECT split_name, nominal_temperature_C, voltage_window_family, {_rbp} AS rate_bucket, avg(residual) AS group_bias FROM res GROUP BY ALL) JOIN (SELECT split_name, avg(residual) AS global_bias FROM res GROUP BY ALL) USING (split_name)")
_w = "1 + 0.5 * (n::DOUBLE / (c * k) - 1)"
Q("E17_condition_weights", lambda v: ru.balanced_weights(stack_splits(v.spine), ["split_name"], F.col("parameter_set"), 0.5), "split_name cell_id checkup_k:i weight:r",
  f"SELECT split_name, cell_id, checkup_k, {_w} AS weight FROM (SELECT *, count(*) OVER (PARTITION BY split_name) AS n, count(*) OVER (PARTITION BY split_name, parameter_set) AS c, (SELECT count(DISTINCT parameter_set) FROM spine) AS k FROM sfi)")
Q("E18_stressor_weights", lambda v: ru.balanced_weights(stack_splits(v.spine), ["split_name"], S.stressor_key(F.col("split_name")), 0.5), "split_name cell_id checkup_k:i weight:r",
  f"WITH s AS ({' UNION ALL '.join(f'SELECT {chr(39)}{s}{chr(39)} AS split_name, cell_id, checkup_k, {k} AS key FROM spine' for s, k in SKEY.items())}) SELECT split_name, cell_id, checkup_k, {_w} AS weight FROM (SELECT *, count(*) OVER (PARTITION BY split_name) AS n, count(*) OVER (PARTITION BY split_name, key) AS c FROM s) JOIN (SELECT split_name, count(DISTINCT key) AS k FROM s GROUP BY ALL) USING (split_name)")
NUM, CAT = ["capacity_Ah_k", "log_age_efc_delta", "nominal_temperature_C"], ["voltage_window_family", "profile_label"]
_train = lambda v: v.intervals.filter("condition_fold <> 0")
Q("E01_encoder_fit", lambda v: ru.fit_encoder(_train(v), NUM, CAT, ["capacity_Ah_k1"])[0], "field mean:r std:r", " UNION ALL ".join(f"SELECT '{c}' AS field, avg({c}) AS mean, stddev_pop({c}) AS std FROM ivq WHERE condition_fold <> 0" for c in NUM))
Q("E02_encoder_transform", lambda v: ru.transform(v.intervals.filter("condition_fold = 0"), *ru.fit_encoder(_train(v), NUM, CAT), NUM, CAT).select("*", F.concat_ws(",", F.transform("voltage_window_family_hot", lambda x: x.cast("int").cast("string"))).alias("hot")),
  "cell_id checkup_k:i " + " ".join(f"{c}_z:r" for c in NUM) + " hot",
  "SELECT cell_id, checkup_k, " + ", ".join(f"(coalesce({c}, (SELECT avg({c}) FROM ivq WHERE condition_fold <> 0)) - (SELECT avg({c}) FROM ivq WHERE condition_fold <> 0)) / (SELECT stddev_pop({c}) FROM ivq WHERE condition_fold <> 0) AS {c}_z" for c in NUM)
  + ", (SELECT string_agg((v = i.voltage_window_family)::INT::VARCHAR, ',' ORDER BY v) FROM (SELECT DISTINCT voltage_window_family AS v FROM ivq WHERE condition_fold <> 0)) AS hot FROM ivq i WHERE condition_fold = 0")
WNUM = ["soh_k", "calendar_day_k", "cumulative_efc_k"]
Q("E03_variant_encoders", lambda v: ru.fit_encoder(v.warning, WNUM, CAT)[0], "field mean:r std:r", " UNION ALL ".join(f"SELECT '{c}' AS field, avg({c}) AS mean, stddev_pop({c}) AS std FROM warn" for c in WNUM))
Q("J19_capacity_pulse_table", lambda v: v.intervals.join(v.pulse_targets.filter("delta_pulse_1s_resistance IS NOT NULL").select("cell_id", "checkup_k", "delta_pulse_1s_resistance", "pulse_1s_resistance_k"), ["cell_id", "checkup_k"]), "cell_id checkup_k:i delta_capacity_Ah:r delta_pulse_1s_resistance:r pulse_1s_resistance_k:r",
  "SELECT i.cell_id, i.checkup_k, i.delta_capacity_Ah, t.delta_pulse_1s_resistance, t.pulse_1s_resistance_k FROM ivq i JOIN ptgt t USING (cell_id, checkup_k) WHERE delta_pulse_1s_resistance IS NOT NULL")


def _panel(v):
    p = v.pulse_targets.filter("pulse_1s_resistance_k IS NOT NULL").select("cell_id", "checkup_k", "pulse_1s_resistance_k")
    e = v.eis_targets.filter("eis_z_abs_1kHz_k IS NOT NULL").select("cell_id", "checkup_k", "eis_z_abs_1kHz_k")
    s = v.stress.select("cell_id", "checkup_k", "charge_time_h", "stress_coverage_fraction")
    d = v.intervals.join(s, ["cell_id", "checkup_k"]).join(p, ["cell_id", "checkup_k"]).join(e, ["cell_id", "checkup_k"])
    d = cut(d.select("parameter_set", "cell_id", "checkup_k", "charge_time_h", "pulse_1s_resistance_k", "eis_z_abs_1kHz_k", "capacity_Ah_k"))
    # one row per condition of the design
    return d.join(F.broadcast(d.groupBy("parameter_set").agg(F.count(F.lit(1)).alias("condition_rows"))), "parameter_set")


_pansql = "SELECT *, count(*) OVER (PARTITION BY parameter_set) AS condition_rows FROM (SELECT s.*, p.pulse_1s_resistance_k, e.eis_z_abs_1kHz_k FROM stress s JOIN ptgt p USING (cell_id, checkup_k) JOIN eist e USING (cell_id, checkup_k) WHERE p.pulse_1s_resistance_k IS NOT NULL AND e.eis_z_abs_1kHz_k IS NOT NULL)"
for _n in ("S01_panel_load", "J04_sidecar_star_join"):
    Q(_n, _panel, "cell_id checkup_k:i charge_time_h:r pulse_1s_resistance_k:r eis_z_abs_1kHz_k:r condition_rows:i capacity_Ah_k:r", _pansql)
Q("B28_pulse_panel_load", lambda v: _panel(v).join(v.pulse_targets.filter("greatest(alignment_delta_s_k, alignment_delta_s_k1) <= 86400 AND alignment_delta_s_k1 IS NOT NULL").select("cell_id", "checkup_k"), ["cell_id", "checkup_k"], "left_semi"), "cell_id checkup_k:i charge_time_h:r pulse_1s_resistance_k:r",
  f"SELECT q.* FROM ({_pansql}) q JOIN ptgt t USING (cell_id, checkup_k) WHERE greatest(t.alignment_delta_s_k, t.alignment_delta_s_k1) <= 86400 AND t.alignment_delta_s_k1 IS NOT NULL")
