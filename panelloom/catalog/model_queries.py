"""Estimator and resampling queries over all splits and held-out folds (learnt weights, so no SQL oracle; tests recompute them)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..operators import boosting as bo, logistic as lg, metrics as me, models as mo, ridge as rg, rules as ru, sequences as sq, uncertainty as un
from . import features as fe
from .base import Q
from .ridge_sql import adaptive_sql, board_sql, chosen_sql, gain_sql, metrics_sql, nested_tables, ridge_tables, stacked_tables
from .state_queries import SKEY

DELTA, LEVEL = "delta_capacity_Ah", "capacity_Ah_k1"
F4 = fe.CAPACITY["F4_state_log_age_scalar"]
ARM = "split_name heldout_fold:i model_level feature_group target test_rows:i mae:r rmse:r bias:r condition_mean_mae:r worst_condition_mae:r"
BOARD = "split_name model_level feature_group target fold_count:i condition_mean_mae:r worst_condition_mae:r"


# ---- SQL of the ridge panels ----
_BOTH = {DELTA: DELTA, LEVEL: LEVEL}
ridge_tables("rgc", "SELECT * FROM ivq", _BOTH, fe.CAPACITY, residuals=True)
ridge_tables("rgs", f"SELECT i.*, {', '.join('s.time_voltage_ge_4p1_h AS high_voltage_time_h' if c == 'high_voltage_time_h' else 's.' + c for c in fe.STRESS)} FROM ivq i LEFT JOIN stress s USING (cell_id, checkup_k)", _BOTH, fe.SEMI_EMPIRICAL)
ridge_tables("rgh", "SELECT * FROM hz", {t: t for t in ("capacity_Ah_kh", "delta_capacity_Ah_h")}, fe.HORIZON)
ridge_tables("rgd", """SELECT d.*, h.calendar_day_k, h.cumulative_q_Ah_k, h.prior_delta_capacity_Ah, h.prior_capacity_slope_per_day, h.nominal_charge_C_rate, h.nominal_discharge_C_rate, h.voltage_window_family,
h.profile_label, h.aging_mode FROM dhz d JOIN hz h USING (cell_id, checkup_k, horizon_checkups)""", {t: f"CASE WHEN target_name = '{t}' THEN diagnostic_value_kh END" for t in fe.DIAGNOSTIC_TARGETS}, fe.DIAGNOSTIC)
_IMPEDANCE = f"""SELECT i.*, {', '.join('p.' + c for c in [*fe.PULSE_TARGETS, *fe.PULSE_STATE])}, {', '.join('e.' + c for c in [*fe.SPECTRUM_TARGETS, *fe.SPECTRUM_STATE])}
FROM ivq i LEFT JOIN ptgt p USING (cell_id, checkup_k) LEFT JOIN eist e USING (cell_id, checkup_k)"""
ridge_tables("rgp", _IMPEDANCE, {t: t for t in fe.PULSE_TARGETS}, fe.PULSE)
ridge_tables("rge", _IMPEDANCE, {t: t for t in fe.SPECTRUM_TARGETS}, fe.SPECTRUM)


def _met(pred):
    return me.regression_metrics(pred)


def _ridge(df, targets, groups, arms=rg.plain_arms, **kw):
    """Predictions of ridge arms for feature sets ``groups`` on every split, fold and target."""
    return cut(rg.run(df, targets, arms(groups, **kw), *fe.fields(groups))[0])


def _stressed(v):
    keys = ["cell_id", "checkup_k"]
    return v.intervals.join(v.stress.select(*keys, *[c for c in fe.STRESS if c in v.stress.columns]), keys, "left")


def _trees(df, targets, groups, name, model="L2_trees", **kw):
    """Predictions of boosted trees on the feature set ``name``, every split, fold and target."""
    return bo.run_trees(df, targets, *groups[name], name, model, **kw)


def _ridge_and_trees(df, targets, groups, ridge, name, trees):
    """Metrics of ridge arms and of trees on the feature set ``name``; predictions are folded at once, only errors per arm and condition are stored."""
    pred = rg.run(df, targets, rg.plain_arms(groups, model=ridge), *fe.fields(groups))[0]
    return me.regression_metrics(pred.unionByName(_trees(df, targets, groups, name, trees)), cut=cut)


Q("E08_ridge_arms", lambda v: _met(_ridge(v.intervals, [DELTA, LEVEL], fe.CAPACITY)), ARM, metrics_sql("rgc", {"plain": "L1_ridge"}))
Q("E08_ridge_trees_quantile", lambda v: _met(_ridge(v.intervals, [DELTA, LEVEL], fe.CAPACITY).unionByName(
    _trees(v.intervals, [DELTA, LEVEL], fe.CAPACITY, "F4_state_log_age_scalar", quantile_model="L3_quantile"), allowMissingColumns=True)), ARM)
_SEMI = metrics_sql("rgs", {"plain": "L4_semi_empirical_ridge"})
Q("E28_semi_empirical_ridge", lambda v: _met(_ridge(_stressed(v), [LEVEL, DELTA], fe.SEMI_EMPIRICAL, model="L4_semi_empirical_ridge")), ARM, _SEMI)
Q("B45_semi_empirical_run", lambda v: me.leaderboard(_met(_ridge(_stressed(v), [LEVEL, DELTA], fe.SEMI_EMPIRICAL, model="L4_semi_empirical_ridge"))), BOARD, board_sql(_SEMI))
Q("E09_horizon_ridge", lambda v: _met(_ridge(v.horizon, ["capacity_Ah_kh", "delta_capacity_Ah_h"], fe.HORIZON, model="MH2_ridge")), ARM, metrics_sql("rgh", {"plain": "MH2_ridge"}))
Q("E09_horizon_models", lambda v: _ridge_and_trees(v.horizon, ["capacity_Ah_kh", "delta_capacity_Ah_h"], fe.HORIZON, "MH2_ridge", "K2_nominal_condition", "MH3_trees"), ARM)


def _diagnostic(v):
    """One target column for each diagnostic: a row counts for its own only."""
    return cut(v.diagnostic.withColumns({n: F.when(F.col("target_name") == n, F.col("diagnostic_value_kh")) for n in fe.DIAGNOSTIC_TARGETS}))


Q("E10_diagnostic_ridge", lambda v: _met(_ridge(_diagnostic(v), fe.DIAGNOSTIC_TARGETS, fe.DIAGNOSTIC, model="DM2_ridge")), ARM, metrics_sql("rgd", {"plain": "DM2_ridge"}))
Q("E10_diagnostic_models", lambda v: _ridge_and_trees(_diagnostic(v), fe.DIAGNOSTIC_TARGETS, fe.DIAGNOSTIC, "DM2_ridge", "DH3_capacity_plus_prior_same_diagnostic", "DM3_trees"), ARM)


def _pulse(v):
    p = v.pulse_targets.select("cell_id", "checkup_k", *fe.PULSE_TARGETS, *fe.PULSE_STATE)
    e = v.eis_targets.select("cell_id", "checkup_k", *fe.SPECTRUM_TARGETS, *fe.SPECTRUM_STATE)
    d = cut(v.intervals.join(p, ["cell_id", "checkup_k"], "left").join(e, ["cell_id", "checkup_k"], "left"))
    return _met(_ridge(d, fe.PULSE_TARGETS, fe.PULSE).unionByName(_ridge(d, fe.SPECTRUM_TARGETS, fe.SPECTRUM)))


Q("E11_pulse_eis_models", _pulse, ARM, " UNION ALL ".join(f"SELECT * FROM ({metrics_sql(p, {'plain': 'L1_ridge'})})" for p in ("rgp", "rge")))


WARN_TARGETS = ["event_within_1_checkup", "event_within_2_checkups", "event_within_3_checkups"]


def _warn(v):
    """Logistic and tree probabilities of every target, split and fold."""
    d = v.warning.withColumns({t: F.col(t).cast("double") for t in WARN_TARGETS})
    p = lg.logistic_arms(d, WARN_TARGETS, fe.WARNING)
    t = _trees(d, WARN_TARGETS, fe.WARNING, "W2_nominal", "B6_trees", loss="log")
    names = ["split_name", "heldout_fold", "target", "model_level", "feature_group", "cell_id", "checkup_k", "parameter_set"]
    return cut(un.union_all([x.select(*names, F.col("y_true").cast("int").alias("y"), F.col("y_pred").alias("p")) for x in (p, t)]))


def _warnscores(v):
    d, k = _warn(v), ["split_name", "heldout_fold", "target", "model_level", "feature_group"]
    return me.point_scores(d, k).join(me.auroc(d, k), k)


Q("E12_warning_models", _warnscores, "split_name heldout_fold:i target model_level feature_group n:i brier:r log_loss:r auroc:r")


def _cal(v):
    """Every (split, fold, target): the base model leaves the calibration conditions out, the maps are learnt on them, the fold is judged."""
    part = ru.calibration_partition(v.warn_long).where("calibration")
    d = v.warning.withColumns({t: F.col(t).cast("double") for t in WARN_TARGETS})
    p = cut(lg.logistic_arms(d, WARN_TARGETS, {"W2_nominal": fe.WARNING["W2_nominal"]}, leave_out=part))
    keys = ["split_name", "heldout_fold", "target"]
    rows = p.select(*keys, "cell_id", "checkup_k", "parameter_set", "calibration", F.col("y_true").cast("int").alias("y"), F.col("y_pred").alias("p"))
    return cut(lg.calibrated(rows, keys).withColumn("p", F.col("p_calibrated")))


def _calscores(v):
    d, k = _cal(v), ["split_name", "heldout_fold", "target", "method", "applied"]
    return me.point_scores(d, k).join(me.ece(d, k), k)


Q("E15_platt_isotonic", _calscores, "split_name heldout_fold:i target method applied n:i brier:r log_loss:r ece:r")
Q("B36_warning_calibration_run", lambda v: _calscores(v).groupBy("split_name", "target", "method").agg(
    F.count(F.lit(1)).alias("folds"), F.sum((F.col("applied") != "raw").cast("long")).alias("calibrated_folds"), F.avg("brier").alias("brier"), F.avg("ece").alias("ece")),
  "split_name target method folds:i calibrated_folds:i brier:r ece:r")


F4_SET = {"F4_state_log_age_scalar": F4}


def _weighted(v):
    """Metrics of trees in four weight settings, and of the same settings of the ridge; predictions are folded at once."""
    name = "F4_state_log_age_scalar"
    ridge = rg.run(v.intervals, [DELTA, LEVEL], rg.weighted_arms(name, *F4), *F4)[0]
    ridge = ridge.withColumn("model_level", F.concat("model_level", F.lit("_ridge")))
    return me.regression_metrics(bo.run_weighted(v.intervals, [DELTA, LEVEL], *F4, name).unionByName(ridge), cut=cut)


Q("E19_weighted_bagged_trees", _weighted, ARM)
Q("B32_robust_capacity_run", lambda v: me.leaderboard(_weighted(v)), BOARD)
SEEDS = (42, 43, 44)
NEST = "split_name heldout_fold:i target seed:i setting mean_condition_mae:r worst_condition_mae:r"
PICK = "split_name heldout_fold:i target seed:i policy setting mean_gain:r max_degradation:r guarded"


def _nested(v, targets=(DELTA,), seeds=(42,), settings=rg.SETTINGS):
    return rg.run_nested(v.intervals, list(targets), rg.nested_arms("F4_state_log_age_scalar", *F4, settings=settings, seeds=seeds), *F4)


WEIGHTS = [s for s in rg.SETTINGS if s[1] in ("R0", "R2")]
ridge_tables("rgf", "SELECT * FROM ivq", _BOTH, F4_SET)
nested_tables("rgn", "rgf", SKEY, rg.SETTINGS, [42], [DELTA, LEVEL])
nested_tables("rgr", "rgf", SKEY, WEIGHTS, SEEDS, [DELTA])
Q("E20_worst_fold_selection", lambda v: rg.chosen(_nested(v, (DELTA, LEVEL)), "worst"), NEST, chosen_sql("rgn", "worst"))
Q("E22_arm_selector", lambda v: rg.chosen(_nested(v, (DELTA, LEVEL)), "mean"), NEST, chosen_sql("rgn", "mean"))
Q("E21_adaptive_weight_search", lambda v: _nested(v, (DELTA, LEVEL), settings=WEIGHTS), NEST,
  f"SELECT * FROM rgn_scores WHERE setting IN ({', '.join(repr(n) for n, _, _ in WEIGHTS)})")


def _replicated(v):
    """The search repeated over seeds, with the pick of either policy."""
    scores = _nested(v, seeds=SEEDS, settings=WEIGHTS)
    return un.union_all([rg.adaptive_selection(scores, p) for p in ("max_gain_guarded", "conservative_guarded")])


Q("E33_adaptive_replication", _replicated, PICK, adaptive_sql("rgr"))


def _stack(v):
    p = v.pulse_targets.select("cell_id", "checkup_k", "pulse_1s_resistance_k1")
    d = v.intervals.join(p, ["cell_id", "checkup_k"], "left")
    return cut(rg.run(d, [DELTA, LEVEL], rg.stacked_arms("pulse_1s_resistance_k1", "F4_state_log_age_scalar", *F4), *F4, extra_targets=["pulse_1s_resistance_k1"])[0])


ridge_tables("rgx", "SELECT i.*, p.pulse_1s_resistance_k1 FROM ivq i LEFT JOIN ptgt p USING (cell_id, checkup_k)", _BOTH | {"pulse_1s_resistance_k1": "pulse_1s_resistance_k1"}, F4_SET)
stacked_tables("rgt", "rgx", "pulse_1s_resistance_k1", [DELTA, LEVEL])
_STACK = metrics_sql("rgt", {"without": "D0_without_state", "with": "D1_auxiliary_state"})
Q("E26_out_of_fold_stacking", lambda v: _met(_stack(v)), ARM, _STACK)
Q("B42_distillation_run", lambda v: me.leaderboard(_met(_stack(v))), BOARD, board_sql(_STACK))
Q("B43_distillation_metrics", lambda v: me.error_summary(_stack(v), ["split_name", "heldout_fold", "model_level", "target"]),
  "split_name heldout_fold:i model_level target n:i mae:r rmse:r bias:r median_abs_error:r parameter_sets:i",
  """SELECT split_name, heldout_fold, CASE arm WHEN 'with' THEN 'D1_auxiliary_state' ELSE 'D0_without_state' END AS model_level, target, count(*) AS n, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, avg(e) AS bias,
  quantile_cont(abs(e), 0.5) AS median_abs_error, count(DISTINCT parameter_set) AS parameter_sets FROM rgt_pred GROUP BY ALL""")


def _seq(v):
    vectors = {"true_sequence_vector": "S1_sequence_ridge", "shuffled_sequence_vector": "S1_shuffled_ridge"}
    s = sq.sequence_table(v.spine, v.run_events, sq.VECTOR_V1)
    # the padding at the end of a vector is left off
    s = s.select("cell_id", "checkup_k", *[F.slice(c, F.lit(1), (F.col("selected_event_count") * F.col("event_feature_count")).cast("int")).alias(c) for c in vectors])
    return _met(cut(mo.sequence_ridges(cut(v.intervals.join(s, ["cell_id", "checkup_k"])), DELTA, vectors)))


Q("E29_sequence_ridge", _seq, ARM)
Q("B46_sequence_value_run", lambda v: me.leaderboard(_seq(v)), BOARD)
_HIER = metrics_sql("rgc", {"mean": "H0_global_train_mean", "plain": "H1_state_time_ridge", "pooled": "H2_partial_pooling_ridge"})
Q("B44_hierarchical_predict", lambda v: _met(_ridge(v.intervals, [DELTA, LEVEL], fe.CAPACITY, rg.hierarchical_arms)), ARM, _HIER)

# ---- arms against their references ----
GAIN = "split_name target candidate_model_level candidate_feature_group reference_model_level reference_feature_group gain:r relative_gain:r beats_reference"
KEYS = ["run_scope", "split_name", "target"]


def _gain(board, candidate, reference, keys=KEYS):
    return me.arm_gains(board, keys, F.expr(candidate), F.expr(reference), "condition_mean_mae")


def _corrected(v):
    board = me.leaderboard(_met(_ridge(v.intervals, [DELTA, LEVEL], fe.CAPACITY, rg.corrected_arms)))
    return un.union_all([_gain(board, f"model_level = 'L1_ridge_bias_corrected' AND feature_group = '{g}'", f"model_level = 'L1_ridge' AND feature_group = '{g}'") for g in fe.CAPACITY])


Q("A15_bias_correction_comparison", _corrected, GAIN,
  gain_sql(board_sql(metrics_sql("rgc", {"plain": "L1_ridge", "bias": "L1_ridge_bias_corrected"})), "L1_ridge_bias_corrected", "L1_ridge", "split_name, target"))


def _pooled(v):
    board = me.leaderboard(_met(_ridge(v.intervals, [DELTA, LEVEL], fe.CAPACITY, rg.hierarchical_arms)))
    pairs = [("H2_partial_pooling_ridge", "H1_state_time_ridge"), ("H1_state_time_ridge", "H0_global_train_mean")]
    return un.union_all([_gain(board, f"model_level = '{a}' AND feature_group = '{g}'", f"model_level = '{b}' AND feature_group = '{g}'") for a, b in pairs for g in fe.CAPACITY])


Q("A124_hierarchical_comparison", _pooled, GAIN, " UNION ALL ".join(gain_sql(board_sql(_HIER), a, b, "split_name, target") for a, b in (
    ("H2_partial_pooling_ridge", "H1_state_time_ridge"), ("H1_state_time_ridge", "H0_global_train_mean"))))
Q("A128_distillation_gains", lambda v: _gain(_met(_stack(v)), "model_level = 'D1_auxiliary_state'", "model_level = 'D0_without_state'", [*KEYS, "heldout_fold"]),
  GAIN.replace("target ", "target heldout_fold:i ", 1), gain_sql(_STACK, "D1_auxiliary_state", "D0_without_state", "split_name, target, heldout_fold"))
Q("A122_order_vs_shuffled_gains", lambda v: _gain(_seq(v), "model_level = 'S1_sequence_ridge'", "model_level = 'S1_shuffled_ridge'", [*KEYS, "heldout_fold"]),
  GAIN.replace("target ", "target heldout_fold:i ", 1))


def _semi_gain(v):
    """Best semi-empirical set of each target and split against the widest plain ridge."""
    semi = me.leaderboard(_met(_ridge(_stressed(v), [LEVEL, DELTA], fe.SEMI_EMPIRICAL, model="L4_semi_empirical_ridge")))
    best = me.best_arm(semi).select("target", "split_name", F.col("best_model_level").alias("model_level"), F.col("best_feature_group").alias("feature_group"))
    semi = semi.join(best, ["target", "split_name", "model_level", "feature_group"])
    board = cut(semi.unionByName(me.leaderboard(_met(_ridge(v.intervals, [LEVEL, DELTA], F4_SET)))))
    return _gain(board, "model_level = 'L4_semi_empirical_ridge'", "model_level = 'L1_ridge'")


_TOP = "round(condition_mean_mae, 12), round(worst_condition_mae, 12), model_level, feature_group"
Q("B45_semi_empirical_comparison", _semi_gain, GAIN, gain_sql(
    f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target, split_name ORDER BY {_TOP}) AS turn FROM ({board_sql(_SEMI)})) WHERE turn = 1 UNION ALL "
    f"SELECT *, 1 FROM ({board_sql(metrics_sql('rgc', {'plain': 'L1_ridge'}))}) WHERE feature_group = 'F4_state_log_age_scalar'", "L4_semi_empirical_ridge", "L1_ridge", "split_name, target", same_group=False))


def _resid(v):
    d = mo.residualised(v.coupling, ["delta_pulse_1s_resistance", DELTA], ["capacity_Ah_k", "duration_h", "nominal_temperature_C", "nominal_charge_C_rate", "log_age_efc_delta"], mo.CATEGORICAL)
    d = d.select("row_id", F.lit("all").alias("scope"), "delta_pulse_1s_resistance_residual", "delta_capacity_Ah_residual")
    return un.correlations(d, ["scope"], "delta_pulse_1s_resistance_residual", "delta_capacity_Ah_residual", "row_id")


Q("A39_residualised_correlation", _resid, "scope n:i pearson:r spearman_ordinal:r")
