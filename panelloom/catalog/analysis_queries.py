"""Queries over prediction tables: contrasts, support, uncertainty, coupling, frontiers."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.ordered import ranks
from ..operators import contrasts as co, metrics as me, rules as ru, support as su, uncertainty as un
from ..operators.splits import SPLITS
from .base import Q, table
from .state_queries import _case

# ---- contrasts ----
_meta = ["aging_mode", "nominal_temperature_C", "voltage_window_family", "nominal_charge_C_rate", "nominal_discharge_C_rate", "profile_label"]
table("csum", f"""SELECT parameter_set, count(DISTINCT cell_id) AS cells, count(*) AS interval_rows, min(checkup_k) AS mn, max(checkup_k_next) AS mx, {', '.join(f'min({c}) AS {c}' for c in _meta)},
  list_sort(list_distinct(list(checkup_k) || list(checkup_k_next))) AS ks FROM spine GROUP BY parameter_set""")
Q("A77_condition_summary", lambda v: co.condition_summaries(v.spine).withColumn("n_checkups", F.size("checkups")), "parameter_set:i cells:i interval_rows:i min_checkup_k:i max_checkup_k:i n_checkups:i aging_mode nominal_temperature_C:r",
  "SELECT *, mn AS min_checkup_k, mx AS max_checkup_k, len(ks) AS n_checkups FROM csum")
_fam = []
for _f, (_v, _m) in co.FAMILIES.items():
    _js = "to_json({" + ", ".join(f"'{c}': {c}::VARCHAR" for c in sorted(_m)) + "})::VARCHAR"
    _num = _v if _v.startswith("nominal") else "0.0"
    _fam.append(f"SELECT '{_f}' AS contrast_family, '{_v}' AS varied_field, {_js} AS match_key, {_v}::VARCHAR AS val, {_num}::DOUBLE AS num, parameter_set, cells, interval_rows, mn, mx, ks FROM csum")
table("cfam", " UNION ALL ".join(_fam))
table("ctr", """SELECT printf('%s_%03d_%03d', a.contrast_family, a.parameter_set, b.parameter_set) AS contrast_id, a.contrast_family, a.varied_field, a.match_key, a.parameter_set AS arm_a_parameter_set, b.parameter_set AS arm_b_parameter_set,
  a.val AS arm_a_value, b.val AS arm_b_value, a.cells AS arm_a_cells, b.cells AS arm_b_cells, a.interval_rows AS arm_a_interval_rows, b.interval_rows AS arm_b_interval_rows, len(list_intersect(a.ks, b.ks)) AS common_checkup_count,
  concat_ws(';', CASE WHEN least(a.cells, b.cells) >= 3 THEN 'matched_triplets' WHEN least(a.cells, b.cells) >= 2 THEN 'partial_replicates' ELSE 'insufficient_replicates' END, CASE WHEN len(list_intersect(a.ks, b.ks)) < 3 THEN 'insufficient_common_horizon' END) AS support_quality
FROM cfam a JOIN cfam b ON a.contrast_family = b.contrast_family AND a.match_key = b.match_key AND (a.num < b.num OR (a.num = b.num AND a.val < b.val))""")
CT = "contrast_id contrast_family varied_field match_key arm_a_parameter_set:i arm_b_parameter_set:i arm_a_value arm_b_value arm_a_cells:i arm_b_cells:i common_checkup_count:i support_quality"
Q("J09_matched_contrasts", lambda v: v.build_registry(), CT, "SELECT * FROM ctr")
Q("B12_contrast_registry", lambda v: v.build_registry(), CT + " arm_a_interval_rows:i arm_b_interval_rows:i", "SELECT * FROM ctr")
Q("T02_match_key_json", lambda v: co.condition_summaries(v.spine).select("parameter_set", co.match_key(co.FAMILIES["temperature"][1]).alias("match_key")), "parameter_set:i match_key", "SELECT parameter_set, match_key FROM cfam WHERE contrast_family = 'temperature'")
Q("U03_checkup_set_intersection", lambda v: v.registry.select("contrast_id", F.size("common_checkups").alias("n"), F.array_max("common_checkups").alias("mx")), "contrast_id n:i mx:i",
  "SELECT contrast_id, len(l) AS n, list_max(l) AS mx FROM (SELECT printf('%s_%03d_%03d', a.contrast_family, a.parameter_set, b.parameter_set) AS contrast_id, list_filter(list_intersect(a.ks, b.ks), lambda x: x <> 0) AS l FROM cfam a JOIN cfam b ON a.contrast_family = b.contrast_family AND a.match_key = b.match_key AND (a.num < b.num OR (a.num = b.num AND a.val < b.val)))")
Q("A69_contrast_families", lambda v: co.families(v.registry), "contrast_family contrasts:i triplet_supported:i match_groups:i", "SELECT contrast_family, count(*) AS contrasts, count(*) FILTER (support_quality = 'matched_triplets') AS triplet_supported, count(DISTINCT match_key) AS match_groups FROM ctr GROUP BY 1")
table("loss", "SELECT parameter_set, k, first_value(capacity_Ah) OVER (PARTITION BY cell_id ORDER BY k) - capacity_Ah AS loss FROM pts")
table("stb", """SELECT c.contrast_id, c.contrast_family, a.k AS checkup_k, avg(b.loss) - avg(a.loss) AS effect0, avg((b.loss > a.loss)::INT) AS pairwise_positive_fraction, count(*) AS np FROM ctr c JOIN loss a ON a.parameter_set = arm_a_parameter_set AND a.k <> 0 JOIN loss b ON b.parameter_set = arm_b_parameter_set AND b.k = a.k GROUP BY ALL""")
table("stb2", """SELECT s.*, m.na AS arm_a_replicates, n.na AS arm_b_replicates, n.m - m.m AS effect_b_minus_a, m.na >= 2 AND n.na >= 2 AND (pairwise_positive_fraction >= 0.75 OR pairwise_positive_fraction <= 0.25) AS sign_stable FROM stb s JOIN ctr c USING (contrast_id)
JOIN (SELECT parameter_set, k, count(*) AS na, avg(loss) AS m FROM loss GROUP BY ALL) m ON m.parameter_set = arm_a_parameter_set AND m.k = checkup_k JOIN (SELECT parameter_set, k, count(*) AS na, avg(loss) AS m FROM loss GROUP BY ALL) n ON n.parameter_set = arm_b_parameter_set AND n.k = checkup_k""")
SB = "contrast_id checkup_k:i arm_a_replicates:i arm_b_replicates:i effect_b_minus_a:r pairwise_positive_fraction:r sign_stable"
for _n in ("A70_observed_sign_stability",):
    Q(_n, lambda v: v.build_stability(), SB, "SELECT * FROM stb2")
Q("A71_stability_by_family", lambda v: co.stability_by_family(v.stability), "contrast_family stability_rows:i sign_stable_rows:i sign_stable_fraction:r unique_contrasts:i median_abs_effect_b_minus_a:r",
  "SELECT contrast_family, count(*) AS stability_rows, count(*) FILTER (sign_stable) AS sign_stable_rows, avg(sign_stable::INT) AS sign_stable_fraction, count(DISTINCT contrast_id) AS unique_contrasts, quantile_cont(abs(effect_b_minus_a), 0.5) AS median_abs_effect_b_minus_a FROM stb2 GROUP BY 1")


def _truth(v):
    keys = ["cell_id", "checkup_k", "horizon_checkups"]
    return co.join_truth(v.hpreds, v.horizon.select(*keys, F.col("capacity_Ah_kh").alias("observed")), keys)


Q("J10_prediction_truth_check", lambda v: _truth(v)[1], "rows:i mismatches:i", "SELECT count(*) AS rows, 0 AS mismatches FROM hp")
_SC = "split_name, target, horizon_checkups, model_level, feature_group"
SC = "split_name target horizon_checkups:i model_level feature_group"
_sgn = lambda x: f"CASE WHEN {x} > 1e-12::DOUBLE THEN 'arm_b_more_degraded' WHEN {x} < -1e-12::DOUBLE THEN 'arm_a_more_degraded' ELSE 'tie' END"
table("pgrp", f"SELECT parameter_set, {_SC}, checkup_k, count(*) AS n, avg(-y_true) AS obs, avg(-y_pred) AS prd FROM hp GROUP BY ALL HAVING count(*) >= 2")
table("pw", f"""SELECT *, {_sgn('o')} AS observed_sign_label, {_sgn('p')} AS predicted_sign_label, abs(p - o) AS effect_abs_error, o AS observed_effect_b_minus_a, p AS predicted_effect_b_minus_a,
  {_sgn('o')} <> 'tie' AND {_sgn('p')} <> 'tie' AS sign_evaluable, {_sgn('o')} <> 'tie' AND {_sgn('o')} = {_sgn('p')} AS sign_correct FROM (
  SELECT c.contrast_id, c.contrast_family, c.arm_a_parameter_set, c.arm_b_parameter_set, {', '.join('a.' + x.strip() for x in _SC.split(','))}, a.checkup_k, b.obs - a.obs AS o, b.prd - a.prd AS p
  FROM ctr c JOIN pgrp a ON a.parameter_set = arm_a_parameter_set JOIN pgrp b ON b.parameter_set = arm_b_parameter_set AND {' AND '.join(f'a.{x.strip()} = b.{x.strip()}' for x in _SC.split(','))} AND a.checkup_k = b.checkup_k WHERE support_quality = 'matched_triplets')""")
Q("A72_pairwise_ordering", lambda v: v.build_pairwise(), f"{SC} contrast_id checkup_k:i observed_effect_b_minus_a:r predicted_effect_b_minus_a:r effect_abs_error:r sign_evaluable sign_correct", "SELECT * FROM pw")
table("pwa", "SELECT *, contrast_family AS fam FROM pw UNION ALL SELECT *, 'all' FROM pw")
_osum = """count(*) AS pairwise_rows, count(DISTINCT contrast_id) AS unique_contrasts, count(*) FILTER (sign_evaluable) AS sign_evaluable_rows, count(*) FILTER (sign_correct) AS sign_correct_rows, count(*) FILTER (sign_correct) / nullif(count(*) FILTER (sign_evaluable), 0)::DOUBLE AS sign_accuracy,
  avg(effect_abs_error) AS mean_effect_abs_error, quantile_cont(effect_abs_error, 0.5) AS median_effect_abs_error, count(*) FILTER (observed_sign_label = 'tie') AS observed_tie_rows, count(*) FILTER (predicted_sign_label = 'tie') AS predicted_tie_rows"""
OS = "pairwise_rows:i unique_contrasts:i sign_evaluable_rows:i sign_correct_rows:i sign_accuracy:r mean_effect_abs_error:r median_effect_abs_error:r observed_tie_rows:i predicted_tie_rows:i"
for _n in ("A73_ordering_summary",):
    Q(_n, lambda v: co.ordering_summary(v.pairwise), f"{SC} contrast_family {OS}", f"SELECT {_SC}, fam AS contrast_family, {_osum} FROM pwa GROUP BY ALL")
for _n in ("A74_effect_threshold_accuracy",):
    Q(_n, lambda v: co.threshold_accuracy(v.pairwise), f"{SC} contrast_family effect_threshold_Ah:r pairwise_rows:i unique_contrasts:i sign_accuracy:r median_effect_abs_error:r",
      f"SELECT {_SC}, fam AS contrast_family, t AS effect_threshold_Ah, {_osum} FROM pwa, (VALUES (0.0::DOUBLE), (0.01::DOUBLE), (0.02::DOUBLE), (0.05::DOUBLE)) x(t) WHERE abs(o) >= t GROUP BY ALL")
_bin = _case("abs(c.o)", [(.01, "tiny_lt_0.01Ah"), (.02, "small_0.01_to_0.02Ah"), (.05, "medium_0.02_to_0.05Ah")], "large_ge_0.05Ah")
Q("A75_arm_vs_arm_by_effect_bin", lambda v: co.arm_bins(v.pairwise, F.col("feature_group") == "K2_state_exposure", F.col("feature_group") == "prior_slope"), "horizon_checkups:i effect_bin n:i candidate_accuracy:r reference_accuracy:r candidate_error:r reference_error:r",
  f"SELECT c.horizon_checkups, {_bin} AS effect_bin, count(*) AS n, avg(c.sign_correct::INT) AS candidate_accuracy, avg(r.sign_correct::INT) AS reference_accuracy, avg(c.effect_abs_error) AS candidate_error, avg(r.effect_abs_error) AS reference_error FROM pw c JOIN pw r USING (split_name, target, horizon_checkups, contrast_id, checkup_k) WHERE c.feature_group = 'K2_state_exposure' AND r.feature_group = 'prior_slope' GROUP BY ALL")
table("ceff", f"SELECT {_SC}, fam AS contrast_family, contrast_id, (arm_a_parameter_set * 100000 + arm_b_parameter_set) * 8 + ascii(contrast_id) % 8 AS pair_id, round(avg(o), 10) AS obs, round(avg(p), 10) AS prd FROM pwa GROUP BY ALL")
_CK = f"{_SC}, contrast_family"
table("crank", f"SELECT *, rank() OVER (PARTITION BY {_CK} ORDER BY obs) + (count(*) OVER (PARTITION BY {_CK}, obs) - 1) / 2.0::DOUBLE AS ro, rank() OVER (PARTITION BY {_CK} ORDER BY prd) + (count(*) OVER (PARTITION BY {_CK}, prd) - 1) / 2.0::DOUBLE AS rp FROM ceff")
table("cspear", f"SELECT {_CK}, count(*) AS contrast_rows, CASE WHEN count(*) >= 5 AND stddev_pop(ro) > 0 AND stddev_pop(rp) > 0 THEN corr(ro, rp) END AS spearman_r FROM crank GROUP BY ALL")
table("cken", f"""SELECT {_CK}, CASE WHEN count(*) > 0 AND (sum((a.obs <> b.obs)::INT)) > 0 AND sum((a.prd <> b.prd)::INT) > 0 THEN sum(sign(a.obs - b.obs) * sign(a.prd - b.prd)) / sqrt(sum((a.obs <> b.obs)::INT)::DOUBLE * sum((a.prd <> b.prd)::INT)::DOUBLE) END AS kendall_tau_b
FROM ceff a JOIN ceff b USING ({_CK}) WHERE a.contrast_id < b.contrast_id GROUP BY ALL""")
for _n, _c in (("A76_contrast_rank_correlation", "spearman_r:r kendall_tau_b:r status"), ("A37_spearman_average_ranks", "spearman_r:r"), ("A38_kendall_tau_b", "kendall_tau_b:r")):
    Q(_n, lambda v: co.rank_correlation(v.pairwise), f"{SC} contrast_family contrast_rows:i {_c}",
      f"SELECT * REPLACE (CASE WHEN contrast_rows >= 5 THEN kendall_tau_b END AS kendall_tau_b), CASE WHEN contrast_rows >= 5 THEN 'evaluated' ELSE 'insufficient_contrasts' END AS status FROM cspear LEFT JOIN cken USING ({_CK})")
Q("W25_average_ranks", lambda v: ranks(co.contrast_effects(v.pairwise), [*co.SCOPE, "contrast_family"], "obs", "ro"), f"{SC} contrast_family contrast_id ro:r", "SELECT * FROM crank")
Q("K03_topk_regret", lambda v: co.top_k_regret(v.pairwise), f"{SC} contrast_family top_k:i contrast_rows:i effective_top_k:i topk_overlap_fraction:r mean_observed_effect_selected:r mean_observed_effect_best:r regret_vs_observed_best:r",
  f"""SELECT *, contrast_rows AS cr, mean_observed_effect_best - mean_observed_effect_selected AS regret_vs_observed_best FROM (SELECT {_CK}, top_k, max(n) AS contrast_rows, least(top_k, max(n)) AS effective_top_k, count(*) FILTER (a <= least(top_k, n) AND b <= least(top_k, n)) / least(top_k, max(n))::DOUBLE AS topk_overlap_fraction,
  avg(obs) FILTER (b <= least(top_k, n)) AS mean_observed_effect_selected, avg(obs) FILTER (a <= least(top_k, n)) AS mean_observed_effect_best FROM (SELECT *, row_number() OVER (PARTITION BY {_CK} ORDER BY obs DESC, pair_id) AS a, row_number() OVER (PARTITION BY {_CK} ORDER BY prd DESC, pair_id) AS b,
  count(*) OVER (PARTITION BY {_CK}) AS n FROM ceff), (VALUES (3), (5)) t(top_k) WHERE n >= 3 GROUP BY {_CK}, top_k)""")
Q("A46_accuracy_gain_bootstrap", lambda v: un.bootstrap_mean(v.pairwise.filter("feature_group = 'K2_state_exposure'").withColumn("gain", F.col("sign_correct").cast("double")), ["split_name", "horizon_checkups"], "contrast_id", "gain", 100), "split_name horizon_checkups:i mean_p05:r mean_p50:r mean_p95:r",
  "SELECT split_name, horizon_checkups, quantile_cont(m, 0.05) AS mean_p05, quantile_cont(m, 0.5) AS mean_p50, quantile_cont(m, 0.95) AS mean_p95 FROM (SELECT split_name, horizon_checkups, b, sum(s) / sum(n) AS m FROM bacc GROUP BY ALL) GROUP BY ALL")

# ---- support ----
table("cond", f"SELECT parameter_set, {', '.join(f'min({c}) AS {c}' for c in _meta + SPLITS)} FROM spine GROUP BY parameter_set")
table("conds", " UNION ALL ".join(f"SELECT '{s}' AS split_name, {s} AS fold, * FROM cond" for s in SPLITS))
_sf = "CASE t.split_name WHEN 'temperature_holdout_fold' THEN t.nominal_temperature_C = r.nominal_temperature_C WHEN 'c_rate_holdout_fold' THEN t.nominal_charge_C_rate = r.nominal_charge_C_rate AND t.nominal_discharge_C_rate = r.nominal_discharge_C_rate WHEN 'profile_holdout_fold' THEN t.profile_label = r.profile_label WHEN 'voltage_window_holdout_fold' THEN t.voltage_window_family = r.voltage_window_family ELSE t.aging_mode = r.aging_mode END"
_nums = su.NUMERIC
table("crange", "SELECT f.split_name, f.fold AS heldout_fold, count(*) AS train_conditions, " + ", ".join(f"CASE WHEN max(c.{x}) > min(c.{x}) THEN max(c.{x}) - min(c.{x}) ELSE 1.0 END AS r_{x}" for x in _nums) + " FROM (SELECT DISTINCT split_name, fold FROM conds) f JOIN conds c ON c.split_name = f.split_name AND c.fold <> f.fold GROUP BY ALL")
table("sup", f"""SELECT split_name, heldout_fold, parameter_set, max(train_conditions) AS train_conditions, min(d) AS nearest_distance, arg_min(rid, (d, rid)) AS nearest_parameter_set, sum(ex::INT) AS exact_nominal_match_count, sum(sf::INT) AS same_stressor_support_count, 1.0::DOUBLE / (1.0 + min(d)) AS support_score FROM (
  SELECT t.split_name, t.fold AS heldout_fold, t.parameter_set, r.parameter_set AS rid, g.train_conditions, round(sqrt({' + '.join(f'pow((t.{x} - r.{x}) / g.r_{x}, 2)' for x in _nums)} + {' + '.join(f'(t.{x} <> r.{x})::INT' for x in su.CATEGORICAL)}), 12) AS d,
  {' AND '.join([f'abs(t.{x} - r.{x}) <= 1e-12' for x in _nums] + [f't.{x} = r.{x}' for x in su.CATEGORICAL])} AS ex, {_sf} AS sf FROM conds t JOIN conds r ON r.split_name = t.split_name AND r.fold <> t.fold JOIN crange g ON g.split_name = t.split_name AND g.heldout_fold = t.fold) GROUP BY ALL""")
SU = "split_name heldout_fold:i parameter_set:i train_conditions:i nearest_distance:r nearest_parameter_set:i exact_nominal_match_count:i same_stressor_support_count:i support_score:r"
for _n in ("J12_nearest_condition_support", "B16_condition_support"):
    Q(_n, lambda v: v.build_support(), SU, "SELECT * FROM sup")
Q("P29_low_support_flag", lambda v: v.support.select("split_name", "parameter_set", S.low_support(F.col("support_score")).alias("low")), "split_name parameter_set:i low", "SELECT split_name, parameter_set, support_score < 0.5 AS low FROM sup")
Q("A91_support_summary", lambda v: su.support_summary(v.support, ["split_name"]), "split_name conditions:i low_support:i low_fraction:r mean_score:r median_score:r mean_distance:r",
  "SELECT split_name, count(*) AS conditions, count(*) FILTER (support_score < 0.5) AS low_support, avg((support_score < 0.5)::INT) AS low_fraction, avg(support_score) AS mean_score, quantile_cont(support_score, 0.5) AS median_score, avg(nearest_distance) AS mean_distance FROM sup GROUP BY split_name")
Q("J11_support_attach", lambda v: su.attach(v.hpreds.filter("model_level = 'MH0_persistence'"), v.support), "split_name cell_id checkup_k:i horizon_checkups:i support_score:r nearest_distance:r", "SELECT h.*, support_score, nearest_distance FROM hp h LEFT JOIN sup USING (split_name, parameter_set) WHERE model_level = 'MH0_persistence'")
table("pwsup", "SELECT p.*, least(a.support_score, b.support_score) AS support_score, greatest(a.nearest_distance, b.nearest_distance) AS nearest_distance FROM pw p LEFT JOIN sup a ON a.split_name = p.split_name AND a.parameter_set = arm_a_parameter_set LEFT JOIN sup b ON b.split_name = p.split_name AND b.parameter_set = arm_b_parameter_set")
Q("J11b_two_arm_support_attach", lambda v: su.attach_two(v.pairwise.filter("model_level = 'MH0_persistence'"), v.support), "split_name horizon_checkups:i contrast_id checkup_k:i support_score:r nearest_distance:r", "SELECT * FROM pwsup WHERE model_level = 'MH0_persistence'")
_RET = "(VALUES (1.0::DOUBLE), (0.9::DOUBLE), (0.75::DOUBLE), (0.5::DOUBLE), (0.25::DOUBLE)) t(retention_fraction)"
table("hsel", f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_SC} ORDER BY -support_score, nearest_distance, parameter_set, split_part(cell_id, '_', 2)::INT, checkup_k) AS pos, count(*) OVER (PARTITION BY {_SC}) AS n FROM (SELECT h.*, support_score, nearest_distance FROM hp h JOIN sup USING (split_name, parameter_set))), {_RET} WHERE pos <= greatest(1, ceil(n * retention_fraction))""")
Q("A93_selective_regression", lambda v: su.selective_regression(v.hpreds, v.support, co.SCOPE), f"{SC} retention_fraction:r rows_retained:i conditions_retained:i mae:r rmse:r mean_support_score:r median_nearest_distance:r",
  f"SELECT {_SC}, retention_fraction, count(*) AS rows_retained, count(DISTINCT parameter_set) AS conditions_retained, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, avg(support_score) AS mean_support_score, quantile_cont(nearest_distance, 0.5) AS median_nearest_distance FROM hsel GROUP BY ALL")
Q("W26_supported_row_retention", lambda v: su.retained(su.attach(v.hpreds.filter("model_level = 'MH1_prior_slope'"), v.support).withColumn("_r", su.replicate_of(F.col("cell_id"))), co.SCOPE, "parameter_set", ["_r", "checkup_k"], F.col("_r"), [0.5]), f"{SC} cell_id checkup_k:i",
  "SELECT * FROM hsel WHERE model_level = 'MH1_prior_slope' AND retention_fraction = 0.5")
_WP = "split_name, target, model_level"
table("wsel", f"""SELECT * REPLACE (greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, p)) AS p) FROM (SELECT *, row_number() OVER (PARTITION BY {_WP} ORDER BY -support_score, nearest_distance, parameter_set, split_part(cell_id, '_', 2)::INT, checkup_k) AS pos, count(*) OVER (PARTITION BY {_WP}) AS n FROM (SELECT h.*, support_score, nearest_distance FROM wp h JOIN sup USING (split_name, parameter_set))), {_RET} WHERE pos <= greatest(1, ceil(n * retention_fraction))""")
Q("A94_selective_probability", lambda v: su.selective_probability(v.wpreds, v.support, ["split_name", "target", "model_level"]), "split_name target model_level retention_fraction:r rows_retained:i positive_count:i brier:r ece:r mean_support_score:r",
  f"SELECT * FROM (SELECT {_WP}, retention_fraction, count(*) AS rows_retained, sum(y) AS positive_count, avg((p - y) * (p - y)) AS brier, avg(support_score) AS mean_support_score FROM wsel GROUP BY ALL) JOIN (SELECT {_WP}, retention_fraction, sum(m * abs(mp - my)) / sum(m) AS ece FROM (SELECT {_WP}, retention_fraction, least(floor(p * 10), 9) AS b, count(*) AS m, avg(p) AS mp, avg(y) AS my FROM wsel GROUP BY ALL) GROUP BY ALL) USING ({_WP}, retention_fraction)")
Q("A95_selective_ordering", lambda v: su.selective_ordering(v.pairwise, v.support, co.SCOPE), f"{SC} contrast_family retention_fraction:r rows_retained:i contrasts_retained:i sign_evaluable_rows:i sign_correct_rows:i mean_effect_abs_error:r mean_support_score:r",
  f"""SELECT {_SC}, fam AS contrast_family, retention_fraction, count(*) AS rows_retained, count(DISTINCT contrast_id) AS contrasts_retained, count(*) FILTER (sign_evaluable) AS sign_evaluable_rows, count(*) FILTER (sign_correct) AS sign_correct_rows, avg(effect_abs_error) AS mean_effect_abs_error, avg(support_score) AS mean_support_score FROM (
  SELECT *, row_number() OVER (PARTITION BY {_SC}, fam ORDER BY -support_score, nearest_distance, arm_a_parameter_set, contrast_id, checkup_k) AS pos, count(*) OVER (PARTITION BY {_SC}, fam) AS n FROM (SELECT *, contrast_family AS fam FROM pwsup UNION ALL SELECT *, 'all' FROM pwsup)), {_RET} WHERE pos <= greatest(1, ceil(n * retention_fraction)) GROUP BY ALL""")
table("cgain", "SELECT c.split_name, c.heldout_fold, c.target, c.parameter_set, c.model_level, c.feature_group, r.condition_mae - c.condition_mae AS gain, r.condition_mae AS refm, c.condition_mae AS candm FROM cerr c JOIN cerr r USING (run_scope, split_name, heldout_fold, target, parameter_set) WHERE c.run_scope = 'primary' AND c.model_level <> 'L0_persistence' AND r.model_level = 'L0_persistence'")
_cg = lambda v: me.paired_condition_gains(v.preds.filter("run_scope = 'primary'")).withColumnsRenamed({"candidate_model_level": "model_level", "candidate_feature_group": "feature_group"})
for _n in ("A88_support_stratum_gains",):
    Q(_n, lambda v: su.stratum_gains(_cg(v), v.support, ["split_name", "target", "model_level", "feature_group"]), "split_name target model_level feature_group stratum n:i mean_gain:r median_gain:r",
      "SELECT split_name, target, model_level, feature_group, CASE WHEN support_score < 0.5 THEN 'low_support' ELSE 'high_support' END AS stratum, count(*) AS n, avg(gain) AS mean_gain, quantile_cont(gain, 0.5) AS median_gain FROM cgain JOIN sup USING (split_name, parameter_set) GROUP BY ALL")

# ---- replicate spread and conformal ----
table("lt", "SELECT parameter_set, checkup_k_next, cell_id, 'capacity_Ah_k1' AS target, capacity_Ah_k1 AS y FROM spine UNION ALL SELECT parameter_set, checkup_k_next, cell_id, 'delta_capacity_Ah', delta_capacity_Ah FROM spine")
table("spr", "SELECT parameter_set, checkup_k_next, target, count(*) AS n, avg(y) AS mean, quantile_cont(y, 0.5) AS median, coalesce(stddev_samp(y), 0) AS std, max(y) - min(y) AS spread, min(y) AS lower, max(y) AS upper FROM lt GROUP BY ALL")
SPK = "parameter_set:i checkup_k_next:i target"
Q("A04_replicate_spread", lambda v: v.build_spread(), f"{SPK} n:i mean:r median:r std:r spread:r lower:r upper:r", "SELECT * FROM spr")
Q("A05_tolerance_band", lambda v: un.tolerance_band(v.spread), f"{SPK} lower:r upper:r half_width:r", "SELECT *, spread / 2 AS half_width FROM spr")
_EK = ["split_name", "model_level", "feature_group", "target"]
table("evs", "SELECT split_name, model_level, feature_group, target, parameter_set, count(*) AS n, avg(abs(e)) AS mae, quantile_cont(abs(e), 0.5) AS median_abs_error, avg(spread) AS mean_spread, avg(abs(e)) > avg(spread) + 1e-12 AS exceeds_spread FROM preds JOIN spr USING (parameter_set, checkup_k_next, target) WHERE run_scope = 'primary' GROUP BY ALL")
_evs = lambda v: un.error_vs_spread(v.preds.filter("run_scope = 'primary'"), v.spread, _EK)
Q("A06_error_vs_spread", _evs, "split_name model_level feature_group target parameter_set:i mae:r median_abs_error:r mean_spread:r exceeds_spread", "SELECT * FROM evs")
for _n in ("A07_uncertainty_summary",):
    Q(_n, lambda v: un.uncertainty_summary(_evs(v), _EK), "split_name model_level feature_group target conditions:i fraction_exceeding:r mean_mae:r", "SELECT split_name, model_level, feature_group, target, count(*) AS conditions, avg(exceeds_spread::INT) AS fraction_exceeding, avg(mae) AS mean_mae FROM evs GROUP BY ALL")
_arm1 = "run_scope = 'primary' AND model_level = 'L2_rule' AND feature_group = 'F2_state'"
table("cfp", f"SELECT * FROM preds WHERE {_arm1}")
table("cpool", """SELECT t.target, t.split_name, t.heldout_fold, m.method, abs(p.e) AS a, p.parameter_set, s.spread FROM (SELECT DISTINCT target, split_name, heldout_fold FROM cfp) t JOIN cfp p ON p.target = t.target
JOIN (VALUES ('Q1_split_conformal_abs_residual'), ('Q2_stressor_family_conformal'), ('Q3_replicate_tolerance_hybrid')) m(method) ON m.method NOT LIKE 'Q1%' OR (p.split_name = t.split_name AND p.heldout_fold <> t.heldout_fold)
LEFT JOIN spr s ON s.parameter_set = p.parameter_set AND s.checkup_k_next = p.checkup_k_next AND s.target = p.target
WHERE NOT EXISTS (SELECT 1 FROM cfp x WHERE x.target = t.target AND x.split_name = t.split_name AND x.heldout_fold = t.heldout_fold AND x.parameter_set = p.parameter_set)""")
table("crad", """SELECT target, split_name, heldout_fold, method, n_calibration_conditions, n_calibration_rows, CASE WHEN method LIKE 'Q3%' THEN greatest(r, coalesce(rep, 0.0)) ELSE r END AS radius FROM (SELECT target, split_name, heldout_fold, method, count(DISTINCT parameter_set) AS n_calibration_conditions, count(*) AS n_calibration_rows,
  list_sort(list(a))[least(count(*), greatest(1, CAST(ceil((count(*) + 1) * 0.9::DOUBLE) AS BIGINT)))] AS r, quantile_cont(spread, 0.5) AS rep FROM cpool GROUP BY ALL HAVING count(DISTINCT parameter_set) >= 5)""")
table("cint", """SELECT *, miss <= 1e-12 AS covered, 2 * radius AS width, 2 * radius + 20.0 * miss AS interval_score FROM (SELECT p.*, c.method, c.radius, c.n_calibration_conditions, s.spread, greatest(0.0, p.y_pred - radius - p.y_true) + greatest(0.0, p.y_true - p.y_pred - radius) AS miss
FROM cfp p JOIN crad c USING (target, split_name, heldout_fold) LEFT JOIN spr s USING (parameter_set, checkup_k_next, target))""")
_cf = lambda v: un.conformal(v.preds.filter(_arm1), v.spread)
_raw = "run_scope = 'primary' AND model_level = 'L3_quantile'"
_cf0 = lambda v: un.union_all([_cf(v), un.raw_quantile(v.preds.filter(_raw), v.spread)])
table("cint0", f"""SELECT method, target, split_name, heldout_fold, cell_id, checkup_k, parameter_set, spread, covered, width, interval_score FROM cint UNION ALL
SELECT 'Q0_raw_quantile', target, split_name, heldout_fold, cell_id, checkup_k, parameter_set, spread, miss <= 1e-12, w, w + 20.0 * miss FROM (SELECT p.*, s.spread, y_pred_q90 - y_pred_q10 AS w,
greatest(0.0, y_pred_q10 - y_true) + greatest(0.0, y_true - y_pred_q90) AS miss FROM preds p LEFT JOIN spr s USING (parameter_set, checkup_k_next, target) WHERE {_raw} AND y_pred_q10 IS NOT NULL)""")
_mk = ["method", "target", "split_name", "heldout_fold"]
MK = "method target split_name heldout_fold:i"
Q("A59_conformal_radius", lambda v: _cf(v).groupBy(*_mk).agg(F.max("radius").alias("radius")), f"{MK} radius:r", "SELECT method, target, split_name, heldout_fold, max(radius) AS radius FROM cint GROUP BY ALL")
Q("A61_interval_score", _cf0, f"{MK} cell_id checkup_k:i covered width:r interval_score:r", "SELECT * FROM cint0")
_rl = """count(*) AS n_test_rows, count(DISTINCT parameter_set) AS n_test_conditions, avg(covered::INT) AS empirical_coverage, avg(width) AS mean_interval_width, quantile_cont(width, 0.5) AS median_interval_width, avg(interval_score) AS interval_score, avg(spread) AS mean_test_replicate_spread, avg((width < spread - 1e-12)::INT) AS narrower_than_spread_fraction"""
for _n in ("A60_conformal_evaluation", "A62_coverage_rollup"):
    Q(_n, lambda v: un.coverage_rollup(_cf0(v), _mk), f"{MK} n_test_rows:i n_test_conditions:i empirical_coverage:r mean_interval_width:r median_interval_width:r interval_score:r mean_test_replicate_spread:r narrower_than_spread_fraction:r condition_level_coverage:r worst_condition_coverage:r",
      f"SELECT * FROM (SELECT method, target, split_name, heldout_fold, {_rl} FROM cint0 GROUP BY ALL) JOIN (SELECT method, target, split_name, heldout_fold, avg(c) AS condition_level_coverage, min(c) AS worst_condition_coverage FROM (SELECT method, target, split_name, heldout_fold, parameter_set, avg(covered::INT) AS c FROM cint0 GROUP BY ALL) GROUP BY ALL) USING (method, target, split_name, heldout_fold)")

# ---- coupling ----
table("cpl", "SELECT i.*, t.delta_pulse_1s_resistance, t.pulse_1s_resistance_k, ('0x' || substr(md5(i.cell_id || '|' || i.checkup_k), 1, 12))::BIGINT AS row_id FROM ivq i JOIN ptgt t USING (cell_id, checkup_k) WHERE delta_pulse_1s_resistance IS NOT NULL")
table("cpls", "SELECT *, 'all' AS scope FROM cpl UNION ALL SELECT *, 'c_rate' FROM cpl WHERE c_rate_holdout_fold <> 0 UNION ALL SELECT *, 'cold' FROM cpl WHERE nominal_temperature_C <= 10")
_x, _y = "delta_pulse_1s_resistance", "delta_capacity_Ah"
for _n, _c in (("A35_pearson", "pearson:r"), ("A36_spearman_ordinal", "spearman_ordinal:r"), ("A40_correlation_by_scope", "pearson:r spearman_ordinal:r")):
    Q(_n, lambda v: un.correlations(un.with_scopes(v.coupling), ["scope"], _x, _y, "row_id"), f"scope n:i {_c}",
      f"SELECT scope, count(*) AS n, corr({_x}, {_y}) AS pearson, corr(rx, ry) AS spearman_ordinal FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY {_x}, row_id) AS rx, row_number() OVER (PARTITION BY scope ORDER BY {_y}, row_id) AS ry FROM cpls) GROUP BY scope")
_grow = _case(_x, [(-0.001, "negative"), (0.001, "near_zero"), (0.003, "moderate")], "high")
_resj = lambda v: v.preds.filter("run_scope = 'primary' AND target = 'delta_capacity_Ah' AND model_level = 'L2_rule'").join(v.coupling.select("cell_id", "checkup_k", _x, "row_id"), ["cell_id", "checkup_k"])
table("cplr", f"SELECT p.*, c.{_x}, c.row_id FROM preds p JOIN cpl c USING (cell_id, checkup_k) WHERE run_scope = 'primary' AND target = 'delta_capacity_Ah' AND p.model_level = 'L2_rule'")
Q("A41_growth_bin_residuals", lambda v: me.error_summary(_resj(v).withColumn("growth_bin", S.growth_bin(F.col(_x))), ["split_name", "feature_group", "growth_bin"]), "split_name feature_group growth_bin n:i mae:r bias:r",
  f"SELECT split_name, feature_group, {_grow} AS growth_bin, count(*) AS n, avg(abs(e)) AS mae, avg(e) AS bias FROM cplr GROUP BY ALL")
Q("A42_condition_rollup", lambda v: v.coupling.groupBy("parameter_set").agg(F.count(F.lit(1)).alias("n"), F.avg(_x).alias("mean_growth"), F.avg(_y).alias("mean_delta"), F.bool_or(S.cold_fast(F.col("nominal_temperature_C"), F.col("nominal_charge_C_rate"))).alias("cold_fast")), "parameter_set:i n:i mean_growth:r mean_delta:r cold_fast",
  f"SELECT parameter_set, count(*) AS n, avg({_x}) AS mean_growth, avg({_y}) AS mean_delta, bool_or(nominal_temperature_C <= 10 AND nominal_charge_C_rate >= 1) AS cold_fast FROM cpl GROUP BY 1")
Q("W24_error_decile", lambda v: un.deciles(_resj(v).withColumn("ae", F.round(F.abs(F.col("y_pred") - F.col("y_true")), 10)), ["split_name", "feature_group"], "ae", "row_id").groupBy("split_name", "feature_group", "decile").agg(F.count(F.lit(1)).alias("n"), F.avg(_x).alias("mean_growth")), "split_name feature_group decile:i n:i mean_growth:r",
  f"SELECT split_name, feature_group, decile, count(*) AS n, avg({_x}) AS mean_growth FROM (SELECT *, least(9, (10 * (row_number() OVER (PARTITION BY split_name, feature_group ORDER BY round(abs(e), 10), row_id) - 1)) // count(*) OVER (PARTITION BY split_name, feature_group)) + 1 AS decile FROM cplr) GROUP BY ALL")
_h = lambda *p: "('0x' || substr(md5(concat_ws('|', " + ", ".join(p) + ")), 1, 12))::BIGINT"


def _boot_sql(src, keys, cluster, stats, B=100, seed=42):
    k = ", ".join(keys)
    return f"""WITH per AS (SELECT {k}, {cluster}, {stats} FROM {src} GROUP BY ALL), ids AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY {_h(f"'{seed}'", cluster)}, {cluster}) - 1 AS pos, count(*) OVER (PARTITION BY {k}) AS nc FROM per),
    nn AS (SELECT DISTINCT {k}, nc FROM ids), dr AS (SELECT {k}, b, {_h(f"'{seed}'", 'b', 'slot')} % nc AS pos FROM nn, (SELECT unnest(range({B})) AS b), LATERAL (SELECT unnest(range(nc)) AS slot)) SELECT * FROM dr JOIN ids USING ({k}, pos)"""


table("bcor", _boot_sql("cpls", ["scope"], "parameter_set", f"count(*) AS n, sum({_x}) AS sx, sum({_y}) AS sy, sum({_x} * {_x}) AS sxx, sum({_y} * {_y}) AS syy, sum({_x} * {_y}) AS sxy"))
_q3 = lambda e, a=("p05", "p50", "p95"): f"quantile_cont({e}, 0.05) AS {a[0]}, quantile_cont({e}, 0.5) AS {a[1]}, quantile_cont({e}, 0.95) AS {a[2]}"
Q("A43_bootstrap_correlation", lambda v: un.bootstrap_correlation(un.with_scopes(v.coupling), ["scope"], "parameter_set", _x, _y, 100), "scope p05:r p50:r p95:r",
  f"SELECT scope, {_q3('r')} FROM (SELECT scope, b, (sum(sxy) - sum(sx) * sum(sy) / sum(n)) / sqrt((sum(sxx) - sum(sx) * sum(sx) / sum(n)) * (sum(syy) - sum(sy) * sum(sy) / sum(n))) AS r FROM bcor GROUP BY ALL) GROUP BY scope")
_GKq = ["split_name", "target", "model_level", "feature_group"]
table("bgain", _boot_sql("cgain", _GKq, "parameter_set", "sum(gain) AS s, count(*) AS n, sum((gain > 0)::INT) AS wins"))
Q("A44_bootstrap_gain", lambda v: un.bootstrap_mean(_cg(v), _GKq, "parameter_set", "gain", 100), " ".join(_GKq) + " mean_p05:r mean_p50:r mean_p95:r",
  f"SELECT {', '.join(_GKq)}, {_q3('m', ('mean_p05', 'mean_p50', 'mean_p95'))} FROM (SELECT {', '.join(_GKq)}, b, sum(s) / sum(n) AS m FROM bgain GROUP BY ALL) GROUP BY ALL")
table("bacc", _boot_sql("(SELECT * FROM pw WHERE feature_group = 'K2_state_exposure')", ["split_name", "horizon_checkups"], "contrast_id", "sum(sign_correct::INT)::DOUBLE AS s, count(*) AS n"))
table("p05", f"SELECT {', '.join(_GKq)}, list_sort(list(m))[CAST(floor(0.05::DOUBLE * 99) AS BIGINT) + 1] AS p05 FROM (SELECT {', '.join(_GKq)}, b, sum(s) / sum(n) AS m FROM bgain GROUP BY ALL) GROUP BY ALL")
_p05 = lambda v: un.bootstrap_p05(_cg(v), _GKq, "parameter_set", "gain", 100)
Q("A45_bootstrap_p05", _p05, " ".join(_GKq) + " p05:r", "SELECT * FROM p05")

# ---- residualised correlation needs a fit: rows only; see ml queries ----
# ---- paired comparisons, frontiers, gates ----
for _n in ("J08c_prior_feature_paired_gains", "A83_path_gains", "A126_attribution_comparison"):
    Q(_n, lambda v: me.win_rate(_cg(v), _GKq).join(_p05(v), _GKq), " ".join(_GKq) + " n:i mean_gain:r win_rate:r p05:r",
      f"SELECT * FROM (SELECT {', '.join(_GKq)}, count(*) AS n, avg(gain) AS mean_gain, avg((gain > 0)::INT) AS win_rate FROM cgain GROUP BY ALL) JOIN p05 USING ({', '.join(_GKq)})")


def _bvb(v):
    c = me.condition_errors(v.preds.filter("run_scope = 'primary'"), [*_GKq, "heldout_fold"])
    best = me.best_arm(v.board.filter("run_scope = 'primary'")).select("target", "split_name", F.col("best_model_level").alias("model_level"), F.col("best_feature_group").alias("feature_group"))
    k = ["target", "split_name", "heldout_fold", "parameter_set"]
    a = c.join(best, ["target", "split_name", "model_level", "feature_group"]).select(*k, F.col("condition_mae").alias("best_mae"))
    b = c.filter("model_level = 'L0_persistence'").select(*k, F.col("condition_mae").alias("reference_mae"))
    return a.join(b, k).withColumn("gain", F.col("reference_mae") - F.col("best_mae"))


Q("J08b_best_vs_best_pairing", _bvb, "target split_name heldout_fold:i parameter_set:i best_mae:r reference_mae:r gain:r",
  "SELECT c.target, c.split_name, c.heldout_fold, c.parameter_set, c.condition_mae AS best_mae, r.condition_mae AS reference_mae, r.condition_mae - c.condition_mae AS gain FROM cerr c JOIN best b ON b.target = c.target AND b.split_name = c.split_name AND b.best_model_level = c.model_level AND b.best_feature_group = c.feature_group JOIN cerr r ON r.run_scope = 'primary' AND r.model_level = 'L0_persistence' AND r.target = c.target AND r.split_name = c.split_name AND r.heldout_fold = c.heldout_fold AND r.parameter_set = c.parameter_set WHERE c.run_scope = 'primary'")


def _front(v):
    """Arm settings with the rate-split gain and the worst relative degradation elsewhere."""
    b = v.board.filter("run_scope = 'primary' AND target = 'capacity_Ah_k1'").withColumn("model_setting_id", F.concat_ws("|", "model_level", "feature_group"))
    ref = b.filter("model_level = 'L0_persistence'").select("split_name", F.col("condition_mean_mae").alias("ref"))
    d = b.filter("model_level <> 'L0_persistence'").join(ref, "split_name").withColumns({"g": F.col("ref") - F.col("condition_mean_mae"), "deg": (F.col("condition_mean_mae") - F.col("ref")) / F.col("ref")})
    cr = F.col("split_name") == "c_rate_holdout_fold"
    return d.groupBy("model_setting_id", "model_level", "feature_group").agg(F.max(F.when(cr, F.col("g"))).alias("gain"), F.max(F.when(~cr, F.col("deg"))).alias("degradation"))


table("frt", """SELECT model_level || '|' || feature_group AS model_setting_id, model_level, feature_group, max(ref - c) FILTER (split_name = 'c_rate_holdout_fold') AS gain, max((c - ref) / ref) FILTER (split_name <> 'c_rate_holdout_fold') AS degradation FROM (
  SELECT b.*, b.condition_mean_mae AS c, r.condition_mean_mae AS ref FROM board b JOIN board r USING (run_scope, target, split_name) WHERE run_scope = 'primary' AND target = 'capacity_Ah_k1' AND b.model_level <> 'L0_persistence' AND r.model_level = 'L0_persistence') GROUP BY ALL""")
Q("K04_pareto_frontier", lambda v: un.pareto_frontier(_front(v)), "model_setting_id gain:r degradation:r is_nondominated",
  "SELECT *, NOT EXISTS (SELECT 1 FROM frt o WHERE round(o.gain, 12) >= round(f.gain, 12) AND round(o.degradation, 12) <= round(f.degradation, 12) AND (round(o.gain, 12) > round(f.gain, 12) OR round(o.degradation, 12) < round(f.degradation, 12))) AS is_nondominated FROM frt f")


def _gated(v):
    p = _p05(v).filter("split_name = 'c_rate_holdout_fold' AND target = 'capacity_Ah_k1'").select("model_level", "feature_group", "p05")
    return un.gate(_front(v).join(p, ["model_level", "feature_group"]), "gain", "p05", "degradation")


Q("A131_guardrail_gate", _gated, "model_setting_id threshold:r gain:r p05:r degradation:r passes_threshold",
  "SELECT f.*, p.p05, t AS threshold, coalesce(gain > 0 AND p.p05 > 0 AND degradation <= t, false) AS passes_threshold FROM frt f JOIN p05 p ON p.model_level = f.model_level AND p.feature_group = f.feature_group AND split_name = 'c_rate_holdout_fold' AND target = 'capacity_Ah_k1', (VALUES (0.0::DOUBLE), (0.01::DOUBLE), (0.02::DOUBLE), (0.05::DOUBLE), (0.1::DOUBLE)) x(t)")
for _n, _lim in (("K06_guarded_argmax", 0.02), ("K07_guarded_arm_choice", 5.0)):
    Q(_n, lambda v, _lim=_lim: un.guarded_choice(_front(v).withColumn("all", F.lit("all")), ["all"], "gain", "degradation", _lim, "model_setting_id"), "arms_inside:i model_setting_id gain:r degradation:r",
      f"SELECT (SELECT count(*) FROM frt WHERE degradation <= {_lim}) AS arms_inside, model_setting_id, gain, degradation FROM frt ORDER BY degradation > {_lim}, CASE WHEN degradation <= {_lim} THEN -round(gain, 12) ELSE round(degradation, 12) END, model_setting_id LIMIT 1")
Q("K05_dominant_conditions", lambda v: v.violations.join(v.cells.select("cell_id", "parameter_set"), "cell_id").groupBy("parameter_set").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "parameter_set").limit(5), "parameter_set:i n:i",
  "SELECT parameter_set, count(*) AS n FROM viol JOIN cells USING (cell_id) GROUP BY 1 ORDER BY n DESC, parameter_set LIMIT 5")


def _outside(v):
    k = ["target", "model_level", "feature_group"]
    d = v.board.filter("run_scope = 'primary'")
    ref = d.filter("model_level = 'L0_persistence'").select("target", "split_name", F.col("condition_mean_mae").alias("ref"))
    d = d.filter("model_level <> 'L0_persistence' AND split_name <> 'c_rate_holdout_fold'").join(ref, ["target", "split_name"])
    return d.groupBy(*k).agg(F.max((F.col("condition_mean_mae") - F.col("ref")) / F.col("ref")).alias("max_relative_degradation"))


_outq = "SELECT b.target, b.model_level, b.feature_group, max((b.condition_mean_mae - r.condition_mean_mae) / r.condition_mean_mae) AS max_relative_degradation FROM board b JOIN board r USING (run_scope, target, split_name) WHERE run_scope = 'primary' AND b.model_level <> 'L0_persistence' AND r.model_level = 'L0_persistence' AND split_name <> 'c_rate_holdout_fold' GROUP BY ALL"
Q("A84_outside_guardrail", _outside, "target model_level feature_group max_relative_degradation:r", _outq)
Q("A89_repair_target_rows", lambda v: me.win_rate(_cg(v).filter("split_name = 'c_rate_holdout_fold'"), ["target", "model_level", "feature_group"]).join(_outside(v), ["target", "model_level", "feature_group"]), "target model_level feature_group n:i mean_gain:r max_relative_degradation:r",
  f"SELECT * FROM (SELECT target, model_level, feature_group, count(*) AS n, avg(gain) AS mean_gain FROM cgain WHERE split_name = 'c_rate_holdout_fold' GROUP BY ALL) JOIN ({_outq}) USING (target, model_level, feature_group)")
_split = lambda v: me.win_rate(_cg(v), _GKq).withColumn("passes", F.col("mean_gain") > -1e-12)
for _n in ("A85_outside_failure_by_split", "A90_repair_split_rows"):
    Q(_n, _split, " ".join(_GKq) + " n:i mean_gain:r passes", f"SELECT {', '.join(_GKq)}, count(*) AS n, avg(gain) AS mean_gain, avg(gain) > -1e-12 AS passes FROM cgain GROUP BY ALL")


def _hot(v):
    fail = _split(v).filter("NOT passes AND split_name <> 'c_rate_holdout_fold'")
    qa = v.intervals.groupBy("parameter_set").agg(F.sum(F.col("log_age_monotonicity_violation_count")).alias("violations"))
    return su.attach(_cg(v).filter("gain < -1e-12").join(fail.select(*_GKq), _GKq, "left_semi").join(qa, "parameter_set", "left"), v.support)


Q("A86_failing_hotspots", _hot, " ".join(_GKq) + " heldout_fold:i parameter_set:i gain:r violations:i support_score:r",
  f"SELECT c.*, q.violations, s.support_score FROM cgain c JOIN (SELECT {', '.join(_GKq)} FROM cgain WHERE split_name <> 'c_rate_holdout_fold' GROUP BY ALL HAVING avg(gain) <= -1e-12) f USING ({', '.join(_GKq)}) LEFT JOIN (SELECT parameter_set, sum(n_viol) AS violations FROM iv GROUP BY 1) q USING (parameter_set) LEFT JOIN sup s USING (split_name, parameter_set) WHERE gain < -1e-12")
Q("A92_repair_evidence_rows", lambda v: un.union_all([me.win_rate(_cg(v), ["split_name", "target"]).withColumn("source", F.lit("paired")), v.support.groupBy("split_name").agg(F.count(F.lit(1)).alias("n")).withColumn("source", F.lit("support"))]), "source split_name target n:i mean_gain:r",
  "SELECT 'paired' AS source, split_name, target, count(*) AS n, avg(gain) AS mean_gain FROM cgain GROUP BY ALL UNION ALL SELECT 'support', split_name, NULL, count(*), NULL FROM sup GROUP BY split_name")


def _paths(v):
    """Direct and derived (level from change, change from level) predictions of one arm."""
    d = v.preds.filter("run_scope = 'primary' AND model_level = 'L2_rule'")
    other = F.when(F.col("target") == ru.LEVEL, ru.DELTA).otherwise(F.lit(ru.LEVEL))
    shift = F.when(F.col("target") == ru.LEVEL, -F.col("capacity_Ah_k")).otherwise(F.col("capacity_Ah_k"))
    arms = F.array(F.struct(F.lit("direct").alias("path"), F.col("target").alias("t"), F.col("y_true").alias("a"), F.col("y_pred").alias("b")),
                   F.struct(F.lit("derived").alias("path"), other.alias("t"), (F.col("y_true") + shift).alias("a"), (F.col("y_pred") + shift).alias("b")))
    d = d.withColumn("_p", F.explode(arms))
    return d.select("split_name", "heldout_fold", "feature_group", "cell_id", "parameter_set", "checkup_k", F.expr("_p.path"), F.expr("_p.t AS target"), F.expr("_p.a AS y_true"), F.expr("_p.b AS y_pred"))


table("pth", """SELECT split_name, heldout_fold, feature_group, cell_id, parameter_set, checkup_k, 'direct' AS path, target, y_true, y_pred, e FROM preds WHERE run_scope = 'primary' AND model_level = 'L2_rule'
UNION ALL SELECT split_name, heldout_fold, feature_group, cell_id, parameter_set, checkup_k, 'derived', CASE target WHEN 'capacity_Ah_k1' THEN 'delta_capacity_Ah' ELSE 'capacity_Ah_k1' END, CASE target WHEN 'capacity_Ah_k1' THEN y_true - capacity_Ah_k ELSE y_true + capacity_Ah_k END,
  CASE target WHEN 'capacity_Ah_k1' THEN y_pred - capacity_Ah_k ELSE y_pred + capacity_Ah_k END, e FROM preds WHERE run_scope = 'primary' AND model_level = 'L2_rule'""")
Q("A82_path_reconstruction", _paths, "split_name heldout_fold:i feature_group cell_id checkup_k:i path target y_true:r y_pred:r", "SELECT * FROM pth")
_pk = ["split_name", "feature_group", "path", "target"]
for _n in ("A18_target_path_metrics", "A81_target_path_summary"):
    Q(_n, lambda v: me.error_summary(_paths(v), _pk), "split_name feature_group path target n:i mae:r rmse:r bias:r", "SELECT split_name, feature_group, path, target, count(*) AS n, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, avg(e) AS bias FROM pth GROUP BY ALL")
Q("A19_direct_vs_derived", lambda v: _paths(v).groupBy("split_name", "feature_group", "target").agg(*[F.avg(F.when(F.col("path") == p, F.abs(F.col("y_pred") - F.col("y_true")))).alias(f"{p}_mae") for p in ("direct", "derived")]), "split_name feature_group target direct_mae:r derived_mae:r",
  "SELECT split_name, feature_group, target, avg(abs(e)) FILTER (path = 'direct') AS direct_mae, avg(abs(e)) FILTER (path = 'derived') AS derived_mae FROM pth GROUP BY ALL")


def _stress_err(v):
    from ..functions.ordered import quantiles
    p = v.preds.filter("run_scope = 'primary' AND split_name = 'c_rate_holdout_fold' AND model_level = 'L2_rule' AND target = 'delta_capacity_Ah'").withColumn("ae", F.round(F.abs(F.col("y_pred") - F.col("y_true")), 10))
    p = p.join(quantiles(p, ["feature_group"], "ae", {"p75": .75}), "feature_group").withColumn("high", F.col("ae") >= F.col("p75"))
    s = v.stress.select("cell_id", "checkup_k", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in ("charge_time_h", "rest_time_h", "high_voltage_time_h")])).alias("z")).select("cell_id", "checkup_k", "z.*")
    return p.select("feature_group", "cell_id", "checkup_k", "high").join(s, ["cell_id", "checkup_k"]).groupBy("feature_group", "feature").agg(
        F.avg(F.when(F.col("high"), F.col("x"))).alias("high_mean"), F.avg(F.when(~F.col("high"), F.col("x"))).alias("rest_mean"))


for _n in ("A80_high_error_feature_contrast",):
    Q(_n, _stress_err, "feature_group feature high_mean:r rest_mean:r",
      """SELECT feature_group, feature, avg(x) FILTER (ae >= q) AS high_mean, avg(x) FILTER (ae < q) AS rest_mean FROM (SELECT p.feature_group, round(abs(p.e), 10) AS ae, f.feature, f.x, w.q FROM preds p JOIN (SELECT feature_group, quantile_cont(round(abs(e), 10), 0.75) AS q FROM preds WHERE run_scope = 'primary' AND split_name = 'c_rate_holdout_fold' AND model_level = 'L2_rule' AND target = 'delta_capacity_Ah' GROUP BY 1) w USING (feature_group)
      JOIN (SELECT cell_id, checkup_k, unnest(['charge_time_h', 'rest_time_h', 'high_voltage_time_h']) AS feature, unnest([charge_time_h, rest_time_h, time_voltage_ge_4p1_h]) AS x FROM stress) f USING (cell_id, checkup_k) WHERE run_scope = 'primary' AND split_name = 'c_rate_holdout_fold' AND model_level = 'L2_rule' AND target = 'delta_capacity_Ah') GROUP BY ALL""")
Q("A127_replication_rollup", lambda v: v.metrics.groupBy("run_scope", "target", "model_level", "feature_group").agg(F.min("condition_mean_mae").alias("least"), F.max("worst_condition_mae").alias("worst"), F.count(F.lit(1)).alias("runs")), "run_scope target model_level feature_group least:r worst:r runs:i",
  "SELECT run_scope, target, model_level, feature_group, min(condition_mean_mae) AS least, max(worst_condition_mae) AS worst, count(*) AS runs FROM met GROUP BY ALL")
Q("A129_auxiliary_metrics", lambda v: v.preds.filter("run_scope = 'primary'").groupBy("split_name", "heldout_fold", "target").agg(F.avg(F.when(F.col("model_level") == "L2_rule", F.abs(F.col("y_pred") - F.col("y_true")))).alias("mae"), F.avg(F.when(F.col("model_level") == "L1_mean", F.abs(F.col("y_pred") - F.col("y_true")))).alias("train_mean_mae")), "split_name heldout_fold:i target mae:r train_mean_mae:r",
  "SELECT split_name, heldout_fold, target, avg(abs(e)) FILTER (model_level = 'L2_rule') AS mae, avg(abs(e)) FILTER (model_level = 'L1_mean') AS train_mean_mae FROM preds WHERE run_scope = 'primary' GROUP BY ALL")


def _filtered(v):
    from ..operators import diagnostics as dg
    ok = dg.eligible_intervals(v.eis_targets, 86400.0, 0.25)
    d = v.preds.filter("run_scope = 'primary'").join(ok, ["cell_id", "checkup_k", "checkup_k_next"], "left_semi")
    return me.win_rate(me.paired_condition_gains(d), ["split_name", "target", "candidate_model_level", "candidate_feature_group"])


Q("A130_filtered_paired_comparison", _filtered, "split_name target candidate_model_level candidate_feature_group n:i mean_gain:r win_rate:r",
  """WITH d AS (SELECT split_name, heldout_fold, target, model_level, feature_group, preds.parameter_set, avg(abs(e)) AS c FROM preds JOIN eist t USING (cell_id, checkup_k) WHERE run_scope = 'primary' AND greatest(alignment_delta_s_k, alignment_delta_s_k1) <= 86400 AND alignment_delta_s_k IS NOT NULL AND alignment_delta_s_k1 IS NOT NULL AND least(valid_modeling_fraction_k, valid_modeling_fraction_k1) >= 0.25 GROUP BY ALL)
  SELECT a.split_name, a.target, a.model_level AS candidate_model_level, a.feature_group AS candidate_feature_group, count(*) AS n, avg(r.c - a.c) AS mean_gain, avg((r.c - a.c > 0)::INT) AS win_rate FROM d a JOIN d r USING (split_name, heldout_fold, target, parameter_set) WHERE a.model_level <> 'L0_persistence' AND r.model_level = 'L0_persistence' GROUP BY ALL""")
