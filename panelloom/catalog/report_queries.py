"""Composite reports: the parts of a report melted into one long table (section, item, measure, value).

A part is a registered query; its SQL oracle is melted in the same way, so each report has its own oracle.
``item`` joins the texts of the part's key columns, ``measure`` names a number of it.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from . import base

#: Whole numbers and rates that name a row rather than measure it.
KEY_NUMBERS = {"heldout_fold", "fold", "parameter_set", "checkup_k", "checkup_k_next", "target_checkup_k", "horizon_checkups", "nearest_parameter_set", "bin", "decile", "k",
               "arm_a_parameter_set", "arm_b_parameter_set", "threshold", "retention_fraction", "nominal_temperature_C", "nominal_charge_C_rate", "top_k", "effect_threshold_Ah", "threshold_s"}
REPORT = "section item measure value:r"


def _split(name: str) -> tuple[list[str], list[str]]:
    """Key columns and measures of a registered query."""
    keys, numbers = [], []
    for column, kind in base.fields(base.SPECS[name]):
        (numbers if kind and column not in KEY_NUMBERS else keys).append(column)
    return keys, numbers


def melted(df: DataFrame, section: str, keys, numbers) -> DataFrame:
    item = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys]) if keys else F.lit("")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).cast("double").alias("value")) for n in numbers]))
    return df.select(F.lit(section).alias("section"), item.alias("item"), each.alias("m")).select("section", "item", "m.measure", "m.value")


def melted_sql(sql: str, section: str, keys, numbers) -> str:
    item = "concat_ws('|', " + ", ".join(f"coalesce(CAST({k} AS VARCHAR), 'null')" for k in keys) + ")" if keys else "''"
    wide = ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in numbers)
    return (f"SELECT '{section}' AS section, item, measure, value FROM (SELECT {item} AS item, {wide} FROM ({sql}) AS p) "
            f"UNPIVOT INCLUDE NULLS (value FOR measure IN ({', '.join(numbers)}))")


def report(name: str, parts: dict[str, str]) -> None:
    """Register ``name`` with its parts {section: registered query}."""
    split = {section: _split(part) for section, part in parts.items()}

    def run(spark, sf_dir):
        frames = [melted(base.QUERIES[part](spark, sf_dir), section, *split[section]) for section, part in parts.items()]
        return base.shape(reduce(DataFrame.unionByName, frames), REPORT)

    body = " UNION ALL ".join(melted_sql(base.ORACLES[part], section, *split[section]) for section, part in parts.items())
    base.QUERIES[name], base.SPECS[name], base.ORACLES[name] = run, REPORT, base.sql_shape(body, REPORT)


report("B11_knee_forensics", {"inconsistent": "A102_inconsistent_conditions", "replicates": "A99_replicate_consistency", "by_condition": "A98_knee_by_condition"})
report("B13_observed_contrast_evaluation", {"stability": "A70_observed_sign_stability", "by_family": "A71_stability_by_family"})
report("B14_ordering_evaluation", {"summary": "A73_ordering_summary", "bootstrap": "A46_accuracy_gain_bootstrap"})
report("B15_ordering_forensics", {"effect_thresholds": "A74_effect_threshold_accuracy", "failure_bins": "A75_arm_vs_arm_by_effect_bin", "rank_correlation": "A76_contrast_rank_correlation",
                                  "topk_regret": "K03_topk_regret"})
report("B17_selective_reliability", {"regression": "A93_selective_regression", "probability": "A94_selective_probability", "ordering": "A95_selective_ordering", "support": "A91_support_summary"})
report("B18_calibration_run", {"radius": "A59_conformal_radius", "rollup": "A62_coverage_rollup"})
report("B19_replicate_report", {"spread": "A04_replicate_spread", "tolerance": "A05_tolerance_band", "errors": "A06_error_vs_spread", "summary": "A07_uncertainty_summary"})
report("B20_c_rate_diagnosis", {"hotspots": "A78_hotspots", "metrics": "A79_metric_summary", "features": "A80_high_error_feature_contrast"})
report("B21_repair_boundary", {"strata": "A88_support_stratum_gains", "targets": "A89_repair_target_rows", "splits": "A90_repair_split_rows"})
report("B22_target_consistency", {"paths": "A81_target_path_summary", "gains": "A83_path_gains", "guardrail": "A84_outside_guardrail"})
report("B23_coupling_diagnostics", {"correlations": "A40_correlation_by_scope", "growth_bins": "A41_growth_bin_residuals", "conditions": "A42_condition_rollup"})
report("B25_eis_qa", {"coverage": "A24_spectrum_coverage", "frequencies": "A34_frequency_mask_audit", "alignment": "A27b_eis_alignment_sensitivity"})
report("B30_prior_feature_comparison", {"gains": "J08c_prior_feature_paired_gains", "bootstrap": "A44_bootstrap_gain"})
report("B31_target_consistency_baseline", {"metrics": "A18_target_path_metrics", "direct_vs_derived": "A19_direct_vs_derived", "residuals": "A20_residual_diagnostics", "groups": "A21_residual_groups"})
report("B34_selector_comparison", {"gains": "A126_attribution_comparison", "lower_bounds": "A45_bootstrap_p05", "dominant": "K05_dominant_conditions"})
report("B38_censoring_comparison", {"by_split": "A57_censoring_by_split", "policies": "A58_censoring_policy_comparison"})
report("B39_warning_diagnosis", {"reliability": "A53_reliability_bins", "groups": "A56_grouped_performance"})
