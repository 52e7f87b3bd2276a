"""Product contracts: ordered column names and types, as the columns of a CREATE TABLE.

Nullability is not part of a contract.
"""
from __future__ import annotations

from pyspark.sql.types import (ArrayType, BooleanType, ByteType, DoubleType, IntegerType, LongType, StringType, StructField,
                               StructType)

SQL_TYPES = {
    "STRING": StringType(),
    "INT": IntegerType(),
    "BIGINT": LongType(),
    "DOUBLE": DoubleType(),
    "BOOLEAN": BooleanType(),
    "ARRAY<DOUBLE>": ArrayType(DoubleType()),
    "ARRAY<TINYINT>": ArrayType(ByteType()),
}


def schema(columns: str) -> StructType:
    """A list of ``name TYPE`` separated by commas; needs no session."""
    pairs = [column.split() for column in columns.split(",")]
    return StructType([StructField(name, SQL_TYPES[kind]) for name, kind in pairs])


# ---- fixed values: names and types of the products' columns ----
COLUMNS: dict[str, str] = {
    "condition": """
        cell_id STRING,
        parameter_set INT,
        replicate_id INT,
        aging_mode STRING,
        nominal_temperature_C DOUBLE,
        voltage_window STRING,
        voltage_window_family STRING,
        soc_window_approx STRING,
        nominal_charge_C_rate DOUBLE,
        nominal_discharge_C_rate DOUBLE,
        profile_label STRING,
        source_file STRING,
        source_archive STRING,
        schema_version STRING
    """,
    "checkups": """
        cell_id STRING,
        parameter_set INT,
        replicate_id INT,
        checkup_k INT,
        timestamp DOUBLE,
        capacity_Ah DOUBLE,
        capacity_soh DOUBLE,
        charge_energy_Wh DOUBLE,
        discharge_energy_Wh DOUBLE,
        temperature_context STRING,
        source_file STRING,
        source_archive STRING,
        schema_version STRING,
        quality_flags STRING
    """,
    "pulse_raw": """
        cell_id STRING,
        checkup_k INT,
        soc_percent DOUBLE,
        temperature_context STRING,
        temperature_C DOUBLE,
        pulse_direction STRING,
        pulse_10ms_resistance DOUBLE,
        pulse_1s_resistance DOUBLE,
        voltage DOUBLE,
        current DOUBLE,
        alignment_method STRING,
        alignment_delta_s DOUBLE,
        source_file STRING,
        quality_flags STRING
    """,
    "pulse_summary": """
        cell_id STRING,
        checkup_k INT,
        soc_percent DOUBLE,
        temperature_context STRING,
        temperature_C DOUBLE,
        pulse_direction STRING,
        pulse_10ms_resistance DOUBLE,
        pulse_1s_resistance DOUBLE,
        alignment_method STRING,
        alignment_delta_s DOUBLE,
        source_file STRING,
        quality_flags STRING
    """,
    "eis": """
        cell_id STRING,
        checkup_k INT,
        soc_percent DOUBLE,
        temperature_context STRING,
        temperature_C DOUBLE,
        frequency_Hz DOUBLE,
        z_real DOUBLE,
        z_imag DOUBLE,
        z_abs DOUBLE,
        phase DOUBLE,
        is_valid_raw BOOLEAN,
        is_valid_modeling_frequency BOOLEAN,
        alignment_method STRING,
        alignment_delta_s DOUBLE,
        source_file STRING,
        source_archive STRING,
        quality_flags STRING
    """,
    "eis_quality": """
        cell_id STRING,
        checkup_k INT,
        soc_percent DOUBLE,
        temperature_context STRING,
        temperature_C_mean DOUBLE,
        total_frequencies INT,
        valid_raw_frequencies INT,
        valid_modeling_frequencies INT,
        valid_modeling_fraction DOUBLE,
        alignment_method STRING,
        alignment_delta_s DOUBLE,
        quality_flags STRING,
        source_file STRING,
        source_archive STRING
    """,
    "excluded": """
        cell_id STRING,
        source_archive STRING,
        source_file STRING,
        reason STRING
    """,
    "log": """
        cell_id STRING,
        timestamp_s DOUBLE,
        v_raw_V DOUBLE,
        ocv_est_V DOUBLE,
        i_raw_A DOUBLE,
        t_cell_degC DOUBLE,
        soc_est DOUBLE,
        delta_q_Ah DOUBLE,
        EFC DOUBLE,
        cap_aged_est_Ah DOUBLE,
        R0_mOhm DOUBLE,
        R1_mOhm DOUBLE,
        source_file STRING,
        source_archive STRING,
        quality_flags STRING
    """,
    "splits": """
        cell_id STRING,
        parameter_set INT,
        replicate_id INT,
        condition_fold INT,
        temperature_holdout_fold INT,
        voltage_window_holdout_fold INT,
        soc_window_holdout_fold INT,
        c_rate_holdout_fold INT,
        profile_holdout_fold INT,
        replicate_calibration_fold INT,
        time_horizon_fold INT,
        schema_version STRING
    """,
    "intervals": """
        cell_id STRING,
        parameter_set INT,
        replicate_id INT,
        aging_mode STRING,
        nominal_temperature_C DOUBLE,
        voltage_window STRING,
        voltage_window_family STRING,
        soc_window_approx STRING,
        nominal_charge_C_rate DOUBLE,
        nominal_discharge_C_rate DOUBLE,
        profile_label STRING,
        checkup_k INT,
        checkup_k_next INT,
        t_result_k_s DOUBLE,
        t_result_k1_s DOUBLE,
        duration_s DOUBLE,
        duration_h DOUBLE,
        calendar_days DOUBLE,
        capacity_Ah_k DOUBLE,
        capacity_Ah_k1 DOUBLE,
        delta_capacity_Ah DOUBLE,
        delta_capacity_soh DOUBLE,
        condition_fold INT,
        temperature_holdout_fold INT,
        voltage_window_holdout_fold INT,
        soc_window_holdout_fold INT,
        c_rate_holdout_fold INT,
        profile_holdout_fold INT,
        replicate_calibration_fold INT,
        time_horizon_fold INT,
        log_age_row_count BIGINT,
        log_age_elapsed_s DOUBLE,
        log_age_efc_delta DOUBLE,
        log_age_delta_q_Ah DOUBLE,
        log_age_mean_voltage_V DOUBLE,
        log_age_min_voltage_V DOUBLE,
        log_age_max_voltage_V DOUBLE,
        log_age_mean_temperature_C DOUBLE,
        log_age_min_temperature_C DOUBLE,
        log_age_max_temperature_C DOUBLE,
        log_age_mean_current_A DOUBLE,
        log_age_mean_abs_current_A DOUBLE,
        log_age_max_abs_current_A DOUBLE,
        log_age_mean_soc DOUBLE,
        log_age_min_soc DOUBLE,
        log_age_max_soc DOUBLE,
        log_age_capacity_diag_rows_masked BIGINT,
        log_age_r0_diag_rows_masked BIGINT,
        log_age_r1_diag_rows_masked BIGINT,
        LOG_AGE_available BOOLEAN,
        log_age_monotonicity_violation_count BIGINT,
        log_age_timestamp_decrease_count BIGINT,
        log_age_efc_decrease_count BIGINT,
        log_age_max_timestamp_drop_s DOUBLE,
        log_age_max_efc_drop DOUBLE,
        LOG_AGE_monotonicity_clean BOOLEAN,
        quality_flags STRING,
        schema_version STRING
    """,
    "subset_registry": """
        cell_id STRING,
        parameter_set INT,
        replicate_id INT,
        checkup_k INT,
        checkup_k_next INT,
        interval_id STRING,
        baseline_clean_strict BOOLEAN,
        baseline_clean_tolerant BOOLEAN,
        sensitivity_flagged_monotonicity BOOLEAN,
        small_efc_jitter BOOLEAN,
        excluded_due_to_large_efc_drop BOOLEAN,
        excluded_due_to_timestamp_drop BOOLEAN,
        excluded_due_to_missing_log_age BOOLEAN,
        excluded_due_to_duration_error BOOLEAN,
        monotonicity_policy_version STRING,
        schema_version STRING
    """,
    "stress": """
        cell_id STRING,
        parameter_set INT,
        replicate_id INT,
        checkup_k INT,
        checkup_k_next INT,
        schema_version STRING,
        feature_policy_version STRING,
        current_sign_policy STRING,
        current_sign_convention_confirmed BOOLEAN,
        sign_dependent_features_provisional BOOLEAN,
        stress_log_age_row_count BIGINT,
        stress_duration_h DOUBLE,
        time_voltage_lt_3p3_h DOUBLE,
        time_voltage_3p3_3p6_h DOUBLE,
        time_voltage_3p6_3p9_h DOUBLE,
        time_voltage_3p9_4p1_h DOUBLE,
        time_voltage_ge_4p1_h DOUBLE,
        high_voltage_time_h DOUBLE,
        voltage_dwell_weighted_h DOUBLE,
        time_temp_lt_5C_h DOUBLE,
        time_temp_5_15C_h DOUBLE,
        time_temp_15_30C_h DOUBLE,
        time_temp_30_40C_h DOUBLE,
        time_temp_ge_40C_h DOUBLE,
        cold_time_h DOUBLE,
        hot_time_h DOUBLE,
        mean_charge_current_A DOUBLE,
        mean_discharge_current_A DOUBLE,
        charge_time_h DOUBLE,
        discharge_time_h DOUBLE,
        rest_time_h DOUBLE,
        abs_current_ge_1C_time_h DOUBLE,
        abs_current_ge_1p5C_time_h DOUBLE,
        abs_current_ge_5over3C_time_h DOUBLE,
        charge_current_ge_1C_time_h DOUBLE,
        charge_current_ge_1p5C_time_h DOUBLE,
        charge_current_ge_5over3C_time_h DOUBLE,
        time_soc_lt_20_h DOUBLE,
        time_soc_20_50_h DOUBLE,
        time_soc_50_80_h DOUBLE,
        time_soc_ge_80_h DOUBLE,
        high_soc_time_h DOUBLE,
        cold_high_charge_time_h DOUBLE,
        cold_high_abs_current_time_h DOUBLE,
        high_voltage_hot_time_h DOUBLE,
        high_soc_hot_time_h DOUBLE,
        high_voltage_high_abs_current_time_h DOUBLE,
        high_soc_high_abs_current_time_h DOUBLE,
        delta_capacity_per_day DOUBLE,
        delta_capacity_per_efc DOUBLE,
        delta_capacity_per_Ah_throughput DOUBLE,
        log_age_efc_per_day DOUBLE,
        stress_observed_duration_h DOUBLE,
        stress_coverage_fraction DOUBLE,
        median_log_age_dt_s DOUBLE,
        max_log_age_gap_s DOUBLE,
        log_age_gap_count_gt_60s BIGINT,
        log_age_gap_count_gt_300s BIGINT,
        n_charge_events BIGINT,
        n_discharge_events BIGINT,
        n_rest_events BIGINT,
        max_charge_event_h DOUBLE,
        max_discharge_event_h DOUBLE,
        max_rest_event_h DOUBLE,
        max_abs_current_ge_1C_event_h DOUBLE,
        max_abs_current_ge_1p5C_event_h DOUBLE,
        max_abs_current_ge_5over3C_event_h DOUBLE,
        max_cold_high_abs_current_event_h DOUBLE,
        max_high_voltage_high_abs_current_event_h DOUBLE,
        max_high_soc_high_abs_current_event_h DOUBLE
    """,
    "run_events": """
        cell_id STRING,
        parameter_set INT,
        replicate_id INT,
        checkup_k INT,
        checkup_k_next INT,
        event_index INT,
        event_type STRING,
        event_start_s DOUBLE,
        event_end_s DOUBLE,
        event_duration_s DOUBLE,
        event_duration_h DOUBLE,
        mean_voltage_V DOUBLE,
        min_voltage_V DOUBLE,
        max_voltage_V DOUBLE,
        mean_current_A DOUBLE,
        mean_abs_current_A DOUBLE,
        max_abs_current_A DOUBLE,
        mean_temperature_C DOUBLE,
        max_temperature_C DOUBLE,
        mean_soc DOUBLE,
        min_soc DOUBLE,
        max_soc DOUBLE,
        delta_q_Ah DOUBLE,
        delta_EFC DOUBLE,
        high_voltage_event BOOLEAN,
        cold_event BOOLEAN,
        hot_event BOOLEAN,
        high_abs_current_event BOOLEAN,
        cold_high_current_event BOOLEAN,
        high_voltage_high_current_event BOOLEAN,
        source_rows BIGINT,
        max_gap_s DOUBLE,
        quality_flags STRING,
        schema_version STRING
    """,
    "sequence_features": """
        cell_id STRING,
        parameter_set INT,
        replicate_id INT,
        checkup_k INT,
        checkup_k_next INT,
        schema_version STRING,
        feature_policy_version STRING,
        sequence_event_count INT,
        sequence_total_event_duration_h DOUBLE,
        sequence_charge_event_count INT,
        sequence_discharge_event_count INT,
        sequence_rest_event_count INT,
        sequence_unknown_event_count INT,
        sequence_charge_duration_h DOUBLE,
        sequence_discharge_duration_h DOUBLE,
        sequence_rest_duration_h DOUBLE,
        sequence_max_charge_duration_h DOUBLE,
        sequence_max_discharge_duration_h DOUBLE,
        sequence_max_rest_duration_h DOUBLE,
        sequence_high_current_event_count INT,
        sequence_cold_high_current_event_count INT,
        sequence_high_voltage_high_current_event_count INT,
        sequence_transition_charge_rest INT,
        sequence_transition_rest_charge INT,
        sequence_transition_discharge_rest INT,
        sequence_transition_rest_discharge INT,
        sequence_alternation_count INT,
        sequence_first_high_current_position DOUBLE,
        sequence_last_high_current_position DOUBLE,
        sequence_early_high_current_fraction DOUBLE,
        sequence_mid_high_current_fraction DOUBLE,
        sequence_late_high_current_fraction DOUBLE,
        sequence_longest_high_current_burst_h DOUBLE,
        sequence_longest_cold_high_current_burst_h DOUBLE,
        sequence_shuffled_transition_charge_rest INT,
        sequence_shuffled_transition_rest_charge INT,
        sequence_shuffled_transition_discharge_rest INT,
        sequence_shuffled_transition_rest_discharge INT,
        sequence_shuffled_alternation_count INT,
        sequence_shuffled_early_high_current_fraction DOUBLE,
        sequence_shuffled_mid_high_current_fraction DOUBLE,
        sequence_shuffled_late_high_current_fraction DOUBLE,
        sequence_shuffle_seed INT,
        sequence_quality_flags STRING
    """,
    "event_sequences": """
        cell_id STRING,
        parameter_set INT,
        replicate_id INT,
        checkup_k INT,
        checkup_k_next INT,
        schema_version STRING,
        feature_policy_version STRING,
        max_events INT,
        event_feature_count INT,
        event_feature_columns STRING,
        event_count INT,
        selected_event_count INT,
        truncated_event_count INT,
        true_sequence_vector ARRAY<DOUBLE>,
        shuffled_sequence_vector ARRAY<DOUBLE>,
        event_mask ARRAY<TINYINT>,
        sequence_shuffle_seed INT,
        sequence_quality_flags STRING
    """,
    "event_tensors": """
        cell_id STRING,
        parameter_set INT,
        replicate_id INT,
        checkup_k INT,
        checkup_k_next INT,
        schema_version STRING,
        feature_policy_version STRING,
        sampling_policy STRING,
        max_events INT,
        event_feature_count INT,
        event_feature_columns STRING,
        event_count INT,
        selected_event_count INT,
        truncated_event_count INT,
        true_sequence_vector ARRAY<DOUBLE>,
        shuffled_sequence_vector ARRAY<DOUBLE>,
        event_mask ARRAY<TINYINT>,
        sequence_shuffle_seed INT,
        sequence_quality_flags STRING
    """,
    "knee_candidates": """
        cell_id STRING,
        parameter_set INT,
        replicate_id INT,
        aging_mode STRING,
        nominal_temperature_C DOUBLE,
        voltage_window_family STRING,
        nominal_charge_C_rate DOUBLE,
        profile_label STRING,
        detector_name STRING,
        x_axis STRING,
        smoothing_policy STRING,
        knee_checkup_k INT,
        knee_x_value DOUBLE,
        knee_capacity_Ah DOUBLE,
        knee_soh DOUBLE,
        pre_knee_slope DOUBLE,
        post_knee_slope DOUBLE,
        slope_change_ratio DOUBLE,
        detector_quality_flags STRING,
        schema_version STRING
    """,
    "knee_risk": """
        cell_id STRING,
        parameter_set INT,
        replicate_id INT,
        checkup_k INT,
        checkup_k_next INT,
        detector_name STRING,
        x_axis STRING,
        smoothing_policy STRING,
        knee_within_1_checkup BOOLEAN,
        knee_within_2_checkups BOOLEAN,
        knee_within_3_checkups BOOLEAN,
        time_to_knee_checkups INT,
        time_to_knee_days DOUBLE,
        knee_label_quality STRING,
        schema_version STRING
    """,
    "knee_stable": """
        parameter_set INT,
        stability_status STRING,
        n_replicates INT,
        n_valid_knees INT,
        knee_spread_checkups DOUBLE,
        median_knee_checkup_k DOUBLE,
        aging_mode STRING,
        nominal_temperature_C DOUBLE,
        voltage_window_family STRING,
        nominal_charge_C_rate DOUBLE,
        nominal_discharge_C_rate DOUBLE,
        profile_label STRING,
        has_severe_qa_flags BOOLEAN,
        quality_flags STRING,
        schema_version STRING
    """,
    "threshold_labels": """
        cell_id STRING,
        parameter_set INT,
        replicate_id INT,
        checkup_k INT,
        checkup_k_next INT,
        threshold_label STRING,
        threshold_fraction DOUBLE,
        threshold_event_checkup_k INT,
        threshold_event_days DOUBLE,
        threshold_event_efc DOUBLE,
        event_within_1_checkup BOOLEAN,
        event_within_2_checkups BOOLEAN,
        event_within_3_checkups BOOLEAN,
        time_to_event_checkups INT,
        time_to_event_days DOUBLE,
        target_quality_flags STRING,
        schema_version STRING
    """,
    "warning": """
        cell_id STRING,
        parameter_set INT,
        replicate_id INT,
        checkup_k INT,
        capacity_Ah_k DOUBLE,
        soh_k DOUBLE,
        calendar_day_k DOUBLE,
        cumulative_efc_k DOUBLE,
        nominal_temperature_C DOUBLE,
        voltage_window_family STRING,
        nominal_charge_C_rate DOUBLE,
        nominal_discharge_C_rate DOUBLE,
        profile_label STRING,
        aging_mode STRING,
        condition_fold INT,
        temperature_holdout_fold INT,
        c_rate_holdout_fold INT,
        profile_holdout_fold INT,
        voltage_window_holdout_fold INT,
        threshold_name STRING,
        event_checkup_k INT,
        time_to_event_checkups INT,
        event_within_1_checkup BOOLEAN,
        event_within_2_checkups BOOLEAN,
        event_within_3_checkups BOOLEAN,
        event_observed BOOLEAN,
        label_quality STRING,
        schema_version STRING
    """,
    "contrasts": """
        contrast_id STRING,
        contrast_family STRING,
        varied_field STRING,
        match_key STRING,
        arm_a_parameter_set INT,
        arm_b_parameter_set INT,
        arm_a_value STRING,
        arm_b_value STRING,
        arm_a_cells INT,
        arm_b_cells INT,
        arm_a_interval_rows INT,
        arm_b_interval_rows INT,
        arm_a_min_checkup_k INT,
        arm_a_max_checkup_k INT,
        arm_b_min_checkup_k INT,
        arm_b_max_checkup_k INT,
        common_checkup_count INT,
        has_triplet_support BOOLEAN,
        support_quality STRING,
        schema_version STRING
    """,
    "horizon": """
        cell_id STRING,
        parameter_set INT,
        replicate_id INT,
        checkup_k INT,
        target_checkup_k INT,
        horizon_checkups INT,
        capacity_Ah_k DOUBLE,
        capacity_Ah_kh DOUBLE,
        delta_capacity_Ah_h DOUBLE,
        soh_k DOUBLE,
        soh_kh DOUBLE,
        calendar_day_k DOUBLE,
        horizon_days DOUBLE,
        cumulative_efc_k DOUBLE,
        cumulative_q_Ah_k DOUBLE,
        prior_delta_capacity_Ah DOUBLE,
        prior_capacity_slope_per_checkup DOUBLE,
        prior_capacity_slope_per_day DOUBLE,
        nominal_temperature_C DOUBLE,
        voltage_window_family STRING,
        nominal_charge_C_rate DOUBLE,
        nominal_discharge_C_rate DOUBLE,
        profile_label STRING,
        aging_mode STRING,
        condition_fold INT,
        temperature_holdout_fold INT,
        c_rate_holdout_fold INT,
        profile_holdout_fold INT,
        voltage_window_holdout_fold INT,
        horizon_interval_count INT,
        horizon_duration_h DOUBLE,
        horizon_calendar_days DOUBLE,
        horizon_log_age_efc_delta DOUBLE,
        horizon_log_age_delta_q_Ah DOUBLE,
        horizon_log_age_row_count BIGINT,
        event_observed BOOLEAN,
        quality_flags STRING,
        schema_version STRING
    """,
    "trajectory_features": """
        cell_id STRING,
        parameter_set INT,
        replicate_id INT,
        checkup_k INT,
        target_checkup_k INT,
        horizon_checkups INT,
        prior_history_length INT,
        prior_capacity_delta_lag1 DOUBLE,
        prior_capacity_delta_lag2 DOUBLE,
        prior_capacity_delta_lag3 DOUBLE,
        prior_delta_mean_3 DOUBLE,
        prior_delta_std_3 DOUBLE,
        prior_delta_min_3 DOUBLE,
        prior_delta_max_3 DOUBLE,
        prior_delta_mean_all DOUBLE,
        prior_delta_std_all DOUBLE,
        prior_slope_per_day_mean_3 DOUBLE,
        prior_slope_per_day_std_3 DOUBLE,
        prior_capacity_curvature_lag1 DOUBLE,
        prior_capacity_acceleration_mean_3 DOUBLE,
        prior_capacity_volatility_3 DOUBLE,
        prior_capacity_increase_count INT,
        prior_capacity_increase_fraction DOUBLE,
        prior_capacity_range_Ah_all DOUBLE,
        prior_delta_abs_max_all DOUBLE,
        trajectory_quality_flags STRING,
        schema_version STRING
    """,
    "pulse_targets": """
        cell_id STRING,
        parameter_set INT,
        replicate_id INT,
        checkup_k INT,
        checkup_k_next INT,
        soc_percent DOUBLE,
        temperature_context STRING,
        pulse_1s_resistance_k DOUBLE,
        pulse_1s_resistance_k1 DOUBLE,
        delta_pulse_1s_resistance DOUBLE,
        pulse_10ms_resistance_k DOUBLE,
        pulse_10ms_resistance_k1 DOUBLE,
        delta_pulse_10ms_resistance DOUBLE,
        alignment_delta_s_k DOUBLE,
        alignment_delta_s_k1 DOUBLE,
        quality_flags STRING,
        schema_version STRING
    """,
    "eis_features": """
        cell_id STRING,
        parameter_set INT,
        replicate_id INT,
        checkup_k INT,
        soc_percent DOUBLE,
        temperature_context STRING,
        temperature_C_mean DOUBLE,
        valid_modeling_fraction DOUBLE,
        valid_modeling_frequencies INT,
        alignment_delta_s DOUBLE,
        z_real_0p5Hz DOUBLE,
        z_imag_0p5Hz DOUBLE,
        z_abs_0p5Hz DOUBLE,
        phase_0p5Hz DOUBLE,
        freq_selected_0p5Hz DOUBLE,
        z_real_1Hz DOUBLE,
        z_imag_1Hz DOUBLE,
        z_abs_1Hz DOUBLE,
        phase_1Hz DOUBLE,
        freq_selected_1Hz DOUBLE,
        z_real_10Hz DOUBLE,
        z_imag_10Hz DOUBLE,
        z_abs_10Hz DOUBLE,
        phase_10Hz DOUBLE,
        freq_selected_10Hz DOUBLE,
        z_real_1kHz DOUBLE,
        z_imag_1kHz DOUBLE,
        z_abs_1kHz DOUBLE,
        phase_1kHz DOUBLE,
        freq_selected_1kHz DOUBLE,
        z_real_5kHz DOUBLE,
        z_imag_5kHz DOUBLE,
        z_abs_5kHz DOUBLE,
        phase_5kHz DOUBLE,
        freq_selected_5kHz DOUBLE,
        R0_mOhm_k DOUBLE,
        R1_mOhm_k DOUBLE,
        r0_r1_source STRING,
        r0_r1_leakage_safe BOOLEAN,
        nyquist_re_min DOUBLE,
        nyquist_re_max DOUBLE,
        nyquist_im_min DOUBLE,
        nyquist_im_peak_abs DOUBLE,
        nyquist_semicircle_width_proxy DOUBLE,
        nyquist_high_freq_re_intercept_proxy DOUBLE,
        nyquist_low_freq_tail_slope_proxy DOUBLE,
        quality_flags STRING,
        schema_version STRING,
        feature_policy_version STRING
    """,
    "eis_targets": """
        cell_id STRING,
        parameter_set INT,
        replicate_id INT,
        checkup_k INT,
        checkup_k_next INT,
        soc_percent DOUBLE,
        temperature_context STRING,
        condition_fold INT,
        temperature_holdout_fold INT,
        c_rate_holdout_fold INT,
        profile_holdout_fold INT,
        voltage_window_holdout_fold INT,
        eis_z_real_1kHz_k DOUBLE,
        eis_z_imag_1kHz_k DOUBLE,
        eis_z_abs_1kHz_k DOUBLE,
        eis_phase_1kHz_k DOUBLE,
        eis_z_real_1kHz_k1 DOUBLE,
        eis_z_imag_1kHz_k1 DOUBLE,
        eis_z_abs_1kHz_k1 DOUBLE,
        eis_phase_1kHz_k1 DOUBLE,
        delta_eis_z_real_1kHz DOUBLE,
        delta_eis_z_abs_1kHz DOUBLE,
        nyquist_re_min_k DOUBLE,
        nyquist_re_max_k DOUBLE,
        nyquist_im_peak_abs_k DOUBLE,
        nyquist_semicircle_width_proxy_k DOUBLE,
        nyquist_re_min_k1 DOUBLE,
        nyquist_re_max_k1 DOUBLE,
        nyquist_im_peak_abs_k1 DOUBLE,
        nyquist_semicircle_width_proxy_k1 DOUBLE,
        delta_nyquist_semicircle_width_proxy DOUBLE,
        valid_modeling_fraction_k DOUBLE,
        valid_modeling_fraction_k1 DOUBLE,
        alignment_delta_s_k DOUBLE,
        alignment_delta_s_k1 DOUBLE,
        quality_flags STRING,
        schema_version STRING,
        feature_policy_version STRING
    """,
    "diagnostic_horizon": """
        cell_id STRING,
        parameter_set INT,
        replicate_id INT,
        checkup_k INT,
        target_checkup_k INT,
        horizon_checkups INT,
        diagnostic_family STRING,
        target_name STRING,
        diagnostic_value_k DOUBLE,
        diagnostic_value_kh DOUBLE,
        delta_diagnostic_value_h DOUBLE,
        capacity_Ah_k DOUBLE,
        soh_k DOUBLE,
        calendar_day_k DOUBLE,
        cumulative_efc_k DOUBLE,
        cumulative_q_Ah_k DOUBLE,
        prior_delta_capacity_Ah DOUBLE,
        prior_capacity_slope_per_day DOUBLE,
        nominal_temperature_C DOUBLE,
        voltage_window_family STRING,
        nominal_charge_C_rate DOUBLE,
        nominal_discharge_C_rate DOUBLE,
        profile_label STRING,
        aging_mode STRING,
        condition_fold INT,
        temperature_holdout_fold INT,
        c_rate_holdout_fold INT,
        profile_holdout_fold INT,
        voltage_window_holdout_fold INT,
        event_observed BOOLEAN,
        diagnostic_quality_flags STRING,
        schema_version STRING
    """,
}

CONTRACTS: dict[str, StructType] = {name: schema(columns) for name, columns in COLUMNS.items()}
