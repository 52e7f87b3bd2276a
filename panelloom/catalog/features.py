"""Declared feature sets of the model arms: {name: (numbers, categories)}.  Fixed values."""
from __future__ import annotations

_MODE, _PLACE = ["aging_mode", "voltage_window_family"], ["voltage_window_family", "profile_label", "aging_mode"]
_NOMINAL = ["nominal_temperature_C", "nominal_charge_C_rate", "nominal_discharge_C_rate"]
_TIME = ["duration_h", "calendar_days", "checkup_k"]
_USE = ["log_age_efc_delta", "log_age_delta_q_Ah"]
_LOG = ["log_age_mean_voltage_V", "log_age_min_voltage_V", "log_age_max_voltage_V", "log_age_mean_temperature_C", "log_age_min_temperature_C",
        "log_age_max_temperature_C", "log_age_mean_current_A", "log_age_mean_abs_current_A", "log_age_max_abs_current_A", "log_age_mean_soc",
        "log_age_min_soc", "log_age_max_soc"]
CAPACITY = {
    "F0_time_only": (_TIME, []),
    "F1_state_time": (["capacity_Ah_k", *_TIME], []),
    "F2_state_exposure": (["capacity_Ah_k", *_TIME, *_USE], []),
    "F3_state_nominal": (["capacity_Ah_k", *_TIME, *_USE, *_NOMINAL], _MODE),
    "F4_state_log_age_scalar": (["capacity_Ah_k", *_TIME, *_USE, *_NOMINAL, *_LOG], _MODE),
}
_FADE = ["capacity_Ah_k", "calendar_days", "log_age_efc_delta"]
_HEAT = ["log_age_mean_temperature_C", "log_age_max_temperature_C", "log_age_mean_voltage_V", "log_age_max_voltage_V", "high_voltage_time_h", "cold_time_h", "hot_time_h"]
_RATE = ["abs_current_ge_1p5C_time_h", "cold_high_abs_current_time_h"]
_COUPLED = ["high_voltage_hot_time_h", "high_soc_hot_time_h"]
SEMI_EMPIRICAL = {
    "SE0_time_efc": (_FADE, []),
    "SE1_calendar_cycling": ([*_FADE, "log_age_delta_q_Ah"], []),
    "SE2_temperature_voltage": ([*_FADE, "log_age_delta_q_Ah", "nominal_temperature_C", *_HEAT], ["voltage_window_family"]),
    "SE3_c_rate_interactions": ([*_FADE, "log_age_delta_q_Ah", *_NOMINAL, *_HEAT, *_RATE], ["voltage_window_family", "aging_mode"]),
    "SE4_coupled_stress": ([*_FADE, "log_age_delta_q_Ah", *_NOMINAL, *_HEAT, *_RATE, *_COUPLED], ["voltage_window_family", "aging_mode"]),
}
STRESS = [*_HEAT[4:], *_RATE, *_COUPLED]
_PRIOR = ["capacity_Ah_k", "soh_k", "horizon_checkups", "checkup_k", "calendar_day_k", "cumulative_efc_k", "cumulative_q_Ah_k", "prior_delta_capacity_Ah",
          "prior_capacity_slope_per_day"]
_AHEAD = ["horizon_interval_count", "horizon_duration_h", "horizon_calendar_days", "horizon_log_age_efc_delta", "horizon_log_age_delta_q_Ah",
          "horizon_log_age_row_count"]
HORIZON = {
    "K0_prior_capacity": (["capacity_Ah_k", "horizon_checkups", "checkup_k"], []),
    "K1_prior_state_time": (_PRIOR, []),
    "K2_nominal_condition": ([*_PRIOR, *_NOMINAL], _PLACE),
    "K3_oracle_exposure_diagnostic": ([*_PRIOR, *_NOMINAL, *_AHEAD], _PLACE),
}
_CLOCK = ["horizon_checkups", "checkup_k", "calendar_day_k", "cumulative_efc_k", "cumulative_q_Ah_k"]
_STATE = ["capacity_Ah_k", "soh_k", "prior_delta_capacity_Ah", "prior_capacity_slope_per_day"]
DIAGNOSTIC = {
    "DH0_time_nominal": ([*_CLOCK, *_NOMINAL], _PLACE),
    "DH1_capacity_state": ([*_CLOCK, *_STATE, *_NOMINAL], _PLACE),
    "DH2_prior_same_diagnostic_state": ([*_CLOCK, "diagnostic_value_k", *_NOMINAL], _PLACE),
    "DH3_capacity_plus_prior_same_diagnostic": ([*_CLOCK, *_STATE, "diagnostic_value_k", *_NOMINAL], _PLACE),
}
DIAGNOSTIC_TARGETS = ["nyquist_semicircle_width_proxy", "pulse_10ms_resistance", "pulse_1s_resistance", "z_abs_1kHz"]
WARNING = {
    "W0_capacity_state": (["capacity_Ah_k", "soh_k"], []),
    "W1_state_time": (["capacity_Ah_k", "soh_k", "checkup_k", "calendar_day_k", "cumulative_efc_k"], []),
    "W2_nominal": (["capacity_Ah_k", "soh_k", "checkup_k", "calendar_day_k", "cumulative_efc_k", *_NOMINAL], _PLACE),
}
PULSE_STATE = ["pulse_1s_resistance_k", "pulse_10ms_resistance_k"]
SPECTRUM_STATE = ["eis_z_real_1kHz_k", "eis_z_imag_1kHz_k", "eis_z_abs_1kHz_k", "eis_phase_1kHz_k"]


def impedance(prefix: str, state: list[str], other: list[str]) -> dict:
    """Sets of the pulse (P) or spectrum (E) arms: own prior state, then capacity, nominal, log and the other family's prior state."""
    base = [*state, *_TIME]
    return {f"{prefix}1_state_time": (base, []), f"{prefix}2_state_capacity": ([*base, "capacity_Ah_k"], []),
            f"{prefix}3_state_nominal": ([*base, "capacity_Ah_k", *_USE, *_NOMINAL], _MODE),
            f"{prefix}4_state_log_age_scalar": ([*base, "capacity_Ah_k", *_USE, *_NOMINAL, *_LOG], _MODE),
            f"{prefix}_prior_other_family": ([*base, "capacity_Ah_k", *_USE, *_NOMINAL, *other], _MODE)}


PULSE, SPECTRUM = impedance("P", PULSE_STATE, SPECTRUM_STATE), impedance("E", SPECTRUM_STATE, PULSE_STATE)
PULSE_TARGETS = ["delta_pulse_1s_resistance", "pulse_1s_resistance_k1", "delta_pulse_10ms_resistance", "pulse_10ms_resistance_k1"]
SPECTRUM_TARGETS = ["delta_eis_z_real_1kHz", "delta_eis_z_abs_1kHz", "delta_nyquist_semicircle_width_proxy"]


def fields(groups: dict) -> tuple[list[str], list[str]]:
    """All numbers and categories of some sets, each once."""
    return (list(dict.fromkeys(n for numeric, _ in groups.values() for n in numeric)),
            list(dict.fromkeys(c for _, categorical in groups.values() for c in categorical)))
