"""Shared SQL tables of the oracles: the panel views written independently in SQL."""
from __future__ import annotations

from .base import table

table("ev0", """
SELECT *, CAST((user_id // 3) % 60 AS INTEGER) AS parameter_set,
  CAST((user_id // 180) * 3 + user_id % 3 + 1 AS INTEGER) AS replicate_id,
  printf('P%03d_%d', (user_id // 3) % 60, (user_id // 180) * 3 + user_id % 3 + 1) AS cell_id,
  epoch_us(ts) / 1000000.0::DOUBLE AS t
FROM events""")
table("cells", """
SELECT *, voltage_window_family AS voltage_window, replace(voltage_window_family, 'approx_', '') AS soc_window_approx,
  CASE WHEN aging_mode = 'profile' THEN 'drive' ELSE 'none' END AS profile_label, 1.0::DOUBLE AS nominal_discharge_C_rate
FROM (SELECT DISTINCT cell_id, parameter_set, replicate_id,
  CASE WHEN parameter_set < 40 THEN 'cyclic' WHEN parameter_set % 2 = 0 THEN 'calendar' ELSE 'profile' END AS aging_mode,
  ([0, 10, 25, 35, 40])[parameter_set % 5 + 1]::DOUBLE AS nominal_temperature_C,
  CASE WHEN parameter_set < 20 THEN 'approx_0_100' WHEN parameter_set < 40 THEN 'approx_10_100'
       WHEN parameter_set % 2 = 0 THEN 'calendar_soc_50' ELSE 'approx_10_90' END AS voltage_window_family,
  CASE parameter_set % 4 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 1.5::DOUBLE
       ELSE 5.0::DOUBLE / 3 END AS nominal_charge_C_rate FROM ev0)""")
table("chk", """
SELECT *, capacity_Ah / 3.0 AS capacity_soh FROM (
SELECT cell_id, parameter_set, replicate_id, checkup_k, t AS timestamp, event_id,
  3.0::DOUBLE - 0.05::DOUBLE * checkup_k * (1.0::DOUBLE + (parameter_set % 7) / 6.0::DOUBLE)
    - least(value, 200.0) / 1000.0 AS capacity_Ah
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY cell_id ORDER BY t, event_id) - 1 AS INTEGER) AS checkup_k
      FROM ev0 WHERE event_type = 'purchase'))""")
table("smp", """
SELECT cell_id, t - z AS timestamp_s, 3.2::DOUBLE + (k % 11) * 0.1::DOUBLE AS v_raw_V, i AS i_raw_A,
  nominal_temperature_C + event_id % 7 - 3 AS t_cell_degC, k::DOUBLE AS soc_est, q AS delta_q_Ah, q / 6.0 AS EFC,
  CASE WHEN k % 10 = 0 THEN 3.0 END AS cap_aged_est_Ah, CASE WHEN k % 20 = 0 THEN 20.0 END AS R0_mOhm,
  CASE WHEN k % 25 = 0 THEN 10.0 END AS R1_mOhm, 'f' || (event_id % 4) AS source_file, event_id AS seq
FROM (SELECT *, sum(abs(i)) OVER (PARTITION BY cell_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS q
  FROM (SELECT ev0.*, c.nominal_temperature_C, zz.timestamp AS z, json_extract_string(props, '$.k')::INTEGER AS k,
    CASE event_type WHEN 'view' THEN 0 WHEN 'error' THEN -1 ELSE 1 END * value / 20.0::DOUBLE AS i
    FROM ev0 JOIN chk zz ON zz.cell_id = ev0.cell_id AND zz.checkup_k = 0
    JOIN cells c ON c.cell_id = ev0.cell_id WHERE event_type <> 'purchase'))""")
table("stored", """
SELECT * REPLACE (timestamp_s - CASE WHEN seq % 41 = 0 THEN 90000.0 ELSE 0.0 END AS timestamp_s,
  EFC - CASE WHEN seq % 29 = 0 THEN 3.0 WHEN seq % 31 = 0 THEN 0.0001 ELSE 0.0 END AS EFC) FROM smp""")
table("viol", """
SELECT *, CASE WHEN td > 0 AND ed > 1e-9 THEN 'both' WHEN td > 0 THEN 'timestamp_decrease' ELSE 'efc_decrease' END AS violation_type,
  CASE WHEN greatest(td, ed) <= 1e-9 THEN 'tiny' WHEN greatest(td, ed) <= 1 THEN 'small' WHEN greatest(td, ed) <= 60 THEN 'medium'
       WHEN greatest(td, ed) <= 3600 THEN 'large' ELSE 'severe' END AS magnitude_bucket,
  td AS timestamp_drop_s, ed AS efc_drop
FROM (SELECT *, greatest(0.0, pt - timestamp_s) AS td, greatest(0.0, pe - EFC) AS ed
  FROM (SELECT *, lag(timestamp_s) OVER w AS pt, lag(EFC) OVER w AS pe FROM stored WINDOW w AS (PARTITION BY cell_id ORDER BY seq)))
WHERE pt IS NOT NULL AND (td > 0 OR ed > 1e-9)""")
table("condfold", """
SELECT parameter_set, CAST((row_number() OVER (ORDER BY h, parameter_set) - 1) % 5 AS INTEGER) AS condition_fold
FROM (SELECT DISTINCT parameter_set, ('0x' || substr(md5('42|' || parameter_set), 1, 12))::BIGINT AS h FROM cells)""")
table("reg", """
SELECT c.cell_id, c.parameter_set, c.replicate_id, condition_fold,
  CASE nominal_temperature_C WHEN 0 THEN 1 WHEN 40 THEN 2 ELSE 0 END AS temperature_holdout_fold,
  CASE WHEN voltage_window_family = 'approx_0_100' THEN 1 WHEN voltage_window_family IN ('approx_10_100', 'approx_10_90') THEN 2
       WHEN voltage_window_family LIKE 'calendar_soc_%' THEN 3 ELSE 0 END AS voltage_window_holdout_fold,
  CASE WHEN nominal_charge_C_rate >= 5.0::DOUBLE / 3 OR nominal_discharge_C_rate >= 5.0::DOUBLE / 3 THEN 1 ELSE 0 END AS c_rate_holdout_fold,
  CASE WHEN aging_mode = 'profile' THEN 1 ELSE 0 END AS profile_holdout_fold,
  CASE WHEN replicate_id = 3 THEN 1 ELSE 0 END AS replicate_calibration_fold, 0 AS time_horizon_fold
FROM cells c JOIN condfold USING (parameter_set)""")
table("spine0", """
SELECT *, t1 - t0 AS duration_s, (t1 - t0) / 3600.0::DOUBLE AS duration_h, (t1 - t0) / 86400.0::DOUBLE AS calendar_days,
  capacity_Ah_k1 - capacity_Ah_k AS delta_capacity_Ah, t0 - zero AS window_start_s, t1 - zero AS window_end_s
FROM (SELECT cell_id, parameter_set, replicate_id, checkup_k, timestamp AS t0, capacity_Ah AS capacity_Ah_k, capacity_soh,
    lead(checkup_k) OVER w AS checkup_k_next, lead(timestamp) OVER w AS t1, lead(capacity_Ah) OVER w AS capacity_Ah_k1,
    lead(capacity_soh) OVER w - capacity_soh AS delta_capacity_soh, first_value(timestamp) OVER w AS zero
  FROM chk WINDOW w AS (PARTITION BY cell_id ORDER BY checkup_k, timestamp))
WHERE checkup_k_next > checkup_k""")
table("spine", """
SELECT s.*, s.t0 AS t_result_k_s, s.t1 AS t_result_k1_s, c.aging_mode, c.nominal_temperature_C, c.voltage_window_family,
  c.nominal_charge_C_rate, c.nominal_discharge_C_rate, c.profile_label, r.condition_fold, r.temperature_holdout_fold,
  r.voltage_window_holdout_fold, r.c_rate_holdout_fold, r.profile_holdout_fold, r.replicate_calibration_fold
FROM spine0 s JOIN cells c USING (cell_id) JOIN reg r USING (cell_id)""")
table("logiv", """
SELECT s.*, v.checkup_k, v.checkup_k_next, v.window_start_s, v.window_end_s, v.parameter_set, v.replicate_id
FROM smp s JOIN spine v ON v.cell_id = s.cell_id AND s.timestamp_s > v.window_start_s AND s.timestamp_s <= v.window_end_s""")
table("expo", """
SELECT cell_id, checkup_k, count(*) AS log_age_row_count, max(timestamp_s) - min(timestamp_s) AS log_age_elapsed_s,
  max(EFC) - min(EFC) AS log_age_efc_delta, max(delta_q_Ah) - min(delta_q_Ah) AS log_age_delta_q_Ah,
  avg(v_raw_V) AS log_age_mean_voltage_V, min(v_raw_V) AS log_age_min_voltage_V, max(v_raw_V) AS log_age_max_voltage_V,
  avg(t_cell_degC) AS log_age_mean_temperature_C, min(t_cell_degC) AS log_age_min_temperature_C, max(t_cell_degC) AS log_age_max_temperature_C,
  avg(i_raw_A) AS log_age_mean_current_A, avg(abs(i_raw_A)) AS log_age_mean_abs_current_A, max(abs(i_raw_A)) AS log_age_max_abs_current_A,
  avg(soc_est) AS log_age_mean_soc, min(soc_est) AS log_age_min_soc, max(soc_est) AS log_age_max_soc,
  count(cap_aged_est_Ah) AS m_cap, count(R0_mOhm) AS m_r0, count(R1_mOhm) AS m_r1
FROM logiv GROUP BY ALL""")
table("violiv", """
SELECT v.cell_id, s.checkup_k, count(*) AS n_viol, sum(CASE WHEN violation_type IN ('timestamp_decrease', 'both') THEN 1 ELSE 0 END) AS n_ts,
  sum(CASE WHEN violation_type IN ('efc_decrease', 'both') THEN 1 ELSE 0 END) AS n_efc, max(timestamp_drop_s) AS max_ts, max(efc_drop) AS max_efc
FROM viol v JOIN spine s ON v.cell_id = s.cell_id AND v.timestamp_s > s.window_start_s AND v.timestamp_s <= s.window_end_s GROUP BY ALL""")
table("iv", """
SELECT s.*, coalesce(e.log_age_row_count, 0) AS log_age_row_count, e.* EXCLUDE (cell_id, checkup_k, log_age_row_count, m_cap, m_r0, m_r1),
  coalesce(m_cap, 0) AS m_cap, coalesce(m_r0, 0) AS m_r0, coalesce(m_r1, 0) AS m_r1,
  coalesce(n_viol, 0) AS n_viol, coalesce(n_ts, 0) AS n_ts, coalesce(n_efc, 0) AS n_efc,
  coalesce(max_ts, 0.0) AS max_ts, coalesce(max_efc, 0.0) AS max_efc
FROM spine s LEFT JOIN expo e USING (cell_id, checkup_k) LEFT JOIN violiv x USING (cell_id, checkup_k)""")
table("gaps", """
SELECT *, least(raw_dt_s, 43200.0) AS dt_s, least(raw_dt_s, 43200.0) / 3600.0::DOUBLE AS dt_h FROM (
SELECT *, timestamp_s - coalesce(lag(timestamp_s) OVER (PARTITION BY cell_id, checkup_k ORDER BY timestamp_s, seq), window_start_s) AS raw_dt_s
FROM logiv) WHERE raw_dt_s > 0""")
