"""Raw semicolon files to products, with file versions, foreign cells and bad numbers."""
import math

import pytest

from panelloom.plans import jobs
from panelloom.sources import ingest as ing


def write(folder, name, header, rows):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(";".join(map(str, r)) for r in [header, *rows]) + "\n")


@pytest.fixture
def raw(tmp_path):
    root = tmp_path / "raw"
    cfg = ["age_type", "age_temp", "v_min_V", "v_max_V", "age_soc", "age_chg_rate", "age_dischg_rate", "age_profile"]
    for r in (1, 2):
        write(root / "cfg", f"cell_cfg_P001_{r}_S01_C10.csv", cfg, [["2", "25.0", "2.5", "4.2", "80", "1.0", "1.5", "5"]])
        write(root / "eoc", f"cell_eocv2_P001_{r}_S01_C10.csv", ["timestamp_s", "num_cycles_checkup", "cyc_charged", "cap_aged_est_Ah", "soh_cap", "delta_e_chg_Wh", "delta_e_dischg_Wh"],
              [["1000.0", "0", "1", "2.95", "98.0", "11.2", "0.0"], ["1500.0", "0", "0", "2.94", "97.8", "0.0", "-10.7"], ["2000.0", "1", "0", "2.90", "96.5", "0.0", "-10.5"]])
        write(root / "log", f"cell_log_age_2s_P001_{r}_S01_C01.csv", ["timestamp_s", "v_raw_V", "EFC"], [["100.0", "3.4", "10.0"], ["200.0", "nan", "10.5"]])
    pls = ["timestamp_s", "soc_nom", "is_rt", "t_avg_degC", "cyc_charged", "r_ref_10ms_mOhm", "r_ref_1s_mOhm", "v_raw_V", "i_raw_A"]
    write(root / "pls", "cell_plsv2_P001_1_S01_C10.csv", pls, [["1550.0", "50", "1", "25.0", "0", "20.5", "25.2", "3.35", "-1.0"], ["1960.0", "50", "0", "10.0", "1", "21.5", "26.2", "3.3", "1.0"],
                                                              ["1960.0", "50", "0", "12.0", "1", "22.5", "27.2", "3.3", "1.0"], ["bad", "50", "1", "25.0", "0", "20.5", "25.2", "3.35", "-1.0"]])
    # an older version: other order, no direction column
    write(root / "pls", "cell_plsv1_P001_2_S01_C10.csv", ["soc_nom", "timestamp_s", "r_ref_1s_mOhm", "r_ref_10ms_mOhm", "is_rt", "t_avg_degC"], [["30", "1750.0", "24.0", "19.0", "1", "25.0"]])
    write(root / "pls", "cell_plsv2_P099_1_S01_C10.csv", pls, [["1550.0", "50", "1", "25.0", "0", "20.5", "25.2", "3.35", "-1.0"]])
    eis = ["timestamp_s", "soc_nom", "is_rt", "t_avg_degC", "freq_Hz", "valid", "z_amp_comp_mOhm", "z_ph_comp_deg", "z_re_comp_mOhm", "z_im_comp_mOhm"]
    write(root / "eis", "cell_eisv2_P001_1_S01_C10.csv", eis, [["1550.0", "50", "1", "25.0", "1000.0", "1", "20.0", "-15.0", "19.3", "-5.2"], ["1551.0", "50", "1", "25.0", "100.0", "1", "nan", "nan", "3.0", "-4.0"],
                                                              ["1552.0", "50", "1", "25.0", "10.0", "0", "20.0", "-15.0", "nan", "nan"]])
    write(root / "eis", "broken name.csv", eis, [["1550.0", "50", "1", "25.0", "1000.0", "1", "20.0", "-15.0", "19.3", "-5.2"]])
    return {part: str(root / part) for part in ("cfg", "eoc", "log", "pls", "eis")}


def test_ingest_writes_pulses_and_spectra(spark, raw, tmp_path):
    out = jobs.Store(spark, str(tmp_path / "out"))
    jobs.ingest(spark, raw, out)
    pulses = {(r["cell_id"], r["checkup_k"], r["pulse_direction"], r["temperature_C"]): r for r in out.read("pulse_raw").collect()}
    assert len(pulses) == 4
    first = pulses["P001_1", 0, "discharge", 25.0]
    assert abs(first["pulse_10ms_resistance"] - 0.0205) < 1e-12 and abs(first["pulse_1s_resistance"] - 0.0252) < 1e-12 and first["alignment_delta_s"] == 50.0 and first["alignment_method"] == "nearest_eoc_timestamp"
    assert pulses["P001_1", 1, "charge", 10.0]["alignment_delta_s"] == 40.0 and pulses["P001_1", 1, "charge", 10.0]["temperature_context"] == "OT"
    old = pulses["P001_2", 0, "discharge", 25.0]                       # 250 s from either check-up: the earlier one
    assert (old["soc_percent"], old["pulse_1s_resistance"], old["voltage"]) == (30.0, 0.024, None) and old["alignment_delta_s"] == 250.0
    summary = {(r["cell_id"], r["checkup_k"], r["pulse_direction"]): r for r in out.read("pulse_summary").collect()}
    both = summary["P001_1", 1, "charge"]
    assert len(summary) == 3 and both["temperature_C"] == 11.0 and abs(both["pulse_1s_resistance"] - 0.0262) < 1e-12 and both["source_file"] == "cell_plsv2_P001_1_S01_C10.csv"
    spectra = {r["frequency_Hz"]: r for r in out.read("eis").collect()}
    assert len(spectra) == 3 and spectra[1000.0]["is_valid_modeling_frequency"] and not spectra[100.0]["is_valid_modeling_frequency"] and not spectra[10.0]["is_valid_raw"]
    assert abs(spectra[100.0]["z_abs"] - 0.005) < 1e-12 and abs(spectra[100.0]["phase"] - math.degrees(math.atan2(-4, 3))) < 1e-9 and spectra[10.0]["z_real"] is None
    quality = out.read("eis_quality").collect()
    assert [(r["total_frequencies"], r["valid_raw_frequencies"], r["valid_modeling_frequencies"], r["checkup_k"]) for r in quality] == [(3, 2, 1, 0)]
    gone = {(r["cell_id"], r["source_file"]) for r in spark.read.option("header", True).csv(f"{out.root}/excluded").collect()}
    assert gone == {("P099_1", "cell_plsv2_P099_1_S01_C10.csv"), ("unknown", "broken name.csv")}


def test_header_groups(spark, raw, tmp_path):
    d = ing.read_groups(spark, raw["pls"])
    assert d.count() == 6 and {"cyc_charged", "i_raw_A", "soc_nom", "_block"} <= set(d.columns)
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        ing.read_groups(spark, str(tmp_path / "none"))
