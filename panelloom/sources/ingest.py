"""Raw readers: semicolon CSV members to typed panel tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import scalar as S

# ---- fixed values: null words and column names of the raw files ----
NULL_WORDS = ["nan", "NAN", "NaN", "null", "NULL", ""]
LOG_COLUMNS = ["timestamp_s", "v_raw_V", "ocv_est_V", "i_raw_A", "t_cell_degC", "soc_est", "delta_q_Ah", "EFC",
               "cap_aged_est_Ah", "R0_mOhm", "R1_mOhm"]
AGE_TYPES = {1: "calendar", 2: "cyclic", 3: "profile"}


def number(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return S.finite(F.when(~F.trim(c).isin(NULL_WORDS), F.trim(c)).try_cast("double"))


def cell_of(name: Column) -> Column:
    """``P###_#`` found in a name, else NULL."""
    hit = F.regexp_extract(name, S.COHORT_PATTERN, 0)
    return F.when(hit != "", hit)


def modality_of(name: Column) -> Column:
    low, out = F.lower(name), None
    for modality, words in S.MODALITY_WORDS.items():
        test = None
        for w in words:
            test = low.contains(w) if test is None else test | low.contains(w)
        out = F.when(test, modality) if out is None else out.when(test, modality)
    return out.otherwise("unknown")


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """A directory of ``;`` CSV files as text columns with the file name and its cell.

    The header of the first file names the columns; nothing is inferred from values.  A file whose
    header differs, in names or order, is an error and never read by position.
    """
    df = spark.read.option("sep", ";").option("header", True).option("inferSchema", False).option("enforceSchema", False).csv(path)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return df.select("*", name.alias("source_file"), cell_of(name).alias("cell_id"),
                     F.col("_metadata.file_block_start").alias("_block"))


def _decoded(path: Column) -> Column:
    """File metadata give paths URL-encoded."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def read_groups(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """A directory of ``;`` CSV files whose headers may differ: files are grouped by their header line and each group is read by
    its own names; columns that a group lacks are null.  The number of groups is that of file versions."""
    text = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(path)
    path_of = _decoded(F.col("_metadata.file_path"))
    first = text.where(F.col("_metadata.file_block_start") == 0).select(path_of.alias("file"), "value", F.monotonically_increasing_id().alias("i"))
    heads = first.groupBy("file").agg(F.min_by("value", "i").alias("header")).groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files"))
    out = None
    for r in heads.orderBy("header").collect():
        d = spark.read.option("sep", ";").option("header", True).option("inferSchema", False).option("enforceSchema", False).csv(r["files"])
        name = _decoded(F.col("_metadata.file_name"))
        d = d.select("*", name.alias("source_file"), cell_of(name).alias("cell_id"), F.col("_metadata.file_block_start").alias("_block"))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(f"no {glob} under {path}")
    return out


def in_cohort(df: DataFrame, cohort: DataFrame | None) -> DataFrame:
    """Semi-join with the cohort; Catalyst broadcasts it only when it is measured small."""
    return df if cohort is None else df.join(cohort.select("cell_id").distinct(), "cell_id", "left_semi")


def excluded(raw: DataFrame, cohort: DataFrame, archive: str, reason: str = "not in cohort") -> DataFrame:
    """Files of cells outside the cohort, with the reason."""
    files = raw.select("cell_id", "source_file").distinct()
    out = files.join(cohort.select("cell_id").distinct(), "cell_id", "left_anti")
    why = F.when(F.col("cell_id").isNull(), "Malformed cell ID pattern").otherwise(reason)
    return out.select(F.coalesce("cell_id", F.lit("unknown")).alias("cell_id"), F.lit(archive).alias("source_archive"), "source_file",
                      why.alias("reason"))


def record_exclusions(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def log_table(raw: DataFrame, cohort: DataFrame | None = None, archive: str = "") -> DataFrame:
    """Typed log rows; ``seq`` keeps the stored order of each file."""
    d = in_cohort(raw.filter("cell_id IS NOT NULL"), cohort)
    seq = F.monotonically_increasing_id()   # taken at first read and then written with the table
    present = [c for c in LOG_COLUMNS if c in raw.columns]
    absent = [c for c in LOG_COLUMNS if c not in raw.columns]
    return d.select("cell_id", *[number(c).alias(c) for c in present], *[F.lit(None).cast("double").alias(c) for c in absent],
                    "source_file", F.lit(archive).alias("source_archive"), F.lit("OK").alias("quality_flags"), seq.alias("seq"))


def condition_table(raw: DataFrame) -> DataFrame:
    """Aging mode, voltage window text and family, rates and temperature per cell."""
    mode = F.when(number("age_type") == 1, AGE_TYPES[1]).when(number("age_type") == 2, AGE_TYPES[2]).otherwise(AGE_TYPES[3])
    lo, hi, soc = number("v_min_V"), number("v_max_V"), F.col("age_soc")
    cell = F.col("cell_id")
    return raw.filter("cell_id IS NOT NULL").select(
        "cell_id", F.substring(cell, 2, 3).cast("int").alias("parameter_set"), F.substring(cell, 6, 1).cast("int").alias("replicate_id"),
        mode.alias("aging_mode"), number("age_temp").alias("nominal_temperature_C"),
        F.when(mode == "calendar", F.concat(F.lit("SOC "), soc)).otherwise(F.format_string("%.2f-%.2f V", lo, hi)).alias("voltage_window"),
        S.window_family(lo, hi, mode, soc).alias("voltage_window_family"), number("age_chg_rate").alias("nominal_charge_C_rate"),
        number("age_dischg_rate").alias("nominal_discharge_C_rate"),
        F.when(mode == "profile", F.col("age_profile")).otherwise("none").alias("profile_label"), "source_file")


def checkup_table(raw: DataFrame, order: str = "pos") -> DataFrame:
    """Last discharge row of a check-up, else the last charge row; energies from each side."""
    cap, k = number("cap_aged_est_Ah"), F.floor(number("num_cycles_checkup")).cast("int")
    d = raw.withColumns({"_cap": cap, "checkup_k": k, "_side": F.floor(number("cyc_charged")).cast("int")}).filter("_cap IS NOT NULL AND checkup_k IS NOT NULL")
    row = F.struct(F.col("_cap").alias("cap"), number("soh_cap").alias("soh"), number("timestamp_s").alias("t"),
                   number("delta_e_chg_Wh").alias("chg"), F.abs(number("delta_e_dischg_Wh")).alias("dis"))
    side = lambda s: F.max_by(row, F.when(F.col("_side") == s, F.col(order)))
    g = d.groupBy("cell_id", "checkup_k").agg(side(0).alias("d"), side(1).alias("c"))
    best = F.coalesce("d", "c")
    return g.withColumn("b", best).filter("b IS NOT NULL").select(
        "cell_id", "checkup_k", F.col("b.t").alias("timestamp"), F.col("b.cap").alias("capacity_Ah"),
        F.coalesce("b.soh", F.lit(100.0)).alias("capacity_soh"), F.coalesce("c.chg", F.lit(0.0)).alias("charge_energy_Wh"),
        F.coalesce("d.dis", F.lit(0.0)).alias("discharge_energy_Wh"))


def with_modeling_mask(rows: DataFrame) -> DataFrame:
    """Adds ``is_valid_modeling_frequency`` to typed spectra rows."""
    f, re, im = F.col("frequency_Hz"), F.col("z_real"), F.col("z_imag")
    return rows.withColumn("is_valid_modeling_frequency", S.modeling_mask(f, re, im, F.col("is_valid_raw").cast("int")))


def _of(raw: DataFrame, name: str) -> Column:
    """A numeric column of the raw files, null where they have none of that name."""
    return number(name) if name in raw.columns else F.lit(None).cast("double")


def _points(raw: DataFrame) -> DataFrame:
    """What pulses and spectra share: state of charge, temperature, time, and ``point_id`` in stored order (write it before use)."""
    return raw.where("cell_id IS NOT NULL").withColumns({
        "timestamp": _of(raw, "timestamp_s"), "soc_percent": _of(raw, "soc_nom"), "temperature_C": _of(raw, "t_avg_degC"),
        "temperature_context": F.when(F.floor(_of(raw, "is_rt")) == 1, "RT").otherwise("OT"), "quality_flags": F.lit("OK"),
        "point_id": F.monotonically_increasing_id()})


def pulse_rows(raw: DataFrame, archive: str = "") -> DataFrame:
    """Pulses in ohm with direction and context; rows without time or resistances are left out."""
    d = _points(raw).withColumns({
        "pulse_10ms_resistance": _of(raw, "r_ref_10ms_mOhm") / 1000.0, "pulse_1s_resistance": _of(raw, "r_ref_1s_mOhm") / 1000.0,
        "pulse_direction": F.when(F.floor(F.coalesce(_of(raw, "cyc_charged"), F.lit(0.0))) == 1, "charge").otherwise("discharge"),
        "voltage": _of(raw, "v_raw_V"), "current": _of(raw, "i_raw_A"), "source_archive": F.lit(archive)})
    keep = ["cell_id", "timestamp", "soc_percent", "temperature_context", "temperature_C", "pulse_direction", "pulse_10ms_resistance", "pulse_1s_resistance", "voltage", "current",
            "source_file", "source_archive", "quality_flags", "point_id"]
    return d.where("timestamp IS NOT NULL AND pulse_10ms_resistance IS NOT NULL AND pulse_1s_resistance IS NOT NULL").select(*keep)


def eis_rows(raw: DataFrame, archive: str = "") -> DataFrame:
    """Spectra in ohm with magnitude, phase and validity; an amplitude that is missing follows from the components."""
    re, im, amp, ph = (_of(raw, c) for c in ("z_re_comp_mOhm", "z_im_comp_mOhm", "z_amp_comp_mOhm", "z_ph_comp_deg"))
    d = _points(raw).withColumns({
        "frequency_Hz": _of(raw, "freq_Hz"), "z_real": re / 1000.0, "z_imag": im / 1000.0,
        "z_abs": F.coalesce(amp / 1000.0, F.sqrt(re * re + im * im) / 1000.0), "phase": F.coalesce(ph, F.degrees(F.atan2(im, re))),
        "is_valid_raw": F.coalesce(F.floor(_of(raw, "valid")) == 1, F.lit(False)), "source_archive": F.lit(archive)})
    d = with_modeling_mask(d).withColumn("is_valid_modeling_frequency", F.coalesce("is_valid_modeling_frequency", F.lit(False)))
    keep = ["cell_id", "timestamp", "soc_percent", "temperature_context", "temperature_C", "frequency_Hz", "z_real", "z_imag", "z_abs", "phase", "is_valid_raw",
            "is_valid_modeling_frequency", "source_file", "source_archive", "quality_flags", "point_id"]
    return d.where("timestamp IS NOT NULL AND frequency_Hz IS NOT NULL").select(*keep)
