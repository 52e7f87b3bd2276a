"""Panel views over the driver tables.

``events`` becomes an experiment panel: a user is a cell, users of one design point are
replicates, purchases are check-ups and all other events are log samples.
``lineitem``/``orders`` give impedance spectra, ``pages`` gives a file inventory.
"""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.lineage import cut
from ..functions.ordered import carry
from ..operators import contrasts as co, diagnostics as dg, dwell, events as ev, intervals as iv, knee as kn, metrics as me, rules as ru, splits as sp, support as su, trajectories as tr, uncertainty as un

from . import ingest as ing

DESIGN_POINTS = 60
SECONDS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) / 1000000.0D"
DWELL = dwell.DwellLimits(max_gap_s=43200.0, gap_counts_s=(21600.0, 43200.0))
EVENT = ev.EventLimits(max_gap_s=43200.0)


_OPEN: dict = {}


def views(spark: SparkSession, sf_dir: str) -> "Views":
    """One ``Views`` per application, folder and state of the folder, so that products are written once."""
    key = (spark.sparkContext.applicationId, sf_dir, changed_at(spark, sf_dir))
    if key not in _OPEN:
        _OPEN[key] = Views(spark, sf_dir)
    return _OPEN[key]


def changed_at(spark: SparkSession, folder: str) -> tuple:
    """Names, sizes and times of the tables in a folder of any store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found))


def product(build):
    """A table several jobs start from: built on first use, written as Parquet, never collected."""
    name = build.__name__.removeprefix("build_")
    prop = cached_property(lambda self: cut(build(self)))
    prop.__set_name__(Views, name)
    setattr(Views, name, prop)
    return build


class Views:
    """Panel products; ``build_x()`` is the job, ``x`` its stored result."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _keyed(self) -> DataFrame:
        u = F.col("user_id")
        p = (F.floor(u / 3) % DESIGN_POINTS).cast("int")
        r = (F.floor(u / (3 * DESIGN_POINTS)) * 3 + u % 3 + 1).cast("int")
        return self.read("events").withColumns({
            "parameter_set": p, "replicate_id": r, "t": F.expr(SECONDS),
            "cell_id": F.format_string("P%03d_%d", p, r)})

    def build_cells(self) -> DataFrame:
        p = F.col("parameter_set")
        block = F.floor(p / 20)
        family = (F.when(block == 0, "approx_0_100").when(block == 1, "approx_10_100")
                  .when(p % 2 == 0, "calendar_soc_50").otherwise("approx_10_90"))
        mode = F.when(block < 2, "cyclic").when(p % 2 == 0, "calendar").otherwise("profile")
        pick = lambda vals, i: F.element_at(F.array(*[F.lit(float(v)) for v in vals]), (i + 1).cast("int"))
        return (self._keyed().select("cell_id", "parameter_set", "replicate_id").distinct().withColumns({
            "aging_mode": mode, "nominal_temperature_C": pick([0, 10, 25, 35, 40], p % 5),
            "voltage_window": family, "voltage_window_family": family,
            "soc_window_approx": F.replace(family, F.lit("approx_"), F.lit("")),
            "nominal_charge_C_rate": pick([0.5, 1.0, 1.5, 5.0 / 3.0], p % 4),
            "nominal_discharge_C_rate": F.lit(1.0),
            "profile_label": F.when(mode == "profile", "drive").otherwise("none")}))

    def build_checkups(self) -> DataFrame:
        d = self._keyed().filter("event_type = 'purchase'").withColumn("_c", F.floor(F.col("t") / 86400))
        d = carry(d, ["cell_id"], "_c", ["t", "event_id"], sums_before={"k": F.lit(1)})
        cap = 3.0 - 0.05 * F.col("k") * (1.0 + (F.col("parameter_set") % 7) / 6.0) - F.least(
            F.col("value"), F.lit(200.0)) / 1000.0
        return d.select("cell_id", "parameter_set", "replicate_id", F.col("k").cast("int").alias("checkup_k"),
                        F.col("t").alias("timestamp"), cap.alias("capacity_Ah"), (cap / 3.0).alias("capacity_soh"),
                        "event_id")

    def build_log(self) -> DataFrame:
        """Samples on the clock of the cell's first check-up."""
        zero = self.checkups.filter("checkup_k = 0").select("cell_id", F.col("timestamp").alias("_z"))
        sign = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "error", -1).otherwise(1)
        amps = sign * F.col("value") / 20.0
        # texts are read before the first exchange, numbers are shuffled
        d = self._keyed().filter("event_type <> 'purchase'").select(
            "cell_id", "t", "event_id", amps.alias("i_raw_A"), F.get_json_object("props", "$.k").cast("int").alias("_k"))
        d = d.join(zero, "cell_id").join(self.cells.select("cell_id", "nominal_temperature_C"), "cell_id")
        d = d.withColumns({"timestamp_s": F.col("t") - F.col("_z"), "_c": F.floor(F.col("t") / 86400)})
        d = carry(d, ["cell_id"], "_c", ["t", "event_id"], sums={"delta_q_Ah": F.abs("i_raw_A")})
        third = lambda n, v: F.when(F.col("_k") % n == 0, F.lit(v))
        return d.select(
            "cell_id", "timestamp_s", (3.2 + (F.col("_k") % 11) * 0.1).alias("v_raw_V"), "i_raw_A",
            (F.col("nominal_temperature_C") + (F.col("event_id") % 7) - 3).alias("t_cell_degC"),
            F.col("_k").cast("double").alias("soc_est"), "delta_q_Ah", (F.col("delta_q_Ah") / 6.0).alias("EFC"),
            third(10, 3.0).alias("cap_aged_est_Ah"), third(20, 20.0).alias("R0_mOhm"),
            third(25, 10.0).alias("R1_mOhm"), F.concat(F.lit("f"), F.col("event_id") % 4).alias("source_file"),
            F.col("event_id").alias("seq"))

    @cached_property
    def stored_log(self) -> DataFrame:
        """The log as recorded, with clock and counter glitches on some rows."""
        return self.log.withColumns({
            "timestamp_s": F.col("timestamp_s") - F.when(F.col("seq") % 41 == 0, 90000.0).otherwise(0.0),
            "EFC": F.col("EFC") - F.when(F.col("seq") % 29 == 0, 3.0).when(F.col("seq") % 31 == 0, 0.0001)
            .otherwise(0.0)})

    def build_violations(self) -> DataFrame:
        return iv.monotonicity_violations(self.stored_log)

    def build_splits(self) -> DataFrame:
        return sp.split_registry(self.cells)

    def build_spine(self) -> DataFrame:
        return iv.interval_spine(self.checkups, self.cells, self.splits)

    @cached_property
    def log_in(self) -> DataFrame:
        return iv.range_join(self.log, self.spine, cols=["parameter_set", "replicate_id"])

    def build_intervals(self) -> DataFrame:
        return iv.interval_table(self.spine, self.log, self.violations)

    def build_gaps(self) -> DataFrame:
        return dwell.capped_gaps(self.log_in, DWELL)

    def build_stress(self) -> DataFrame:
        return dwell.stress_table(self.intervals, self.log_in, DWELL, cut)

    def build_run_events(self) -> DataFrame:
        """Events with their interval's ``event_count``, so that no reader joins it anew."""
        log = iv.range_join(self.log, self.spine, cols=["parameter_set", "replicate_id"], width=EVENT.chunk_s, bucket="_chunk")
        return ev.run_events(log, EVENT, chunk="_chunk", counted=True)

    def build_sequences(self) -> DataFrame:
        return ev.sequence_features(self.run_events, self.spine, cut=cut)

    def build_points(self) -> DataFrame:
        return tr.capacity_points(self.intervals)

    def build_horizon(self) -> DataFrame:
        return tr.horizon_table(self.points)

    def build_candidates(self) -> DataFrame:
        return kn.knee_candidates(self.points)

    def build_labels(self) -> DataFrame:
        return kn.threshold_labels(self.intervals, self.points)

    def build_warning(self) -> DataFrame:
        return kn.warning_table(self.labels, self.intervals, self.points)

    def build_pulses(self) -> DataFrame:
        """Sign-up events as raw pulses, aligned to their nearest check-up."""
        d = self._keyed().filter("event_type = 'signup'")
        k = F.get_json_object("props", "$.k").cast("int")
        raw = d.select("cell_id", F.col("event_id").alias("point_id"), F.col("t").alias("timestamp"), k.alias("_k"),
                       F.when(k % 10 < 7, 50.0).otherwise(90.0).alias("soc_percent"),
                       F.when(F.col("event_id") % 5 < 4, "RT").otherwise("OT").alias("temperature_context"),
                       F.when(F.floor(F.col("event_id") / 2) % 2 == 0, "charge").otherwise("discharge").alias("pulse_direction"),
                       (20.0 + F.col("event_id") % 5).alias("temperature_C"),
                       ((10.0 + F.col("value") / 10.0) / 1000.0).alias("pulse_10ms_resistance"),
                       ((20.0 + F.col("value") / 5.0) / 1000.0).alias("pulse_1s_resistance"))
        return dg.nearest_checkup(raw, self.checkups)

    def build_eis(self) -> DataFrame:
        """Order lines as impedance rows: an order is a sweep, a line a frequency."""
        o = self.read("orders").select("o_orderkey", "o_custkey")
        ln = self.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_quantity")
        d = ln.join(o, ln.l_orderkey == o.o_orderkey)
        key, u = F.col("l_orderkey"), F.floor(F.col("o_custkey") / 10)
        n = F.col("l_linenumber")
        freq = F.element_at(F.array(*[F.lit(f) for f in (0.5, 1.0, 10.0, 100.0, 208.3, 1000.0, 5000.0, 14700.0)]), ((n - 1 + key) % 8 + 1).cast("int"))
        re = 0.01 + F.col("l_discount") / 10.0 + n * 0.0001
        im = -(0.005 + F.col("l_tax") / 10.0)
        return ing.with_modeling_mask(d.select(
            F.format_string("P%03d_%d", (F.floor(u / 3) % DESIGN_POINTS).cast("int"),
                            (F.floor(u / (3 * DESIGN_POINTS)) * 3 + u % 3 + 1).cast("int")).alias("cell_id"),
            (key % 12).cast("int").alias("checkup_k"), F.when(key % 3 < 2, 50.0).otherwise(70.0).alias("soc_percent"),
            F.when(key % 5 < 4, "RT").otherwise("OT").alias("temperature_context"), (20.0 + key % 7).alias("temperature_C"),
            freq.alias("frequency_Hz"), re.alias("z_real"), im.alias("z_imag"), F.sqrt(re * re + im * im).alias("z_abs"),
            F.degrees(F.atan2(im, re)).alias("phase"), (F.col("l_quantity") > 5).alias("is_valid_raw"),
            ((key % 48) * 1800.0).alias("alignment_delta_s"), sp.hash_int(*[c.cast("string") for c in (key, n, F.col("l_partkey"), F.col("l_suppkey"), F.round(F.col("l_extendedprice") * 100).cast("long"))]).alias("row_id")))

    def build_pulse_summary(self) -> DataFrame:
        return dg.pulse_summary(self.pulses)

    def build_eis_quality(self) -> DataFrame:
        return dg.spectrum_quality(self.eis)

    def build_eis_features(self) -> DataFrame:
        return dg.eis_features(self.eis, self.eis_quality, self.intervals)

    def build_pulse_targets(self) -> DataFrame:
        return dg.pulse_targets(self.intervals, self.pulse_summary, keep=["condition_fold", "c_rate_holdout_fold", "profile_holdout_fold"])

    def build_eis_targets(self) -> DataFrame:
        return dg.eis_targets(self.intervals, self.eis_features, keep=["condition_fold", "c_rate_holdout_fold", "profile_holdout_fold"])

    def build_diagnostic(self) -> DataFrame:
        pulse = dg.canonical_state(self.pulse_summary).withColumn("quality_flags", F.lit("OK"))
        return tr.diagnostic_horizon(self.points, {
            "pulse": (pulse, ["pulse_1s_resistance", "pulse_10ms_resistance"]),
            "eis": (self.eis_features, ["z_abs_1kHz", "nyquist_semicircle_width_proxy"])})

    def build_preds(self) -> DataFrame:
        return ru.capacity_predictions(self.intervals)

    def build_hpreds(self) -> DataFrame:
        return ru.horizon_predictions(self.horizon)

    def build_warn_long(self) -> DataFrame:
        return ru.warning_long(self.warning, kn.TARGETS)

    def build_wpreds(self) -> DataFrame:
        from ..operators.splits import hash_int
        return ru.warning_predictions(self.warn_long).withColumn("row_id", hash_int(F.col("cell_id"), F.col("checkup_k").cast("string")))

    def build_cerr(self) -> DataFrame:
        """Errors per arm and condition: all that leaderboards need of the predictions."""
        return me.condition_errors(self.build_preds())

    def build_metrics(self) -> DataFrame:
        return me.metrics_of(self.cerr)

    def build_board(self) -> DataFrame:
        return me.leaderboard(self.metrics)

    def build_hmetrics(self) -> DataFrame:
        return me.regression_metrics(self.build_hpreds(), [*ru.ARM, "horizon_checkups"], cut)

    def build_registry(self) -> DataFrame:
        return co.contrast_registry(self.spine)

    def build_stability(self) -> DataFrame:
        return co.observed_stability(self.registry, self.points)

    def build_pairwise(self) -> DataFrame:
        return co.pairwise_ordering(self.registry, self.build_hpreds())   # folded at once: predictions are not written

    def build_support(self) -> DataFrame:
        return su.condition_support(self.spine)

    def build_spread(self) -> DataFrame:
        return un.replicate_spread(self.spine)

    def build_coupling(self) -> DataFrame:
        """Capacity and pulse changes of an interval, with an integer row id."""
        p = self.pulse_targets.filter("delta_pulse_1s_resistance IS NOT NULL").select(
            "cell_id", "checkup_k", "delta_pulse_1s_resistance", "pulse_1s_resistance_k")
        d = self.intervals.join(p, ["cell_id", "checkup_k"])
        return d.withColumn("row_id", sp.hash_int(F.col("cell_id"), F.col("checkup_k").cast("string")))

    @cached_property
    def files(self) -> DataFrame:
        """Pages as a file inventory."""
        return self.read("pages").select(
            F.col("url").alias("path"), F.length("html").cast("long").alias("size_bytes"), F.md5("html").alias("hash"), "page_id",
            F.concat(F.element_at(F.array(*[F.lit(x) for x in ("cfg", "eoc", "eis", "PLS", "log_age", "logger", "misc")]), (F.col("page_id") % 7 + 1).cast("int")),
                     F.format_string("_P%03d_%d.csv", (F.col("page_id") % 100).cast("int"), (F.col("page_id") % 3 + 1).cast("int"))).alias("name"))


for _n in [n for n in dir(Views) if n.startswith("build_")]:
    product(getattr(Views, _n))
