"""Jobs: read raw tables, build products in dependency order, write them, read them back."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..contracts import CONTRACTS
from ..functions.lineage import cut
from ..operators import contrasts as co, diagnostics as dg, dwell, events as ev, intervals as iv, knee as kn, splits as sp, trajectories as tr
from ..operators.audit import conform, matches
from ..sources import ingest as ing

VERSION = "v1"


@dataclass(frozen=True)
class Store:
    """A folder of Parquet products."""
    spark: SparkSession
    root: str

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(CONTRACTS[name]).parquet(f"{self.root}/{name}") if name in CONTRACTS else self.spark.read.parquet(f"{self.root}/{name}")

    def write(self, df: DataFrame, name: str, sort=("cell_id",), partitions: int | None = None, contract: bool = True) -> None:
        """Range-partitioned and sorted by the keys, so that row groups hold few cells and
        Parquet statistics can skip them; ``partitions`` defaults to the session's setting."""
        out = conform(df, name, schema_version=VERSION) if contract and name in CONTRACTS else df
        if contract and name in CONTRACTS and not matches(out, CONTRACTS[name]):
            raise TypeError(f"{name} does not match its contract")
        keys = [F.col(c) for c in sort]
        out = out.repartitionByRange(partitions, *keys) if partitions else out.repartitionByRange(*keys)
        out.sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{self.root}/{name}")

    def write_rows(self, df: DataFrame, name: str, fmt: str = "json") -> None:
        """Metric rows as JSON or CSV files."""
        w = df.write.mode("overwrite")
        (w.json if fmt == "json" else w.option("header", True).csv)(f"{self.root}/reports/{name}")


def ingest(spark: SparkSession, raw: dict[str, str], out: Store) -> None:
    """Conditions, check-ups, log, pulses and spectra from directories of raw CSV files; pulses (``pls``) and spectra (``eis``) may be absent."""
    cond = ing.condition_table(ing.read_raw(spark, raw["cfg"]))
    out.write(cond.withColumn("soc_window_approx", F.col("voltage_window_family")), "condition")
    cohort = out.read("condition").select("cell_id", "parameter_set", "replicate_id")
    eoc = ing.read_raw(spark, raw["eoc"]).withColumn("pos", F.monotonically_increasing_id())
    out.write(ing.checkup_table(eoc).join(cohort, "cell_id"), "checkups", ("cell_id", "checkup_k"))
    log = ing.read_raw(spark, raw["log"])
    ing.record_exclusions(ing.excluded(log, cohort, "log"), f"{out.root}/excluded")
    # the stored order is kept beside the contract columns for the monotonicity audit
    out.write(ing.log_table(log, cohort, "log"), "log_ordered", ("cell_id", "timestamp_s"), contract=False)
    checkups = out.read("checkups")
    for part, rows, write in (("pls", ing.pulse_rows, write_pulses), ("eis", ing.eis_rows, write_spectra)):
        if part in raw:
            files = ing.read_groups(spark, raw[part])
            ing.record_exclusions(ing.excluded(files, cohort, part), f"{out.root}/excluded")
            # point ids are taken once and kept
            points = cut(ing.in_cohort(rows(files, part), cohort))
            aligned = cut(dg.nearest_checkup(points, checkups).withColumn("alignment_method", F.lit("nearest_eoc_timestamp")))
            write(out, aligned)


def write_pulses(out: Store, aligned: DataFrame) -> None:
    """Aligned pulses and their summary per state."""
    out.write(aligned, "pulse_raw", ("cell_id", "checkup_k"))
    by = dg.PULSE_KEY
    first = aligned.withColumn("soc_percent", F.round("soc_percent", 1)).groupBy(*by).agg(F.min_by("source_file", "point_id").alias("source_file"))
    d = dg.pulse_summary(aligned).join(first, by)
    out.write(d.withColumns({"alignment_method": F.lit("nearest_eoc_timestamp"), "quality_flags": F.lit("OK")}), "pulse_summary", ("cell_id", "checkup_k"))


def write_spectra(out: Store, aligned: DataFrame) -> None:
    """Aligned spectra rows and the quality of each spectrum."""
    out.write(aligned, "eis", ("cell_id", "checkup_k"))
    first = aligned.groupBy(*dg.SPECTRUM).agg(F.min_by(F.struct("source_file", "source_archive"), "point_id").alias("_s"))
    d = dg.spectrum_quality(aligned.withColumn("row_id", F.col("point_id"))).join(first, dg.SPECTRUM).select("*", "_s.*").drop("_s")
    out.write(d.withColumns({"alignment_method": F.lit("nearest_eoc_timestamp"), "quality_flags": F.lit("OK")}), "eis_quality", ("cell_id", "checkup_k"))


def build_products(store: Store, lim: dwell.DwellLimits = dwell.DwellLimits(), events: ev.EventLimits = ev.EventLimits()) -> None:
    """Interval, stress, event, sequence, label and contrast tables from ingested ones.

    Every product is written before the next one reads it: lineage is short, a lost executor
    costs at most one stage, and no table is computed twice.
    """
    cond, chk, log = store.read("condition"), store.read("checkups"), store.read("log_ordered")
    store.write(sp.split_registry(cond), "splits")
    violations = cut(iv.monotonicity_violations(log))
    spine = cut(iv.interval_spine(chk, cond, store.read("splits")))
    store.write(iv.interval_table(spine, log, violations), "intervals", ("cell_id", "checkup_k"))
    table = store.read("intervals")
    store.write(iv.subset_registry(table), "subset_registry", ("cell_id", "checkup_k"))
    within = iv.range_join(log, spine, cols=["parameter_set", "replicate_id"])
    store.write(dwell.stress_table(table, within, lim, cut), "stress", ("cell_id", "checkup_k"))
    bucketed = iv.range_join(log, spine, cols=["parameter_set", "replicate_id"], width=events.chunk_s, bucket="_chunk")
    store.write(ev.run_events(bucketed, events, chunk="_chunk"), "run_events", ("cell_id", "checkup_k", "event_index"))
    store.write(ev.sequence_features(store.read("run_events"), table, cut=cut), "sequence_features", ("cell_id", "checkup_k"))
    points = cut(tr.capacity_points(table))
    store.write(tr.horizon_table(points), "horizon", ("cell_id", "checkup_k"))
    store.write(tr.trajectory_features(store.read("horizon"), points), "trajectory_features", ("cell_id", "checkup_k"))
    store.write(kn.knee_candidates(points), "knee_candidates")
    store.write(kn.threshold_labels(table, points), "threshold_labels", ("cell_id", "checkup_k"))
    store.write(kn.warning_table(store.read("threshold_labels"), table, points), "warning", ("cell_id", "checkup_k"))
    store.write(co.contrast_registry(table), "contrasts", ("contrast_id",))


def build_diagnostics(store: Store, pulses: DataFrame, spectra: DataFrame) -> None:
    """Pulse and spectra states per check-up and their interval targets."""
    table = store.read("intervals")
    summary = cut(dg.pulse_summary(dg.nearest_checkup(pulses, store.read("checkups"))))
    store.write(dg.pulse_targets(table, summary), "pulse_targets", ("cell_id", "checkup_k"))
    quality = cut(dg.spectrum_quality(spectra))
    store.write(dg.eis_features(spectra, quality, table), "eis_features", ("cell_id", "checkup_k"))
    store.write(dg.eis_targets(table, store.read("eis_features")), "eis_targets", ("cell_id", "checkup_k"))
