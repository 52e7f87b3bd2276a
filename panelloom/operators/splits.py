"""Grouped folds and leave-one-fold-out iteration."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalar as S
from ..functions.ordered import carry

SPLITS = ["condition_fold", "temperature_holdout_fold", "c_rate_holdout_fold",
          "profile_holdout_fold", "voltage_window_holdout_fold"]


def hash_int(*parts: Column) -> Column:
    """A 48-bit integer from the md5 of the joined parts (portable across engines)."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12), 16, 10).cast("long")


def hash_positions(df: DataFrame, keys, id_col: str, seed: int, out: str = "pos") -> DataFrame:
    """Zero-based position of each (unique) id inside ``keys`` in hash order."""
    keys = list(keys)
    d = df.withColumn("_h", hash_int(F.lit(str(seed)), F.col(id_col).cast("string")))
    d = d.withColumn("_chunk", F.shiftright("_h", 40)).withColumn("_whole", F.lit(0))
    d = carry(d, keys or ["_whole"], "_chunk", ["_h", id_col], sums_before={out: F.lit(1)})
    return d.withColumn(out, F.col(out).cast("long")).drop("_h", "_chunk", "_whole")


def split_registry(cells: DataFrame, folds: int = 5, seed: int = 42) -> DataFrame:
    """One row per cell with the fold of every split; replicates share the condition fold."""
    conditions = cells.select("parameter_set").distinct()
    placed = hash_positions(conditions, [], "parameter_set", seed)
    placed = placed.select("parameter_set", (F.col("pos") % folds).cast("int").alias("condition_fold"))
    voltage = S.voltage_fold(F.col("voltage_window_family"))
    return cells.join(placed, "parameter_set").select(
        "cell_id", "parameter_set", "replicate_id", "condition_fold",
        S.temperature_fold(F.col("nominal_temperature_C")).alias("temperature_holdout_fold"),
        voltage.alias("voltage_window_holdout_fold"), voltage.alias("soc_window_holdout_fold"),
        S.c_rate_fold(F.col("nominal_charge_C_rate"), F.col("nominal_discharge_C_rate"))
        .alias("c_rate_holdout_fold"),
        S.profile_fold(F.col("aging_mode")).alias("profile_holdout_fold"),
        S.replicate_fold(F.col("replicate_id")).alias("replicate_calibration_fold"),
        F.lit(0).alias("time_horizon_fold"))


def stack_splits(df: DataFrame, splits=SPLITS) -> DataFrame:
    """One row per (row, split) with ``split_name`` and ``fold`` (a narrow explode)."""
    pairs = F.array(*[F.struct(F.lit(s).alias("split_name"), F.col(s).cast("int").alias("fold"))
                      for s in splits])
    return df.withColumn("_s", F.explode(pairs)).select("*", "_s.split_name", "_s.fold").drop("_s")


def is_heldout(split: Column, fold: Column) -> Column:
    """Condition folds are all held out in turn; other splits hold out their non-zero folds."""
    return (split == "condition_fold") | (fold != 0)


def test_rows(df: DataFrame) -> DataFrame:
    """Every row once per split in which it is tested."""
    return (stack_splits(df).filter(is_heldout(F.col("split_name"), F.col("fold")))
            .withColumnRenamed("fold", "heldout_fold"))


def fold_totals(df: DataFrame, sums: dict[str, Column], by=()) -> DataFrame:
    """Train-side sums per held-out fold (and ``by`` group), as total minus fold.

    No row is copied once per fold: the sums of the folds are taken in one pass and the
    held-out fold is subtracted.  ``splits x folds`` rows come out, so every later use is
    a join with a small table.
    """
    by = list(by)
    per_fold = stack_splits(df).groupBy("split_name", "fold", *by).agg(
        *[F.sum(e).alias(n) for n, e in sums.items()])
    total = per_fold.groupBy("split_name", *by).agg(*[F.sum(n).alias(f"_t_{n}") for n in sums])
    held = (per_fold.filter(is_heldout(F.col("split_name"), F.col("fold")))
            .select("split_name", F.col("fold").alias("heldout_fold")).distinct())
    mine = per_fold.withColumnRenamed("fold", "heldout_fold")
    grid = held.join(total, "split_name")
    out = grid.join(mine, ["split_name", "heldout_fold", *by], "left")
    return out.select("split_name", "heldout_fold", *by,
                      *[(F.col(f"_t_{n}") - F.coalesce(F.col(n), F.lit(0))).alias(n) for n in sums])


def train_test_roles(df: DataFrame) -> DataFrame:
    """(split, held-out fold, role) counts; both sides must be non-empty."""
    n = stack_splits(df).groupBy("split_name", "fold").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("split_name").agg(F.sum("n").alias("total"))
    return (n.join(total, "split_name").filter(is_heldout(F.col("split_name"), F.col("fold")))
            .select("split_name", F.col("fold").alias("heldout_fold"), F.col("n").alias("test_rows"),
                    (F.col("total") - F.col("n")).alias("train_rows")))


def fold_overlap(df: DataFrame, id_col: str = "parameter_set") -> DataFrame:
    """Ids that sit in more than one fold of a split (leakage); clean data give no rows."""
    return (stack_splits(df).groupBy("split_name", id_col)
            .agg(F.min("fold").alias("lo"), F.max("fold").alias("hi"))
            .filter("lo <> hi").groupBy("split_name").agg(F.count(F.lit(1)).alias("overlap")))


def split_audit(registry: DataFrame) -> DataFrame:
    """Per split and fold: conditions and cells; ``leaking`` counts conditions in two folds."""
    s = stack_splits(registry)
    leaks = (s.groupBy("split_name", "parameter_set").agg(F.min("fold").alias("a"), F.max("fold").alias("b"))
             .groupBy("split_name").agg(F.sum((F.col("a") != F.col("b")).cast("long")).alias("leaking")))
    per = s.groupBy("split_name", "fold").agg(
        F.countDistinct("parameter_set").alias("conditions"), F.count(F.lit(1)).alias("cells"))
    return per.join(leaks, "split_name")


def inner_folds(df: DataFrame, keys, id_col: str, folds: int, seed: int) -> DataFrame:
    """Round-robin folds of the distinct ids of each group in hash order."""
    ids = df.select(*keys, id_col).distinct()
    placed = hash_positions(ids, keys, id_col, seed)
    return placed.select(*keys, id_col, (F.col("pos") % folds).cast("int").alias("inner_fold"))
