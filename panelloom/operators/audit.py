"""Schema contracts, product digests, equality and tolerance comparisons."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from ..contracts import CONTRACTS


def matches(df: DataFrame, contract: StructType, strict: bool = True) -> bool:
    """Strict: same names and types in the same order; relaxed: every name is present."""
    have = [(f.name, f.dataType) for f in df.schema.fields]
    want = [(f.name, f.dataType) for f in contract.fields]
    return have == want if strict else {n for n, _ in want} <= {n for n, _ in have}


def conform(df: DataFrame, product: str, **constants) -> DataFrame:
    """Select and cast to a contract; absent columns take the given constant or NULL."""
    cols = []
    for f in CONTRACTS[product].fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(constants.get(f.name))
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def schema_report(df: DataFrame, contract: StructType) -> DataFrame:
    """One row per contract column: present, and with the right type."""
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = [(f.name, f.dataType.simpleString(), have.get(f.name), have.get(f.name) == f.dataType.simpleString()) for f in contract.fields]
    return df.sparkSession.createDataFrame(rows, "column_name string, expected string, found string, ok boolean")


def row_hash(cols) -> Column:
    """60-bit integer of the md5 over the columns as text."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def digest(df: DataFrame, cols) -> DataFrame:
    """Order-free product digest: row count, xor and wide sum of row hashes."""
    h = row_hash(cols)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(h).alias("xor_hash"), F.sum(h.cast("decimal(20,0)")).cast("string").alias("sum_hash"))


def differences(current: DataFrame, rebuilt: DataFrame, cols) -> DataFrame:
    """Rows only in one of two products, counted with multiplicity in one aggregate.

    Both sides are folded to (row, count) before they meet, so equal rows cost one group.
    """
    a = current.select(*cols, F.lit(1).alias("_w"))
    b = rebuilt.select(*cols, F.lit(-1).alias("_w"))
    net = a.unionByName(b).groupBy(*cols).agg(F.sum("_w").alias("_w"))
    return net.agg(F.coalesce(F.sum(F.greatest("_w", F.lit(0))), F.lit(0)).alias("only_current"),
                   F.coalesce(F.sum(F.greatest(-F.col("_w"), F.lit(0))), F.lit(0)).alias("only_rebuilt"))


def compare_products(current: DataFrame, rebuilt: DataFrame, cols) -> DataFrame:
    """Schema, count and digest equality of two products in one row."""
    same = current.select(*cols).schema == rebuilt.select(*cols).schema
    a = digest(current, cols).withColumnsRenamed({c: f"current_{c}" for c in ("rows", "xor_hash", "sum_hash")})
    b = digest(rebuilt, cols).withColumnsRenamed({c: f"rebuilt_{c}" for c in ("rows", "xor_hash", "sum_hash")})
    j = a.crossJoin(b)   # one-row frames
    return j.withColumns({"schema_equal": F.lit(same), "rows_equal": F.col("current_rows") == F.col("rebuilt_rows"),
                          "digest_equal": (F.col("current_xor_hash") == F.col("rebuilt_xor_hash")) & (F.col("current_sum_hash") == F.col("rebuilt_sum_hash"))})


def golden_compare(expected: DataFrame, actual: DataFrame, keys, fields, tolerance: float = 1e-9) -> DataFrame:
    """Per field: matched keys and values further apart than the tolerance."""
    arms = lambda d, n: d.select(*keys, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias(n)) for f in fields])).alias("z")).select(*keys, "z.*")
    j = arms(expected, "e").join(arms(actual, "a"), [*keys, "field"], "left")
    bad = F.coalesce(F.abs(F.col("e") - F.col("a")) > tolerance, ~F.col("e").eqNullSafe(F.col("a")))
    return j.groupBy("field").agg(F.count(F.lit(1)).alias("rows"), F.sum(bad.cast("long")).alias("mismatches"))


def expectations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row per named check with the number of rows that violate it; a single scan."""
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.sum((~F.coalesce(c, F.lit(False))).cast("long")).alias(n) for n, c in checks.items()])
    arms = F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(n).alias("violations")) for n in checks])
    return one.select("_rows", F.explode(arms).alias("z")).select("z.check_name", "z.violations", F.col("_rows").alias("rows"))
