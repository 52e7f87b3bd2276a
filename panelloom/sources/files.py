"""File inventories, manifests and coverage as Spark jobs."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from .ingest import cell_of, modality_of


def inventory(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """One row per file: path, size, suffix, modality, cell and SHA-256 of the content."""
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root))
    name = F.element_at(F.split("path", "/"), -1)
    return df.select("path", name.alias("name"), F.col("length").alias("size_bytes"), F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).alias("suffix"),
                     modality_of(name).alias("modality"), cell_of(name).alias("cell_id"), F.sha2("content", 256).alias("sha256"),
                     F.md5("content").alias("md5"))


def reconcile(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """ok / missing / hash_mismatch / unexpected per path."""
    e = expected.select("path", F.col("hash").alias("expected_hash"))
    a = actual.select("path", F.col("hash").alias("actual_hash"))
    status = (F.when(F.col("actual_hash").isNull(), "missing").when(F.col("expected_hash").isNull(), "unexpected")
              .when(F.col("actual_hash") == F.col("expected_hash"), "ok").otherwise("hash_mismatch"))
    return e.join(a, "path", "full_outer").withColumn("status", status)


def coverage(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Per modality: files, bytes, entities seen; ``missing`` against the expected entities."""
    n = expected.select("cell_id").distinct().agg(F.count(F.lit(1)).alias("expected_entities"))
    seen = files.join(expected.select("cell_id").distinct(), "cell_id", "left_semi").groupBy("modality").agg(
        F.countDistinct("cell_id").alias("observed_entities"))
    g = files.groupBy("modality").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"))
    out = g.join(seen, "modality", "left").fillna(0).crossJoin(n)   # one-row frame on the right
    return out.withColumn("missing_entities", F.col("expected_entities") - F.col("observed_entities"))


def members(spark: SparkSession, root: str) -> DataFrame:
    """One row per member of every zip archive, without extracting.

    Only the directory of an archive is decoded, inside the task that read the file.
    """
    def listing(batches):
        import io
        import zipfile

        import pandas as pd
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    rows += [(path, i.filename, i.compress_size, i.file_size) for i in z.infolist() if not i.is_dir()]
            yield pd.DataFrame(rows, columns=["archive", "member", "compressed_size_bytes", "uncompressed_size_bytes"])

    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(root)
    out = df.select("path", "content").mapInPandas(
        listing, "archive string, member string, compressed_size_bytes long, uncompressed_size_bytes long")
    return out.withColumns({"modality": modality_of(F.col("member")), "cell_id": cell_of(F.col("member")),
                            "suffix": F.lower(F.regexp_extract("member", r"(\.[^.]+)$", 1))})


def family_counts(files: DataFrame, rows_col: str = "row_count") -> DataFrame:
    return files.groupBy("modality").agg(F.sum(rows_col).alias("rows"))


def collection_manifest(roots: dict[str, DataFrame]) -> DataFrame:
    """Files and bytes per archive set; a set without files stays with zero counts."""
    arms = [df.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))
            .select(F.lit(name).alias("archive_set"), "files", "bytes", (F.col("files") > 0).alias("present"))
            for name, df in roots.items()]
    return reduce(DataFrame.unionByName, arms)


def dataset_manifest(files: DataFrame, expected: DataFrame) -> DataFrame:
    """One row of totals with a warning count of unknown and missing items."""
    cov = coverage(files, expected).agg(F.sum("missing_entities").alias("missing_entities"))
    return files.agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"), F.countDistinct("modality").alias("modalities"),
                     F.sum((F.col("modality") == "unknown").cast("long")).alias("unknown_files")).crossJoin(cov)   # one-row frames
