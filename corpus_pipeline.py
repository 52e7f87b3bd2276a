"""Corpus pipeline: the stages in order, each written as Parquet and read again as the next one's documents.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``.  Rows with null ids or texts pass through filters unless a stage's operator says otherwise.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelloom.llm import decontaminate, linededup, mixpack, superminhash, toxicity
from panelloom.llm.common import id_key, packed, read, sized, union_all, written


#: A text with a word.
WORD = r"[^\x20\x09-\x0D]"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold."""
    return toxicity.without_toxic(docs, read(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines in windows that occur earlier are taken out, and n_chars follows the text.

    A document that loses lines and has no word left goes: all of it stands elsewhere.  Texts that had no
    word before stay."""
    clean = linededup.dedup_lines(packed(docs).select("row", "row.doc_id", "row.text"))
    clean = clean.where((F.col("n_removed") == 0) | F.col("clean_text").rlike(WORD))
    out = {"text": F.col("clean_text")}
    if "n_chars" in docs.columns:
        length = F.length("clean_text").cast(docs.schema["n_chars"].dataType)
        out["n_chars"] = F.when(F.col("n_removed") > 0, length).otherwise(F.col("row.n_chars"))
    return clean.select(*[out[c].alias(c) if c in out else F.col(f"row.`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each group linked at five-word shingles and a similarity of 0.8: the smallest by (doc_id, text hash).

    A document is a doc_id with a text: rows that share an id, or have none, are told apart by their texts.
    Of rows with equal doc_id and text one stays, if the text has a word."""
    rows = packed(docs).select("row", id_key("row.doc_id").alias("id"), F.xxhash64("row.text").alias("th"))
    key = F.xxhash64("id", "th")
    found = superminhash.near_duplicates(rows.select(key.alias("doc_id"), "row.text"), words=5, percent=80)
    found = found.where("n_shingles > 0").groupBy(id_key().alias("key"), id_key("component_id").alias("group")).agg(F.count(F.lit(1)).alias("n"))
    found = written(found.join(rows.select(key.alias("key"), "id", "th").distinct(), "key"), "near-copies")
    first = found.groupBy("group").agg(F.min(F.struct("id", "th")).alias("first")).select("first.*")
    gone = written(found.join(first, ["id", "th"], "left_anti").select("id", "th"), "copies")
    again = written(found.where("n > 1").join(first, ["id", "th"], "left_semi").select("id", "th"), "again")
    rows = rows.join(sized(gone), ["id", "th"], "left_anti")
    if again.isEmpty():
        return rows.select("row.*")
    several = rows.join(sized(again), ["id", "th"], "left_semi")
    one = several.groupBy("id", "th").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return union_all([f.select("row.*") for f in (rows.join(sized(again), ["id", "th"], "left_anti"), one)])


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no item of ``benchmark``."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 tokens that mirror the mix of sources."""
    return mixpack.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

#: Toxicity is learnt, so no stage after it can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
