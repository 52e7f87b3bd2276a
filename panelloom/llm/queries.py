"""The registered queries of the subpackage, each over its whole tables, and their SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import attribution, decontaminate, hashtree, licenses, linededup, linequality, mixpack, periodic, ppm, superminhash, toxicity, urlrules, whitening
from .common import read
from .oracles import SQL as ORACLES  # noqa: F401

QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_pairs(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op2_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "clean_text")


@query
def op3_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(read(spark, sf_dir, "documents"))


@query
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


@query
def op5_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.section_tokens(read(spark, sf_dir, "documents"))


@query
def op6_gru_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linequality.line_quality(read(spark, sf_dir, "documents"))


@query
def op8_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashtree.shard(read(spark, sf_dir, "documents"))


@query
def op9_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixpack.pack(read(spark, sf_dir, "documents"))


@query
def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(read(spark, sf_dir, "pages"), urlrules.rule_table(spark, urlrules.RULES))


@query
def op11_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.predicted(read(spark, sf_dir, "documents"))


@query
def op12_rank_one_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


@query
def op13_sync_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic_runs(read(spark, sf_dir, "documents"))
