"""URL rules by a sort-merge range join over reversed-host keys.

A key is the host's labels in reverse, each ended by byte 1, then byte 2 and the path; bytes 1 to 3 inside a
label are written as byte 3 and a letter, so that no label holds an end mark.  All keys under a
rule's host, or under a rule's path on one host, start with the rule's key: they form the interval from
that key to the key with byte 255 behind it, and intervals nest.  A sweep over the sorted keys, openings
and ends holds the stack of active intervals; its depth is a running sum, and the interval on top at a
depth is the last one opened at that depth.

The sort is a range partition; intervals open across a border are opened again at the start of the next
part, so every part is swept on its own and a host with a third of all pages spreads over many parts.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import LOWER, UPPER, written

#: The rules of the registered query (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
AGAIN, OPEN, POINT, CLOSE = -1, 0, 1, 2


def host_and_path(url: Column) -> tuple[Column, Column]:
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, parts, 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, parts, 2), F.lit(""))


def host_key(host: Column) -> Column:
    for mark, letter in (("\x03", "c"), ("\x01", "a"), ("\x02", "b")):
        host = F.replace(host, F.lit(mark), F.lit("\x03" + letter))
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.", -1)), "\x01"), F.lit("\x01"))


def path_key(host: Column, path: Column) -> Column:
    return F.concat(host_key(host), F.lit("\x02"), path)


def sweep(points: DataFrame, intervals: DataFrame, whole_stack: bool = False) -> DataFrame:
    """``points`` (key, tie, ...) with ``interval``: the innermost of ``intervals`` (key, interval) whose key
    starts the point's key, null if there is none; with ``whole_stack`` a row for each that does.

    Keys of intervals must be distinct.  Points with equal keys are told apart by ``tie`` (a long) when
    they are dealt to parts.
    """
    payload = [c for c in points.columns if c not in ("key", "tie")]
    k = F.encode("key", "UTF-8")
    nothing = [F.lit(None).cast(points.schema[c].dataType).alias(c) for c in payload]
    start = intervals.select(k.alias("k"), F.lit(OPEN).alias("kind"), F.lit(0).cast("long").alias("tie"), k.alias("_own"), "interval", *nothing)
    end = intervals.select(F.concat(k, F.unhex(F.lit("FF"))).alias("k"), F.lit(CLOSE).alias("kind"), F.lit(0).cast("long").alias("tie"), k.alias("_own"), "interval", *nothing)
    no = F.lit(None).cast(intervals.schema["interval"].dataType).alias("interval")
    point = points.select(k.alias("k"), F.lit(POINT).alias("kind"), F.col("tie").cast("long"), F.unhex(F.lit("")).alias("_own"), no, *payload)
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    events = start.union(end).union(point).repartitionByRange(parts, "k", "kind", "tie").withColumn("part", F.spark_partition_id())
    events = written(events, "events")
    opened = events.where(F.col("kind") == OPEN).select("_own", "interval", F.col("part").alias("a"))
    closed = events.where(F.col("kind") == CLOSE).select("_own", F.col("part").alias("b"))
    across = opened.join(closed, "_own").where("b > a").withColumn("part", F.explode(F.expr("sequence(a + 1, b)")))
    again = across.select(F.unhex(F.lit("")).alias("k"), F.lit(AGAIN).alias("kind"), F.lit(0).cast("long").alias("tie"), "_own", "interval", *nothing, "part")
    events = events.union(again)
    line = Window.partitionBy("part").orderBy("k", "kind", "_own", "tie").rowsBetween(Window.unboundedPreceding, 0)
    delta = F.when(F.col("kind") == CLOSE, -1).when(F.col("kind") == POINT, 0).otherwise(1)
    events = events.withColumn("depth", F.sum(delta).over(line)).where(F.col("kind") != CLOSE)
    if whole_stack:
        at = F.when((F.col("kind") == POINT) & (F.col("depth") > 0), F.sequence(F.lit(1).cast("long"), "depth")).otherwise(F.array("depth"))
        events = events.withColumn("depth", F.explode(at))
    level = Window.partitionBy("part", "depth").orderBy("k", "kind", "_own", "tie").rowsBetween(Window.unboundedPreceding, 0)
    # at depth 0 nothing is ever opened, so points there find null
    top = F.last("interval", ignorenulls=True).over(level)
    return events.withColumn("interval", top).where(F.col("kind") == POINT).select(*payload, "interval")


def rule_table(spark: SparkSession, rules) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Per row of ``pages`` (page_id, url): host, path, rule, verdict.

    ``rules`` (verdict, host, path): a rule fits its host and all subdomains if the page's path starts with
    the rule's.  The longest rule text (host and path) wins, then the larger text; of rules with equal
    host and path the larger verdict counts.  Rules with nulls are ignored.  No rule: ``rule`` is null, and
    the verdict is ``block`` for a page without host and ``allow`` otherwise.  Null urls and urls without
    ``://`` have an empty host and path.  Repeated and null page_ids are rows like others; extra columns are
    ignored; empty input gives no rows.
    """
    rules = rules.where("host is not null and path is not null and verdict is not null")
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    host, path = host_and_path(F.col("url"))
    pages = written(pages.select("page_id", host.alias("host"), path.alias("path"), F.xxhash64("page_id").alias("tie")), "pages")

    # the rules' hosts that each host of the pages lies under
    hosts = pages.select("host").distinct()
    zones = rules.select(F.col("host").alias("interval")).distinct().withColumn("key", host_key(F.col("interval")))
    under = sweep(hosts.select(host_key(F.col("host")).alias("key"), F.lit(0).alias("tie"), "host"), zones, whole_stack=True)
    own = under.where("interval is not null").join(rules.withColumnRenamed("host", "interval"), "interval")
    text = F.concat("interval", "path")
    own = written(own.select("host", "path", F.struct(F.length(text).alias("n"), text.alias("rule"), "verdict").alias("value")), "own-rules")

    # each interval of a host takes the longest rule among those around it
    prefixes = own.groupBy("host", "path").agg(F.max("value").alias("interval")).withColumn("key", path_key(F.col("host"), F.col("path")))
    around = sweep(prefixes.select("key", F.lit(0).alias("tie"), F.col("key").alias("own")), prefixes.select("key", "interval"), whole_stack=True)
    best = written(around.groupBy("own").agg(F.max("interval").alias("interval")).withColumnRenamed("own", "key"), "intervals")

    found = sweep(pages.withColumn("key", path_key(F.col("host"), F.col("path"))), best)
    other = F.when(F.col("host") == "", F.lit("block")).otherwise(F.lit("allow"))
    return found.select("page_id", "host", "path", F.col("interval.rule").alias("rule"), F.coalesce("interval.verdict", other).alias("verdict"))
