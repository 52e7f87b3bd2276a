"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

On every level the children of the chosen node draw a hash of (document, child); the least
``-ln(u) / weight`` wins.  A draw depends on its own child only, so when one child's weight changes,
documents move only into it (grown) or out of it (shrunk): movement stays within the subtree whose weight
changed.  New shards are put in a region of their own, so that what moves lands in the new shard.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import id_key, written

REGION, RACK = 8, 4
#: Blocks in which the documents of a shard are numbered.
BLOCKS = 1024


def even_tree(shards: int) -> list[tuple[str, str, int, float]]:
    """(region, rack, shard, weight) for shards of weight 1: eight to a region, four to a rack."""
    return [(f"r{s // REGION}", f"r{s // REGION}k{s % REGION // RACK}", s, 1.0) for s in range(shards)]


def _child_map(pairs) -> Column:
    """Literal map of a node to its children (name, weight), a weight being the sum below it."""
    children: dict = {}
    for parent, child, weight in pairs:
        own = children.setdefault(parent, {})
        own[child] = own.get(child, 0.0) + weight
    entries = []
    for parent, own in children.items():
        entries += [F.lit(parent), F.array(*[F.struct(F.lit(c).alias("name"), F.lit(w).alias("weight")) for c, w in own.items()])]
    return F.create_map(*entries)


def descend(key: Column, tree: list[tuple[str, str, int, float]]) -> Column:
    """The shard of a key; the tree is configuration and becomes a literal of the plan."""
    tree = [t for t in tree if t[3] > 0]
    regions = _child_map([("", r, w) for r, _, _, w in tree])
    racks = _child_map([(r, k, w) for r, k, _, w in tree])
    shards = _child_map([(k, str(s), w) for _, k, s, w in tree])

    def draw(children: Column) -> Column:
        def score(c):
            u = (F.shiftrightunsigned(F.xxhash64(key, c["name"]), 11).cast("double") + 0.5) / F.lit(float(2 ** 53))
            return F.struct((-F.log(u) / c["weight"]).alias("score"), c["name"].alias("name"))
        return F.array_min(F.transform(children, score))["name"]

    region = draw(F.element_at(regions, F.lit("")))
    rack = draw(F.element_at(racks, region))
    return draw(F.element_at(shards, rack)).cast("int")


def shard(docs: DataFrame, tree: list | None = None, grown: list | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): size, text_crc32, law, shard, slot, grown_shard.

    ``shard`` depends on doc_id and ``tree`` alone (law ``key``): rows with one doc_id, null included,
    share a shard.  ``grown_shard`` is the shard under ``grown``, the tree with one more shard.  Slots
    count from 0 without gaps in each shard, in blocks of hashed ids; within a block by doc_id, checksum
    and size, so only equal rows are interchangeable.  Null text is empty: size 1, checksum 0.  Extra
    columns are ignored; empty input gives no rows.
    """
    tree = tree or even_tree(16)
    grown = grown or even_tree(len(tree) + 1)
    key = id_key()
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select("doc_id", F.octet_length(body).cast("long").alias("_bytes"), F.crc32(body).alias("text_crc32"),
                       F.pmod(F.xxhash64(key), F.lit(BLOCKS)).cast("int").alias("_block"),
                       descend(key, tree).alias("shard"), descend(key, grown).alias("grown_shard"))
    rows = written(rows.withColumn("size", F.col("_bytes") + 1).drop("_bytes"), "shards")
    blocks = rows.groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("shard", "_block").orderBy("doc_id", "text_crc32", "size")
    out = rows.withColumn("_at", F.row_number().over(inside) - 1).join(blocks, ["shard", "_block"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_before") + F.col("_at")).alias("slot"), "grown_shard")
