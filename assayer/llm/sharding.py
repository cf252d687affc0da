"""Sharding by a hierarchical weighted hash tree (DataFrame functions only).

Shards are the leaves of a tree of regions, racks and shards.  A node weighs what its shards
weigh together, and draws ``-ln(u) / weight`` for a document, with u a hash of the document's id
and the node.  A document descends from the root, at each level into the child with the smallest
draw, so only the children of nodes on its path are drawn.  A weight that changes, changes the
draws on that leaf's path alone: between regions documents move only into or out of its region,
within that between racks only into or out of its rack, and no other subtree is touched.

Law ``key``: id and shard count decide; one more shard takes rows only into itself.  The count alone
gives the tree: from ``LAID_OUT`` shards on, the first ``LAID_OUT`` fill racks and regions, and each
further one is a node of its own below the root, as inside an old region it would draw rows to that
region's other shards.  Fewer shards are all nodes below the root.  (So the one step in which old
shards exchange rows is that to ``LAID_OUT`` shards, where the regions are laid out.)

Slots number a shard's documents from 0 without gaps.  They are counted in two levels
(sub-bucket sums, then rows within a sub-bucket), so no task holds a whole shard; equal rows of a
partition are numbered as one.

Defined results: null text has size 8 and crc 0; a null id hashes to a constant; repeated
ids share a shard and get slots of their own; equal draws go to the node with the smaller
number; very long texts are read whole; extra columns are ignored, whatever their names; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.llm.common import materialize, table

SHARDS_PER_RACK = 4
RACKS_PER_REGION = 3
#: Shards that fill the first racks and regions: a constant of the law.
LAID_OUT = 24
#: Rows of a shard that one task numbers, and the most sub-buckets a shard is split into.
SUB_ROWS = 2000
SUB_MOST = 4096


def layout(shards: int, weights: list[float] | None = None, laid_out: int = LAID_OUT) -> list[tuple[int, int, int, float]]:
    """(region, rack, shard, weight) of each leaf.

    The first ``laid_out`` shards fill racks and regions one after the other; each further one,
    and every one of fewer than ``laid_out``, is a region with a rack of its own.
    """
    w = weights or [1.0] * shards
    base = laid_out if shards >= laid_out else 0
    per_region = SHARDS_PER_RACK * RACKS_PER_REGION
    regions, racks = -(-base // per_region), -(-base // SHARDS_PER_RACK)
    old = [(k // per_region, k // SHARDS_PER_RACK, k, float(w[k])) for k in range(base)]
    return old + [(regions + k - base, racks + k - base, k, float(w[k])) for k in range(base, shards)]


def _draw(key: Column, level: str, node: int, weight: float) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(level), F.lit(node)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(u) / F.lit(weight)


def _child(key: Column, level: str, weights: dict[int, float]) -> Column:
    """The node with the smallest draw, the smaller number among equals."""
    if len(weights) == 1:
        return F.lit(next(iter(weights)))
    return F.least(*[F.struct(_draw(key, level, n, w).alias("draw"), F.lit(n).alias("node")) for n, w in weights.items()])["node"]


def descend(df: DataFrame, key: Column, tree: list[tuple[int, int, int, float]], out: str) -> DataFrame:
    """Adds ``out``, the leaf that ``key`` reaches; one projection per level of the tree."""
    keep = [F.col(f"`{c}`") for c in df.columns if c != out]
    regions: dict[int, float] = {}
    racks: dict[int, dict[int, float]] = {}
    leaves: dict[int, dict[int, float]] = {}
    for region, rack, k, w in tree:
        if w > 0:
            regions[region] = regions.get(region, 0.0) + w
            racks.setdefault(region, {})[rack] = racks.get(region, {}).get(rack, 0.0) + w
            leaves.setdefault(rack, {})[k] = w

    def below(at: Column, level: str, children: dict[int, dict[int, float]]) -> Column:
        found = F.lit(None).cast("int")
        for node, weights in children.items():
            found = F.when(at == node, _child(key, level, weights)).otherwise(found)
        return found

    df = df.select(*[F.col(f"`{c}`") for c in df.columns], _child(key, "region", regions).alias("_at_region"))
    df = df.select("*", below(F.col("_at_region"), "rack", racks).alias("_at_rack"))
    return df.select(*keep, below(F.col("_at_rack"), "shard", leaves).cast("int").alias(out))


def assign(docs: DataFrame, shards: int = 24, weights: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    text = F.col(f"`{text_col}`")
    slim = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    more = None if weights is None else [*weights, 1.0]
    slim = descend(slim, F.col("doc_id"), layout(shards, weights), "shard")
    slim = descend(slim, F.col("doc_id"), layout(shards + 1, more), "grown_shard")
    same = ["doc_id", "text_crc32", "size", "part"]
    slim = slim.withColumn("part", F.spark_partition_id()).groupBy("shard", "grown_shard", *same).agg(F.count(F.lit(1)).alias("times"))
    slim = materialize(slim, "shard")
    subs = max(1, min(SUB_MOST, -(-(slim.agg(F.sum("times")).first()[0] or 0) // (shards * SUB_ROWS))))
    slim = slim.withColumn("sub", F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit("slot")), F.lit(subs)).cast("int"))
    counts = slim.groupBy("shard", "sub").agg(F.sum("times").alias("n"))
    starts = counts.select("shard", "sub", (F.sum("n").over(W.partitionBy("shard").orderBy("sub").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")).alias("start"))
    before = F.sum("times").over(W.partitionBy("shard", "sub").orderBy(*same).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("times")
    numbered = slim.withColumn("before", before).join(starts, ["shard", "sub"]).repartition("doc_id", "part")
    slot = F.explode(F.sequence(F.col("start") + F.col("before"), F.col("start") + F.col("before") + F.col("times") - 1))
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slot.alias("slot"), "grown_shard")


def shard_report(spark, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))
