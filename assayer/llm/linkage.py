"""Connected components, and exact comparison of all pairs within candidate groups.

Both are distributed: edges, labels and fingerprints never gather on the driver, and no
group is ever held by one task.  A group of any size is cut into blocks of bounded size, and
each pair of blocks is a tile of its own, which one task compares in numpy.  A tile reports
counts per member and a spanning forest of the links it found, never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import Written, materialize

#: Members of a block; a tile compares two blocks.
BLOCK = 128


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of all nodes of ``edges`` (src, dst long): root is the smallest reachable.

    Alternates large-star and small-star steps until nothing changes; every step is a
    partially aggregated minimum per node and a join.  The minima are written before they
    are joined, so both sides of the join are plain exchanges, and a hub's edges can be
    split over tasks by Spark's skew join.  Tables of earlier steps are dropped.
    """
    e = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u <> v").distinct()
    e = Written(e, "edges")
    seen = None
    for _ in range(most_rounds):
        both = e.df.unionByName(e.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        least = Written(least, "minima")
        big = both.filter("v > u").join(least.df, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        big = Written(big.filter("u <> v").distinct(), "edges")
        low = big.df.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        low = Written(low, "minima")
        small = big.df.join(low.df, F.col("u") == F.col("w"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.df.select(F.col("w").alias("u"), F.col("m").alias("v")))
        new = Written(small.filter("u <> v").distinct(), "edges")
        for old in (e, least, big, low):
            old.drop()
        e = new
        now = e.df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or now[0] == 0:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    nodes = e.df.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(e.df.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def by_group(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Members joined to their groups' row.

    The groups are written first and joined by a sort-merge join, so both sides are plain
    exchanges and Spark splits large groups over tasks.
    """
    return members.join(materialize(groups, "groups").hint("merge"), "group")


def distinct_sets(members: DataFrame) -> DataFrame:
    """(group, node) of the groups of several nodes; of groups with the same nodes one is left."""
    sets = members.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(node))").alias("x")).filter("n > 1")
    return by_group(members, sets.groupBy("n", "x").agg(F.min("group").alias("group")).select("group"))


def tile_rows(members: DataFrame, block: int | None = None, most_size: int | None = None) -> DataFrame:
    """(group, node) -> (group, node, blk, ti, tj, tile): one row for each tile the node is in.

    Blocks are dealt by hash, so numbering them needs no ordered pass over a group.  With
    ``most_size``, members have a ``size``, and a block holds about that much of it at most.
    """
    block = block or BLOCK
    blocks = F.ceil(F.count(F.lit(1)) / block)
    blocks = F.greatest(blocks, F.ceil(F.sum("size") / most_size)) if most_size else blocks
    sizes = members.groupBy("group").agg(F.count(F.lit(1)).alias("n"), blocks.cast("int").alias("blocks")).filter("n > 1")
    rows = by_group(members, sizes.drop("n")).withColumn("blk", F.pmod(F.xxhash64("node", F.lit("blk")), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("group", "node", "blk", F.least("blk", "other").alias("ti"), F.greatest("blk", "other").alias("tj"))
    return rows.withColumn("tile", F.expr("CAST(tj AS LONG) * (tj + 1) div 2") + F.col("ti"))


def cross_tile_rows(left: DataFrame, members: DataFrame, block: int | None = None) -> DataFrame:
    """The same for pairs of a group's ``left`` nodes with all its members; left blocks count down from -1."""
    block = block or BLOCK
    count = lambda df, name: df.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
    sizes = materialize(count(left, "lefts").join(count(members, "alls"), "group"), "sizes").hint("merge")
    deal = lambda n: F.pmod(F.xxhash64("node", F.lit("blk")), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    tile = F.col("i") + F.col("j").cast("long") * F.col("lefts")
    place = [(-F.col("i") - 1).alias("ti"), F.col("j").alias("tj"), tile.alias("tile")]
    a = left.join(sizes, "group").withColumn("i", deal("lefts")).withColumn("j", each("alls"))
    b = members.join(sizes, "group").withColumn("j", deal("alls")).withColumn("i", each("lefts"))
    return a.select("group", "node", (-F.col("i") - 1).alias("blk"), *place).unionByName(b.select("group", "node", F.col("j").alias("blk"), *place))


def _spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index linked to each of n members by the pairs (a, b)."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        low = np.minimum(ra, rb)
        new = root.copy()
        np.minimum.at(new, ra, low)
        np.minimum.at(new, rb, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def compare_tiles(rows: DataFrame, payload: list[str], link: Callable[[dict, int], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Compare all pairs of each tile of ``rows`` (group, ti, tj, tile, blk, node, weight, payload).

    ``link(tile, left)`` gets a tile's columns, the first block's rows first, by node, and the number of rows of the first block (all, in a tile of one block); it
    returns the index pairs that link, each once.  The result has a row for each linked
    node of a tile: node, links (sum of the linked nodes' weights) and root (the smallest
    node of the tile's links that reach it).
    """
    columns = ["group", "ti", "tj", "blk", "node", "weight", *payload]

    def one(parts: list[dict], key: tuple) -> tuple | None:
        tile = parts[0] if len(parts) == 1 else {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
        order = np.lexsort((tile["node"], tile["blk"]))
        tile = {c: v[order] for c, v in tile.items()}
        left = len(order) if key[1] == key[2] else int((tile["blk"] == key[1]).sum())
        if len(order) < 2 or left == 0:
            return None
        a, b = link(tile, left)
        if not len(a):
            return None
        node, weight = tile["node"], tile["weight"]
        links = np.bincount(a, weights=weight[b], minlength=len(node)) + np.bincount(b, weights=weight[a], minlength=len(node))
        order = np.argsort(node, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        root = node[order][_spanning(len(node), place[a], place[b])][place]
        hit = links > 0
        return node[hit], links[hit].astype(np.int64), root[hit]

    def run(batches):
        held: list[dict] = []
        key = None
        for pdf in batches:
            done = []
            group, ti, tj = (pdf[c].to_numpy() for c in columns[:3])
            data = {c: pdf[c].to_numpy() for c in columns[3:]}
            new = np.flatnonzero((group[1:] != group[:-1]) | (ti[1:] != ti[:-1]) | (tj[1:] != tj[:-1])) + 1
            for lo, hi in zip([0, *new], [*new, len(group)]):
                k = (group[lo], ti[lo], tj[lo])
                if k != key and held:
                    done.append(one(held, key))
                    held = []
                key = k
                held.append({c: v[lo:hi] for c, v in data.items()})
            done = [d for d in done if d is not None]
            if done:
                yield pd.DataFrame({c: np.concatenate([d[i] for d in done]) for i, c in enumerate(("node", "links", "root"))})
        if held and (last := one(held, key)) is not None:
            yield pd.DataFrame(dict(zip(("node", "links", "root"), last)))

    # the tiles of one group go to one partition after the other, so a large group spreads evenly
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.pmod(F.xxhash64("group") % parts + F.col("tile"), F.lit(parts)).cast("int")
    dealt = rows.select(*columns, "tile").repartitionById(parts, place).drop("tile").sortWithinPartitions("group", "ti", "tj")
    return dealt.mapInPandas(run, "node long, links long, root long")
