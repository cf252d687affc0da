"""Numbering and scanning rows in a global order, without a task that sees them all.

Spark's range sort deals rows to tasks in order; what a task has to know of the tasks before
it is one number or one value, so only those few rows are gathered.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numbered(df: DataFrame, order: list[str | Column], path: str, out: str = "id", first: int = 1) -> DataFrame:
    """``df`` with a gapless ``out`` from ``first`` in the given order, read back from ``path``.

    The sorted rows are written once with their task and place, which fixes both; the counts of
    the tasks (one row each) give every task its first number.  Ties get numbers in any order.
    """
    place = F.monotonically_increasing_id()
    rows = df.orderBy(*order).select("*", F.shiftrightunsigned(place, 33).alias("_task"), place.bitwiseAND((1 << 33) - 1).alias("_place"))
    schema = rows.schema
    rows.write.parquet(path)
    rows = df.sparkSession.read.schema(schema).parquet(path)
    counts = rows.groupBy("_task").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.orderBy("_task").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_n")
    starts = counts.select("_task", before.alias("_start"))
    return rows.join(F.broadcast(starts), "_task").select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_start") + F.col("_place") + first).alias(out))


#: Rows of a series that one task goes through, most blocks of all series, and sampled rows per block.
BLOCK_ROWS = 1_000_000
MOST_BLOCKS = 4096
SAMPLED = 32


@dataclass(frozen=True)
class Bounds:
    """First rows (by keys, then order) of all blocks of some series but the first block."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    firsts: tuple[tuple, ...] = ()

    def block(self, df: DataFrame) -> Column:
        """The number of a row's block, by binary search: a fixed function of the row, whatever plan it is part of."""
        columns = [*self.keys, *self.order]
        firsts = F.array(*[F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(columns, row)]) for row in self.firsts])
        row = F.struct(*[F.col(c) for c in columns])
        n = len(self.firsts)
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
        further = lambda at, step: F.coalesce((at + step <= n) & (F.get(firsts, at + step - 1) <= row), F.lit(False))
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when(further(at, step), at + step).otherwise(at))

    def split_keys(self, df: DataFrame) -> DataFrame:
        """The keys that may lie in several blocks: those of the blocks' first rows."""
        return df.sparkSession.createDataFrame(sorted({r[: len(self.keys)] for r in self.firsts}, key=repr), df.select(*self.keys).schema)


def bounds(df: DataFrame, keys: list[str], order: list[str], rows: int = BLOCK_ROWS) -> Bounds:
    """Bounds that cut the sorted rows into blocks of about ``rows``, within a hot key too, from a sample by hash.

    They hold for any part of these rows as well.  A table that fits in a block has none.
    """
    n = df.count()
    blocks = min(MOST_BLOCKS, math.ceil(n / rows))
    if blocks <= 1:
        return Bounds(tuple(keys), tuple(order))
    columns = [*keys, *order]
    share = F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) < F.lit(math.ceil(min(1.0, blocks * SAMPLED / n) * (1 << 30)))
    sample = [tuple(r) for r in df.select(*columns).filter(share).distinct().orderBy(*columns).collect()]
    firsts = [sample[k * len(sample) // blocks] for k in range(1, blocks)] if sample else []
    return Bounds(tuple(keys), tuple(order), tuple(dict.fromkeys(firsts)))


def carry(df: DataFrame, cuts: Bounds, values: list[str], upto: str | None = None, beside: str | None = None, backward: bool = False) -> DataFrame:
    """Adds to each value, along its series, the last one that is not null.

    ``upto``: suffix of that up to the row itself; ``beside``: of that before it.  ``backward`` goes
    against the order.  Within blocks this is a window; what a block takes over from those before it
    is the last value of each, which only the few keys that lie in several blocks need: no task
    goes through more than a block, however long a series is.
    """
    keys, order, block = list(cuts.keys), list(cuts.order), "_block"
    along = [F.desc(o) if backward else F.asc(o) for o in order]
    bare, df = df, df.withColumn(block, cuts.block(df) if cuts.firsts else F.lit(0))
    within = W.partitionBy(*([block] if cuts.firsts else []), *keys).orderBy(*along)
    frames = [(s, within.rowsBetween(W.unboundedPreceding, end)) for s, end in ((upto, W.currentRow), (beside, -1)) if s]
    out = df.select("*", *[F.last(v, True).over(frame).alias(v + s) for v in values for s, frame in frames])
    if cuts.firsts:
        last = F.min_by if backward else F.max_by
        same = lambda a, b, names: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in names]
        # only rows of these keys are searched for their block
        split = bare.alias("l").join(F.broadcast(cuts.split_keys(df)).alias("r"), same("l", "r", keys), "left_semi")
        split = split.withColumn(block, cuts.block(bare))
        ends = split.groupBy(*keys, block).agg(*[last(v, F.when(F.col(v).isNotNull(), F.struct(*order))).alias(v) for v in values])
        blocks = W.partitionBy(*keys).orderBy(F.desc(block) if backward else F.asc(block)).rowsBetween(W.unboundedPreceding, -1)
        ends = ends.select(*keys, block, *[F.last(v, True).over(blocks).alias(f"_came_{v}") for v in values])
        # a row for each block and each split key at most
        out = out.alias("l").join(F.broadcast(ends).alias("r"), same("l", "r", [*keys, block]), "left")
        cols = [F.col(f"l.{c}") for c in df.columns]
        out = out.select(*cols, *[F.coalesce(v + s, f"_came_{v}").alias(v + s) for v in values for s, _ in frames])
    return out.drop(block)
