"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only).

Every source is a queue whose documents stand in a fixed shuffled order (md5 of id and
size).  A document's virtual finish time is the number of its source's words up to its
middle, divided by the source's target.  A queue may be gone through up to ``max_repeats``
times, so the k-th copy of a document finishes k rounds later.  All copies of all sources are
ordered by virtual finish time, and the mix is truncated where the next copy would exceed the
budget: that copy's finish time is the cut.

Targets: the budget is shared by weight; a source whose share is above ``max_repeats``
times its size gets that, and the excess is reshared by weight until none is above.

Scale: one pass over the texts yields (id, source, size, hash).  Equal rows of a partition are
counted as one until their copies are known.  Running sums per source use two levels, sums by
hash bucket and then rows within a bucket, so a source that holds a third of all rows is spread
over 4096 buckets and no task sees a whole source.  The global order is cut into slices of
virtual time, at most ``SLICES`` of them: sums of whole buckets by slice tell between which slices the
budget ends, and only copies of the buckets that reach there are sorted one by one.

Defined results: null text has size 0; a null source is a source of its own, last in
order; rows of size 0 take no words; repeated rows are rows of their own; rows with equal
hashes stand by id and size, and copies that finish at the same time by hash and source; very
long texts are counted whole; an empty table gives an empty mix; extra columns are carried
along by :func:`mix`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.llm.common import materialize, word_count

BUCKET_HEX = 3
WEIGHTS = (1, 2, 3)
#: Slices of a unit of virtual time up to time 2; beyond it 1024 for each doubling.
FINE = 1 << 16
SLICES = 2 * FINE + 1024 * 1024
#: JSON that tells timestamps apart to the microsecond.
EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _key(source: Column) -> Column:
    """Source as a non-null key that sorts by code point, null last."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def _order_hash(doc_id: Column, size: Column) -> Column:
    return F.md5(F.concat_ws("|", doc_id.cast("string"), size.cast("string")).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = 3, budget: int | None = None) -> DataFrame:
    """(mix_key, source_size) -> adds ``weight`` and ``target``; one row per source.

    The capped sources are those with the smallest ratio of cap to weight: after sorting by
    that ratio, a source is capped if its cap is at most the share it would get once all
    sources before it are capped.
    """
    by_key = W.partitionBy(F.lit(1)).orderBy("mix_key")
    rank = F.row_number().over(by_key) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    one = W.partitionBy(F.lit(1))
    s = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_repeats)
    total = F.lit(budget).cast("long") if budget is not None else F.sum("source_size").over(one)
    s = s.withColumn("budget", total)
    upto = one.orderBy(F.col("cap") / F.col("weight"), "mix_key")
    s = s.withColumn("caps_before", F.sum("cap").over(upto.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("cap"))
    s = s.withColumn("weight_left", F.sum("weight").over(one) - F.sum("weight").over(upto.rowsBetween(W.unboundedPreceding, W.currentRow)) + F.col("weight"))
    capped = F.col("cap") * F.col("weight_left") <= (F.col("budget") - F.col("caps_before")) * F.col("weight")
    s = s.withColumn("capped", capped)
    caps = F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(one), F.lit(0))
    rest = F.coalesce(F.sum(F.when(~F.col("capped"), F.col("weight"))).over(one), F.lit(0.0))
    share = F.col("weight") * (F.col("budget") - caps) / F.nullif(rest, F.lit(0.0))
    return s.select("mix_key", "source_size", "weight", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def _slice(finish: Column) -> Column:
    """Slices of virtual time in its order: even ones up to time 2, beyond it even in its logarithm."""
    late = F.lit(2 * FINE) + F.floor(F.log2(finish) * 1024)
    return F.when(finish < 2, F.floor(finish * FINE)).otherwise(late).cast("long")


def _finish(round_: Column, place: Column | None = None) -> Column:
    """Virtual finish time of a document's copy of a round, or of a place in its source's queue."""
    return ((F.col("middle") if place is None else place) + round_ * F.col("source_size")) / F.nullif(F.col("target"), F.lit(0.0))


def _cut(placed: DataFrame, offsets: DataFrame, budget: int | None, max_repeats: int) -> tuple | None:
    """(finish, mix_hash, mix_key) of the first copy that the budget leaves out; None if it takes all.

    The words of a source's bucket lie between its offsets, so each round's copies of it finish between
    two known times.  Sums of buckets by the slices of these times bound the slices in which the cut can
    be; only copies of the buckets that reach into those are ordered one by one.
    """
    one = W.partitionBy(F.lit(1))
    rounds = offsets.filter("words > 0").withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))))
    at = lambda place: _slice(_finish(F.col("round"), place))
    rounds = rounds.select("mix_key", "bucket", "round", "words", at(F.col("before")).alias("low"), at(F.col("before") + F.col("words")).alias("high")).filter("low IS NOT NULL")
    total = budget if budget is not None else offsets.agg(F.sum("words")).first()[0] or 0

    def first_over(slice_: str) -> int | None:
        sums = rounds.groupBy(slice_).agg(F.sum("words").alias("words"))
        upto = F.sum("words").over(one.orderBy(slice_).rowsBetween(W.unboundedPreceding, W.currentRow))
        return sums.withColumn("upto", upto).filter(F.col("upto") > total).agg(F.min(slice_)).first()[0]

    low = first_over("low")
    if low is None:
        return None
    high = first_over("high")
    before = rounds.filter(F.col("high") < low).agg(F.sum("words")).first()[0] or 0
    across = rounds.filter((F.col("high") >= low) & (F.col("low") <= high if high is not None else F.lit(True))).select("mix_key", "bucket", "round")
    order = ["finish", "mix_hash", "mix_key"]
    inside = placed.filter("size > 0").join(across, ["mix_key", "bucket"]).select(_finish(F.col("round")).alias("finish"), "mix_hash", "mix_key", "size")
    upto = F.sum("size").over(one.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)) + F.lit(before)
    found = inside.withColumn("upto", upto).filter(F.col("upto") > total).orderBy(*order).select(*order).first()
    return tuple(found) if found else None


def schedule(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_repeats: int = 3, budget: int | None = None) -> DataFrame:
    """One row per document: mix_id, mix_key, size, mix_hash, source_size, weight, target, copies, virtual_finish.

    ``virtual_finish`` is that of the first copy; ``copies`` counts those before the cut.
    """
    size = word_count(F.col(f"`{text_col}`"))
    slim = docs.select(F.col(f"`{id_col}`").alias("mix_id"), _key(F.col(f"`{source_col}`")).alias("mix_key"), size.alias("size"))
    slim = slim.withColumn("mix_hash", _order_hash(F.col("mix_id"), F.col("size")))
    # equal rows of a partition are one row with a count
    same = ["mix_key", "mix_hash", "mix_id", "size", "part"]
    slim = slim.withColumn("part", F.spark_partition_id()).groupBy(*same).agg(F.count(F.lit(1)).alias("times"))
    slim = materialize(slim.withColumn("bucket", F.substring("mix_hash", 1, BUCKET_HEX)), "mix")
    all_words = F.sum(F.col("size") * F.col("times"))
    buckets = slim.groupBy("mix_key", "bucket").agg(all_words.alias("words"))
    sizes = slim.groupBy("mix_key").agg(all_words.alias("source_size"))
    plan = targets(sizes, weights, max_repeats, budget)
    within = W.partitionBy("mix_key").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    offsets = materialize(buckets.withColumn("before", F.sum("words").over(within) - F.col("words")).join(plan, "mix_key"), "offsets")
    run = W.partitionBy("mix_key", "bucket").orderBy(*same[1:]).rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = slim.withColumn("upto", F.sum(F.col("size") * F.col("times")).over(run)).join(offsets.drop("words"), ["mix_key", "bucket"])
    placed = placed.withColumn("start", F.col("before") + F.col("upto") - F.col("size") * F.col("times"))
    # rows of a count, one after the other, dealt over the tasks before they are made
    placed = placed.repartition("mix_hash", "part").withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    placed = placed.withColumn("middle", F.col("start") + F.col("nth") * F.col("size") + F.col("size") / 2)
    placed = placed.select("mix_id", "mix_key", "bucket", "size", "mix_hash", "source_size", "weight", "target", "middle")
    cut = _cut(placed, offsets, budget, max_repeats)
    copies = F.lit(0)
    for k in range(max_repeats):
        f = _finish(F.lit(k))
        early = F.lit(True) if cut is None else (f < cut[0]) | (f == cut[0]) & ((F.col("mix_hash") < cut[1]) | (F.col("mix_hash") == cut[1]) & (F.col("mix_key") < cut[2]))
        copies = copies + F.when(f.isNotNull() & early, 1).otherwise(0)
    return placed.select("mix_id", "mix_key", "size", "mix_hash", "source_size", "weight", "target", copies.cast("long").alias("copies"), _finish(F.lit(0)).alias("virtual_finish")).orderBy("virtual_finish", "mix_hash", "mix_id")


def cuts(scheduled: DataFrame) -> DataFrame:
    """Per source: copies that all documents get, and the last hash that gets one more.

    Copies never increase along a source's order, so the table has one row per source and
    decides for every document but those that share the last hash with documents beyond the
    cut, where ``split`` is set; it is far smaller than the documents.
    """
    ends = scheduled.groupBy("mix_key", "copies").agg(F.min("mix_hash").alias("first"), F.max("mix_hash").alias("last"))
    ends = ends.groupBy("mix_key").agg(F.min("copies").alias("least"), F.max("copies").alias("most"), F.min_by("first", "copies").alias("next_hash"), F.max_by("last", "copies").alias("cut_hash"))
    return ends.withColumn("cut_hash", F.when(F.col("most") > F.col("least"), F.col("cut_hash"))).withColumn("split", F.coalesce(F.col("cut_hash") == F.col("next_hash"), F.lit(False))).drop("next_hash")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_repeats: int = 3, budget: int | None = None) -> DataFrame:
    """The mixed documents: each row of ``docs`` as many times as the mix takes it."""
    scheduled = schedule(docs, id_col, text_col, source_col, weights, max_repeats, budget)
    cut = materialize(cuts(scheduled), "mixcut")
    split = cut.filter("split").select("mix_key", "most", "cut_hash")
    names = ["mix_key", "least", "most", "cut_hash", "split"]
    tied = bool(split.take(1))
    if tied:
        at = scheduled.join(split.withColumnsRenamed({"mix_key": "k", "most": "m"}), (F.col("mix_key") == F.col("k")) & (F.col("mix_hash") == F.col("cut_hash")))
        more = at.groupBy("mix_key").agg(F.count_if(F.col("copies") == F.col("m")).alias("more"))
        cut, names = materialize(cut.join(more, "mix_key", "left"), "mixcut"), [*names, "more"]
    # rows travel as one column, so no name of theirs can clash
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, _order_hash(F.col(f"`{id_col}`"), word_count(F.col(f"`{text_col}`"))).alias("hash"), _key(F.col(f"`{source_col}`")).alias("mix_key"))
    rows = rows.join(cut.select(*names), "mix_key")
    at_cut = F.col("split") & (F.col("hash") == F.col("cut_hash"))
    n = F.when(F.col("hash") <= F.col("cut_hash"), F.col("most")).otherwise(F.col("least"))
    out = _copies(rows.filter(~at_cut) if tied else rows, n)
    return out.unionByName(_tied(rows.filter(at_cut))) if tied else out


def _copies(rows: DataFrame, n: Column) -> DataFrame:
    """Each row n times."""
    rows = rows.select("row", n.cast("int").alias("n")).filter(F.col("n") > 0)
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")


def _tied(rows: DataFrame) -> DataFrame:
    """Copies of the rows at the cut: the first ``more`` of each source get one more than the others.

    Equal rows of a partition are counted as one, so that a row repeated very often is neither
    sorted nor written by one task.
    """
    keys = ["mix_key", "same", "part"]
    rows = rows.withColumn("same", F.sha2(F.to_json("row", EXACT), 256)).withColumn("part", F.spark_partition_id())
    some = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.any_value("row").alias("row"), *[F.max(c).alias(c) for c in ("least", "most", "more")])
    upto = F.sum("n").over(W.partitionBy(keys[0]).orderBy(*keys[1:]).rowsBetween(W.unboundedPreceding, W.currentRow))
    first = F.greatest(F.least(F.col("more") - (upto - F.col("n")), F.col("n")), F.lit(0))
    some = some.withColumn("total", F.col("least") * F.col("n") + first * (F.col("most") - F.col("least"))).repartition(*keys)
    return _copies(some, F.col("total"))


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document, in the mix's order."""
    s = schedule(docs)
    return s.select(F.col("mix_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


#: The same result in DuckDB SQL: plain running sums, an iterated resharing, and all copies sorted.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT ROW_NUMBER() OVER () AS row_id, doc_id, source, n AS size, md5(concat_ws('|', CAST(doc_id AS VARCHAR), CAST(n AS VARCHAR))) AS h
  FROM (SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n FROM documents)
), s AS (
  SELECT source, SUM(size) AS sz, CASE (ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 2.0 ELSE 3.0 END AS w
  FROM d GROUP BY source
), r AS (
  SELECT 0 AS k, source, sz, w, false AS capped FROM s
  UNION ALL
  SELECT k + 1, source, sz, w, capped OR 3 * sz * SUM(CASE WHEN capped THEN 0 ELSE w END) OVER () < w * (SUM(sz) OVER () - SUM(CASE WHEN capped THEN 3 * sz ELSE 0 END) OVER ())
  FROM r WHERE k < 60
), t AS (
  SELECT source, sz, CASE WHEN capped THEN CAST(3 * sz AS DOUBLE)
    ELSE w * CAST(SUM(sz) OVER () - SUM(CASE WHEN capped THEN 3 * sz ELSE 0 END) OVER () AS DOUBLE) / SUM(CASE WHEN capped THEN 0 ELSE w END) OVER () END AS target
  FROM r WHERE k = 60
), c AS (
  SELECT d.*, t.sz, t.target, SUM(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size / 2.0::DOUBLE AS mid
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), x AS (
  SELECT c.*, (mid + round * sz) / NULLIF(target, 0) AS finish FROM c, (VALUES (0), (1), (2)) v(round) WHERE size > 0
), y AS (
  SELECT row_id, SUM(size) OVER (ORDER BY finish, h, source NULLS LAST ROWS UNBOUNDED PRECEDING) <= (SELECT SUM(size) FROM d) AS taken FROM x
), z AS (SELECT row_id, COUNT(*) FILTER (WHERE taken) AS copies FROM y GROUP BY row_id)
SELECT c.doc_id, c.size, CAST(c.sz AS BIGINT) AS source_size, c.target, CAST(c.size * COALESCE(z.copies, 0) AS BIGINT) AS taken
FROM c LEFT JOIN z ON z.row_id = c.row_id
"""
