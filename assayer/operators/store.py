"""Keyed merges and idempotent ledgers.

First and last always mean an explicit sequence column, never the order rows happen to be in.
All picks are partially aggregated extremes of a struct, so a hot key is no hot task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: list[str], order: list[Column], last: bool) -> DataFrame:
    """One whole row per key: that with the smallest (or largest) order, by its content among equals."""
    cols = [F.col(f"`{c}`") for c in df.columns]
    agg = (F.max_by if last else F.min_by)(F.struct(*cols), F.struct(*order, F.to_json(F.struct(*cols))))
    return df.groupBy(*keys).agg(agg.alias("_row")).select("_row.*")


def first_wins(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row per key, the first by ``order``."""
    return _pick(df, keys, [F.col(o) for o in order], False)


def last_wins(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row per key, the last by ``order``."""
    return _pick(df, keys, [F.col(o) for o in order], True)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Rows of both, by key: new wins over old, the last by ``order`` within each; repeating it changes nothing."""
    both = old.withColumn("_gen", F.lit(0)).unionByName(new.withColumn("_gen", F.lit(1)))
    return _pick(both, keys, [F.col("_gen"), *[F.col(o) for o in order]], True).drop("_gen")


def merge_precedence(tables: list[DataFrame], keys: list[str], *order: str) -> DataFrame:
    """Union by key in which later tables win (a trap catalogue over the decisions), and within one the last by ``order``."""
    both = tables[0].withColumn("_rank", F.lit(0))
    for k, t in enumerate(tables[1:], 1):
        both = both.unionByName(t.withColumn("_rank", F.lit(k)))
    return _pick(both, keys, [F.col("_rank"), *[F.col(o) for o in order]], True).drop("_rank")


def filtered_replace(old: DataFrame, new: DataFrame, column: str, value) -> DataFrame:
    """``new`` in place of the rows of one partition value; all others stay."""
    return old.filter(~F.col(column).eqNullSafe(F.lit(value))).unionByName(new)


def missing(requested: DataFrame, returned: DataFrame, key: str) -> DataFrame:
    """Distinct requested keys that did not come back."""
    return requested.select(key).distinct().join(returned.select(key), key, "left_anti")


def ledger_entries(rows: DataFrame, run: str = "run_id", by: tuple[str, ...] = ("model_key", "prompt_version")) -> DataFrame:
    """One ledger row per run: documents, tokens, cost rounded to six places."""
    return rows.groupBy(run, *by).agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum("input_tokens").cast("long").alias("input_tokens"),
        F.sum("output_tokens").cast("long").alias("output_tokens"),
        F.round(F.sum("cost_usd"), 6).alias("cost_usd"),
    )


def append_once(ledger: DataFrame, entries: DataFrame, run: str = "run_id") -> DataFrame:
    """Entries of runs that the ledger does not have yet."""
    return entries.join(ledger.select(run).filter(F.col(run).isNotNull()), run, "left_anti")


def run_summary(rows: DataFrame) -> DataFrame:
    """Rows, successes, failures and cost of a run."""
    ok = F.coalesce(F.col("ok"), F.lit(False))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failures"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"))


def requested_lookup(requested: DataFrame, catalogs: DataFrame, key: str = "doc_id", position: str = "position", strict: bool = False) -> DataFrame:
    """Requested keys in their order with their catalogue row; ``strict`` fails on an unknown one."""
    out = requested.join(catalogs.withColumn("_known", F.lit(True)), key, "left")
    if strict:
        known = F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit("unknown "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)
        out = out.filter(known)
    return out.drop("_known").orderBy(position)


def first_per_year(rows: DataFrame, date: str, years: list[int] | None = None, tie: str | None = None) -> DataFrame:
    """The earliest row of each year."""
    rows = rows.withColumn("year", F.year(date))
    rows = rows.filter(F.col("year").isin(*years)) if years else rows
    return first_wins(rows, ["year"], date, *([tie] if tie else []))


def coverage_gaps(rows: DataFrame, date: str, first: int, last: int, least: int) -> DataFrame:
    """Years of [first, last] with fewer than ``least`` rows, years without any included."""
    spark = rows.sparkSession
    years = spark.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    counts = rows.groupBy(F.year(date).alias("year")).agg(F.count(F.lit(1)).alias("n"))
    out = years.join(counts, "year", "left").select("year", F.coalesce("n", F.lit(0)).alias("n"))
    return out.filter(F.col("n") < least)


def require_sample(sample: DataFrame, years: list[int], date: str, latest_month: int = 3) -> DataFrame:
    """Fail if a year has no sampled row, or one later than the month allowed."""
    have = {r["year"]: r["d"] for r in sample.select("year", F.col(date).alias("d")).collect()}
    if gone := [y for y in years if y not in have]:
        raise RuntimeError(f"no documents for {gone}")
    if late := sorted(d for d in have.values() if d.month > latest_month):
        raise RuntimeError(f"first of the year after month {latest_month}: {late}")
    return sample


def pending_guard(states: DataFrame, model_key: str, prompt_version: str, force: bool = False) -> None:
    """Refuse a submission while an uncollected batch of the same model and prompt exists."""
    same = states.filter((F.col("model_key") == model_key) & (F.col("prompt_version") == prompt_version) & ~F.col("collected"))
    found = [] if force else [r["batch_id"] for r in same.select("batch_id").limit(20).collect()]
    if found:
        raise ValueError(f"uncollected batches for {model_key}/{prompt_version}: {sorted(found)}")
