"""Level series: gap filling, shifts, and step-function look-ups.

A series is keyed by one or more columns.  One long series (a hot key) must not be one task: long
tables are cut into blocks of sorted rows, within a key and a time too, and what a block takes
over from those before it is carried on (:mod:`assayer.operators.ranges`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.operators.ranges import Bounds, bounds, carry
from assayer.rules import DEFAULT_RULES, GradingRules


def clean_level(raw: Column) -> Column:
    """A level from text or number: what is no number, or NaN, is missing."""
    return F.nanvl(raw.try_cast("double"), F.lit(None).cast("double"))


def ffill(df: DataFrame, keys: list[str], order: list[str], value: str = "level", cuts: Bounds | None = None) -> DataFrame:
    """Forward fill; rows before a series' first value are dropped.

    ``cuts``: the blocks of the table or of one that it is part of, if they are known already.
    """
    out = carry(df, cuts or bounds(df, keys, order), [value], upto="_filled")
    return out.filter(F.col(f"{value}_filled").isNotNull()).drop(value).withColumnRenamed(f"{value}_filled", value)


def level_shifts(df: DataFrame, keys: list[str], order: list[str], value: str = "level", first: bool = False, cuts: Bounds | None = None) -> DataFrame:
    """Rows whose filled level differs from that of the row before: old_level, new_level, change_bps, direction.

    With ``first``, a series' first level counts too, with a null old_level, change_bps and direction.
    """
    out = carry(df, cuts or bounds(df, keys, order), [value], upto="_filled", beside="_before")
    old, new = F.col(f"{value}_before"), F.col(f"{value}_filled")
    out = out.filter(~old.eqNullSafe(new) if first else old.isNotNull() & (new != old))
    out = out.drop(value).withColumnsRenamed({f"{value}_before": "old_level", f"{value}_filled": "new_level"})
    out = out.withColumn("change_bps", F.rint((F.col("new_level") - F.col("old_level")) * 100).cast("int"))
    return out.withColumn("direction", F.when(F.col("change_bps") > 0, "hike").when(F.col("change_bps") <= 0, "cut"))


def regime(date: Column, regimes) -> Column:
    """Name of the last regime that starts by the date; the first one before all starts."""
    out = F.lit(regimes[0][1])
    for start, name in regimes:
        out = F.when(date >= F.lit(start), F.lit(name)).otherwise(out)
    return out


def classify_shifts(shifts: DataFrame, rules: GradingRules = DEFAULT_RULES, area: str = "ref_area", date: str = "effective_date") -> DataFrame:
    """Adds instrument, excluded, exclusion_reason, audit_note; excluded shifts are kept."""
    a, d = F.col(area), F.col(date)
    special = a == rules.regime_area
    early = F.lit(None).cast("string")
    for k, start in rules.window_start.items():
        early = F.when((a == k) & (d < F.lit(start)), F.lit(f"outside project window (before {start})")).otherwise(early)
    redefined = F.when(special & d.isin(*rules.redefinition_dates), rules.redefinition_reason)
    reason = F.coalesce(early, redefined)
    return shifts.select(
        "*",
        F.when(special, regime(d, rules.regimes)).otherwise(rules.other_instrument).alias("instrument"),
        reason.isNotNull().alias("excluded"),
        reason.alias("exclusion_reason"),
        F.when(special & d.isin(*rules.audit_dates), rules.audit_note).alias("audit_note"),
    )


def golden_summary(events: DataFrame, area: str = "ref_area") -> DataFrame:
    """Per area: shifts kept and excluded, first and last date of those kept."""
    kept = ~F.col("excluded")
    d = F.when(kept, F.col("effective_date"))
    return events.groupBy(area).agg(F.count_if(kept).alias("n_events"), F.count_if(F.col("excluded")).alias("n_excluded"), F.min(d).alias("first_date"), F.max(d).alias("last_date"))


def validity_intervals(shifts: DataFrame, keys: list[str], order: list[str], date: str = "effective_date", cuts: Bounds | None = None) -> DataFrame:
    """Adds valid_to, the next shift's date (null for the last): half-open validity intervals."""
    return carry(shifts, cuts or bounds(shifts, keys, order), [date], beside="_next", backward=True).withColumnRenamed(f"{date}_next", "valid_to")


def as_of(left: DataFrame, shifts: DataFrame, keys: list[str], left_date: str, order: list[str], date: str = "effective_date") -> DataFrame:
    """Adds prevailing_level to ``left``: the new level of the last shift on or before its date.

    Before the first shift it is that shift's old level; without shifts it is null.  Shifts and
    questions first become one row per key and day, the day's last level, so a series is as long as
    its calendar at most, whatever the number of its rows; levels are carried along these days,
    and rows find theirs by key and day.
    """
    ks = [f"_k{i}" for i in range(len(keys))]
    key = [F.col(k).alias(n) for k, n in zip(keys, ks)]
    steps = shifts.select(*key, F.col(date).cast("date").alias("_day"), F.struct(date, *order).alias("_o"), "old_level", "new_level")
    steps = steps.groupBy(*ks, "_day").agg(F.max_by("new_level", "_o").alias("_level"), F.min_by("old_level", "_o").alias("_old"), F.lit(True).alias("_step"))
    asked = left.select(*key, F.col(left_date).cast("date").alias("_day")).distinct()
    asked = asked.select("*", F.lit(None).cast("double").alias("_level"), F.lit(None).cast("double").alias("_old"), F.lit(False).alias("_step"))
    days = steps.unionByName(asked).groupBy(*ks, "_day").agg(F.max("_level").alias("_level"), F.max("_old").alias("_old"), F.bool_or("_step").alias("_step"))
    line = W.partitionBy(*ks).orderBy("_day")
    first = F.first(F.when(F.col("_step"), F.struct("_old")), True).over(line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))["_old"]
    level = F.last(F.when(F.col("_step"), F.struct("_level")), True).over(line.rowsBetween(W.unboundedPreceding, W.currentRow))["_level"]
    found = days.select(*ks, "_day", F.coalesce(level, first).alias("prevailing_level"))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{n}")) for k, n in zip(keys, ks)] + [F.col(f"l.{left_date}").cast("date").eqNullSafe(F.col("r._day"))]
    return left.alias("l").join(found.alias("r"), same, "left").select("l.*", "prevailing_level")
