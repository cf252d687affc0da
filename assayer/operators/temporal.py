"""Joining documents to the events that follow them.

The window join is a range join.  Each document's window [d, d + w] and each shift are
dealt to time buckets of w + 1 days, so a window touches at most two buckets and the join is
an equi-join on (key, bucket) with the range as a residual: no key's documents meet all of
its shifts, and a hot key is spread over its buckets.

Calendars are distinct days, so a key has as many rows as there are days, whatever the number of
its documents: the windows over them are bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def next_announcement(calendar: DataFrame, keys: list[str], date: str = "announcement_date") -> DataFrame:
    """Distinct (keys, date) with ``next_date``, the strictly later announcement.

    The calendar is that of all announcements, not of the documents being graded.
    """
    days = calendar.select(*keys, F.col(date).cast("date").alias(date)).distinct()
    return days.withColumn("next_date", F.lead(date).over(W.partitionBy(*keys).orderBy(date)))


def window_candidates(docs: DataFrame, shifts: DataFrame, keys: list[str], days: Column | int, most_days: int, date: str = "announcement_date", effective: str = "effective_date") -> DataFrame:
    """docs joined to the shifts of the same key with date <= effective <= date + days.

    Shift columns other than the keys must not clash with document columns.
    """
    days = F.lit(days) if isinstance(days, int) else days
    width = most_days + 1
    slot = lambda d: F.floor(F.unix_date(d) / width)
    a = docs.withColumn("_until", F.date_add(F.col(date), days.cast("int")))
    a = a.withColumn("_slot", F.explode(F.sequence(slot(F.col(date)), slot(F.col("_until")))))
    b = shifts.withColumnsRenamed({k: f"_s_{k}" for k in keys}).withColumn("_s_slot", slot(F.col(effective)))
    cond = [F.col(k) == F.col(f"_s_{k}") for k in keys] + [F.col("_slot") == F.col("_s_slot")]
    cond += [F.col(effective) >= F.col(date), F.col(effective) <= F.col("_until")]
    return a.join(b, cond).drop(*[f"_s_{k}" for k in keys], "_slot", "_s_slot", "_until")


def next_in_calendar(docs: DataFrame, calendar: DataFrame, keys: list[str], date: str = "announcement_date") -> DataFrame:
    """(keys, date, next_date) of all calendar and document dates.

    ``next_date`` is the first *calendar* date strictly after the date: grading a part of the
    documents does not change who owns an event.  One time line of distinct days per key,
    filled backwards.
    """
    days = calendar.select(*keys, F.col(date)).distinct().withColumn("_real", F.lit(1))
    asked = docs.select(*keys, F.col(date)).distinct().withColumn("_real", F.lit(0))
    both = days.unionByName(asked).groupBy(*keys, date).agg(F.max("_real").alias("_real"))
    later = W.partitionBy(*keys).orderBy(F.col(date).desc()).rowsBetween(W.unboundedPreceding, -1)
    real = F.when(F.col("_real") == 1, F.col(date))
    return both.select(*keys, date, F.last(real, True).over(later).alias("next_date"))


def owned(candidates: DataFrame, calendar: DataFrame, keys: list[str], date: str = "announcement_date", effective: str = "effective_date", docs: DataFrame | None = None) -> DataFrame:
    """Adds ``owned``: no calendar announcement of the key lies in (date, effective].

    Documents of the same day own alike.  ``docs``, the documents that the candidates were joined
    from, saves the join from being made once more for their days.
    """
    nxt = next_in_calendar(candidates if docs is None else docs, calendar, keys, date).select(*[F.col(k).alias(f"_n_{k}") for k in keys], F.col(date).alias("_n_date"), "next_date")
    cond = [F.col(k) == F.col(f"_n_{k}") for k in keys] + [F.col(date) == F.col("_n_date")]
    ok = F.col("next_date").isNull() | (F.col("next_date") > F.col(effective))
    return candidates.join(nxt, cond, "left").withColumn("owned", ok).drop(*[f"_n_{k}" for k in keys], "_n_date", "next_date")
