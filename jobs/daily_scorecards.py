"""Graded rows and mergeable scorecard counts of every announcement day, brought up to date.

    python -m jobs.daily_scorecards --events PATH --output PATH [--config FILE]

The events of each entity are its level series, and its documents are announced on their day; what
the models extracted from them is graded against the shifts that follow within the window.
A day is open until every window that begins on it has ended; a run grades the days that are open
and reads only their events: it starts from the high-water mark, the first open day, and from the
level that each entity had before it.

Output, in Parquet: ``graded`` (a row per document and model) and ``counts`` (integer counts per
model, prompt and bank), both partitioned by announcement day, and ``state``, partitioned by
mark: each entity's last level before the mark.  A run replaces the days from its mark on and adds
the state of its new mark last, so a run that breaks off is simply done again from the old mark,
and one without new events writes the same rows again.  Scorecards of any period are rolled up from
the counts; no closed day is graded again.  Events that arrive for a closed day are too late, and
events without a time have no day: neither takes part.
"""

from __future__ import annotations

import argparse
import datetime as dt
import logging
import os
import sys
from dataclasses import replace

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.operators import grading, scorecard, series
from assayer.plans.audit import KEYS, ORDER, RULES, artifacts_of, bank, levels_of
from jobs.common import log_to_stderr, own_settings, session, settings, table_at

log = logging.getLogger("jobs.daily_scorecards")
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
GRADED = (
    "doc_id string, bank string, model_key string, prompt_version string, status string, expected_kind string, action_correct boolean, fabricated_decision boolean, "
    "wrong_direction boolean, change_bps string, level string, effective_date string, decision_date string, announcement_date date"
)
STATE = "user_id long, level double, mark date"
DAY = "announcement_date"


def counts_of(graded: DataFrame) -> DataFrame:
    return graded.groupBy("model_key", "prompt_version", "bank", DAY).agg(*scorecard.scorecard_counts())


def replace_days(rows: DataFrame, path: str, by: str = DAY) -> None:
    """Write the rows' partitions in place of those of that name; all others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def grade_days(events: DataFrame, before: DataFrame, mark: dt.date | None, config: dict) -> DataFrame:
    """Graded rows of the documents of ``events``, which begin at the mark; ``before``: levels as the mark found them."""
    rules = replace(RULES, window_days={k: int(v) for k, v in config["window_days"].items()})
    levels = levels_of(events)
    if mark:
        # the level an entity came with stands just before the mark, so only a move away from it is a shift
        came = before.select("user_id", (F.lit(mark).cast("timestamp_ntz") - F.expr("INTERVAL 1 MICROSECOND")).alias("ts"), F.lit(None).cast("long").alias("event_id"), "level")
        levels = levels.unionByName(came)
    steps = series.level_shifts(levels, KEYS, ORDER, first=True).withColumn("effective_date", F.col("ts").cast("date")).withColumn("bank", bank())
    steps = series.classify_shifts(steps, rules, area="bank").withColumn("ref_area", F.col("bank"))
    rows = artifacts_of(events)
    calendar = rows.select("bank", "user_id", DAY)
    return grading.grade(rows, steps, calendar, rules, ("effective_date", *ORDER), tuple(KEYS), empty_series=True, firsts=True)


def run(spark: SparkSession, events: str, output: str, config: dict) -> DataFrame:
    """Bring the output up to date and return all its graded rows."""
    state = table_at(spark, f"{output}/state", STATE, ["mark"])
    graded = table_at(spark, f"{output}/graded", GRADED, [DAY])
    mark = state.agg(F.max("mark")).first()[0]
    new = spark.read.schema(EVENTS).parquet(events).filter("ts IS NOT NULL")
    new = new.filter(F.col("ts") >= F.lit(mark).cast("timestamp_ntz")) if mark else new
    before = state.filter(F.col("mark") == F.lit(mark))
    n, last = new.agg(F.count(F.lit(1)), F.max("ts").cast("date")).first()
    log.info("read %d events from %s on, of %s", n, mark or "the start", events)
    if not n:
        return graded
    replace_days(grade_days(new, before, mark, config).select(*[f.name for f in graded.schema]), f"{output}/graded")
    days = spark.read.schema(GRADED).parquet(f"{output}/graded")
    written = days.filter(F.col(DAY) >= F.lit(mark)) if mark else days
    replace_days(counts_of(written), f"{output}/counts")
    rows, first = written.agg(F.count(F.lit(1)), F.min(DAY)).first()
    log.info("wrote %d graded rows of the days from %s to %s", rows, first, last)
    until = last - dt.timedelta(days=max(map(int, config["window_days"].values())))
    if not mark or until > mark:
        closed = levels_of(new).filter((F.col("ts") < F.lit(until).cast("timestamp_ntz")) & F.col("level").isNotNull())
        closed = closed.select("user_id", F.struct(F.lit(1).alias("new"), *ORDER).alias("at"), "level")
        came = before.select("user_id", F.struct(F.lit(0).alias("new"), F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(None).cast("long").alias("event_id")).alias("at"), "level")
        levels = closed.unionByName(came).groupBy("user_id").agg(F.max_by("level", "at").alias("level"))
        replace_days(levels.withColumn("mark", F.lit(until)), f"{output}/state", "mark")
        log.info("days before %s are closed", until)
    for r in scorecard.ranking(cards(spark, output)).collect():
        log.info("%s: %d graded, actions %.4f, hallucinations %.4f", r["model_key"], r["graded"], r["action_rate"] or 0, r["hallucination_rate"] or 0)
    return days


def cards(spark: SparkSession, output: str, by: tuple[str, ...] = ("model_key",), since: dt.date | None = None) -> DataFrame:
    """Scorecards of all stored days, or of those from a day on, from their counts."""
    counts = spark.read.parquet(f"{output}/counts")
    return scorecard.rollup(counts.filter(F.col(DAY) >= F.lit(since)) if since else counts, by)


def regressions(spark: SparkSession, output: str, since: dt.date, config: dict) -> DataFrame:
    """Models whose rates from a day on have fallen behind those before it, from the counts."""
    counts = spark.read.parquet(f"{output}/counts").withColumn("late", F.col(DAY) >= F.lit(since))
    return scorecard.period_gate(scorecard.rollup(counts, ("model_key", "late")), F.col("late"), ["model_key"], ["action_rate"], float(config["tolerance"])).filter("degraded")


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("--events", "--output"):
        p.add_argument(name, required=True)
    p.add_argument("--config", help="a TOML file; jobs/daily_scorecards.toml if not given")
    p.add_argument("--since", type=dt.date.fromisoformat, help="also log regressions from this day on")
    a = p.parse_args(args)
    log_to_stderr()
    spark = session("daily_scorecards")
    try:
        config = settings(spark, a.config) if a.config else own_settings("daily_scorecards")
        run(spark, a.events, a.output, config)
        for r in regressions(spark, a.output, a.since, config).collect() if a.since else []:
            log.warning("%s: %s fell from %.4f to %.4f", r["model_key"], r["metric"], r["baseline"], r["current"])
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
