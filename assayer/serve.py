"""Read paths of a service as functions that return DataFrames; HTTP itself is left to the caller."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.operators.store import last_wins
from assayer.types import BANKS, SCHEMA_VERSION

IDENTIFIER = re.compile(r"[A-Za-z0-9._-]+")
MOST_TEXT = 200_000


class BadRequest(ValueError):
    """What a caller asked for is malformed."""


def check_identifier(value: str) -> str:
    if not IDENTIFIER.fullmatch(value or ""):
        raise BadRequest(f"malformed identifier {value!r}")
    return value


def check_limit(limit: int, most: int) -> int:
    if not 1 <= limit <= most:
        raise BadRequest(f"limit must be from 1 to {most}")
    return limit


def health() -> dict:
    return {"status": "ok", "schema_version": SCHEMA_VERSION}


def decisions(graded: DataFrame, records: DataFrame, bank: str | None = None, date_from: dt.date | None = None, date_to: dt.date | None = None, status: str | None = None, limit: int = 500, order: str = "doc_id", generation: str | None = None) -> DataFrame:
    """Graded rows with the record of each document's latest run, filtered, first ``limit`` in order.

    Filters are those given (inclusive dates) and reach the scan; the limit is taken before
    the records are joined, so only the rows returned look theirs up.
    """
    check_limit(limit, 2000)
    if bank and bank not in BANKS:
        raise BadRequest(f"bank must be one of {BANKS}")
    day = F.col("announcement_date").cast("date")
    for want, cond in ((bank, F.col("bank") == bank), (date_from, day >= F.lit(date_from)), (date_to, day <= F.lit(date_to)), (status, F.col("status") == status)):
        graded = graded.filter(cond) if want else graded
    top = graded.orderBy(order).limit(limit)
    # at most 2,000 ids, so they may be broadcast: only their records are read further
    records = records.join(F.broadcast(top.select("doc_id").distinct()), "doc_id", "left_semi")
    latest = last_wins(records, ["doc_id"], generation) if generation else records
    return top.join(latest.select("doc_id", "record"), "doc_id", "left").orderBy(order)


def scorecards(cards: DataFrame, model_key: str | None = None) -> DataFrame:
    out = cards.filter(F.col("model_key") == model_key) if model_key else cards
    if model_key and out.isEmpty():
        raise LookupError(f"no scorecard for model {model_key}")
    return out


def recent_traces(traces: DataFrame | None, spark: SparkSession, schema, limit: int = 50) -> DataFrame:
    """The newest traces; none if nothing was ever traced."""
    check_limit(limit, 500)
    return spark.createDataFrame([], schema) if traces is None else traces.orderBy(F.desc("id")).limit(limit)


def resolve_request(doc_id: str | None, bank: str | None, text: str | None, today: dt.date) -> dict:
    """What an extraction request means: a catalogued document, or text given with its bank."""
    if doc_id:
        return {"doc_id": check_identifier(doc_id)}
    if not text or bank not in BANKS:
        raise BadRequest("give doc_id, or a bank with text")
    if len(text) > MOST_TEXT:
        raise BadRequest(f"text is longer than {MOST_TEXT}")
    return {"doc_id": "adhoc", "bank": bank, "announcement_date": today, "url": "", "doc_type": "statement", "text": text}
