"""Connectors: remote pages and series.  Everything relational about them is elsewhere.

``get`` is any callable from a URL to text, so tests and offline runs pass their own.
"""

from __future__ import annotations

import datetime as dt
import time
import urllib.parse
import urllib.request
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from assayer import types as t
from assayer.functions import text as tx
from assayer.functions.html import anchors
from assayer.operators.store import coverage_gaps, first_per_year, first_wins, require_sample

#: Public addresses of the index pages and of the series.
SERIES_URL = "https://stats.bis.org/api/v2/data/dataflow/BIS/WS_CBPOL/1.0/D.{ref_area}"
SERIES_START = "1998-12-01"
REF_AREAS = ("US", "XM")
FED_URL, ECB_URL = "https://www.federalreserve.gov", "https://www.ecb.europa.eu"
FED_CALENDAR_PAGE, FED_YEAR_PAGE = "/monetarypolicy/fomccalendars.htm", "/monetarypolicy/fomchistorical{year}.htm"
ECB_YEAR_PAGE = "/press/govcdec/mopo/{year}/html/index_include.en.html"
REF = "bank", "doc_id", "announcement_date", "url", "doc_type"


def http_get(url: str, timeout: float = 60.0) -> str:
    """A page's text, asked for compressed as large series are slow otherwise."""
    import gzip

    ask = urllib.request.Request(url, headers={"User-Agent": "Mozilla/5.0", "Accept-Encoding": "gzip"})
    with urllib.request.urlopen(ask, timeout=timeout) as r:
        body = r.read()
        return (gzip.decompress(body) if r.headers.get("Content-Encoding") == "gzip" else body).decode("utf-8")


def with_retries(get: Callable[[str], str], url: str, retries: int = 3, sleep: Callable[[float], None] = time.sleep) -> str:
    """Try again after 1, 2, 4 ... seconds; the last error is raised."""
    for attempt in range(retries):
        try:
            return get(url)
        except OSError:
            if attempt == retries - 1:
                raise
            sleep(2**attempt)
    raise ValueError("retries must be positive")


def fetch_series(ref_area: str, start: str = SERIES_START, get: Callable[[str], str] = http_get, retries: int = 3) -> str:
    """The CSV text of one area's daily series."""
    if ref_area not in REF_AREAS:
        raise ValueError(f"area {ref_area!r} is none of {REF_AREAS}")
    query = urllib.parse.urlencode({"format": "csv", "startPeriod": start})
    return with_retries(get, SERIES_URL.format(ref_area=ref_area) + "?" + query, retries)


def uncached(refs: DataFrame, cache: DataFrame) -> DataFrame:
    """References whose page is not in the cache: all that a fetch needs to ask for."""
    return refs.join(cache.select("doc_id"), "doc_id", "left_anti")


#: Pages of a host that one task asks for: what a lost task has to ask for again.
ROUND = 500


def fetch_pages(refs: DataFrame, path: str, get: Callable[[str], str] = http_get, delay: float = 0.5, retries: int = 3, sleep: Callable[[float], None] = time.sleep, round_pages: int = ROUND) -> DataFrame:
    """Append the pages of references (doc_id, url) to a table, and return what was asked for this time.

    A host's pages are asked for by one task, one polite request after the other; hosts go side by
    side.  A page goes to the table from the task that fetched it and never passes the driver, and
    failures are rows with an error.  Hosts of many pages take several rounds, whose tasks' pages
    are in place when the task ends, so a crawl that breaks off keeps what it has.
    """
    spark = refs.sparkSession
    host = F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit(""))
    asked = refs.select("doc_id", "url").dropDuplicates(["doc_id"]).withColumn("host", host)
    place = F.row_number().over(W.partitionBy("host").orderBy("doc_id")) - 1
    asked = asked.withColumn("round", F.floor(place / round_pages).cast("int"))

    def call(batches):
        for pdf in batches:
            for doc_id, url, name in zip(pdf["doc_id"], pdf["url"], pdf["host"]):
                try:
                    html, error = with_retries(get, url, retries, sleep), None
                except OSError as e:
                    html, error = None, f"{type(e).__name__}: {e}"
                yield pd.DataFrame({"doc_id": [doc_id], "url": [url], "host": [name], "html": [html], "error": [error], "fetched_at": [pd.Timestamp.now(tz="UTC")]})
                sleep(delay)

    began = dt.datetime.now(dt.UTC)
    table_schema = StructType.fromDDL(t.PAGES)
    spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in table_schema]).write.mode("append").parquet(path)
    for row in asked.groupBy("round").agg(F.count_distinct("host").alias("hosts")).orderBy("round").collect():
        mine = asked.filter(F.col("round") == row["round"]).repartition(row["hosts"], "host").sortWithinPartitions("host", "doc_id")
        pages = mine.select("doc_id", "url", "host").mapInPandas(call, t.PAGES)
        pages.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)
    return spark.read.schema(t.PAGES).parquet(path).filter(F.col("fetched_at") >= F.lit(began))


def pages_of(spark: SparkSession, urls: list[str], get: Callable[[str], str] = http_get) -> DataFrame:
    """Index pages (a few dozen) as (page, url, html), in order."""
    return spark.createDataFrame([(k, u, with_retries(get, u)) for k, u in enumerate(urls)], "page int, url string, html string")


def _refs(links: DataFrame, ref, bank: str, base: str) -> DataFrame:
    found = links.withColumn("_r", ref).filter(F.col("_r").isNotNull())
    rows = found.select("page", "seq", F.lit(bank).alias("bank"), "_r.doc_id", "_r.announcement_date", F.concat(F.lit(base), F.col("href")).alias("url"), "_r.doc_type")
    return first_wins(rows, ["doc_id"], "page", "seq").select(*REF)


def fed_statements(calendar: DataFrame, historical: DataFrame) -> DataFrame:
    """Statement references of the calendar page and the yearly pages, first mention first."""
    parts = []
    for k, (pages, word, patterns) in enumerate(((calendar, "HTML", tx.FED_CALENDAR), (historical, "Statement", tx.FED_HISTORICAL))):
        links = anchors(pages).withColumn("page", F.col("page") + k * 10_000)
        links = links.withColumn("_ref", tx.fed_statement(F.col("text"), F.col("href"), word, patterns))
        parts.append(links)
    both = parts[0].unionByName(parts[1])
    return _refs(both, F.col("_ref"), "FED", FED_URL).orderBy("announcement_date", "doc_id")


def verify_coverage(statements: DataFrame, this_year: int, first: int = 2000, least: int = 4) -> None:
    gaps = [r["year"] for r in coverage_gaps(statements, "announcement_date", first, this_year - 1, least).orderBy("year").collect()]
    if gaps:
        raise RuntimeError(f"fewer than {least} statements in {gaps}: an index page has moved")


def fed_minutes(calendar: DataFrame, historical: DataFrame, years: list[int]) -> DataFrame:
    """Minutes of the first meeting of each sampled year."""
    parts = []
    for k, (pages, word) in enumerate(((calendar, "HTML"), (historical, "Minutes"), (historical, "HTML"))):
        links = anchors(pages).withColumn("page", F.col("page") + k * 10_000)
        parts.append(links.withColumn("_ref", tx.fed_minutes(F.col("text"), F.col("href"), word, F.col("context"))))
    refs = _refs(parts[0].unionByName(parts[1]).unionByName(parts[2]), F.col("_ref"), "FED", FED_URL)
    refs = refs.withColumn("meeting", F.to_date(F.regexp_replace("doc_id", "^fed_min_", ""), "yyyyMMdd"))
    sample = first_per_year(refs, "meeting", years, "doc_id")
    return require_sample(sample, years, "meeting").select(*REF).orderBy("doc_id")


def ecb_references(pages: DataFrame, traps: bool) -> DataFrame:
    """Decisions, or the releases and accounts that are none."""
    ref = tx.ecb_link(F.col("text"), F.col("in_title"), F.col("href"), F.col("iso_date"))
    wanted = F.when((F.col("_l.doc_type") != "decision") if traps else (F.col("_l.doc_type") == "decision"), F.col("_l"))
    return _refs(anchors(pages).withColumn("_l", ref), wanted, "ECB", ECB_URL).orderBy("announcement_date", "doc_id")


# ---- whole enumerations ---------------------------------------------------------------------

#: Years with an index page of their own, years whose first minutes are sampled, and
#: the first year of the other bank's list.
FED_YEARS, MINUTES_YEARS, ECB_FIRST_YEAR = tuple(range(2000, 2021)), tuple(range(2000, 2025)), 1999


def fed_indexes(spark: SparkSession, get: Callable[[str], str] = http_get, years: Iterable[int] = FED_YEARS) -> tuple[DataFrame, DataFrame]:
    """The calendar page and the yearly pages."""
    return pages_of(spark, [FED_URL + FED_CALENDAR_PAGE], get), pages_of(spark, [FED_URL + FED_YEAR_PAGE.format(year=y) for y in years], get)


def ecb_indexes(spark: SparkSession, last_year: int, get: Callable[[str], str] = http_get, first_year: int = ECB_FIRST_YEAR) -> DataFrame:
    return pages_of(spark, [ECB_URL + ECB_YEAR_PAGE.format(year=y) for y in range(first_year, last_year + 1)], get)


def enumerate_decisions(spark: SparkSession, this_year: int, bank: str = "all", get: Callable[[str], str] = http_get, fed_years: Iterable[int] = FED_YEARS, ecb_first: int = ECB_FIRST_YEAR, check: bool = True) -> DataFrame:
    """References of all statements and decisions of one bank or both; years with too few statements fail."""
    parts = []
    if bank in ("FED", "all"):
        parts.append(fed_statements(*fed_indexes(spark, get, fed_years)))
        if check:
            verify_coverage(parts[0], this_year)
    if bank in ("ECB", "all"):
        parts.append(ecb_references(ecb_indexes(spark, this_year, get, ecb_first), traps=False))
    return reduce(DataFrame.unionByName, parts)


def enumerate_traps(spark: SparkSession, this_year: int, get: Callable[[str], str] = http_get, fed_years: Iterable[int] = FED_YEARS, sampled: Iterable[int] = MINUTES_YEARS, ecb_first: int = ECB_FIRST_YEAR) -> DataFrame:
    """References of documents that announce no decision: sampled minutes, accounts and other releases."""
    minutes = fed_minutes(*fed_indexes(spark, get, fed_years), list(sampled))
    return minutes.unionByName(ecb_references(ecb_indexes(spark, this_year, get, ecb_first), traps=True))
