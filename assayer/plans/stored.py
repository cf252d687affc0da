"""Queries over what the engine has written and read back: files of every format it parses, tables of runs, streams.

Each writes the whole of a given table, in the form that the engine's sources have, to a new folder
below ``spark.checkpoint.dir``, and returns what the engine's readers make of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer import types as t
from assayer.operators import series
from assayer.plans.audit import SQL_ART, SQL_CLASSIFIED, artifacts, classified, read
from assayer.sources import readers
from assayer.sources.files import new_folder
from assayer.sources.runs import compact, read_latest, run_name, write_run
from assayer.streaming.catalog import catalog_stream, catalog_table, ingest


def _catalog(spark, sf_dir) -> DataFrame:
    """Orders as a catalogue; texts with commas, quotes and blanks."""
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    bank = F.when(k % 2 == 0, "FED").otherwise("ECB")
    kind = F.when(k % 7 == 0, "minutes").otherwise(F.when(k % 2 == 0, "statement").otherwise("decision"))
    return o.select(bank.alias("bank"), F.concat(F.lit("d"), k.cast("string")).alias("doc_id"), F.col("o_orderdate").cast("date").alias("announcement_date"), F.concat(F.lit('/x, "'), F.col("o_orderpriority"), F.lit('".htm')).alias("url"), kind.alias("doc_type"))


def q_catalog_file(spark, sf_dir):
    path = new_folder(spark, "catalog")
    _catalog(spark, sf_dir).write.options(**t.CSV).csv(path)
    return readers.read_catalog(spark, path).select(*t.CATALOG.names)


def q_golden_file(spark, sf_dir):
    """Classified shifts as a golden file; flags as True and False."""
    path = new_folder(spark, "golden")
    rows = classified(spark, sf_dir).withColumn("ref_area", F.concat_ws("-", "bank", F.col("user_id").cast("string"), F.col("event_id").cast("string")))
    text = [F.initcap(F.col(f.name).cast("string")).alias(f.name) if f.name == "excluded" else F.col(f.name) for f in t.GOLDEN]
    rows.select(*text).write.options(**t.CSV).csv(path)
    return readers.read_golden(spark, path).select(*t.GOLDEN.names)


def q_series_file(spark, sf_dir):
    """Each day's last value of the even and of the odd entities as two series files with other columns, and their shifts."""
    e = read(spark, sf_dir, "events")
    area = F.when(F.col("user_id") % 2 == 0, "US").otherwise("XM")
    last = e.groupBy(area.alias("area"), F.col("ts").cast("date").alias("TIME_PERIOD")).agg(F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("x"))
    said = F.when(F.col("x.event_id") % 5 == 0, "NaN").when(F.col("x.event_id") % 5 == 1, "n/a").otherwise((F.floor(F.col("x.value") / 50) * 0.25).cast("string"))
    out = None
    for name in ("US", "XM"):
        path = new_folder(spark, "series")
        last.filter(F.col("area") == name).select(F.lit("D").alias("FREQ"), "TIME_PERIOD", F.lit('a, "b"').alias("TITLE"), said.alias("OBS_VALUE")).write.options(**t.CSV).csv(path)
        levels = readers.read_sdmx(spark, path, name)
        out = levels if out is None else out.unionByName(levels)
    return series.level_shifts(out, ["ref_area"], ["date"]).select("ref_area", "date", "old_level", "new_level", "change_bps", "direction")


def q_artifact_lines(spark, sf_dir):
    """Artifacts as JSON lines, read by their declared schema."""
    path = new_folder(spark, "artifacts")
    a = artifacts(spark, sf_dir)
    record = F.when(F.col("record").isNotNull(), F.struct(*[(F.col(f"record.{f.name}") if f.name in a.schema["record"].dataType.names else F.lit(None)).cast(f.dataType).alias(f.name) for f in t.ARTIFACT["record"].dataType]))
    a = a.withColumns({"record": record, "announcement_date": F.col("announcement_date").cast("string"), "schema_version": F.lit(t.SCHEMA_VERSION), "error": F.when(~F.col("ok"), 'a "b"\n\\c'), "latency_ms": F.lit(None).cast("int")})
    a.select(*t.ARTIFACT.names).write.option("ignoreNullFields", False).json(path)
    got = readers.read_artifacts(spark, path)
    fields = [F.col(f"record.{c}").alias(c) for c in ("action", "change_bps", "effective_date", "dfr_pct")]
    return got.select("doc_id", "bank", "announcement_date", "model_key", "ok", "error", "input_tokens", "output_tokens", *fields)


def q_runs(spark, sf_dir):
    """Events in four runs, the third done twice, the first two compacted; merged on read by entity."""
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    path, packed = new_folder(spark, "runs"), new_folder(spark, "runs")
    for k in (0, 1, 2, 2, 3):
        write_run(e.filter(F.col("event_id") % 4 == (k * 3) % 4), path, run_name(k))
    compact(spark, path, packed, e.schema, ["user_id"], run_name(1), "event_id")
    return read_latest(spark, packed, e.schema, ["user_id"], "event_id")


def q_stream(spark, sf_dir):
    """The catalogue in two waves of files, the second of which corrects a third of the first, as a stream into a table of runs."""
    folder, table, checkpoint = (new_folder(spark, n) for n in ("incoming", "ingested", "checkpoint"))
    rows = _catalog(spark, sf_dir)
    number = F.substring("doc_id", 2, 20).cast("long")
    fixed = rows.filter(number % 3 == 0).withColumn("announcement_date", F.date_sub("announcement_date", 5)).withColumn("url", F.lit("corrected"))
    for wave in (rows, fixed):
        wave.write.mode("append").options(**t.CSV).csv(folder)
        ingest(catalog_stream(spark, folder), table, checkpoint).awaitTermination()
    return catalog_table(spark, table)


QUERIES = {"catalog_file": q_catalog_file, "golden_file": q_golden_file, "series_file": q_series_file, "artifact_lines": q_artifact_lines, "runs_merged_on_read": q_runs, "catalog_stream": q_stream}

_CATALOG = """c AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'FED' ELSE 'ECB' END AS bank, 'd' || o_orderkey AS doc_id, CAST(o_orderdate AS DATE) AS announcement_date, '/x, "' || o_orderpriority || '".htm' AS url,
  CASE WHEN o_orderkey % 7 = 0 THEN 'minutes' WHEN o_orderkey % 2 = 0 THEN 'statement' ELSE 'decision' END AS doc_type, o_orderkey FROM orders)"""

ORACLES = {
    "catalog_file": f"WITH {_CATALOG} SELECT bank, doc_id, announcement_date, url, doc_type FROM c",
    "golden_file": f"WITH {SQL_CLASSIFIED} SELECT bank || '-' || user_id || '-' || event_id AS ref_area, effective_date, old_level, new_level, change_bps, direction, instrument, exclusion_reason IS NOT NULL AS excluded, exclusion_reason, audit_note FROM classified",
    "series_file": """WITH l AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'US' ELSE 'XM' END AS ref_area, CAST(ts AS DATE) AS date, arg_max({'e': event_id, 'v': value}, (ts, event_id)) AS x FROM events GROUP BY ALL),
        v AS (SELECT ref_area, date, CASE WHEN x.e % 5 > 1 THEN floor(x.v / 50) * 0.25::DOUBLE END AS level FROM l),
        f AS (SELECT ref_area, date, last_value(level IGNORE NULLS) OVER (PARTITION BY ref_area ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS new_level FROM v),
        g AS (SELECT *, lag(new_level) OVER (PARTITION BY ref_area ORDER BY date) AS old_level FROM f)
        SELECT ref_area, date, old_level, new_level, CAST(round_even((new_level - old_level) * 100, 0) AS INTEGER) AS change_bps, CASE WHEN new_level > old_level THEN 'hike' ELSE 'cut' END AS direction FROM g WHERE old_level <> new_level""",
    "artifact_lines": f"""WITH {SQL_ART} SELECT doc_id, bank, CAST(d AS VARCHAR) AS announcement_date, model_key, ok, CASE WHEN NOT ok THEN 'a "b"' || chr(10) || chr(92) || 'c' END AS error, CAST(x % 1000 + 500 AS INTEGER) AS input_tokens, CAST(x % 90 + 10 AS INTEGER) AS output_tokens,
        CASE WHEN ok THEN action END AS action, CASE WHEN ok THEN bps END AS change_bps, CASE WHEN ok THEN CAST(eff AS VARCHAR) END AS effective_date, CASE WHEN ok AND x % 17 <> 0 THEN rate END AS dfr_pct FROM rec""",
    "runs_merged_on_read": "SELECT user_id, event_id, event_type, value FROM events QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY [0, 3, 2, 1][event_id % 4 + 1] DESC, event_id DESC) = 1",
    "catalog_stream": f"WITH {_CATALOG} SELECT bank, doc_id, CASE WHEN o_orderkey % 3 = 0 THEN announcement_date - 5 ELSE announcement_date END AS announcement_date, CASE WHEN o_orderkey % 3 = 0 THEN 'corrected' ELSE url END AS url, doc_type FROM c",
}
