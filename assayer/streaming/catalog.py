"""Incremental ingestion: a stream of catalogue files into a table that grows by micro-batches.

A micro-batch writes its own rows only, and replaying one after a failure replaces exactly those.
Of rows with one key the one that arrived last counts: by the time of its file, then the file's name,
then its place in the file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from assayer import types as t
from assayer.operators.store import last_wins
from assayer.sources.runs import read_latest, run_name, write_run

ARRIVED, PLACE = "_arrived", "_place"


def catalog_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Catalogue rows of CSV files as they arrive, with their file's time, name and part in ``_arrived``."""
    rows = spark.readStream.schema(t.CATALOG).options(**t.CSV).option("maxFilesPerTrigger", files_per_batch).csv(folder)
    return rows.select("*", F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start").alias(ARRIVED))


def ingest(stream: DataFrame, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start writing the stream to a Parquet table, a run for each micro-batch; read it with :func:`catalog_table`."""

    def add(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn(PLACE, F.monotonically_increasing_id())
        write_run(last_wins(rows, ["doc_id"], ARRIVED, PLACE).drop(ARRIVED, PLACE), table, run_name(batch_id))

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def catalog_table(spark: SparkSession, table: str) -> DataFrame:
    """The ingested catalogue: each document's row of the last micro-batch that has one."""
    return read_latest(spark, table, t.CATALOG, ["doc_id"])


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events per day and type of an event stream, with a watermark that bounds the state."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
