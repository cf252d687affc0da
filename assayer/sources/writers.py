"""Sinks, on any store that Spark writes to.

Files are replaced through a staging name, so a crash leaves old or new, not half; tables grow by
runs (:mod:`assayer.sources.runs`).
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from assayer.operators.ranges import numbered
from assayer.operators.store import append_once
from assayer.sources.files import Files, with_retries
from assayer.types import CSV


def replace_with_retries(source: str, target: str, attempts: int = 5, wait: float = 0.1, sleep: Callable[[float], None] = time.sleep) -> None:
    """Atomic rename on a local disk; only a PermissionError (a reader holds the file) is tried again."""
    with_retries(lambda: os.replace(source, target), attempts, wait, sleep)


def write_one_file(df: DataFrame, path: str, fmt: str, **options) -> None:
    """A small table as one file."""
    files = Files(df.sparkSession)
    stage = f"{path}.{uuid.uuid4().hex}"
    df.coalesce(1).write.format(fmt).options(**options).save(stage)
    try:
        [part] = files.glob(f"{stage}/part-*")
        files.replace(part, path)
    finally:
        files.delete(stage)


def write_one_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """A small table as one sorted CSV file with a header (catalogues, golden events)."""
    text = [F.when(F.col(c), "True").when(~F.col(c), "False").alias(c) if t == "boolean" else F.col(c) for c, t in df.dtypes]
    write_one_file(df.orderBy(*order).select(*text), path, "csv", **CSV)


def write_graded(df: DataFrame, folder: str, by: tuple[str, ...] = ("model_key", "prompt_version")) -> list[str]:
    """Graded rows as one JSON-lines file per model and prompt; returns the files.

    All groups are written in one pass, so the rows are graded once, and then named.
    """
    files = Files(df.sparkSession)
    stage = f"{folder}/.{uuid.uuid4().hex}"
    name = F.concat_ws("-", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in by])
    rows = df.withColumn("_file", F.concat(F.lit("graded-"), F.regexp_replace(name, "[/\\\\]", "_"), F.lit(".jsonl")))
    rows.repartition("_file").write.partitionBy("_file").option("ignoreNullFields", False).json(stage)
    out = []
    try:
        for part in files.glob(f"{stage}/_file=*/part-*"):
            out.append(f"{folder}/{unquote(part.split('/_file=')[1].split('/')[0])}")
            files.replace(part, out[-1])
    finally:
        files.delete(stage)
    return sorted(out)


def write_catalog(df: DataFrame, path: str) -> None:
    write_one_csv(df.select("bank", "doc_id", "announcement_date", "url", "doc_type"), path, ["bank", "announcement_date", "doc_id"])


def write_golden(df: DataFrame, path: str) -> None:
    write_one_csv(df, path, ["ref_area", "effective_date"])


def write_partitioned(df: DataFrame, path: str, by: tuple[str, ...] = ("model_key", "prompt_version"), mode: str = "overwrite", fmt: str = "parquet") -> None:
    """Graded rows or artifacts by model and prompt; only the partitions present are replaced."""
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*by).format(fmt).save(path)


def append_ledger(entries: DataFrame, path: str, schema: StructType) -> int:
    """Add the runs that the ledger lacks; returns how many were new.

    A run has a partition of its own, so two collectors of one run write it twice, but bill it once.
    """
    spark = entries.sparkSession
    if Files(spark).exists(path):
        entries = append_once(read_ledger(spark, path, schema), entries)
    # a row for each run that has just ended
    rows = entries.select(*[F.col(f.name).cast(f.dataType) for f in schema]).collect()
    if rows:
        new = spark.createDataFrame(rows, schema)
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)
    return len(rows)


def read_ledger(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def record_traces(new: DataFrame, path: str, schema: StructType) -> None:
    """Append traces with gapless ids that continue the table's, numbered over all tasks by time and document."""
    spark, files = new.sparkSession, Files(new.sparkSession)
    top = spark.read.schema(schema).parquet(path).agg(F.max("id")).first()[0] if files.exists(path) else None
    rows = new.withColumn("cost_usd", F.round("cost_usd", 6)).withColumn("ok", F.col("ok").cast("int"))
    stage = f"{path}.{uuid.uuid4().hex}"
    try:
        rows = numbered(rows.drop("id"), ["timestamp_utc", "doc_id"], stage, first=(top or 0) + 1)
        rows.select(*[F.col(f.name).cast(f.dataType) for f in schema]).write.mode("append").parquet(path)
    finally:
        files.delete(stage)


def record_traces_safely(new: DataFrame, path: str, schema) -> bool:
    """The same, but a failure to trace never costs the caller its result."""
    try:
        record_traces(new, path, schema)
    except Exception:
        import logging

        logging.getLogger(__name__).exception("traces were not written to %s", path)
        return False
    return True
