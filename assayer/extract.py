"""Running an extraction model over documents.

A model is any callable from (prompt, input) to an :class:`Answer`; the provider clients are
the caller's.  Failures are rows, not exceptions: what an extraction could not do is part of
what is measured, and an empty answer is billed all the same.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from assayer.functions.cost import cost_usd
from assayer.functions.text import framed, source_label
from assayer.functions.validate import with_record
from assayer.operators.store import first_wins, ledger_entries
from assayer.sources.runs import write_run
from assayer.sources.writers import append_ledger
from assayer.types import ARTIFACT_TABLE, LEDGER, SCHEMA_VERSION


@dataclass(frozen=True)
class Answer:
    """A model's answer: text, or None if empty, with what it cost."""

    payload: str | None
    input_tokens: int = 0
    output_tokens: int = 0
    latency_ms: int = 0


def model_inputs(docs: DataFrame) -> DataFrame:
    """Documents (bank, doc_type, text) with their framed ``model_input``."""
    return docs.withColumn("model_input", framed(source_label(F.col("bank"), F.col("doc_type")), F.col("text")))


def run(docs: DataFrame, model: Callable[[str, str], Answer], prompt: str, model_row: dict, prompt_version: str, batch: bool = False) -> DataFrame:
    """Artifact rows of all documents; the model is called on the executors, a batch at a time.

    Each action on the result calls the model again: :func:`run_and_store` writes it first.
    """
    asked = [c for c in docs.columns if c == "asked"]
    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "bank", F.col("announcement_date").cast("string").alias("announcement_date"), "model_input", *asked)

    def call(batches):
        for pdf in batches:
            rows = []
            for text in pdf["model_input"]:
                try:
                    a = model(prompt, text)
                    rows.append((a.payload, None if a.payload is not None else "api_error: empty response", a.input_tokens, a.output_tokens, a.latency_ms))
                except Exception as e:
                    rows.append((None, f"api_error: {e}", 0, 0, 0))
            got = pd.DataFrame(rows, columns=["payload", "call_error", "input_tokens", "output_tokens", "latency_ms"])
            yield pd.concat([pdf[["doc_id", "bank", "announcement_date", *asked]].reset_index(drop=True), got], axis=1)

    rows = docs.mapInPandas(call, f"doc_id string, bank string, announcement_date string, {'asked long, ' if asked else ''}payload string, call_error string, input_tokens int, output_tokens int, latency_ms int")
    rows = with_record(rows, F.col("payload"), "_p")
    rate = lambda k: F.lit(float(model_row[k]))
    discount = float(model_row.get("batch_discount", 1.0)) if batch else 1.0
    return rows.select(
        "doc_id", "bank", "announcement_date", F.lit(model_row["key"]).alias("model_key"), F.lit(prompt_version).alias("prompt_version"),
        F.lit(SCHEMA_VERSION).alias("schema_version"), F.coalesce("_p.ok", F.lit(False)).alias("ok"), F.col("_p.record").alias("record"), F.coalesce("call_error", "_p.error").alias("error"),
        "input_tokens", "output_tokens", cost_usd(F.col("input_tokens"), F.col("output_tokens"), rate("input_usd_per_mtok"), rate("output_usd_per_mtok"), discount).alias("cost_usd"), "latency_ms", *asked,
    )


#: Documents that one task asks the model about: what a lost task has to ask again.
ASKED = 50


def kept_answers(docs: DataFrame, ask: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """The answers to all documents, each of which is asked for once, however often the run breaks off.

    A task's answers are put in place when the task ends, not when the job does (the second
    algorithm of Hadoop's committer), so a job that is killed leaves what it has paid for; done again,
    it asks for the rest.  An answer that a lost commit has written twice counts once.
    """
    spark, key = docs.sparkSession, ["doc_id", "asked"]
    # rows that repeat an id may ask for different texts
    docs = docs.withColumn("asked", F.xxhash64("model_input"))
    docs.limit(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in ARTIFACT_TABLE], "asked").write.mode("append").parquet(path)
    schema = StructType([*ARTIFACT_TABLE, StructField("asked", LongType())])
    told = spark.read.schema(schema).parquet(path)
    rest = docs.dropDuplicates(key).withColumn("doc_id", F.col("doc_id").cast("string")).join(told.select(*key), key, "left_anti")
    n = rest.count()
    if n:
        tasks = -(-n // ASKED)
        answers = ask(rest.repartition(tasks, F.rand(1)))
        answers.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)
    return first_wins(spark.read.schema(schema).parquet(path), key)


def run_and_store(docs: DataFrame, model: Callable[[str, str], Answer], prompt: str, model_row: dict, prompt_version: str, artifacts: str, ledger: str, run_id: str, batch: bool = False) -> DataFrame:
    """Call the model once per document, keep what it said and what it cost, and return the run's rows.

    Answers are kept below ``<artifacts>.answers`` as they come, so a failure costs no second call:
    with the same run_id only documents without an answer are asked about.  The run's rows then
    become a run of the artifacts; names of runs sort by time.
    """
    spark = docs.sparkSession
    rows = kept_answers(docs, lambda rest: run(rest, model, prompt, model_row, prompt_version, batch), f"{artifacts}.answers/{run_id}").drop("asked")
    write_run(rows, artifacts, run_id)
    entries = ledger_entries(rows.withColumn("run_id", F.lit(run_id))).withColumn("timestamp_utc", F.lit(dt.datetime.now(dt.UTC).isoformat(timespec="seconds")))
    append_ledger(entries, ledger, LEDGER)
    return rows
