"""The life of a provider batch: submit, refresh, collect.

A batch's state is one small JSON file and its documents are a table, on any store: enough for a fresh
process to collect it, and no list of documents passes the driver.  A provider
is an object with ``submit(requests) -> (batch_id, extra state)``, ``status(state) -> state
changes`` and ``results(state) -> (output lines, error lines)`` as DataFrames of
:data:`assayer.types.OPENAI_LINE` or :data:`~assayer.types.ANTHROPIC_LINE`.

Collecting can be repeated after a crash at any point: a batch is a run of the artifacts of its own,
the ledger takes a run once, and the state is retired last.
"""

from __future__ import annotations

import datetime as dt
import json
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer import types as t
from assayer.functions.cost import token_estimate
from assayer.operators import batch, store
from assayer.sources.files import Files
from assayer.sources.runs import RUN, read_runs, write_run
from assayer.sources.writers import append_ledger

#: A development set over every layout and kind of decision.
DEV_SET = (
    "fed_20260617a", "fed_20240918a", "fed_20200315a", "fed_20081216b", "fed_20050202", "fed_20021106",
    "ecb_mp260611", "ecb_mp240912", "ecb_pr121206", "ecb_pr081008", "ecb_pr050804_2", "ecb_pr991202",
)


class Provider(Protocol):
    name: str

    def submit(self, requests: DataFrame) -> tuple[str, dict]: ...

    def status(self, state: dict) -> dict: ...

    def results(self, state: dict) -> tuple[DataFrame, DataFrame | None]: ...


class NotReady(Exception):
    """The provider still works on the batch."""


def _now() -> str:
    return dt.datetime.now(dt.UTC).isoformat(timespec="seconds")


def save_state(spark: SparkSession, state: dict, folder: str) -> str:
    """Write a state file, on any store, as a whole or not at all."""
    path = f"{folder}/{state['batch_id']}.json"
    Files(spark).write_text(path, json.dumps(state, indent=2) + "\n")
    return path


def load_state(spark: SparkSession, path: str) -> dict:
    return json.loads(Files(spark).read_text(path))


def list_states(spark: SparkSession, folder: str) -> list[str]:
    return Files(spark).glob(f"{folder}/*.json")


def members(spark: SparkSession, batch_id: str, folder: str) -> DataFrame:
    """The documents of a batch."""
    return read_runs(spark, f"{folder}/documents", t.BATCH_MEMBER).filter(F.col(RUN) == batch_id).drop(RUN)


def missing_documents(spark: SparkSession, batch_id: str, folder: str) -> DataFrame:
    """Documents of a collected batch whose requests were never executed."""
    return read_runs(spark, f"{folder}/missing", t.BATCH_MEMBER).filter(F.col(RUN) == batch_id).drop(RUN)


def submit(docs: DataFrame, model: dict, prompt: str, prompt_version: str, provider: Provider, folder: str, force: bool = False) -> dict:
    """Send one (model, prompt) batch of documents with their ``model_input``; keep its state and, as a table, its documents.

    Refuses while an uncollected batch of the same model and prompt exists.
    """
    spark = docs.sparkSession
    asked = docs.select(*[F.col(f.name).cast(f.dataType) for f in t.BATCH_MEMBER])
    n, tokens = docs.agg(F.count(F.lit(1)), token_estimate(len(prompt), F.col("model_input"))).first()
    if not n:
        raise ValueError("no documents given")
    pending = [s["batch_id"] for s in (load_state(spark, p) for p in list_states(spark, folder)) if (s["model_key"], s["prompt_version"], s["collected"]) == (model["key"], prompt_version, False)]
    if pending and not force:
        raise ValueError(f"uncollected batches for {model['key']}/{prompt_version}: {pending}")
    requests = batch.request_rows(docs, model["model_id"], prompt, provider.name, t.record_json_schema())
    batch_id, extra = provider.submit(requests)
    write_run(asked, f"{folder}/documents", batch_id)
    state = {
        "batch_id": batch_id, "provider": provider.name, "model_key": model["key"], "prompt_version": prompt_version, "schema_version": t.SCHEMA_VERSION,
        "submitted_at_utc": _now(), "status": "submitted", "collected": False, "estimated_input_tokens": tokens, "n_documents": n, **extra,
    }
    save_state(spark, state, folder)
    return state


def refresh(spark: SparkSession, state: dict, provider: Provider, folder: str) -> dict:
    """Ask for progress; a collected batch is not asked about again."""
    if state["collected"]:
        return state
    state = {**state, **provider.status(state)}
    save_state(spark, state, folder)
    return state


def is_terminal(state: dict) -> bool:
    return state["status"] in batch.TERMINAL[state["provider"]]


def collect(spark: SparkSession, state: dict, provider: Provider, models: DataFrame, folder: str, artifacts: str, ledger: str) -> DataFrame:
    """Artifact rows of a finished batch, merged into the artifacts and counted in the ledger.

    Requests that were never executed go to a table of missing documents instead of becoming rows.
    """
    if state["collected"]:
        raise ValueError(f"{state['batch_id']} is collected already")
    if state["schema_version"] != t.SCHEMA_VERSION:
        raise RuntimeError(f"{state['batch_id']} has schema {state['schema_version']}, not {t.SCHEMA_VERSION}")
    state = refresh(spark, state, provider, folder)
    if not is_terminal(state):
        raise NotReady(f"{state['batch_id']} is {state['status']}")
    requests = members(spark, state["batch_id"], folder)
    output, errors = provider.results(state)
    if state["provider"] == "openai":
        found = batch.collect_openai(output, errors if errors is not None else spark.createDataFrame([], t.OPENAI_LINE))
    else:
        found = batch.collect_anthropic(output)
    model = models.filter(F.col("key") == state["model_key"])
    run = f"{state['submitted_at_utc']}-{state['batch_id']}"
    write_run(batch.artifact_rows(found, requests, model, state["prompt_version"]), artifacts, run)
    # from here on from what is stored: the provider's answers are asked for once
    rows = read_runs(spark, artifacts, t.ARTIFACT_TABLE).filter(F.col(RUN) == run).drop(RUN)
    write_run(requests.join(rows, "doc_id", "left_anti"), f"{folder}/missing", state["batch_id"])
    n_missing = missing_documents(spark, state["batch_id"], folder).count()
    if rows.count():
        entries = store.ledger_entries(rows.withColumn("run_id", F.lit(state["batch_id"]))).withColumn("timestamp_utc", F.lit(_now()))
        append_ledger(entries, ledger, t.LEDGER)
    save_state(spark, {**state, "collected": True, "collected_at_utc": _now(), "n_missing": n_missing}, folder)
    return rows
