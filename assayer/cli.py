"""Command line over files on disk.

    python -m assayer.cli golden --series US=us.csv --series XM=xm.csv --out events.csv
    python -m assayer.cli ingest --catalog documents.csv --cache cache/ --bank all
    python -m assayer.cli ingest-traps --catalog traps.csv --cache cache/
    python -m assayer.cli extract --model nano --models models.json --client mine:client --prompts prompts/ --catalog documents.csv --cache cache/ --dev-set --artifacts runs/ --ledger ledger/
    python -m assayer.cli batch submit|status|collect --provider mine:provider --states batches/ ...
    python -m assayer.cli grade --artifacts runs/ --golden events.csv --catalog documents.csv --traps traps.csv --out graded/
    python -m assayer.cli serve --graded graded/ --artifacts runs/ --models models.json --prompts prompts/
    python -m assayer.cli smoke --client mine:client --models models.json

``--client`` names ``module:function``, a function from a model's registry row to a callable of
prompt and input that returns an :class:`assayer.extract.Answer`; ``--provider`` a function from
the session to a :class:`assayer.lifecycle.Provider`.  Credentials are theirs.
"""

from __future__ import annotations

import argparse
import datetime as dt
import importlib
import json
import uuid
from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer import extract, lifecycle
from assayer.functions import cost, html, text
from assayer.http import Service, server
from assayer.operators import grading, scorecard, series
from assayer.operators.store import filtered_replace, merge_precedence, requested_lookup, run_summary
from assayer.sources import fetch, readers, writers
from assayer.sources.files import Files
from assayer.sources.traces import SqliteTraces


def golden(spark: SparkSession, sources: dict[str, str]) -> DataFrame:
    """Classified events of all areas' daily series."""
    daily = reduce(DataFrame.unionByName, [readers.read_sdmx(spark, path, area) for area, path in sources.items()])
    shifts = series.level_shifts(daily, ["ref_area"], ["date"]).withColumnRenamed("date", "effective_date")
    columns = ["ref_area", "effective_date", "old_level", "new_level", "change_bps", "direction", "instrument", "excluded", "exclusion_reason", "audit_note"]
    return series.classify_shifts(shifts).select(*columns)


def grade(spark: SparkSession, artifacts: str, golden_path: str, catalog: str, traps: str | None) -> tuple[DataFrame, DataFrame]:
    """Graded rows and scorecards of all artifacts."""
    decisions = readers.read_catalog(spark, catalog)
    known = merge_precedence([decisions, *([readers.read_catalog(spark, traps)] if traps else [])], ["doc_id"])
    table = Files(spark).glob(f"{artifacts}/run=*")
    rows = readers.latest_artifacts(spark, artifacts) if table else readers.read_artifacts(spark, artifacts)
    grading.guard_unknown(rows, known)
    typed = grading.resolve_doc_types(rows, known)
    graded = grading.grade(typed, readers.read_golden(spark, golden_path), readers.announcements(decisions))
    return graded, scorecard.summarize(graded, rows)


def named(name: str) -> Callable:
    """The function that ``module:function`` names."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def ingest(spark: SparkSession, refs: DataFrame, catalog: str, cache: str, get: Callable[[str], str] = fetch.http_get, bank: str = "all", **politeness) -> list[str]:
    """Write the catalogue, fetch the pages that the cache lacks; returns the ids that failed.

    References of one bank replace only that bank's rows of the catalogue.
    """
    files = Files(spark)
    # some hundred rows, each page of which was asked for once: they are not to be asked for again
    refs = spark.createDataFrame(refs.select(*readers.t.CATALOG.names).collect(), readers.t.CATALOG)
    if bank != "all" and files.exists(catalog):
        old = spark.createDataFrame(readers.read_catalog(spark, catalog).collect(), readers.t.CATALOG)
        whole = filtered_replace(old, refs, "bank", bank)
    else:
        whole = refs
    writers.write_catalog(whole, catalog)
    asked = fetch.uncached(whole, readers.cached_pages(spark, cache)).select("doc_id", "url")
    got = fetch.fetch_pages(asked, f"{cache}/pages", get, **politeness)
    return [r["doc_id"] for r in got.filter("error IS NOT NULL").select("doc_id").orderBy("doc_id").collect()]


def documents(spark: SparkSession, ids: list[str] | None, catalog: str, traps: str | None, cache: str) -> DataFrame:
    """The asked documents (all, without ids) in their order with the text of their pages; unknown ids fail."""
    known = merge_precedence([readers.read_catalog(spark, c) for c in (catalog, traps) if c], ["doc_id"])
    if ids is None:
        ids = [r["doc_id"] for r in known.select("doc_id").orderBy("doc_id").collect()]
    asked = spark.createDataFrame([(d, k) for k, d in enumerate(ids)], "doc_id string, position int")
    found = requested_lookup(asked, known, strict=True).join(readers.cached_pages(spark, cache).select("doc_id", "html"), "doc_id", "left")
    gone = F.raise_error(F.concat(F.lit("document not cached "), F.col("doc_id"))).cast("string")
    found = found.withColumn("html", F.coalesce("html", gone))
    texts = html.extract(found, text.extractor_name(F.col("bank"), F.col("doc_type")))
    return extract.model_inputs(texts.withColumn("text", F.coalesce("text", F.raise_error(F.concat("doc_id", F.lit(": "), "text_error")).cast("string"))))


def registry_of(path: str, key: str) -> dict:
    raw = Path(path).read_text(encoding="utf-8")
    models = json.loads(raw) if path.endswith(".json") else importlib.import_module("yaml").safe_load(raw)
    if key not in models["models"]:
        raise KeyError(f"no model {key!r}; there are {sorted(models['models'])}")
    return {**models["models"][key], "key": key, "batch_discount": models.get("batch_discount", 1.0)}


def smoke(client: Callable, models: dict) -> list[str]:
    """One tiny call of the cheapest model of each provider; returns the providers that failed."""
    best: dict[str, tuple] = {}
    for key, m in sorted(models["models"].items()):
        best[m["provider"]] = min(best.get(m["provider"], (float("inf"), "")), (m["input_usd_per_mtok"], key))
    failed = []
    for provider, (_, key) in sorted(best.items()):
        try:
            said = client({**models["models"][key], "key": key})("Answer with one word.", "Say ok.")
            print(provider, key, "ok" if said.payload else "empty answer")
            if not said.payload:
                failed.append(provider)
        except Exception as e:
            print(provider, key, f"failed: {e}")
            failed.append(provider)
    return failed


def _asked(a: argparse.Namespace) -> list[str] | None:
    return list(lifecycle.DEV_SET) if a.dev_set else a.docs.split(",") if a.docs else None


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="assayer")
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, *required: str, parent=verbs, **optional) -> argparse.ArgumentParser:
        v = parent.add_parser(name)
        for r in required:
            v.add_argument(f"--{r}", required=True)
        for o, default in optional.items():
            v.add_argument(f"--{o}", default=default)
        return v

    def which(v: argparse.ArgumentParser, *more: str) -> None:
        g = v.add_mutually_exclusive_group(required=True)
        g.add_argument("--docs")
        for m in ("dev-set", *more):
            g.add_argument(f"--{m}", action="store_true")

    verb("golden", "out").add_argument("--series", action="append", required=True, metavar="AREA=FILE")
    verb("ingest", "catalog", "cache").add_argument("--bank", choices=["FED", "ECB", "all"], default="all")
    verb("ingest-traps", "catalog", "cache")
    which(verb("extract", "model", "models", "client", "prompts", "catalog", "cache", "artifacts", "ledger", prompt="v001", traps=None))
    batch = verbs.add_parser("batch").add_subparsers(dest="step", required=True)
    submit = verb("submit", "model", "models", "provider", "prompts", "catalog", "cache", "states", parent=batch, prompt="v001", traps=None)
    which(submit, "all", "trap-set")
    submit.add_argument("--force", action="store_true")
    verb("status", "provider", "states", parent=batch)
    verb("collect", "provider", "states", "models", "artifacts", "ledger", parent=batch).add_argument("--batch-id")
    verb("grade", "artifacts", "golden", "catalog", "out", traps=None)
    verb("serve", "graded", "artifacts", "models", "prompts", client=None, host="127.0.0.1", port="8000", db=None)
    verb("smoke", "client", "models")
    return p


def run_batch(spark: SparkSession, a: argparse.Namespace) -> int:
    provider = named(a.provider)(spark)
    if a.step == "submit":
        row = registry_of(a.models, a.model)
        ids = _asked(a)
        if a.trap_set:
            ids = [r["doc_id"] for r in readers.read_catalog(spark, a.traps).select("doc_id").orderBy("doc_id").collect()]
        docs = documents(spark, ids, a.catalog, a.traps, a.cache)
        state = lifecycle.submit(docs, row, readers.load_prompt(a.prompts, a.prompt), a.prompt, provider, a.states, a.force)
        print(state["batch_id"], state["n_documents"], state["estimated_input_tokens"])
        return 0
    states = [lifecycle.load_state(spark, p) for p in lifecycle.list_states(spark, a.states)]
    if a.step == "status":
        for state in states:
            state = lifecycle.refresh(spark, state, provider, a.states)
            print(state["batch_id"], state["status"], "collected" if state["collected"] else "pending")
        return 0
    models = cost.registry(spark, json.loads(Path(a.models).read_text(encoding="utf-8")))
    for state in states:
        if state["collected"] or a.batch_id not in (None, state["batch_id"]):
            continue
        try:
            rows = lifecycle.collect(spark, state, provider, models, a.states, a.artifacts, a.ledger)
            print(state["batch_id"], run_summary(rows).first().asDict())
        except lifecycle.NotReady as e:
            print(e)
    return 0


def main(args: list[str] | None = None, get: Callable[[str], str] = fetch.http_get) -> int:
    a = parser().parse_args(args)
    if a.verb == "smoke":
        return int(bool(smoke(named(a.client), json.loads(Path(a.models).read_text(encoding="utf-8")))))
    spark = SparkSession.builder.appName("assayer").getOrCreate()
    today = dt.datetime.now(dt.UTC).date()
    if a.verb == "golden":
        events = golden(spark, dict(s.split("=", 1) for s in a.series))
        writers.write_golden(events, a.out)
        for row in series.golden_summary(events).orderBy("ref_area").collect():
            print(row["ref_area"], row["n_events"], row["first_date"], row["last_date"])
        return 0
    if a.verb in ("ingest", "ingest-traps"):
        traps = a.verb == "ingest-traps"
        refs = fetch.enumerate_traps(spark, today.year, get) if traps else fetch.enumerate_decisions(spark, today.year, a.bank, get)
        failed = ingest(spark, refs, a.catalog, a.cache, get, "all" if traps else a.bank)
        for doc_id in failed:
            print("MISSING", doc_id)
        return int(bool(failed))
    if a.verb == "extract":
        row = registry_of(a.models, a.model)
        docs = documents(spark, _asked(a), a.catalog, a.traps, a.cache)
        rows = extract.run_and_store(docs, named(a.client)(row), readers.load_prompt(a.prompts, a.prompt), row, a.prompt, a.artifacts, a.ledger, f"{dt.datetime.now(dt.UTC):%Y-%m-%dT%H-%M-%S}-{uuid.uuid4().hex[:8]}")
        print(run_summary(rows).first().asDict())
        return 0
    if a.verb == "batch":
        return run_batch(spark, a)
    if a.verb == "serve":
        models = json.loads(Path(a.models).read_text(encoding="utf-8"))
        client = named(a.client)(models) if a.client else None
        server(Service(spark, a.graded, a.artifacts, a.graded, SqliteTraces(a.db), models, a.prompts, client), a.host, int(a.port)).serve_forever()
        return 0
    graded, cards = grade(spark, a.artifacts, a.golden, a.catalog, a.traps)
    writers.write_graded(graded, a.out)
    found = [row.asDict(recursive=True) for row in cards.collect()]
    files = Files(spark)
    for card in found:
        files.write_text(f"{a.out}/scorecard-{card['model_key']}-{card['prompt_version']}.json", json.dumps(card, indent=2))
    print(scorecard.league_table(found))
    for row in scorecard.pairwise(graded.filter("status = 'graded' AND coalesce(expected_kind, '') <> 'trap'"), order="prompt_version").orderBy("model_a", "model_b").collect():
        print(row.asDict())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
