"""Sinks by URI, crashes in a swap, enumeration, the command line and the HTTP service, all offline."""

import importlib
import json
import sys
import threading
import urllib.error
import urllib.request

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from assayer import cli
from assayer import types as t
from assayer.extract import model_inputs, run_and_store
from assayer.http import Service, answer, server
from assayer.operators import scorecard, store
from assayer.sources import fetch, readers, runs, writers
from assayer.sources.traces import SqliteTraces

# connectors of this module go to the executors by value, as they cannot import it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
MODELS = {"batch_discount": 0.5, "models": {"nano": {"provider": "p", "model_id": "n", "input_usd_per_mtok": 0.2, "output_usd_per_mtok": 1.25}, "mini": {"provider": "p", "model_id": "m", "input_usd_per_mtok": 0.5, "output_usd_per_mtok": 1.25}}}
RECORD = json.dumps({k: {"bank": "FED", "action": "hold", "evidence_quote": "q"}.get(k) for k in t.RECORD_FIELDS})


CLIENT = f"""
from assayer.extract import Answer
def client(row):
    def call(prompt, said):
        if "boom" in said:
            raise RuntimeError("down")
        return Answer({RECORD!r}, 1000, 100, 5)
    return call
"""


@pytest.fixture(scope="module")
def client(spark, tmp_path_factory):
    """A client in a module that the workers can import too."""
    path = tmp_path_factory.mktemp("m") / "service_client.py"
    path.write_text(CLIENT)
    spark.sparkContext.addPyFile(str(path))
    sys.path.insert(0, str(path.parent))
    yield importlib.import_module("service_client").client
    sys.path.remove(str(path.parent))


def test_sinks_by_uri(spark, tmp_path):
    uri = f"file://{tmp_path}"
    df = spark.createDataFrame([("a", 1), ("b", 1)], "doc_id string, v int")
    for k in (1, 2, 3, 3):
        runs.write_run(spark.createDataFrame([("b", k), ("c", k)], df.schema) if k > 1 else df, f"{uri}/t", runs.run_name(k))
    assert {tuple(r) for r in runs.read_latest(spark, f"{uri}/t", df.schema, ["doc_id"]).collect()} == {("a", 1), ("b", 3), ("c", 3)}
    rows = spark.createDataFrame([("r1", "m", "v", 10, 1, 0.1)], "run_id string, model_key string, prompt_version string, input_tokens int, output_tokens int, cost_usd double")
    entries = store.ledger_entries(rows)
    assert [writers.append_ledger(entries, f"{uri}/l", entries.schema) for _ in range(2)] == [1, 0]
    one = spark.createDataFrame([("t", "d", "FED", "m", "v", 1, 1, 0.1, 5, True, None)], ", ".join(f"{f.name} {'boolean' if f.name == 'ok' else f.dataType.simpleString()}" for f in t.TRACE if f.name != "id"))
    for _ in range(2):
        writers.record_traces(one, f"{uri}/traces", t.TRACE)
    assert sorted(r["id"] for r in spark.read.parquet(f"{uri}/traces").collect()) == [1, 2]


def test_ties_are_settled(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 2, "y"), ("a", 1, "z")], "k string, seq int, v string")
    for part in (df, df.orderBy(F.desc("v")), df.repartition(3)):
        assert store.last_wins(part, ["k"], "seq").first()["v"] == "y" and store.merge_precedence([part, part.limit(0)], ["k"], "seq").first()["v"] == "y"
    rows = spark.createDataFrame([("d", "m1", 1, True), ("d", "m1", 2, False), ("d", "m2", 1, True)], "doc_id string, model_key string, seq int, action_correct boolean")
    assert [tuple(r)[:5] for r in scorecard.pairwise(rows, order="seq").collect()] == [("m1", "m2", 1, 0, 1)]
    assert [tuple(r)[:5] for r in scorecard.pairwise(rows).collect()] == [("m1", "m2", 1, 0, 0)]


def test_a_stored_run_calls_the_model_once(spark, tmp_path, client):
    docs = model_inputs(spark.createDataFrame([("x", "FED", "2024-01-01", "statement", "said"), ("x", "FED", "2024-01-01", "statement", "boom"), ("y", "ECB", "2024-01-01", "decision", "t")], "doc_id string, bank string, announcement_date string, doc_type string, text string"))
    calls, one = spark.sparkContext.accumulator(0), client({})

    def model(prompt, said):
        calls.add(1)
        return one(prompt, said)

    row = {**MODELS["models"]["nano"], "key": "nano"}
    for _ in range(2):
        rows = run_and_store(docs, model, "p", row, "v1", f"{tmp_path}/a", f"{tmp_path}/l", "run1")
        assert rows.count() == 3 and rows.filter("ok").count() == 2 and calls.value == 3
    assert runs.read_runs(spark, f"{tmp_path}/a", t.ARTIFACT_TABLE).count() == 3 and readers.latest_artifacts(spark, f"{tmp_path}/a").count() == 2 and spark.read.parquet(f"{tmp_path}/l").count() == 1


def test_a_killed_run_keeps_its_answers(spark, tmp_path, client):
    """Tasks that ended before the job broke off are not asked again; the rest is."""
    n, fails = 400, str(tmp_path / "fails")
    docs = model_inputs(spark.range(n).select(F.col("id").cast("string").alias("doc_id"), F.lit("FED").alias("bank"), F.lit("2024-01-01").alias("announcement_date"), F.lit("statement").alias("doc_type"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text")))
    calls, one = spark.sparkContext.accumulator(0), client({})
    (tmp_path / "fails").write_text("")

    def model(prompt, said):
        import os

        if os.path.exists(fails) and "text 77\n" in said:
            raise SystemExit("killed")
        calls.add(1)
        return one(prompt, said)

    row = {**MODELS["models"]["nano"], "key": "nano"}
    go = lambda: run_and_store(docs, model, "p", row, "v1", f"{tmp_path}/a", f"{tmp_path}/l", "run1")
    with pytest.raises(Exception):  # noqa: B017
        go()
    kept = spark.read.parquet(f"{tmp_path}/a.answers/run1").count()
    assert 0 < kept < n and not (tmp_path / "a").exists() and not (tmp_path / "l").exists()
    (tmp_path / "fails").unlink()
    before = calls.value
    assert go().count() == n and calls.value - before == n - kept and spark.read.parquet(f"{tmp_path}/l").first()["documents"] == n


def site(url):
    """A little of both banks' sites."""
    if url.endswith("fomccalendars.htm"):
        return '<p>(Released January 5, 2022)<a href="/monetarypolicy/fomcminutes20211215.htm">HTML</a></p><a href="/newsevents/pressreleases/monetary20220126a.htm">HTML</a>'
    if "fomchistorical2000" in url:
        return '<p><a href="/boarddocs/press/general/2000/20000202/default.htm">Statement</a></p><div>(Released March 23, 2000)<a href="/fomc/minutes/20000202.htm">Minutes</a></div>'
    if "govcdec" in url:
        link = lambda day, kind, name, title: f'<dt isoDate="{day}"></dt><dd><div class="title"><a href="/press/{kind}/2022/html/{name}.en.html">{title}</a></div></dd>'
        return "<dl>" + link("2022-02-03", "pr/date", "ecb.mp220203~90fbe94662", "Monetary policy decisions") + link("2022-03-03", "accounts", "ecb.mg220303~92ac2c3d3e", "Meeting of 2-3 February") + "</dl>"
    if "bad" in url:
        raise OSError("gone")
    return f"<main><div class='section'><p>Page of {url}</p></div></main><div id='article'><div class='col-sm-8'><p>Text of {url}</p></div></div>"


def test_enumeration_and_ingest(spark, tmp_path, capsys):
    small = {"fed_years": [2000], "ecb_first": 2022}
    refs = fetch.enumerate_decisions(spark, 2022, get=site, check=False, **small)
    assert [r["doc_id"] for r in refs.orderBy("doc_id").collect()] == ["ecb_mp220203", "fed_20000202", "fed_20220126a"]
    traps = fetch.enumerate_traps(spark, 2022, site, sampled=[2000], **small)
    assert {(r["doc_id"], str(r["announcement_date"])) for r in traps.collect()} == {("fed_min_20000202", "2000-03-23"), ("ecb_mg220303", "2022-03-03")}
    with pytest.raises(RuntimeError, match="statements"):
        fetch.enumerate_decisions(spark, 2022, "FED", site, [2000])
    catalog, cache = f"{tmp_path}/c.csv", f"{tmp_path}/cache"
    polite = {"delay": 0.0, "retries": 1, "sleep": lambda s: None}
    assert cli.ingest(spark, refs, catalog, cache, site, **polite) == []
    assert {(r["bank"], r["doc_id"]) for r in readers.cached_pages(spark, cache).collect()} == {("ECB", "ecb_mp220203"), ("FED", "fed_20000202"), ("FED", "fed_20220126a")} and readers.read_catalog(spark, catalog).count() == 3
    again = spark.createDataFrame([("FED", "fed_x", __import__("datetime").date(2022, 5, 1), "bad", "statement")], t.CATALOG)
    assert cli.ingest(spark, again, catalog, cache, site, "FED", **polite) == ["fed_x"]
    assert {r["doc_id"] for r in readers.read_catalog(spark, catalog).collect()} == {"fed_x", "ecb_mp220203"}


def test_command_line_from_documents_to_scorecards(spark, tmp_path, capsys, client):
    cli.ingest(spark, fetch.enumerate_decisions(spark, 2022, get=site, check=False, fed_years=[2000], ecb_first=2022), f"{tmp_path}/c.csv", f"{tmp_path}/cache", site, delay=0.0, sleep=lambda s: None)
    (tmp_path / "models.json").write_text(json.dumps(MODELS))
    (tmp_path / "prompts").mkdir()
    (tmp_path / "prompts" / "v001.md").write_text("prompt")
    for area, level in (("US", 0.125), ("XM", -0.5)):
        (tmp_path / f"{area}.csv").write_text("TIME_PERIOD,OBS_VALUE\n" + "\n".join(f"2022-0{m}-{d:02d},{level if m < 3 else level + 0.25}" for m in (1, 2, 3) for d in range(1, 29)))
    common = [f"--{k}={tmp_path}/{v}" for k, v in (("models", "models.json"), ("prompts", "prompts"), ("catalog", "c.csv"), ("cache", "cache"), ("artifacts", "runs"), ("ledger", "ledger"))]
    where = "service_client:client"
    assert cli.main(["golden", f"--series=US={tmp_path}/US.csv", f"--series=XM={tmp_path}/XM.csv", f"--out={tmp_path}/g.csv"]) == 0
    assert cli.main(["extract", "--model=nano", f"--client={where}", "--docs=fed_20220126a,ecb_mp220203", *common]) == 0
    with pytest.raises(KeyError, match="nano"):
        cli.main(["extract", "--model=none", f"--client={where}", "--docs=x", *common])
    assert cli.main(["grade", f"--artifacts={tmp_path}/runs", f"--golden={tmp_path}/g.csv", f"--catalog={tmp_path}/c.csv", f"--out={tmp_path}/graded"]) == 0
    assert cli.main(["smoke", f"--client={where}", f"--models={tmp_path}/models.json"]) == 0
    said = capsys.readouterr().out
    assert "'n': 2" in said and "| nano |" in said and "p nano ok" in said
    lines = [json.loads(x) for x in (tmp_path / "graded" / "graded-nano-v001.jsonl").read_text().splitlines()]
    assert {x["doc_id"] for x in lines} == {"fed_20220126a", "ecb_mp220203"} and all("change_bps" in x for x in lines)

    traces = SqliteTraces(f"{tmp_path}/x/traces.sqlite")
    service = Service(spark, f"{tmp_path}/graded", f"{tmp_path}/runs", f"{tmp_path}/graded", traces, MODELS, f"{tmp_path}/prompts", client({}))
    assert answer(service, "GET", "/health")[0] == 200 and answer(service, "GET", "/none")[0] == 404
    status, got = answer(service, "GET", "/decisions?model=nano&bank=FED&limit=5")
    assert status == 200 and got["count"] == 1 and got["decisions"][0]["record"]["action"] == "hold"
    assert answer(service, "GET", "/decisions?model=other")[0] == 404 and answer(service, "GET", "/decisions?model=nano&bank=BOE")[0] == 422 and answer(service, "GET", "/decisions?model=../x")[0] == 422
    assert answer(service, "GET", "/scorecards?model=nano")[1]["scorecards"][0]["documents"] == 2 and answer(service, "GET", "/scorecards?model=x")[0] == 404
    assert answer(service, "GET", "/traces")[1] == {"traces": []} and answer(service, "GET", "/traces?limit=0")[0] == 422
    ask = lambda **kw: answer(service, "POST", "/extract", json.dumps({"model": "nano", **kw}).encode())
    status, got = ask(bank="FED", text="some text")
    assert status == 200 and got["ok"] and got["trace_id"] == 1 and got["cost_usd"] == 0.000325
    assert ask(bank="FED", text="boom")[1]["error"] == "api_error: down" and ask(bank="BOE", text="x")[0] == 422 and ask(bank="FED", text="x", prompt="v9")[0] == 404
    assert [r["ok"] for r in answer(service, "GET", "/traces?limit=2")[1]["traces"]] == [0, 1]
    web = server(service, port=0)
    threading.Thread(target=web.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{web.server_address[1]}/health", timeout=10) as r:
        assert json.load(r)["status"] == "ok"
    with pytest.raises(urllib.error.HTTPError):
        urllib.request.urlopen(f"http://127.0.0.1:{web.server_address[1]}/decisions?model=other", timeout=10)
    web.shutdown()


def test_trace_path(tmp_path, monkeypatch):
    monkeypatch.setenv("ASSAYER_TRACES", f"{tmp_path}/a.sqlite")
    assert str(SqliteTraces().path) == f"{tmp_path}/a.sqlite" and str(SqliteTraces(f"{tmp_path}/b").path) == f"{tmp_path}/b"
    monkeypatch.delenv("ASSAYER_TRACES")
    assert str(SqliteTraces().path) == "eval/traces.sqlite"
    assert SqliteTraces("/proc/nowhere/x").record_safely({"cost_usd": 0.0, "ok": True}) is None
