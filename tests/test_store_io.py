import datetime as dt
import json

import pytest

from assayer import types as t
from assayer.extract import Answer, model_inputs, run
from assayer.functions import cost
from assayer.operators import batch, store
from assayer.serve import BadRequest, check_identifier, decisions, recent_traces, resolve_request
from assayer.sources import fetch, readers, runs, writers
from assayer.streaming.catalog import catalog_stream, catalog_table, ingest

D = dt.date
MODEL = {"batch_discount": 0.5, "models": {"nano": {"provider": "openai", "model_id": "n", "input_usd_per_mtok": 0.2, "output_usd_per_mtok": 1.25}}}


def cat(spark, rows):
    return spark.createDataFrame([(b, d, D.fromisoformat(a), "u", k) for b, d, a, k in rows], t.CATALOG)


def test_catalog_round_trip(spark, tmp_path):
    df = cat(spark, [("FED", "f2", "2024-01-02", "statement"), ("ECB", "e", "2024-01-01", "decision"), ("FED", "f1", "2024-01-02", "statement")])
    writers.write_catalog(df, str(tmp_path / "c.csv"))
    lines = (tmp_path / "c.csv").read_text().splitlines()
    assert lines[0] == "bank,doc_id,announcement_date,url,doc_type" and [x.split(",")[1] for x in lines[1:]] == ["e", "f1", "f2"]
    assert sorted(readers.read_catalog(spark, str(tmp_path / "c.csv")).collect()) == sorted(df.collect())
    (tmp_path / "bad.csv").write_text(lines[0] + "\nFED,x,notadate,u,statement\n")
    with pytest.raises(Exception):  # noqa: B017
        readers.read_catalog(spark, str(tmp_path / "bad.csv")).collect()


def test_quotes_in_csv(spark, tmp_path):
    """As Python's csv module writes and reads them."""
    import csv

    odd = 'say "x, y", \\ then'
    df = spark.createDataFrame([("FED", "d", D(2024, 1, 1), odd, "statement")], t.CATALOG)
    writers.write_catalog(df, str(tmp_path / "c.csv"))
    assert list(csv.DictReader(open(tmp_path / "c.csv")))[0]["url"] == odd == readers.read_catalog(spark, str(tmp_path / "c.csv")).first()["url"]


def test_golden_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("US", D(2024, 9, 19), 5.375, 4.875, -50, "cut", "FFTR_MID", False, None, None), ("XM", D(2024, 9, 18), 4.25, 3.5, -75, "cut", "DFR", True, "r, s", None)], t.GOLDEN)
    writers.write_golden(df, str(tmp_path / "g.csv"))
    assert "True" in (tmp_path / "g.csv").read_text()
    assert sorted(readers.read_golden(spark, str(tmp_path / "g.csv")).collect()) == sorted(df.collect())


def test_precedence_and_replace(spark):
    a, b = cat(spark, [("FED", "x", "2024-01-01", "statement"), ("FED", "y", "2024-01-01", "statement")]), cat(spark, [("FED", "x", "2024-01-01", "minutes")])
    assert {r["doc_id"]: r["doc_type"] for r in readers.doc_types(a, b).collect()} == {"x": "minutes", "y": "statement"}
    old = cat(spark, [("FED", "x", "2024-01-01", "statement"), ("ECB", "e", "2024-01-01", "decision")])
    got = store.filtered_replace(old, cat(spark, [("FED", "z", "2024-01-01", "statement")]), "bank", "FED")
    assert {r["doc_id"] for r in got.collect()} == {"e", "z"}


def test_runs_are_merged_on_read(spark, tmp_path):
    """A run writes one partition and touches no other; done again, it changes nothing; compaction changes no answer."""
    ddl = spark.createDataFrame([], "doc_id string, v int").schema
    path = str(tmp_path / "t")
    runs.write_run(spark.createDataFrame([("a", 1), ("b", 1), (None, 1)], ddl), path, runs.run_name(9))
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    old = files()
    for _ in range(2):
        runs.write_run(spark.createDataFrame([("b", 2), ("c", 2), ("c", 3)], ddl), path, runs.run_name(10))
    assert {p: m for p, m in files().items() if p in old} == old and len(files()) > len(old)
    want = {("a", 1), ("b", 2), ("c", 3), (None, 1)}
    latest = lambda p: {tuple(r) for r in runs.read_latest(spark, p, ddl, ["doc_id"], "v").collect()}
    assert latest(path) == want
    runs.write_run(spark.createDataFrame([("a", 0)], ddl), path, runs.run_name(11))
    runs.compact(spark, path, str(tmp_path / "u"), ddl, ["doc_id"], runs.run_name(10), "v")
    assert latest(str(tmp_path / "u")) == latest(path) == (want - {("a", 1)}) | {("a", 0)}
    assert runs.read_runs(spark, str(tmp_path / "u"), ddl).count() == 5


def test_graded_files_in_one_pass(spark, tmp_path):
    """Quotes, slashes and nulls in names; the rows are computed once, whatever the number of groups."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    rows = [(f"d{k}", m, p) for k in range(3) for m, p in (("it's", "v1"), ("a/b", "v1"), ("m", None))]
    df = spark.createDataFrame(rows, "doc_id string, model_key string, prompt_version string").mapInPandas(count, "doc_id string, model_key string, prompt_version string")
    out = writers.write_graded(df, str(tmp_path / "g"))
    assert [p.rsplit("/", 1)[1] for p in out] == ["graded-a_b-v1.jsonl", "graded-it's-v1.jsonl", "graded-m-null.jsonl"] and seen.value == 9
    assert sorted(p.name for p in (tmp_path / "g").iterdir() if not p.name.startswith(".")) == sorted(p.rsplit("/", 1)[1] for p in out)
    for p, (m, v) in zip(out, (("a/b", "v1"), ("it's", "v1"), ("m", None))):
        got = [json.loads(x) for x in open(p)]
        assert sorted(g["doc_id"] for g in got) == ["d0", "d1", "d2"] and {(g["model_key"], g["prompt_version"]) for g in got} == {(m, v)}


def test_scorecards_by_declared_schema(spark, tmp_path):
    (tmp_path / "scorecard-m-v1.json").write_text(json.dumps({"model_key": "m", "prompt_version": "v1", "documents": 3, "action_accuracy": {"rate": 0.5, "n": 2, "ci95": [0.1, 0.9]}}, indent=2))
    [r] = readers.read_scorecards(spark, str(tmp_path)).collect()
    assert r["action_accuracy"]["ci95"] == [0.1, 0.9] and r["cost_usd"] is None and r["documents"] == 3
    with pytest.raises(LookupError):
        readers.read_scorecards(spark, str(tmp_path), "other")


def test_ledger_once(spark, tmp_path):
    rows = spark.createDataFrame([("r1", "m", "v", 10, 1, 0.1), ("r1", "m", "v", 5, 1, 0.2)], "run_id string, model_key string, prompt_version string, input_tokens int, output_tokens int, cost_usd double")
    entries = store.ledger_entries(rows)
    path = str(tmp_path / "l")
    assert [writers.append_ledger(entries, path, entries.schema) for _ in range(2)] == [1, 0]
    [r] = spark.read.parquet(path).collect()
    assert (r["documents"], r["input_tokens"], r["cost_usd"]) == (2, 15, 0.3)


def test_traces(spark, tmp_path):
    row = ("t", None, "FED", "m", "v", 1, 1, 0.00000149, 5, True, None)
    new = spark.createDataFrame([row], ", ".join(f"{f.name} {'boolean' if f.name == 'ok' else f.dataType.simpleString()}" for f in t.TRACE if f.name != "id"))
    for _ in range(3):
        writers.record_traces(new, str(tmp_path / "t"), t.TRACE)
    got = recent_traces(spark.read.parquet(str(tmp_path / "t")), spark, t.TRACE, 2).collect()
    assert [r["id"] for r in got] == [3, 2] and got[0]["ok"] == 1 and got[0]["cost_usd"] == 1e-06
    assert recent_traces(None, spark, t.TRACE).count() == 0
    assert writers.record_traces_safely(new, "/proc/nowhere/x", t.TRACE) is False


def test_batch_state_and_pending(spark, tmp_path):
    state = {"batch_id": "b1", "provider": "openai", "model_key": "m", "prompt_version": "v", "schema_version": "s1", "status": "completed", "collected": False, "documents": [{"doc_id": "x", "bank": "FED", "announcement_date": "2024-01-01"}]}
    (tmp_path / "b1.json").write_text(json.dumps(state, indent=2))
    states = readers.read_batch_states(spark, str(tmp_path))
    assert readers.batch_documents(states).first()["doc_id"] == "x"
    with pytest.raises(ValueError, match="b1"):
        store.pending_guard(states, "m", "v")
    store.pending_guard(states, "m", "v", force=True)
    store.pending_guard(states, "other", "v")


def test_collect_openai(spark, tmp_path):
    good = json.dumps({"bank": "FED", "decision_date": None, "effective_date": None, "action": "hold", "change_bps": None, "target_range_lower_pct": None, "target_range_upper_pct": None, "dfr_pct": None, "mro_pct": None, "mlf_pct": None, "evidence_quote": "q"})
    said = lambda text: [{"type": "message", "content": [{"type": "output_text", "text": text}]}]
    use = {"input_tokens": 1000, "output_tokens": 200}
    lines = [
        {"custom_id": "ok", "response": {"status_code": 200, "body": {"output": said(good), "usage": use}}},
        {"custom_id": "bad", "response": {"status_code": 200, "body": {"status": "completed", "output": said("{"), "usage": use}}},
        {"custom_id": "cut", "response": {"status_code": 200, "body": {"status": "incomplete", "incomplete_details": {"reason": "content_filter"}, "output": [], "usage": use}}},
        {"custom_id": "http", "response": {"status_code": 500, "body": {"error": {"code": "server", "message": "down"}}}},
    ]
    errors = [{"custom_id": "ok", "error": {"code": "other"}}, {"custom_id": "gone", "error": {"code": "batch_expired"}}, {"custom_id": "err", "error": {"code": "other"}}]
    for name, rows in (("o", lines), ("e", errors)):
        (tmp_path / f"{name}.jsonl").write_text("\n\n".join(json.dumps(r) for r in rows))
    ids = ["ok", "bad", "cut", "http", "gone", "err"]
    requests = spark.createDataFrame([(i, "FED", "2024-01-01") for i in ids], "doc_id string, bank string, announcement_date string")
    found = batch.collect_openai(readers.read_openai_lines(spark, str(tmp_path / "o.jsonl")), readers.read_openai_lines(spark, str(tmp_path / "e.jsonl")))
    rows = batch.artifact_rows(found, requests, cost.registry(spark, MODEL), "v1")
    got = {r["doc_id"]: r for r in rows.collect()}
    assert got["ok"]["ok"] and got["ok"]["record"]["action"] == "hold" and got["ok"]["cost_usd"] == 0.000225
    assert got["bad"]["error"].startswith("schema_violation") and got["bad"]["cost_usd"] == 0.000225
    assert got["cut"]["error"] == "api_error: response incomplete (content_filter)" and "down" in got["http"]["error"] and got["http"]["cost_usd"] == 0
    assert "other" in got["err"]["error"]
    assert [r["doc_id"] for r in store.missing(requests, rows, "doc_id").collect()] == ["gone"]


def test_run_turns_failures_into_rows(spark):
    def model(prompt, said):
        if "boom" in said:
            raise RuntimeError("down")
        return Answer(None, 7, 0, 1) if "empty" in said else Answer("{}", 10, 2, 3)

    docs = spark.createDataFrame([(str(k), "FED", "2024-01-01", "minutes" if k == 0 else "statement", x) for k, x in enumerate(("fine", "boom", "empty"))], "doc_id string, bank string, announcement_date string, doc_type string, text string")
    asked = model_inputs(docs)
    assert asked.filter("doc_id = '0'").first()["model_input"].startswith("Source: Federal Reserve (FOMC) publication\n\n<document>\nfine")
    row = {"key": "k", "input_usd_per_mtok": 1.0, "output_usd_per_mtok": 1.0}
    got = {r["doc_id"]: r for r in run(asked, model, "p", row, "v1").collect()}
    assert got["1"]["error"] == "api_error: down" and got["2"]["error"].startswith("api_error") and got["2"]["input_tokens"] == 7 and got["2"]["cost_usd"] == 7e-06
    assert got["0"]["error"].startswith("schema_violation")


def test_serving(spark):
    graded = spark.createDataFrame([(f"d{k}", "FED" if k % 2 else "ECB", f"2024-01-{k + 1:02d}", "graded") for k in range(9)], "doc_id string, bank string, announcement_date string, status string")
    runs = spark.createDataFrame([("d1", 1, "old"), ("d1", 2, "new")], "doc_id string, gen int, record string")
    got = decisions(graded, runs, "FED", D(2024, 1, 2), D(2024, 1, 6), limit=2, generation="gen").collect()
    assert [(r["doc_id"], r["record"]) for r in got] == [("d1", "new"), ("d3", None)]
    for bad in ("../x", "", "a/b"):
        with pytest.raises(BadRequest):
            check_identifier(bad)
    with pytest.raises(BadRequest):
        decisions(graded, runs, limit=0)
    with pytest.raises(BadRequest):
        resolve_request(None, "BOE", "text", D(2024, 1, 1))
    assert resolve_request(None, "FED", "text", D(2024, 1, 1))["doc_id"] == "adhoc"


def test_retries_and_cache(spark):
    tries, slept = [], []

    def get(url):
        tries.append(url)
        if "bad" in url or len(tries) == 1:
            raise OSError("no")
        return "page"

    assert fetch.with_retries(get, "u", sleep=slept.append) == "page" and slept == [1]
    with pytest.raises(ValueError):
        fetch.fetch_series("GB", get=get)
    refs, cache = spark.createDataFrame([("a",), ("b",)], "doc_id string"), spark.createDataFrame([("a",)], "doc_id string")
    assert [r[0] for r in fetch.uncached(refs, cache).collect()] == ["b"]


def test_pages_are_fetched_by_hosts(spark, tmp_path):
    """One task a host, one request after the other, in rounds; failures are rows; what a broken crawl has fetched stays."""
    log, path = str(tmp_path / "log"), str(tmp_path / "pages")

    def get(url):
        import os
        import time

        if "breaks" in url and os.path.exists(f"{log}.fails"):
            time.sleep(5)
            raise SystemExit("killed")
        if "bad" in url:
            raise OSError("gone")
        with open(log, "a") as f:
            f.write(f"{os.getpid()} {url}\n")
        return f"page of {url}"

    urls = [f"https://h{k % 3}.example/{k}" for k in range(30)] + ["https://h1.example/bad", "no host"]
    refs = spark.createDataFrame([(f"d{k:02d}", u) for k, u in enumerate(urls)] + [("d00", urls[0])], "doc_id string, url string")
    got = {r["doc_id"]: r for r in fetch.fetch_pages(refs.repartition(5), path, get, 0.0, 1, round_pages=4).collect()}
    assert len(got) == 32 and got["d30"]["error"] == "OSError: gone" and got["d30"]["html"] is None and got["d31"]["host"] == ""
    assert all(r["html"] == f"page of {r['url']}" for r in got.values() if r["doc_id"] != "d30")
    asked = [x.split() for x in open(log).read().splitlines()]
    for h in ("h0", "h1", "h2"):
        mine = [u for _, u, *_ in asked if h in u]
        assert mine == sorted(mine, key=lambda u: int(u.rsplit("/", 1)[1])) and len(mine) == 10
    # a crawl that breaks off keeps its finished hosts
    open(f"{log}.fails", "w").close()
    more = spark.createDataFrame([("e1", "https://a.example/1"), ("e2", "https://breaks.example/1")], "doc_id string, url string")
    with pytest.raises(Exception):  # noqa: B017
        fetch.fetch_pages(more, path, get, 0.0, 1)
    kept = {r["doc_id"] for r in spark.read.schema(t.PAGES).parquet(path).collect()}
    assert "e2" not in kept and len(kept) >= 32


def test_documents_from_cache(spark, tmp_path):
    (tmp_path / "fed").mkdir()
    (tmp_path / "fed" / "x.html").write_text("<p>\nhi</p>")
    cache = readers.read_documents(spark, str(tmp_path))
    assert tuple(cache.first()) == ("FED", "x", "<p>\nhi</p>")
    c = cat(spark, [("FED", "x", "2024-01-01", "statement"), ("FED", "y", "2024-01-01", "statement")])
    ask = lambda *ids: spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "doc_id string, position int")
    assert readers.load_documents(ask("x"), c, cache).count() == 1
    for gone in ("y", "z"):
        with pytest.raises(Exception, match=f"document.* {gone}"):
            readers.load_documents(ask(gone), c, cache).collect()


def test_replace_with_retries(tmp_path, monkeypatch):
    import os

    calls, waits = [], []

    def replace(a, b):
        calls.append(a)
        if len(calls) < 3:
            raise PermissionError

    monkeypatch.setattr(os, "replace", replace)
    writers.replace_with_retries("a", "b", sleep=waits.append)
    assert len(calls) == 3 and waits == [0.1, 0.2]


def test_streaming_ingest(spark, tmp_path):
    import os

    src, table = tmp_path / "in", str(tmp_path / "t")
    src.mkdir()
    head = "bank,doc_id,announcement_date,url,doc_type\n"

    def put(name, body, at):
        (src / name).write_text(head + body)
        os.utime(src / name, (at, at))

    go = lambda: ingest(catalog_stream(spark, str(src)), table, str(tmp_path / "cp")).awaitTermination()
    got = lambda: {(r["doc_id"], r["url"]) for r in catalog_table(spark, table).collect()}
    put("1.csv", "FED,x,2024-01-05,u1,statement\n", 1_700_000_000)
    go()
    # later rows win by arrival, even where their announcement is corrected to an earlier day
    put("3.csv", "FED,x,2024-01-01,old,statement\nFED,z,2024-01-01,first,statement\nFED,z,2023-01-01,second,statement\n", 1_700_000_100)
    put("2.csv", "FED,x,2024-01-02,u2,statement\nECB,y,2024-01-01,u,decision\n", 1_700_000_200)
    go()
    go()
    assert got() == {("x", "u2"), ("y", "u"), ("z", "second")}
    # the commit of the last micro-batch is lost with a part of its rows: it is done again and ends alike
    before = {p.name for p in (tmp_path / "t").rglob("run=000000000000/*.parquet")}
    for f in (tmp_path / "cp/commits").glob("*1*"):
        f.unlink()
    for f in (tmp_path / "t").rglob("run=000000000001/*.parquet"):
        f.unlink()
    go()
    assert got() == {("x", "u2"), ("y", "u"), ("z", "second")} and {p.name for p in (tmp_path / "t").rglob("run=000000000000/*.parquet")} == before
