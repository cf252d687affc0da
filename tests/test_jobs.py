"""The jobs over growing copies of the tables, after crashes, and from the command line."""

import datetime as dt
import logging
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import daily_scorecards as daily
from jobs import prepare_inputs as inputs
from jobs.common import own_settings, settings

ROOT = Path(__file__).resolve().parent.parent
DAY = daily.DAY


def rows(df, *drop):
    cols = sorted(set(df.columns) - set(drop))
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


# ---- prepare_inputs -----------------------------------------------------------------------


@pytest.fixture
def growing(spark, tmp_path):
    """Adds files of documents to a folder; paths of the folder, the output and the checkpoint."""

    def add(data):
        spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/documents")

    return add, (f"{tmp_path}/documents", f"{tmp_path}/out/inputs", f"{tmp_path}/checkpoint")


def test_only_new_documents_are_prepared(spark, growing, caplog):
    add, paths = growing
    config = own_settings("prepare_inputs")
    add([(1, "a  text", "en", "src0", 1), (2, "x", "de", "s", 1), (2, "b", "fr", "s", 1), (3, None, "en", "s", 0), (None, "no id", "en", "s", 1), (None, "no id", "en", "s", 1)])
    caplog.set_level(logging.INFO)
    first = inputs.run(spark, *paths, config)
    got = {r["doc_id"]: r for r in first.filter("doc_id IS NOT NULL").collect()}
    assert got[1]["model_input"].endswith("<document>\na text\n</document>") and (got[1]["doc_type"], got[1]["extractor"], got[1]["bank"]) == ("minutes", "fed_minutes", "FED")
    assert "\nb\n" in got[2]["model_input"] and (got[3]["status"], got[3]["reason"], got[3]["usd"]) == ("rejected", "no text", None)
    assert [(r["status"], r["reason"]) for r in first.filter("doc_id IS NULL").collect()] == [("rejected", "no id")] * 2
    before = rows(first)
    add([(1, "another text of a known document", "en", "src0", 1), (4, "new", "en", "s", 1)])
    second = inputs.run(spark, *paths, config)
    assert rows(second.filter("batch = 0")) == before and [r["doc_id"] for r in second.filter("batch > 0").collect()] == [4]
    assert "read 6 new rows" in caplog.text and "read 2 new rows" in caplog.text and "wrote 1 documents, ready, FED" in caplog.text
    again = inputs.run(spark, *paths, config)
    assert rows(again) == rows(second) and "read 0 new rows" in caplog.text


def test_prices_are_those_of_the_cheapest_model(spark, growing):
    add, paths = growing
    add([(k, "word " * n, "en", "s", 1) for k, n in enumerate((1, 2_000, 40_000, 4_000_000))])
    config = own_settings("prepare_inputs")
    for r in inputs.run(spark, *paths, config).collect():
        tokens = (config["prompt_chars"] + len(r["model_input"])) // 4
        price = {k: round((tokens * m["input_usd_per_mtok"] + 300 * m["output_usd_per_mtok"]) / 1e6 * 0.5, 6) for k, m in config["models"].items()}
        assert r["input_tokens"] == tokens and r["usd"] == pytest.approx(min(price.values()), abs=1e-9) and price[r["model_key"]] == min(price.values())
    assert {r["model_key"] for r in spark.read.parquet(paths[1]).select("model_key").distinct().collect()} == {"small", "wide"}


def test_a_batch_that_broke_off_is_replaced(spark, growing, tmp_path):
    """The commit of the last micro-batch is lost, with half of its rows written: the next run ends with the same rows."""
    import shutil

    add, paths = growing
    config = own_settings("prepare_inputs")
    add([(k, f"text {k}", "en" if k % 2 else "de", "s", 1) for k in range(10)])
    inputs.run(spark, *paths, config)
    add([(k, f"text {k}", "en" if k % 2 else "de", "s", 1) for k in range(5, 20)])
    want = rows(inputs.run(spark, *paths, config))
    for f in (tmp_path / "checkpoint/commits").glob("*1*"):
        f.unlink()
    shutil.rmtree(tmp_path / "out/inputs/batch=1/status=ready/bank=ECB")
    assert rows(inputs.run(spark, *paths, config)) == want
    with pytest.raises(Exception, match="does not know"):
        inputs.run(spark, paths[0], paths[1], f"{tmp_path}/another", config)


def test_empty_folder_and_settings_file(spark, growing, tmp_path):
    add, paths = growing
    add([])
    assert inputs.run(spark, *paths, own_settings("prepare_inputs")).count() == 0
    assert settings(spark, str(ROOT / "jobs/prepare_inputs.toml")) == own_settings("prepare_inputs")


# ---- daily_scorecards ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def put(events, until, path):
    events.filter(F.col("ts") < F.lit(until).cast("timestamp_ntz")).write.mode("overwrite").parquet(path)
    return path


def test_growing_events_end_as_one_run_over_all(spark, events, tmp_path, caplog):
    config = own_settings("daily_scorecards")
    caplog.set_level(logging.INFO)
    to, source = f"{tmp_path}/grown", f"{tmp_path}/events"
    for until in (dt.date(2024, 1, 14), dt.date(2024, 1, 15), dt.date(2024, 1, 24)):
        daily.run(spark, put(events, until, source), to, config)
    closed = rows(spark.read.parquet(f"{to}/graded").filter(F.col(DAY) < "2024-01-13"))
    caplog.clear()
    last = daily.run(spark, put(events, dt.date(2025, 1, 1), source), to, config)
    fresh = daily.run(spark, source, f"{tmp_path}/fresh", config)
    assert rows(last) == rows(fresh) and rows(last.filter(F.col(DAY) < "2024-01-13")) == closed and len(closed) > 100
    assert rows(spark.read.parquet(f"{to}/counts")) == rows(spark.read.parquet(f"{tmp_path}/fresh/counts"))
    # the last run read only what began at its mark
    n = events.filter(F.col("ts") >= F.lit(dt.date(2024, 1, 13)).cast("timestamp_ntz")).count()
    assert f"read {n} events from 2024-01-13 on" in caplog.text and 0 < n < events.count()


def test_runs_again_safely_and_rolls_up(spark, events, tmp_path):
    from assayer.operators import scorecard

    config = own_settings("daily_scorecards")
    source, to = put(events, dt.date(2025, 1, 1), f"{tmp_path}/events"), f"{tmp_path}/out"
    first = rows(daily.run(spark, source, to, config))
    again = daily.run(spark, source, to, config)
    assert rows(again) == first
    for by in (("model_key",), ("model_key", "bank")):
        assert rows(daily.cards(spark, to, by)) == rows(scorecard.scorecard(again, by))
    since = dt.date(2024, 1, 16)
    late = F.col(DAY) >= F.lit(since)
    card = lambda df: scorecard.scorecard(df, ("model_key",))
    gate = scorecard.regression_gate(card(again.filter(late)), card(again.filter(~late)), ["model_key"], ["action_rate"], 0.0)
    assert rows(daily.regressions(spark, to, since, {"tolerance": 0.0})) == rows(gate.filter("degraded"))


def test_a_run_that_broke_off_before_its_state_is_done_again(spark, events, tmp_path, monkeypatch):
    config = own_settings("daily_scorecards")
    source, to = f"{tmp_path}/events", f"{tmp_path}/out"
    daily.run(spark, put(events, dt.date(2024, 1, 20), source), to, config)
    put(events, dt.date(2025, 1, 1), source)
    keep = daily.replace_days
    for broken in ("graded", "counts", "state"):
        def crash(df, path, by=DAY, broken=broken):
            if path.endswith(broken):
                raise OSError("lost")
            keep(df, path, by)

        monkeypatch.setattr(daily, "replace_days", crash)
        with pytest.raises(OSError):
            daily.run(spark, source, to, config)
    monkeypatch.setattr(daily, "replace_days", keep)
    assert rows(daily.run(spark, source, to, config)) == rows(daily.run(spark, source, f"{tmp_path}/fresh", config))


def test_no_events_and_entities_without_a_level(spark, tmp_path):
    ddl = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    at = lambda d: dt.datetime(2024, 1, d, 9)
    config = own_settings("daily_scorecards")
    none = f"{tmp_path}/none"
    spark.createDataFrame([], ddl).write.parquet(none)
    assert daily.run(spark, none, f"{tmp_path}/a", config).count() == 0
    data = [(11, at(1), 2, "signup", None), (13, at(2), 4, "error", 5.0), (14, at(3), 4, "signup", 300.0), (15, at(30), 4, "view", 300.0), (16, None, 4, "view", 1.0)]
    some = f"{tmp_path}/some"
    spark.createDataFrame(data, ddl).write.parquet(some)
    got = daily.run(spark, some, f"{tmp_path}/b", config)
    assert got.count() == 6 and {r["expected_kind"] for r in got.filter("status = 'graded'").collect()} <= {"hold", "trap"}
    assert rows(daily.run(spark, some, f"{tmp_path}/b", config)) == rows(got)


def test_grading_looks_documents_up_by_day_in_code_that_is_compiled(spark, events):
    """No document meets the shifts of its window, events are read a few times, and no method is too large for the JVM's compiler (8,000 bytes)."""
    import re

    before = spark.createDataFrame([], daily.STATE)
    large = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}  # the plan of tables that are not broadcast
    for k, v in large.items():
        spark.conf.set(k, v)
    try:
        query = daily.grade_days(events, before, None, own_settings("daily_scorecards"))._jdf.queryExecution()
        debug = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$")
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", getattr(debug, "MODULE$").codegenString(query.executedPlan()))]
        plan = query.optimizedPlan().toString()
    finally:
        for k in large:
            spark.conf.unset(k)
    assert "Join Inner" not in plan and plan.count("Relation [") <= 4
    assert len(sizes) > 5 and max(sizes) < 8000


# ---- both ---------------------------------------------------------------------------------


def test_jobs_import_nothing_optional_and_read_through_spark():
    for p in [*(ROOT / "jobs").glob("*.py"), Path(__file__)]:
        lines = [x for x in p.read_text().splitlines() if x.lstrip().startswith(("import ", "from "))]
        assert not any("llm" in x or "corpus_pipeline" in x for x in lines)


def test_command_lines(sf_dir, tmp_path):
    docs = tmp_path / "documents"
    docs.mkdir()
    (docs / "part.parquet").symlink_to(f"{sf_dir}/documents.parquet")
    run = lambda *a: subprocess.run([sys.executable, *a], cwd=ROOT, capture_output=True, text=True, timeout=300)
    a = run("-m", "jobs.prepare_inputs", "--documents", str(docs), "--output", f"{tmp_path}/o1", "--checkpoint", f"{tmp_path}/c1", "--config", str(ROOT / "jobs/prepare_inputs.toml"))
    assert a.returncode == 0 and "batch 0: wrote" in a.stderr, a.stderr[-2000:]
    b = run(str(ROOT / "jobs/daily_scorecards.py"), "--events", f"{sf_dir}/events.parquet", "--output", f"{tmp_path}/o2", "--since", "2024-01-16")
    assert b.returncode == 0 and "graded rows of the days" in b.stderr, b.stderr[-2000:]
