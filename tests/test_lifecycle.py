import json

import pytest

from assayer import lifecycle as life
from assayer import types as t
from assayer.functions.cost import registry
from assayer.operators.batch import request_rows

MODELS = {"batch_discount": 0.5, "models": {"nano": {"provider": "openai", "model_id": "n-1", "input_usd_per_mtok": 0.2, "output_usd_per_mtok": 1.25}}}
MODEL = {"key": "nano", "model_id": "n-1"}
RECORD = json.dumps({k: {"bank": "FED", "action": "hold", "evidence_quote": "q"}.get(k) for k in t.RECORD_FIELDS})


class Fake:
    name = "openai"

    def __init__(self, spark, status="completed"):
        self.spark, self.now, self.asked = spark, status, 0

    def submit(self, requests):
        self.requests = [json.loads(r["request"]) for r in requests.collect()]
        return "b1", {"openai_input_file_id": "f"}

    def status(self, state):
        self.asked += 1
        return {"status": self.now}

    def results(self, state):
        out = [("x", (200, ("completed", None, [("message", [("output_text", RECORD)])], (1000, 200), None)), None)]
        gone = [("y", None, ("batch_expired", "m"))]
        return self.spark.createDataFrame(out, t.OPENAI_LINE), self.spark.createDataFrame(gone, t.OPENAI_LINE)


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([("x", "FED", "2024-01-01", 'said "so"\n'), ("y", "ECB", "2024-01-02", "more")], "doc_id string, bank string, announcement_date string, model_input string")


def test_life_of_a_batch(spark, docs, tmp_path):
    folder, art, ledger = (str(tmp_path / k) for k in ("s", "a", "l"))
    p = Fake(spark, "in_progress")
    state = life.submit(docs, MODEL, "prompt", "v1", p, folder)
    assert p.requests[0]["body"]["input"] == 'said "so"\n' and p.requests[0]["body"]["text"]["format"]["schema"] == t.record_json_schema()
    assert state["estimated_input_tokens"] == (2 * 6 + 10 + 4) // 4
    with pytest.raises(ValueError, match="b1"):
        life.submit(docs, MODEL, "prompt", "v1", p, folder)
    models = registry(spark, MODELS)
    with pytest.raises(life.NotReady):
        life.collect(spark, state, p, models, folder, art, ledger)
    p.now = "completed"
    for _ in range(2):  # again, as after a crash before the state was retired
        rows = life.collect(spark, state, p, models, folder, art, ledger)
        assert [(r["doc_id"], r["ok"], r["cost_usd"]) for r in rows.collect()] == [("x", True, 0.000225)]
    assert spark.read.parquet(ledger).count() == 1 and spark.read.parquet(art).count() == 1
    done = life.load_state(spark, life.list_states(spark, folder)[0])
    assert done["collected"] and done["n_missing"] == 1 and "documents" not in done
    assert [tuple(r) for r in life.missing_documents(spark, "b1", folder).collect()] == [("y", "ECB", "2024-01-02")]
    assert sorted(r["doc_id"] for r in life.members(spark, "b1", folder).collect()) == ["x", "y"]
    asked = p.asked
    assert life.refresh(spark, done, p, folder) == done and p.asked == asked
    with pytest.raises(ValueError, match="already"):
        life.collect(spark, done, p, models, folder, art, ledger)
    with pytest.raises(RuntimeError, match="schema"):
        life.collect(spark, {**state, "schema_version": "s0"}, p, models, folder, art, ledger)


def test_other_provider_and_no_documents(spark, docs, tmp_path):
    [r] = request_rows(docs.limit(1), "m", "p", "anthropic", {"type": "object"}).collect()
    body = json.loads(r["request"])
    assert body["custom_id"] == "x" and body["params"]["messages"][0]["content"] == 'said "so"\n' and body["params"]["output_config"]["format"]["schema"] == {"type": "object"}
    with pytest.raises(KeyError):
        request_rows(docs, "m", "p", "none", {})
    with pytest.raises(ValueError, match="no documents"):
        life.submit(docs.limit(0), MODEL, "p", "v1", Fake(spark), str(tmp_path))
