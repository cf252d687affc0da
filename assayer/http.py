"""A small HTTP service over the read paths, with the standard library's server.

GET /health, /decisions, /scorecards, /traces; POST /extract.  Malformed requests are answered
with 422, what is not there with 404; a call of the model is traced whatever becomes of it.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from dataclasses import dataclass
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import SparkSession

from assayer import extract, serve
from assayer.sources import readers
from assayer.sources.traces import SqliteTraces


@dataclass
class Service:
    """What the service answers from; ``artifacts`` and ``graded`` are folders of a grading run."""

    spark: SparkSession
    graded: str
    artifacts: str
    scorecards: str
    traces: SqliteTraces
    models: dict
    prompts: str
    model: Callable[[str, str], extract.Answer] | None = None
    documents: Callable[[str], dict] | None = None

    def health(self) -> dict:
        return serve.health()

    def decisions(self, model: str, prompt: str = "v001", bank: str | None = None, date_from: str | None = None, date_to: str | None = None, status: str | None = None, limit: str = "500") -> dict:
        for name in (model, prompt):
            serve.check_identifier(name)
        path = Path(self.graded, f"graded-{model}-{prompt}.jsonl")
        if not path.is_file():
            raise LookupError(f"no graded rows of {model} with prompt {prompt}")
        records = readers.read_artifacts(self.spark, self.artifacts) if self.artifacts.endswith(".jsonl") else readers.latest_artifacts(self.spark, self.artifacts)
        day = lambda v: dt.date.fromisoformat(v) if v else None
        rows = serve.decisions(readers.read_graded(self.spark, str(path)), records, bank, day(date_from), day(date_to), status, int(limit))
        found = [json.loads(r) for r in rows.toJSON().collect()]
        return {"model": model, "prompt": prompt, "count": len(found), "decisions": found}

    def scorecard_list(self, model: str | None = None) -> dict:
        cards = [json.loads(p.read_text(encoding="utf-8")) for p in sorted(Path(self.scorecards).glob("scorecard-*.json"))]
        cards = [c for c in cards if model is None or c["model_key"] == model]
        if model is not None and not cards:
            raise LookupError(f"no scorecard for model {model}")
        return {"scorecards": cards}

    def recent(self, limit: str = "50") -> dict:
        return {"traces": self.traces.recent(serve.check_limit(int(limit), 500))}

    def extract(self, model: str, prompt: str = "v001", doc_id: str | None = None, bank: str | None = None, text: str | None = None) -> dict:
        """One document, catalogued or given, through the model; its cost and outcome are traced."""
        serve.check_identifier(model)
        said = readers.load_prompt(self.prompts, serve.check_identifier(prompt))
        if model not in self.models["models"]:
            raise serve.BadRequest(f"unknown model {model}")
        if self.model is None:
            raise serve.BadRequest("the service has no model")
        ask = serve.resolve_request(doc_id, bank, text, dt.datetime.now(dt.UTC).date())
        if "text" not in ask:
            if self.documents is None:
                raise LookupError(f"document {doc_id}")
            ask = self.documents(doc_id)
        row = {**self.models["models"][model], "key": model}
        one = self.spark.createDataFrame([(ask["doc_id"], ask["bank"], str(ask["announcement_date"]), ask["doc_type"], ask["text"])], "doc_id string, bank string, announcement_date string, doc_type string, text string")
        [answer] = [json.loads(r) for r in extract.run(extract.model_inputs(one), self.model, said, row, prompt).toJSON().collect()]
        answer["trace_id"] = self.traces.record_safely({**answer, "error": answer.get("error")})
        return answer


ROUTES = {("GET", "/health"): "health", ("GET", "/decisions"): "decisions", ("GET", "/scorecards"): "scorecard_list", ("GET", "/traces"): "recent", ("POST", "/extract"): "extract"}


def answer(service: Service, method: str, target: str, body: bytes = b"") -> tuple[int, dict]:
    """Status and JSON of a request."""
    url = urlsplit(target)
    name = ROUTES.get((method, url.path))
    if name is None:
        return 404, {"detail": "no such path"}
    try:
        given = dict(parse_qsl(url.query)) if method == "GET" else json.loads(body or b"{}")
        return 200, getattr(service, name)(**given)
    except (LookupError, FileNotFoundError) as e:
        return 404, {"detail": str(e)}
    except (ValueError, TypeError) as e:
        return 422, {"detail": str(e)}


def server(service: Service, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, found = answer(service, self.command, self.path, body)
            data = json.dumps(found).encode("utf-8")
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _answer

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
