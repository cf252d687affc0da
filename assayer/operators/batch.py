"""Collecting provider batches: result lines to artifact rows."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.cost import cost_usd
from assayer.functions.validate import with_record
from assayer.types import SCHEMA_VERSION

#: The providers' own words for final states and for requests never billed.
TERMINAL = {"openai": ("completed", "failed", "expired", "cancelled"), "anthropic": ("ended",)}
UNBILLED_CODES = ("batch_expired", "batch_cancelled")
UNBILLED_TYPES = ("canceled", "expired")


def is_terminal(provider: Column, status: Column) -> Column:
    out = F.lit(False)
    for name, states in TERMINAL.items():
        out = out | ((provider == name) & status.isin(*states))
    return F.coalesce(out, F.lit(False))


def openai_text(body: Column) -> Column:
    """All output_text blocks of message items, joined; null if there is none."""
    items = F.filter(F.coalesce(body["output"], F.array()), lambda i: i["type"] == "message")
    blocks = F.flatten(F.transform(items, lambda i: F.filter(F.coalesce(i["content"], F.array()), lambda b: b["type"] == "output_text")))
    return F.nullif(F.array_join(F.transform(blocks, lambda b: b["text"]), ""), F.lit(""))


def openai_error(line: Column) -> Column:
    """The most specific error as JSON: the line's, the body's, else the status code.

    An error object without any content counts as none.
    """
    detail = lambda e: F.nullif(F.to_json(e), F.lit("{}"))
    code = F.to_json(F.struct(line["response"]["status_code"].alias("status_code")))
    return F.coalesce(detail(line["error"]), detail(line["response"]["body"]["error"]), code)


def _error_code(line: Column) -> Column:
    """Code of the most specific error that has content."""
    own, body = line["error"], line["response"]["body"]["error"]
    has = lambda e: e.isNotNull() & (F.to_json(e) != "{}")
    return F.when(has(own), own["code"]).when(has(body), body["code"])


def classify_openai(line: Column) -> Column:
    """struct(payload, error, input_tokens, output_tokens) of an output line."""
    response, body = line["response"], line["response"]["body"]
    own_error = line["error"].isNotNull() & (F.to_json(line["error"]) != "{}")
    failed = own_error | response.isNull() | ~F.coalesce(response["status_code"] == 200, F.lit(False))
    status = F.coalesce(body["status"], F.lit("completed"))
    reason = body["incomplete_details"]["reason"]
    text = openai_text(body)
    stopped = F.concat(F.lit("api_error: response "), status, F.coalesce(F.concat(F.lit(" ("), F.nullif(reason, F.lit("")), F.lit(")")), F.lit("")))
    error = F.when(failed, F.concat(F.lit("api_error: "), F.left(openai_error(line), F.lit(300))))
    error = error.when(status != "completed", stopped).when(text.isNull(), "api_error: no output_text in batch response")
    tokens = lambda k: F.when(~failed, F.coalesce(body["usage"][k], F.lit(0))).otherwise(0)
    return F.struct(F.when(error.isNull(), text).alias("payload"), error.alias("error"), tokens("input_tokens").alias("input_tokens"), tokens("output_tokens").alias("output_tokens"))


def classify_anthropic(result: Column) -> Column:
    """The same of a result that was billed or failed."""
    message = result["message"]
    done = result["type"] == "succeeded"
    texts = F.filter(F.coalesce(message["content"], F.array()), lambda b: b["type"] == "text")
    text = F.get(texts, F.lit(0))["text"]
    error = F.when(~done, F.concat(F.lit("api_error: batch result "), result["type"], F.lit(": "), F.coalesce(result["error"], F.lit("None"))))
    error = error.when(text.isNull(), F.concat(F.lit("api_error: no text block (stop_reason="), F.coalesce(message["stop_reason"], F.lit("None")), F.lit(")")))
    tokens = lambda k: F.when(done, F.coalesce(message["usage"][k], F.lit(0))).otherwise(0)
    return F.struct(F.when(error.isNull(), text).alias("payload"), error.alias("error"), tokens("input_tokens").alias("input_tokens"), tokens("output_tokens").alias("output_tokens"))


def collect_openai(output: DataFrame, errors: DataFrame) -> DataFrame:
    """custom_id and ``result`` of each billed or failed request.

    An error line counts only if its request has no output line and was executed.
    """
    line = F.struct("response", "error")
    rows = output.withColumn("_l", line).select("custom_id", classify_openai(F.col("_l")).alias("result"))
    kept = errors.join(output.select("custom_id"), "custom_id", "left_anti").withColumn("_l", line)
    kept = kept.filter(~F.coalesce(_error_code(F.col("_l")).isin(*UNBILLED_CODES), F.lit(False)))
    failed = F.struct(
        F.lit(None).cast("string").alias("payload"),
        F.concat(F.lit("api_error: "), F.left(openai_error(F.col("_l")), F.lit(300))).alias("error"),
        F.lit(0).alias("input_tokens"),
        F.lit(0).alias("output_tokens"),
    )
    return rows.unionByName(kept.select("custom_id", failed.alias("result")))


def collect_anthropic(results: DataFrame) -> DataFrame:
    kept = results.filter(~F.coalesce(F.col("result.type").isin(*UNBILLED_TYPES), F.lit(False)))
    return kept.select("custom_id", classify_anthropic(F.col("result")).alias("result"))


def artifact_rows(collected: DataFrame, requests: DataFrame, model: DataFrame, prompt_version: str) -> DataFrame:
    """Artifact rows: results keyed to their requests, payloads validated, costs at batch rates.

    ``model`` is the registry row of the batch's model.  A result without a request fails.
    """
    r = F.col("result")
    rows = collected.join(requests, F.col("custom_id") == F.col("doc_id"), "left").crossJoin(F.broadcast(model.limit(1)))
    doc_id = F.when(F.col("doc_id").isNull(), F.raise_error(F.concat(F.lit("unknown custom_id "), F.col("custom_id")))).otherwise(F.col("doc_id"))
    rows = with_record(rows, r["payload"], "_p")
    return rows.select(
        doc_id.alias("doc_id"), "bank", "announcement_date", F.col("key").alias("model_key"), F.lit(prompt_version).alias("prompt_version"), F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.coalesce(F.col("_p.ok"), F.lit(False)).alias("ok"), F.col("_p.record").alias("record"), F.coalesce(r["error"], F.col("_p.error")).alias("error"),
        r["input_tokens"].alias("input_tokens"), r["output_tokens"].alias("output_tokens"),
        cost_usd(r["input_tokens"], r["output_tokens"], F.col("input_usd_per_mtok"), F.col("output_usd_per_mtok"), F.col("batch_discount")).alias("cost_usd"),
        F.lit(0).alias("latency_ms"),
    )


def _with_tail(fields: Column, tail: dict) -> Column:
    """JSON of a struct with the members of a constant behind its own."""
    head, rest = F.to_json(fields), json.dumps(tail)[1:]
    return F.concat(F.substr(head, F.lit(1), F.length(head) - 1), F.lit(", " + rest))


def request_rows(docs: DataFrame, model_id: str, prompt: str, provider: str, json_schema: dict, max_tokens: int = 1024, name: str = "decision") -> DataFrame:
    """custom_id and the provider's request (JSON text) of each document's model input."""
    key = F.to_json(F.struct(F.col("doc_id").alias("custom_id")))
    said = F.col("model_input")
    if provider == "openai":
        fields = F.struct(F.lit(model_id).alias("model"), F.lit(prompt).alias("instructions"), said.alias("input"), F.lit(max_tokens).alias("max_output_tokens"))
        body = _with_tail(fields, {"text": {"format": {"type": "json_schema", "name": name, "schema": json_schema, "strict": True}}})
        where = ', "method": "POST", "url": "/v1/responses", "body": '
    elif provider == "anthropic":
        messages = F.array(F.struct(F.lit("user").alias("role"), said.alias("content")))
        fields = F.struct(F.lit(model_id).alias("model"), F.lit(max_tokens).alias("max_tokens"), F.lit(prompt).alias("system"), messages.alias("messages"))
        body = _with_tail(fields, {"output_config": {"format": {"type": "json_schema", "schema": json_schema}}})
        where = ', "params": '
    else:
        raise KeyError(provider)
    line = F.concat(F.substr(key, F.lit(1), F.length(key) - 1), F.lit(where), body, F.lit("}"))
    return docs.select(F.col("doc_id").alias("custom_id"), line.alias("request"))
