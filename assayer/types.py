"""Schemas of the engine's entities, as data: no session is needed to import them."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = "s1"
#: CSV as most programs write it: a header, and a quote within quotes doubled.
CSV = {"header": True, "quote": '"', "escape": '"'}
BANKS = ("FED", "ECB")
ACTIONS = ("hike", "cut", "hold", "no_policy_decision")
DOC_TYPES = ("statement", "decision", "minutes", "non_decision")
TRAP_DOC_TYPES = ("minutes", "non_decision")
STATUSES = ("graded", "extraction_failed", "ungradeable_redefinition_window", "ungradeable_corridor_only")


_PLAIN = {"string": T.StringType, "date": T.DateType, "int": T.IntegerType, "long": T.LongType, "double": T.DoubleType, "boolean": T.BooleanType}


def _split(text: str) -> list[str]:
    """Parts between commas that stand outside angle brackets."""
    out, depth, part = [], 0, ""
    for c in text:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += c
    return [x.strip() for x in [*out, part]]


def _type(text: str) -> T.DataType:
    if text.startswith("array<"):
        return T.ArrayType(_type(text[6:-1].strip()))
    if text.startswith("struct<"):
        return struct(text[7:-1], ":")
    return _PLAIN[text]()


def struct(ddl: str, sep: str = " ") -> T.StructType:
    """A StructType from ``name type, ...``, without a session (Spark's own parser needs one)."""
    fields = [f.split(sep, 1) for f in _split(ddl)]
    return T.StructType([T.StructField(n.strip(), _type(t.strip())) for n, t in fields])


#: Fields of an extracted record with their kinds; all keys are required, null is an abstention.
RECORD_FIELDS = {
    "bank": "enum", "decision_date": "date", "effective_date": "date", "action": "enum", "change_bps": "int",
    "target_range_lower_pct": "double", "target_range_upper_pct": "double", "dfr_pct": "double", "mro_pct": "double", "mlf_pct": "double",
    "evidence_quote": "string",
}
NOT_NULL_FIELDS = ("bank", "action", "evidence_quote")
ENUMS = {"bank": BANKS, "action": ACTIONS}
RECORD_DDL = ", ".join(f"{k}: {'string' if v in ('enum', 'date', 'string') else v}" for k, v in RECORD_FIELDS.items())
RECORD = struct(", ".join(f"{k} {'string' if v in ('enum', 'string') else v}" for k, v in RECORD_FIELDS.items()))


def record_json_schema() -> dict:
    """The record as a JSON schema for constrained output: dates are strings, nothing is optional."""
    kinds = {"date": "string", "int": "integer", "double": "number", "string": "string", "enum": "string"}
    props: dict = {}
    for name, kind in RECORD_FIELDS.items():
        base = kinds[kind]
        props[name] = {"type": base if name in NOT_NULL_FIELDS else [base, "null"]}
        if kind == "enum":
            props[name]["enum"] = list(ENUMS[name])
    return {"type": "object", "properties": props, "required": list(RECORD_FIELDS), "additionalProperties": False}


#: Fetched pages, in Spark's own notation.
PAGES = "doc_id string, url string, host string, html string, error string, fetched_at timestamp"
CATALOG = struct("bank string, doc_id string, announcement_date date, url string, doc_type string")
LEVELS = struct("ref_area string, date date, level double")
GOLDEN = struct(
    "ref_area string, effective_date date, old_level double, new_level double, change_bps int, direction string, "
    "instrument string, excluded boolean, exclusion_reason string, audit_note string"
)
ARTIFACT = struct(
    "doc_id string, bank string, announcement_date string, model_key string, prompt_version string, schema_version string, "
    f"ok boolean, record struct<{RECORD_DDL}>, error string, input_tokens int, output_tokens int, cost_usd double, latency_ms int"
)
#: The same in a table, where dates are dates.
ARTIFACT_TABLE = T.StructType([T.StructField(f.name, RECORD if f.name == "record" else f.dataType) for f in ARTIFACT])
GRADED = struct(
    "doc_id string, bank string, model_key string, prompt_version string, announcement_date string, status string, "
    "expected_kind string, action_correct boolean, fabricated_decision boolean, wrong_direction boolean, change_bps string, "
    "level string, effective_date string, decision_date string"
)
_RATE = "struct<rate: double, n: long, ci95: array<double>>"
_THREE = "struct<n: long, correct: double, wrong: double, abstained: double>"
SCORECARD = struct(
    "model_key string, prompt_version string, documents long, graded long, extraction_failed long, ungradeable long, events long, holds long, "
    f"action_accuracy {_RATE}, hallucination_rate {_RATE}, fabricated_decision_rate {_RATE}, change_bps {_THREE}, level {_THREE}, effective_date {_THREE}, decision_date {_THREE}, "
    f"traps struct<documents: long, graded: long, extraction_failed: long, false_positive_rate: {_RATE}>, cost_usd double, input_tokens long, output_tokens long"
)
MODELS = struct("key string, provider string, model_id string, input_usd_per_mtok double, output_usd_per_mtok double, batch_discount double")
LEDGER = struct(
    "timestamp_utc string, model_key string, prompt_version string, documents long, input_tokens long, output_tokens long, cost_usd double, run_id string"
)
BATCH_MEMBER = struct("doc_id string, bank string, announcement_date string")
BATCH_STATE = struct(
    "batch_id string, provider string, model_key string, prompt_version string, schema_version string, submitted_at_utc string, status string, "
    "collected boolean, estimated_input_tokens long, documents array<struct<doc_id: string, bank: string, announcement_date: string>>, "
    "openai_output_file_id string, openai_error_file_id string, openai_errors string, collected_at_utc string, missing_doc_ids array<string>"
)
TRACE = struct(
    "id long, timestamp_utc string, doc_id string, bank string, model_key string, prompt_version string, input_tokens long, "
    "output_tokens long, cost_usd double, latency_ms long, ok int, error string"
)
_ERROR = "struct<code: string, message: string>"
OPENAI_LINE = struct(
    f"custom_id string, response struct<status_code: int, body: struct<status: string, incomplete_details: struct<reason: string>, "
    f"output: array<struct<type: string, content: array<struct<type: string, text: string>>>>, usage: struct<input_tokens: int, output_tokens: int>, "
    f"error: {_ERROR}>>, error {_ERROR}"
)
ANTHROPIC_LINE = struct(
    "custom_id string, result struct<type: string, error: string, message: struct<content: array<struct<type: string, text: string>>, "
    "usage: struct<input_tokens: int, output_tokens: int>, stop_reason: string>>"
)
