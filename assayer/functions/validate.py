"""Validation of extracted payloads: JSON text to a typed record or a schema violation.

Rules are lax on types and strict on values: numeric text counts as a number, a whole double
as an integer, midnight timestamps and whole days since 1970 (in seconds or milliseconds) as
dates; a missing key, an unknown enum value, a fractional integer or a number in place of text
is a violation; unknown keys are dropped.

:func:`with_record` validates a column of a table in staged projections, each of which reads the
columns of the one before and stays in generated code.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.types import ENUMS, NOT_NULL_FIELDS, RECORD_FIELDS

DATE = r"^\d{4}-\d{2}-\d{2}(T00:00:00(\.0+)?(Z|[+-]00:00)?)?$"
#: Numbers up to this size are seconds since 1970, larger ones milliseconds.
SECONDS = 20_000_000_000
NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def _seen(v: Column, name: str) -> dict[str, Column]:
    """One field of a variant object: itself (null if missing), its type and its text."""
    part = F.try_variant_get(v, f"$.{name}", "variant")
    return {"part": part, "what": F.schema_of_variant(part), "text": F.try_variant_get(v, f"$.{name}", "string")}


def _value(s, kind: str) -> Column:
    """The field's value, null where it has none of its kind."""
    what, text = s["what"], s["text"]
    is_text = what == "STRING"
    if kind in ("enum", "string"):
        return F.when(is_text, text)
    number = F.when(is_text & text.rlike(NUMBER), F.trim(text).try_cast("double"))
    number = number.when(what.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(s["part"], "$", "double"))
    if kind == "date":
        days = F.when(F.abs(number) <= SECONDS, number / 86_400).otherwise(number / 86_400_000)
        whole = F.when(days == F.floor(days), F.date_add(F.lit(dt.date(1970, 1, 1)), days.try_cast("int")))
        return F.when(is_text & text.rlike(DATE), F.substring(text, 1, 10).try_cast("date")).otherwise(whole)
    number = number.when(what == "BOOLEAN", F.try_variant_get(s["part"], "$", "boolean").cast("double"))
    return F.when(number == F.floor(number), number.try_cast("int")) if kind == "int" else number


def _valid(s, value: Column, name: str, kind: str) -> Column:
    """Whether the field is there and may have its value."""
    null = s["what"] == "VOID"
    if kind in ("enum", "string"):
        ok = value.isin(*ENUMS[name]) if kind == "enum" else value.isNotNull()
        ok = ok if name in NOT_NULL_FIELDS else null | ok
    else:
        ok = null | value.isNotNull()
        if kind not in ("date", "int"):
            ok = ok | (s["what"] == "STRING") & (F.lower(F.trim(s["text"])) == "nan")
    return s["part"].isNotNull() & F.coalesce(ok, F.lit(False))


def _result(is_json: Column, is_object: Column, bad: Column, values: dict[str, Column]) -> Column:
    ok = is_object & (F.size(bad) == 0)
    record = F.struct(*[v.alias(n) for n, v in values.items()])
    error = F.when(~is_json, "schema_violation: not JSON").when(~is_object, "schema_violation: no object")
    error = error.when(F.size(bad) > 0, F.concat(F.lit("schema_violation: "), F.array_join(bad, ", ")))
    return F.struct(ok.alias("ok"), F.when(ok, record).alias("record"), error.alias("error"))


def _bad(valid: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(~ok, F.lit(n)) for n, ok in valid.items()]))


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def with_record(df: DataFrame, payload: Column, out: str) -> DataFrame:
    """``df`` with ``out``, struct(ok, record, error) of a payload; null where the payload is."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != out]).alias("row")
    df = df.select(row, payload.isNotNull().alias("given"), F.try_parse_json(payload).alias("v"))
    seen = [c.alias(f"{k}_{n}") for n in RECORD_FIELDS for k, c in _seen(F.col("v"), n).items()]
    df = df.select("row", "given", F.col("v").isNotNull().alias("is_json"), _is_object(F.col("v")).alias("is_object"), *seen)
    of = lambda n: {k: F.col(f"{k}_{n}") for k in ("part", "what", "text")}
    df = df.select("*", *[_value(of(n), kind).alias(f"value_{n}") for n, kind in RECORD_FIELDS.items()])
    bad = _bad({n: _valid(of(n), F.col(f"value_{n}"), n, kind) for n, kind in RECORD_FIELDS.items()})
    df = df.select("row", "given", "is_json", "is_object", bad.alias("bad"), *[f"value_{n}" for n in RECORD_FIELDS])
    result = _result(F.col("is_json"), F.col("is_object"), F.col("bad"), {n: F.col(f"value_{n}") for n in RECORD_FIELDS})
    return df.select("row.*", F.when(F.col("given"), result).alias(out))
