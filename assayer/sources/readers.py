"""Scans: every schema is declared, nothing is inferred."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer import types as t
from assayer.functions.cost import registry
from assayer.operators.series import clean_level
from assayer.operators.store import last_wins, merge_precedence
from assayer.sources.files import Files
from assayer.sources.runs import read_latest


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A document catalogue; a malformed row fails the read."""
    return spark.read.schema(t.CATALOG).options(**t.CSV).option("mode", "FAILFAST").csv(path)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden events of all areas in one DataFrame; True/False text becomes boolean, empty null."""
    text = t.struct(", ".join(f"{f.name} string" for f in t.GOLDEN))
    raw = spark.read.schema(text).options(**t.CSV).csv(path)
    return raw.select(*[F.nullif(F.trim(f.name), F.lit("")).cast(f.dataType).alias(f.name) for f in t.GOLDEN])


def read_sdmx(spark: SparkSession, path: str, ref_area: str) -> DataFrame:
    """A daily level series: only the two columns that count, missing values as null."""
    raw = spark.read.options(**t.CSV).csv(path)
    if gone := sorted({"TIME_PERIOD", "OBS_VALUE"} - set(raw.columns)):
        raise ValueError(f"columns missing: {gone}")
    return raw.select(F.lit(ref_area).alias("ref_area"), F.to_date("TIME_PERIOD").alias("date"), clean_level(F.col("OBS_VALUE")).alias("level"))


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(t.ARTIFACT).json(path)


def latest_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Of a table of runs, each document's last artifact by model and prompt."""
    return read_latest(spark, path, t.ARTIFACT_TABLE, ["doc_id", "model_key", "prompt_version"])


def read_graded(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(t.GRADED).json(path)


def read_batch_states(spark: SparkSession, path: str) -> DataFrame:
    """One row per state file, in the order of their ids."""
    return spark.read.schema(t.BATCH_STATE).option("multiLine", True).json(path).orderBy("batch_id")


def batch_documents(states: DataFrame) -> DataFrame:
    """One row per requested document of each batch."""
    return states.select("batch_id", "provider", "model_key", "prompt_version", F.explode("documents").alias("d")).select("batch_id", "provider", "model_key", "prompt_version", "d.*")


def read_openai_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(t.OPENAI_LINE).json(path)


def read_anthropic_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(t.ANTHROPIC_LINE).json(path)


def read_scorecards(spark: SparkSession, path: str, model_key: str | None = None) -> DataFrame:
    """Scorecard documents by file name; an unknown model is an error."""
    cards = spark.read.schema(t.SCORECARD).option("multiLine", True).json(path).withColumn("_file", F.input_file_name())
    if model_key is not None:
        cards = cards.filter(F.col("model_key") == model_key)
        if cards.isEmpty():
            raise LookupError(f"no scorecard for model {model_key}")
    return cards.orderBy("_file").drop("_file")


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """The raw document cache ``<root>/<bank>/<doc_id>.html`` as (bank, doc_id, html)."""
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.html")
    parts = F.split(F.input_file_name(), "/")
    return raw.select(F.upper(F.element_at(parts, -2)).alias("bank"), F.regexp_replace(F.element_at(parts, -1), r"\.html$", "").alias("doc_id"), F.col("value").alias("html"))


def cached_pages(spark: SparkSession, root: str) -> DataFrame:
    """(bank, doc_id, html) of the cache: the files of :func:`read_documents`, and over them what has been fetched, last page first."""
    files = Files(spark)
    out = spark.range(0).selectExpr("'' AS bank", "'' AS doc_id", "'' AS html")
    if files.glob(f"{root}/*/*.html"):
        out = read_documents(spark, root)
    if files.exists(f"{root}/pages"):
        pages = spark.read.schema(t.PAGES).parquet(f"{root}/pages").filter("html IS NOT NULL")
        pages = last_wins(pages, ["doc_id"], "fetched_at").select(F.upper(F.substring_index("doc_id", "_", 1)).alias("bank"), "doc_id", "html")
        out = merge_precedence([out, pages], ["doc_id"])
    return out


def load_prompt(folder: str, version: str) -> str:
    """A prompt by version; the error names those there are."""
    path = Path(folder) / f"{version}.md"
    if not path.is_file():
        raise FileNotFoundError(f"no prompt {version!r}; there are {sorted(p.stem for p in Path(folder).glob('*.md'))}")
    return path.read_text(encoding="utf-8")


def load_models(spark: SparkSession, path: str) -> DataFrame:
    """The model registry from YAML (where that library is installed) or JSON."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        import yaml

        return registry(spark, yaml.safe_load(text))
    return registry(spark, json.loads(text))


def doc_types(catalog: DataFrame, traps: DataFrame | None = None) -> DataFrame:
    """doc_id -> doc_type over the decisions and, winning over them, the traps."""
    pick = lambda df: df.select("doc_id", "doc_type")
    return merge_precedence([pick(catalog), *([pick(traps)] if traps is not None else [])], ["doc_id"])


def announcements(catalog: DataFrame) -> DataFrame:
    """The announcement calendar: decisions only, never traps."""
    return catalog.select("bank", "announcement_date").distinct()


def load_documents(requested: DataFrame, catalog: DataFrame, cache: DataFrame) -> DataFrame:
    """Requested ids in their order with catalogue row and page; unknown or uncached ids fail."""
    known = requested.join(catalog, "doc_id", "left").join(cache.select("doc_id", "html"), "doc_id", "left")
    fail = lambda c, what: F.when(c.isNull(), F.raise_error(F.concat(F.lit(what), F.col("doc_id"))).cast("string")).otherwise(c)
    return known.withColumn("url", fail(F.col("url"), "unknown document ")).withColumn("html", fail(F.col("html"), "document not cached ")).orderBy("position")
