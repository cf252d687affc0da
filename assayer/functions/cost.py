"""Token and cost arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.types import MODELS

EXPECTED_OUTPUT_TOKENS = 300


def cost_usd(input_tokens: Column, output_tokens: Column, input_rate: Column, output_rate: Column, discount: Column | float = 1.0, digits: int = 6) -> Column:
    """Price of a call from rates per million tokens; a batch multiplies by its discount."""
    full = (input_tokens * input_rate + output_tokens * output_rate) / 1_000_000
    return F.round(full * discount, digits)


def token_estimate(prompt_chars: int, inputs: Column) -> Column:
    """Aggregate: a token for four characters, rounded down after the sum."""
    return F.floor(F.sum(F.lit(prompt_chars) + F.length(inputs)) / 4).cast("long")


def submit_estimate(documents: Column, input_tokens: Column, input_rate: Column, output_rate: Column, discount: Column | float) -> Column:
    """Expected price of a batch before it is sent."""
    return cost_usd(input_tokens, documents * EXPECTED_OUTPUT_TOKENS, input_rate, output_rate, discount)


def registry(spark: SparkSession, models: dict) -> DataFrame:
    """The model registry {batch_discount, models: {key: {...}}} as a small dimension."""
    rows = [
        (k, m["provider"], m["model_id"], float(m["input_usd_per_mtok"]), float(m["output_usd_per_mtok"]), float(models.get("batch_discount", 1.0)))
        for k, m in models["models"].items()
    ]
    return spark.createDataFrame(rows, MODELS)


def cheapest(models: DataFrame) -> DataFrame:
    """Per provider, the model with the lowest input price, the first key among equals."""
    return models.groupBy("provider").agg(F.min_by("key", F.struct("input_usd_per_mtok", "key")).alias("key"), F.min("input_usd_per_mtok").alias("input_usd_per_mtok"))
