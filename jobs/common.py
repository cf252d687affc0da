"""What the jobs share: settings from a small TOML file, and logs."""

from __future__ import annotations

import logging
import sys
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DEFAULTS = __file__.rpartition("/")[0]


def settings(spark: SparkSession, path: str) -> dict:
    """A TOML file of any store that Spark reads."""
    return tomllib.loads(spark.read.text(path, wholetext=True).first()[0])


def own_settings(name: str) -> dict:
    """The settings that come with a job, for use without a file."""
    with open(f"{DEFAULTS}/{name}.toml", "rb") as f:
        return tomllib.load(f)


def table_at(spark: SparkSession, path: str, schema: str, by: list[str]) -> DataFrame:
    """The partitioned table at a path, which is made, empty, if nothing is there yet."""
    columns = [F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)]
    spark.range(0).select(*columns).write.mode("append").partitionBy(*by).parquet(path)
    return spark.read.schema(schema).parquet(path)


def log_to_stderr() -> None:
    logging.basicConfig(stream=sys.stderr, level=logging.INFO, format="%(asctime)s %(name)s %(message)s")


def session(name: str) -> SparkSession:
    """The session of a command line; cluster settings come from spark-submit."""
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
