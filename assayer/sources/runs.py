"""Tables that grow by runs: a partition for each run, merged when they are read.

A run (a collected batch, an extraction, a micro-batch of a stream) writes its own rows and nothing
else, whatever the size of the table; done again, after a crash or by mistake, it replaces exactly
what it wrote before.  Which row of a key counts is settled on read: that of the last run.  Names of
runs sort in the order of the runs: numbers are padded, others begin with a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from assayer.operators.store import last_wins
from assayer.sources.files import Files

RUN = "run"


def run_name(number: int) -> str:
    return f"{number:012d}"


def write_run(rows: DataFrame, path: str, run: str, fmt: str = "parquet") -> None:
    """The rows of a run, in place of those that it has written already."""
    rows.withColumn(RUN, F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(RUN).format(fmt).save(path)


def read_runs(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All rows of all runs, with their run; none where nothing has been written yet."""
    whole = StructType([*schema, StructField(RUN, StringType())])
    if not Files(spark).exists(path):
        return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in whole])
    return spark.read.schema(whole).parquet(path)


def read_latest(spark: SparkSession, path: str, schema: StructType, keys: list[str], *order: str) -> DataFrame:
    """Per key the row of the last run that has one, the last by ``order`` within it."""
    return last_wins(read_runs(spark, path, schema), keys, RUN, *order).drop(RUN)


def compact(spark: SparkSession, path: str, to: str, schema: StructType, keys: list[str], until: str, *order: str) -> None:
    """The table with the runs up to ``until`` merged into that one, written as a table of its own; later runs stay as they are.

    Readers and writers move on to the new path when it is whole; until then the old one serves.
    """
    rows = read_runs(spark, path, schema)
    merged = last_wins(rows.filter(F.col(RUN) <= until), keys, RUN, *order).withColumn(RUN, F.lit(until))
    merged.unionByName(rows.filter(F.col(RUN) > until)).write.partitionBy(RUN).parquet(to)
