"""Bounds of what Spark hands to Python at once."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows and bytes of one Arrow batch handed to Python, so that very long texts stay bounded.
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch can hold; smaller settings of the session stay."""
    for key, most in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
        ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES),
    ):
        now = spark.conf.get(key, None)
        digits = "".join(c for c in (now or "") if c.isdigit())
        if not digits or not 0 < int(digits) <= most or now != digits:
            spark.conf.set(key, str(most))
