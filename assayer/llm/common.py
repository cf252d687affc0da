"""Shared plumbing of the training-data operators.

Intermediate results that are used twice are written as Parquet below the shared
folder that the cluster names in ``spark.checkpoint.dir``; that cuts the lineage and
survives the loss of an executor.  Nothing is kept in executor-local storage.
"""

from __future__ import annotations

import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions.batches import bounded_batches  # noqa: F401


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share; a temporary one only in local mode."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        current = sc.getCheckpointDir()
        if current:
            return current
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="assayer-")
        sc.setCheckpointDir(found)
    return found


#: Paths written within the innermost open :class:`Scratch` of this thread.
_OPEN: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/assayer/{name}-{uuid.uuid4().hex}"
    if (mine := _OPEN.get()) is not None:
        mine.append(path)
    return path


class Scratch:
    """What is written inside the block, and only that, is dropped when it ends, but for what is kept."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        self._token = _OPEN.set(self.paths)
        return self

    def keep(self, path: str) -> None:
        self.paths.remove(path)

    def __exit__(self, *_) -> None:
        _OPEN.reset(self._token)
        for path in self.paths:
            drop_path(self.spark, path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a DataFrame that reads it back."""
    return Written(df, name).df


class Written:
    """A table in the shared folder that can be dropped once all that reads it has been written."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = scratch_path(self.spark, name)
        schema = df.schema
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(schema).parquet(self.path)

    def drop(self) -> None:
        drop_path(self.spark, self.path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exact_id(name: str, out: str) -> str:
    """SQL of an id as text, which pandas keeps as it is where a long with nulls becomes a double."""
    return f"CAST(CAST(`{name}` AS LONG) AS STRING) AS {out}"


def word_count(text: Column) -> Column:
    """Number of runs of characters outside the six ASCII white-space characters."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: crc32 of the id's text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


#: Most labelled rows that a classifier is fitted on (a uniform sample by hash of the id).
FIT_ROWS = 20_000


def hash_sample(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Of the rows that differ in ``keys``, the ``rows`` with the smallest hash of them.

    On larger tables a threshold on the hash, set from an estimate of the number of different
    rows and wide enough for half as many again, comes first: what is sorted and sent does
    not grow with the number of partitions, and rows repeated any number of times count once.
    """
    df = df.withColumn("_hash", F.shiftrightunsigned(F.xxhash64(*keys), 1))
    n = df.agg(F.approx_count_distinct("_hash", 0.02)).first()[0]
    if n > 2 * rows:
        df = df.filter(F.col("_hash") < int(1.5 * rows / n * 2**63))
    return df.dropDuplicates(["_hash"]).orderBy("_hash").limit(rows).drop("_hash")


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, text, target) of at most ``rows`` labelled training documents.

    Held-out ids, null ids and null labels take no part; an id labelled twice counts with
    its larger label, and of rows that repeat an id one text, the one with the smallest hash,
    is taken.  The sample of ids has a proven bound, so it may be broadcast.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias(target))
    known = known.filter(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & ~held_out(F.col("doc_id")))
    known = hash_sample(known.groupBy("doc_id").agg(F.max(target).alias(target)), ["doc_id"], rows)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    own = own.join(F.broadcast(known), "doc_id")
    return own.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.max(target).alias(target))
