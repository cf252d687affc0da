"""Model inputs, with their expected price, from documents as they arrive.

    python -m jobs.prepare_inputs --documents PATH --output PATH --checkpoint PATH [--config FILE]

A file stream takes the Parquet files of a folder that its checkpoint does not know yet, and stops
when there are none.  Of each document that the output does not have, the text is normalised and
framed as the input of an extraction model, its tokens are estimated, and it is priced with the
model that would cost least.  A document without a usable text is kept as rejected, with the reason.

Output: one row per document, in Parquet, partitioned by micro-batch, status and bank.  A document
that comes again is not prepared (or paid for) again: the first one stays, within a micro-batch the
one with the smallest text.  Rows without an id cannot be told apart and stay, rejected, once for
each time they come.  A micro-batch that is run again after a crash sees only the batches before it
and replaces exactly its own partitions, so it ends with the same rows.  The output belongs to
its checkpoint: with a new one beside an old output the job refuses to start over.
"""

from __future__ import annotations

import argparse
import logging
import os
import sys

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions.cost import EXPECTED_OUTPUT_TOKENS, cost_usd
from assayer.functions.text import extractor_name, framed, normalize, source_label
from assayer.operators.store import first_wins
from jobs.common import log_to_stderr, own_settings, session, settings, table_at

log = logging.getLogger("jobs.prepare_inputs")
DOCUMENTS = "doc_id long, text string, lang string, source string"
BY = ["batch", "status", "bank"]
COLUMNS = ["doc_id", "source", "doc_type", "extractor", "model_input", "input_tokens", "model_key", "usd", "reason", "status", "bank"]
INPUTS = "doc_id long, source string, doc_type string, extractor string, model_input string, input_tokens long, model_key string, usd double, reason string, batch long, status string, bank string"


def cheapest_call(tokens: Column, config: dict) -> Column:
    """struct(usd, model_key) of the model whose call costs least, the first key among equals."""
    price = lambda m: cost_usd(tokens, F.lit(EXPECTED_OUTPUT_TOKENS), F.lit(float(m["input_usd_per_mtok"])), F.lit(float(m["output_usd_per_mtok"])), float(config["batch_discount"]))
    return F.array_min(F.array(*[F.struct(price(m).alias("usd"), F.lit(k).alias("model_key")) for k, m in config["models"].items()]))


def prepare(docs: DataFrame, config: dict) -> DataFrame:
    """One row of ``INPUTS`` (without its batch) for each row of documents."""
    banks = dict(config["banks"])
    other = banks.pop("other")
    bank = F.lit(other)
    for lang, name in banks.items():
        bank = F.when(F.col("lang") == lang, name).otherwise(bank)
    kind = F.when(F.col("source").isin(*config["minutes"]["sources"]), "minutes").otherwise("statement")
    rows = docs.select("doc_id", "source", bank.alias("bank"), kind.alias("doc_type"), normalize(F.coalesce("text", F.lit(""))).alias("clean"))
    reason = F.when(F.col("doc_id").isNull(), "no id").when(F.col("clean") == "", "no text")
    usable = lambda c: F.when(F.col("reason").isNull(), c)
    rows = rows.withColumn("reason", reason)
    rows = rows.withColumn("model_input", usable(framed(source_label(F.col("bank"), F.col("doc_type")), F.col("clean"))))
    rows = rows.withColumn("input_tokens", F.floor((F.lit(config["prompt_chars"]) + F.length("model_input")) / 4).cast("long"))
    rows = rows.withColumn("call", usable(cheapest_call(F.col("input_tokens"), config)))
    status = F.when(F.col("reason").isNull(), "ready").otherwise("rejected")
    rows = rows.withColumns({"extractor": extractor_name(F.col("bank"), F.col("doc_type")), "model_key": F.col("call.model_key"), "usd": F.col("call.usd"), "status": status})
    return rows.select(*COLUMNS)


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, config: dict) -> DataFrame:
    """Take what is new, wait for the stream's end, and return the whole output."""
    table_at(spark, output, INPUTS, BY)

    def take(batch: DataFrame, number: int) -> None:
        mine = batch.sparkSession
        there = mine.read.schema(INPUTS).parquet(output)
        if there.filter(F.col("batch") > number).limit(1).count():
            raise RuntimeError(f"{output} has batches that the checkpoint {checkpoint} does not know")
        # rows without an id are told apart by their place, and meet none that is known
        rows = batch.withColumn("_place", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()))
        known = there.filter(F.col("batch") < number).select("doc_id")
        new = first_wins(rows, ["doc_id", "_place"], "text").join(known, "doc_id", "left_anti")
        rows = prepare(new, config).withColumn("batch", F.lit(number).cast("long"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*BY).parquet(output)
        written = mine.read.schema(INPUTS).parquet(output).filter(F.col("batch") == number)
        for r in written.groupBy("status", "bank").agg(F.count(F.lit(1)).alias("n"), F.sum("input_tokens").alias("tokens"), F.round(F.sum("usd"), 2).alias("usd")).orderBy("status", "bank").collect():
            log.info("batch %d: wrote %d documents, %s, %s: %s tokens, %s dollars", number, r["n"], r["status"], r["bank"], r["tokens"] or 0, r["usd"] or 0)

    stream = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", int(config["files_per_batch"])).parquet(documents)
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("read %d new rows of %s", sum(p["numInputRows"] for p in query.recentProgress), documents)
    return spark.read.schema(INPUTS).parquet(output)


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("--documents", "--output", "--checkpoint"):
        p.add_argument(name, required=True)
    p.add_argument("--config", help="a TOML file; jobs/prepare_inputs.toml if not given")
    a = p.parse_args(args)
    log_to_stderr()
    spark = session("prepare_inputs")
    try:
        run(spark, a.documents, a.output, a.checkpoint, settings(spark, a.config) if a.config else own_settings("prepare_inputs"))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
