"""From raw documents to token ids: five stages, each of one training-data operator.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and
returns a DataFrame, which is written as Parquet and read again as the next one's ``docs``.
All stages but the last return the columns of ``docs``.

Defined results, stage by stage.  A null or empty text has a score like any other text in the two
classifiers, no near copies, size 0 in the mix (so it is never taken) and no tokens.  Null ids are
kept by the classifiers; rows that repeat an id or a whole row are rows of their own in the scores,
one group in the near copies if their texts are alike, and keep their number in the mix.  A score
equal to the quality bound stays, one equal to the toxicity bound goes.  Null sources are a source
of their own.  Very long texts are read whole, extra columns travel along whatever their names, and
an empty table goes through all stages as one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import bpe, jaccard, mixing, quality, toxicity
from assayer.llm.common import Scratch, Written, table

#: A document stays if its quality is at least, and its toxicity below, these scores.
LEAST_QUALITY, TOXIC = 0.3, 0.5


def keep_scored(docs: DataFrame, scored: Callable[[DataFrame, str], DataFrame], keep: Callable[[Column], Column]) -> DataFrame:
    """Documents whose score is kept, with the columns of ``docs``; the score takes a name that is free."""
    taken = {c.lower() for c in docs.columns}
    name = next(n for n in (f"_score{k}" for k in range(len(taken) + 1)) if n not in taken)
    return scored(docs, name).filter(keep(F.col(name))).drop(name)


def drop_junk(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return keep_scored(docs, lambda df, out: quality.score(df, model, out=out), lambda s: s >= LEAST_QUALITY)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents that it rejects go."""
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return keep_scored(docs, lambda df, out: toxicity.score(df, lexicon, out=out), lambda s: s < TOXIC)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: one document of each group stays."""
    return jaccard.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: a document appears as often as the mix takes it."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE: doc_id, n_tokens and digests of the ids and the decoded text of every row."""
    return bpe.digest_texts(docs, bpe.public_path())


STAGES = [
    ("quality", drop_junk),
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Learned classifiers are no SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents; what a stage of this run leaves behind is dropped."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with Scratch(spark) as scratch:
            out = Written(stage(spark, docs, sf_dir), f"pipeline-{name}")
            scratch.keep(out.path)
        if before:
            before.drop()
        docs, before = out.df, out
    return docs
