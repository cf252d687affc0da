"""Approximate nearest neighbours with score-aware anisotropic quantisation.

Unit vectors are coded by a product quantiser of two-dimensional subspaces with 16 centroids
each (four bits).  Codebooks and codes minimise ``|r|^2 + (eta - 1) (r . x)^2`` for residual
r of x: error parallel to a vector, which shifts its large inner products, costs eta times as
much as error across it.  A search looks codes up in per-query four-bit tables (quantised to
bytes, two tables at a time), takes the largest sums for a first exact threshold, and then
reranks in double precision every row whose sum, plus a bound on its quantisation error at
``SIGMAS`` standard deviations, reaches that threshold.  So the rerank set follows the data:
crowds of near copies are all reranked, and there is no cap on candidates.

The codebook is fitted on at most ``FIT_VECTORS`` different vectors; every row is coded and
scanned.  Rows are dealt in blocks by hash, queries in blocks too, and each pair of blocks is
one task-sized tile.  Of rows with equal vectors those that can be among a query's ``k`` nearest
are kept before that, so a vector repeated any number of times is no large block.

Defined results: vectors that are null, empty, zero or hold null or non-finite components
take no part; vectors of another length than the commonest among different rows (the shorter, among equals) take
no part; ties go to the smaller id; rows that share the query's id are the query's own, and
other rows that repeat an id are candidates of their own; fewer candidates than ``k`` give all
of them; very long vectors are coded whole; extra columns are ignored, whatever their names; an
empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.llm.common import bounded_batches, exact_id, hash_sample, materialize, table
from assayer.llm.neardup import element_type, usable

FIT_VECTORS, CENTROIDS, SUB, ROUNDS = 10_000, 16, 2, 8
#: Inner products above this share of the norms matter most; sets the weight of parallel error.
SCORE_THRESHOLD = 0.2
#: Rows and queries of a block: a tile's vectors take some megabytes.  Small tables are cut
#: into blocks down to LEAST_BLOCK rows, one for each partition.
ROW_BLOCK, QUERY_BLOCK, QUERY_STEP, LEAST_BLOCK = 16384, 8192, 64, 4096
#: Pairs scored exactly at a time.
PAIRS = 1 << 16
FIRST, SIGMAS = 8, 4.0


def padded(unit: np.ndarray) -> np.ndarray:
    """Zero columns up to a multiple of four, so that two codes fill a byte."""
    return np.pad(unit, ((0, 0), (0, -unit.shape[1] % (2 * SUB))))


class Quantizer:
    """Codebooks (subspaces, 16, 2) of an anisotropic product quantiser."""

    def __init__(self, books: np.ndarray, eta: float):
        self.books, self.eta = books, eta

    def encode(self, unit: np.ndarray, passes: int = 2) -> np.ndarray:
        """Codes (rows, subspaces) by coordinate descent on the anisotropic loss."""
        x = padded(unit).reshape(len(unit), -1, SUB)
        codes = np.empty(x.shape[:2], np.uint8)
        parallel = np.zeros(x.shape[:2])
        for s, book in enumerate(self.books):
            r = x[:, s, None, :] - book[None]
            codes[:, s] = (r * r).sum(-1).argmin(1)
            parallel[:, s] = ((x[:, s] - book[codes[:, s]]) * x[:, s]).sum(-1)
        total = parallel.sum(1)
        for _ in range(passes):
            for s, book in enumerate(self.books):
                r = x[:, s, None, :] - book[None]
                along = (r * x[:, s, None, :]).sum(-1)
                rest = (total - parallel[:, s])[:, None]
                best = ((r * r).sum(-1) + (self.eta - 1) * (rest + along) ** 2).argmin(1)
                codes[:, s] = best
                new = along[np.arange(len(x)), best]
                total += new - parallel[:, s]
                parallel[:, s] = new
        return codes

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.books[np.arange(len(self.books))[None, :], codes].reshape(len(codes), -1)


def fit_quantizer(unit: np.ndarray, seed: int = 7) -> Quantizer:
    """Lloyd's start, then alternating anisotropic codes and codebooks."""
    rng = np.random.default_rng(seed)
    d = unit.shape[1]
    x = padded(unit).reshape(len(unit), -1, SUB)
    eta = max(1.0, (d - 1) * SCORE_THRESHOLD**2 / (1 - SCORE_THRESHOLD**2))
    books = np.stack([x[rng.choice(len(x), CENTROIDS, replace=len(x) < CENTROIDS), s] for s in range(x.shape[1])])
    for _ in range(ROUNDS):
        for s in range(x.shape[1]):
            at = ((x[:, s, None] - books[s][None]) ** 2).sum(-1).argmin(1)
            for k in range(CENTROIDS):
                if (at == k).any():
                    books[s, k] = x[at == k, s].mean(0)
    model = Quantizer(books, eta)
    for _ in range(3):
        codes = model.encode(unit)
        r = x - books[np.arange(x.shape[1])[None], codes]
        along = (r * x).sum(-1)
        total = along.sum(1)
        for s in range(x.shape[1]):
            rest = total - along[:, s] + (x[:, s] ** 2).sum(-1)
            for k in range(CENTROIDS):
                v, q = x[codes[:, s] == k, s], rest[codes[:, s] == k]
                if len(v):
                    left = len(v) * np.eye(SUB) + (eta - 1) * v.T @ v
                    books[s, k] = np.linalg.solve(left, v.sum(0) + (eta - 1) * (q[:, None] * v).sum(0))
    return model


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row pair in double precision, summed component by component."""
    dot, na, nb = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for j in range(a.shape[1]):
        dot += a[:, j] * b[:, j]
        na += a[:, j] * a[:, j]
        nb += b[:, j] * b[:, j]
    return np.clip(dot / np.sqrt(na * nb), -1.0, 1.0)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _products(q: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the pairs (q[a], x[b]), a bounded number at a time."""
    return np.concatenate([np.einsum("ij,ij->i", q[a[k : k + PAIRS]], x[b[k : k + PAIRS]]) for k in range(0, len(a), PAIRS)] or [np.zeros(0)])


def _place(starts: np.ndarray, n: int) -> np.ndarray:
    """Place of each of n rows within its run, given where runs start."""
    return np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))


def search_block(model: Quantizer, q_id: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, spread: np.ndarray, k: int):
    """(query index, id, score) of each query's k nearest in the block, its own id left out.

    codes: two four-bit codes a byte; spread: the standard deviation of each row's error.
    """
    # of equal vectors only k rows of an id, and of these the 2 k smallest ids, can matter:
    # without a query's own id, k rows are left
    same = np.unique(np.ascontiguousarray(x).view(f"V{x.shape[1] * 8}").ravel(), return_inverse=True)[1]
    order = np.lexsort((ids, same))
    runs = same[order]
    copy = np.flatnonzero(np.concatenate([[True], (runs[1:] != runs[:-1]) | (ids[order][1:] != ids[order][:-1])]))
    few = _place(copy, len(order)) < k
    order, runs = order[few], runs[few]
    first = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]]))
    keep = np.sort(order[_place(first, len(order)) < 2 * k])
    ids, x, codes, spread = ids[keep], x[keep], codes[keep], spread[keep]
    halves = codes.shape[1]
    out = []
    unit_q, unit_x = _unit(q), _unit(x)
    unit = padded(unit_q).reshape(len(q), -1, SUB)
    for at in range(0, len(q), QUERY_STEP):
        some = slice(at, at + QUERY_STEP)
        lut = np.einsum("qsd,scd->qsc", unit[some], model.books)
        low = lut.min(axis=2, keepdims=True)
        scale = np.maximum((lut - low).max(axis=(1, 2)), 1e-12) / 255
        small = np.rint((lut - low) / scale[:, None, None]).astype(np.uint16)
        pair = (small[:, 0::2, None, :] + small[:, 1::2, :, None]).reshape(len(lut), halves, 256)
        # bytes of two tables are added halves times: sums of long vectors need more than 16 bits
        total = np.zeros((len(lut), len(ids)), np.uint16 if halves * 510 <= 65_535 else np.uint32)
        for h in range(halves):
            total += pair[:, h][:, codes[:, h]]
        about = total * scale[:, None] + low.sum(axis=(1, 2))[:, None]
        about[q_id[some][:, None] == ids[None, :]] = -np.inf
        m = min(len(ids), FIRST * k)
        top = np.argpartition(-about, m - 1, axis=1)[:, :m]
        rows = np.repeat(np.arange(len(lut)), m)
        exact = _products(unit_q[some], unit_x, rows, top.ravel()).reshape(len(lut), m)
        exact[~np.isfinite(np.take_along_axis(about, top, axis=1))] = -np.inf
        threshold = -np.partition(-exact, min(k, m) - 1, axis=1)[:, min(k, m) - 1]
        slack = SIGMAS * (spread[None, :] + scale[:, None] * math.sqrt(2 * halves / 12))
        a, b = np.nonzero((about + slack >= threshold[:, None]) & np.isfinite(about))
        # all of these in double precision, and those that reach the threshold summed in order
        near = _products(unit_q[some], unit_x, a, b) >= threshold[a] - 1e-9
        a, b = a[near], b[near]
        score = cosines(q[some][a], x[b])
        order = np.lexsort((ids[b], -score, a))
        a, b, score = a[order], b[order], score[order]
        start = np.searchsorted(a, a, side="left")
        best = np.arange(len(a)) - start < k
        out.append((a[best] + at, ids[b[best]], score[best]))
    return tuple(np.concatenate(c) for c in zip(*out))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of ``vectors`` to each of ``queries``."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    dtype = element_type(vectors, vector_col)

    def read(batches):
        for pdf in batches:
            got = [None if pd.isna(i) else usable(v) for i, v in zip(pdf["id"], pdf["v"])]
            blobs = [None if u is None else (u + 0.0).astype(dtype).tobytes() for u in got]
            yield pd.DataFrame({"id": pdf["id"], "v": blobs, "dim": [0 if u is None else len(u) for u in got]})[lambda d: d["dim"] > 0]

    def clean(df: DataFrame) -> DataFrame:
        rows = df.selectExpr(exact_id(id_col, "id"), f"`{vector_col}` AS v")
        return rows.mapInPandas(read, "id string, v binary, dim int").withColumn("id", F.col("id").cast("long"))

    def first(df: DataFrame, keys: list[str], order: str, most: int) -> DataFrame:
        """The first rows of each key; Spark limits them on both sides of the exchange."""
        place = F.row_number().over(W.partitionBy(*keys).orderBy(order))
        return df.withColumn("_n", place).filter(F.col("_n") <= most).drop("_n")

    # of equal vectors k rows of an id, and of these the 2 k with the smallest ids: without a
    # query's own id, k rows are left
    base = first(first(clean(vectors).withColumn("same", F.md5("v")), ["same", "id"], "same", k), ["same"], "id", 2 * k)
    base = materialize(base.drop("same"), "ann")
    sizes = base.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    dim, total = sizes["dim"], sizes["count"]
    base = base.filter(F.col("dim") == dim)
    sample = hash_sample(base, ["v"], FIT_VECTORS).select("v").collect()
    matrix = lambda c: np.frombuffer(b"".join(c), dtype).reshape(len(c), -1).astype(np.float64)
    model = fit_quantizer(_unit(matrix([r["v"] for r in sample])))

    def encode(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            unit = _unit(matrix(pdf["v"]))
            codes = model.encode(unit)
            error = padded(unit) - model.decode(codes)
            spread = np.sqrt((error * error).sum(axis=1) / dim)
            packed = codes[:, 0::2] | codes[:, 1::2] << 4
            yield pd.DataFrame({"id": pdf["id"], "v": pdf["v"], "code": [c.tobytes() for c in packed], "spread": spread})

    coded = base.select("id", "v").mapInPandas(encode, "id long, v binary, code binary, spread double")
    asked = materialize(clean(queries).filter(F.col("dim") == dim).select("id", "v").distinct(), "queries")
    spread_over = int(spark.conf.get("spark.sql.shuffle.partitions"))
    row_blocks = max(1, math.ceil(total / ROW_BLOCK), min(spread_over, math.ceil(total / LEAST_BLOCK)))
    query_blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")
    left = coded.withColumn("rb", block(row_blocks)).withColumn("qb", each(query_blocks))
    right = asked.withColumn("qb", block(query_blocks)).withColumn("rb", each(row_blocks))

    def scan(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(queries):
            return pd.DataFrame({"query_id": [], "query_key": [], "vec_id": [], "score": []})
        queries = queries.sort_values("id").reset_index(drop=True)
        rows = rows.sort_values("id").reset_index(drop=True)
        codes = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1)
        at, found, score = search_block(model, queries["id"].to_numpy(), matrix(queries["v"]), rows["id"].to_numpy(), matrix(rows["v"]), codes, rows["spread"].to_numpy(), k)
        return pd.DataFrame({"query_id": queries["id"].to_numpy()[at], "query_key": queries["key"].to_numpy()[at], "vec_id": found, "score": score})

    right = right.withColumn("key", F.xxhash64("v"))
    found = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInPandas(scan, "query_id long, query_key long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_report(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


#: Brute force in DuckDB SQL.
ORACLE = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
