"""Embedding near-duplicates: cross-polytope hashing with verified candidate pairs.

Distinct vectors are classes.  Each of some tables hashes a unit vector with a few functions: a
fast Hadamard transform after random sign flips, three times, then the nearest signed axis (the
cross-polytope vertex).  Besides its own bucket a vector enters those of its next best vertices
(multiprobe), by the smallest loss of the projected value.  Probes and tables are those with
the fewest entries that find a pair at the threshold with the target probability.

Within a bucket all pairs are verified: first by vectors of 8-bit numbers, with the bound that
their rounding sets on the error of a cosine, so no link is lost, and a spanning forest of those
pairs gives the components; then every pair within a component is compared by cosine in double
precision, so links are exact and do not depend on which buckets a pair met in.

Buckets and components may be of any size: they are compared in tiles of two blocks, which
report counts and spanning edges, never pairs.  Buckets with the same vectors are compared once.

Defined results: vectors that are null, empty, zero or hold null or non-finite components
link with nothing; so do vectors of different length with each other; repeated vectors (and
rows that repeat an id) link with each other; pairs at the threshold exactly are links; very
long vectors are hashed whole; extra columns are ignored, whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from assayer.llm.common import bounded_batches, exact_id, materialize, table
from assayer.llm.jaccard import class_table
from assayer.llm.linkage import compare_tiles, components, distinct_sets, tile_rows

COSINE = 0.95
SEED, RECALL = 4242, 0.9999
#: Probes tried, and tables beyond which fewer functions (so larger buckets) are taken.
PROBES, FEW_TABLES = range(1, 7), 64
#: Vectors of a block of a tile.
BLOCK = 128


def usable(values) -> np.ndarray | None:
    """The vector in double precision, or None if it takes no part."""
    if values is None or len(values) == 0:
        return None
    v = np.array([np.nan if x is None else x for x in values] if isinstance(values, list) else values, np.float64)
    if not np.isfinite(v).all() or not v.any():
        return None
    return v


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each column (length a power of two), orthonormal."""
    d, n = x.shape
    x = x / math.sqrt(d)
    h = 1
    while h < d:
        y = x.reshape(d // (2 * h), 2, h, n)
        low, high = y[:, 0], y[:, 1]
        low += high
        high *= -2
        high += low
        h *= 2
    return x


@functools.cache
def signs(table_no: int, function: int, d: int) -> np.ndarray:
    """The random sign flips of one function's three rounds."""
    rng = np.random.default_rng([SEED, table_no, function, d])
    return np.stack([rng.choice([-1.0, 1.0], d) for _ in range(3)])


def rotated(unit: np.ndarray, table_no: int, function: int) -> np.ndarray:
    d = 1 << max(0, (unit.shape[1] - 1).bit_length())
    x = np.zeros((d, len(unit)))
    x[: unit.shape[1]] = unit.T
    for flips in signs(table_no, function, d):
        x = hadamard(x * flips[:, None])
    return x.T


def functions_for(rows: int, dim: int, probes: int) -> int:
    """Hash functions of a table: so many that a bucket expects less than one random vector."""
    vertices = 2 << max(0, (dim - 1).bit_length())
    return max(1, math.ceil(math.log(max(rows, 1) * (1 + probes)) / math.log(vertices)))


def chance(functions: int, dim: int, cosine: float, probes: int) -> float:
    """Probability that a table finds a pair at the threshold, measured on random pairs with that cosine."""
    rng = np.random.default_rng(SEED)
    x, u = rng.normal(size=(2, 600, dim))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    if dim < 2:
        return 1.0
    u -= (u * x).sum(axis=1)[:, None] * x
    u /= np.sqrt((u * u).sum(axis=1))[:, None]
    a, b = (buckets(v, functions, 4, probes) for v in (x, cosine * x + math.sqrt(1 - cosine**2) * u))
    return float((a[:, :, :, None] == b[:, :, None, :]).any(axis=(2, 3)).mean())


def tables_for(functions: int, dim: int, cosine: float, probes: int, recall: float) -> int:
    """Tables that find a pair at the threshold with the target probability; never fewer."""
    p = chance(functions, dim, cosine, probes)
    if p <= 0:
        raise ValueError(f"{functions} functions and {probes} probes never find a pair at cosine {cosine} in {dim} dimensions")
    return max(2, math.ceil(math.log(1 - recall) / math.log(1 - min(p, 0.999))))


def scheme(rows: int, dim: int, cosine: float, recall: float, probes: int | None = None) -> tuple[int, int, int]:
    """(functions, tables, probes) that meet the recall with the fewest entries a vector.

    Where that takes very many tables, buckets are made larger by fewer functions.
    """
    found = []
    for n in [probes] if probes is not None else PROBES:
        for functions in range(functions_for(rows, dim, n), 0, -1):
            if chance(functions, dim, cosine, n) > 0:
                tables = tables_for(functions, dim, cosine, n, recall)
                found.append((tables > FEW_TABLES, tables * (1 + n), functions, tables, n))
                if tables <= FEW_TABLES:
                    break
    if not found:
        raise ValueError(f"no buckets find a pair at cosine {cosine} in {dim} dimensions")
    return min(found)[2:]


def buckets(unit: np.ndarray, functions: int, tables: int, probes: int) -> np.ndarray:
    """(vectors, tables, 1 + probes) bucket numbers; probes change the cheapest vertex choices."""
    n = len(unit)
    out = np.empty((n, tables, 1 + probes), np.int64)
    for t in range(tables):
        choice, second, loss = [], [], []
        for f in range(functions):
            x = rotated(unit, t, f)
            signed = np.concatenate([x, -x], axis=1)
            k = min(1 + probes, signed.shape[1])
            top = np.argpartition(-signed, k - 1, axis=1)[:, :k]
            value = np.take_along_axis(signed, top, axis=1)
            order = np.argsort(-value, axis=1, kind="stable")
            top, value = np.take_along_axis(top, order, axis=1), np.take_along_axis(value, order, axis=1)
            choice.append(top[:, 0])
            second.append(top[:, 1:])
            loss.append(value[:, :1] - value[:, 1:])
        width = 2 * x.shape[1]
        main = sum(c * width**f for f, c in enumerate(choice))
        out[:, t, 0] = main
        alternatives = np.concatenate([main[:, None] + (s - c[:, None]) * width**f for f, (c, s) in enumerate(zip(choice, second))], axis=1)
        best = np.argsort(np.concatenate(loss, axis=1), axis=1, kind="stable")[:, :probes]
        got = np.take_along_axis(alternatives, best, axis=1)
        out[:, t, 1 : 1 + got.shape[1]] = got
        out[:, t, 1 + got.shape[1] :] = main[:, None]
    return out


def sketch(unit: np.ndarray) -> list[bytes]:
    """Each unit vector as its scale, the length of its rounding error, and 8-bit numbers."""
    scale = np.abs(unit).max(axis=1, keepdims=True) / 127
    small = np.rint(unit / scale).astype(np.int8)
    error = np.sqrt(((unit - small * scale) ** 2).sum(axis=1, keepdims=True))
    head = np.concatenate([scale, error], axis=1).astype("<f8")
    return [h.tobytes() + v.tobytes() for h, v in zip(head, small)]


def _link_sketches(cosine: float):
    """Pairs whose cosine may reach the threshold: the errors a and b move it by a + b + a b at most."""

    def link(tile: dict, left: int) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(b"".join(tile["sketch"]), np.uint8).reshape(len(tile["sketch"]), -1)
        head = np.ascontiguousarray(raw[:, :16]).view("<f8")
        x, e = raw[:, 16:].view(np.int8) * head[:, :1], head[:, 1]
        lo = 0 if left == len(x) else left
        most = e[:left, None] + e[None, lo:] + e[:left, None] * e[None, lo:] + 1e-9
        a, b = np.nonzero(x[:left] @ x[lo:].T + most >= cosine)
        b = b + lo
        return a[a < b], b[a < b]

    return link


def _link(cosine: float, dtype: str):
    def link(tile: dict, left: int) -> tuple[np.ndarray, np.ndarray]:
        x = np.frombuffer(b"".join(tile["vector"]), dtype).reshape(len(tile["vector"]), -1).astype(np.float64)
        x = x / np.sqrt((x * x).sum(axis=1))[:, None]
        lo = 0 if left == len(x) else left
        a, b = np.nonzero(x[:left] @ x[lo:].T >= cosine)
        b = b + lo
        return a[a < b], b[a < b]

    return link


def element_type(vectors: DataFrame, vector_col: str) -> str:
    """numpy's name of the type that holds the column's components exactly."""
    return "<f4" if isinstance(vectors.schema[vector_col].dataType.elementType, FloatType) else "<f8"


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, probes: int | None = None, recall: float = RECALL) -> DataFrame:
    """doc_id, n_links, class_id of every vector (its id, links and component)."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    dtype = element_type(vectors, vector_col)
    width = int(dtype[-1])

    def read(batches):
        for pdf in batches:
            keys, blobs = [], []
            for i, v in zip(pdf["doc_id"], pdf["v"]):
                u = None if pd.isna(i) else usable(v)
                blobs.append(None if u is None else (u + 0.0).astype(dtype).tobytes())
                keys.append(None if u is None else hashlib.md5(blobs[-1]).digest())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "class_key": keys, "vector": blobs})

    # read twice, as the rows need as much room as the input
    slim = vectors.selectExpr(exact_id(id_col, "doc_id"), f"`{vector_col}` AS v").mapInPandas(read, "doc_id string, class_key binary, vector binary")
    slim = slim.withColumn("doc_id", F.col("doc_id").cast("long"))
    classes = slim.filter(F.col("class_key").isNotNull()).groupBy("class_key")
    classes = classes.agg(F.struct(F.min("doc_id").alias("doc_id")).alias("own"), F.count(F.lit(1)).alias("weight"), F.first("vector").alias("vector"))
    classes = materialize(classes.withColumn("node", F.xxhash64("class_key")), "classes")
    sizes = classes.groupBy((F.octet_length("vector") / width).cast("int").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()
    plans = {r["dim"]: scheme(r["n"], r["dim"], cosine, recall, probes) for r in sizes}

    def units(pdf, d):
        x = np.frombuffer(b"".join(pdf["vector"]), dtype).reshape(len(pdf), d).astype(np.float64)
        return x / np.sqrt((x * x).sum(axis=1))[:, None]

    def by_size(pdf):
        sizes = np.array([len(v) // width for v in pdf["vector"]], np.int64)
        return [(int(d), pdf[sizes == d]) for d in np.unique(sizes)]

    def hashed(batches):
        for pdf in batches:
            for d, some in by_size(pdf):
                functions, tables, n_probes = plans[d]
                keys = buckets(units(some, d), functions, tables, n_probes).reshape(len(some), tables, -1)
                keys.sort(axis=2)
                new = np.ones(keys.shape, bool)
                new[:, :, 1:] = keys[:, :, 1:] != keys[:, :, :-1]
                row, tab, _ = np.nonzero(new)
                yield pd.DataFrame({"node": some["node"].to_numpy()[row], "dim": np.full(len(row), d, np.int32), "tab": tab.astype(np.int32), "bucket": keys[new]})

    def sketched(batches):
        for pdf in batches:
            for d, some in by_size(pdf):
                yield pd.DataFrame({"node": some["node"], "sketch": sketch(units(some, d))})

    entries = classes.select("node", "vector").mapInPandas(hashed, "node long, dim int, tab int, bucket long")
    entries = materialize(entries.select("node", F.xxhash64("dim", "tab", "bucket").alias("group")), "buckets")
    met = materialize(distinct_sets(entries), "met")
    small = classes.select("node", "vector").mapInPandas(sketched, "node long, sketch binary").withColumn("weight", F.lit(1))
    met = compare_tiles(tile_rows(met, BLOCK).join(small, "node"), ["sketch"], _link_sketches(cosine))
    edges = met.filter("node <> root").select(F.col("node").alias("src"), F.col("root").alias("dst")).distinct()
    groups = materialize(components(edges).select(F.col("root").alias("group"), "node"), "groups")
    payload = classes.select("node", "weight", "vector")
    linked = compare_tiles(tile_rows(groups, BLOCK).join(payload, "node"), ["vector"], _link(cosine, dtype))
    return class_table(slim, classes, materialize(linked, "links"))


def near_duplicate_report(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("doc_id").alias("vec_id"), "n_links", F.col("class_id").alias("component_id"), (F.col("doc_id") == F.col("class_id")).alias("kept"))


#: Brute force in DuckDB SQL.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), r AS (
  SELECT vec_id AS node, vec_id AS root FROM v UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.node
), t AS (SELECT node, MIN(root) AS root FROM r GROUP BY node),
m AS (SELECT x, COUNT(*) AS k FROM l GROUP BY x)
SELECT e.vec_id, COALESCE(m.k, 0) AS n_links, COALESCE(t.root, e.vec_id) AS component_id, COALESCE(t.root, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN t ON t.node = e.vec_id LEFT JOIN m ON m.x = e.vec_id
"""
