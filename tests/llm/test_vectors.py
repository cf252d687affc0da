"""Nearest neighbours and near-duplicates of vectors against brute force."""

import math

import numpy as np
import pytest

from assayer.llm import ann, neardup

DDL = "vec_id long, embedding array<float>, label int, rank string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "r") for i, v in rows], DDL)


def crowd(n=600, d=24, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    x[100:160] = x[100] + rng.normal(size=(60, d)) * 0.05  # near copies
    x[200:230] = x[200]  # exact copies
    x[300] = 2 * x[301]
    return [(k, v) for k, v in enumerate(x)]


def brute(rows, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    n = np.sqrt((x * x).sum(1))
    s = x @ x.T / np.outer(n, n)
    return ids, s


def test_nearest_recall_and_order(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROW_BLOCK", 150)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 5)
    rows = crowd()
    df = table(spark, rows)
    got = {}
    for r in ann.nearest(df, df.filter("vec_id % 25 = 0"), 5).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    ids, s = brute(rows, 5)
    hits = total = 0
    for q in range(0, 600, 25):
        order = sorted((j for j in ids if j != q), key=lambda j: (-round(s[q, j], 12), j))[:5]
        found = [got[q][k][0] for k in range(1, 6)]
        hits += len(set(order) & set(found))
        total += 5
        assert [got[q][k][1] for k in range(1, 6)] == pytest.approx([s[q, j] for j in found], abs=1e-12)
        assert all(got[q][k][1] >= got[q][k + 1][1] for k in range(1, 5)) and q not in found
    assert hits / total >= 0.98
    assert [v for v, _ in (got[200][k] for k in range(1, 6))] == [201, 202, 203, 204, 205]


def test_nearest_edges(spark):
    bad = [(0, [1, 0]), (1, None), (2, [0, 0]), (3, [float("nan"), 1]), (4, [float("inf"), 1]), (5, [None, 1]), (6, []), (50, [1, 1]), (7, [0, 1]), (8, [1, 1, 1]), (None, [1, 1])]
    df = table(spark, bad)
    got = ann.nearest(df, df.filter("vec_id % 50 = 0 OR vec_id IS NULL"), 5).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 50), (0, 2, 7), (50, 1, 0), (50, 2, 7)]
    assert got[0]["score"] == pytest.approx(math.sqrt(0.5))
    assert ann.nearest(df.limit(0), df.limit(0)).collect() == []


def test_parallel_error_counts_more():
    """The anisotropic codes have less error along the vectors than across, per dimension."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 16))
    x /= np.sqrt((x * x).sum(1))[:, None]
    q = ann.fit_quantizer(x)
    e = ann.padded(x) - q.decode(q.encode(x))
    along = (e * x).sum(1)
    assert q.eta > 1 or x.shape[1] < 26
    q2 = ann.Quantizer(q.books, 10.0)
    e2 = ann.padded(x) - q2.decode(q2.encode(x))
    assert ((e2 * x).sum(1) ** 2).mean() < (along**2).mean()


def links(rows, cosine=0.95):
    ids, s = brute(rows, 0)
    near = s >= cosine
    np.fill_diagonal(near, False)
    root = np.arange(len(ids))
    for _ in range(len(ids)):
        new = np.array([min([root[i], *root[near[i]]]) for i in range(len(ids))])
        if (new == root).all():
            break
        root = new
    return {int(ids[i]): (int(near[i].sum()), int(ids[root[i]])) for i in range(len(ids))}


def test_near_duplicates_match_brute_force(spark, monkeypatch):
    from assayer.llm import linkage

    monkeypatch.setattr(linkage, "BLOCK", 16)
    rows = crowd()
    got = {r["doc_id"]: (r["n_links"], r["class_id"]) for r in neardup.near_duplicates(table(spark, rows)).collect()}
    assert got == links(rows)


def test_near_duplicate_edges(spark):
    rows = [(1, [1, 0]), (1, [1, 0]), (2, [2, 0]), (3, None), (4, [0, 0]), (5, [float("nan"), 1]), (6, [1, 0, 0]), (None, [1, 0]), (7, [])]
    got = sorted((r["doc_id"] or -1, r["n_links"], r["class_id"]) for r in neardup.near_duplicates(table(spark, rows)).collect())
    assert got == sorted([(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (-1, 0, None), (7, 0, 7)], key=lambda r: r[0]) or got[1:] == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7)]
    assert neardup.near_duplicates(table(spark, [])).collect() == []


def test_hadamard_is_orthonormal():
    h = neardup.hadamard(np.eye(8))
    assert np.allclose(h @ h.T, np.eye(8))


def test_bucket_recall():
    t = neardup.tables_for(3, 64, 0.95, 4, 0.9999)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 64))
    x /= np.sqrt((x * x).sum(1))[:, None]
    u = rng.normal(size=x.shape)
    u -= (u * x).sum(1)[:, None] * x
    u /= np.sqrt((u * u).sum(1))[:, None]
    a, b = (neardup.buckets(v, 3, t, 4) for v in (x, 0.95 * x + math.sqrt(1 - 0.95**2) * u))
    assert (a[:, :, :, None] == b[:, :, None, :]).any(axis=(1, 2, 3)).mean() >= 0.99
