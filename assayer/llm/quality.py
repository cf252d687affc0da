"""Quality by a generalised additive model with pairwise interactions.

Each text becomes a row of bounded features (counts, shares of character classes, repetition,
line shapes, compressibility).  Features are cut into quantile bins.  Cyclic boosting visits
one feature after the other, fits a shallow tree on its binned gradients and adds it to the
feature's lookup table; then the pairs of features with the largest gain on what is left get
tables of their own.  A score is the logistic of the intercept plus one table entry per
feature and pair: vectorised look-ups and additions.

Fitting uses at most ``FIT_ROWS`` labelled rows (features only go to the driver); scoring
reads every whole text.

Defined results: null text is empty; an empty text has all features 0 and is scored as such;
repeated rows score alike; with no labelled rows or one class only, every score is the
smoothed share of label 1; extra columns are carried along by :func:`score`.  A value equal to a
bin's edge is in the bin above it; of splits of equal gain the first is taken.  Very
long texts are read whole; rows with a null id are scored, but never fitted on; an empty table has
no scores.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import bounded_batches, held_out, labelled_sample, table

BINS, PAIR_BINS, PAIRS = 32, 8, 8
ROUNDS, PAIR_ROUNDS, RATE = 200, 100, 0.1
LEAST_ROWS = 5
FEATURES = (
    "words", "word_length", "longest_word", "distinct_words", "repeated_next", "lines", "line_length", "distinct_lines",
    "upper", "lower", "digits", "blanks", "stops", "exclaims", "signs", "bars", "brackets", "other_bytes", "compressed",
)


def _classes() -> np.ndarray:
    out = np.zeros(256, np.int64)
    for k, chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\n\r", b".,;:", b"!?", b"#$%&*@^~+=", b"|", b"()[]{}<>/\\"), 1):
        out[list(chars)] = k
    out[128:] = 10
    return out


_CLASS = _classes()


def features(text: str) -> list[float]:
    """The features of one whole text."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = text.encode()
    words, lines = text.split(), text.split("\n")
    n = len(words) or 1
    by_class = np.bincount(_CLASS, weights=np.bincount(np.frombuffer(raw, np.uint8), minlength=256), minlength=11)[1:] / len(raw)
    return [
        np.log1p(len(words)), len(text) / n, np.log1p(max(map(len, words), default=0)), len(set(words)) / n, sum(map(eq, words, words[1:])) / n,
        np.log1p(len(lines)), np.log1p(len(text) / len(lines)), len(set(lines)) / len(lines),
        *by_class, len(zlib.compress(raw, 1)) / (len(raw) + 20),
    ]


def feature_matrix(texts) -> np.ndarray:
    return np.array([features(t or "") for t in texts], float).reshape(-1, len(FEATURES))


@dataclass
class Gam:
    """Bin edges and lookup tables of each feature and of each chosen pair."""

    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, (e, t) in enumerate(zip(self.edges, self.tables)):
            total += t[np.searchsorted(e, x[:, j], side="right")]
        for i, j, t in self.pairs:
            total += t[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _quantile_edges(v: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(v, np.arange(1, bins) / bins, method="higher"))


def _gain(g, h):
    return g * g / (h + 1.0)


def _shallow_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int = 3) -> np.ndarray:
    """A tree of few leaves over a histogram's bins: the Newton step of each bin's leaf."""
    cuts = [0, len(g)]
    G, H, N = (np.concatenate([[0], np.cumsum(v)]) for v in (g, h, n))
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for lo, hi in zip(cuts, cuts[1:]):
            k = np.arange(lo + 1, hi)
            k = k[(N[k] - N[lo] >= LEAST_ROWS) & (N[hi] - N[k] >= LEAST_ROWS)]
            if len(k):
                gain = _gain(G[k] - G[lo], H[k] - H[lo]) + _gain(G[hi] - G[k], H[hi] - H[k]) - _gain(G[hi] - G[lo], H[hi] - H[lo])
                if gain.max() > best[0]:
                    best = (gain.max(), int(k[gain.argmax()]))
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    if len(cuts) > 2:
        for lo, hi in zip(cuts, cuts[1:]):
            out[lo:hi] = (G[hi] - G[lo]) / (H[hi] - H[lo] + 1.0)
    return out


def _shallow_pair(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree with one cut in each direction over a grid, and its gain."""
    G, H, N = (np.pad(v.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for v in (g, h, n))
    best, where = 0.0, None
    base = _gain(G[-1, -1], H[-1, -1])
    for a in range(1, g.shape[0]):
        for b in range(1, g.shape[1]):
            total = -base
            for v in ((0, a, 0, b), (0, a, b, -1), (a, -1, 0, b), (a, -1, b, -1)):
                box = [M[v[1], v[3]] - M[v[0], v[3]] - M[v[1], v[2]] + M[v[0], v[2]] for M in (G, H)]
                total += _gain(*box)
            if total > best:
                best, where = total, (a, b)
    out = np.zeros(g.shape)
    if where:
        a, b = where
        for rows in (slice(0, a), slice(a, None)):
            for cols in (slice(0, b), slice(b, None)):
                if n[rows, cols].sum() >= LEAST_ROWS:
                    out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + 1.0)
    return best, out


def fit_gam(x: np.ndarray, y: np.ndarray) -> Gam:
    """Cyclic boosting of single features, then of the pairs with the largest gain."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Gam(float(np.log(share / (1 - share))))
    if len(y) == 0 or y.min() == y.max():
        return model
    d = x.shape[1]
    model.edges = [_quantile_edges(x[:, j], BINS) for j in range(d)]
    model.coarse = [_quantile_edges(x[:, j], PAIR_BINS) for j in range(d)]
    fine = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    rough = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.coarse)]
    sizes = [len(e) + 1 for e in model.edges]
    counts = [np.bincount(b, minlength=k) for b, k in zip(fine, sizes)]
    model.tables = [np.zeros(k) for k in sizes]
    total = np.full(len(y), model.intercept)
    for _ in range(ROUNDS):
        for j in range(d):
            p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
            g = np.bincount(fine[j], weights=y - p, minlength=sizes[j])
            h = np.bincount(fine[j], weights=p * (1 - p), minlength=sizes[j])
            step = RATE * _shallow_tree(g, h, counts[j])
            model.tables[j] += step
            total += step[fine[j]]

    def grid(i, j, p):
        a, b = len(model.coarse[i]) + 1, len(model.coarse[j]) + 1
        at = rough[i] * b + rough[j]
        return [np.bincount(at, weights=w, minlength=a * b).reshape(a, b) for w in (y - p, p * (1 - p), np.ones(len(y)))], at

    p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
    found = sorted(((_shallow_pair(*grid(i, j, p)[0])[0], i, j) for i in range(d) for j in range(i)), reverse=True)[:PAIRS]
    tables = {(i, j): np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)) for gain, i, j in found if gain > 1e-6}
    for _ in range(PAIR_ROUNDS):
        for (i, j), t in tables.items():
            p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
            sums, at = grid(i, j, p)
            step = RATE * _shallow_pair(*sums)[1]
            t += step
            total += step.ravel()[at]
    model.pairs = [(i, j, t) for (i, j), t in tables.items()]
    return model


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality") -> Gam:
    """Learn the model from labelled training rows; features are computed on the executors."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for pdf in batches:
            x = feature_matrix(pdf["text"])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf[target].astype("int32"), **{f: x[:, j] for j, f in enumerate(FEATURES)}})

    schema = "doc_id long, y int, " + ", ".join(f"`{f}` double" for f in FEATURES)
    rows = labelled_sample(docs, labels, target).mapInPandas(run, schema).toPandas()
    rows = rows.sort_values(["doc_id", *FEATURES])
    return fit_gam(rows[list(FEATURES)].to_numpy(float), rows["y"].to_numpy(float))


def score(docs: DataFrame, model: Gam, text_col: str = "text", out: str = "quality") -> DataFrame:
    """All columns of ``docs`` with ``out``, a score from 0 to 1, added (in place of one of that name)."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.predict(feature_matrix(texts)))

    return docs.withColumn(out, run(F.col(f"`{text_col}`")))


def quality_report(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality").alias("score"), (F.col("quality") >= 0.3).cast("int").alias("predicted"))
