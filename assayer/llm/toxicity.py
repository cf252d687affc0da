"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases a text, strips accents (accented words are matched with theirs too), maps homoglyphs (Cyrillic, Greek, full-width and
mathematical letters) and digit or sign substitutions to letters, treats i, l, 1, ! within a
word and | alike, and turns all else into blanks.  Lexicon entries are word stems: they match
where a word begins.  A hit inside an exception phrase does not count.

The lexicon is learned from labelled rows, near copies counting once: stems found in markedly
more toxic documents than others, extended as long as one longer stem keeps nearly all of its documents, weighted by
log odds.  Clean words that begin with a stem become exception phrases; more phrases can be
given.  Where a stem is too common in clean words, a whole word may be an entry.  The score is logistic in the matched weight and in that weight by length.

Fitting uses at most ``FIT_ROWS`` labelled rows; scoring reads every whole text.

Defined results: null text is empty; a text without hits (an empty one too) gets the score of
no hit; repeated rows score alike; very long texts are scored whole, in time linear in their
length but for its sort; with no labelled rows or one class only, every score is the smoothed
share of toxic labels; extra columns are carried along by :func:`score`, which replaces one of
the score's name.  Stems are gone through by length and then by
letters, so ties do not depend on the order of rows; rows with a null
id are scored, but never fitted on; an empty table has no scores.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import bounded_batches, held_out, labelled_sample, materialize, table

#: Lengths of a stem; longer entries are whole words of any length, which end with a blank.
STEM = range(3, 17)
#: An entry is in at least so many toxic families of texts, with so much evidence and weight.
LEAST_DOCS, LEAST_GAIN, LEAST_WEIGHT, KEEPS = 4, 25.0, 2.5, 0.95

#: Letters of other scripts that look like a Latin one, and substitutions.
HOMOGLYPHS = dict(zip("авеёкмнопрстухіїјѕԁԛԝһѵαβεηικμνορτυχω", "abeekmhonpctyxiijsdqwhvabeniikmvoptuxw"))
SUBSTITUTES = {"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "l": "i"}
_INNER = re.compile(r"(?<=[^\W_])[!|](?=[^\W_])")


def _fold_table(accents: bool) -> dict[int, str | None]:
    """Character map of folding; with ``accents`` letters keep theirs."""
    out: dict[int, str | None] = {}
    for code in [*range(0x250), *range(0x370, 0x530), *range(0x1E00, 0x2070), *range(0xFF00, 0xFF5F), *range(0x1D400, 0x1D800)]:
        char = chr(code)
        low = char.lower()
        base = unicodedata.normalize("NFKD", low)[:1] or char
        if accents and code < 0x250 and base != low and low.isalpha():
            base = low
        base = HOMOGLYPHS.get(base, base)
        base = SUBSTITUTES.get(base, base)
        if unicodedata.category(char) in ("Cf", "Mn"):
            out[code] = None
        elif not base.isalnum():
            out[code] = " "
        elif base != char:
            out[code] = base
    return out


_PLAIN, _ACCENTED = _fold_table(False), _fold_table(True)


def fold(text: str) -> str:
    """Folded text, with a blank in front and behind.

    Words with accented letters come once more at the end with their accents, as an entry may
    differ from a clean word in those alone.
    """
    text = text.lower()
    if "!" in text or "|" in text:
        text = _INNER.sub("i", text)
    if text.isascii():
        return f" {text.translate(_PLAIN)} "
    accented = [w for w in text.translate(_ACCENTED).split() if not w.isascii()]
    return f" {text.translate(_PLAIN)} {' '.join(accented)} "


@dataclass
class Lexicon:
    """Stems with weights, exception phrases, and the coefficients of the score."""

    stems: dict[str, float]
    exceptions: list[str]
    coefficients: list[float]

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for s, w in self.stems.items():
            a.add_word(" " + s, (len(s), w))
        for phrase in self.exceptions:
            a.add_word(f" {phrase} ", (-len(phrase) - 1, 0.0))
        a.make_automaton()
        return a


def matched(a: ahocorasick.Automaton, folded: str) -> float:
    """Weight of the lexicon hits of a folded text that no exception phrase covers."""
    hits, spans = [], []
    for end, (size, w) in a.iter(folded):
        if size > 0:
            hits.append((end - size, w))
        else:
            spans.append((end + size, end))
    if spans and hits:
        spans.sort()
        starts = [lo for lo, _ in spans]
        ends = list(accumulate((hi for _, hi in spans), max))
        # the spans that begin by a hit's place, and the farthest end among them
        hits = [(at, w) for at, w in hits if not (k := bisect_right(starts, at)) or ends[k - 1] <= at]
    return sum(w for _, w in hits)


def _features(weight: float, chars: int) -> list[float]:
    """1, whether anything matched, the weight, and the weight per length."""
    words = chars / 6 + 10
    return [1.0, float(weight > 0), math.log1p(weight), math.log1p(100 * weight / words)]


def _stems_of(folded: str) -> set[str]:
    out = set()
    for w in set(folded.split()):
        out.update([w[:k] for k in STEM if k <= len(w)])
        out.add(w + " ")
    return out


def least_count(n_pos: int, n_neg: int) -> float:
    """Toxic families below which no stem has the evidence of an entry, even without a clean one."""
    return max(LEAST_DOCS, LEAST_GAIN / (2 * math.log((n_pos + n_neg) / n_pos)))


def family(text: str | None) -> tuple[str, str]:
    """Two min-wise hashes over the runs of five folded words; near copies mostly share one.

    A shorter text is one run.
    """
    words = np.array([zlib.crc32(w.encode()) for w in fold(text or "").split()] or [0], np.uint64)
    size = min(5, len(words))
    runs = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        runs = runs * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(runs)]
    other = (runs ^ (runs >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    runs = (runs ^ (runs >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return str(runs.min()), str(other.min())


def choose_stems(positives: dict[str, int], negatives: dict[str, int], n_pos: int, n_neg: int) -> dict[str, float]:
    """Stems whose documents are toxic far more often than chance, with their log odds.

    Shorter stems come first.  A stem grows letter by letter while the longer one keeps nearly
    all of its toxic documents, or has more evidence as it sheds clean ones.
    """
    rate = n_pos / (n_pos + n_neg)
    children: dict[str, list[str]] = {}
    for s in positives:
        if s[-1] != " ":
            children.setdefault(s[:-1], []).append(s)

    def weight(s: str) -> float:
        return math.log((positives[s] + 0.5) / (n_pos + 1)) - math.log((negatives.get(s, 0) + 0.5) / (n_neg + 1))

    def gain(s: str) -> float:
        p, n = positives[s], negatives.get(s, 0)
        share = p / (p + n)
        return 2 * (p * math.log(share / rate) + (n * math.log((1 - share) / (1 - rate)) if n else 0))

    out: dict[str, float] = {}
    covered: set[str] = set()
    for s in sorted(positives, key=lambda s: (len(s), s)):
        if any(s[:k] in covered for k in range(STEM.start, len(s) + 1)):
            continue
        if positives[s] < least_count(n_pos, n_neg) or gain(s) < LEAST_GAIN or weight(s) < LEAST_WEIGHT:
            continue
        while True:
            best = max(children.get(s, []), key=lambda c: positives[c], default=None)
            if best is None or positives[best] < KEEPS * positives[s] and gain(best) <= gain(s):
                break
            s = best
        covered.add(s)
        out[s] = weight(s)
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> list[float]:
    """Ridge logistic regression by Newton's method (the intercept is not shrunk)."""
    b = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], ridge)
    shrink[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(shrink), x.T @ (y - p) - shrink * b)
        b = b + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b.tolist()


def fit(docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """Learn a lexicon from labelled training rows; bounded work, mostly on the executors."""
    spark = docs.sparkSession
    bounded_batches(spark)
    sample = materialize(labelled_sample(docs, labels, "toxic"), "toxicfit")

    def count(batches, wanted=None):
        c: Counter = Counter()
        for pdf in batches:
            for text, y in zip(pdf["text"], pdf["toxic"]):
                stems = _stems_of(fold(text))
                c.update(stems if wanted is None else stems & wanted)
        stems, n = list(c.keys()), np.fromiter(c.values(), np.int64, len(c))
        for k in range(0, len(stems), 50_000):
            yield pd.DataFrame({"stem": pd.Series(stems[k : k + 50_000], dtype=object), "n": n[k : k + 50_000]})

    key = F.pandas_udf(lambda texts: pd.DataFrame(list(map(family, texts)), columns=["a", "b"], dtype=object), "a string, b string")
    families = sample.select("doc_id", "toxic", "text", key("text").alias("key"))
    for part in ("a", "b"):
        row = F.min_by(F.struct("doc_id", "text", "key"), "doc_id").alias("row")
        families = families.groupBy("toxic", F.col(f"key.{part}").alias("part")).agg(row).select("toxic", "row.*")
    families = materialize(families.select("toxic", "text"), "toxicfamilies")
    sizes = {r["toxic"]: r["n"] for r in families.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    if not n_pos or not n_neg:
        share = (n_pos + 1) / (n_pos + n_neg + 2)
        return Lexicon({}, [], [math.log(share / (1 - share)), 0.0, 0.0, 0.0])
    found = families.filter("toxic = 1").mapInPandas(count, "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n"))
    # fewer families than an entry needs: such stems cannot become one
    found = found.filter(F.col("n") >= least_count(n_pos, n_neg))
    positives = {r["stem"]: r["n"] for r in found.collect()}
    wanted = set(positives)
    clean = families.filter("toxic = 0").mapInPandas(lambda b: count(b, wanted), "stem string, n long")
    negatives = {r["stem"]: r["n"] for r in clean.groupBy("stem").agg(F.sum("n").alias("n")).collect()}
    stems = choose_stems(positives, negatives, n_pos, n_neg)

    def words(batches):
        a = Lexicon(stems, [], []).automaton()
        c: Counter = Counter()
        for pdf in batches:
            for text, y in zip(pdf["text"], pdf["toxic"]):
                f = fold(text)
                hit = {f[end - size + 1 : f.index(" ", end - size + 1)] for end, (size, _) in a.iter(f)} if stems else set()
                c.update((w, int(y)) for w in hit)
        yield pd.DataFrame({"word": pd.Series([k[0] for k in c], dtype=object), "toxic": np.array([k[1] for k in c], np.int32), "n": np.fromiter(c.values(), np.int64, len(c))})

    per_word = sample.mapInPandas(words, "word string, toxic int, n long").groupBy("word").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("q")
    )
    clean_words = [r["word"] for r in per_word.filter("q >= 2 AND q > p").orderBy(F.desc("q"), "word").collect()]
    lexicon = Lexicon(stems, [*[fold(x).strip() for x in exceptions], *clean_words], [])
    rows = sample.select("doc_id", "toxic", "text").mapInPandas(_weigher(lexicon, ("toxic",)), "doc_id long, toxic int, weight double, chars long")
    got = rows.toPandas().sort_values(["doc_id", "weight", "chars"])
    x = np.array([_features(w, c) for w, c in zip(got["weight"], got["chars"])])
    lexicon.coefficients = fit_logistic(x, got["toxic"].to_numpy(float))
    return lexicon


def _weigher(lexicon: Lexicon, keep: tuple[str, ...] = ()):
    def run(batches):
        a = lexicon.automaton() if lexicon.stems else None
        for pdf in batches:
            folded = [fold(t or "") for t in pdf["text"]]
            out = {"doc_id": pdf["doc_id"], **{k: pdf[k] for k in keep}}
            out["weight"] = [matched(a, f) if a else 0.0 for f in folded]
            out["chars"] = np.array([len(t or "") for t in pdf["text"]], np.int64)
            yield pd.DataFrame(out)

    return run


def score(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """All columns of ``docs`` with ``out``, a score from 0 to 1, added (in place of one of that name)."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        a = lexicon.automaton() if lexicon.stems else None
        b = np.array(lexicon.coefficients)
        for texts in batches:
            folded = [fold(t or "") for t in texts]
            x = np.array([_features(matched(a, f) if a else 0.0, len(t or "")) for t, f in zip(texts, folded)]).reshape(-1, len(b))
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ b, -30, 30))))

    return docs.withColumn(out, run(F.col(f"`{text_col}`")))


def toxicity_report(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = fit(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, lexicon)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
