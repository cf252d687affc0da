r"""Phrase collocation mining by Apriori level-wise passes.

Texts are lower-cased (A-Z only), cut into pieces at ``.,;:!?`` and line ends, and pieces into
words between blanks and tabs.  The first pass counts words; the texts then become runs of the
ids of frequent words.  Pass k reads the runs of frequent (k-1)-gram ids: a k-gram is the pair
of the (k-1)-grams it begins and ends with, and is emitted only where both are frequent, so two
ids say exactly which k-gram it is.  Pairs are summed within a task before they are shuffled.
Frequent pairs get ids of their own, the ids are looked up at every place, and the runs of
k-gram ids that this leaves, ever fewer, are the input of the next pass.

Each level's table holds, for a k-gram, the counts of its first 1, 2, .. k words and of its last
1, 2, .. k words: the former come from the level table of the (k-1)-gram it begins with, the
latter from that of the one it ends with.  A cut after word j is scored from these two arrays.

Look-ups: frequent grams are broadcast, at most ``BROADCAST`` of them, the most frequent ones.  Where
a level has more, the places that are not found among those are joined with the rest of the level
table by a shuffle; none of its keys is hot, as the hot ones have been broadcast.

A run is one row of some hundred ids, whatever the texts are: it is cut where no gram goes on or, within a
piece that is longer, with the ids that follow repeated as negative ones, in which grams end but do not begin.
So neither a batch of rows that is read nor a run that is put together again grows with the input.

Defined results: null and empty texts have no words; a null lang is ``und``; repeated rows
count as often as they stand there; ids take no part; phrases of equal score and count stand in byte order; extra columns are ignored, whatever
their names; an empty table gives no phrases.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import Scratch, Written, bounded_batches, materialize, scratch_path, table
from assayer.operators.ranges import numbered

LEAST, LONGEST, TOP, PERCENT = 100, 5, 2000, 100
#: Most grams of a level that are broadcast to the look-up (a word takes some 100 bytes there, a pair of ids 16).
BROADCAST = 1_000_000
#: Different words or pairs that a task holds before it hands them on, ids that it gathers before it writes them, and ids in a row.
HELD, RUN, ROW = 300_000, 1 << 16, 1 << 9
_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_ENDS = b".,;:!?\n\x0b\x0c\r"
#: Lower case, with the ends of pieces turned into blanks, or into line ends.
_WORDS = bytes.maketrans(_UPPER + _ENDS, _LOWER + b" " * len(_ENDS))
_PIECES = bytes.maketrans(_UPPER + _ENDS, _LOWER + b"\n" * len(_ENDS))


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("binary").alias("text")).filter(F.octet_length("text") > 0)


def _slices(columns: list[pa.Array], names: list[str], step: int = 100_000) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays(columns, names)
    for at in range(0, whole.num_rows, step):
        yield whole.slice(at, step)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def told(held: dict[str, Counter]):
        for lang, words in held.items():
            yield from _slices([pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], ["lang", "word", "n"])

    held: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            held.setdefault(lang, Counter()).update(text.as_buffer().to_pybytes().translate(_WORDS).split())
        if sum(map(len, held.values())) > HELD:
            yield from told(held)
            held = {}
    yield from told(held)


def word_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, word (binary), f of all words."""
    bounded_batches(docs.sparkSession)
    counted = _texts(docs, text_col, lang_col).mapInArrow(_count_words, "lang string, word binary, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("f"))


# ---- runs of ids ------------------------------------------------------------------------------


def _packed(ids: np.ndarray) -> np.ndarray:
    """Ids without zeros at the start or beside other zeros, and with one at the end."""
    ids = np.append(ids, 0)
    return ids[(ids != 0) | (np.concatenate([[0], ids[:-1]]) != 0)]


def _bounded(ids: np.ndarray, longest: int) -> np.ndarray:
    """Packed ids of which no more than ``ROW`` follow each other: longer stretches are cut, and after each part come the
    next ``longest`` - 1 ids as negative ones, so that a gram across the cut is found, and counts once."""
    ends = np.flatnonzero(ids == 0)
    starts = np.concatenate([[0], ends[:-1] + 1])
    parts, done = [], 0
    for k in np.flatnonzero(ends - starts > ROW):
        parts.append(ids[done : starts[k]])
        for at in range(starts[k], ends[k], ROW):
            upto = min(at + ROW, ends[k])
            parts += [ids[at:upto], -ids[upto : min(upto + longest - 1, ends[k])], ids[ends[k] : ends[k] + 1]]
        done = ends[k] + 1
    return np.concatenate([*parts, ids[done:]]) if parts else ids


def _cuts(ids: np.ndarray) -> np.ndarray:
    """Where runs of about ``ROW`` ids begin, and the end of the last: each ends with a zero."""
    ends = np.flatnonzero(ids == 0) + 1
    return np.unique(np.concatenate([[0], ends[np.searchsorted(ends, np.arange(ROW, len(ids), ROW))], ends[-1:]])).astype(np.int32)


def _runs(parts: list[np.ndarray]) -> pa.RecordBatch:
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(_cuts(ids)), pa.array(ids, pa.int64()))], ["ids"])


def _flat(column: pa.ListArray) -> np.ndarray:
    """The ids of all runs of a batch one after the other; each run ends with a zero, so none meets the next."""
    return column.flatten().to_numpy(zero_copy_only=False)


def _unsure(first: int, cuts: np.ndarray, at: np.ndarray, ids: np.ndarray, sign: np.ndarray, keys: list[tuple[str, pa.Array]]) -> Iterator[pa.RecordBatch]:
    """Places of some runs with their ids or, where the broadcast has none (0), with what to join by and the sign to put before."""
    run = TaskContext.get().partitionId() * (1 << 32) + first + np.searchsorted(cuts, at, "right") - 1
    yield from _slices([pa.array(run, pa.int64()), pa.array(at, pa.int64()), pa.array(ids * sign, pa.int64()), pa.array(sign, pa.int64()), *[v for _, v in keys]], ["run", "place", "id", "sign", *[k for k, _ in keys]])


def _joined(places: DataFrame, level: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of ids of places that are partly without one: those are joined, and all are put together again."""
    places = materialize(places, "places")
    known = places.filter("id <> 0").select("run", "place", "id")
    found = places.filter("id = 0").drop("id").join(level.select(*keys, "id"), keys).select("run", "place", (F.col("id") * F.col("sign")).alias("id"))
    whole = known.unionByName(found).groupBy("run").agg(F.array_sort(F.collect_list(F.struct("place", "id"))).alias("held"))

    def close(batches):
        for batch in batches:
            parts = []
            for held in batch.column(0):
                at, ids = (held.values.field(k).to_numpy() for k in (0, 1))
                out = np.zeros(len(at) + np.count_nonzero(np.diff(at) > 1), np.int64)
                out[np.arange(len(at)) + np.concatenate([[0], np.cumsum(np.diff(at) > 1)])] = ids
                parts.append(_packed(out))
            yield _runs(parts)

    return whole.select("held").mapInArrow(close, "ids array<long>")


def _most_frequent(level: DataFrame, columns: list[str], rows: int, most: int) -> tuple[pa.Table, DataFrame]:
    """Of a level's rows at most so many, all those above some count, and the rest as a table.

    The driver is told how many rows have each count: different counts are few, as they add up to no more than all words.
    """
    rest = level.filter("false")
    if rows > most:
        left, above = most, None
        for f, n in level.groupBy("f").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("f")).collect():
            left, above = left - n, f
            if left < 0:
                break
        level, rest = level.filter(F.col("f") > above), level.filter(F.col("f") <= above)
    got = level.select(*columns).toArrow()
    # what is left is as small as that where it can be: then no place is shuffled to be found
    return got, F.broadcast(rest) if rows - got.num_rows <= most else rest


def encode(docs: DataFrame, level: DataFrame, rows: int, broadcast: int, longest: int, text_col: str, lang_col: str) -> DataFrame:
    """Texts as runs of the ids of frequent words (``ids``), with zeros for other words and the ends of pieces."""
    spark = docs.sparkSession
    got, rest = _most_frequent(level.withColumn("word", F.col("phrase").cast("binary")), ["lang", "word", "id"], rows, broadcast)
    ids: dict[str, dict[bytes, int]] = {}
    for lang, word, i in zip(*(got.column(k).to_pylist() for k in range(3))):
        ids.setdefault(lang, {})[word] = i
    shared, whole = spark.sparkContext.broadcast(ids), rows <= broadcast
    del got, ids

    def cut(text: bytes) -> list[bytes]:
        return text.translate(_PIECES).replace(b"\n", b" . ").split()

    def to_ids(batches):
        parts, held = [], 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = cut(text.as_buffer().to_pybytes())
                run = _packed(np.fromiter(map(shared.value.get(lang, {}).get, words, repeat(0)), np.int64, len(words)))
                if len(run) > 2:
                    parts.append(_bounded(run, longest))
                    held += len(run)
                if held > RUN:
                    yield _runs(parts)
                    parts, held = [], 0
        if parts:
            yield _runs(parts)

    def to_places(batches):
        serial = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = cut(text.as_buffer().to_pybytes())
                number = np.array([w != b"." for w in words], bool) * np.arange(1, len(words) + 1)
                number = _bounded(_packed(number), longest)
                at, cuts = np.flatnonzero(number), _cuts(number)
                word = np.abs(number[at]) - 1
                known = np.fromiter(map(shared.value.get(lang, {}).get, words, repeat(0)), np.int64, len(words))[word]
                names = pa.array([None if i else words[k] for k, i in zip(word, known)], pa.binary())
                yield from _unsure(serial, cuts, at, known, np.sign(number[at]), [("lang", pa.array([lang] * len(at), pa.string())), ("word", names)])
                serial += len(cuts) - 1

    bounded_batches(spark)
    texts = _texts(docs, text_col, lang_col)
    if whole:
        return texts.mapInArrow(to_ids, "ids array<long>")
    places = texts.mapInArrow(to_places, "run long, place long, id long, sign long, lang string, word binary")
    return _joined(places, rest, ["lang", "word"])


# ---- pairs ------------------------------------------------------------------------------------


def _pairs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places where a frequent gram is followed by another, with both ids; from negative ids on, grams are those of the next run."""
    at = np.flatnonzero((ids[:-1] != 0) & (ids[1:] != 0))
    return at, np.abs(ids[at]), np.abs(ids[at + 1])


def _distinct(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, with the sum of n."""
    if not len(a):
        return a, b, n
    if max(a.max(), b.max()) < 1 << 31:
        order = np.argsort(a << 32 | b, kind="stable")
    else:
        order = np.lexsort((b, a))
    a, b = a[order], b[order]
    start = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return a[start], b[start], np.add.reduceat(n[order], start)


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, waiting, sure = [], 0, 0

    def merged():
        return _distinct(*(np.concatenate([h[k] for h in held]) for k in range(3)))

    for batch in batches:
        flat = _flat(batch.column(0))
        at, a, b = _pairs(flat)
        a, b = a[flat[at] > 0], b[flat[at] > 0]
        held.append((a, b, np.ones(len(a), np.int64)))
        waiting += len(a)
        if waiting > 4 * HELD + sure:
            held = [merged()]
            sure = waiting = len(held[0][0])
            if sure > HELD:
                yield from _slices([pa.array(x) for x in held[0]], ["first", "second", "n"])
                held, waiting, sure = [], 0, 0
    if held:
        yield from _slices([pa.array(x) for x in merged()], ["first", "second", "n"])


def pair_counts(runs: DataFrame) -> DataFrame:
    """first, second, f: how often a gram is followed by another within a run."""
    bounded_batches(runs.sparkSession)
    return runs.mapInArrow(_count_pairs, "first long, second long, n long").groupBy("first", "second").agg(F.sum("n").alias("f"))


def look_up(runs: DataFrame, level: DataFrame, rows: int, broadcast: int) -> DataFrame:
    """Runs of the ids of the pairs in ``level``, from runs of the ids that those pairs are made of."""
    spark = runs.sparkSession
    got, rest = _most_frequent(level, ["first", "second", "id"], rows, broadcast)
    a, b, i = (got.column(k).to_numpy() for k in range(3))
    order = np.lexsort((b, a))
    shared, whole = spark.sparkContext.broadcast((a[order], b[order], i[order])), rows <= broadcast

    def find(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        first, second, ids = shared.value
        if not len(ids):
            return np.zeros(len(a), np.int64)
        if max(first[-1], second.max()) < 1 << 31:
            at = np.searchsorted(first << 32 | second, a << 32 | b)
        else:
            low, high = np.searchsorted(first, a), np.searchsorted(first, a, "right")
            while (low < high).any():
                mid = (low + high) // 2
                less = (low < high) & (second[np.minimum(mid, len(ids) - 1)] < b)
                low, high = np.where(less, mid + 1, low), np.where(less, high, np.minimum(mid, high))
            at = low
        at = np.minimum(at, len(ids) - 1)
        return np.where((first[at] == a) & (second[at] == b), ids[at], 0)

    def to_ids(batches):
        for batch in batches:
            flat = _flat(batch.column(0))
            at, a, b = _pairs(flat)
            out = np.zeros(len(flat), np.int64)
            out[at] = find(a, b) * np.sign(flat[at])
            out = _packed(out)
            if len(out) > 2:
                yield _runs([out])

    def to_places(batches):
        serial = 0
        for batch in batches:
            flat = _flat(batch.column(0))
            at, a, b = _pairs(flat)
            cuts = _cuts(flat)
            yield from _unsure(serial, cuts, at, find(a, b), np.sign(flat[at]), [("first", pa.array(a)), ("second", pa.array(b))])
            serial += len(cuts) - 1

    bounded_batches(spark)
    if whole:
        return runs.mapInArrow(to_ids, "ids array<long>")
    return _joined(runs.mapInArrow(to_places, "run long, place long, id long, sign long, first long, second long"), rest, ["first", "second"])


# ---- level tables -----------------------------------------------------------------------------


def levels(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, broadcast: int = BROADCAST, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n of all words), and for each length a table of the phrases found at least ``least`` times.

    id; first and second, the ids one level below; lang, phrase, last (its last word); f; heads and
    tails, the counts of its first and of its last 1, 2, .. words.
    """
    spark = docs.sparkSession
    words = materialize(word_counts(docs, text_col, lang_col), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    one = words.filter(F.col("f") >= least).select(F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("second"), "lang", F.col("word").cast("string").alias("phrase"), F.col("word").cast("string").alias("last"), "f", F.array("f").alias("heads"), F.array("f").alias("tails"))
    found = [numbered(one, ["lang", "phrase"], scratch_path(spark, "phrases-1"))]
    runs = None
    for k in range(2, longest + 1):
        below = found[-1]
        rows = below.count()
        if not rows:
            break
        old = runs
        with Scratch(spark) as places:
            runs = Written(encode(docs, below, rows, broadcast, longest, text_col, lang_col) if k == 2 else look_up(runs.df, below, rows, broadcast), f"runs-{k - 1}")
            places.keep(runs.path)
        if old:
            old.drop()
        pairs = materialize(pair_counts(runs.df).filter(F.col("f") >= least), "pairs")
        a = below.select(F.col("id").alias("first"), "lang", "phrase", "heads")
        b = below.select(F.col("id").alias("second"), "last", "tails")
        both = pairs.join(a, "first").join(b, "second")
        grown = both.select(
            "first", "second", "lang", F.concat("phrase", F.lit(" "), "last").alias("phrase"), "last", "f",
            F.concat("heads", F.array("f")).alias("heads"), F.concat("tails", F.array("f")).alias("tails"),
        )
        found.append(numbered(grown, ["first", "second"], scratch_path(spark, f"phrases-{k}")))
    if runs:
        runs.drop()
    return totals, found


#: The cut with the lowest score, in decimals of 38 digits, as products pass 64 bits; the smallest k among equals.
_CUT = """array_min(transform(sequence(1, size(heads) - 1), k -> struct(
    (CAST(1000 AS DECIMAL(38, 0)) * f * n) div (CAST(heads[k - 1] AS DECIMAL(38, 0)) * tails[size(heads) - k - 1]) AS score,
    k AS k, heads[k - 1] AS l, tails[size(heads) - k - 1] AS r)))"""


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, percent: int = PERCENT, broadcast: int = BROADCAST, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each lang's ``top`` phrases by their lowest-scoring cut.

    A phrase inside a longer one that is found at least ``percent`` in 100 times as often is left
    out.  It is enough to look one word further: any longer phrase holds one that is at least as
    frequent as itself.
    """
    totals, found = levels(docs, least, longest, broadcast, text_col, lang_col)
    kept = None
    for k, level in enumerate(found[1:], 2):
        rows = level.select("id", "lang", "phrase", "f", "heads", "tails")
        if k < len(found):
            longer = found[k].select(F.explode(F.array("first", "second")).alias("id"), F.col("f").alias("_f")).groupBy("id").agg(F.max("_f").alias("_f"))
            rows = rows.join(longer, "id", "left").filter(F.col("_f").isNull() | (F.lit(100) * F.col("_f") < F.lit(percent) * F.col("f")))
        rows = rows.select("lang", "phrase", "f", "heads", "tails")
        kept = rows if kept is None else kept.unionByName(rows)
    schema = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"
    if kept is None:
        return docs.sparkSession.createDataFrame([], schema)
    scored = kept.join(totals, "lang").withColumn("cut", F.expr(_CUT))
    scored = scored.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")
    # numbered over all langs by a range sort, so no lang is one task; a lang's ranks count from its first number
    placed = numbered(scored, ["lang", F.desc("score"), F.desc("a"), "phrase"], scratch_path(docs.sparkSession, "ranked"))
    first = placed.groupBy("lang").agg(F.min("id").alias("_first"))
    ranked = placed.join(first, "lang").withColumn("rank", F.col("id") - F.col("_first") + 1)
    return ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocation_report(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


#: All phrases of all lengths counted outright, with 128-bit products.
ORACLE = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
g AS (
  SELECT lang, len AS k, array_to_string(words[i : i + len - 1], ' ') AS phrase
  FROM (SELECT lang, words, len, unnest(generate_series(1, len(words) - len + 1)) AS i FROM w, (VALUES (1), (2), (3), (4), (5)) v(len) WHERE len(words) >= len)
), f AS MATERIALIZED (SELECT lang, k, phrase, string_split(phrase, ' ') AS words, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, words, f AS a FROM f WHERE k >= 2 AND f >= 100),
halves AS MATERIALIZED (SELECT lang, phrase, a, cut, array_to_string(words[1 : cut], ' ') AS head, array_to_string(words[cut + 1 : k], ' ') AS tail FROM (SELECT *, unnest(generate_series(1, k - 1)) AS cut FROM c)),
one AS MATERIALIZED (SELECT h.*, x.f AS l FROM halves h JOIN f x ON x.lang = h.lang AND x.phrase = h.head),
two AS MATERIALIZED (SELECT o.*, y.f AS r FROM one o JOIN f y ON y.lang = o.lang AND y.phrase = o.tail),
cuts AS (
  SELECT lang, phrase, a, cut, l, r, n, CAST((1000::HUGEINT * a * n) // (l::HUGEINT * r) AS BIGINT) AS score FROM two JOIN n USING (lang)
), best AS (SELECT * FROM cuts QUALIFY ROW_NUMBER() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_ AS (
  SELECT DISTINCT c.lang, c.phrase FROM (SELECT lang, a AS longer, array_to_string(words[s : s + size - 1], ' ') AS sub
    FROM (SELECT *, unnest(generate_series(1, k - size + 1)) AS s FROM (SELECT *, unnest(generate_series(2, k - 1)) AS size FROM c WHERE k > 2))) x
  JOIN c ON c.lang = x.lang AND c.phrase = x.sub AND 100 * x.longer >= 100 * c.a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT b.lang, ROW_NUMBER() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
  FROM best b WHERE NOT EXISTS (SELECT 1 FROM inner_ i WHERE i.lang = b.lang AND i.phrase = b.phrase)
) WHERE rank <= 2000
"""
