"""Phrase mining against a plain version that counts every phrase outright."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from assayer.llm import collocation as col

DDL = "doc_id long, text string, lang string, phrase string, id string, f string"
COLS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, least, longest=5, top=2000, percent=100):
    n, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) >= 2 and a >= least}
        rated = []
        for p, a in found.items():
            inside = any(len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items())
            cuts = [(1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            if not inside:
                rated.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rated)[:top], 1)]
    return sorted(out)


def mined(df, **options):
    return sorted(tuple(r[c] for c in COLS) for r in col.collocations(df, **options).collect())


def corpus(seed, docs=120):
    rnd = random.Random(seed)
    vocabulary = ["the", "The", "of", "sea", "über", "Über", "x", "x", "deep blue", "a-b", "ß", " ", "日本"]
    sep = [" ", "  ", "\t", ". ", ", ", "\n", "\r\n", "\x0b", "!", " ; "]
    rows = []
    for k in range(docs):
        text = "".join(rnd.choice(vocabulary) + rnd.choices(sep, [20, 2, 2] + [1] * 7)[0] for _ in range(rnd.randint(0, 40)))
        rows.append((k, text, rnd.choice(["en", "de", None, "und"]), "p", "i", "f"))
    return rows


@pytest.mark.parametrize("broadcast", [1_000_000, 6, 0])
@pytest.mark.parametrize("least,longest,top", [(5, 5, 2000), (3, 4, 7), (2, 2, 2000)])
def test_equals_the_plain_version(spark, broadcast, least, longest, top):
    rows = corpus(least)
    rows += [(900 + k, " ".join(["x"] * 30) + " the of sea" * 9, "en", None, None, None) for k in range(4)]
    df = spark.createDataFrame(rows, DDL).repartition(5)
    got = mined(df, least=least, longest=longest, top=top, broadcast=broadcast)
    assert got == plain([(r[1], r[2]) for r in rows], least, longest, top) and len(got) > 10


def test_longer_phrases_by_share(spark):
    """With 60 percent, a phrase goes when a longer one is found three times for its five."""
    rows = [(k, "a b c" if k < 3 else "a b", "en", "", "", "") for k in range(5)]
    df = spark.createDataFrame(rows, DDL)
    assert [r[2] for r in mined(df, least=2, percent=60)] == [r[2] for r in plain([(r[1], r[2]) for r in rows], 2, percent=60)] == ["a b c"]
    assert [r[2] for r in mined(df, least=2)] == ["a b", "a b c"]


def test_odd_rows(spark, odd_docs, no_docs):
    got = mined(odd_docs, least=2)
    assert got == plain([(r["text"], r["lang"]) for r in odd_docs.select("text", "lang").collect()], 2) and got
    assert mined(no_docs) == mined(odd_docs.filter(F.col("text").isNull()), least=1) == []
    same = odd_docs.filter("doc_id = 1").select(F.explode(F.sequence(F.lit(1), F.lit(50))).alias("doc_id"), "text", "lang")
    assert [r[3] for r in mined(same, least=50)] == [50] * len(mined(same, least=50)) and mined(same, least=51) == []


def test_products_pass_64_bits(spark):
    """A score is exact where 1000 a n and l r are beyond 64 bits."""
    a, n, left, right = 9_999_999_999, 10**15 + 7, 10**12 + 39, 10**12 + 61
    df = spark.createDataFrame([(a, n, [left, a], [right, a])], "f long, n long, heads array<long>, tails array<long>")
    assert df.select(F.expr(col._CUT)["score"]).first()[0] == 1000 * a * n // (left * right)


def test_ids_beyond_31_bits(spark):
    import numpy as np

    a, b = np.array([1 << 40, 3, 1 << 40, 3]), np.array([5, 1 << 33, 5, 7])
    assert [x.tolist() for x in col._distinct(a, b, np.ones(4, np.int64))] == [[3, 3, 1 << 40], [7, 1 << 33, 5], [1, 1, 2]]
    big = 1 << 40
    runs = spark.createDataFrame([([big + 1, big + 2, big + 1, big + 2, big + 3, 0],)], "ids array<long>")
    level = spark.createDataFrame([(big + 1, big + 2, 2, 11), (big + 2, big + 3, 1, 12)], "first long, second long, f long, id long")
    for broadcast in (10, 1, 0):
        assert [r["ids"] for r in col.look_up(runs, level, 2, broadcast).collect()] == [[11, 0, 11, 12, 0]]


@pytest.mark.parametrize("broadcast", [1_000_000, 5, 0])
def test_runs_are_bounded_rows(spark, broadcast):
    """No row of ids grows with the texts, within a piece of any length too, on either way of look-up; no gram is lost or counted twice at a cut."""
    rnd = random.Random(3)
    words = ["the", "of", "sea", "blue", "deep", "x", "y"]
    one = " ".join(rnd.choices(words, k=7 * col.ROW + 3))
    rows = [(one, "en"), (". ".join(" ".join(rnd.choices(words, k=3)) for _ in range(3 * col.ROW)), "en"), (" ".join(["x"] * (4 * col.ROW)), "de"), (" ".join(rnd.choices(words, k=col.ROW + 1)) + ". x", "de"), ("x", "en")]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(2)
    assert mined(df, least=3, broadcast=broadcast) == plain(rows, 3)
    level = spark.createDataFrame([(k, lang, w, 9 - k) for k, (lang, w) in enumerate([(la, w) for la in ("en", "de") for w in words], 1)], "id long, lang string, phrase string, f long")
    runs = col.encode(df, level, 14, broadcast, 5, "text", "lang").select("ids").cache()
    pairs = runs.select(F.explode(F.arrays_zip("ids", F.slice("ids", 2, 1 << 20).alias("next")))).select(F.monotonically_increasing_id().alias("id"), F.abs("col.ids").alias("first"), F.abs("col.next").alias("second"))
    pairs = pairs.filter("first <> 0 AND second <> 0").groupBy("first", "second").agg(F.count(F.lit(1)).alias("f"), F.min("id").alias("id")).withColumn("id", F.col("id") + 1)
    after = col.look_up(runs, pairs, pairs.count(), broadcast)
    for df in (runs, after):
        longest = df.select(F.max(F.size("ids"))).first()[0]
        assert col.ROW / 2 < longest <= 2 * col.ROW + 10
