"""Rows that tie in a source's order: mix() takes as many of them as its schedule."""

from collections import Counter

from assayer.llm import mixing


def taken_words(rows):
    """Words by (source, id)."""
    out = Counter()
    for r in rows:
        out[r["source"], r["doc_id"]] += len(r["text"].split())
    return {k: n for k, n in out.items() if n}


def test_repeated_rows_and_rows_without_an_id_stay_on_target(spark):
    same = [(7, "a b c d", "s")] * 40
    nameless = [(None, f"w{k} x y", "t") for k in range(60)]
    rows = same + [(k, "u v w", "s") for k in range(100, 140)] + nameless + [(k, "u v w x", "t") for k in range(200, 220)] + [(k, "p q", "u") for k in range(300, 340)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    for budget in (60, 150, 333, 700, None):
        s = mixing.schedule(docs, budget=budget).collect()
        want = Counter()
        for r in s:
            want[r["mix_key"][1:], r["mix_id"]] += r["size"] * r["copies"]
        got = mixing.mix(docs, budget=budget)
        assert got.columns == docs.columns
        got = got.collect()
        assert taken_words(got) == {k: n for k, n in want.items() if n}
        counts = Counter(r["text"] for r in got if r["doc_id"] is None)
        assert max(counts.values(), default=0) - min(counts[f"w{k} x y"] for k in range(60)) <= 1


def test_clashing_columns_are_carried_along(spark):
    docs = spark.createDataFrame([(k, "a b c", "s", "x", 5, "h") for k in range(30)], "doc_id long, text string, source string, mix_key string, n int, hash string")
    got = mixing.mix(docs, budget=45)
    assert got.columns == docs.columns and sum(3 for _ in got.collect()) == 45 and {(r["mix_key"], r["n"], r["hash"]) for r in got.collect()} == {("x", 5, "h")}


def test_the_mix_is_a_prefix_of_the_global_order(spark):
    """Copies of all sources by finish time, cut before the first that exceeds the budget."""
    rows = [(k, "w " * (k * 7 % 23 + 1), "abc"[k % 3 if k % 5 else 0]) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for budget in (1, 50, 777, 3000, 10**6):
        s = mixing.schedule(docs, budget=budget).collect()
        copies = sorted(((r["virtual_finish"] + k * r["source_size"] / r["target"], r["mix_hash"], r["mix_key"], r["size"], k < r["copies"]) for r in s for k in range(3)), key=lambda c: (round(c[0], 9), *c[1:3]))
        taken = [c[4] for c in copies]
        n = sum(taken)
        assert taken == [True] * n + [False] * (len(taken) - n) and sum(c[3] for c in copies[:n]) <= budget
        assert n == len(copies) or sum(c[3] for c in copies[: n + 1]) > budget
