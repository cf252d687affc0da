"""Rows repeated very often: samples, neighbours, mixing, shards and near copies."""

import numpy as np

from assayer.llm import ann, neardup
from assayer.llm.common import hash_sample, labelled_sample


def vectors(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v], "c") for i, v in rows], "vec_id long, embedding array<float>, score string")


def test_a_sample_of_repeated_rows_is_never_empty(spark):
    one = spark.range(100_000).selectExpr("7L AS id", "'a' AS v")
    for key in range(5):
        got = hash_sample(one.selectExpr(f"id + {key} AS id", "v"), ["id", "v"], 100).collect()
        assert len(got) == 1
    many = spark.range(50_000).selectExpr("id % 20000 AS id")
    got = [r["id"] for r in hash_sample(many, ["id"], 500).collect()]
    assert len(got) == len(set(got)) == 500 and sorted(got) == sorted(r["id"] for r in hash_sample(many.repartition(9), ["id"], 500).collect())


def test_labelled_sample_takes_one_text_an_id(spark):
    docs = spark.range(3000).selectExpr("id % 3 + 11 AS doc_id", "concat('text ', id % 7) AS text", "1 AS toxic")
    labels = spark.createDataFrame([(11, 1), (12, 0), (13, None), (12, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["toxic"] for r in labelled_sample(docs, labels, "toxic").collect()}
    assert set(got) <= {11, 12} and all(v == 1 for v in got.values())
    assert labelled_sample(docs, labels, "toxic").count() == len(got)


def test_nearest_among_equal_rows(spark):
    same = spark.range(100_000).selectExpr("7L AS vec_id", "array(1f, 2f, 3f, 4f) AS embedding")
    assert {(r["vec_id"], round(r["score"], 9)) for r in ann.nearest(same, vectors(spark, [(50, [1, 2, 3, 4])]), 5).collect()} == {(7, 1.0)}
    assert ann.nearest(same, same.limit(3), 5).collect() == []


def test_nearest_behind_a_repeated_query_id(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 16))
    rows = [(0, x[0])] * 8 + [(1, x[0])] + [(k, x[k]) for k in range(2, 300)]
    df = vectors(spark, rows)
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(df, df.filter("vec_id = 0"), 5).collect())
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    s = unit.astype(np.float32).astype(float) @ unit[0]
    s[1] = 1.0
    want = sorted(range(1, 300), key=lambda k: (-round(s[k], 6), k))[:5]
    assert [i for _, i, _ in got] == want and got[0][1] == 1


def test_near_copies_of_repeated_rows(spark):
    rows = [(k, [1, 2, 3]) for k in range(400)] + [(900, [1, 2, 3.01]), (901, [3, -2, 1])]
    got = {r["doc_id"]: (r["n_links"], r["class_id"]) for r in neardup.near_duplicates(vectors(spark, rows)).collect()}
    assert got[0] == got[399] == (400, 0) and got[900] == (400, 0) and got[901] == (0, 901)


def test_tables_always_meet_the_recall():
    for dim, cosine in ((2, 0.9), (16, 0.5), (64, 0.3), (64, 0.95), (768, 0.95)):
        functions, tables, probes = neardup.scheme(10**9, dim, cosine, 0.9999)
        p = neardup.chance(functions, dim, cosine, probes)
        assert 1 - (1 - p) ** tables >= 0.9999 - 1e-9 or tables == 2 and p > 0.99


def test_links_at_a_low_cosine_match_brute_force(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(150, 8)).astype(np.float32).astype(float)
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    near = (unit @ unit.T >= 0.7).sum(1) - 1
    got = {r["doc_id"]: r["n_links"] for r in neardup.near_duplicates(vectors(spark, list(enumerate(x))), cosine=0.7).collect()}
    assert [got[k] for k in range(150)] == near.tolist()


def test_large_ids_beside_null_ones(spark, tmp_path):
    from assayer.llm import bpe, jaccard, tokenfile

    big = 2**62 + 1
    docs = spark.createDataFrame([(big, "a b c d e f"), (None, "a b c d e f"), (big + 1, "a b c d e f")], "doc_id long, text string").coalesce(1)
    assert {r["doc_id"] for r in bpe.digest_texts(docs, bpe.public_path()).collect()} == {big, big + 1, None}
    assert {(r["doc_id"], r["class_id"]) for r in jaccard.jaccard_join(docs).collect()} == {(big, big), (big + 1, big), (None, None)}
    m = tokenfile.write_token_files(docs, f"{tmp_path}/t", bpe.public_path())
    assert [r["doc_id"] for r in tokenfile.read_documents(m, f"{tmp_path}/t").orderBy("start").collect()] == [None, big, big + 1]
    v = vectors(spark, [(big, [1, 2]), (None, [1, 2]), (big + 49, [2, 1])])
    assert {r["doc_id"] for r in neardup.near_duplicates(v).collect()} == {big, None, big + 49}
    assert {(r["query_id"], r["vec_id"]) for r in ann.nearest(v, v).collect()} == {(big, big + 49), (big + 49, big)}


def test_one_template_makes_no_component(spark):
    """Texts that share a template, well below the threshold, are verified in their nodes and not compared in full."""
    import random

    from assayer.llm import jaccard

    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    frame = [word() for _ in range(130)]
    texts = [" ".join(frame + [word() for _ in range(60)]) for _ in range(250)]
    texts += [texts[0] + " tail", texts[5] + " end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    slim = jaccard.signatures(docs, "doc_id", "text", jaccard.TREES, jaccard.DEPTH)
    classes = slim.selectExpr("xxhash64(class_key) AS node", "labels", "doc_id")
    groups = jaccard.candidate_groups(classes, 0.8, jaccard.TREES, jaccard.DEPTH, jaccard.RECALL)
    full = groups.groupBy("group").count().collect()
    assert 2 <= sum(r["count"] for r in full) <= 12
    got = {r["doc_id"]: (r["n_links"], r["class_id"]) for r in jaccard.jaccard_join(docs).collect()}
    assert got[0] == (1, 0) and got[250] == (1, 0) and got[5] == (1, 5) and got[251] == (1, 5) and sum(n for n, _ in got.values()) == 4


def test_deduplicate_repeated_and_blank_rows(spark):
    from assayer.llm import jaccard

    docs = spark.range(3000).selectExpr("CASE WHEN id < 2000 THEN 5 WHEN id < 2500 THEN 6 ELSE id END AS doc_id", "CASE WHEN id < 2000 THEN 'a b c d e f' WHEN id < 2500 THEN ' 　 ' ELSE concat('q', id, ' é') END AS text", "id % 7 AS `_near_id`", "'x' AS n")
    got = [r.asDict() for r in jaccard.deduplicate(docs).collect()]
    assert sum(r["doc_id"] == 6 for r in got) == 500 and sum(r["doc_id"] >= 2500 for r in got) == 500
    assert [r for r in got if r["doc_id"] == 5] == [{"doc_id": 5, "text": "a b c d e f", "_near_id": 0, "n": "x"}]
