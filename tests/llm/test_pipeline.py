"""The pipeline against a plain Python version of every stage, and the optional import."""

import hashlib
import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as cp
from assayer.llm import bpe, quality, toxicity

ROOT = Path(__file__).resolve().parents[2]
SF = "/root/testdata/sf0.001"


def test_run_matches_brute_force(spark):
    from tests_llm_helpers import brute_links, plain_targets, words

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = [r.asDict() for r in docs.collect()]
    m = quality.fit(docs, labels)
    rows = [r for r, s in zip(rows, m.predict(quality.feature_matrix([r["text"] for r in rows]))) if s >= 0.3]
    lex = toxicity.fit(spark.createDataFrame(rows, docs.schema), labels)
    a = lex.automaton() if lex.stems else None

    def toxic(text):
        f = toxicity.fold(text or "")
        x = np.array(toxicity._features(toxicity.matched(a, f) if a else 0.0, len(text or "")))
        return 1 / (1 + np.exp(-(x @ np.array(lex.coefficients))))

    rows = [r for r in rows if toxic(r["text"]) < 0.5]
    root = brute_links([(r["doc_id"], r["text"] or "") for r in rows])
    rows = [r for r in rows if root[r["doc_id"]][1] == r["doc_id"]]
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += words(r["text"])
    target, out, lib = plain_targets(sizes), Counter(), Tokenizer.from_file(bpe.public_path())
    copies = []
    for s in sizes:
        order = sorted((hashlib.md5(f"{r['doc_id']}|{words(r['text'])}".encode()).hexdigest(), r["doc_id"], r["text"]) for r in rows if r["source"] == s)
        for k in range(3):
            at = k * sizes[s]
            for h, i, t in order:
                if words(t):
                    copies.append(((at + words(t) / 2) / target[s], h, i, t))
                at += words(t)
    left = sum(sizes.values())
    for _, _, i, t in sorted(copies, key=lambda c: c[:2]):
        left -= words(t)
        if left < 0:
            break
        ids = lib.encode(t or "", add_special_tokens=False).ids
        out[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in cp.run(spark, SF).collect())
    assert got == out and len(got) > 50


def test_stages_keep_columns_and_survive_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in cp.STAGES:
            out = stage(spark, docs, SF)
            assert name == "bpe" or out.columns == docs.columns
            out.count()


def test_a_run_drops_only_what_it_made(spark):
    """Results of other queries and of an earlier run stay readable after a second run."""
    from assayer.llm import registry

    shards, files = registry.QUERIES["op7_sharding"](spark, SF), registry.QUERIES["op9_token_files"](spark, SF)
    first = cp.run(spark, SF)
    n = [df.count() for df in (shards, files, first)]
    second = cp.run(spark, SF)
    assert [df.count() for df in (shards, files, first)] == n and sorted(first.collect()) == sorted(second.collect())


def test_clashing_score_columns_travel_along(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({c: F.lit(c) for c in ("_score0", "_Score1", "quality", "_pipeline_score")})
    out = cp.drop_toxic(spark, cp.drop_junk(spark, docs, SF), SF)
    assert out.columns == docs.columns and {tuple(r) for r in out.select("_score0", "_Score1", "quality", "_pipeline_score").distinct().collect()} == {("_score0", "_Score1", "quality", "_pipeline_score")}


def test_the_rest_works_without_the_optional_parts(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'scorecard' in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "r", check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path / "r")})
    rest = [p for p in (tmp_path / "r").rglob("*.py") if "llm" not in p.parts and p.name != "__spark_entry__.py"]
    assert not [p for p in rest if "assayer.llm" in p.read_text()]
