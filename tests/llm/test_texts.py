"""Jaccard join, BPE, token files and licences."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from assayer.llm import bpe, jaccard, license, linkage, tokenfile

PATH = bpe.public_path()


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(PATH)


def corpus(seed=1):
    """Families of near copies of falling similarity, a crowd, copies and strangers."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rnd.choice((6, 40, 200)))]
        texts.append(" ".join(base))
        for edits in (0, 1, 2, 4):
            w = list(base)
            for _ in range(edits):
                w[rnd.randrange(len(w))] = word()
            texts.append(" ".join(w).capitalize())
    base = [word() for _ in range(300)]
    for k in range(70):
        texts.append(" ".join([*base[:-1], f"end{k}"]))
    texts += [" ".join(word() for _ in range(30)) for _ in range(40)] + ["", "  ", "a", "a", "a b c d", "a b c d e"]
    return list(enumerate(texts))


def brute_links(rows, threshold=0.8):
    def grams(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {i: grams(t) for i, t in rows}
    near = {i: {j for j in sets if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])} for i in sets}
    root = {}
    for i in sorted(sets):
        if i not in root:
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in root:
                    root[k] = i
                    todo += near[k]
    return {i: (len(near[i]), root[i]) for i in sets}


def test_jaccard_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(linkage, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "CHUNK", 64)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_links"], r["class_id"]) for r in jaccard.jaccard_join(df).collect()}
    want = brute_links(rows)
    assert got == want
    kept = {r["doc_id"] for r in jaccard.deduplicate(df).collect()}
    assert kept == {i for i, (_, root) in want.items() if i == root}


def test_jaccard_edges(spark, odd_docs, no_docs):
    got = sorted(((r["doc_id"] or -1), r["n_links"], r["class_id"]) for r in jaccard.jaccard_join(odd_docs).collect() if r["doc_id"])
    by = {}
    for i, n, c in got:
        by.setdefault(i, set()).add((n, c))
    assert by[1] == by[2] == {(2, 1)} and by[3] == {(0, 3)} and by[4] == {(0, 4)} and by[5] == {(0, 5)}
    assert by[6] == {(1, 6)} and by[7] == {(1, 6)} and by[8] == {(0, 8)} and by[9] == {(0, 9)} and len(got) == 11
    kept = jaccard.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 3, 4, 5, 6, 8, 8, 9]
    assert jaccard.jaccard_join(no_docs).collect() == [] and jaccard.deduplicate(no_docs).collect() == []


def test_minhash_estimates_similarity():
    rng = np.random.default_rng(1)
    seeds = jaccard._seeds(400)
    u = rng.integers(0, 1 << 63, 9000, dtype=np.uint64)
    a, b = np.unique(u[:8000]), np.unique(u[1000:])
    assert abs((jaccard.minhashes(a, seeds) == jaccard.minhashes(b, seeds)).mean() - 7 / 9) < 0.06
    assert jaccard.found_probability(0.8, 5, 20) > 0.999


ALPHABET = "abcdefghijklmnopqrstuvwxyzABCÀÉßΣσςİıǅ日本語한국어😀́  \x1c\x85\x0b\t\n 0123456789'’!?.,;:-_()<|>٣Ⅷ²" + "".join(map(chr, range(256)))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(st.sampled_from(ALPHABET), max_size=60), st.text(max_size=30), st.text(st.sampled_from("etaoinsrh"), max_size=40)), max_size=6))
def test_bpe_equals_the_library(texts):
    t = Tokenizer.from_file(PATH) if not hasattr(test_bpe_equals_the_library, "t") else test_bpe_equals_the_library.t
    test_bpe_equals_the_library.t = t
    own = bpe.encoder(PATH)
    for text, ids, want in zip(texts, own.encode_ids(texts), t.encode_batch(texts, add_special_tokens=False)):
        assert ids.tolist() == want.ids, repr(text)
        assert own.decode(ids) == t.decode(want.ids, skip_special_tokens=False)


def test_bpe_hard_texts(lib):
    own = bpe.encoder(PATH)
    texts = ["x<|endoftext|>y <|startoftext|> z<|ENDOFTEXT|>", "it's WE'RE i'd'x''s 's '", "aaaaaaaaaaaaaaa aaaaaaa bbbbb" * 3, "", "a" * 5000 + " " + "ab" * 3000, "thntatnd " * 2000, "'"]
    for _ in range(2):
        for ids, want in zip(own.encode_ids(texts), lib.encode_batch(texts, add_special_tokens=False)):
            assert ids.tolist() == want.ids


def test_word_memory_is_bounded(lib, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN", 50)
    own = bpe.WordBpe(PATH)
    rnd = random.Random(2)
    for _ in range(5):
        texts = [" ".join("".join(rnd.choice("aeintrs") for _ in range(5)) for _ in range(100))]
        assert own.encode_ids(texts)[0].tolist() == lib.encode(texts[0], add_special_tokens=False).ids


def test_bpe_digests_and_edges(spark, odd_docs, no_docs, lib):
    got = bpe.digest_texts(odd_docs, PATH).collect()
    assert len(got) == odd_docs.count()
    want = {}
    for r in odd_docs.collect():
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        want.setdefault(r["doc_id"], set()).add((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    for r in got:
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) in want[r["doc_id"]]
    full = bpe.encode_texts(odd_docs.filter("doc_id = 1"), PATH).first()
    assert full["token_ids"] == lib.encode(full["text"], add_special_tokens=False).ids and full["decoded"] == bpe.decode_ids(full["token_ids"], PATH)
    assert bpe.digest_texts(no_docs, PATH).collect() == []


def test_token_files_round_trip(spark, tmp_path, monkeypatch, lib, odd_docs, no_docs):
    monkeypatch.setattr(tokenfile, "FILE_ROWS", 50)
    rows = [(3 * k, f"text number {k} " * (k % 400)) for k in range(230)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    uri = f"file://{tmp_path}/t"
    manifest = tokenfile.write_token_files(df, uri, PATH)
    got = {r["doc_id"]: r for r in tokenfile.read_documents(manifest, uri).collect()}
    at = 0
    for i, text in rows:
        ids = [*lib.encode(text, add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    shards = manifest.orderBy("shard").collect()
    assert len(shards) == 5 and sum(r["n_tokens"] for r in shards) == at
    f = tokenfile.TokenFile(uri, shards[1]["shard"], shards[1]["attempt"])
    n = shards[1]["n_tokens"]
    stream = f.span(0, n)
    last = (n - 1) // tokenfile.SEQ_LEN
    for i in range(last + 1):
        part = stream[i * tokenfile.SEQ_LEN : (i + 1) * tokenfile.SEQ_LEN]
        assert (f.sequence(i)[: len(part)] == part).all() and f.mask(i).sum() == len(part) and len(f.sequence(i)) == tokenfile.SEQ_LEN
    assert not f.sequence(0).flags.owndata
    odd = tokenfile.read_documents(tokenfile.write_token_files(odd_docs, f"{tmp_path}/o", PATH), f"{tmp_path}/o").orderBy("start").collect()
    assert len(odd) == odd_docs.count() and odd[0]["doc_id"] is None and odd[-1]["doc_id"] == 9
    assert tokenfile.read_documents(tokenfile.write_token_files(no_docs, f"{tmp_path}/e", PATH), f"{tmp_path}/e").collect() == []


def test_licences(spark, odd_docs, no_docs):
    mit = dict((k, t) for k, t in license.templates() if len(t) > 900)["MIT"]
    wrapped = "\n".join(mit[k : k + 70] for k in range(0, len(mit), 70))
    texts = ["Some prose.\nLicensed under the Apache License, Version 2.0.\nMore prose.", "intro\n\n" + mit + "\n\nend", "All rights reserved.", "no licence at all in this line", "This work is licensed under CC BY-NC 4.0", None, ""]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, license string")
    got = {r["doc_id"]: (r["license"], round(r["dice"], 3), r["license_lines"]) for r in license.scan(df).collect()}
    assert got[0] == ("Apache-2.0", 1.0, 1) and got[1] == ("MIT", 1.0, 1) and got[2][0] == "Proprietary" and got[3] == (None, 0.0, 0) and got[4][0] == "CC-BY-NC-4.0"
    assert got[5] == got[6] == (None, 0.0, 0)
    assert license.scan_text(wrapped, license.Matcher(license.templates(), 0.8))[0] == "MIT"
    assert license.scan(odd_docs).count() == odd_docs.count() and license.scan(no_docs).collect() == []


def test_licence_pruning_loses_nothing():
    pairs = license.templates()
    m = license.Matcher(pairs, 0.8)
    rnd = random.Random(4)
    for lic, t in pairs:
        w = t.split()
        for _ in range(3):
            k = rnd.randrange(len(w))
            unit = " ".join(w[:k] + ["other"] * rnd.randrange(3) + w[k + rnd.randrange(2) :])
            own = license.bigrams(unit)
            best = max(((2 * len(own & license.bigrams(x)) / max(1, len(own) + len(license.bigrams(x))), lic2) for lic2, x in pairs), key=lambda v: v[0])
            found = m.best(license._WORD.findall(unit.lower()))
            assert (found is not None) == (best[0] >= 0.8) and (found is None or found[0] == pytest.approx(best[0]))
