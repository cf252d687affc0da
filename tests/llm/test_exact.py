"""Word memory behind equal hashes, long texts, and plain versions of the classifiers."""

import random
import time

import numpy as np
import pytest
from tokenizers import Tokenizer

from assayer.llm import bpe, license, quality, toxicity

PATH = bpe.public_path()


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(PATH)


def check(own, lib, texts):
    for ids, want in zip(own.encode_ids(texts), lib.encode_batch(texts, add_special_tokens=False)):
        assert ids.tolist() == want.ids


@pytest.mark.parametrize("known", [bpe.KNOWN, 40])
def test_words_with_equal_hashes_keep_their_own_ids(lib, monkeypatch, known):
    monkeypatch.setattr(bpe, "KNOWN", known)
    own = bpe.WordBpe(PATH)
    own.byte_value = np.zeros(256, np.uint64)  # every hash is one of the word's length
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("aeinrst") for _ in range(rnd.choice((1, 3, 4, 9, 17, 70))))
    for _ in range(6):
        check(own, lib, [" ".join(word() for _ in range(60)) for _ in range(4)])


def test_same_bytes_against_slices():
    rnd = np.random.default_rng(0)
    a = rnd.integers(0, 3, 4000).astype(np.uint8)
    size = rnd.integers(0, 90, 500)
    x, y = rnd.integers(0, 3900, 500), rnd.integers(0, 3900, 500)
    y[::2] = x[::2]
    b = a.copy()
    b[rnd.integers(0, 4000, 20)] ^= 1
    got = bpe.same_bytes(a, x, size, b, y, size)
    assert got.tolist() == [bool((a[i : i + n] == b[j : j + n]).all()) for i, j, n in zip(x, y, size)]


def test_long_texts_in_pieces(lib, monkeypatch):
    monkeypatch.setattr(bpe, "FAST_BYTES", 64)
    own = bpe.WordBpe(PATH)
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab c\n's1,.é") for _ in range(n)) for n in (1, 64, 65, 500, 5000)] + ["x" * 300, "x" * 100 + " y" * 100, " " * 200, "\n" * 65]
    check(own, lib, texts)


def test_encode_texts_replaces_clashing_columns(spark, lib):
    df = spark.createDataFrame([(1, "One two", "x", 5)], "doc_id long, text string, token_ids string, decoded int")
    got = bpe.encode_texts(df, PATH)
    assert got.columns == ["doc_id", "text", "token_ids", "decoded"] and got.first()["token_ids"] == lib.encode("One two", add_special_tokens=False).ids
    got = license.scan(df.withColumnsRenamed({"token_ids": "dice", "decoded": "license_lines"}))
    assert got.columns == ["doc_id", "text", "license", "dice", "license_lines"] and got.first()["dice"] == 0.0


# ---- toxicity -------------------------------------------------------------------------------


def naive(lexicon, folded):
    """Every stem at every place, and every exception phrase that could cover it."""
    total = 0.0
    for at in range(len(folded)):
        for s, w in lexicon.stems.items():
            if folded.startswith(" " + s, at):
                inside = any(folded.startswith(f" {p} ", k) and k <= at < k + len(p) + 1 for p in lexicon.exceptions for k in range(max(0, at - len(p) - 1), at + 1))
                total += 0.0 if inside else w
    return total


def test_matcher_against_a_naive_one():
    rnd = random.Random(6)
    part = lambda n: "".join(rnd.choice("abc") for _ in range(n))
    hits = 0
    for _ in range(150):
        stems = {part(rnd.randrange(1, 4)) + rnd.choice(("", " ")): rnd.randrange(1, 9) for _ in range(4)}
        lexicon = toxicity.Lexicon(stems, [" ".join(part(rnd.randrange(1, 5)) for _ in range(rnd.randrange(1, 4))) for _ in range(3)], [])
        folded = f" {' '.join(part(rnd.randrange(1, 6)) for _ in range(40))} "
        want = naive(lexicon, folded)
        assert toxicity.matched(lexicon.automaton(), folded) == want
        hits += want > 0
    assert hits > 100


def test_a_word_longer_than_any_stem_can_be_an_entry():
    long = "q" + "ab" * 20
    a = toxicity.Lexicon({f"{long} ": 2.0}, [], []).automaton()
    assert f"{long} " in toxicity._stems_of(f" {long} ")
    assert toxicity.matched(a, f" x {long} y ") == 2.0 and toxicity.matched(a, f" {long}s ") == 0.0


def test_a_long_toxic_text_is_matched_in_linear_time():
    a = toxicity.Lexicon({"dumm": 1.0}, ["dummer august", "so dumm"], []).automaton()
    text = toxicity.fold("dummer august und dumm und so dumm " * 30_000)
    began = time.perf_counter()
    assert len(text) > 1_000_000 and toxicity.matched(a, text) == 30_000.0
    assert time.perf_counter() - began < 1.5


def test_scores_are_those_of_a_plain_formula(spark):
    lexicon = toxicity.Lexicon({"bad": 1.5, "worse ": 2.0}, ["bad luck"], [-3.0, 1.0, 0.5, 0.7])
    texts = ["bad b4d badly", "bad luck", "worse", "worsen", "", None, "BÄD worse bad luck"]
    got = [r["s"] for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), lexicon, out="s").orderBy("doc_id").collect()]
    for t, s in zip(texts, got):
        weight = naive(lexicon, toxicity.fold(t or ""))
        x = [1.0, float(weight > 0), np.log1p(weight), np.log1p(100 * weight / (len(t or "") / 6 + 10))]
        assert s == pytest.approx(1 / (1 + np.exp(-sum(a * b for a, b in zip(x, lexicon.coefficients)))))


def test_logistic_fit_is_at_its_optimum():
    rng = np.random.default_rng(2)
    x = np.column_stack([np.ones(300), rng.normal(size=(300, 3))])
    y = (rng.random(300) < 1 / (1 + np.exp(-x @ [0.3, 1, -2, 0]))).astype(float)
    b = np.array(toxicity.fit_logistic(x, y))
    loss = lambda b: np.log1p(np.exp(-(2 * y - 1) * (x @ b))).sum() + (b[1:] ** 2).sum() / 2 + 0.5e-6 * b[0] ** 2
    for k in range(4):
        for step in (-1e-3, 1e-3):
            assert loss(b + step * np.eye(4)[k]) > loss(b)


# ---- quality --------------------------------------------------------------------------------


def plain_tree(g, h, n, leaves=3):
    """The best cut of any leaf, twice, by trying all of them."""
    gain = lambda a, b: sum(g[a:b]) ** 2 / (sum(h[a:b]) + 1)
    cuts = [0, len(g)]
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for lo, hi in zip(cuts, cuts[1:]):
            for k in range(lo + 1, hi):
                if min(sum(n[lo:k]), sum(n[k:hi])) >= quality.LEAST_ROWS:
                    v = gain(lo, k) + gain(k, hi) - gain(lo, hi)
                    if v > best[0] + 1e-12:
                        best = (v, k)
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = [0.0] * len(g)
    if len(cuts) > 2:
        for lo, hi in zip(cuts, cuts[1:]):
            out[lo:hi] = [sum(g[lo:hi]) / (sum(h[lo:hi]) + 1)] * (hi - lo)
    return out


def test_boosting_against_a_plain_version(monkeypatch):
    monkeypatch.setattr(quality, "ROUNDS", 4)
    monkeypatch.setattr(quality, "PAIRS", 0)
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(260, 3)), 1)
    y = (x[:, 0] - x[:, 1] ** 2 + rng.normal(size=260) > 0).astype(float)
    m = quality.fit_gam(x, y)
    share = (sum(y) + 1) / (len(y) + 2)
    score = [float(np.log(share / (1 - share)))] * len(y)
    for _ in range(4):
        for j in range(3):
            edges = list(m.edges[j])
            at = [sum(v >= e for e in edges) for v in x[:, j]]
            p = [1 / (1 + np.exp(-s)) for s in score]
            bins = range(len(edges) + 1)
            g = [sum(y[i] - p[i] for i in range(len(y)) if at[i] == b) for b in bins]
            h = [sum(p[i] * (1 - p[i]) for i in range(len(y)) if at[i] == b) for b in bins]
            step = plain_tree(g, h, [at.count(b) for b in bins])
            score = [s + quality.RATE * step[b] for s, b in zip(score, at)]
    assert np.allclose(m.predict(x), 1 / (1 + np.exp(-np.array(score))))


def test_pair_cut_and_prediction_against_all_cuts():
    rng = np.random.default_rng(8)
    for _ in range(20):
        g, h, n = rng.normal(size=(5, 4)), rng.random((5, 4)), rng.integers(quality.LEAST_ROWS, 9, (5, 4))
        quad = lambda a, b: [(slice(0, a), slice(0, b)), (slice(0, a), slice(b, 4)), (slice(a, 5), slice(0, b)), (slice(a, 5), slice(b, 4))]
        best = max((sum(g[q].sum() ** 2 / (h[q].sum() + 1) for q in quad(a, b)) - g.sum() ** 2 / (h.sum() + 1), a, b) for a in range(1, 5) for b in range(1, 4))
        gain, out = quality._shallow_pair(g, h, n)
        assert gain == pytest.approx(best[0])
        for q in quad(*best[1:]):
            assert np.allclose(out[q], g[q].sum() / (h[q].sum() + 1))
    m = quality.Gam(0.2, [np.array([1.0, 2.0]), np.array([5.0])], [np.array([0.1, 0.2, 0.4]), np.array([-1.0, 1.0])], [np.array([1.5]), np.array([5.0])], [(1, 0, np.array([[0.0, 0.5], [0.25, 0.75]]))])
    rows = np.array([[0.5, 5.0], [1.0, 4.9], [1.7, 6.0], [2.0, 0.0]])
    want = [0.2 + 0.1 + 1.0 + 0.25, 0.2 + 0.2 - 1.0 + 0.0, 0.2 + 0.2 + 1.0 + 0.75, 0.2 + 0.4 - 1.0 + 0.5]
    assert np.allclose(m.predict(rows), 1 / (1 + np.exp(-np.array(want))))


# ---- token files ----------------------------------------------------------------------------


def test_library_encoder_equals_whole_texts(lib, monkeypatch):
    from assayer.llm import tokenfile

    monkeypatch.setattr(tokenfile, "CACHE", 30)
    own = tokenfile.LibraryEncoder(PATH)
    rnd = random.Random(9)
    odd = "ab cÉß\x1c\x1d\x85　 \t\n\x0b0'’!.<|endoftext|> σς日́"
    texts = ["".join(rnd.choice(odd) for _ in range(rnd.randrange(80))) for _ in range(300)] + ["", " ", "x<|endoftext|>y <|startoftext|> z", "a" * 3000]
    for _ in range(2):
        for got, want in zip(own.encode_ids(texts), lib.encode_batch(texts, add_special_tokens=False)):
            assert got.tolist() == want.ids


def test_equal_and_null_ids_are_cut_over_files(spark, tmp_path):
    from assayer.llm import tokenfile

    df = spark.range(4000).selectExpr("CASE WHEN id < 1500 THEN NULL WHEN id < 3000 THEN 7 ELSE id END AS doc_id", "concat('same text ', id % 3) AS text", "'s' AS shard").repartition(4)
    manifest = tokenfile.write_token_files(df, f"{tmp_path}/t", PATH, file_rows=250)
    rows = manifest.collect()
    assert len(rows) >= 12 and max(r["n_docs"] for r in rows) < 1000 and sum(r["n_docs"] for r in rows) == 4000
    got = tokenfile.read_documents(manifest, f"{tmp_path}/t").orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None] * 1500 + [7] * 1500 + list(range(3000, 4000))
    assert [r["start"] for r in got] == [int(v) for v in np.cumsum([0, *[r["n_tokens"] for r in got[:-1]]])]
