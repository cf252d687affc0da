"""Queries take every row of their tables: brute force over small tables made for it."""

import datetime as dt
from fractions import Fraction
from math import comb

import pytest

from assayer.plans import catalogue

TS = dt.datetime(2024, 1, 10, 9)
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Writes one table as <dir>/<name>.parquet and returns the directory."""

    def write(name, rows, ddl):
        path = tmp_path_factory.mktemp("sf")
        spark.createDataFrame(rows, ddl).write.parquet(str(path / f"{name}.parquet"))
        return str(path)

    return write


def test_documents_are_graded_against_their_own_entity(spark, tables):
    """Entities 4 and 6 share a bank: 4 moves after its document, 6 long before, 8 never."""
    day = lambda n: TS + dt.timedelta(days=n)
    rows = [
        (1, day(-9), 4, "view", 100.0), (12, day(0), 4, "signup", 100.0), (3, day(2), 4, "view", 300.0),
        (4, day(-9), 6, "view", 100.0), (5, day(-8), 6, "view", 900.0), (13, day(0), 6, "signup", 900.0),
        (14, day(1), 8, "signup", 100.0),
    ]
    sf = tables("events", rows, EVENTS)
    got = {(r["doc_id"], r["model_key"]): r for r in catalogue.QUERIES["grade_rows"](spark, sf).collect()}
    kinds = {d: {r["expected_kind"] for (x, _), r in got.items() if x == d and r["status"] == "graded"} for d in ("12", "13", "14")}
    assert len(got) == 9 and kinds == {"12": {"change"}, "13": {"hold"}, "14": {"hold"}}
    # The records state 0.25 * (x // 3 % 5), the middle of the range, where x % 13 is not 0; 8 has no level.
    level = lambda d, want: {(m, "abstained" if x % 13 == 0 else "correct" if 0.25 * (x // 3 % 5) == want else "wrong") for m in range(3) if (x := d * 7 + m * 13) % 23}
    for d, want in ((12, 0.75), (13, 2.25), (14, None)):
        assert {(m, got[str(d), f"m{m}"]["level"]) for m in range(3) if got[str(d), f"m{m}"]["status"] == "graded"} == level(d, want)


def test_links_of_every_order_are_classified(spark, tables):
    """One order per pair of form and link text; each form is taken with its own texts only."""
    sf = tables("orders", [(k, TS) for k in range(55)], "o_orderkey long, o_orderdate timestamp_ntz")
    fed = {0: (0, 1), 1: (1,), 2: (1,), 3: (1,), 4: (0, 2), 5: (0, 2)}
    ecb = {6: (3,), 7: (3,), 8: (0, 1, 2, 4), 9: (0, 1, 2, 4)}
    for name, texts, titled in (("fed_link_classify", fed, False), ("ecb_link_classify", ecb, True)):
        got = sorted(r["o_orderkey"] for r in catalogue.QUERIES[name](spark, sf).collect())
        assert got == [k for k in range(55) if k % 5 in texts.get(k % 11, ()) and not (titled and k % 10 == 0)]


def test_documents_of_every_batch_are_exploded(spark, tables):
    rows = [(k, n, k * 10 + n) for k in range(1, 9) for n in (3, 1, 2)]
    sf = tables("lineitem", rows, "l_orderkey long, l_linenumber int, l_partkey long")
    got = sorted(tuple(r) for r in catalogue.QUERIES["explode_batch_docs"](spark, sf).select("batch_id", "position", "doc_id", "part").collect())
    assert got == [(k, n - 1, n, k * 10 + n) for k in range(1, 9) for n in (1, 2, 3)]


def test_provider_lines_hold_whole_texts(spark, tables):
    texts = ['He said "no" \\ twice\n\tand\x01 then, ' + "word " * 2000, "short", "déjà vu – 😀" * 9]
    sf = tables("conversations", [(c, 1, "user", t) for c, t in zip((0, 6, 30), texts)], "conv_id long, turn long, role string, text string")
    for name, tail in (("provider_openai", "!"), ("provider_anthropic", "")):
        got = {r["custom_id"]: r["payload"] for r in catalogue.QUERIES[name](spark, sf).collect() if r["payload"] is not None}
        assert got == {str(c * 7 + 1): t + tail for c, t in zip((0, 6, 30), texts)}


def test_p_values_of_the_whole_grid(spark, tables):
    """Exact p in rationals for orders of all sizes, far above 400 too."""
    keys = [*range(0, 60), 401, 5_003, 149_999, 2_000_000_011]
    sf = tables("orders", [(k,) for k in keys], "o_orderkey long")
    got = {(r["b"], r["c"]): r["p_value"] for r in catalogue.QUERIES["mcnemar_p_values"](spark, sf).collect()}
    p = lambda b, c: min(Fraction(1), Fraction(2 * sum(comb(b + c, i) for i in range(min(b, c) + 1)), 2 ** (b + c)))
    want = {(k % 41, k * 3 % 1301): float(p(k % 41, k * 3 % 1301)) for k in keys}
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x], abs=1e-8) for x in want)
