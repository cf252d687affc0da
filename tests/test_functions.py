import datetime as dt
import json
import math
import time
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from assayer import types as t
from assayer.functions import cost, html, stats, text
from assayer.functions.validate import with_record

CARDS = [
    (505, 524, 0.9441, 0.9767), (3, 524, 0.0019, 0.0167), (2, 391, None, None), (55, 64, None, None),
    (458, 476, 0.9410, 0.9759), (11, 476, 0.0130, 0.0409), (413, 468, 0.8501, 0.9086), (43, 468, 0.0689, 0.1215),
]


def test_wilson_reproduces_published_intervals(spark):
    df = spark.createDataFrame([(i, k, n) for i, (k, n, _, _) in enumerate(CARDS)] + [(98, 11, 11), (99, 0, 0)], "i int, k long, n long")
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    got = {r["i"]: r for r in df.select("i", lo.alias("lo"), hi.alias("hi"), stats.rate(F.col("k"), F.col("n")).alias("r")).collect()}
    for i, (_, _, a, b) in enumerate(CARDS):
        if a is not None:
            assert (round(got[i]["lo"], 4), round(got[i]["hi"], 4)) == (a, b)
    assert abs(got[98]["lo"] - 0.7412) < 1e-4 and got[98]["hi"] == 1.0
    assert got[99]["lo"] is None and got[99]["r"]["rate"] is None and got[99]["r"]["ci95"] is None


def test_mcnemar(spark):
    pairs = [(0, 0), (1, 1), (5, 0), (38, 0), (700, 800), (2000, 3), (13, 29)]
    df = spark.createDataFrame(pairs, "b long, c long")
    for (b, c), r in zip(pairs, df.select(stats.mcnemar_p(F.col("b"), F.col("c"))).collect()):
        n, k = b + c, min(b, c)
        want = 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)
        assert r[0] == pytest.approx(want, rel=1e-9, abs=1e-300)


def test_compare_is_three_valued(spark):
    df = spark.createDataFrame([(None, 1), (1, 1), (2, 1)], "g int, w int")
    assert [r[0] for r in df.select(stats.compare(F.col("g"), F.col("w"))).collect()] == ["abstained", "correct", "wrong"]


def test_costs(spark):
    row = spark.range(1).select(*[cost.cost_usd(F.lit(i), F.lit(o), F.lit(0.2), F.lit(1.25), d) for i, o, d in ((10**6, 10**6, 1.0), (10**6, 10**6, 0.5), (1000, 200, 0.5), (1000, 200, 1.0))]).first()
    assert list(row) == [1.45, 0.725, 0.000225, 0.00045]


def test_normalize(spark):
    raw = " a b‑c   d\n\x0b e\x1f "
    assert spark.createDataFrame([(raw,)], "t string").select(text.normalize(F.col("t"))).first()[0] == "a b-c d e" == html.normalize(raw)


@pytest.mark.parametrize("href,want", [("/press/pr/date/2026/html/ecb.mp260611~4d41bd5e83.en.html", "ecb_mp260611"), ("/press/pr/date/2005/html/pr050804_2.en.html", "ecb_pr050804_2")])
def test_ecb_ids(spark, href, want):
    assert spark.range(1).select(text.ecb_doc_id(F.lit(href))).first()[0] == want


def test_century_pivot(spark):
    r = spark.range(1).select(*[text.pivot_date(F.lit(d)) for d in ("990107", "260611", "900101", "891231", "991399")]).first()
    assert [str(x) for x in r] == ["1999-01-07", "2026-06-11", "1990-01-01", "2089-12-31", "None"]


def test_anchors_and_links(spark):
    page = """<dl><dt isoDate="2016-12-08">8 Dec</dt><dd><div class="title"><a href="/press/pr/date/2016/html/pr161208.en.html">Monetary Policy Decisions</a></div>
      <div class="title"><a href="/press/pr/date/2020/html/ecb.pr200318_1~3949d6f266.en.html">PEPP details</a></div><div><a href="/press/pr/date/2016/html/pr161208.fr.html">FR</a></div></dd></dl>"""
    a = html.anchors(spark.createDataFrame([(0, page)], "page int, html string"))
    ref = text.ecb_link(F.col("text"), F.col("in_title"), F.col("href"), F.col("iso_date"))
    got = [r["r"] for r in a.select(ref.alias("r")).filter("r IS NOT NULL").collect()]
    assert [(r["doc_id"], str(r["announcement_date"]), r["doc_type"]) for r in got] == [("ecb_pr161208", "2016-12-08", "decision"), ("ecb_pr200318_1", "2016-12-08", "non_decision")]


def test_fed_index(spark):
    from assayer.sources import fetch

    cal = '<div><a href="/newsevents/pressreleases/monetary20240918a.htm">HTML</a><a href="/monetarypolicy/beigebook202409.htm">HTML</a><a href="/monetarypolicy/fomcminutes20240131.htm">HTML</a> (Released February 21, 2024)</div>'
    old = '<p><a href="/boarddocs/press/general/2000/20000202/default.htm">Statement</a><a href="/newsevents/pressreleases/monetary20240918a.htm">Statement</a></p><div><a href="/fomc/minutes/20000202.htm">Minutes</a><i>(Released Mar. 23, 2000)</i></div>'
    pages = lambda h: spark.createDataFrame([(0, "u", h)], "page int, url string, html string")
    got = fetch.fed_statements(pages(cal), pages(old)).collect()
    assert [(r["doc_id"], str(r["announcement_date"])) for r in got] == [("fed_20000202", "2000-02-02"), ("fed_20240918a", "2024-09-18")]
    m = fetch.fed_minutes(pages(cal), pages(old), [2000, 2024]).collect()
    assert [(r["doc_id"], str(r["announcement_date"])) for r in m] == [("fed_min_20000202", "2000-03-23"), ("fed_min_20240131", "2024-02-21")]
    with pytest.raises(RuntimeError):
        fetch.fed_minutes(pages(cal), pages(old), [2000, 2001, 2024])
    with pytest.raises(RuntimeError, match="2001"):
        fetch.verify_coverage(fetch.fed_statements(pages(cal), pages(old)), 2002)


def test_modern_statement():
    page = """<div id="article"><div class="heading col-sm-8"><p class="article__time">September 18, 2024</p><p>no</p></div><div class="col-sm-8"><p>First&nbsp;one.</p><p><a href="/x">Note</a></p>
      <p>mail <span class="__cf_email__">x</span></p><p>by <a href="/cdn-cgi/l">p</a></p><p>See <a href="/y">this</a> too.</p></div></div>"""
    assert html.page_text("fed", page) == "Published: September 18, 2024\n\nFirst one.\n\nSee this too."
    with pytest.raises(ValueError):
        html.page_text("fed", "<p>nothing</p>")


def test_marked_statement():
    page = "<p>Release Date: May 3, 2005</p><table><td><!-- DO NOT REMOVE: a -->\n<p>One<p>Two <b>bold</b><p>\n<!-- DO NOT REMOVE: b --><p>foot</table>"
    assert html.page_text("fed", page) == "Release Date: May 3, 2005\n\nOne\n\nTwo bold"
    assert html.page_text("fed", "<table><tr><td>Body text Last update: May</td></tr></table>") == "Body text "


def test_minutes_and_release():
    long = "word " * 1100
    page = f'<div id="leftText"><p>{long}<p>Tail</p><li>Return to top</li><p><a href="/z">Only link</a></p></div><div id="lastUpdate">Last update: July 1, 2009</div>'
    got = html.page_text("fed_minutes", page)
    assert got.startswith("Published: July 1, 2009\n\nword") and got.endswith("Tail")
    with pytest.raises(ValueError):
        html.page_text("fed_minutes", "<p>short</p>")
    ecb = '<main><div class="section"><p class="ecb-publicationDate">11 June 2026</p><h2>H</h2><p>A</p><p>***</p></div><div class="orderedlist"><li>B</li></div><div class="other"><p>no</p></div></main>'
    assert html.page_text("ecb", ecb) == "Published: 11 June 2026\n\nH\n\nA\n\nB"
    with pytest.raises(ValueError):
        html.page_text("ecb", "<p>x</p>")


def test_extract_never_fails_the_job(spark):
    df = spark.createDataFrame([(1, "<article><p>a<p>b</article>"), (2, "<p>x</p>"), (3, None)], "id int, html string")
    got = {r["id"]: r for r in html.extract(df, "article").collect()}
    assert got[1]["text"] == "a\n\nb" and got[2]["text"] is None and got[2]["text_error"] and got[3]["text"] is None


def payload(**kw):
    base = {"bank": "FED", "decision_date": "2024-09-18", "effective_date": None, "action": "cut", "change_bps": -50, "target_range_lower_pct": 4.75, "target_range_upper_pct": 5, "dfr_pct": None, "mro_pct": None, "mlf_pct": None, "evidence_quote": "q"}
    return json.dumps({**base, **kw})


@pytest.mark.parametrize(
    "change,ok,field,value",
    [
        ({}, True, "change_bps", -50), ({"change_bps": "25"}, True, "change_bps", 25), ({"change_bps": 25.0}, True, "change_bps", 25), ({"change_bps": True}, True, "change_bps", 1),
        ({"change_bps": 25.5}, False, None, None), ({"change_bps": ""}, False, None, None), ({"dfr_pct": "2.25"}, True, "dfr_pct", 2.25), ({"extra": 1}, True, "action", "cut"),
        ({"bank": "fed"}, False, None, None), ({"evidence_quote": 5}, False, None, None), ({"evidence_quote": None}, False, None, None), ({"decision_date": "June 11, 2026"}, False, None, None),
        ({"decision_date": "2026-06-11T00:00:00"}, True, "evidence_quote", "q"), ({"decision_date": "2026-06-11T10:00:00"}, False, None, None), ({"decision_date": "2026-06"}, False, None, None), ({"action": "raise"}, False, None, None),
    ],
)
def test_payloads(spark, change, ok, field, value):
    r = spark.createDataFrame([(payload(**change),)], "p string").transform(with_record, F.col("p"), "r").first()["r"]
    assert r["ok"] is ok and (r["error"] is None) == ok
    assert not ok or r["record"][field] == value
    assert ok or r["error"].startswith("schema_violation:")


def test_payload_shapes(spark):
    short = json.loads(payload())
    del short["mlf_pct"]
    rows = [("{",), ("[1]",), ("null",), (json.dumps(short),), (None,)]
    got = [r["r"] for r in spark.createDataFrame(rows, "p string").transform(with_record, F.col("p"), "r").collect()]
    assert [g and g["ok"] for g in got] == [False] * 4 + [None] and "mlf_pct" in got[3]["error"]


def test_schema_mirrors_record():
    s = t.record_json_schema()
    assert s["required"] == list(t.RECORD_FIELDS) == list(s["properties"]) == t.RECORD.fieldNames() and s["additionalProperties"] is False


@pytest.mark.parametrize("value,want", [("0", dt.date(1970, 1, 1)), ("86400", dt.date(1970, 1, 2)), ('"86400"', dt.date(1970, 1, 2)), ("1718064000000", dt.date(2024, 6, 11)), ("-86400.0", dt.date(1969, 12, 31)), ("5", None), ("true", None)])
def test_whole_days_are_dates(spark, value, want):
    df = spark.createDataFrame([(payload(decision_date="@").replace('"@"', value),)], "p string")
    r = with_record(df, F.col("p"), "r").first()["r"]
    assert r["ok"] == (want is not None) and (want is None or str(r["record"]["decision_date"]) == str(want))


def test_validation_keeps_rows_and_columns(spark):
    rows = [(k, p) for k, p in enumerate([payload(), payload(change_bps=1.5), payload(bank="BOE"), "[1]", "x", "", "{}", None, payload(change_bps="7"), payload(action=None), payload(dfr_pct="nan")])]
    df = spark.createDataFrame(rows, "row int, p string")
    got = with_record(df, F.col("p"), "r")
    assert got.columns == ["row", "p", "r"]
    assert {r["row"]: r["r"] and r["r"]["ok"] for r in got.collect()} == {0: True, 1: False, 2: False, 3: False, 4: False, 5: False, 6: False, 7: None, 8: True, 9: False, 10: True}


def test_deep_pages_take_linear_time():
    """A hundred thousand unclosed paragraphs, each within all before it."""
    began = time.time()
    assert html.page_text("article", "<article>" + "<p>x " * 100_000) == "\n\n".join(["x"] * 100_000)
    assert time.time() - began < 20


def test_spans_nest_by_ticks():
    page = html.Page("a<p>b<b>c</b><p>d<script>e</script></div>f</p>g", ("p",))
    assert [(s.tag, page.text(s), page.own(k, False)) for k, s in enumerate(page.spans)] == [("p", "b c d f g", "b c g"), ("b", "c", ""), ("p", "d f", "d f"), ("script", "", "")]
    assert [s.tag for _, s in page.within(page.spans[0])] == ["b", "p", "script"] and html.page_whole(page) == "a b c d f g"


def test_layouts_are_tried_in_turn():
    with pytest.raises(ValueError, match="without"):
        html.page_text("fed", '<div id="article"><p>x</p></div>')
    with pytest.raises(ValueError, match="unknown layout"):
        html.page_text("fed", "<table></table>")
    assert html.page_text("fed", "<table></table><table><td>x</td></table>") == "x"
    with pytest.raises(KeyError):
        html.page_text("other", "")


def exact_p(b, c):
    """In whole numbers, from the largest term down."""
    n, k = b + c, min(b, c)
    if n == 0:
        return 1.0
    return min(1.0, float(Fraction(2 * sum(math.comb(n, i) for i in range(k + 1)), 2**n)))


def test_mcnemar_of_small_counts(spark):
    pairs = [(b, c) for b in range(0, 41, 3) for c in [0, 1, 2, 5, 17, 40, 200, 1300]] + [(15, 16), (16, 16), (0, 1100), (500, 600)]
    got = {(r["b"], r["c"]): r["p"] for r in spark.createDataFrame(pairs, "b long, c long").select("b", "c", stats.mcnemar_p(F.col("b"), F.col("c")).alias("p")).collect()}
    for x in pairs:
        assert got[x] == pytest.approx(exact_p(*x), rel=1e-12)


def test_mcnemar_of_large_counts(spark):
    """Ten million against five thousand more, in one row; the tail by logarithms of Python's gamma function, whose digits there are ten."""
    pairs = [(10_000_000, 10_005_000), (10_005_000, 10_000_000), (250_000, 251_500), (3_000_000_000, 3_000_000_000), (7, 5_000_000)]
    got = [r["p"] for r in spark.createDataFrame(pairs, "b long, c long").coalesce(1).select(stats.mcnemar_p(F.col("b"), F.col("c")).alias("p")).collect()]

    def plain(b, c):
        n, k = b + c, min(b, c)
        top = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2)
        total, term, i = 1.0, 1.0, 0
        while term > 1e-18 and i < k:
            term *= (k - i) / (n - k + 1 + i)
            total += term
            i += 1
        return min(1.0, 2 * math.exp(top) * total)

    assert got[0] == got[1] == pytest.approx(plain(*pairs[0]), rel=1e-6) and 0.2 < got[0] < 0.3
    # the normal law with a correction for continuity agrees to a few parts in a million there
    assert got[0] == pytest.approx(math.erfc((5000 - 1) / math.sqrt(20_005_000) / math.sqrt(2)), rel=1e-5)
    assert got[2] == pytest.approx(plain(*pairs[2]), rel=1e-8) and got[3] == 1.0 and got[4] == 0.0


def test_pages_come_in_bounded_batches(spark):
    """Python holds a batch of pages several times over, so what a batch holds is bounded in rows and in bytes."""
    from pyspark.sql import functions as F

    from assayer.functions import batches, html

    kept = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")}
    try:
        pages = spark.range(0, 3000, 1, 1).select("id", F.concat(F.lit("<article><p>a</p><a href='/x'>b</a></article>"), F.repeat(F.lit(" "), 9000)).alias("html"))
        for make in (lambda p: html.extract(p, "article"), html.anchors):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
            spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
            assert make(pages).count() == 3000
            assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= batches.BATCH_ROWS and int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= batches.BATCH_BYTES
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
