import datetime as dt

import pytest
from pyspark.sql import functions as F

from assayer import types as t
from assayer.operators import grading, scorecard, temporal

D = dt.date
US = [("US", D(2024, 9, 19), 5.375, 4.875, -50, "cut", "FFTR_MID", False), ("US", D(2024, 11, 8), 4.875, 4.625, -25, "cut", "FFTR_MID", False)]
XM = [("XM", D(2008, 10, 15), 4.25, 3.75, -50, "cut", "MRO", False), ("XM", D(2024, 9, 18), 4.25, 3.5, -75, "cut", "DFR", True), ("XM", D(2026, 6, 17), 2.0, 2.25, 25, "hike", "DFR", False)]
CAL = [("FED", d) for d in ("2008-12-16", "2024-09-18", "2024-10-15", "2024-10-16", "2024-10-17")] + [("ECB", d) for d in ("2019-09-12", "2024-09-12", "2025-02-06", "2026-06-11")]
SHIFT_DDL = "ref_area string, effective_date date, old_level double, new_level double, change_bps int, direction string, instrument string, excluded boolean"


def rec(action, bps=None, lo=None, hi=None, dfr=None, mro=None, eff=None, dec=None, bank="FED"):
    return {"bank": bank, "decision_date": dec, "effective_date": eff, "action": action, "change_bps": bps, "target_range_lower_pct": lo, "target_range_upper_pct": hi, "dfr_pct": dfr, "mro_pct": mro, "mlf_pct": None, "evidence_quote": "q"}


def grade(spark, docs, shifts=None, cal=None, model="m"):
    """docs: (doc_id, bank, date, doc_type, record or None)."""
    rows = [(d, b, day, model, "v1", "s1", r is not None, r, None, 10, 1, 0.001, 5) for d, b, day, _, r in docs]
    art = spark.createDataFrame(rows, t.ARTIFACT)
    types = spark.createDataFrame([(d, k) for d, _, _, k, _ in docs], "doc_id string, doc_type string")
    s = spark.createDataFrame(shifts if shifts is not None else US + XM, SHIFT_DDL)
    c = spark.createDataFrame([(b, D.fromisoformat(d)) for b, d in (cal or CAL)], "bank string, announcement_date date")
    return grading.grade(grading.resolve_doc_types(art, types), s, c), art


def one(spark, bank, day, record, kind="statement", **kw):
    g, _ = grade(spark, [("x", bank, day, kind, record)], **kw)
    return g.first()


def test_change(spark):
    r = one(spark, "FED", "2024-09-18", rec("cut", -50, 4.75, 5.0, dec="2024-09-18"))
    assert (r["expected_kind"], r["action_correct"], r["change_bps"], r["level"], r["effective_date"], r["decision_date"]) == ("change", True, "correct", "correct", "abstained", "correct")
    assert r["fabricated_decision"] is None and r["wrong_direction"] is False
    assert one(spark, "FED", "2024-09-18", rec("cut", -25, 4.75, 5.0))["change_bps"] == "wrong"
    r = one(spark, "FED", "2024-09-18", rec("hike", 50))
    assert r["action_correct"] is False and r["wrong_direction"] is True and r["level"] == "abstained"


def test_change_on_rate(spark):
    r = one(spark, "ECB", "2026-06-11", rec("hike", 25, dfr=2.25, eff="2026-06-17", dec="2026-06-11", bank="ECB"))
    assert [r[k] for k in ("change_bps", "level", "effective_date", "decision_date")] == ["correct"] * 4


def test_point_to_range_has_no_bps(spark):
    s = [("US", D(2008, 12, 17), 1.0, 0.125, -88, "cut", "FFTR_MID", False)]
    r = one(spark, "FED", "2008-12-16", rec("cut", -75, 0.0, 0.25), shifts=s)
    assert r["change_bps"] is None and r["level"] == "correct"


def test_later_announcement_owns_the_event(spark):
    s = [("XM", D(2001, 9, 18), 4.25, 3.75, -50, "cut", "MRO", False)]
    cal = [("ECB", "2001-09-13"), ("ECB", "2001-09-17")]
    docs = [("a", "ECB", "2001-09-13", "decision", rec("hold", mro=4.25, bank="ECB")), ("b", "ECB", "2001-09-17", "decision", rec("cut", -50, mro=3.75, bank="ECB")), ("c", "ECB", "2001-09-17", "decision", rec("cut", -50, mro=3.75, bank="ECB"))]
    g, _ = grade(spark, docs, s, cal)
    got = {r["doc_id"]: r for r in g.collect()}
    assert got["a"]["expected_kind"] == "hold" and got["a"]["action_correct"] and got["a"]["level"] == "correct"
    assert all(got[k]["expected_kind"] == "change" and got[k]["level"] == "correct" for k in "bc")
    alone, _ = grade(spark, docs[:1], s, cal)
    assert alone.first()["expected_kind"] == "hold"


def test_hold(spark):
    r = one(spark, "FED", "2024-10-15", rec("hold", lo=4.75, hi=5.0))
    assert (r["expected_kind"], r["action_correct"], r["fabricated_decision"], r["level"]) == ("hold", True, False, "correct")
    assert one(spark, "FED", "2024-10-15", rec("cut", -25))["fabricated_decision"] is True
    assert one(spark, "ECB", "2025-02-06", rec("hold", dfr=3.5, bank="ECB"))["level"] == "correct"


def test_tolerance_is_strict_on_doubles(spark):
    for got, want in ((4.870, "correct"), (4.865, "wrong")):
        assert one(spark, "FED", "2024-09-18", rec("cut", -50, got, got))["level"] == want


@pytest.mark.parametrize("action,ok", [("no_policy_decision", True), ("hike", False), ("cut", False), ("hold", False)])
def test_traps(spark, action, ok):
    r = one(spark, "FED", "2024-09-18", rec(action), "minutes")
    assert (r["status"], r["expected_kind"], r["action_correct"], r["fabricated_decision"], r["level"], r["decision_date"]) == ("graded", "trap", ok, not ok, None, None)


def test_failures_and_ungradeables(spark):
    r = one(spark, "FED", "2024-09-18", None, "minutes")
    assert (r["status"], r["expected_kind"], r["fabricated_decision"]) == ("extraction_failed", "trap", None)
    r = one(spark, "ECB", "2024-09-12", rec("cut", -25, bank="ECB"))
    assert (r["status"], r["action_correct"]) == ("ungradeable_redefinition_window", None)
    assert one(spark, "ECB", "2019-09-12", rec("cut", bank="ECB"))["status"] == "ungradeable_corridor_only"


def test_unknown_document_is_an_error(spark):
    _, art = grade(spark, [("x", "FED", "2024-09-18", "statement", None)])
    with pytest.raises(ValueError, match="1 documents"):
        grading.guard_unknown(art, spark.createDataFrame([("y", "s")], "doc_id string, doc_type string"))


def test_summary_and_league(spark):
    docs = [
        ("a", "FED", "2024-09-18", "statement", rec("cut", -50, 4.75, 5.0)), ("b", "FED", "2024-10-15", "statement", rec("hold", lo=4.75, hi=5.0)),
        ("c", "FED", "2024-10-16", "statement", rec("cut", -25)), ("d", "FED", "2024-10-17", "statement", None),
        ("t1", "FED", "2024-10-17", "minutes", rec("no_policy_decision")), ("t2", "FED", "2024-10-17", "minutes", rec("hold")), ("t3", "FED", "2024-10-17", "minutes", None),
    ]
    g, art = grade(spark, docs)
    s = scorecard.summarize(g, art).first().asDict(recursive=True)
    assert [s[k] for k in ("documents", "graded", "extraction_failed", "events", "holds")] == [4, 3, 1, 1, 2]
    assert s["action_accuracy"]["rate"] == 0.6667 and s["hallucination_rate"]["rate"] == 0.3333 and s["fabricated_decision_rate"]["rate"] == 0.5
    assert (s["traps"]["documents"], s["traps"]["graded"], s["traps"]["extraction_failed"], s["traps"]["false_positive_rate"]["rate"], s["traps"]["false_positive_rate"]["n"]) == (3, 2, 1, 0.3333, 3)
    assert s["cost_usd"] == 0.007 and s["input_tokens"] == 70
    assert "66.7% [" in scorecard.league_table([s])


def test_pairs_leave_traps_out(spark):
    docs = [("a", "FED", "2024-10-15", "statement", rec("hold", lo=4.75, hi=5.0)), ("t", "FED", "2024-10-15", "minutes", rec("hold"))]
    g1, _ = grade(spark, docs, model="m1")
    g2, _ = grade(spark, [("a", "FED", "2024-10-15", "statement", rec("cut"))], model="m2")
    both = g1.unionByName(g2).filter("status = 'graded' AND expected_kind <> 'trap'")
    r = scorecard.pairwise(both).first()
    assert (r["model_a"], r["model_b"], r["n_paired"], r["only_a_correct"], r["only_b_correct"], r["p_value"]) == ("m1", "m2", 1, 1, 0, 1.0)


def test_each_event_has_one_owner(spark):
    days = [D(2024, 1, 1) + dt.timedelta(days=k) for k in (0, 3, 3, 4, 9, 20, 22)]
    docs = spark.createDataFrame([(i, "k", d) for i, d in enumerate(days)], "doc int, key string, announcement_date date")
    events = spark.createDataFrame([("k", D(2024, 1, 1) + dt.timedelta(days=k)) for k in range(0, 34)], "key string, effective_date date")
    c = temporal.window_candidates(docs, events, ["key"], 10, 10)
    assert c.count() == sum(11 for _ in days)
    o = temporal.owned(c, docs, ["key"]).filter("owned").select("effective_date", "announcement_date").distinct()
    assert o.count() == o.select("effective_date").distinct().count()


def test_unknown_banks_and_empty_series_fail(spark):
    from assayer.operators import grading

    record = "struct<bank:string,decision_date:string,effective_date:string,action:string,change_bps:int,target_range_lower_pct:double,target_range_upper_pct:double,dfr_pct:double,mro_pct:double>"
    ddl = f"doc_id string, bank string, announcement_date string, model_key string, prompt_version string, ok boolean, record {record}, doc_type string"
    said = ("FED", "2024-05-01", None, "hold", None, 5.0, 5.25, None, None)
    shifts = spark.createDataFrame([], "ref_area string, effective_date date, old_level double, new_level double, change_bps int, direction string, instrument string, excluded boolean")
    for bank, what in (("BOE", "unknown bank BOE"), (None, "unknown bank null"), ("FED", "no shifts for FED")):
        rows = spark.createDataFrame([("d", bank, "2024-05-01", "m", "v1", True, said, "statement")], ddl)
        with pytest.raises(Exception, match=what):
            grading.grade(rows, shifts, rows.select("bank", F.col("announcement_date").cast("date").alias("announcement_date")).filter("bank = 'FED'")).collect()
    rows = spark.createDataFrame([("d", "FED", "2024-05-01", "m", "v1", True, said, "statement")], ddl)
    got = grading.grade(rows, shifts, rows.selectExpr("bank", "CAST(announcement_date AS DATE) AS announcement_date"), empty_series=True).first()
    assert (got["status"], got["expected_kind"], got["action_correct"], got["level"]) == ("graded", "hold", True, "wrong")


def test_days_find_their_next_event_announcement_and_level(spark):
    """Against a search of all shifts and announcements for each day, with several shifts and excluded ones on a day."""
    import random

    rng = random.Random(7)
    day = lambda k: D(2024, 1, 1) + dt.timedelta(days=k)
    data = []
    for s in range(12):
        level = None
        for n, k in enumerate(sorted(rng.choices(range(40), k=rng.choice((0, 1, 6, 25))))):
            new = rng.choice([x for x in (1.0, 2.0, 3.0, 4.0) if x != level])
            data.append((s, day(k), n, level, new, n, "up", "X", rng.random() < 0.3))
            level = new
    shifts = spark.createDataFrame(data, "s int, effective_date date, n int, old_level double, new_level double, change_bps int, direction string, instrument string, excluded boolean")
    asked = sorted({(s, day(rng.randrange(-3, 45))) for s in range(13) for _ in range(8)})
    announced = sorted({(s, day(rng.randrange(45))) for s in range(13) for _ in range(6)}) + asked[::3]
    table = lambda x: spark.createDataFrame(x + x[:5], "s int, _day date")
    for firsts in (False, True):
        got = {(r["s"], r["_day"]): r for r in grading.day_events(shifts, table(asked), table(announced), ["s"], ("effective_date", "n"), firsts).collect()}
        assert sorted(got) == asked
        for (s, d), r in got.items():
            mine = [x for x in data if x[0] == s]
            later = [x for x in mine if x[1] >= d and (x[3] is not None or not firsts)]
            event = next((x for x in later if not x[8]), None)
            upto = [x for x in mine if x[1] <= d]
            assert (r["_event"] and r["_event"]["change_bps"]) == (event and event[2])
            assert r["_out_day"] == next((x[1] for x in later if x[8]), None)
            assert r["_next_day"] == min((x[1] for x in announced if x[0] == s and x[1] > d), default=None)
            assert r["prevailing_level"] == (upto[-1][4] if upto else mine[0][3] if mine else None)
