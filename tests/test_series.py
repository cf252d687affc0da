import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assayer.cli import golden
from assayer.operators import ranges, series
from assayer.sources import readers

D = dt.date


def daily(spark, area, rows):
    data = [(area, D.fromisoformat(d), v) for d, v in rows]
    return spark.createDataFrame(data, "ref_area string, date date, raw string").select("ref_area", "date", series.clean_level(F.col("raw")).alias("level"))


def shifts(spark, area, rows):
    s = series.level_shifts(daily(spark, area, rows), ["ref_area"], ["date"]).withColumnRenamed("date", "effective_date")
    return series.classify_shifts(s).orderBy("effective_date").collect()


def test_nan_is_filled(spark):
    rows = [("2024-09-20", "3.50"), ("2024-09-21", "NaN"), ("2024-09-22", "x"), ("2024-09-23", "3.50")]
    got = series.ffill(daily(spark, "XM", rows), ["ref_area"], ["date"]).orderBy("date").collect()
    assert [r["level"] for r in got] == [3.5] * 4


def test_leading_gap_is_dropped_and_fill_crosses_months(spark):
    rows = [("2024-01-30", "NaN"), ("2024-01-31", "1.0"), ("2024-02-01", "NaN"), ("2024-04-01", "NaN")]
    got = series.ffill(daily(spark, "XM", rows), ["ref_area"], ["date"]).orderBy("date").collect()
    assert [(r["date"].month, r["level"]) for r in got] == [(1, 1.0), (2, 1.0), (4, 1.0)]


def test_cut_is_one_event(spark):
    [e] = shifts(spark, "US", [("2024-09-17", "5.375"), ("2024-09-18", "5.375"), ("2024-09-19", "4.875"), ("2024-09-20", "4.875")])
    assert (e["effective_date"], e["change_bps"], e["direction"], e["instrument"], e["excluded"]) == (D(2024, 9, 19), -50, "cut", "FFTR_MID", False)


@pytest.mark.parametrize("rows", [[("2024-05-01", "4.375"), ("2024-05-02", "4.375")], [("2024-05-01", "3.25"), ("2024-05-02", "NaN"), ("2024-05-03", "NaN"), ("2024-05-04", "3.25")]])
def test_hold_and_gap_are_no_event(spark, rows):
    assert shifts(spark, "US", rows) == []


def test_change_across_missing_day(spark):
    [e] = shifts(spark, "US", [("2024-10-17", "4.875"), ("2024-10-19", "4.625")])
    assert (e["effective_date"], e["change_bps"]) == (D(2024, 10, 19), -25)


def test_exclusions_are_kept(spark):
    [a] = shifts(spark, "US", [("1999-11-15", "5.25"), ("1999-11-16", "5.50")])
    assert a["excluded"] and "outside project window" in a["exclusion_reason"]
    [b] = shifts(spark, "XM", [("2024-09-17", "4.25"), ("2024-09-18", "3.50")])
    assert b["excluded"] and b["change_bps"] == -75 and "redefinition" in b["exclusion_reason"] and b["instrument"] == "DFR"
    [c] = shifts(spark, "XM", [("2008-10-14", "4.25"), ("2008-10-15", "3.75")])
    assert not c["excluded"] and c["audit_note"] and c["instrument"] == "MRO"


def test_half_even_and_tiny_shift(spark):
    rows = [("2020-01-01", "1.0"), ("2020-01-02", "0.125"), ("2020-01-03", "0.129")]
    assert [(e["change_bps"], e["direction"]) for e in shifts(spark, "US", rows)] == [(-88, "cut"), (0, "cut")]


def test_regimes(spark):
    days = ["1999-06-01", "2005-03-01", "2024-09-17", "2024-09-18", "2026-06-17", "1990-01-01"]
    df = spark.createDataFrame([(D.fromisoformat(d),) for d in days], "d date")
    from assayer.rules import DEFAULT_RULES

    got = [r[0] for r in df.select(series.regime(F.col("d"), DEFAULT_RULES.regimes)).collect()]
    assert got == ["MRO", "MRO", "MRO", "DFR", "DFR", "MRO"]


def test_as_of_steps(spark):
    s = spark.createDataFrame([("XM", D(2008, 10, 15), 4.25, 3.75), ("XM", D(2024, 9, 18), 4.25, 3.5), ("XM", D(2026, 6, 17), 2.0, 2.25)], "ref_area string, effective_date date, old_level double, new_level double")
    asked = spark.createDataFrame([("XM", D(2008, 1, 1)), ("XM", D(2010, 1, 1)), ("XM", D(2025, 2, 6)), ("XM", D(2026, 6, 17)), ("US", D(2020, 1, 1))], "ref_area string, d date")
    got = {(r["ref_area"], r["d"].year): r["prevailing_level"] for r in series.as_of(asked, s, ["ref_area"], "d", ["effective_date"]).collect()}
    assert got == {("XM", 2008): 4.25, ("XM", 2010): 3.75, ("XM", 2025): 3.5, ("XM", 2026): 2.25, ("US", 2020): None}


def test_golden_end_to_end(spark, tmp_path):
    head = "FREQ,TIME_PERIOD,TITLE,OBS_VALUE\n"
    (tmp_path / "us.csv").write_text(head + 'D,1999-11-15,"a, b",5.25\nD,1999-11-16,"a, b",5.5\nD,2024-09-18,x,5.5\nD,2024-09-19,x,5.0\n')
    (tmp_path / "xm.csv").write_text(head + "D,2024-09-17,x,4.25\nD,2024-09-18,x,3.5\nD,2026-06-16,x,3.5\nD,2026-06-17,x,3.75\n")
    events = golden(spark, {"US": str(tmp_path / "us.csv"), "XM": str(tmp_path / "xm.csv")})
    assert events.count() == 4 and events.filter("excluded").count() == 2
    assert {(r["ref_area"], r["change_bps"]) for r in events.filter("NOT excluded").collect()} == {("US", -50), ("XM", 25)}
    (tmp_path / "bad.csv").write_text("A,B\n1,2\n")
    with pytest.raises(ValueError, match="OBS_VALUE"):
        readers.read_sdmx(spark, str(tmp_path / "bad.csv"), "US")


@settings(max_examples=8, deadline=None)
@given(st.lists(st.sampled_from([0.25, 0.5, 0.75, None]), min_size=1, max_size=40), st.data())
def test_shifts_ignore_repeated_levels(spark, levels, data):
    """Against a plain loop; repeating a day's level changes nothing."""
    at = data.draw(st.integers(0, len(levels) - 1))
    for values in (levels, levels[: at + 1] + levels[at:]):
        rows = [("u", D(2020, 1, 1) + dt.timedelta(days=3 * k), v) for k, v in enumerate(values)]
        df = spark.createDataFrame(rows, "k string, date date, level double")
        got = [(r["old_level"], r["new_level"]) for r in series.level_shifts(df, ["k"], ["date"]).orderBy("date").collect()]
        want, last = [], None
        for v in values:
            if v is not None:
                if last is not None and v != last:
                    want.append((last, v))
                last = v
        assert got == want


# ---- series of several blocks -------------------------------------------------------------

DDL = "k string, ts long, n long, level double"


def plain_scan(rows, backward=False):
    """(last value up to the row, last value before it) of every row, by a loop."""
    out, last = {}, {}
    for k, ts, n, v in sorted(rows, key=lambda r: ((r[0] is not None, r[0]), r[1], r[2]), reverse=backward):
        out[k, ts, n] = (v if v is not None else last.get(k), last.get(k))
        last[k] = out[k, ts, n][0]
    return out


@pytest.mark.parametrize("backward", [False, True])
def test_one_hot_key_spreads_over_blocks(spark, backward):
    """A key with most rows, all of one month and many of one moment, in more blocks than one; null keys and long gaps too."""
    rnd = __import__("random").Random(7)
    rows = [("hot", 1_700_000_000 + k // 40, k, rnd.choice([0.25, 0.5, None, None, None])) for k in range(6000)]
    rows += [("hot", 1_700_000_150, 10_000 + k, None) for k in range(1500)]
    rows += [(k, 1_700_000_000 + n, n, rnd.choice([1.0, 2.0, None])) for k in (None, "a", "m", "z") for n in range(60)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, DDL).repartition(6)
    cuts = ranges.bounds(df, ["k"], ["ts", "n"], rows=250)
    assert len(cuts.firsts) >= 25 and sum(r[0] == "hot" for r in cuts.firsts) >= 20
    sizes = [r["count"] for r in df.groupBy(cuts.block(df).alias("b")).count().collect()]
    assert len(sizes) == len(cuts.firsts) + 1 and max(sizes) < 1000 and sum(sizes) == len(rows)
    got = ranges.carry(df, cuts, ["level"], upto="_upto", beside="_beside", backward=backward)
    want = plain_scan(rows, backward)
    assert {(r["k"], r["ts"], r["n"]): (r["level_upto"], r["level_beside"]) for r in got.collect()} == want and got.count() == len(rows)


def test_blocks_give_what_one_block_gives(spark):
    rnd = __import__("random").Random(8)
    rows = [(rnd.choice("xxxxxy"), k // 3, k, rnd.choice([0.25, 0.5, 0.75, None])) for k in range(3000)]
    df = spark.createDataFrame(rows, DDL)
    key, order = ["k"], ["ts", "n"]
    cuts = ranges.bounds(df, key, order, rows=100)
    same = lambda f: (sorted(map(tuple, f(None).collect()), key=repr), sorted(map(tuple, f(cuts).collect()), key=repr))
    a, b = same(lambda c: series.ffill(df, key, order, cuts=c))
    assert a == b and len(cuts.firsts) > 20
    a, b = same(lambda c: series.level_shifts(df, key, order, cuts=c))
    assert a == b and len(a) > 500
    shifts = lambda c: series.level_shifts(df, key, order, first=True, cuts=c).withColumn("effective_date", F.date_add(F.lit(D(2024, 1, 1)), F.col("ts").cast("int")))
    a, b = same(lambda c: series.validity_intervals(shifts(c), key, order, cuts=c))
    assert a == b and sum(r[-1] is None for r in a) == 2


def test_as_of_is_as_long_as_its_calendar(spark):
    """Many shifts a day: the day's last holds from that day on; questions with a null date or key get the first old level or none."""
    s = spark.createDataFrame([("a", D(2024, 1, 1 + k // 50), k, float(k), float(k + 1)) for k in range(500)], "k string, effective_date date, n long, old_level double, new_level double")
    asked = spark.createDataFrame([("a", D(2024, 1, 3)), ("a", D(2024, 1, 3)), ("a", D(2023, 1, 1)), ("a", None), (None, D(2024, 1, 3)), ("a", D(2025, 1, 1))], "k string, d date")
    got = sorted(((r["k"], r["d"], r["prevailing_level"]) for r in series.as_of(asked, s, ["k"], "d", ["n"]).collect()), key=repr)
    assert got == sorted([("a", D(2024, 1, 3), 150.0)] * 2 + [("a", D(2023, 1, 1), 0.0), ("a", None, 0.0), (None, D(2024, 1, 3), None), ("a", D(2025, 1, 1), 500.0)], key=repr)


def test_numbers_are_gapless(spark, tmp_path):
    df = spark.range(0, 5000, 1, 9).select((F.col("id") * 7919 % 5003).alias("v"), F.lit("x").alias("id_of"))
    got = ranges.numbered(df, [F.desc("v")], f"{tmp_path}/numbered", first=10)
    assert [r["id"] for r in got.orderBy(F.desc("v")).collect()] == list(range(10, 5010)) and got.columns == ["v", "id_of", "id"]
    assert ranges.numbered(df.limit(0), ["v"], f"{tmp_path}/none").collect() == []
