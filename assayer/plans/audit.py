"""Series, temporal, grading and scorecard queries, re-hosted on the test tables.

Vocabulary: an entity is a ``user_id``; its bank is FED (even) or ECB (odd), windows of 5 and
10 days; its level series are its events by (ts, event_id), missing where the event is an
error, else floor(value / 100) * 0.25; a document is a 'signup' event, announced on its day.
The oracles are written from the semantics, with correlated NOT EXISTS, ASOF joins and plain
windows, not from the DataFrame code.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions.stats import mcnemar_p, wilson
from assayer.operators import grading, scorecard, series, temporal
from assayer.operators.ranges import Bounds, bounds
from assayer.rules import GradingRules

KEYS, ORDER = ["user_id"], ["ts", "event_id"]
MODELS = ("m0", "m1", "m2")
D = dt.date
RULES = GradingRules(
    ref_area={"FED": "FED", "ECB": "ECB"},
    window_start={"FED": D(2024, 1, 3), "ECB": D(2024, 1, 4)},
    regimes=((D(2024, 1, 1), "MRO"), (D(2024, 1, 16), "DFR")),
    regime_area="ECB",
    redefinition_dates=(D(2024, 1, 16), D(2024, 1, 17)),
    redefinition_reason="series redefinition",
    audit_dates=(D(2024, 1, 10), D(2024, 1, 20)),
    audit_note="audit",
    corridor_only={"ECB": (D(2024, 1, 7), D(2024, 1, 12))},
    range_transition={"FED": (D(2024, 1, 8), D(2024, 1, 22))},
)


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_levels(spark, sf_dir: str) -> DataFrame:
    return levels_of(read(spark, sf_dir, "events"))


def levels_of(e: DataFrame) -> DataFrame:
    """The level series of events: missing where an event is an error."""
    level = F.when(F.col("event_type") != "error", F.floor(F.col("value") / 100) * 0.25)
    return e.select("user_id", "ts", "event_id", level.cast("double").alias("level"))


def bank():
    return F.when(F.col("user_id") % 2 == 0, "FED").otherwise("ECB")


def shifts(spark, sf_dir: str, cuts: Bounds | None = None) -> DataFrame:
    out = series.level_shifts(raw_levels(spark, sf_dir), KEYS, ORDER, cuts=cuts)
    return out.withColumn("effective_date", F.col("ts").cast("date")).withColumn("bank", bank())


def classified(spark, sf_dir: str) -> DataFrame:
    return series.classify_shifts(shifts(spark, sf_dir), RULES, area="bank")


def documents(spark, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").filter("event_type = 'signup'")
    return e.select(F.col("event_id").alias("doc_id"), "user_id", F.col("ts").cast("date").alias("announcement_date"))


# ---- series -----------------------------------------------------------------------------

SQL_LEVELS = """
raw AS (SELECT user_id, ts, event_id, CASE WHEN event_type <> 'error' THEN floor(value / 100) * 0.25::DOUBLE END AS level FROM events),
filled AS (SELECT * FROM (SELECT user_id, ts, event_id, last_value(level IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS level FROM raw) WHERE level IS NOT NULL),
lagged AS (SELECT *, lag(level) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old_level FROM filled),
shifts AS (SELECT user_id, ts, event_id, old_level, level AS new_level, CAST(round_even((level - old_level) * 100, 0) AS INTEGER) AS change_bps,
  CASE WHEN round_even((level - old_level) * 100, 0) > 0 THEN 'hike' ELSE 'cut' END AS direction, CAST(ts AS DATE) AS effective_date,
  CASE WHEN user_id % 2 = 0 THEN 'FED' ELSE 'ECB' END AS bank FROM lagged WHERE old_level IS NOT NULL AND level <> old_level)
"""
SQL_CLASSIFIED = (
    SQL_LEVELS
    + """, classified AS (
  SELECT *, CASE WHEN bank = 'FED' THEN 'FFTR_MID' WHEN effective_date >= DATE '2024-01-16' THEN 'DFR' ELSE 'MRO' END AS instrument,
    CASE WHEN bank = 'FED' AND effective_date < DATE '2024-01-03' THEN 'outside project window (before 2024-01-03)'
         WHEN bank = 'ECB' AND effective_date < DATE '2024-01-04' THEN 'outside project window (before 2024-01-04)'
         WHEN bank = 'ECB' AND effective_date IN (DATE '2024-01-16', DATE '2024-01-17') THEN 'series redefinition' END AS exclusion_reason,
    CASE WHEN bank = 'ECB' AND effective_date IN (DATE '2024-01-10', DATE '2024-01-20') THEN 'audit' END AS audit_note
  FROM shifts)
"""
)


def q_ffill(spark, sf_dir):
    return series.ffill(raw_levels(spark, sf_dir), KEYS, ORDER)


def q_shifts(spark, sf_dir):
    return shifts(spark, sf_dir).select("user_id", "event_id", "old_level", "new_level", "change_bps", "direction", "effective_date")


def q_classification(spark, sf_dir):
    return classified(spark, sf_dir).select("user_id", "event_id", "instrument", "excluded", "exclusion_reason", "audit_note")


def q_golden_summary(spark, sf_dir):
    return series.golden_summary(classified(spark, sf_dir), "bank")


def q_regime(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    regimes = ((D(1996, 1, 1), "A"), (D(1998, 6, 28), "B"), (D(2000, 10, 15), "C"))
    return o.select("o_orderkey", series.regime(F.col("o_orderdate").cast("date"), regimes).alias("instrument"))


def q_as_of(spark, sf_dir):
    asked = documents(spark, sf_dir).select("user_id", "announcement_date").distinct()
    return series.as_of(asked, shifts(spark, sf_dir), KEYS, "announcement_date", ORDER)


def q_intervals(spark, sf_dir):
    levels = raw_levels(spark, sf_dir)
    cuts = bounds(levels, KEYS, ORDER)
    return series.validity_intervals(shifts(spark, sf_dir, cuts), KEYS, ORDER, cuts=cuts).select("user_id", "event_id", "new_level", F.col("effective_date").alias("valid_from"), "valid_to")


# ---- temporal ---------------------------------------------------------------------------


def candidates(spark, sf_dir):
    docs = documents(spark, sf_dir)
    days = F.when(F.col("user_id") % 2 == 0, 5).otherwise(10)
    s = shifts(spark, sf_dir).select("user_id", "event_id", "ts", "effective_date", "change_bps")
    return temporal.window_candidates(docs, s, KEYS, days, 10)


def q_window(spark, sf_dir):
    return candidates(spark, sf_dir).select("doc_id", "user_id", "announcement_date", "event_id", "effective_date")


def owned(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return temporal.owned(candidates(spark, sf_dir), docs, KEYS, docs=docs)


def q_ownership(spark, sf_dir):
    """The first owned event of each document."""
    first = F.min_by(F.struct("event_id", "effective_date", "change_bps"), F.struct("ts", "event_id")).alias("e")
    return owned(spark, sf_dir).filter("owned").groupBy("doc_id").agg(first).select("doc_id", "e.*")


def q_naive_vs_owned(spark, sf_dir):
    per = owned(spark, sf_dir).groupBy("user_id", "announcement_date").agg(F.bool_or("owned").alias("o"))
    docs = documents(spark, sf_dir).select("user_id", "announcement_date").distinct()
    both = docs.join(per, ["user_id", "announcement_date"], "left")
    return both.agg(F.count_if("o").alias("n_owned"), F.count_if(~F.col("o")).alias("n_inverted"), F.count_if(F.col("o").isNull()).alias("n_none"))


SQL_DOCS = "docs AS (SELECT event_id AS doc_id, user_id, CAST(ts AS DATE) AS announcement_date FROM events WHERE event_type = 'signup')"
SQL_WINDOW = """cand AS (SELECT d.doc_id, d.user_id, d.announcement_date, s.event_id, s.ts, s.effective_date, s.change_bps FROM docs d JOIN shifts s ON s.user_id = d.user_id
  AND s.effective_date BETWEEN d.announcement_date AND d.announcement_date + CASE WHEN d.user_id % 2 = 0 THEN 5 ELSE 10 END)"""
SQL_OWNED = """owned AS (SELECT c.*, NOT EXISTS (SELECT 1 FROM docs x WHERE x.user_id = c.user_id AND x.announcement_date > c.announcement_date AND x.announcement_date <= c.effective_date) AS owned FROM cand c)"""

# ---- grading ----------------------------------------------------------------------------


def artifacts(spark, sf_dir) -> DataFrame:
    """Artifact rows of three models, by arithmetic on ids."""
    return artifacts_of(read(spark, sf_dir, "events"))


def artifacts_of(e: DataFrame) -> DataFrame:
    """What three models extracted from the documents (signup events), by arithmetic on ids."""
    e = e.filter("event_type = 'signup'")
    m = F.explode(F.array(*[F.lit(k) for k in range(len(MODELS))])).alias("m")
    r = e.select("event_id", "user_id", F.col("ts").cast("date").alias("d"), m)
    x = F.col("event_id") * 7 + F.col("m") * 13
    nul = lambda c, n: F.when(x % n != 0, c)
    actions = F.array(*[F.lit(a) for a in ("hike", "cut", "hold", "cut", "hold", "no_policy_decision")])
    rate = (F.floor(x / 3) % 5) * 0.25
    record = F.struct(
        bank().alias("bank"),
        nul(F.date_add("d", (x % 9 == 0).cast("int")), 11).cast("string").alias("decision_date"),
        nul(F.date_add("d", (x % 4).cast("int")), 3).cast("string").alias("effective_date"),
        F.element_at(actions, (x % 6 + 1).cast("int")).alias("action"),
        nul(((x % 7) - 3) * 25, 5).cast("int").alias("change_bps"),
        nul(rate - 0.125, 13).alias("target_range_lower_pct"),
        (rate + 0.125).alias("target_range_upper_pct"),
        nul(rate, 17).alias("dfr_pct"),
        nul(rate + 0.25, 19).alias("mro_pct"),
    )
    ok = x % 23 != 0
    return r.select(
        F.col("event_id").cast("string").alias("doc_id"), bank().alias("bank"), F.col("user_id"), F.col("d").alias("announcement_date"),
        F.concat(F.lit("m"), F.col("m").cast("string")).alias("model_key"), F.lit("v1").alias("prompt_version"), ok.alias("ok"), F.when(ok, record).alias("record"),
        F.when(F.col("event_id") % 10 == 0, "minutes").when(F.col("event_id") % 10 == 1, "non_decision").otherwise("statement").alias("doc_type"),
        (x % 1000 + 500).cast("int").alias("input_tokens"), (x % 90 + 10).cast("int").alias("output_tokens"), ((x % 1000 + 500) * 1e-06).alias("cost_usd"),
    )


def graded(spark, sf_dir) -> DataFrame:
    """Graded rows: each document against the series and the calendar of its own entity."""
    rows = artifacts(spark, sf_dir)
    s = classified(spark, sf_dir).withColumn("ref_area", F.col("bank"))
    calendar = rows.select("bank", "user_id", "announcement_date").filter(F.dayofmonth("announcement_date") % 3 != 0)
    return grading.grade(rows, s, calendar, RULES, ("effective_date", "ts", "event_id"), ("user_id",), empty_series=True)


def q_grade(spark, sf_dir):
    return graded(spark, sf_dir).drop("prompt_version")


def q_status(spark, sf_dir):
    return graded(spark, sf_dir).groupBy("model_key", "bank", "status", "expected_kind").agg(F.count(F.lit(1)).alias("n"))


def q_traps(spark, sf_dir):
    return graded(spark, sf_dir).filter("expected_kind = 'trap'").select("doc_id", "model_key", "status", "action_correct", "fabricated_decision")


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def q_scorecard(spark, sf_dir):
    return rounded(scorecard.scorecard(graded(spark, sf_dir), ("model_key", "bank")))


def q_summary(spark, sf_dir):
    """Nested scorecards with cost and tokens, flattened where SQL can say the same."""
    cards = scorecard.summarize(graded(spark, sf_dir).withColumn("prompt_version", F.lit("v1")), artifacts(spark, sf_dir))
    three = [F.col(f"{f}.{w}").alias(f"{f}_{w}") for f in ("change_bps", "level", "effective_date", "decision_date") for w in ("n", "correct")]
    return cards.select("model_key", "prompt_version", "documents", "events", F.col("action_accuracy.rate").alias("action_rate"), F.col("action_accuracy.n").alias("action_n"), F.col("traps.false_positive_rate.rate").alias("trap_fp_rate"), *three, "cost_usd", "input_tokens", "output_tokens")


def q_scorecard_sets(spark, sf_dir):
    g = graded(spark, sf_dir).withColumn("era", F.when(F.col("announcement_date") < F.lit(D(2024, 1, 16)), "early").otherwise("late"))
    cols = ["model_key", "bank", "era"]
    out = scorecard.scorecard(g, tuple(cols), [["model_key"], ["model_key", "bank"], ["model_key", "era"]])
    return rounded(out.select(*cols, "documents", "graded", "events", "holds", "action_correct", "hallucinated", "action_rate"))


def q_mcnemar(spark, sf_dir):
    g = graded(spark, sf_dir).filter("status = 'graded' AND coalesce(expected_kind, '') <> 'trap'")
    return rounded(scorecard.pairwise(g))


def q_league(spark, sf_dir):
    cards = scorecard.scorecard(graded(spark, sf_dir), ("model_key",))
    ranked = scorecard.ranking(cards).select("model_key", "graded", "documents", "action_rate")
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.coalesce("action_rate", F.lit(0.0)).desc(), "model_key"))
    return rounded(ranked.withColumn("place", place))


def q_gate(spark, sf_dir):
    """Late against early, both from one grading."""
    g = graded(spark, sf_dir).withColumn("late", F.col("announcement_date") >= F.lit(D(2024, 1, 16)))
    cards = scorecard.scorecard(g, ("model_key", "late"))
    return rounded(scorecard.period_gate(cards, F.col("late"), ["model_key"], ["action_rate", "hallucination_rate"], 0.02))


SQL_ART = """art AS (
  SELECT CAST(event_id AS VARCHAR) AS doc_id, event_id, user_id, CASE WHEN user_id % 2 = 0 THEN 'FED' ELSE 'ECB' END AS bank, CAST(ts AS DATE) AS d, 'm' || m AS model_key, event_id * 7 + m * 13 AS x,
    CASE WHEN event_id % 10 IN (0, 1) THEN true ELSE false END AS trap
  FROM events, (VALUES (0), (1), (2)) v(m) WHERE event_type = 'signup'
), rec AS (
  SELECT *, x % 23 <> 0 AS ok, ['hike', 'cut', 'hold', 'cut', 'hold', 'no_policy_decision'][x % 6 + 1] AS action,
    CASE WHEN x % 5 <> 0 THEN CAST((x % 7 - 3) * 25 AS INTEGER) END AS bps, (floor(x / 3) % 5) * 0.25::DOUBLE AS rate,
    CASE WHEN x % 3 <> 0 THEN d + CAST(x % 4 AS INTEGER) END AS eff, CASE WHEN x % 11 <> 0 THEN d + CASE WHEN x % 9 = 0 THEN 1 ELSE 0 END END AS dec FROM art
)"""
#: Announcements of which every third day's are unknown, and prevailing levels from shifts alone.
SQL_CALENDAR = "cal AS (SELECT DISTINCT user_id, d FROM art WHERE day(d) % 3 <> 0)"
SQL_PREVAILING = """fst AS (SELECT user_id, arg_min(old_level, (effective_date, ts, event_id)) AS old_level FROM shifts GROUP BY user_id),
lst AS (SELECT user_id, effective_date, arg_max(new_level, (ts, event_id)) AS new_level FROM shifts GROUP BY user_id, effective_date),
prev AS (SELECT y.user_id, y.d, COALESCE(l.new_level, f.old_level) AS level FROM days y ASOF LEFT JOIN lst l ON y.user_id = l.user_id AND y.d >= l.effective_date LEFT JOIN fst f ON f.user_id = y.user_id)"""


def sql_graded(calendar: str = SQL_CALENDAR, prevailing: str = SQL_PREVAILING) -> str:
    return (
        SQL_CLASSIFIED
        + ","
        + SQL_ART
        + f""", {calendar},
days AS (SELECT DISTINCT user_id, bank, d FROM art),
win AS (
  SELECT y.d, s.*, NOT EXISTS (SELECT 1 FROM cal x WHERE x.user_id = y.user_id AND x.d > y.d AND x.d <= s.effective_date) AS own
  FROM days y JOIN classified s ON s.user_id = y.user_id AND s.effective_date BETWEEN y.d AND y.d + CASE WHEN y.bank = 'FED' THEN 5 ELSE 10 END
), ev AS (
  SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, d ORDER BY effective_date, ts, event_id) AS rn FROM win WHERE own AND exclusion_reason IS NULL) WHERE rn = 1
), exc AS (SELECT DISTINCT user_id, d FROM win WHERE exclusion_reason IS NOT NULL),
{prevailing},
j AS (
  SELECT r.*, e.effective_date, e.new_level, e.change_bps, e.direction, e.instrument, e.bank IS NOT NULL AS has, x.user_id IS NOT NULL AS redef, p.level AS prevailing,
    (r.bank = 'ECB' AND r.d IN (DATE '2024-01-07', DATE '2024-01-12')) AS corridor, (r.bank = 'FED' AND r.d IN (DATE '2024-01-08', DATE '2024-01-22')) AS nobps,
    CASE WHEN r.bank = 'FED' THEN 'FFTR_MID' WHEN r.d >= DATE '2024-01-16' THEN 'DFR' ELSE 'MRO' END AS holdinst
  FROM rec r LEFT JOIN ev e ON e.user_id = r.user_id AND e.d = r.d LEFT JOIN exc x ON x.user_id = r.user_id AND x.d = r.d LEFT JOIN prev p ON p.user_id = r.user_id AND p.d = r.d
), k AS (
  SELECT *, CASE WHEN NOT ok THEN 'extraction_failed' WHEN trap THEN 'graded' WHEN redef AND NOT has THEN 'ungradeable_redefinition_window' WHEN corridor THEN 'ungradeable_corridor_only' ELSE 'graded' END AS status FROM j
), q AS (
  SELECT *, CASE WHEN trap THEN 'trap' WHEN status <> 'graded' THEN NULL WHEN has THEN 'change' ELSE 'hold' END AS kind,
    CASE WHEN has THEN instrument ELSE holdinst END AS inst, CASE WHEN has THEN new_level ELSE prevailing END AS want FROM k
), lv AS (
  SELECT *, CASE inst WHEN 'FFTR_MID' THEN (CASE WHEN x % 13 <> 0 THEN (rate - 0.125::DOUBLE + rate + 0.125::DOUBLE) / 2 END) WHEN 'DFR' THEN (CASE WHEN x % 17 <> 0 THEN rate END) ELSE (CASE WHEN x % 19 <> 0 THEN rate + 0.25::DOUBLE END) END AS got FROM q
), graded AS (
  SELECT doc_id, bank, d AS announcement_date, model_key, status, kind AS expected_kind,
    CASE WHEN status <> 'graded' THEN NULL WHEN kind = 'trap' THEN action = 'no_policy_decision' WHEN kind = 'change' THEN action = direction ELSE action = 'hold' END AS action_correct,
    CASE WHEN status <> 'graded' THEN NULL WHEN kind = 'trap' THEN action <> 'no_policy_decision' WHEN kind = 'hold' THEN action IN ('hike', 'cut') END AS fabricated_decision,
    CASE WHEN kind = 'change' THEN action IN ('hike', 'cut') AND action <> direction END AS wrong_direction,
    CASE WHEN kind = 'change' AND NOT nobps THEN CASE WHEN bps IS NULL THEN 'abstained' WHEN bps = change_bps THEN 'correct' ELSE 'wrong' END END AS change_bps,
    CASE WHEN kind IN ('change', 'hold') THEN CASE WHEN got IS NULL THEN 'abstained' WHEN abs(got - want) < 0.005::DOUBLE THEN 'correct' ELSE 'wrong' END END AS level,
    CASE WHEN kind = 'change' THEN CASE WHEN eff IS NULL THEN 'abstained' WHEN eff = effective_date THEN 'correct' ELSE 'wrong' END END AS effective_date,
    CASE WHEN kind IN ('change', 'hold') THEN CASE WHEN dec IS NULL THEN 'abstained' WHEN dec = d THEN 'correct' ELSE 'wrong' END END AS decision_date
  FROM lv
)"""
    )


SQL_GRADED = sql_graded()
_HALL = "(COALESCE(fabricated_decision, false) OR COALESCE(wrong_direction, false) OR COALESCE(change_bps = 'wrong', false) OR COALESCE(level = 'wrong', false))"
_C = "COALESCE(expected_kind, '') <> 'trap'"
_G = f"{_C} AND status = 'graded'"


def _n(cond: str, name: str) -> str:
    return f"COUNT(*) FILTER (WHERE {cond}) AS {name}"


_COUNTS = ", ".join(
    [
        _n(_C, "documents"), _n(_G, "graded"), _n(f"{_C} AND status = 'extraction_failed'", "extraction_failed"), _n(f"{_C} AND status LIKE 'ungradeable%'", "ungradeable"),
        _n(f"{_G} AND expected_kind = 'change'", "events"), _n(f"{_G} AND expected_kind = 'hold'", "holds"), _n(f"{_G} AND action_correct", "action_correct"), _n(f"{_G} AND {_HALL}", "hallucinated"),
        _n(f"{_G} AND expected_kind = 'hold' AND fabricated_decision", "fabricated"), _n("expected_kind = 'trap'", "trap_documents"), _n("expected_kind = 'trap' AND status = 'graded'", "trap_graded"),
        _n("expected_kind = 'trap' AND status = 'extraction_failed'", "trap_failed"), _n("expected_kind = 'trap' AND fabricated_decision", "trap_fabricated"),
    ]
    + [
        _n(f"{cond} AND {f} {test}", f"{f}_{name}")
        for f, cond in (("change_bps", f"{_G} AND expected_kind = 'change'"), ("level", _G), ("effective_date", f"{_G} AND expected_kind = 'change'"), ("decision_date", _G))
        for name, test in (("n", "IS NOT NULL"), ("correct", "= 'correct'"), ("wrong", "= 'wrong'"), ("abstained", "= 'abstained'"))
    ]
)


def sql_wilson(k: str, n: str, sign: str) -> str:
    z = "1.959964::DOUBLE"
    centre = f"({k} + {z} * {z} / 2) / ({n} + {z} * {z})"
    half = f"{z} / ({n} + {z} * {z}) * sqrt({k} * ({n} - {k})::DOUBLE / NULLIF({n}, 0) + {z} * {z} / 4)"
    clamp = ("greatest", "0.0") if sign == "-" else ("least", "1.0")
    return f"CASE WHEN {n} > 0 THEN round({clamp[0]}({centre} {sign} {half}, {clamp[1]}::DOUBLE), 9) END"


_RATES = ", ".join(
    f"round({k}::DOUBLE / NULLIF({n}, 0), 9) AS {name}_rate, {sql_wilson(k, n, '-')} AS {name}_lo, {sql_wilson(k, n, '+')} AS {name}_hi"
    for name, k, n in (("action", "action_correct", "graded"), ("hallucination", "hallucinated", "graded"), ("fabricated", "fabricated", "holds"), ("trap_fp", "trap_fabricated", "trap_documents"))
)
SQL_MCNEMAR_P = """CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(b + c + 1.0::DOUBLE) - lgamma(i + 1.0::DOUBLE) - lgamma(b + c - i + 1.0::DOUBLE) - (b + c) * ln(2.0::DOUBLE))) FROM (SELECT unnest(generate_series(0, least(b, c))) AS i))) END"""

# ---- statistics on documents and labels ---------------------------------------------------


def labelled(spark, sf_dir) -> DataFrame:
    d, lab = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return d.select("doc_id", "lang", "source", "n_chars").join(lab, "doc_id")


def q_wilson(spark, sf_dir):
    g = labelled(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").cast("long").alias("k"))
    lo, hi = wilson(F.col("k"), F.col("n"))
    return rounded(g.select("lang", "n", "k", (F.col("k") / F.col("n")).alias("rate"), lo.alias("lo"), hi.alias("hi")))


def q_three_way(spark, sf_dir):
    from assayer.functions.stats import compare, three_way

    g = labelled(spark, sf_dir).withColumn("grade", compare(F.when(F.col("n_chars") % 5 != 0, F.col("n_chars") % 2), F.col("quality")))
    n, c, w, a = three_way(F.col("grade"), F.col("toxic") == 0)
    out = g.groupBy("source").agg(n.alias("n"), c.alias("correct"), w.alias("wrong"), a.alias("abstained"))
    return rounded(out.withColumn("correct_rate", F.col("correct") / F.nullif(F.col("n"), F.lit(0))))


def q_trap_fp(spark, sf_dir):
    """False positives over all traps, those that failed included."""
    failed = F.col("n_chars") % 7 == 0
    none = F.lit(None).cast("string")
    g = labelled(spark, sf_dir).filter("lang <> 'en'").select(
        "lang", F.when(failed, "extraction_failed").otherwise("graded").alias("status"), F.lit("trap").alias("expected_kind"), F.lit(None).cast("boolean").alias("action_correct"), F.lit(None).cast("boolean").alias("wrong_direction"),
        F.when(~failed, F.col("toxic") == 1).alias("fabricated_decision"), *[none.alias(c) for c in ("change_bps", "level", "effective_date", "decision_date")],
    )
    return rounded(scorecard.scorecard(g, ("lang",)).select("lang", "trap_documents", "trap_graded", "trap_failed", "trap_fabricated", "trap_fp_rate", "trap_fp_lo", "trap_fp_hi"))


def q_mcnemar_docs(spark, sf_dir):
    d = labelled(spark, sf_dir)
    m = F.explode(F.array(*[F.struct(F.lit(k).alias("model_key"), ((F.col("n_chars") + F.col("doc_id") * i) % (i + 3) != F.col("quality")).alias("c")) for i, k in enumerate(MODELS)])).alias("m")
    return rounded(scorecard.pairwise(d.select("doc_id", m).select("doc_id", "m.*"), correct="c"))


def q_p_values(spark, sf_dir):
    """Exact p over a grid of discordant counts, beyond where 2^-n underflows."""
    o = read(spark, sf_dir, "orders")
    g = o.select((F.col("o_orderkey") % 41).alias("b"), (F.col("o_orderkey") * 3 % 1301).alias("c")).distinct()
    return rounded(g.withColumn("p_value", mcnemar_p(F.col("b"), F.col("c"))), 8)


_LAB = "lab AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"

QUERIES = {
    "ffill_levels": q_ffill, "level_shifts": q_shifts, "shift_classification": q_classification, "golden_summary": q_golden_summary, "regime_lookup": q_regime, "as_of_level": q_as_of,
    "validity_intervals": q_intervals, "window_candidates": q_window, "event_ownership": q_ownership, "naive_vs_owned": q_naive_vs_owned, "grade_rows": q_grade, "gradeability_status": q_status,
    "trap_grading": q_traps, "scorecard": q_scorecard, "scorecard_summary": q_summary, "scorecard_grouping_sets": q_scorecard_sets, "mcnemar_models": q_mcnemar, "league_ranking": q_league, "regression_gate": q_gate,
    "wilson_by_lang": q_wilson, "three_way_rates": q_three_way, "trap_false_positive": q_trap_fp, "mcnemar_pairs": q_mcnemar_docs, "mcnemar_p_values": q_p_values,
}

ORACLES = {
    "ffill_levels": f"WITH {SQL_LEVELS} SELECT user_id, ts, event_id, level FROM filled",
    "level_shifts": f"WITH {SQL_LEVELS} SELECT user_id, event_id, old_level, new_level, change_bps, direction, effective_date FROM shifts",
    "shift_classification": f"WITH {SQL_CLASSIFIED} SELECT user_id, event_id, instrument, exclusion_reason IS NOT NULL AS excluded, exclusion_reason, audit_note FROM classified",
    "golden_summary": f"WITH {SQL_CLASSIFIED} SELECT bank, count(*) FILTER (WHERE exclusion_reason IS NULL) AS n_events, count(exclusion_reason) AS n_excluded, min(CASE WHEN exclusion_reason IS NULL THEN effective_date END) AS first_date, max(CASE WHEN exclusion_reason IS NULL THEN effective_date END) AS last_date FROM classified GROUP BY bank",
    "regime_lookup": "SELECT o.o_orderkey, COALESCE(r.name, 'A') AS instrument FROM orders o ASOF LEFT JOIN (VALUES (DATE '1996-01-01', 'A'), (DATE '1998-06-28', 'B'), (DATE '2000-10-15', 'C')) r(start, name) ON CAST(o.o_orderdate AS DATE) >= r.start",
    "as_of_level": f"""WITH {SQL_LEVELS}, {SQL_DOCS}, q AS (SELECT DISTINCT user_id, announcement_date FROM docs),
        l AS (SELECT user_id, effective_date, arg_max(new_level, (ts, event_id)) AS new_level FROM shifts GROUP BY ALL), f AS (SELECT user_id, arg_min(old_level, (ts, event_id)) AS old_level FROM shifts GROUP BY user_id)
        SELECT q.user_id, q.announcement_date, COALESCE(l.new_level, f.old_level) AS prevailing_level FROM q ASOF LEFT JOIN l ON l.user_id = q.user_id AND q.announcement_date >= l.effective_date LEFT JOIN f ON f.user_id = q.user_id""",
    "validity_intervals": f"WITH {SQL_LEVELS} SELECT user_id, event_id, new_level, effective_date AS valid_from, lead(effective_date) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM shifts",
    "window_candidates": f"WITH {SQL_LEVELS}, {SQL_DOCS}, {SQL_WINDOW} SELECT doc_id, user_id, announcement_date, event_id, effective_date FROM cand",
    "event_ownership": f"WITH {SQL_LEVELS}, {SQL_DOCS}, {SQL_WINDOW}, {SQL_OWNED} SELECT doc_id, event_id, effective_date, change_bps FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY ts, event_id) AS rn FROM owned WHERE owned) WHERE rn = 1",
    "naive_vs_owned": f"WITH {SQL_LEVELS}, {SQL_DOCS}, {SQL_WINDOW}, {SQL_OWNED}, p AS (SELECT user_id, announcement_date, bool_or(owned) AS o FROM owned GROUP BY ALL) SELECT count(*) FILTER (WHERE o) AS n_owned, count(*) FILTER (WHERE NOT o) AS n_inverted, count(*) FILTER (WHERE o IS NULL) AS n_none FROM (SELECT DISTINCT user_id, announcement_date FROM docs) q LEFT JOIN p USING (user_id, announcement_date)",
    "grade_rows": f"WITH {SQL_GRADED} SELECT * FROM graded",
    "gradeability_status": f"WITH {SQL_GRADED} SELECT model_key, bank, status, expected_kind, count(*) AS n FROM graded GROUP BY ALL",
    "trap_grading": f"WITH {SQL_GRADED} SELECT doc_id, model_key, status, action_correct, fabricated_decision FROM graded WHERE expected_kind = 'trap'",
    "scorecard": f"WITH {SQL_GRADED}, c AS (SELECT model_key, bank, {_COUNTS} FROM graded GROUP BY model_key, bank) SELECT *, {_RATES} FROM c",
    "scorecard_summary": f"""WITH {SQL_GRADED}, c AS (SELECT model_key, {_COUNTS} FROM graded GROUP BY model_key),
        spent AS (SELECT model_key, round(sum((x % 1000 + 500) * 0.000001::DOUBLE), 4) AS cost_usd, CAST(sum(x % 1000 + 500) AS BIGINT) AS input_tokens, CAST(sum(x % 90 + 10) AS BIGINT) AS output_tokens FROM art GROUP BY model_key)
        SELECT model_key, 'v1' AS prompt_version, documents, events, round(action_correct::DOUBLE / NULLIF(graded, 0), 4) AS action_rate, graded AS action_n, round(trap_fabricated::DOUBLE / NULLIF(trap_documents, 0), 4) AS trap_fp_rate,
          {", ".join(f"{f}_n, round({f}_correct::DOUBLE / NULLIF({f}_n, 0), 4) AS {f}_correct" for f in ("change_bps", "level", "effective_date", "decision_date"))}, cost_usd, input_tokens, output_tokens FROM c JOIN spent USING (model_key)""",
    "scorecard_grouping_sets": f"WITH {SQL_GRADED}, g AS (SELECT *, CASE WHEN announcement_date < DATE '2024-01-16' THEN 'early' ELSE 'late' END AS era FROM graded), c AS (SELECT model_key, bank, era, {_COUNTS} FROM g GROUP BY GROUPING SETS ((model_key), (model_key, bank), (model_key, era))) SELECT model_key, bank, era, documents, graded, events, holds, action_correct, hallucinated, round(action_correct::DOUBLE / NULLIF(graded, 0), 9) AS action_rate FROM c",
    "mcnemar_models": f"WITH {SQL_GRADED}, h AS (SELECT doc_id, model_key, COALESCE(action_correct, false) AS ok FROM graded WHERE {_G}), n AS (SELECT x.model_key AS model_a, y.model_key AS model_b, count(*) AS n_paired, count(*) FILTER (WHERE x.ok AND NOT y.ok) AS b, count(*) FILTER (WHERE NOT x.ok AND y.ok) AS c FROM h x JOIN h y ON x.doc_id = y.doc_id AND x.model_key < y.model_key GROUP BY ALL) SELECT model_a, model_b, n_paired, b AS only_a_correct, c AS only_b_correct, round({SQL_MCNEMAR_P}, 9) AS p_value FROM n",
    "league_ranking": f"WITH {SQL_GRADED}, c AS (SELECT model_key, {_COUNTS} FROM graded GROUP BY model_key) SELECT model_key, graded, documents, round(action_correct::DOUBLE / NULLIF(graded, 0), 9) AS action_rate, CAST(row_number() OVER (ORDER BY COALESCE(action_correct::DOUBLE / NULLIF(graded, 0), 0) DESC, model_key) AS INTEGER) AS place FROM c",
    "regression_gate": f"""WITH {SQL_GRADED}, c AS (SELECT model_key, announcement_date >= DATE '2024-01-16' AS late, {_COUNTS} FROM graded GROUP BY ALL),
        r AS (SELECT model_key, late, action_correct::DOUBLE / NULLIF(graded, 0) AS action_rate, hallucinated::DOUBLE / NULLIF(graded, 0) AS hallucination_rate FROM c),
        u AS (SELECT model_key, late, 'action_rate' AS metric, action_rate AS v FROM r UNION ALL SELECT model_key, late, 'hallucination_rate', hallucination_rate FROM r)
        SELECT x.model_key, x.metric, round(x.v, 9) AS current, round(y.v, 9) AS baseline, round(x.v - y.v, 9) AS delta, COALESCE(x.v - y.v < -0.02, false) AS degraded FROM u x JOIN u y ON x.model_key = y.model_key AND x.metric = y.metric WHERE x.late AND NOT y.late""",
    "wilson_by_lang": f"WITH {_LAB}, g AS (SELECT lang, count(*) AS n, CAST(sum(quality) AS BIGINT) AS k FROM lab GROUP BY lang) SELECT lang, n, k, round(k::DOUBLE / n, 9) AS rate, {sql_wilson('k', 'n', '-')} AS lo, {sql_wilson('k', 'n', '+')} AS hi FROM g",
    "three_way_rates": f"WITH {_LAB}, g AS (SELECT *, CASE WHEN n_chars % 5 = 0 THEN 'abstained' WHEN n_chars % 2 = quality THEN 'correct' ELSE 'wrong' END AS grade FROM lab) SELECT source, count(*) FILTER (WHERE toxic = 0) AS n, count(*) FILTER (WHERE toxic = 0 AND grade = 'correct') AS correct, count(*) FILTER (WHERE toxic = 0 AND grade = 'wrong') AS wrong, count(*) FILTER (WHERE toxic = 0 AND grade = 'abstained') AS abstained, round(count(*) FILTER (WHERE toxic = 0 AND grade = 'correct')::DOUBLE / NULLIF(count(*) FILTER (WHERE toxic = 0), 0), 9) AS correct_rate FROM g GROUP BY source",
    "trap_false_positive": f"WITH {_LAB}, g AS (SELECT lang, count(*) AS trap_documents, count(*) FILTER (WHERE n_chars % 7 <> 0) AS trap_graded, count(*) FILTER (WHERE n_chars % 7 = 0) AS trap_failed, count(*) FILTER (WHERE toxic = 1 AND n_chars % 7 <> 0) AS trap_fabricated FROM lab WHERE lang <> 'en' GROUP BY lang) SELECT *, round(trap_fabricated::DOUBLE / trap_documents, 9) AS trap_fp_rate, {sql_wilson('trap_fabricated', 'trap_documents', '-')} AS trap_fp_lo, {sql_wilson('trap_fabricated', 'trap_documents', '+')} AS trap_fp_hi FROM g",
    "mcnemar_pairs": f"WITH {_LAB}, h AS (SELECT doc_id, 'm' || i AS model_key, (n_chars + doc_id * i) % (i + 3) <> quality AS ok FROM lab, (VALUES (0), (1), (2)) v(i)), n AS (SELECT x.model_key AS model_a, y.model_key AS model_b, count(*) AS n_paired, count(*) FILTER (WHERE x.ok AND NOT y.ok) AS b, count(*) FILTER (WHERE NOT x.ok AND y.ok) AS c FROM h x JOIN h y ON x.doc_id = y.doc_id AND x.model_key < y.model_key GROUP BY ALL) SELECT model_a, model_b, n_paired, b AS only_a_correct, c AS only_b_correct, round({SQL_MCNEMAR_P}, 9) AS p_value FROM n",
    "mcnemar_p_values": f"WITH n AS (SELECT DISTINCT o_orderkey % 41 AS b, o_orderkey * 3 % 1301 AS c FROM orders) SELECT b, c, round({SQL_MCNEMAR_P}, 8) AS p_value FROM n",
}
