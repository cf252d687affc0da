"""Grading extracted records against the events of a level series.

One plan for all models: a time line of each series' days gives the next event, its owner and the
prevailing level, rows look up their day, then one ordered CASE per graded field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.functions.stats import compare
from assayer.operators.series import regime
from assayer.operators.store import missing
from assayer.rules import DEFAULT_RULES, GradingRules

GRADED_KEYS = ("doc_id", "bank", "model_key", "prompt_version", "announcement_date")
LEVELS = ("target_range_lower_pct", "target_range_upper_pct", "dfr_pct", "mro_pct")


def by_bank(bank: Column, values: dict[str, object], default=None) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(bank == k, F.lit(v)).otherwise(out)
    return out


def on_dates(bank: Column, date: Column, dates: dict[str, tuple]) -> Column:
    """Whether (bank, date) is one of the listed ones; never null for known dates."""
    out = F.lit(False)
    for k, days in dates.items():
        out = out | ((bank == k) & date.isin(*days)) if days else out
    return F.coalesce(out, F.lit(False))


def extracted_level(record: Column, instrument: Column) -> Column:
    """The level a record states for an instrument: the middle of a range, or one rate."""
    middle = (record["target_range_lower_pct"] + record["target_range_upper_pct"]) / 2
    known = F.when(instrument == "FFTR_MID", middle).when(instrument == "DFR", record["dfr_pct"]).when(instrument == "MRO", record["mro_pct"])
    unknown = instrument.isNotNull() & ~instrument.isin("FFTR_MID", "DFR", "MRO")
    return F.when(unknown, F.raise_error(F.concat(F.lit("unknown instrument "), instrument)).cast("double")).otherwise(known)


def level_grade(got: Column, want: Column, tolerance: float) -> Column:
    """Abstained if null; correct if strictly within the tolerance."""
    near = F.coalesce(F.abs(got - want) < tolerance, F.lit(False))
    return F.when(got.isNull(), "abstained").when(near, "correct").otherwise("wrong")


def resolve_doc_types(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Adds doc_type from a (doc_id, doc_type) look-up; null if unknown."""
    return rows.join(catalog.select("doc_id", "doc_type"), "doc_id", "left")


def unknown_documents(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Distinct documents that rows name and the catalogue lacks."""
    return missing(rows, catalog, "doc_id")


def guard_unknown(rows: DataFrame, catalog: DataFrame) -> None:
    """Fail loudly if rows name documents that the catalogue lacks."""
    unknown = unknown_documents(rows, catalog)
    n = unknown.count()
    if n:
        first = [r["doc_id"] for r in unknown.orderBy("doc_id").limit(5).collect()]
        raise ValueError(f"{n} documents are in no catalogue, first {first}")


def grade(rows: DataFrame, shifts: DataFrame, calendar: DataFrame, rules: GradingRules = DEFAULT_RULES, order: tuple[str, ...] = ("effective_date",), series: tuple[str, ...] = (), empty_series: bool = False, firsts: bool = False) -> DataFrame:
    """Graded rows of all models.

    rows: artifact rows with ``doc_type`` and ``announcement_date`` (date or ISO text);
    shifts: classified shifts (ref_area, effective_date, old_level, new_level, change_bps,
    direction, instrument, excluded), ties in ``order``; calendar: (bank, announcement_date)
    of all announcements.  Where an area has several series, ``series`` names the columns, of all
    three tables, that tell them apart.

    A bank that the rules do not know fails, and so does a hold whose series has no shift at
    all, unless ``empty_series`` lets its level be unknown.  With ``firsts``, shifts without an old
    level are their series' first levels, which prevail from their day on but are no events.

    What a document is graded by depends on its series and day alone, and is looked up there.
    """
    keys = ["_area", *series]
    bank = F.col("bank")
    area = by_bank(bank, rules.ref_area)
    unknown = F.raise_error(F.concat(F.lit("unknown bank "), F.coalesce(bank, F.lit("null")))).cast("string")
    rows = rows.withColumn("_ann", F.col("announcement_date").cast("date")).withColumn("_area", F.coalesce(area, unknown))
    asked = rows.select(*keys, F.col("_ann").alias("_day"))
    announced = calendar.select(area.alias("_area"), *series, F.col("announcement_date").cast("date").alias("_day"))
    found = day_events(shifts.withColumnRenamed("ref_area", "_area"), asked, announced, keys, order, firsts)
    said = rows.select(*[c for c in rows.columns if c in GRADED_KEYS], *keys[:1], *[k for k in series if k not in GRADED_KEYS], "_ann", *_said(rules))
    found = found.withColumnsRenamed({k: f"_d_{k}" for k in keys})
    same = [F.col(k) == F.col(f"_d_{k}") for k in keys] + [F.col("_ann") == F.col("_day")]
    return said.join(found, same, "left").select(*[c for c in said.columns if c in GRADED_KEYS], *_graded_fields(rules, empty_series))


def day_events(shifts: DataFrame, asked: DataFrame, announced: DataFrame, keys: list[str], order: tuple[str, ...], firsts: bool = False) -> DataFrame:
    """(keys, _day) asked for, with the prevailing level, the next event and next excluded day on or after it, and the next announcement after it.

    Shifts, questions and announcements first become rows of distinct days, so a series is as long as
    its calendar, whatever the number of its rows: no document meets all shifts of its window.
    An event belongs to a document if it falls into its window and before the next announcement; as
    later ones do so only if the next one does, the next one is all that is needed.
    """
    ties = [F.col(c) for c in dict.fromkeys(("effective_date", *order))]
    event = F.col("old_level").isNotNull() if firsts else F.lit(True)
    fields = ("effective_date", "new_level", "change_bps", "direction", "instrument")
    steps = shifts.select(*keys, F.col("effective_date").cast("date").alias("_day"), F.struct(*ties).alias("_o"), "old_level", "new_level", F.struct(*fields).alias("_picked"), (event & F.col("excluded")).alias("_out"), (event & ~F.col("excluded")).alias("_in"))
    steps = steps.groupBy(*keys, "_day").agg(
        F.max_by("new_level", "_o").alias("_level"), F.min_by("old_level", "_o").alias("_old"), F.min_by("_picked", F.when(F.col("_in"), F.col("_o"))).alias("_event"), F.bool_or("_out").alias("_out"),
        F.lit(False).alias("_asked"), F.lit(False).alias("_announced"),
    )
    no = F.lit(False)
    days = asked.select(*keys, "_day", F.lit(True).alias("_asked"), no.alias("_announced")).distinct().unionByName(announced.select(*keys, "_day", no.alias("_asked"), F.lit(True).alias("_announced")).distinct())
    days = days.groupBy(*keys, "_day").agg(F.bool_or("_asked").alias("_asked"), F.bool_or("_announced").alias("_announced"))
    days = days.withColumn("_doc", F.lit(True))
    line = steps.withColumn("_doc", no).unionByName(days, allowMissingColumns=True)
    step, day = ~F.col("_doc"), F.col("_day")
    # a day's shifts come before its documents in both directions
    forth, back = W.partitionBy(*keys).orderBy("_day", "_doc"), W.partitionBy(*keys).orderBy(F.desc("_day"), "_doc")
    upto, before = back.rowsBetween(W.unboundedPreceding, W.currentRow), back.rowsBetween(W.unboundedPreceding, -1)
    first = F.first(F.when(step, F.struct("_old")), True).over(forth.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))["_old"]
    level = F.last(F.when(step, F.struct("_level")), True).over(forth.rowsBetween(W.unboundedPreceding, W.currentRow))["_level"]
    line = line.select(
        *keys, "_day", "_asked", F.coalesce(level, first).alias("prevailing_level"), F.last("_event", True).over(upto).alias("_event"),
        F.last(F.when(F.col("_out"), day), True).over(upto).alias("_out_day"), F.last(F.when(F.col("_announced"), day), True).over(before).alias("_next_day"),
    )
    return line.filter("_asked").drop("_asked")


def _said(rules: GradingRules) -> list[Column]:
    """What a row says by itself, before it meets its day: the code that follows the join stays small enough to be compiled."""
    bank, ann, rec = F.col("bank"), F.col("_ann"), F.col("record")
    area_instrument = F.when(by_bank(bank, rules.ref_area) == rules.regime_area, regime(ann, rules.regimes)).otherwise(rules.other_instrument)
    return [
        F.date_add(ann, by_bank(bank, rules.window_days).cast("int")).alias("_until"),
        (~F.coalesce(F.col("ok"), F.lit(False)) | rec.isNull()).alias("_failed"),
        F.coalesce(F.col("doc_type").isin(*rules.trap_doc_types), F.lit(False)).alias("_trap"),
        on_dates(bank, ann, rules.corridor_only).alias("_corridor"),
        on_dates(bank, ann, rules.range_transition).alias("_transition"),
        area_instrument.alias("_instrument"),
        rec["action"].alias("_action"),
        rec["change_bps"].alias("_bps"),
        rec["effective_date"].cast("string").alias("_effective"),
        compare(rec["decision_date"].cast("string"), ann.cast("string")).alias("_decision"),
        F.struct(*[rec[c].alias(c) for c in LEVELS]).alias("_levels"),
    ]


def _graded_fields(rules: GradingRules, empty_series: bool) -> list[Column]:
    failed, trap, action, until, nearest = (F.col(c) for c in ("_failed", "_trap", "_action", "_until", "_event"))
    day = nearest["effective_date"]
    event = F.when((day <= until) & (F.col("_next_day").isNull() | (F.col("_next_day") > day)), nearest)
    redefined = F.coalesce(F.col("_out_day") <= until, F.lit(False)) & event.isNull()
    corridor = F.col("_corridor")
    status = F.when(failed, "extraction_failed").when(trap, "graded").when(redefined, "ungradeable_redefinition_window").when(corridor, "ungradeable_corridor_only").otherwise("graded")
    graded = ~failed & (trap | ~(redefined | corridor))
    control = graded & ~trap
    change, hold = control & event.isNotNull(), control & event.isNull()
    moved = F.coalesce(action.isin("hike", "cut"), F.lit(False))
    decided = F.coalesce(action.isin("hike", "cut", "hold"), F.lit(False))
    is_ = lambda want: F.coalesce(action == want, F.lit(False))
    known = F.col("prevailing_level")
    if not empty_series:
        known = F.coalesce(known, F.raise_error(F.concat(F.lit("no shifts for "), F.col("bank"))).cast("double"))
    instrument = F.when(change, event["instrument"]).otherwise(F.col("_instrument"))
    want = F.when(change, event["new_level"]).otherwise(known)
    return [
        status.alias("status"),
        F.when(trap, "trap").when(change, "change").when(hold, "hold").alias("expected_kind"),
        F.when(graded & trap, is_("no_policy_decision")).when(change, is_(event["direction"])).when(hold, is_("hold")).alias("action_correct"),
        F.when(graded & trap, decided).when(hold, moved).alias("fabricated_decision"),
        F.when(change, moved & ~is_(event["direction"])).alias("wrong_direction"),
        F.when(change & ~F.col("_transition"), compare(F.col("_bps"), event["change_bps"])).alias("change_bps"),
        F.when(control, level_grade(extracted_level(F.col("_levels"), instrument), want, rules.level_tolerance)).alias("level"),
        F.when(change, compare(F.col("_effective"), event["effective_date"].cast("string"))).alias("effective_date"),
        F.when(control, F.col("_decision")).alias("decision_date"),
    ]
