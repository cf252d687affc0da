"""Scorecards, paired tests and rankings over graded rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.stats import mcnemar_p, rate, three_way, wilson

BY = ("model_key", "prompt_version")


def hallucinated() -> Column:
    """A value that contradicts the events: abstentions never count."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return yes(F.col("fabricated_decision")) | yes(F.col("wrong_direction")) | yes(F.col("change_bps") == "wrong") | yes(F.col("level") == "wrong")


def scorecard_counts() -> list[Column]:
    """All integer counts of a scorecard as aggregates of one pass over graded rows."""
    trap = F.coalesce(F.col("expected_kind") == "trap", F.lit(False))
    status = F.col("status")
    graded = ~trap & (status == "graded")
    event, hold = graded & (F.col("expected_kind") == "change"), graded & (F.col("expected_kind") == "hold")
    yes = lambda c: F.coalesce(c, F.lit(False))
    out = {
        "documents": ~trap,
        "graded": graded,
        "extraction_failed": ~trap & (status == "extraction_failed"),
        "ungradeable": ~trap & status.startswith("ungradeable"),
        "events": event,
        "holds": hold,
        "action_correct": graded & yes(F.col("action_correct")),
        "hallucinated": graded & hallucinated(),
        "fabricated": hold & yes(F.col("fabricated_decision")),
        "trap_documents": trap,
        "trap_graded": trap & (status == "graded"),
        "trap_failed": trap & (status == "extraction_failed"),
        "trap_fabricated": trap & yes(F.col("fabricated_decision")),
    }
    cols = [F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in out.items()]
    for name, among in (("change_bps", event), ("level", graded), ("effective_date", event), ("decision_date", graded)):
        cols += [c.alias(f"{name}_{k}") for k, c in zip(("n", "correct", "wrong", "abstained"), three_way(F.col(name), among))]
    return cols


def _grouped(df: DataFrame, by: tuple[str, ...], sets: list[list[str]] | None):
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *by) if sets else df.groupBy(*by)


def scorecard(graded: DataFrame, by: tuple[str, ...] = BY, sets: list[list[str]] | None = None) -> DataFrame:
    """Counts with the rates' Wilson intervals, per group or grouping set."""
    return with_rates(_grouped(graded, by, sets).agg(*scorecard_counts()))


def rollup(counts: DataFrame, by: tuple[str, ...] = BY, sets: list[list[str]] | None = None) -> DataFrame:
    """The same from stored counts of any finer grouping: counts add up, so nothing is graded again."""
    totals = [F.sum(c).alias(c) for c, t in counts.dtypes if c not in by and t == "bigint"]
    return with_rates(_grouped(counts, by, sets).agg(*totals))


def with_rates(out: DataFrame) -> DataFrame:
    """Adds rates and their Wilson intervals to counts."""
    for name, k, n in (("action", "action_correct", "graded"), ("hallucination", "hallucinated", "graded"), ("fabricated", "fabricated", "holds"), ("trap_fp", "trap_fabricated", "trap_documents")):
        lo, hi = wilson(F.col(k), F.col(n))
        out = out.withColumns({f"{name}_rate": F.col(k) / F.nullif(F.col(n), F.lit(0)), f"{name}_lo": lo, f"{name}_hi": hi})
    return out


def summarize(graded: DataFrame, artifacts: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """The nested scorecard of each model and prompt, with cost and tokens of all its rows."""
    c = graded.groupBy(*by).agg(*scorecard_counts())
    spend = artifacts.groupBy(*by).agg(F.round(F.sum("cost_usd"), 4).alias("cost_usd"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    three = lambda k: F.struct(
        F.col(f"{k}_n").alias("n"), *[F.round(F.col(f"{k}_{w}") / F.nullif(F.col(f"{k}_n"), F.lit(0)), 4).alias(w) for w in ("correct", "wrong", "abstained")]
    ).alias(k)
    col = F.col
    return c.join(spend, list(by), "left").select(
        *by, "documents", "graded", "extraction_failed", "ungradeable", "events", "holds",
        rate(col("action_correct"), col("graded")).alias("action_accuracy"),
        rate(col("hallucinated"), col("graded")).alias("hallucination_rate"),
        rate(col("fabricated"), col("holds")).alias("fabricated_decision_rate"),
        three("change_bps"), three("level"), three("effective_date"), three("decision_date"),
        F.struct(col("trap_documents").alias("documents"), col("trap_graded").alias("graded"), col("trap_failed").alias("extraction_failed"), rate(col("trap_fabricated"), col("trap_documents")).alias("false_positive_rate")).alias("traps"),
        "cost_usd", "input_tokens", "output_tokens",
    )


def pairwise(graded: DataFrame, key: str = "model_key", doc: str = "doc_id", correct: str = "action_correct", order: str | None = None) -> DataFrame:
    """McNemar's exact test for every pair of models, over documents that both were graded on.

    Each document's answers are gathered into one row of at most one answer per model, and
    pairs are made within that row: no self join of the graded table.  Of a model's several
    answers to a document the last by ``order`` counts, without it a correct one if there is any.
    """
    answer = F.coalesce(F.col(correct), F.lit(False))
    one = F.max_by(answer, F.struct(F.col(order), answer)) if order else F.bool_or(answer)
    rows = graded.groupBy(doc, F.col(key).alias("m")).agg(one.alias("c"))
    rows = rows.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("m", "c"))).alias("a"))
    one = rows.select(doc, "a", F.explode("a").alias("x"))
    both = one.select("x", F.explode(F.filter("a", lambda y: y["m"] > F.col("x.m"))).alias("y"))
    out = both.groupBy(F.col("x.m").alias("model_a"), F.col("y.m").alias("model_b")).agg(
        F.count(F.lit(1)).alias("n_paired"),
        F.count_if(F.col("x.c") & ~F.col("y.c")).alias("only_a_correct"),
        F.count_if(~F.col("x.c") & F.col("y.c")).alias("only_b_correct"),
    )
    return out.withColumn("p_value", mcnemar_p(F.col("only_a_correct"), F.col("only_b_correct")))


def ranking(cards: DataFrame, key: str = "model_key", value: str = "action_rate") -> DataFrame:
    """Best first, null as 0, equal ones by key."""
    return cards.orderBy(F.coalesce(value, F.lit(0.0)).desc(), key)


def regression_gate(current: DataFrame, baseline: DataFrame, keys: list[str], metrics: list[str], tolerance: float) -> DataFrame:
    """Per key and metric: current, baseline, delta, and whether it fell by more than the tolerance."""
    melt = lambda df, name: df.unpivot([F.col(k) for k in keys], [F.col(m) for m in metrics], "metric", name)
    both = melt(current, "current").join(melt(baseline, "baseline"), [*keys, "metric"])
    delta = F.col("current") - F.col("baseline")
    return both.withColumn("delta", delta).withColumn("degraded", F.coalesce(delta < -tolerance, F.lit(False)))


def period_gate(cards: DataFrame, current: Column, keys: list[str], metrics: list[str], tolerance: float) -> DataFrame:
    """The same from one table of cards, in which ``current`` tells a key's card from its baseline: both come from one pass."""
    cells = cards.withColumn("_now", current).unpivot([*[F.col(k) for k in keys], F.col("_now")], [F.col(m) for m in metrics], "metric", "_value")
    side = lambda now: F.max(F.when(now, F.col("_value")))
    both = cells.groupBy(*keys, "metric").agg(side(F.col("_now")).alias("current"), side(~F.col("_now")).alias("baseline"), F.count_distinct("_now").alias("_sides"))
    delta = F.col("current") - F.col("baseline")
    return both.filter("_sides = 2").drop("_sides").withColumn("delta", delta).withColumn("degraded", F.coalesce(delta < -tolerance, F.lit(False)))


def league_table(cards: list[dict]) -> str:
    """Markdown of collected nested scorecards, best action accuracy first."""

    def pct(cell, key="rate"):
        if not cell or cell.get(key) is None:
            return "-"
        ends = f" [{cell['ci95'][0]:.1%}, {cell['ci95'][1]:.1%}]" if key == "rate" else ""
        return f"{cell[key]:.1%}{ends}"

    head = ["model", "graded", "action acc. (95% CI)", "hallucination (95% CI)", "bps ok", "level ok", "eff.date ok", "trap FP (95% CI)", "cost"]
    rows = [head, ["---"] * len(head)]
    for c in sorted(cards, key=lambda c: c["action_accuracy"]["rate"] or 0, reverse=True):
        rows.append([
            c["model_key"], f"{c['graded']}/{c['documents']}", pct(c["action_accuracy"]), pct(c["hallucination_rate"]),
            *[pct(c[k], "correct") for k in ("change_bps", "level", "effective_date")], pct(c["traps"]["false_positive_rate"]), f"${c['cost_usd'] or 0:.2f}",
        ])
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)
