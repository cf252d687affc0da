"""The jobs as queries: each runs twice into one new folder and returns its whole output after that."""

from __future__ import annotations

from pyspark.sql import DataFrame

from assayer.plans.audit import sql_graded
from assayer.plans.corpus import sql_normalize
from assayer.sources.files import new_folder
from jobs import daily_scorecards, prepare_inputs
from jobs.common import own_settings


def q_prepare_inputs(spark, sf_dir) -> DataFrame:
    to, config = new_folder(spark, "job1"), own_settings("prepare_inputs")
    for _ in range(2):
        # a pattern, as a stream's path may not be a file
        out = prepare_inputs.run(spark, f"{sf_dir}/documents.parque[t]", f"{to}/inputs", f"{to}/checkpoint", config)
    return out.select(*prepare_inputs.COLUMNS)


def q_daily_scorecards(spark, sf_dir) -> DataFrame:
    """Graded rows, each with the stored counts of its day, model and bank."""
    to, config = new_folder(spark, "job2"), own_settings("daily_scorecards")
    for _ in range(2):
        rows = daily_scorecards.run(spark, f"{sf_dir}/events.parquet", to, config)
    day = ("model_key", "bank", "announcement_date")
    told = ("documents", "graded", "events", "holds", "action_correct", "hallucinated", "trap_documents")
    counts = spark.read.parquet(f"{to}/counts").selectExpr(*day, *[f"{c} AS day_{c}" for c in told])
    return rows.drop("prompt_version").join(counts, list(day))


_CLEAN = sql_normalize("coalesce(text, '')")
_PRICES = ", ".join(f"('{k}', {m['input_usd_per_mtok']}::DOUBLE, {m['output_usd_per_mtok']}::DOUBLE)" for k, m in own_settings("prepare_inputs")["models"].items())

QUERIES = {"job1_prepare_inputs": q_prepare_inputs, "job2_daily_scorecards": q_daily_scorecards}

ORACLES = {
    "job1_prepare_inputs": f"""WITH d AS (
          SELECT doc_id, source, CASE WHEN lang = 'en' THEN 'FED' ELSE 'ECB' END AS bank, CASE WHEN source IN ('src0', 'src3', 'src5') THEN 'minutes' ELSE 'statement' END AS doc_type, {_CLEAN} AS clean
          FROM documents QUALIFY doc_id IS NULL OR ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY text NULLS FIRST, lang, source) = 1
        ), r AS (SELECT *, CASE WHEN doc_id IS NULL THEN 'no id' WHEN clean = '' THEN 'no text' END AS reason FROM d),
        i AS (
          SELECT *, CASE WHEN reason IS NULL THEN 'Source: ' || CASE bank WHEN 'FED' THEN 'Federal Reserve (FOMC)' ELSE 'European Central Bank' END || CASE doc_type WHEN 'minutes' THEN ' publication' ELSE ' press release' END
            || chr(10) || chr(10) || '<document>' || chr(10) || clean || chr(10) || '</document>' END AS model_input FROM r
        ), t AS (SELECT *, (4800 + length(model_input)) // 4 AS input_tokens, row_number() OVER () AS row_no FROM i),
        p AS (SELECT row_no, key, round((input_tokens * inr + 300 * outr) / 1000000 * 0.5::DOUBLE, 6) AS usd FROM t, (VALUES {_PRICES}) v(key, inr, outr) QUALIFY ROW_NUMBER() OVER (PARTITION BY row_no ORDER BY usd, key) = 1)
        SELECT doc_id, source, doc_type, CASE WHEN bank = 'ECB' THEN 'ecb' WHEN doc_type = 'minutes' THEN 'fed_minutes' ELSE 'fed' END AS extractor, model_input, CAST(input_tokens AS BIGINT) AS input_tokens,
          CASE WHEN reason IS NULL THEN key END AS model_key, usd, reason, CASE WHEN reason IS NULL THEN 'ready' ELSE 'rejected' END AS status, bank FROM t JOIN p USING (row_no)""",
    "job2_daily_scorecards": "WITH "
    + sql_graded(
        "cal AS (SELECT DISTINCT user_id, d FROM art)",
        "ends AS (SELECT user_id, CAST(ts AS DATE) AS day, arg_max(level, (ts, event_id)) AS level FROM filled GROUP BY ALL),\n"
        "prev AS (SELECT y.user_id, y.d, e.level FROM days y ASOF LEFT JOIN ends e ON y.user_id = e.user_id AND y.d >= e.day)",
    )
    + """, h AS (SELECT *, coalesce(fabricated_decision, false) OR coalesce(wrong_direction, false) OR coalesce(change_bps = 'wrong', false) OR coalesce(level = 'wrong', false) AS h,
          coalesce(expected_kind, '') <> 'trap' AS doc, status = 'graded' AS g, count(*) FILTER (WHERE expected_kind = 'trap') OVER w AS day_trap_documents FROM graded WINDOW w AS (PARTITION BY model_key, bank, announcement_date))
        SELECT doc_id, bank, announcement_date, model_key, status, expected_kind, action_correct, fabricated_decision, wrong_direction, change_bps, level, effective_date, decision_date, day_trap_documents,
          count(*) FILTER (WHERE doc) OVER w AS day_documents, count(*) FILTER (WHERE doc AND g) OVER w AS day_graded, count(*) FILTER (WHERE doc AND g AND expected_kind = 'change') OVER w AS day_events,
          count(*) FILTER (WHERE doc AND g AND expected_kind = 'hold') OVER w AS day_holds, count(*) FILTER (WHERE doc AND g AND action_correct) OVER w AS day_action_correct, count(*) FILTER (WHERE doc AND g AND h) OVER w AS day_hallucinated
        FROM h WINDOW w AS (PARTITION BY model_key, bank, announcement_date)""",
}
