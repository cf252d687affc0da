"""Text, cost, catalogue, ledger and batch queries, re-hosted on the test tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions import cost, html, text
from assayer.functions.validate import with_record
from assayer.operators import batch, grading, store
from assayer.plans.audit import read
from assayer.serve import decisions, recent_traces
from assayer.sources.readers import batch_documents
from assayer.types import ANTHROPIC_LINE, OPENAI_LINE

REGISTRY = {
    "batch_discount": 0.5,
    "models": {
        "small": {"provider": "p1", "model_id": "s-1", "input_usd_per_mtok": 0.20, "output_usd_per_mtok": 1.25},
        "medium": {"provider": "p1", "model_id": "m-1", "input_usd_per_mtok": 0.75, "output_usd_per_mtok": 4.50},
        "other": {"provider": "p2", "model_id": "o-1", "input_usd_per_mtok": 1.00, "output_usd_per_mtok": 5.00},
    },
}
SQL_REGISTRY = "reg(key, provider, inr, outr) AS (VALUES ('small', 'p1', 0.20::DOUBLE, 1.25::DOUBLE), ('medium', 'p1', 0.75::DOUBLE, 4.50::DOUBLE), ('other', 'p2', 1.00::DOUBLE, 5.00::DOUBLE))"
SQL_BLANKS = text.BLANKS


def sql_normalize(col: str) -> str:
    return f"trim(regexp_replace(translate({col}, chr(160) || chr(8209), ' -'), '{SQL_BLANKS}', ' ', 'g'))"


def usage(spark, sf_dir) -> DataFrame:
    """Tokens of each conversation and the model that served it."""
    c = read(spark, sf_dir, "conversations")
    size = F.length("text").cast("long")
    g = c.groupBy("conv_id").agg(F.sum(F.when(F.col("role") != "assistant", size).otherwise(0)).alias("input_tokens"), F.sum(F.when(F.col("role") == "assistant", size).otherwise(0)).alias("output_tokens"))
    key = F.element_at(F.array(F.lit("small"), F.lit("medium"), F.lit("other")), (F.col("conv_id") % 3 + 1).cast("int"))
    return g.withColumn("key", key)


SQL_USAGE = "u AS (SELECT conv_id, CAST(sum(CASE WHEN role <> 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS i, CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS o, ['small', 'medium', 'other'][conv_id % 3 + 1] AS key FROM conversations GROUP BY conv_id)"

# ---- text ---------------------------------------------------------------------------------


def q_normalize(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    messy = F.concat(F.lit("   "), F.regexp_replace("text", " of ", " of‑ "), F.lit(" \n"))
    return d.select("doc_id", text.normalize(messy).alias("clean"))


def q_framed(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    bank = F.when(F.col("lang") == "en", "FED").otherwise("ECB")
    kind = F.when(F.col("doc_id") % 3 == 0, "minutes").otherwise("statement")
    return d.select("doc_id", text.framed(text.source_label(bank, kind), F.col("text")).alias("model_input"), text.extractor_name(bank, kind).alias("extractor"))


def _links(spark, sf_dir) -> DataFrame:
    """Synthetic links of every form that the classifiers know, dated by orders."""
    o = read(spark, sf_dir, "orders")
    day, k = F.date_format("o_orderdate", "yyyyMMdd"), F.col("o_orderkey")
    short = F.date_format("o_orderdate", "yyMMdd")
    year = F.date_format("o_orderdate", "yyyy")
    forms = [
        F.concat(F.lit("/newsevents/pressreleases/monetary"), day, F.lit("a.htm")),
        F.concat(F.lit("/newsevents/press/monetary/"), day, F.lit("b.htm")),
        F.concat(F.lit("/boarddocs/press/general/"), year, F.lit("/"), day, F.lit("/default.htm")),
        F.concat(F.lit("/boarddocs/press/monetary/"), year, F.lit("/"), day, F.lit("/")),
        F.concat(F.lit("/monetarypolicy/fomcminutes"), day, F.lit(".htm")),
        F.concat(F.lit("/fomc/minutes/"), day, F.lit(".htm")),
        F.concat(F.lit("/press/pr/date/"), year, F.lit("/html/ecb.mp"), short, F.lit("~4d41bd5e83.en.html")),
        F.concat(F.lit("/press/pr/date/"), year, F.lit("/html/pr"), short, F.lit("_2.en.html")),
        F.concat(F.lit("/press/pr/date/"), year, F.lit("/html/ecb.pr"), short, F.lit("_1~abc0.en.html")),
        F.concat(F.lit("/press/accounts/"), year, F.lit("/html/ecb.mg"), short, F.lit("~abc0.en.html")),
        F.concat(F.lit("/monetarypolicy/beigebook"), day, F.lit(".htm")),
    ]
    href = F.element_at(F.array(*forms), (k % len(forms)).cast("int") + 1)
    words = F.array(*[F.lit(w) for w in ("HTML", " Statement ", "Minutes", "Monetary policy  decisions", "Other news")])
    full, brief = F.date_format(F.date_add("o_orderdate", 21), "MMMM d, yyyy"), F.date_format(F.date_add("o_orderdate", 21), "MMM d, yyyy")
    context = F.when(k % 4 == 0, F.concat(F.lit("x (Released "), full, F.lit(") y"))).when(k % 4 == 1, F.concat(F.lit("(Released  "), brief, F.lit(")"))).when(k % 4 == 2, "(Released soon)").otherwise("")
    iso = F.when(k % 3 == 0, F.date_format(F.date_add("o_orderdate", 1), "yyyy-MM-dd"))
    return o.select(k.alias("o_orderkey"), href.alias("href"), F.element_at(words, (k % 5).cast("int") + 1).alias("text"), context.alias("context"), (k % 10 != 0).alias("in_title"), iso.alias("iso"))


def q_fed_links(spark, sf_dir):
    a = _links(spark, sf_dir)
    t, h = F.col("text"), F.col("href")
    ref = F.coalesce(text.fed_statement(t, h, "HTML", text.FED_CALENDAR), text.fed_statement(t, h, "Statement", text.FED_HISTORICAL), text.fed_minutes(t, h, "HTML", F.col("context")), text.fed_minutes(t, h, "Minutes", F.col("context")))
    return a.select("o_orderkey", ref.alias("r")).filter("r IS NOT NULL").select("o_orderkey", "r.*")


def q_ecb_links(spark, sf_dir):
    a = _links(spark, sf_dir)
    ref = text.ecb_link(F.col("text"), F.col("in_title"), F.col("href"), F.col("iso"))
    return a.select("o_orderkey", ref.alias("r")).filter("r IS NOT NULL").select("o_orderkey", "r.*")


SQL_LINKS = """lk AS (SELECT o_orderkey, o_orderkey % 11 AS f, o_orderkey % 5 AS w, CAST(o_orderdate AS DATE) AS d FROM orders),
ln AS (SELECT *, strftime(d, '%Y%m%d') AS ymd, strftime(d, '%y%m%d') AS short FROM lk)"""


def q_doc_ids(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    href = F.concat(F.lit("/x/ecb."), F.regexp_replace("url", r"^https?://", ""), F.lit("~0ab.en.html"))
    return p.select("page_id", text.ecb_doc_id(href).alias("doc_id"))


def q_years(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    digits = F.concat(F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0"), F.date_format("o_orderdate", "MMdd"))
    iso = F.when(F.col("o_orderkey") % 7 == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select("o_orderkey", text.ecb_announcement(iso, F.concat(F.lit("/html/pr"), digits, F.lit(".en.html"))).alias("announced"))


def q_release(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    said = F.when(k % 4 == 0, F.date_format(d, "MMMM d, yyyy")).when(k % 4 == 1, F.concat(F.date_format(d, "MMM"), F.lit(". "), F.date_format(d, "d, yyyy"))).when(k % 4 == 2, "soon")
    context = F.concat(F.lit("Minutes (Released "), F.coalesce(said, F.lit("")), F.lit(") PDF"))
    return o.select("o_orderkey", text.release_date(context, F.date_add(d, -21)).alias("released"))


def q_html(spark, sf_dir):
    return html.extract(read(spark, sf_dir, "pages").select("page_id", "html"), "article").select("page_id", "text", "text_error")


def q_anchors(spark, sf_dir):
    return html.anchors(read(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", "seq", "text", "href")


EXTRACTORS = ("fed", "fed", "fed_minutes", "ecb", "article")


def q_layouts(spark, sf_dir):
    """Each document's lines as the paragraphs of a page in one of the layouts that the extractors know."""
    d = read(spark, sf_dir, "documents")
    safe = F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    paragraphs = lambda head, tail: F.concat(F.lit(head), F.replace(safe, F.lit("\n"), F.lit(tail + head)), F.lit(tail))
    pages = [
        ('<div id="article"><div class="heading col-sm-8"><p class="article__time">May  1</p></div><div class="col-sm-8">', paragraphs("<p>", "</p>"), "<p><a href='/x'>More</a></p></div></div>"),
        ("<p>Release Date: May 2</p><!-- DO NOT REMOVE: a -->", paragraphs("<p>", ""), "<!---- DO NOT REMOVE: b --><p>tail"),
        ('<p>menu</p><div id="leftText">', paragraphs("<li>", "</li>"), '<p>Return to top</p></div><div id="lastUpdate">Last update: June 3</div>'),
        ('<main><div class="title"><p>x</p></div><div class="section"><p class="ecb-publicationDate">7 July</p>', paragraphs("<h2>", "</h2>"), "<p>***</p></div></main>"),
        ("<p>menu</p><article>", paragraphs("<p>", ""), "</article><p>foot"),
    ]
    page = F.element_at(F.array(*[F.concat(F.lit(a), b, F.lit(c)) for a, b, c in pages]), (F.col("doc_id") % 5 + 1).cast("int"))
    name = F.element_at(F.array(*[F.lit(e) for e in EXTRACTORS]), (F.col("doc_id") % 5 + 1).cast("int"))
    return html.extract(d.select("doc_id", page.alias("html"), name.alias("extractor")), F.col("extractor")).drop("html")


# ---- cost and ledger ----------------------------------------------------------------------


def q_cost(spark, sf_dir):
    u = usage(spark, sf_dir).join(F.broadcast(cost.registry(spark, REGISTRY)), "key")
    args = [F.col(c) for c in ("input_tokens", "output_tokens", "input_usd_per_mtok", "output_usd_per_mtok")]
    return u.select("conv_id", "key", "input_tokens", "output_tokens", cost.cost_usd(*args, digits=9).alias("sync_usd"), cost.cost_usd(*args, F.col("batch_discount"), 9).alias("batch_usd"))


def q_estimate(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").groupBy("role").agg(cost.token_estimate(1200, F.col("text")).alias("tokens"), F.count(F.lit(1)).alias("documents"))
    return c.withColumn("usd", cost.submit_estimate(F.col("documents"), F.col("tokens"), F.lit(0.2), F.lit(1.25), 0.5))


def q_cheapest(spark, sf_dir):
    best = cost.cheapest(cost.registry(spark, REGISTRY))
    n = usage(spark, sf_dir).groupBy("key").agg(F.count(F.lit(1)).alias("conversations"))
    return best.join(n, "key", "left")


def _runs(spark, sf_dir) -> DataFrame:
    u = usage(spark, sf_dir).join(F.broadcast(cost.registry(spark, REGISTRY)), "key")
    args = [F.col(c) for c in ("input_tokens", "output_tokens", "input_usd_per_mtok", "output_usd_per_mtok")]
    return u.select((F.col("conv_id") % 10).alias("run_id"), F.col("key").alias("model_key"), F.lit("v1").alias("prompt_version"), "input_tokens", "output_tokens", cost.cost_usd(*args, digits=9).alias("cost_usd"), (F.col("conv_id") % 4 != 0).alias("ok"))


def q_ledger(spark, sf_dir):
    return store.ledger_entries(_runs(spark, sf_dir)).withColumn("cost_usd", F.round("cost_usd", 5))


def q_ledger_once(spark, sf_dir):
    entries = store.ledger_entries(_runs(spark, sf_dir))
    return store.append_once(entries.filter("run_id < 4"), entries).select("run_id", "model_key", "documents")


def q_run_summary(spark, sf_dir):
    return store.run_summary(_runs(spark, sf_dir)).withColumn("cost_usd", F.round("cost_usd", 4))


# ---- catalogues and merges ----------------------------------------------------------------


def q_precedence(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.lit("statement").alias("doc_type"))
    traps = read(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id", F.lit("minutes").alias("doc_type"))
    return store.merge_precedence([d, traps], ["doc_id"])


def q_unknown(spark, sf_dir):
    lab = read(spark, sf_dir, "labels").select((F.col("doc_id") * 3).alias("doc_id"))
    return grading.unknown_documents(lab, read(spark, sf_dir, "documents"))


def q_doc_types(spark, sf_dir):
    lab = read(spark, sf_dir, "labels").select((F.col("doc_id") * 2).alias("doc_id"), "quality")
    return grading.resolve_doc_types(lab, read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("doc_type")))


def q_replace(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    new = d.filter("lang = 'de' AND doc_id % 2 = 0").withColumn("source", F.concat(F.lit("new-"), "source"))
    return store.filtered_replace(d, new, "lang", "de")


def q_upsert(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    half = F.col("event_id") % 2 == 0
    # the odd events of every third user have keys of their own, so some keys are on one side only
    apart = e.filter(~half).withColumn("user_id", F.when(F.col("user_id") % 3 == 0, F.col("user_id") + 1_000_000_000).otherwise(F.col("user_id")))
    return store.upsert(e.filter(half), apart, ["user_id"], "event_id")


def q_first_wins(spark, sf_dir):
    p = read(spark, sf_dir, "pages").withColumn("host", F.regexp_extract("url", r"^https?://([^/]+)/", 1))
    return store.first_wins(p.select("host", "page_id", "url"), ["host"], "page_id")


def q_missing(spark, sf_dir):
    """Orders without a line item of at least 45 units."""
    big = read(spark, sf_dir, "lineitem").filter("l_quantity >= 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return store.missing(read(spark, sf_dir, "orders"), big, "o_orderkey")


def q_pending(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    states = F.array(*[F.lit(s) for s in ("completed", "in_progress", "failed", "ended", "expired")])
    s = o.select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "openai").otherwise("anthropic").alias("provider"), F.element_at(states, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("status"), (F.col("o_orderstatus") == "F").alias("collected"))
    return s.groupBy("provider", "status").agg(F.count_if(~F.col("collected")).alias("pending"), F.count_if(~F.col("collected") & batch.is_terminal(F.col("provider"), F.col("status"))).alias("collectable"))


def q_first_year(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    return store.first_per_year(o, "d", list(range(1996, 2001)), "o_orderkey")


def q_coverage(spark, sf_dir):
    """Years around those of the orders; the years without any are the gaps."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("d"))
    return store.coverage_gaps(o, "d", 1990, 2005, 4)


def q_batch_docs(spark, sf_dir):
    """Batch states that hold their documents as an array, and back to one row each."""
    li = read(spark, sf_dir, "lineitem")
    doc = F.struct(F.col("l_linenumber").alias("doc_id"), F.col("l_partkey").alias("part"))
    states = li.groupBy(F.col("l_orderkey").alias("batch_id")).agg(F.array_sort(F.collect_list(doc)).alias("documents"))
    numbered = F.transform("documents", lambda d, i: F.struct(i.alias("position"), d["doc_id"].alias("doc_id"), d["part"].alias("part")))
    states = states.select("batch_id", *[F.lit(v).alias(c) for c, v in (("provider", "openai"), ("model_key", "m0"), ("prompt_version", "v1"))], numbered.alias("documents"))
    return batch_documents(states)


def q_requested(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    asked = read(spark, sf_dir, "labels").select((F.col("doc_id") * 2).alias("doc_id"), F.col("doc_id").alias("position"))
    return store.requested_lookup(asked, d)


def q_decisions(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    lab = read(spark, sf_dir, "labels")
    day = F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("doc_id") % 60).cast("int"))
    graded = d.select("doc_id", F.when(F.col("lang") == "en", "FED").otherwise("ECB").alias("bank"), day.alias("announcement_date"), F.when(F.col("n_chars") % 9 == 0, "extraction_failed").otherwise("graded").alias("status"))
    records = lab.select("doc_id", F.struct("quality", "toxic").alias("record"))
    out = decisions(graded, records, "ECB", dt.date(2024, 1, 10), dt.date(2024, 2, 10), "graded", 200)
    return out.select("doc_id", "announcement_date", "record.quality", "record.toxic")


def q_traces(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", "event_type")
    return recent_traces(e, spark, e.schema, 50)


# ---- provider batches -----------------------------------------------------------------------


def _openai(spark, sf_dir) -> DataFrame:
    """Provider output lines of each conversation turn, as JSON text and parsed back."""
    c = read(spark, sf_dir, "conversations")
    k = F.col("conv_id") * 7 + F.col("turn")
    block = lambda kind, t: F.struct(F.lit(kind).alias("type"), t.alias("text"))
    item = lambda kind, *bs: F.struct(F.lit(kind).alias("type"), F.array(*bs).alias("content"))
    items = F.array(item("reasoning", block("output_text", F.lit("no"))), item("message", block("output_text", F.col("text")), block("refusal", F.lit("x")), block("output_text", F.lit("!"))))
    said = F.when(k % 5 != 0, F.to_json(items)).otherwise("[]")
    status = F.when(k % 6 == 0, "incomplete").otherwise("completed")
    details = F.when(k % 12 == 0, '{"reason":"content_filter"}').otherwise("null")
    body = F.concat(F.lit('{"status":"'), status, F.lit('","incomplete_details":'), details, F.lit(',"output":'), said, F.lit(',"usage":{"input_tokens":'), F.length("text").cast("string"), F.lit(',"output_tokens":7}}'))
    fine = F.concat(F.lit('{"custom_id":"'), k.cast("string"), F.lit('","response":{"status_code":200,"body":'), body, F.lit('},"error":null}'))
    http = F.concat(F.lit('{"custom_id":"'), k.cast("string"), F.lit('","response":{"status_code":500,"body":{"error":{"code":"server","message":"down"}}},"error":null}'))
    bare = F.concat(F.lit('{"custom_id":"'), k.cast("string"), F.lit('","response":{"status_code":429,"body":{}},"error":{}}'))
    line = F.when(k % 8 == 7, http).when(k % 8 == 6, bare).otherwise(fine)
    return c.select(F.from_json(line, OPENAI_LINE).alias("l")).select("l.*")


def q_openai(spark, sf_dir):
    out = _openai(spark, sf_dir)
    errors = out.select((F.col("custom_id").cast("long") + 1).cast("string").alias("custom_id"), F.lit(None).cast(out.schema["response"].dataType).alias("response"))
    code = F.when(F.col("custom_id").cast("long") % 2 == 0, "batch_expired").otherwise("other")
    errors = errors.withColumn("error", F.struct(code.alias("code"), F.lit("m").alias("message")))
    return batch.collect_openai(out, errors).select("custom_id", "result.*")


def q_anthropic(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    k = F.col("conv_id") * 7 + F.col("turn")
    kinds = F.array(*[F.lit(x) for x in ("succeeded", "succeeded", "errored", "expired", "canceled", "succeeded")])
    content = F.when(k % 4 != 0, F.array(F.struct(F.lit("thinking").alias("type"), F.lit("t").alias("text")), F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))).otherwise(F.array().cast("array<struct<type:string,text:string>>"))
    kind = F.element_at(kinds, (k % 6 + 1).cast("int"))
    message = F.struct(content.alias("content"), F.struct(F.length("text").alias("input_tokens"), F.lit(3).alias("output_tokens")).alias("usage"), F.lit("end_turn").alias("stop_reason"))
    result = F.struct(kind.alias("type"), F.when(kind == "errored", "boom").alias("error"), F.when(kind == "succeeded", message).alias("message"))
    line = F.to_json(F.struct(k.cast("string").alias("custom_id"), result.alias("result")))
    lines = c.select(F.from_json(line, ANTHROPIC_LINE).alias("l")).select("l.*")
    return batch.collect_anthropic(lines).select("custom_id", "result.*")


def q_payloads(spark, sf_dir):
    """Payloads with one field put wrong in each of a dozen ways."""
    e = read(spark, sf_dir, "events")
    k = F.col("event_id")
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (k % len(v) + 1).cast("int"))
    bps = pick("25", '"25"', "25.0", "25.5", '""', "null", "true")
    day = pick('"2026-06-11"', '"2026-06-11T00:00:00"', '"June 11, 2026"', "null", '"2026-06-11T10:00:00"')
    bank, action = pick('"FED"', '"ECB"', '"fed"', "5", '"FED"', '"ECB"', '"FED"', '"ECB"', '"FED"', '"ECB"', '"FED"'), pick('"hike"', '"cut"', '"hold"', '"no_policy_decision"', '"raise"', "null", '"hold"', '"cut"', '"hike"', '"cut"', '"hold"', '"hike"', '"hold"')
    quote = F.when(k % 17 == 0, "").otherwise(F.concat(F.lit('"evidence_quote":"q'), k.cast("string"), F.lit('",')))
    rate = pick("2.25", '"2.25"', "null", "2", '"x"', "1.5", "0.75", "2.5", "3.0")
    body = F.concat(F.lit('{"bank":'), bank, F.lit(',"action":'), action, F.lit(',"change_bps":'), bps, F.lit(',"decision_date":'), day, F.lit(","), quote, F.lit('"effective_date":null,"target_range_lower_pct":null,"target_range_upper_pct":null,"dfr_pct":'), rate, F.lit(',"mro_pct":null,"mlf_pct":null,"extra":1}'))
    body = F.when(k % 31 == 0, F.left(body, F.lit(30))).when(k % 37 == 0, "[1]").otherwise(body)
    out = with_record(e.select("event_id", body.alias("body")), F.col("body"), "p")
    return out.select("event_id", "p.ok", "p.record.bank", "p.record.action", "p.record.change_bps", F.col("p.record.decision_date").cast("date").alias("decision_date"), "p.record.dfr_pct", F.substring_index("p.error", ":", 1).alias("error"))


def q_requests(spark, sf_dir):
    """Shape of the request bodies built for a batch."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("model_input"))
    r = batch.request_rows(d, "m-1", "prompt", "openai", {"type": "object"})
    found = lambda path: F.get_json_object("request", path)
    return r.select("custom_id", found("$.body.model").alias("model"), F.length(found("$.body.input")).cast("long").alias("chars"), found("$.body.text.format.schema.type").alias("kind"))


QUERIES = {
    "normalize_text": q_normalize, "framed_input": q_framed, "fed_link_classify": q_fed_links, "ecb_link_classify": q_ecb_links, "doc_id_from_url": q_doc_ids, "year_pivot": q_years,
    "release_date_parse": q_release, "html_text": q_html, "html_anchors": q_anchors, "html_layouts": q_layouts, "token_cost": q_cost, "submit_estimate": q_estimate, "cheapest_model": q_cheapest,
    "cost_ledger": q_ledger, "ledger_idempotent_append": q_ledger_once, "run_summary": q_run_summary, "catalog_merge_precedence": q_precedence, "unknown_doc_guard": q_unknown, "doc_type_lookup": q_doc_types, "filtered_replace": q_replace,
    "upsert_last_wins": q_upsert, "dedupe_first_wins": q_first_wins, "missing_docs": q_missing, "pending_batches": q_pending, "first_per_year": q_first_year, "yearly_coverage": q_coverage,
    "explode_batch_docs": q_batch_docs, "requested_ids_lookup": q_requested, "decisions_read": q_decisions, "recent_traces": q_traces, "provider_openai": q_openai, "provider_anthropic": q_anthropic,
    "payload_validation": q_payloads, "batch_requests": q_requests,
}

_RUNS = f"WITH {SQL_REGISTRY}, {SQL_USAGE}, runs AS (SELECT conv_id % 10 AS run_id, u.key AS model_key, 'v1' AS prompt_version, i, o, (i * inr + o * outr) / 1000000 AS c, conv_id % 4 <> 0 AS ok FROM u JOIN reg USING (key))"

ORACLES = {
    "normalize_text": f"SELECT doc_id, {sql_normalize('m')} AS clean FROM (SELECT doc_id, '  ' || chr(160) || regexp_replace(text, ' of ', chr(8195) || 'of' || chr(8209) || ' ', 'g') || chr(160) || chr(10) AS m FROM documents)",
    "framed_input": "SELECT doc_id, 'Source: ' || CASE WHEN lang = 'en' THEN 'Federal Reserve (FOMC)' ELSE 'European Central Bank' END || CASE WHEN doc_id % 3 = 0 THEN ' publication' ELSE ' press release' END || chr(10) || chr(10) || '<document>' || chr(10) || text || chr(10) || '</document>' AS model_input, CASE WHEN lang <> 'en' THEN 'ecb' WHEN doc_id % 3 = 0 THEN 'fed_minutes' ELSE 'fed' END AS extractor FROM documents",
    "fed_link_classify": f"""WITH {SQL_LINKS} SELECT o_orderkey,
        CASE WHEN f IN (4, 5) THEN 'fed_min_' || ymd ELSE 'fed_' || ymd || CASE f WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE '' END END AS doc_id,
        CASE WHEN f NOT IN (4, 5) THEN d WHEN o_orderkey % 4 IN (0, 1) THEN d + 21 ELSE d END AS announcement_date, CASE WHEN f IN (4, 5) THEN 'minutes' ELSE 'statement' END AS doc_type
        FROM ln WHERE (f = 0 AND w IN (0, 1)) OR (f IN (1, 2, 3) AND w = 1) OR (f IN (4, 5) AND w IN (0, 2))""",
    "ecb_link_classify": f"""WITH {SQL_LINKS} SELECT o_orderkey, 'ecb_' || CASE f WHEN 6 THEN 'mp' || short WHEN 7 THEN 'pr' || short || '_2' WHEN 8 THEN 'pr' || short || '_1' ELSE 'mg' || short END AS doc_id,
        CASE WHEN o_orderkey % 3 = 0 THEN d + 1 ELSE d END AS announcement_date, CASE WHEN f IN (6, 7) THEN 'decision' WHEN f = 8 THEN 'non_decision' ELSE 'minutes' END AS doc_type
        FROM ln WHERE o_orderkey % 10 <> 0 AND ((f IN (6, 7) AND w = 3) OR (f IN (8, 9) AND w <> 3))""",
    "doc_id_from_url": r"SELECT page_id, 'ecb_' || regexp_replace(string_split(string_split(string_split('ecb.' || regexp_replace(url, '^https?://', '') || '~0ab.en.html', '/')[-1], '.en.html')[1], '~')[1], '^ecb\.', '') AS doc_id FROM pages",
    "year_pivot": "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_orderdate AS DATE) ELSE TRY_CAST(CASE WHEN o_orderkey % 100 >= 90 THEN '19' ELSE '20' END || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') || strftime(o_orderdate, '-%m-%d') AS DATE) END AS announced FROM orders",
    "release_date_parse": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 IN (0, 1) THEN CAST(o_orderdate AS DATE) ELSE CAST(o_orderdate AS DATE) - 21 END AS released FROM orders",
    # tags cut out by regular expressions, entities by name, as the pages have them
    "html_text": r"""WITH b AS (SELECT page_id, regexp_split_to_array(regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1), '<(?:p|li|h[123])(?: [^>]*)?>') AS parts FROM pages),
u AS (SELECT page_id, unnest(parts[2:]) AS part, unnest(generate_series(2, len(parts))) AS i FROM b),
t AS (SELECT page_id, i, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(part, '<!--.*?-->|<[^>]*>', ' ', 'g'), '&lt;?', '<', 'g'), '&#39;', ''''), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&nbsp;?', ' ', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM u)
SELECT p.page_id, string_agg(t.text, chr(10) || chr(10) ORDER BY i) FILTER (WHERE t.text <> '') AS text, CASE WHEN count(*) FILTER (WHERE t.text <> '') = 0 THEN 'ValueError: no text in article' END AS text_error FROM pages p LEFT JOIN t USING (page_id) GROUP BY p.page_id""",
    "html_anchors": r"""WITH a AS (SELECT page_id, regexp_extract_all(html, '(?s)<a href="[^"]*">.*?</a>') AS found FROM pages),
e AS (SELECT page_id, unnest(found) AS link, unnest(generate_series(0, len(found) - 1)) AS seq FROM a)
SELECT page_id, CAST(seq AS INTEGER) AS seq, trim(regexp_replace(link, '<[^>]*>', '', 'g')) AS text, regexp_extract(link, 'href="([^"]*)"', 1) AS href FROM e""",
    "token_cost": f"WITH {SQL_REGISTRY}, {SQL_USAGE} SELECT conv_id, key, i AS input_tokens, o AS output_tokens, round((i * inr + o * outr) / 1000000, 9) AS sync_usd, round((i * inr + o * outr) / 1000000 * 0.5::DOUBLE, 9) AS batch_usd FROM u JOIN reg USING (key)",
    "submit_estimate": "WITH t AS (SELECT role, CAST(sum(1200 + length(text)) // 4 AS BIGINT) AS tokens, count(*) AS documents FROM conversations GROUP BY role) SELECT *, round((tokens * 0.2::DOUBLE + documents * 300 * 1.25::DOUBLE) / 1000000 * 0.5::DOUBLE, 6) AS usd FROM t",
    "cheapest_model": f"WITH {SQL_REGISTRY}, {SQL_USAGE}, b AS (SELECT provider, arg_min(key, inr) AS key, min(inr) AS input_usd_per_mtok FROM reg GROUP BY provider) SELECT b.*, n.conversations FROM b LEFT JOIN (SELECT key, count(*) AS conversations FROM u GROUP BY key) n USING (key)",
    "cost_ledger": _RUNS + " SELECT run_id, model_key, prompt_version, count(*) AS documents, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, round(round(sum(round(c, 9)), 6), 5) AS cost_usd FROM runs GROUP BY ALL",
    "ledger_idempotent_append": _RUNS + " SELECT run_id, model_key, count(*) AS documents FROM runs x WHERE NOT EXISTS (SELECT 1 FROM runs y WHERE y.run_id = x.run_id AND y.run_id < 4) GROUP BY ALL",
    "run_summary": _RUNS + " SELECT count(*) AS n, count(*) FILTER (WHERE ok) AS ok, count(*) FILTER (WHERE NOT ok) AS failures, round(sum(round(c, 9)), 4) AS cost_usd FROM runs",
    "catalog_merge_precedence": "SELECT COALESCE(d.doc_id, t.doc_id) AS doc_id, COALESCE(t.k, 'statement') AS doc_type FROM documents d FULL JOIN (SELECT DISTINCT doc_id, 'minutes' AS k FROM labels WHERE toxic = 1) t ON t.doc_id = d.doc_id",
    "unknown_doc_guard": "SELECT DISTINCT doc_id * 3 AS doc_id FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id * 3)",
    "filtered_replace": "SELECT doc_id, lang, CASE WHEN lang = 'de' THEN 'new-' || source ELSE source END AS source FROM documents WHERE lang <> 'de' OR doc_id % 2 = 0",
    "upsert_last_wins": "SELECT k AS user_id, event_id, event_type, value FROM (SELECT *, CASE WHEN event_id % 2 = 1 AND user_id % 3 = 0 THEN user_id + 1000000000 ELSE user_id END AS k FROM events) QUALIFY row_number() OVER (PARTITION BY k ORDER BY event_id % 2 DESC, event_id DESC) = 1",
    "dedupe_first_wins": "SELECT host, min(page_id) AS page_id, arg_min(url, page_id) AS url FROM (SELECT *, regexp_extract(url, '^https?://([^/]+)/', 1) AS host FROM pages) GROUP BY host",
    "missing_docs": "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 45)",
    "pending_batches": "WITH s AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'openai' ELSE 'anthropic' END AS provider, ['completed', 'in_progress', 'failed', 'ended', 'expired'][o_orderkey % 5 + 1] AS status, o_orderstatus = 'F' AS c FROM orders) SELECT provider, status, count(*) FILTER (WHERE NOT c) AS pending, count(*) FILTER (WHERE NOT c AND ((provider = 'openai' AND status IN ('completed', 'failed', 'expired', 'cancelled')) OR (provider = 'anthropic' AND status = 'ended'))) AS collectable FROM s GROUP BY ALL",
    "first_per_year": "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(year(o_orderdate) AS INTEGER) AS year FROM (SELECT *, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS rn FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 2000) WHERE rn = 1",
    "yearly_coverage": "SELECT CAST(y AS INTEGER) AS year, count(o.o_orderkey) AS n FROM generate_series(1990, 2005) g(y) LEFT JOIN orders o ON year(o.o_orderdate) = y GROUP BY y HAVING count(o.o_orderkey) < 4",
    "explode_batch_docs": "SELECT l_orderkey AS batch_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS INTEGER) AS position, l_linenumber AS doc_id, l_partkey AS part, 'openai' AS provider, 'm0' AS model_key, 'v1' AS prompt_version FROM lineitem",
    "doc_type_lookup": "SELECT l.doc_id * 2 AS doc_id, l.quality, d.lang AS doc_type FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id * 2",
    "html_layouts": f"""WITH p AS (SELECT doc_id, doc_id % 5 AS k, list_filter(list_transform(string_split(COALESCE(text, ''), chr(10)), lambda x: {sql_normalize('x')}), lambda x: x <> '') AS ps FROM documents),
        t AS (SELECT doc_id, ['fed', 'fed', 'fed_minutes', 'ecb', 'article'][k + 1] AS extractor, k,
          array_to_string(list_concat([['Published: May 1'], ['Release Date: May 2'], ['Published: June 3'], ['Published: 7 July'], []][k + 1], ps), chr(10) || chr(10)) AS text FROM p)
        SELECT doc_id, extractor, CASE WHEN error IS NULL THEN text END AS text, error AS text_error
        FROM (SELECT *, CASE WHEN k = 2 AND length(text) < 5000 THEN 'ValueError: minutes of ' || length(text) || ' characters' WHEN text = '' THEN 'ValueError: no text in article' END AS error FROM t)""",
    "requested_ids_lookup": "SELECT l.doc_id * 2 AS doc_id, l.doc_id AS position, d.lang, d.source FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id * 2",
    "decisions_read": "SELECT g.doc_id, g.d AS announcement_date, l.quality, l.toxic FROM (SELECT doc_id, DATE '2024-01-01' + CAST(doc_id % 60 AS INTEGER) AS d FROM documents WHERE lang <> 'en' AND n_chars % 9 <> 0 AND doc_id % 60 BETWEEN 9 AND 40 ORDER BY doc_id LIMIT 200) g LEFT JOIN labels l USING (doc_id)",
    "recent_traces": "SELECT event_id AS id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 50",
    "provider_openai": r"""WITH c AS (SELECT conv_id * 7 + turn AS k, text AS t, length(text) AS n FROM conversations),
        o AS (SELECT k, CASE WHEN k % 8 = 7 THEN 'api_error: {"code":"server","message":"down"}' WHEN k % 8 = 6 THEN 'api_error: {"status_code":429}' WHEN k % 12 = 0 THEN 'api_error: response incomplete (content_filter)' WHEN k % 6 = 0 THEN 'api_error: response incomplete' WHEN k % 5 = 0 THEN 'api_error: no output_text in batch response' END AS error, t || '!' AS p, n FROM c)
        SELECT CAST(k AS VARCHAR) AS custom_id, CASE WHEN error IS NULL THEN p END AS payload, error, CASE WHEN k % 8 >= 6 THEN 0 ELSE n END::INTEGER AS input_tokens, CASE WHEN k % 8 >= 6 THEN 0 ELSE 7 END AS output_tokens FROM o
        UNION ALL SELECT CAST(k + 1 AS VARCHAR), NULL, 'api_error: {"code":"other","message":"m"}', 0, 0 FROM o WHERE (k + 1) % 2 = 1 AND k + 1 NOT IN (SELECT k FROM o)""",
    "provider_anthropic": "WITH c AS (SELECT conv_id * 7 + turn AS k, text FROM conversations) SELECT CAST(k AS VARCHAR) AS custom_id, CASE WHEN k % 6 IN (0, 1, 5) AND k % 4 <> 0 THEN text END AS payload, CASE WHEN k % 6 = 2 THEN 'api_error: batch result errored: boom' WHEN k % 4 = 0 THEN 'api_error: no text block (stop_reason=end_turn)' END AS error, CASE WHEN k % 6 = 2 THEN 0 ELSE length(text) END::INTEGER AS input_tokens, CASE WHEN k % 6 = 2 THEN 0 ELSE 3 END AS output_tokens FROM c WHERE k % 6 NOT IN (3, 4)",
    "payload_validation": """WITH e AS (SELECT event_id AS k, k % 31 <> 0 AND k % 37 <> 0 AND k % 17 <> 0 AND k % 11 NOT IN (2, 3) AND k % 13 NOT IN (4, 5) AND k % 7 NOT IN (3, 4) AND k % 5 NOT IN (2, 4) AND k % 9 <> 4 AS ok FROM events)
        SELECT k AS event_id, ok, CASE WHEN ok THEN CASE WHEN k % 11 % 2 = 0 THEN 'FED' ELSE 'ECB' END END AS bank, CASE WHEN ok THEN ['hike', 'cut', 'hold', 'no_policy_decision', '', '', 'hold', 'cut', 'hike', 'cut', 'hold', 'hike', 'hold'][k % 13 + 1] END AS action,
        CASE WHEN ok THEN CASE k % 7 WHEN 5 THEN NULL WHEN 6 THEN 1 ELSE 25 END END::INTEGER AS change_bps, CASE WHEN ok AND k % 5 < 2 THEN DATE '2026-06-11' END AS decision_date,
        CASE WHEN ok THEN [2.25, 2.25, NULL, 2, NULL, 1.5, 0.75, 2.5, 3.0][k % 9 + 1] END::DOUBLE AS dfr_pct, CASE WHEN NOT ok THEN 'schema_violation' END AS error FROM e""",
    "batch_requests": "SELECT CAST(doc_id AS VARCHAR) AS custom_id, 'm-1' AS model, CAST(length(text) AS BIGINT) AS chars, 'object' AS kind FROM documents",
}
