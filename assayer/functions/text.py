"""Text normalisation, link classification and dates in text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode defines it, which Java's \s does not.
BLANKS = r"[\s\x0B\x1C-\x1F\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"

#: The forms of links to documents.
FED_CALENDAR = [r"^/newsevents/pressreleases/monetary(\d{8})([a-z])\.htm$"]
FED_HISTORICAL = [
    r"^/newsevents/(?:press/monetary/|pressreleases/monetary)(\d{8})([a-z])\.htm$",
    r"^/boarddocs/press/(?:monetary|general)/\d{4}/(\d{8})/(?:default\.htm)?$",
]
FED_MINUTES = [r"^/monetarypolicy/fomcminutes(\d{8})\.htm$", r"^/fomc/minutes/(\d{8})\.htm$"]
ECB_DECISION = r"^/press/pr/date/\d{4}/html/(?:ecb\.mp\d{6}~[0-9a-f]+|pr\d{6}(?:_\d+)?)\.en\.html$"
ECB_NON_DECISION = r"^/press/pr/date/\d{4}/html/ecb\.pr\d{6}(?:_\d+)?~[0-9a-f]+\.en\.html$"
ECB_ACCOUNTS = r"^/press/accounts/\d{4}/html/ecb\.mg\d{6}~[0-9a-f]+\.en\.html$"
ECB_DECISION_TITLE = "monetary policy decisions"
ECB_DATE = r"(?:ecb\.(?:mp|mg|pr)|pr)(\d{6})"
RELEASED = r"\(Released ([^)]+)\)"


def normalize(text: Column) -> Column:
    """No-break spaces and hyphens made plain, runs of white space made one space, ends cut."""
    plain = F.translate(text, " ‑", " -")
    return F.trim(F.regexp_replace(plain, BLANKS, " "))


def source_label(bank: Column, doc_type: Column) -> Column:
    """How a document is introduced to a model."""
    name = F.when(bank == "FED", "Federal Reserve (FOMC)").when(bank == "ECB", "European Central Bank").otherwise(bank)
    kind = F.when(doc_type == "minutes", "publication").otherwise("press release")
    return F.concat_ws(" ", name, kind)


def framed(label: Column, text: Column) -> Column:
    """The input of an extraction model."""
    return F.concat(F.lit("Source: "), label, F.lit("\n\n<document>\n"), text, F.lit("\n</document>"))


def extractor_name(bank: Column, doc_type: Column) -> Column:
    """Which text extractor a document needs."""
    return F.when((bank == "FED") & (doc_type == "minutes"), "fed_minutes").when(bank == "FED", "fed").when(bank == "ECB", "ecb")


def _first_match(href: Column, patterns: list[str], group: int) -> Column:
    return F.coalesce(*[F.when(href.rlike(p), F.regexp_extract(href, p, group)) for p in patterns])


def fed_statement(text: Column, href: Column, link_text: str, patterns: list[str]) -> Column:
    """struct(doc_id, announcement_date, doc_type) of a statement link, else null."""
    digits = _first_match(href, patterns, 1)
    suffix = F.coalesce(*[F.when(href.rlike(p), F.regexp_extract(href, p, 2) if "([a-z])" in p else F.lit("")) for p in patterns])
    ref = F.struct(F.concat(F.lit("fed_"), digits, suffix).alias("doc_id"), F.try_to_date(digits, "yyyyMMdd").alias("announcement_date"), F.lit("statement").alias("doc_type"))
    return F.when((F.trim(text) == link_text) & digits.isNotNull(), ref)


def fed_minutes(text: Column, href: Column, link_text: str, context: Column) -> Column:
    """The same of a minutes link; dated by the release named in the text around it."""
    digits = _first_match(href, FED_MINUTES, 1)
    meeting = F.try_to_date(digits, "yyyyMMdd")
    ref = F.struct(F.concat(F.lit("fed_min_"), digits).alias("doc_id"), release_date(context, meeting).alias("announcement_date"), F.lit("minutes").alias("doc_type"))
    return F.when((F.trim(text) == link_text) & digits.isNotNull(), ref)


def release_date(context: Column, meeting: Column) -> Column:
    """The date in "(Released ...)", its month in full or short; else the meeting's."""
    found = F.regexp_replace(normalize(F.regexp_extract(context, RELEASED, 1)), r"\.", "")
    return F.coalesce(F.try_to_date(found, "MMMM d, yyyy"), F.try_to_date(found, "MMM d, yyyy"), meeting)


def ecb_doc_id(href: Column) -> Column:
    """Last path segment without language, hash and house prefix."""
    name = F.substring_index(F.substring_index(F.substring_index(href, "/", -1), ".en.html", 1), "~", 1)
    return F.concat(F.lit("ecb_"), F.regexp_replace(name, r"^ecb\.", ""))


def pivot_date(digits: Column) -> Column:
    """yymmdd to a date; years from 90 are of the last century."""
    yy = F.substring(digits, 1, 2).try_cast("int")
    year = F.when(yy >= 90, 1900 + yy).otherwise(2000 + yy)
    return F.try_to_date(F.concat(year.cast("string"), F.substring(digits, 3, 4)), "yyyyMMdd")


def ecb_announcement(iso: Column, href: Column) -> Column:
    """The list's own date, else the date in the link."""
    return F.coalesce(F.try_to_date(iso, "yyyy-MM-dd"), pivot_date(F.regexp_extract(href, ECB_DATE, 1)))


def ecb_link(title: Column, in_title: Column, href: Column, iso: Column) -> Column:
    """struct(doc_id, announcement_date, doc_type) of a decision or a trap, else null."""
    decision = F.lower(normalize(title)) == ECB_DECISION_TITLE
    kind = F.when(decision & href.rlike(ECB_DECISION), "decision")
    kind = kind.when(~decision & href.rlike(ECB_NON_DECISION), "non_decision").when(~decision & href.rlike(ECB_ACCOUNTS), "minutes")
    ref = F.struct(ecb_doc_id(href).alias("doc_id"), ecb_announcement(iso, href).alias("announcement_date"), kind.alias("doc_type"))
    return F.when(in_title & kind.isNotNull(), ref)
