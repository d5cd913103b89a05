"""Document types and speakers of central-bank publications."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import blank_to_null, lookup

#: Patterns and words by type, in the order in which they are tried.
ECB_PATTERNS = {
    "policy": ("monetary policy decisions?", "governing council", "interest rate", "key ecb interest rates", "policy decision"),
    "speeches": ("speech by", "remarks by", "keynote", "interview with", "statement by"),
    "bulletins": ("economic bulletin", "monthly bulletin", "quarterly bulletin"),
}
ECB_TYPES = {"pressreleases": "press_release", "speeches": "speech", "policy": "policy_decision", "bulletins": "bulletin"}
FED_WORDS = {
    "fomc_statement": ("fomc", "federal open market committee", "policy statement"),
    "speech": ("speech", "remarks", "statement by", "governor", "chair"),
    "testimony": ("testimony", "testifies", "congress"),
    "minutes": ("minutes", "meeting minutes"),
    "press_release": ("press release", "announces", "announcement", "enforcement action", "regulation"),
}
FED_CATEGORIES = {
    "Monetary Policy": "policy",
    "Orders on Banking Applications": "regulation",
    "Enforcement Actions": "regulation",
    "Banking and Consumer Regulatory Policy": "regulation",
    "Other Announcements": "other",
}
BOE_PATHS = (r"/speech/", r"/news/", r"/minutes/", r"/monetary-policy-summary", r"/monetary-policy-committee/")
SOURCE_CURRENCY = {"fed": "USD", "ecb": "EUR", "boe": "GBP"}


def _title_and_summary(title: Column, summary: Column) -> Column:
    return F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(summary, F.lit(""))))


def ecb_type(title: Column, summary: Column) -> Column:
    text = _title_and_summary(title, summary)
    return F.coalesce(*(F.when(text.rlike("|".join(p)), name) for name, p in ECB_PATTERNS.items()), F.lit("pressreleases"))


def ecb_section_type(found: Column, default: Column) -> Column:
    """The archive section's own type where the classifier fell back to press releases."""
    return F.when((found == "pressreleases") & (default != "pressreleases"), default).otherwise(found)


def ecb_label(kind: Column) -> Column:
    return lookup(ECB_TYPES, kind)


def fed_type(title: Column, summary: Column) -> Column:
    text = _title_and_summary(title, summary)
    return F.coalesce(*(F.when(reduce(Column.__or__, [text.contains(w) for w in words]), name) for name, words in FED_WORDS.items()), F.lit("press_release"))


def fed_category_type(category: Column, is_speech: Column) -> Column:
    return F.when(is_speech, "speeches").otherwise(F.coalesce(lookup(FED_CATEGORIES, category), F.lit("other")))


def boe_type(url: Column) -> Column:
    """struct(bucket, type)."""
    u = F.lower(F.coalesce(url, F.lit("")))
    speech, summary = u.contains("/speech/") | u.contains("/speeches/"), u.contains("monetary-policy-summary")
    bucket = F.when(speech, "speeches").when(summary, "summaries").otherwise("statements")
    kind = F.when(speech, "boe_speech").when(summary, "monetary_policy_summary").otherwise("press_release")
    return F.struct(bucket.alias("bucket"), kind.alias("type"))


def boe_url_wanted(url: Column, first_year: int | None = None, last_year: int | None = None) -> Column:
    """A wanted kind of page, and of a year in range; no year in the path passes."""
    wanted = url.rlike("|".join(BOE_PATHS))
    if first_year is None or last_year is None:
        return wanted
    year = F.regexp_extract(url, r"/(\d{4})/", 1)
    return wanted & ((year == "") | year.try_cast("int").between(first_year, last_year))


def source_currency(source: Column) -> Column:
    return F.coalesce(lookup(SOURCE_CURRENCY, F.lower(source)), F.lit("OTHER"))


#: Patterns of speakers' names.
ECB_SPEAKERS = [
    r"(?i)(?:speech|remarks|interview|statement)\s+by\s+([A-Z][a-z]+\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)(?:\s+at|\s+in|\s+to|\s+for|\s+on|,|$)",
    r"(?i)([A-Z][a-z]+\s+[A-Z][a-z]+)(?:\s*,\s*(?:President|Vice-President|Member|Chief))",
]
FED_TITLE_SPEAKERS = [r"(?i)(Vice\s+Chair(?:man)?\s+\w+)", r"(?i)(Chair(?:man)?\s+\w+)", r"(?i)(Governor\s+\w+)"]
FED_OFFICES = r"(?i)^(Governor|Chair|Vice Chair|President|Member)\s+"


def _one_spaced(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def ecb_speaker(title: Column, content: Column) -> Column:
    """Two patterns over the title and the first 500 characters; names of 4 to 49 characters."""
    text = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.substring(F.coalesce(content, F.lit("")), 1, 500))
    names = [_one_spaced(F.regexp_extract(text, p, 1)) for p in ECB_SPEAKERS]
    return F.coalesce(*(F.when((F.length(n) > 3) & (F.length(n) < 50), n) for n in names))


def fed_title_speaker(title: Column) -> Column:
    """'Vice Chair X', 'Chair X' or 'Governor X' of a title; '' where there is none."""
    found = [blank_to_null(F.trim(F.regexp_extract(title, p, 1))) for p in FED_TITLE_SPEAKERS]
    return F.coalesce(*found, F.lit(""))


def fed_speaker(text: Column) -> Column:
    """The name without the office before it; NULL where nothing is left."""
    return blank_to_null(F.trim(F.regexp_replace(F.trim(text), FED_OFFICES, "")))


def boe_speaker(author: Column, head_text: Column, main_text: Column) -> Column:
    """The page's author, else what follows 'speech by ' in the first 25 lines by the title, else in 80 lines of the main text."""

    def after(text: Column, lines: int) -> Column:
        full = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
        hit = F.get(F.filter(F.slice(full, 1, lines), lambda x: F.lower(x).contains("speech by ")), F.lit(0))
        return F.trim(F.substring(hit, F.locate("speech by ", F.lower(hit)) + 10, F.length(hit)))

    return F.coalesce(blank_to_null(F.trim(author)), after(head_text, 25), after(main_text, 80))
