"""Text normalisers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Country names and currency codes with their alpha-2 codes.
COUNTRY_CODES = {
    "united states": "US", "eurozone": "EU", "europe": "EU", "united kingdom": "GB", "japan": "JP", "canada": "CA", "australia": "AU",
    "switzerland": "CH", "china": "CN", "germany": "DE", "france": "FR", "italy": "IT", "spain": "ES", "new zealand": "NZ",
    "singapore": "SG", "brazil": "BR", "south korea": "KR", "india": "IN", "mexico": "MX", "south africa": "ZA", "turkey": "TR",
    "sweden": "SE", "norway": "NO", "denmark": "DK", "hong kong": "HK", "indonesia": "ID", "thailand": "TH", "russia": "RU",
    "poland": "PL", "israel": "IL", "colombia": "CO", "philippines": "PH",
    "USD": "US", "EUR": "EU", "GBP": "GB", "JPY": "JP", "CAD": "CA", "AUD": "AU", "CHF": "CH", "CNY": "CN", "NZD": "NZ", "SGD": "SG",
    "BRL": "BR", "KRW": "KR", "INR": "IN", "MXN": "MX", "ZAR": "ZA", "TRY": "TR", "SEK": "SE", "NOK": "NO", "DKK": "DK", "HKD": "HK",
    "IDR": "ID", "THB": "TH", "RUB": "RU", "PLN": "PL", "ILS": "IL", "COP": "CO", "PHP": "PH",
}
#: Words in event names that name a country; the first that fits wins.
COUNTRY_WORDS = [
    (r"german|germany", "DE"), (r"french|france", "FR"), (r"italian|italy", "IT"), (r"spanish|spain", "ES"), (r"greek|greece", "GR"),
    (r"portuguese|portugal", "PT"), (r"dutch|netherlands", "NL"), (r"belgian|belgium", "BE"), (r"austrian|austria", "AT"),
    (r"irish|ireland", "IE"), (r"finnish|finland", "FI"), (r"british|uk|u\.k\.", "GB"), (r"us|u\.s\.", "US"),
]
#: Domains by tier; boilerplate of landed pages; what stands for a missing value.
TIERS = {1: ("reuters.com", "bloomberg.com", "ft.com"), 2: ("wsj.com", "cnbc.com")}
NOISE = (r"Skip to main content", r"Board of Governors.*?Federal Reserve System", r"Stay Connected.*?RSS", r"Last Update:.*?\d{4}")
MISSING = ("-", "n/a", "na", "", "—", "–")


def lookup(values: dict[str, str], key: Column) -> Column:
    """The value under ``key``, NULL where there is none."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), key)


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def closed_references(html: Column) -> Column:
    """HTML in which only references with a semicolon count: one that is broken off is the text that it looks like.

    A parser of HTML takes ``&amp`` for ``&``; where escaped text was cut, it is a rest of that text.
    """
    return F.regexp_replace(html, r"&(?!(?:[a-zA-Z][a-zA-Z0-9]*|#[0-9]+|#[xX][0-9a-fA-F]+);)", "&amp;")


def clean_text(c: Column) -> Column:
    """All runs of Unicode white space to one space, zero-width spaces out, ends trimmed; NULL to ''."""
    spaced = F.regexp_replace(F.translate(c, "\u200b", ""), r"(?U)[\s\x1c-\x1f]+", " ")
    return F.coalesce(F.trim(spaced), F.lit(""))


def clean_value(c: Column) -> Column:
    return F.when(~F.lower(F.trim(c)).isin(*MISSING), F.trim(c))


def country_code(c: Column) -> Column:
    """Alpha-2 code of a country name or currency code; else the first two letters in upper case; NULL to ''."""
    spaced = F.lower(F.trim(F.regexp_replace(c, r"([a-z])([A-Z])", "$1 $2")))
    found = F.coalesce(lookup(COUNTRY_CODES, c), lookup(COUNTRY_CODES, F.lower(F.trim(c))), lookup(COUNTRY_CODES, spaced))
    return F.coalesce(found, F.substring(F.upper(F.trim(c)), 1, 2), F.lit(""))


def country_from_name(c: Column) -> Column:
    """The code of the word that comes first in the list, among all the words found in one pass."""
    words = [w for ws, _ in COUNTRY_WORDS for w in ws.split("|")]
    rank = {w.replace("\\", ""): k for k, (ws, _) in enumerate(COUNTRY_WORDS) for w in ws.split("|")}
    found = F.regexp_extract_all(F.lower(c), F.lit(rf"\b({'|'.join(words)})\b"), F.lit(1))
    of = F.create_map(*(F.lit(x) for pair in rank.items() for x in pair))
    first = F.array_min(F.transform(found, lambda w: F.element_at(of, w)))
    return F.when(F.size(found) > 0, F.get(F.array(*(F.lit(code) for _, code in COUNTRY_WORDS)), first))


def _level(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.contains("high"), "High").when(low.contains("medium") | low.contains("moderate"), "Medium").when(low.contains("low"), "Low")


def impact_level(classes: Column, title: Column, text: Column) -> Column:
    """The class string decides, then the icon's title, then the text."""
    return F.coalesce(_level(classes), _level(title), _level(text), F.lit("Unknown"))


def split_list(c: Column) -> Column:
    """Items between semicolons, each trimmed; NULL or '' to an empty array."""
    return F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(c, ";", -1), lambda x: F.trim(x)))


def credibility_tier(domain: Column, match: str = "substring") -> Column:
    """Tier 1, 2 or 3; ``match='domain'`` asks for the domain itself or a subdomain."""
    low = F.lower(F.coalesce(domain, F.lit("")))
    fits = (lambda d: low.contains(d)) if match == "substring" else (lambda d: (low == d) | low.endswith("." + d))
    any_of = lambda tier: [fits(d) for d in TIERS[tier]]
    return F.when(any_of(1)[0] | any_of(1)[1] | any_of(1)[2], 1).when(any_of(2)[0] | any_of(2)[1], 2).otherwise(3)


def without_noise(c: Column) -> Column:
    """Blank lines collapsed, known boilerplate out, ends trimmed."""
    out = F.regexp_replace(c, r"\n\s*\n", "\n\n")
    for pattern in NOISE:
        out = F.regexp_replace(out, f"(?is){pattern}", "")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def preview(c: Column, size: int = 80) -> Column:
    return F.substring(c, 1, size)


def absolute_url(href: Column, base: str) -> Column:
    """``href`` under ``base`` (scheme and host): absolute as it is, a path, query or fragment behind the host."""
    scheme = F.lit(base.partition("//")[0])
    joined = F.when(href.startswith("//"), F.concat(scheme, href)).when(href.rlike("^[/?#]") | (href == ""), F.concat(F.lit(base), href))
    return F.when(href.rlike("(?i)^[a-z][a-z0-9+.-]*:"), href).otherwise(joined.otherwise(F.concat(F.lit(base + "/"), href)))


def is_english_page(url: Column) -> Column:
    return url.endswith(".en.html")
