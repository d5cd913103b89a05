"""Landed web pages: text, links, metadata, listings and calendar tables."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.classify import fed_speaker
from tidemark.functions.text import absolute_url, blank_to_null, clean_value, impact_level, is_english_page, without_noise
from tidemark.functions.times import header_date, url_date, us_date
from tidemark.operators import elements as el

_DROPPED = r"(?is)<(script|style|nav|header|footer)\b[^>]*>.*?</\1\s*>"
_ANCHOR = r"(?is)<a\b[^>]*?href=\"([^\"]*)\"[^>]*>(.*?)</a>"


@dataclass(frozen=True)
class Profile:
    """What to drop, where to look for the main text, how long it must be there, and where to look last (``*``: all text).

    A selector is a tag with classes or an id: ``div.a.b``, ``main#c``; behind ``.~`` or ``#~`` stands a pattern
    that one class or the id must contain.
    """

    drop: tuple[str, ...] = ("script", "style", "nav", "header", "footer")
    drop_classes: tuple[str, ...] = ()
    selectors: tuple[str, ...] = ("main", "article", "div.content")
    longer_than: int = 100
    last: str = "body"
    clean: bool = False


_BOE_DROP = ("script", "style", "nav", "header", "footer", "aside", "form", "button")
_BOE_NOISE = ("cookie-notice", "nav-bypass", "global-header", "global-footer", "page-survey", "accordion", "pdf-button", "footer-social-bank", "footer-topics")
#: The page layouts of the sources, in the order in which places are tried.
PROFILES = {
    "ecb": Profile(selectors=("div.~content|article|body", "article", "main", "div#~content|article")),
    "fed": Profile(selectors=("article", "main", "div.col-xs-12", "div#article", "div.row"), last="*"),
    "fed_feed": Profile(drop=("script", "style", "nav", "header", "footer", "aside"), selectors=("div#article", "div.col-xs-12.col-sm-8.col-md-8", "div.row", "article", "main", "div#content", "body"), longer_than=200, clean=True),
    "boe": Profile(_BOE_DROP, _BOE_NOISE, ("div.page-content", "section.page-section", "div.accordion-content", "article", "main#main-content", "body"), 200),
    "boe_sitemap": Profile(_BOE_DROP, _BOE_NOISE, ("div.content-block", "div.page-content", "section.page-section", "div.accordion-content", "article", "main#main-content", "body"), 200),
}


def _matcher(selector: str) -> Callable[[Column], Column]:
    tag, sign, rest = re.fullmatch(r"([a-z0-9]+|\*)(\.~|#~|\.|#)?(.*)", selector).groups()
    kinds: dict[str | None, Callable[[Column], Column]] = {
        None: lambda e: F.lit(True),
        ".~": lambda e: F.exists(el.classes(e), lambda c: c.rlike(rest)),
        "#~": lambda e: F.coalesce(e["id"], F.lit("")).rlike(rest),
        "#": lambda e: F.coalesce(e["id"] == rest, F.lit(False)),
        ".": lambda e: el.has_class(e, *rest.split(".")),
    }
    return lambda e: (e["tag"] == tag) & kinds[sign](e)


def shown_text(page: Column, profile: Profile = Profile()) -> Column:
    """A parsed page's main text: of the first element that fits a selector and holds enough text, selector by selector, else of the last resort."""
    dropped = F.filter(page["elements"], lambda e: e["tag"].isin(*profile.drop) | (F.arrays_overlap(el.classes(e), F.array(*map(F.lit, profile.drop_classes))) if profile.drop_classes else F.lit(False)))
    gone = lambda e: F.exists(dropped, lambda d: (d["at"] <= e["at"]) & (e["at"] <= d["last"]))
    left = F.transform(page["texts"], lambda t, k: F.when(~F.exists(dropped, lambda d: (d["t0"] <= k) & (k < d["t1"])), t))

    def of(selector: str) -> Column:
        fits = _matcher(selector)
        e = el.first(page["elements"], lambda e: fits(e) & ~gone(e))
        return F.array_join(F.slice(left, e["t0"] + 1, e["t1"] - e["t0"]), "\n")

    enough = [F.when(F.length(of(s)) > profile.longer_than, of(s)) for s in profile.selectors]
    rest = F.array_join(left, "\n")
    return F.coalesce(*enough, rest if profile.last == "*" else blank_to_null(of(profile.last)), rest)


def main_text(pages: DataFrame, key: str, html: str, profile: Profile = Profile()) -> DataFrame:
    """key, text: the page's main text."""
    found = pages.select(key, el.parsed(html).alias("_page")).select(key, shown_text(F.col("_page"), profile).alias("text"))
    return found.withColumn("text", without_noise(F.col("text"))) if profile.clean else found


def plain_text(html: Column) -> Column:
    """Text without tags by patterns alone: dropped elements, then tags, then runs of white space."""
    bare = F.regexp_replace(F.regexp_replace(html, _DROPPED, " "), r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def links(pages: DataFrame, key: str, html: str, base: str, pattern: str = ".") -> DataFrame:
    """key, position, url, anchor: links whose href fits ``pattern``."""
    found = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(_ANCHOR), F.lit(0))).alias("position", "_a"))
    href, text = F.regexp_extract("_a", _ANCHOR, 1), F.regexp_extract("_a", _ANCHOR, 2)
    anchor = F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", " "), r"\s+", " "))
    return found.select(key, "position", href.alias("href"), anchor.alias("anchor")).where(F.col("href").rlike(pattern)).select(key, "position", absolute_url(F.col("href"), base).alias("url"), "anchor")


@dataclass(frozen=True)
class Section:
    """An archive section: what its article links look like, and their kind."""

    name: str
    pattern: str
    category: str


#: Archive sections.
SECTIONS = (
    Section("speeches", r"/press/key/date/\d{4}/html/", "speeches"),
    Section("press_releases", r"/press/pr/date/\d{4}/html/", "pressreleases"),
    Section("press_conferences", r"/press/press_conference/monetary-policy-statement/\d{4}/html/", "policy"),
    Section("monetary_policy_accounts", r"/press/accounts/\d{4}/html/", "policy"),
)
def article_links(pages: DataFrame, key: str, html: str, base: str, sections: tuple[Section, ...] = SECTIONS, start: str | None = None, end: str | None = None) -> DataFrame:
    """key, position, section, url, title, date_hint, category of a page's English article links.

    A link belongs to the first section whose pattern its href contains.  The title is the link's text, else all that of
    the nearest div, li or span around it; the date comes from the URL, and links without one pass the date filter.
    """
    page = F.col("_page")

    def link(e: Column) -> Column:
        blocks = F.filter(F.slice(page["elements"], 1, e["at"]), lambda b: b["tag"].isin("div", "li", "span") & (b["last"] >= e["at"]))
        shown = F.coalesce(blank_to_null(el.text(page, e)), el.text(page, F.try_element_at(blocks, F.lit(-1))), F.lit(""))
        return F.struct(e["ref"].alias("href"), shown.alias("title"))

    # only links of a section are looked at closer
    wanted = F.filter(page["elements"], lambda e: (e["tag"] == "a") & F.coalesce(e["ref"].rlike("|".join(s.pattern for s in sections)), F.lit(False)))
    found = pages.select(key, el.parsed(html).alias("_page")).select(key, F.posexplode(F.transform(wanted, link)).alias("position", "_a")).select(key, "position", "_a.*")
    of = F.coalesce(*(F.when(F.col("href").rlike(s.pattern), F.lit(k)) for k, s in enumerate(sections)))
    found = found.withColumns({"_s": of, "url": absolute_url(F.col("href"), base)})
    found = found.where(F.col("_s").isNotNull() & is_english_page(F.col("url"))).withColumn("date_hint", url_date(F.col("url")))
    for bound, op in ((start, ">="), (end, "<=")):
        if bound is not None:
            found = found.where(f"date_hint is null or date_hint {op} date'{bound}'")
    name = lambda f: F.array(*(F.lit(f(s)) for s in sections))[F.col("_s")]
    return found.select(key, "position", name(lambda s: s.name).alias("section"), "url", "title", "date_hint", name(lambda s: s.category).alias("category"))


def metadata(html: Column) -> dict[str, Column]:
    """title, h1, author, published, shown_date as columns, of HTML or of a page that is parsed already; '' where the page lacks one."""
    return page_metadata(el.parsed(html))


def page_metadata(page: Column) -> dict[str, Column]:
    every = page["elements"]
    shown = lambda test: F.coalesce(el.text(page, el.first(every, test)), F.lit(""))
    meta = lambda n: F.btrim(F.coalesce(el.first(every, lambda e: (e["tag"] == "meta") & F.array_contains(F.split(e["label"], " "), n))["ref"], F.lit("")), F.lit(" \t\n\r"))
    return {
        "title": shown(lambda e: e["tag"] == "title"),
        "h1": shown(lambda e: e["tag"] == "h1"),
        "author": meta("author"),
        "published": F.coalesce(*(blank_to_null(meta(n)) for n in ("article:published_time", "pubdate", "datePublished")), F.lit("")),
        "shown_date": shown(lambda e: (e["tag"] == "div") & el.has_class(e, "published-date")),
    }


def link_statistics(found: DataFrame, section: str, day: str) -> DataFrame:
    return found.groupBy(section).agg(F.count("*").alias("n_links"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))


#: How a calendar's table is known, best first.
_CALENDAR: tuple[Callable[[Column], Column], ...] = (lambda e: e["class"].contains("calendar__table"), lambda e: e["id"] == "calendar_table", lambda e: e["class"].contains("calendar"))
#: Places of a row's cells: time, currency, impact, event, detail, actual, forecast, previous.  A row that opens
#: a block of one time has the date before them.
_PLACES = {False: (0, 1, 2, 3, 5, 6, 7, 8), True: (1, 2, 3, 4, 6, 7, 8, 9)}


def _calendar_table(page: Column) -> Column:
    def of(known: Callable[[Column], Column]) -> Column:
        return el.first(page["elements"], lambda e: (e["tag"] == "table") & F.coalesce(known(e), F.lit(False)))

    return F.coalesce(*map(of, _CALENDAR))


def _row_class(tr: Column) -> Column:
    return F.lower(F.coalesce(tr["class"], F.lit("")))


def _dated(tr: Column) -> Column:
    return _row_class(tr).rlike("date|day-breaker|day_breaker")


def _day(page: Column, tr: Column, year: int) -> Column:
    spans = F.filter(el.inside(page, tr), lambda e: e["tag"] == "span")
    own = F.coalesce(el.first(spans, lambda e: e["class"].contains("date")), F.get(spans, 0))
    return F.struct(tr["at"].alias("at"), header_date(el.text(page, own), year).alias("day"))


def _event_cells(page: Column, tr: Column, k: Column) -> Column:
    """The cells of an event row that are its own, NULL for other rows."""
    named = F.exists(F.split(_row_class(tr), r"\s+"), lambda c: c.contains("calendar") & c.contains("row")) & ~_row_class(tr).contains("head") & ~_dated(tr)
    tds = F.filter(el.inside(page, tr), lambda e: (e["tag"] == "td") & (e["up"] == tr["at"]))
    return F.when(named, F.struct(tr["at"].alias("at"), k.alias("position"), tds.alias("tds")))


def _event(page: Column, r: Column, days: Column) -> Column:
    tds = r["tds"]
    td = lambda k: F.get(tds, F.when(F.size(tds) >= 11, _PLACES[True][k]).otherwise(_PLACES[False][k]))
    shown = lambda k: F.coalesce(el.text(page, td(k)), F.lit(""))
    icon = el.first(el.inside(page, td(2)), lambda e: e["tag"].isin("span", "i", "div"))
    link = el.first(el.inside(page, td(4)), lambda e: e["tag"] == "a")
    impact = F.struct(F.coalesce(td(2)["class"], F.lit("")).alias("class"), F.coalesce(icon["label"], F.lit("")).alias("title"), shown(2).alias("text"))
    day = F.try_element_at(F.filter(days, lambda d: d["at"] < r["at"]), F.lit(-1))["day"]
    fields = {"time": 0, "currency": 1, "event": 3, "actual": 5, "forecast": 6, "previous": 7}
    return F.struct(r["position"].alias("position"), day.alias("day"), impact.alias("impact"), link["ref"].alias("href"), *(shown(k).alias(n) for n, k in fields.items()))


def calendar_rows(pages: DataFrame, key: str, html: str, base: str, year: int) -> DataFrame:
    """Event rows of calendar tables, by key and position, with the day that the last date row above them set.

    A row has the cells that are its own: a table inside a cell is text of that cell.  ``year`` completes day headers
    without one.  Rows before the first date, header rows, rows of fewer than eight cells and rows without an event's
    name go.  A page is parsed once and its rows, days included, come out of that; nothing is shuffled.
    """
    page, table, trs, days = (F.col(c) for c in ("_page", "_table", "_trs", "_days"))
    tr = lambda e: e["tag"] == "tr"
    once = pages.select(key, el.parsed(html).alias("_page")).withColumn("_table", _calendar_table(page))
    once = once.select(key, "_page", F.filter(F.when(table.isNull(), page["elements"]).otherwise(el.inside(page, table)), tr).alias("_trs"))
    dated = F.filter(F.transform(F.filter(trs, _dated), lambda x: _day(page, x, year)), lambda d: d["day"].isNotNull())
    once = once.select(key, "_page", dated.alias("_days"), F.filter(F.transform(trs, lambda x, k: _event_cells(page, x, k)), lambda r: r.isNotNull() & (F.size(r["tds"]) >= 8)).alias("_rows"))
    # days stand twice here, so that they are made before and not again for each row
    events = F.when(F.size(days) > 0, F.transform("_rows", lambda r: _event(page, r, days)))
    rows = once.select(key, F.explode(events).alias("_r")).select(key, "_r.*").where("day is not null and event <> ''")
    return rows.select(
        key, "position", "day", blank_to_null(F.col("time")).alias("time"), blank_to_null(F.col("currency")).alias("currency"), impact_level(F.col("impact.class"), F.col("impact.title"), F.col("impact.text")).alias("impact"), "event",
        absolute_url(blank_to_null(F.col("href")), base).alias("event_url"), *(clean_value(F.col(n)).alias(n) for n in ("actual", "forecast", "previous")),
    )


def listing_rows(pages: DataFrame, key: str, html: str, base: str) -> DataFrame:
    """Items of listing pages: key, position, date, url, title, category, speaker, location.

    An item is a ``row`` with a time and an event part, up to the next row; items without a readable date or a link go.
    """
    page = F.col("_page")
    rows = F.filter(page["elements"], lambda e: (e["tag"] == "div") & el.has_class(e, "row"))

    def parts(r: Column, k: Column) -> Column:
        end = F.least(r["last"], F.coalesce(F.get(F.col("_rows"), k + 1)["at"] - 1, r["last"]))
        own = F.slice(page["elements"], r["at"] + 2, end - r["at"])
        find = lambda name: el.first(own, lambda e: (e["tag"] == "div") & el.has_class(e, name))
        return F.struct(find("eventlist__time").alias("time"), find("eventlist__event").alias("event"))

    def item(r: Column) -> Column:
        event = el.inside(page, r["event"])
        tagged = lambda tag: el.first(event, lambda e: e["tag"] == tag)
        para = lambda name: el.first(event, lambda e: (e["tag"] == "p") & el.has_class(e, name))
        speaker = para("news__speaker")
        strong = el.first(el.inside(page, para("eventlist__press")), lambda e: e["tag"] == "strong")
        return F.struct(
            el.text(page, el.first(el.inside(page, r["time"]), lambda e: e["tag"] == "time")).alias("shown"), tagged("a")["ref"].alias("href"), tagged("a").isNotNull().alias("linked"), el.text(page, tagged("a")).alias("title"),
            el.text(page, strong).alias("category"), el.text(page, speaker).alias("speaker"), el.text(page, el.first(event, lambda e: (e["tag"] == "p") & (e["at"] == speaker["last"] + 1))).alias("location"),
        )

    once = pages.select(key, el.parsed(html).alias("_page")).select(key, "_page", rows.alias("_rows"))
    items = F.transform(F.transform("_rows", parts), lambda r: F.when(r["time"].isNotNull() & r["event"].isNotNull(), item(r)))
    found = once.select(key, F.posexplode(items).alias("position", "_i")).select(key, "position", "_i.*")
    out = found.select(
        key, "position", us_date(F.col("shown")).cast("date").alias("date"), "linked", absolute_url(F.col("href"), base).alias("url"), "title", F.coalesce(blank_to_null(F.col("category")), F.lit("other")).alias("category"),
        fed_speaker(blank_to_null(F.col("speaker"))).alias("speaker"), blank_to_null(F.col("location")).alias("location"),
    )
    return out.where("date is not null and linked").drop("linked")
