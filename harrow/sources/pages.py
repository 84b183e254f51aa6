"""Scans over landed HTML pages ``(page_id, url, html)``.

There is no DOM here: structure is read with open-tag markers and regular
expressions, all evaluated inside each page row, so every scan is a narrow
``select`` + ``explode`` with no shuffle.  Markers are parameters with the
city-board and startup-board defaults; closing tags are never required
(landed pages often leave them unbalanced).

An element is its opening tag taken whole (attributes are then read one by
one, in any order) and everything up to the closing tag, with inner tags
stripped.  A fragment ends where the next one of its kind begins; nothing is
cut off the end of a page.

* :func:`link_scan`    every link whose href contains a marker, with the company
  of its container (S5).
* :func:`card_scan`    fragments that start at a card marker, with title, link,
  company, salary, location and card text read from each fragment (S4);
  pages without any card fall back to the link scan (S7).
* :func:`section_scan` rows that inherit the nearest company header above
  them (S6): the page is cut at header markers, so a row's section *is* its
  forward-filled header; pages without job rows fall back to detail links.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions.company import split_company
from harrow.functions.regex import to_java
from harrow.functions.text import collapse_ws, jstrim, or_default, strip_tags

# Group 1: attributes of the opening tag, group 2: content.
LINK_PATTERN = r"(?is)<a\b([^>]*)>(.*?)</a>"
HREF_PATTERN = r'(?i)\bhref="([^"]*)"'
# Elements without children whose text may be a company.
LEAF_PATTERN = r"(?i)<(?:span|p|a)\b[^>]*>([^<]+)</(?:span|p|a)>"
# A container opens here; a link belongs to the last one opened before it.
CONTAINER_PATTERN = r"(?i)<(?:li|article)\b[^>]*>|<div\b[^>]*\bdata-id=[^>]*>"
COMPANY_PATTERNS = (r'(?is)<([a-z0-9]+\b[^>]*\bdata-id="company-title"[^>]*)>(.*?)</',
                    r'(?is)<(a\b[^>]*\bhref="[^"]*/company/[^"]*"[^>]*)>(.*?)</a>')


def inner_text(markup: Column) -> Column:
    """Text of an element: inner tags vanish, ends are trimmed."""
    return jstrim(F.regexp_replace(markup, "<[^>]+>", ""))


def absolute_url(base: Column, href: Column) -> Column:
    """``href`` resolved against the page's URL, as a browser's ``link.href``.

    Absolute URLs stay; ``//host``, ``/path``, ``?query``, ``#part`` and
    relative paths take what they lack from ``base``.  Without a base, or
    without a href, the value stays as it is.
    """
    base = F.coalesce(base, F.lit(""))
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.regexp_extract(F.when(page == origin, F.concat(origin, F.lit("/"))).otherwise(page), r"^(.*/)", 1)
    return (F.when((href == "") | (origin == "") | href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
            .when(href.startswith("//"), F.concat(scheme, href))
            .when(href.startswith("/"), F.concat(origin, href))
            .when(href.startswith("?"), F.concat(page, href))
            .when(href.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), href))
            .otherwise(F.concat(folder, href)))


def links(html: Column) -> Column:
    """Array of struct(href, text) for every link, in document order."""
    attrs = F.regexp_extract_all(html, F.lit(LINK_PATTERN), 1)
    texts = F.regexp_extract_all(html, F.lit(LINK_PATTERN), 2)
    return F.zip_with(attrs, texts, lambda a, t: F.struct(
        F.regexp_extract(a, HREF_PATTERN, 1).alias("href"), inner_text(t).alias("text")))


def _company_in(fragment: Column) -> Column:
    """Text of the first company element of a fragment, '' without one."""
    found = [inner_text(F.regexp_extract(fragment, p, 2)) for p in COMPANY_PATTERNS]
    return F.coalesce(*[F.when(f != "", f) for f in found], F.lit(""))


def contained_links(html: Column) -> Column:
    """``links`` with the company of the container each one lies in.

    The page is cut where containers open, so a fragment holds a container's
    links up to the next container.
    """
    parts = F.split(html, CONTAINER_PATTERN)
    per_part = F.transform(parts, lambda part, i: F.transform(links(part), lambda l: F.struct(
        l["href"].alias("href"), l["text"].alias("text"),
        F.when(i > 0, _company_in(part)).otherwise(F.lit("")).alias("company"),
        F.when(i > 0, collapse_ws(strip_tags(part))).otherwise(l["text"]).alias("around"))))
    return F.flatten(per_part)


def _base(base_col: str | None) -> Column:
    return F.col(base_col) if base_col else F.lit("")


def link_scan(pages: DataFrame, href_contains: str = "/job/", location: str = "",
              page_col: str = "page_id", html_col: str = "html", base_col: str | None = None) -> DataFrame:
    """One row per matching link: (page_id, pos, title, href, company, location,
    salary, card_text).  Company is that of the link's container, else ``Unknown``."""
    arr = F.filter(contained_links(F.col(html_col)), lambda l: l["href"].contains(href_contains))
    base = _base(base_col)
    return (pages.select(page_col, base.alias("_base"), F.posexplode(arr).alias("pos", "l"))
            .select(page_col, "pos",
                    F.col("l.text").alias("title"),
                    absolute_url(F.col("_base"), F.col("l.href")).alias("href"),
                    or_default(F.col("l.company"), "Unknown").alias("company"),
                    F.lit(location).alias("location"),
                    F.lit("").alias("salary"),
                    F.col("l.around").alias("card_text")))


@dataclass(frozen=True)
class CardRules:
    """Regex rules for reading a card fragment (Java syntax).

    A title rule has the title element's attributes in group 1 and its content
    in group 2; rules are tried in their order.  Other rules have the value in
    group 1.
    """

    card_marker: str = (r'<[^>]*data-id="job-card"[^>]*>'
                        r'|<article\b[^>]*class="(?:[^"]*\s)?job-card(?:\s[^"]*)?"[^>]*>')
    titles: tuple[str, ...] = (
        r'(?is)<[a-z0-9]+\b([^>]*data-id="job-card-title"[^>]*)>(.*?)</(?:a|h[1-6])>',
        r"(?is)<h[23]\b[^>]*>\s*<a\b([^>]*)>(.*?)</a>",
        r'(?is)<a\b([^>]*href="[^"]*/job/[^"]*"[^>]*)>(.*?)</a>')
    company: str = r'(?is)<[^>]*data-id="company-title"[^>]*>(.*?)</'
    salary: str = r'<[^>]*class="[^"]*(?:salary|Salary|compensation)[^"]*"[^>]*>([^<]*)'
    location_leaf: str = r"<span[^>]*>([^<]*)</span>"
    location_like: str = r"remote|hybrid|in.office|TX|Austin"  # JavaScript syntax, /i
    link_href_contains: str = "/job/"
    location_no_cards: str = "Austin, TX"
    location_default: str = "Austin, TX"


def card_fields(fragment: Column, rules: CardRules) -> Column:
    """struct(title, href, company, salary, location, card_text) of one card."""
    title, href = F.lit(""), F.lit("")
    for rule in reversed(rules.titles):
        hit = fragment.rlike(rule)
        title = F.when(hit, inner_text(F.regexp_extract(fragment, rule, 2))).otherwise(title)
        href = F.when(hit, F.regexp_extract(F.regexp_extract(fragment, rule, 1), HREF_PATTERN, 1)).otherwise(href)
    runs = F.transform(F.regexp_extract_all(fragment, F.lit(LEAF_PATTERN), 1), jstrim)
    leaf = F.get(F.filter(runs, lambda r: (r != "") & (r != title)), 0)
    company = F.when(fragment.rlike(rules.company), inner_text(F.regexp_extract(fragment, rules.company, 1))).otherwise(
        F.coalesce(leaf, F.lit("Unknown")))
    spans = F.transform(F.regexp_extract_all(fragment, F.lit(rules.location_leaf), 1), jstrim)
    loc_pat = f"(?i:{to_java(rules.location_like)})"
    loc = F.get(F.filter(spans, lambda s: s.rlike(loc_pat)), 0)
    return F.struct(
        title.alias("title"),
        href.alias("href"),
        company.alias("company"),
        jstrim(F.regexp_extract(fragment, rules.salary, 1)).alias("salary"),
        F.coalesce(loc, F.lit(rules.location_default)).alias("location"),
        collapse_ws(strip_tags(fragment)).alias("card_text"),
    )


def card_scan(pages: DataFrame, rules: CardRules = CardRules(), page_col: str = "page_id",
              html_col: str = "html", carry: tuple[str, ...] = (), base_col: str | None = None) -> DataFrame:
    """Cards of every page, or its detail links when the page has no card.

    The page is split at ``card_marker``; element 0 (before the first card)
    is dropped and the last card runs to the end of the page.  Output
    columns: page_id, pos, title, href, company, salary, location, card_text,
    from_cards (plus the ``carry`` columns).
    """
    html = F.col(html_col)
    parts = F.split(html, rules.card_marker)
    cards = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    card_rows = F.transform(cards, lambda frag: F.struct(card_fields(frag, rules).alias("f"),
                                                         F.lit(True).alias("from_cards")))
    link_arr = F.filter(contained_links(html), lambda l: l["href"].contains(rules.link_href_contains))
    link_rows = F.transform(link_arr, lambda l: F.struct(
        F.struct(l["text"].alias("title"), l["href"].alias("href"),
                 or_default(l["company"], "Unknown").alias("company"), F.lit("").alias("salary"),
                 F.lit(rules.location_no_cards).alias("location"),
                 l["around"].alias("card_text")).alias("f"),
        F.lit(False).alias("from_cards")))
    chosen = F.when(F.size(parts) > 1, card_rows).otherwise(link_rows)
    keep = [page_col, *carry]
    return (pages.select(*keep, _base(base_col).alias("_base"), F.posexplode(chosen).alias("pos", "c"))
            .select(*keep, "pos", "c.f.title", absolute_url(F.col("_base"), F.col("c.f.href")).alias("href"),
                    "c.f.company", "c.f.salary", "c.f.location", "c.f.card_text", "c.from_cards"))


@dataclass(frozen=True)
class SectionRules:
    """Regex rules of a page of company sections (Java syntax).

    ``header`` opens a section and its text up to the closing tag is the
    header; ``row`` opens a job row; ``title`` (attributes, content) is the
    row's title link; ``location`` and ``salary`` have the value in group 1;
    ``detail_link`` marks the links taken when a page has no row.
    """

    header: str = r'<a\b[^>]*href="[^"]*/companies/[^"]*"[^>]*>'
    row: str = r'<[^>]*class="[^"]*(?:JobRow|job-row)[^"]*"[^>]*>|<li\b[^>]*class="[^"]*job[^"]*"[^>]*>' \
               r'|<div\b[^>]*class="[^"]*job-listing[^"]*"[^>]*>'
    title: str = r'(?is)<a\b([^>]*href="[^"]*/jobs/[^"]*"[^>]*)>(.*?)</a>'
    location: str = r'<[^>]*class="[^"]*(?:location|remote)[^"]*"[^>]*>([^<]*)'
    salary: str = r'<[^>]*class="[^"]*(?:salary|compensation)[^"]*"[^>]*>([^<]*)'
    detail_link: str = r"/jobs/\d+"


def section_scan(pages: DataFrame, rules: SectionRules = SectionRules(), page_col: str = "page_id",
                 html_col: str = "html", carry: tuple[str, ...] = (), base_col: str | None = None) -> DataFrame:
    """Rows with the nearest company header above them.

    Cutting the page at headers makes each section start with its header
    text; a row's company is its section's header (the forward fill of the
    header down the page), passed through ``split_company``.  Rows before the
    first header have no company (``Unknown``).  A section is cut into rows at
    row markers; on a page without any row marker its detail links are the
    rows.  Output: page_id, section, pos, title, href, company,
    company_context, location, salary, card_text (plus ``carry``).
    """
    html = F.col(html_col)
    sections = F.split(html, rules.header)
    marked = html.rlike(rules.row)

    def rows_of(sec, idx):
        header = F.when(idx > 0, inner_text(F.regexp_extract(sec, r"(?is)^(.*?)</a>", 1))).otherwise(F.lit(""))
        parts = F.split(sec, rules.row)
        fragments = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
        rows = F.transform(fragments, lambda f: F.struct(
            inner_text(F.regexp_extract(f, rules.title, 2)).alias("title"),
            F.regexp_extract(F.regexp_extract(f, rules.title, 1), HREF_PATTERN, 1).alias("href"),
            jstrim(F.regexp_extract(f, rules.location, 1)).alias("location"),
            jstrim(F.regexp_extract(f, rules.salary, 1)).alias("salary"),
            collapse_ws(strip_tags(f)).alias("card_text")))
        bare = F.transform(F.filter(links(sec), lambda l: l["href"].rlike(rules.detail_link)), lambda l: F.struct(
            l["text"].alias("title"), l["href"].alias("href"), F.lit("").alias("location"),
            F.lit("").alias("salary"), l["text"].alias("card_text")))
        return F.struct(idx.alias("section"), header.alias("header"), F.when(marked, rows).otherwise(bare).alias("rows"))

    keep = [page_col, *carry]
    return (pages.select(*keep, _base(base_col).alias("_base"), F.explode(F.transform(sections, rows_of)).alias("s"))
            .select(*keep, "_base", "s.section", "s.header", F.posexplode("s.rows").alias("pos", "r"))
            .withColumn("sc", split_company(F.col("header")))
            .select(*keep, "section", "pos", "r.title",
                    absolute_url(F.col("_base"), F.col("r.href")).alias("href"),
                    F.col("sc.company").alias("company"), F.col("sc.context").alias("company_context"),
                    "r.location", "r.salary", "r.card_text"))
