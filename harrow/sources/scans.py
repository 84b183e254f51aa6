"""Listing rows of landed HTML pages, read by the extents of their elements.

Each scan is a narrow projection over ``(page_id, url, html)`` and explodes what it
finds; no shuffle, no UDF.  Elements, their texts and their ancestors come from
:mod:`harrow.sources.elements`, so a card, a row or a container ends at its own
closing tag, attributes may be quoted either way, and "the first element that
matches one of these" is the first in the document, whichever rule it matches.

* :func:`city_scan`     cards, or the detail links of a page without cards, with the
  company of the nearest container (S4, S5, S7).
* :func:`startup_scan`  job rows with the company inside the row, else of the nearest of
  at most six ancestors that holds a company link; on a page without rows its detail
  links, with title and location from the lines of the element around them (S5, S6).

:mod:`harrow.sources.pages` has the same scans by open-tag markers, for pages whose
closing tags cannot be relied on at all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions.company import split_company
from harrow.functions.regex import to_java
from harrow.functions.text import lines
from harrow.sources.elements import first_inside, inside, is_leaf, let, text_of, with_elements
from harrow.sources.pages import absolute_url


@dataclass(frozen=True)
class CityRules:
    """What differs between city boards; locations are JavaScript patterns (ignoring case)."""

    location_like: str = r"remote|hybrid|in.office|TX|Austin"
    location_no_cards: str = "Austin, TX"
    location_default: str = "Austin, TX"
    card_mark: str = "job-card"
    title_mark: str = "job-card-title"
    company_mark: str = "company-title"
    job_path: str = "/job/"
    company_path: str = "/company/"


@dataclass(frozen=True)
class StartupRules:
    row_classes: tuple[str, ...] = ("JobRow", "job-row")
    row_tags: tuple[tuple[str, str], ...] = (("li", "job"), ("div", "job-listing"))
    job_path: str = "/jobs/"
    detail_link: str = r"/jobs/\d+"
    company_path: str = "/companies/"
    company_classes: tuple[str, ...] = ("company", "startup")
    ancestors: int = 6


def _has_class(e: Column, name: str) -> Column:
    """Whether the class attribute lists this name."""
    return F.array_contains(F.split(e["cls"], r"[ \t\n\r\f]+"), name)


def _class_with(e: Column, *parts: str) -> Column:
    """Whether the class attribute contains one of these texts."""
    found = F.lit(False)
    for p in parts:
        found = found | e["cls"].contains(p)
    return found


def _under(e: Column, *names: str) -> Column:
    return F.exists(e["path"], lambda a: a["n"].isin(*names))


def _link(e: Column, path: str) -> Column:
    return (e["n"] == "a") & e["href"].contains(path)


def _text(e: Column) -> Column:
    """Text of an element, null without one."""
    return let(e, lambda v: F.when(v.isNotNull(), text_of(v)))


def _box_of(e: Column, fits) -> Column:
    """(i, ends) of the nearest ancestor that fits, else of the parent, else of the page.

    ``fits`` is a predicate on an ancestor's (i, n).
    """
    def box(chosen: Column) -> Column:
        ends = F.get(F.filter("_elements", lambda x: x["i"] == chosen["i"]), 0)["ends"]
        return F.struct(F.coalesce(chosen["i"], F.lit(0)).alias("i"), F.coalesce(ends, F.col("_end")).alias("ends"))

    return let(F.coalesce(F.get(F.filter(e["path"], fits), 0), F.get(e["path"], 0)), box)


def _prepared(pages: DataFrame, html_col: str, page_col: str, carry: tuple[str, ...], base_col: str | None) -> DataFrame:
    base = F.col(base_col) if base_col else F.lit("")
    return with_elements(pages.select(page_col, *carry, base.alias("_base"), F.col(html_col).alias("html")), "html").drop("html")


def city_scan(pages: DataFrame, rules: CityRules = CityRules(), page_col: str = "page_id", html_col: str = "html",
              carry: tuple[str, ...] = (), base_col: str | None = None) -> DataFrame:
    """page_id, pos, title, href, company, salary, location, card_text, from_cards (and ``carry``)."""
    p = _prepared(pages, html_col, page_col, carry, base_col)
    e = F.col("_elements")
    p = p.withColumns({
        "_cards": F.filter(e, lambda x: (x["mark"] == rules.card_mark) | ((x["n"] == "article") & _has_class(x, "job-card"))),
        "_companies": F.filter(e, lambda x: x["mark"] == rules.company_mark),
        "_around": F.filter(e, lambda x: (x["mark"] == rules.company_mark) | _link(x, rules.company_path)),
        "_boxes": F.transform(F.filter(e, lambda x: x["n"].isin("li", "article") | (
            (x["n"] == "div") & x["tag"].rlike(r"(?i)\sdata-id\b"))), lambda x: x["i"])})
    in_cards = F.size("_cards") > 0
    # What cards are searched for, and the links of a page without cards: nothing of it is built for the other kind.
    p = p.withColumns({
        "_titles": F.when(in_cards, F.filter(e, lambda x: (x["mark"] == rules.title_mark) | _link(x, rules.job_path) | (
            (x["n"] == "a") & _under(x, "h2", "h3")))),
        "_salaries": F.when(in_cards, F.filter(e, lambda x: _class_with(x, "salary", "Salary", "compensation"))),
        "_leaves": F.when(in_cards, F.transform(F.filter(e, lambda x: x["n"].isin("span", "p", "a") & is_leaf(x)),
                                                lambda x: F.struct(x["i"], x["n"], x["ends"], text_of(x).alias("text")))),
        "_links": F.when(~in_cards, F.filter(e, lambda x: _link(x, rules.job_path)))})
    like = f"(?i:{to_java(rules.location_like)})"

    def card(c: Column) -> Column:
        def fields(title: Column, text: Column, leaves: Column) -> Column:
            where = F.get(F.filter(leaves, lambda x: (x["n"] == "span") & x["text"].rlike(like)), 0)["text"]
            other = F.get(F.filter(leaves, lambda x: (x["text"] != "") & (x["text"] != text)), 0)["text"]
            return F.struct(
                text.alias("title"), F.when(title["n"] == "a", title["href"]).otherwise(F.lit("")).alias("href"),
                F.coalesce(_text(first_inside(F.col("_companies"), c)), other, F.lit("Unknown")).alias("company"),
                F.coalesce(_text(first_inside(F.col("_salaries"), c)), F.lit("")).alias("salary"),
                F.coalesce(where, F.lit(rules.location_default)).alias("location"), text_of(c).alias("card_text"),
                F.lit(True).alias("from_cards"))

        return let(first_inside(F.col("_titles"), c), lambda title: let(
            F.coalesce(_text(title), F.lit("")), lambda text: let(
                inside(F.col("_leaves"), c), lambda leaves: fields(title, text, leaves))))

    def link(x: Column) -> Column:
        return let(_box_of(x, lambda a: F.array_contains("_boxes", a["i"])), lambda box: F.struct(
            text_of(x).alias("title"), x["href"].alias("href"),
            F.coalesce(_text(first_inside(F.col("_around"), box)), F.lit("Unknown")).alias("company"), F.lit("").alias("salary"),
            F.lit(rules.location_no_cards).alias("location"), text_of(box).alias("card_text"), F.lit(False).alias("from_cards")))

    found = F.when(in_cards, F.transform("_cards", card)).otherwise(F.transform("_links", link))
    keep = [page_col, *carry]
    return (p.select(*keep, "_base", F.posexplode(found).alias("pos", "c"))
            .select(*keep, "pos", "c.title", absolute_url(F.col("_base"), F.col("c.href")).alias("href"), "c.company",
                    "c.salary", "c.location", "c.card_text", "c.from_cards"))


def startup_scan(pages: DataFrame, rules: StartupRules = StartupRules(), page_col: str = "page_id", html_col: str = "html",
                 carry: tuple[str, ...] = (), base_col: str | None = None) -> DataFrame:
    """page_id, pos, title, href, company, company_context, location, salary, card_text, from_rows (and ``carry``)."""
    p = _prepared(pages, html_col, page_col, carry, base_col)
    e = F.col("_elements")

    def is_row(x: Column) -> Column:
        hit = _class_with(x, *rules.row_classes)
        for name, part in rules.row_tags:
            hit = hit | ((x["n"] == name) & x["cls"].contains(part))
        return hit

    p = p.withColumns({
        "_rows": F.filter(e, is_row),
        "_jobs": F.filter(e, lambda x: _link(x, rules.job_path)),
        "_firms": F.filter(e, lambda x: _link(x, rules.company_path)),
        "_named": F.filter(e, lambda x: _link(x, rules.company_path) | _class_with(x, *rules.company_classes))})
    marked = F.size("_rows") > 0
    p = p.withColumns({
        "_titles": F.when(marked, F.filter(e, lambda x: _link(x, rules.job_path) | x["n"].isin("h2", "h3") | _class_with(x, "title"))),
        "_places": F.when(marked, F.filter(e, lambda x: _class_with(x, "location", "remote"))),
        "_salaries": F.when(marked, F.filter(e, lambda x: _class_with(x, "salary", "compensation")))})

    def company(box: Column, path: Column) -> Column:
        """Company inside the box, else the first company link of the nearest ancestor that has one."""
        walls = F.transform(path, lambda a: a["n"].isin("main", "body"))
        up = F.when(F.array_contains(walls, True), F.array_position(walls, True).cast("int") - 1).otherwise(F.size(path))
        near = F.slice(path, 1, F.least(up, F.lit(rules.ancestors)))

        def above(ancestors: Column) -> Column:
            within = lambda i: F.filter("_firms", lambda f: F.exists(f["path"], lambda o: o["i"] == i))
            firms = F.transform(ancestors, lambda a: F.get(within(a["i"]), 0))
            return _text(F.get(F.filter(firms, lambda f: f.isNotNull()), 0))

        return F.coalesce(_text(first_inside(F.col("_named"), box)), let(near, above), F.lit(""))

    def row(r: Column) -> Column:
        return let(first_inside(F.col("_titles"), r), lambda title: let(
            F.coalesce(first_inside(F.col("_jobs"), r), title), lambda link: F.struct(
                F.coalesce(_text(title), F.lit("")).alias("title"),
                F.when(link["n"] == "a", link["href"]).otherwise(F.lit("")).alias("href"), company(r, r["path"]).alias("header"),
                F.coalesce(_text(first_inside(F.col("_places"), r)), F.lit("")).alias("location"),
                F.coalesce(_text(first_inside(F.col("_salaries"), r)), F.lit("")).alias("salary"),
                text_of(r).alias("card_text"), F.lit(True).alias("from_rows"))))

    def bare(x: Column) -> Column:
        def fields(box: Column, text: Column, parts: Column) -> Column:
            above = F.filter(x["path"], lambda a: a["i"] < box["i"])  # the ancestors of the box
            return F.struct(
                F.coalesce(F.get(parts, 0), text_of(x)).alias("title"), x["href"].alias("href"), company(box, above).alias("header"),
                F.coalesce(F.get(parts, 2), F.lit("")).alias("location"), F.lit("").alias("salary"), text.alias("card_text"),
                F.lit(False).alias("from_rows"))

        return let(_box_of(x, lambda a: a["n"].isin("div", "li", "article")), lambda box: let(
            text_of(box), lambda text: let(lines(text), lambda parts: fields(box, text, parts))))

    details = F.filter("_jobs", lambda x: absolute_url(F.col("_base"), x["href"]).rlike(rules.detail_link))
    found = F.when(marked, F.transform("_rows", row)).otherwise(F.transform(details, bare))
    keep = [page_col, *carry]
    return (p.select(*keep, "_base", F.posexplode(found).alias("pos", "c"))
            .withColumn("_firm", split_company(F.col("c.header")))
            .select(*keep, "pos", "c.title", absolute_url(F.col("_base"), F.col("c.href")).alias("href"),
                    F.col("_firm.company").alias("company"), F.col("_firm.context").alias("company_context"),
                    "c.location", "c.salary", "c.card_text", "c.from_rows"))

