"""Company text: split a section header, read a company from a heading, or
take the last line before the heading."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harrow.config import BATCH_SUFFIX_PATTERN, HEADING_COMPANY_PATTERN
from harrow.functions.regex import to_java
from harrow.functions.text import col_, collapse_ws, jstrim, lines


def split_company(raw) -> Column:
    """Header ``Name (S23) • context • more`` -> struct(company, context).

    Whitespace runs collapse to one space, the text splits on ``•``, the
    first part loses its batch suffix and defaults to ``Unknown``; the rest
    joins with `` • `` (so neighbouring spaces double, as the source does).
    """
    text = collapse_ws(F.coalesce(col_(raw), F.lit("")))
    parts = F.split(text, "•")
    name = jstrim(F.regexp_replace(F.get(parts, 0), f"(?i){to_java(BATCH_SUFFIX_PATTERN)}", ""))
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.struct(
        F.coalesce(F.when(name != "", name), F.lit("Unknown")).alias("company"),
        jstrim(F.array_join(rest, " • ")).alias("context"),
    )


def company_from_heading(h1) -> Column:
    """Text after the leftmost `` at `` in a heading, minus a batch suffix;
    '' when there is none."""
    return jstrim(F.regexp_extract(jstrim(F.coalesce(col_(h1), F.lit(""))),
                                   to_java(HEADING_COMPANY_PATTERN), 1))


def company_before_heading(body_text, heading) -> Column:
    """Last non-empty line of the text before the first occurrence of the
    heading, when the heading occurs after position 0 and the line differs
    from it; else ''."""
    body = col_(body_text)
    h = jstrim(F.coalesce(col_(heading), F.lit("")))
    pos = F.instr(body, h)  # 1-based, 0 when absent
    before = F.substring(body, F.lit(1), pos - 1)
    last = F.try_element_at(lines(jstrim(before)), F.lit(-1))
    ok = (h != "") & (pos > 1) & (F.size(lines(jstrim(before))) > 0) & (last != h)
    return F.when(ok, last).otherwise(F.lit(""))
