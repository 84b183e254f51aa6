"""Salary text: clean scraped salary strings and format numeric ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harrow.config import (NOT_LISTED, SALARY_DASH_PATTERN, SALARY_HOURLY_PATTERN,
                           SALARY_RANGE_PATTERN, SALARY_SINGLE_PATTERN)
from harrow.functions.regex import to_java
from harrow.functions.text import blank_to_null, col_, jstrim


def clean_salary(c) -> Column:
    """Scraped salary text -> ``$a/hr`` | ``$a - $b`` | ``$a`` | ``Not listed``.

    Hourly first (dashes normalised to `` - ``), then a range (both
    case-insensitive), then a single amount (case-sensitive, so ``$120k``
    keeps only ``$120``).
    """
    s = jstrim(col_(c))
    hourly = F.regexp_extract(s, f"(?i)({to_java(SALARY_HOURLY_PATTERN)})", 1)
    hourly = F.regexp_replace(hourly, to_java(SALARY_DASH_PATTERN), " - ")
    rng = f"(?i){to_java(SALARY_RANGE_PATTERN)}"
    low = F.regexp_extract(s, rng, 1)
    high = F.regexp_extract(s, rng, 2)
    ranged = F.when(low != "", F.concat(low, F.lit(" - "), high))
    single = F.regexp_extract(s, f"({to_java(SALARY_SINGLE_PATTERN)})", 1)
    return F.coalesce(blank_to_null(hourly), ranged, blank_to_null(single), F.lit(NOT_LISTED))


def _en_us(x: Column) -> Column:
    """``Number(x).toLocaleString('en-US')``: grouping, at most 3 decimals."""
    return F.call_function("format_number", x, F.lit("#,##0.###"))


def currency_symbol(cur, default_usd: bool = True) -> Column:
    """``$`` for USD (any case) or a missing currency, else ``CUR `` as given."""
    cur = col_(cur)
    is_usd = F.upper(cur) == "USD"
    missing = F.coalesce(cur, F.lit("")) == ""
    return F.when(missing | is_usd, F.lit("$")).otherwise(F.concat(cur, F.lit(" ")))


def format_range(min_v, max_v, symbol: Column) -> Column:
    """``min && max`` -> range; ``min`` -> ``min+``; ``max`` -> ``up to max``.

    Zero, NaN and null count as missing (JavaScript truthiness)."""
    lo = F.when(~F.isnan(col_(min_v)) & (col_(min_v) != 0), col_(min_v))
    hi = F.when(~F.isnan(col_(max_v)) & (col_(max_v) != 0), col_(max_v))
    return (F.when(lo.isNotNull() & hi.isNotNull(),
                   F.concat(symbol, _en_us(lo), F.lit(" - "), symbol, _en_us(hi)))
            .when(lo.isNotNull(), F.concat(symbol, _en_us(lo), F.lit("+")))
            .when(hi.isNotNull(), F.concat(F.lit("up to "), symbol, _en_us(hi))))


def salary_from_range(rng) -> Column:
    """Shape-B ``salaryRange {min, max, currency}`` -> salary text."""
    r = col_(rng)
    text = format_range(r["min"], r["max"], currency_symbol(r["currency"]))
    return F.when(r.isNull(), F.lit(NOT_LISTED)).otherwise(F.coalesce(text, F.lit(NOT_LISTED)))


def salary_from_compensation(comp) -> Column:
    """Shape-C compensation -> salary text.

    The first summary component (if any) supplies currency and bounds, else
    the top-level fields; both bounds are needed.  Otherwise a ``$a - $b``
    range (case-sensitive ``K``) is taken from the tier summary.
    """
    c = col_(comp)
    sc = F.get(c["summaryComponents"], 0)
    has_sc = sc.isNotNull()
    cur = F.upper(F.coalesce(blank_to_null(sc["currencyCode"]), blank_to_null(c["currency"]),
                             blank_to_null(c["currencyCode"]), F.lit("USD")))
    sym = F.when(cur == "USD", F.lit("$")).otherwise(F.concat(cur, F.lit(" ")))
    min_v = F.when(has_sc, sc["minValue"]).otherwise(c["minValue"])
    max_v = F.when(has_sc, sc["maxValue"]).otherwise(c["maxValue"])
    lo = F.when(~F.isnan(min_v) & (min_v != 0), min_v)
    hi = F.when(~F.isnan(max_v) & (max_v != 0), max_v)
    both = F.when(lo.isNotNull() & hi.isNotNull(),
                  F.concat(sym, _en_us(lo), F.lit(" - "), sym, _en_us(hi)))
    tier = c["compensationTierSummary"]
    pat = to_java(SALARY_RANGE_PATTERN)
    t_lo = F.regexp_extract(F.coalesce(tier, F.lit("")), pat, 1)
    t_hi = F.regexp_extract(F.coalesce(tier, F.lit("")), pat, 2)
    from_tier = F.when(t_lo != "", F.concat(t_lo, F.lit(" - "), t_hi))
    return F.when(c.isNull(), F.lit(NOT_LISTED)).otherwise(
        F.coalesce(both, from_tier, F.lit(NOT_LISTED)))
