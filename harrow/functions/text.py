"""Column helpers for text: JavaScript-compatible trim and whitespace, tag
stripping, blunt substring tests, regex-any tests, haystacks, fingerprint.

All helpers return Columns built from Spark's built-in expressions so they
stay inside whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from harrow.functions.regex import any_of, js_space_run, js_trim_pattern, required_literals

# Above this many phrases an OR-chain is replaced by one ``exists`` over an
# array literal (same result, smaller generated code).
_OR_CHAIN_LIMIT = 64


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once.

    The value is the start of a reduction over nothing and ``body`` its finish,
    which hands it on as it is; a transform would copy what ``body`` gives, with
    every array in it, at each step.
    """
    return F.reduce(F.array().cast("array<int>"), value, lambda given, _: given, body)


def blank_to_null(c) -> Column:
    """JavaScript truthiness for strings: '' counts as missing."""
    c = col_(c)
    return F.when(c != "", c)


def or_default(c, default: str) -> Column:
    """``value || default`` for a string value."""
    return F.coalesce(blank_to_null(c), F.lit(default))


def jstrim(c) -> Column:
    """``String.prototype.trim``: strips every JavaScript whitespace char."""
    return F.regexp_replace(col_(c), js_trim_pattern(), "")


def collapse_ws(c) -> Column:
    """``replace(/\\s+/g, ' ').trim()``."""
    return jstrim(F.regexp_replace(col_(c), js_space_run(), " "))


def strip_tags(c) -> Column:
    """Replace every ``<...>`` tag by one space; no entity decoding."""
    return F.regexp_replace(col_(c), "<[^>]+>", " ")


def contains_any(c, phrases: Sequence[str], lowered: bool = False) -> Column:
    """Case-insensitive substring any-match (``list.some(p => s.includes(p))``).

    ``c`` is lower-cased once per row unless ``lowered``; the phrases are
    lower-cased once here.  An empty list never matches; a phrase ``''``
    always matches, as in JavaScript.
    """
    hay = col_(c) if lowered else F.lower(col_(c))
    low = list(dict.fromkeys(p.lower() for p in phrases))
    if not low:
        return F.lit(False)
    if len(low) > _OR_CHAIN_LIMIT:
        arr = F.array(*[F.lit(p) for p in low])
        return F.exists(arr, lambda p: F.instr(hay, p) > 0)
    out = hay.contains(low[0])
    for p in low[1:]:
        out = out | hay.contains(p)
    return out


def matches_any(c, patterns: Sequence[str], ignore_case: bool = True,
                low: Column | None = None) -> Column:
    """``patterns.some(p => p.test(s))`` for JavaScript-syntax patterns.

    Each pattern that has literals every match must contain is gated by a
    ``contains`` test of those literals on the lower-cased text (computed
    once per row), so only patterns that can match scan the text; the
    short-circuit OR of gated patterns has the same result as one
    alternation and avoids trying every alternative at every position.
    """
    c = col_(c)
    low = F.lower(c) if low is None else low
    gated: list[Column] = []
    plain: list[str] = []
    for p in patterns:
        req = required_literals(p) if ignore_case else None
        if req:
            gate = contains_any(low, req, lowered=True)
            gated.append(gate & c.rlike(any_of([p], ignore_case)))
        else:
            plain.append(p)
    parts = ([c.rlike(any_of(plain, ignore_case))] if plain else []) + gated
    if not parts:
        return c.rlike(any_of([], ignore_case))
    out = parts[0]
    for x in parts[1:]:
        out = out | x
    return F.when(c.isNull(), F.lit(None).cast("boolean")).otherwise(out)


def matches(c, pattern: str, ignore_case: bool = True) -> Column:
    return matches_any(c, [pattern], ignore_case)


def join_truthy(*cols, sep: str = "\n") -> Column:
    """``[a, b, ...].filter(Boolean).join(sep)``."""
    return F.concat_ws(sep, *[blank_to_null(c) for c in cols])


def filter_haystack(title="title", description="description",
                    card_text="card_text", company_context="company_context") -> Column:
    """Lower-cased text the tier filter searches (title, description, card
    text and company context)."""
    return F.lower(join_truthy(title, description, card_text, company_context))


def class_haystack(title="title", description="description",
                   card_text="card_text") -> Column:
    """Text the classifiers search (no company context)."""
    return join_truthy(title, description, card_text)


def fingerprint(company="company", title="title", location="location") -> Column:
    """SHA-256 hex of ``lower(trim(company))|lower(trim(title))|lower(trim(location))``,
    null treated as ''."""
    parts = [jstrim(F.lower(F.coalesce(col_(x), F.lit("")))) for x in (company, title, location)]
    return F.sha2(F.concat_ws("|", *parts), 256)


def lines(c) -> Column:
    """``text.split('\\n').map(trim).filter(Boolean)``."""
    return F.filter(F.transform(F.split(col_(c), "\n"), lambda s: jstrim(s)),
                    lambda s: s != "")


def first_line(c) -> Column:
    return F.substring_index(col_(c), "\n", 1)
