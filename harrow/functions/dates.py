"""Posted-date text: read it by property type and repair sentinels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harrow.config import KNOWN_BAD_FALLBACK_DATE, NOT_POSTED
from harrow.functions.text import col_, jstrim


def utc_day(ts) -> Column:
    """``created_time.split('T')[0]`` for a timestamp: its UTC calendar day
    (the session time zone is UTC)."""
    return F.date_format(col_(ts), "yyyy-MM-dd")


def posted_text(prop) -> Column:
    """A typed cell struct(type, date STRUCT<start>, rich_text ARRAY<STRUCT<plain_text>>)
    -> text: date start, or joined rich text trimmed, else ``Not Posted``."""
    p = col_(prop)
    rich = jstrim(F.array_join(F.transform(p["rich_text"],
                                           lambda r: F.coalesce(r["plain_text"], F.lit(""))), ""))
    return (F.when(p.isNull(), F.lit(NOT_POSTED))
            .when(p["type"] == "date", F.coalesce(F.when(p["date"]["start"] != "", p["date"]["start"]),
                                                  F.lit(NOT_POSTED)))
            .when(p["type"] == "rich_text", F.coalesce(F.when(rich != "", rich), F.lit(NOT_POSTED)))
            .otherwise(F.lit(NOT_POSTED)))


def normalize_posted(posted, created_day, bad_day: str = KNOWN_BAD_FALLBACK_DATE) -> Column:
    """Blank, ``Not listed`` and ``Not Posted`` -> ``Not Posted``; the known
    bad fallback day -> ``Not Posted`` only when the row was created that same
    day; anything else unchanged."""
    p = col_(posted)
    blank = F.coalesce(p, F.lit("")).isin("", "Not listed", NOT_POSTED)
    fake = (p == bad_day) & (col_(created_day) == bad_day)
    return F.when(blank | F.coalesce(fake, F.lit(False)), F.lit(NOT_POSTED)).otherwise(p)
