"""Employment-type and experience-level classifiers over the class haystack."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harrow.config import (ASSOCIATE_PATTERNS, ENTRY_LEVEL_PATTERNS, FULL_TIME_PATTERNS,
                           INTERNSHIP_PATTERNS, MID_LEVEL_PATTERNS, SENIOR_LEVEL_PATTERNS,
                           STAFF_PLUS_PATTERNS)
from harrow.functions.text import class_haystack, col_, matches_any


def level_flags(hay, low=None) -> dict[str, Column]:
    h = col_(hay)
    lists = {"internship": INTERNSHIP_PATTERNS, "full_time": FULL_TIME_PATTERNS,
             "entry": ENTRY_LEVEL_PATTERNS, "associate": ASSOCIATE_PATTERNS,
             "mid": MID_LEVEL_PATTERNS, "senior": SENIOR_LEVEL_PATTERNS,
             "staff": STAFF_PLUS_PATTERNS}
    return {k: matches_any(h, v, low=low) for k, v in lists.items()}


def employment_type(hay) -> Column:
    f = level_flags(hay)
    return (F.when(f["internship"], "Internship")
            .when(f["full_time"], "Full-Time")
            .otherwise("Unknown"))


def matched_levels(hay) -> Column:
    """How many of entry / associate / senior / mid matched (0-4)."""
    f = level_flags(hay)
    return (f["entry"].cast("int") + f["associate"].cast("int")
            + f["senior"].cast("int") + f["mid"].cast("int"))


def experience_level(hay) -> Column:
    """Internship first, then Staff+, then ``Unknown`` when more than one of
    the four ordinary levels matched, then the single match."""
    f = level_flags(hay)
    return (F.when(f["internship"], "Internship")
            .when(f["staff"], "Staff+")
            .when(matched_levels(hay) > 1, "Unknown")
            .when(f["entry"], "Entry Level")
            .when(f["associate"], "Associate")
            .when(f["senior"], "Senior")
            .when(f["mid"], "Mid Level")
            .otherwise("Unknown"))


def _from_flags(f) -> dict[str, Column]:
    n = (f["entry"].cast("int") + f["associate"].cast("int")
         + f["senior"].cast("int") + f["mid"].cast("int"))
    et = (F.when(f["internship"], "Internship").when(f["full_time"], "Full-Time")
          .otherwise("Unknown"))
    el = (F.when(f["internship"], "Internship").when(f["staff"], "Staff+")
          .when(n > 1, "Unknown").when(f["entry"], "Entry Level")
          .when(f["associate"], "Associate").when(f["senior"], "Senior")
          .when(f["mid"], "Mid Level").otherwise("Unknown"))
    return {"employment_type": et, "experience_level": el, "matched_levels": n}


def classify_hay(df, hay, with_count: bool = False):
    """Add the two classes for a haystack Column.

    The seven pattern flags (each a scan of the whole text) are packed into
    one integer in their own projection and both classes decode it with bit
    tests.  An integer, unlike a struct, is not re-inlined into every
    consumer by the optimizer, so each regex runs once per row.
    """
    # The haystack and its lower-cased form are columns of their own, so
    # every pattern gate reads them instead of rebuilding them.
    df = df.withColumn("_hay", hay).withColumn("_hay_low", F.lower("_hay"))
    flags = level_flags(F.col("_hay"), F.col("_hay_low"))
    names = list(flags)
    mask = None
    for i, k in enumerate(names):
        bit = F.when(flags[k], F.lit(1 << i)).otherwise(F.lit(0))
        mask = bit if mask is None else mask + bit
    tmp = df.withColumn("_class_mask", mask)
    f = {k: (F.col("_class_mask").bitwiseAND(1 << i) != 0) for i, k in enumerate(names)}
    out = _from_flags(f)
    if not with_count:
        out.pop("matched_levels")
    return tmp.withColumns(out).drop("_class_mask", "_hay", "_hay_low")


def classify(df, title="title", description="description", card_text="card_text"):
    """Add ``employment_type`` and ``experience_level`` to a listing frame."""
    hay = class_haystack(*(c if c in df.columns else F.lit(None).cast("string")
                           for c in (title, description, card_text)))
    return classify_hay(df, hay)
