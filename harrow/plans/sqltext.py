"""SQL text (DuckDB dialect) for the correctness oracles.

These helpers state the same rules as the Column helpers, in SQL, so each
registered query has an independent statement of its answer.  They are used
only to build oracle strings; nothing here runs on Spark.
"""

from __future__ import annotations

from collections.abc import Sequence

from harrow.config import (ASSOCIATE_PATTERNS, ENTRY_LEVEL_PATTERNS, FULL_TIME_PATTERNS,
                           INTERNSHIP_PATTERNS, MID_LEVEL_PATTERNS, SENIOR_LEVEL_PATTERNS,
                           STAFF_PLUS_PATTERNS, CurationConfig)
from harrow.functions.regex import any_of, js_space_run, js_trim_pattern, to_re2


def q(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def nz(e: str) -> str:
    return f"coalesce({e}, '')"


def truthy(e: str) -> str:
    """NULL when '' (JavaScript truthiness)."""
    return f"nullif({e}, '')"


def jstrim(e: str) -> str:
    return f"regexp_replace({e}, {q(js_trim_pattern('re2'))}, '', 'g')"


def collapse(e: str) -> str:
    return jstrim(f"regexp_replace({e}, {q(js_space_run('re2'))}, ' ', 'g')")


def strip_tags(e: str) -> str:
    return f"regexp_replace({e}, '<[^>]+>', ' ', 'g')"


def contains_any(e_lower: str, phrases: Sequence[str]) -> str:
    low = list(dict.fromkeys(p.lower() for p in phrases))
    if not low:
        return "false"
    return "(" + " OR ".join(f"contains({e_lower}, {q(p)})" for p in low) + ")"


def rlike_any(e: str, patterns: Sequence[str], ignore_case: bool = True) -> str:
    return f"regexp_matches({e}, {q(any_of(patterns, ignore_case, dialect='re2'))})"


def rlike(e: str, pattern: str, ignore_case: bool = True) -> str:
    return rlike_any(e, [pattern], ignore_case)


def join_truthy(*exprs: str, sep: str = "chr(10)") -> str:
    return f"concat_ws({sep}, {', '.join(truthy(e) for e in exprs)})"


def fingerprint(company: str, title: str, location: str) -> str:
    parts = [jstrim(f"lower({nz(x)})") for x in (company, title, location)]
    return f"sha256(concat_ws('|', {', '.join(parts)}))"


def failed_tier(cfg: CurationConfig, title: str, description: str = "NULL",
                card_text: str = "NULL", context: str = "NULL", location: str = "NULL") -> str:
    t = f"lower({nz(title)})"
    loc = f"lower({nz(location)})"
    text = f"lower({join_truthy(title, description, card_text, context)})"
    t1 = f"({contains_any(t, cfg.blocked_job_titles)} OR NOT {contains_any(t, cfg.job_titles)})"
    t2 = f"({text} <> '' AND NOT {contains_any(text, cfg.keywords)})"
    t3 = f"({text} <> '' AND {contains_any(text, cfg.exclude_keywords)})"
    if cfg.preferred_locations:
        t4 = (f"NOT ({loc} = '' OR contains({loc}, 'remote') OR "
              f"{contains_any(loc, cfg.preferred_locations)})")
    else:
        t4 = "false"
    return (f"CASE WHEN {t1} THEN 1 WHEN {t2} THEN 2 WHEN {t3} THEN 3 WHEN {t4} THEN 4 "
            f"ELSE NULL END")


def class_flags(hay: str) -> dict[str, str]:
    return {
        "internship": rlike_any(hay, INTERNSHIP_PATTERNS),
        "full_time": rlike_any(hay, FULL_TIME_PATTERNS),
        "entry": rlike_any(hay, ENTRY_LEVEL_PATTERNS),
        "associate": rlike_any(hay, ASSOCIATE_PATTERNS),
        "mid": rlike_any(hay, MID_LEVEL_PATTERNS),
        "senior": rlike_any(hay, SENIOR_LEVEL_PATTERNS),
        "staff": rlike_any(hay, STAFF_PLUS_PATTERNS),
    }


def employment_type(hay: str) -> str:
    f = class_flags(hay)
    return (f"CASE WHEN {f['internship']} THEN 'Internship' WHEN {f['full_time']} "
            f"THEN 'Full-Time' ELSE 'Unknown' END")


def matched_levels(hay: str) -> str:
    f = class_flags(hay)
    return " + ".join(f"CAST({f[k]} AS INTEGER)" for k in ("entry", "associate", "senior", "mid"))


def experience_level(hay: str) -> str:
    f = class_flags(hay)
    return (f"CASE WHEN {f['internship']} THEN 'Internship' WHEN {f['staff']} THEN 'Staff+' "
            f"WHEN ({matched_levels(hay)}) > 1 THEN 'Unknown' "
            f"WHEN {f['entry']} THEN 'Entry Level' WHEN {f['associate']} THEN 'Associate' "
            f"WHEN {f['senior']} THEN 'Senior' WHEN {f['mid']} THEN 'Mid Level' "
            f"ELSE 'Unknown' END")


def re2(js: str) -> str:
    return to_re2(js)
