"""Column-level functions (pure expressions, no actions)."""

from harrow.functions.classify import classify, employment_type, experience_level, matched_levels
from harrow.functions.company import company_before_heading, company_from_heading, split_company
from harrow.functions.dates import normalize_posted, posted_text, utc_day
from harrow.functions.salary import (clean_salary, salary_from_compensation,
                                     salary_from_range)
from harrow.functions.text import (blank_to_null, class_haystack, collapse_ws, contains_any,
                                   filter_haystack, fingerprint, jstrim, join_truthy, lines,
                                   matches_any, or_default, strip_tags)

__all__ = [
    "blank_to_null", "class_haystack", "classify", "clean_salary", "collapse_ws",
    "company_before_heading", "company_from_heading", "contains_any", "employment_type",
    "experience_level", "filter_haystack", "fingerprint", "join_truthy", "jstrim", "lines",
    "matched_levels", "matches_any", "normalize_posted", "or_default", "posted_text",
    "salary_from_compensation", "salary_from_range", "split_company", "strip_tags", "utc_day",
]
