"""Store maintenance jobs: class backfill, schema migration, posted-date
repair, blank-company repair and the status funnel.

Each job is one narrow projection over the store (plus, for the company
repair, one join to landed pages on URL) and returns the new snapshot with
the job's counters; writing the snapshot is the caller's choice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.config import (EMPLOYMENT_TYPES, EXPERIENCE_LEVELS, HOST_RULE_HEADING_AT,
                           HOST_RULE_HEADING_LINE, KNOWN_BAD_FALLBACK_DATE, NOT_LISTED,
                           NOT_POSTED, STATUSES)
from harrow.functions.classify import classify_hay
from harrow.functions.company import company_before_heading, company_from_heading
from harrow.functions.dates import normalize_posted, utc_day
from harrow.functions.text import blank_to_null, jstrim, join_truthy
from harrow.operators.filters import blank_or_invalid, route_by_host
from harrow.sources.store import first_existing, with_blank


# --- class backfill -------------------------------------------------------

def backfill_classes(store: DataFrame) -> DataFrame:
    """Reclassify only blank or out-of-domain class values; valid values
    (``Unknown`` included) are never overwritten.

    The listing is rebuilt from the stored row: title, and a card text of
    title, company and location joined by newlines, so company and location
    text do reach the classifiers here.  Adds ``employment_type_updated`` and
    ``experience_level_updated`` flags.
    """
    title = jstrim(F.coalesce(F.col("job_title"), F.lit("")))
    company = jstrim(F.coalesce(F.col("company"), F.lit("")))
    location = jstrim(F.coalesce(F.col("location"), F.lit("")))
    card = join_truthy(title, company, location)
    hay = join_truthy(title, F.lit(None).cast("string"), card)
    cur_et = F.coalesce(F.col("employment_type"), F.lit(""))
    cur_el = F.coalesce(F.col("experience_level"), F.lit(""))
    et_upd = blank_or_invalid(cur_et, EMPLOYMENT_TYPES)
    el_upd = blank_or_invalid(cur_el, EXPERIENCE_LEVELS)
    flagged = (store.withColumn("employment_type_updated", et_upd)
               .withColumn("experience_level_updated", el_upd)
               .withColumn("_cur_et", cur_et).withColumn("_cur_el", cur_el))
    classed = classify_hay(flagged.drop("employment_type", "experience_level"), hay)
    return (classed
            .withColumn("employment_type", F.when(F.col("employment_type_updated"), F.col("employment_type"))
                        .otherwise(F.col("_cur_et")))
            .withColumn("experience_level", F.when(F.col("experience_level_updated"),
                                                   F.col("experience_level")).otherwise(F.col("_cur_el")))
            .drop("_cur_et", "_cur_el"))


def backfill_summary(backfilled: DataFrame) -> DataFrame:
    et, el = F.col("employment_type_updated"), F.col("experience_level_updated")
    return backfilled.agg(
        F.count(F.lit(1)).alias("scanned"),
        F.count_if(et | el).alias("updated"),
        F.count_if(et).alias("employment_type_updated"),
        F.count_if(el).alias("experience_level_updated"),
        F.count_if(~(et | el)).alias("unchanged"))


# --- schema migration -----------------------------------------------------

def migrate_schema(store: DataFrame) -> DataFrame:
    """Legacy store -> current columns: ``title`` -> ``job_title``,
    ``date_found`` -> ``date_posted`` as text, ``cover_letter`` and
    ``resume_version`` dropped.  Steps whose source column is absent are
    skipped (the migration is re-runnable)."""
    out = store
    if "title" in out.columns and "job_title" not in out.columns:
        out = out.withColumnRenamed("title", "job_title")
    if "date_found" in out.columns and "date_posted" not in out.columns:
        out = out.withColumn("date_posted", F.col("date_found").cast("string")).drop("date_found")
    return out.drop(*[c for c in ("cover_letter", "resume_version") if c in out.columns])


def fill_blank_salary(store: DataFrame) -> DataFrame:
    """Blank salary -> ``Not listed``; adds ``salary_filled``."""
    blank = F.coalesce(F.col("salary"), F.lit("")) == ""
    return (store.withColumn("salary_filled", blank)
            .withColumn("salary", F.when(blank, F.lit(NOT_LISTED)).otherwise(F.col("salary"))))


# --- posted-date repair ---------------------------------------------------

def repair_dates(store: DataFrame, created: str = "created_time",
                 bad_day: str = KNOWN_BAD_FALLBACK_DATE) -> DataFrame:
    """Rewrite every row's posted date as text.

    The posted column is ``date_posted`` or else ``date_found`` (resolved
    from the schema); a date-typed value becomes its ISO day, text is
    trimmed, a missing column or value becomes ``Not Posted``; then the
    sentinels are normalised against the row's UTC created day.  The title
    column is renamed to ``job_title`` if needed.  Adds ``created_day``.
    """
    posted_col = first_existing(store, "date_posted", "date_found")
    if posted_col is None:
        raw = F.lit(NOT_POSTED)
    else:
        dtype = dict(store.dtypes)[posted_col]
        if dtype in ("date", "timestamp"):
            raw = F.coalesce(F.date_format(F.col(posted_col), "yyyy-MM-dd"), F.lit(NOT_POSTED))
        else:
            t = jstrim(F.coalesce(F.col(posted_col).cast("string"), F.lit("")))
            raw = F.when(t != "", t).otherwise(F.lit(NOT_POSTED))
    day = utc_day(F.col(created))
    out = store.withColumn("created_day", day).withColumn(
        "_posted", normalize_posted(raw, day, bad_day))
    if posted_col and posted_col != "date_posted":
        out = out.drop(posted_col)
    out = out.drop("date_posted").withColumnRenamed("_posted", "date_posted")
    if "title" in out.columns and "job_title" not in out.columns:
        out = out.withColumnRenamed("title", "job_title")
    return out


def repair_dates_summary(repaired: DataFrame, bad_day: str = KNOWN_BAD_FALLBACK_DATE) -> DataFrame:
    """Rows rewritten, and rows now at the sentinel whose created day is the
    bad day (this also counts rows that were blank anyway)."""
    return repaired.agg(
        F.count(F.lit(1)).alias("rewritten"),
        F.count_if((F.col("date_posted") == NOT_POSTED)
                   & (F.col("created_day") == bad_day)).alias("repaired_fallbacks"))


# --- blank-company repair -------------------------------------------------

def page_text(html: Column) -> Column:
    """Approximate ``body.innerText``: drop head, script and style; block
    tags become line breaks, other tags vanish."""
    h = F.regexp_replace(html, r"(?is)<head\b.*?</head>|<script\b.*?</script>|<style\b.*?</style>", "")
    h = F.regexp_replace(h, r"(?i)</?(?:p|div|h[1-6]|li|ul|ol|article|section|header|footer|nav|main|br|tr|table)\b[^>]*>", "\n")
    return F.regexp_replace(h, r"<[^>]+>", "")


def heading(html: Column) -> Column:
    """Text of the first ``<h1>`` (tags inside stripped), trimmed."""
    inner = F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1)
    return jstrim(F.regexp_replace(inner, r"<[^>]+>", ""))


def link_text(html: Column, href_marker: str) -> Column:
    """Trimmed text (inner tags stripped) of the first link whose href contains the marker."""
    m = href_marker.replace(".", r"\.")
    value = rf'''(?:"[^"]*{m}[^"]*"|'[^']*{m}[^']*'|[^\s"'>]*{m}[^\s"'>]*)'''
    pat = rf"(?is)<a\b[^>]*\bhref\s*=\s*{value}[^>]*>(.*?)</a>"
    return jstrim(F.regexp_replace(F.regexp_extract(html, pat, 1), "<[^>]+>", ""))


def company_element(html: Column) -> Column:
    """Text of the first ``data-id="company-title"`` element, else of the first company link."""
    marked = jstrim(F.regexp_replace(F.regexp_extract(
        html, r"""(?is)<[a-z0-9]+\b[^>]*\bdata-id\s*=\s*["']?company-title(?=["'\s>])[^>]*>(.*?)</""", 1), "<[^>]+>", ""))
    return F.coalesce(F.when(marked != "", marked), link_text(html, "/company/"))


def page_companies(pages: DataFrame) -> DataFrame:
    """Per landed page URL, the company each recovery rule reads from it:
    ``line_rule`` (company element or link, else the last line before the heading) and
    ``at_rule`` (company link, else the text after `` at `` in the heading).

    A narrow projection over the pages, then one row per URL: of several pages
    of one URL, each rule takes the least name that is not blank ('' if all are).
    The page HTML itself is never shuffled.
    """
    named = pages.select("url", F.coalesce(F.col("html"), F.lit("")).alias("html")).select(
        "url", "html", heading(F.col("html")).alias("_heading"), company_element(F.col("html")).alias("_element"),
        link_text(F.col("html"), "/companies/").alias("_link"))
    line_rule = F.coalesce(blank_to_null("_element"), company_before_heading(page_text(F.col("html")), F.col("_heading")))
    at_rule = F.coalesce(blank_to_null("_link"), company_from_heading(F.col("_heading")))
    per_page = named.select("url", line_rule.alias("line_rule"), at_rule.alias("at_rule"))
    return (per_page.groupBy(F.col("url").alias("_url"))
            .agg(*[F.coalesce(F.min(blank_to_null(r)), F.lit("")).alias(r) for r in ("line_rule", "at_rule")]))


def recover_company(store: DataFrame, pages: DataFrame,
                    heading_line_host: str = HOST_RULE_HEADING_LINE,
                    heading_at_host: str = HOST_RULE_HEADING_AT,
                    url_col: str = "source_url") -> DataFrame:
    """Fill blank companies from the row's landed detail page.

    Only rows with a blank company are joined (left, on URL) to the per-page
    candidates of :func:`page_companies`; the host picks the rule.
    Unresolved rows keep their blank company; rows with a company pass
    through untouched.  Adds ``company_recovered``.
    """
    blank = F.coalesce(F.col("company"), F.lit("")) == ""
    todo = store.where(blank)
    done = store.where(~blank).withColumn("company_recovered", F.lit(False))
    cand = page_companies(pages)
    joined = todo.join(cand, todo[url_col] == cand["_url"], "left")
    found = route_by_host(F.col(url_col), [(heading_line_host, F.col("line_rule")),
                                           (heading_at_host, F.col("at_rule"))])
    found = F.coalesce(F.when(F.col("_url").isNotNull(), found), F.lit(""))
    fixed = (joined.withColumn("company_recovered", found != "")
             .withColumn("company", F.when(found != "", found).otherwise(F.col("company")))
             .drop("_url", "line_rule", "at_rule"))
    return done.unionByName(fixed)


def recover_company_summary(repaired: DataFrame) -> DataFrame:
    """Rows whose company was recovered, and rows still blank."""
    return repaired.agg(
        F.count_if("company_recovered").alias("updated"),
        F.count_if(F.coalesce(F.col("company"), F.lit("")) == "").alias("unresolved"))


# --- status funnel --------------------------------------------------------

def status_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, s) for i, s in enumerate(STATUSES)],
                                 "status_rank INT, status STRING")


def status_funnel(store: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Rows per status for every status of the domain (0 when absent), the
    per-status scans done as one grouped count."""
    spark = spark or store.sparkSession
    counts = store.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return (status_dim(spark).join(counts, "status", "left")
            .select("status_rank", "status", F.coalesce("n", F.lit(0)).alias("n")))


__all__ = ["backfill_classes", "backfill_summary", "migrate_schema", "fill_blank_salary",
           "repair_dates", "repair_dates_summary", "recover_company", "status_funnel",
           "with_blank"]
