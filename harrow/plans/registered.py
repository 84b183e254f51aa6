"""Queries registered with the driver, each paired with an oracle in SQL.

Every query reads whole driver tables (listing views of ``plans.views``) and
runs one operator family of the library over them.  Phrase lists are chosen
from words that occur in the driver text so that every tier and class is
reached; the rules themselves are the library's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.config import CITY_LOCATION_PATTERNS, HTML_LOCATION_DEFAULTS, CurationConfig
from harrow.functions.classify import class_haystack, employment_type, experience_level, matched_levels
from harrow.functions.company import split_company
from harrow.functions.salary import clean_salary, salary_from_compensation, salary_from_range
from harrow.functions.text import collapse_ws, fingerprint, jstrim, lines, or_default, strip_tags
from harrow.functions.variants import number_at, payload, variants_by_name
from harrow.operators.dedupe import anti_store, cap_per_group, first_wins, two_key_dedupe
from harrow.operators.filters import apply_tiers, board_title_ok, phrase_semi, present, with_relevance
from harrow.operators.metrics import source_counts, sources_dim, tier_counts
from harrow.plans import maintain
from harrow.plans import sqltext as S
from harrow.plans.curate import curate, enrich, settle_source
from harrow.plans.element_sql import city_sql, startup_sql
from harrow.plans.views import doc_listings, key_listings, part_listings, spread, table
from harrow.sources.boards import BOARDS, TEMPLATES, board_listings, judge_payloads
from harrow.sources.pages import (COMPANY_PATTERNS, CONTAINER_PATTERN, LEAF_PATTERN, LINK_PATTERN, CardRules, SectionRules, card_scan,
                                  link_scan, section_scan)
from harrow.sources.indexed import IndexedStore
from harrow.sources.quarantine import (EMPTY, NOT_JSON, UNKNOWN_BOARD, WRONG_SHAPE, bad_payloads,
                                       quarantine_counts)
from harrow.sources.registry import Source, collect_run, html_rows
from harrow.sources.scans import CityRules, StartupRules, city_scan, startup_scan
from harrow.sources.store import (LISTING_STORE, publish, read_current, to_store_rows, update_status, with_blank,
                                  with_status)
from harrow.streaming.incremental import ingest_available, land_batch, run_rows
from harrow.session import scratch_path

# Phrase lists for the driver tables (words present in documents and part).
DRIVER_CONFIG = CurationConfig(
    job_titles=("the", "de ", "le", "ring", "widget", "gear"),
    blocked_job_titles=("tion", "red"),
    keywords=("ouen", "thin", "ment", "small", "blue", "hot"),
    exclude_keywords=("worthless", "pathetic", "gizmo"),
    preferred_locations=("src1", "src2", "economy", "small"),
    max_jobs_per_source=50,
)
# The full-run checks let every row through the per-source cap so the whole
# table reaches the tiers and the dedupe; the cap is checked on its own.
UNCAPPED = DRIVER_CONFIG.with_(max_jobs_per_source=None)
# All keywords of the example configuration besides those that occur in the driver text.
TIER_CONFIG = DRIVER_CONFIG.with_(keywords=tuple(CurationConfig().keywords) + DRIVER_CONFIG.keywords)

# Fixed test values: suffixes appended to document text so that every class
# outcome occurs (chosen by doc_id mod 12).
CLASS_SUFFIXES = ("", " Intern", " co-op", " full-time", " Senior", " Sr. engineer",
                  " senior staff", " entry level", " associate engineer", " 2+ years",
                  " 0-2 years", " new grad senior")
BAD_DAY = "1995-01-01"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


# --- shared SQL views -----------------------------------------------------
NL = "chr(10)"
LDOC = (f"(SELECT doc_id AS ord, lang AS source, split_part(text, {NL}, 1) AS title, "
        f"text AS description, lang AS company, source AS location, "
        f"'doc://' || sha256(text) AS source_url FROM documents)")
LPART = ("(SELECT p_partkey AS ord, 'part' AS source, p_name AS title, p_brand AS company, "
         "p_type AS location, 'part://' || CAST(p_partkey AS VARCHAR) AS source_url FROM part)")
LKEYS = ("(SELECT doc_id AS ord, CAST(doc_id % 211 AS VARCHAR) AS source_url, "
         "concat_ws('|', lang, source) AS fingerprint FROM documents)")


def _greedy_sql(rows: str) -> str:
    """Sequential two-key loop as a recursive CTE over ``rows(ord, source_url,
    fingerprint)``: walk rows in order carrying the used keys."""
    return f"""
WITH RECURSIVE r AS (SELECT row_number() OVER (ORDER BY ord) AS i, * FROM {rows}),
walk(i, urls, fps, kept) AS (
  SELECT 0::BIGINT, []::VARCHAR[], []::VARCHAR[], []::BIGINT[]
  UNION ALL
  SELECT r.i,
    CASE WHEN list_contains(w.urls, r.source_url) OR list_contains(w.fps, r.fingerprint)
         THEN w.urls ELSE list_append(w.urls, r.source_url) END,
    CASE WHEN list_contains(w.urls, r.source_url) OR list_contains(w.fps, r.fingerprint)
         THEN w.fps ELSE list_append(w.fps, r.fingerprint) END,
    CASE WHEN list_contains(w.urls, r.source_url) OR list_contains(w.fps, r.fingerprint)
         THEN w.kept ELSE list_append(w.kept, r.ord) END
  FROM walk w JOIN r ON r.i = w.i + 1)
SELECT unnest(kept) AS ord FROM walk WHERE i = (SELECT max(i) FROM walk)"""


def _sql_doc_store_keys() -> str:
    """URLs and fingerprints of the store built from labelled documents."""
    return (f"(SELECT source_url, {S.fingerprint('company', 'title', 'location')} AS fingerprint "
            f"FROM {LDOC} d WHERE ord IN (SELECT doc_id FROM labels))")


def _doc_store(spark, sf):
    labelled = table(spark, sf, "labels").select(F.col("doc_id").alias("ord"))
    docs = doc_listings(spark, sf).join(labelled, "ord", "left_semi")
    return to_store_rows(enrich(docs))


# --- listing views, fingerprint ------------------------------------------
@register("listing_view", f"""
SELECT ord, source, title, company, location, source_url FROM {LDOC}
WHERE coalesce(title, '') <> '' AND coalesce(source_url, '') <> ''""")
def q_listing_view(spark, sf):
    d = doc_listings(spark, sf)
    return (d.where(present("title") & present("source_url"))
            .select("ord", "source", or_default("title", "Not listed").alias("title"), "company",
                    or_default("location", "").alias("location"), "source_url"))


@register("fingerprint", f"""
SELECT source_url, {S.fingerprint('company', 'title', 'location')} AS fingerprint
FROM (SELECT source_url, company, title, location FROM {LDOC}
      UNION ALL SELECT source_url, company, title, location FROM {LPART})""")
def q_fingerprint(spark, sf):
    u = doc_listings(spark, sf).unionByName(part_listings(spark, sf), allowMissingColumns=True)
    return u.select("source_url", fingerprint("company", "title", "location").alias("fingerprint"))


# --- predicates -----------------------------------------------------------
def _board_sql(title: str, shape: str) -> str:
    from harrow.config import BOARD_TITLE_PHRASES_A, BOARD_TITLE_PHRASES_B
    return S.contains_any(f"lower({S.nz(title)})",
                          BOARD_TITLE_PHRASES_A if shape == "A" else BOARD_TITLE_PHRASES_B)


@register("contains_any", f"""
SELECT ord, {_board_sql('title', 'A')} AS keep_a, {_board_sql('title', 'B')} AS keep_b,
       {S.contains_any("lower(coalesce(title, ''))", DRIVER_CONFIG.job_titles)} AS title_hit
FROM {LDOC}""")
def q_contains_any(spark, sf):
    from harrow.functions.text import contains_any
    d = doc_listings(spark, sf)
    return d.select("ord", board_title_ok("title", "A").alias("keep_a"),
                    board_title_ok("title", "B").alias("keep_b"),
                    contains_any(F.coalesce("title", F.lit("")), DRIVER_CONFIG.job_titles).alias("title_hit"))


@register("phrase_semi", """
SELECT d.doc_id FROM documents d
WHERE EXISTS (SELECT 1 FROM benchmark b WHERE b.text IS NOT NULL
              AND contains(lower(coalesce(d.text, '')), lower(b.text)))""")
def q_phrase_semi(spark, sf):
    docs = table(spark, sf, "documents")
    phrases = table(spark, sf, "benchmark").select(F.col("text").alias("phrase"))
    return phrase_semi(docs, "text", phrases).select("doc_id")


def _city_sql(title: str, card: str) -> str:
    from harrow.config import (CITY_AI_PATTERNS, CITY_IRRELEVANT_PATTERNS, INTERN_ALLOW_PATTERN,
                               INTERN_PATTERN)
    t = S.jstrim(S.nz(title))
    hay = f"({t} || {NL} || {S.nz(card)})"
    return (f"({t} <> '' AND NOT {S.rlike_any(t, CITY_IRRELEVANT_PATTERNS)} AND "
            f"{S.rlike_any(hay, CITY_AI_PATTERNS)} AND (NOT {S.rlike(hay, INTERN_PATTERN)} OR "
            f"{S.rlike(hay, INTERN_ALLOW_PATTERN)}))")


def _startup_sql(title: str) -> str:
    from harrow.config import (INTERN_ALLOW_PATTERN, INTERN_PATTERN, STARTUP_AI_PATTERNS,
                               STARTUP_IRRELEVANT_PATTERNS)
    t = S.jstrim(S.nz(title))
    return (f"({t} <> '' AND NOT {S.rlike_any(t, STARTUP_IRRELEVANT_PATTERNS)} AND "
            f"{S.rlike_any(t, STARTUP_AI_PATTERNS)} AND (NOT {S.rlike(t, INTERN_PATTERN)} OR "
            f"{S.rlike(t, INTERN_ALLOW_PATTERN)}))")


@register("relevance_gate", f"""
SELECT ord, {_city_sql('title', 'description')} AS city_keep, {_startup_sql('title')} AS startup_keep
FROM {LDOC}""")
def q_relevance_gate(spark, sf):
    d = doc_listings(spark, sf)
    return with_relevance(d, "title", "description", city="city_keep", startup="startup_keep").select(
        "ord", "city_keep", "startup_keep")


@register("tier_filter", f"""
SELECT ord, failed_tier, failed_tier IS NULL AS passed FROM (
  SELECT ord, {S.failed_tier(TIER_CONFIG, 'title', 'description', location='location')} AS failed_tier
  FROM {LDOC})""")
def q_tier_filter(spark, sf):
    return apply_tiers(doc_listings(spark, sf), TIER_CONFIG).select("ord", "failed_tier", "passed")


@register("tier_counts", f"""
SELECT failed_tier, count(*) AS n FROM (
  SELECT {S.failed_tier(DRIVER_CONFIG, 'title', 'description', location='location')} AS failed_tier
  FROM (SELECT title, description, location FROM {LDOC}
        UNION ALL SELECT title, NULL, location FROM {LPART}))
GROUP BY failed_tier""")
def q_tier_counts(spark, sf):
    u = doc_listings(spark, sf).unionByName(part_listings(spark, sf), allowMissingColumns=True)
    return tier_counts(apply_tiers(u, DRIVER_CONFIG))


# --- classifiers ----------------------------------------------------------
_SUFFIX_SQL = "[" + ", ".join(S.q(s) for s in CLASS_SUFFIXES) + "]"
_CLASS_DESC = f"(text || {_SUFFIX_SQL}[doc_id % {len(CLASS_SUFFIXES)} + 1])"
_CLASS_HAY = S.join_truthy(f"split_part(text, {NL}, 1)", _CLASS_DESC, "NULL")


@register("classify", f"""
SELECT doc_id AS ord, {S.employment_type(_CLASS_HAY)} AS employment_type,
       {S.experience_level(_CLASS_HAY)} AS experience_level,
       {S.matched_levels(_CLASS_HAY)} AS matched_levels
FROM documents""")
def q_classify(spark, sf):
    d = table(spark, sf, "documents")
    suffix = F.element_at(F.array(*[F.lit(s) for s in CLASS_SUFFIXES]),
                          (F.col("doc_id") % len(CLASS_SUFFIXES) + 1).cast("int"))
    hay = class_haystack(F.substring_index("text", "\n", 1), F.concat("text", suffix),
                         F.lit(None).cast("string"))
    from harrow.functions.classify import classify_hay
    return classify_hay(d.select(F.col("doc_id").alias("ord"), "text", "doc_id"), hay,
                        with_count=True).select("ord", "employment_type", "experience_level",
                                                "matched_levels")


# --- salary ---------------------------------------------------------------
def _salary_raw_spark() -> F.Column:
    a = F.floor(F.col("o_totalprice") / 1000).cast("long").cast("string")
    b = (F.floor(F.col("o_totalprice") / 1000).cast("long") + 20).cast("string")
    k = F.col("o_orderkey") % 8
    return (F.when(k == 0, F.concat(F.lit("$"), a, F.lit("/hr")))
            .when(k == 1, F.concat(F.lit("$"), a, F.lit(" – $"), b, F.lit(" / HR")))
            .when(k == 2, F.concat(F.lit("$"), a, F.lit(",000–$"), b, F.lit(",000 Offers Equity")))
            .when(k == 3, F.concat(F.lit("$"), a, F.lit("k - $"), b, F.lit("k")))
            .when(k == 4, F.concat(F.lit("$"), a, F.lit("K")))
            .when(k == 5, F.concat(F.lit("$"), a, F.lit("k")))
            .when(k == 6, F.concat(a, F.lit("K - "), b, F.lit("K")))
            .otherwise(F.lit("   ")))


_A = "CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS VARCHAR)"
_B = "CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) + 20 AS VARCHAR)"
_SAL_RAW = (f"CASE o_orderkey % 8 WHEN 0 THEN '$' || {_A} || '/hr' "
            f"WHEN 1 THEN '$' || {_A} || ' – $' || {_B} || ' / HR' "
            f"WHEN 2 THEN '$' || {_A} || ',000–$' || {_B} || ',000 Offers Equity' "
            f"WHEN 3 THEN '$' || {_A} || 'k - $' || {_B} || 'k' "
            f"WHEN 4 THEN '$' || {_A} || 'K' WHEN 5 THEN '$' || {_A} || 'k' "
            f"WHEN 6 THEN {_A} || 'K - ' || {_B} || 'K' ELSE '   ' END")


def _clean_salary_sql(e: str) -> str:
    from harrow.config import (SALARY_DASH_PATTERN, SALARY_HOURLY_PATTERN, SALARY_RANGE_PATTERN,
                               SALARY_SINGLE_PATTERN)
    s = S.jstrim(e)
    hr = f"regexp_extract({s}, {S.q('(?i)(' + S.re2(SALARY_HOURLY_PATTERN) + ')')}, 1)"
    hr = f"regexp_replace({hr}, {S.q(S.re2(SALARY_DASH_PATTERN))}, ' - ', 'g')"
    rng = S.q("(?i)" + S.re2(SALARY_RANGE_PATTERN))
    lo, hi = f"regexp_extract({s}, {rng}, 1)", f"regexp_extract({s}, {rng}, 2)"
    single = f"regexp_extract({s}, {S.q('(' + S.re2(SALARY_SINGLE_PATTERN) + ')')}, 1)"
    return (f"coalesce(nullif({hr}, ''), CASE WHEN {lo} <> '' THEN {lo} || ' - ' || {hi} END, "
            f"nullif({single}, ''), 'Not listed')")


@register("salary_clean", f"""
SELECT o_orderkey, {_clean_salary_sql(_SAL_RAW)} AS salary FROM orders""")
def q_salary_clean(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", clean_salary(_salary_raw_spark()).alias("salary"))


def _salary_structs(o: DataFrame) -> DataFrame:
    a = (F.floor(F.col("o_totalprice") / 1000).cast("long") * 1000).cast("double")
    b = a + F.lit(20000.0)
    cur = (F.when(F.col("o_orderstatus") == "F", F.lit("usd"))
           .when(F.col("o_orderstatus") == "O", F.lit("EUR")).otherwise(F.lit(None).cast("string")))
    k5, k4 = F.col("o_orderkey") % 5, F.col("o_orderkey") % 4
    nul = F.lit(None).cast("double")
    rng = F.struct(
        F.when(k5.isin(0, 1), a).when(k5 == 3, F.lit(0.0)).otherwise(nul).alias("min"),
        F.when(k5.isin(0, 2, 3), b).otherwise(nul).alias("max"),
        cur.alias("currency"))
    comp_t = F.concat(F.lit("$"), (a / 1000).cast("long").cast("string"), F.lit("K – $"),
                      (b / 1000).cast("long").cast("string"), F.lit("K • Equity"))
    sc_type = T.ArrayType(T.StructType([T.StructField("currencyCode", T.StringType()),
                                        T.StructField("minValue", T.DoubleType()),
                                        T.StructField("maxValue", T.DoubleType())]))
    sc = (F.when(k4 == 0, F.array(F.struct(cur.alias("currencyCode"), a.alias("minValue"),
                                           b.alias("maxValue"))))
          .when(k4 == 1, F.array(F.struct(cur.alias("currencyCode"), a.alias("minValue"),
                                          nul.alias("maxValue"))))
          .otherwise(F.lit(None).cast(sc_type)))
    comp = F.struct(sc.alias("summaryComponents"), cur.alias("currency"),
                    F.lit(None).cast("string").alias("currencyCode"),
                    F.when(k4 == 3, a).otherwise(nul).alias("minValue"),
                    F.when(k4 == 3, b).otherwise(nul).alias("maxValue"),
                    F.when(k4 == 1, comp_t).when(k4 == 2, F.lower(comp_t)).alias("compensationTierSummary"))
    return o.select("o_orderkey", rng.alias("rng"), comp.alias("comp"))


_AK = "CAST(floor(o_totalprice / 1000) AS BIGINT)"
_FMT_A = f"format('{{:,}}', {_AK} * 1000)"
_FMT_B = f"format('{{:,}}', {_AK} * 1000 + 20000)"
_CUR = "CASE o_orderstatus WHEN 'F' THEN 'usd' WHEN 'O' THEN 'EUR' END"
_SYM_B = f"CASE WHEN {_CUR} IS NULL OR upper({_CUR}) = 'USD' THEN '$' ELSE {_CUR} || ' ' END"
_SYM_C = f"CASE WHEN upper(coalesce({_CUR}, 'USD')) = 'USD' THEN '$' ELSE upper({_CUR}) || ' ' END"
_TIER = f"'$' || CAST({_AK} AS VARCHAR) || 'K – $' || CAST({_AK} + 20 AS VARCHAR) || 'K • Equity'"


@register("salary_format", f"""
SELECT o_orderkey,
  CASE WHEN o_orderkey % 5 = 0 AND {_AK} <> 0 THEN {_SYM_B} || {_FMT_A} || ' - ' || {_SYM_B} || {_FMT_B}
       WHEN o_orderkey % 5 = 0 THEN 'up to ' || {_SYM_B} || {_FMT_B}
       WHEN o_orderkey % 5 = 1 AND {_AK} <> 0 THEN {_SYM_B} || {_FMT_A} || '+'
       WHEN o_orderkey % 5 IN (2, 3) THEN 'up to ' || {_SYM_B} || {_FMT_B}
       ELSE 'Not listed' END AS salary_range,
  CASE WHEN o_orderkey % 4 IN (0, 3) AND {_AK} <> 0 THEN {_SYM_C} || {_FMT_A} || ' - ' || {_SYM_C} || {_FMT_B}
       WHEN o_orderkey % 4 = 1 THEN
         coalesce(regexp_extract({_TIER}, {S.q(S.re2(r'(\$[\d,]+(?:K)?)\s*[-–]\s*(\$[\d,]+(?:K)?)'))}, 1)
                  || ' - ' ||
                  regexp_extract({_TIER}, {S.q(S.re2(r'(\$[\d,]+(?:K)?)\s*[-–]\s*(\$[\d,]+(?:K)?)'))}, 2),
                  'Not listed')
       ELSE 'Not listed' END AS salary_comp
FROM orders""")
def q_salary_format(spark, sf):
    s = _salary_structs(table(spark, sf, "orders"))
    return s.select("o_orderkey", salary_from_range("rng").alias("salary_range"),
                    salary_from_compensation("comp").alias("salary_comp"))


# --- HTML -----------------------------------------------------------------
@register("strip_html", f"""
SELECT page_id, sha256({S.collapse(S.strip_tags('html'))}) AS text_a,
       sha256({S.jstrim(S.strip_tags('html'))}) AS text_b,
       CAST(length({S.collapse(S.strip_tags('html'))}) AS INTEGER) AS n_chars
FROM pages""")
def q_strip_html(spark, sf):
    p = table(spark, sf, "pages")
    a = collapse_ws(strip_tags("html"))
    return p.select("page_id", F.sha2(a, 256).alias("text_a"),
                    F.sha2(jstrim(strip_tags("html")), 256).alias("text_b"),
                    F.length(a).alias("n_chars"))


def _inner_sql(x: str) -> str:
    return S.jstrim(f"regexp_replace({x}, '<[^>]+>', '', 'g')")


def _absolute_sql(base: str, href: str) -> str:
    b = f"coalesce({base}, '')"
    origin = f"regexp_extract({b}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
    page = f"regexp_extract({b}, '^([^?#]*)', 1)"
    folder = f"regexp_extract(CASE WHEN {page} = {origin} THEN {origin} || '/' ELSE {page} END, '^(.*/)', 1)"
    return (f"CASE WHEN {href} = '' OR {origin} = '' OR regexp_matches({href}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {href} "
            f"WHEN starts_with({href}, '//') THEN regexp_extract({b}, '^([A-Za-z][A-Za-z0-9+.-]*:)', 1) || {href} "
            f"WHEN starts_with({href}, '/') THEN {origin} || {href} "
            f"WHEN starts_with({href}, '?') THEN {page} || {href} "
            f"WHEN starts_with({href}, '#') THEN regexp_extract({b}, '^([^#]*)', 1) || {href} "
            f"ELSE {folder} || {href} END")


def _markup(kinds: dict[int, str], every: int) -> tuple[Callable[[DataFrame], DataFrame], str]:
    """Pages whose ``<p>`` become the markup of page_id modulo ``every`` ({n} is the page id), on Spark and in SQL."""
    def spark_side(p: DataFrame) -> DataFrame:
        new = F.lit("<p>")
        for k, text in kinds.items():
            parts = [x for piece in text.split("{n}") for x in (F.lit(piece), F.col("page_id").cast("string"))][:-1]
            new = F.when(F.col("page_id") % every == k, F.concat(*parts)).otherwise(new)
        return p.withColumn("html", F.replace("html", F.lit("<p>"), new))

    cases = " ".join(f"WHEN {k} THEN " + " || CAST(page_id AS VARCHAR) || ".join(S.q(x) for x in text.split("{n}"))
                     for k, text in kinds.items())
    return spark_side, f"replace(html, '<p>', CASE page_id % {every} {cases} ELSE '<p>' END)"


_LINK = S.q(LINK_PATTERN)
_HREF = S.q(r'(?i)\bhref="([^"]*)"')
_LINK_PAGES, _LINK_HTML = _markup({
    0: '<li class="x"><a class="c" href="/company/{n}"><b>Firm {n}</b></a><a href="/job/{n}"><span>Role {n}</span></a>',
    1: '<article><a href="job/{n}?a=b">Role <i>{n}</i></a><em data-id="company-title"> Maker {n} </em>',
    2: '<div data-id="box"><a href="//h.example/job/{n}">Role {n}</a></div>'}, 4)


def _company_in_sql(part: str) -> str:
    found = [_inner_sql(f"regexp_extract({part}, {S.q(p)}, 2)") for p in COMPANY_PATTERNS]
    return f"coalesce({', '.join(f'nullif({f}, {S.q(str())})' for f in found)}, '')"


def _contained_sql(html: str, source: str = "pages") -> str:
    """(page_id, url, j, k, href, text, company, around) of every link."""
    return f"""
(SELECT page_id, url, j, k, regexp_extract(attrs[k], {_HREF}, 1) AS href, {_inner_sql('texts[k]')} AS text,
        CASE WHEN j > 1 THEN {_company_in_sql('part')} ELSE '' END AS company,
        CASE WHEN j > 1 THEN {S.collapse(S.strip_tags('part'))} ELSE {_inner_sql('texts[k]')} END AS around
 FROM (SELECT *, unnest(range(1, len(attrs) + 1)) AS k FROM (
   SELECT page_id, url, j, part, regexp_extract_all(part, {_LINK}, 1) AS attrs,
          regexp_extract_all(part, {_LINK}, 2) AS texts
   FROM (SELECT page_id, url, j, parts[j] AS part FROM (
     SELECT page_id, url, parts, unnest(range(1, len(parts) + 1)) AS j FROM (
       SELECT page_id, url, string_split_regex({html}, {S.q(CONTAINER_PATTERN)}) AS parts FROM {source}))))))"""


@register("page_links", f"""
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY j, k) - 1 AS INTEGER) AS pos,
       text AS title, {_absolute_sql('url', 'href')} AS href, coalesce(nullif(company, ''), 'Unknown') AS company,
       '' AS location, around AS card_text
FROM {_contained_sql(_LINK_HTML)} WHERE contains(href, '/')""")
def q_page_links(spark, sf):
    return link_scan(_LINK_PAGES(table(spark, sf, "pages")), href_contains="/", base_col="url").select(
        "page_id", "pos", "title", "href", "company", "location", "card_text")


DRIVER_CITY = CityRules(CITY_LOCATION_PATTERNS["BuiltIn Houston"], *HTML_LOCATION_DEFAULTS["BuiltIn Houston"])
DRIVER_CARDS = CardRules(
    location_like=CITY_LOCATION_PATTERNS["BuiltIn Houston"], link_href_contains="/job/",
    location_no_cards=HTML_LOCATION_DEFAULTS["BuiltIn Houston"][0],
    location_default=HTML_LOCATION_DEFAULTS["BuiltIn Houston"][1])
_CARD_PAGES, _CARD_HTML = _markup({
    0: '<li><a href="/company/{n}"><i>Firm {n}</i></a><a href="/job/{n}"><span>Role {n}</span></a>',
    1: '<div data-id="job-card"><a href="/job/{n}" data-id="job-card-title"><b>Role {n}</b></a>'
       '<em data-id="company-title"><i>Firm {n}</i></em><div class="job-salary"> ${n} </div><footer>end</footer>',
    2: '<article class="wide job-card"><h2> <a href="job/{n}">Role {n}</a></h2><span>In Office, Remote</span>',
    3: '<div data-id="job-card"><em>Lead {n}</em><a class="y" href="https://h.example/job/{n}">Role {n}</a>',
    4: '<div data-id="job-card">'}, 6)


def _card_sql() -> str:
    r = DRIVER_CARDS
    f = "frag"
    runs = f"list_transform(regexp_extract_all({f}, {S.q(LEAF_PATTERN)}, 1), lambda x: {S.jstrim('x')})"
    title = ("CASE " + " ".join(f"WHEN regexp_matches({f}, {S.q(t)}) THEN {_inner_sql(f'regexp_extract({f}, {S.q(t)}, 2)')}"
                                for t in r.titles) + " ELSE '' END")
    href = ("CASE " + " ".join(f"WHEN regexp_matches({f}, {S.q(t)}) THEN "
                               f"regexp_extract(regexp_extract({f}, {S.q(t)}, 1), {_HREF}, 1)" for t in r.titles)
            + " ELSE '' END")
    spans = f"list_transform(regexp_extract_all({f}, {S.q(r.location_leaf)}, 1), lambda x: {S.jstrim('x')})"
    loc = f"list_filter({spans}, lambda x: regexp_matches(x, {S.q('(?i:' + S.re2(r.location_like) + ')')}))[1]"
    return f"""
WITH p AS (SELECT page_id, url, {_CARD_HTML} AS html FROM pages),
b AS (SELECT page_id, url, html, string_split_regex(html, {S.q(r.card_marker)}) AS parts FROM p),
x AS (SELECT page_id, url, i, parts[i] AS frag FROM (
  SELECT page_id, url, parts, unnest(range(2, len(parts) + 1)) AS i FROM b WHERE len(parts) > 1)),
t AS (SELECT page_id, url, i, frag, {title} AS title, {href} AS href, {runs} AS runs FROM x),
c AS (
  SELECT page_id, CAST(i - 2 AS INTEGER) AS pos, title, {_absolute_sql('url', 'href')} AS href,
         CASE WHEN regexp_matches({f}, {S.q(r.company)}) THEN {_inner_sql(f'regexp_extract({f}, {S.q(r.company)}, 1)')}
              ELSE coalesce(list_filter(runs, lambda x: x <> '' AND x <> title)[1], 'Unknown') END AS company,
         {S.jstrim(f"regexp_extract({f}, {S.q(r.salary)}, 1)")} AS salary,
         coalesce({loc}, {S.q(r.location_default)}) AS location,
         {S.collapse(S.strip_tags(f))} AS card_text, true AS from_cards
  FROM t),
n AS (SELECT page_id, url, html FROM b WHERE len(parts) <= 1),
lk AS (
  SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY j, k) - 1 AS INTEGER) AS pos, text AS title,
         {_absolute_sql('url', 'href')} AS href, coalesce(nullif(company, ''), 'Unknown') AS company, '' AS salary,
         {S.q(r.location_no_cards)} AS location, around AS card_text, false AS from_cards
  FROM {_contained_sql('html', 'n')} WHERE contains(href, {S.q(r.link_href_contains)}))
SELECT * FROM c UNION ALL SELECT * FROM lk"""


@register("page_cards", _card_sql())
def q_page_cards(spark, sf):
    return card_scan(_CARD_PAGES(table(spark, sf, "pages")), DRIVER_CARDS, base_col="url").select(
        "page_id", "pos", "title", "href", "company", "salary", "location", "card_text", "from_cards")


def _split_company_sql(raw: str) -> tuple[str, str]:
    from harrow.config import BATCH_SUFFIX_PATTERN
    parts = f"string_split({S.collapse(S.nz(raw))}, '•')"
    name = S.jstrim(f"regexp_replace({parts}[1], {S.q('(?i)' + S.re2(BATCH_SUFFIX_PATTERN))}, '')")
    company = f"coalesce(nullif({name}, ''), 'Unknown')"
    context = S.jstrim(f"array_to_string({parts}[2:], ' • ')")
    return company, context


_SEC_CO, _SEC_CTX = _split_company_sql("header")
_SECTIONS = SectionRules()
_SECTION_PAGES, _SECTION_HTML = _markup({
    0: '<a class="c" href="/companies/{n}"><b>Firm {n} (S24)</b> • Robots • {n} people</a>'
       '<li class="job"><a href="/jobs/{n}"><i>Role {n}</i></a><span class="location">Paris</span>'
       '<div class="salary"> ${n}K </div><li class="job">No link',
    1: '<li class="a-job"><h3>Lost {n}</h3><a href="https://h.example/companies/x{n}">Next {n}</a>',
    2: '<a href="/companies/{n}">Bare {n}</a><a href="/jobs/{n}">Role <b>{n}</b></a><a href="/jobs/list">All</a>'}, 4)
_SECTION_SQL = f"""
(WITH p AS (SELECT page_id, url, {_SECTION_HTML} AS html FROM pages),
s AS (SELECT page_id, url, regexp_matches(html, {S.q(_SECTIONS.row)}) AS marked,
             string_split_regex(html, {S.q(_SECTIONS.header)}) AS secs FROM p),
x AS (SELECT page_id, url, marked, secs[j] AS sec, j FROM (
  SELECT page_id, url, marked, secs, unnest(range(1, len(secs) + 1)) AS j FROM s)),
y AS (SELECT *, CASE WHEN j > 1 THEN {_inner_sql("regexp_extract(sec, '(?is)^(.*?)</a>', 1)")} ELSE '' END AS header FROM x),
rows AS (
  SELECT page_id, url, j, header, i - 2 AS pos, {_inner_sql(f'regexp_extract(frag, {S.q(_SECTIONS.title)}, 2)')} AS title,
         regexp_extract(regexp_extract(frag, {S.q(_SECTIONS.title)}, 1), {_HREF}, 1) AS href,
         {S.jstrim(f'regexp_extract(frag, {S.q(_SECTIONS.location)}, 1)')} AS location,
         {S.jstrim(f'regexp_extract(frag, {S.q(_SECTIONS.salary)}, 1)')} AS salary,
         {S.collapse(S.strip_tags('frag'))} AS card_text
  FROM (SELECT *, parts[i] AS frag FROM (
    SELECT *, unnest(range(2, len(parts) + 1)) AS i FROM (
      SELECT *, string_split_regex(sec, {S.q(_SECTIONS.row)}) AS parts FROM y WHERE marked)))
  UNION ALL
  SELECT page_id, url, j, header, row_number() OVER (PARTITION BY page_id, j ORDER BY k) - 1, title, href, '', '', title
  FROM (SELECT page_id, url, j, header, k, {_inner_sql('texts[k]')} AS title, regexp_extract(attrs[k], {_HREF}, 1) AS href
        FROM (SELECT *, unnest(range(1, len(attrs) + 1)) AS k FROM (
          SELECT *, regexp_extract_all(sec, {_LINK}, 1) AS attrs, regexp_extract_all(sec, {_LINK}, 2) AS texts
          FROM y WHERE NOT marked)))
  WHERE regexp_matches(href, {S.q(_SECTIONS.detail_link)}))
SELECT page_id, CAST(j - 1 AS INTEGER) AS section, CAST(pos AS INTEGER) AS pos, title,
       {_absolute_sql('url', 'href')} AS href, {_SEC_CO} AS company, {_SEC_CTX} AS company_context,
       location, salary, card_text
FROM rows)"""


@register("page_section_fill", f"SELECT * FROM {_SECTION_SQL}")
def q_page_section_fill(spark, sf):
    return section_scan(_SECTION_PAGES(table(spark, sf, "pages")), _SECTIONS, base_col="url").select(
        "page_id", "section", "pos", "title", "href", "company", "company_context", "location", "salary", "card_text")


_ELEMENT_PAGES, _ELEMENT_HTML = _markup({
    0: "<section><div data-id='box'><a href='/company/{n}'>Firm {n}</a><div><a href='/job/{n}'>Role <b>{n}</a></div></div>"
       "<a href=/job/x{n}>Loose {n}</a></section>",
    1: '<div class="gap-job-cards"><div data-id="job-card"><div><a href="/job/{n}" title="a > b">Role {n}</a></div>'
       '<div class="job-salary"><span>${n}</span>k</div></div><div><span>TX outside</span></div></div><footer>End {n}</footer>',
    2: "<ul><li><article class='wide job-card'><h3><a href='job/{n}'>Role {n}</a></h3><p>Maker {n}<p>Hybrid</p><span>Remote</span></article>"
       "<li><article class='job-card'><em data-id=company-title>Firm<br>{n}</em><h2 data-id=job-card-title>No link</h2></article></ul>",
    3: '<div data-id="job-card"><p>Unclosed {n}<a href="/job/{n}">One<a href="/job/y{n}">Two</a></i>'}, 5)


@register("element_cards", city_sql(_ELEMENT_HTML, DRIVER_CITY, _absolute_sql))
def q_element_cards(spark, sf):
    return city_scan(_ELEMENT_PAGES(spread(table(spark, sf, "pages"))), DRIVER_CITY, base_col="url")


_ROW_PAGES, _ROW_HTML = _markup({
    0: "<main><section><header><a href='/companies/{n}'>Firm {n} (S24) • Robots</a></header><div><div><div class='JobRow x'>"
       "<a href='/jobs/{n}'>Role <i>{n}</i></a><div class='location'><span>Paris</span>, FR</div></div></div></div></section>"
       "<div class='job-row'><h3>No firm {n}</h3><span class='salary'>${n}<b>k</b></span></div></main>",
    1: '<ul><li class="a-job"><b class="companyName">Inner {n}</b><h2>Lead {n}</h2><li class=job><span class="title">Last</span></ul>',
    2: "<article><a href='/companies/{n}'>Bare {n}</a><div>Title line {n}<br>Maker<p>Lyon</p><a href='/jobs/{n}'>Apply</a></div>"
       "<a href='/jobs/list'>All</a></article><a href='https://h.example/jobs/9{n}'>Loose</a>",
    3: "<div><a href='/companies/far{n}'>Far {n}</a><p><i><span><em><u><s><b><li class='job'><a href=/jobs/{n}>Deep</a></li></div>"}, 5)


@register("element_rows", startup_sql(_ROW_HTML, StartupRules(), _absolute_sql, _split_company_sql))
def q_element_rows(spark, sf):
    return startup_scan(_ROW_PAGES(spread(table(spark, sf, "pages"))), StartupRules(), base_col="url")


@register("page_order", f"""
SELECT CAST(r.seed AS INTEGER) AS board_rank, page_id, section, CAST(pos AS BIGINT) AS pos, title, CAST(1 AS BIGINT) AS n
FROM {_SECTION_SQL} s, (VALUES (0), (1)) r(seed)""")
def q_page_order(spark, sf):
    """Two seeds with the same page ids: every row has an order of its own."""
    p = _SECTION_PAGES(table(spark, sf, "pages"))
    seeds = p.withColumn("board_rank", F.lit(0)).unionByName(p.withColumn("board_rank", F.lit(1)))
    rows = html_rows(section_scan(seeds, _SECTIONS, carry=("board_rank",), base_col="url"), "YC Jobs", 5, "Remote")
    return rows.groupBy("ord").agg(F.max("title").alias("title"), F.count(F.lit(1)).alias("n")).select(
        "ord.board_rank", "ord.page_id", "ord.section", "ord.pos", "title", "n")


# --- boards ----------------------------------------------------------------
# One payload for every board token and run of about 200 parts, written as JSON from part rows.
_BOARD_TITLE = ("CASE p_partkey % 4 WHEN 0 THEN 'Machine Learning ' || p_name WHEN 1 THEN p_name "
                "WHEN 2 THEN 'AI ' || p_brand ELSE '' END")
_BOARD_ITEMS = {
    "A": ("jobs", "named_struct('id', p_partkey, 'title', t, 'content', concat('<p>', p_type, '</p>  <b>', p_name, '</b>'), "
          "'location', named_struct('name', if(p_size % 3 = 0, '', p_type)), "
          "'company', if(p_size % 2 = 0, named_struct('name', p_brand), null), "
          "'absolute_url', if(p_size % 5 = 0, null, concat('https://b.example/', p_partkey)))"),
    "B": (None, "named_struct('id', cast(p_partkey as string), 'text', t, 'description', if(p_size % 2 = 0, '', concat('<i>', p_type, '</i>')), "
          "'descriptionPlain', p_name, 'categories', named_struct('location', if(p_size % 3 = 0, '', p_type)), "
          "'workplaceType', p_brand, 'salaryRange', if(p_size % 4 = 0, named_struct('min', cast(p_size * 1000 as double), "
          "'max', cast(p_size * 2000 as double), 'currency', 'usd'), null), "
          "'hostedUrl', if(p_size % 5 = 0, null, concat('https://l.example/', p_partkey)))"),
    "C": ("jobPostings", "named_struct('id', cast(p_partkey as string), 'title', t, 'descriptionPlain', if(p_size % 2 = 0, '', p_type), "
          "'description', concat('<i>', p_name, '</i>'), 'location', if(p_size % 3 = 0, '', p_type), "
          "'locationName', p_brand, 'jobUrl', if(p_size % 5 = 0, null, concat('https://a.example/', p_partkey)))"),
}
_BOARD_LABEL = {"A": "Greenhouse", "B": "Lever", "C": "Ashby"}


def _payloads(spark, sf, shape: str) -> DataFrame:
    key, item = _BOARD_ITEMS[shape]
    tokens = F.array(*[F.lit(t) for _, t in BOARDS[shape]])
    n = len(BOARDS[shape])
    p = table(spark, sf, "part").withColumn("t", F.expr(_BOARD_TITLE)).withColumn(
        "token", F.element_at(tokens, (F.col("p_partkey") % n + 1).cast("int")))
    runs = p.groupBy("token", F.floor(F.col("p_partkey") / (200 * n)).alias("run")).agg(
        F.expr(f"transform(array_sort(collect_list(struct(p_partkey, {item} as j))), x -> x.j)").alias("items"))
    value = F.to_json("items") if key is None else F.to_json(F.struct(F.col("items").alias(key)))
    return runs.select("token", value.alias("value"))


def _board_oracle(shape: str) -> str:
    n = len(BOARDS[shape])
    names = "[" + ", ".join(S.q(b) for b, _ in BOARDS[shape]) + "]"
    tokens = "[" + ", ".join(S.q(t) for _, t in BOARDS[shape]) + "]"
    board, token = f"{names}[p_partkey % {n} + 1]", f"{tokens}[p_partkey % {n} + 1]"
    prefix, rest = TEMPLATES[shape].split("{token}")
    fallback = f"{S.q(prefix)} || {token} || {S.q(rest.split('{id}')[0])} || CAST(p_partkey AS VARCHAR)"
    host = {"A": "b", "B": "l", "C": "a"}[shape]
    url = f"CASE WHEN p_size % 5 = 0 THEN {fallback} ELSE 'https://{host}.example/' || CAST(p_partkey AS VARCHAR) END"
    place = {"A": "''", "B": "p_brand", "C": "p_brand"}[shape]
    location = f"coalesce(nullif(CASE WHEN p_size % 3 = 0 THEN {place} ELSE p_type END, ''), '')"
    text = {"A": S.collapse("' ' || p_type || '    ' || p_name || ' '"),
            "B": "CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_type END",
            "C": "CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_type END"}[shape]
    company = f"CASE WHEN p_size % 2 = 0 THEN p_brand ELSE {board} END" if shape == "A" else board
    salary = ("CASE WHEN p_size % 4 = 0 THEN '$' || format('{:,}', p_size * 1000) || ' - $' || format('{:,}', p_size * 2000) "
              "ELSE 'Not listed' END" if shape == "B" else "'Not listed'")
    return f"""
SELECT p_partkey AS ord_key, title, {company} AS company, {location} AS location, {salary} AS salary,
       {url} AS source_url, {text} AS description, CAST(pos AS BIGINT) AS pos
FROM (SELECT *, {_BOARD_TITLE} AS title, row_number() OVER (PARTITION BY p_partkey % {n}, p_partkey // {200 * n} ORDER BY p_partkey) - 1 AS pos FROM part)
WHERE {_board_sql('title', 'A' if shape == 'A' else 'B')}"""


def _register_board(shape: str) -> None:
    @register(f"board_{shape.lower()}", _board_oracle(shape))
    def q_board(spark, sf):
        rows = board_listings(_payloads(spark, sf, shape), shape, _BOARD_LABEL[shape], 0)
        key = F.regexp_extract("source_url", r"([0-9]+)$", 1).cast("int")
        return rows.select(key.alias("ord_key"), "title", "company", "location", "salary", "source_url", "description",
                           F.col("ord.pos").alias("pos"))


for _shape in "ABC":
    _register_board(_shape)


def _spoiled(spark, sf, shape: str) -> DataFrame:
    """The payloads of a shape, each fourth run of parts spoiled in one of four ways."""
    n = len(BOARDS[shape])
    runs = _payloads(spark, sf, shape)
    first = F.regexp_extract("value", r'"id":"?([0-9]+)', 1).cast("long")
    way = F.when(F.floor(first / (200 * n)) % 2 == 0, first % n % 5).otherwise(F.lit(4))
    wrong = "[]" if shape != "B" else '{"jobs":[]}'
    value = (F.when(way == 0, F.expr("left(value, length(value) - 2)")).when(way == 1, F.lit(wrong)).when(way == 2, F.lit(" "))
             .otherwise(F.col("value")))
    return runs.select(F.when(way == 3, F.lit("nowhere")).otherwise(F.col("token")).alias("token"), value.alias("value"))


def _spoiled_sql(shape: str) -> str:
    """The way in which the run of a part is spoiled (4: not)."""
    n = len(BOARDS[shape])
    return f"CASE WHEN p_partkey // {200 * n} % 2 = 0 THEN p_partkey % {n} % 5 ELSE 4 END"


_REASONS = f"['{NOT_JSON}', '{WRONG_SHAPE}', '{EMPTY}', '{UNKNOWN_BOARD}']"


@register("quarantine_payloads", " UNION ALL ".join(f"""
SELECT '{_BOARD_LABEL[s]}' AS source, {_REASONS}[way + 1] AS reason, count(*) AS n FROM (
  SELECT DISTINCT p_partkey % {len(BOARDS[s])} AS token, p_partkey // {200 * len(BOARDS[s])} AS run, {_spoiled_sql(s)} AS way FROM part)
WHERE way < 4 GROUP BY way""" for s in "ABC"))
def q_quarantine_payloads(spark, sf):
    bad = [bad_payloads(judge_payloads(_spoiled(spark, sf, s), s), _BOARD_LABEL[s]) for s in "ABC"]
    return quarantine_counts(bad[0].unionByName(bad[1]).unionByName(bad[2]))


@register("quarantine_rows", " UNION ALL ".join(f"""
SELECT '{_BOARD_LABEL[s]}' AS source, ord_key, title FROM ({_board_oracle(s)}) b
JOIN (SELECT p_partkey, {_spoiled_sql(s)} AS way FROM part) p ON p.p_partkey = b.ord_key AND p.way = 4""" for s in "ABC"))
def q_quarantine_rows(spark, sf):
    """The rows of all payloads that are well formed, beside spoiled ones."""
    rows = [board_listings(_spoiled(spark, sf, s), s, _BOARD_LABEL[s], 0) for s in "ABC"]
    key = F.regexp_extract("source_url", r"([0-9]+)$", 1).cast("int")
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).select("source", key.alias("ord_key"), "title")


def _plugins(sf: str) -> tuple[Source, ...]:
    """A registry of plug-ins over the driver tables: two that work, one disabled, one that fails."""
    def broken(spark, landing, cfg):
        raise ValueError("this source always fails")

    read = {"docs": doc_listings, "parts": part_listings}
    work = [Source(n, i, lambda spark, landing, cfg, f=f: f(spark, sf).withColumns({
        "source": F.lit(n_of[f]), "ord": F.struct(
            F.lit(r_of[f]).alias("source_rank"), F.lit(0).alias("board_rank"), F.lit(0).cast("long").alias("page_id"),
            F.lit(0).alias("section"), F.col("ord").cast("long").alias("pos"))}), lands=False)
        for i, (n, f) in enumerate(read.items())]
    n_of = {f: n for n, f in read.items()}
    r_of = {f: i for i, f in enumerate(read.values())}
    return (*work, Source("off", 2, None), Source("broken", 3, broken, lands=False), Source("unlanded", 4, broken))


@register("registry_run", f"""
WITH settled AS (
  SELECT s, t FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY ord) AS place FROM (
    SELECT *, row_number() OVER (PARTITION BY s, source_url ORDER BY ord) AS first FROM (
      SELECT 'docs' AS s, ord, source_url, title, {S.failed_tier(DRIVER_CONFIG, 'title', 'description', location='location')} AS t FROM {LDOC}
      UNION ALL
      SELECT 'parts', ord, source_url, title, {S.failed_tier(DRIVER_CONFIG, 'title', 'NULL', location='location')} FROM {LPART})
    WHERE coalesce(title, '') <> '') WHERE first = 1) WHERE place <= {DRIVER_CONFIG.max_jobs_per_source})
SELECT 'found' AS kind, s AS source, count(*) AS n FROM settled GROUP BY s
UNION ALL SELECT 'passed', s, CAST(count_if(t IS NULL) AS BIGINT) FROM settled GROUP BY s
UNION ALL SELECT 'errors', NULL, count(*) FROM (VALUES ('broken'), ('unlanded'))""")
def q_registry_run(spark, sf):
    """A run over plug-ins: counts by source, and the sources that failed as errors of the summary."""
    got = collect_run(spark, scratch_path(spark, "nothing-landed"), DRIVER_CONFIG, _plugins(sf), settle=True)
    res = curate(got.listings, DRIVER_CONFIG, quarantine=got.quarantine)
    per = res.verdicts.groupBy("source").agg(F.count(F.lit(1)).alias("found"), F.count_if("passed").alias("passed"))
    by_source = per.unpivot("source", ["found", "passed"], "kind", "n").select("kind", "source", "n")
    return by_source.unionByName(res.summary.select(F.lit("errors").alias("kind"), F.lit(None).cast("string").alias("source"),
                                                    F.col("errors").alias("n")))


_SPLIT_RAW = ("CASE WHEN p_size % 7 = 0 THEN '' ELSE p_brand || CASE WHEN p_size % 3 = 0 "
              "THEN ' (S' || CAST(p_size AS VARCHAR) || ')' ELSE '' END || ' • ' || p_name "
              "|| '  •   ' || p_type END")
_SPLIT_CO, _SPLIT_CTX = _split_company_sql(_SPLIT_RAW)
_LINES_SQL = (f"array_to_string(list_filter(list_transform(string_split(p_name || {NL} || '  ' "
              f"|| {NL} || p_type, {NL}), lambda x: {S.jstrim('x')}), lambda x: x <> ''), '|')")


@register("split_company", f"""
SELECT p_partkey AS ord, {_SPLIT_CO} AS company, {_SPLIT_CTX} AS context, {_LINES_SQL} AS lines
FROM part""")
def q_split_company(spark, sf):
    p = table(spark, sf, "part")
    raw = (F.when(F.col("p_size") % 7 == 0, F.lit(""))
           .otherwise(F.concat("p_brand",
                               F.when(F.col("p_size") % 3 == 0,
                                      F.concat(F.lit(" (S"), F.col("p_size").cast("string"), F.lit(")")))
                               .otherwise(F.lit("")),
                               F.lit(" • "), "p_name", F.lit("  •   "), "p_type")))
    sc = split_company(raw)
    ls = F.array_join(lines(F.concat_ws("\n", "p_name", F.lit("  "), "p_type")), "|")
    return p.select(F.col("p_partkey").alias("ord"), sc["company"].alias("company"),
                    sc["context"].alias("context"), ls.alias("lines"))


@register("json_field", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def q_json_field(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@register("star_lookup", """
SELECT s.s_suppkey, s.s_name, n.n_name FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey""")
def q_star_lookup(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).select("s_suppkey", "s_name", "n_name")


# --- windows and caps -----------------------------------------------------
@register("first_wins", f"""
SELECT ord, source, source_url FROM (
  SELECT *, row_number() OVER (PARTITION BY source, source_url ORDER BY ord) AS rn FROM {LDOC})
WHERE rn = 1""")
def q_first_wins(spark, sf):
    return first_wins(doc_listings(spark, sf), ["source", "source_url"]).select(
        "ord", "source", "source_url")


@register("cap_per_source", f"""
SELECT ord, source FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY ord) AS rk FROM (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, source_url ORDER BY ord) AS rn
                   FROM {LDOC}) WHERE rn = 1 AND coalesce(title, '') <> ''))
WHERE rk <= {DRIVER_CONFIG.max_jobs_per_source}""")
def q_cap_per_source(spark, sf):
    return settle_source(doc_listings(spark, sf), DRIVER_CONFIG).select("ord", "source")


@register("preview_top3", """
SELECT event_type, event_id FROM (
  SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rk
  FROM events) WHERE rk <= 3""")
def q_preview_top3(spark, sf):
    e = table(spark, sf, "events").withColumn("ord", F.struct("ts", "event_id"))
    return cap_per_group(e, "event_type", 3).select("event_type", "event_id")


# --- union and counts -----------------------------------------------------
@register("union_sources", f"""
SELECT ord, source, source_url, CAST(length(description) AS INTEGER) AS description_len FROM {LDOC}
UNION ALL SELECT ord, source, source_url, NULL FROM {LPART}""")
def q_union_sources(spark, sf):
    u = doc_listings(spark, sf).unionByName(part_listings(spark, sf), allowMissingColumns=True)
    return u.select("ord", "source", "source_url", F.length("description").alias("description_len"))


_SOURCES = ("de", "en", "es", "fr", "part", "disabled")


@register("source_counts", f"""
WITH u AS (SELECT source, source_url FROM {LDOC} UNION ALL SELECT source, source_url FROM {LPART}),
agg AS (SELECT source, count(*) AS found, count(DISTINCT source_url) AS distinct_urls FROM u GROUP BY source)
SELECT d.source, coalesce(a.found, 0) AS found, coalesce(a.distinct_urls, 0) AS distinct_urls
FROM (SELECT unnest([{', '.join(S.q(s) for s in _SOURCES)}]) AS source) d LEFT JOIN agg a ON a.source = d.source
UNION ALL SELECT NULL, count(*), count(DISTINCT source_url) FROM u""")
def q_source_counts(spark, sf):
    u = doc_listings(spark, sf).unionByName(part_listings(spark, sf), allowMissingColumns=True)
    return source_counts(u, sources_dim(spark, _SOURCES))


# --- store joins and the two-key rule -------------------------------------
@register("anti_store", f"""
SELECT ord FROM (SELECT ord, source_url, {S.fingerprint('company', 'title', 'location')} AS fingerprint FROM {LDOC}) n
WHERE source_url NOT IN (SELECT source_url FROM {_sql_doc_store_keys()} WHERE source_url IS NOT NULL)
  AND fingerprint NOT IN (SELECT fingerprint FROM {_sql_doc_store_keys()} WHERE fingerprint IS NOT NULL)""")
def q_anti_store(spark, sf):
    new = doc_listings(spark, sf).withColumn("fingerprint", fingerprint("company", "title", "location"))
    return anti_store(new, _doc_store(spark, sf)).select("ord")


def _indexed(spark, rows: DataFrame, epochs: int = 1) -> IndexedStore:
    """An indexed store that holds ``rows``, appended in as many epochs by a hash of the fingerprint."""
    store = IndexedStore(spark, scratch_path(spark, "indexed"), rows.schema)
    for part in range(epochs):
        store.append(rows.where(F.pmod(F.xxhash64("fingerprint"), F.lit(epochs)) == part))
    return store


@register("index_anti_store", ORACLES["anti_store"])
def q_index_anti_store(spark, sf):
    new = doc_listings(spark, sf).withColumn("fingerprint", fingerprint("company", "title", "location"))
    return anti_store(new, _indexed(spark, _doc_store(spark, sf), epochs=3)).select("ord")


@register("dedupe_two_key", f"""
SELECT k.ord, k.source_url, k.fingerprint FROM {LKEYS} k JOIN ({_greedy_sql(LKEYS)}) g ON g.ord = k.ord""")
def q_dedupe_two_key(spark, sf):
    return two_key_dedupe(key_listings(spark, sf)).select("ord", "source_url", "fingerprint")


LCHAIN = ("(SELECT doc_id AS ord, CAST((doc_id + 1) // 2 AS VARCHAR) AS source_url, "
          "CAST(doc_id // 2 AS VARCHAR) || CASE WHEN doc_id % 97 = 0 THEN '' ELSE 'f' END AS fingerprint FROM documents)")


@register("dedupe_chain", _greedy_sql(LCHAIN))
def q_dedupe_chain(spark, sf):
    """Keys that chain the whole table, each row waiting on the one before it."""
    end = F.when(F.col("doc_id") % 97 == 0, F.lit("")).otherwise(F.lit("f"))
    keys = table(spark, sf, "documents").select(
        F.col("doc_id").alias("ord"), F.floor((F.col("doc_id") + 1) / 2).cast("string").alias("source_url"),
        F.concat(F.floor(F.col("doc_id") / 2).cast("string"), end).alias("fingerprint"))
    return two_key_dedupe(keys).select("ord")


@register("incremental_two_batch", ORACLES["dedupe_two_key"])
def q_incremental_two_batch(spark, sf):
    keys = key_listings(spark, sf)
    landing = scratch_path(spark, "landing")
    store = scratch_path(spark, "store")
    mid = keys.agg(F.percentile_approx("ord", 0.5).alias("m")).first()["m"]
    land_batch(keys.where(F.col("ord") <= mid), landing, 1)
    land_batch(keys.where(F.col("ord") > mid), landing, 2)
    return ingest_available(spark, landing, keys.schema, store).rows().select("ord", "source_url", "fingerprint")


# --- the full run ---------------------------------------------------------
def _run(spark, sf):
    return curate(doc_listings(spark, sf), UNCAPPED, _doc_store(spark, sf), settle=True)


_RUN_ROWS = f"""
(SELECT ord, source_url, {S.fingerprint('company', 'title', 'location')} AS fingerprint,
        {S.failed_tier(UNCAPPED, 'title', 'description', location='location')} AS failed_tier
 FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, source_url ORDER BY ord) AS rn
                      FROM {LDOC}) WHERE rn = 1 AND coalesce(title, '') <> '' AND coalesce(source_url, '') <> ''))"""
_RUN_CAND = f"""
(SELECT ord, source_url, fingerprint FROM {_RUN_ROWS} r WHERE failed_tier IS NULL
   AND source_url NOT IN (SELECT source_url FROM {_sql_doc_store_keys()})
   AND fingerprint NOT IN (SELECT fingerprint FROM {_sql_doc_store_keys()}))"""


@register("run_summary", f"""
WITH rows AS {_RUN_ROWS}, written AS ({_greedy_sql(_RUN_CAND)})
SELECT count(*) AS found, CAST(count_if(failed_tier IS NULL) AS BIGINT) AS passed_filters,
       CAST(count_if(failed_tier IS NOT NULL) AS BIGINT) AS filtered,
       CAST(count_if(failed_tier IS NULL) AS BIGINT) - (SELECT count(*) FROM written) AS duplicates,
       (SELECT count(*) FROM written) AS written, CAST(0 AS BIGINT) AS errors
FROM rows""")
def q_run_summary(spark, sf):
    return _run(spark, sf).summary


_BATCH = "ord > (SELECT max(doc_id) // 2 FROM documents)"


def _stream_sql() -> str:
    """Two runs, one after the other: first-wins looks at each batch, the two-key rule at all written rows."""
    rows = _RUN_ROWS.replace("PARTITION BY source, source_url", f"PARTITION BY {_BATCH}, source, source_url")
    cand = f"(SELECT ord, source_url, fingerprint FROM {rows} r WHERE failed_tier IS NULL)"
    return f"""
SELECT r.source_url, r.fingerprint, 'New' AS status FROM {rows} r
JOIN ({_greedy_sql(cand)}) g ON g.ord = r.ord"""


@register("incremental_run", _stream_sql())
def q_incremental_run(spark, sf):
    listings = doc_listings(spark, sf)
    landing, store = scratch_path(spark, "landing"), scratch_path(spark, "store")
    mid = listings.agg(F.floor(F.max("ord") / 2).alias("m")).first()["m"]
    land_batch(listings.where(F.col("ord") <= mid), landing, 1)
    land_batch(listings.where(F.col("ord") > mid), landing, 2)
    held = ingest_available(spark, landing, listings.schema, store, run_rows(UNCAPPED), LISTING_STORE)
    return held.rows().select("source_url", "fingerprint", "status")


_RUNS = 3
_RUN_OF = f"LEAST(ord * {_RUNS} // ((SELECT max(doc_id) FROM documents) + 1), {_RUNS - 1})"


def _runs_sql() -> str:
    """Runs with first-wins and cap each, then the two-key rule over all in their order."""
    rows = _RUN_ROWS.replace("PARTITION BY source, source_url", f"PARTITION BY {_RUN_OF}, source, source_url")
    rows = rows.replace("SELECT ord, source_url,", "SELECT ord, source,  source_url,", 1)
    capped = (f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_RUN_OF}, source ORDER BY ord) AS place "
              f"FROM {rows}) WHERE place <= {DRIVER_CONFIG.max_jobs_per_source})")
    cand = f"(SELECT ord, source_url, fingerprint FROM {capped} r WHERE failed_tier IS NULL)"
    return f"""
SELECT r.source_url, r.fingerprint, 'New' AS status FROM {_RUN_ROWS.replace('rn = 1', 'rn >= 1')} r
JOIN ({_greedy_sql(cand)}) g ON g.ord = r.ord"""


@register("incremental_runs", _runs_sql())
def q_incremental_runs(spark, sf):
    listings = doc_listings(spark, sf)
    landing, store, checkpoint = (scratch_path(spark, n) for n in ("landing", "store", "checkpoint"))
    end = listings.agg(F.max("ord")).first()[0] + 1
    run = F.least(F.floor(F.col("ord") * _RUNS / end), F.lit(_RUNS - 1))
    for numbers in ((0,), (2, 1)):  # the last two runs land out of order and share a micro-batch
        for number in numbers:
            land_batch(listings.where(run == number), landing, number)
        held = ingest_available(spark, landing, listings.schema, store, run_rows(DRIVER_CONFIG), LISTING_STORE, checkpoint)
    return held.rows().select("source_url", "fingerprint", "status")


_STORE_SAL = "CASE ord % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE '$' || CAST(ord AS VARCHAR) END"
_DOC_HAY = S.join_truthy("title", "description", "NULL")


@register("store_projection", f"""
SELECT title AS job_title, company, location, coalesce(nullif({_STORE_SAL}, ''), 'Not listed') AS salary,
       source_url, {S.employment_type(_DOC_HAY)} AS employment_type,
       {S.experience_level(_DOC_HAY)} AS experience_level, 'New' AS status,
       {S.fingerprint('company', 'title', 'location')} AS fingerprint
FROM {LDOC}""")
def q_store_projection(spark, sf):
    d = doc_listings(spark, sf)
    sal = (F.when(F.col("ord") % 3 == 0, F.lit("")).when(F.col("ord") % 3 == 1, F.lit(None).cast("string"))
           .otherwise(F.concat(F.lit("$"), F.col("ord").cast("string"))))
    return to_store_rows(enrich(d.withColumn("salary", sal))).drop("applied_date")


# --- maintenance ----------------------------------------------------------
def _class_store(spark, sf):
    d = doc_listings(spark, sf)
    et = F.element_at(F.array(F.lit(""), F.lit("Sr"), F.lit("Full-Time"), F.lit("Unknown")),
                      (F.col("ord") % 4 + 1).cast("int"))
    el = F.element_at(F.array(F.lit(""), F.lit("Senior"), F.lit("junior"), F.lit("Unknown"),
                              F.lit(None).cast("string")), (F.col("ord") % 5 + 1).cast("int"))
    return d.select("ord", F.col("title").alias("job_title"), "company", "location",
                    et.alias("employment_type"), el.alias("experience_level"))


_BF_T = S.jstrim("coalesce(title, '')")
_BF_HAY = S.join_truthy(_BF_T, "NULL", S.join_truthy(_BF_T, S.jstrim("coalesce(company, '')"),
                                                    S.jstrim("coalesce(location, '')")))
_BF_BASE = f"""
(SELECT ord, title, company, location,
        coalesce((['', 'Sr', 'Full-Time', 'Unknown'])[ord % 4 + 1], '') AS cur_et,
        coalesce((['', 'Senior', 'junior', 'Unknown', NULL])[ord % 5 + 1], '') AS cur_el FROM {LDOC})"""
_ET_UPD = "(cur_et = '' OR cur_et NOT IN ('Internship', 'Full-Time', 'Unknown'))"
_EL_UPD = ("(cur_el = '' OR cur_el NOT IN ('Internship', 'Entry Level', 'Associate', 'Mid Level', "
           "'Senior', 'Staff+', 'Unknown'))")
_BF_SQL = f"""
(SELECT ord, CASE WHEN {_ET_UPD} THEN {S.employment_type(_BF_HAY)} ELSE cur_et END AS employment_type,
        CASE WHEN {_EL_UPD} THEN {S.experience_level(_BF_HAY)} ELSE cur_el END AS experience_level,
        {_ET_UPD} AS employment_type_updated, {_EL_UPD} AS experience_level_updated
 FROM {_BF_BASE})"""


@register("backfill_classes", f"SELECT * FROM {_BF_SQL}")
def q_backfill_classes(spark, sf):
    return maintain.backfill_classes(_class_store(spark, sf)).select(
        "ord", "employment_type", "experience_level", "employment_type_updated",
        "experience_level_updated")


@register("delta_backfill", f"SELECT ord, employment_type, experience_level FROM {_BF_SQL}")
def q_delta_backfill(spark, sf):
    """Class backfill as deltas of the changed fields only, folded in by a compaction."""
    keyed = _class_store(spark, sf).withColumns({
        "fingerprint": F.sha2(F.col("ord").cast("string"), 256), "source_url": F.concat(F.lit("doc://"), "ord")})
    store = _indexed(spark, keyed, epochs=2)
    changed = maintain.backfill_classes(store.rows())
    for field in ("employment_type", "experience_level"):
        store.update(changed.where(f"{field}_updated"), [field])
    store.compact()
    return store.rows().select("ord", "employment_type", "experience_level")


@register("backfill_summary", f"""
SELECT count(*) AS scanned, CAST(count_if(employment_type_updated OR experience_level_updated) AS BIGINT) AS updated,
       CAST(count_if(employment_type_updated) AS BIGINT) AS employment_type_updated,
       CAST(count_if(experience_level_updated) AS BIGINT) AS experience_level_updated,
       CAST(count_if(NOT (employment_type_updated OR experience_level_updated)) AS BIGINT) AS unchanged
FROM {_BF_SQL}""")
def q_backfill_summary(spark, sf):
    return maintain.backfill_summary(maintain.backfill_classes(_class_store(spark, sf)))


def _legacy_store(spark, sf):
    p = table(spark, sf, "part")
    sal = (F.when(F.col("p_size") % 4 == 0, F.lit("")).when(F.col("p_size") % 4 == 1, F.lit(None).cast("string"))
           .otherwise(F.concat(F.lit("$"), (F.col("p_size") * 1000).cast("string"))))
    return p.select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("title"),
                    F.col("p_brand").alias("company"), F.col("p_type").alias("location"),
                    sal.alias("salary"),
                    F.date_add(F.lit("2026-01-01").cast("date"), F.col("p_size")).alias("date_found"),
                    (F.col("p_size") % 2 == 0).alias("cover_letter"),
                    F.concat(F.lit("v"), (F.col("p_size") % 3).cast("string")).alias("resume_version"))


_MIG_SAL = ("CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN NULL "
            "ELSE '$' || CAST(p_size * 1000 AS VARCHAR) END")


@register("schema_migrate", f"""
SELECT p_partkey AS ord, p_name AS job_title, p_brand AS company, p_type AS location,
       coalesce(nullif({_MIG_SAL}, ''), 'Not listed') AS salary,
       CAST(DATE '2026-01-01' + p_size AS VARCHAR) AS date_posted,
       coalesce({_MIG_SAL}, '') = '' AS salary_filled
FROM part""")
def q_schema_migrate(spark, sf):
    out = maintain.fill_blank_salary(maintain.migrate_schema(_legacy_store(spark, sf)))
    return out.select("ord", "job_title", "company", "location", "salary", "date_posted", "salary_filled")


@register("fill_blank", f"""
SELECT CAST(count_if(coalesce({_MIG_SAL}, '') = '') AS BIGINT) AS filled FROM part""")
def q_fill_blank(spark, sf):
    out = maintain.fill_blank_salary(maintain.migrate_schema(_legacy_store(spark, sf)))
    return out.agg(F.count_if("salary_filled").alias("filled"))


def _dated_store(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey") % 6
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    posted = (F.when(k == 0, day).when(k == 1, F.lit("")).when(k == 2, F.lit("Not listed"))
              .when(k == 3, F.lit(None).cast("string")).when(k == 4, F.lit(" Not Posted "))
              .otherwise(F.lit(BAD_DAY)))
    created = F.timestamp_add("DAY", (F.col("o_orderkey") % 3).cast("int"), F.col("o_orderdate"))
    return o.select(F.col("o_orderkey").alias("ord"),
                    F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("title"),
                    posted.alias("date_found"), created.alias("created_time"))


_RD_BASE = f"""
(SELECT o_orderkey AS ord, 'order ' || CAST(o_orderkey AS VARCHAR) AS job_title,
        CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN ''
             WHEN 2 THEN 'Not listed' WHEN 3 THEN NULL WHEN 4 THEN ' Not Posted ' ELSE '{BAD_DAY}' END AS raw,
        strftime(o_orderdate + INTERVAL (o_orderkey % 3) DAY, '%Y-%m-%d') AS created_day
 FROM orders)"""
_RD_TRIM = S.jstrim("coalesce(raw, '')")
_RD_POSTED = f"coalesce(nullif({_RD_TRIM}, ''), 'Not Posted')"
_RD_SQL = f"""
(SELECT ord, job_title,
        CASE WHEN {_RD_POSTED} IN ('', 'Not listed', 'Not Posted') THEN 'Not Posted'
             WHEN {_RD_POSTED} = '{BAD_DAY}' AND created_day = '{BAD_DAY}' THEN 'Not Posted'
             ELSE {_RD_POSTED} END AS date_posted, created_day
 FROM {_RD_BASE})"""


@register("repair_dates", f"SELECT * FROM {_RD_SQL}")
def q_repair_dates(spark, sf):
    out = maintain.repair_dates(_dated_store(spark, sf), bad_day=BAD_DAY)
    return out.select("ord", "job_title", "date_posted", "created_day")


@register("repair_dates_summary", f"""
SELECT count(*) AS rewritten,
       CAST(count_if(date_posted = 'Not Posted' AND created_day = '{BAD_DAY}') AS BIGINT) AS repaired_fallbacks
FROM {_RD_SQL}""")
def q_repair_dates_summary(spark, sf):
    out = maintain.repair_dates(_dated_store(spark, sf), bad_day=BAD_DAY)
    return maintain.repair_dates_summary(out, BAD_DAY)


# --- company repair and status --------------------------------------------
def _company_store(spark, sf):
    p = table(spark, sf, "pages")
    return p.select(F.col("page_id").alias("ord"), F.col("url").alias("source_url"),
                    F.when(F.col("page_id") % 3 == 0, F.lit("Acme"))
                    .when(F.col("page_id") % 3 == 1, F.lit(None).cast("string"))
                    .otherwise(F.lit("")).alias("company"))


HOSTS = (".example.com", ".example.net")


def _recovered(spark, sf):
    return maintain.recover_company(_company_store(spark, sf), table(spark, sf, "pages"),
                                    heading_line_host=HOSTS[0], heading_at_host=HOSTS[1])


def _page_text_sql(h: str) -> str:
    x = f"regexp_replace({h}, '(?is)<head\\b.*?</head>|<script\\b.*?</script>|<style\\b.*?</style>', '', 'g')"
    x = (f"regexp_replace({x}, '(?i)</?(?:p|div|h[1-6]|li|ul|ol|article|section|header|footer|nav|main|br|tr|table)\\b[^>]*>', "
         f"chr(10), 'g')")
    return f"regexp_replace({x}, '<[^>]+>', '', 'g')"


def _heading_sql(h: str) -> str:
    inner = f"regexp_extract({h}, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1)"
    return S.jstrim(f"regexp_replace({inner}, '<[^>]+>', '', 'g')")


def _link_text_sql(h: str, marker: str) -> str:
    pat = '(?is)<a\\b[^>]*href="[^"]*' + marker.replace(".", "\\.") + '[^"]*"[^>]*>(.*?)</a>'
    return _inner_sql(f"regexp_extract({h}, {S.q(pat)}, 1)")


def _company_element_sql(h: str) -> str:
    pat = '(?is)<[a-z0-9]+\\b[^>]*data-id="company-title"[^>]*>(.*?)</'
    marked = _inner_sql(f"regexp_extract({h}, {S.q(pat)}, 1)")
    return f"coalesce(nullif({marked}, ''), {_link_text_sql(h, '/company/')})"


def _lines_sql(e: str) -> str:
    return f"list_filter(list_transform(string_split({e}, chr(10)), lambda x: {S.jstrim('x')}), lambda x: x <> '')"


def _before_heading_sql(body: str, head: str) -> str:
    pos = f"strpos({body}, {head})"
    before = f"{S.jstrim(f'substring({body}, 1, {pos} - 1)')}"
    ls = _lines_sql(before)
    last = f"{ls}[-1]"
    return (f"CASE WHEN {head} <> '' AND {pos} > 1 AND len({ls}) > 0 AND {last} <> {head} "
            f"THEN {last} ELSE '' END")


def _from_heading_sql(head: str) -> str:
    from harrow.config import HEADING_COMPANY_PATTERN
    return S.jstrim(f"regexp_extract({S.jstrim(head)}, {S.q(S.re2(HEADING_COMPANY_PATTERN))}, 1)")


_H = "coalesce(p.html, '')"
_RULE_LINE = (f"coalesce(nullif({_company_element_sql(_H)}, ''), "
              f"{_before_heading_sql(_page_text_sql(_H), _heading_sql(_H))})")
_RULE_AT = (f"coalesce(nullif({_link_text_sql(_H, '/companies/')}, ''), "
            f"{_from_heading_sql(_heading_sql(_H))})")
_FOUND = (f"CASE WHEN coalesce(s.company, '') = '' AND p.html IS NOT NULL THEN "
          f"CASE WHEN contains(coalesce(s.source_url, ''), '{HOSTS[0]}') THEN {_RULE_LINE} "
          f"WHEN contains(coalesce(s.source_url, ''), '{HOSTS[1]}') THEN {_RULE_AT} ELSE '' END "
          f"ELSE '' END")
_RC_SQL = f"""
(SELECT ord, CASE WHEN found <> '' THEN found ELSE company END AS company, found <> '' AS company_recovered
 FROM (SELECT s.ord, s.company, {_FOUND} AS found
       FROM (SELECT page_id AS ord, url AS source_url,
                    CASE page_id % 3 WHEN 0 THEN 'Acme' WHEN 1 THEN NULL ELSE '' END AS company
             FROM pages) s
       LEFT JOIN pages p ON s.source_url = p.url))"""


@register("recover_company", f"SELECT * FROM {_RC_SQL}")
def q_recover_company(spark, sf):
    return _recovered(spark, sf).select("ord", "company", "company_recovered")


@register("recover_company_summary", f"""
SELECT CAST(count_if(company_recovered) AS BIGINT) AS updated, CAST(count_if(coalesce(company, '') = '') AS BIGINT) AS unresolved
FROM {_RC_SQL}""")
def q_recover_company_summary(spark, sf):
    return maintain.recover_company_summary(_recovered(spark, sf))


def _status_store(spark, sf):
    o = table(spark, sf, "orders")
    st = (F.when(F.col("o_orderstatus") == "F", F.lit("Applied"))
          .when(F.col("o_orderstatus") == "O", F.lit("New")).otherwise(F.lit("Reviewing")))
    return o.select(F.col("o_orderkey").alias("ord"),
                    F.col("o_orderkey").cast("string").alias("fingerprint"),
                    st.alias("status"), "o_orderpriority")


_ST_SQL = ("(SELECT o_orderkey AS ord, CAST(o_orderkey AS VARCHAR) AS fingerprint, "
           "CASE o_orderstatus WHEN 'F' THEN 'Applied' WHEN 'O' THEN 'New' ELSE 'Reviewing' END AS status, "
           "o_orderpriority FROM orders)")


@register("status_scan", f"SELECT ord FROM {_ST_SQL} WHERE status = 'Applied'")
def q_status_scan(spark, sf):
    return with_status(_status_store(spark, sf), "Applied").select("ord")


@register("blank_scan", f"""
SELECT p_partkey AS ord, status FROM (SELECT *, CASE p_size % 3 WHEN 0 THEN 'New' WHEN 1 THEN 'Apply' ELSE 'Offer' END AS status FROM part)
WHERE coalesce({_MIG_SAL}, '') = '' AND status <> 'Offer'""")
def q_blank_scan(spark, sf):
    """Rows without a salary in two states, read from a published snapshot."""
    status = F.when(F.col("p_size") % 3 == 0, F.lit("New")).when(F.col("p_size") % 3 == 1, F.lit("Apply")).otherwise(F.lit("Offer"))
    rows = _legacy_store(spark, sf).join(table(spark, sf, "part").select(F.col("p_partkey").alias("ord"), status.alias("status")), "ord")
    base = scratch_path(spark, "published")
    publish(rows, base)
    store = read_current(spark, base, rows.schema)
    blank = with_blank(store, "salary")
    return with_status(blank, "New").unionByName(with_status(blank, "Apply")).select("ord", "status")


_OPTION_SQL = ("CASE p_size % 5 WHEN 0 THEN '{\"options\":5}' WHEN 1 THEN '{}' ELSE '{\"options\":[{\"name\":\"' || p_brand || "
               "'\",\"c\":1},{\"name\":\"' || p_name || '\",\"c\":2},{\"c\":3},{\"name\":\"' || p_brand || '\",\"c\":' || "
               "CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE '[4]' END || '}]}' END")


@register("map_by_name", f"""
SELECT p_partkey AS ord, CAST(coalesce(len(names), -1) AS INTEGER) AS n_names,
       CASE WHEN names IS NOT NULL AND p_size % 2 = 0 THEN CAST(p_size AS DOUBLE) END AS c,
       CASE WHEN names IS NOT NULL THEN CAST(2 AS DOUBLE) END AS other
FROM (SELECT *, CASE WHEN p_size % 5 > 1 THEN list_distinct(list_filter(
        CAST(json_extract_string({_OPTION_SQL}, '$.options[*].name') AS VARCHAR[]), lambda x: x IS NOT NULL)) END AS names FROM part)""")
def q_map_by_name(spark, sf):
    """Options by name from JSON of several shapes: no options, a number, an array with a name that is repeated."""
    p = spread(table(spark, sf, "part"))
    last = F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.lit("[4]"))
    text = (F.when(F.col("p_size") % 5 == 0, F.lit('{"options":5}')).when(F.col("p_size") % 5 == 1, F.lit("{}"))
            .otherwise(F.concat(F.lit('{"options":[{"name":"'), "p_brand", F.lit('","c":1},{"name":"'), "p_name",
                                F.lit('","c":2},{"c":3},{"name":"'), "p_brand", F.lit('","c":'), last, F.lit("}]}"))))
    named = p.withColumn("m", variants_by_name(payload(text), "options"))
    return named.select(F.col("p_partkey").alias("ord"), F.coalesce(F.size("m"), F.lit(-1)).alias("n_names"),
                        number_at(F.try_element_at("m", F.col("p_brand")), "c").alias("c"),
                        number_at(F.try_element_at("m", F.col("p_name")), "c").alias("other"))


@register("status_update", f"""
SELECT s.ord, coalesce(u.status, s.status) AS status FROM {_ST_SQL} s
LEFT JOIN (SELECT fingerprint, 'Interviewing' AS status FROM {_ST_SQL} WHERE o_orderpriority = '1-URGENT') u
  ON u.fingerprint = s.fingerprint""")
def q_status_update(spark, sf):
    store = _status_store(spark, sf)
    updates = store.where(F.col("o_orderpriority") == "1-URGENT").select(
        "fingerprint", F.lit("Interviewing").alias("status"))
    return update_status(store, updates).select("ord", "status")


@register("delta_status_update", ORACLES["status_update"])
def q_delta_status_update(spark, sf):
    rows = _status_store(spark, sf).withColumn("source_url", F.concat(F.lit("order://"), "ord"))
    store = _indexed(spark, rows)
    urgent = rows.where(F.col("o_orderpriority") == "1-URGENT")
    store.update(urgent.select("fingerprint", F.lit("Apply").alias("status")), ["status"])
    store.update(urgent.select("fingerprint", F.lit("Interviewing").alias("status")), ["status"])
    return store.rows().select("ord", "status")


@register("status_funnel", f"""
SELECT d.status_rank, d.status, coalesce(c.n, 0) AS n
FROM (SELECT * FROM (VALUES (0, 'New'), (1, 'Reviewing'), (2, 'Apply'), (3, 'Applied'),
                            (4, 'Interviewing'), (5, 'Rejected'), (6, 'Offer')) t(status_rank, status)) d
LEFT JOIN (SELECT status, count(*) AS n FROM {_ST_SQL} GROUP BY status) c ON c.status = d.status""")
def q_status_funnel(spark, sf):
    return maintain.status_funnel(_status_store(spark, sf), spark)


# --- typed cells and records -------------------------------------------------
def _cells(spark, sf):
    """A typed cell for each part: the type by size, its value from the part's columns."""
    kind = F.element_at(F.array(*[F.lit(k) for k in ("title", "rich_text", "select", "date")]),
                        (F.col("p_size") % 4 + 1).cast("int"))
    runs = F.array(F.struct(F.concat(F.lit(" "), "p_brand").alias("plain_text")),
                   F.struct(F.lit(None).cast("string").alias("plain_text")),
                   F.struct(F.concat(F.lit(" "), "p_name", F.lit("  ")).alias("plain_text")))
    name = F.when(F.col("p_partkey") % 3 > 0, F.col("p_type"))
    start = F.when(F.col("p_partkey") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("2026-01-"), F.lpad((F.col("p_size") % 28 + 1).cast("string"), 2, "0")))
    cell = F.struct(kind.alias("type"), runs.alias("title"), runs.alias("rich_text"), F.struct(name.alias("name")).alias("select"),
                    F.struct(start.alias("start")).alias("date"), F.lit(None).cast("string").alias("url"))
    return table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 > 0, cell).alias("cell"),
                                           F.col("p_brand").alias("p_brand"))


_CELL_KIND = "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE (['title', 'rich_text', 'select', 'date'])[p_size % 4 + 1] END"
_CELL_RUNS = S.jstrim("' ' || p_brand || ' ' || p_name || '  '")


@register("typed_cells", f"""
SELECT p_partkey, CASE WHEN kind = 'title' THEN {_CELL_RUNS} ELSE '' END AS title,
       CASE WHEN kind = 'rich_text' THEN {_CELL_RUNS} ELSE '' END AS rich_text,
       CASE WHEN kind = 'select' AND p_partkey % 3 > 0 THEN p_type ELSE '' END AS choice,
       CASE WHEN kind = 'date' AND p_partkey % 3 > 0 THEN '2026-01-' || lpad(CAST(p_size % 28 + 1 AS VARCHAR), 2, '0')
            WHEN kind = 'rich_text' THEN {_CELL_RUNS} ELSE 'Not Posted' END AS posted,
       CASE WHEN kind = 'title' THEN p_brand END AS title_property
FROM (SELECT *, {_CELL_KIND} AS kind FROM part)""")
def q_typed_cells(spark, sf):
    from harrow.functions.dates import posted_text
    from harrow.sources.store import cell_text, title_property
    c = _cells(spark, sf)
    return c.select("p_partkey", *[cell_text("cell", k).alias(n) for k, n in (
        ("title", "title"), ("rich_text", "rich_text"), ("select", "choice"))], posted_text("cell").alias("posted"),
        title_property(F.create_map("p_brand", "cell")).alias("title_property"))


_APPLIED = "CASE WHEN p_size % 5 = 0 THEN NULL ELSE '2026-02-' || lpad(CAST(p_size % 28 + 1 AS VARCHAR), 2, '0') END"


@register("application_rows", f"""
SELECT p_brand AS company, p_name AS role, p_type AS location, 'v' || CAST(p_size % 3 AS VARCHAR) AS resume_version,
       'Applied' AS status, 'https://n.example/' || CAST(p_partkey AS VARCHAR) AS notion_url,
       CAST({_APPLIED} AS DATE) AS date_applied, coalesce(CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false END, false) AS cover_letter
FROM part""")
def q_application_rows(spark, sf):
    """Application records, published as a snapshot and read back as the current one."""
    from harrow.sources.store import APPLICATION_STORE, publish, read_current, to_application_rows
    p = table(spark, sf, "part")
    day = F.when(F.col("p_size") % 5 > 0, F.concat(F.lit("2026-02-"), F.lpad((F.col("p_size") % 28 + 1).cast("string"), 2, "0")))
    rows = to_application_rows(p.select(
        F.col("p_brand").alias("company"), F.col("p_name").alias("role"), F.col("p_type").alias("location"),
        F.concat(F.lit("v"), (F.col("p_size") % 3).cast("string")).alias("resume_version"), F.lit("Applied").alias("status"),
        F.concat(F.lit("https://n.example/"), F.col("p_partkey").cast("string")).alias("notion_url"),
        day.alias("date_applied"),
        F.when(F.col("p_size") % 3 == 0, True).when(F.col("p_size") % 3 == 1, False).alias("cover_letter")))
    base = scratch_path(spark, "applications")
    publish(rows, base)
    return read_current(spark, base, APPLICATION_STORE)
