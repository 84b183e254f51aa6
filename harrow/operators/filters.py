"""Row predicates: board pre-filter, HTML relevance gates, row validity, the
four-tier verdict, domain checks and phrase semi-joins."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.config import (BOARD_TITLE_PHRASES_A, BOARD_TITLE_PHRASES_B, CITY_AI_PATTERNS,
                           CITY_IRRELEVANT_PATTERNS, INTERN_ALLOW_PATTERN, INTERN_PATTERN,
                           STARTUP_AI_PATTERNS, STARTUP_IRRELEVANT_PATTERNS, CurationConfig)
from harrow.functions.regex import JS_SPACE_JAVA
from harrow.functions.text import col_, contains_any, filter_haystack, jstrim, matches_any
from harrow.session import scratch_path

# Characters of a phrase by which phrase_semi looks it up.
ANCHOR_CHARS = 24
# Bytes up to which a phrase table goes to each task whole; a larger one is joined.
PHRASE_TABLE_BYTES = 8 << 20


def board_title_ok(title, shape: str) -> Column:
    """Board pre-filter: lower-cased title contains one of the shape's phrases."""
    phrases = BOARD_TITLE_PHRASES_A if shape == "A" else BOARD_TITLE_PHRASES_B
    return contains_any(F.coalesce(col_(title), F.lit("")), phrases)


def _relevance(title_text: Column, hay: Column, ai, irrelevant, title_low: Column | None = None,
               hay_low: Column | None = None) -> Column:
    intern = matches_any(hay, [INTERN_PATTERN], low=hay_low)
    return ((title_text != "")
            & ~matches_any(title_text, irrelevant, low=title_low)
            & matches_any(hay, ai, low=hay_low)
            & (~intern | matches_any(hay, [INTERN_ALLOW_PATTERN], low=hay_low)))


def with_relevance(df: DataFrame, title="title", card_text="card_text", city: str | None = None,
                   startup: str | None = None) -> DataFrame:
    """Adds the city gate and the startup gate under the names given.

    Title, text and their lower-cased forms are columns of their own first,
    so that the many patterns read them instead of building them again.
    """
    t = jstrim(F.coalesce(col_(title), F.lit("")))
    df = df.withColumn("_title", t).withColumn("_title_low", F.lower("_title"))
    names = ["_title", "_title_low"]
    if city:
        df = (df.withColumn("_text", F.concat(F.col("_title"), F.lit("\n"), F.coalesce(col_(card_text), F.lit(""))))
              .withColumn("_text_low", F.lower("_text"))
              .withColumn(city, _relevance(F.col("_title"), F.col("_text"), CITY_AI_PATTERNS,
                                           CITY_IRRELEVANT_PATTERNS, F.col("_title_low"), F.col("_text_low"))))
        names += ["_text", "_text_low"]
    if startup:
        df = df.withColumn(startup, _relevance(F.col("_title"), F.col("_title"), STARTUP_AI_PATTERNS,
                                               STARTUP_IRRELEVANT_PATTERNS, F.col("_title_low"), F.col("_title_low")))
    return df.drop(*names)


def city_relevant(title="title", card_text="card_text") -> Column:
    """City-board gate: deny patterns on the title, allow patterns on title
    plus card text; intern rows need a research-flavoured match too."""
    t = jstrim(F.coalesce(col_(title), F.lit("")))
    hay = F.concat(t, F.lit("\n"), F.coalesce(col_(card_text), F.lit("")))
    return _relevance(t, hay, CITY_AI_PATTERNS, CITY_IRRELEVANT_PATTERNS)


def startup_relevant(title="title") -> Column:
    """Startup-board gate: same shape as the city gate, on the title only."""
    t = jstrim(F.coalesce(col_(title), F.lit("")))
    return _relevance(t, t, STARTUP_AI_PATTERNS, STARTUP_IRRELEVANT_PATTERNS)


def present(c) -> Column:
    """Row validity: the value is neither null nor ''."""
    return F.coalesce(col_(c), F.lit("")) != ""


def failed_tier(cfg: CurationConfig, title="title", description="description",
                card_text="card_text", company_context="company_context",
                location="location") -> Column:
    """First failing tier (1-4) or null when the row passes.

    1: a blocked title phrase, or no target title phrase;
    2: the listing text has no keyword;  3: it has an excluded phrase
    (2 and 3 apply only when the listing text is non-empty);
    4: the location is not blank, not remote and matches no preferred place
    (skipped when no places are configured).
    """
    return _tier(cfg, F.lower(F.coalesce(col_(title), F.lit(""))), F.lower(F.coalesce(col_(location), F.lit(""))),
                 filter_haystack(title, description, card_text, company_context))


def _tier(cfg: CurationConfig, t: Column, loc: Column, text: Column) -> Column:
    has_text = text != ""
    t1 = contains_any(t, cfg.blocked_job_titles, lowered=True) | ~contains_any(
        t, cfg.job_titles, lowered=True)
    t2 = has_text & ~contains_any(text, cfg.keywords, lowered=True)
    t3 = has_text & contains_any(text, cfg.exclude_keywords, lowered=True)
    if cfg.preferred_locations:
        t4 = ~((loc == "") | loc.contains("remote")
               | contains_any(loc, cfg.preferred_locations, lowered=True))
    else:
        t4 = F.lit(False)
    return (F.when(t1, F.lit(1)).when(t2, F.lit(2)).when(t3, F.lit(3))
            .when(t4, F.lit(4)).otherwise(F.lit(None).cast("int")))


def apply_tiers(df: DataFrame, cfg: CurationConfig) -> DataFrame:
    """Add ``failed_tier`` and ``passed``; missing optional text columns count as empty."""
    def c(name):
        return F.col(name) if name in df.columns else F.lit(None).cast("string")
    # The lower-cased texts are columns of their own, so each phrase test reads them as they are.
    df = df.withColumns({
        "_tier_title": F.lower(F.coalesce(c("title"), F.lit(""))),
        "_tier_place": F.lower(F.coalesce(c("location"), F.lit(""))),
        "_tier_text": filter_haystack(c("title"), c("description"), c("card_text"), c("company_context"))})
    tier = _tier(cfg, F.col("_tier_title"), F.col("_tier_place"), F.col("_tier_text"))
    return (df.withColumn("failed_tier", tier).drop("_tier_title", "_tier_place", "_tier_text")
            .withColumn("passed", F.col("failed_tier").isNull()))


def blank_or_invalid(value, domain: Sequence[str]) -> Column:
    """``!value || !domain.has(value)``."""
    v = col_(value)
    return (F.coalesce(v, F.lit("")) == "") | ~v.isin(*domain)


def route_by_host(url, rules: Sequence[tuple[str, Column]], default: Column | None = None) -> Column:
    """First rule whose marker is a substring of the URL picks the value."""
    u = F.coalesce(col_(url), F.lit(""))
    out = None
    for marker, value in rules:
        out = F.when(u.contains(marker), value) if out is None else out.when(u.contains(marker), value)
    dflt = default if default is not None else F.lit("")
    return dflt if out is None else out.otherwise(dflt)


def phrase_semi(df: DataFrame, text_col: str, phrases: DataFrame, phrase_col: str = "phrase",
                table_bytes: int = PHRASE_TABLE_BYTES) -> DataFrame:
    """Rows whose lower-cased text contains at least one phrase of a table.

    Phrases are looked up by an anchor, which every text that holds the phrase
    holds too:

    * a phrase with whitespace is anchored at the (up to) ANCHOR_CHARS characters
      that follow its first whitespace; wherever the phrase occurs in a text,
      that anchor starts right after a whitespace character of the text;
    * a phrase without whitespace, or with nothing behind its first one, is
      anchored at its first characters, as many as the shortest such phrase has
      (ANCHOR_CHARS at most), and texts are indexed at every position for these,
      if there are any.

    The distinct anchors of a text meet the phrases by a 64-bit hash, and what
    meets is verified with a substring test.  The phrase table is measured
    first.  Up to ``table_bytes`` it becomes one array of hash buckets that goes
    to each task, and the match is a filter within the row: no text is copied,
    no key is asked for and nothing is shuffled.  A larger table meets the
    anchors in a shuffled equi-join, see ``_phrase_join``.  Both give the same
    rows; rows with null keys stay, and an empty phrase is in every text.
    """
    space = f"[{JS_SPACE_JAVA}]"
    low = (phrases.select(F.lower(F.col(phrase_col)).alias("_p")).where(F.col("_p").isNotNull()).distinct())
    sp = F.regexp_instr(F.col("_p"), F.lit(space))  # 1-based, 0 when none
    low = low.withColumn("_a", F.when(sp > 0, F.substring("_p", sp + 1, ANCHOR_CHARS)).otherwise(F.lit("")))
    loose = F.col("_a") == ""
    seen = low.agg(F.min(F.when(loose, F.length("_p"))).alias("shortest"),
                   F.collect_set(F.when(~loose, F.length("_a"))).alias("lengths"),  # ANCHOR_CHARS of them at most
                   F.count("*").alias("phrases"), F.sum(F.octet_length("_p") + 40).alias("size")).first()
    if seen.shortest == 0:
        return df
    if not seen.phrases:
        return df.where(F.lit(False))
    n = min(seen.shortest or 0, ANCHOR_CHARS)
    index = low.select("_p", F.xxhash64(F.when(loose, F.substring("_p", 1, n)).otherwise(F.col("_a"))).alias("_h"))

    def anchors(text: Column) -> Column:
        grams = []
        if seen.lengths:
            behind = F.regexp_extract_all(text, F.lit(f"(?s)(?<={space})(?=(.{{1,{ANCHOR_CHARS}}}))"), 1)
            sizes = F.array(*[F.lit(k) for k in sorted(seen.lengths)])
            grams.append(F.flatten(F.transform(behind, lambda g: F.transform(
                F.filter(sizes, lambda k: k <= F.length(g)), lambda k: F.xxhash64(F.substring(g, F.lit(1), k))))))
        if n:
            every = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), 1)
            grams.append(F.transform(every, lambda g: F.xxhash64(g)))
        return F.array_distinct(F.concat(*grams))

    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    if seen.size > table_bytes:
        return _phrase_join(df, text, anchors, index)
    held = "_phrases"
    while held in df.columns:
        held += "_"
    hit = F.exists(anchors(text), lambda h: F.exists(
        F.get(F.col(held), F.pmod(h, F.lit(2 * seen.phrases)).cast("int")),
        lambda c: (c["_h"] == h) & (F.instr(text, c["_p"]) > 0)))
    # Two projections that collapse into one, so that no row carries the buckets; then a generator,
    # not a filter, because a filter would move below a repartition of df, into the tasks of its scan.
    return (df.withColumn(held, _bucket_array(index, 2 * seen.phrases))
            .select(*df.columns, hit.alias(held))
            .select(*df.columns, F.explode(F.when(F.col(held), F.array(F.lit(True)))).alias(held)).drop(held))


def _bucket_array(index: DataFrame, buckets: int) -> Column:
    """The index as one value: an array by hash modulo ``buckets`` of arrays of its rows."""
    held = index.groupBy(F.pmod("_h", F.lit(buckets)).alias("_b")).agg(
        F.collect_list(F.struct("_h", "_p")).alias("_c"))
    every = index.sparkSession.range(0, buckets, 1, 1).select(F.col("id").alias("_b")).join(held, "_b", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("_b", F.coalesce("_c", F.array()).alias("_c")))),
                                 lambda row: row["_c"])).scalar()


def _phrase_join(df: DataFrame, text: Column, anchors: Callable[[Column], Column], index: DataFrame) -> DataFrame:
    """``phrase_semi`` with a phrase table of any size.

    Texts are written once with a row number of their own, anchors meet the
    index on their hash, and the texts of candidate rows are shuffled to be
    verified.
    """
    texts = df.withColumn("_row", F.monotonically_increasing_id()).withColumn("_t", text)
    path = scratch_path(df.sparkSession, "phrase-texts")
    texts.write.parquet(path)
    texts = df.sparkSession.read.schema(texts.schema).parquet(path)
    found = texts.select("_row", F.explode(anchors(F.col("_t"))).alias("_h"))
    pairs = found.join(index, "_h").select("_row", "_p").distinct()
    hits = texts.select("_row", "_t").join(pairs, "_row").where(F.instr("_t", F.col("_p")) > 0).select("_row")
    return texts.join(hits.distinct(), "_row", "left_semi").select(*df.columns)
