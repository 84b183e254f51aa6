"""The ordered source registry and the collection of one run.

A source is ``Source(label, rank, reader)`` where ``reader(spark, landing,
cfg)`` returns listing rows (already pre-filtered for relevance).  Sources
run in registry order; ``rank`` is the first component of every row's
``ord``.  A disabled source yields no rows but is still listed, so metrics
report it with 0.

Landing layout (one folder per source under ``landing``):
``greenhouse/ lever/ ashby/`` hold ``<token>.json`` board payloads;
``builtin-austin/ builtin-houston/ yc-jobs/`` hold Parquet pages
``(board_rank INT, page_id BIGINT, url STRING, html STRING)`` where
``board_rank`` is the seed URL's position and ``page_id`` the page order.
``details/`` (optional) holds detail pages ``(url, html)`` for company
recovery.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.config import (CITY_LOCATION_PATTERNS, HOST_RULE_HEADING_AT, HOST_RULE_HEADING_LINE,
                           HTML_LOCATION_DEFAULTS, SEEDS, SOURCES, CurationConfig)
from harrow.functions.salary import clean_salary
from harrow.functions.text import blank_to_null, jstrim
from harrow.operators.filters import city_relevant, startup_relevant
from harrow.plans.maintain import page_companies
from harrow.sources.boards import board_scan, judge_payloads, read_payloads
from harrow.sources.quarantine import FAILED, NOT_LANDED, QUARANTINE, bad_payloads, unread_files, whole_source
from harrow.sources.scans import CityRules, city_scan, startup_scan

S = T.StringType()
# Arrival order, unique by construction: JSON sources use page_id 0 and section 0.
ORD = T.StructType([T.StructField("source_rank", T.IntegerType()), T.StructField("board_rank", T.IntegerType()),
                    T.StructField("page_id", T.LongType()), T.StructField("section", T.IntegerType()),
                    T.StructField("pos", T.LongType())])
LISTING = T.StructType([
    T.StructField("source", S),
    T.StructField("ord", ORD),
    T.StructField("title", S), T.StructField("company", S), T.StructField("location", S),
    T.StructField("salary", S), T.StructField("source_url", S), T.StructField("description", S),
    T.StructField("card_text", S), T.StructField("company_context", S)])



@dataclass(frozen=True)
class Source:
    """A plug-in: its reader gives listing rows, its audit what it could not use.

    ``lands`` says that it reads the landing folder of its name, without which
    it has nothing to read.
    """

    label: str
    rank: int
    reader: Callable[[SparkSession, str, CurationConfig], DataFrame] | None
    audit: Callable[[SparkSession, str, CurationConfig], DataFrame] | None = None
    lands: bool = True

    @property
    def enabled(self) -> bool:
        return self.reader is not None


def empty_listings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LISTING)


def html_rows(raw: DataFrame, source: str, rank: int, location_default: str) -> DataFrame:
    """Normalise scanned HTML rows: company ``|| ''``, location ``|| default``,
    cleaned salary, href as URL; card text and company context are dropped,
    as the source does (so later tiers see the title only)."""
    return raw.select(
        F.lit(source).alias("source"),
        F.struct(F.lit(rank).alias("source_rank"), F.col("board_rank").cast("int").alias("board_rank"),
                 F.col("page_id").cast("long").alias("page_id"), F.col("section").cast("int").alias("section"),
                 F.col("pos").cast("long").alias("pos")).alias("ord"),
        F.col("title"),
        F.coalesce(blank_to_null("company"), F.lit("")).alias("company"),
        F.coalesce(blank_to_null("location"), F.lit(location_default)).alias("location"),
        clean_salary("salary").alias("salary"),
        F.col("href").alias("source_url"),
        F.lit(None).cast("string").alias("description"),
        F.lit(None).cast("string").alias("card_text"),
        F.lit(None).cast("string").alias("company_context"))


PAGES = T.StructType([T.StructField("board_rank", T.IntegerType()), T.StructField("page_id", T.LongType()),
                      T.StructField("url", S), T.StructField("html", S)])


def seed_rank(url: Column, label: str) -> Column:
    """Place of the seed URL a page was reached from (its URL begins with it), null for another page."""
    rank = F.lit(None).cast("int")
    for i, seed in reversed(list(enumerate(SEEDS[label]))):
        rank = F.when(url.startswith(seed), F.lit(i)).otherwise(rank)
    return rank


def landed_pages(spark: SparkSession, label: str, path: str, cfg: CurationConfig) -> DataFrame:
    """Landed HTML pages of one source; a page without a board rank takes that of its seed."""
    pages = spark.read.schema(PAGES).option("ignoreCorruptFiles", cfg.skip_unreadable).parquet(path)
    return pages.withColumn("board_rank", F.coalesce("board_rank", seed_rank(F.col("url"), label)))


def audit_pages(label: str) -> Callable[[SparkSession, str, CurationConfig], DataFrame]:
    def audit(spark: SparkSession, landing: str, cfg: CurationConfig) -> DataFrame:
        path = f"{landing}/{slug_of(label)}"
        return unread_files(spark, path, landed_pages(spark, label, path, cfg), label)
    return audit


def audit_board(shape: str, label: str) -> Callable[[SparkSession, str, CurationConfig], DataFrame]:
    def audit(spark: SparkSession, landing: str, cfg: CurationConfig) -> DataFrame:
        payloads = read_payloads(spark, f"{landing}/{slug_of(label)}", cfg.skip_unreadable)
        return bad_payloads(judge_payloads(payloads, shape), label)
    return audit


def seed_dim(spark: SparkSession) -> DataFrame:
    """The seed URLs of the HTML sources in their order (source, source_rank, board_rank, url)."""
    rows = [(label, rank_of(label), i, url) for label, urls in SEEDS.items() for i, url in enumerate(urls)]
    return spark.createDataFrame(rows, "source STRING, source_rank INT, board_rank INT, url STRING")


def city_board(label: str) -> Callable[[SparkSession, str, CurationConfig], DataFrame]:
    no_cards, default = HTML_LOCATION_DEFAULTS[label]
    rules = CityRules(CITY_LOCATION_PATTERNS[label], no_cards, default)
    slug = label.lower().replace(" ", "-")

    def read(spark: SparkSession, landing: str, cfg: CurationConfig) -> DataFrame:
        cards = city_scan(landed_pages(spark, label, f"{landing}/{slug}", cfg), rules,
                          carry=("board_rank",), base_col="url").withColumn("section", F.lit(0))
        # Relevance reads the card text, before the projection drops it.
        relevant = cards.where(city_relevant("title", "card_text"))
        return html_rows(relevant, label, rank_of(label), default)
    return read


def startup_board(spark: SparkSession, landing: str, cfg: CurationConfig) -> DataFrame:
    label = "YC Jobs"
    rows = startup_scan(landed_pages(spark, label, f"{landing}/yc-jobs", cfg), carry=("board_rank",), base_col="url").withColumn("section", F.lit(0))
    relevant = rows.where(startup_relevant("title"))
    return html_rows(relevant, label, rank_of(label), HTML_LOCATION_DEFAULTS[label][1])


def json_board(shape: str, label: str) -> Callable[[SparkSession, str, CurationConfig], DataFrame]:
    def read(spark: SparkSession, landing: str, cfg: CurationConfig) -> DataFrame:
        return board_scan(spark, f"{landing}/{label.lower()}", shape, label, rank_of(label), cfg.skip_unreadable)
    return read


def rank_of(label: str) -> int:
    return [s for s, _ in SOURCES].index(label)


READERS = {
    "Greenhouse": json_board("A", "Greenhouse"),
    "Lever": json_board("B", "Lever"),
    "Ashby": json_board("C", "Ashby"),
    "BuiltIn Austin": city_board("BuiltIn Austin"),
    "BuiltIn Houston": city_board("BuiltIn Houston"),
    "YC Jobs": startup_board,
}
HTML_SOURCES = ("BuiltIn Austin", "BuiltIn Houston", "YC Jobs")
AUDITS = {label: audit_board(shape, label) for shape, label in (("A", "Greenhouse"), ("B", "Lever"), ("C", "Ashby"))} | {
    label: audit_pages(label) for label in HTML_SOURCES}
REGISTRY = tuple(Source(label, i, READERS.get(label) if enabled else None, AUDITS.get(label))
                 for i, (label, enabled) in enumerate(SOURCES))


def enrich_blank_companies(listings: DataFrame, details: DataFrame) -> DataFrame:
    """In-run company recovery, for sources read from HTML: rows whose company
    is null or white space only look up their
    landed detail page (``details(url, html)``) by URL; the city-board rule
    reads the company link or the last line before the heading.  Only blank
    rows are joined, and only per-page candidates (never the HTML) move."""
    blank = (jstrim(F.coalesce(F.col("company"), F.lit(""))) == "") & F.col("source").isin(*HTML_SOURCES)
    cand = page_companies(details)
    todo = listings.where(blank)
    fixed = (todo.join(cand, todo["source_url"] == cand["_url"], "left")
             .withColumn("company", F.coalesce(blank_to_null(F.col("line_rule")), F.col("company")))
             .drop("_url", "line_rule", "at_rule"))
    return listings.where(~blank).unionByName(fixed)


def landed(spark: SparkSession, path: str) -> bool:
    """Whether a landing folder exists (any other failure to look is raised)."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(target)


def slug_of(label: str) -> str:
    return label.lower().replace(" ", "-")


def collect_sources(spark: SparkSession, landing: str, cfg: CurationConfig,
                    registry: tuple[Source, ...] = REGISTRY,
                    details: DataFrame | None = None, settle: bool = True) -> DataFrame:
    """Union of every enabled source's settled rows, in registry order.

    Each source is settled on its own (validity, first-wins URL, cap), or
    with ``settle=False`` left to the run, which settles slim rows.  A source
    whose landing folder does not exist yields no rows; any other error is
    raised, for a source that cannot be read must not look like an empty one.
    Detail pages come from ``details`` or the landing folder of that name.
    """
    from harrow.plans.curate import settle_source
    out = empty_listings(spark)
    for src in registry:
        if not src.enabled or (src.lands and not landed(spark, f"{landing}/{slug_of(src.label)}")):
            continue
        rows = src.reader(spark, landing, cfg)
        out = out.unionByName(settle_source(rows, cfg) if settle else rows, allowMissingColumns=True)
    if details is None and landed(spark, f"{landing}/details"):
        details = spark.read.parquet(f"{landing}/details")
    if details is not None:
        out = enrich_blank_companies(out, details)
    return out


@dataclass
class Collected:
    listings: DataFrame
    quarantine: DataFrame  # what could not be used: (source, place, reason, size)


def collect_run(spark: SparkSession, landing: str, cfg: CurationConfig, registry: tuple[Source, ...] = REGISTRY,
                details: DataFrame | None = None, settle: bool = False) -> Collected:
    """:func:`collect_sources`, but no source or file ends the run.

    Files that cannot be read are passed over and reported, bad payloads are
    reported, and so is a source that fails or has not landed; its rows are
    missing, those of all others are there.
    """
    cfg = cfg.with_(skip_unreadable=True)
    fine, reports = [], []
    for src in registry:
        if not src.enabled:
            continue
        if src.lands and not landed(spark, f"{landing}/{slug_of(src.label)}"):
            reports.append(whole_source(spark, src.label, NOT_LANDED))
            continue
        try:
            src.reader(spark, landing, cfg).schema  # noqa: B018 - a source that fails does so while its plan is made
            if src.audit:
                reports.append(src.audit(spark, landing, cfg))
            fine.append(src)
        except Exception as failure:  # noqa: BLE001 - a plug-in may fail in any way; the report names it
            reports.append(whole_source(spark, src.label, FAILED, type(failure).__name__))
    listings = collect_sources(spark, landing, cfg, tuple(fine), details, settle)
    return Collected(listings, reduce(DataFrame.unionByName, reports, spark.createDataFrame([], QUARANTINE)))


__all__ = ["Source", "Collected", "collect_run", "REGISTRY", "collect_sources", "enrich_blank_companies", "empty_listings",
           "HOST_RULE_HEADING_AT", "HOST_RULE_HEADING_LINE"]
