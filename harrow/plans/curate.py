"""The collection run as DataFrame plans.

sources -> per-source validity, first-wins URL dedupe and cap -> union ->
fingerprint + classes -> four-tier verdict -> ordered two-key dedupe against
the store and within the run -> store rows + verdicts + metrics.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from harrow.config import CurationConfig
from harrow.functions.classify import classify, classify_hay
from harrow.functions.text import class_haystack, fingerprint
from harrow.session import work_dir
from harrow.operators.dedupe import cap_per_group, first_wins, two_key_dedupe
from harrow.operators.filters import apply_tiers, present
from harrow.operators.metrics import run_summary
from harrow.sources.indexed import IndexedStore
from harrow.sources.store import append, to_store_rows


def settle_source(listings: DataFrame, cfg: CurationConfig, source: str = "source",
                  url: str = "source_url", order: str = "ord", run: str | None = None) -> DataFrame:
    """Per source (and per value of ``run``, if rows of several runs come together): drop rows without title or URL, keep the first row of each
    URL, then the first ``max_jobs_per_source`` rows in arrival order (None: all).

    Relevance and pre-filters must already be applied (an irrelevant row
    never reserves its URL), and the tier filter must come after (the cap
    counts rows that tiers later reject); a verdict that rides along as a
    column removes nothing and may be computed before.
    """
    valid = listings.where(present("title") & present(url))
    groups = [run, source] if run else [source]
    firsts = first_wins(valid, [*groups, url], order)
    return cap_per_group(firsts, groups, cfg.max_jobs_per_source, order)


def enrich(listings: DataFrame) -> DataFrame:
    """Add fingerprint, employment_type and experience_level."""
    return classify(listings.withColumn("fingerprint", fingerprint("company", "title", "location")))


@dataclass
class RunResult:
    verdicts: DataFrame  # every listing with failed_tier, passed, status
    written: DataFrame  # store rows to append
    summary: DataFrame
    rounds: int


def judge(listings: DataFrame, cfg: CurationConfig) -> DataFrame:
    """Slim rows: fingerprint, verdict and (for rows that pass) classes, without the text.

    One narrow pass over the text; everything after it moves slim rows only.
    """
    text_cols = [c for c in ("description", "card_text", "company_context") if c in listings.columns]

    def c(name):
        return F.col(name) if name in listings.columns else F.lit(None).cast("string")
    fp = listings.withColumn("fingerprint", fingerprint("company", "title", "location"))
    verdicts = apply_tiers(fp, cfg)
    hay = F.when(F.col("passed"), class_haystack(c("title"), c("description"), c("card_text")))
    classed = classify_hay(verdicts, hay)
    for k in ("employment_type", "experience_level"):
        classed = classed.withColumn(k, F.when(F.col("passed"), F.col(k)))
    return classed.drop(*text_cols)


def curate(listings: DataFrame, cfg: CurationConfig, store: DataFrame | IndexedStore | None = None,
           order: str = "ord", settle: bool = False, run: str | None = None,
           quarantine: DataFrame | None = None) -> RunResult:
    """Tier verdicts, two-key dedupe and store rows for a listing set.

    The slim rows of :func:`judge` are settled per source if ``settle`` asks
    for it (else the listings are settled already) and checkpointed; dedupe
    and status labels both read that table, and no shuffle carries text.  The
    counters of the summary are observed while that table is made;
    ``quarantine`` rows count as its errors.
    """
    slim = judge(listings, cfg)
    if settle:
        slim = settle_source(slim, cfg, order=order, run=run)
    work_dir(slim.sparkSession)
    seen = Observation()
    slim = slim.observe(seen, F.count(F.lit(1)).alias("found"), F.count_if("passed").alias("passed")).checkpoint(eager=True)
    kept, rounds = two_key_dedupe(slim.where("passed"), "source_url", "fingerprint", order, store,
                                  return_rounds=True)
    flag = kept.select(order).withColumn("_written", F.lit(True))
    labelled = (slim.join(flag, order, "left")
                .withColumn("status", F.when(~F.col("passed"), F.lit("filtered"))
                            .when(F.col("_written"), F.lit("written"))
                            .otherwise(F.lit("duplicate")))
                .drop("_written"))
    return RunResult(labelled, to_store_rows(kept),
                     run_summary(seen.get["found"], seen.get["passed"], kept, quarantine), rounds)


def run_into_store(listings: DataFrame, cfg: CurationConfig, store_path: str,
                   store: DataFrame | None = None, settle: bool = False) -> RunResult:
    """Curate and append the survivors to the store at ``store_path``."""
    res = curate(listings, cfg, store, settle=settle)
    append(res.written, store_path)
    return res
