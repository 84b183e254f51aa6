"""Run metrics: summary counters, per-source counts, rejections by tier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run_summary(found: int, passed: int, written: DataFrame, quarantine: DataFrame | None = None) -> DataFrame:
    """found, passed_filters, filtered, duplicates, written, errors.

    ``found`` and ``passed`` are counters the run observed; ``written`` has one
    row per row to be written and ``quarantine`` one per thing that could not
    be used (``errors``).  found = filtered + passed_filters; passed_filters =
    duplicates + written.
    """
    marks = written.select(F.lit(1).alias("w"), F.lit(0).alias("e"))
    if quarantine is not None:
        marks = marks.unionByName(quarantine.select(F.lit(0).alias("w"), F.lit(1).alias("e")))
    sums = marks.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("written"), F.coalesce(F.sum("e"), F.lit(0)).alias("errors"))
    n = lambda v: F.lit(v).cast("long")
    return sums.select(n(found).alias("found"), n(passed).alias("passed_filters"), n(found - passed).alias("filtered"),
                       (n(passed) - F.col("written")).alias("duplicates"), "written", "errors")


def source_counts(listings: DataFrame, sources: DataFrame | None = None,
                  source: str = "source", url: str = "source_url") -> DataFrame:
    """Rows and distinct URLs per source plus a grand total (``source`` null).

    ``sources`` (a registry dimension with a ``source`` column) is
    left-joined so a source that yielded nothing still reports 0.
    """
    agg = listings.rollup(source).agg(F.count(F.lit(1)).alias("found"),
                                      F.count_distinct(url).alias("distinct_urls"))
    if sources is None:
        return agg
    per = sources.select(source).join(agg.where(F.col(source).isNotNull()), source, "left")
    per = per.select(source, F.coalesce("found", F.lit(0)).alias("found"),
                     F.coalesce("distinct_urls", F.lit(0)).alias("distinct_urls"))
    return per.unionByName(agg.where(F.col(source).isNull()))


def tier_counts(verdicts: DataFrame) -> DataFrame:
    """Rejections per failed tier (null tier = passed)."""
    return verdicts.groupBy("failed_tier").agg(F.count(F.lit(1)).alias("n"))


def sources_dim(spark: SparkSession, labels: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(i, s) for i, s in enumerate(labels)],
                                 "source_rank INT, source STRING")
