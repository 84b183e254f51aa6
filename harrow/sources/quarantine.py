"""What a run could not use: bad payloads, unreadable files, sources that failed.

A run goes on without them, as one failing board or source must not end it, but
they are not lost from sight: each becomes a row (source, place, reason, size) of a
side table, and the run's summary counts them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

S = T.StringType()
QUARANTINE = T.StructType([T.StructField("source", S), T.StructField("place", S), T.StructField("reason", S),
                           T.StructField("size", T.LongType())])

EMPTY, NOT_JSON, WRONG_SHAPE, UNKNOWN_BOARD = "empty payload", "not JSON", "wrong shape", "unknown board"
NOT_LANDED, NO_ROWS, FAILED = "not landed", "no readable rows", "source failed"


def payload_reason(value: Column, shape: str, known_board: Column) -> Column:
    """Why a board payload gives no rows, null if it is well formed.

    Shape A is an object with an array ``jobs``, B an array, C an object with an
    array ``jobs`` or ``jobPostings``.  A payload that breaks off is not JSON, even
    if rows could be read from its beginning.
    """
    whole = F.json_object_keys(value).isNotNull() | F.json_array_length(value).isNotNull()
    if shape == "B":
        fits = F.json_array_length(value).isNotNull()
    else:
        keys = ("jobs",) if shape == "A" else ("jobs", "jobPostings")
        fits = F.json_array_length(F.coalesce(*[F.get_json_object(value, f"$.{k}") for k in keys])).isNotNull()
    return (F.when(F.coalesce(F.trim(value), F.lit("")) == "", F.lit(EMPTY)).when(~whole, F.lit(NOT_JSON))
            .when(~fits, F.lit(WRONG_SHAPE)).when(~known_board, F.lit(UNKNOWN_BOARD)))


def bad_payloads(judged: DataFrame, source: str) -> DataFrame:
    """Quarantine rows of payloads (token, value, reason) that have a reason."""
    return judged.where(F.col("reason").isNotNull()).select(
        F.lit(source).alias("source"), F.col("token").alias("place"), "reason",
        F.coalesce(F.length("value"), F.lit(0)).cast("long").alias("size"))


def unread_files(spark: SparkSession, path: str, rows: DataFrame, source: str) -> DataFrame:
    """Quarantine rows of files under ``path`` from which ``rows`` (read from there) got nothing.

    ``rows`` must have been read with ``ignoreCorruptFiles``.  Only names and
    lengths of files are listed, their contents are not read again.
    """
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    listed = (spark.read.format("binaryFile").load(path).where(F.col("length") > 0)
              .select(name.alias("place"), F.col("length").alias("size")))
    seen = rows.select(F.col("_metadata.file_name").alias("place")).distinct()
    return listed.join(seen, "place", "left_anti").select(
        F.lit(source).alias("source"), "place", F.lit(NO_ROWS).alias("reason"), F.col("size").cast("long").alias("size"))


def whole_source(spark: SparkSession, source: str, reason: str, detail: str = "") -> DataFrame:
    """One quarantine row for a source as a whole."""
    return spark.createDataFrame([(source, detail, reason, 0)], QUARANTINE)


def quarantine_counts(quarantine: DataFrame) -> DataFrame:
    """(source, reason, n) of a side table."""
    return quarantine.groupBy("source", "reason").agg(F.count(F.lit(1)).alias("n"))
