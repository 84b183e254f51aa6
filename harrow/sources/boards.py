"""Scans over landed JSON board payloads (one file per board, named
``<token>.json``), normalised to the listing shape.

Each file is read whole (``wholetext``) so that a posting's position in the
payload survives as ``ord.pos``; the board comes from the file name and is
looked up in a constant board dimension (15 rows per source, so broadcasting
it is safe).  Bad JSON, a missing file or a payload of the wrong shape yields
no rows, and the run goes on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.config import (BOARDS_A, BOARDS_B, BOARDS_C, URL_TEMPLATE_A, URL_TEMPLATE_B,
                           URL_TEMPLATE_C)
from harrow.functions.salary import salary_from_compensation, salary_from_range
from harrow.functions.text import blank_to_null, collapse_ws, jstrim, or_default, strip_tags
from harrow.operators.filters import board_title_ok
from harrow.sources.quarantine import payload_reason

S = T.StringType()
D = T.DoubleType()

SHAPE_A = T.StructType([T.StructField("jobs", T.ArrayType(T.StructType([
    T.StructField("id", T.LongType()), T.StructField("title", S), T.StructField("content", S),
    T.StructField("location", T.StructType([T.StructField("name", S)])),
    T.StructField("company", T.StructType([T.StructField("name", S)])),
    T.StructField("absolute_url", S)])))])

SHAPE_B_ITEM = T.StructType([
    T.StructField("id", S), T.StructField("text", S), T.StructField("description", S),
    T.StructField("descriptionPlain", S),
    T.StructField("descriptionBody", T.StructType([T.StructField("descriptionPlain", S)])),
    T.StructField("categories", T.StructType([T.StructField("location", S)])),
    T.StructField("workplaceType", S),
    T.StructField("salaryRange", T.StructType([T.StructField("min", D), T.StructField("max", D),
                                               T.StructField("currency", S)])),
    T.StructField("hostedUrl", S)])
SHAPE_B = T.ArrayType(SHAPE_B_ITEM)

COMPENSATION = T.StructType([
    T.StructField("summaryComponents", T.ArrayType(T.StructType([
        T.StructField("currencyCode", S), T.StructField("minValue", D),
        T.StructField("maxValue", D)]))),
    T.StructField("currency", S), T.StructField("currencyCode", S),
    T.StructField("minValue", D), T.StructField("maxValue", D),
    T.StructField("compensationTierSummary", S)])
SHAPE_C_ITEM = T.StructType([
    T.StructField("id", S), T.StructField("title", S), T.StructField("descriptionPlain", S),
    T.StructField("description", S), T.StructField("location", S),
    T.StructField("locationName", S), T.StructField("jobUrl", S),
    T.StructField("compensation", COMPENSATION)])
SHAPE_C = T.StructType([T.StructField("jobs", T.ArrayType(SHAPE_C_ITEM)),
                        T.StructField("jobPostings", T.ArrayType(SHAPE_C_ITEM))])

BOARDS = {"A": BOARDS_A, "B": BOARDS_B, "C": BOARDS_C}
TEMPLATES = {"A": URL_TEMPLATE_A, "B": URL_TEMPLATE_B, "C": URL_TEMPLATE_C}


def board_dim(spark: SparkSession, shape: str) -> DataFrame:
    rows = [(i, name, token) for i, (name, token) in enumerate(BOARDS[shape])]
    return spark.createDataFrame(rows, "board_rank INT, board_name STRING, token STRING")


def read_payloads(spark: SparkSession, path: str, skip_unreadable: bool = False) -> DataFrame:
    """(token, value) for every landed board file under ``path``."""
    raw = (spark.read.option("wholetext", True).option("ignoreMissingFiles", True)
           .option("ignoreCorruptFiles", skip_unreadable)
           .text(path).select("value", F.col("_metadata.file_path").alias("file")))
    return raw.select(F.regexp_extract("file", r"([^/]+)\.json$", 1).alias("token"), "value")


def _fallback_url(shape: str, token: Column, job_id: Column) -> Column:
    prefix, rest = TEMPLATES[shape].split("{token}")
    middle = rest.split("{id}")[0]
    return F.concat(F.lit(prefix), token, F.lit(middle),
                    F.coalesce(job_id.cast("string"), F.lit("undefined")))


def _items(payloads: DataFrame, shape: str) -> DataFrame:
    v = F.col("value")
    if shape == "A":
        arr = F.from_json(v, SHAPE_A)["jobs"]
    elif shape == "B":
        # A bare object would parse as a one-element array; the payload must be an array.
        arr = F.when(F.json_array_length(v).isNotNull(), F.from_json(v, SHAPE_B))
    else:
        obj = F.from_json(v, SHAPE_C)
        arr = F.coalesce(obj["jobs"], obj["jobPostings"])
    return payloads.select("token", F.posexplode(arr).alias("pos", "j"))


def board_scan(spark: SparkSession, path: str, shape: str, source: str,
               source_rank: int, skip_unreadable: bool = False) -> DataFrame:
    """Listings of one JSON source, after its title pre-filter, in arrival order."""
    return board_listings(read_payloads(spark, path, skip_unreadable), shape, source, source_rank)


def judge_payloads(payloads: DataFrame, shape: str) -> DataFrame:
    """Adds ``reason``: why a payload (token, value) gives no rows, null if it is well formed."""
    known = F.col("token").isin(*[t for _, t in BOARDS[shape]])
    return payloads.withColumn("reason", payload_reason(F.col("value"), shape, F.coalesce(known, F.lit(False))))


def board_listings(payloads: DataFrame, shape: str, source: str, source_rank: int) -> DataFrame:
    """Listings of well-formed payload rows (token, value)."""
    payloads = judge_payloads(payloads, shape).where(F.col("reason").isNull()).drop("reason")
    items = _items(payloads, shape)
    dims = F.broadcast(board_dim(payloads.sparkSession, shape))
    j = F.col("j")
    x = items.join(dims, "token", "inner")
    if shape == "A":
        title, company = j["title"], F.when(j["company"].isNotNull(), j["company"]["name"]).otherwise(
            F.col("board_name"))
        description = collapse_ws(strip_tags(F.coalesce(j["content"], F.lit(""))))
        location = or_default(j["location"]["name"], "")
        salary = F.lit("Not listed")
        url = F.coalesce(blank_to_null(j["absolute_url"]), _fallback_url("A", F.col("token"), j["id"]))
    elif shape == "B":
        title, company = j["text"], F.col("board_name")
        lists = F.coalesce(blank_to_null(j["descriptionBody"]["descriptionPlain"]),
                           blank_to_null(j["descriptionPlain"]), F.lit(""))
        description = jstrim(strip_tags(F.coalesce(blank_to_null(j["description"]), lists)))
        location = F.coalesce(blank_to_null(j["categories"]["location"]),
                              blank_to_null(j["workplaceType"]), F.lit(""))
        salary = F.when(j["salaryRange"].isNull(), F.lit("Not listed")).otherwise(
            salary_from_range(j["salaryRange"]))
        url = F.coalesce(blank_to_null(j["hostedUrl"]), _fallback_url("B", F.col("token"), j["id"]))
    else:
        title, company = j["title"], F.col("board_name")
        description = jstrim(strip_tags(F.coalesce(blank_to_null(j["descriptionPlain"]),
                                                   blank_to_null(j["description"]), F.lit(""))))
        location = F.coalesce(blank_to_null(j["location"]), blank_to_null(j["locationName"]), F.lit(""))
        salary = salary_from_compensation(j["compensation"])
        url = F.coalesce(blank_to_null(j["jobUrl"]), _fallback_url("C", F.col("token"), j["id"]))
    return (x.where(board_title_ok(title, "A" if shape == "A" else "B"))
            .select(F.lit(source).alias("source"),
                    F.struct(F.lit(source_rank).alias("source_rank"), F.col("board_rank"),
                             F.lit(0).cast("long").alias("page_id"), F.lit(0).alias("section"),
                             F.col("pos").cast("long").alias("pos")).alias("ord"),
                    or_default(title, "Not listed").alias("title"),
                    company.alias("company"), location.alias("location"),
                    salary.alias("salary"), url.alias("source_url"),
                    description.alias("description"),
                    F.lit(None).cast("string").alias("card_text"),
                    F.lit(None).cast("string").alias("company_context")))
