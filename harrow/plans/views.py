"""Listing views over the driver tables.

The driver data has no job listings, so each registered query derives its
listings from a driver table with Spark, over the whole table:

* ``doc_listings``  (Ldoc)  from ``documents``: title = first line,
  description = whole text, company = lang, location = source,
  source = lang, URL = ``doc://`` + SHA-256 of the text, ord = doc_id.
* ``key_listings``  (Lkeys) from ``documents``: URL = doc_id mod 211,
  fingerprint = lang|source, ord = doc_id.  Here URL and fingerprint are
  independent, which is what the two-key rule needs to be exercised.
* ``part_listings`` (Lpart) from ``part``: title = name, company = brand,
  location = type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.functions.text import first_line

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str, partitions: int | None = None) -> DataFrame:
    """A driver table, in as many partitions as stated here or by the session (``spark.harrow.partitions``).

    Unstated, the scan's own splits stay: a table of many files needs no
    shuffle to spread its work.  State a number for a table of few files.
    """
    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    stated = partitions or int(spark.conf.get("spark.harrow.partitions", "0"))
    return rows.repartition(stated) if stated else rows


def spread(rows: DataFrame) -> DataFrame:
    """The same rows in four partitions a core or more, for work that takes long a row: a small file has few splits."""
    wanted = 4 * rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= wanted else rows.repartition(wanted)


def doc_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("ord"),
        F.col("lang").alias("source"),
        first_line("text").alias("title"),
        F.col("text").alias("description"),
        F.col("lang").alias("company"),
        F.col("source").alias("location"),
        F.concat(F.lit("doc://"), F.sha2("text", 256)).alias("source_url"),
    )


def key_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("ord"),
        (F.col("doc_id") % 211).cast("string").alias("source_url"),
        F.concat_ws("|", "lang", "source").alias("fingerprint"),
    )


def part_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("ord"),
        F.lit("part").alias("source"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("company"),
        F.col("p_type").alias("location"),
        F.concat(F.lit("part://"), F.col("p_partkey").cast("string")).alias("source_url"),
    )
