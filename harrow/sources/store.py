"""The listing store and the application store as Parquet tables.

Writes are appends of new rows or whole new snapshots (plain Parquet has no
MERGE); reads are scans with pushed-down filters.  A store row's id is its
fingerprint.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.config import NOT_LISTED
from harrow.functions.text import col_, jstrim, or_default

S = T.StringType()
LISTING_STORE = T.StructType([
    T.StructField("job_title", S), T.StructField("company", S), T.StructField("location", S),
    T.StructField("salary", S), T.StructField("source_url", S),
    T.StructField("employment_type", S), T.StructField("experience_level", S),
    T.StructField("status", S), T.StructField("fingerprint", S),
    T.StructField("applied_date", T.DateType())])
APPLICATION_STORE = T.StructType([
    T.StructField("company", S), T.StructField("role", S), T.StructField("location", S),
    T.StructField("resume_version", S), T.StructField("status", S),
    T.StructField("notion_url", S), T.StructField("date_applied", T.DateType()),
    T.StructField("cover_letter", T.BooleanType())])

RICH_RUN = T.ArrayType(T.StructType([T.StructField("plain_text", S)]))
CELL = T.StructType([
    T.StructField("type", S), T.StructField("title", RICH_RUN), T.StructField("rich_text", RICH_RUN),
    T.StructField("select", T.StructType([T.StructField("name", S)])),
    T.StructField("date", T.StructType([T.StructField("start", S)])), T.StructField("url", S)])


def to_store_rows(listings: DataFrame) -> DataFrame:
    """Listing -> store row: salary defaults to ``Not listed``, classes to
    ``Unknown``, status is always ``New``."""
    def c(name):
        return F.col(name) if name in listings.columns else F.lit(None).cast("string")
    return listings.select(
        F.col("title").alias("job_title"), "company", "location",
        or_default(c("salary"), NOT_LISTED).alias("salary"), "source_url",
        or_default(c("employment_type"), "Unknown").alias("employment_type"),
        or_default(c("experience_level"), "Unknown").alias("experience_level"),
        F.lit("New").alias("status"), "fingerprint",
        F.lit(None).cast("date").alias("applied_date"))


def to_application_rows(apps: DataFrame) -> DataFrame:
    """Application record: the eight fields, typed."""
    return apps.select(
        "company", "role", "location", "resume_version", "status", "notion_url",
        F.col("date_applied").cast("date").alias("date_applied"),
        F.coalesce(F.col("cover_letter").cast("boolean"), F.lit(False)).alias("cover_letter"))


def read_store(spark: SparkSession, path: str, schema: T.StructType = LISTING_STORE) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


#: Order of the rows within the files of a snapshot: by status, then by which fields are blank.
CLUSTER = ("status",)
BLANKS = ("company", "salary")


def publish(df: DataFrame, base: str, cluster: Sequence[str] = CLUSTER, blanks: Sequence[str] = BLANKS,
            row_group_bytes: int | None = None) -> str:
    """Write a new snapshot of a store and make it the current one.

    Rows are sorted within the files (no shuffle) by ``cluster`` and by whether
    the ``blanks`` are blank, so that a scan for a status or a blank field leaves
    out the row groups that hold none; columns the store lacks are passed over.

    Snapshots are numbered folders under ``base``; a snapshot is current once
    its marker ``<n>.current`` exists, and that is created last, so readers see
    the old or the new one, never a part.  The plan of ``df`` may read the
    snapshot it replaces.
    """
    spark = df.sparkSession
    number = max([n for n, _ in _snapshots(spark, base)], default=0) + 1
    path = f"{base.rstrip('/')}/snapshot={number}"
    order = [F.col(c) for c in cluster if c in df.columns] + [~is_blank(c) for c in blanks if c in df.columns]
    out = (df.sortWithinPartitions(*order) if order else df).write.mode("overwrite")
    (out.option("parquet.block.size", row_group_bytes) if row_group_bytes else out).parquet(path)
    fs, target = _fs(spark, f"{base.rstrip('/')}/{number}.current")
    fs.create(target, False).close()
    return path


def read_current(spark: SparkSession, base: str, schema: T.StructType = LISTING_STORE) -> DataFrame:
    """The current snapshot of a published store; an empty one before the first."""
    done = [p for _, p in sorted(_snapshots(spark, base)) if p]
    return read_store(spark, done[-1], schema) if done else spark.createDataFrame([], schema)


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), target


def _snapshots(spark: SparkSession, base: str) -> list[tuple[int, str | None]]:
    """(number, path of the snapshot, null while it has no marker)."""
    fs, target = _fs(spark, base)
    if not fs.exists(target):
        return []
    names = {f.getPath().getName() for f in fs.listStatus(target)}
    numbers = [int(n.split("=")[1]) for n in names if n.startswith("snapshot=")]
    return [(n, f"{base.rstrip('/')}/snapshot={n}" if f"{n}.current" in names else None) for n in numbers]


def with_status(store: DataFrame, status: str) -> DataFrame:
    """Rows in one status (pushed down to the Parquet scan)."""
    return store.where(F.col("status") == status)


def is_blank(column: str) -> Column:
    """Null or '', in a form that is pushed down to the Parquet scan."""
    return F.col(column).isNull() | (F.col(column) == "")


def with_blank(store: DataFrame, column: str) -> DataFrame:
    """Rows whose column is null or '' (every such row, no page cut; pushed down to the Parquet scan)."""
    return store.where(is_blank(column))


def update_status(store: DataFrame, updates: DataFrame, key: str = "fingerprint",
                  order: str | None = None) -> DataFrame:
    """Keyed status update, no domain or transition check: rows named in
    ``updates(key, status)`` take the new status, all others keep theirs.

    Of several updates of one key the last in ``order`` counts (without an
    order, or on a tie, the largest status), so no store row is doubled.
    """
    last = F.struct(*([F.col(order)] if order else []), F.col("status"))
    u = (updates.where(F.col(key).isNotNull()).groupBy(key)
         .agg(F.max(last).alias("_last")).select(F.col(key), F.col("_last.status").alias("_new_status")))
    return (store.join(u, key, "left")
            .withColumn("status", F.coalesce(F.col("_new_status"), F.col("status")))
            .drop("_new_status").select(*store.columns))


def cell_text(cell, kind: str = "title") -> Column:
    """Typed cell -> text: runs of ``title``/``rich_text`` joined and trimmed,
    ``select`` name; a cell of another type gives ''."""
    c = col_(cell)
    if kind in ("title", "rich_text"):
        runs = F.transform(c[kind], lambda r: F.coalesce(r["plain_text"], F.lit("")))
        val = jstrim(F.array_join(runs, ""))
    elif kind == "select":
        val = F.coalesce(c["select"]["name"], F.lit(""))
    else:
        raise ValueError(kind)
    return F.when(c.isNotNull() & (c["type"] == kind), F.coalesce(val, F.lit(""))).otherwise(F.lit(""))


def title_property(props) -> Column:
    """Name of the first property whose type is ``title`` (map<string, cell>)."""
    keys = F.map_keys(F.map_filter(col_(props), lambda k, v: v["type"] == "title"))
    return F.get(F.array_sort(keys), 0)


def first_existing(df: DataFrame, *names: str) -> str | None:
    """The first of ``names`` that is a column of ``df`` (schema check, no action)."""
    for n in names:
        if n in df.columns:
            return n
    return None
