"""Incremental ingestion with Structured Streaming.

One stream reads the landing root, whose numbered folders (``batch=000001`` ...)
are runs.  Each micro-batch runs the batch plan of the run (fingerprint, verdict
and classes in one narrow pass, first-wins and cap for each run and source,
two-key dedupe against the store, store rows) and is committed to an
:class:`~harrow.sources.indexed.IndexedStore` as one epoch that carries the
micro-batch's id.  A micro-batch that was stopped between its write and its commit
is replayed by the stream: what it had written is cleared, and it is written
again.  One that was committed before the stream knew is skipped.  So each row is
written once whatever its keys are, and recovery does not rest on the two-key rule.
Built-in ``dropDuplicates`` state is not used because it knows one key set, not the
ordered two-key rule.

Rows of one micro-batch arrive in the order (run, ``ord``), so the number of a
folder decides and not its file time; folders that land after a micro-batch has
begun belong to a later one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.config import CurationConfig
from harrow.operators.dedupe import two_key_dedupe
from harrow.plans.curate import curate
from harrow.session import scratch_path
from harrow.sources.indexed import IndexedStore


def land_batch(df: DataFrame, landing: str, number: int) -> None:
    """Write one numbered batch."""
    df.write.parquet(f"{landing.rstrip('/')}/batch={number:06d}")


def dedupe_rows(url: str = "source_url", fp: str = "fingerprint", order: str = "_arrival"):
    """A step that keeps the rows the two-key rule writes, as they are."""
    def run(rows: DataFrame, store: IndexedStore) -> DataFrame:
        return two_key_dedupe(rows, url, fp, order, store)
    return run


def run_rows(cfg: CurationConfig):
    """A step that runs the whole collection run and yields store rows."""
    def run(rows: DataFrame, store: IndexedStore) -> DataFrame:
        return curate(rows, cfg, store, order="_arrival", settle=True, run="batch").written
    return run


def writer_of(spark: SparkSession, checkpoint: str) -> str:
    """The name under which a stream commits: an id kept in its checkpoint folder.

    A new checkpoint counts its micro-batches from 0 again and is another writer.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/writer")
    fs = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    if not names:
        names = [uuid.uuid4().hex]
        fs.create(spark._jvm.org.apache.hadoop.fs.Path(folder, names[0]), False).close()
    return names[0]


def ingest_available(spark: SparkSession, landing: str, schema: T.StructType, store_path: str,
                     step: Callable[[DataFrame, IndexedStore], DataFrame] | None = None,
                     store_schema: T.StructType | None = None, checkpoint: str | None = None,
                     before_commit: Callable[[int], None] | None = None) -> IndexedStore:
    """Process everything landed and not yet processed, then stop; gives the store.

    ``step(rows, store)`` gives the rows to append to the store, from rows with
    the columns ``batch`` (the run) and ``_arrival`` (their order); the rows of the
    two-key rule by default.  ``before_commit(id)`` is called between the write
    and the commit of a micro-batch.
    """
    checkpoint = checkpoint or scratch_path(spark, "stream-ckpt")
    step = step or dedupe_rows()
    store = IndexedStore(spark, store_path, store_schema or schema)
    writer = writer_of(spark, checkpoint)

    def land(rows: DataFrame, number: int) -> None:
        if store.done(writer) >= number:
            return
        arrived = rows.withColumn("_arrival", F.struct("batch", "ord"))
        store.append(step(arrived, store), writer, number, (lambda: before_commit(number)) if before_commit else None)

    runs = T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])
    query = (spark.readStream.schema(runs).parquet(landing)
             .writeStream.foreachBatch(land)
             .option("checkpointLocation", f"{checkpoint.rstrip('/')}/stream")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return store
