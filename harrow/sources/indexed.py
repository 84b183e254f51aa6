"""A listing store with stored key layouts, a commit log and keyed deltas.

The store under one base folder holds three bucketed tables:

* ``rows``   the store rows, bucketed and sorted by fingerprint;
* ``urls``   their source URLs, bucketed and sorted by URL;
* ``deltas`` updates of single columns, bucketed and sorted by fingerprint.

A join on the fingerprint or the URL reads the stored layout: the batch is
shuffled into the store's buckets, the store is not shuffled at all.  That holds
for the existence checks of a batch (:meth:`IndexedStore.urls`,
:meth:`IndexedStore.prints`) and for reading the rows with their updates folded
in (:meth:`IndexedStore.rows`), which joins two tables of one layout.

Each write is an *epoch*: a partition of these tables that readers see once its
commit file exists, and that file is made last.  A writer that was stopped before
leaves files nobody reads, and the next one clears them.  A commit may carry the
writer's own number of the batch (a stream's id of its micro-batch): a number that
is committed is never written again, so a replay leaves each row once, whatever
its rows are.

Updates are epochs too and rewrite nothing.  :meth:`IndexedStore.compact` folds
committed epochs into one epoch of a new *generation*, which becomes current with
its marker, created last; readers see the old or the new one, never a part.

Layout: ``base/generation=<g>/{rows,urls,deltas}/epoch=<e>``,
``base/generation=<g>/commits/<e>[@<writer>@<number>]``, ``base/<g>.current`` and
``base/buckets=<n>``.  One writer at a time is assumed, as with one stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.sources.store import LISTING_STORE

KEY, URL = "fingerprint", "source_url"
URL_SCHEMA = T.StructType([T.StructField(URL, T.StringType())])
DELTA_SCHEMA = T.StructType([
    T.StructField(KEY, T.StringType()), T.StructField("field", T.StringType()),
    T.StructField("place", T.LongType()), T.StructField("value", T.StringType())])


class IndexedStore:
    """The store under ``base``, created if there is none.

    ``schema`` must hold the key columns ``fingerprint`` and ``source_url``.
    ``buckets`` counts at creation only (the session's shuffle partitions
    unless given); afterwards the store states its own number.
    """

    def __init__(self, spark: SparkSession, base: str, schema: T.StructType = LISTING_STORE,
                 buckets: int | None = None):
        self.spark, self.base, self.schema = spark, base.rstrip("/"), schema
        self.tables = {"rows": (schema, KEY), "urls": (URL_SCHEMA, URL), "deltas": (DELTA_SCHEMA, KEY)}
        names = self._names("")
        stated = [n for n in names if n.startswith("buckets=")]
        if names and not stated:
            raise ValueError(f"{self.base} holds something else than an indexed store: {names[:5]}")
        if not stated:
            stated = [f"buckets={buckets or int(spark.conf.get('spark.sql.shuffle.partitions'))}"]
            self._create(stated[0])
        self.buckets = int(stated[0].split("=")[1])

    # --- files ---------------------------------------------------------------

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def _names(self, folder: str) -> list[str]:
        fs, path = self._path(folder)
        return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []

    def _create(self, name: str) -> None:
        fs, path = self._path(name)
        fs.create(path, False).close()

    def _delete(self, name: str) -> None:
        fs, path = self._path(name)
        fs.delete(path, True)

    # --- log -----------------------------------------------------------------

    def generation(self) -> int:
        """The current generation (0 before the first compaction)."""
        return max([int(n.split(".")[0]) for n in self._names("") if n.endswith(".current")], default=0)

    def _log(self, generation: int | None = None) -> list[list[str]]:
        g = self.generation() if generation is None else generation
        return [n.split("@") for n in self._names(f"generation={g}/commits") if n[0].isdigit()]

    def commits(self) -> list[int]:
        """Committed epochs of the current generation."""
        return sorted({int(entry[0]) for entry in self._log()})

    def done(self, writer: str) -> int:
        """The largest number this writer has committed, -1 without one."""
        return max((int(e[2]) for e in self._log() if len(e) == 3 and e[1] == writer), default=-1)

    # --- reading -------------------------------------------------------------

    def table(self, kind: str, generation: int | None = None, epochs: list[int] | None = None) -> DataFrame:
        """One of the three tables, committed epochs only, with its stored layout.

        A table of the session's catalogue carries the layout; it is external and
        made anew at each call, because other sessions may have added epochs.
        """
        g = self.generation() if generation is None else generation
        epochs = self.commits() if epochs is None else epochs
        table = self.spark.table(self._register(kind, g))
        return table.where(F.col("epoch").isin(epochs) if epochs else F.lit(False))

    def _register(self, kind: str, generation: int) -> str:
        """Name in the session's catalogue of one table with its layout and partitions."""
        schema, key = self.tables[kind]
        folder = f"generation={generation}/{kind}"
        fs, path = self._path(folder)
        fs.mkdirs(path)
        place = f"{self.base}/{folder}"
        name = f"harrow_{kind}_{hashlib.sha256(place.encode()).hexdigest()[:16]}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.spark.sql(f"CREATE TABLE {name} ({columns}, epoch BIGINT) USING parquet LOCATION '{place}' "
                       f"PARTITIONED BY (epoch) CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {self.buckets} BUCKETS")
        self.spark.catalog.recoverPartitions(name)
        return name

    def urls(self) -> DataFrame:
        """Source URLs in the store, in the layout of the URL."""
        return self.table("urls").select(URL)

    def prints(self) -> DataFrame:
        """Fingerprints in the store, in the layout of the fingerprint."""
        return self.table("rows").select(KEY).where(F.col(KEY).isNotNull())

    def rows(self, generation: int | None = None, epochs: list[int] | None = None) -> DataFrame:
        """The store rows with all updates folded in; nothing is shuffled.

        Of several updates of a column the one of the latest epoch counts, then
        the one of the greatest place, then the greatest value.
        """
        rows, deltas = (self.table(k, generation, epochs) for k in ("rows", "deltas"))
        newest = F.max(F.struct("epoch", "place", "value"))
        folded = (deltas.groupBy(KEY, "field").agg(newest.alias("last"))
                  .groupBy(F.col(KEY).alias("_key"))
                  .agg(F.map_from_entries(F.collect_list(F.struct("field", "last"))).alias("_new")))
        joined = rows.join(folded, F.col(KEY) == F.col("_key"), "left")

        def folded_in(f: T.StructField):
            last = F.try_element_at("_new", F.lit(f.name))
            later = last.isNotNull() & (last["epoch"] >= F.col("epoch"))
            return F.when(later, last["value"].cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name)

        return joined.select(*[F.col(f.name) if f.name == KEY else folded_in(f) for f in self.schema])

    # --- writing -------------------------------------------------------------

    def _write(self, df: DataFrame, kind: str, epoch: int, generation: int) -> None:
        """Write one epoch of a table: a task for each bucket, so one file for each bucket."""
        schema, key = self.tables[kind]
        (df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema],
                   F.lit(epoch).cast("long").alias("epoch"))
         .repartition(self.buckets, key)
         .write.insertInto(self._register(kind, generation)))

    def _write_rows(self, rows: DataFrame, epoch: int, generation: int) -> None:
        self._write(rows, "rows", epoch, generation)
        stored = self.table("rows", generation, [epoch])  # what was written, not the plan that made it once more
        self._write(stored.select(URL).where(F.col(URL).isNotNull()), "urls", epoch, generation)

    def begin(self) -> int:
        """The next epoch, cleared of what a stopped writer left there."""
        epoch = max(self.commits(), default=-1) + 1
        for kind in self.tables:
            self._delete(f"generation={self.generation()}/{kind}/epoch={epoch}")
        return epoch

    def commit(self, epoch: int, writer: str | None = None, number: int | None = None) -> None:
        """Let readers see an epoch."""
        tag = "" if writer is None else f"@{writer}@{number}"
        self._create(f"generation={self.generation()}/commits/{epoch}{tag}")

    def append(self, rows: DataFrame, writer: str | None = None, number: int | None = None,
               before_commit: Callable[[], None] | None = None) -> int | None:
        """Add rows as one epoch; None if the writer has committed this number before.

        A writer's numbers must rise.  ``before_commit`` is called between the
        write and the commit.
        """
        if writer is not None and self.done(writer) >= number:
            return None
        epoch = self.begin()
        self._write_rows(rows, epoch, self.generation())
        if before_commit:
            before_commit()
        self.commit(epoch, writer, number)
        return epoch

    def update(self, changes: DataFrame, fields: list[str], key: str = KEY, order: str | None = None,
               writer: str | None = None, number: int | None = None) -> int | None:
        """Set ``fields`` of the rows named by ``changes(key, *fields)``, as one epoch of deltas.

        Nothing stored is rewritten.  Each named field takes the given value, a
        null included; of several changes of one key the last in ``order`` counts
        (without an order, or on a tie, the greatest value).  Changes of keys the
        store does not hold change nothing, nor those of rows added later.
        """
        unknown = [f for f in fields if f not in self.schema.fieldNames() or f == KEY]
        if unknown:
            raise ValueError(f"not columns that can be updated: {unknown}")
        if writer is not None and self.done(writer) >= number:
            return None
        epoch = self.begin()
        place = (F.col(order) if order else F.lit(0)).cast("long")
        each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"))
                                   for f in fields])).alias("c")
        deltas = (changes.where(F.col(key).isNotNull()).select(F.col(key).alias(KEY), place.alias("place"), each)
                  .select(KEY, "c.field", "place", "c.value"))
        last = F.max(F.struct("place", "value")).alias("last")  # a hot key is combined before it travels
        deltas = deltas.groupBy(KEY, "field").agg(last).select(KEY, "field", "last.place", "last.value")
        self._write(deltas, "deltas", epoch, self.generation())
        self.commit(epoch, writer, number)
        return epoch

    def compact(self) -> int:
        """Fold the committed epochs into one epoch of a new generation and make it current.

        The new log states the folded epoch and each writer's last number, so
        numbers and replays go on as before.
        """
        old, done = self.generation(), self.commits()
        if not done:
            return old
        new, last = old + 1, done[-1]
        self._delete(f"generation={new}")  # of a compaction that was stopped
        self._write_rows(self.rows(old, done), last, new)
        writers = {entry[1] for entry in self._log(old) if len(entry) == 3}
        for name in [str(last), *(f"{last}@{w}@{self.done(w)}" for w in sorted(writers))]:
            self._create(f"generation={new}/commits/{name}")
        self._create(f"{new}.current")
        return new

    def vacuum(self) -> None:
        """Delete generations before the current one, once no reader uses them."""
        current = self.generation()
        for name in self._names(""):
            if name.startswith("generation=") and int(name.split("=")[1]) < current:
                self._delete(name)
