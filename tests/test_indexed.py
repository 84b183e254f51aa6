"""The indexed store: stored layouts, commits and replays, deltas and compaction."""

import random
import re

import pytest
from pyspark.sql import functions as F

from harrow.operators.dedupe import anti_store, sequential_two_key, two_key_dedupe
from harrow.session import scratch_path
from harrow.sources.indexed import IndexedStore
from harrow.streaming.incremental import ingest_available, land_batch

COLS = "ord long, source_url string, fingerprint string, status string, applied_date date"


def rows_of(spark, n, start=0):
    return spark.range(start, start + n).select(
        F.col("id").alias("ord"), F.concat(F.lit("u"), "id").alias("source_url"),
        F.concat(F.lit("f"), "id").alias("fingerprint"), F.lit("New").alias("status"), F.lit(None).cast("date").alias("applied_date"))


def new_store(spark, buckets=4):
    df = spark.createDataFrame([], COLS)
    return IndexedStore(spark, scratch_path(spark, "t-indexed"), df.schema, buckets)


def scan_paths(df):
    """For each scan of a plan, the operators above it up to the next join."""
    plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
    found = []
    for i, line in enumerate(plan):
        if "FileScan" not in line:
            continue
        depth, above = re.search(r"[A-Za-z*(]", line).start(), []
        for up in reversed(plan[:i]):
            at = re.search(r"[A-Za-z*(]", up)
            if at and at.start() < depth:
                depth = at.start()
                above.append(up)
                if "Join" in up:
                    break
        found.append((line, above))
    return found


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_joins_do_not_shuffle_the_store(spark, no_broadcast):
    store = new_store(spark)
    store.append(rows_of(spark, 100))
    store.append(rows_of(spark, 50, 100))
    store.update(rows_of(spark, 30).withColumn("status", F.lit("Apply")), ["status"])
    batch = spark.createDataFrame([(1, "u3", "x"), (2, "y", "f120"), (3, "y", "x"), (4, None, None)],
                                  "ord long, source_url string, fingerprint string")
    joined = anti_store(batch, store)
    for df in (joined, store.rows()):  # plans before they run
        scans = scan_paths(df)
        assert len(scans) == 2
        for line, above in scans:
            assert "Bucketed: true" in line
            assert not any("Exchange" in a for a in above), above
    # the batch alone is shuffled, once for each key
    assert joined._jdf.queryExecution().executedPlan().toString().count("Exchange") == 2
    assert sorted(r.ord for r in joined.collect()) == [3, 4]


def test_indexed_store_blocks_like_a_plain_one(spark):
    rng = random.Random(4)
    rows = [(i, f"u{rng.randrange(40)}", f"f{rng.randrange(40)}") for i in range(120)]
    held = [(f"u{i}", f"f{100 + i}") for i in range(0, 40, 7)] + [(f"u{100 + i}", f"f{i}") for i in range(0, 40, 9)]
    store = new_store(spark)
    store.append(spark.createDataFrame([(0, u, f, "New", None) for u, f in held], COLS))
    df = spark.createDataFrame(rows, "ord long, source_url string, fingerprint string")
    got = sorted(r.ord for r in two_key_dedupe(df, store=store).collect())
    assert got == sequential_two_key(rows, {u for u, _ in held}, {f for _, f in held})


def test_deltas_fold_in_and_compaction_changes_nothing(spark):
    store = new_store(spark)
    store.append(rows_of(spark, 20))
    changes = spark.createDataFrame([("f1", "Apply", "2026-01-02", 1), ("f1", "Reviewing", None, 2), ("f2", None, "2026-01-03", 1),
                                     ("gone", "Offer", None, 1), (None, "Offer", None, 1), ("f30", "Offer", None, 1)]
                                    + [("f5", "Apply", None, 1)] * 300,
                                    "fingerprint string, status string, applied_date string, seq int")
    store.update(changes, ["status", "applied_date"], order="seq")
    store.update(spark.createDataFrame([("f2", "Offer")], "fingerprint string, status string"), ["status"])
    store.append(rows_of(spark, 20, 20))  # f30 comes after its update

    def state():
        return {r.fingerprint: (r.status, str(r.applied_date)) for r in store.rows().collect()}

    want = {f"f{i}": ("New", "None") for i in range(40)} | {
        "f1": ("Reviewing", "None"), "f2": ("Offer", "2026-01-03"), "f5": ("Apply", "None")}
    assert state() == want and store.commits() == [0, 1, 2, 3]
    before = store.rows()
    assert store.compact() == 1 and store.commits() == [3] and state() == want
    assert before.count() == 40  # the old generation is still there for its readers
    assert {r.source_url for r in store.urls().collect()} == {f"u{i}" for i in range(40)}
    store.update(spark.createDataFrame([("f39", "Applied")], "fingerprint string, status string"), ["status"])
    store.vacuum()
    assert state() == want | {"f39": ("Applied", "None")} and store.commits() == [3, 4]
    again = IndexedStore(spark, store.base, store.schema, buckets=99)  # another session: the store states its buckets
    assert again.buckets == 4 and again.rows().count() == 40


def test_update_rejects_what_it_cannot_do(spark):
    store = new_store(spark)
    for fields in (["nothing"], ["fingerprint"]):
        with pytest.raises(ValueError, match="cannot|can be updated"):
            store.update(rows_of(spark, 1), fields)
    assert store.rows().collect() == [] and store.urls().collect() == [] and store.compact() == 0


class Stopped(Exception):
    pass


def stop(*_):
    raise Stopped("stopped between write and commit")


def test_what_is_not_committed_is_not_read_and_is_cleared(spark):
    store = new_store(spark)
    store.append(rows_of(spark, 5), "w", 0)
    with pytest.raises(Stopped):
        store.append(rows_of(spark, 7, 100), "w", 1, before_commit=stop)
    assert store.rows().count() == 5 and store.urls().count() == 5 and store.done("w") == 0
    store.update(rows_of(spark, 2).withColumn("status", F.lit("Apply")), ["status"])  # takes the same epoch number
    assert sorted(r.status for r in store.rows().collect()) == ["Apply"] * 2 + ["New"] * 3
    assert store.append(rows_of(spark, 7, 100), "w", 1) == 2
    assert store.append(rows_of(spark, 7, 100), "w", 1) is None  # a replay
    assert store.rows().count() == 12
    store.compact()
    assert store.append(rows_of(spark, 7, 100), "w", 1) is None and store.done("w") == 1


def test_stream_stopped_between_write_and_commit_gives_each_row_once(spark):
    # Rows without keys: nothing but the commit log can tell that they are stored already.
    keys = spark.range(30).select(F.col("id").alias("ord"), F.lit(None).cast("string").alias("source_url"),
                                  F.lit(None).cast("string").alias("fingerprint"))
    landing, path, checkpoint = (scratch_path(spark, f"t-{n}") for n in ("landing", "store", "checkpoint"))

    def run(hook=None):
        return ingest_available(spark, landing, keys.schema, path, lambda rows, _: rows, checkpoint=checkpoint, before_commit=hook)

    land_batch(keys.where("ord < 10"), landing, 1)
    run()
    land_batch(keys.where("ord >= 10"), landing, 2)
    with pytest.raises(Exception, match="stopped between write and commit"):
        run(stop)
    store = IndexedStore(spark, path, keys.schema)
    assert store.rows().count() == 10  # written, not committed
    run()
    assert sorted(r.ord for r in store.rows().collect()) == list(range(30))
    run()
    assert store.rows().count() == 30


def test_commit_the_stream_does_not_know_of_is_not_repeated(spark):
    keys = rows_of(spark, 12).select("ord", "source_url", "fingerprint")
    landing, path, checkpoint = (scratch_path(spark, f"t-{n}") for n in ("landing", "store", "checkpoint"))
    land_batch(keys, landing, 1)

    def run(step):
        return ingest_available(spark, landing, keys.schema, path, step, checkpoint=checkpoint)

    def commit_then_fail(rows, store):
        from harrow.streaming.incremental import writer_of
        store.append(rows, writer_of(spark, checkpoint), 0)
        raise Stopped("stopped after the commit")

    with pytest.raises(Exception, match="stopped after the commit"):
        run(commit_then_fail)
    assert run(lambda rows, _: rows).rows().count() == 12
