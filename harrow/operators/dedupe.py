"""Ordered de-duplication: first-wins per key, per-source caps, existence
checks against a store, and the ordered two-key rule.

Arrival order is an explicit column (``ord``: a number or a struct such as
``(source_rank, board_rank, page_id, section, pos)``), never task order, so results do
not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.operators.selection import first_of_groups
from harrow.session import scratch_path
from harrow.sources.indexed import KEY, URL, IndexedStore


def first_wins(df: DataFrame, keys: Sequence[str], order: str = "ord") -> DataFrame:
    """Keep the earliest row of every key group (``seen``-set dedupe).

    Only ``min(order)`` per key is aggregated (combined map-side, so a key that
    holds a third of all rows is reduced inside each task), and the rows that
    hold it are taken by a join on the keys and the order.  Null keys are a
    group of their own.
    """
    marks = [f"_k{i}" for i in range(len(keys))]
    firsts = df.groupBy(*[F.col(k).alias(m) for k, m in zip(keys, marks, strict=True)]).agg(
        F.min(order).alias("_first"))
    same = df[order] == firsts["_first"]
    for k, m in zip(keys, marks, strict=True):
        same = same & df[k].eqNullSafe(firsts[m])
    return df.join(firsts, same, "left_semi")


#: Largest cap for which Spark plans a partial WindowGroupLimit before the exchange.
GROUP_LIMIT = 1000


def cap_per_group(df: DataFrame, group: str | Sequence[str], n: int | None,
                  order: str = "ord", rank_col: str | None = None) -> DataFrame:
    """Keep the first ``n`` rows of every group in ``order``; None keeps all.

    Up to GROUP_LIMIT, Spark plans a partial ``WindowGroupLimit`` before the
    shuffle, so each task sends at most ``n`` rows per group and one pass is
    enough.  For a larger cap the group's n-th order value is found by
    distributed selection (:mod:`harrow.operators.selection`) and rows up to it
    are kept: no group is sorted or sent to one task.  Orders are unique within
    a group.  ``rank_col`` adds the rank of the rows that are kept, which does
    number them in one task for each group.
    """
    if n is None and rank_col is None:
        return df
    groups = [group] if isinstance(group, str) else list(group)
    kept = first_of_groups(df, groups, order, n) if n is not None and n > GROUP_LIMIT else df
    if rank_col or kept is df:
        name = rank_col or "_rank"
        kept = kept.withColumn(name, F.row_number().over(Window.partitionBy(*groups).orderBy(F.col(order))))
        kept = kept if n is None else kept.where(F.col(name) <= n)
        return kept if rank_col else kept.drop(name)
    return kept


def anti_store(new: DataFrame, store: DataFrame | IndexedStore, url: str = "source_url",
               fp: str = "fingerprint", store_url: str | None = None,
               store_fp: str | None = None) -> DataFrame:
    """Rows whose URL and whose fingerprint are both absent from the store.

    Two ``left_anti`` joins replace one store lookup per row.  An indexed
    store gives its keys in their stored layout, so the batch is shuffled into
    the store's buckets and the store is not shuffled.  Of a plain store AQE
    broadcasts the side only when its measured size is under the broadcast
    threshold; otherwise both sides shuffle on the key, and skewed keys are
    split by the skew-join rule.
    """
    if isinstance(store, IndexedStore):
        su = store.urls().select(F.col(URL).alias(url))
        sf = store.prints().select(F.col(KEY).alias(fp))
        return new.join(su, url, "left_anti").join(sf, fp, "left_anti")
    su = store.select(F.col(store_url or url).alias(url)).where(F.col(url).isNotNull())
    sf = store.select(F.col(store_fp or fp).alias(fp)).where(F.col(fp).isNotNull())
    return new.join(su, url, "left_anti").join(sf, fp, "left_anti")


def _plain_round(cand: DataFrame, order: str, url: str, fp: str) -> DataFrame:
    """Rows that are the earliest remaining one of their URL and of their fingerprint.

    Minima are aggregates combined map-side; the minimum of a group is one row,
    so the join that pairs them is on the unique order and cannot skew.
    """
    by_url = (cand.groupBy(url)
              .agg(F.min(F.struct(F.col(order).alias("o"), F.col(fp).alias("f"))).alias("m"))
              .select(url, F.col("m.o").alias(order), F.col("m.f").alias(fp)))
    by_fp = cand.groupBy(fp).agg(F.min(order).alias(order))
    return by_url.join(by_fp, [order, fp], "inner").select(order, url, fp)


def _pointers(cand: DataFrame, order: str, url: str, fp: str) -> DataFrame:
    """(order, url, fp, ptr) of rows that wait on at most one earlier row: that row's order, or null.

    Only the first two rows of a group can wait on at most one row of it; a
    partial limit takes them in each task, so a hot key sends two rows a task.
    """
    def first_two(key: str, waits: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(key).orderBy(order))
        two = cand.withColumn("_place", place).where(F.col("_place") <= 2)
        first = F.min(order).over(Window.partitionBy(key))
        return two.withColumn(waits, F.when(F.col("_place") == 2, first)).drop("_place")

    by_url = first_two(url, "_by_url")
    by_fp = first_two(fp, "_by_fp").select(F.col(order).alias("_o"), "_by_fp")
    both = by_url.join(by_fp, F.col(order) == F.col("_o")).drop("_o")
    one = F.col("_by_url").isNull() | F.col("_by_fp").isNull() | (F.col("_by_url") == F.col("_by_fp"))
    return both.where(one).select(order, url, fp, F.coalesce("_by_url", "_by_fp").alias("_ptr"))


def _pointer_round(cand: DataFrame, order: str, url: str, fp: str, path: str) -> DataFrame:
    """Rows whose fate follows from chains of rows that wait on one earlier row each, kept ones only.

    Such a row is kept if and only if the one it waits on is not, so two steps
    along a chain compose to one with the product of their signs.  Pointers are
    doubled until each reaches a row that waits on none (which is kept) or one
    that waits on two (undecided here): a chain of n rows takes log2(n) joins.
    Rows that have arrived leave the join, so the end of many chains is no hot key.
    """
    spark = cand.sparkSession
    start = _pointers(cand, order, url, fp).withColumn("_even", F.lit(False))
    start.write.mode("overwrite").parquet(f"{path}/pointers")
    table = spark.read.parquet(f"{path}/pointers")
    roots = table.where(F.col("_ptr").isNull()).select(order, url, fp)
    moving = table.where(F.col("_ptr").isNotNull())
    ends = table.select(F.col(order).alias("_at"), F.col("_ptr").isNull().alias("_root"))
    arrived: list[DataFrame] = []
    while True:
        # A pointer meets a root, or a row with a pointer of its own; one that waits on two is in neither.
        met_path = f"{path}/met={len(arrived)}"
        (moving.join(ends, F.col("_ptr") == F.col("_at")).drop("_at")
         .write.mode("overwrite").partitionBy("_root").parquet(met_path))
        met = spark.read.schema(T.StructType([*moving.schema.fields, T.StructField("_root", T.BooleanType())])).parquet(met_path)
        on = met.where(~F.col("_root")).drop("_root")
        nexts = [moving, *arrived]  # rows that arrived before still say where they arrived
        arrived.append(met.where("_root").drop("_root"))
        if on.isEmpty():
            break
        of = reduce(DataFrame.unionByName, nexts).select(
            F.col(order).alias("_at"), F.col("_ptr").alias("_next"), F.col("_even").alias("_sign"))
        doubled = on.join(of, F.col("_ptr") == F.col("_at")).select(
            order, url, fp, F.col("_next").alias("_ptr"), (F.col("_even") == F.col("_sign")).alias("_even"))
        doubled.write.mode("overwrite").parquet(f"{path}/doubled={len(arrived)}")
        moving = spark.read.parquet(f"{path}/doubled={len(arrived)}")
    found = reduce(DataFrame.unionByName, arrived).where("_even").select(order, url, fp)
    return roots.unionByName(found)


def _greedy_rounds(keys: DataFrame, out_path: str, order: str, url: str, fp: str) -> int:
    """Write the order values of the greedy matching of ``keys`` to ``out_path``; gives the number of rounds.

    ``keys`` holds one row per candidate with unique ``order``.  A plain round
    keeps every row that is the earliest remaining row of its URL group *and*
    of its fingerprint group (such a row would be written by the sequential
    loop: nothing earlier can claim either key), then every row that shares a
    key with a kept row goes.  Repeating until nothing remains yields the
    lexicographically-first maximal matching, i.e. the sequential result
    (Blelloch, Fineman, Shun, SPAA 2012).  Random keys need a handful of
    rounds; a chain, where each row waits on the one before it, would need one
    for every second row.  So a round that leaves more than half of the rows is
    followed by one that decides whole chains (:func:`_pointer_round`).  Each
    round's kept rows are written, and the remaining candidates are
    checkpointed to the shared folder, so lineage stays short and a lost
    executor recomputes at most one round.
    """
    cand = keys.checkpoint(eager=True)
    spark = cand.sparkSession
    left, rounds, chains = cand.count(), 0, False
    while left:
        rounds += 1
        round_path = f"{out_path}/kept/round={rounds}"
        kept = (_pointer_round(cand, order, url, fp, f"{out_path}/chains={rounds}") if chains
                else _plain_round(cand, order, url, fp))
        kept.write.mode("overwrite").parquet(round_path)
        kept = spark.read.parquet(round_path)
        cand = (cand.join(kept.select(url), url, "left_anti")
                .join(kept.select(fp), fp, "left_anti")).checkpoint(eager=True)
        before, left = left, cand.count()
        chains = 2 * left > before
    return rounds


def two_key_dedupe(df: DataFrame, url: str = "source_url", fp: str = "fingerprint",
                   order: str = "ord", store: DataFrame | IndexedStore | None = None,
                   return_rounds: bool = False):
    """Rows the sequential loop would write.

    Rows arrive in ``order``; a row is written iff no store row and no earlier
    *written* row shares its URL or its fingerprint.  Rows blocked by the
    store never write and never block others, so the store anti-joins run
    first; the rest is the greedy matching of :func:`_greedy_rounds`.
    ``order`` must be unique; null keys never match anything.
    """
    spark = df.sparkSession
    cand = df
    if store is not None:
        cand = anti_store(cand, store, url, fp)
    # A null key claims nothing: give it a value no real key can take.
    def _key(c):
        return F.coalesce(F.col(c), F.concat(F.lit("\u0000"), F.col(order).cast("string")))
    keys = cand.select(order, _key(url).alias(url), _key(fp).alias(fp))
    out_path = scratch_path(spark, "two-key")
    rounds = _greedy_rounds(keys, out_path, order, url, fp)
    if rounds == 0:
        result = df.where(F.lit(False))
    else:
        kept = spark.read.parquet(f"{out_path}/kept").select(order)
        result = df.join(kept, order, "left_semi")
    return (result, rounds) if return_rounds else result


def sequential_two_key(rows: Sequence[tuple], store_urls=(), store_fps=()) -> list:
    """Reference model of the loop for tests: rows are (order, url, fp)."""
    used_u, used_f = set(store_urls), set(store_fps)
    out = []
    for o, u, f in sorted(rows):
        if u in used_u or f in used_f:
            continue
        used_u.add(u)
        used_f.add(f)
        out.append(o)
    return out
