"""Distributed selection: the n-th value of an order within each group, without sorting a group.

Each pass looks at the range of the order that holds a group's n-th value.  A few
order values of that range (about EDGES, by hash) cut it into parts, the rows of
each part are counted in the tasks, and the part in which the count passes n is the
next range.  Ranges shrink EDGES-fold at each pass until one holds at most SMALL
rows, whose order values are sorted in one small array.  Rows are only counted:
none is shuffled, and what a group gives to one task is bounded whatever its size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.session import scratch_path

EDGES = 64
SMALL = 4_096
#: Passes that may fail to shrink any range before the order is taken to hold ties.
PATIENCE = 16


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    """Equal columns by name, nulls equal to nulls."""
    same = F.lit(True)
    for a, b in zip(left, right, strict=True):
        same = same & F.col(a).eqNullSafe(F.col(b))
    return same


def nth_of_groups(df: DataFrame, groups: Sequence[str], order: str, n: int) -> tuple[DataFrame, list[str]] | None:
    """The ``n``-th smallest ``order`` of each group with more than ``n`` rows, as (marks of the group, ``_cut``).

    Null if no group has more rows.  Orders must be unique within a group and
    not null; they may be of any type that compares.
    """
    marks = [f"_g{i}" for i in range(len(groups))]
    keys = df.select(*[F.col(g).alias(f"_k{i}") for i, g in enumerate(groups)], F.col(order).alias("_o"))
    names = [f"_k{i}" for i in range(len(groups))]
    null = F.lit(None).cast(keys.schema["_o"].dataType)
    state = _written(keys.groupBy(*[F.col(k).alias(m) for k, m in zip(names, marks, strict=True)])
                     .agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > n)
                     .select(*marks, "_n", F.lit(n).cast("long").alias("_need"), null.alias("_lo"), null.alias("_hi")), "nth")
    largest, stuck = state.agg(F.max("_n")).first()[0], 0
    if largest is None:
        return None

    def within(state: DataFrame) -> DataFrame:
        met = keys.join(state, _same(names, marks))
        return met.where((F.col("_lo").isNull() | (F.col("_o") > F.col("_lo")))
                         & (F.col("_hi").isNull() | (F.col("_o") <= F.col("_hi"))))

    step = 0
    while largest > SMALL:
        step += 1
        picked = F.pmod(F.xxhash64("_o", F.lit(step)), F.ceil(F.col("_n") / EDGES)) == 0
        others = [f"_e{i}" for i in range(len(groups))]
        edges = (within(state).where(picked).groupBy(*[F.col(m).alias(e) for m, e in zip(marks, others, strict=True)])
                 .agg(F.sort_array(F.collect_set("_o")).alias("_edges")))
        edged = _written(state.join(edges, _same(marks, others), "left").select(*state.columns, "_edges"), "nth-edges")
        part = F.coalesce(F.size(F.filter("_edges", lambda e: e < F.col("_o"))), F.lit(0))
        counts = within(edged).groupBy(*marks, part.alias("_part")).agg(
            F.count(F.lit(1)).alias("_c"), *[F.first(c).alias(c) for c in ("_need", "_lo", "_hi", "_edges")])
        upto = F.sum("_c").over(Window.partitionBy(*marks).orderBy("_part"))  # at most EDGES parts or so of a group
        holds = counts.withColumn("_upto", upto).where((F.col("_upto") >= F.col("_need")) & (F.col("_upto") - F.col("_c") < F.col("_need")))
        state = _written(holds.select(
            *marks, F.col("_c").alias("_n"), (F.col("_need") - F.col("_upto") + F.col("_c")).alias("_need"),
            F.coalesce(F.get("_edges", F.col("_part") - 1), F.col("_lo")).alias("_lo"),
            F.coalesce(F.get("_edges", F.col("_part")), F.col("_hi")).alias("_hi")), "nth")
        before, largest = largest, state.agg(F.max("_n")).first()[0]
        stuck = stuck + 1 if largest == before else 0
        if stuck > PATIENCE:
            raise ValueError(f"{order} must be unique within {list(groups)}: over {SMALL} rows share a value")
    cut = F.get(F.sort_array(F.collect_list("_o")), F.first("_need").cast("int") - 1)
    return _written(within(state).groupBy(*marks).agg(cut.alias("_cut")), "nth-cut"), marks


def first_of_groups(df: DataFrame, groups: Sequence[str], order: str, n: int) -> DataFrame:
    """The first ``n`` rows of each group in ``order``: rows up to the group's n-th order value."""
    if n <= 0:
        return df.where(F.lit(False))
    found = nth_of_groups(df, groups, order, n)
    if found is None:
        return df
    cuts, marks = found
    joined = df.join(cuts, _same(groups, marks), "left")
    return joined.where(F.col("_cut").isNull() | (F.col(order) <= F.col("_cut"))).select(*df.columns)
