"""Hard-negative mining by slots of score.

An anchor's positives are its best rows of the same label.  Each positive asks
for the best rows of other labels whose scores lie between a low and a high
share of its own score.  These windows overlap, so they are not searched one by
one: the distinct upper limits of an anchor's positives cut the scores into
disjoint slots, every pair of rows is scored once and falls into one slot at
most, combiners keep the best ``k`` of each slot, and a walk from the lowest
slot upwards (the rows of a slot before what the slots below it gave, cut to
``k``) gives the best rows under each limit.  The lower limit is applied last,
which is exact because the rows under a limit come best first.

Anchors and candidates are cut into blocks and dealt over a grid of (candidate
block, anchor block) cells, for the positives and for the slots; neither side is
broadcast, labels are never a partitioning key (so a hot label is nothing
special), and cells hand on ``k`` rows per anchor and slot at most.

Defined results: rows with a null id, a null label, a null vector or a null or
non-finite component take no part; of rows that share an id the one with the
least label, then the least vector, stands for all; a missing dimension counts
as 0 when lengths differ; scores are exact, and saturate only at +-(2^63 - 1);
ties go to the smaller id; an anchor without positives, or a positive whose
window is empty, has no rows; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.llm.common import ship_code, to_scratch

CANDIDATES, ANCHORS = 16_384, 4_096
BATCH = 128
TOP = 2**63 - 1
#: Integers up to here are exact as doubles, sums of products included.
EXACT = 2**53


def _participants(vectors: DataFrame, is_anchor: Column, id_col: str, vec_col: str, label_col: str,
                  scale: float) -> DataFrame:
    """(vec_id, label, is_anchor, v array<double> of integers): one row per id."""
    x = F.col(vec_col).cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    # 256 * c is exact in a double and so is floor's result, unlike a cast to long.
    whole = F.transform(x, lambda c: F.when(F.abs(c * scale) < F.lit(float(EXACT)),
                                            F.floor(c * scale).cast("double")).otherwise(c * scale) + F.lit(0.0))
    rows = (vectors.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vec_col).isNotNull() & fine)
            .select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
                    F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"), whole.alias("v")))
    least = F.min(F.struct("label", "v", "is_anchor"))
    return rows.groupBy("vec_id").agg(least.alias("r")).select("vec_id", "r.label", "r.is_anchor", "r.v")


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and the (rows, dimensions) matrix, rows by id; short rows are filled up with 0."""
    ids = table["vec_id"].to_numpy()
    column = table["v"].combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    m = np.zeros((len(ids), int(lengths.max(initial=0))))
    m[np.arange(m.shape[1]) < lengths[:, None]] = column.flatten().to_numpy()
    order = np.argsort(ids, kind="stable")
    return ids[order], table["label"].to_numpy()[order], m[order]


def scores_of(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products of two matrices of whole doubles, saturated at +-TOP."""
    dims = min(anchors.shape[1], rows.shape[1])
    a, r = anchors[:, :dims], rows[:, :dims]
    worst = float(np.abs(a).max(initial=0)) * float(np.abs(r).max(initial=0)) * max(dims, 1)
    if worst < EXACT:
        return np.rint(a @ r.T).astype(np.int64)
    big = np.frompyfunc(int, 1, 1)
    exact = big(a).astype(object) @ big(r).astype(object).T
    return np.clip(exact, -TOP, TOP).astype(np.int64)


def first_places(scores: np.ndarray, open_to: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores among the open ones, ties to the smaller place."""
    places = np.flatnonzero(open_to)
    if len(places) > k:
        s = scores[places]
        edge = np.partition(s, len(s) - k)[len(s) - k]
        above, level = places[s > edge], places[s == edge]
        places = np.concatenate([above, level[: k - len(above)]])
    return places


def _table(columns: list[list], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(np.concatenate(c) if c else [], f.type)
                                 for c, f in zip(columns, schema, strict=True)], schema=schema)


FOUND = pa.schema([("anchor_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
SLOTTED = pa.schema([("anchor_id", pa.int64()), ("slot", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _cells(left: pa.Table, right: pa.Table) -> Iterator[tuple]:
    """(place of the anchor in ``left``, its id, its scores, ids, places of the same label) of one grid cell."""
    order = np.argsort(left["vec_id"].to_numpy(), kind="stable")
    a_ids, a_labels, a = _matrix(left)
    ids, labels, rows = _matrix(right)
    for at in range(0, len(a), BATCH):
        for i, row in enumerate(scores_of(a[at:at + BATCH], rows), at):
            yield order[i], a_ids[i], row, ids, labels == a_labels[i]


def _positives_cell(k: int):
    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            for _, anchor, scores, ids, same in _cells(left, right):
                places = first_places(scores, same & (ids != anchor), k)
                for c, x in zip(out, (np.full(len(places), anchor), ids[places], scores[places]), strict=True):
                    c.append(x)
        return _table(out, FOUND)

    return cell


def _slots_cell(k: int):
    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            limits, lowest = left["limits"].to_pylist(), left["lowest"].to_pylist()
            for place, anchor, scores, ids, same in _cells(left, right):
                edges = limits[place]  # falling; slot j holds the scores from edges[j] down to over edges[j + 1]
                slot = len(edges) - 1 - np.searchsorted(edges[::-1], scores, "left")
                useful = ~same & (scores >= lowest[place])
                for j in range(len(edges)):
                    places = first_places(scores, useful & (slot == j), k)
                    for c, x in zip(out, (np.full(len(places), anchor), np.full(len(places), j, np.int32),
                                          ids[places], scores[places]), strict=True):
                        c.append(x)
        return _table(out, SLOTTED)

    return cell


def _grid(rows: DataFrame, anchors: DataFrame, cell, schema: str, n: int, n_anchors: int, cores: int) -> DataFrame:
    """Every anchor against every row, one task-sized cell at a time."""
    a_blocks = max(-(-n_anchors // ANCHORS), 1)
    blocks = max(-(-n // CANDIDATES), 1)
    if blocks * a_blocks < cores:  # small inputs: use all cores
        blocks = max(blocks, min(-(-cores // a_blocks), n // 512))
    block = lambda m: F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = anchors.withColumns({"ab": block(a_blocks), "cb": every(blocks)})
    own = [F.col(c).alias(c) for c in ("vec_id", "label", "v")]  # columns apart from those of the anchors' plan
    right = rows.select(*own, block(blocks).alias("cb"), every(a_blocks).alias("ab"))
    return left.groupBy("cb", "ab").cogroup(right.groupBy("cb", "ab")).applyInArrow(cell, schema)


def _first(rows: DataFrame, keys: list[str], k: int, rank: str) -> DataFrame:
    """The ``k`` best rows of each key, best first; a partial limit runs before the exchange."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return rows.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, k: int = 3, low: int = 50, high: int = 95,
                   id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                   scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``low`` and ``high`` are hundredths of the positive's score, between which
    (both included) a negative's score must lie.
    """
    spark = vectors.sparkSession
    ship_code(spark)
    rows = to_scratch(_participants(vectors, is_anchor, id_col, vec_col, label_col, scale), "negative-rows")
    n, n_anchors = rows.agg(F.count(F.lit(1)), F.count_if("is_anchor")).first()
    cores = 2 * spark.sparkContext.defaultParallelism
    anchors = rows.filter("is_anchor").select("vec_id", "label", "v")

    near = _grid(rows, anchors, _positives_cell(positives), "anchor_id long, vec_id long, score long", n, n_anchors, cores)
    best = _first(near, ["anchor_id"], positives, "place").withColumnRenamed("vec_id", "positive_id")
    exact = F.col("score").cast("decimal(38,0)")  # shares of a score near 2^63 pass a long on the way
    # 50 p <= 100 s <= 95 p over integers: s from ceil(50 p / 100) to floor(95 p / 100).
    share = {"upper": F.floor(exact * high / 100).cast("long"), "lower": F.ceil(exact * low / 100).cast("long")}
    pairs = to_scratch(best.withColumns(share).filter("lower <= upper")
                       .select("anchor_id", "positive_id", F.col("score").alias("positive_score"), "lower", "upper"),
                       "positives")

    limits = pairs.groupBy("anchor_id").agg(F.reverse(F.sort_array(F.collect_set("upper"))).alias("limits"),
                                            F.min("lower").alias("lowest"))
    asking = anchors.join(limits, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id")
    slotted = _grid(rows, asking, _slots_cell(k), "anchor_id long, slot int, vec_id long, score long",
                    n, n_anchors, cores)
    kept = _first(slotted, ["anchor_id", "slot"], k, "place")

    hit = F.struct("place", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    slots = (kept.groupBy("anchor_id", "slot").agg(F.sort_array(F.collect_list(hit)).alias("hits"))
             .groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "hits"))).alias("slots")))
    asked = pairs.join(limits, "anchor_id").join(slots, "anchor_id")
    none = F.array().cast("array<struct<place:int,negative_id:bigint,negative_score:bigint>>")

    def ahead(below: Column, slot: Column) -> Column:
        """The best rows under the limit of a slot, given those under the next lower limit."""
        return F.slice(F.concat(F.coalesce(F.try_element_at("slots", slot), none), below), 1, k)

    own = F.array_position("limits", F.col("upper")).cast("int") - 1
    downwards = F.reverse(F.sequence(own, F.size("limits") - 1))
    asked = asked.withColumn("hits", F.reduce(downwards, none, ahead))
    fits = F.filter("hits", lambda h: h["negative_score"] >= F.col("lower"))
    return (asked.select("anchor_id", "positive_id", "positive_score", F.posexplode(fits).alias("at", "hit"))
            .select("anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), "hit.negative_id",
                    "positive_score", "hit.negative_score"))


def relabelled(vectors: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """Vectors whose label moves on by one (modulo ``labels``) where the id is divisible by ``every``."""
    moved = ((F.col("label").cast("long") + 1) % labels).cast("long")
    return vectors.select("vec_id", "embedding", F.when(F.col("vec_id") % every == 0, moved)
                          .otherwise(F.col("label").cast("long")).alias("label"))

