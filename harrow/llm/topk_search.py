"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors become integer rows floor(scale * x).  Candidates and queries are cut
into blocks and dealt over a grid of (candidate block, query block) cells, so
neither side is broadcast and no cell grows with the data.  In a cell the
candidates lie term by term (one dense posting array for each dimension); a
query is a sparse row of (term, weight) pairs, and each pair scatters weight *
posting into the query's dense score array.  A partition selection takes the
best ``k`` of the cell and a window over query ids merges the cells.

Defined results: a null vector, or one with a null or non-finite component, and
a row without id take no part; a missing dimension counts as 0 when lengths
differ (an empty vector scores 0 everywhere); components and scores saturate only
at +-(2^63 - 1), and pairs whose sums might pass that are scored in Python integers;
ties go to the smaller id; rows that agree in id and vector count once (as a
query if any of them is marked; a null mark is no mark), rows
with the query's own id are never its candidates; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from harrow.llm.common import ship_code, to_scratch

CANDIDATES, QUERIES = 16_384, 1_024
BATCH = 128
TOP = 2**63 - 1


def integer_rows(vectors: DataFrame, id_col: str, vec_col: str, scale: float, is_query: Column) -> DataFrame:
    """(vec_id, v array<long>, is_query) of the rows that take part; any column may mark the queries."""
    x = F.col(vec_col).cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return (vectors.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & fine)
            .select(F.col(id_col).cast("long").alias("vec_id"),
                    F.transform(x, lambda c: F.greatest(F.floor(c * scale), F.lit(-TOP))).alias("v"),
                    F.coalesce(is_query, F.lit(False)).alias("is_query"))
            .groupBy("vec_id", "v").agg(F.max("is_query").alias("is_query")))


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and a (rows, dimensions) matrix, rows by id; short rows are filled up with 0."""
    ids = table["vec_id"].to_numpy()
    column = table["v"].combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    m = np.zeros((len(ids), int(lengths.max(initial=0))), np.int64)
    m[np.arange(m.shape[1]) < lengths[:, None]] = flat
    order = np.argsort(ids, kind="stable")
    return ids[order], m[order]


def accumulate(queries: np.ndarray, postings: np.ndarray) -> np.ndarray:
    """Scores of each query (rows) against each candidate; postings is (terms, candidates)."""
    scores = np.zeros((len(queries), postings.shape[1]), postings.dtype)
    scratch = np.empty(postings.shape[1], postings.dtype)
    for q, row in enumerate(queries):
        for term in np.flatnonzero(row[: len(postings)]):
            np.multiply(postings[term], postings.dtype.type(row[term]), out=scratch)
            scores[q] += scratch
    return scores


def exact(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Scores of one query against rows in Python integers, saturated at +-TOP."""
    return np.array([min(max(s, -TOP), TOP) for s in rows.astype(object) @ query.astype(object)], np.int64)


def _beyond(m: np.ndarray) -> np.ndarray:
    """Rows whose scores against others like them might not fit a long."""
    return np.abs(m).max(axis=1, initial=0) > math.isqrt(TOP // max(m.shape[1], 1))


def best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id; ids ascend."""
    lo, hi = np.searchsorted(ids, own), np.searchsorted(ids, own, "right")
    if hi > lo:
        keep = np.concatenate([np.arange(lo), np.arange(hi, len(ids))])
        scores = scores[keep]
    else:
        keep = None
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > edge)
        chosen = np.concatenate([above, np.flatnonzero(scores == edge)[: k - len(above)]])
    else:
        chosen = np.arange(len(scores))
    return chosen if keep is None else keep[chosen]


def _cell(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        q_ids, q = _matrix(left)
        c_ids, c = _matrix(right)
        dims = min(q.shape[1], c.shape[1])
        q, c = q[:, :dims], c[:, :dims]
        far_q, far_c = _beyond(q), _beyond(c)
        whole_q, whole_c = q, c
        if far_q.any() or far_c.any():
            q, c = np.where(far_q[:, None], 0, q), np.where(far_c[:, None], 0, c)
        worst = int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * max(dims, 1)
        postings = np.ascontiguousarray(c.T.astype(np.int32 if worst < 2**31 else np.int64))
        out_q, out_v, out_s = [], [], []
        for at in range(0, len(q), BATCH):
            scores = accumulate(q[at:at + BATCH], postings)
            for place, (own, row) in enumerate(zip(q_ids[at:at + BATCH], scores, strict=True), at):
                again = np.arange(len(c)) if far_q[place] else np.flatnonzero(far_c)
                if len(again):
                    row = row.astype(np.int64)
                    row[again] = exact(whole_q[place], whole_c[again])
                chosen = best(row, c_ids, own, k)
                out_q.append(np.full(len(chosen), own))
                out_v.append(c_ids[chosen])
                out_s.append(row[chosen].astype(np.int64))
        return pa.Table.from_arrays([pa.array(np.concatenate(x)) for x in (out_q, out_v, out_s)], schema=schema)

    return cell


def topk_search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id",
                vec_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each row that ``is_query`` marks."""
    spark = vectors.sparkSession
    ship_code(spark)
    rows = to_scratch(integer_rows(vectors, id_col, vec_col, scale, is_query), "vectors")
    n, n_queries = rows.agg(F.count(F.lit(1)), F.count_if("is_query")).first()
    c_blocks = max(-(-n // CANDIDATES), 1)
    q_blocks = max(-(-n_queries // QUERIES), 1)
    if c_blocks * q_blocks < 2 * spark.sparkContext.defaultParallelism:  # small inputs: use all cores
        c_blocks = min(max(c_blocks, -(-2 * spark.sparkContext.defaultParallelism // q_blocks)), max(n // 512, c_blocks))
    block = lambda blocks: F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    queries = rows.filter("is_query").select("vec_id", "v", block(q_blocks).alias("qb"), every(c_blocks).alias("cb"))
    candidates = rows.select("vec_id", "v", block(c_blocks).alias("cb"), every(q_blocks).alias("qb"))
    cells = (queries.groupBy("cb", "qb").cogroup(candidates.groupBy("cb", "qb"))
             .applyInArrow(_cell(k), "query_id long, vec_id long, score long"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (cells.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
