"""Exact de-duplication by a tree merge of digest runs, in DataFrame operations only.

Every row becomes (digest, id); a hash of the id deals the rows into ``runs``
runs.  Within a run equal digests are reduced to their smallest id and a count.
Rounds then merge ``fan_in`` neighbouring runs at a time (run numbers of a
binomial tree: the low bits are shifted out) until one run remains, keeping the
smallest id at each level.  No sorted run is built: the merge of sorted runs is
expressed as a partial aggregate on (digest, run), which Spark runs natively.
Each level is partitioned by (digest, run), so a
run is spread over all tasks, and a digest shared by a third of all rows is cut
into ``runs`` pieces before its first exchange and again reduced inside each
task.  The answer travels the same tree downwards: a level joins the level
above on (digest, run), at most ``fan_in`` rows to one, so no join has a hot
key either.  Text never leaves the scan.

The key of a level is the SHA-256 of the normalised text together with its
length and a second, 64-bit hash; every level so verifies that equal digests
stand for texts of equal length and equal second hash.

Defined results: null text counts as empty; a null id never stays when another
row of its group has an id, and then that id is the group's; in a group of null
ids alone keep_id is null and all stay (``drop_exact_copies`` leaves rows
without id alone, for no id names them); a repeated row (same
id, same text) is kept together with its twin, for both are that document; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.llm.common import to_scratch

WHITESPACE = r"[\x20\x09-\x0D]+"
KEY = ["digest", "n_chars", "check"]
RUNS = 4096
FAN_IN = 16


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITESPACE, " ")


def _run(fan_in: int) -> Column:
    return F.floor(F.col("run") / fan_in).cast("int")


def deal_runs(runs: int = RUNS) -> Column:
    """The run of a row, from its id."""
    return F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1))), F.lit(runs)).cast("int")


def tree_merge(rows: DataFrame, key: list[str], runs: int = RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """``rows`` (doc_id, run, key columns, others) with the least id and size of each key's group."""
    levels = [rows.groupBy(*key, "run").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))]
    width = runs
    while width > 1:
        width = -(-width // fan_in)
        levels.append(levels[-1].withColumn("run", _run(fan_in)).groupBy(*key, "run")
                      .agg(F.min("least").alias("least"), F.sum("n").alias("n")))
    answer = levels[-1]
    for below in reversed(levels[:-1]):
        above = answer.select(*key, F.col("run").alias("up"), "least", "n")
        answer = (below.select(*key, "run", _run(fan_in).alias("up"))
                  .join(above, [*key, "up"]).select(*key, "run", "least", "n"))
    return rows.join(answer, [*key, "run"])


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 runs: int = RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row."""
    norm = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    rows = to_scratch(norm.select(
        "doc_id", F.unhex(F.sha2("norm", 256)).alias("digest"), F.length("norm").alias("n_chars"),
        F.xxhash64("norm").alias("check"), deal_runs(runs).alias("run")), "digests")
    return (tree_merge(rows, KEY, runs, fan_in)
            .select("doc_id", F.col("least").alias("keep_id"), F.col("n").alias("group_size"),
                    F.col("doc_id").eqNullSafe(F.col("least")).alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256")))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they were."""
    gone = (exact_copies(docs, id_col, text_col).filter(~F.col("kept") & F.col("doc_id").isNotNull())
            .select(F.col("doc_id").alias("_gone")).distinct())
    return docs.join(gone, docs[id_col].cast("long") == gone["_gone"], "left_anti")
