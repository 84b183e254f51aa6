"""Token counts by a two-tier lookup on the map side; pre-tokens are never shuffled.

A pre-token is a run of spaces with the word behind it, a trailing run of
spaces, or a line feed.  No piece of the vocabulary reaches across those
borders (``Pretokens`` checks that when it loads the model), so the token
count of a text is the sum over its pre-tokens.

Tier one is a broadcast table of the lengths of frequent pre-tokens.  It comes
from one pass over all texts: every task keeps a summary of bounded size
(``table_size`` entries) and the summaries, not the pre-tokens, are merged in a
tree.  Tier two is a cache in each Python worker; what is in neither is encoded
by the library once and remembered.  The tables only save work, so any content
gives the same counts.

Defined results: null and empty texts have 0 bytes and 0 tokens; special
strings inside a text are ordinary text; a null id is kept; repeated rows give
repeated rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm.common import id_text, rows_of, ship_code, slices

DEFAULT_MODEL = "piece_bpe_32k.model"
#: Entries of the broadcast table; with at most MAX_KEY characters each it stays under 10 MB.
TABLE_SIZE = 32_768
MAX_KEY = 48
#: Entries a worker's cache holds before it starts again.
CACHE_SIZE = 250_000
#: Summaries merged by one task of the tree.
FAN_IN = 32
SPACE = "▁"
PRETOKEN = re.compile(r" *[^ \n]+| +|\n")


def model_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pretokens(text: str) -> list[str]:
    """Pre-tokens of a text, the leading space that the library adds included."""
    return PRETOKEN.findall(" " + text.replace(SPACE, " ")) if text else []


class Pretokens:
    """The library's encoder, applied to single pre-tokens."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        for i in range(self.sp.get_piece_size()):
            piece = self.sp.id_to_piece(i)
            if not self.sp.is_byte(i) and (SPACE in piece.lstrip(SPACE) or "\n" in piece):
                raise ValueError(f"piece {piece!r} reaches across pre-tokens; encode whole texts")
        self.mark = len(self.sp.encode("\n")) - 1  # the library adds a space before any text

    def length(self, pretoken: str) -> int:
        if pretoken == "\n":
            return self.mark
        if pretoken[0] == " ":
            return len(self.sp.encode(pretoken[1:])) if len(pretoken) > 1 else 1
        # A word right behind a line feed has no space before it.
        return len(self.sp.encode("\n" + pretoken)) - 1 - self.mark


class Lengths(dict):
    """The broadcast table; what it lacks is looked up in the worker's cache, then encoded."""

    def __init__(self, table: dict[str, int], encoder: Pretokens, cache_size: int) -> None:
        super().__init__(table)
        self.encoder, self.cache, self.cache_size = encoder, {}, cache_size

    def __missing__(self, pretoken: str) -> int:
        n = self.cache.get(pretoken)
        if n is None:
            n = self.encoder.length(pretoken)
            if len(pretoken) <= MAX_KEY:
                if len(self.cache) >= self.cache_size:
                    self.cache.clear()
                self.cache[pretoken] = n
        return n

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, pretokens(text)))


_WORKER: dict[str, tuple[str, object]] = {}


def worker_value(kind: str, tag: str, make: Callable[[], object]) -> object:
    """A value that the Python worker keeps across tasks, one of each kind.

    Kinds are named operator.name; values of another operator are let go, so a
    worker that serves a whole pipeline holds one operator's caches at a time.
    """
    owner = kind.partition(".")[0]
    for other in [k for k in _WORKER if k.partition(".")[0] != owner]:
        del _WORKER[other]
    if kind not in _WORKER or _WORKER[kind][0] != tag:
        _WORKER[kind] = (tag, make())
    return _WORKER[kind][1]


def _shrink(counts: Counter, size: int) -> Counter:
    """The ``size`` largest counts, ties to the smaller key."""
    if len(counts) <= size:
        return counts
    return Counter(dict(sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[:size]))


def _summary_schema() -> pa.Schema:
    return pa.schema([("part", pa.int64()), ("keys", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def frequent_pretokens(docs: DataFrame, table_size: int = TABLE_SIZE) -> list[str]:
    """Frequent pre-tokens of all texts, at most ``table_size`` of them.

    Each task counts its own pre-tokens with bounded memory; a tree of merges
    with ``FAN_IN`` summaries a task leaves one summary, which is small enough
    for the driver by its definition.
    """
    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts: Counter = Counter()
        for (text,) in rows_of(batches, "text"):
            counts.update(pretokens(text))
            if len(counts) > 16 * table_size:
                counts = _shrink(counts, 4 * table_size)
        counts = _shrink(Counter({k: v for k, v in counts.items() if len(k) <= MAX_KEY}), table_size)
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array([part]), pa.array([list(counts)], pa.list_(pa.string())),
             pa.array([list(counts.values())], pa.list_(pa.int64()))], schema=_summary_schema())

    def merge(table: pa.Table) -> pa.Table:
        counts: Counter = Counter()
        for keys, ns in zip(table["keys"].to_pylist(), table["counts"].to_pylist(), strict=True):
            for k, n in zip(keys, ns, strict=True):
                counts[k] += n
        counts = _shrink(counts, table_size)
        return pa.Table.from_arrays(
            [pa.array([table["part"][0].as_py()]), pa.array([list(counts)], pa.list_(pa.string())),
             pa.array([list(counts.values())], pa.list_(pa.int64()))], schema=_summary_schema())

    ddl = "part long, keys array<string>, counts array<long>"
    parts = docs.select("text").mapInArrow(summarise, ddl)
    left = max(1, docs.rdd.getNumPartitions())
    while left > 1:
        parts = (parts.withColumn("part", F.floor(F.col("part") / FAN_IN))
                 .groupBy("part").applyInArrow(merge, ddl))
        left = -(-left // FAN_IN)
    return [k for row in parts.select("keys").collect() for k in row[0]]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 model: str = DEFAULT_MODEL, limit: int = 4096,
                 table_size: int = TABLE_SIZE, cache_size: int = CACHE_SIZE) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > ``limit``) of every whole text."""
    spark = docs.sparkSession
    ship_code(spark)
    texts = id_text(docs, id_col, text_col)
    path, tag = model_path(model), uuid.uuid4().hex
    encoder = Pretokens(path)
    table = spark.sparkContext.broadcast(
        {k: encoder.length(k) for k in frequent_pretokens(texts, table_size)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = worker_value("tokens.lengths", tag, lambda: Lengths(table.value, Pretokens(path), cache_size))
        for b in slices(batches):
            ns = [lengths.count(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index("doc_id")),
                 b.column(b.schema.get_field_index("n_bytes")), pa.array(ns, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"])

    return (texts.withColumn("n_bytes", F.octet_length("text").cast("long"))
            .mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > limit))
