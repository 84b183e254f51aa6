"""Katz backoff language model over a whole corpus, and the score of every text under it.

Documents become *blocks* of about ``block_words`` tokens.  Level by level (1:
words, 2: pairs, ... up to ``order``) each block sends its distinct n-grams with
their local training counts to buckets, as sorted, compressed arrays.  A bucket
adds the counts of all blocks, numbers its n-grams, and answers every block in
the order it asked.  The counts are kept as tables partitioned by level and
kind; what a level gathers grows with the corpus.  Contexts of the next level
are the n-gram numbers of this one, so each level is the same exchange.

Counts up to ``GT`` are discounted by Good-Turing (Katz's form with the
counts-of-counts of that level).  The weight of a context h is

    alpha(h) = (1 - sum of seen P(w|h)) / (1 - sum of the same w's lower-order P)

with both sums over all words seen after h, so each distribution sums to one
over the vocabulary and the unknown word.  The lowest level gives the mass that
discounting leaves to the unknown word.  A context whose counts are all above
``GT`` keeps half a count for unseen words.  Evaluation is recursive per token:
an n-gram with a count takes its discounted share, any other takes alpha(h)
times the probability one level down.

A context with more than 1/(8 * buckets) of all tokens is dealt to several
buckets by its next word; the partial sums of such contexts (at most 8 *
buckets rows) are added in one small aggregate and broadcast.

Defined results: null and empty texts hold the end token alone; a null id is
in training; an empty training set gives probability 1 to the unknown word;
repeated rows are scored and counted row by row; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm.common import delete_folder, id_text, release_shuffles, rows_of, ship_code
from harrow.session import scratch_path

ORDER = 2
GT = 5
BLOCK_WORDS = 1_000_000
#: Entries of one bucket that a level aims at.
BUCKET_ENTRIES = 400_000
UNKNOWN, START, FIRST = 0, 1, 2
END = b" "  # no word holds a space

ASK = "level int, bucket int, block long, keys binary, sizes binary, words binary, counts binary, low binary, hot binary"
TOLD = ("kind string, level int, bucket int, block long, ids binary, counts binary, few binary, low binary, "
        "stats array<long>")


# Arrays as bytes --------------------------------------------------------------

def pack(a: np.ndarray) -> bytes:
    """An array as bytes: narrowest unsigned type that holds it, byte plane by byte plane, compressed."""
    if a.dtype.kind in "iu":
        top = int(a.max(initial=0))
        a = a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32
                     else np.uint64)
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T
    return a.dtype.char.encode() + zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpack(b: bytes) -> np.ndarray:
    kind = np.dtype(b[:1].decode())
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[1:]), np.uint8).reshape(kind.itemsize, -1)
    a = np.ascontiguousarray(planes.T).view(kind).ravel()
    return a.astype(np.int64) if kind.kind in "iu" and kind.itemsize < 8 else a


def pack_values(a: np.ndarray) -> bytes:
    """Floats with few distinct values: a table and indices."""
    table, place = np.unique(a, return_inverse=True)
    head = pack(table)
    return len(head).to_bytes(4, "little") + head + pack(place)


def unpack_values(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:4], "little")
    return unpack(b[4:4 + n])[unpack(b[4 + n:])]


def mixed(a: np.ndarray) -> np.ndarray:
    """A 64-bit mix of whole numbers."""
    x = a.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# Blocks -------------------------------------------------------------------------

def words_of(text: str) -> list[bytes]:
    """Tokens of a text without the end: ASCII letters lowered, cut at ASCII white space."""
    return text.encode().lower().split()


def in_training(doc_id: int | None, fold: int) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 != fold


#: kind "text": what later levels read; kind "words": what the first level asks, deleted after it.
BLOCK = ("kind string, block long, n_words long, n_types long, docs array<long>, lengths binary, tokens binary, "
         "place binary, hashes binary, counts binary")


def _blocks(block_words: int, fold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        made = 0
        vocabulary: defaultdict[bytes, int] = defaultdict()
        vocabulary.default_factory = vocabulary.__len__
        docs: list[int | None] = []
        runs: list[np.ndarray] = []
        total = 0

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(r) for r in runs])
            tokens = np.concatenate(runs)
            train = np.repeat([in_training(d, fold) for d in docs], lengths)
            hashes = mixed(np.fromiter(map(xxhash.xxh64_intdigest, vocabulary), np.uint64, len(vocabulary)))
            counts = np.bincount(tokens[train], minlength=len(vocabulary))
            # Frequent words get small numbers, which compress best; words are asked for by hash.
            common = np.argsort(-np.bincount(tokens, minlength=len(vocabulary)), kind="stable")
            number = np.empty(len(common), np.int64)
            number[common] = np.arange(len(common))
            order = np.argsort(hashes)
            place = np.empty(len(order), np.int64)
            place[number[order]] = np.arange(len(order))
            block = part << 32 | made
            return _rows(BLOCK, [
                dict(kind="text", block=block, n_words=total, n_types=len(hashes), docs=docs, lengths=pack(lengths),
                     tokens=pack(number[tokens]), place=pack(place)),
                dict(kind="words", block=block, hashes=pack(np.diff(hashes[order], prepend=np.uint64(0))),
                     counts=pack(counts[order]))])

        for doc_id, text in rows_of(batches, "doc_id", "text"):
            words = words_of(text)
            words.append(END)
            runs.append(np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words)))
            docs.append(doc_id)
            total += len(words)
            if total >= block_words:
                yield flush()
                made += 1
                vocabulary.clear()
                docs, runs, total = [], [], 0
        if docs:
            yield flush()

    return run


# Level 1: words -------------------------------------------------------------------

def _ask_words(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, hashes, counts in rows_of(batches, "block", "hashes", "counts"):
            hashes, counts = np.cumsum(unpack(hashes).astype(np.uint64)), unpack(counts)
            # A bucket is a range of hashes, so a block's answers in bucket order are in hash order.
            bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            yield _rows(ASK, [dict(level=1, bucket=b, block=block, keys=pack(np.diff(hashes[at], prepend=np.uint64(0))),
                                   counts=pack(counts[at])) for b, at in _split(bucket)])

    return run


def _split(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places in their order) for the buckets that occur."""
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order])) + 1
    for at in np.split(order, edges):
        if len(at):
            yield int(bucket[at[0]]), at


_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(),
          "array<long>": pa.list_(pa.int64()), "double": pa.float64()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _TYPES[t]) for n, t in (x.split() for x in ddl.split(", "))])


def _rows(ddl: str, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_schema(ddl))


def _few(counts: np.ndarray) -> list[int]:
    """Types, tokens, then how many types have count 1, 2, ... GT + 1."""
    return [int((counts > 0).sum()), int(counts.sum()), *[int((counts == r).sum()) for r in range(1, GT + 2)]]


def _add_words(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["bucket", "block", "keys", "counts"]).to_pylist()
        keys = [np.cumsum(unpack(r["keys"]).astype(np.uint64)) for r in rows]
        types, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, np.concatenate([unpack(r["counts"]) for r in rows])).astype(np.int64)
        bucket = rows[0]["bucket"]
        ids = np.empty(len(types), np.int64)  # frequent words have small numbers
        ids[np.argsort(-total, kind="stable")] = FIRST + np.arange(len(types)) * buckets + bucket
        ids[total == 0] = UNKNOWN
        out = [dict(kind="stat", level=1, bucket=bucket, stats=_few(total)),
               dict(kind="model", level=1, bucket=bucket, ids=pack(ids[total > 0]), counts=pack(total[total > 0]))]
        at = 0
        for r, k in zip(rows, keys, strict=True):
            mine = place[at:at + len(k)]
            at += len(k)
            out.append(dict(kind="reply", level=1, bucket=bucket, block=r["block"], ids=pack(ids[mine]),
                            counts=pack(total[mine])))
        return pa.Table.from_batches([_rows(TOLD, out)])

    return run


# Discounts ------------------------------------------------------------------------

def discounts(few: list[int]) -> np.ndarray:
    """Factor d[r] of a count r (index 0 unused, above GT: 1) from counts-of-counts.

    Katz's Good-Turing form; where the counts do not give factors between 0
    and 1 (tiny corpora), half a count is taken off instead.
    """
    n = np.array([0, *few], float)  # n[1] .. n[GT + 1]
    d = np.ones(GT + 2)
    if (n[1:] > 0).all():
        last = (GT + 1) * n[GT + 1] / n[1]
        if last < 1:
            r = np.arange(1, GT + 1)
            d[1:GT + 1] = ((r + 1) * n[2:GT + 2] / (r * n[1:GT + 1]) - last) / (1 - last)
            if ((d[1:GT + 1] > 0) & (d[1:GT + 1] <= 1)).all() and (d[1:GT + 1] < 1).any():
                return d
    d[1:GT + 1] = 1 - 0.5 / np.arange(1, GT + 1)
    return d


class Level:
    """Corpus-wide numbers of one level."""

    def __init__(self, stats: list[int]) -> None:
        self.types, self.tokens, self.few = stats[0], stats[1], stats[2:]
        self.d = discounts(self.few)
        taken = sum((1 - self.d[r]) * r * self.few[r - 1] for r in range(1, GT + 1))
        #: Of words: total that shares are taken of, and the unknown word's share.
        self.total = self.tokens if taken > 0 else self.tokens + 0.5
        self.left = (taken if taken > 0 else 0.5) / self.total
        #: Training documents; as many times the start is a context.
        self.documents = 0

    def discounted(self, counts: np.ndarray) -> np.ndarray:
        return counts * self.d[np.minimum(counts, GT + 1)]

    def word_probability(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.discounted(counts) / self.total, self.left)


# Levels above 1 -------------------------------------------------------------------

class Asked:
    """What a block asks at a level: its distinct contexts and n-grams, by bucket."""

    def __init__(self, context: np.ndarray, context_count: np.ndarray, word: np.ndarray, buckets: int,
                 hot_from: float) -> None:
        """context and word: numbers for each token (UNKNOWN: not in training)."""
        self.contexts, first, place = np.unique(context, return_index=True, return_inverse=True)
        self.context_of_token = place
        count = context_count[first]
        self.known = self.contexts != UNKNOWN
        parts = np.maximum(np.ceil(count / hot_from), 1).astype(np.int64)
        self.hot = self.known & (parts > 1)
        words, w = np.unique(word, return_inverse=True)
        key = place * len(words) + w
        useful = self.known[place] & (word != UNKNOWN)
        self.grams, self.gram_of_token = np.full(0, 0), np.full(len(word), -1)
        grams, inverse = np.unique(key[useful], return_inverse=True)
        self.gram_of_token[useful] = inverse
        self.useful = useful
        self.gram_context = grams // max(len(words), 1)
        self.gram_word = words[grams % max(len(words), 1)] if len(grams) else np.zeros(0, np.int64)
        at = mixed(self.contexts)
        part = mixed(self.gram_word + 7) % parts[self.gram_context].astype(np.uint64)
        self.gram_bucket = ((at[self.gram_context] + part) % np.uint64(buckets)).astype(np.int64)
        self.context_bucket = (at % np.uint64(buckets)).astype(np.int64)

    def rows(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(bucket, contexts, sizes, grams): grams follow their contexts; a context may have none."""
        need = np.flatnonzero(self.known & ~self.hot)  # contexts that need sums although no gram goes there
        gram = np.concatenate([np.arange(len(self.gram_bucket)), np.full(len(need), -1)])
        context = np.concatenate([self.gram_context, need])
        bucket = np.concatenate([self.gram_bucket, self.context_bucket[need]])
        order = np.lexsort((gram, context, bucket))
        gram, context, bucket = gram[order], context[order], bucket[order]
        for b, at in _split(bucket):
            contexts, start = np.unique(context[at], return_index=True)
            real = gram[at] >= 0
            sizes = np.add.reduceat(real.astype(np.int64), start)
            yield b, contexts, sizes, gram[at][real]


def _ask_rows(level: int, block: int, asked: Asked, train: np.ndarray, low: np.ndarray) -> list[dict]:
    n = len(asked.gram_word)
    mine = asked.gram_of_token[asked.useful]
    counts = np.bincount(mine[train[asked.useful]], minlength=n)
    value = np.zeros(n)
    value[mine] = low[asked.useful]
    return [dict(level=level, bucket=b, block=block, keys=pack(asked.contexts[c]), sizes=pack(s),
                 words=pack(asked.gram_word[g]), counts=pack(counts[g]), low=pack_values(value[g]),
                 hot=pack(asked.hot[c].astype(np.int64)))
            for b, c, s, g in asked.rows()]


def _add_grams(level: int, buckets: int, order: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        bucket = rows[0]["bucket"]
        keys, sizes, words = ([unpack(r[x]) for r in rows] for x in ("keys", "sizes", "words"))
        contexts, c_place = np.unique(np.concatenate(keys), return_inverse=True)
        hot = np.zeros(len(contexts), bool)
        hot[c_place] = np.concatenate([unpack(r["hot"]) for r in rows]) > 0
        of_gram = np.repeat(c_place, np.concatenate(sizes))
        word_ids, w = np.unique(np.concatenate(words), return_inverse=True)
        grams, first, place = np.unique(of_gram * max(len(word_ids), 1) + w, return_index=True, return_inverse=True)
        total = np.bincount(place, np.concatenate([unpack(r["counts"]) for r in rows]),
                            minlength=len(grams)).astype(np.int64)
        low = np.concatenate([unpack_values(r["low"]) for r in rows])[first]
        context = grams // max(len(word_ids), 1)
        seen = total > 0
        few = np.stack([np.bincount(context[total == r], minlength=len(contexts)) for r in range(1, GT + 1)], axis=1)
        sums = np.bincount(context[seen], low[seen], minlength=len(contexts))
        ids = np.where(seen, FIRST + np.arange(len(grams)) * buckets + bucket, UNKNOWN)
        out = [dict(kind="stat", level=level, bucket=bucket, stats=_few(total)),
               dict(kind="model", level=level, bucket=bucket, ids=pack(contexts[context[seen]]),
                    few=pack(word_ids[grams % max(len(word_ids), 1)][seen]) if len(grams) else pack(context),
                    counts=pack(total[seen])),
               dict(kind="hot", level=level, bucket=bucket, ids=pack(contexts[hot]), few=pack(few[hot].T),
                    low=pack_values(sums[hot]))]
        c_at = g_at = 0
        for r, k, s in zip(rows, keys, sizes, strict=True):
            c, g = c_place[c_at:c_at + len(k)], place[g_at:g_at + int(s.sum())]
            c_at, g_at = c_at + len(c), g_at + len(g)
            out.append(dict(kind="reply", level=level, bucket=bucket, block=r["block"], counts=pack(total[g]),
                            few=pack(few[c].T), low=pack_values(sums[c]),
                            ids=pack(ids[g]) if level < order else None))
        return pa.Table.from_batches([_rows(TOLD, out)])

    return run


def _hot_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, few, low in rows_of(batches, "ids", "few", "low"):
        ids, few, low = unpack(ids), unpack(few).reshape(GT, -1).T, unpack_values(low)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids.astype(np.int64)), *[pa.array(few[:, i].astype(np.int64)) for i in range(GT)],
             pa.array(low.astype(np.float64))], names=["context", *[f"n{i}" for i in range(GT)], "low"])


# Blocks with the answers --------------------------------------------------------------

class Evaluated:
    """Probabilities of a block's tokens, level by level, from the answers so far."""

    def __init__(self, row: dict, replies: list[dict], levels: list[Level], hot: dict[int, dict[int, np.ndarray]],
                 buckets: list[int], hot_from: list[float], fold: int) -> None:
        self.docs = row["docs"]
        self.lengths = unpack(row["lengths"])
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        tokens = unpack(row["tokens"])
        self.train = np.repeat([in_training(d, fold) for d in self.docs], self.lengths)
        by = {(r["level"], r["bucket"]): r for r in replies}
        words = [by[1, b] for b in range(buckets[0]) if (1, b) in by]
        place = unpack(row["place"])
        ids = np.concatenate([unpack(r["ids"]) for r in words])[place]
        counts = np.concatenate([unpack(r["counts"]) for r in words])[place]
        self.word, self.word_count = ids[tokens], counts[tokens]
        self.p = levels[0].word_probability(self.word_count)
        gram, gram_count = self.word, self.word_count
        documents = levels[0].documents
        self.asked = None
        for k in range(2, len(buckets) + 1):
            context = np.concatenate([[START], gram[:-1]])
            context_count = np.concatenate([[documents], gram_count[:-1]])
            context[self.starts], context_count[self.starts] = (START, documents) if documents else (UNKNOWN, 0)
            asked = Asked(context, context_count, self.word, buckets[k - 1], hot_from[k - 1])
            if k > len(levels):
                self.asked = asked
                return
            gram, gram_count = self._apply(asked, context_count, by, k, levels[k - 1], hot.get(k, {}))

    def _apply(self, asked: Asked, context_count: np.ndarray, by: dict, k: int, level: Level,
               hot: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        n, m = len(asked.gram_word), len(asked.contexts)
        count, ids = np.zeros(n, np.int64), np.zeros(n, np.int64)
        few, low = np.zeros((m, GT), np.int64), np.zeros(m)
        for b, c, _, g in asked.rows():
            r = by[k, b]
            count[g] = unpack(r["counts"])
            if r["ids"] is not None:
                ids[g] = unpack(r["ids"])
            few[c], low[c] = unpack(r["few"]).reshape(GT, -1).T, unpack_values(r["low"])
        for i in np.flatnonzero(asked.hot):
            sums = hot[int(asked.contexts[i])]
            few[i], low[i] = sums[:GT], sums[GT]
        # Per context: mass taken off by discounting, or half a count where there is none.
        h_count = np.zeros(m, np.int64)
        h_count[asked.context_of_token] = context_count
        taken = few @ ((1 - level.d[1:GT + 1]) * np.arange(1, GT + 1))
        total = np.where(taken > 1e-9, h_count, h_count + 0.5)
        alpha = np.where(asked.known, np.where(taken > 1e-9, taken, 0.5) / np.maximum(total, 0.5)
                         / np.maximum(1 - low, 1e-300), 1.0)
        h = asked.context_of_token
        mine = np.where(asked.gram_of_token >= 0, asked.gram_of_token, 0)
        c = np.where(asked.gram_of_token >= 0, count[mine], 0) if n else np.zeros(len(h), np.int64)
        self.p = np.where(c > 0, level.discounted(c) / np.maximum(total[h], 0.5), alpha[h] * self.p)
        gram = np.where(c > 0, ids[mine], UNKNOWN) if n else np.zeros(len(h), np.int64)
        return gram, c

    def by_document(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, self.starts)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
REPLY_COLUMNS = ["level", "bucket", "block", "ids", "counts", "few", "low"]


def katz_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER,
                fold: int = 1, block_words: int = BLOCK_WORDS, bucket_entries: int = BUCKET_ENTRIES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every whole text.

    The model learns from rows whose fold (crc32 of the id as text, modulo 5)
    is not ``fold``.
    """
    return KatzModel(docs, id_col, text_col, order, fold, block_words, bucket_entries).scores()


class KatzModel:
    """Counts of all levels in partitioned tables, and what it takes to score the same documents."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER,
                 fold: int = 1, block_words: int = BLOCK_WORDS, bucket_entries: int = BUCKET_ENTRIES) -> None:
        self.spark = docs.sparkSession
        ship_code(self.spark)
        self.fold = fold
        blocks, folder = _partitioned(
            id_text(docs, id_col, text_col).mapInArrow(_blocks(block_words, fold), BLOCK), BLOCK, "blocks")
        self.blocks, self.words = blocks.filter("kind = 'text'"), blocks.filter("kind = 'words'")
        n_words, n_types = self.blocks.agg(F.sum("n_words"), F.sum("n_types")).first()
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[Level] = []
        self.buckets: list[int] = []
        self.hot_from: list[float] = []
        self.hot: dict[int, dict[int, np.ndarray]] = {}
        self.told: list[DataFrame] = []
        for level in range(1, order + 1):
            entries = (n_types if level == 1 else n_words) or 0
            self.buckets.append(max(4 * parts, -(-entries // bucket_entries)))
            self.hot_from.append(max((n_words or 0) / (8 * self.buckets[-1]), 1000.0))
            self._add_level(level, order)
            if level == 1:
                delete_folder(self.spark, f"{folder}/kind=words")
            release_shuffles(self.spark)

    def _add_level(self, level: int, order: int) -> None:
        buckets = self.buckets[-1]
        if level == 1:
            asked = self.words.select("block", "hashes", "counts").mapInArrow(_ask_words(buckets), ASK)
            add = _add_words(buckets)
        else:
            asked = self._with_replies(_ask_level(*self._known(), level), ASK)
            add = _add_grams(level, buckets, order)
        self.told.append(_partitioned(asked.groupBy("bucket").applyInArrow(add, TOLD), TOLD, f"katz-{level}")[0])
        del asked
        release_shuffles(self.spark)
        stats = self.told[-1].filter("kind = 'stat'")
        row = stats.agg(*[F.sum(F.col("stats")[i]) for i in range(GT + 3)]).first()
        self.levels.append(Level([x or 0 for x in row]))
        if level == 1:
            self.levels[0].documents = self._training_documents()
        else:
            sums = (self.told[-1].filter("kind = 'hot'").select("ids", "few", "low")
                    .mapInArrow(_hot_rows, "context long, " + "".join(f"n{i} long, " for i in range(GT)) + "low double")
                    .groupBy("context").agg(*[F.sum(f"n{i}") for i in range(GT)], F.sum("low")))
            # Contexts above 1/(8 * buckets) of all tokens: at most 8 * buckets rows.
            self.hot[level] = {r[0]: np.array(r[1:], float) for r in sums.collect()}

    def _training_documents(self) -> int:
        ids = self.blocks.select(F.explode("docs").alias("d"))
        fold = F.coalesce(F.crc32(F.col("d").cast("string").cast("binary")) % 5, F.lit((self.fold + 1) % 5))
        return ids.filter(fold != self.fold).count()

    def _known(self) -> tuple:
        return self.levels[:], self.spark.sparkContext.broadcast(self.hot), self.buckets[:], self.hot_from[:], self.fold

    def _with_replies(self, run, ddl: str) -> DataFrame:
        replies = None
        for told in self.told:
            mine = told.filter("kind = 'reply'").select(*REPLY_COLUMNS)
            replies = mine if replies is None else replies.unionByName(mine)
        return (self.blocks.select("block", "docs", "lengths", "tokens", "place").groupBy("block")
                .cogroup(replies.groupBy("block")).applyInArrow(run, ddl))

    def counts(self) -> DataFrame:
        """The model as rows: level, context (null for words), word, count; numbers, not texts."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for level, ids, few, counts in rows_of(batches, "level", "ids", "few", "counts"):
                ids, counts = unpack(ids).astype(np.int64), unpack(counts).astype(np.int64)
                words = ids if few is None else unpack(few).astype(np.int64)
                context = pa.array([None] * len(ids), pa.int64()) if few is None else pa.array(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), level, np.int32)), context, pa.array(words), pa.array(counts)],
                    names=["level", "context", "word", "count"])

        parts = [t.filter("kind = 'model'").select("level", "ids", "few", "counts") for t in self.told]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.mapInArrow(run, "level int, context long, word long, count long")

    def scores(self) -> DataFrame:
        levels, hot, buckets, hot_from, fold = self._known()
        n, v = levels[0].tokens, levels[0].types

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            e = Evaluated(left.to_pylist()[0], right.to_pylist(), levels, hot.value, buckets, hot_from, fold)
            base = np.log10((e.word_count + 0.5) / (n + 0.5 * (v + 1)))
            held = [d is not None and not in_training(d, fold) for d in e.docs]
            return pa.Table.from_arrays(
                [pa.array(e.docs, pa.int64()), pa.array(held), pa.array(e.lengths.astype(np.int64)),
                 pa.array(e.by_document((e.word_count > 0).astype(np.int64))),
                 pa.array(np.full(len(e.docs), n, np.int64)), pa.array(e.by_document(base)),
                 pa.array(e.by_document(np.log10(e.p)))], names=[x.split()[0] for x in SCORES.split(", ")])

        return self._with_replies(run, SCORES)


def _ask_level(levels: list[Level], hot, buckets: list[int], hot_from: list[float], fold: int, level: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        e = Evaluated(row, right.to_pylist(), levels, hot.value, buckets, hot_from, fold)
        return pa.Table.from_batches([_rows(ASK, _ask_rows(level, row["block"], e.asked, e.train, e.p))])

    return run


def _partitioned(df: DataFrame, ddl: str, name: str) -> tuple[DataFrame, str]:
    """Written to the shared folder with one partition for each kind of row, and that folder."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").partitionBy("kind").parquet(path)
    columns = ddl.removeprefix("kind string, ")
    return df.sparkSession.read.schema(f"{columns}, kind string").parquet(path), path
