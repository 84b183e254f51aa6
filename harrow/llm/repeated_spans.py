"""Removal of repeated byte strings by a sparse, distributed suffix merge sort.

Each byte covered by a string of ``LENGTH`` bytes that also starts anywhere
else (in any document, the same one included) is marked.  Sorting every suffix
would move hundreds of times the text, so suffixes are sorted at *anchors*
only: each window of LENGTH bytes names the place of its least GRAM-byte hash
(leftmost among equals).  That choice depends on the window's bytes alone, so
equal windows name the same offset, and it is enough to compare the anchors'
surroundings: the suffix (up to LENGTH bytes) and the bytes before it (up to
LENGTH - GRAM).

1. Texts become blocks.  Blocks send the distinct hashes of their anchors to
   buckets, which answer which of them occur more than once anywhere.
2. For those, a block makes sorted runs of distinct suffixes, front-coded
   (length of the prefix shared with the suffix before, then the rest), with the
   bytes before and how often the block holds them: copies inside a block are
   one entry.  Runs go to the buckets by their GRAM-byte hash.  A hash that
   occurs more than HOT times would fill one bucket, so its windows are dealt
   by ranges of their offset instead: all windows of a range share a core of
   bytes, the core chooses the bucket, and an entry holds no more than the range
   needs, so that copies of a core with its surroundings are again one entry.
3. A bucket merges its runs with a loser tree that knows, for each contender,
   how long a prefix it shares with the last suffix put out; only bytes behind
   that are compared.  The merged order with its shared-prefix lengths gives,
   for each window offset, the suffixes that agree far enough; of these the ones
   whose bytes before also agree are repeats (those bytes are compared by a
   64-bit hash).  The answer for an entry is the nearest and farthest
   repeated window.
4. Blocks mark bytes from the answers and cut their texts.

Defined results: null and empty texts have 0 bytes and nothing removed, like
every text shorter than LENGTH without being compared; a repeated row is text
that starts elsewhere, so both copies go; a null id is kept; what is left
need not be valid UTF-8 and is binary; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm.common import id_text, release_shuffles, rows_of, ship_code, to_scratch
from harrow.llm.katz import _split, mixed, pack, unpack
from harrow.llm.token_counts import worker_value

LENGTH, GRAM = 200, 100
BEFORE = LENGTH - GRAM
BLOCK_BYTES = 2_000_000
BUCKET_ENTRIES = 100_000
#: Occurrences from which an anchor's windows are dealt by ranges of offsets.
HOT = 5_000
#: Offsets (bytes before the anchor) compared together: all, or for hot anchors in ranges.
RANGES = [(0, BEFORE), *[(a, min(a + 9, BEFORE) if a < 90 else BEFORE) for a in range(0, 91, 10)]]
_CHUNK = 1 << 20
_FACTOR = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(77).integers(1, 2**63, 256, dtype=np.uint64)
NONE = 255


class Powers:
    """Powers of the rolling hash's factor and of its inverse modulo 2^64."""

    def __init__(self, n: int) -> None:
        inverse = pow(_FACTOR, -1, 1 << 64)
        self.up, self.down = self._row(_FACTOR, n), self._row(inverse, n)

    @staticmethod
    def _row(factor: int, n: int) -> np.ndarray:
        out = np.ones(n, np.uint64)
        done, power = 1, factor
        while done < n:  # doubling: out[done:2 * done] = out[:done] * factor^done
            out[done:2 * done] = out[:min(done, n - done)] * np.uint64(power)
            power = power * power % (1 << 64)
            done *= 2
        return out


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of all windows that lie within a document."""
    places, hashes = [], []
    powers = worker_value("spans.powers", "", lambda: Powers(_CHUNK + LENGTH))
    window = np.zeros(len(data) + 1, np.int8)  # marks of places where a window may start
    long = ends - starts >= LENGTH
    np.add.at(window, starts[long], 1)
    np.add.at(window, ends[long] - LENGTH + 1, -1)
    valid = np.cumsum(window[:-1]) > 0
    for at in range(0, len(data), _CHUNK):
        part = data[at:at + _CHUNK + LENGTH - 1]
        n = len(part) - LENGTH + 1
        if n <= 0 or not valid[at:at + n].any():
            continue
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * powers.down[:len(part)], out=sums[1:])
        h = mixed((sums[GRAM:] - sums[:-GRAM]) * powers.up[:len(part) - GRAM + 1])
        low = np.uint64((1 << 21) - 1)
        least = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # ties go to the left
        span = 1
        width = LENGTH - GRAM + 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[:-(width - span)], least[width - span:])
        chosen = np.zeros(len(h), bool)
        chosen[(least[:n][valid[at:at + n]] & low).astype(np.int64)] = True
        mine = np.flatnonzero(chosen)
        places.append(mine + at)
        hashes.append(h[mine])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    places, first = np.unique(np.concatenate(places), return_index=True)
    return places, np.concatenate(hashes)[first]


# Blocks -------------------------------------------------------------------------

BLOCK = "block long, n_bytes long, docs array<long>, ends binary, body binary"
ASK = "bucket int, block long, hashes binary, counts binary"
RUN = "bucket int, block long, shared binary, rest binary, lengths binary, before binary, counts binary"
TOLD = "kind int, bucket int, block long, answer binary, answer2 binary"


def _blocks(block_bytes: int):
    schema = pa.schema([("block", pa.int64()), ("n_bytes", pa.int64()), ("docs", pa.list_(pa.int64())),
                        ("ends", pa.binary()), ("body", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        texts: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ends = np.cumsum([len(t) for t in texts])
            body = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            return pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | made]), pa.array([size]), pa.array([docs], pa.list_(pa.int64())),
                 pa.array([pack(ends)], pa.binary()), pa.array([body], pa.binary())], schema=schema)

        for doc_id, text in rows_of(batches, "doc_id", "text"):
            texts.append(text.encode())
            docs.append(doc_id)
            size += len(texts[-1])
            if size >= block_bytes:
                yield flush()
                made += 1
                docs, texts, size = [], [], 0
        if docs:
            yield flush()

    return run


class Text:
    """A block's bytes, its documents' borders and its anchors."""

    def __init__(self, ends: bytes, body: bytes) -> None:
        self.body = zstandard.ZstdDecompressor().decompress(body)
        self.data = np.frombuffer(self.body, np.uint8)
        self.ends = unpack(ends)
        self.starts = np.concatenate([[0], self.ends[:-1]])
        self.places, self.hashes = anchors(self.data, self.starts, self.ends)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes in bucket order of asking, how often, place of each anchor's hash)."""
        hashes, place, counts = np.unique(self.hashes, return_inverse=True, return_counts=True)
        return hashes, place, counts


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(hashes) % np.uint64(buckets)).astype(np.int64)


def _ask(buckets: int):
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ends, body in rows_of(batches, "block", "ends", "body"):
            hashes, _, counts = Text(ends, body).distinct()
            yield pa.RecordBatch.from_pylist(
                [dict(bucket=b, block=block, hashes=pack(hashes[at]), counts=pack(counts[at]))
                 for b, at in _split(_bucket(hashes, buckets))], schema=schema)

    return run


_TOLD = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()),
                   ("answer", pa.binary()), ("answer2", pa.binary())])


def _repeated(hot: int):
    """For each block's hashes: does the hash occur more than once anywhere, and is it hot?"""
    def run(table: pa.Table) -> pa.Table:
        return _answers(table, hot)

    return run


def _answers(table: pa.Table, hot: int) -> pa.Table:
    rows = table.to_pylist()
    hashes = [unpack(r["hashes"]) for r in rows]
    _, place = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(place, np.concatenate([unpack(r["counts"]) for r in rows]))
    out, at = [], 0
    for r, h in zip(rows, hashes, strict=True):
        mine = total[place[at:at + len(h)]]
        at += len(h)
        out.append(dict(kind=1, bucket=r["bucket"], block=r["block"], answer=pack(np.packbits(mine > 1)),
                        answer2=pack(np.packbits(mine > hot))))
    return pa.Table.from_pylist(out, schema=_TOLD)


class Entries:
    """The distinct surroundings of a block's repeated anchors, by bucket and in suffix order."""

    def __init__(self, text: Text, replies: list[dict], buckets: int) -> None:
        hashes, place, _ = text.distinct()
        more, hot = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
        by = {r["bucket"]: r for r in replies if r["kind"] == 1}
        bucket = _bucket(hashes, buckets)
        for b, at in _split(bucket):
            for flags, answer in ((more, "answer"), (hot, "answer2")):
                flags[at] = np.unpackbits(unpack(by[b][answer]).astype(np.uint8), count=len(at)).astype(bool)
        chosen = more[place]
        anchors_ = text.places[chosen]
        doc = np.searchsorted(text.ends, anchors_, "right")
        body = text.body
        seen: dict[tuple[int, bytes, bytes], int] = {}
        places, entry = [], []
        for x, b, h, s, e in zip(anchors_.tolist(), bucket[place[chosen]].tolist(), hot[place[chosen]].tolist(),
                                 text.starts[doc].tolist(), text.ends[doc].tolist(), strict=True):
            for n in range(1, len(RANGES)) if h else (0,):
                least, most = RANGES[n]
                if h:
                    if x - s < least or e - x < LENGTH - most:
                        continue  # no window of the range fits into the document
                    core = body[x - least:x + LENGTH - most]
                    b = n * buckets + xxhash.xxh64_intdigest(core, seed=n) % buckets
                key = (b, body[x:min(x + LENGTH - least, e)], body[max(s, x - most):x])
                places.append(x)
                entry.append(seen.setdefault(key, len(seen)))
        keys = list(seen)
        order = sorted(range(len(keys)), key=keys.__getitem__)
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.arange(len(keys))
        self.places = np.array(places, np.int64)
        self.keys = [keys[i] for i in order]
        self.entry_of_place = rank[np.array(entry, np.int64)] if entry else np.zeros(0, np.int64)
        self.counts = np.bincount(self.entry_of_place, minlength=len(keys))
        of_key = np.array([k[0] for k in self.keys], np.int64)
        self.runs = {b: (at[0], at[-1] + 1) for b, at in _split(of_key)} if len(of_key) else {}


def _fixed(strings: list[bytes], width: int, right: bool = False) -> np.ndarray:
    """(strings, width) bytes, filled up with zeros on the right (or left)."""
    fill = bytes.rjust if right else bytes.ljust
    return np.frombuffer(b"".join(fill(s, width, b"\0") for s in strings), np.uint8).reshape(len(strings), width)


def front_code(suffixes: list[bytes]) -> tuple[np.ndarray, bytes]:
    """Prefix lengths shared with the suffix before, and the remaining bytes of all."""
    m = _fixed(suffixes, LENGTH)
    lengths = np.array([len(s) for s in suffixes])
    shared = np.zeros(len(suffixes), np.int64)
    if len(suffixes) > 1:
        differ = m[1:] != m[:-1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), LENGTH)
        shared[1:] = np.minimum(first, np.minimum(lengths[1:], lengths[:-1]))
    return shared, b"".join(s[n:] for s, n in zip(suffixes, shared.tolist(), strict=True))


def _run_rows(block: int, entries: Entries) -> list[dict]:
    press = zstandard.ZstdCompressor(level=3)
    out = []
    for b, (lo, hi) in entries.runs.items():
        keys = entries.keys[lo:hi]
        shared, rest = front_code([k[1] for k in keys])
        lengths = np.array([[len(k[1]), len(k[2])] for k in keys]).ravel()
        out.append(dict(bucket=b, block=block, shared=pack(shared), rest=press.compress(rest), lengths=pack(lengths),
                        before=press.compress(b"".join(k[2] for k in keys)), counts=pack(entries.counts[lo:hi])))
    return out


# Merging ------------------------------------------------------------------------

class Run:
    """A front-coded run, decoded as it is read."""

    def __init__(self, row: dict) -> None:
        self.shared = unpack(row["shared"]).tolist()
        lengths = unpack(row["lengths"]).reshape(-1, 2)
        self.lengths = lengths[:, 0].tolist()
        self.rest = zstandard.ZstdDecompressor().decompress(row["rest"])
        raw = zstandard.ZstdDecompressor().decompress(row["before"])
        cuts = np.concatenate([[0], np.cumsum(lengths[:, 1])]).tolist()
        self.before = [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.counts = unpack(row["counts"])
        self.at = self.read = 0
        self.now = b""

    def step(self) -> bool:
        """Go to the next suffix; False at the end."""
        if self.at == len(self.shared):
            return False
        s = self.shared[self.at]
        n = self.lengths[self.at] - s
        self.now = self.now[:s] + self.rest[self.read:self.read + n]
        self.read += n
        self.at += 1
        return True


def merge(runs: list[Run]) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """(run, place in it) in suffix order, prefix lengths shared with the one before, suffix lengths.

    ``known[r]`` is the prefix that run r's suffix shares with the last one put
    out.  Every suffix still to come is not smaller than that one, so the larger
    known prefix wins; only equal ones are compared, from there on.
    """
    width = 1
    while width < len(runs):
        width *= 2
    known = [0] * width
    alive = [r < len(runs) and runs[r].step() for r in range(width)]
    lose = [0] * width

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        if not alive[b]:
            return a, b
        if not alive[a]:
            return b, a
        ka, kb = known[a], known[b]
        if ka != kb:
            return (a, b) if ka > kb else (b, a)
        x, y = runs[a].now, runs[b].now
        end = min(len(x), len(y))
        while ka < end and x[ka:ka + 16] == y[ka:ka + 16]:
            ka += 16
        ka = min(ka, end)
        while ka < end and x[ka] == y[ka]:
            ka += 1
        first = (len(x), a) <= (len(y), b) if ka == end else x[ka] < y[ka]
        winner, loser = (a, b) if first else (b, a)
        known[loser] = ka
        return winner, loser

    champions = list(range(width))  # first tournament, bottom up
    size = width
    while size > 1:
        following = []
        for i in range(0, size, 2):
            winner, loser = play(champions[i], champions[i + 1])
            lose[(size + i) // 2] = loser
            following.append(winner)
        champions = following
        size //= 2
    winner = champions[0]
    order, shared, lengths = [], [], []
    while alive[winner]:
        run = runs[winner]
        order.append((winner, run.at - 1))
        shared.append(known[winner])
        lengths.append(len(run.now))
        if run.at < len(run.shared):
            known[winner] = run.shared[run.at]
        alive[winner] = run.step()
        node = (width + winner) // 2
        while node:
            winner, lose[node] = play(winner, lose[node])
            node //= 2
    return order, shared, lengths


def repeated_windows(shared: np.ndarray, lengths: np.ndarray, before: np.ndarray, n_before: np.ndarray,
                     counts: np.ndarray, offsets: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest window offset (bytes before the anchor) that repeats, or NONE."""
    n = len(shared)
    near, far = np.full(n, NONE, np.int64), np.full(n, NONE, np.int64)
    h = np.zeros(n, np.uint64)
    for offset in range(offsets[1] + 1):
        if offset:
            h = mixed(h * np.uint64(_FACTOR) + before[:, BEFORE - offset] + np.uint64(1))
        if offset < offsets[0]:
            continue
        depth = LENGTH - offset
        fit = np.flatnonzero((lengths >= depth) & (n_before >= offset))
        if not len(fit):
            continue
        interval = np.cumsum(shared < depth).astype(np.uint64)  # suffixes that agree for depth bytes
        key = mixed(h[fit] + np.uint64(_FACTOR) * interval[fit])
        _, place = np.unique(key, return_inverse=True)
        twice = fit[np.bincount(place, counts[fit])[place] > 1]
        near[twice] = np.minimum(near[twice], offset)
        far[twice] = offset
    return near, far


def _merge_bucket(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        return _merged(rows, RANGES[rows[0]["bucket"] // buckets])

    return run


def _merged(rows: list[dict], offsets: tuple[int, int]) -> pa.Table:
    runs = [Run(r) for r in rows]
    order, shared, lengths = merge(runs)
    befores = [runs[r].before[i] for r, i in order]
    near, far = repeated_windows(
        np.array(shared), np.array(lengths), _fixed(befores, BEFORE, right=True),
        np.array([len(b) for b in befores]), np.array([runs[r].counts[i] for r, i in order]), offsets)
    answer = [np.full((2, len(run.shared)), NONE, np.int64) for run in runs]
    of, place = np.array(order).T
    for r in range(len(runs)):
        mine = of == r
        answer[r][0, place[mine]], answer[r][1, place[mine]] = near[mine], far[mine]
    return pa.Table.from_pylist(
        [dict(kind=2, bucket=r["bucket"], block=r["block"], answer=pack(a[0]), answer2=pack(a[1]))
         for r, a in zip(rows, answer, strict=True)], schema=_TOLD)


# Cutting ------------------------------------------------------------------------

def _runs_of_block(buckets: int):
    schema = pa.schema([(x.split()[0], {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]])
                        for x in RUN.split(", ")])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        entries = Entries(Text(row["ends"], row["body"]), right.to_pylist(), buckets)
        return pa.Table.from_pylist(_run_rows(row["block"], entries), schema=schema)

    return run


def covered(text: Text, entries: Entries, replies: list[dict]) -> np.ndarray:
    """Which bytes of a block go."""
    near, far = np.full(len(entries.keys), NONE, np.int64), np.full(len(entries.keys), NONE, np.int64)
    by = {r["bucket"]: r for r in replies if r["kind"] == 2}
    for b, (lo, hi) in entries.runs.items():
        near[lo:hi], far[lo:hi] = unpack(by[b]["answer"]), unpack(by[b]["answer2"])
    near, far = near[entries.entry_of_place], far[entries.entry_of_place]
    hit = near != NONE
    change = np.zeros(len(text.data) + 1, np.int64)
    np.add.at(change, entries.places[hit] - far[hit], 1)
    np.add.at(change, entries.places[hit] - near[hit] + LENGTH, -1)
    return np.cumsum(change[:-1]) > 0


def _cut(buckets: int):
    names = ["doc_id", "n_bytes", "spans", "kept"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row, replies = left.to_pylist()[0], right.to_pylist()
        text = Text(row["ends"], row["body"])
        gone = covered(text, Entries(text, replies, buckets), replies)
        spans, kept = [], []
        for a, b in zip(text.starts.tolist(), text.ends.tolist(), strict=True):
            mask = gone[a:b]
            edges = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
            spans.append([{"start": int(s), "end": int(e)} for s, e in edges.reshape(-1, 2)])
            kept.append(text.data[a:b][~mask].tobytes())
        return pa.Table.from_arrays(
            [pa.array(row["docs"], pa.int64()), pa.array((text.ends - text.starts).astype(np.int64)),
             pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
             pa.array(kept, pa.binary())], names=names)

    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   block_bytes: int = BLOCK_BYTES, bucket_entries: int = BUCKET_ENTRIES, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, spans (removed byte ranges, end exclusive) and kept (binary) of every text."""
    spark = docs.sparkSession
    ship_code(spark)
    blocks = to_scratch(id_text(docs, id_col, text_col).mapInArrow(_blocks(block_bytes), BLOCK), "blocks")
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(4 * parts, -(-total // (LENGTH - GRAM) * 2 // bucket_entries))

    def with_replies(run, ddl: str, *told: DataFrame) -> DataFrame:
        replies = told[0] if len(told) == 1 else told[0].unionByName(told[1])
        return (blocks.select("block", "docs", "ends", "body").groupBy("block")
                .cogroup(replies.groupBy("block")).applyInArrow(run, ddl))

    asked = blocks.select("block", "ends", "body").mapInArrow(_ask(buckets), ASK)
    told = to_scratch(asked.groupBy("bucket").applyInArrow(_repeated(hot), TOLD), "repeated")
    del asked
    release_shuffles(spark)
    runs = with_replies(_runs_of_block(buckets), RUN, told)
    merged = to_scratch(runs.groupBy("bucket").applyInArrow(_merge_bucket(buckets), TOLD), "merged")
    del runs
    release_shuffles(spark)
    return with_replies(
        _cut(buckets), "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary",
        told, merged)


def span_digests(spans: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of ``repeated_spans``."""
    return spans.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

