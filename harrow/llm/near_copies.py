"""Near-duplicate classes by SetSketch registers, joint likelihood and exact verification.

A document is the set of its distinct word shingles.  A SetSketch has
``BANDS * ROWS`` registers; each is the truncated, exponentially spaced
minimum floor(1 - log_BASE(x)) of exponential hash values x over the set, so
sketches merge by maximum and equal registers are likelier for similar sets.
Groups of ROWS registers form band keys; documents that share a key are
candidates of each other (at Jaccard 0.8 a pair is missed with a probability of
about 3e-6).

Documents with equal sets are first reduced to one representative (the tree
merge of ``exact_copies``).  Buckets with the same members are looked at once.
A bucket becomes one *cell*, or several if it is large; in a cell all pairs are
rated by the joint likelihood of their registers given the known set sizes,
and taken from the likeliest down: a pair counts only when the full sets
confirm it, and pairs that are connected already, that differ too much in size
for the threshold, or whose estimate is five standard errors below it, need no
look.  A cell returns its connected groups, never its pairs.

Large buckets (over ``CELL`` members) are cut into blocks; the first round
compares block 0 with each other block.  Components follow by passing least
ids between groups and documents, both of bounded degree.  A second round then
takes, in each large bucket, the documents outside its main component against
all members of a set size that allows a link, so that every pair of a bucket
that is not connected by then has been compared: no cap, and no pairs for what
is connected.  Its cells pair two places (a band of set sizes and a block of
it); a place holds up to ``SIDE`` documents, fewer when they are long, so that a
member is copied once for every ``SIDE`` documents of the remainder near its size.

Defined results: letters A-Z are lowered, words are cut at ASCII white space;
a text with fewer words than a shingle is one shingle; null, empty and blank
texts have the empty set and are linked with nothing; rows with a null id are
linked with nothing, have component null and stay; rows that share an id are
one document; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.llm.common import id_text, release_shuffles, ship_code, to_scratch
from harrow.llm.exact_copies import RUNS, deal_runs, tree_merge
from harrow.llm.katz import mixed
from harrow.llm.token_counts import worker_value

BANDS, ROWS = 42, 6
REGISTERS = BANDS * ROWS
#: SetSketch parameters: base, rate of the exponential values, largest register.
BASE, RATE, TOP = 1.1, 20.0, 254
#: Members of a cell that is not cut, of a block of a larger bucket, and (at least) of a place of the second round.
CELL, BLOCK, REST = 256, 192, 128
#: Members of a place of the second round at most, and their shingles together.
SIDE, SIDE_SHINGLES = 1024, 1 << 19
ERRORS = 5.0
_MULTIPLIERS = np.random.default_rng(20_240).integers(1, 2**63, REGISTERS, dtype=np.uint64) | np.uint64(1)
_PRIME = np.uint64(0x100000001B3)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) > 250_000:
            self.clear()
        self[word] = h
        return h


def shingle_set(words: list[bytes], width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; fewer words than ``width`` are one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(len(w) - width + 1, 1)
    size = min(width, len(w))
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = mixed(h * _PRIME + w[k:k + n])
    return np.unique(h)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, REGISTERS) register values of sets that are not empty."""
    out = np.empty((len(sets), REGISTERS), np.uint32)
    step = 2048
    for i, s in enumerate(sets):
        low = np.full(REGISTERS, np.iinfo(np.uint32).max, np.uint32)
        for at in range(0, len(s), step):
            np.minimum(low, ((s[at:at + step, None] * _MULTIPLIERS) >> np.uint64(32)).min(axis=0).astype(np.uint32),
                       out=low)
        out[i] = low
    x = -np.log1p(-(out + 0.5) / 2.0**32) / RATE  # exponential minima
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP).astype(np.uint8)


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """(sets, BANDS) keys; the band is part of its key."""
    key = np.arange(BANDS, dtype=np.uint64)[None, :] + np.zeros((len(sketches), 1), np.uint64)
    parts = sketches.reshape(len(sketches), BANDS, ROWS).astype(np.uint64)
    for k in range(ROWS):
        key = mixed(key * _PRIME + parts[:, :, k])
    return key.view(np.int64)


def likeliest(more: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard estimate of pairs, jointly by likelihood.

    more and less count the registers of a above and below those of b; n_a and
    n_b are the set sizes.  The likelihood is that of SetSketch: a register
    of a is above b's with probability p(u - v * J), u and v the sizes' shares.
    """
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    grid = np.linspace(0, 1, 81)[None, :] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)
    up, down = np.maximum(p(u - v * grid), 1e-9), np.maximum(p(v - u * grid), 1e-9)
    same = np.maximum(1 - up - down, 1e-9)
    equal = REGISTERS - more - less
    fit = more[:, None] * np.log(up) + less[:, None] * np.log(down) + equal[:, None] * np.log(same)
    return np.take_along_axis(grid, fit.argmax(axis=1)[:, None], axis=1)[:, 0]


SKETCHED = ("doc_id long, n_shingles long, digest binary, bands array<long>, sketch binary, body binary")


def _sketch(width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()),
                        ("bands", pa.list_(pa.int64())), ("sketch", pa.binary()), ("body", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = worker_value("near.hashes", "", WordHashes)
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                words = [t.encode().lower().split() for t in part.column(1).to_pylist()]
                sets = [shingle_set(w, width, hashes) for w in words]
                full = [i for i, s in enumerate(sets) if len(s)]
                sketches = registers([sets[i] for i in full])
                keys = band_keys(sketches)
                bands: list = [None] * len(sets)
                sketch: list = [None] * len(sets)
                for row, i in enumerate(full):
                    bands[i], sketch[i] = keys[row].tolist(), sketches[row].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                     pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary()),
                     pa.array([press.compress(b" ".join(w)) if w else None for w in words], pa.binary())],
                    schema=schema)

    return run


class Groups:
    """Union-find over the places of a cell."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[max(self.root(i), self.root(j))] = min(self.root(i), self.root(j))


def _cell(width: int, percent: int):
    schema = pa.schema([("g", pa.int64()), ("doc_id", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        ids, labels = table["doc_id"].to_pylist(), table["label"].to_pylist()
        n = len(ids)
        size = table["n_shingles"].to_numpy().astype(float)
        label, side = table["label"].to_numpy(), table["side"].to_numpy()
        across = side.any()  # two places: only pairs between them
        sketches = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(n, REGISTERS)
        groups = Groups(n)
        first: dict[int, int] = {}
        for i, l in enumerate(labels):  # connected by an earlier round
            groups.join(first.setdefault(l, i), i)
        share = percent / 100
        least = share - ERRORS * np.sqrt(share * (1 - share) / REGISTERS)
        found = []
        for i in range(n - 1):
            rest = np.arange(i + 1, n)
            rest = rest[(label[rest] != label[i]) & (np.minimum(size[i], size[rest])
                                                     >= share * np.maximum(size[i], size[rest]) - 1e-9)]
            if across:
                rest = rest[side[rest] != side[i]]
            if len(rest):
                diff = sketches[i].astype(np.int16) - sketches[rest]
                estimate = likeliest((diff > 0).sum(axis=1), (diff < 0).sum(axis=1),
                                     np.full(len(rest), size[i]), size[rest])
                keep = estimate >= least
                found.append(np.stack([np.full(int(keep.sum()), i), rest[keep], -estimate[keep]]))
        sets: dict[int, np.ndarray] = {}
        bodies = table["body"]
        hashes = worker_value("near.hashes", "", WordHashes)

        def full(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = shingle_set(zstandard.ZstdDecompressor().decompress(bodies[i].as_py()).split(), width, hashes)
            return sets[i]

        if found:
            pairs = np.concatenate(found, axis=1)
            for i, j in pairs[:2, np.argsort(pairs[2], kind="stable")].T.astype(int).tolist():
                if groups.root(i) != groups.root(j):
                    a, b = full(i), full(j)
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    if 100 * both >= percent * (len(a) + len(b) - both):
                        groups.join(i, j)
        members: dict[int, dict[int, int]] = {}
        for i, l in enumerate(labels):  # one document of each earlier component is enough
            members.setdefault(groups.root(i), {}).setdefault(l, ids[i])
        out = [sorted(m.values()) for m in members.values() if len(m) > 1]
        g = [xxhash.xxh64_intdigest(np.array(m, np.int64).tobytes()) - 2**63 for m in out]
        return pa.Table.from_arrays(
            [pa.array([k for k, m in zip(g, out, strict=True) for _ in m], pa.int64()),
             pa.array([d for m in out for d in m], pa.int64())], schema=schema)

    return run


def _components(links: DataFrame) -> DataFrame:
    """(doc_id, label): the least id connected through groups; links is (g, doc_id)."""
    now = to_scratch(links.distinct().withColumn("label", F.col("doc_id")).withColumn("moved", F.lit(True)), "labels")
    while now.filter("moved").limit(1).count():
        step = now.withColumnRenamed("label", "old")
        label = F.col("old")
        for _ in range(2):  # two passes over groups and documents for each written table
            step = (step.withColumn("label", F.min(label).over(Window.partitionBy("g")))
                    .withColumn("label", F.min("label").over(Window.partitionBy("doc_id"))))
            label = F.col("label")
        now = to_scratch(step.select("g", "doc_id", "label", (F.col("label") < F.col("old")).alias("moved")), "labels")
    return now.select("doc_id", "label").distinct()


def _each(n: str | int, start: int = 0):
    return F.explode(F.sequence(F.lit(start), F.expr(f"cast({n} as int) - 1")))


def near_copies(docs: DataFrame, width: int = 4, percent: int = 80, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row.

    Documents are linked at 100 * intersection >= percent * union of their
    shingle sets; a component's id is its least document id.
    """
    ship_code(docs.sparkSession)
    rows = to_scratch(id_text(docs, id_col, text_col).mapInArrow(_sketch(width), SKETCHED), "sketches")
    classes = to_scratch(
        tree_merge(rows.filter("digest is not null and doc_id is not null").select("doc_id", "digest", "n_shingles", deal_runs().alias("run")),
                   ["digest", "n_shingles"], RUNS).select("doc_id", "least"), "classes")
    release_shuffles(docs.sparkSession)
    leaders = classes.filter(F.col("doc_id") == F.col("least")).select("doc_id").distinct()
    keyed = (rows.filter("bands is not null").select("doc_id", "bands").join(leaders, "doc_id", "left_semi")
             .dropDuplicates(["doc_id"]).select("doc_id", F.explode("bands").alias("key")))
    keyed = to_scratch(keyed, "bands")
    # Same members: exact for two; of more, the least, the largest and 128 bits of hashes agree.
    who = [F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.bit_xor(F.xxhash64("doc_id")).alias("x"),
           F.bit_xor(F.xxhash64(F.lit(1), "doc_id")).alias("y")]
    same = (keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m"), *who)
            .filter("m > 1").groupBy("m", "low", "high", "x", "y").agg(F.min("key").alias("key")).select("key", "m"))
    members = to_scratch(keyed.join(same, "key"), "members")
    wanted = members.select("doc_id").distinct()
    # The wanted ids grow with the corpus, so they are never broadcast.
    bodies = to_scratch(rows.select("doc_id", "n_shingles", "sketch", "body")
                        .join(wanted.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "bodies")
    release_shuffles(docs.sparkSession)

    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("blocks")).cast("int")
    cut = members.withColumn("blocks", F.when(F.col("m") <= CELL, 1).otherwise(blocks)).withColumn("block", block)
    home = cut.filter("blocks = 1 or block > 0").select("key", "doc_id", F.col("block").alias("cell"))
    base = cut.filter("blocks > 1 and block = 0").select("key", "doc_id", _each("blocks", 1).alias("cell"))
    compare = _cell(width, percent)
    cells = home.unionByName(base).select("key", F.lit(0).alias("a"), F.col("cell").alias("b"), F.lit(0).alias("side"),
                                          "doc_id", F.col("doc_id").alias("label"))
    links = to_scratch(_compared(cells, bodies, compare), "links")
    labels = to_scratch(_components(links), "components")

    large = cut.filter("blocks > 1")
    if large.limit(1).count():
        large = to_scratch(
            large.join(labels, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id")), "large")
        more = to_scratch(_compared(_rest_cells(large, bodies, percent), bodies, compare), "more-links")
        # A group names one document of each earlier component, so link those components by their labels.
        renamed = (more.join(labels, "doc_id", "left")
                   .select("g", F.coalesce("label", "doc_id").alias("doc_id")).distinct())
        joined = _components(renamed).select(F.col("doc_id").alias("label"), F.col("label").alias("final"))
        old = labels.join(joined, "label", "left").select("doc_id", F.coalesce("final", "label").alias("label"))
        new = joined.select(F.col("label").alias("doc_id"), F.col("final").alias("label"))
        labels = to_scratch(old.unionByName(new).groupBy("doc_id").agg(F.min("label").alias("label")), "components")

    known = (classes.select("doc_id", F.col("least").alias("leader"))
             .join(labels.select(F.col("doc_id").alias("leader"), "label"), "leader", "left")
             .select("doc_id", F.coalesce("label", "leader").alias("component")))
    by_id = known.groupBy("doc_id").agg(F.min("component").alias("component"))
    return (rows.select("doc_id", "n_shingles").join(by_id, "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each class stays, the one with the least id; columns as they were."""
    gone = near_copies(docs, width, percent).filter("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")


def _size_band(n: Column, percent: int) -> Column:
    """Band of a set size; sets whose bands are no neighbours differ too much in size to be linked."""
    return F.floor(F.log(n) / _band_width(percent)).cast("int")


def _band_width(percent: int) -> float:
    return max(-math.log(percent / 100), 0.05) * (1 + 1e-6)  # wider than a link allows, so rounding drops nothing


def _rest_cells(large: DataFrame, bodies: DataFrame, percent: int) -> DataFrame:
    """Second-round cells: key, places a and b, side (1: in b), doc_id, label.

    large is (key, doc_id, label) of the large buckets.  The documents outside
    the main component of a bucket meet each other and the main component,
    where the bands of their set sizes are the same or neighbours.
    """
    sizes = large.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    main = (sizes.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("m"),
                                     F.max("n").alias("most"))
            .filter("m > most").select("key", "main"))
    banded = to_scratch(
        large.select("key", "doc_id", "label").join(main, "key").join(bodies.select("doc_id", "n_shingles"), "doc_id")
        .select("key", "doc_id", "label", (F.col("label") != F.col("main")).alias("outside"),
                _size_band(F.col("n_shingles"), percent).alias("band")), "banded")
    largest = F.exp((F.col("band") + 1) * F.lit(_band_width(percent)))
    side = F.greatest(F.lit(float(REST)), F.least(F.lit(float(SIDE)), F.lit(float(SIDE_SHINGLES)) / largest))
    blocks = (banded.groupBy("key", "outside", "band").agg(F.count(F.lit(1)).alias("n"))
              .select("key", "outside", "band", F.ceil(F.col("n") / side).cast("int").alias("blocks")))
    placed = (banded.join(blocks, ["key", "outside", "band"])
              .withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.col("blocks")).cast("int")))
    others = blocks.select("key", F.col("outside").alias("o_outside"), F.col("band").alias("o_band"),
                           F.col("blocks").alias("o_blocks"),
                           F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)])).alias("band"))
    met = (placed.join(others, ["key", "band"]).filter("outside or o_outside")
           .select("key", "doc_id", "label", F.struct("band", "outside", "block").alias("mine"), "o_band", "o_outside",
                   _each("o_blocks").alias("o_block"))
           .withColumn("other", F.struct(F.col("o_band").alias("band"), F.col("o_outside").alias("outside"),
                                         F.col("o_block").alias("block"))))
    return met.select("key", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"),
                      (F.col("mine") > F.col("other")).cast("int").alias("side"), "doc_id", "label")


def _compared(cells: DataFrame, bodies: DataFrame, compare) -> DataFrame:
    return (cells.join(bodies, "doc_id").select("key", "a", "b", "side", "doc_id", "label", "n_shingles", "sketch", "body")
            .groupBy("key", "a", "b").applyInArrow(compare, "g long, doc_id long"))
