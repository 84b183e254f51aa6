"""Toxicity by a small convolutional text classifier, trained in numpy.

Words are hashed into ``BUCKETS`` embedding rows.  Filters of widths 1, 2 and 3
run over the whole text; the maximum of each filter over all positions feeds a
logistic unit.  Scoring runs in Arrow batches over all rows with the fitted
weights broadcast (BUCKETS * WIDTH floats, 4 MB at most a filter column,
whatever the corpus).

Every labelled row outside the held-out fold is used, with its whole text: four
of five train, the fifth (by a hash of the id) calibrates.  The counts behind the
first embedding column are sums over all training texts.  Training (Adam,
gradients only at the positions that won) runs in shards of about
``SHARD_CHARS`` characters, dealt by a hash of the id, all from one start; the
model is the mean of theirs, where an embedding row weighs by the shard's texts
that hold it and the rest by its texts (parallel SGD, Zinkevich et al. 2010).
Calibration and the thresholds, one for each language with enough rows, come
from sums and running sums over all calibration rows; the score itself never
sees language, source, labels or id.

Defined results: null and empty texts score like a text of unknown words;
without labelled rows, or with one class only, every score is the share of
toxic labels (0.0 without any); rows with a null label do not train; of several
labels of one id the largest counts; repeated rows give repeated rows; a null
language has the common threshold; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harrow.llm.common import crc_fold, ship_code, slices, to_scratch
from harrow.llm.token_counts import worker_value

BUCKETS = 1 << 20
WIDTH = 8
FILTERS = 6
SPANS = (1, 2, 3)
PARTS = 3
#: Text of a training shard: about 8,000 common documents, whose numbers take some 70 MB.
SHARD_CHARS = 32_000_000
#: Words taken at once in one product; longer texts go in pieces.
PIECE = 200_000
#: Embedding rows of a block in which the shards' models are added up.
BLOCK = 1024
#: Parts in which scores are counted for a threshold.
CUTS = 64
#: Languages with fewer toxic or clean calibration rows share the common threshold.
LEAST_CLASS = 10
#: Embedding rows seen in fewer training texts stay 0, so that no text is learned by heart.
LEAST_TEXTS = 3
PAD = 0
WORD = re.compile(r"[^\W_]+")


class Buckets(dict):
    """Word to its embedding rows, remembered; row 0 is the padding.

    A word has three rows whose sum stands for it: one for the whole word and
    one for its beginning of 4 and of 5 letters, which inflected forms share.
    """

    def __missing__(self, word: str) -> tuple[int, ...]:
        rows = tuple(1 + xxhash.xxh64_intdigest(part.encode(), seed=n) % (BUCKETS - 1) if part else PAD
                     for n, part in enumerate((word, word[:4] if len(word) > 4 else "",
                                               word[:5] if len(word) > 5 else "")))
        if len(self) > 250_000:
            self.clear()
        self[word] = rows
        return rows

    def ids(self, text: str) -> np.ndarray:
        """(words, PARTS) rows of a text, with padding so that each filter has a place."""
        words = WORD.findall(text.lower())
        flat = np.fromiter(chain.from_iterable(map(self.__getitem__, words)), np.int32, PARTS * len(words))
        return np.concatenate([flat, np.zeros(PARTS * max(SPANS), np.int32)]).reshape(-1, PARTS)


@dataclass
class Model:
    """Weights: embedding rows in use, filters by span, output layer, calibration, thresholds."""

    rows: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    values: np.ndarray = field(default_factory=lambda: np.zeros((1, WIDTH), np.float32))
    filters: list[np.ndarray] = field(default_factory=list)
    bias: list[np.ndarray] = field(default_factory=list)
    out: np.ndarray | None = None
    out_bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0
    constant: float | None = None
    common: float = 0.5
    thresholds: dict[str, float] = field(default_factory=dict)

    def embedding(self) -> np.ndarray:
        e = np.zeros((BUCKETS, WIDTH), np.float32)
        e[self.rows] = self.values
        e[PAD] = 0
        return e


def _pieces(docs: list[np.ndarray], words: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Documents in groups of about so many words; a longer one goes in pieces that share max(SPANS) - 1 words."""
    at, group, n = [], [], 0
    for i, d in enumerate(docs):
        for a in range(0, len(d) - max(SPANS) + 1, words):
            piece = d[a:a + words + max(SPANS) - 1]
            if group and n + len(piece) > words:
                yield at, group
                at, group, n = [], [], 0
            at.append(i)
            group.append(piece)
            n += len(piece)
    if group:
        yield at, group


def _pooled(e: np.ndarray, filters: list[np.ndarray], bias: list[np.ndarray], docs: list[np.ndarray],
            where: bool = False, words: int = PIECE) -> tuple[np.ndarray, list[np.ndarray]]:
    """Maxima (documents, all filters) and, on wish, the winners' rows (documents, filters, span, parts) by span."""
    top = np.full((len(docs), len(SPANS) * FILTERS), -np.inf, np.float32)
    won = [np.zeros((len(docs), FILTERS, span, PARTS), np.int32) for span in SPANS]
    joint = np.concatenate([w[k] for w in filters for k in range(len(w))], axis=1)
    for at, group in _pieces(docs, words):
        flat = np.concatenate(group)
        ends = np.cumsum([len(d) for d in group])
        starts = np.concatenate([[0], ends[:-1]])
        last = np.concatenate([ends - k for k in range(1, max(SPANS))])  # from these a filter would reach the next text
        # One product gives every (span, offset) projection of each word; a filter adds its shifted columns.
        y = e[flat].sum(axis=1) @ joint
        col = 0
        for s, span in enumerate(SPANS):
            conv = y[:, col:col + FILTERS].copy()
            for k in range(1, span):
                conv[:-k] += y[k:, col + k * FILTERS:col + (k + 1) * FILTERS]
            col += span * FILTERS
            conv[last] = -np.inf
            best = np.maximum.reduceat(conv, starts, axis=0) + bias[s]
            mine = top[:, s * FILTERS:(s + 1) * FILTERS]
            if where:
                for i, a, b, value in zip(at, starts, ends, best, strict=True):
                    better = value > mine[i]
                    place = a + conv[a:b].argmax(axis=0)
                    for k in range(span):
                        won[s][i, better, k] = flat[place[better] + k]
                    mine[i] = np.maximum(mine[i], value)
            else:
                np.maximum.at(mine, at, best)
    return np.maximum(top, 0, out=top) if not where else top, won


def logits(model: Model, e: np.ndarray, docs: list[np.ndarray], batch_words: int = 200_000) -> np.ndarray:
    """Uncalibrated scores; documents are taken in groups of bounded length."""
    out, group, n = [], [], 0
    for d in [*docs, None]:
        if group and (d is None or n + len(d) > batch_words):
            top, _ = _pooled(e, model.filters, model.bias, group)
            out.append(top @ model.out + model.out_bias)
            group, n = [], 0
        if d is not None:
            group.append(d)
            n += len(d)
    return np.concatenate(out) if out else np.zeros(0, np.float32)


def _head_start(with_word: np.ndarray, n: np.ndarray) -> np.ndarray:
    """First column of the embeddings: how clearly a row speaks for label 1 (in standard errors).

    ``with_word``: training texts with each row by label (2, rows); ``n``: training texts by label.
    """
    odds = [np.log((with_word[k] + 0.5) / (n[k] - with_word[k] + 0.5)) for k in (0, 1)]
    error = np.sqrt(sum(1 / (with_word[k] + 0.5) + 1 / (n[k] - with_word[k] + 0.5) for k in (0, 1)))
    return (0.6 * np.clip((odds[1] - odds[0]) / error - 1.5, 0, 4)).astype(np.float32)


def start(rows: np.ndarray, with_word: np.ndarray, n: np.ndarray, seed: int = 7) -> Model:
    """The model from which every shard trains."""
    rng = np.random.default_rng(seed)
    values = rng.normal(0, 0.02, (len(rows), WIDTH)).astype(np.float32)
    values[:, 0] = _head_start(with_word, n)
    filters = [rng.normal(0, 0.1, (span, WIDTH, FILTERS)).astype(np.float32) for span in SPANS]
    for w in filters:
        w[0, 0] = np.abs(w[0, 0]) + 0.4
    mean = n[1] / n.sum()
    return Model(rows, values, filters, [np.full(FILTERS, -0.3, np.float32) for _ in SPANS],
                 np.full(len(SPANS) * FILTERS, 0.3, np.float32), float(np.log((mean + 1e-3) / (1 - mean + 1e-3))))


def numbered(rows: np.ndarray, docs: Iterable[np.ndarray]) -> list[np.ndarray]:
    """Documents in the numbers 1.. of the rows in use; all other rows are 0 like the padding, and so are their values."""
    number = np.zeros(BUCKETS, np.int32)
    number[rows] = np.arange(1, len(rows) + 1)
    return [number[d] for d in docs]


def train(first: Model, docs: list[np.ndarray], y: np.ndarray, epochs: int = 6, batch: int = 64,
          rate: float = 0.02, seed: int = 7) -> Model:
    """Fit embeddings, filters and output layer by Adam on the log loss, from ``first``.

    ``docs`` are in the numbers of the rows in use (:func:`numbered`), and the
    tables hold only those, so that training needs little memory beside them.
    """
    rng = np.random.default_rng(seed)
    e = np.concatenate([np.zeros((1, WIDTH), np.float32), first.values])
    filters, bias, out = [w.copy() for w in first.filters], [b.copy() for b in first.bias], first.out.copy()
    out_bias = np.array([first.out_bias], np.float32)
    dense = [*filters, *bias, out, out_bias]
    m = [np.zeros_like(p) for p in dense]
    v = [np.zeros_like(p) for p in dense]
    em, ev = np.zeros_like(e), np.zeros_like(e)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), batch):
            chosen = order[at:at + batch]
            group = [docs[i] for i in chosen]
            raw, won = _pooled(e, filters, bias, group, where=True)
            top = np.maximum(raw, 0)
            p = 1 / (1 + np.exp(-(top @ out + out_bias[0])))
            g = ((p - y[chosen]) / len(chosen)).astype(np.float32)
            g_top = np.outer(g, out) * (raw > 0)
            grads = [np.zeros_like(w) for w in filters] + [None] * len(SPANS)
            touched, pushes = [], []
            for s, span in enumerate(SPANS):
                gs = g_top[:, s * FILTERS:(s + 1) * FILTERS]
                grads[len(SPANS) + s] = gs.sum(axis=0)
                for k in range(span):
                    ids = won[s][:, :, k]
                    grads[s][k] = np.einsum("df,dfw->wf", gs, e[ids].sum(axis=2))
                    push = (gs[:, :, None] * filters[s][k].T[None]).reshape(-1, WIDTH)
                    for part in range(PARTS):
                        touched.append(ids[:, :, part].ravel())
                        pushes.append(push)
            grads += [top.T @ g + 1e-4 * out, np.array([g.sum()], np.float32)]
            step += 1
            fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for i, (param, grad) in enumerate(zip(dense, grads, strict=True)):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad**2
                param -= (rate * 0.25 * fix * m[i] / (np.sqrt(v[i]) + 1e-8)).astype(np.float32)
            ids, place = np.unique(np.concatenate(touched), return_inverse=True)
            grad = np.zeros((len(ids), WIDTH), np.float32)
            np.add.at(grad, place, np.concatenate(pushes))
            live = (ids != PAD) & (np.abs(grad).sum(axis=1) > 0)
            ids, grad = ids[live], grad[live]
            em[ids] = 0.9 * em[ids] + 0.1 * grad
            ev[ids] = 0.999 * ev[ids] + 0.001 * grad**2
            e[ids] -= rate * fix * em[ids] / (np.sqrt(ev[ids]) + 1e-8)
    return Model(first.rows, e[1:], filters, bias, out, float(out_bias[0]))


def calibrate(model: Model, marks: DataFrame, n1: int, n0: int) -> None:
    """A slope and shift (Platt, with its smoothed targets) so that 0.5 is the best cut, then cuts by language.

    ``marks``: z, y and lang of all calibration rows, of which ``n1`` and ``n0`` have label 1 and 0.
    """
    if n1 and n0:
        t = F.when(F.col("y") == 1, F.lit((n1 + 1) / (n1 + 2))).otherwise(F.lit(1 / (n0 + 2)))

        def at(ab: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
            """Loss, gradient and curvature; with a weak pull to slope 1 and shift 0."""
            q = F.col("z") * float(ab[0]) + float(ab[1])
            p = 1 / (1 + F.exp(-F.greatest(F.least(q, F.lit(30.0)), F.lit(-30.0))))
            r = marks.select("z", q.alias("q"), p.alias("p"), t.alias("t")).select(
                F.sum(F.greatest("q", F.lit(0.0)) + F.log1p(F.exp(-F.abs("q"))) - F.col("t") * F.col("q")),
                F.sum(F.col("z") * (F.col("p") - F.col("t"))), F.sum(F.col("p") - F.col("t")),
                *[F.sum(F.pow("z", F.lit(k)) * F.col("p") * (1 - F.col("p"))) for k in (2.0, 1.0, 0.0)]).first()
            pull = ab - [1.0, 0.0]
            return (r[0] + 0.5 * float((pull**2).sum()), np.array([r[1], r[2]]) + pull,
                    np.array([[r[3], r[4]], [r[4], r[5]]]) + np.eye(2))

        ab = np.array([1.0, 0.0])
        loss, g, curve = at(ab)
        for _ in range(50):  # Newton steps on two numbers, halved until they help
            move = np.linalg.solve(curve, g)
            there = at(ab - move)
            while np.abs(move).max() > 1e-9 and there[0] > loss:
                move /= 2
                there = at(ab - move)
            ab = ab - move
            loss, g, curve = there
            if np.abs(move).max() < 1e-6:
                break
        model.scale, model.shift = max(float(ab[0]), 1e-2), float(ab[1])
        cut = _cuts(_with_scores(marks.withColumn("lang", F.lit("")), model)).get("", 0.5)
        if 0 < cut < 1:  # the best common threshold becomes 0.5
            model.shift -= float(np.log(cut / (1 - cut)))
    model.thresholds.update(_cuts(_with_scores(marks.filter(F.col("lang") != ""), model), LEAST_CLASS))


def _with_scores(marks: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        calibrated = Model(scale=model_scale, shift=model_shift)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(
                probabilities(calibrated, b.column(2).to_numpy()), pa.float64())], names=["lang", "y", "s"])

    model_scale, model_shift = model.scale, model.shift
    return marks.select("lang", "y", "z").mapInArrow(run, "lang string, y int, s double")


def _cuts(scored: DataFrame, least: int = 1) -> dict[str, float]:
    """Middle of the gap that gives the best F1, by language; of those with fewer rows of a label none.

    Scores are counted, cut into ``CUTS`` parts that hold about equally many, and
    added up from the highest down within the parts, behind the sums of the parts
    above; so every score of every row is tried as a cut and no task has them all.
    """
    counted = to_scratch(scored.groupBy("lang", "s").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("hit")), "toxicity-scores")
    bounds = sorted(set(counted.approxQuantile("s", [k / CUTS for k in range(1, CUTS)], 0.002)))
    part = sum(((F.col("s") < x).cast("int") for x in bounds), F.lit(0))
    counted = counted.withColumn("part", part)
    totals = counted.groupBy("lang", "part").agg(F.sum("n").alias("part_n"), F.sum("hit").alias("part_hit"))
    above = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy("lang")
    totals = totals.select(  # CUTS rows a language
        "lang", "part", F.coalesce(F.sum("part_n").over(above), F.lit(0)).alias("n_above"),
        F.coalesce(F.sum("part_hit").over(above), F.lit(0)).alias("hit_above"),
        F.sum("part_n").over(everything).alias("all_n"), F.sum("part_hit").over(everything).alias("all_hit"))
    totals = totals.filter((F.col("all_hit") >= least) & (F.col("all_n") - F.col("all_hit") >= least))
    down = Window.partitionBy("lang", "part").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    f1 = 2 * (F.col("hit_above") + F.sum("hit").over(down)) / (F.col("n_above") + F.sum("n").over(down) + F.col("all_hit"))
    best = (counted.join(F.broadcast(totals), ["lang", "part"]).select("lang", "s", f1.alias("f1"))
            .groupBy("lang").agg(F.max(F.struct("f1", "s"))["s"].alias("best")))
    below = F.max(F.when(F.col("s") < F.col("best"), F.col("s")))
    rows = counted.join(F.broadcast(best), "lang").groupBy("lang", "best").agg(below.alias("below")).collect()  # one a language
    return {r.lang: (r.best + (r.below or 0.0)) / 2 for r in rows}


def probabilities(model: Model, z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.scale * z.astype(np.float64) + model.shift, -30, 30)))


def _tokens(b: pa.RecordBatch | pa.Table, rows: np.ndarray | None = None) -> list[np.ndarray]:
    buckets = worker_value("toxicity.buckets", "", Buckets)
    docs = (buckets.ids(t) for t in b.column("text").to_pylist())
    return list(docs) if rows is None else numbered(rows, docs)


def _counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows in at least LEAST_TEXTS texts, and the texts with each by label (2, rows)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_word = np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            for piece in slices([b], 500):
                for d, label in zip(_tokens(piece), piece.column("y").to_pylist(), strict=True):
                    with_word[label, np.unique(d)] += 1
        with_word[:, PAD] = 0
        some = np.flatnonzero(with_word.sum(axis=0))
        for at in range(0, len(some), 50_000):
            i = some[at:at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(with_word[0, i]), pa.array(with_word[1, i])],
                                             names=["row", "clean", "toxic"])

    t = (rows.select("y", "text").mapInArrow(run, "row long, clean long, toxic long")
         .groupBy("row").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
         .filter(F.col("clean") + F.col("toxic") >= LEAST_TEXTS).orderBy("row").toArrow())  # at most BUCKETS small rows
    return t.column("row").to_numpy(), np.stack([t.column("clean").to_numpy(), t.column("toxic").to_numpy()])


def _trained(rows: DataFrame, first: Model, shards: int) -> Model:
    """The mean of the models that the shards train from ``first``."""
    shared = rows.sparkSession.sparkContext.broadcast(first)

    def shard(key: tuple, group: pa.Table) -> pa.Table:
        begun = shared.value
        group = group.sort_by("h")
        y = group.column("y").to_numpy().astype(np.float32)
        docs = []
        for b in group.to_batches(max_chunksize=500):
            docs += _tokens(b, begun.rows)
        n = np.zeros(len(begun.rows) + 1, np.float64)
        for d in docs:
            n[np.unique(d)] += 1
        model = train(begun, docs, y)
        out: list[tuple[int, np.ndarray, np.ndarray]] = [(-1, np.full(1, len(docs), np.float64), _flat(model)[None])]
        for at in range(0, len(begun.rows), BLOCK):
            out.append((at // BLOCK, n[1 + at:1 + at + BLOCK], model.values[at:at + BLOCK]))
        return pa.table({"shard": pa.array([key[0].as_py()] * len(out), pa.int64()), "block": pa.array([o[0] for o in out], pa.int64()),
                         "n": pa.array([o[1].tobytes() for o in out], pa.binary()),
                         "v": pa.array([o[2].astype(np.float32).tobytes() for o in out], pa.binary())})

    def mean(key: tuple, group: pa.Table) -> pa.Table:
        total, weight = 0.0, 0.0
        for n, v in zip(*(group.sort_by("shard").column(c).to_pylist() for c in ("n", "v")), strict=True):
            n = np.frombuffer(n, np.float64)
            total = total + n[:, None] * np.frombuffer(v, np.float32).reshape(len(n), -1)
            weight = weight + n
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()),
                         "v": pa.array([(total / np.maximum(weight, 1)[:, None]).astype(np.float32).tobytes()], pa.binary())})

    parts = (rows.select(F.pmod(F.xxhash64("h"), F.lit(shards)).alias("shard"), "h", "y", "text")
             .groupBy("shard").applyInArrow(shard, "shard long, block long, n binary, v binary")
             .groupBy("block").applyInArrow(mean, "block long, v binary").orderBy("block").collect())  # one model
    dense = np.frombuffer(bytes(parts[0].v), np.float32)
    values = [np.frombuffer(bytes(r.v), np.float32).reshape(-1, WIDTH) for r in parts[1:]]
    model = Model(first.rows, np.concatenate(values) if values else first.values)
    for like, name in ((first.filters, "filters"), (first.bias, "bias")):
        setattr(model, name, [])
        for w in like:
            getattr(model, name).append(dense[:w.size].reshape(w.shape))
            dense = dense[w.size:]
    model.out, model.out_bias = dense[:-1], float(dense[-1])
    return model


def _flat(model: Model) -> np.ndarray:
    return np.concatenate([*[w.ravel() for w in (*model.filters, *model.bias)], model.out, [model.out_bias]]).astype(np.float32)


def _logits_of(rows: DataFrame, model: Model) -> DataFrame:
    """y, lang and the uncalibrated score z of each row."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        table = np.concatenate([np.zeros((1, WIDTH), np.float32), fitted.values])
        for b in slices(batches, 500):
            z = logits(fitted, table, _tokens(b, fitted.rows)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([b.column("y"), b.column("lang"), pa.array(z, pa.float64())], names=["y", "lang", "z"])

    return to_scratch(rows.select("y", "lang", "text").mapInArrow(run, "y int, lang string, z double"), "toxicity-logits")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", lang_col: str = "lang", held_out_fold: int = 0,
        max_words: int | None = None) -> Model:
    """Train and calibrate on all labelled rows outside the held-out fold.

    Texts of over ``max_words`` words are passed over in fitting; by default there is no such limit.
    """
    ship_code(docs.sparkSession)
    marks = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
             .filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (crc_fold("doc_id") != held_out_fold))
             .groupBy("doc_id").agg(F.max("y").alias("y")))
    # One row for each id.
    texts = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"),
                         F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(marks, "doc_id")
             .groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("r"), F.max("y").alias("y"))
             .select(F.xxhash64("doc_id").alias("h"), "y", "r.lang", "r.text"))
    if max_words is not None:
        def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, 500):
                yield b.filter(pa.array([len(d) <= max_words for d in _tokens(b)], pa.bool_()))

        texts = texts.mapInArrow(short, texts.schema)
    rows = to_scratch(texts.withColumn("calib", F.pmod("h", F.lit(5)) == 4), "toxicity-rows")
    found = {(r.calib, r.y): r for r in rows.groupBy("calib", "y").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).collect()}
    n = np.array([[found[c, y].n if (c, y) in found else 0 for y in (0, 1)] for c in (False, True)], np.int64)
    if not n.sum(axis=0).all():
        return Model(constant=float(n[:, 1].sum() / n.sum()) if n.sum() else 0.0)
    # Four of five rows train, the fifth calibrates; all do both if one part has one label only.
    fits = holds = rows
    if n.all():
        fits, holds, (n_fit, n_hold) = rows.filter(~F.col("calib")), rows.filter("calib"), n
    else:
        n_fit = n_hold = n.sum(axis=0)
    chars = sum(r.chars for (calib, _), r in found.items() if not (calib and n.all()))
    model = _trained(fits, start(*_counts(fits), n_fit), 1 + chars // SHARD_CHARS)
    calibrate(model, _logits_of(holds, model), int(n_hold[1]), int(n_hold[0]))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """doc_id, score, threshold, rejected (score >= threshold), then the columns ``keep``."""
    ship_code(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    tag = str(np.random.default_rng().integers(2**62))
    keep = keep or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = worker_value("toxicity.buckets", "", Buckets)
        fitted = shared.value
        e = worker_value("toxicity.embedding", tag, fitted.embedding) if fitted.constant is None else None
        for b in slices(batches, 500):
            if fitted.constant is None:
                z = logits(fitted, e, [buckets.ids(t) for t in b.column(2).to_pylist()])
                s = probabilities(fitted, z)
            else:
                s = np.full(b.num_rows, fitted.constant)
            t = np.array([fitted.thresholds.get(x, fitted.common) for x in b.column(1).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(s, pa.float64()), pa.array(t, pa.float64()), pa.array(s >= t, pa.bool_()),
                 *[b.column(3 + i) for i in range(len(keep))]],
                names=["_id", "_score", "_threshold", "_rejected", *[f"_{i}" for i in range(len(keep))]])

    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(lang_col).cast("string").alias("_lang"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
                        *[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)])
    ddl = "_id long, _score double, _threshold double, _rejected boolean"
    for i, c in enumerate(keep):
        ddl += f", _{i} {docs.schema[c].dataType.simpleString()}"
    return texts.mapInArrow(run, ddl)


def toxicity(docs: DataFrame, labels: DataFrame, **names: str) -> DataFrame:
    """doc_id, held_out, score, predicted, lang_threshold and rejected of every whole text."""
    scored = score(docs, fit(docs, labels, **names), **{k: v for k, v in names.items() if k != "label_col"})
    return scored.select(
        F.col("_id").alias("doc_id"), (crc_fold("_id") == 0).alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"), F.col("_threshold").alias("lang_threshold"),
        F.col("_rejected").alias("rejected"))


def drop_toxic(docs: DataFrame, labels: DataFrame, train_docs: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` under their language's threshold, all columns as they were."""
    names = docs.columns
    model = fit(docs if train_docs is None else train_docs, labels)
    return (score(docs, model, keep=names).filter(~F.col("_rejected"))
            .select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(names)]))
