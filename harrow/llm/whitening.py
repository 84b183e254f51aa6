"""Embedding whitening by incremental eigendecomposition.

Vectors become integer rows floor(scale * x).  The fit list holds each distinct
row once; it is written, and three passes read it:

1. Each task keeps the count, the mean and the eigensystem of the scatter of
   what it has seen.  A new row x moves the scatter by the centred rank-one term
   m / (m + 1) * (x - mean)(x - mean)^T, so the new eigenvalues are the roots of
   a secular equation.  Negligible weights and equal eigenvalues are deflated,
   roots are found relative to their nearer pole by rational interpolation
   inside a bracket, and the weights are computed anew from the roots (Gu and
   Eisenstat), which keeps the vectors orthogonal.  The tasks' spectra are
   combined in a tree: one takes in another by one rank-one update for each of
   its eigenpairs and one for the difference of the means.
2. The combined basis Q carries rounding of many updates, so it is refined:
   tasks sum Q^T (x - mean)(x - mean)^T Q, the sums meet in the same tree, and a
   Rayleigh-Ritz step on the (dimension x dimension) result gives the
   components to double precision.  Nothing is truncated, so the step loses no
   direction.
3. The covariance of the whitened fit list is summed, and its largest distance
   from the identity reported.

What meets in one task, in the driver or in a closure is a fixed number of
(dimension x dimension) arrays, whatever the number of rows or tasks.

Defined results: rows whose vector is null or holds a null or non-finite entry
are dropped; short vectors are filled up with zeros to the longest before
anything else; repeated rows and rows with a null id are returned each; entries
saturate at +-2^62; ``deviation`` is null where it would pass a long; a
component without variance (one distinct row, equal columns) has whitened and
explained 0 and stands outside ``identity_error``; an empty table, or one of
empty vectors, gives an empty result; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm.common import ship_code, slices, to_scratch

FAN_IN = 8
EPS = np.finfo(float).eps
LIMIT = 2.0**62
#: Components of less variance than this share of the whole count as without any.
NO_VARIANCE = 1e-13
PART = "slot long, payload binary"
PART_SCHEMA = pa.schema([("slot", pa.int64()), ("payload", pa.binary())])


# Rank-one updates of an eigensystem --------------------------------------------------

def secular_roots(d: np.ndarray, w: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho * sum_j w_j^2 / (d_j - t) = 0 for rising d, nonzero w and rho > 0.

    Returns the roots and the matrix of d_j - root_i (row i), which is accurate
    although the roots may lie close to the poles.
    """
    k = len(d)
    w2 = rho * w * w
    total = w2.sum()
    gaps = np.append(np.diff(d), total)
    rows = np.arange(k)
    middle = d + gaps / 2
    at_middle = 1 + (w2 / (d - middle[:, None])).sum(axis=1)
    right = (at_middle < 0) & (rows < k - 1)  # the root is nearer to the upper pole
    origin = np.where(right, np.append(d[1:], 0.0), d)
    delta = d - origin[:, None]
    lo = np.where(right, -gaps / 2, 0.0)
    hi = np.where(right, 0.0, np.where(rows < k - 1, gaps / 2, gaps))
    last_low = (rows == k - 1) & (at_middle < 0)
    lo = np.where(last_low, gaps / 2, lo)
    hi = np.where((rows == k - 1) & ~last_low, gaps / 2, hi)
    lower = np.tril(np.broadcast_to(w2, (k, k)))  # weights of the poles at or below each root
    pole_l = delta[rows, rows]
    pole_r = delta[rows, np.minimum(rows + 1, k - 1)]
    t = (lo + hi) / 2
    todo, places = rows, delta
    for _ in range(60):
        now = t[todo]
        inverse = 1 / (places - now[:, None])
        psi, both = np.einsum("ij,ij->i", inverse, lower), inverse @ w2
        f, size = 1 + both, 1 + both - 2 * psi  # terms of poles at or below a root are negative
        np.multiply(inverse, inverse, out=inverse)
        psi1 = np.einsum("ij,ij->i", inverse, lower)
        phi1 = inverse @ w2 - psi1
        under = f < 0
        lo[todo], hi[todo] = np.where(under, now, lo[todo]), np.where(under, hi[todo], now)
        low, high = lo[todo], hi[todo]
        open_ = (np.abs(f) > 4 * EPS * size) & (high - low > 2 * EPS * np.maximum(np.abs(low), np.abs(high)))
        if not open_.all():
            if not open_.any():
                break
            todo, f, psi1, phi1 = todo[open_], f[open_], psi1[open_], phi1[open_]
            places, lower = places[open_], lower[open_]
        x, y = pole_l[todo] - t[todo], pole_r[todo] - t[todo]
        # Each half is matched by one pole and a constant; the step solves the resulting quadratic.
        c = f - x * psi1 - y * phi1
        a = (x + y) * f - x * y * (psi1 + phi1)
        b = x * y * f
        root = np.sqrt(np.abs(a * a - 4 * b * c))
        with np.errstate(all="ignore"):
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            final = todo == k - 1
            one = f - x * psi1  # the last root has one pole only: constant + x^2 psi' / (x - step)
            step = np.where(final, x + x * x * psi1 / one, step)
        new = t[todo] + step
        lost = ~(np.isfinite(new) & (new > lo[todo]) & (new < hi[todo]))
        t[todo] = np.where(lost, (lo[todo] + hi[todo]) / 2, new)
    return origin + t, delta - t[:, None]


def rank_one(lam: np.ndarray, u: np.ndarray, rho: float, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigensystem (values rising, vectors in columns) of u diag(lam) u^T + rho z z^T, rho >= 0."""
    w = z @ u
    norm = float(np.sqrt(w @ w))
    if not rho * norm:
        return lam, u
    tol = 8 * EPS * max(float(np.abs(lam).max()), rho * norm * norm)
    live = np.flatnonzero(rho * np.abs(w) * norm > tol)
    fresh = False
    if len(live) > 1:
        gap, a, b = np.diff(lam[live]), w[live[:-1]], w[live[1:]]
        for at in np.flatnonzero((gap * np.abs(a * b) <= tol * (a * a + b * b)) | (gap <= tol)):
            i, j = live[at], live[at + 1]
            r = np.hypot(w[i], w[j])
            c, s = w[j] / r, w[i] / r
            if abs((lam[j] - lam[i]) * c * s) > tol:
                continue
            if not fresh:
                lam, u, w, fresh = lam.copy(), u.copy(), w.copy(), True
            u[:, i], u[:, j] = c * u[:, i] - s * u[:, j], s * u[:, i] + c * u[:, j]
            lam[i], lam[j] = c * c * lam[i] + s * s * lam[j], s * s * lam[i] + c * c * lam[j]
            w[i], w[j] = 0.0, r
        live = live[rho * np.abs(w[live]) * norm > tol]
    if not len(live):
        return lam, u
    live = live[np.argsort(lam[live], kind="stable")]
    d, v = lam[live], w[live]
    if len(live) == 1:
        roots, parts = d + rho * v * v, u[:, live]
    else:
        roots, diff = secular_roots(d, v, rho)
        own = -np.diagonal(diff)  # root_j - d_j
        apart = d[:, None] - d
        np.fill_diagonal(apart, 1.0)
        ratio = -diff / apart
        np.fill_diagonal(ratio, own)
        v = np.sqrt(np.abs(ratio.prod(axis=0)) / rho) * np.sign(v)
        vectors = (v / diff).T
        parts = u[:, live] @ (vectors / np.sqrt((vectors * vectors).sum(axis=0)))
    lam, u = lam.copy(), u.copy()
    lam[live], u[:, live] = roots, parts
    order = np.argsort(lam, kind="stable")
    return lam[order], np.ascontiguousarray(u[:, order])


@dataclass
class Spectrum:
    """Count, mean and eigensystem of the scatter of some rows."""

    count: int
    mean: np.ndarray
    lam: np.ndarray
    u: np.ndarray

    @classmethod
    def empty(cls, dims: int) -> Spectrum:
        return cls(0, np.zeros(dims), np.zeros(dims), np.eye(dims))

    def add(self, x: np.ndarray) -> None:
        gap = x - self.mean
        self.lam, self.u = rank_one(self.lam, self.u, self.count / (self.count + 1), gap)
        self.count += 1
        self.mean = self.mean + gap / self.count

    def take_in(self, other: Spectrum) -> None:
        if not self.count:
            self.count, self.mean, self.lam, self.u = other.count, other.mean, other.lam, other.u
            return
        for value, vector in zip(other.lam, other.u.T, strict=True):
            self.lam, self.u = rank_one(self.lam, self.u, max(float(value), 0.0), vector)
        both = self.count + other.count
        gap = other.mean - self.mean
        self.lam, self.u = rank_one(self.lam, self.u, self.count * other.count / both, gap)
        self.mean, self.count = self.mean + gap * (other.count / both), both

    def pack(self) -> bytes:
        return np.concatenate([[float(self.count)], self.mean, self.lam, self.u.ravel()]).tobytes()

    @classmethod
    def unpack(cls, payload: bytes, dims: int) -> Spectrum:
        x = np.frombuffer(payload)
        return cls(int(x[0]), x[1:dims + 1], x[dims + 1:2 * dims + 1], x[2 * dims + 1:].reshape(dims, dims))


def merge_spectra(payloads: list[bytes], dims: int) -> bytes:
    spectra = sorted((Spectrum.unpack(p, dims) for p in payloads), key=lambda s: -s.count)
    whole = spectra[0]
    for s in spectra[1:]:
        whole.take_in(s)
    return whole.pack()


def add_up(payloads: list[bytes]) -> bytes:
    return np.sum([np.frombuffer(p) for p in payloads], axis=0).tobytes()


# Passes over the fit list --------------------------------------------------------------

def _matrices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(batch, its column x as a long matrix of ``dims`` columns, short rows filled up with 0)."""
    for batch in slices(batches, 4096):
        x = batch.column(batch.schema.get_field_index("x"))
        lengths = np.diff(x.offsets.to_numpy())
        m = np.zeros((len(x), dims), np.int64)
        m[np.arange(dims) < lengths[:, None]] = x.flatten().to_numpy()
        yield batch, m


def _part(payload: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"slot": [TaskContext.get().partitionId()], "payload": [payload]}, PART_SCHEMA)


def _sums(dims: int):
    """Per task: rows of (dimension, exact sum as text), -1 for the count."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * dims, 0
        for _, m in _matrices(batches, dims):
            if np.abs(m).max(initial=0) < 2**50:
                sums = m.sum(axis=0).tolist()  # 4,096 entries under 2^50 stay under 2^62
            else:
                sums = [sum(c) for c in m.T.tolist()]
            total = [a + b for a, b in zip(total, sums, strict=True)]
            n += len(m)
        if n:
            yield pa.RecordBatch.from_pydict({"dim": [-1, *range(dims)], "amount": [str(n), *map(str, total)]},
                                             pa.schema([("dim", pa.int32()), ("amount", pa.string())]))
    return run


def _spectra(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Spectrum.empty(dims)
        for _, m in _matrices(batches, dims):
            for row in m.astype(np.float64):
                own.add(row)
        if own.count:
            yield _part(own.pack())
    return run


def _projected(mean: np.ndarray, basis: np.ndarray, with_sums: bool):
    """Per task: the sum of y y^T (and of y) of the rows y = (x - mean) projected on ``basis``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = basis.shape[1]
        square, sums, n = np.zeros((k, k)), np.zeros(k), 0
        for _, m in _matrices(batches, len(mean)):
            y = (m - mean) @ basis
            square += y.T @ y
            sums += y.sum(axis=0)
            n += len(m)
        if n:
            yield _part(np.concatenate([square.ravel(), sums if with_sums else []]).tobytes())
    return run


def tree(parts: DataFrame, merge: Callable[[list[bytes]], bytes], name: str) -> bytes | None:
    """The payloads of all slots merged FAN_IN at a time; each level is written to the shared folder."""
    def step(group: pa.Table) -> pa.Table:
        order = np.argsort(group["slot"].to_numpy(), kind="stable")
        payloads = group["payload"].take(pa.array(order)).to_pylist()
        return pa.table({"slot": [group["slot"][0].as_py() // FAN_IN], "payload": [merge(payloads)]}, schema=PART_SCHEMA)

    level = to_scratch(parts, name)
    top = level.agg(F.max("slot")).first()[0]
    while top:
        level = to_scratch(level.groupBy(F.floor(F.col("slot") / FAN_IN).alias("g")).applyInArrow(step, PART), name)
        top //= FAN_IN
    row = level.first()
    return None if row is None else bytes(row["payload"])


def _whole_numbers(vec_col: str, scale: float):
    """The vector as array<long> of floor(scale * x), saturated at +-2^62."""
    scaled = lambda c: F.greatest(F.least(c * scale, F.lit(LIMIT)), F.lit(-LIMIT))
    return F.transform(F.col(vec_col).cast("array<double>"), lambda c: F.floor(scaled(c)))


@dataclass
class Whitener:
    """What is fitted: count and exact sums of the fit list, components in columns, eigenvalues falling."""

    count: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.count for s in self.sums])

    @property
    def factors(self) -> np.ndarray:
        """(dimensions, components): x - mean times this is whitened; zero where there is no variance."""
        has = self.values > NO_VARIANCE * self.trace
        return self.components * np.where(has, 1 / np.sqrt(np.where(has, self.values, 1.0)), 0.0)


def fit(rows: DataFrame, components: int) -> Whitener | None:
    """Fit on the distinct vectors of ``rows`` (column x, array<long>); None if there is nothing to fit."""
    dims = rows.agg(F.max(F.size("x"))).first()[0]
    if not dims:
        return None
    padded = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("x")))
    spark = rows.sparkSession
    # distinct() combines inside the tasks, so a hot vector does not travel; the updates want more tasks than its bytes do.
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    fit_list = to_scratch(rows.select(padded.alias("x")).distinct().repartition(tasks), "whitening-fit")
    amounts = {r["dim"]: int(r["total"]) for r in
               fit_list.mapInArrow(_sums(dims), "dim int, amount string").groupBy("dim")
               .agg(F.sum(F.col("amount").cast("decimal(38,0)")).alias("total")).collect()}  # dims + 1 rows
    n, sums = amounts[-1], [amounts[i] for i in range(dims)]
    mean = np.array([s / n for s in sums])

    spectrum = Spectrum.unpack(tree(fit_list.mapInArrow(_spectra(dims), PART),
                                    lambda p: merge_spectra(p, dims), "whitening-spectra"), dims)
    basis, _ = np.linalg.qr(spectrum.u[:, ::-1])
    ritz = np.frombuffer(tree(fit_list.mapInArrow(_projected(mean, basis, False), PART),
                              add_up, "whitening-ritz")).reshape(dims, dims) / n
    values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    k = min(components, dims)
    top = np.argsort(-values, kind="stable")[:k]
    fitted = Whitener(n, sums, basis @ turn[:, top], np.maximum(values[top], 0.0), float(np.trace(ritz)), 0.0)

    sums2 = np.frombuffer(tree(fit_list.mapInArrow(_projected(mean, fitted.factors, True), PART),
                               add_up, "whitening-check"))
    square, first = sums2[:k * k].reshape(k, k), sums2[k * k:] / n
    has = fitted.values > NO_VARIANCE * fitted.trace
    apart = np.abs(square / n - np.outer(first, first) - np.eye(k))[np.ix_(has, has)]
    fitted.identity_error = float(apart.max(initial=0.0))
    return fitted


def deviations(m: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sum over dimensions of (n * x - sum)^2; None beyond a long."""
    worst = n * int(np.abs(m).max(initial=0)) + max(map(abs, sums), default=0)
    if worst * worst * max(len(sums), 1) < 2**63:
        gap = m * n - np.array(sums, np.int64)
        return (gap * gap).sum(axis=1).tolist()
    exact = (sum((n * x - s) ** 2 for x, s in zip(row, sums, strict=True)) for row in m.tolist())
    return [v if v < 2**63 else None for v in exact]


WHITENED = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
                      ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])


def _whiten(w: Whitener):
    mean, factors, k = w.mean, w.factors, len(w.values)
    shares = (w.values / w.trace if w.trace > 0 else np.zeros(k)).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, m in _matrices(batches, len(mean)):
            r = len(m)
            places = pa.array(np.repeat(np.arange(r), k))
            yield pa.RecordBatch.from_arrays([
                batch.column(batch.schema.get_field_index("vec_id")).take(places),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), r)),
                pa.array(np.full(r * k, w.count)),
                pa.array(deviations(m, w.count, w.sums), pa.int64()).take(places),
                pa.array(((m - mean) @ factors).ravel()),
                pa.array(np.tile(shares, r)),
                pa.array(np.full(r * k, w.identity_error))], schema=WHITENED)

    return run


def whiten(vectors: DataFrame, components: int = 4, id_col: str = "vec_id", vec_col: str = "embedding",
           scale: float = 256.0) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: each row on each component."""
    ship_code(vectors.sparkSession)
    x = F.col(vec_col).cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = (vectors.filter(F.col(vec_col).isNotNull() & fine)
            .select(F.col(id_col).cast("long").alias("vec_id"), _whole_numbers(vec_col, scale).alias("x")))
    fitted = fit(rows, components)
    schema = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    if fitted is None:
        return vectors.sparkSession.createDataFrame([], schema)
    return rows.mapInArrow(_whiten(fitted), schema)
