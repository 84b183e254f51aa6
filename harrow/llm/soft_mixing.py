"""Mixing to target weights with soft membership, in DataFrame operations only.

A naive Bayes classifier is counted from the labelled table: a document is
described by a few binned properties of its whole text (``FEATURES``), and the
class counts of each bin, with one added, give the posterior of every domain.
Documents with equal bins have equal posteriors, so they share a *signature*,
and a document belongs to each domain by its posterior.

Rates r >= ``floor`` are then fitted by projected gradient least squares, so that the expected token total of each domain,
sum(rate * tokens * posterior), comes to target weight * budget.  Tokens are
first summed by signature: at most the product of the bin counts rows, whatever
the corpus, and no key that follows a source.  Each iteration is one
distributed sum that returns a number for each domain.  Steps start from rate
1, so rates stay as near to 1 as the targets allow.

``mix`` turns rates into whole copies: the integer part, and one more when a
hash of the id falls under the fraction.

Defined results: null and empty texts have 0 tokens; a null id has copies by
the hash of null; of several labels of one id the largest counts, null labels
do not; without labels each target domain has the same posterior; labelled
domains without a target have target 0; an empty table gives an empty result;
repeated rows are mixed row by row; input columns with the names of new ones
are not returned by ``mixing_rates`` and come through ``mix`` as they were.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.llm.common import to_scratch

SPLIT = r"[\x20\x09-\x0D]+"
ITERATIONS, TOLERANCE = 30, 1e-7


def _bin(ratio: Column, cuts: list[float]) -> Column:
    """How many of the cuts a number exceeds."""
    out = F.lit(0)
    for c in cuts:
        out = out + (ratio > c).cast("int")
    return out


def _per_word(x: Column) -> Column:
    return x / F.greatest(F.col("n_tokens"), F.lit(1))


def _count(what: str) -> Column:
    return F.length("text") - F.length(F.replace(F.col("text"), F.lit(what), F.lit("")))


def _repeated_lines() -> Column:
    lines = F.split("text", "\n")
    return 1 - F.size(F.array_distinct(lines)) / F.size(lines)


#: name -> (number of bins, bin of a row that has text, words and n_tokens)
FEATURES: dict[str, tuple[int, Callable[[], Column]]] = {
    "length": (5, lambda: _bin(F.col("n_tokens"), [20, 80, 300, 1500])),
    "word": (6, lambda: _bin(_per_word(F.length("text")), [5.0, 5.6, 6.5, 7.5, 8.5])),
    "bars": (3, lambda: _bin(_per_word(_count("|")), [0.02, 0.2])),
    "symbols": (4, lambda: _bin(_per_word(F.length("text") - F.length(F.translate("text", "!%$&*#", ""))),
                                [0.02, 0.2, 1.0])),
    "variety": (6, lambda: _bin(_per_word(F.size(F.array_distinct("words"))), [0.2, 0.5, 0.65, 0.75, 0.9])),
    "lines": (3, lambda: _bin(_repeated_lines(), [0.05, 0.4])),
}


def describe(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_tokens and the signature (all bins in one number) of every whole text."""
    words = F.filter(F.split("text", SPLIT), lambda w: w != "")
    rows = (docs.select(F.col(id_col).cast("long").alias("doc_id"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
            .withColumn("words", words).withColumn("n_tokens", F.size("words").cast("long")))
    signature = F.lit(0)
    for bins, feature in FEATURES.values():
        signature = signature * bins + feature()
    return rows.select("doc_id", "n_tokens", signature.cast("int").alias("signature"))


def _bins() -> list[tuple[str, int, Column]]:
    """(feature, bins, bin of a signature), undoing ``describe``."""
    out, below = [], 1
    for name, (bins, _) in reversed(FEATURES.items()):
        out.append((name, bins, F.pmod(F.floor(F.col("signature") / below), F.lit(bins)).cast("int")))
        below *= bins
    return out


def posteriors(signatures: DataFrame, labels: DataFrame, label_col: str, id_col: str,
               domains: list[str]) -> tuple[list[str], Column]:
    """All domains and the posterior array of a signature, counted from all labelled rows."""
    known = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("string").alias("domain"))
             .filter(F.col("doc_id").isNotNull() & F.col("domain").isNotNull())
             .groupBy("doc_id").agg(F.max("domain").alias("domain"))
             .join(signatures.select("doc_id", "signature").distinct(), "doc_id")
             .groupBy("domain", "signature").agg(F.count(F.lit(1)).alias("n")))
    known = to_scratch(known, "classes")
    totals = {r.domain: r.n for r in known.groupBy("domain").agg(F.sum("n").alias("n")).collect()}
    domains = sorted({*domains, *totals})
    counts: dict[tuple[str, str, int], int] = {}
    bins = _bins()
    table = known.select("domain", "n", F.explode(F.array(*[
        F.struct(F.lit(name).alias("feature"), b.alias("bin")) for name, _, b in bins])).alias("f"))
    for r in table.groupBy("domain", "f.feature", "f.bin").agg(F.sum("n").alias("n")).collect():
        counts[r.domain, r.feature, r.bin] = r.n  # domains * features * bins numbers
    everything = sum(totals.values())
    logs = []
    for d in domains:
        n = totals.get(d, 0)
        log = F.lit(math.log((n + 1) / (everything + len(domains))))
        for name, size, b in bins:
            row = F.array(*[F.lit(math.log((counts.get((d, name, i), 0) + 1) / (n + size))) for i in range(size)])
            log = log + F.element_at(row, b + 1)
        logs.append(log)
    most = F.greatest(*logs) if len(logs) > 1 else logs[0]
    weights = F.array(*[F.exp(x - most) for x in logs])
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return domains, F.transform(weights, lambda x: x / total)


def _inner(p: str | Column, g: Column, n: int) -> Column:
    p = F.col(p) if isinstance(p, str) else p
    return sum((F.element_at(p, i + 1) * F.element_at(g, i + 1) for i in range(n)), F.lit(0.0))


def _rates(history: list[list[float]], n: int, floor: float) -> Column:
    """Rate of a row after the steps so far, from its posterior alone: r <- max(floor, r - p.h)."""
    start = F.lit(max(1.0, floor))
    if not history:
        return start
    steps = F.array(*[F.array(*[F.lit(x) for x in h]) for h in history])
    return F.aggregate(steps, start, lambda r, h: F.greatest(F.lit(floor), r - _inner("p", h, n)))


def _solve(m: list[list[float]], g: list[float]) -> list[float]:
    """h with (m + a small ridge) h = g, by elimination; as many equations as domains."""
    n = len(g)
    ridge = 1e-9 * (max((m[i][i] for i in range(n)), default=0.0) or 1.0)
    a = [[*m[i][:i], m[i][i] + ridge, *m[i][i + 1:], g[i]] for i in range(n)]
    for i in range(n):
        top = max(range(i, n), key=lambda k: abs(a[k][i]))
        a[i], a[top] = a[top], a[i]
        for k in range(n):
            if k != i:
                factor = a[k][i] / a[i][i]
                a[k] = [x - factor * y for x, y in zip(a[k], a[i], strict=True)]
    return [a[i][n] / a[i][i] for i in range(n)]


def fit_rates(mass: DataFrame, domains: list[str], targets: dict[str, float], floor: float,
              budget: float | None, iterations: int, tolerance: float) -> Column:
    """The rate of a row with posterior array ``p``; ``mass`` has (p, share of all tokens).

    Projected gradient on the squared distance of the domain totals from their
    targets.  The gradient is taken in the metric of the rows that are above
    the floor (moments of their posteriors, a domains x domains matrix that the
    same sum returns), so few steps are needed; a step that does not bring the
    totals nearer is halved.
    """
    n = len(domains)
    weights = [max(targets.get(d, 0.0), 0.0) for d in domains]
    weights = [w / (sum(weights) or 1.0) for w in weights]

    def measure(rate: Column) -> tuple[list[float], list[list[float]]]:
        p = [F.element_at("p", i + 1) for i in range(n)]
        free = F.when(F.col("r") > floor, F.col("share")).otherwise(0.0)
        row = mass.withColumn("r", rate).agg(
            *[F.sum(F.col("share") * F.col("r") * p[i]) for i in range(n)],
            *[F.sum((free if floor < 1 or history else F.col("share")) * p[i] * p[j])
              for i in range(n) for j in range(n)]).first()
        numbers = [x or 0.0 for x in row]
        return numbers[:n], [numbers[n + i * n:n + (i + 1) * n] for i in range(n)]

    history: list[list[float]] = []
    have, moments = measure(_rates(history, n, floor))
    if budget is None:  # the smallest total that gives each wanted domain what it has at the floor
        budget = max([s / w for s, w in zip(have, weights, strict=True) if w > 0], default=1.0)
    goal = [w * budget for w in weights]
    distance = lambda got: math.sqrt(sum((s - t) ** 2 for s, t in zip(got, goal, strict=True)))
    size = 1.0
    for _ in range(iterations):
        if distance(have) < tolerance or size < 1e-3:
            break
        h = _solve(moments, [s - t for s, t in zip(have, goal, strict=True)])
        trial = [*history, [size * x for x in h]]
        got, new_moments = measure(_rates(trial, n, floor))
        if distance(got) < distance(have) - 1e-12:
            history, have, moments, size = trial, got, new_moments, min(1.0, 2 * size)
        else:
            size /= 2
    return _rates(history, n, floor)


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float], label_col: str = "quality",
                 id_col: str = "doc_id", text_col: str = "text", floor: float = 0.0,
                 budget: float | None = 1.0, iterations: int = ITERATIONS,
                 tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, n_tokens, posteriors (map by domain), rate and copies of every document.

    ``targets`` gives the wanted share of tokens by domain; ``budget`` is the
    wanted total as a multiple of the input's (None: the smallest total that
    lets every domain keep ``floor`` times what it has).
    """
    rows = to_scratch(describe(docs, id_col, text_col), "signatures")
    domains, posterior = posteriors(rows, labels, label_col, id_col, sorted(targets))
    mass = rows.groupBy("signature").agg(F.sum("n_tokens").alias("n"))
    total = mass.agg(F.sum("n")).first()[0] or 1
    mass = to_scratch(mass.select(posterior.alias("p"), (F.col("n") / total).alias("share")), "mass")
    rate = fit_rates(mass, domains, targets, floor, budget, iterations, tolerance)
    # One row for each signature: at most the product of the bin counts.
    rated = to_scratch(rows.select("signature").distinct().select("signature", posterior.alias("p"))
                       .withColumn("rate", rate), "rates")
    draw = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1))), F.lit(1_000_003)) / 1_000_003
    return (rows.join(F.broadcast(rated), "signature")
            .select("doc_id", "n_tokens",
                    F.map_from_arrays(F.array(*[F.lit(d) for d in domains]), "p").alias("posteriors"), "rate",
                    (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")).alias("copies")))


def _unused(name: str, columns: list[str]) -> str:
    """``name``, lengthened until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], **options: object) -> DataFrame:
    """``docs`` with each row repeated as often as its rate says; columns as they were, whatever their names."""
    id_col = str(options.get("id_col", "doc_id"))
    key, copies, copy = (_unused(n, docs.columns) for n in ("_mix_id", "_mix_copies", "_mix_copy"))
    drawn = (mixing_rates(docs, labels, targets, **options).groupBy(F.col("doc_id").alias(key))
             .agg(F.max("copies").cast("int").alias(copies)))
    return (docs.join(drawn, docs[id_col].cast("long").eqNullSafe(drawn[key]))
            .withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(copies))))
            .filter(F.col(copy) < F.col(copies)).select(*docs.columns))
