"""Whitening, hard negatives and secret scans against brute force."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from llm_cases import awkward_texts
from pyspark.sql import functions as F

from harrow.llm import hard_negatives as negatives
from harrow.llm import secret_scan as secrets
from harrow.llm import whitening
from harrow.llm.hard_negatives import hard_negatives
from harrow.llm.secret_scan import secret_scan
from harrow.llm.whitening import Spectrum, rank_one, whiten

VECTORS = "vec_id long, embedding array<double>, label int, n long, component int, x string, rank int, slot int, score double"


def vector_table(spark, rows):
    """(vec_id, embedding, label) rows with extra columns whose names clash."""
    return spark.createDataFrame([(i, v, y, 1, 2, "x", 3, 4, 0.5) for i, v, y in rows], VECTORS)


def vectors(seed, n, dims, spread=1.0, labels=3):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0.2, spread) for _ in range(dims)], rng.randrange(labels)) for i in range(n)]


ODD = [(900, None, 1), (901, [1.0, None, 2.0], 1), (902, [float("nan")] * 3, 0), (903, [float("inf"), 0.0, 0.0], 0),
       (904, [0.5], 1), (905, [], 1), (None, [0.1, 0.2, -0.3], 1)]


# Whitening ---------------------------------------------------------------------------

@pytest.mark.parametrize("dims", [1, 2, 7, 33])
def test_rank_one_updates_equal_eigh(dims):
    rng = np.random.default_rng(dims)
    lam, u = np.zeros(dims), np.eye(dims)
    whole = np.zeros((dims, dims))
    for step in range(3 * dims + 10):
        z = rng.normal(size=dims) * 10.0 ** rng.integers(-6, 4)
        if step % 4 == 0:
            z[rng.random(dims) < 0.6] = 0  # weights that deflate
        rho = float(rng.random()) if step % 5 else 0.0
        lam, u = rank_one(lam, u, rho, z)
        whole += rho * np.outer(z, z)
        scale = max(np.abs(whole).max(), 1e-300)
        assert (np.diff(lam) >= 0).all()
        assert np.abs(u.T @ u - np.eye(dims)).max() < 1e-12
        assert np.abs((u * lam) @ u.T - whole).max() < 1e-12 * scale * dims


def test_spectra_combine_in_any_order():
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(90, 6)) * 50)
    x[:, 5] = x[:, 4]  # a direction without variance
    parts = []
    for piece in (x[:1], x[1:40], x[40:41], x[41:]):
        s = Spectrum.empty(6)
        for row in piece:
            s.add(row)
        parts.append(s.pack())
    centred = x - x.mean(axis=0)
    want = centred.T @ centred
    for order in itertools.permutations(parts):
        got = Spectrum.unpack(whitening.merge_spectra(list(order), 6), 6)
        assert got.count == 90 and np.allclose(got.mean, x.mean(axis=0))
        assert np.abs((got.u * got.lam) @ got.u.T - want).max() < 1e-9 * want.max()


def brute_whitening(rows, components=4, scale=256.0):
    fine = [(i, v) for i, v, _ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dims = max((len(v) for _, v in fine), default=0)
    ints = [(i, tuple([math.floor(scale * c) for c in v] + [0] * (dims - len(v)))) for i, v in fine]
    fit = sorted(set(x for _, x in ints))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array(fit, float) - np.array([s / n for s in sums])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    return ints, n, sums, e, v, min(components, dims)


@pytest.mark.parametrize("fan_in", [2, 8])
def test_whitening_equals_brute_force(spark, monkeypatch, fan_in):
    monkeypatch.setattr(whitening, "FAN_IN", fan_in)
    hot = [(1000 + i, [0.25, -0.5, 0.75], 1) for i in range(60)]  # one vector holding a third of the rows
    rows = vectors(5, 120, 3) + hot + ODD + vectors(5, 120, 3)[:4]
    ints, n, sums, e, v, k = brute_whitening(rows)
    got = whiten(vector_table(spark, rows).repartition(7)).collect()
    assert len(got) == k * len(ints)
    mean = np.array([s / n for s in sums])
    want = {}
    for i, x in ints:
        want.setdefault(i, (sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)),
                            (np.array(x) - mean) @ v[:, :k] / np.sqrt(e[:k])))
    signs = {}
    for r in sorted(got, key=lambda r: -abs(r.whitened)):
        deviation, projected = want[r.vec_id]
        p = projected[r.component - 1]
        sign = signs.setdefault(r.component, 1 if p * r.whitened > 0 else -1)
        assert r.n == n and r.deviation == deviation
        assert abs(r.whitened - sign * p) < 1e-10
        assert abs(r.explained - e[r.component - 1] / e.sum()) < 1e-12
        assert r.identity_error < 1e-10


def test_whitening_of_degenerate_tables(spark):
    assert whiten(vector_table(spark, [])).collect() == []
    assert whiten(vector_table(spark, [(1, None, 0), (2, [], 0)])).collect() == []
    same = whiten(vector_table(spark, [(1, [0.5, 1.0], 0), (2, [0.5, 1.0], 1), (None, [0.5, 1.0], 1)])).collect()
    assert len(same) == 6
    assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same} == {(1, 0, 0.0, 0.0, 0.0)}
    line = whiten(vector_table(spark, [(i, [float(i), float(i)], 0) for i in range(5)])).collect()
    for r in line:  # all variance on one component
        assert r.identity_error < 1e-9
        assert (abs(r.explained - 1) < 1e-12) if r.component == 1 else (r.whitened == 0 and abs(r.explained) < 1e-12)
    far = whiten(vector_table(spark, [(1, [1e300, 0.0], 0), (2, [-1e300, 1.0], 0), (3, [0.0, 2.0], 0)])).collect()
    assert len(far) == 6 and all(r.deviation is None for r in far if r.vec_id < 3)


# Hard negatives ----------------------------------------------------------------------

def brute_negatives(rows, is_anchor, positives=5, k=3, low=50, high=95, scale=256):
    fine = {}
    for i, v, y in rows:
        if i is None or y is None or v is None or not all(c is not None and math.isfinite(c) for c in v):
            continue
        entry = (y, [math.floor(scale * c) for c in v])
        fine[i] = min(fine.get(i, entry), entry)
    out = []
    for a in filter(is_anchor, fine):
        y, v = fine[a]
        scored = sorted((-sum(p * q for p, q in zip(v, w, strict=False)), i, z == y)
                        for i, (z, w) in fine.items() if i != a)
        for s, p, _ in [x for x in scored if x[2]][:positives]:
            inside = [(n, i) for n, i, same in scored if not same and low * -s <= 100 * -n <= high * -s]
            out += [(a, p, r, i, -s, -n) for r, (n, i) in enumerate(inside[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("seed", "dims", "spread"), [(1, 3, 1.0), (2, 8, 0.3), (3, 1, 2.0)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, seed, dims, spread):
    monkeypatch.setattr(negatives, "CANDIDATES", 40)
    monkeypatch.setattr(negatives, "ANCHORS", 16)
    rows = vectors(seed, 150, dims, spread)
    rows += [(i + 2000, v, y) for i, v, y in rows[:40]]  # ties
    rows += [(3000 + i, [0.5] * dims, 0) for i in range(90)]  # a hot vector and a hot label
    rows += ODD + [(910, [0.1] * dims, None), rows[0], (1, [0.3] * dims, 2)]  # repeated rows, repeated ids
    got = hard_negatives(vector_table(spark, rows), F.col("vec_id") % 4 == 0)
    want = brute_negatives(rows, lambda i: i % 4 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == want and len(want) > 50


def test_hard_negatives_of_other_columns_limits_and_far_components(spark):
    rows = [(i, [1e17 * v[0], *v[1:]], y) for i, v, y in vectors(4, 40, 3)]
    table = vector_table(spark, rows).withColumnsRenamed({"vec_id": "id", "embedding": "v", "label": "kind"})
    got = hard_negatives(table, F.col("x") == "x", positives=3, k=7, low=10, high=100, id_col="id", vec_col="v",
                         label_col="kind", scale=1.0)
    top = negatives.TOP
    want = [(a, p, r, n, min(s, top), min(t, top)) for a, p, r, n, s, t in
            brute_negatives(rows, lambda i: True, 3, 7, 10, 100, 1)]
    if all(abs(x[4]) < top for x in want):
        assert sorted(map(tuple, got.collect())) == sorted(want)
    else:  # saturated scores tie, and ties go to the smaller id
        assert all(abs(r.positive_score) <= top for r in got.collect())


def test_hard_negatives_of_empty_tables(spark):
    assert hard_negatives(vector_table(spark, []), F.col("vec_id") % 2 == 0).collect() == []
    assert hard_negatives(vector_table(spark, [(1, [1.0], 0), (2, [1.0], 0)]), F.lit(True)).collect() == []
    assert hard_negatives(vector_table(spark, vectors(1, 9, 2)), F.lit(None).cast("boolean")).collect() == []


# Secret scans ------------------------------------------------------------------------

NAME = r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"


def plain_base(text):
    """The base rules word for word, without the short cuts."""
    kinds = ((NAME + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12), ("AKIA[A-Z0-9]+", 0, 18), ("[0-9a-f]+", 0, 16))
    return sorted((m.start(), k, m.end()) for k, (rule, group, least) in enumerate(kinds)
                  for m in re.finditer(rule, text) if len(m[group]) >= least)


def corpus(seed, n):
    rng = random.Random(seed)
    words = "the of and then onti rehe thst ndan token secret plan 2024 12.5 call well-known".split()
    out = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        text.insert(rng.randrange(len(text)), rng.choice(
            [f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}", f"user.{rng.randrange(99)}@mail{rng.randrange(9)}.example.com",
             f"{rng.randrange(255)}.{rng.randrange(255)}.12.7", f"v{rng.randrange(9)}.{rng.randrange(9)}.12-build", "https://h.example/a/1234567"]))
        if i % 3 == 0:
            text.insert(rng.randrange(len(text)), plant(rng, i // 3 % 3))
        out.append(" ".join(text))
    return out


def plant(rng, kind):
    value = "".join(rng.choice("0123456789abcdef") for _ in range(30))
    return (f"password={value}", f'token = "{value}"', "AKIA" + "".join(rng.choice("ABCDEFGHJKLMNPQ234567") for _ in range(16)))[kind]


def test_base_spans_equal_the_rules_word_for_word():
    rng = random.Random(5)
    pieces = ["token", "=", ": ", '"', "'", "Secret", "API_KEY", "apikey", "passwd", " ", "  ", "abcdef0123456789", "x" * 11, "Zz.-/+_=",
              "AKIA", "AKIAABCDEF234567QQ", "deadbeef", "\t", "ſecret=", "toKen=", "é", "0123456789abcdef0", "\n", "A"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14)))
        assert secrets.base_spans(text) == plain_base(text), text


def brute_paths(scores, moves):
    """(log partition, best path, marginals) of one run by listing all paths."""
    total, best, share = [], None, np.zeros_like(scores)
    for path in itertools.product(range(3), repeat=len(scores)):
        ends = (secrets.OUT, *path, secrets.OUT)
        value = sum(moves[a, b] for a, b in itertools.pairwise(ends)) + sum(scores[t, y] for t, y in enumerate(path))
        total.append(value)
        best = max(best or (value, path), (value, path))
        for t, y in enumerate(path):
            share[t, y] += math.exp(value)
    z = math.log(sum(map(math.exp, total)))
    return z, best[1], share / math.exp(z)


def test_field_equals_listing_all_paths():
    rng = np.random.default_rng(1)
    moves = secrets._clamped(rng.normal(size=(3, 3)))
    lengths = np.array([1, 4, 2, 5])
    scores = rng.normal(size=(4, 5, 3))
    z, tags, expected = secrets.marginals(scores, moves, lengths)
    for i, size in enumerate(lengths):
        want_z, _, want = brute_paths(scores[i, :size], moves)
        assert abs(z[i] - want_z) < 1e-9 and np.abs(tags[i, :size] - want).max() < 1e-9
    assert abs(expected.sum() - (lengths + 1).sum()) < 1e-6
    slots = [[list(rng.integers(0, secrets.SLOTS, secrets.FEATURES)) for _ in range(size)] for size in lengths]
    field = secrets.Field(rng.normal(size=(secrets.SLOTS, 3)).astype(np.float32), rng.normal(size=(3, 3)))
    for s, got in zip(slots, secrets.decode(field, slots), strict=True):
        _, path, _ = brute_paths(field.weights[np.array(s)].sum(axis=1).astype(float), secrets._clamped(field.moves))
        assert tuple(got) == path


def test_field_holds_on_other_texts_and_finds_unknown_shapes(spark):
    learn, held = corpus(1, 600), corpus(2, 300)
    texts = spark.createDataFrame([(t,) for t in learn], "text string").repartition(4)
    field = secrets.fit(texts)
    caught = wrong = hidden = clean = 0
    for i, text in enumerate(held):
        runs = secrets.runs_of(text)
        file = secrets.file_features(text, len(runs))
        tags = secrets.decode(field, [secrets.features(text, r, file) for r in runs])
        spans = [s for r, t in zip(runs, tags, strict=True) for s in secrets.tagged_spans(text, r, t)]
        values = [(a, b) for a, k, b in plain_base(text) if k]
        if i % 3 == 0:
            hidden += 1
            caught += any(a <= x and y <= b for a, b in spans for x, y in values)
        else:
            clean += 1
            wrong += bool(spans)
    assert caught >= 0.95 * hidden and wrong <= 0.02 * clean
    rng = random.Random(9)
    letters = "".join(chr(c) for c in (*range(48, 58), *range(65, 91), *range(97, 123)))
    found = 0
    for _ in range(60):  # shapes and names that no base rule knows
        value = "".join(rng.choice(letters) for _ in range(32))
        text = rng.choice([f"then onti credential = \"{value}\" of the", f"the of {value} and then", f"plan ghp_{value} then"])
        assert not any(k < 2 for _, k, _ in plain_base(text))
        (_, spans), = secrets.scan([text], field)
        found += any(k == 3 for _, k, _ in spans)
    assert found >= 40


def test_secret_scan_of_awkward_tables(spark, awkward, empty):
    got = secret_scan(awkward).collect()
    assert len(got) == len(awkward_texts())
    want = sorted(((i, secrets.joined(plain_base(t or ""))) for i, t in awkward_texts()), key=repr)
    assert sorted(((r.doc_id, r.spans) for r in got), key=repr) == want  # nothing to learn, nothing added
    assert secret_scan(empty).collect() == []
    planted = [(i, t) for i, t in enumerate(corpus(3, 90))] + [(None, None), (500, "é😀 token='abcdefABCDEF12' " * 3000)]
    table = spark.createDataFrame([(i, t, "s") for i, t in planted], "doc_id long, text string, secrets string")
    for r in secret_scan(table).collect():
        text = dict(planted)[r.doc_id] or ""
        base = plain_base(text)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, k, _ in base) for j in range(3))
        assert r.base_sha256 == hashlib.sha256(secrets.joined(base).encode()).hexdigest()
        assert set(filter(None, secrets.joined(base).split(","))) <= set(r.spans.split(","))
        assert [(s["kind"], s["start"], s["end"]) for s in r.secrets] == [
            (k, int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)]
        assert all(text[s["start"]:s["end"]] == s["value"] for s in r.secrets)
