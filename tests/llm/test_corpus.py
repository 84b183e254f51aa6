"""Operators that compare texts or vectors: copies, near copies, repeated spans, Katz, search; the pipeline."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from llm_cases import awkward_texts, invent
from pyspark.sql import functions as F

import corpus_pipeline
from harrow.llm import near_copies as near
from harrow.llm import repeated_spans as spans_module
from harrow.llm.exact_copies import drop_exact_copies, exact_copies
from harrow.llm.katz import GT, KatzModel, discounts, katz_scores
from harrow.llm.near_copies import drop_near_copies, likeliest, near_copies, registers
from harrow.llm.repeated_spans import front_code, merge, repeated_spans, span_digests
from harrow.llm.topk_search import topk_search

SF = "/root/testdata/sf0.001"


def bag(rows):
    return sorted(map(repr, rows))


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# Exact copies -----------------------------------------------------------------------

def test_exact_copies(spark, awkward, empty):
    norm = {n: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for n, (_, t) in enumerate(awkward_texts())}
    groups = defaultdict(list)
    for n, (i, _) in enumerate(awkward_texts()):
        groups[norm[n]].append(i)
    want = []
    for n, (i, _) in enumerate(awkward_texts()):
        g = groups[norm[n]]
        keep = min((x for x in g if x is not None), default=None)
        want.append((i, keep, len(g), i == keep, hashlib.sha256(norm[n].encode()).hexdigest()))
    for runs, fan_in in ((4096, 16), (7, 2), (1, 2)):
        assert bag(map(tuple, exact_copies(awkward, runs=runs, fan_in=fan_in).collect())) == bag(want)
    left = drop_exact_copies(awkward)
    assert left.columns == awkward.columns
    assert bag(r.doc_id for r in left.collect()) == bag(w[0] for w in want if w[3] or w[0] is None)
    assert exact_copies(empty).collect() == [] and drop_exact_copies(empty).collect() == []


def test_one_digest_holding_a_third_of_all_rows(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same text"))
                                    .otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    got = exact_copies(docs)
    assert got.filter("kept").count() == 2001 and got.filter("group_size = 1000 and keep_id = 0").count() == 1000


# Near copies ------------------------------------------------------------------------

def brute_components(rows, width=4, percent=80):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


@pytest.mark.parametrize("sizes", [(256, 192, 128), (3, 2, 1)])
def test_near_copies_equal_brute_force(spark, monkeypatch, sizes):
    for name, value in zip(("CELL", "BLOCK", "REST"), sizes, strict=True):
        monkeypatch.setattr(near, name, value)
    rng = random.Random(3)
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()]
    for c in range(3):  # chains of near copies with a few edits each
        words = invent(50 + c, 70).split()
        for k in range(25):
            edited = list(words)
            for _ in range(rng.randrange(4)):
                edited[rng.randrange(len(edited))] = f"edit{rng.randrange(99)}"
            rows.append((10_000 + 100 * c + k, " ".join(edited)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in near_copies(docs).collect()}
    assert got == brute_components(rows)


def test_near_copies_with_a_large_remainder(spark, monkeypatch):
    """One bucket of all documents, of which thousands are outside its main component."""
    monkeypatch.setattr(near, "REST", 1)
    monkeypatch.setattr(near, "band_keys", lambda sketches: np.full((len(sketches), 1), 7))
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(25 + 4 * (i % 5)))) for i in range(2400)]
    rows += [(10_000 + i, f"{rows[i][1]} more") for i in range(0, 2400, 100)]
    got = {r.doc_id: r.component_id for r in near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i % 10_000 for i, _ in rows}


@pytest.mark.parametrize("percent", [80, 100])
def test_near_copies_over_places_of_set_sizes(spark, monkeypatch, percent):
    for name, value in dict(CELL=3, BLOCK=2, REST=1, SIDE=3).items():
        monkeypatch.setattr(near, name, value)
    monkeypatch.setattr(near, "band_keys", lambda sketches: np.full((len(sketches), 1), 7))
    words = invent(9, 90).split()
    rows = [(i, " ".join(words[i % 3 * 5:25 + i])) for i in range(50)]
    got = near_copies(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == brute_components(rows, percent=percent)


def test_near_copies_of_pairs_whose_hash_sums_are_equal(spark):
    """The xxhash64 of these ids, modulo 2^40, have the same sum in both pairs of a line."""
    pairs = [((359, 2724), (2641, 3206)), ((857, 2163), (2876, 3146)), ((82, 837), (1942, 2444))]
    rows = []
    for pair in (p for line in pairs for p in line):
        text = invent(pair[0], 60)
        rows += [(pair[0], text), (pair[1], f"{text} more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    h = F.xxhash64("doc_id") % 2**40
    sums = {r[0]: r[1] for r in docs.select("doc_id", h).collect()}
    assert all(sums[a] + sums[b] == sums[c] + sums[d] for (a, b), (c, d) in pairs)
    got = {r.doc_id: r.component_id for r in near_copies(docs).collect()}
    assert got == {i: p[0] for line in pairs for p in line for i in p}


def test_near_copies_of_awkward_tables(spark, awkward, empty):
    got = near_copies(awkward).collect()
    want = brute_components([(i, t) for i, t in awkward_texts() if i is not None])
    assert {r[0]: tuple(r)[1:] for r in got if r[0] is not None} == want
    assert [tuple(r)[2:] for r in got if r[0] is None] == [(None, True)] * 2 and len(got) == awkward.count()
    left = drop_near_copies(awkward)
    five = brute_components([(i, t) for i, t in awkward_texts() if i is not None], 5)
    assert left.columns == awkward.columns
    assert {r.doc_id for r in left.collect()} == {i for i, w in five.items() if w[2]} | {None}
    assert near_copies(empty).collect() == []


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 900).astype(np.uint64)
    a, b = x[:600], x[150:750]  # Jaccard 450 / 750
    ra, rb, both = registers([a, b, np.union1d(a, b)])
    assert (np.maximum(ra, rb) == both).all()  # mergeable
    got = likeliest(np.array([(ra > rb).sum()]), np.array([(ra < rb).sum()]), np.array([600.0]), np.array([600.0]))
    assert got[0] == pytest.approx(0.6, abs=0.12)


# Repeated spans -----------------------------------------------------------------------

def brute_spans(rows, length=200):
    seen = Counter(t[k:k + length] for _, t in rows for k in range(len(t) - length + 1))
    out = []
    for i, t in rows:
        mask = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k:k + length]] > 1:
                mask[k:k + length] = b"\1" * length
        kept = bytes(c for c, m in zip(t, mask, strict=True) if not m)
        out.append((i, len(t), sum(mask), len([x for x in bytes(mask).split(b"\0") if x]),
                    hashlib.sha256(kept).hexdigest()))
    return out


def test_repeated_spans_equal_brute_force(spark, monkeypatch):
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()][:120]
    passage = invent(77, 60)
    rows += [(7000 + k, invent(800 + k, 3) + "is onhe. " * (20 + k) + invent(900 + k, 3)) for k in range(20)]
    rows += [(5000 + k, invent(600 + k, 5 + k) + passage[k:] + invent(700 + k, k)) for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = bag(brute_spans([(i, t.encode()) for i, t in rows]))
    for block, entries, hot in ((2_000_000, 100_000, 5000), (20_000, 50, 5000), (20_000, 50, 3)):
        got = span_digests(repeated_spans(docs, block_bytes=block, bucket_entries=entries, hot=hot))
        assert bag(map(tuple, got.collect())) == want


def test_repeated_spans_of_awkward_tables(spark, awkward, empty):
    got = span_digests(repeated_spans(awkward, block_bytes=9_000)).collect()
    assert bag(map(tuple, got)) == bag(brute_spans([(i, (t or "").encode()) for i, t in awkward_texts()]))
    assert repeated_spans(empty).collect() == []


def test_anchors_do_not_depend_on_chunks(monkeypatch):
    rng = np.random.default_rng(4)
    data = rng.integers(97, 101, 9000).astype(np.uint8)
    starts, ends = np.array([0, 5000, 5100]), np.array([5000, 5100, 9000])
    whole = spans_module.anchors(data, starts, ends)[0].tolist()
    monkeypatch.setattr(spans_module, "_CHUNK", 700)
    spans_module.worker_value("spans.powers", "small", lambda: spans_module.Powers(4000))
    assert spans_module.anchors(data, starts, ends)[0].tolist() == whole


def test_loser_tree_merges_front_coded_runs():
    import zstandard

    rng = random.Random(8)
    runs, everything = [], []
    for r in range(5):
        suffixes = sorted({bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 40))) for _ in range(60)})
        everything += [(s, r) for s in suffixes]
        shared, rest = front_code(suffixes)
        press = zstandard.ZstdCompressor().compress
        runs.append(spans_module.Run(dict(
            shared=spans_module.pack(shared), rest=press(rest), before=press(b""), counts=spans_module.pack(shared),
            lengths=spans_module.pack(np.array([[len(s), 0] for s in suffixes]).ravel()))))
    order, shared, lengths = merge(runs)
    everything.sort()
    assert [r for r, _ in order] == [r for _, r in everything] and lengths == [len(s) for s, _ in everything]
    for k in range(1, len(everything)):
        a, b = everything[k - 1][0], everything[k][0]
        assert shared[k] == next((j for j in range(min(len(a), len(b))) if a[j] != b[j]), min(len(a), len(b)))


# Katz ---------------------------------------------------------------------------------

def brute_katz(rows, order, fold=1):
    """Scores straight from the definition; also checks that distributions sum to one."""
    tokens = [(i, [*(t or "").encode().lower().split(), None]) for i, t in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == fold
    counts = [None, *[defaultdict(Counter) for _ in range(order)]]
    gram = lambda s, k, n: tuple(s[j] if j >= 0 else "start" for j in range(k - n + 1, k))
    for i, s in tokens:
        if not held(i):
            for n in range(1, order + 1):
                for k, w in enumerate(s):
                    counts[n][gram(s, k, n)][w] += 1
    d = [None, *[discounts([sum(c == r for x in counts[n].values() for c in x.values()) for r in range(1, GT + 2)])
                 for n in range(1, order + 1)]]
    cut = lambda n, c: c * d[n][min(c, GT + 1)]
    words = counts[1][()]
    total = sum(words.values())
    taken = sum(c - cut(1, c) for c in words.values())
    size = total if taken > 0 else total + 0.5

    @lru_cache(None)
    def context(n, h):
        x = counts[n][h]
        t = sum(c - cut(n, c) for c in x.values())
        all_ = sum(x.values()) + (0 if t > 1e-9 else 0.5)
        return all_, (t if t > 1e-9 else 0.5) / all_ / (1 - sum(p(n - 1, h[1:], w) for w in x))

    def p(n, h, w):
        if n == 1:
            return cut(1, words[w]) / size if w in words else (taken if taken > 0 else 0.5) / size
        if h not in counts[n]:
            return p(n - 1, h[1:], w)
        all_, alpha = context(n, h)
        c = counts[n][h].get(w, 0)
        return cut(n, c) / all_ if c else alpha * p(n - 1, h[1:], w)

    for n in range(1, order + 1):
        for h in list(counts[n])[:5]:
            assert sum(p(n, h, w) for w in words) + p(n, h, b"never seen") == pytest.approx(1)
    out = []
    for i, s in tokens:
        base = sum(math.log10((words.get(w, 0) + 0.5) / (total + 0.5 * (len(words) + 1))) for w in s)
        score = sum(math.log10(p(order, gram(s, k, order), w)) for k, w in enumerate(s))
        out.append((i, held(i), len(s), sum(w in words for w in s), total, base, score))
    return out


def same_scores(got, want):
    key = lambda r: (repr(r[0]), r[2], r[6])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)


@pytest.mark.parametrize(("order", "options"), [(2, dict(block_words=3000, bucket_entries=300)),
                                                (3, dict(block_words=9000, bucket_entries=5000)), (1, {})])
def test_katz_equals_the_definition(spark, order, options):
    docs = documents(spark)
    same_scores(katz_scores(docs, order=order, **options).collect(),
                brute_katz([(r.doc_id, r.text) for r in docs.collect()], order))


def test_katz_with_contexts_dealt_to_several_buckets(spark):
    """One word is over half of all tokens, so that its successors are split."""
    rng = random.Random(6)
    rows = [(i, " ".join(x for _ in range(60) for x in ("the", f"w{rng.randrange(400)}"))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = KatzModel(docs, order=2, block_words=2000, bucket_entries=200)
    assert model.hot[2]
    same_scores(model.scores().collect(), brute_katz(rows, 2))
    pairs = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            s = [*t.split(), None]
            pairs.update(zip(["start", *s], s, strict=False))
    stored = model.counts().filter("level = 2").agg(F.count("count"), F.sum("count")).first()
    assert tuple(stored) == (len(pairs), sum(pairs.values()))


def test_katz_of_awkward_tables(spark, awkward, empty):
    same_scores(katz_scores(awkward).collect(), brute_katz(awkward_texts(), 2))
    assert katz_scores(empty).collect() == []
    held = spark.createDataFrame([(i, "a b") for i in range(60)], "doc_id long, text string").filter(
        F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1)
    assert {(r.train_tokens, r.n_known, r.base_score, r.score) for r in katz_scores(held).collect()} == {(0, 0, 0.0, 0.0)}


# Search -------------------------------------------------------------------------------

def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 0.05, 8).round(2).tolist()) for i in range(700)]
    rows += [(700, None), (720, [float("nan")] * 8), (740, [None] * 8), (760, [float("inf")] * 8), (780, []),
             (800, [0.5, 0.25]), (820, rows[0][1]), (840, rows[0][1]), (840, rows[0][1]), (None, [0.1] * 8)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    live = {i: [math.floor(64 * float(np.float32(x))) for x in v] for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q, v in live.items():
        if q % 20 == 0:
            ranked = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in live.items() if i != q)
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(ranked[:20])]
    assert bag(map(tuple, topk_search(vectors, F.col("vec_id") % 20 == 0).collect())) == bag(want)


def test_search_of_large_components(spark):
    rows = [(0, [1.0, 1.0]), (1, [4e7, 0.0]), (2, [5e7, 1.0]), (3, [6e7, -3.0]), (4, [-7e8, 2.0]),
            (20, [1e9, -1e9]), (21, [1e9, 0.9999e9]), (22, [2.0**40, 2.0**40]), (23, [1e300, -1e300])]
    top = 2**63 - 1
    live = {i: [max(min(math.floor(64 * int(x)), top), -top) for x in v] for i, v in rows}
    want = []
    for q in (0, 20):
        ranked = sorted((-max(min(sum(a * b for a, b in zip(live[q], w, strict=True)), top), -top), i)
                        for i, w in live.items() if i != q)
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(ranked)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert bag(map(tuple, topk_search(vectors, F.col("vec_id") % 20 == 0).collect())) == bag(want)


def test_search_with_few_rows(spark):
    few = spark.createDataFrame([(0, [0.5]), (1, [1.0]), (2, [1e30])], "vec_id long, embedding array<double>")
    got = topk_search(few, F.col("vec_id") == 0).collect()
    assert [(r["rank"], r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 2), (2, 1)]
    assert topk_search(few.limit(0), F.col("vec_id") == 0).collect() == []


# Pipeline -----------------------------------------------------------------------------

def test_stages_follow_each_other(spark, tmp_path):
    from harrow.llm.common import read_table

    docs = documents(spark)
    base = invent(900, 60)
    extra = [(9000, base), (9001, base + " "), (9002, base.replace(" ", "\n")),
             (9003, " ".join(["edited", *base.split()[1:]])), (9004, invent(901, 40)), (9005, None), (9006, "")]
    planted = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in extra], docs.schema)
    docs.unionByName(planted).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    whole = read_table(spark, str(tmp_path), "documents")
    ids = {"start": [r.doc_id for r in whole.select("doc_id").collect()]}
    now = whole
    texts = {r.doc_id: r.text for r in whole.collect()}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path)).cache()
        ids[name] = [r.doc_id for r in now.select("doc_id").collect()]
        assert now.columns == whole.columns + (["piece_ids", "n_pieces"] if name == "pieces" else [])
    norm = lambda i: re.sub(r"[\x20\x09-\x0D]+", " ", texts[i] or "")
    least = {}
    for i in sorted(ids["toxicity"]):
        least.setdefault(norm(i), i)
    assert sorted(ids["exact_dedup"]) == sorted(least.values())
    near_kept = brute_components([(i, texts[i]) for i in ids["exact_dedup"]], 5)
    assert sorted(ids["near_dedup"]) == sorted(i for i, w in near_kept.items() if w[2])
    assert set(ids["mixing"]) == set(ids["near_dedup"]) and ids["pieces"] and set(ids["pieces"]) == set(ids["mixing"])
    assert {9000, 9004} <= set(ids["pieces"]) and not {9001, 9002, 9003} & set(ids["pieces"])


def test_pipeline_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 100 and corpus_pipeline.ORACLE_SQL is None
    assert got.filter("n_pieces <> size(piece_ids)").count() == 0


def test_queries_may_be_marked_by_any_column(spark):
    rows = [(i, [float(i % 5), 1.0], "q" if i in (3, 7) else None) for i in range(20)] + [(7, [2.0, 1.0], "x"), (9, [4.0, 1.0], "q")]
    table = spark.createDataFrame(rows, "id long, v array<double>, is_query string")
    got = topk_search(table, F.col("is_query") == "q", k=3, id_col="id", vec_col="v", scale=1.0).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by[r.query_id].append(r.vec_id)
    want = {q: [i for _, i in sorted((-(a * (i % 5) + 1), i) for i in range(20) if i != q)][:3] for q, a in ((3, 3), (7, 2), (9, 4))}
    assert dict(by) == want
