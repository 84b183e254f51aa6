"""Operators that look at each text by itself: token counts, pieces, toxicity, personal data, mixing."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from harrow.llm import toxicity as toxicity_module
from harrow.llm.personal_data import KINDS, personal_data, span_report
from harrow.llm.piece_codec import PieceCodec, decode_documents, encode_documents, round_trips
from harrow.llm.soft_mixing import mix, mixing_rates
from harrow.llm.token_counts import DEFAULT_MODEL, model_path, token_counts
from harrow.llm.toxicity import drop_toxic, fit, toxicity
from llm_cases import awkward_texts, invent

SF = "/root/testdata/sf0.001"


def bag(rows):
    return sorted(map(repr, rows))


# Token counts ---------------------------------------------------------------------

def test_token_counts_equal_the_library(spark, awkward):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path(DEFAULT_MODEL))
    for limit, table in ((4096, 32_768), (3, 4)):  # a tiny table sends everything to the cache
        got = token_counts(awkward, limit=limit, table_size=table, cache_size=8).collect()
        want = [(i, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > limit)
                for i, t in awkward_texts()]
        assert bag(map(tuple, got)) == bag(want)


def test_token_counts_of_no_rows(empty):
    assert token_counts(empty).collect() == []


# Pieces ---------------------------------------------------------------------------

def brute_viterbi(codec: PieceCodec, text: str) -> float:
    """Best total score by trying every piece at every place."""
    scores = {p: s for p, (_, s, _) in codec.automaton.items()}
    best = [0.0] + [float("-inf")] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - 16), end):
            s = scores.get(text[start:end])
            if s is None and end - start == 1 and text[start] not in codec.single:
                s = codec.unknown_score
            if s is not None:
                best[end] = max(best[end], best[start] + s)
    return best[-1]


@pytest.fixture(scope="module")
def codec():
    return PieceCodec(model_path(DEFAULT_MODEL))


def path_score(codec: PieceCodec, ids) -> float:
    """Score of ids; a run of byte pieces is as many unknown characters as it decodes to."""
    scores = {i: s for _, s, i in codec.automaton.values()}
    run = bytes(codec.bytes_of[i] for i in ids if i in codec.bytes_of)
    return sum(scores[i] for i in ids if i not in codec.bytes_of) + len(run.decode()) * codec.unknown_score


def test_viterbi_is_the_best_path(codec):
    rng = random.Random(5)
    texts = ["".join(rng.choice("the ofand aéÄ日本😀xq.12") for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    for t in texts:
        marked = ("▁" + t).replace(" ", "▁")
        ids = codec.encode(t)
        assert path_score(codec, ids) == pytest.approx(brute_viterbi(codec, marked))
        assert codec.decode(ids) == t


def test_no_path_of_the_library_scores_higher(codec):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(model_path(DEFAULT_MODEL), "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1  # the same pieces and scores, read as a unigram model
    lib = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    for t in {w for n in range(20) for w in invent(n, 40).split()}:
        assert path_score(codec, codec.encode(t)) >= path_score(codec, lib.encode(t)) - 1e-3
        assert lib.decode(codec.encode(t)) == t


def test_pieces_round_trip(spark, awkward, empty):
    rows = round_trips(awkward).collect()
    assert all(r.round_trip and r.n_pieces == len(r.piece_ids) for r in rows) and len(rows) == awkward.count()
    want = [(i, hashlib.sha256((t or "").replace("▁", " ").encode()).hexdigest()) for i, t in awkward_texts()]
    assert bag((r.doc_id, r.decoded_sha256) for r in rows) == bag(want)
    clash = awkward.withColumn("n_pieces", F.lit("old"))
    encoded = encode_documents(clash)
    assert encoded.columns == [*awkward.columns, "piece_ids", "n_pieces"]
    back = decode_documents(encoded).collect()
    assert bag(map(tuple, back)) == bag((i, (t or "").replace("▁", " ")) for i, t in awkward_texts())
    assert round_trips(empty).collect() == [] and encode_documents(empty).collect() == []


# Toxicity -------------------------------------------------------------------------

def toxic_corpus(spark, n=400):
    rng = random.Random(9)
    rows, marks = [], []
    for i in range(n):
        words = invent(i, 40).split()
        bad = rng.random() < 0.3
        if bad:
            words.insert(rng.randrange(len(words)), rng.choice(["nasty", "vile", "rotten"]))
        rows.append((i, " ".join(words), "en" if i % 2 else "de"))
        marks.append((i, 1, int(bad)))
    return (spark.createDataFrame(rows, "doc_id long, text string, lang string"),
            spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))


def test_toxicity_learns_and_holds_out(spark):
    docs, labels = toxic_corpus(spark)
    got = toxicity(docs, labels).join(labels, "doc_id").collect()
    assert len(got) == 400
    held = [r for r in got if r.held_out]
    assert 40 < len(held) < 120 and all(r.predicted == int(r.score >= 0.5) for r in got)
    assert sum(r.predicted == r.toxic for r in held) >= 0.95 * len(held)
    left = {r.doc_id for r in drop_toxic(docs, labels).collect()}
    assert left == {r.doc_id for r in got if not r.rejected}


def test_toxicity_does_not_see_held_out_labels_or_ids(spark):
    docs, labels = toxic_corpus(spark, 120)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one = {r.doc_id: r.score for r in toxicity(docs, labels).collect()}
    two = {r.doc_id: r.score for r in toxicity(docs.withColumn("lang", F.lit("xx")), flipped).collect()}
    assert one == pytest.approx(two)


def test_toxicity_of_awkward_tables(spark, awkward, empty, labels, no_labels):
    rows = toxicity(awkward, labels).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in toxicity(awkward, no_labels).collect()} == {0.0}
    assert toxicity(empty, labels).collect() == []
    assert drop_toxic(awkward, no_labels).columns == awkward.columns
    assert fit(awkward, labels, max_words=1).constant == 0.0  # nothing is short enough to fit on


def test_toxicity_fits_on_every_labelled_row(spark, monkeypatch):
    """Long texts train too, shards of any number count the same rows, cuts are those of all rows."""
    docs, labels = toxic_corpus(spark, 200)
    seen = []
    whole = toxicity_module.start
    monkeypatch.setattr(toxicity_module, "start", lambda rows, counts, n: seen.append((counts, n)) or whole(rows, counts, n))
    long = docs.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.repeat(F.lit(" word"), 50_001))).otherwise(F.col("text")))
    monkeypatch.setattr(toxicity_module, "SHARD_CHARS", 4_000_000)
    model = fit(long, labels)
    used = labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    trained = used.filter(F.pmod(F.xxhash64("doc_id"), F.lit(5)) != 4)
    assert seen[0][1].tolist() == [trained.filter("toxic = 0").count(), trained.filter("toxic = 1").count()]
    assert seen[0][0].sum(axis=0).max() >= trained.filter("doc_id % 2 = 0").count()
    assert np.isfinite(model.values).all() and 0 < model.scale


def test_toxicity_cuts_are_the_best_of_all_rows(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b"]), int(rng.random() < 0.4), round(rng.random(), 2)) for _ in range(400)] + [("c", 1, 0.5)]
    got = toxicity_module._cuts(spark.createDataFrame(rows, "lang string, y int, s double"), 3)
    for lang in "ab":
        mine = [(y, s) for x, y, s in rows if x == lang]
        f1 = {c: 2 * sum(y for y, s in mine if s >= c) / (sum(s >= c for _, s in mine) + sum(y for y, _ in mine)) for _, c in mine}
        best = max(f1, key=lambda c: (f1[c], c))
        assert got[lang] == pytest.approx((best + max([s for _, s in mine if s < best], default=0.0)) / 2)
    assert set(got) == {"a", "b"}


def test_long_texts_pool_as_whole_ones():
    rng = np.random.default_rng(3)
    e = rng.normal(size=(50, toxicity_module.WIDTH)).astype(np.float32)
    filters = [rng.normal(size=(s, toxicity_module.WIDTH, toxicity_module.FILTERS)).astype(np.float32) for s in toxicity_module.SPANS]
    bias = [np.zeros(toxicity_module.FILTERS, np.float32) for _ in filters]
    docs = [np.concatenate([rng.integers(1, 50, (n, toxicity_module.PARTS)), np.zeros((3, toxicity_module.PARTS), int)]).astype(np.int32)
            for n in (0, 1, 5, 40, 7)]
    alone = [toxicity_module._pooled(e, filters, bias, [d], where=True) for d in docs]
    for words in (4, 10, 1000):
        top, won = toxicity_module._pooled(e, filters, bias, docs, where=True, words=words)
        assert np.allclose(top, np.concatenate([t for t, _ in alone]), atol=1e-4)
        assert all((w == np.concatenate([a[s] for _, a in alone])).all() for s, w in enumerate(won))


# Personal data --------------------------------------------------------------------

RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
         "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
         "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits: str) -> bool:
    twice = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in twice) % 10 == 0


def brute_spans(text: str) -> list[str]:
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m.group())
            if (kind == "email" or kind == "ip" and max(map(int, m.group().split("."))) <= 255
                    or kind == "card" and 13 <= len(digits) <= 19 and luhn(digits)
                    or kind == "phone" and 9 <= len(digits) <= 15):
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans_equal_the_plain_rules(spark, awkward, empty):
    rng = random.Random(11)
    texts = [t or "" for _, t in awkward_texts()] + [
        "a@b.c%d@e.f x", "a@b.c.@d.e", "1.2.3.4.5.6.7.8 300.1.1.1 0000255.1.1.01", "é😀 x@y.zz 10.0.0.1\n4111111111111111",
        "4111 1111 1111 1111 4111-1111-1111-1111 41111111111111111111", "+1 (988) 555-2485 ++49 30 1234567. +",
        "1" * 20_000, "a@" * 2000, "1.2.3.4 " * 500, "x@y.zz," * 500, "+" * 2000]
    texts += ["".join(rng.choice("ab1@.+ -0(49%") for _ in range(60)) for _ in range(800)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in span_report(personal_data(docs)).collect():
        want = brute_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS] == [sum(x.startswith(k) for x in want) for k in KINDS]
        assert set(want) <= set(r.spans.split(",")) | {""}
    assert span_report(personal_data(awkward)).count() == awkward.count()
    assert personal_data(empty).collect() == []


def test_bootstrap_finds_an_unseen_identifier(spark):
    rows = [(i, f"please ring {w} +1 ({200 + i}) 555-{1000 + i} {w} today") for i in range(60)
            for w in [random.Random(i).choice(["now", "soon"])]]
    # Digits that follow make the whole run too long for the base rule.
    rows.append((100, "please ring soon +1 (977) 555-1999 190.137.223.20 bye"))
    got = {r.doc_id: r for r in span_report(personal_data(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got[100].n_phone == 0 and got[100].n_added == 1
    text = rows[-1][1]
    phone = [x.split(":") for x in got[100].spans.split(",") if x.startswith("phone")][0]
    assert text[int(phone[1]):int(phone[2])] == "+1 (977) 555-1999"
    assert all(got[i].n_phone == 1 and got[i].n_added == 0 for i in range(60))


# Mixing ---------------------------------------------------------------------------

def test_rates_meet_the_targets(spark):
    rows = [(i, (invent(i, 50) if i % 3 else "JUNK!! " * 60)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 300, 2)], "doc_id long, quality int")
    for floor, budget in ((0.0, 1.0), (1.0, None)):
        got = mixing_rates(docs, marks, {"1": 0.8, "0": 0.2}, floor=floor, budget=budget).toPandas()
        p = np.array([[x["0"], x["1"]] for x in got.posteriors])
        mass = (got.n_tokens.values * got.rate.values) @ p
        assert np.allclose(p.sum(axis=1), 1) and (got.rate >= floor - 1e-12).all()
        assert np.allclose(mass / mass.sum(), [0.2, 0.8], atol=1e-4)
        assert ((got.copies == np.floor(got.rate)) | (got.copies == np.floor(got.rate) + 1)).all()
        if budget:
            assert mass.sum() == pytest.approx(got.n_tokens.sum(), rel=1e-4)


def test_rates_equal_a_plain_projected_gradient(spark):
    """The target is out of reach, so rates end on the floor."""
    rows = [(i, (invent(i, 50) if i % 3 else "JUNK!! " * 60)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(120)], "doc_id long, quality int")
    got = mixing_rates(docs, marks, {"1": 1.0}, floor=0.0).toPandas()
    p = np.array([[x["0"], x["1"]] for x in got.posteriors])
    w = got.n_tokens.values / got.n_tokens.sum()
    r = np.ones(len(w))
    for _ in range(20_000):
        r = np.maximum(0, r - p @ ((w * r) @ p - np.array([0.0, 1.0])))
    ours = (w * got.rate.values) @ p - np.array([0.0, 1.0])
    assert np.linalg.norm(ours) <= np.linalg.norm((w * r) @ p - np.array([0.0, 1.0])) + 1e-5


def test_mixing_of_awkward_tables(awkward, empty, labels, no_labels):
    mixed = mix(awkward, labels, {"1": 0.6, "0": 0.4}, floor=1.0, budget=None)
    assert mixed.columns == awkward.columns
    before, after = bag(awkward.distinct().collect()), bag(mixed.distinct().collect())
    assert before == after  # at least one copy of every row
    rates = mixing_rates(awkward, no_labels, {"1": 0.5, "0": 0.5}).collect()
    assert len(rates) == awkward.count() and all(abs(r.rate - 1) < 1e-6 for r in rates)
    assert mix(empty, labels, {"1": 1.0}).collect() == []


def test_mixing_keeps_columns_of_any_name(spark, labels):
    rows = [(i, f"word {i} " * (i + 1), i, i + 1, i + 2, i + 3) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _copy int, _copies int, _mix_copy int, _mix_id_ int")
    mixed = mix(docs, labels, {"1": 0.6, "0": 0.4}, floor=1.0, budget=None)
    assert mixed.columns == docs.columns
    got = {r.doc_id: tuple(r) for r in mixed.collect()}
    assert got == {i: (i, t, *rest) for i, t, *rest in rows}
