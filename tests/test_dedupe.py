import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from harrow.config import CurationConfig
from harrow.operators import dedupe
from harrow.operators.dedupe import sequential_two_key, two_key_dedupe
from harrow.plans.curate import settle_source
from harrow.plans.views import key_listings
from harrow.session import scratch_path

SCHEMA = "ord long, source_url string, fingerprint string"


def run(spark, rows, store=None):
    df = spark.createDataFrame(rows, SCHEMA)
    st_df = spark.createDataFrame(store, "source_url string, fingerprint string") if store else None
    return sorted(r.ord for r in two_key_dedupe(df, store=st_df).collect())


def test_golden_cases(spark):
    assert run(spark, [(1, "u1", "f1"), (2, "u1", "f2"), (3, "u2", "f2")]) == [1, 3]
    assert run(spark, [(1, "u1", "f1"), (2, "u2", "f1"), (3, "u2", "f2")]) == [1, 3]
    assert run(spark, [(1, "u1", "f1"), (2, "u2", "f1"), (3, "u2", "f2")],
               store=[("zz", "f1")]) == [3]
    assert run(spark, [(1, "u1", "f1"), (2, "u1", "f1")]) == [1]


def test_driver_documents_79(spark):
    k = key_listings(spark, "/root/testdata/sf0.01")
    assert two_key_dedupe(k).count() == 79


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), min_size=1, max_size=40))
def test_matches_sequential_loop(spark, pairs):
    rows = [(i, f"u{u}", f"f{f}") for i, (u, f) in enumerate(pairs)]
    assert run(spark, rows) == sequential_two_key(rows)


def test_adversarial_chain(spark):
    # A(u0,f0) B(u1,f0) C(u1,f1) D(u2,f1) ...: every other row survives.
    rows = []
    for i in range(30):
        rows.append((2 * i, f"u{i}", f"f{i}"))
        rows.append((2 * i + 1, f"u{i + 1}", f"f{i}"))
    assert run(spark, rows) == sequential_two_key(rows)


def chain(n):
    """A(u0,f0) B(u1,f0) C(u1,f1) D(u2,f1) ...: each row waits on the one before it."""
    return [(i, f"u{(i + 1) // 2}", f"f{i // 2}") for i in range(n)]


def test_chains_end_in_few_rounds(spark):
    for n in (2, 3, 5, 17, 300):
        df = spark.createDataFrame(chain(n), SCHEMA)
        kept, rounds = two_key_dedupe(df, return_rounds=True)
        assert sorted(r.ord for r in kept.collect()) == list(range(0, n, 2))
        assert rounds <= 4, (n, rounds)


def branching(seed, n):
    """Chains that meet: some rows wait on two earlier ones, some share both keys with one."""
    rng, rows, u, f = random.Random(seed), [], 0, 0
    for i in range(n):
        kind = rng.random()
        if kind < 0.15 or not rows:
            u, f = u + 1, f + 1
            rows.append((i, f"u{u}", f"f{f}"))
            continue
        _, a, b = rng.choice(rows[-6:])
        u, f = u + 1, f + 1
        rows.append((i, a, f"f{f}") if kind < 0.5 else (i, f"u{u}", b) if kind < 0.85 else (i, a, rng.choice(rows)[2]))
    return rows


def test_pointer_rounds_alone_equal_the_loop(spark, monkeypatch):
    monkeypatch.setattr(dedupe, "_plain_round", lambda cand, *keys: dedupe._pointer_round(
        cand, *keys, scratch_path(spark, "t-chains")))
    for seed in range(4):
        rows = branching(seed, 120)
        assert run(spark, rows) == sequential_two_key(rows)
    hot = [(i, f"u{i // 2}", "hot" if i % 3 == 0 else f"f{i // 2}") for i in range(600)]
    assert run(spark, hot) == sequential_two_key(hot)


def test_chains_of_struct_orders_and_null_keys(spark):
    rows = [((i // 7, i % 7), u if i % 5 else None, f if i % 4 else None) for i, u, f in chain(80)]
    df = spark.createDataFrame(rows, "ord struct<a:int,b:int>, source_url string, fingerprint string")
    want = sequential_two_key([(o, u or f"none{o}", f or f"none{o}") for o, u, f in rows])
    assert sorted(tuple(r.ord) for r in two_key_dedupe(df).collect()) == want


def test_relevance_dedupe_cap_order(spark):
    # (u1,no) (u1,yes) (u2,yes) (u2,yes) (u3,yes), cap 2 -> second u1, first u2.
    rows = [(0, "u1", False), (1, "u1", True), (2, "u2", True), (3, "u2", True), (4, "u3", True)]
    df = (spark.createDataFrame(rows, "ord long, source_url string, relevant boolean")
          .withColumn("source", F.lit("s")).withColumn("title", F.lit("t")))
    out = settle_source(df.where("relevant"), CurationConfig(max_jobs_per_source=2))
    assert sorted(r.ord for r in out.collect()) == [1, 2]


def test_hot_key_third_of_rows(spark):
    # One fingerprint holds a third of all rows; URLs repeat in small groups.
    rows = [(i, f"u{i // 3}", "hot" if i % 3 == 0 else f"f{i}") for i in range(3000)]
    assert run(spark, rows) == sequential_two_key(rows)


def test_first_wins_hot_key(spark):
    from harrow.operators.dedupe import first_wins
    rows = [(i, "s", "hot" if i % 3 else f"u{i}", f"t{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "ord long, source string, source_url string, title string")
    out = {r.source_url: r.ord for r in first_wins(df, ["source", "source_url"]).collect()}
    assert out["hot"] == 1 and out["u0"] == 0 and len(out) == 1001


def test_large_caps_are_ranked_in_pieces(spark):
    from pyspark.sql import functions as F

    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"), F.col("id").alias("ord"))
    for n in (10, 1500, None):
        got = dedupe.cap_per_group(df, "g", n).groupBy("g").agg(F.count("*").alias("n"), F.max("ord").alias("m")).collect()
        sizes = {"a": 1667, "b": 3333}
        assert {r.g: r.n for r in got} == {g: min(n or 10**9, s) for g, s in sizes.items()}
        if n == 1500:
            assert {r.g: r.m for r in got} == {"a": 3 * 1499, "b": 2249}
