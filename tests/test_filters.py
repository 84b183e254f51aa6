import pytest
from pyspark.sql import functions as F

from harrow.config import CurationConfig
from harrow.operators.filters import (PHRASE_TABLE_BYTES, phrase_semi, apply_tiers, board_title_ok, city_relevant,
                                      startup_relevant)

TIERS = [
    ("Software Engineer", "python", "Austin, TX", None),
    ("Software Engineer", "python", "", None),
    ("Software Engineer", "python", "Remote - EU", None),
    ("", "python", "Remote", 1),
    ("Software Engineer, Chrome", "python", "Remote", 1),
    ("Software Engineer, Leadership Tools", "python", "Remote", 1),
    ("Staffing Software Engineer", "python", "Remote", 1),
    ("SRE", "", "Remote", 2),
    ("Software Engineer", "10+ years", "Remote", 3),
    ("Product Designer", "", "Paris", 4),
]


def test_four_tier_golden(spark):
    df = spark.createDataFrame([(i, t, d, l) for i, (t, d, l, _) in enumerate(TIERS)],
                               "i int, title string, description string, location string")
    got = {r.i: r.failed_tier for r in apply_tiers(df, CurationConfig()).collect()}
    assert [got[i] for i in range(len(TIERS))] == [x[3] for x in TIERS]


def test_empty_lists(spark):
    df = spark.createDataFrame([("Software Engineer", "python", "Paris")],
                               "title string, description string, location string")
    cfg = CurationConfig(job_titles=(), preferred_locations=())
    assert apply_tiers(df, cfg).first().failed_tier == 1
    cfg = CurationConfig(preferred_locations=())
    assert apply_tiers(df, cfg).first().failed_tier is None


def test_board_prefilter(spark):
    titles = ["AI Engineer", "Lead AI Engineer", "Applied AI", "Research Scientist", "International Sales"]
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    got = [(r[0], r[1]) for r in df.select(board_title_ok("t", "A"), board_title_ok("t", "B")).collect()]
    assert got == [(True, False), (True, True), (False, False), (False, True), (True, True)]


def test_relevance(spark):
    df = spark.createDataFrame([
        ("Software Engineer", "AI-first team"), ("AI Sales Engineer", ""),
        ("Software Engineer Intern", ""), ("Research Engineer Intern", "")], "t string, c string")
    got = [(r[0], r[1]) for r in df.select(city_relevant("t", "c"), startup_relevant("t")).collect()]
    assert got[0] == (True, False)
    assert got[1][1] is False
    assert got[2][1] is False
    assert got[3][1] is True


def test_phrase_semi_both_paths(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox jumps"), (2, "lazy dog sleeps"),
                                  (3, "xyzzy"), (4, "Quick Brown")], "k int, t string")
    phrases = ["quick brown f", "dog", "nothing here"] + [f"filler phrase {i}" for i in range(80)]
    ph = spark.createDataFrame([(p,) for p in phrases], "phrase string")
    small = spark.createDataFrame([(p,) for p in phrases[:3]], "phrase string")
    a = sorted(r.k for r in phrase_semi(docs, "t", small).collect())
    b = sorted(r.k for r in phrase_semi(docs, "t", ph).collect())
    assert a == b == [1, 2]


@pytest.mark.parametrize("table_bytes", [PHRASE_TABLE_BYTES, 0])
def test_phrase_semi_equals_substring_search_on_both_sides_of_the_size_check(spark, table_bytes):
    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abÜc") for _ in range(rng.randrange(1, 4)))
    texts = [(None if k % 9 == 0 else k, " ".join(word() for _ in range(rng.randrange(1, 30)))) for k in range(150)]
    texts += [(7, None), (8, ""), (9, "ab\nc\u00a0ab  x"), (9, "ab\nc\u00a0ab  x")]
    df = spark.createDataFrame(texts, "k long, t string")
    pool = [" ".join(word() for _ in range(rng.randrange(1, 5))) for _ in range(90)] + ["ab\nc", "abc ", " a", "Üc b", "\u00a0ab"]
    for phrases in ([], ["abca"], pool[:3], pool, [None], ["a", ""]):
        table = spark.createDataFrame([(p,) for p in phrases], "phrase string")
        want = [r for r in texts if any(p is not None and p.lower() in (r[1] or "").lower() for p in phrases)]
        got = phrase_semi(df, "t", table, table_bytes=table_bytes).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_a_small_phrase_table_is_matched_within_the_row(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox jumps"), (2, "lazy dog")], "k int, t string")
    table = spark.createDataFrame([("quick brown f",), ("dog",)], "phrase string")
    out = phrase_semi(docs, "t", table)
    plan = out._jdf.queryExecution().executedPlan().toString().splitlines()
    steps = [line for line in plan if not line.lstrip().startswith(":")]  # without those of the phrase table
    assert sorted(r.k for r in out.collect()) == [1, 2]
    assert not [line for line in steps if "Exchange" in line or "Join" in line]
    uses = [line for line in steps if "Subquery" in line]
    assert len(uses) == 1 and "exists(Subquery" in uses[0] and "AS _phrases" in uses[0]  # in no column of its own
