"""Caps by distributed selection, clustered snapshots, VARIANT chaining and maps by name."""

import glob
import json
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from harrow.functions.variants import chain, items_at, javascript_json, map_by_name, number_at, payload, string_at, variants_by_name
from harrow.operators import selection
from harrow.operators.dedupe import GROUP_LIMIT, cap_per_group
from harrow.session import scratch_path
from harrow.sources.store import publish, read_current, with_blank, with_status


# --- caps --------------------------------------------------------------------

def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_caps_over_the_group_limit_share_a_plan_without_a_window(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 5)).alias("g"),
                                    (F.col("id") * 7919 % 20_011).alias("ord"))
    sizes = {r.g: r["count"] for r in df.groupBy("g").count().collect()}
    shapes = set()
    for n in (1, 1_000, 1_001, 5_000, 6_666):
        got = cap_per_group(df, "g", n)
        plan = plan_of(got)
        if n > GROUP_LIMIT:
            assert "Window" not in plan
            shapes.add(plan.count("Join"))
        kept = {r.g: sorted(x for x in r.o) for r in got.groupBy("g").agg(F.collect_list("ord").alias("o")).collect()}
        want = {r.g: sorted(r.o)[:n] for r in df.groupBy("g").agg(F.collect_list("ord").alias("o")).collect()}
        assert kept == want
    assert shapes == {1}
    assert cap_per_group(df, "g", 1_000_000).count() == sum(sizes.values())
    assert cap_per_group(df, "g", 0).count() == 0 and cap_per_group(df, "g", None) is df


@pytest.mark.parametrize("seed", range(3))
def test_selection_equals_sorting(spark, monkeypatch, seed):
    monkeypatch.setattr(selection, "SMALL", 5)
    monkeypatch.setattr(selection, "EDGES", 4)
    rng = random.Random(seed)
    places = rng.sample(range(10_000), 400)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice(["x", "y"]), (p // 100, p % 100), i) for i, p in enumerate(places)]
    df = spark.createDataFrame(rows, "g string, h string, ord struct<a:int,b:int>, _k0 int")
    for n in (1, 7, 50, 399):
        got = sorted(r._k0 for r in selection.first_of_groups(df, ["g", "h"], "ord", n).collect())
        want = []
        for key in {r[:2] for r in rows}:
            want += [r[3] for r in sorted((r for r in rows if r[:2] == key), key=lambda r: r[2])[:n]]
        assert got == sorted(want)


def test_tied_orders_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(selection, "SMALL", 5)
    df = spark.createDataFrame([("a", 1)] * 50, "g string, ord int")
    with pytest.raises(ValueError, match="unique"):
        selection.first_of_groups(df, ["g"], "ord", 10)


def test_ranks_come_with_the_cap(spark):
    df = spark.range(3_000).select(F.lit("a").alias("g"), F.col("id").alias("ord"))
    got = cap_per_group(df, "g", 1_500, rank_col="place").agg(F.max("place"), F.max("ord"), F.count("*")).first()
    assert tuple(got) == (1_500, 1_499, 1_500)


# --- clustered snapshots -------------------------------------------------------

def scanned_rows(df):
    """Rows that the scan of a plan handed on after leaving out row groups."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_snapshots_are_clustered_so_that_row_groups_are_left_out(spark):
    rows = spark.range(40_000).select(
        F.concat(F.lit("t"), "id").alias("job_title"),
        F.when(F.col("id") % 50 == 0, F.when(F.col("id") % 100 == 0, F.lit("")).otherwise(F.lit(None))).otherwise(F.lit("co")).alias("company"),
        F.element_at(F.array(*map(F.lit, ("New", "Apply", "Offer", "Rejected"))), (F.col("id") % 4 + 1).cast("int")).alias("status"),
        F.sha2(F.col("id").cast("string"), 256).alias("fingerprint"))
    base = scratch_path(spark, "t-clustered")
    path = publish(rows.coalesce(2), base, row_group_bytes=64 * 1024)
    groups = [pq.ParquetFile(f).metadata.num_row_groups for f in glob.glob(f"{path.removeprefix('file:')}/*.parquet")]
    assert min(groups) > 4
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        store = read_current(spark, base, rows.schema)
        for df, n in ((with_status(store, "Offer"), 10_000), (with_blank(store, "company"), 800)):
            assert df.count() == n
            assert "PushedFilters: [" in plan_of(df)
            assert scanned_rows(df) < 20_000, "row groups without a match are not read"
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


# --- variants --------------------------------------------------------------------

TEXTS = ['{"a": {"b": [1, "x", null]}}', '{"a": 5}', '{"a": "s"}', "[1, 2]", '"a"', "null", "", "{", None, '{"a": {"b": {"1": "y"}}}',
         '{"a": 1, "a": {"b": ["z", "w"]}}', '{"a": {"b": [2.5, true]}}']


def js(text, *steps):
    """``value?.step`` in Python, undefined as None."""
    try:
        value = json.loads(text) if text else None
    except ValueError:
        return None
    for s in steps:
        value = (value.get(s) if isinstance(value, dict) and isinstance(s, str)
                 else value[s] if isinstance(value, list) and isinstance(s, int) and s < len(value) else None)
    return value


def test_chaining_over_unknown_shapes(spark):
    before = spark.conf.get("spark.sql.variant.allowDuplicateKeys")
    javascript_json(spark)
    try:
        df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").withColumn("v", payload("t"))
        got = df.select("i", string_at("v", "a", "b", 1).alias("s"), number_at("v", "a", "b", 0).alias("n"),
                        number_at("v", "a").alias("a"), chain("v", "a", "b").isNotNull().alias("has"),
                        F.size(items_at("v", "a", "b")).alias("size")).orderBy("i").collect()
    finally:
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", before)
    for r, t in zip(got, TEXTS, strict=True):
        s, n, a, b = js(t, "a", "b", 1), js(t, "a", "b", 0), js(t, "a"), js(t, "a", "b")
        assert r.s == (s if isinstance(s, str) else None)
        assert r.n == (n if isinstance(n, int | float) and not isinstance(n, bool) else None)
        assert r.a == (a if isinstance(a, int) else None)
        assert r["size"] == (len(b) if isinstance(b, list) else None)
        assert r.has == (b is not None)


def test_map_by_name_keeps_the_last_of_a_name(spark):
    rows = [([("x", 1), ("y", 2), ("x", 3), (None, 4)],), ([],), (None,), ([("x", None)],)]
    df = spark.createDataFrame(rows, "o array<struct<name:string,c:int>>")
    got = [r[0] for r in df.select(map_by_name("o")).collect()]
    assert [None if m is None else {k: v.c for k, v in m.items()} for m in got] == [{"x": 3, "y": 2}, {}, None, {"x": None}]
    text = '{"o": [{"name": "x", "c": 1}, {"c": 9}, 7, {"name": 5}, {"name": "x", "c": [2]}]}'
    v = spark.createDataFrame([(text,)], "t string").select(variants_by_name(payload("t"), "o").alias("m"))
    assert v.select(F.map_keys("m"), F.to_json(F.element_at("m", "x"))).first() == (["x"], '{"c":[2],"name":"x"}')


def test_map_by_name_reads_its_json_once(spark):
    df = spark.createDataFrame([('{"o": [{"name": "b", "c": 1}, {"name": "a", "c": 2}, {"name": "b", "c": 3}]}',)], "t string")
    m = df.select(variants_by_name(payload("t"), "o").alias("m"))
    assert m._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
    assert m.select(F.map_keys("m")).first()[0] == ["a", "b"]
    many = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(2999)), lambda i: F.struct(
        (i % 1000).cast("string").alias("name"), i.alias("c"))).alias("o"))
    got = many.select(map_by_name("o").alias("m")).first()["m"]
    assert {k: v.c for k, v in got.items()} == {str(i): 2000 + i for i in range(1000)}
