"""Bad payloads, unreadable files and failing sources are reported and do not end the run."""

import json
import os

from pyspark.sql import functions as F

from harrow.config import CurationConfig
from harrow.plans.curate import curate
from harrow.sources.boards import judge_payloads
from harrow.sources.registry import REGISTRY, Source, collect_run, seed_dim, seed_rank

ANY = CurationConfig(job_titles=("engineer",), blocked_job_titles=(), keywords=("engineer",), exclude_keywords=(), max_jobs_per_source=None)


def test_reason_of_each_payload(spark):
    job = {"jobs": [{"id": 1, "title": "ML Engineer"}]}
    cases = [("A", "anthropic", json.dumps(job), None), ("A", "anthropic", json.dumps(job)[:-3], "not JSON"),
             ("A", "anthropic", '{"jobs": {}}', "wrong shape"), ("A", "anthropic", '{"jobs": null}', "wrong shape"),
             ("A", "anthropic", "[]", "wrong shape"), ("A", "nowhere", json.dumps(job), "unknown board"),
             ("A", None, json.dumps(job), "unknown board"), ("A", "anthropic", None, "empty payload"),
             ("A", "anthropic", " ", "empty payload"), ("A", "anthropic", "<html>", "not JSON"), ("A", "anthropic", "5", "not JSON"),
             ("B", "mistral", "[]", None), ("B", "mistral", "{}", "wrong shape"),
             ("C", "openai", '{"jobPostings": []}', None), ("C", "openai", '{"jobs": null, "jobPostings": []}', None)]
    for shape in "ABC":
        mine = [c for c in cases if c[0] == shape]
        df = spark.createDataFrame([(i, t, v) for i, (_, t, v, _) in enumerate(mine)], "i int, token string, value string")
        got = {r.i: r.reason for r in judge_payloads(df, shape).collect()}
        want = {i: w for i, (_, _, _, w) in enumerate(mine)}
        assert got == want


def land(spark, d):
    pages = "board_rank int, page_id long, url string, html string"
    card = '<div data-id="job-card"><h2><a href="/job/{i}">AI Software Engineer {i}</a></h2></div>'
    for i in range(3):
        spark.createDataFrame([(None, i, "https://builtin.com/jobs/austin/artificial-intelligence?page=2", card.format(i=i))], pages
                              ).coalesce(1).write.mode("append").parquet(f"{d}/builtin-austin")
    os.makedirs(f"{d}/greenhouse")
    for name, text in {"anthropic": json.dumps({"jobs": [{"id": 1, "title": "ML Engineer", "absolute_url": "https://g/1"}]}),
                       "waymo": '{"jobs": [{"id": 2, "title": "ML Eng', "cohere": '{"error": "gone"}'}.items():
        with open(f"{d}/greenhouse/{name}.json", "w") as out:
            out.write(text)


def test_run_goes_on_and_reports(spark, tmp_path):
    d = str(tmp_path)
    land(spark, d)
    (tmp_path / "builtin-austin" / "part-bad.parquet").write_text("not parquet at all")

    def broken(spark, landing, cfg):
        raise KeyError("no such thing")

    registry = (*REGISTRY[:5], Source("broken", 9, broken, lands=False))
    got = collect_run(spark, d, ANY, registry)
    assert sorted(r.title for r in got.listings.collect()) == [f"AI Software Engineer {i}" for i in range(3)] + ["ML Engineer"]
    report = {(r.source, r.place, r.reason) for r in got.quarantine.collect()}
    assert report == {("Greenhouse", "waymo", "not JSON"), ("Greenhouse", "cohere", "wrong shape"), ("Lever", "", "not landed"),
                      ("Ashby", "", "not landed"), ("BuiltIn Austin", "part-bad.parquet", "no readable rows"),
                      ("broken", "KeyError", "source failed")}
    assert {r.ord.board_rank for r in got.listings.where("source = 'BuiltIn Austin'").collect()} == {1}  # by its seed
    s = curate(got.listings, ANY, quarantine=got.quarantine, settle=True).summary.first()
    assert (s.found, s.passed_filters, s.filtered, s.duplicates, s.written, s.errors) == (4, 4, 0, 0, 4, 6)


def test_observed_counters_equal_the_labels(spark):
    rows = [(i, "s", f"Engineer {i % 4}" if i % 3 else "Chef", "engineer", "co", "Remote", f"u{i % 9}") for i in range(40)]
    df = spark.createDataFrame(rows, "ord long, source string, title string, description string, company string, location string, source_url string")
    res = curate(df, ANY, settle=True)
    by = {r.status: r["count"] for r in res.verdicts.groupBy("status").count().collect()}
    s = res.summary.first()
    assert (s.found, s.filtered, s.duplicates, s.written, s.errors) == (
        sum(by.values()), by.get("filtered", 0), by.get("duplicate", 0), by.get("written", 0), 0)
    assert s.written == res.written.count()


def test_seed_dimension(spark):
    dim = seed_dim(spark)
    assert [tuple(r) for r in dim.groupBy("source", "source_rank").count().orderBy("source_rank").collect()] == [
        ("BuiltIn Austin", 4, 2), ("BuiltIn Houston", 5, 2), ("YC Jobs", 6, 3)]
    got = dim.where("source = 'YC Jobs'").select("board_rank", seed_rank(F.concat("url", F.lit("&page=3")), "YC Jobs").alias("r")).collect()
    assert all(r.board_rank == r.r for r in got)
    assert dim.select(seed_rank(F.lit("https://other.example/"), "YC Jobs")).first()[0] is None
