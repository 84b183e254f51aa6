import json
import tempfile

import pytest

from harrow.config import CurationConfig
from harrow.operators.metrics import source_counts, sources_dim
from harrow.plans.curate import curate
from harrow.sources.registry import REGISTRY, collect_sources, enrich_blank_companies


def landing(spark):
    d = tempfile.mkdtemp(prefix="harrow-land-")
    import os
    os.makedirs(f"{d}/greenhouse")
    with open(f"{d}/greenhouse/anthropic.json", "w") as fh:
        json.dump({"jobs": [{"id": 1, "title": "ML Engineer", "content": "python",
                             "location": {"name": "Remote"}, "absolute_url": "https://g/1"},
                            {"id": 2, "title": "ML Engineer", "content": "python",
                             "location": {"name": "Remote"}, "absolute_url": "https://g/1"}]}, fh)
    card = ('<div data-id="job-card"><a data-id="job-card-title" href="https://builtin.com/job/{i}">'
            'AI Software Engineer</a><span>Austin, TX</span><div class="salary">$150K - $180K</div></div>')
    html = "<main>" + "".join(card.format(i=i) for i in range(3)) + "</main>"
    spark.createDataFrame([(0, 0, "https://builtin.com/jobs/austin/ml", html)],
                          "board_rank int, page_id long, url string, html string"
                          ).write.parquet(f"{d}/builtin-austin")
    yc = ('<div><a href="/companies/acme">Acme (W22) • Robots</a>'
          # A detail link's title is the first line of the nearest div, so each link has one of its own.
          '<div><a href="https://www.workatastartup.com/jobs/77">Founding AI Engineer</a></div>'
          '<div><a href="https://www.workatastartup.com/jobs/78">Sales Lead</a></div></div>')
    spark.createDataFrame([(0, 0, "https://www.workatastartup.com/jobs", yc)],
                          "board_rank int, page_id long, url string, html string"
                          ).write.parquet(f"{d}/yc-jobs")
    return d


def test_collect_and_curate(spark):
    d = landing(spark)
    cfg = CurationConfig(max_jobs_per_source=2)
    rows = collect_sources(spark, d, cfg)
    got = sorted((r.source, r.title, r.company, r.location, r.salary) for r in rows.collect())
    assert got == [
        # No company element: the first leaf text that is not the title wins.
        ("BuiltIn Austin", "AI Software Engineer", "Austin, TX", "Austin, TX", "$150K - $180K"),
        ("BuiltIn Austin", "AI Software Engineer", "Austin, TX", "Austin, TX", "$150K - $180K"),
        ("Greenhouse", "ML Engineer", "Anthropic", "Remote", "Not listed"),
        ("YC Jobs", "Founding AI Engineer", "Acme", "Remote", "Not listed"),
    ]
    counts = {r.source: r.found for r in source_counts(rows, sources_dim(spark, [s.label for s in REGISTRY])).collect()}
    assert counts["Wellfound"] == 0 and counts["BuiltIn Austin"] == 2 and counts[None] == 4
    res = curate(rows, CurationConfig(job_titles=("Engineer",), keywords=("engineer",)))
    s = res.summary.first()
    # The two city-board cards share a fingerprint: the second is a duplicate.
    assert (s.found, s.passed_filters, s.duplicates, s.written) == (4, 4, 1, 3)


def test_in_run_company_enrichment(spark):
    rows = spark.createDataFrame([("https://builtin.com/job/1", " ", "BuiltIn Austin"),
                                  ("https://builtin.com/job/2", "Kept", "BuiltIn Austin"),
                                  ("https://builtin.com/job/1", "", "Greenhouse")],
                                 "source_url string, company string, source string")
    details = spark.createDataFrame([("https://builtin.com/job/1",
                                      '<body><a href="/company/acme">Acme</a><h1>Role</h1></body>')],
                                    "url string, html string")
    got = sorted((r.source_url, r.company) for r in enrich_blank_companies(rows, details).collect())
    # A JSON source keeps its blank company.
    assert got == [("https://builtin.com/job/1", ""), ("https://builtin.com/job/1", "Acme"),
                   ("https://builtin.com/job/2", "Kept")]


def test_missing_folder_is_an_empty_source_and_a_bad_file_is_an_error(spark, tmp_path):
    assert collect_sources(spark, str(tmp_path), CurationConfig()).count() == 0
    (tmp_path / "yc-jobs").mkdir()
    (tmp_path / "yc-jobs" / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception, match="(?i)parquet"):
        collect_sources(spark, str(tmp_path), CurationConfig()).count()


def test_unsettled_sources_give_the_same_run(spark):
    d = landing(spark)
    cfg = CurationConfig(job_titles=("Engineer",), keywords=("engineer",), max_jobs_per_source=2)
    one = curate(collect_sources(spark, d, cfg), cfg).verdicts
    two = curate(collect_sources(spark, d, cfg, settle=False), cfg, settle=True).verdicts
    assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))
