import json
import tempfile

from pyspark.sql import functions as F

from harrow.sources.boards import board_scan
from harrow.config import CurationConfig
from harrow.plans.curate import curate
from harrow.sources.pages import CardRules, absolute_url, card_scan, link_scan, section_scan
from harrow.sources.registry import html_rows


def land(files):
    d = tempfile.mkdtemp(prefix="harrow-landing-")
    for name, payload in files.items():
        with open(f"{d}/{name}", "w") as fh:
            fh.write(payload)
    return d


def test_shape_a(spark):
    d = land({
        "anthropic.json": json.dumps({"jobs": [
            {"id": 7, "title": "ML Engineer", "content": "<p>Build</p>\n<b>models</b>",
             "location": {"name": "SF"}, "company": {"name": "Acme"}},
            {"id": 8, "title": "Accountant"},
            {"id": 9, "title": "AI Researcher", "company": {}}]}),
        "waymo.json": "not json",
    })
    rows = board_scan(spark, d, "A", "Greenhouse", 1).orderBy("ord").collect()
    assert [r.title for r in rows] == ["ML Engineer", "AI Researcher"]
    assert rows[0].description == "Build models"
    assert rows[0].company == "Acme" and rows[0].location == "SF"
    assert rows[0].source_url == "https://boards.greenhouse.io/anthropic/jobs/7"
    assert rows[1].company is None  # a company object without a name wins over the board
    assert rows[0].ord.pos == 0 and rows[1].ord.pos == 2


def test_shape_b_requires_array(spark):
    d = land({
        "mistral.json": json.dumps([
            {"id": "x1", "text": "Research Scientist", "categories": {"location": "Paris"},
             "salaryRange": {"min": 120000, "max": 160000, "currency": "usd"},
             "hostedUrl": "https://h/x1"},
            {"id": "x2", "text": "Office Manager"}]),
        "palantir.json": json.dumps({"text": "ML Engineer"}),
    })
    rows = board_scan(spark, d, "B", "Lever", 2).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.company, r.location, r.salary) == ("Mistral AI", "Paris", "$120,000 - $160,000")


def test_shape_c_job_postings_fallback(spark):
    d = land({"openai.json": json.dumps({"jobPostings": [
        {"id": "p1", "title": "Machine Learning Engineer", "locationName": "Remote",
         "compensation": {"compensationTierSummary": "$200K – $300K • Offers Equity"}}]})})
    r = board_scan(spark, d, "C", "Ashby", 3).first()
    assert (r.location, r.salary, r.source_url) == ("Remote", "$200K - $300K",
                                                   "https://jobs.ashbyhq.com/openai/p1")


def test_card_scan_and_fallback(spark):
    html_cards = ('<main><div data-id="job-card"><a href="/job/1" data-id="job-card-title"><b>ML Engineer</b></a>'
                  '<a data-id="company-title">Acme</a><span>Hybrid</span><span>Austin, TX</span>'
                  '<div class="salary-range">$100K - $120K</div><footer>card footer</footer></div>'
                  '<article class="wide job-card"><h2><a href="job/2">AI <i>Lead</i></a></h2>'
                  '<span>Beta Co</span></article></main><footer>x</footer>')
    html_links = ('<ul><li><a href="/company/g">Gamma</a><a href="/job/9"><span>Data Scientist</span></a></li>'
                  '<li><a href="/about">About</a></li></ul>')
    pages = spark.createDataFrame([(1, "https://b.example/jobs/x?p=1", html_cards), (2, "https://b.example/l", html_links)],
                                  "page_id long, url string, html string")
    rows = card_scan(pages, CardRules(), base_col="url").orderBy("page_id", "pos").collect()
    assert [(r.title, r.href, r.company, r.location, r.salary) for r in rows] == [
        ("ML Engineer", "https://b.example/job/1", "Acme", "Hybrid", "$100K - $120K"),
        ("AI Lead", "https://b.example/jobs/job/2", "Beta Co", "Austin, TX", ""),
        ("Data Scientist", "https://b.example/job/9", "Gamma", "Austin, TX", ""),
    ]
    assert [r.from_cards for r in rows] == [True, True, False]
    assert link_scan(pages, "job/").count() == 3


def test_cards_with_footers_are_all_read(spark):
    card = '<div data-id="job-card"><a href="/job/{i}" data-id="job-card-title">Role {i}</a><footer>f</footer></main></div>'
    pages = spark.createDataFrame([(1, "".join(card.format(i=i) for i in range(5)))], "page_id long, html string")
    assert [r.title for r in card_scan(pages).orderBy("pos").collect()] == [f"Role {i}" for i in range(5)]


def test_absolute_url(spark):
    base = "https://b.example/jobs/x?p=1#top"
    want = {"/a": "https://b.example/a", "a/b": "https://b.example/jobs/a/b", "//h.example/c": "https://h.example/c",
            "http://z.example/": "http://z.example/", "?q=2": "https://b.example/jobs/x?q=2",
            "#s": "https://b.example/jobs/x?p=1#s", "mailto:x": "mailto:x", "": ""}
    df = spark.createDataFrame([(h,) for h in want], "h string")
    got = {r.h: r.u for r in df.select("h", absolute_url(F.lit(base), F.col("h")).alias("u")).collect()}
    assert got == want
    assert df.select(absolute_url(F.lit(None).cast("string"), F.lit("/a"))).first()[0] == "/a"


def test_section_scan_inherits_header(spark):
    html = ('<div><a href="/companies/acme">Acme (S23) • Robots</a>'
            '<a href="/jobs/11">ML Engineer</a><a href="/jobs/12"><b>AI</b> Intern</a></div>'
            '<div><a href="/companies/beta">Beta</a><a href="/jobs/13">Researcher</a><a href="/jobs/all">All</a></div>')
    rows_html = ('<a href="/companies/c">Cee</a><li class="job-row"><a href="/jobs/1">Founding Engineer</a>'
                 '<span class="location">Paris</span><div class="salary">$9K</div></li>')
    pages = spark.createDataFrame([(1, html), (2, rows_html)], "page_id long, html string")
    rows = section_scan(pages).orderBy("page_id", "section", "pos").collect()
    assert [(r.title, r.company, r.company_context, r.location, r.salary) for r in rows] == [
        ("ML Engineer", "Acme", "Robots", "", ""), ("AI Intern", "Acme", "Robots", "", ""),
        ("Researcher", "Beta", "", "", ""), ("Founding Engineer", "Cee", "", "Paris", "$9K")]
    assert rows[3].card_text == "Founding Engineer Paris $9K"


def test_every_row_has_an_order_of_its_own(spark):
    """150 sections on each of two pages, two seeds with equal page ids."""
    page = "".join(f'<a href="/companies/{i}">Co {i}</a><a href="/jobs/{i}{{p}}{{s}}">AI Engineer</a>' for i in range(150))
    pages = spark.createDataFrame(
        [(s, p, f"https://w.example/{s}", page.format(p=p, s=s)) for s in range(2) for p in range(2)],
        "board_rank int, page_id long, url string, html string")
    rows = html_rows(section_scan(pages, carry=("board_rank",), base_col="url"), "YC Jobs", 5, "Remote")
    assert rows.count() == 600 and rows.select("ord").distinct().count() == 600
    res = curate(rows, CurationConfig(job_titles=("engineer",), keywords=("engineer",), max_jobs_per_source=None),
                 settle=True)
    s = res.summary.first()
    # Two seeds and pages repeat the 150 companies, so 150 fingerprints are written.
    assert (s.found, s.passed_filters, s.duplicates, s.written) == (600, 600, 450, 150)
