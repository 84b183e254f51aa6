import datetime as dt

from pyspark.sql import functions as F

from harrow.functions.company import company_from_heading, split_company
from harrow.plans import maintain
from harrow.sources.store import update_status


def test_split_company(spark):
    df = spark.createDataFrame([("Acme (S23) • Robots for  all • Austin",), ("",), ("Acme (YC S23)",)], "r string")
    got = [(r.s.company, r.s.context) for r in df.select(split_company("r").alias("s")).collect()]
    assert got == [("Acme", "Robots for all  •  Austin"), ("Unknown", ""), ("Acme (YC S23)", "")]


def test_company_from_heading(spark):
    df = spark.createDataFrame([("Engineer at Acme (S23)",), ("Chef at large at Acme",), ("Engineer",)], "h string")
    assert [r[0] for r in df.select(company_from_heading("h")).collect()] == ["Acme", "large at Acme", ""]


def test_repair_dates(spark):
    ts = lambda d: dt.datetime.fromisoformat(d + "T10:00:00")
    rows = [(1, None, ts("2026-04-01")), (2, "", ts("2026-04-01")), (3, "Not listed", ts("2026-04-01")),
            (4, "2026-04-14", ts("2026-04-14")), (5, "2026-04-14", ts("2026-04-15")),
            (6, "2026-03-01", ts("2026-04-14"))]
    df = spark.createDataFrame(rows, "id int, date_found string, created_time timestamp")
    out = maintain.repair_dates(df)
    got = {r.id: r.date_posted for r in out.collect()}
    assert got == {1: "Not Posted", 2: "Not Posted", 3: "Not Posted", 4: "Not Posted",
                   5: "2026-04-14", 6: "2026-03-01"}
    s = maintain.repair_dates_summary(out).first()
    assert (s.rewritten, s.repaired_fallbacks) == (6, 1)


def test_backfill_never_overwrites_valid(spark):
    rows = [(1, "Senior Engineer", "Senior"), (2, "Senior Engineer", "Unknown"), (3, "Senior Engineer", ""),
            (4, "Senior Engineer", "Sr")]
    df = (spark.createDataFrame(rows, "id int, job_title string, experience_level string")
          .withColumn("company", F.lit("Acme")).withColumn("location", F.lit("Austin"))
          .withColumn("employment_type", F.lit("Unknown")))
    got = {r.id: r.experience_level for r in maintain.backfill_classes(df).collect()}
    assert got == {1: "Senior", 2: "Unknown", 3: "Senior", 4: "Senior"}


def test_migrate_and_fill(spark):
    df = spark.createDataFrame([("t", "", dt.date(2026, 1, 2), True, "v1")],
                               "title string, salary string, date_found date, cover_letter boolean, resume_version string")
    out = maintain.fill_blank_salary(maintain.migrate_schema(df))
    r = out.first()
    assert set(out.columns) == {"job_title", "salary", "date_posted", "salary_filled"}
    assert (r.salary, r.date_posted, r.salary_filled) == ("Not listed", "2026-01-02", True)


def test_status_update_and_funnel(spark):
    store = spark.createDataFrame([("a", "New"), ("b", "New"), ("c", "Applied")], "fingerprint string, status string")
    upd = spark.createDataFrame([("b", "Offer")], "fingerprint string, status string")
    out = update_status(store, upd)
    assert {r.fingerprint: r.status for r in out.collect()} == {"a": "New", "b": "Offer", "c": "Applied"}
    f = {r.status: r.n for r in maintain.status_funnel(out).collect()}
    assert f["New"] == 1 and f["Offer"] == 1 and f["Rejected"] == 0 and len(f) == 7


def test_recover_company(spark):
    pages = spark.createDataFrame([
        ("https://builtin.com/job/1", "<body><nav>Menu</nav><div>Acme Robotics</div><h1>ML Engineer</h1></body>"),
        ("https://www.workatastartup.com/jobs/2", "<body><h1>Engineer at Beta (S21)</h1></body>"),
        ("https://other.com/3", "<body><h1>x</h1></body>")], "url string, html string")
    store = spark.createDataFrame([("https://builtin.com/job/1", ""), ("https://www.workatastartup.com/jobs/2", None),
                                   ("https://other.com/3", ""), ("https://builtin.com/job/1", "Kept")],
                                  "source_url string, company string")
    out = maintain.recover_company(store, pages)
    got = sorted((r.source_url, r.company, r.company_recovered) for r in out.collect())
    assert ("https://builtin.com/job/1", "Acme Robotics", True) in got
    assert ("https://builtin.com/job/1", "Kept", False) in got
    assert ("https://www.workatastartup.com/jobs/2", "Beta", True) in got
    assert ("https://other.com/3", "", False) in got
    s = maintain.recover_company_summary(out).first()
    assert (s.updated, s.unresolved) == (2, 1)


def test_typed_cells_and_posted_text(spark):
    from harrow.functions.dates import posted_text
    from harrow.sources.store import CELL, cell_text, title_property, to_application_rows
    from pyspark.sql import types as T
    rows = [
        (("title", [(" Eng",), ("ineer ",)], None, None, None, None),
         ("date", None, None, None, ("2026-03-01",), None)),
        (("rich_text", None, [("x",)], None, None, None),
         ("rich_text", None, [(" 2026-04-02 ",)], None, None, None)),
        (None, ("select", None, None, ("New",), None, None)),
    ]
    schema = T.StructType([T.StructField("a", CELL), T.StructField("b", CELL)])
    df = spark.createDataFrame(rows, schema)
    got = [(r[0], r[1]) for r in df.select(cell_text("a", "title"), posted_text("b")).collect()]
    assert got == [("Engineer", "2026-03-01"), ("", "2026-04-02"), ("", "Not Posted")]
    props = spark.createDataFrame([({"Name": ("title", None, None, None, None, None),
                                     "Company": ("rich_text", None, None, None, None, None)},)],
                                  T.StructType([T.StructField("p", T.MapType(T.StringType(), CELL))]))
    assert props.select(title_property("p")).first()[0] == "Name"
    apps = spark.createDataFrame([("Acme", "Eng", "Austin", "v2", "Applied", "u", "2026-04-01", None)],
                                 "company string, role string, location string, resume_version string, "
                                 "status string, notion_url string, date_applied string, cover_letter string")
    r = to_application_rows(apps).first()
    assert str(r.date_applied) == "2026-04-01" and r.cover_letter is False


def test_status_update_with_repeated_keys(spark):
    from harrow.sources.store import update_status

    store = spark.createDataFrame([("a", "New"), ("b", "New")], "fingerprint string, status string")
    updates = spark.createDataFrame([("a", "Applied", 1), ("a", "Offer", 3), ("a", "Rejected", 2), (None, "Offer", 9)],
                                    "fingerprint string, status string, n int")
    got = sorted(map(tuple, update_status(store, updates, order="n").collect()))
    assert got == [("a", "Offer"), ("b", "New")]


def test_publish_replaces_the_snapshot_it_reads(spark, tmp_path):
    from harrow.sources.store import APPLICATION_STORE, publish, read_current

    base = str(tmp_path / "store")
    schema = APPLICATION_STORE
    assert read_current(spark, base, schema).count() == 0
    row = {f.name: None for f in schema.fields} | {"company": "Acme", "status": "New"}
    publish(spark.createDataFrame([row], schema), base)
    now = read_current(spark, base, schema)
    publish(now.unionByName(now), base)
    assert read_current(spark, base, schema).count() == 2
    # A snapshot without its marker is not current.
    now.write.parquet(f"{base}/snapshot=9")
    assert read_current(spark, base, schema).count() == 2
    publish(now, base)
    assert read_current(spark, base, schema).count() == 1


def test_work_folder_must_be_shared_off_a_local_master():
    import pytest

    from harrow.session import work_dir

    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

        def getConf(self):  # noqa: N802
            return Conf()

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_dir(Session())


def test_company_title_element_comes_first(spark):
    from harrow.plans.maintain import page_companies

    html = '<body><a href="/company/x"><b>Link</b> Co</a><div data-id="company-title"> <i>Acme</i></div><h1>Role</h1></body>'
    pages = spark.createDataFrame([("u1", html), ("u2", html.replace("company-title", "other"))], "url string, html string")
    assert {r["_url"]: r.line_rule for r in page_companies(pages).collect()} == {"u1": "Acme", "u2": "Link Co"}
