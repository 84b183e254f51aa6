import pytest
from pyspark.sql import functions as F

from columns import one_col
from harrow.functions.classify import classify
from harrow.functions.salary import clean_salary, salary_from_compensation, salary_from_range

SALARY_TEXT = [
    (None, "Not listed"), ("", "Not listed"), ("   ", "Not listed"),
    ("$45/hr", "$45/hr"), ("$45 – $65 / hr", "$45 - $65 / hr"),
    ("$120,000–$160,000 Offers Equity", "$120,000 - $160,000"),
    ("$120k - $160k", "$120k - $160k"), ("$120K", "$120K"), ("$120k", "$120"),
    ("$120K - 160K", "$120K"), ("$45.50/hr", "$45"), ("120K - 160K", "Not listed"),
    ("€90,000 - €110,000", "Not listed"),
]


def test_clean_salary_golden(spark):
    got = one_col(spark, [a for a, _ in SALARY_TEXT], clean_salary)
    assert got == [b for _, b in SALARY_TEXT]


def test_salary_range_golden(spark):
    rows = [(120000.0, 160000.0, "usd"), (120000.0, None, None), (None, 90000.0, "EUR"),
            (0.0, 50000.0, "USD"), (None, None, "USD")]
    df = spark.createDataFrame([((a, b, c),) for a, b, c in rows],
                               "r struct<min:double,max:double,currency:string>")
    got = [r[0] for r in df.select(salary_from_range("r")).collect()]
    assert got == ["$120,000 - $160,000", "$120,000+", "up to EUR 90,000", "up to $50,000",
                   "Not listed"]


def test_salary_compensation_golden(spark):
    schema = ("c struct<summaryComponents:array<struct<currencyCode:string,minValue:double,"
              "maxValue:double>>,currency:string,currencyCode:string,minValue:double,"
              "maxValue:double,compensationTierSummary:string>")
    rows = [
        (([("gbp", 80000.0, 95000.0)], None, None, None, None, None),),
        (([("USD", 120000.0, None)], None, None, None, None, "$120K – $160K • Equity"),),
        ((None, None, None, None, None, "$120k – $160k"),),
        (None,),
    ]
    got = [r[0] for r in spark.createDataFrame(rows, schema).select(salary_from_compensation("c")).collect()]
    assert got == ["GBP 80,000 - GBP 95,000", "$120K - $160K", "Not listed", "Not listed"]


CLASSES = [
    ("Software Engineer Intern", "Internship", "Internship"),
    ("Co-op / Coop Developer", "Internship", "Internship"),
    ("Software Engineer, Internal Tools", "Unknown", "Unknown"),
    ("Software Interns", "Unknown", "Unknown"),
    ("Full-time Senior Engineer", "Full-Time", "Senior"),
    ("Fulltime Engineer", "Full-Time", "Unknown"),
    ("Sr. Engineer", "Unknown", "Senior"),
    ("Senior Staff Engineer", "Unknown", "Staff+"),
    ("Solutions Architect", "Unknown", "Staff+"),
    ("Architecture Engineer", "Unknown", "Unknown"),
    ("New grad role with senior mentors", "Unknown", "Unknown"),
    ("Associate Engineer", "Unknown", "Associate"),
    ("Associate Product Designer", "Unknown", "Unknown"),
    ("Analyst, 2+ years", "Unknown", "Mid Level"),
    ("Analyst, 0-2 years", "Unknown", "Mid Level"),
    ("Analyst, 12 years / 5+ years", "Unknown", "Unknown"),
]


def test_classifier_golden(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CLASSES)], "i int, title string")
    got = {r.i: (r.employment_type, r.experience_level) for r in classify(df).collect()}
    for i, (_, et, el) in enumerate(CLASSES):
        assert got[i] == (et, el), CLASSES[i]
