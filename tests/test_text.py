from pyspark.sql import functions as F

from columns import one_col
from harrow.functions.regex import required_literals, to_java, to_re2
from harrow.functions.text import collapse_ws, contains_any, fingerprint, jstrim, matches, strip_tags


def test_fingerprint_golden(spark):
    df = spark.createDataFrame([(" Acme", "Engineer\t", "Austin, TX"), (None, None, None)],
                               "company string, title string, location string")
    got = [r[0] for r in df.select(fingerprint()).collect()]
    assert got[0] == "99c8a84830cc880c2c4760802622e5fb541f8aff5d2b63bb72f73f167da8b51f"
    import hashlib
    assert got[1] == hashlib.sha256(b"||").hexdigest()


def test_jstrim_strips_unicode_spaces(spark):
    got = one_col(spark, ["\u00a0 A\t", " B\ufeff", "\u3000C D\u2028"], jstrim)
    assert got == ["A", "B", "C D"]


def test_collapse_and_strip_tags(spark):
    got = one_col(spark, ["<p>a</p>  <b>b</b>\n"], lambda c: collapse_ws(strip_tags(c)))
    assert got == ["a b"]


def test_contains_any_semantics(spark):
    vals = ["Software Engineer", "Chrome dev", ""]
    assert one_col(spark, vals, lambda c: contains_any(c, [])) == [False, False, False]
    assert one_col(spark, vals, lambda c: contains_any(c, [""])) == [True, True, True]
    assert one_col(spark, vals, lambda c: contains_any(c, ["HR"])) == [False, True, False]
    many = [f"zz{i}" for i in range(100)] + ["engineer"]
    assert one_col(spark, vals, lambda c: contains_any(c, many)) == [True, False, False]


def test_word_boundary_is_ascii(spark):
    # JavaScript's \b treats accented letters as non-word characters.
    assert one_col(spark, ["éai é", "chair", "AI lab"], lambda c: matches(c, r"\bai\b")) == [
        True, False, True]


def test_space_class_includes_nbsp(spark):
    assert one_col(spark, ["full\u00a0time", "fulltime", "full-time"],
                   lambda c: matches(c, r"\bfull[\s-]?time\b")) == [True, True, True]


def test_translation_dialects():
    assert to_re2(r"\bai\b") == r"\bai\b"
    assert "(?<!" in to_java(r"\bai\b")
    assert required_literals(r"\bco-?op\b") == ["co"]
    assert required_literals(r"\b1\+?\s+years?\b") == ["year"]
    assert required_literals(r"[a-z]+") is None
