"""Personal data by base rules and bootstrapped contextual extraction, in DataFrame operations only.

Base entities (email, ip, card, phone) are found by fixed rules over whole
texts.  They are the seeds of a bootstrap over *tokens* (runs without white
space that hold a digit or an at sign): a token's *patterns* are its shape
with the word to its left, and its shape with the word to its right; its
*instance* is its value.  Over all documents, counts of (pattern, instance) form
a graph that is scored in rounds:

* an instance starts at the share of its occurrences that base entities cover,
  by kind;
* a pattern's confidence in a kind is the mean score of its occurrences, with
  one unknown occurrence added;
* a pattern that at least ``SUPPORT`` distinct instances with a base entity
  speak for, and whose confidence reaches ``CONFIDENCE``, lends its confidence
  to all its instances, and the next round starts from those scores.

After ``ROUNDS`` rounds a token outside the base entities becomes an entity of a
kind when both its patterns are confident of that kind, together with directly
neighbouring tokens whose pattern towards it, or whose value, is.  Base spans
always stay.

The rules as regular expressions avoid quadratic scans: a match can only begin
where its run of characters begins (or where the last match ended), and
repetitions that cannot give back are possessive; both leave the leftmost
matches as they are.

Defined results: null text counts as empty and has no entity; offsets are code
points, ends exclusive; repeated rows give repeated rows; rows with the same
text share nothing but the counts; a null id is kept; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.llm.common import to_scratch

KINDS = ["email", "ip", "card", "phone"]
_LOCAL = "[A-Za-z0-9._%+-]"
RULES = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Cheap test that a text can hold an entity at all.
NEEDS = {"email": "text like '%@%'", "ip": "text rlike '[0-9][.][0-9]'", "card": "text rlike '[0-9][ -]?[0-9]'",
         "phone": "text like '%+%'"}
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
SUPPORT, CONFIDENCE, ROUNDS = 5, 0.95, 3
_STEP = 128
_SPAN = "array<struct<start: int, end: int, value: string>>"


def _sql(pattern: str) -> str:
    return "r'" + pattern.replace("'", "''") + "'"


def _located(rows: DataFrame, name: str, pattern: str, needs: str) -> DataFrame:
    """Adds ``s_<name>``: the pattern's leftmost matches with offsets.

    Offsets are prefix sums over the pieces between matches, taken in steps of
    _STEP matches so that a text with many matches stays linear.
    """
    m, p, n, b = f"m_{name}", f"p_{name}", f"n_{name}", f"b_{name}"
    rx = _sql(pattern)
    rows = rows.withColumn(m, F.expr(f"case when {needs} then regexp_extract_all(text, {rx}, 0) "
                                     "else cast(array() as array<string>) end"))
    rows = rows.withColumn(p, F.expr(
        f"case when size({m}) > 0 then transform(split(text, {rx}, -1), x -> char_length(x)) end"))
    rows = rows.withColumn(n, F.expr(f"zip_with({m}, slice({p}, 1, size({m})), (x, y) -> char_length(x) + y)"))
    rows = rows.withColumn(b, F.expr(
        f"aggregate(sequence(0, (size({m}) - 1) div {_STEP}), array(0), (acc, c) -> concat(acc, array("
        f"element_at(acc, -1) + aggregate(slice({n}, cast(c * {_STEP} + 1 as int), {_STEP}), 0, (x, y) -> x + y))))"))
    rows = rows.withColumn(f"s_{name}", F.expr(f"""
        case when size({m}) > 0 then transform(
          transform(sequence(0, size({m}) - 1), i -> struct(i as i,
            element_at({b}, cast(i div {_STEP} + 1 as int))
            + aggregate(slice({n}, cast((i div {_STEP}) * {_STEP} + 1 as int), i % {_STEP}), 0, (x, y) -> x + y)
            + {p}[i] as start)),
          x -> struct(x.start as start, x.start + char_length({m}[x.i]) as end, {m}[x.i] as value))
        else cast(array() as {_SPAN}) end"""))
    return rows.drop(p, n, b)


def _luhn(digits: str) -> str:
    """SQL: the digits pass the Luhn check."""
    return (f"aggregate(sequence(1, char_length({digits})), 0, (acc, i) -> acc + "
            f"case when (char_length({digits}) - i) % 2 = 0 then cast(substr({digits}, i, 1) as int) "
            f"else cast(substr({digits}, i, 1) as int) * 2 - case when substr({digits}, i, 1) >= '5' then 9 else 0 end "
            f"end) % 10 = 0")


VALID = {
    "email": "true",
    "ip": f"s.value rlike {_sql(rf'^{_PART}(?:[.]{_PART}){{3}}$')}",
    "card": _luhn("regexp_replace(s.value, '[^0-9]', '')"),
    "phone": "char_length(regexp_replace(s.value, '[^0-9]', '')) between 9 and 15",
}


def base_entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row_key, spans by kind (columns email, ip, card, phone) and tokens of every whole text.

    A token has its span without closing punctuation, value, left and right
    word, and the kind of the base entity that covers it (null: none).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("row_key", F.xxhash64("doc_id", "text"))
    for kind in KINDS:
        rows = _located(rows, kind, RULES[kind], NEEDS[kind])
        rows = rows.withColumn(kind, F.expr(f"filter(s_{kind}, s -> {VALID[kind]})")).drop(f"m_{kind}", f"s_{kind}")
    rows = _located(rows, "token", TOKEN, "text rlike '[0-9@]'")
    rows = rows.withColumn("between", F.expr(
        f"case when size(m_token) > 0 then transform(split(text, {_sql(TOKEN)}, -1), "
        r"x -> translate(x, '\n\t\r\f\u000b ', '      ')) end"))
    closing = "'.,;:!?\"'')]}>'"
    covered = " ".join(f"when exists({k}, b -> b.start < s.end and b.end > s.start) then '{k}'" for k in KINDS)
    side = lambda x, word: f"case when {x} <> '' then {word} else '' end"
    tokens = f"""
        transform(s_token, (s, i) -> struct(
          s.start as start, s.start + char_length(rtrim({closing}, s.value)) as end,
          rtrim({closing}, s.value) as value,
          {side("rtrim(between[i])", "substring_index(rtrim(between[i]), ' ', -1)")} as left,
          {side("ltrim(between[i + 1])", "substring_index(ltrim(between[i + 1]), ' ', 1)")} as right,
          i as i))"""
    rows = rows.withColumn("found", F.expr(tokens))
    # The word next to a token may be a token itself; single characters say nothing.
    rows = rows.withColumn("tokens", F.expr(f"""
        transform(filter(found, s -> char_length(s.value) > 1), s -> struct(
          s.i as i, s.left = '' and s.i > 0 as follows, s.start as start, s.end as end, s.value as value,
          case when s.left = '' and s.i > 0 then found[s.i - 1].value else s.left end as left,
          case when s.right = '' and s.i + 1 < size(found) then found[s.i + 1].value else s.right end as right,
          case {covered} end as kind))"""))
    return rows.select("doc_id", "row_key", *KINDS, "tokens")


def _shape(c: Column) -> Column:
    """Letters as runs of a or A, digits as 9 each; long ones by their hash."""
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\p{Lu}+", "A"), r"\p{Ll}+", "a"), "[0-9]", "9")
    return F.when(F.length(s) > 64, F.md5(s)).otherwise(s)


def _word(c: Column) -> Column:
    w = F.lower(F.regexp_replace(c, "[0-9]", "9"))
    return F.when(F.length(w) > 64, F.md5(w)).otherwise(w)


def occurrences(base: DataFrame) -> DataFrame:
    """One row for each token with its two patterns."""
    rows = base.select("row_key", F.explode("tokens").alias("t")).select("row_key", "t.*")
    shape = _shape(F.col("value"))
    return rows.select("row_key", "i", "follows", "start", "end", "kind",
                       F.when(F.length("value") > 64, F.md5("value")).otherwise(F.col("value")).alias("instance"),
                       F.concat(F.lit("l "), _word(F.col("left")), F.lit(" "), shape).alias("left_pattern"),
                       F.concat(F.lit("r "), shape, F.lit(" "), _word(F.col("right"))).alias("right_pattern"))


def _by_kind(scores: DataFrame, name: str, least: float) -> DataFrame:
    """(name, kind) of the scores of at least ``least``, from one column for each kind."""
    return (scores.select(name, F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col(k).alias("score")) for k in KINDS])).alias("x"))
        .filter((F.col("x.score") >= least) & (F.col("x.score") > 0)).select(name, "x.kind"))


def confident(found: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE,
              rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(pattern, kind) after the rounds, and (instance, kind) of values that occur ``support`` times and
    are covered by base entities nearly always; ``found`` as from ``occurrences``."""
    graph = to_scratch(
        found.select("instance", "kind", F.explode(F.array("left_pattern", "right_pattern")).alias("pattern"))
        .groupBy("pattern", "instance").agg(
            F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("kind") == k).alias(k) for k in KINDS]), "graph")
    instances = graph.groupBy("instance").agg(F.sum("n").alias("all"), *[F.sum(k).alias(k) for k in KINDS])
    scores = to_scratch(instances.select(
        "instance", "all", *[(F.col(k) / F.col("all")).alias(k) for k in KINDS]), "instances")
    # An occurrence counts once in either pattern, so twice here.
    values = _by_kind(scores.filter(F.col("all") >= 2 * support), "instance", confidence)
    scores = scores.drop("all")
    by_pattern = None
    for _ in range(rounds):
        weighed = graph.select("pattern", "instance", "n", *[F.col(k).alias(f"seen_{k}") for k in KINDS]).join(
            scores, "instance")
        sums = weighed.groupBy("pattern").agg(
            F.sum("n").alias("n"), *[F.sum(F.col("n") * F.col(k)).alias(k) for k in KINDS],
            *[F.count_if(F.col(f"seen_{k}") > 0).alias(f"support_{k}") for k in KINDS])
        by_pattern = to_scratch(sums.select("pattern", *[
            F.when((F.col(f"support_{k}") >= support) & (F.col(k) / (F.col("n") + 1) >= confidence),
                   F.col(k) / (F.col("n") + 1)).otherwise(0.0).alias(k) for k in KINDS])
            .filter(" or ".join(f"{k} > 0" for k in KINDS)), "patterns")
        lent = (graph.select("pattern", "instance").join(by_pattern, "pattern").groupBy("instance")
                .agg(*[F.max(k).alias(f"lent_{k}") for k in KINDS]))
        scores = to_scratch(scores.join(lent, "instance", "left").select(
            "instance", *[F.greatest(F.col(k), F.coalesce(F.col(f"lent_{k}"), F.lit(0.0))).alias(k) for k in KINDS]),
            "instances")
    return _by_kind(by_pattern, "pattern", confidence), values


def discovered(found: DataFrame, patterns: DataFrame, values: DataFrame) -> DataFrame:
    """(row_key, kind, start, end) of entities outside the base ones.

    A token with confident patterns on both sides is one; a neighbour directly
    before or behind it belongs to it when its pattern on that side, or its
    value, is confident of the same kind.
    """
    left = patterns.select(F.col("pattern").alias("left_pattern"), F.col("kind").alias("new_kind"))
    right = patterns.select(F.col("pattern").alias("right_pattern"), F.col("kind").alias("new_kind"))
    free = found.filter("kind is null").select("row_key", "i", "follows", "start", "end", "left_pattern",
                                               "right_pattern", "instance")
    value = values.select("instance", F.col("kind").alias("new_kind"))
    names = ["row_key", "new_kind", "i", "follows", "start", "end"]
    from_left = free.join(left, "left_pattern").select(*names).distinct()
    from_right = free.join(right, "right_pattern").select(*names).distinct()
    from_value = free.join(value, "instance").select(*names).distinct()
    sides = (from_left.withColumn("l", F.lit(True)).join(from_right.withColumn("r", F.lit(True)), names, "full")
             .join(from_value.withColumn("v", F.lit(True)), names, "full")
             .select(*names, *[F.coalesce(c, F.lit(False)).alias(c) for c in "lrv"]))
    # Tokens of one text and kind in their order: a handful of rows each.
    line = Window.partitionBy("row_key", "new_kind").orderBy("i", "start")
    before = F.coalesce(F.lag("i").over(line) == F.col("i") - 1, F.lit(False)) & F.col("follows")
    behind = F.coalesce((F.lead("i").over(line) == F.col("i") + 1) & F.lead("follows").over(line), F.lit(False))
    taken = sides.withColumn("core", F.col("l") & F.col("r")).withColumn("before", before).withColumn("behind", behind)
    taken = taken.withColumn("taken", F.col("core")
                             | ((F.col("l") | F.col("v")) & F.col("before") & F.lag("core", 1, False).over(line))
                             | ((F.col("r") | F.col("v")) & F.col("behind") & F.lead("core", 1, False).over(line))).filter("taken")
    first = ~(F.coalesce(F.lag("i").over(line) == F.col("i") - 1, F.lit(False)) & F.col("follows"))
    return (taken.withColumn("piece", F.sum(first.cast("int")).over(line)).groupBy("row_key", "new_kind", "piece")
            .agg(F.min("start").alias("start"), F.max("end").alias("end"))
            .select("row_key", F.col("new_kind").alias("kind"), "start", "end"))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT,
                  confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, base and added spans (arrays of kind, start, end) of every whole text."""
    base = to_scratch(base_entities(docs, id_col, text_col), "entities")
    found = to_scratch(occurrences(base), "occurrences")
    added = (discovered(found, *confident(found, support, confidence, rounds)).groupBy("row_key")
             .agg(F.collect_list(F.struct("kind", "start", "end")).alias("added")))
    spans = F.expr("concat(" + ", ".join(
        f"transform({k}, s -> struct('{k}' as kind, s.start as start, s.end as end))" for k in KINDS) + ")")
    none = F.expr("cast(array() as array<struct<kind: string, start: int, end: int>>)")
    return (base.select("doc_id", "row_key", spans.alias("base")).join(added, "row_key", "left")
            .select("doc_id", "base", F.coalesce("added", none).alias("added")))


def span_report(spans: DataFrame) -> DataFrame:
    """doc_id, number of base spans by kind, base_sha256 and all spans as text."""
    order = "array_position(array('email', 'ip', 'card', 'phone'), x.kind)"
    text = lambda c: (f"concat_ws(',', transform(array_sort(transform({c}, x -> struct({order} as o, x.start as start, "  # noqa: E731
                      "x.end as end, x.kind as kind))), y -> concat(y.kind, ':', y.start, ':', y.end)))")
    return spans.select(
        "doc_id", *[F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.expr(text("base")), 256).alias("base_sha256"),
        F.expr(text("concat(base, added)")).alias("spans"),
        F.expr("cast(size(added) as bigint)").alias("n_added"))
