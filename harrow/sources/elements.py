"""Extents of HTML elements, in built-in expressions within the page row.

A page is cut into *tokens* (tags, comments, whole script and style elements) and
the *pieces* of text between them.  One walk over the tags keeps the open elements
as a stack and gives each element the token that ends it and its ancestors, so
"inside this card", "nearest enclosing container" and "at most six ancestors up"
are lookups.

The walk follows the rules of the HTML standard as far as listings need them:

* void elements have no content; a self-closing slash means nothing else;
* a closing tag ends the nearest open element of its name and what is open inside
  it; without one it is ignored;
* a closing tag of an inline element does not reach out of a block: of a formatting
  element (``a``, ``b`` ...) it ends just that element, of another it is ignored;
* ``li`` ends an open ``li`` of the same list, a block ends an open ``p``, ``a`` ends
  an open ``a``; whatever is open at the end of the page ends there.

This is no DOM: there are no nodes, selectors are Column predicates, and nothing
but start, end and ancestors of an element is known.  The stack is one string, in
which the nearest element of a name is a substring search; a search in an array
would evaluate a lambda for each open element, name by name.  The walk appends to
short arrays (the tags are taken in about sqrt(n) chunks), so a page of n tags
costs n * sqrt(n) small copies and not n * n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions.regex import js_space_run
from harrow.functions.text import jstrim, let

# Names of the HTML standard.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
BLOCK = ("address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
         "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "html",
         "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead",
         "tr", "ul")
FORMATTING = ("a", "b", "big", "code", "em", "font", "i", "nobr", "s", "small", "strike", "strong", "tt", "u")

TAG = r"""</?[A-Za-z][A-Za-z0-9-]*[^'">]*(?:(?:"[^"]*"|'[^']*')[^'">]*)*>"""
TOKEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<![a-z][^>]*>|" + TAG
NAME = r"^</?([A-Za-z][A-Za-z0-9-]*)"
SPACES = r"[ \t\n\r\f]+"
#: Starting a line: blocks (opening or closing) and line breaks.
BREAKS = (*BLOCK, "br")

#: What a tag does: the elements it ends, and the open elements around one that it opens (null otherwise).
RECORD = "struct<i:int,ended:string,around:string>"


def _before_value(name: str) -> str:
    value = r"""(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""
    other = rf"""(?:\s+[^\s=>"'/]+(?:\s*=\s*{value})?|\s*/)"""
    return rf"""(?is)^<[a-z][a-z0-9-]*{other}*?\s+{name}\s*=\s*"""


def attribute_pattern(name: str) -> str:
    """Value of an attribute in a tag, quoted either way or not at all (groups 1 to 3); other values are passed whole."""
    return _before_value(name) + r"""(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of an opening tag, '' without one; read once, quotes and all."""
    whole = F.regexp_extract(tag, _before_value(name) + r"""("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    bare = let(whole, lambda v: F.when(v.startswith('"') | v.startswith("'"), v.substr(F.lit(2), F.length(v) - 2)).otherwise(v))
    return F.when(F.lower(tag).contains(name), bare).otherwise(F.lit(""))


def _near(stack: Column, *names: str) -> Column:
    """Place in the stack of the nearest open element of these names, null without one."""
    places = [F.nullif(F.instr(stack, f"|{n}:"), F.lit(0)) for n in names]
    return F.least(*places) if len(places) > 1 else places[0]


def _step(acc: Column, t: Column) -> Column:
    """One tag ``t`` (i, n, shut, block, formatting, entry, mark): the new stack and the record of the tag.

    The stack is a string of entries ``|name:i;``, innermost first, those of blocks
    behind ``#``.  A move is 0, the place of the last entry to end with all before
    it, or the negative place of the one entry to end.
    """
    stack = acc["stack"]

    def reach(inner: Column, walls: Column) -> Column:
        return let(inner, lambda m: F.when(m.isNotNull() & F.coalesce(m < walls, F.lit(True)), m).otherwise(F.lit(0)))

    def on_close(m: Column) -> Column:
        return F.when(m == 0, F.lit(0)).when(t["block"], m).otherwise(let(F.instr(stack, "#"), lambda wall: F.when(
            (wall == 0) | (m < wall), m).when(t["formatting"], -m).otherwise(F.lit(0))))

    in_list = F.when(t["n"] == "li", reach(_near(stack, "li"), _near(stack, "ul", "ol"))).otherwise(F.lit(0))
    on_open = F.when(t["block"], F.greatest(in_list, reach(_near(stack, "p"), _near(stack, "td", "th", "table", "button")))).when(
        t["n"] == "a", -F.coalesce(_near(stack, "a"), F.lit(0))).otherwise(F.lit(0))
    move = F.when(t["shut"], let(F.instr(stack, t["mark"]), on_close)).otherwise(on_open)

    def moved(m: Column) -> Column:
        def to(end: Column) -> Column:
            rest = stack.substr(end + 1, F.length(stack))
            ended = F.when(m > 0, stack.substr(F.lit(1), end)).when(m < 0, stack.substr(-m, end + m + 1)).otherwise(F.lit(""))
            left = F.when(m > 0, rest).when(m < 0, F.concat(stack.substr(F.lit(1), -m - 1), rest)).otherwise(stack)
            return let(left, lambda l: F.struct(
                F.when(t["shut"], l).otherwise(F.concat(t["entry"], l)).alias("stack"),
                F.concat(acc["out"], F.array(F.struct(t["i"].alias("i"), ended.alias("ended"),
                                                      F.when(~t["shut"], l).alias("around")))).alias("out")))

        return F.when(t["shut"] & (m == 0), acc).otherwise(let(
            F.when(m == 0, F.lit(0)).otherwise(F.position(F.lit(";"), stack, F.abs(m))), to))

    return let(move, moved)


def _walk(tags: Column) -> Column:
    """What is open at the end (stack) and the records of all tags that open or end something (outs), in chunks."""
    none = F.array().cast(f"array<{RECORD}>")
    size = F.greatest(F.ceil(F.sqrt(F.size(tags))).cast("int"), F.lit(1))
    chunks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(tags), F.lit(1)), size), lambda at: F.slice(tags, at, size))

    def chunk(acc: Column, part: Column) -> Column:
        done = F.reduce(part, F.struct(acc["stack"].alias("stack"), none.alias("out")), _step)
        return let(done, lambda d: F.struct(d["stack"].alias("stack"), F.concat(acc["outs"], F.array(d["out"])).alias("outs")))

    start = F.struct(F.lit("").alias("stack"), F.array().cast(f"array<array<{RECORD}>>").alias("outs"))
    return F.reduce(chunks, start, chunk)


def _tokens_of(entries: Column) -> Column:
    """Tokens at which the elements of stack entries open."""
    return F.transform(F.filter(F.split(entries, ";"), lambda e: e != ""), lambda e: F.substring_index(e, ":", -1).cast("int"))


def with_elements(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Adds ``_elements``, ``_lined`` and ``_end`` to pages.

    ``_elements``: (i, n, tag, ends, path, cls, mark, href) of every element in
    the order of their opening tags: the token it opens at, its lower-case name,
    the tag, the token that ends it, its ancestors (i, n) nearest first, and its
    class, data-id and href ('' without).  ``_lined``: the text after each token,
    white space collapsed, behind a line break if the token starts a line.
    ``_end``: the token number at which the page ends.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    pages = pages.withColumns({"_tokens": F.regexp_extract_all(html, F.lit(TOKEN), 0), "_pieces": F.split(html, TOKEN, -1)})
    named = F.transform("_tokens", lambda t, i: F.struct(
        (i + 1).cast("int").alias("i"), F.lower(F.regexp_extract(t, NAME, 1)).alias("n"), t.startswith("</").alias("shut"),
        t.alias("tag")))
    raw = lambda t: (t["n"].startswith("script") | t["n"].startswith("style")) & t["tag"].rlike(r"(?is)^<(?:script|style)\b")
    pages = pages.withColumn("_named", named).withColumn("_end", F.size("_tokens") + 1)
    tags = F.transform(F.filter("_named", lambda t: (t["n"] != "") & ~raw(t) & ~t["n"].isin(*VOID)), lambda t: F.struct(
        t["i"], t["n"], t["shut"], t["n"].isin(*BLOCK).alias("block"), t["n"].isin(*FORMATTING).alias("formatting"),
        F.concat(F.when(t["n"].isin(*BLOCK), F.lit("#|")).otherwise(F.lit("|")), t["n"], F.lit(":"), t["i"].cast("string"),
                 F.lit(";")).alias("entry"), F.concat(F.lit("|"), t["n"], F.lit(":")).alias("mark")))
    pages = pages.withColumn("_tags", tags).withColumn("_walked", _walk(F.col("_tags"))).withColumn(
        "_records", F.flatten("_walked.outs"))
    still = F.transform(_tokens_of(F.col("_walked.stack")), lambda i: F.struct(i.alias("i"), F.col("_end").alias("ends")))
    closed = F.flatten(F.transform(F.filter("_records", lambda r: r["ended"] != ""), lambda r: F.transform(
        _tokens_of(r["ended"]), lambda i: F.struct(i.alias("i"), r["i"].alias("ends")))))
    pages = pages.withColumns({"_opened": F.filter("_records", lambda r: r["around"].isNotNull()),
                               "_closed": F.array_sort(F.concat(closed, still))})
    path = lambda o: F.transform(_tokens_of(o["around"]), lambda i: F.struct(
        i.alias("i"), F.get("_named", i - 1)["n"].alias("n")))
    both = F.zip_with("_opened", "_closed", lambda o, c: let(F.get("_named", o["i"] - 1), lambda t: F.struct(
        o["i"].alias("i"), t["n"].alias("n"), t["tag"].alias("tag"), c["ends"].alias("ends"), path(o).alias("path"),
        attribute(t["tag"], "class").alias("cls"), attribute(t["tag"], "data-id").alias("mark"),
        attribute(t["tag"], "href").alias("href"))))
    # The text before the first token, then the text after each.
    lined = F.transform("_pieces", lambda p, k: F.concat(
        F.when((k > 0) & F.get("_named", F.greatest(k - 1, F.lit(0)))["n"].isin(*BREAKS), F.lit("\n")).otherwise(F.lit("")),
        F.regexp_replace(p, SPACES, " ")))
    return (pages.withColumns({"_elements": both, "_lined": lined})
            .drop("_tokens", "_pieces", "_named", "_tags", "_walked", "_records", "_opened", "_closed"))


def rendered(joined: Column) -> Column:
    """Lines of joined ``_lined`` pieces: spaces collapsed and trimmed, empty lines gone; no pattern runs for nothing."""
    def at_end(t: Column) -> Column:
        return F.concat(t.substr(1, 1), t.substr(-1, 1)).rlike(js_space_run())

    single = let(joined, lambda t: F.when(t.contains("  "), F.regexp_replace(t, " +", " ")).otherwise(t))
    broken = let(single, lambda t: F.when(t.contains("\n"), F.regexp_replace(t, " ?\n[ \n]*", "\n")).otherwise(t))
    return let(F.trim(broken, F.lit(" \n")), lambda t: F.when(at_end(t), jstrim(t)).otherwise(t))


def text_of(box: Column) -> Column:
    """Text of an element, as a browser's ``innerText`` (lines at blocks and breaks), trimmed."""
    return rendered(F.array_join(F.slice("_lined", box["i"] + 1, box["ends"] - box["i"]), ""))


def inside(elements: Column, box: Column) -> Column:
    """The elements inside a box (not itself), in document order."""
    return F.filter(elements, lambda e: (e["i"] > box["i"]) & (e["i"] < box["ends"]))


def first_inside(elements: Column, box: Column) -> Column:
    return F.get(inside(elements, box), 0)


def is_leaf(element: Column) -> Column:
    """Whether an element has no child: what follows its tag is text up to its own closing tag."""
    return element["ends"] == element["i"] + 1
