"""Element extents and the scans that use them, against a small tree builder and golden pages."""

import random
import re

from pyspark.sql import functions as F

from harrow.plans.maintain import page_companies
from harrow.sources import elements as E
from harrow.sources.elements import attribute, text_of, with_elements
from harrow.sources.scans import city_scan, startup_scan


def tree(html):
    """(token, name, end token, ancestors' tokens) of every element: nodes with parent links, one tag after the other."""
    toks = re.findall(E.TOKEN, html)
    parent, name, ends = {0: None}, {0: ""}, {0: len(toks) + 1}
    at = 0  # the node that is open

    def up(node):
        while node:
            yield node
            node = parent[node]

    order, lost = [], set()
    for i, tok in enumerate(toks, 1):
        m = re.match(r"<(/?)([A-Za-z][A-Za-z0-9-]*)", tok)
        if not m or re.match(r"(?i)<(script|style)\b", tok) or m[2].lower() in E.VOID:
            continue
        n, line = m[2].lower(), [x for x in up(at) if x not in lost]

        def leave(node):
            nonlocal at
            for x in line:
                ends[x] = i
                lost.add(x)
                if x == node:
                    break
            at = parent[node]

        def nearest(*names, line=line):
            return next((x for x in line if name[x] in names), None)

        def before(node, wall, line=line):
            return node and (not wall or line.index(node) < line.index(wall))

        if m[1]:
            hit, wall = nearest(n), nearest(*E.BLOCK)
            if hit and (n in E.BLOCK or before(hit, wall)):
                leave(hit)
            elif hit and n in E.FORMATTING:
                ends[hit] = i
                lost.add(hit)
            continue
        goals = [x for x in (n == "li" and before(nearest("li"), nearest("ul", "ol")) and nearest("li"),
                             n in E.BLOCK and before(nearest("p"), nearest("td", "th", "table", "button")) and nearest("p")) if x]
        if goals:
            leave(max(goals, key=line.index))
        elif n == "a" and nearest("a"):
            ends[nearest("a")] = i
            lost.add(nearest("a"))
        parent[i], name[i], ends[i] = at, n, len(toks) + 1
        order.append((i, n, [x for x in up(at) if x not in lost]))
        at = i
    return [(i, n, ends[i], path) for i, n, path in order]


def markup(seed, n):
    rng = random.Random(seed)
    names = ["div", "li", "ul", "p", "a", "b", "span", "h2", "td", "table", "article", "BR", "img", "em", "i"]
    out = []
    for _ in range(n):
        k = rng.random()
        x = rng.choice(names)
        out.append(f"<{x}>" if k < 0.45 else f"</{x}>" if k < 0.8 else rng.choice(
            ["text", " ", "<!-- <div> -->", "<script>'</div>'</script>", "<a href='x>y' class=\"z\">", "<div data-id=q/>", "a < b", "<>", "</ p>"]))
    return "".join(out)


def test_extents_equal_a_tree(spark):
    pages = [markup(s, 60) for s in range(40)] + ["", "text", "</div></p>", "<p>" * 300, "<div>" * 40 + "</div>" * 50, None]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id int, html string")
    rows = with_elements(df).select("page_id", "_elements").collect()
    for r in rows:
        got = [(e.i, e.n, e.ends, [a.i for a in e.path]) for e in r._elements]
        assert got == tree(pages[r.page_id] or ""), pages[r.page_id]


def test_attributes_in_any_quoting(spark):
    tags = ['<a href="x">', "<a href='x'>", "<a href=x>", "<A  HREF = 'x' >", '<a title="href=y" href="x">', "<a data-href='y' href=x class=k>",
            '<a disabled href="x">', "<a>", "<a href>", '<a href="">', "<a title='a > b' href='x'>"]
    df = spark.createDataFrame([(t,) for t in tags], "t string")
    got = [r[0] for r in df.select(attribute(F.col("t"), "href")).collect()]
    assert got == ["x"] * 7 + ["", "", "", "x"]


def test_text_has_lines_at_blocks(spark):
    df = spark.createDataFrame([("<div> One <b>two</b>\n three<br>four<p>five</p>&amp; six<script>no</script></div>",)], "html string")
    got = with_elements(df).select(text_of(F.get("_elements", 0))).first()[0]
    assert got == "One two three\nfour\nfive\n&amp; six"


def scan(spark, f, html, url="https://x.example/jobs/list"):
    rows = f(spark.createDataFrame([(1, url, html)], "page_id int, url string, html string"), base_col="url").collect()
    return [r.asDict() for r in sorted(rows, key=lambda r: r.pos)]


def test_cards_end_at_their_own_tags(spark):
    html = ("<div class='gap-job-cards'><div data-id='job-card'><div><div>x</div></div><a href='/job/1'>Dev</a>"
            "<div class=job-salary>$1<i>20k</i></div></div><span>Remote</span></div><footer>AI engineer</footer>")
    (row,) = scan(spark, city_scan, html)
    assert row["card_text"] == "x\nDev\n$120k" and row["salary"] == "$120k" and row["location"] == "Austin, TX"
    assert row["href"] == "https://x.example/job/1" and row["company"] == "Unknown" and row["from_cards"]


def test_links_without_cards_take_the_container_that_holds_them(spark):
    html = ("<ul><li><a href='/company/a'>A</a><div><a href='/job/1'>One</a></div></li><li><a href='/job/2'>Two</a></li></ul>"
            "<p><a href=/company/p>P</a> <a href=/job/3>Three</a></p><a href='/job/4'>Four</a>")
    rows = scan(spark, city_scan, html)
    assert [(r["title"], r["company"], r["card_text"]) for r in rows[:3]] == [
        ("One", "A", "A\nOne"), ("Two", "Unknown", "Two"), ("Three", "P", "P Three")]
    assert rows[3]["company"] == "A" and not rows[3]["from_cards"]  # its box is the page


def test_company_of_a_startup_row(spark):
    deep = "<div>" * 5 + "<li class='job'><a href='/jobs/9'>Deep</a></li>" + "</div>" * 5
    html = ("<main><section><h2><a href='/companies/a'>Acme (S24) • Robots</a></h2><div class='JobRow'><a href='/jobs/1'>One</a></div></section>"
            "<div class='job-row'><b class='companyName'>Inner</b><h3>Two</h3></div></main>"
            f"<section><a href='/companies/b'>Near</a>{deep}</section><section><a href='/companies/c'>Far</a><div>{deep}</div></section>")
    rows = scan(spark, startup_scan, html)
    assert [(r["title"], r["company"], r["company_context"]) for r in rows] == [
        ("One", "Acme", "Robots"), ("Two", "Inner", ""), ("Deep", "Near", ""), ("Deep", "Unknown", "")]
    assert rows[1]["href"] == "" and rows[0]["href"] == "https://x.example/jobs/1"


def test_detail_links_take_title_and_location_from_lines(spark):
    html = ("<article><a href='/companies/a'>Acme</a><div>Engineer<br>Full time<p>Lyon, FR</p><a href='/jobs/12'>Apply</a></div></article>"
            "<a href='/jobs/list'>All</a>")
    (row,) = scan(spark, startup_scan, html)
    assert (row["title"], row["location"], row["company"], row["from_rows"]) == ("Engineer", "Lyon, FR", "Acme", False)


def test_a_blank_company_does_not_hide_a_found_one(spark):
    pages = spark.createDataFrame([("u", "<p>nothing</p>"), ("u", "<a href='/company/x'>Acme</a><h1>T</h1>"), ("u", None),
                                   ("u", "<b data-id=company-title>Beta</b>"), ("v", "<h1>Role at Firm (S24)</h1>")], "url string, html string")
    got = {r["_url"]: (r.line_rule, r.at_rule) for r in page_companies(pages).collect()}
    assert got["u"] == ("Acme", "") and got["v"][1] == "Firm"
