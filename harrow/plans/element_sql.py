"""DuckDB SQL of the element walk and of the scans that use it.

The walk is a recursive query that goes through each page's tags one by one and
carries the open elements as lists, innermost first; extents are read off the
tags at which an element leaves the list.
"""

from __future__ import annotations

from collections.abc import Callable

from harrow.plans import sqltext as S
from harrow.sources.elements import BLOCK, BREAKS, FORMATTING, NAME, SPACES, TOKEN, VOID, attribute_pattern
from harrow.sources.scans import CityRules, StartupRules


def _in(x: str, names) -> str:
    return f"{x} IN ({', '.join(S.q(n) for n in names)})"


def _near(names) -> str:
    return f"coalesce(list_position([{_in('x', names)} FOR x IN w.sn], true), 0)"


def _attribute(tag: str, name: str) -> str:
    p = S.q(attribute_pattern(name))
    return " || ".join(f"regexp_extract({tag}, {p}, {g})" for g in (1, 2, 3))


def text_sql(i: str, ends: str) -> str:
    """Text between two tokens of a row that has ``lined``."""
    joined = f"array_to_string(lined[{i} + 1:{ends}], '')"
    return S.jstrim(f"regexp_replace(regexp_replace({joined}, ' +', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g')")


def elements_sql(html: str) -> str:
    """Common table expressions up to e(page_id, url, i, n, tag, ends, pi, pn, cls, mark, href, txt) and pg."""
    return f"""
p0 AS (SELECT page_id, url, coalesce({html}, '') AS html FROM pages),
p1 AS (SELECT page_id, url, regexp_extract_all(html, {S.q(TOKEN)}) AS tokens, string_split_regex(html, {S.q(TOKEN)}) AS pieces FROM p0),
tk AS (SELECT page_id, i, tokens[i] AS tag, lower(regexp_extract(tokens[i], {S.q(NAME)}, 1)) AS n, starts_with(tokens[i], '</') AS shut,
              regexp_matches(tokens[i], '(?is)^<(?:script|style)\\b') AS raw
       FROM (SELECT page_id, tokens, unnest(range(1, len(tokens) + 1)) AS i FROM p1)),
br AS (SELECT page_id, list({_in('n', BREAKS)} ORDER BY i) AS brk FROM tk GROUP BY page_id),
pg AS (SELECT page_id, url, len(tokens) + 1 AS fin,
              [CASE WHEN k > 1 AND brk[k - 1] THEN chr(10) ELSE '' END || regexp_replace(pieces[k], {S.q(SPACES)}, ' ', 'g')
               FOR k IN range(1, len(pieces) + 1)] AS lined
       FROM p1 LEFT JOIN br USING (page_id)),
tg AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS k FROM tk WHERE n <> '' AND NOT raw AND NOT {_in('n', VOID)}),
walk(page_id, k, i, opened, si, sn, gone) AS (
  SELECT page_id, 0::BIGINT, 0::BIGINT, false, []::BIGINT[], []::VARCHAR[], []::BIGINT[] FROM p1
  UNION ALL
  SELECT page_id, k, i, NOT shut,
         CASE WHEN shut THEN ri ELSE list_concat([i], ri) END, CASE WHEN shut THEN rn ELSE list_concat([n], rn) END, gone
  FROM (SELECT *, CASE WHEN cut > 0 THEN list_concat(si[1:cut - 1], si[cut + 1:]) ELSE si[pop + 1:] END AS ri,
               CASE WHEN cut > 0 THEN list_concat(sn[1:cut - 1], sn[cut + 1:]) ELSE sn[pop + 1:] END AS rn,
               CASE WHEN cut > 0 THEN [si[cut]] ELSE si[1:pop] END AS gone
        FROM (SELECT *, CASE WHEN shut AND pop = 0 AND m > 0 AND {_in('n', FORMATTING)} THEN m
                             WHEN NOT shut AND n = 'a' THEN m ELSE 0 END AS cut
              FROM (SELECT *, CASE WHEN shut THEN CASE WHEN m > 0 AND ({_in('n', BLOCK)} OR wall = 0 OR m < wall) THEN m ELSE 0 END
                                   ELSE greatest(CASE WHEN n = 'li' AND li > 0 AND (lists = 0 OR li < lists) THEN li ELSE 0 END,
                                                 CASE WHEN {_in('n', BLOCK)} AND p > 0 AND (pens = 0 OR p < pens) THEN p ELSE 0 END)
                              END AS pop
                    FROM (SELECT w.page_id, g.k, g.i, g.n, g.shut, w.si, w.sn, coalesce(list_position(w.sn, g.n), 0) AS m,
                                 {_near(BLOCK)} AS wall, {_near(['li'])} AS li, {_near(['ul', 'ol'])} AS lists, {_near(['p'])} AS p,
                                 {_near(['td', 'th', 'table', 'button'])} AS pens
                          FROM walk w JOIN tg g ON g.page_id = w.page_id AND g.k = w.k + 1))))),
en AS (SELECT page_id, unnest(gone) AS e, i AS ends FROM walk),
e AS (SELECT tg.page_id, pg.url, tg.i, tg.n, tg.tag, coalesce(en.ends, pg.fin) AS ends, walk.si[2:] AS pi, walk.sn[2:] AS pn,
             {_attribute('tg.tag', 'class')} AS cls, {_attribute('tg.tag', 'data-id')} AS mark, {_attribute('tg.tag', 'href')} AS href,
             {text_sql('tg.i', 'coalesce(en.ends, pg.fin)')} AS txt
      FROM tg JOIN walk ON walk.page_id = tg.page_id AND walk.k = tg.k AND walk.opened JOIN pg ON pg.page_id = tg.page_id
      LEFT JOIN en ON en.page_id = tg.page_id AND en.e = tg.i)"""


def _first(rule: str, box: str = "c", table: str = "e") -> str:
    return (f"(SELECT min(x.i) FROM {table} x WHERE x.page_id = {box}.page_id AND x.i > {box}.i AND x.i < {box}.ends AND ({rule}))")


def _get(column: str, i: str, table: str = "e") -> str:
    return f"(SELECT max(y.{column}) FROM {table} y WHERE y.page_id = c.page_id AND y.i = {i})"


def _class_with(*parts: str) -> str:
    return "(" + " OR ".join(f"contains(x.cls, {S.q(p)})" for p in parts) + ")"


def _boxes(links: str, fits: str) -> str:
    """(link, box, ends, above) of each link: the nearest ancestor that fits, else the parent, else the page."""
    return f"""
SELECT l.page_id, l.i AS link, coalesce(a.i, 0) AS i, coalesce(a.ends, pg.fin) AS ends, coalesce(a.pi, []) AS pi, coalesce(a.pn, []) AS pn
FROM {links} l JOIN pg ON pg.page_id = l.page_id
LEFT JOIN e a ON a.page_id = l.page_id AND a.i = coalesce(
  (SELECT max(x.i) FROM e x WHERE x.page_id = l.page_id AND list_contains(l.pi, x.i) AND ({fits})), l.pi[1])"""


def city_sql(html: str, rules: CityRules, absolute: Callable[[str, str], str]) -> str:
    job, firm = f"x.n = 'a' AND contains(x.href, {S.q(rules.job_path)})", f"x.n = 'a' AND contains(x.href, {S.q(rules.company_path)})"
    title = (f"x.mark = {S.q(rules.title_mark)} OR ({job}) OR (x.n = 'a' AND (list_contains(x.pn, 'h2') OR list_contains(x.pn, 'h3')))")
    like = S.q(f"(?i:{S.re2(rules.location_like)})")
    return f"""
WITH RECURSIVE {elements_sql(html)},
cards AS (SELECT * FROM e WHERE mark = {S.q(rules.card_mark)} OR (
  n = 'article' AND list_contains(string_split_regex(cls, '[ \\t\\n\\r\\f]+'), 'job-card'))),
leaf AS (SELECT * FROM e WHERE n IN ('span', 'p', 'a') AND ends = i + 1),
c1 AS (SELECT c.*, {_first(title)} AS ti, {_first(f"x.mark = {S.q(rules.company_mark)}")} AS ci,
              {_first(_class_with('salary', 'Salary', 'compensation'))} AS sa,
              {_first(f"x.n = 'span' AND regexp_matches(x.txt, {like})", table='leaf')} AS lo FROM cards c),
c2 AS (SELECT c.*, coalesce({_get('txt', 'c.ti')}, '') AS title FROM c1 c),
c3 AS (SELECT c.*, {_first("x.txt <> '' AND x.txt <> c.title", table='leaf')} AS ot FROM c2 c),
found AS (
  SELECT page_id, url, i, title, coalesce((SELECT max(y.href) FROM e y WHERE y.page_id = c.page_id AND y.i = c.ti AND y.n = 'a'), '') AS href,
         coalesce({_get('txt', 'c.ci')}, {_get('txt', 'c.ot')}, 'Unknown') AS company, coalesce({_get('txt', 'c.sa')}, '') AS salary,
         coalesce({_get('txt', 'c.lo')}, {S.q(rules.location_default)}) AS location, txt AS card_text, true AS from_cards FROM c3 c),
links AS (SELECT * FROM e x WHERE ({job}) AND page_id NOT IN (SELECT page_id FROM cards)),
boxes AS ({_boxes('links', "x.n IN ('li', 'article') OR (x.n = 'div' AND regexp_matches(x.tag, '(?i)\\sdata-id\\b'))")}),
bare AS (
  SELECT l.page_id, l.url, l.i, l.txt AS title, l.href, coalesce({_get('txt', _first(f"x.mark = {S.q(rules.company_mark)} OR ({firm})"))}, 'Unknown') AS company,
         '' AS salary, {S.q(rules.location_no_cards)} AS location, {text_sql('c.i', 'c.ends')} AS card_text, false AS from_cards
  FROM boxes c JOIN links l ON l.page_id = c.page_id AND l.i = c.link JOIN pg ON pg.page_id = c.page_id)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS pos, title, {absolute('url', 'href')} AS href,
       company, salary, location, card_text, from_cards
FROM (SELECT * FROM found UNION ALL SELECT * FROM bare)"""


def startup_sql(html: str, rules: StartupRules, absolute: Callable[[str, str], str], split: Callable[[str], tuple[str, str]]) -> str:
    job, firm = f"x.n = 'a' AND contains(x.href, {S.q(rules.job_path)})", f"x.n = 'a' AND contains(x.href, {S.q(rules.company_path)})"
    row = _class_with(*rules.row_classes) + "".join(f" OR (x.n = {S.q(n)} AND contains(x.cls, {S.q(part)}))" for n, part in rules.row_tags)
    up = f"coalesce((SELECT y.txt FROM firms y WHERE y.page_id = c.page_id AND y.i = {{}}), '')"
    # The nearest ancestor of the box, before any main or body and at most so many up, that holds a company link.
    near = (f"(SELECT arg_min(f.i, a.q * 10000000 + f.i) FROM (SELECT unnest(ups) AS a, unnest(range(1, len(ups) + 1)) AS q) a, firms f "
            "WHERE f.page_id = c.page_id AND list_contains(f.pi, a.a))")
    wall = "coalesce(list_position([x IN ('main', 'body') FOR x IN pn], true) - 1, len(pn))"
    firm_col, context = split("header")
    return f"""
WITH RECURSIVE {elements_sql(html)},
firms AS (SELECT * FROM e x WHERE {firm}),
named AS (SELECT * FROM e x WHERE ({firm}) OR {_class_with(*rules.company_classes)}),
rws AS (SELECT x.*, pi[1:least({wall}, {rules.ancestors})] AS ups FROM e x WHERE {row}),
r1 AS (SELECT c.*, {_first(f"({job}) OR x.n IN ('h2', 'h3') OR {_class_with('title')}")} AS ti, {_first(job)} AS li,
              {_first(_class_with('location', 'remote'))} AS lo, {_first(_class_with('salary', 'compensation'))} AS sa,
              {_first('true', table='named')} AS di, {near} AS ui FROM rws c),
found AS (
  SELECT page_id, url, i, coalesce({_get('txt', 'c.ti')}, '') AS title,
         coalesce((SELECT max(y.href) FROM e y WHERE y.page_id = c.page_id AND y.i = coalesce(c.li, c.ti) AND y.n = 'a'), '') AS href,
         coalesce({_get('txt', 'c.di')}, {up.format('c.ui')}) AS header, coalesce({_get('txt', 'c.lo')}, '') AS location,
         coalesce({_get('txt', 'c.sa')}, '') AS salary, txt AS card_text, true AS from_rows FROM r1 c),
links AS (SELECT * FROM e x WHERE ({job}) AND regexp_matches({absolute('url', 'href')}, {S.q(rules.detail_link)})
            AND page_id NOT IN (SELECT page_id FROM rws)),
boxes AS (SELECT *, pi[1:least({wall}, {rules.ancestors})] AS ups FROM ({_boxes('links', "x.n IN ('div', 'li', 'article')")})),
b1 AS (SELECT c.*, {_first('true', table='named')} AS di, {near} AS ui, {text_sql('c.i', 'c.ends')} AS txt
       FROM boxes c JOIN pg ON pg.page_id = c.page_id),
bare AS (
  SELECT c.page_id, l.url, l.i, coalesce(nullif(ls[1], ''), l.txt) AS title, l.href,
         coalesce({_get('txt', 'c.di')}, {up.format('c.ui')}) AS header, coalesce(ls[3], '') AS location, '' AS salary, c.txt AS card_text,
         false AS from_rows
  FROM (SELECT *, [x FOR x IN [{S.jstrim('x')} FOR x IN string_split(txt, chr(10))] IF x <> ''] AS ls FROM b1) c
  JOIN links l ON l.page_id = c.page_id AND l.i = c.link)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS pos, title, {absolute('url', 'href')} AS href,
       {firm_col} AS company, {context} AS company_context, location, salary, card_text, from_rows
FROM (SELECT * FROM found UNION ALL SELECT * FROM bare)"""
