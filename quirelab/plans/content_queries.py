"""Queries over what pages show, and their SQL, which walks operators and tags one by one."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelab.operators import content_ops as C
from quirelab.sources import tables as T

OPS = ("save", "transform", "paint", "restore", "form", "transform", "paint", "end", "other")


def painted_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of drawing operators told from the lengths of a page's words."""
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    w = T.pages(spark, sf_dir).select("doc_id", "page_no", F.posexplode(F.concat(F.array(F.lit("ab"), F.lit("a")), words)).alias("op_no", "word"))
    n, i = F.char_length("word"), F.col("op_no")
    op = F.get(F.array(*map(F.lit, OPS)), ((n * 5 + i) % len(OPS)).cast("int"))
    scale = F.when(i == 0, 60.0).otherwise(F.get(F.array(F.lit(1.0), F.lit(0.5), F.lit(2.0), F.lit(1.0)), (n % 4).cast("int")))
    turned = n % 7 == 3
    zero = F.lit(0.0)
    matrix = F.array(F.when(turned, zero).otherwise(scale), F.when(turned, scale).otherwise(zero), F.when(turned, -scale).otherwise(zero), F.when(turned, zero).otherwise(scale), (n * 3.0 - 6) / 8, (i % 11 * 2.0) / 8)
    ops = w.select("doc_id", "page_no", "op_no", F.when(i == 0, "transform").otherwise(op).alias("op"), F.when((n % 5 != 4) | (i == 0), matrix).alias("matrix"))
    sizes = w.select("doc_id", "page_no").distinct().withColumns({"width": F.lit(612.0), "height": F.lit(792.0)})
    return C.painted_images(ops, sizes, F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, -1.0, 0.0, 792.0)]))


def _planted(pages: DataFrame) -> DataFrame:
    """Pages with a cookie banner around the menu, a popup that nests another, a framed advert, an advert that is never closed in some, and a side bar."""
    h = F.regexp_replace("html", "<nav>", '<DIV id=CMP-1 title="a>b"><p><nav>')
    h = F.regexp_replace(h, "</nav>", "</nav></DIV><div class='x Popup'><div>in <div class=y>deep</div></div> tail</div><iframe src=\"/a\">f</iframe><p class=\"sidebar z\">s</p><p class=\"Sidebar\">t</p>")
    h = F.regexp_replace(h, "</article>", "</article><ins class=\"adsbygoogle\">i<ins>j</ins></ins><section id='ad-1'><br/><hr class=ad-2>k</section>")
    return pages.select("page_id", F.when(F.col("page_id") % 7 == 0, F.concat(h, F.lit('<div class="ads-x">open<div>rest</div>'))).otherwise(h).alias("html"))


def shown_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without anything hidden, and without adverts and popups alone."""
    pages = _planted(T.table(spark, sf_dir, "pages"))
    md5 = lambda c: F.md5(F.col(c).cast("binary"))
    few = C.without_hidden(pages, "page_id", ("ads", "popups")).select("page_id", md5("html").alias("few_md5"), F.col("n_hidden").alias("n_few"))
    return C.without_hidden(pages, "page_id").select("page_id", md5("html").alias("html_md5"), "n_hidden").join(few, "page_id")


QUERIES = {f.__name__: f for f in (painted_images, shown_html)}


def _hides_sql(features: tuple[str, ...]) -> str:
    attr = lambda n: rf"""regexp_replace(regexp_extract(t, '(?is)^<[^>]*?\s{n}\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), '^["'']|["'']$', '', 'g')"""
    out = [f"contains(lower({attr(a)}), '{p}')" for f in features for a, parts in zip(("class", "id"), C.HIDDEN_PARTS.get(f, ((), ())), strict=True) for p in parts]
    out += [f"name IN ({', '.join(repr(n) for n in C.HIDDEN_NAMES[f].split())})" for f in features if f in C.HIDDEN_NAMES]
    for f in features:
        if f in C.HIDDEN_CLASSES:
            single, element = C.HIDDEN_CLASSES[f]
            out.append(rf"(list_contains(string_split_regex({attr('class')}, '\s+'), '{single}')" + (f" AND name = '{element}')" if element else ")"))
    return " OR ".join(out)


# the element that is being cut, and how many of its name are open in it, as the state
def _shown_sql(features: tuple[str, ...], t: str) -> str:
    return rf"""{t}_h AS (SELECT *, regexp_matches(t, '^<[A-Za-z]') AND ({_hides_sql(features)}) AS hides FROM tn),
{t} AS (SELECT page_id, list_reduce(list_prepend({{'cut': '', 'open': 0::BIGINT, 'out': '', 'n': 0::BIGINT}}, list({{'cut': name, 'open': CASE WHEN hides THEN 10 ELSE 0 END + step, 'out': t, 'n': CASE WHEN alone THEN 1 ELSE 0 END::BIGINT}} ORDER BY pos)), lambda s, x: CASE
    WHEN s.cut <> '' THEN CASE WHEN x.cut = s.cut AND x.open IN (-1, 1, 11) THEN CASE WHEN x.open = -1 AND s.open = 1 THEN {{'cut': '', 'open': 0::BIGINT, 'out': s.out, 'n': s.n}} ELSE {{'cut': s.cut, 'open': s.open + CASE WHEN x.open = -1 THEN -1 ELSE 1 END, 'out': s.out, 'n': s.n}} END ELSE s END
    WHEN x.open >= 9 THEN CASE WHEN x.n = 1 THEN {{'cut': '', 'open': 0::BIGINT, 'out': s.out, 'n': s.n + 1}} ELSE {{'cut': x.cut, 'open': 1::BIGINT, 'out': s.out, 'n': s.n + 1}} END
    ELSE {{'cut': '', 'open': 0::BIGINT, 'out': s.out || x.out, 'n': s.n}} END) AS s FROM {t}_h GROUP BY 1)"""


_TOKEN = C.TOKEN.replace("(?i:script|style|textarea|title)", "(?:script|style|textarea|title)").replace("'", "''")

ORACLE_SQL = {
    "painted_images": f"""WITH RECURSIVE p AS (SELECT conv_id AS doc_id, (turn + 1)::INT AS page_no, ['ab', 'a'] || regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM conversations),
w AS (SELECT doc_id, page_no, unnest(range(len(ws))) AS i, length(unnest(ws)) AS n FROM p),
o AS (SELECT doc_id, page_no, i, CASE WHEN i = 0 THEN 'transform' ELSE {list(OPS)!r}[(n * 5 + i) % {len(OPS)} + 1] END AS op, n % 5 <> 4 OR i = 0 AS has, n % 7 = 3 AS turned, CASE WHEN i = 0 THEN 60 ELSE [1, 0.5, 2, 1][n % 4 + 1] END::DOUBLE AS s, (n * 3 - 6)::DOUBLE / 8 AS e, (i % 11 * 2)::DOUBLE / 8 AS f FROM w),
m AS (SELECT doc_id, page_no, i, op, CASE WHEN has THEN CASE WHEN turned THEN [0, s, -s, 0, e, f] ELSE [s, 0, 0, s, e, f] END END AS n FROM o),
r AS (SELECT doc_id, page_no, -1::BIGINT AS i, '' AS op, [1, 0, 0, 1, 0, 0]::DOUBLE[] AS c, []::DOUBLE[][] AS st FROM p
  UNION ALL SELECT m.doc_id, m.page_no, m.i, m.op, CASE WHEN m.op IN ('restore', 'end') THEN coalesce(st[-1], [1, 0, 0, 1, 0, 0]::DOUBLE[]) WHEN m.op IN ('form', 'transform') AND n IS NOT NULL
      THEN [c[1]*n[1]+c[3]*n[2], c[2]*n[1]+c[4]*n[2], c[1]*n[3]+c[3]*n[4], c[2]*n[3]+c[4]*n[4], c[1]*n[5]+c[3]*n[6]+c[5], c[2]*n[5]+c[4]*n[6]+c[6]] ELSE c END,
    CASE WHEN m.op IN ('save', 'form') THEN list_append(st, c) WHEN m.op IN ('restore', 'end') THEN st[:-2] ELSE st END FROM r JOIN m ON m.doc_id = r.doc_id AND m.page_no = r.page_no AND m.i = r.i + 1),
q AS (SELECT doc_id, page_no, i, [c[5], c[1] + c[5], c[3] + c[5], c[1] + c[3] + c[5]] AS xs, [792 - c[6], 792 - c[2] - c[6], 792 - c[4] - c[6], 792 - c[2] - c[4] - c[6]] AS ys FROM r WHERE op = 'paint'),
b AS (SELECT doc_id, page_no, {{'x0': greatest(0, list_min(xs)), 'x1': least(612, list_max(xs)), 'y0': greatest(0, list_min(ys)), 'y1': least(792, list_max(ys))}} AS b, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY i) AS k FROM q),
g AS (SELECT doc_id, page_no, list_reduce(list_prepend([]::STRUCT(x0 DOUBLE, x1 DOUBLE, y0 DOUBLE, y1 DOUBLE)[], list([b] ORDER BY k)), lambda a, z: CASE WHEN len(list_filter(a, lambda y: abs(y.x0 - z[1].x0) < 1 AND abs(y.x1 - z[1].x1) < 1 AND abs(y.y0 - z[1].y0) < 1 AND abs(y.y1 - z[1].y1) < 1)) > 0 THEN a ELSE a || z END) AS l
  FROM b WHERE b.x1 - b.x0 >= 24 AND b.y1 - b.y0 >= 24 GROUP BY 1, 2)
SELECT doc_id, page_no, (unnest(range(len(l))))::INT AS image_no, unnest(l).x0 AS x0, unnest(l).y0 AS y0, unnest(l).x1 AS x1, unnest(l).y1 AS y1 FROM g""",
    "shown_html": rf"""WITH pl AS (SELECT page_id, replace(html, '<nav>', '<DIV id=CMP-1 title="a>b"><p><nav>') AS h FROM pages),
p2 AS (SELECT page_id, replace(h, '</nav>', '</nav></DIV><div class=''x Popup''><div>in <div class=y>deep</div></div> tail</div><iframe src="/a">f</iframe><p class="sidebar z">s</p><p class="Sidebar">t</p>') AS h FROM pl),
p3 AS (SELECT page_id, replace(h, '</article>', '</article><ins class="adsbygoogle">i<ins>j</ins></ins><section id=''ad-1''><br/><hr class=ad-2>k</section>') || CASE WHEN page_id % 7 = 0 THEN '<div class="ads-x">open<div>rest</div>' ELSE '' END AS h FROM p2),
tk AS (SELECT page_id, regexp_extract_all(h, '{_TOKEN}') AS ts FROM p3), tp AS (SELECT page_id, unnest(range(len(ts))) AS pos, unnest(ts) AS t FROM tk),
tn AS (SELECT *, lower(regexp_extract(t, '^</?([A-Za-z][^\s/>]*)', 1)) AS name, lower(regexp_extract(t, '^</?([A-Za-z][^\s/>]*)', 1)) IN ('', 'script', 'style', 'textarea', 'title', {", ".join(repr(v) for v in C.VOID.split())}) OR t LIKE '%/>' AS alone,
  CASE WHEN lower(regexp_extract(t, '^</?([A-Za-z][^\s/>]*)', 1)) IN ('', 'script', 'style', 'textarea', 'title', {", ".join(repr(v) for v in C.VOID.split())}) OR t LIKE '%/>' THEN 0 WHEN t LIKE '</%' THEN -1 ELSE 1 END AS step FROM tp),
{_shown_sql(("cookies", "popups", "ads", "print"), "a")}, {_shown_sql(("ads", "popups"), "b")}
SELECT a.page_id, md5(a.s.out) AS html_md5, a.s.n AS n_hidden, md5(b.s.out) AS few_md5, b.s.n AS n_few FROM a JOIN b USING (page_id)""",
}
