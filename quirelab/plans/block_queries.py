"""Queries over columns, tables and paragraphs of set pages, and their SQL.

The SQL counts at every whole x where the library sweeps over events, and walks rows one by one (recursive tables) where the library folds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelab.operators import block_ops as B
from quirelab.sources import tables as T
from quirelab.sources.store import written

PAGE = ["doc_id", "page_no"]
LEFT, RIGHT = 72.0, 540.0


def _fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.set_fragments(T.table(spark, sf_dir, "documents"))


def page_gutters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.gutters(_fragments(spark, sf_dir), PAGE)


def page_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of set pages; every other page of two columns has an image across them, every other page of three one in its first column."""
    frags = written(B.text_bounds(_fragments(spark, sf_dir).select(*PAGE, "frag_no", "n_chars", "x0", "x1", "top", "bottom"), PAGE))  # no texts
    image = F.when(F.col("doc_id") % 8 == 1, F.struct(F.lit(100.0).alias("x0"), F.lit(500.0).alias("x1"))).when(F.col("doc_id") % 8 == 2, F.struct(F.lit(80.0).alias("x0"), F.lit(200.0).alias("x1")))
    page = frags.groupBy(*PAGE).agg(F.first("left").alias("left"), F.first("right").alias("right")).withColumn("image", image).filter("image IS NOT NULL")
    images = page.select(*PAGE, F.lit(100_000).cast("long").alias("frag_no"), F.lit(None).cast("long").alias("n_chars"), "image.x0", "image.x1", F.lit(230.5).alias("top"), F.lit(262.0).alias("bottom"), "left", "right")
    items = frags.select(images.columns).unionByName(images)
    return B.split_regions(items, PAGE).select(*PAGE, "frag_no", "region_no", "left", "right", "columns")


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page_no, frags, tables) of set pages."""
    pages = T.set_pages(T.table(spark, sf_dir, "documents")).filter("doc_id IS NOT NULL")
    return B.with_tables(pages.withColumn("frags", B.numbered_rows(F.col("frags"))), F.lit(LEFT), F.lit(RIGHT))


def table_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    zone = lambda t: F.struct(t["first_row"].alias("first_row"), t["last_row"].alias("last_row"), F.size(t["cols"]).cast("long").alias("n_cols"))
    return _tables(spark, sf_dir).select(*PAGE, B.rows_of_tables(zone))


def table_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = _tables(spark, sf_dir).select(*PAGE, B.rows_of_tables(lambda t: F.struct(t["first_row"].alias("first_row"), t["cols"].alias("cols"))))
    return zones.select(*PAGE, "first_row", F.posexplode("cols").alias("col_no", "c")).select(*PAGE, "first_row", F.col("col_no").cast("long").alias("col_no"), "c.x0", "c.x1")


def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.cells_of(_tables(spark, sf_dir), PAGE)


def paragraph_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of set pages; every eleventh line begins with a marker, every tenth is centred."""
    rows = B.rows_of_region(B.with_rows(_fragments(spark, sf_dir), PAGE), PAGE)
    r = F.col("row_no")
    text = F.when(r % 11 == 5, F.concat(F.when(r % 2 == 0, "• ").otherwise("1. "), "text")).otherwise(F.col("text"))
    lines = rows.withColumn("text", text).withColumn("x1", F.when(r % 10 == 9, 362.0).otherwise(F.col("x1"))).withColumn("x0", F.when(r % 10 == 9, 250.0).otherwise(F.col("x0")))
    out = B.paragraphs(lines, PAGE, F.lit(LEFT), F.lit(RIGHT))
    return out.select(*PAGE, "para_no", "first_row", "n_lines", F.md5(F.col("text").cast("binary")).alias("text_md5"), "list", "centered", "indent")


QUERIES = {f.__name__: f for f in (page_gutters, page_regions, table_zones, table_columns, table_cells, paragraph_groups)}

_FRAGMENTS = r"""wd AS (SELECT doc_id, doc_id % 4 AS style, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents),
li AS (SELECT doc_id, style, ws, unnest(range((len(ws) + 5) // 6)) AS i FROM wd WHERE len(ws) > 0),
lk AS (SELECT *, i % 80 AS k, style = 0 AND i % 80 // 8 % 2 = 1 AS tb FROM li),
lc AS (SELECT *, CASE WHEN NOT tb THEN [ws[i*6+1:i*6+6]] WHEN k % 8 = 3 THEN [ws[i*6+3:i*6+4]] ELSE [ws[i*6+1:i*6+2], ws[i*6+3:i*6+4], ws[i*6+5:i*6+6]] END AS cells FROM lk),
lf AS (SELECT doc_id, style, i, k, tb, unnest(range(len(cells))) AS c, unnest(cells) AS w6 FROM lc),
ls AS (SELECT *, array_to_string(w6, ' ') AS text, length(array_to_string(w6, ' ')) AS n FROM lf WHERE len(w6) > 0),
lp AS (SELECT doc_id, (i // 80 + 1)::INT AS page_no, k * 4 + c AS frag_no, text, n AS n_chars, style = 3 AND k % 13 = 12 AS bold, CASE WHEN style = 3 AND k % 17 = 16 THEN 16 ELSE 12 END::DOUBLE AS size,
  (CASE style WHEN 0 THEN CASE WHEN NOT tb THEN 72 WHEN k % 8 = 3 THEN 232 ELSE 72 + 160 * c END WHEN 1 THEN CASE WHEN k = 0 THEN 100 ELSE 72 + 246 * ((k - 1) // 40) END WHEN 2 THEN 72 + 170 * (k // 27) ELSE CASE WHEN k % 5 = 0 THEN 90 ELSE 72 END END)::DOUBLE AS x0,
  (CASE style WHEN 0 THEN CASE WHEN tb THEN n * 5 ELSE least(n * 8, 460) END WHEN 1 THEN CASE WHEN k = 0 THEN 380 ELSE least(n * 6, 222) END WHEN 2 THEN least(n * 5, 150) ELSE least(n * 11, 460) END)::DOUBLE AS w,
  (CASE style WHEN 0 THEN 60 + 18 * k - CASE WHEN tb AND k % 8 = 3 THEN 5 ELSE 0 END WHEN 1 THEN CASE WHEN k = 0 THEN 60 ELSE 90 + 14 * ((k - 1) % 40) END WHEN 2 THEN 60 + 14 * (k % 27) ELSE 60 + 14 * k + 10 * (k // 9) END)::DOUBLE AS base FROM ls),
fr AS (SELECT doc_id, page_no, frag_no, text, n_chars, x0, x0 + w AS x1, base - 0.8::DOUBLE * size AS top, base + 0.22::DOUBLE * size AS bottom, base, size, bold, dense_rank() OVER (PARTITION BY doc_id, page_no ORDER BY base) - 1 AS row_no FROM lp)"""


def _gutter_sql(src: str, key: str, nested: bool, t: str) -> str:
    """Tables {t}_g (key, g) of regions of `src`: how many fragments cross each whole x is counted there."""
    both = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in key.split(", "))
    beside = "" if nested else " OR (fl >= 0.4::DOUBLE * nl AND fl >= 8) OR (fr >= 0.4::DOUBLE * nr AND fr >= 8)"
    return f"""{t}_s AS (SELECT {key}, x0, x1 FROM {src} WHERE n_chars >= 2),
{t}_b AS (SELECT {key}, min(x0) AS l, max(x1) AS r FROM {t}_s GROUP BY {key} HAVING count(*) >= 10 AND max(x1) - min(x0) >= 150),
{t}_x AS (SELECT {key}, l, r, unnest(range(ceil(l + 0.2::DOUBLE * (r - l))::BIGINT, floor(l + 0.8::DOUBLE * (r - l))::BIGINT + 1)) AS x FROM {t}_b),
{t}_c AS (SELECT {", ".join(f"x.{k}" for k in key.split(", "))}, x.l, x.r, x.x, count(s.x0) AS c FROM {t}_x x LEFT JOIN {t}_s s ON {both("x", "s")} AND s.x0 < x.x - 1 AND s.x1 > x.x + 1 GROUP BY ALL),
{t}_n AS (SELECT *, x - row_number() OVER (PARTITION BY {key}, c ORDER BY x) AS isle FROM {t}_c),
{t}_r AS (SELECT {key}, l, r, c, min(x) AS a, max(x) AS b FROM {t}_n GROUP BY {key}, l, r, c, isle),
{t}_m AS (SELECT *, (a + b) / 2::DOUBLE AS g, lag(c) OVER o AS before, lead(c) OVER o AS after FROM {t}_r WINDOW o AS (PARTITION BY {key} ORDER BY a)),
{t}_f AS (SELECT {", ".join(f"m.{k}" for k in key.split(", "))}, g, c, count(*) FILTER (WHERE s.x1 <= g + 3) AS nl, count(*) FILTER (WHERE s.x0 >= g - 3) AS nr, count(*) FILTER (WHERE s.x1 <= g + 3 AND s.x1 - s.x0 >= 0.7::DOUBLE * (g - l)) AS fl,
  count(*) FILTER (WHERE s.x0 >= g - 3 AND s.x1 - s.x0 >= 0.7::DOUBLE * (r - g)) AS fr FROM {t}_m m JOIN {t}_s s ON {both("m", "s")} WHERE b - a >= 4 AND coalesce(before, c) >= c AND coalesce(after, c) >= c GROUP BY ALL),
{t}_g AS (SELECT {key}, g FROM {t}_f WHERE nl >= 6 AND nr >= 6 AND c <= 2 * (fl + fr) AND ((fl >= 4 AND fr >= 4 AND fl + fr >= 0.15::DOUBLE * (nl + nr)){beside})
  QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY 2 * least(fl, fr) + greatest(fl, fr) - c DESC, g) = 1)"""


def _split_sql(src: str, key: str, level: int, t: str) -> str:
    """Table {t} of the items of `src` with part{level}, cut{level}, open, and new bounds; bands are handled as lists of their items."""
    nth = lambda c, p: f"list_sort({c})[floor({p}::DOUBLE * (len({c}) - 1) + 0.5::DOUBLE)::INT + 1]"
    return f"""{_gutter_sql(src, key, level > 0, t)},
{t}_i AS (SELECT s.*, g, g IS NULL OR (s.x0 < g - 3 AND s.x1 > g + 3) AS span, (s.x0 + s.x1) / 2 < g AS isleft FROM {src} s LEFT JOIN {t}_g USING ({key})),
{t}_o AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY top, frag_no) AS nth, row_number() OVER (PARTITION BY {key} ORDER BY top, frag_no) - row_number() OVER (PARTITION BY {key}, span ORDER BY top, frag_no) AS isle FROM {t}_i),
{t}_d AS (SELECT {key}, span, isle, min(nth) AS first, min(top) FILTER (WHERE isleft) AS lt, max(bottom) FILTER (WHERE isleft) AS lb, min(top) FILTER (WHERE NOT isleft) AS rt, max(bottom) FILTER (WHERE NOT isleft) AS rb FROM {t}_o GROUP BY {key}, span, isle),
{t}_e AS (SELECT *, NOT span AND lt IS NOT NULL AND rt IS NOT NULL AND greatest(0, least(lb, rb) - greatest(lt, rt)) >= 0.3::DOUBLE * least(lb - lt, rb - rt) AS cols FROM {t}_d),
{t}_p AS (SELECT *, lag(NOT cols) OVER (PARTITION BY {key} ORDER BY first) AS under FROM {t}_e),
{t}_q AS (SELECT o.*, cols, under, rt, min(CASE WHEN NOT (o.isleft AND o.bottom <= rt + 1) THEN nth END) OVER (PARTITION BY {", ".join(f"o.{k}" for k in key.split(", "))}, o.span, o.isle) AS firm FROM {t}_o o JOIN {t}_p p USING ({key}, span, isle)),
{t}_u AS (SELECT *, cols AND NOT (coalesce(under, false) AND nth < firm) AS stands FROM {t}_q),
{t}_v AS (SELECT *, sum(CASE WHEN turn THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY nth) AS flow FROM (SELECT *, lag(stands) OVER (PARTITION BY {key} ORDER BY nth) IS DISTINCT FROM stands AS turn FROM {t}_u)),
{t}_w AS (SELECT {key}, list(x1) FILTER (WHERE n_chars IS NOT NULL AND x1 <= g + 3) AS ends, list(x0) FILTER (WHERE n_chars IS NOT NULL AND x0 >= g - 3) AS begins FROM {t}_i GROUP BY {key}),
{t} AS (SELECT v.* EXCLUDE ("left", "right", g, span, isleft, nth, isle, cols, under, rt, firm, stands, turn, flow), CASE WHEN g IS NULL THEN 0 WHEN NOT stands THEN flow * 2 ELSE flow * 2 + CASE WHEN isleft THEN 0 ELSE 1 END END AS part{level}, g IS NOT NULL AS cut{level}, stands AS open{level},
  CASE WHEN stands AND NOT isleft THEN coalesce({nth("begins", 0.1)}, g) ELSE "left" END AS "left", CASE WHEN stands AND isleft THEN coalesce({nth("ends", 0.9)}, g) ELSE "right" END AS "right" FROM {t}_v v JOIN {t}_w USING ({key}))"""


_WIDTH = f"{RIGHT - LEFT}::DOUBLE"
_SHARE = "greatest(0, least(f.x1, c.x1) - greatest(f.x0, c.x0))"
# zones as (doc_id, page_no, session, first_row): every end of a session is tried, at every whole x
_ZONES = f"""rw AS (SELECT doc_id, page_no, row_no, count(*) AS n_frags, min(x0) AS x0, max(x1) AS x1, min(top) AS top, max(bottom) AS bottom, any_value(base) AS base, max(size) AS size FROM fr GROUP BY 1, 2, 3),
rf AS (SELECT *, n_frags >= 2 OR x1 - x0 < 0.45::DOUBLE * {_WIDTH} AS fits FROM rw),
rl AS (SELECT *, fits AND lag(fits) OVER o AND top - lag(bottom) OVER o <= 2.5::DOUBLE * greatest(size, lag(size) OVER o) AS linked FROM rf WINDOW o AS (PARTITION BY doc_id, page_no ORDER BY row_no)),
rs AS (SELECT *, sum(CASE WHEN linked THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page_no ORDER BY row_no) AS session FROM rl),
rz AS (SELECT *, max(row_no) FILTER (WHERE n_frags >= 2) OVER (PARTITION BY doc_id, page_no, session) AS last_row FROM rs WHERE fits),
cd AS (SELECT doc_id, page_no, session, row_no AS first_row, last_row FROM rz WHERE n_frags >= 2 AND row_no < last_row),
zr AS (SELECT cd.*, rz.row_no, rz.n_frags, rz.size, rz.base FROM cd JOIN rz USING (doc_id, page_no, session) WHERE rz.row_no BETWEEN cd.first_row AND cd.last_row),
zs AS (SELECT doc_id, page_no, session, first_row, last_row, count(*) AS n_rows, count(*) FILTER (WHERE n_frags >= 2) AS n_strong, floor(count(*) * 0.12::DOUBLE) AS allowed, greatest(2, 0.5::DOUBLE * median(size)) AS gap FROM zr GROUP BY ALL),
zf AS (SELECT zr.doc_id, zr.page_no, session, first_row, zr.row_no, fr.frag_no, fr.text, fr.n_chars, fr.x0, fr.x1 FROM zr JOIN fr ON fr.doc_id = zr.doc_id AND fr.page_no = zr.page_no AND fr.row_no = zr.row_no),
zx AS (SELECT DISTINCT doc_id, page_no, session, first_row, row_no, unnest(range(floor(x0)::BIGINT, ceil(x1)::BIGINT + 1)) AS x FROM zf),
zc AS (SELECT doc_id, page_no, session, first_row, x FROM (SELECT doc_id, page_no, session, first_row, x, count(*) AS c FROM zx GROUP BY ALL) JOIN zs USING (doc_id, page_no, session, first_row) WHERE c > allowed),
zn AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY doc_id, page_no, session, first_row ORDER BY x) - 1 < gap THEN 0 ELSE 1 END AS fresh FROM zc JOIN zs USING (doc_id, page_no, session, first_row)),
zi AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, page_no, session, first_row ORDER BY x) - 1 AS col_no FROM zn),
co AS (SELECT doc_id, page_no, session, first_row, col_no, min(x)::DOUBLE AS x0, (max(x) + CASE WHEN col_no < max(col_no) OVER (PARTITION BY doc_id, page_no, session, first_row) THEN 1 ELSE 0 END)::DOUBLE AS x1 FROM zi GROUP BY 1, 2, 3, 4, 5),
cm AS (SELECT c.doc_id, c.page_no, c.session, c.first_row, c.col_no, coalesce(avg(f.x1 - f.x0) FILTER (WHERE {_SHARE} > 0.5::DOUBLE * (f.x1 - f.x0)), 0) AS mean, count(*) FILTER (WHERE {_SHARE} > 0.5::DOUBLE * (f.x1 - f.x0)) AS n,
  count(*) FILTER (WHERE {_SHARE} > 0.5::DOUBLE * (f.x1 - f.x0) AND f.n_chars <= 4) AS short, count(DISTINCT row_no) FILTER (WHERE {_SHARE} > 0) AS filled FROM co c JOIN zf f USING (doc_id, page_no, session, first_row) GROUP BY 1, 2, 3, 4, 5),
ct AS (SELECT doc_id, page_no, session, first_row, count(*) AS n_cols, max(mean) AS widest, max(mean) FILTER (WHERE col_no = 0) AS m0, max(mean) FILTER (WHERE col_no = 1) AS m1, max(n) FILTER (WHERE col_no = 0) AS n0, max(short) FILTER (WHERE col_no = 0) AS s0, sum(filled) AS filled FROM cm GROUP BY 1, 2, 3, 4),
zo AS (SELECT doc_id, page_no, session, first_row, last_row, n_cols FROM ct JOIN zs USING (doc_id, page_no, session, first_row)
  WHERE n_cols >= 2 AND (n_strong >= 3 OR (n_strong >= 2 AND n_cols >= 3)) AND NOT (n_cols = 2 AND ((m0 > 0.3::DOUBLE * {_WIDTH} AND m1 > 0.3::DOUBLE * {_WIDTH}) OR (s0 >= 0.7::DOUBLE * n0 AND m1 > 0.3::DOUBLE * {_WIDTH}))) AND widest <= 0.6::DOUBLE * {_WIDTH} AND filled / (n_rows * n_cols) >= 0.3::DOUBLE
  QUALIFY row_number() OVER (PARTITION BY doc_id, page_no, session ORDER BY first_row) = 1)"""
_ZONE = "doc_id, page_no, session, first_row"
_MARK = r"CASE WHEN regexp_matches(text, '^[•●◦▪■□–—‣⁃∙·*\-]') AND length(text) > 2 THEN 'bullet' WHEN regexp_matches(text, '^(\(?[0-9]{1,2}[.)]|\(?[a-zA-Z][.)]|\(?[ivxIVX]{1,4}[.)])\s+') THEN 'number' END"
_AT = lambda c, p: f"list_sort(list({c}) OVER r)[floor({p}::DOUBLE * (count(*) OVER r - 1) + 0.5::DOUBLE)::INT + 1]"
_ENDED = r"regexp_matches(p.text, '[.!?:][\"'')\]]?$')".replace('\\"', '"')

ORACLE_SQL = {
    "page_gutters": f"WITH {_FRAGMENTS}, {_gutter_sql('fr', 'doc_id, page_no', False, 'a')} SELECT doc_id, page_no, g AS gutter FROM a_g",
    "page_regions": f"""WITH {_FRAGMENTS}, pb AS (SELECT doc_id, page_no, list_sort(list(x0))[floor(0.02::DOUBLE * (count(*) - 1) + 0.5::DOUBLE)::INT + 1] AS "left", list_sort(list(x1))[floor(0.98::DOUBLE * (count(*) - 1) + 0.5::DOUBLE)::INT + 1] AS "right" FROM fr GROUP BY 1, 2),
it AS (SELECT doc_id, page_no, frag_no, n_chars, x0, x1, top, bottom, "left", "right" FROM fr JOIN pb USING (doc_id, page_no)
  UNION ALL SELECT doc_id, page_no, 100000, NULL, CASE doc_id % 8 WHEN 1 THEN 100 ELSE 80 END, CASE doc_id % 8 WHEN 1 THEN 500 ELSE 200 END, 230.5, 262.0, "left", "right" FROM pb WHERE doc_id % 8 IN (1, 2)),
{_split_sql("it", "doc_id, page_no", 0, "a")}, nx AS (SELECT * FROM a WHERE open0), {_split_sql("nx", "doc_id, page_no, part0", 1, "b")},
al AS (SELECT doc_id, page_no, frag_no, "left", "right", part0, 0 AS part1, cut0, false AS cut1 FROM a WHERE NOT open0 UNION ALL SELECT doc_id, page_no, frag_no, "left", "right", part0, part1, cut0, cut1 FROM b)
SELECT doc_id, page_no, frag_no, dense_rank() OVER (PARTITION BY doc_id, page_no ORDER BY part0, part1) - 1 AS region_no, "left", "right", max(CASE WHEN cut1 THEN 3 WHEN cut0 THEN 2 ELSE 1 END) OVER (PARTITION BY doc_id, page_no) AS columns FROM al""",
    "table_zones": f"WITH {_FRAGMENTS}, {_ZONES} SELECT doc_id, page_no, first_row, last_row, n_cols FROM zo",
    "table_columns": f"WITH {_FRAGMENTS}, {_ZONES} SELECT doc_id, page_no, first_row, col_no, x0, x1 FROM co SEMI JOIN zo USING ({_ZONE})",
    "table_cells": f"""WITH RECURSIVE {_FRAGMENTS}, {_ZONES}, tf AS (SELECT f.*, c.col_no, c.x0 AS c0, {_SHARE} AS share FROM zf f SEMI JOIN zo USING ({_ZONE}) JOIN co c USING ({_ZONE})),
tp AS (SELECT * FROM tf QUALIFY row_number() OVER (PARTITION BY {_ZONE}, row_no, frag_no ORDER BY share DESC, col_no) = 1),
tr AS (SELECT *, (base - lag(base) OVER (PARTITION BY {_ZONE} ORDER BY row_no)) / size AS pitch FROM zr SEMI JOIN zo USING ({_ZONE})),
tl AS (SELECT *, coalesce(pitch <= 1.3::DOUBLE AND (median(pitch) OVER (PARTITION BY {_ZONE}) >= 1.45::DOUBLE OR n_frags = 1), false) AS close, row_number() OVER (PARTITION BY {_ZONE} ORDER BY row_no) AS nth FROM tr),
th AS (SELECT {_ZONE}, row_no, list(DISTINCT col_no) AS cols FROM tp GROUP BY ALL), ta AS (SELECT * FROM tl JOIN th USING ({_ZONE}, row_no)),
tw AS (SELECT {_ZONE}, nth, row_no, 0 AS table_row, cols, false AS more FROM ta WHERE nth = 1
  UNION ALL SELECT a.doc_id, a.page_no, a.session, a.first_row, a.nth, a.row_no, CASE WHEN a.close AND list_has_all(w.cols, a.cols) THEN w.table_row ELSE w.table_row + 1 END, CASE WHEN a.close AND list_has_all(w.cols, a.cols) THEN w.cols ELSE a.cols END, a.close AND list_has_all(w.cols, a.cols)
  FROM tw w JOIN ta a ON a.doc_id = w.doc_id AND a.page_no = w.page_no AND a.session = w.session AND a.first_row = w.first_row AND a.nth = w.nth + 1),
tc AS (SELECT {_ZONE}, table_row, col_no, list_transform(list_sort(list({{'r': row_no, 'x': tp.x0, 'f': frag_no, 'm': more, 't': text}})), lambda s: CASE WHEN s.m THEN chr(1) ELSE chr(2) END || s.t) AS parts FROM tp JOIN tw USING ({_ZONE}, row_no) GROUP BY ALL),
tx AS (SELECT *, list_reduce(parts, lambda a, p: CASE WHEN p[1] = chr(1) AND regexp_matches(right(a, 2), '[A-Za-z]-$') AND regexp_matches(p, '^.[a-z]') THEN left(a, length(a) - 1) || p[2:] ELSE a || ' ' || p[2:] END)[2:] AS text FROM tc),
tv AS (SELECT {_ZONE}, col_no, coalesce(lead(x0) OVER (PARTITION BY {_ZONE} ORDER BY col_no), x1) - x0 AS width FROM co SEMI JOIN zo USING ({_ZONE}))
SELECT doc_id, page_no, first_row, table_row::INT AS table_row, col_no, text, width FROM tx JOIN tv USING ({_ZONE}, col_no)""",
    "paragraph_groups": f"""WITH RECURSIVE {_FRAGMENTS}, l0 AS (SELECT doc_id, page_no, row_no, any_value(base) AS base, max(size) AS size, min(x0) AS a, max(x1) AS b, string_agg(text, ' ' ORDER BY x0, frag_no) AS t, sum(CASE WHEN bold THEN n_chars ELSE 0 END) > 0.9::DOUBLE * sum(n_chars) AS bold FROM fr GROUP BY 1, 2, 3),
l1 AS (SELECT doc_id, page_no, row_no, base, size, bold, CASE WHEN row_no % 10 = 9 THEN 250 ELSE a END AS x0, CASE WHEN row_no % 10 = 9 THEN 362 ELSE b END AS x1, CASE WHEN row_no % 11 = 5 THEN CASE WHEN row_no % 2 = 0 THEN '• ' ELSE '1. ' END ELSE '' END || t AS text FROM l0),
l2 AS (SELECT *, CASE WHEN count(*) OVER r >= 4 THEN {_AT("x0", 0.1)} ELSE {LEFT}::DOUBLE END AS le, CASE WHEN count(*) OVER r >= 4 THEN {_AT("x1", 0.9)} ELSE {RIGHT}::DOUBLE END AS re, base - lag(base) OVER o AS rise, lag(size) OVER o AS fs0 FROM l1 WINDOW r AS (PARTITION BY doc_id, page_no), o AS (PARTITION BY doc_id, page_no ORDER BY row_no)),
l3 AS (SELECT *, greatest(1, re - le) AS wide, count(*) FILTER (WHERE x1 >= re - 1.5::DOUBLE * size) OVER r > 0.5::DOUBLE * count(*) OVER r AS just, CASE WHEN abs(size - fs0) < 0.5 AND rise > 0.9::DOUBLE * size AND rise < 2.5::DOUBLE * size THEN rise / size END AS d,
  x1 - x0 < 0.85::DOUBLE * 468 AND abs((x0 + x1) / 2 - 306) < greatest(1.5::DOUBLE * size, 0.03::DOUBLE * 468) AND x0 > 72 + 2 * size AS mid, {_MARK} AS list FROM l2 WINDOW r AS (PARTITION BY doc_id, page_no)),
l4 AS (SELECT *, CASE WHEN count(d) OVER r >= 3 THEN median(d) OVER r ELSE 1.25 END AS spacing FROM l3 WINDOW r AS (PARTITION BY doc_id, page_no)),
w AS (SELECT l4.*, 0 AS para, list AS plist, mid AS pmid, x0 AS px, NULL::DOUBLE AS least_ FROM l4 WHERE row_no = 0
  UNION ALL SELECT n.* EXCLUDE (fresh, para, plist, pmid, px, least_), CASE WHEN fresh THEN para + 1 ELSE para END, CASE WHEN fresh THEN n.list ELSE plist END, CASE WHEN fresh THEN n.mid ELSE pmid END, CASE WHEN fresh THEN n.x0 ELSE px END, CASE WHEN NOT fresh THEN least(coalesce(least_, n.x0), n.x0) END
  FROM (SELECT n.*, p.para, p.plist, p.pmid, p.px, p.least_, NOT (p.plist IS NOT NULL AND n.list IS NULL AND NOT big AND NOT sized AND n.x0 > n.le + 0.5::DOUBLE * n.size AND NOT short) AND
      (n.list IS NOT NULL OR sized OR big OR (p.bold <> n.bold AND (length(p.text) < 90 OR length(n.text) < 90)) OR (short AND NOT (n.mid AND p.pmid))
       OR (p.plist IS NULL AND n.x0 > n.le + 0.8::DOUBLE * n.size AND n.x0 < n.le + 5 * n.size AND p.x0 < n.le + 0.5::DOUBLE * n.size AND {_ENDED})
       OR coalesce(n.x0 < p.least_ - 0.8::DOUBLE * n.size AND p.least_ > p.px + 0.8::DOUBLE * n.size, false) OR (n.mid <> p.pmid AND NOT (n.mid AND NOT p.pmid AND p.x1 - p.x0 > 0.85::DOUBLE * n.wide))) AS fresh
    FROM (SELECT p.*, n.row_no AS nr, abs(n.size - p.size) > 0.12::DOUBLE * greatest(n.size, p.size) AS sized, n.rise / greatest(n.size, p.size) > n.spacing * 1.3::DOUBLE + 0.1::DOUBLE OR n.rise < 0 AS big,
        CASE WHEN n.just THEN p.x1 < n.re - greatest(2 * p.size, 0.06::DOUBLE * n.wide) ELSE p.x1 < n.re - 0.25::DOUBLE * n.wide AND {_ENDED} END AS short
      FROM w p JOIN l4 n ON n.doc_id = p.doc_id AND n.page_no = p.page_no AND n.row_no = p.row_no + 1) p JOIN l4 n ON n.doc_id = p.doc_id AND n.page_no = p.page_no AND n.row_no = p.nr) AS n),
g AS (SELECT doc_id, page_no, para AS para_no, min(row_no) AS first_row, count(*)::INT AS n_lines, list(text ORDER BY row_no) AS ts, list(x0 ORDER BY row_no) AS xs, arg_min(size, row_no) AS s0, any_value(le) AS le, any_value(wide) AS wide, any_value(plist) AS list, any_value(pmid) AS centered FROM w GROUP BY 1, 2, 3),
h AS (SELECT *, CASE WHEN n_lines > 1 THEN list_min(xs[2:]) ELSE xs[1] END - le AS inset FROM g)
SELECT doc_id, page_no, para_no, first_row::INT AS first_row, n_lines, md5(list_reduce(ts, lambda a, l: CASE WHEN regexp_matches(right(a, 2), '[A-Za-z]-$') AND regexp_matches(l, '^[a-z]') THEN left(a, length(a) - 1) || l WHEN a = '' OR regexp_matches(right(a, 1), '[\\s\\x0b]$') THEN a || l ELSE a || ' ' || l END)) AS text_md5,
  list, centered, CASE WHEN NOT centered AND inset > 1.5::DOUBLE * s0 AND inset < 0.5::DOUBLE * wide THEN inset END AS indent FROM h""",
}
