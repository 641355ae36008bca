"""Queries over text made ready for display, and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelab.operators import display_ops as D
from quirelab.sources import tables as T

# Samples of scripts, marks, joiners, symbols and digits, one of which is set before each line.
SAMPLES = (
    "abc, \u0627\u0644\u0639\u0631\u0628\u064a\u0629\u060c \u0646\u0635 12 x ", "\u0645\u0631\u062d\u0628\u0627 (\u0628\u0627\u0644\u0639\u0627\u0644\u0645) 2024 end ", "\u0928\u092e\u0938\u094d\u0924\u0947 \u0926\u0941\u0928\u093f\u092f\u093e! \u0915\u094d\u200d\u0937 ",
    "e\u0301\u0301 x\u093f\u0301 \u2192\u2200 \u2603\u200d\ufe0f 9 ", "\u064e\u0301a\u200c\u0628\u200d\u064e\u060c \u4e2d\u200d\u0301\t", "(\u0628) \u2190 \u03b1\u0301\u03b2 \u0633\u2026\u0634 7% ", "",
)
LINE = ["doc_id", "line_no"]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = F.array(*[F.lit(s) for s in SAMPLES])
    at = (F.col("doc_id") + F.col("line_no")) % len(SAMPLES)
    return T.lines(spark, sf_dir).select(*LINE, F.concat(F.get(samples, at.cast("int")), "line", F.when(F.col("doc_id") % 5 == 0, " \u0634\u0643\u0631\u0627 3").otherwise("")).alias("text"))


def _md5(c: Column) -> Column:
    return F.md5(c.cast("binary"))


def prepared_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as they can be drawn with all fonts, and with that for Arabic alone."""
    text = F.col("text")
    return _lines(spark, sf_dir).select(*LINE, _md5(D.prepared_text(text)).alias("text_md5"), _md5(D.prepared_text(text, {"arab": D.FONTS["arab"]})).alias("few_md5"))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.segments(_lines(spark, sf_dir), LINE)


def text_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir).select(*LINE, "seg_no", _md5(F.col("text")).alias("text_md5"), "font", "strong")


def visual_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of lines in visual order; every third document runs right to left."""
    strong = F.transform(D.segments_of(F.col("text")), lambda s: s["strong"])
    out = _lines(spark, sf_dir).select(*LINE, F.posexplode(D.visual_places(strong, F.col("doc_id") % 3 == 0)).alias("seg_no", "o"))
    return out.select(*LINE, F.col("seg_no").cast("long").alias("seg_no"), "o.level", "o.visual_no")


def cluster_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first word of each line, with marks set in, over one to six glyphs."""
    word = F.regexp_replace(F.substring_index("text", " ", 1), "([aeiou])", "$1\u0301\u0323\u200d")
    parts = _lines(spark, sf_dir).withColumn("p", D.over_glyphs(word, ((F.col("doc_id") + F.col("line_no")) % 6 + 1).cast("int")))
    return parts.select(*LINE, F.array_join("p.pieces", "|").alias("pieces"), F.array_join("p.gaps", "|").alias("gaps"))


QUERIES = {f.__name__: f for f in (prepared_lines, text_segments, visual_lines, cluster_parts)}


def _re(pattern: str) -> str:
    return re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", pattern)


def _font_sql(fonts: dict[str, str]) -> str:
    return f"CASE WHEN regexp_matches(ch, '^[{_re(D.BASE)}]') THEN 'base' " + " ".join(f"WHEN regexp_matches(ch, '^[{_re(r)}]') THEN '{n}'" for n, r in fonts.items()) + " END"


def _in_font_sql(font: str, ch: str) -> str:
    return f"CASE {font} " + " ".join(f"WHEN '{n}' THEN regexp_matches({ch}, '^[{_re(r)}]')" for n, r in D.FONTS.items()) + " ELSE false END"


_SAMPLES = ", ".join("'" + s.replace("'", "''") + "'" for s in SAMPLES)
_L = f"""ln AS (SELECT doc_id, (unnest(range(1, len(ls) + 1)) - 1)::INT AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
tx AS (SELECT doc_id, line_no, [{_SAMPLES}][(doc_id + line_no) % {len(SAMPLES)} + 1] || line || CASE WHEN doc_id % 5 = 0 THEN ' \u0634\u0643\u0631\u0627 3' ELSE '' END AS text FROM ln),
cp AS (SELECT doc_id, line_no, text, regexp_extract_all(text, '(?s).') AS cs FROM tx)"""
# one character after the other, the font of the one before in the state
_PREPARED = lambda fonts: f"""(SELECT list_reduce(list_prepend({{'out': '', 'prev': NULL::VARCHAR}}, list_transform(cs, lambda ch: {{'out': ch, 'prev': {_font_sql(fonts)}}})), lambda s, c: CASE
  WHEN c.out = chr(10) THEN {{'out': s.out || c.out, 'prev': 'base'}}
  WHEN regexp_matches(c.out, '{_re(D.BLANK)}') AND c.prev IS DISTINCT FROM 'base' THEN {{'out': s.out || ' ', 'prev': 'base'}}
  WHEN regexp_matches(c.out, '{_re(D.JOINING)}') AND s.prev <> 'base' AND ({_in_font_sql("s.prev", "c.out")} OR regexp_matches(c.out, '{_re(D.CONTROLS)}')) THEN {{'out': s.out || c.out, 'prev': s.prev}}
  WHEN c.prev IS NOT NULL THEN {{'out': s.out || c.out, 'prev': c.prev}} WHEN regexp_matches(c.out, '{_re(D.JOINING)}') THEN s ELSE {{'out': s.out || '?', 'prev': 'base'}} END).out)"""  # noqa: E731
_STRONG = r"CASE WHEN k = 'arab' THEN CASE WHEN regexp_matches(ch, '^[\p{L}\p{M}]') THEN 'R' ELSE 'N' END WHEN k IN ('sym', 'math') THEN 'N' WHEN regexp_matches(ch, '^[\p{L}\p{M}\p{Nd}]') THEN 'L' ELSE 'N' END"
_SEGMENTS = f"""{_L}, ch AS (SELECT doc_id, line_no, unnest(range(len(cs))) AS pos, unnest(cs) AS ch FROM cp),
co AS (SELECT *, coalesce({_font_sql(D.FONTS)}, 'base') AS own, regexp_matches(ch, '{_re(D.JOINING)}') AS joins FROM ch),
cw AS (SELECT *, CASE WHEN own = 'base' AND joins THEN NULL ELSE own END AS k, 0 AS dummy FROM co),
c1 AS (SELECT doc_id, line_no, pos, ch, joins, own AS k FROM co WHERE pos = 0),
st AS (SELECT doc_id, line_no, pos, k, {_STRONG} AS strong, ch FROM c1
  UNION ALL SELECT doc_id, line_no, pos, k, CASE WHEN k = pk AND k <> 'base' AND joins THEN ps ELSE {_STRONG} END, ch
  FROM (SELECT n.doc_id, n.line_no, n.pos, n.ch, n.joins, CASE WHEN n.joins AND s.k <> 'base' THEN s.k ELSE n.own END AS k, s.k AS pk, s.strong AS ps FROM st s JOIN co n ON n.doc_id = s.doc_id AND n.line_no = s.line_no AND n.pos = s.pos + 1)),
rn AS (SELECT *, lag(k) OVER o IS DISTINCT FROM k OR lag(strong) OVER o IS DISTINCT FROM strong AS fresh FROM st WINDOW o AS (PARTITION BY doc_id, line_no ORDER BY pos)),
ri AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id, line_no ORDER BY pos) AS run FROM rn),
rs AS (SELECT doc_id, line_no, run, any_value(k) AS k, any_value(strong) AS strong, string_agg(ch, '' ORDER BY pos) AS text, bool_and(ch = ' ' OR {_in_font_sql("'deva'", "ch")}) AS deva, bool_and(ch = ' ' OR {_in_font_sql("'arab'", "ch")}) AS arab, bool_and(ch = ' ' OR {_in_font_sql("'noto'", "ch")}) AS noto,
  bool_and(ch = ' ' OR {_in_font_sql("'sym'", "ch")}) AS sym, bool_and(ch = ' ' OR {_in_font_sql("'math'", "ch")}) AS math FROM ri GROUP BY 1, 2, 3),
rl AS (SELECT *, lag(k) OVER o <> 'base' AND strong = 'N' AND lead(k) OVER o = lag(k) OVER o AND lead(strong) OVER o = lag(strong) OVER o AND (k = lag(k) OVER o OR CASE lag(k) OVER o WHEN 'deva' THEN deva WHEN 'arab' THEN arab WHEN 'noto' THEN noto WHEN 'sym' THEN sym ELSE math END) AS link FROM rs WINDOW o AS (PARTITION BY doc_id, line_no ORDER BY run)),
rg AS (SELECT *, sum(CASE WHEN link OR was THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, line_no ORDER BY run) - 1 AS seg_no FROM (SELECT *, lag(link) OVER (PARTITION BY doc_id, line_no ORDER BY run) AS was FROM rl)),
sg AS (SELECT doc_id, line_no, seg_no, string_agg(text, '' ORDER BY run) AS text, arg_min(k, run) AS font, arg_min(strong, run) AS strong FROM rg GROUP BY 1, 2, 3)"""

ORACLE_SQL = {
    "prepared_lines": f"WITH {_L} SELECT doc_id, line_no, md5({_PREPARED(D.FONTS)}) AS text_md5, md5({_PREPARED({'arab': D.FONTS['arab']})}) AS few_md5 FROM cp",
    "text_segments": f"WITH RECURSIVE {_SEGMENTS} SELECT doc_id, line_no, seg_no, md5(text) AS text_md5, font, strong FROM sg",
    # levels by looking at all segments before and after; reversal of whole lists, level by level
    "visual_lines": f"""WITH RECURSIVE {_SEGMENTS}, sl AS (SELECT doc_id, line_no, doc_id % 3 = 0 AS rtl, list({{'n': seg_no, 's': strong}} ORDER BY seg_no) AS l FROM sg GROUP BY 1, 2),
lv AS (SELECT doc_id, line_no, rtl, list_transform(l, lambda x, i: {{'n': x.n, 'v': CASE WHEN x.s <> 'N' THEN CASE WHEN x.s = 'R' THEN 1 WHEN rtl THEN 2 ELSE 0 END
  WHEN coalesce(list_filter(l[:i-1], lambda y: y.s <> 'N')[-1].s, CASE WHEN rtl THEN 'R' ELSE 'L' END) <> coalesce(list_filter(l[i+1:], lambda y: y.s <> 'N')[1].s, CASE WHEN rtl THEN 'R' ELSE 'L' END) THEN CASE WHEN rtl THEN 1 ELSE 0 END
  WHEN coalesce(list_filter(l[:i-1], lambda y: y.s <> 'N')[-1].s, CASE WHEN rtl THEN 'R' ELSE 'L' END) = 'R' THEN 1 WHEN rtl THEN 2 ELSE 0 END}}) AS l FROM sl),
un AS (SELECT doc_id, line_no, unnest(l) AS x FROM lv), u2 AS (SELECT doc_id, line_no, x.n AS seg_no, x.v AS level FROM un),
p2 AS (SELECT *, sum((level < 2)::INT) OVER (PARTITION BY doc_id, line_no ORDER BY seg_no) AS isle FROM u2),
o2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY begun, CASE WHEN level >= 2 THEN -seg_no ELSE seg_no END) AS k FROM (SELECT *, min(seg_no) OVER (PARTITION BY doc_id, line_no, isle, level >= 2) AS begun FROM p2)),
p1 AS (SELECT *, sum((level < 1)::INT) OVER (PARTITION BY doc_id, line_no ORDER BY k) AS isle1 FROM o2),
o1 AS (SELECT *, min(k) OVER (PARTITION BY doc_id, line_no, isle1, level >= 1) AS at1 FROM p1)
SELECT doc_id, line_no, seg_no, level::INT AS level, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY at1, CASE WHEN level >= 1 THEN -k ELSE k END) - 1 AS visual_no FROM o1""",
    # the longest piece is cut, one cut after the other
    "cluster_parts": rf"""WITH RECURSIVE {_L}, w AS (SELECT doc_id, line_no, ((doc_id + line_no) % 6 + 1)::INT AS k, regexp_extract_all(regexp_replace(regexp_replace(string_split(text, ' ')[1], '([aeiou])', '\1{chr(0x301)}{chr(0x323)}{chr(0x200D)}', 'g'), '\p{{Cf}}', '', 'g'), '\p{{Mn}}+|\P{{Mn}}+') AS t FROM tx),
c AS (SELECT doc_id, line_no, k, t FROM w UNION ALL SELECT doc_id, line_no, k, t[:b-1] || [t[b][1]] || [t[b][2:]] || t[b+1:] FROM (
  SELECT *, list_position(list_transform(t, lambda s: CASE WHEN regexp_matches(s, '^\p{{Mn}}') THEN 0 ELSE length(s) END), list_max(list_transform(t, lambda s: CASE WHEN regexp_matches(s, '^\p{{Mn}}') THEN 0 ELSE length(s) END))) AS b,
         coalesce(list_max(list_transform(t, lambda s: CASE WHEN regexp_matches(s, '^\p{{Mn}}') THEN 0 ELSE length(s) END)), 0) AS most, len(list_filter(t, lambda s: NOT regexp_matches(s, '^\p{{Mn}}'))) AS free FROM c) WHERE free < k AND most > 1),
d AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, line_no ORDER BY len(t) DESC) = 1),
e AS (SELECT doc_id, line_no, k, list_reduce(list_prepend({{'p': []::VARCHAR[], 'g': ['']}}, list_transform(t, lambda s: {{'p': [s], 'g': []::VARCHAR[]}})), lambda a, x: CASE WHEN NOT regexp_matches(x.p[1], '^\p{{Mn}}') AND len(a.p) < k THEN {{'p': a.p || x.p, 'g': a.g || ['']}} ELSE {{'p': a.p, 'g': a.g[:-2] || [a.g[-1] || x.p[1]]}} END) AS r FROM d),
f AS (SELECT doc_id, line_no, r.p || list_transform(range(k - len(r.p)), lambda i: '') AS p, r.g || list_transform(range(k - len(r.p)), lambda i: '') AS g FROM e)
SELECT doc_id, line_no, array_to_string(p, '|') AS pieces, array_to_string(g, '|') AS gaps FROM f""",
}
