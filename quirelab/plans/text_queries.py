"""Queries over text, words, searches, usage and layout, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelab.functions import scores as S
from quirelab.functions import text as X
from quirelab.operators import catalog_ops as C
from quirelab.operators import layout_ops as L
from quirelab.operators import ocr_ops as W
from quirelab.operators import page_ops as P
from quirelab.operators import text_ops as O
from quirelab.sources import tables as T

RUN = 12


def text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.table(spark, sf_dir, "documents").select("doc_id", X.text_stats(F.col("text"), 14, True).alias("a"), X.markdown_stats(F.col("text")).alias("b"))
    return d.select("doc_id", F.col("a.chars").alias("chars"), F.col("a.words").alias("words"), F.col("a.pages").alias("pages"), F.col("b.lines").alias("lines"), F.col("b.pages").alias("markdown_pages"))


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = O.word_rows(T.table(spark, sf_dir, "documents"), F.col("text"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"))


def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.repeated_lines(T.lines(spark, sf_dir))


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("h"), "url")
    plain = X.decode_entities(F.col("h"))
    digest = lambda c: F.md5(c.cast("binary"))
    return p.select("page_id", digest(plain).alias("plain_md5"), digest(X.escape_html(plain)).alias("escaped_md5"), X.url_with_scheme(F.regexp_replace("url", "^http://", " ")).alias("url"), X.blocked_url(F.col("url")).alias("blocked"), X.is_rtl(F.col("h")).alias("rtl"))


def joined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.table(spark, sf_dir, "documents")
    cut = F.regexp_replace("text", "([a-z]{4})([a-z]{3})", "$1-\n$2")
    return d.select("doc_id", F.md5(X.join_lines(F.split(cut, "\n", -1)).cast("binary")).alias("joined_md5"))


def inline_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.table(spark, sf_dir, "documents").withColumn("text", F.translate("text", "*`[", "___"))  # marks of the texts' own are none
    marked = F.regexp_replace(F.regexp_replace("text", r"([a-z]{9,})", "**$1**"), " (the|de) ", " `$1` ")
    return d.select("doc_id", F.md5(X.inline_markup(marked).cast("binary")).alias("html_md5"))


def numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("doc_id") % 3999 + 1).cast("int")
    return T.table(spark, sf_dir, "documents").select("doc_id", X.roman(n).alias("roman"), X.alpha(F.col("doc_id") * 97).alias("alpha"))


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word lists of benchmark items and documents that share five words in a row."""
    ref = T.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    out = T.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return O.paired(ref, out, X.words, 5)


def multiset_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.recall_of(_compared(spark, sf_dir))


def run_coverage_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.coverage_of(_compared(spark, sf_dir), RUN)


def ordered_recall_lcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir).select("ref_id", "out_id", O.ordered_recall("rw", "ow").alias("recall"))


def _page_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    w = T.pages(spark, sf_dir).select("doc_id", "page_no", F.posexplode(split).alias("word_no", "text"))
    x0 = F.col("word_no") % 10 * 50.0
    return w.withColumn("x0", x0).withColumn("x1", x0 + F.char_length("text") * 6.0)


def word_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.find_word(_page_words(spark, sf_dir), " The").select("doc_id", "page_no", "word_no", "text", F.round("hit_x0", 6).alias("hit_x0"), F.round("hit_x1", 6).alias("hit_x1"))


def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.find_phrase(_page_words(spark, sf_dir), "of th").select("doc_id", "page_no", "start_no", "word_no", "text")


def recent_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.recent(T.usage(spark, sf_dir))


def favourite_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.favourites(T.usage(spark, sf_dir))


def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("original_size"))
    tries = F.explode(F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(n).alias("name"), F.lit(p).alias("p")) for i, (n, p) in enumerate((("light", 95), ("medium", 102), ("strong", 60), ("small", 64), ("least", 40)))])).alias("t")
    c = d.select("doc_id", "original_size", tries).select("doc_id", "original_size", "t.seq", "t.name", F.floor(F.col("original_size") * F.col("t.p") / 100 + F.col("doc_id") % 50).alias("size"))
    return C.best_candidate(c, F.when(F.col("doc_id") % 3 == 0, F.col("original_size") * 0.62).when(F.col("doc_id") % 3 == 1, F.lit(900.0)))


def related_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("seq"), "lang", "source")
    return C.related(d, F.array(F.concat(F.lit("c:"), "lang"), F.concat(F.lit("t:"), "source")))


def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.array("p_brand", F.lower("p_type")).alias("tags"))
    return C.keyword_search(p, " WIDGET ").select("p_partkey", "name")


def categories_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.first_seen(T.table(spark, sf_dir, "documents"), "source", "doc_id")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.rows_of(T.mono_pages(T.line_pages(spark, sf_dir)))


def weighted_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    fs = S.half_up(F.col("fs") * 2) / 2
    return O.weighted_mode(T.mono_pieces(T.line_pages(spark, sf_dir)), ("doc_id",), fs, F.char_length("str"), F.col("piece_no"))


def layout_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    x0, x1 = F.array_min(F.transform("pieces", lambda i: i["x"])), F.array_max(F.transform("pieces", lambda i: i["x"] + i["w"]))
    return _rows(spark, sf_dir).select("doc_id", "page_no", "row_no", F.size("pieces").cast("long").alias("n_pieces"), F.round(x0, 6).alias("x0"), F.round(x1, 6).alias("x1"))


def layout_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lambda c: F.round(c, 6).alias(c)
    return L.fragments(_rows(spark, sf_dir)).select("doc_id", "page_no", "row_no", "frag_no", "text", r("x0"), r("x1"), r("base"), "size", "bold")


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.headings(L.lines_of(L.fragments(_rows(spark, sf_dir)))).filter("level > 0")


def page_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.pages(spark, sf_dir).select("doc_id", "page_no", F.char_length("text").cast("double").alias("n"), "text", (F.char_length("text") % 101).alias("confidence"))
    stats = p.groupBy("doc_id").agg(F.coalesce(F.percentile("n", 0.5), F.lit(0.0)).alias("median"), F.coalesce(S.half_up(F.avg("confidence")), F.lit(0)).cast("int").alias("mean_confidence"))
    return stats.join(O.rank_of(p, "doc_id", "n", 0.9).withColumnRenamed("n", "p90"), "doc_id")


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of a document's joined text, in order, each under its header."""
    shown = F.concat(F.lit("--- Page "), F.col("page_no").cast("string"), F.lit(" ---\n"), "text")
    return T.pages(spark, sf_dir).select("doc_id", "page_no", F.md5(shown.cast("binary")).alias("text_md5"))


def wrap_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = O.without_blank_end(T.lines(spark, sf_dir).select("doc_id", "line_no", F.posexplode(O.wrap_mono(F.col("line"), F.lit(80))).alias("k", "line")))
    at = F.row_number().over(L.document_order("doc_id", "line_no", "k")) - 1
    return lines.select("doc_id", "line_no", "k", "line", (F.floor(at / 54) + 1).cast("int").alias("page_no"))


def ocr_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("word_no")
    w = _page_words(spark, sf_dir).select("doc_id", "page_no", "word_no", "text", (n * 37 % 100).cast("int").alias("confidence"), (n % 10 * 130.0).alias("x0"), (F.floor(n / 10) * 60.0).alias("y0"), (n % 10 * 130.0 + 100).alias("x1"))
    w = w.withColumn("y1", F.col("y0") + 40).withColumn("baseline_y", F.when(n % 7 != 0, F.col("y0") + 32 + n % 10 * F.col("page_no") * 0.5)).withColumn("line_height", F.lit(None).cast("double"))
    w = w.withColumns({"px_w": F.lit(1275.0), "px_h": F.lit(1650.0), "pdf_w": F.lit(612.0), "pdf_h": F.lit(792.0)})
    r = lambda c: F.round(c, 6).alias(c)
    return W.pieces(w).select("doc_id", "page_no", "word_no", "str", r("x"), r("y"), r("w"), r("fs"))


def scanned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.pages(spark, sf_dir)
    cut = p.select("doc_id", "page_no", F.regexp_replace("text", "[a-z]", "").alias("str")).unionByName(p.filter("page_no % 3 = 0").select("doc_id", "page_no", "text").withColumnRenamed("text", "str"))
    images = p.select("doc_id", "page_no", F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(600.0).alias("x1"), (F.col("page_no") * 100.0).alias("y1"))
    sizes = p.select("doc_id", "page_no", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"))
    return W.scanned(sizes, cut, images)


def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("line_no")
    lead = F.element_at(F.array(*map(F.lit, ("## ", "- ", "- ", "", "2. ", "> ", "### ", "|", "|", ""))), (n % 10 + 1).cast("int"))
    tail = F.when(lead == "|", "|b|").otherwise("")
    lines = T.lines(spark, sf_dir).select("doc_id", "line_no", F.when(n % 10 == 3, "").otherwise(F.concat(lead, "line", tail)).alias("line"))
    return L.markdown_blocks(lines).select("doc_id", "first_line", "kind", F.array_join("items", "¦").alias("items"))


def paginated(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("line_no")
    atoms = T.lines(spark, sf_dir).select("doc_id", (n * 30.0).alias("top"), (n * 30.0 + 10 + F.char_length("line") % 40).alias("bottom"), (n % 9 == 8).alias("keep_with_next"))
    return L.paginate(atoms, 400.0)


QUERIES = {f.__name__: f for f in (
    ocr_pieces, scanned_pages, markdown_blocks, paginated, text_stats, word_counts, repeated_lines, clean_text, joined_lines, inline_markup, numerals, multiset_recall, run_coverage_12, ordered_recall_lcs, word_search, phrase_search,
    recent_items, favourite_items, best_candidate, related_documents, keyword_search, categories_first_seen, weighted_mode, layout_rows, layout_fragments, headings,
    page_statistics, page_texts, wrap_lines,
)}

_WORDS = r"list_filter(string_split_regex(regexp_replace(lower({}), '[\x{{ad}}\x{{2010}}-\x{{2015}}-]', '', 'g'), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
_LISTS = f"""r AS (SELECT item_id AS id, {_WORDS.format("text")} AS ws FROM benchmark), o AS (SELECT doc_id AS id, {_WORDS.format("text")} AS ws FROM documents),
r5 AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) AS g FROM r WHERE len(ws) >= 5),
o5 AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) AS g FROM o WHERE len(ws) >= 5),
pairs AS (SELECT DISTINCT r5.id AS ref_id, o5.id AS out_id FROM r5 JOIN o5 USING (g)),
rc AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(ws) AS w FROM r) GROUP BY ALL), oc AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(ws) AS w FROM o) GROUP BY ALL),
bag AS (SELECT ref_id, out_id, sum(least(rc.n, coalesce(oc.n, 0)))::DOUBLE / sum(rc.n)::DOUBLE AS recall FROM pairs JOIN rc ON rc.id = ref_id LEFT JOIN oc ON oc.id = out_id AND oc.w = rc.w GROUP BY ALL)"""
_PAGE_WORDS = r"""pw AS (SELECT conv_id AS doc_id, (turn + 1)::INT AS page_no, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM conversations),
w AS (SELECT doc_id, page_no, (unnest(range(1, len(ws) + 1)) - 1)::INT AS word_no, unnest(ws) AS text FROM pw)"""
_PIECES = r"""ln AS (SELECT doc_id, (unnest(range(1, len(ls) + 1)) - 1)::INT AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
sp AS (SELECT doc_id, line_no, line, unnest(string_split(line, ' ')) AS s, unnest(range(1, len(string_split(line, ' ')) + 1)) AS k FROM ln),
pc AS (SELECT doc_id, line_no, s, k, CASE WHEN len(string_split(line, ' ')) < 6 THEN 18.0 ELSE 12.0 END::DOUBLE AS fs, regexp_matches(line, '^[0-9]') AS bold, line,
  sum(length(s) + 1) OVER (PARTITION BY doc_id, line_no ORDER BY k) - length(s) - 1 AS col FROM sp),
pw AS (SELECT *, 72 + col * fs * 0.6::DOUBLE AS x FROM pc WHERE s <> ''), rw AS (SELECT doc_id, line_no // 60 + 1 AS page_no, line_no, line, any_value(fs) AS fs, any_value(bold) AS bold, count(*) AS n, sum(length(s)) AS chars, min(x) AS x0, max(x + length(s) * fs * 0.6::DOUBLE) AS x1 FROM pw GROUP BY ALL),
rn AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY line_no) - 1 AS row_no FROM rw)"""

ORACLE_SQL = {
    "ocr_pieces": f"""WITH {_PAGE_WORDS}, a AS (SELECT doc_id, page_no, word_no AS n, text, (word_no % 10 * 130)::DOUBLE AS x0, (word_no // 10 * 60)::DOUBLE AS y0, CASE WHEN word_no % 7 <> 0 THEN word_no // 10 * 60 + 32 + word_no % 10 * page_no * 0.5::DOUBLE END AS bl FROM w WHERE word_no * 37 % 100 >= 10),
b AS (SELECT *, coalesce(bl, y0 + 40) AS yb, lag(x0) OVER o AS px0, lag(coalesce(bl, y0 + 40)) OVER o AS pyb FROM a WINDOW o AS (PARTITION BY doc_id, page_no ORDER BY n)),
s AS (SELECT doc_id, page_no, (yb - pyb) / (x0 - px0) AS s FROM b WHERE px0 IS NOT NULL AND x0 >= px0 + 98 AND x0 - px0 > 40 AND x0 - px0 - 100 <= 120 AND abs((yb - pyb) / (x0 - px0)) < 0.2),
m AS (SELECT doc_id, page_no, list(s ORDER BY s) AS l FROM s GROUP BY ALL), k AS (SELECT doc_id, page_no, CASE WHEN len(l) >= 5 THEN l[len(l) // 2 + 1] ELSE 0 END AS slope FROM m)
SELECT b.doc_id, b.page_no, n AS word_no, text AS str, round(x0 * 612 / 1275, 6) AS x, round((coalesce(bl, y0 + 32) - coalesce(slope, 0) * (x0 + 50)) * 792 / 1650, 6) AS y, 48.0::DOUBLE AS w, round(40 * 792 / 1650 * 0.85::DOUBLE, 6) AS fs
FROM b LEFT JOIN k USING (doc_id, page_no)""",
    "scanned_pages": r"""WITH p AS (SELECT conv_id AS doc_id, (turn + 1)::INT AS page_no, text FROM conversations),
c AS (SELECT *, length(regexp_replace(regexp_replace(text, '[a-z]', '', 'g'), '[\s\x0b\x{a0}\x{feff}]', '', 'g')) + CASE WHEN page_no % 3 = 0 THEN length(regexp_replace(text, '[\s\x0b\x{a0}\x{feff}]', '', 'g')) ELSE 0 END AS n FROM p)
SELECT doc_id, page_no, n < 25 AND 600 * page_no * 100 >= 0.25 * 612 * 792 AS scanned FROM c""",
    "markdown_blocks": r"""WITH ln AS (SELECT doc_id, (unnest(range(1, len(ls) + 1)) - 1)::INT AS n, unnest(ls) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
t AS (SELECT doc_id, n, raw AS s, n % 10 AS k FROM ln WHERE n % 10 <> 3),
u AS (SELECT *, CASE k WHEN 0 THEN '## ' WHEN 4 THEN '2. ' WHEN 5 THEN '> ' WHEN 6 THEN '### ' WHEN 9 THEN '' ELSE CASE WHEN k < 3 THEN '- ' ELSE '|' END END || s || CASE WHEN k IN (7, 8) THEN '|b|' ELSE '' END AS line FROM t),
f AS (SELECT doc_id, n, trim(line) AS line, CASE WHEN starts_with(line, '### ') THEN 'h3' WHEN starts_with(line, '## ') THEN 'h2' WHEN regexp_matches(trim(line), '^\|[\s:|-]+\|$') THEN 'skip'
  WHEN starts_with(trim(line), '|') AND ends_with(trim(line), '|') THEN 'table' WHEN regexp_matches(trim(line), '^[-*]\s') OR regexp_matches(trim(line), '^[0-9]+\.\s') THEN 'list' WHEN starts_with(trim(line), '>') THEN 'quote' ELSE 'p' END AS kind, line AS whole FROM u WHERE trim(line) <> ''),
g AS (SELECT *, CASE WHEN kind IN ('list', 'table') AND lag(kind) OVER o = kind AND (n - lag(n) OVER o) = 1 THEN 0 ELSE 1 END AS fresh FROM f WHERE kind <> 'skip' WINDOW o AS (PARTITION BY doc_id ORDER BY n)),
h AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY n) AS b FROM g),
i AS (SELECT *, CASE kind WHEN 'h2' THEN substr(whole, 4) WHEN 'h3' THEN substr(whole, 5) WHEN 'quote' THEN trim(substr(line, 2)) WHEN 'table' THEN line WHEN 'list' THEN regexp_replace(line, '^([-*]|[0-9]+\.)\s', '') ELSE line END AS item FROM h)
SELECT doc_id, min(n) AS first_line, CASE WHEN any_value(kind) = 'list' THEN CASE WHEN regexp_matches(arg_min(line, n), '^[-*]') THEN 'ul' ELSE 'ol' END ELSE any_value(kind) END AS kind, string_agg(item, '¦' ORDER BY n) AS items FROM i GROUP BY doc_id, b""",
    "text_stats": r"""WITH s AS (SELECT doc_id, length(text) AS chars, len(regexp_extract_all(text, '[^\s\x{a0}\x{feff}\x0b]+')) AS words, len(string_split(text, chr(10))) AS lines FROM documents)
SELECT doc_id, chars, words, CASE WHEN words = 0 THEN 0 ELSE greatest(1, ceil(chars / 1650.0::DOUBLE)) END::BIGINT AS pages, lines, greatest(1, ceil(words / 450.0::DOUBLE))::BIGINT AS markdown_pages FROM s""",
    "word_counts": f"SELECT w AS word, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest({_WORDS.format('text')}) AS w FROM documents) GROUP BY 1",
    "repeated_lines": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
k AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '#', 'g'), '[\s\x{a0}\x{feff}]+', ' ', 'g')) AS line_key FROM l)
SELECT doc_id, line_key, count(*) AS n FROM k WHERE line_key <> '' GROUP BY 1, 2 HAVING count(*) >= 3""",
    "clean_text": r"""WITH p AS (SELECT page_id, html AS h, url FROM pages),
d AS (SELECT *, replace(replace(replace(replace(replace(h, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&') AS t FROM p)
SELECT page_id, md5(t) AS plain_md5, md5(replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS escaped_md5,
  CASE WHEN url LIKE 'https://%' THEN url ELSE 'https://' || substr(url, 8) END AS url, (lower(url) LIKE '%ads%' OR lower(url) LIKE '%doubleclick.net%' OR lower(url) LIKE '%adnxs.com%') AS blocked,
  coalesce(regexp_matches(regexp_extract(h, '\p{L}'), '\p{Arabic}'), false) AS rtl FROM d""",
    "joined_lines": r"""SELECT doc_id, md5(list_reduce(string_split(regexp_replace(text, '([a-z]{4})([a-z]{3})', '\1-' || chr(10) || '\2', 'g'), chr(10)), lambda a, l: CASE WHEN regexp_matches(right(a, 2), '[A-Za-z]-$') AND regexp_matches(l, '^[a-z]')
  THEN left(a, length(a) - 1) || l WHEN a = '' OR regexp_matches(right(a, 1), '[\s\x0b]$') THEN a || l ELSE a || ' ' || l END)) AS joined_md5 FROM documents""",
    "inline_markup": r"""SELECT doc_id, md5(regexp_replace(regexp_replace(translate(text, '*`[', '___'), '([a-z]{9,})', '<strong>\1</strong>', 'g'), ' (the|de) ', ' <code>\1</code> ', 'g')) AS html_md5 FROM documents""",
    "numerals": """WITH d AS (SELECT doc_id, (doc_id % 3999 + 1)::BIGINT AS n FROM documents)
SELECT doc_id, repeat('M', n // 1000) || ['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][n // 100 % 10 + 1] || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][n // 10 % 10 + 1]
  || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][n % 10 + 1] AS roman,
  (WITH RECURSIVE a(left_, out_) AS (SELECT doc_id * 97, '' UNION ALL SELECT (left_ - 1) // 26, chr((97 + (left_ - 1) % 26)::INT) || out_ FROM a WHERE left_ > 0) SELECT out_ FROM a WHERE left_ = 0) AS alpha FROM d""",
    "multiset_recall": f"WITH {_LISTS} SELECT * FROM bag",
    "run_coverage_12": f"""WITH {_LISTS},
rg AS (SELECT id, len(ws) AS n, unnest(range(1, len(ws) - 10)) AS p, unnest(list_transform(range(1, len(ws) - 10), lambda i: array_to_string(ws[i:i+11], ' '))) AS g FROM r WHERE len(ws) >= 12),
og AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(ws) - 10), lambda i: array_to_string(ws[i:i+11], ' '))) AS g FROM o WHERE len(ws) >= 12),
h AS (SELECT DISTINCT ref_id, out_id, unnest(range(p, p + 12)) AS q FROM pairs JOIN rg ON rg.id = ref_id JOIN og ON og.id = out_id AND og.g = rg.g),
c AS (SELECT ref_id, out_id, count(*) AS n FROM h GROUP BY ALL)
SELECT pairs.ref_id, pairs.out_id, CASE WHEN len(r.ws) >= 12 THEN coalesce(c.n, 0)::DOUBLE / len(r.ws) ELSE bag.recall END AS coverage
FROM pairs JOIN r ON r.id = pairs.ref_id LEFT JOIN c USING (ref_id, out_id) LEFT JOIN bag USING (ref_id, out_id)""",
    "word_search": f"""WITH {_PAGE_WORDS} SELECT doc_id, page_no, word_no, text,
  round((word_no % 10) * 50 + 6 * (instr(lower(text), 'the') - 1), 6)::DOUBLE AS hit_x0, round((word_no % 10) * 50 + 6 * (instr(lower(text), 'the') + 2), 6)::DOUBLE AS hit_x1 FROM w WHERE contains(lower(text), 'the')""",
    "phrase_search": f"""WITH {_PAGE_WORDS}, m AS (SELECT *, lead(text) OVER (PARTITION BY doc_id, page_no ORDER BY word_no) AS nxt FROM w),
s AS (SELECT doc_id, page_no, word_no AS start_no, text, nxt FROM m WHERE contains(lower(text), 'of') AND contains(lower(nxt), 'th'))
SELECT doc_id, page_no, start_no, start_no AS word_no, text FROM s UNION ALL SELECT doc_id, page_no, start_no, start_no + 1, nxt FROM s""",
    "recent_items": """WITH u AS (SELECT user_id, (props->>'$.k')::INT AS item, max((ts, event_id)) AS l FROM events GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY l DESC) AS rank FROM u)
SELECT user_id, rank, item FROM k WHERE rank <= 6""",
    "favourite_items": """WITH u AS (SELECT user_id, (props->>'$.k')::INT AS item, max((ts, event_id)) AS l, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY l) AS rank, item FROM u WHERE n % 2 = 1""",
    "best_candidate": """WITH c AS (SELECT doc_id, n_chars AS o, CASE doc_id % 3 WHEN 0 THEN n_chars * 0.62::DOUBLE WHEN 1 THEN 900.0::DOUBLE END AS t, s, name, floor(n_chars * p / 100.0::DOUBLE + doc_id % 50)::BIGINT AS size
  FROM documents, (VALUES (0,'light',95),(1,'medium',102),(2,'strong',60),(3,'small',64),(4,'least',40)) v(s, name, p)),
b AS (SELECT *, min(size) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY size, s) AS nth FROM b WHERE before IS NULL OR (t IS NOT NULL AND before > t)),
f AS (SELECT *, least(size, o) AS best FROM k WHERE nth = 1)
SELECT doc_id, o AS original_size, best AS size, CASE WHEN size < o THEN name ELSE 'original' END AS mode, greatest(0, floor((1 - best::DOUBLE / o) * 100 + 0.5))::INT AS reduction, coalesce(best > t, false) AS missed FROM f""",
    "related_documents": """WITH p AS (SELECT a.doc_id AS id, b.doc_id AS related_id, row_number() OVER (PARTITION BY a.doc_id ORDER BY b.doc_id) AS rank FROM documents a JOIN documents b ON a.doc_id <> b.doc_id AND (a.lang = b.lang OR a.source = b.source))
SELECT id, rank, related_id FROM p WHERE rank <= 3""",
    "keyword_search": "SELECT p_partkey, p_name AS name FROM part WHERE contains(lower(p_name), 'widget') OR contains(lower(p_type), 'widget') OR contains(p_brand, 'widget')",
    "categories_first_seen": "SELECT source, min(doc_id) AS first_seq FROM documents GROUP BY 1",
    "wrap_lines": r"""WITH l AS (SELECT doc_id, (unnest(range(1, len(ls) + 1)) - 1)::INT AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
t AS (SELECT doc_id, line_no, flatten(list_transform(regexp_extract_all(line, '[\s\x0b\x{a0}]+|[^\s\x0b\x{a0}]+'), lambda t: CASE WHEN length(t) <= 80 OR regexp_matches(t, '^[\s\x0b\x{a0}]') THEN [{'t': t, 'cut': false}] ELSE list_transform(range((length(t) + 79) // 80), lambda i: {'t': t[i*80+1:i*80+80], 'cut': true}) END)) AS ts FROM l),
r AS (SELECT doc_id, line_no, list_reduce(list_prepend({'d': []::VARCHAR[], 'c': '', 'cut': false}, list_transform(ts, lambda x: {'d': []::VARCHAR[], 'c': x.t, 'cut': x.cut})), lambda s, x: CASE
  WHEN NOT x.cut AND length(s.c) + length(x.c) <= 80 THEN {'d': s.d, 'c': s.c || x.c, 'cut': false} WHEN regexp_matches(x.c, '^[\s\x0b\x{a0}]') THEN {'d': s.d || [regexp_replace(s.c, '[\s\x0b\x{a0}]+$', '')], 'c': '', 'cut': false}
  ELSE {'d': CASE WHEN regexp_matches(s.c, '[^\s\x0b\x{a0}]') THEN s.d || [regexp_replace(s.c, '[\s\x0b\x{a0}]+$', '')] ELSE s.d END, 'c': x.c, 'cut': false} END) AS s FROM t),
w AS (SELECT doc_id, line_no, s.d || [regexp_replace(s.c, '[\s\x0b\x{a0}]+$', '')] AS ws FROM r),
u AS (SELECT doc_id, line_no, (unnest(range(1, len(ws) + 1)) - 1)::INT AS k, unnest(ws) AS line FROM w),
v AS (SELECT *, max(CASE WHEN line <> '' THEN line_no * 1000000 + k END) OVER (PARTITION BY doc_id) AS last FROM u)
SELECT doc_id, line_no, k, line, ((row_number() OVER (PARTITION BY doc_id ORDER BY line_no, k) - 1) // 54 + 1)::INT AS page_no FROM v WHERE line_no * 1000000 + k <= last""",
    "weighted_mode": f"""WITH {_PIECES}, g AS (SELECT doc_id, floor(fs * 2 + 0.5) / 2 AS v, sum(length(s)) AS n, min(line_no * 10000 + k) AS f FROM pw GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) AS nth FROM g)
SELECT doc_id, v::DOUBLE AS value, n::BIGINT AS weight FROM b WHERE nth = 1""",
    "layout_rows": f"WITH {_PIECES} SELECT doc_id, page_no::INT AS page_no, row_no, n AS n_pieces, round(x0, 6) AS x0, round(x1, 6) AS x1 FROM rn",
    "layout_fragments": f"""WITH {_PIECES}, b AS (SELECT *, CASE WHEN col > lag(col + length(s)) OVER (PARTITION BY doc_id, line_no ORDER BY k) + 1 THEN 1 ELSE 0 END AS cut FROM pw),
f AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id, line_no ORDER BY k) AS frag_no FROM b)
SELECT f.doc_id, (f.line_no // 60 + 1)::INT AS page_no, rn.row_no, frag_no::BIGINT AS frag_no, string_agg(s, ' ' ORDER BY k) AS text, round(min(x), 6) AS x0, round(max(x + length(s) * f.fs * 0.6::DOUBLE), 6) AS x1,
  round(72 + any_value(f.line_no % 60) * 14.4::DOUBLE, 6) AS base, any_value(f.fs) AS size, any_value(f.bold) AS bold FROM f JOIN rn ON rn.doc_id = f.doc_id AND rn.line_no = f.line_no GROUP BY ALL""",
    "headings": f"""WITH {_PIECES}, g AS (SELECT doc_id, fs, sum(chars) AS n, min(page_no * 100000 + row_no) AS f FROM rn GROUP BY 1, 2),
b AS (SELECT doc_id, fs AS body FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) AS nth FROM g) WHERE nth = 1),
t AS (SELECT rn.*, body, trim(regexp_replace(line, ' +', ' ', 'g')) AS shown, count(*) OVER (PARTITION BY rn.doc_id, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '#', 'g'), ' +', ' ', 'g'))) AS times FROM rn JOIN b USING (doc_id)),
u AS (SELECT *, len(string_split(shown, ' ')) AS words, len(string_split(shown, ' ')) <= 20 AND regexp_matches(shown, '[A-Za-z]{{2}}') AND times < 3 AS short FROM t),
v AS (SELECT *, bool_or(short AND fs >= body * 1.15::DOUBLE) OVER (PARTITION BY doc_id) AS larger FROM u),
l AS (SELECT *, CASE WHEN short AND fs >= body * 1.15::DOUBLE THEN 1 WHEN bold AND short AND words <= 14 AND fs >= body * 0.95::DOUBLE AND NOT regexp_matches(shown, '[.,;:]$') THEN CASE WHEN larger THEN 2 ELSE 1 END ELSE 0 END AS level FROM v)
SELECT doc_id, page_no::INT AS page_no, row_no, shown AS text, fs AS size, level FROM l WHERE level > 0""",
    "page_statistics": """WITH p AS (SELECT conv_id AS doc_id, turn + 1 AS page_no, text, length(text)::DOUBLE AS n FROM conversations),
g AS (SELECT doc_id, quantile_cont(n, 0.5) AS median, list(n ORDER BY n) AS l, floor(avg(n::BIGINT % 101) + 0.5)::INT AS mean_confidence FROM p GROUP BY 1)
SELECT doc_id, median, l[least(len(l) - 1, greatest(0, floor(0.9::DOUBLE * (len(l) - 1) + 0.5)))::INT + 1] AS p90, mean_confidence FROM g""",
    "page_texts": """SELECT conv_id AS doc_id, (turn + 1)::INT AS page_no, md5('--- Page ' || turn + 1 || ' ---' || chr(10) || text) AS text_md5 FROM conversations""",
}
