"""Queries over pages and page geometry, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelab.functions import geometry as G
from quirelab.functions import ranges as R
from quirelab.functions import scores as S
from quirelab.operators import page_ops as P
from quirelab.sources import tables as T

SPLIT, EXTRACT = "1-2, 4", "2-3, 1, 3"
ZIP_NAMES = ("a (2).pdf", "a.pdf", "a.pdf", "b", "x.tar.gz", "b")


def _docs(pages: DataFrame, spec: str) -> DataFrame:
    d = P.page_counts(pages).withColumn("name", F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".PDF")))
    return d.withColumn("ranges", R.parse_ranges(F.lit(spec), F.col("page_count"))["ranges"]).filter("ranges is not null")


def split_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = T.pages(spark, sf_dir)
    return P.split_pages(_docs(pages, SPLIT), pages.select("doc_id", "page_no", "text")).select("doc_id", "file_no", "file_name", "page_no", "text")


def extract_separate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = T.pages(spark, sf_dir)
    return P.extract_separate(_docs(pages, EXTRACT), pages.select("doc_id", "page_no", "role")).select("doc_id", "file_no", "file_name", "page_count", "page_no", "role")


def extract_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = T.pages(spark, sf_dir)
    return P.extract_merged(_docs(pages, EXTRACT), pages.select("doc_id", "page_no", "role")).select("doc_id", "file_name", "page_count", "page_no", "role")


def range_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = F.explode(F.array(*map(F.lit, ("1-2, 4", "5-2", "a", "", " , ", "3", "0", "1-99", "2,x,9", "2-1")))).alias("spec")
    d = P.page_counts(T.pages(spark, sf_dir)).select("doc_id", "page_count", specs)
    r = R.parse_ranges(F.col("spec"), F.col("page_count"))
    text = F.array_join(F.transform(r["ranges"], lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return d.select("doc_id", "spec", r["error"].alias("error"), text.alias("ranges"))


def page_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = F.explode(F.array(*map(F.lit, ("1, 2", "3abc", "1-5", "x", "", "9", "+2")))).alias("spec")
    d = P.page_counts(T.pages(spark, sf_dir)).select("doc_id", "page_count", specs)
    r = R.parse_page_list(F.col("spec"), F.col("page_count"))
    return d.select("doc_id", "spec", r["error"].alias("error"), F.array_join(F.transform(r["ranges"], lambda x: x["start"].cast("string")), ",").alias("pages"))


def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = P.page_counts(T.pages(spark, sf_dir)).withColumn("r", F.explode(R.fixed_ranges(F.lit(3), F.col("page_count"))["ranges"]))
    return d.select("doc_id", F.col("r.start").alias("start_page"), F.col("r.end").alias("end_page"))


def size_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = P.page_counts(T.pages(spark, sf_dir)).withColumn("c", R.size_ranges(F.lit(4), F.col("page_count")))
    d = d.select("doc_id", F.col("c.error").alias("error"), F.explode_outer("c.ranges").alias("r"))
    return d.select("doc_id", "error", F.col("r.start").alias("start_page"), F.col("r.end").alias("end_page"))


def pages_to_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = T.pages(spark, sf_dir).filter((F.col("role") != "assistant") | (F.char_length("text") < 900))
    return P.islands(chosen).select("doc_id", F.col("start").alias("start_page"), F.col("end").alias("end_page"))


def remove_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = T.pages(spark, sf_dir)
    gone = pages.select("doc_id").distinct().withColumn("page_no", F.explode(F.array(F.lit(1), F.lit(3), F.lit(77))))
    return P.remove_pages(pages, gone).select("doc_id", "page_no", "role")


def merge_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = T.pages(spark, sf_dir).withColumn("job_id", F.floor(F.col("doc_id") / 10)).withColumn("file_seq", -F.col("doc_id"))
    return P.merge(pages).select("job_id", "out_page", "doc_id", "page_no")


def total_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = P.append_capped(P.page_counts(T.pages(spark, sf_dir)).select(F.floor(F.col("doc_id") / 40).alias("job_id"), F.col("doc_id").alias("file_seq"), "page_count"))
    known = F.when(F.col("file_seq") % 7 != 0, F.col("page_count"))
    return files.groupBy("job_id").agg(F.sum(F.coalesce(known, F.lit(0))).alias("total_pages"), F.count(F.lit(1)).alias("n_files"))


def organize_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = T.pages(spark, sf_dir).withColumn("page_rotation", (F.col("page_no") % 4) * 90).withColumn("width", F.lit(612.0)).withColumn("height", F.lit(792.0))
    plan = spark.createDataFrame([(0, "original", 2, 90), (1, "blank", None, 90), (2, "original", 0, 270), (3, "original", 5, 180), (4, "original", 0, 0), (5, "original", -1, 0)], "op_seq int, type string, original_index int, rotation int")
    ops = pages.select("doc_id").distinct().crossJoin(F.broadcast(plan))  # a plan of six rows, for each document
    return P.organize(pages, ops).select("doc_id", "out_page", "type", "page_no", "out_rotation", "width", "height")


def move_selected_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, chosen = T.pages(spark, sf_dir), F.col("role") == "assistant"
    back = P.move_selected(pages, chosen, front=False).select("doc_id", "page_no", F.col("new_seq").alias("seq_to_end"))
    return P.move_selected(pages, chosen).select("doc_id", "page_no", "new_seq").join(back, ["doc_id", "page_no"])


def move_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.col("page_no")
    return T.pages(spark, sf_dir).select("doc_id", "page_no", P.move_one(seq, F.lit(1), F.lit(3)).alias("down"), P.move_one(seq, F.lit(4), F.lit(2)).alias("up"))


def insert_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.insert_blank(T.pages(spark, sf_dir), F.col("role") == "system").select("doc_id", "page_no", "type", "new_seq")


def rotate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = T.pages(spark, sf_dir).withColumn("rotation", (F.col("page_no") % 4) * 90)
    turns = pages.select("doc_id").distinct().withColumn("t", F.explode(F.expr("array(struct(0 as i, 90 as a), struct(2 as i, 180 as a), struct(0 as i, 270 as a), struct(40 as i, 90 as a))")))
    turns = turns.select("doc_id", F.col("t.i").alias("page_index"), F.col("t.a").alias("angle"))
    return P.rotate(pages, turns).select("doc_id", "page_no", "rotation")


def zip_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = T.pages(spark, sf_dir).select(F.col("doc_id").alias("job_id"), F.col("page_no").alias("file_seq"), F.element_at(F.array(*map(F.lit, ZIP_NAMES)), (F.col("page_no") % len(ZIP_NAMES) + 1).cast("int")).alias("name"))
    return P.unique_names(files).select("job_id", "file_seq", "unique_name")


def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, cover = F.col("page_no"), F.col("doc_id") % 2 == 0
    label = G.page_label(F.lit("{n} of {total}, {n}"), n, F.lit(10), F.lit(2), F.lit(5))
    spot = G.mirrored(F.element_at(F.array(*map(F.lit, ("tl", "mc", "br"))), (n % 3 + 1).cast("int")), n, F.lit(True), cover)
    margin = G.label_margin(F.element_at(F.array(*map(F.lit, ("small", "none", "recommended", "medium"))), (n % 4 + 1).cast("int")))
    p = T.pages(spark, sf_dir).select("doc_id", "page_no", label.alias("label"), spot.alias("spot"), margin.alias("margin")).filter("label is not null")
    x, y = G.anchored(F.col("spot"), F.lit(612.0), F.lit(792.0), G.mono_width(F.col("label"), F.lit(12.0)), F.lit(12.0), F.col("margin"))
    return p.select("doc_id", "page_no", "label", "spot", x.alias("x"), y.alias("y"))


def watermark_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.lit(612.0) * F.element_at(F.array(*map(F.lit, G.IMAGE_SCALE.values())), (F.col("page_no") % 3 + 1).cast("int"))
    h, spot = w * 0.4, F.element_at(F.array(*map(F.lit, ("tl", "mc", "br", "tr", "bl"))), (F.col("doc_id") % 5 + 1).cast("int"))
    x, y = G.anchored(spot, F.lit(612.0), F.lit(792.0), w, h, F.lit(36.0))
    tx, ty = G.turned_corner(x + w / 2, y + h / 2, w, h, F.col("page_no") * 15)
    r = lambda c: F.round(c, 6)
    return T.pages(spark, sf_dir).select("doc_id", "page_no", r(w).alias("w"), r(h).alias("h"), r(tx).alias("x"), r(ty).alias("y"), (1 - F.lit(40) / 100).alias("opacity"))


def crop_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_no")
    top, left = (n % 3) * 10.0, (n % 2) * 5.0
    box = G.crop_box(n * 90 - 180, F.lit(10.0), F.lit(20.0), F.lit(612.0), F.lit(792.0), top, left, 100 - 2 * left, 100 - 1.5 * top)
    r = lambda c: F.round(c, 6)
    return T.pages(spark, sf_dir).select("doc_id", "page_no", box.alias("b")).select("doc_id", "page_no", *[r(F.col(f"b.{k}")).alias(k) for k in "xywh"])


def image_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.char_length("text")
    fit = G.image_fit((n % 1900 + 100).cast("double"), (F.col("page_no") * 300).cast("double"), F.element_at(F.array(*map(F.lit, ("auto", "portrait", "landscape"))), (F.col("doc_id") % 3 + 1).cast("int")), F.element_at(F.array(*map(F.lit, ("fit", "fill", "original"))), (F.col("page_no") % 3 + 1).cast("int")), F.lit(36.0))
    r = lambda c: F.round(c, 6)
    return T.pages(spark, sf_dir).select("doc_id", "page_no", fit.alias("f")).select("doc_id", "page_no", *[r(F.col(f"f.{k}")).alias(k) for k in ("page_w", "page_h", "x", "y", "w", "h")])


def file_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") * F.col("n_chars") * 37).alias("n"), "source", "lang")
    name = F.concat("source", F.lit("."), F.when(F.col("doc_id") % 2 == 0, "PDF").otherwise("PnG"))
    score = S.password_score(F.concat("source", F.upper("lang"), F.when(F.col("doc_id") % 3 == 0, "!").otherwise("")))
    return d.select(
        "doc_id", S.file_size(F.col("n")).alias("short_size"), S.report_size(F.col("n")).alias("report_size"), S.extension(name).alias("extension"),
        S.pdf_error(name, F.lit(None).cast("string"), F.col("n")).alias("pdf_error"), S.image_error(name, F.lit("text/plain"), F.col("n")).alias("image_error"), S.password_label(score).alias("password"),
    )


def health_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    bit = lambda i: F.col("doc_id").bitwiseAND(F.lit(1 << i)) == 0
    c = {k: bit(i) for i, k in enumerate(("header", "eof", "xref", "trailer", "strict", "tolerant", "metadata"))}
    c |= {"encrypted": ~bit(7), "object_errors": F.col("doc_id") % 8, "stream_errors": F.col("doc_id") % 7}
    d = T.table(spark, sf_dir, "documents").select("doc_id", S.health_score(c).alias("score"), S.recovery(c["encrypted"], c["tolerant"], c["strict"], F.col("doc_id") % 4, F.col("doc_id") % 3).alias("r"))
    return d.select("doc_id", "score", S.health_label(F.col("score")).alias("label"), F.col("r.status").alias("status"), F.col("r.chance").alias("chance"), S.recovery_rate(F.col("doc_id") % 5, F.col("doc_id") % 6).alias("rate"))


def health_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    bit = lambda i: F.col("doc_id").bitwiseAND(F.lit(1 << i)) == 0
    c = {k: bit(i) for i, k in enumerate(("header", "eof", "xref", "trailer", "strict", "tolerant", "metadata", "recoverable"))}
    c |= {"encrypted": F.col("doc_id") % 9 == 0, "object_errors": F.col("doc_id") % 8, "stream_errors": F.col("doc_id") % 7}
    d = T.table(spark, sf_dir, "documents").select("doc_id", S.issues(c).alias("i"))
    count = lambda f: F.size(F.filter("i", f))
    return d.select("doc_id", F.array_join(F.transform("i", lambda x: x["id"]), ",").alias("ids"), count(lambda x: x["severity"] == "critical").alias("critical"), count(lambda x: x["fixable"]).alias("fixable"))


QUERIES = {f.__name__: f for f in (
    health_issues, split_pages, extract_separate, extract_merged, range_errors, page_list, fixed_chunks, size_chunks, pages_to_ranges, remove_pages, merge_documents, total_pages,
    organize_pages, move_selected_front, move_item, insert_blank, rotate_pages, zip_names, page_labels, watermark_boxes, crop_boxes, image_fit, file_labels, health_scores,
)}

_P = "p AS (SELECT conv_id AS doc_id, (turn + 1)::INT AS page_no, role, text FROM conversations), c AS (SELECT doc_id, count(*)::INT AS n FROM p GROUP BY 1)"
_SPEC = """s AS (SELECT (row_number() OVER () - 1)::INT AS file_no, regexp_extract(trim(x), '^([0-9]+)', 1)::INT AS a,
  coalesce(nullif(regexp_extract(trim(x), '-([0-9]+)$', 1), ''), regexp_extract(trim(x), '^([0-9]+)', 1))::INT AS b FROM (SELECT unnest(string_split('{}', ',')) AS x)),
d AS (SELECT doc_id, n FROM c WHERE n >= (SELECT max(b) FROM s))"""

ORACLE_SQL = {
    "health_issues": """WITH d AS (SELECT doc_id, doc_id & 1 > 0 AS b0, doc_id & 2 > 0 AS b1, doc_id & 4 > 0 AS b2, doc_id & 8 > 0 AS b3, doc_id & 16 > 0 AS b4, doc_id & 32 > 0 AS b5, doc_id & 64 > 0 AS b6, doc_id & 128 > 0 AS b7,
  doc_id % 8 AS o, doc_id % 7 AS s, doc_id % 9 = 0 AS e FROM documents)
SELECT doc_id, concat_ws(',', CASE WHEN b0 THEN 'no-header' END, CASE WHEN b1 THEN 'no-eof' END, CASE WHEN b2 THEN 'no-xref' END, CASE WHEN b3 THEN 'no-trailer' END, CASE WHEN e THEN 'encrypted' END,
  CASE WHEN o > 0 THEN 'object-mismatch' END, CASE WHEN s > 0 THEN 'stream-mismatch' END, CASE WHEN b4 AND NOT b5 THEN 'strict-parse-fail' END, CASE WHEN b4 AND b5 AND b7 THEN 'unreadable' END, CASE WHEN b6 AND NOT b4 THEN 'corrupt-metadata' END) AS ids,
  (b0::INT + b1::INT + b2::INT + b3::INT + e::INT + (o > 5)::INT + (s > 3)::INT + (b4 AND b5 AND b7)::INT)::INT AS critical,
  (b0::INT + b1::INT + b2::INT + b3::INT + (o > 0)::INT + (s > 0)::INT + (b4 AND NOT b5)::INT + (b6 AND NOT b4)::INT)::INT AS fixable FROM d""",
    "split_pages": f"""WITH {_P}, {_SPEC.format(SPLIT)}
SELECT p.doc_id, s.file_no, 'doc' || p.doc_id || '_' || a || CASE WHEN a <> b THEN '-' || b ELSE '' END || '.pdf' AS file_name, p.page_no, p.text
FROM d JOIN p USING (doc_id) JOIN s ON p.page_no BETWEEN a AND b""",
    "extract_separate": f"""WITH {_P}, {_SPEC.format(EXTRACT)}
SELECT p.doc_id, s.file_no, 'doc' || p.doc_id || '_p' || a || CASE WHEN a <> b THEN '-' || b ELSE '' END || '.pdf' AS file_name, b - a + 1 AS page_count, p.page_no, p.role
FROM d JOIN p USING (doc_id) JOIN s ON p.page_no BETWEEN a AND b""",
    "extract_merged": f"""WITH {_P}, {_SPEC.format(EXTRACT)}, w AS (SELECT DISTINCT unnest(range(a, b + 1))::INT AS page_no FROM s)
SELECT p.doc_id, 'doc' || p.doc_id || '_extracted_p' || (SELECT min(page_no) FROM w) || '-' || (SELECT max(page_no) FROM w) || '.pdf' AS file_name,
       (SELECT count(*) FROM w)::INT AS page_count, p.page_no, p.role FROM d JOIN p USING (doc_id) JOIN w USING (page_no)""",
    "range_errors": f"""WITH {_P}, sp AS (SELECT unnest(['1-2, 4', '5-2', 'a', '', ' , ', '3', '0', '1-99', '2,x,9', '2-1']) AS spec),
q AS (SELECT doc_id, n, spec, list_filter(list_transform(string_split(spec, ','), lambda x: trim(x)), lambda x: x <> '') AS ps FROM c, sp),
u AS (SELECT doc_id, n, spec, unnest(ps) AS part, unnest(range(1, len(ps) + 1)) AS k FROM q),
v AS (SELECT *, try_cast(regexp_extract(part, '^([0-9]+)(-[0-9]+)?$', 1) AS INT) AS a, try_cast(regexp_extract(part, '^[0-9]+-([0-9]+)$', 1) AS INT) AS b0 FROM u),
x AS (SELECT *, coalesce(b0, a) AS b FROM v),
e AS (SELECT *, CASE WHEN a IS NULL THEN 'format' WHEN a < 1 OR a > n THEN 'start' WHEN b < 1 OR b > n THEN 'end' WHEN a > b THEN 'reversed' END AS err FROM x),
g AS (SELECT doc_id, spec, arg_min(err, k) FILTER (WHERE err IS NOT NULL) AS err, string_agg(a || '-' || b, ',' ORDER BY k) AS r FROM e GROUP BY ALL)
SELECT q.doc_id, q.spec, CASE WHEN len(ps) = 0 THEN 'empty' ELSE err END AS error, CASE WHEN len(ps) > 0 AND err IS NULL THEN r END AS ranges FROM q LEFT JOIN g USING (doc_id, spec)""",
    "page_list": f"""WITH {_P}, sp AS (SELECT unnest(['1, 2', '3abc', '1-5', 'x', '', '9', '+2']) AS spec),
q AS (SELECT doc_id, n, spec, list_filter(list_transform(string_split(spec, ','), lambda x: trim(x)), lambda x: x <> '') AS ps FROM c, sp),
u AS (SELECT doc_id, n, spec, unnest(ps) AS part, unnest(range(1, len(ps) + 1)) AS k FROM q),
e AS (SELECT *, try_cast(regexp_extract(part, '^([+-]?[0-9]+)', 1) AS INT) AS a FROM u),
f AS (SELECT *, CASE WHEN a IS NULL THEN 'number' WHEN a < 1 OR a > n THEN 'bounds' END AS err FROM e),
g AS (SELECT doc_id, spec, arg_min(err, k) FILTER (WHERE err IS NOT NULL) AS err, string_agg(a, ',' ORDER BY k) AS r FROM f GROUP BY ALL)
SELECT q.doc_id, q.spec, CASE WHEN len(ps) = 0 THEN 'empty' ELSE err END AS error, CASE WHEN len(ps) > 0 AND err IS NULL THEN r END AS pages FROM q LEFT JOIN g USING (doc_id, spec)""",
    "fixed_chunks": f"WITH {_P} SELECT doc_id, s::INT AS start_page, least(s + 2, n)::INT AS end_page FROM (SELECT doc_id, n, unnest(range(1, n + 1, 3)) AS s FROM c)",
    "size_chunks": f"""WITH {_P} SELECT doc_id, NULL::VARCHAR AS error, s::INT AS start_page, least(s + 3, n)::INT AS end_page FROM (SELECT doc_id, n, unnest(range(1, n + 1, 4)) AS s FROM c WHERE n > 4)
UNION ALL SELECT doc_id, 'too_large', NULL, NULL FROM c WHERE n <= 4""",
    "pages_to_ranges": f"""WITH {_P}, k AS (SELECT doc_id, page_no, page_no - row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS g FROM p WHERE role <> 'assistant' OR length(text) < 900)
SELECT doc_id, min(page_no) AS start_page, max(page_no) AS end_page FROM k GROUP BY doc_id, g""",
    "remove_pages": f"WITH {_P} SELECT doc_id, page_no, role FROM p WHERE page_no NOT IN (1, 3, 77)",
    "merge_documents": f"WITH {_P} SELECT doc_id // 10 AS job_id, row_number() OVER (PARTITION BY doc_id // 10 ORDER BY doc_id DESC, page_no) AS out_page, doc_id, page_no FROM p",
    "total_pages": f"""WITH {_P}, f AS (SELECT doc_id // 40 AS job_id, doc_id, n, row_number() OVER (PARTITION BY doc_id // 40 ORDER BY doc_id) AS k FROM c)
SELECT job_id, sum(CASE WHEN doc_id % 7 <> 0 THEN n ELSE 0 END)::BIGINT AS total_pages, count(*) AS n_files FROM f WHERE k <= 20 GROUP BY 1""",
    "organize_pages": f"""WITH {_P}, o AS (SELECT * FROM (VALUES (0,'original',2,90),(1,'blank',NULL,90),(2,'original',0,270),(3,'original',5,180),(4,'original',0,0),(5,'original',-1,0)) o(s, type, i, r)),
j AS (SELECT c.doc_id, o.*, p.page_no FROM c CROSS JOIN o LEFT JOIN p ON p.doc_id = c.doc_id AND p.page_no = o.i + 1 WHERE type = 'blank' OR p.page_no IS NOT NULL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS out_page, type, page_no, CASE WHEN type = 'blank' THEN r ELSE ((page_no % 4) * 90 + r) % 360 END AS out_rotation,
       CASE WHEN type = 'blank' THEN 595.28 ELSE 612 END::DOUBLE AS width, CASE WHEN type = 'blank' THEN 841.89 ELSE 792 END::DOUBLE AS height FROM j""",
    "move_selected_front": f"""WITH {_P} SELECT doc_id, page_no, row_number() OVER (PARTITION BY doc_id ORDER BY role <> 'assistant', page_no) AS new_seq,
       row_number() OVER (PARTITION BY doc_id ORDER BY role = 'assistant', page_no) AS seq_to_end FROM p""",
    "move_item": f"""WITH {_P} SELECT doc_id, page_no, CASE page_no WHEN 1 THEN 3 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE page_no END AS down, CASE page_no WHEN 4 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE page_no END AS up FROM p""",
    "insert_blank": f"""WITH {_P}, b AS (SELECT doc_id, coalesce(max(page_no) FILTER (WHERE role = 'system'), max(page_no)) AS page_no FROM p GROUP BY 1),
u AS (SELECT doc_id, page_no, 'original' AS type, 0 AS k FROM p UNION ALL SELECT doc_id, page_no, 'blank', 1 FROM b)
SELECT doc_id, page_no, type, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, k) AS new_seq FROM u""",
    "rotate_pages": f"WITH {_P} SELECT doc_id, page_no, (((page_no % 4) * 90 + CASE page_no WHEN 1 THEN 360 WHEN 3 THEN 180 ELSE 0 END) % 360)::INT AS rotation FROM p",
    "zip_names": r"""WITH RECURSIVE f AS (SELECT conv_id AS job_id, (turn + 1)::INT AS file_seq, ['a (2).pdf', 'a.pdf', 'a.pdf', 'b', 'x.tar.gz', 'b'][(turn + 1) % 6 + 1] AS name FROM conversations),
r(job_id, file_seq, used, unique_name) AS (SELECT DISTINCT job_id, 0, []::VARCHAR[], NULL::VARCHAR FROM f UNION ALL SELECT job_id, file_seq, list_append(used, u), u FROM (SELECT f.job_id, f.file_seq, r.used,
  CASE WHEN list_contains(r.used, f.name) THEN list_filter(list_transform(range(2, 99), lambda n: regexp_replace(f.name, '(\.[^.]*)?$', ' (' || n || ')\1')), lambda c: NOT list_contains(r.used, c))[1] ELSE f.name END AS u FROM r JOIN f ON f.job_id = r.job_id AND f.file_seq = r.file_seq + 1))
SELECT job_id, file_seq, unique_name FROM r WHERE file_seq > 0""",
    "page_labels": f"""WITH {_P}, l AS (SELECT doc_id, page_no, (page_no + 8) || ' of 4, ' || (page_no + 8) AS label, ['tl', 'mc', 'br'][page_no % 3 + 1] AS raw,
  [18.0, 36.0, 54.0, 36.0][page_no % 4 + 1]::DOUBLE AS m, CASE WHEN doc_id % 2 = 0 THEN page_no % 2 = 0 ELSE page_no % 2 = 1 END AS is_left FROM p WHERE page_no BETWEEN 2 AND 5),
s AS (SELECT *, CASE WHEN is_left THEN raw[1] || translate(raw[2], 'lr', 'rl') ELSE raw END AS spot, length(label) * 12.0::DOUBLE * 0.6::DOUBLE AS w FROM l)
SELECT doc_id, page_no, label, spot, CASE spot[2] WHEN 'l' THEN m WHEN 'c' THEN 612.0::DOUBLE / 2 - w / 2 ELSE 612.0::DOUBLE - m - w END AS x,
       CASE spot[1] WHEN 't' THEN 792.0::DOUBLE - m - 12 WHEN 'm' THEN 792.0::DOUBLE / 2 - 6 ELSE m END AS y FROM s""",
    "watermark_boxes": f"""WITH {_P}, b AS (SELECT doc_id, page_no, 612.0::DOUBLE * [0.25, 0.5, 0.8][page_no % 3 + 1]::DOUBLE AS w, ['tl', 'mc', 'br', 'tr', 'bl'][doc_id % 5 + 1] AS s FROM p),
g AS (SELECT *, w * 0.4::DOUBLE AS h FROM b),
k AS (SELECT *, CASE s[2] WHEN 'l' THEN 36 + w / 2 WHEN 'c' THEN 306 ELSE 576 - w / 2 END AS cx, CASE s[1] WHEN 't' THEN 756 - h / 2 WHEN 'm' THEN 396 ELSE 36 + h / 2 END AS cy, radians(page_no * 15) AS t FROM g)
SELECT doc_id, page_no, round(w, 6) AS w, round(h, 6) AS h, round(cx - w / 2 * cos(t) + h / 2 * sin(t), 6) AS x, round(cy - w / 2 * sin(t) - h / 2 * cos(t), 6) AS y, 0.6::DOUBLE AS opacity FROM k""",
    "crop_boxes": f"""WITH {_P}, f AS (SELECT doc_id, page_no, ((page_no * 90 - 180) % 360 + 360) % 360 AS r, (page_no % 3) * 0.1::DOUBLE AS t, (page_no % 2) * 0.05::DOUBLE AS l FROM p),
g AS (SELECT *, 1 - 2 * l AS w, 1 - 1.5::DOUBLE * t AS h FROM f),
k AS (SELECT *, CASE r WHEN 90 THEN t WHEN 180 THEN 1 - l - w WHEN 270 THEN 1 - t - h ELSE l END AS fx, CASE r WHEN 90 THEN l WHEN 180 THEN t WHEN 270 THEN 1 - l - w ELSE 1 - t - h END AS fy,
  CASE WHEN r IN (90, 270) THEN h ELSE w END AS fw, CASE WHEN r IN (90, 270) THEN w ELSE h END AS fh, NOT (t = 0 AND l = 0) AS cut FROM g)
SELECT doc_id, page_no, CASE WHEN cut THEN round(10 + fx * 612, 6) END AS x, CASE WHEN cut THEN round(20 + fy * 792, 6) END AS y, CASE WHEN cut THEN round(fw * 612, 6) END AS w,
       CASE WHEN cut THEN round(fh * 792, 6) END AS h FROM k""",
    "image_fit": f"""WITH {_P}, i AS (SELECT doc_id, page_no, (length(text) % 1900 + 100)::DOUBLE AS iw, (page_no * 300)::DOUBLE AS ih, doc_id % 3 AS o, page_no % 3 AS f FROM p),
b AS (SELECT *, CASE WHEN o = 2 OR (o = 0 AND iw > ih) THEN 841.89 ELSE 595.28 END::DOUBLE AS pw, CASE WHEN o = 2 OR (o = 0 AND iw > ih) THEN 595.28 ELSE 841.89 END::DOUBLE AS ph FROM i),
s AS (SELECT *, CASE f WHEN 0 THEN least((pw-72)/iw, (ph-72)/ih) WHEN 1 THEN greatest((pw-72)/iw, (ph-72)/ih) ELSE least((pw-72)/iw, (ph-72)/ih, 1) END AS k FROM b)
SELECT doc_id, page_no, pw AS page_w, ph AS page_h, round(36 + (pw - 72 - iw*k)/2, 6) AS x, round(36 + (ph - 72 - ih*k)/2, 6) AS y, round(iw*k, 6) AS w, round(ih*k, 6) AS h FROM s""",
    "file_labels": """WITH d AS (SELECT doc_id, n_chars * n_chars * 37 AS n, source, CASE WHEN doc_id % 2 = 0 THEN 'pdf' ELSE 'png' END AS ext, source || upper(lang) || CASE WHEN doc_id % 3 = 0 THEN '!' ELSE '' END AS pw FROM documents),
u AS (SELECT *, CASE WHEN n < 1024 THEN 0 WHEN n < 1048576 THEN 1 WHEN n < 1073741824 THEN 2 ELSE 3 END AS i,
  (length(pw) > 5)::INT + (length(pw) > 8)::INT + regexp_matches(pw, '[A-Z]')::INT + regexp_matches(pw, '[a-z]')::INT + regexp_matches(pw, '[0-9]')::INT + regexp_matches(pw, '[^A-Za-z0-9]')::INT AS sc FROM d),
v AS (SELECT *, floor(n * 10 / pow(1024.0, i) + 0.5)::BIGINT AS t FROM u)
SELECT doc_id, (t // 10) || CASE WHEN t % 10 = 0 THEN '' ELSE '.' || (t % 10) END || ' ' || ['B', 'KB', 'MB', 'GB'][i + 1] AS short_size,
  CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', floor(n * 10 / 1024.0::DOUBLE + 0.5) / 10) ELSE printf('%.2f MB', floor(n * 100 / 1048576.0::DOUBLE + 0.5) / 100) END AS report_size, ext AS extension,
  CASE WHEN ext <> 'pdf' THEN 'type' WHEN n > 52428800 THEN 'size' END AS pdf_error, CASE WHEN ext <> 'png' THEN 'type' WHEN n > 52428800 THEN 'size' END AS image_error,
  CASE WHEN sc = 0 THEN 'None' WHEN sc < 3 THEN 'Weak' WHEN sc < 5 THEN 'Medium' ELSE 'Strong' END AS password FROM v""",
    "health_scores": """WITH d AS (SELECT doc_id, doc_id & 1 AS b0, (doc_id >> 1) & 1 AS b1, (doc_id >> 2) & 1 AS b2, (doc_id >> 3) & 1 AS b3, (doc_id >> 4) & 1 AS b4, (doc_id >> 5) & 1 AS b5, (doc_id >> 6) & 1 AS b6, (doc_id >> 7) & 1 AS b7 FROM documents),
s AS (SELECT *, greatest(0, least(100, 100 - 25*b0 - 15*b1 - 20*b2 - 15*b3 - 30*b7*b4 - 20*b4 - 30*b5 - least(doc_id % 8 * 3, 15) - least(doc_id % 7 * 2, 10) - 3*b6))::INT AS score, doc_id % 4 AS cr, doc_id % 3 AS fx FROM d)
SELECT doc_id, score, CASE WHEN score >= 90 THEN 'Excellent' WHEN score >= 70 THEN 'Good' WHEN score >= 50 THEN 'Fair' ELSE 'Poor' END AS label,
  CASE WHEN b7 = 1 THEN 'locked' WHEN b5 = 1 AND b4 = 1 THEN 'unreadable' WHEN cr = 0 THEN 'healthy' WHEN fx >= cr THEN 'repairable' ELSE 'partial' END AS status,
  CASE WHEN b7 = 1 OR (b5 = 1 AND b4 = 1) THEN 'Low' WHEN cr = 0 THEN 'High' WHEN fx >= cr AND cr <= 2 THEN 'High' ELSE 'Medium' END AS chance,
  CASE WHEN doc_id % 6 > 0 THEN floor((doc_id % 5)::DOUBLE / (doc_id % 6) * 100 + 0.5)::INT ELSE 0 END AS rate FROM s""",
}
