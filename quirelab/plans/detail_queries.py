"""Queries over values, bytes, catalogues, layout details and files' contents, and their SQL. Each runs over a whole table; arguments vary by row."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelab.functions import geometry as G
from quirelab.functions import ranges as R
from quirelab.functions import scores as S
from quirelab.functions import text as X
from quirelab.functions.text import bound
from quirelab.operators import catalog_ops as C
from quirelab.operators import layout_ops as L
from quirelab.operators import ocr_ops as W
from quirelab.operators import page_ops as P
from quirelab.operators import text_ops as O
from quirelab.sources import files as S3
from quirelab.sources import tables as T


def _one_of(values: tuple, place: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(place, F.lit(len(values))) + 1).cast("int"))


def _sql_one_of(values: tuple, place: str) -> str:
    shown = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v) for v in values)
    return f"[{shown}][{place} % {len(values)} + 1]"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "documents")


def _md5(c: Column) -> Column:
    return F.md5(c.cast("binary"))


FONTS = ("ABCDEF+NimbusRomNo9L-Medi", "CMBX10", "Arial,Bd", "Foo-It", "CMTI10", "Times-Roman", "Helvetica-BoldOblique", "SlantedSans", "Minion sb", "Italic Medium", "Abd", "ABCDEF+Semibold")
FAMILY = ("Courier New, monospace", "Georgia, serif", "Inter, sans-serif", "Fantasy", "Times", "Menlo", "-apple-system", "Garamond")
COLORS = ("rgb(255, 0, 51)", "rgba(0,0,0,0.25)", "rgba(10 20 30 / 50%)", "red", "rgba(1,2,3,50%)", "x rgb(1.5,2,3) y", "rgba(0,0,0,3)", "")
MARKS = ("• item", "- x", "-a", "1. one", "(12) a", "iv. b", "plain", "a) c", "2020 x", "* yy")


def font_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    key = X.font_key(_one_of(FAMILY, n), _one_of(("bold", "600", "400", "normal", "0"), n), _one_of(("normal", "italic", "oblique"), n))
    return _documents(spark, sf_dir).select("doc_id", X.font_style(_one_of(FONTS, n)).alias("s"), key.alias("font")).select("doc_id", "s.bold", "s.italic", "font")


def inline_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    white = F.struct(F.lit(1.0).alias("r"), F.lit(0.5).alias("g"), F.lit(0.0).alias("b"))
    d = _documents(spark, sf_dir).select("doc_id", X.color(_one_of(COLORS, n)).alias("c"), X.hex_color(_one_of(("#f08", "00ff7f", "#12"), n)).alias("h"))
    mixed = X.blend(F.col("c"), F.col("c.a"), white)
    r = lambda c: F.round(c, 6)
    return d.select("doc_id", r(F.col("c.a")).alias("a"), r(mixed["r"]).alias("r"), r(mixed["g"]).alias("g"), r(mixed["b"]).alias("b"), r(F.col("h.b")).alias("hex_b"))


def list_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.when(F.col("line_no") % 3 == 0, _one_of(MARKS, F.col("doc_id") + F.col("line_no"))).otherwise(F.col("line"))
    return T.lines(spark, sf_dir).select("doc_id", "line_no", X.list_kind(line).alias("list_kind"))


def centred_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    x0, w = (F.col("line_no") % 7) * 40.0 + 40, (F.col("doc_id") % 11) * 45.0 + 20
    return T.lines(spark, sf_dir).select("doc_id", "line_no", G.centred(x0, x0 + w, F.lit(12.0), F.lit(36.0), F.lit(576.0)).alias("centred"))


def slide_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_no")
    fit = G.slide_fit(_one_of(("A4", "Letter", "Legal", "A3", "other"), n), _one_of(("portrait", "landscape"), F.col("doc_id")), _one_of(("none", "small", "medium", "large", "x"), F.col("doc_id") + n), n % 3 != 0, F.lit(960.0), n * 90.0)
    r = lambda c: F.round(c, 6)
    return T.pages(spark, sf_dir).select("doc_id", "page_no", fit.alias("f")).select("doc_id", "page_no", *[r(F.col(f"f.{k}")).alias(k) for k in ("page_w", "page_h", "x", "y", "w", "h")])


def chosen_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, total = F.col("doc_id"), F.col("page_count")
    picked = R.selected_pages(_one_of(("all", "custom", "custom"), n), _one_of((1, 2, 3, None, 5), n), _one_of((2, 9, 1, 4), n), total)
    ranges = F.array(F.struct(F.lit(2).alias("start"), F.lit(3).alias("end")), F.struct(F.lit(5).alias("start"), F.lit(5).alias("end")))
    show = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    toggled = R.toggle(F.array(*map(F.lit, (1, 3, 5))), (n % 6).cast("int"))
    return P.page_counts(T.pages(spark, sf_dir)).select("doc_id", show(picked).alias("pages"), show(toggled).alias("toggled"), R.contains(ranges, total).alias("last_in_ranges"))


def crop_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.pages(spark, sf_dir)
    for edge in ("top", "bottom", "left", "right"):
        value = F.when(F.col("page_no") % 4 == 3, None).otherwise((F.col("doc_id") % 13) * 10.0 - 10)
        out = out.withColumn(edge, F.to_json(G.crop_margin(edge, value, F.lit(10.0), F.lit(20.0), F.lit(60.0), F.lit(50.0))))
    got = lambda edge, k: F.get_json_object(edge, f"$.{k}").cast("double")
    return out.select("doc_id", "page_no", got("top", "top").alias("top_top"), got("top", "height").alias("top_height"), got("bottom", "height").alias("bottom_height"), got("left", "left").alias("left_left"), got("left", "width").alias("left_width"), got("right", "width").alias("right_width"))


def stage_and_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("doc_id"), F.col("page_no")
    box = G.contain(F.lit(400.0), F.lit(300.0), (n % 5) * 100.0, k * 70.0)
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    q = G.order_quad(F.array(point(100 + n % 7, 10 + k), point(n % 9, k % 5), point(n % 11 + 1, 200 + k), point(110 + k, 220 + n % 3)))
    r = lambda c: F.round(c, 6)
    d = T.pages(spark, sf_dir).select("doc_id", "page_no", box.alias("b"), q.alias("q"), G.overlap(F.lit(10.0), F.lit(20.0), k * 3.0, k * 3.0 + 8).alias("common"))
    return d.select("doc_id", "page_no", r(F.col("b.scale")).alias("scale"), r(F.col("b.dx")).alias("dx"), r(F.col("b.dy")).alias("dy"), "common", *[F.col(f"q.{c}.{a}").alias(f"{c}_{a}") for c in ("tl", "tr", "br", "bl") for a in "xy"])


def _planted(d: DataFrame) -> DataFrame:
    """Texts as files: a header, marks of objects, a trailer and an end, each left out of some."""
    n = F.col("doc_id")
    on = lambda k, s: F.when(n % k != 0, F.lit(s)).otherwise(F.lit(""))
    clean = F.regexp_replace("text", "[^ -~\\n]", "?")
    text = F.concat(on(3, "%PDF-1.4\n"), on(4, "1 0 obj\nstream\n"), clean, on(5, "\nendstream\nendobj\n2 0 obj\nendobj\n"), on(7, "xref\n0 1\n"), on(6, "trailer\n<< /Size 3 /Root 1 0 R /Prev 77 >>\nstartxref\n"), on(8, "/Encrypt 9 0 R\n"), on(9, "%%EOF\n"))
    return d.select("doc_id", F.encode(text, "ISO-8859-1").alias("content"))


def health_from_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = S.byte_checks(F.col("content"))
    return _planted(_documents(spark, sf_dir)).select("doc_id", *[v.cast("long").alias(k) if k.endswith(("errors", "size")) else v.alias(k) for k, v in c.items()])


def rebuilt_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _planted(_documents(spark, sf_dir)).select("doc_id", F.posexplode(S.tail_candidates(F.col("content"))).alias("seq", "c"))
    return d.select("doc_id", "seq", "c.kind", F.md5("c.content").alias("content_md5"))


def detached_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.pages(spark, sf_dir)
    refs = p.select("doc_id", "page_no", (F.char_length("text") % 9).alias("ref"))
    objects = p.select("doc_id", ((F.col("page_no") * 2) % 9).alias("ref"))
    return P.missing_contents(refs, objects)


def clean_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    raw = F.concat(F.lit("a\tb c\r\nd\re\u0001f￾"), F.col("text"), F.lit("\u007f\r"))
    cut = X.splice(F.col("source"), n % 3, n % 5, "**", "**", "text")
    name = X.pdf_name(F.when(n % 4 != 0, F.concat("source", _one_of((".md", ".TXT", ".markdown", ".doc"), n))), F.lit("My  First\tDoc"))
    case = X.transform_case(F.lit("hello wide World"), _one_of(("uppercase", "lowercase", "capitalize", "none"), n))
    return _documents(spark, sf_dir).select("doc_id", _md5(X.sanitize(raw)).alias("sanitized_md5"), _md5(X.xml_safe(raw)).alias("xml_md5"), cut.alias("spliced"), name.alias("pdf_name"), case.alias("cased"))


def shown_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("é‍ \tx\n中"), "text")
    return _documents(spark, sf_dir).select("doc_id", _md5(X.shown_text(raw, "\\x20-\\x7e\\u00e0-\\u00ff")).alias("shown_md5"))


def script_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("abc, العربية، نص 12 x שלום ! עולם. "), "text", F.lit(" नमस्ते दुनिया"))
    runs = X.script_runs(raw)
    shown = F.array_join(F.transform(runs, lambda r: F.concat(r["script"], F.lit("="), r["text"])), "¦")
    return _documents(spark, sf_dir).select("doc_id", F.size(runs).alias("n_runs"), _md5(shown).alias("runs_md5"))


def glyph_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.char_length("text") / 4).cast("int")
    g = T.pages(spark, sf_dir).filter("page_no = 1 and length(text) >= 4").select(F.col("doc_id").alias("run_id"), "text", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    g = g.select("run_id", "text", F.when(F.col("run_id") % 2 == 1, F.col("n") - 1 - F.col("i")).otherwise(F.col("i")).alias("glyph_no"), (F.floor(F.col("i") / 3) * 12).cast("int").alias("cluster"))
    return L.cluster_groups(g).select("run_id", "group_no", "cluster", "n_glyphs", _md5(F.col("text")).alias("text_md5"))


def word_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    w = T.pages(spark, sf_dir).select("doc_id", F.explode(F.array_distinct(words)).alias("word")).distinct()
    return L.in_blocks(w, "doc_id", "word")


def distinct_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    def twice(i: Column) -> Column:
        piece = lambda no, x: F.struct(no.alias("piece_no"), i["str"].alias("str"), x.alias("x"), i["y"].alias("y"))
        return F.array(piece(i["piece_no"], i["x"]), piece(i["piece_no"] + 1_000_000, i["x"] + F.when(i["line_no"] % 2 == 0, 0.0).otherwise(2.0)))

    second = lambda i: i["piece_no"] % (1 << 32) >= 1_000_000
    counts = lambda left: F.struct(F.size(left).cast("long").alias("n_pieces"), F.size(F.filter(left, second)).cast("long").alias("n_second"))
    page = bound(P.distinct_pieces(F.flatten(F.transform("pieces", twice))), counts)
    return T.mono_pages(T.line_pages(spark, sf_dir)).select("doc_id", "page_no", F.inline(F.filter(F.array(page), lambda c: c["n_pieces"] > 0)))  # a filter of rows would look at all pieces again


def cleaned_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("line_no")
    raw = F.concat(F.repeat(F.lit(" "), (k % 3).cast("int")), "line", F.repeat(F.lit(" "), (k % 2).cast("int")))
    p = T.lines(spark, sf_dir).select("doc_id", F.lit(1).alias("page_no"), k.alias("piece_no"), raw.alias("raw"), F.lit(10.0).alias("x"), k.cast("double").alias("y"), (F.char_length(raw) * 5.0).alias("w"), F.when(k % 10 == 9, 0.5).otherwise(12.0).alias("fs"))
    return P.clean_pieces(p).select("doc_id", "piece_no", _md5(F.col("str")).alias("str_md5"), F.round("x", 6).alias("x"), F.round("w", 6).alias("w"))


def image_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_no")
    each = F.explode(F.array(*map(F.lit, range(4)))).alias("i")
    i = F.col("i")
    p = T.pages(spark, sf_dir).select("doc_id", "page_no", each)
    m = [n * 40.0 * (i + 1), F.lit(0.0), F.lit(0.0), F.lit(-90.0), F.floor(i / 2) * 30.0 - 20, n * 50.0 + (i % 2) * 0.25]
    boxes = p.withColumn("box", G.image_box(m, F.lit(612.0), F.lit(792.0))).filter("box is not null").groupBy("doc_id", "page_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "box"))), lambda x: x["box"]).alias("boxes"))
    out = boxes.select("doc_id", "page_no", F.posexplode(G.distinct_boxes(F.col("boxes"))).alias("image_no", "b"))
    return out.select("doc_id", "page_no", "image_no", "b.x0", "b.y0", "b.x1", "b.y1")


def line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.mono_pieces(T.line_pages(spark, sf_dir))
    k = F.col("piece_no") % (1 << 32)
    p = p.withColumn("row_no", F.col("line_no").cast("long") % 60).withColumn("bold", k % 9 == 4)
    lines = p.select("doc_id", "page_no", "row_no", F.lit(12.0).alias("size"), F.col("y").alias("base")).distinct()
    p = p.withColumn("y", F.when(k % 5 == 3, F.col("y") - 4).otherwise(F.col("y"))).withColumn("fs", F.when(k % 5 == 3, 8.0).otherwise(12.0))
    out = L.runs(p, lines)
    return out.groupBy("doc_id", "page_no", "row_no").agg(F.count(F.lit(1)).alias("n_runs"), F.count_if(F.col("script") == "sup").alias("n_sup"), F.sum(F.char_length("text")).alias("n_chars"))


def fragment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = T.lines(spark, sf_dir).filter("line <> ''").withColumn("page_no", (F.floor(F.col("line_no") / 60) + 1).cast("int"))
    f = f.withColumn("half", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("base", (F.col("line_no") % 60) * 14.4 + F.col("half"))
    f = f.select("doc_id", "page_no", (F.col("line_no") * 2 + F.col("half")).alias("frag_no"), (300.0 - F.col("half") * 200).alias("x0"), "base", F.lit(12.0).alias("size"))
    return L.rows_of_fragments(f).select("doc_id", "page_no", "frag_no", "row_no", "place")


def document_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.pages(spark, sf_dir)
    blocks = p.select("doc_id", "page_no", _one_of(("paragraph", "table", "image", "paragraph"), F.col("page_no")).alias("kind"), (F.char_length("text") % 3).alias("level"), (F.col("page_no") % 4).alias("columns"))
    votes = p.select("doc_id", F.col("text").alias("str"), F.when(F.col("page_no") % 3 != 0, F.col("role") == "user").alias("serif"))
    edges = p.select("doc_id", "page_no", F.lit(612.0).alias("width"), (F.char_length("text") % 150).cast("double").alias("text_left"), (612.0 - F.col("page_no") * 20).alias("text_right"))
    return L.structure_counts(blocks).join(L.serif_votes(votes), "doc_id").join(L.margins(edges), "doc_id")


def heading_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.pages(spark, sf_dir)
    lines = p.select("doc_id", (F.char_length("text") % 6).alias("level"), (F.col("page_no") * 1.5 + 10).alias("size"))
    return L.heading_sizes(lines, p.select("doc_id", F.lit(11.0).alias("body")).distinct()).withColumn("size", F.round("size", 6))


def block_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("line_no")
    lead, tail = _one_of(("## ", "- ", "", "2. ", "> ", "### ", "| a ", "|"), n), F.when(n % 8 >= 6, "| b |").otherwise("")
    lines = T.lines(spark, sf_dir).select("doc_id", "line_no", F.when(n % 8 == 2, "").otherwise(F.concat(lead, F.translate("line", "*`[|", "____"), tail)).alias("line"))
    b = L.markdown_blocks(lines)
    return b.select("doc_id", "first_line", _md5(L.block_html(F.col("kind"), F.col("items"))).alias("html_md5"))


def nested_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of pages whose blocks nest paragraphs, lines and words; heights of their base lines."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    line = lambda ws: F.struct(F.lit(0.0).alias("bx0"), F.lit(30.0).alias("by0"), F.lit(600.0).alias("bx1"), F.lit(36.0).alias("by1"), ws.alias("words"))
    first, rest = F.slice(words, 1, 3), F.slice(words, F.lit(4), F.size(words))
    blocks = F.array(F.struct(F.array(F.struct(F.array(line(first), line(rest)).alias("lines"))).alias("paragraphs")))
    w = W.flatten(T.pages(spark, sf_dir).select("doc_id", "page_no", blocks.alias("blocks")))
    x, top = F.col("word_no") % 20 * 30.0, F.col("word_no") % 3 * 10.0
    at = W.baseline(F.col("line.bx0"), F.col("line.by0"), F.col("line.bx1"), F.col("line.by1"), x, top, x + 24, top + 20)
    return w.select("doc_id", "page_no", "word_no", "word", F.round(at, 6).alias("baseline"))


def lowest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.pages(spark, sf_dir).select("doc_id", "page_no", (F.char_length("text") % 17).alias("score"))
    return O.lowest(p, "page_no", "score")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.table(spark, sf_dir, "part")
    return p.select(F.concat(F.lit("item-"), F.col("p_partkey").cast("string")).alias("slug"), F.col("p_name").alias("title"), F.col("p_brand").alias("category"), (F.col("p_partkey") % 5 != 0).alias("listed"), (F.col("p_partkey") % 3 == 0).alias("needs_backend"))


def category_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _items(spark, sf_dir)
    best = i.agg(F.min("category").alias("category")).first()["category"] or ""
    return C.by_category(i, best).select("slug", "title", C.available(F.col("listed"), F.col("needs_backend"), False).alias("available"))


def menu_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _items(spark, sf_dir)
    nested = i.groupBy("category").agg(F.sort_array(F.collect_list(F.struct("slug", (F.col("listed") & F.col("category").rlike("[1-4]$")).alias("listed")))).alias("items"))
    filled = C.filled(i.select("category").distinct(), i.withColumn("listed", F.col("listed") & F.col("category").rlike("[135]$"))).withColumn("filled", F.lit(True))
    return C.menu(nested).join(filled, "category", "full").select("category", F.coalesce(F.size("items"), F.lit(0)).alias("n_items"), F.coalesce("filled", F.lit(False)).alias("filled"))


def post_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    slug = lambda k: F.concat(F.lit("item-"), (n % 50 * k + 1).cast("string"))
    posts = _documents(spark, sf_dir).select(n.alias("post"), F.array(slug(1), slug(3), F.lit("none"), slug(9)).alias("slugs"))
    return C.tools_of_posts(posts, _items(spark, sf_dir))


def curated_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items in a curated order, and titles, made up where there are none."""
    wanted = _documents(spark, sf_dir).select(F.col("doc_id").alias("seq"), F.concat(F.lit("item-"), (F.col("doc_id") * 3).cast("string")).alias("slug"))
    i = _items(spark, sf_dir)
    known = C.lookup_in_order(wanted, i.filter("listed").select("slug", "category"))
    return C.with_default_title(wanted, i.select("slug", "title")).join(known.select("seq", "category"), "seq", "left").select("seq", "slug", "title", "category")


def hit_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, at = F.col("doc_id") % 7, F.col("doc_id") % 5
    return _documents(spark, sf_dir).select("doc_id", C.next_hit(at, hits).cast("long").alias("following"), C.next_hit(at, hits, -1).cast("long").alias("previous"))


def other_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.all_but_first(_documents(spark, sf_dir).select("source", "doc_id"), "source", "doc_id")


def sitemap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _items(spark, sf_dir)
    pages = T.table(spark, sf_dir, "region").select(F.concat(F.lit("/"), F.lower("r_name")).alias("path"), F.lit(None).cast("string").alias("changed"), F.lit("daily").alias("frequency"), F.lit(1.0).alias("priority"))
    posts = _documents(spark, sf_dir).select(F.concat(F.lit("post-"), F.col("doc_id").cast("string")).alias("slug"), F.lit("2024-01-01").alias("changed"))
    tools = i.filter(C.available(F.col("listed"), F.col("needs_backend"), False)).select("slug", F.lit("2025-01-01").alias("changed"))
    return C.sitemap(pages, tools, posts, ("item-1", "item-2"), "https://example.org")


def best_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir).select("doc_id", F.col("n_chars").alias("original_size"))
    tries = F.explode(F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(n).alias("name"), F.lit(p).alias("p")) for i, (n, p) in enumerate((("light", 105), ("medium", 90), ("strong", 60), ("small", 64), ("least", 40)))])).alias("t")
    c = d.select("doc_id", "original_size", tries).select("doc_id", "original_size", "t.seq", "t.name", F.floor(F.col("original_size") * F.col("t.p") / 100 + F.col("doc_id") % 50).alias("size"))
    return C.best_candidate(c, F.when(F.col("doc_id") % 3 == 0, F.col("original_size") * 0.62).when(F.col("doc_id") % 3 == 1, F.lit(900.0)), try_all=True)


def kept_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.pages(spark, sf_dir)
    sheets = p.select(F.col("doc_id").cast("string").alias("path"), F.concat(F.lit("s"), F.col("page_no").cast("string")).alias("sheet"))
    chosen = p.filter("doc_id % 3 <> 0 and page_no in (1, 4)").select(F.col("doc_id").cast("string").alias("path"), F.concat(F.lit("s"), F.col("page_no").cast("string")).alias("sheet"))
    return S3.keep_sheets(sheets, chosen)


QUERIES = {f.__name__: f for f in (
    font_styles, inline_colors, list_markers, centred_lines, slide_places, chosen_pages, crop_edges, stage_and_quads, health_from_bytes, rebuilt_tails, detached_pages, clean_strings, shown_texts, script_segments, glyph_clusters, word_blocks, distinct_pieces, cleaned_pieces,
    image_rects, line_runs, fragment_rows, document_shape, heading_sizes, block_html, nested_words, lowest_pages, category_items, menu_items, post_tools, curated_items, hit_cursor, other_documents, sitemap_rows, best_strategy, kept_sheets,
)}

_PAGES = "p AS (SELECT conv_id AS doc_id, (turn + 1)::INT AS page_no, role, text FROM conversations)"
_LINES = "ln AS (SELECT doc_id, (unnest(range(1, len(ls) + 1)) - 1)::INT AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"
_ITEMS = "i AS (SELECT 'item-' || p_partkey AS slug, p_name AS title, p_brand AS category, p_partkey % 5 <> 0 AS listed, p_partkey % 3 = 0 AS needs FROM part)"
_STYLE = r"bold|black|heavy|semibold|demi|[-,_ ]?medi(um)?\b|[-,]bd\b|cmbx|cmb10|cmssbx|\bsb\b"
_SLANT = r"italic|oblique|ital\b|[-,]it\b|cmti|cmmi|cmsl|cmitt|slanted"
_PARTS = r"rgba?\(\s*([\d.]+)[,\s]+([\d.]+)[,\s]+([\d.]+)(?:\s*[,/]\s*([\d.]+%?))?\s*\)"
_PLANTED = r"""f AS (SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN '%PDF-1.4' || chr(10) ELSE '' END || CASE WHEN doc_id % 4 <> 0 THEN '1 0 obj' || chr(10) || 'stream' || chr(10) ELSE '' END || regexp_replace(text, '[^ -~\n]', '?', 'g')
  || CASE WHEN doc_id % 5 <> 0 THEN chr(10) || 'endstream' || chr(10) || 'endobj' || chr(10) || '2 0 obj' || chr(10) || 'endobj' || chr(10) ELSE '' END || CASE WHEN doc_id % 7 <> 0 THEN 'xref' || chr(10) || '0 1' || chr(10) ELSE '' END
  || CASE WHEN doc_id % 6 <> 0 THEN 'trailer' || chr(10) || '<< /Size 3 /Root 1 0 R /Prev 77 >>' || chr(10) || 'startxref' || chr(10) ELSE '' END || CASE WHEN doc_id % 8 <> 0 THEN '/Encrypt 9 0 R' || chr(10) ELSE '' END
  || CASE WHEN doc_id % 9 <> 0 THEN '%%EOF' || chr(10) ELSE '' END AS t FROM documents)"""


_SCRIPTS = re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", X.script_pattern())

ORACLE_SQL = {
    "font_styles": f"""WITH d AS (SELECT doc_id, regexp_replace({_sql_one_of(FONTS, "doc_id")}, '^[A-Z]{{6}}\\+', '') AS n, lower({_sql_one_of(FAMILY, "doc_id")}) AS f, {_sql_one_of(("bold", "600", "400", "normal", "0"), "doc_id")} AS w, doc_id % 3 <> 0 AS slant FROM documents),
k AS (SELECT *, w IN ('bold', '600') AS heavy, CASE WHEN regexp_matches(f, 'mono|courier|consolas|menlo|monaco') THEN 'mono' WHEN regexp_matches(f, 'sans-serif|system-ui|-apple-system|blinkmacsystemfont|segoe|helvetica|arial|inter\\b') THEN 'sans'
  WHEN regexp_matches(f, 'serif|georgia|times|merriweather|baskerville|garamond') THEN 'serif' ELSE 'sans' END AS kind FROM d)
SELECT doc_id, regexp_matches(n, '{_STYLE}', 'i') AS bold, regexp_matches(n, '{_SLANT}', 'i') AS italic, kind || CASE WHEN heavy OR slant THEN '-' ELSE '' END || CASE WHEN heavy THEN 'b' ELSE '' END || CASE WHEN slant THEN 'i' ELSE '' END AS font FROM k""",
    "inline_colors": f"""WITH d AS (SELECT doc_id, regexp_extract({_sql_one_of(COLORS, "doc_id")}, '{_PARTS}', ['r', 'g', 'b', 'a']) AS c, regexp_matches({_sql_one_of(COLORS, "doc_id")}, '{_PARTS}') AS ok, doc_id % 3 AS k FROM documents),
v AS (SELECT doc_id, k, CASE WHEN ok THEN CASE WHEN c.a = '' THEN 1.0 WHEN c.a LIKE '%\\%' ESCAPE '\\' THEN try_cast(replace(c.a, '%', '') AS DOUBLE) / 100 ELSE try_cast(c.a AS DOUBLE) END END AS a, try_cast(c.r AS DOUBLE) / 255 AS r, try_cast(c.g AS DOUBLE) / 255 AS g, try_cast(c.b AS DOUBLE) / 255 AS b FROM d),
t AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, a)) AS s FROM v)
SELECT doc_id, round(a, 6)::DOUBLE AS a, CASE WHEN a IS NOT NULL THEN round(r * s + (1 - s), 6) END AS r, CASE WHEN a IS NOT NULL THEN round(g * s + 0.5::DOUBLE * (1 - s), 6) END AS g, CASE WHEN a IS NOT NULL THEN round(b * s, 6) END AS b,
  CASE k WHEN 0 THEN round(136 / 255.0::DOUBLE, 6) WHEN 1 THEN round(127 / 255.0::DOUBLE, 6) END AS hex_b FROM t""",
    "list_markers": f"""WITH {_LINES}, m AS (SELECT doc_id, line_no, CASE WHEN line_no % 3 = 0 THEN {_sql_one_of(MARKS, "(doc_id + line_no)")} ELSE line END AS s FROM ln)
SELECT doc_id, line_no, CASE WHEN regexp_matches(s, '^[•●◦▪■□–—‣⁃∙·*\\-]') AND length(s) > 2 THEN 'bullet' WHEN regexp_matches(s, '^(\\(?[0-9]{{1,2}}[.)]|\\(?[a-zA-Z][.)]|\\(?[ivxIVX]{{1,4}}[.)])\\s+') THEN 'number' END AS list_kind FROM m""",
    "centred_lines": f"""WITH {_LINES}, b AS (SELECT doc_id, line_no, line_no % 7 * 40 + 40 AS x, doc_id % 11 * 45 + 20 AS w FROM ln)
SELECT doc_id, line_no, w < 459 AND abs(x + w / 2.0 - 306) < 18 AND x > 60 AS centred FROM b""",
    "slide_places": f"""WITH {_PAGES}, s AS (SELECT doc_id, page_no, {_sql_one_of((595.28, 612.0, 612.0, 841.89, 595.28), "page_no")}::DOUBLE AS a, {_sql_one_of((841.89, 792.0, 1008.0, 1190.55, 841.89), "page_no")}::DOUBLE AS b, {_sql_one_of((0, 36, 72, 108, 0), "(doc_id + page_no)")} AS m, doc_id % 2 = 1 AS wide FROM p),
z AS (SELECT *, CASE WHEN wide THEN b ELSE a END AS pw, CASE WHEN wide THEN a ELSE b END AS ph, page_no * 90.0::DOUBLE AS h FROM s), k AS (SELECT *, CASE WHEN page_no % 3 <> 0 THEN least((pw - 2 * m) / 960, (ph - 2 * m) / h) ELSE 1 END AS q FROM z)
SELECT doc_id, page_no, pw AS page_w, ph AS page_h, round(m + (pw - 2 * m - 960 * q) / 2, 6) AS x, round(m + (ph - 2 * m - h * q) / 2, 6) AS y, round(960 * q, 6) AS w, round(h * q, 6) AS h FROM k""",
    "chosen_pages": f"""WITH {_PAGES}, c AS (SELECT doc_id, max(page_no) AS n, {_sql_one_of((1, 2, 3, None, 5), "doc_id")} AS a, {_sql_one_of((2, 9, 1, 4), "doc_id")} AS b FROM p GROUP BY doc_id)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN array_to_string(range(1, n + 1), ',') WHEN a IS NULL OR a > b THEN '' ELSE array_to_string(range(a, least(b, n) + 1), ',') END AS pages,
  CASE WHEN doc_id % 6 IN (1, 3, 5) THEN array_to_string(list_filter([1, 3, 5], lambda x: x <> doc_id % 6), ',') ELSE array_to_string(list_sort([1, 3, 5, (doc_id % 6)::INT]), ',') END AS toggled, n IN (2, 3, 5) AS last_in_ranges FROM c""",
    "crop_edges": f"""WITH {_PAGES}, v AS (SELECT doc_id, page_no, CASE WHEN page_no % 4 = 3 THEN 0 ELSE doc_id % 13 * 10 - 10 END AS v FROM p)
SELECT doc_id, page_no, greatest(0, least(58, v))::DOUBLE AS top_top, (60 - greatest(0, least(58, v)))::DOUBLE AS top_height, (90 - greatest(0, least(88, v)))::DOUBLE AS bottom_height, greatest(0, least(78, v))::DOUBLE AS left_left,
  (80 - greatest(0, least(78, v)))::DOUBLE AS left_width, (80 - greatest(0, least(78, v)))::DOUBLE AS right_width FROM v""",
    "stage_and_quads": f"""WITH {_PAGES}, a AS (SELECT doc_id, page_no, doc_id % 5 * 100.0::DOUBLE AS w, page_no * 70.0::DOUBLE AS h FROM p), b AS (SELECT *, CASE WHEN w > 0 THEN least(400 / w, 300 / h) END AS s FROM a)
SELECT doc_id, page_no, round(s, 6) AS scale, round((400 - w * s) / 2, 6) AS dx, round((300 - h * s) / 2, 6) AS dy, greatest(0, least(20, page_no * 3 + 8) - greatest(10, page_no * 3))::DOUBLE AS common, (doc_id % 9)::DOUBLE AS tl_x, (page_no % 5)::DOUBLE AS tl_y,
  (100 + doc_id % 7)::DOUBLE AS tr_x, (10 + page_no)::DOUBLE AS tr_y, (110 + page_no)::DOUBLE AS br_x, (220 + doc_id % 3)::DOUBLE AS br_y, (doc_id % 11 + 1)::DOUBLE AS bl_x, (200 + page_no)::DOUBLE AS bl_y FROM b""",
    "health_from_bytes": rf"""WITH {_PLANTED} SELECT doc_id, t LIKE '\%PDF-%' ESCAPE '\' AS header, contains(t, '%%EOF') AS eof, contains(t, 'xref') OR contains(t, '/XRef') AS xref, contains(t, 'trailer') OR contains(t, '/Root') AS trailer, contains(t, '/Encrypt') AS encrypted,
  abs(len(regexp_extract_all(t, '\bstream\b')) - len(regexp_extract_all(t, '\bendstream\b')))::BIGINT AS stream_errors, abs(len(regexp_extract_all(t, '\d+\s+\d+\s+obj\b')) - len(regexp_extract_all(t, '\bendobj\b')))::BIGINT AS object_errors, length(t)::BIGINT AS size FROM f""",
    "rebuilt_tails": rf"""WITH {_PLANTED}, b AS (SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN t ELSE '%PDF-1.7' || chr(10) || t END AS t FROM f), o AS (SELECT doc_id, regexp_extract(t, '(?s)^.*endobj') AS o FROM b WHERE contains(t, 'endobj')),
e AS (SELECT doc_id, o, chr(10) || 'startxref' || chr(10) || '0' || chr(10) || '%%EOF' || chr(10) AS tail, doc_id % 6 <> 0 AS old FROM o)
SELECT doc_id, 0 AS seq, 'rebuilt-tail' AS kind, md5(o || chr(10) || 'trailer' || chr(10) || '<< /Size 3 /Root 1 0 R  >>' || tail) AS content_md5 FROM e WHERE old UNION ALL SELECT doc_id, old::INT, 'rebuilt-tail-no-trailer', md5(o || tail) FROM e""",
    "detached_pages": f"WITH {_PAGES}, r AS (SELECT doc_id, page_no, length(text) % 9 AS ref FROM p), o AS (SELECT DISTINCT doc_id, page_no * 2 % 9 AS ref FROM p) SELECT DISTINCT r.doc_id, r.page_no FROM r LEFT JOIN o ON o.doc_id = r.doc_id AND o.ref = r.ref WHERE o.ref IS NULL",
    "clean_strings": r"""WITH s AS (SELECT doc_id, source, 'a' || chr(9) || 'b' || chr(160) || 'c' || chr(13) || chr(10) || 'd' || chr(13) || 'e' || chr(1) || 'f' || chr(65534) || text || chr(127) || chr(13) AS t, doc_id % 3 AS a, doc_id % 5 AS b FROM documents),
k AS (SELECT *, regexp_replace(regexp_replace(replace(replace(regexp_replace(nfc_normalize(t), '\r\n?', chr(10), 'g'), chr(9), '    '), chr(160), ' '), '[\x00-\x09\x0B-\x1F\x7F]', '', 'g'), '', '', 'g') AS c, [source || '.md', source || '.TXT', source || '.markdown', source || '.doc'][doc_id % 4 + 1] AS name FROM s)
SELECT doc_id, md5(c) AS sanitized_md5, md5(regexp_replace(t, '[^\x09\x0A\x0D\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]', '', 'g')) AS xml_md5,
  left(source, a) || '**' || CASE WHEN b > a THEN substr(source, a + 1, b - a) ELSE 'text' END || '**' || substr(source, b + 1) AS spliced,
  CASE WHEN doc_id % 4 = 0 THEN 'my_first_doc.pdf' ELSE regexp_replace(name, '(?i)\.(md|markdown|txt)$', '.pdf') END AS pdf_name, ['HELLO WIDE WORLD', 'hello wide world', 'Hello Wide World', 'hello wide World'][doc_id % 4 + 1] AS cased FROM k""",
    "shown_texts": r"""WITH s AS (SELECT doc_id, 'e' || chr(769) || chr(8205) || chr(160) || chr(9) || 'x' || chr(10) || chr(20013) || text AS t FROM documents)
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(t, '[\t\r\f\x0b\x{a0}\x{feff}\x{85}]', ' ', 'g'), '[\p{M}\x{200c}\x{200d}]', '', 'g'), '[^\n\x20-\x7e\x{e0}-\x{ff}]', '?', 'g')) AS shown_md5 FROM s""",
    "script_segments": f"""WITH s AS (SELECT doc_id, regexp_extract_all('abc, العربية، نص 12 x שלום ! עולם. ' || text || ' नमस्ते दुनिया', '{_SCRIPTS}') AS r FROM documents)
SELECT doc_id, len(r)::INT AS n_runs, md5(array_to_string(list_transform(r, lambda x: CASE WHEN regexp_matches(x, '^[\\x{{600}}-\\x{{6ff}}]') THEN 'arabic' WHEN regexp_matches(x, '^[\\x{{590}}-\\x{{5ff}}]') THEN 'hebrew' WHEN regexp_matches(x, '^[\\x{{900}}-\\x{{97f}}]') THEN 'devanagari' ELSE 'base' END || '=' || x), '¦')) AS runs_md5 FROM s""",
    "glyph_clusters": f"""WITH {_PAGES}, t AS (SELECT doc_id AS run_id, text, length(text) // 4 AS n FROM p WHERE page_no = 1 AND length(text) >= 4), c AS (SELECT run_id, text, n, unnest(range((n + 2) // 3)) AS k FROM t)
SELECT run_id, CASE WHEN run_id % 2 = 1 THEN (n + 2) // 3 - 1 - k ELSE k END::BIGINT AS group_no, (k * 12)::INT AS cluster, least(3, n - 3 * k)::BIGINT AS n_glyphs, md5(CASE WHEN 3 * (k + 1) < n THEN substr(text, k * 12 + 1, 12) ELSE substr(text, k * 12 + 1) END) AS text_md5 FROM c""",
    "word_blocks": rf"""WITH {_PAGES}, w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word FROM p) SELECT doc_id, word, (row_number() OVER (PARTITION BY doc_id ORDER BY word) - 1) // 100 AS block_no FROM w""",
    "distinct_pieces": r"""WITH ln AS (SELECT doc_id, (unnest(range(1, len(ls) + 1)) - 1)::INT AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)), w AS (SELECT doc_id, line_no, len(list_filter(string_split(line, ' '), lambda x: x <> '')) AS n FROM ln)
SELECT doc_id, (line_no // 60 + 1)::INT AS page_no, sum(CASE WHEN line_no % 2 = 0 THEN n ELSE 2 * n END)::BIGINT AS n_pieces, sum(CASE WHEN line_no % 2 = 0 THEN 0 ELSE n END)::BIGINT AS n_second FROM w WHERE n > 0 GROUP BY ALL""",
    "cleaned_pieces": rf"""WITH {_LINES}, r AS (SELECT doc_id, line_no AS piece_no, repeat(' ', line_no % 3) || line || repeat(' ', line_no % 2) AS raw FROM ln WHERE line_no % 10 <> 9), t AS (SELECT *, regexp_replace(raw, '^[\s\x0b\x{{a0}}\x{{feff}}]+', '') AS r1 FROM r), u AS (SELECT *, regexp_replace(r1, '[\s\x0b\x{{a0}}\x{{feff}}]+$', '') AS s FROM t)
SELECT doc_id, piece_no, md5(s) AS str_md5, round(10 + (length(raw) - length(r1)) * 5.0::DOUBLE, 6) AS x, greatest(0.1, length(s) * 5.0)::DOUBLE AS w FROM u WHERE s <> ''""",
    "image_rects": f"""WITH {_PAGES}, m AS (SELECT doc_id, page_no, i, greatest(0, i // 2 * 30 - 20)::DOUBLE AS x0, least(612, i // 2 * 30 - 20 + page_no * 40 * (i + 1))::DOUBLE AS x1, greatest(0, page_no * 50 + i % 2 * 0.25 - 90)::DOUBLE AS y0, least(792, page_no * 50 + i % 2 * 0.25)::DOUBLE AS y1 FROM p, range(4) r(i)),
b AS (SELECT * FROM m WHERE x1 - x0 >= 24 AND y1 - y0 >= 24), k AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM b c WHERE c.doc_id = b.doc_id AND c.page_no = b.page_no AND c.i < b.i AND abs(c.x0 - b.x0) < 1 AND abs(c.x1 - b.x1) < 1 AND abs(c.y0 - b.y0) < 1 AND abs(c.y1 - b.y1) < 1))
SELECT doc_id, page_no, (row_number() OVER (PARTITION BY doc_id, page_no ORDER BY i) - 1)::INT AS image_no, x0, y0, x1, y1 FROM k""",
    "line_runs": f"""WITH {_LINES}, s AS (SELECT doc_id, line_no, unnest(string_split(line, ' ')) AS s, unnest(range(len(string_split(line, ' ')))) AS k, len(string_split(line, ' ')) < 6 AS large FROM ln), w AS (SELECT *, k % 5 = 3 AS sup, k % 9 = 4 AS bold FROM s WHERE s <> ''),
f AS (SELECT *, CASE WHEN lag(sup) OVER o IS DISTINCT FROM sup OR lag(bold) OVER o IS DISTINCT FROM bold THEN 1 ELSE 0 END AS fresh, CASE WHEN lag(k) OVER o IS NULL THEN 0 ELSE 1 END AS gap FROM w WINDOW o AS (PARTITION BY doc_id, line_no ORDER BY k))
SELECT doc_id, (line_no // 60 + 1)::INT AS page_no, (line_no % 60)::BIGINT AS row_no, sum(fresh)::BIGINT AS n_runs, sum(CASE WHEN sup THEN fresh ELSE 0 END)::BIGINT AS n_sup, sum(length(s) + gap)::BIGINT AS n_chars FROM f GROUP BY doc_id, line_no""",
    "fragment_rows": f"""WITH {_LINES}, n AS (SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id, line_no // 60 ORDER BY line_no) - 1 AS r FROM ln WHERE line <> '')
SELECT doc_id, (line_no // 60 + 1)::INT AS page_no, (line_no * 2 + h)::BIGINT AS frag_no, r AS row_no, (1 - h)::INT AS place FROM n, range(2) x(h)""",
    "document_shape": f"""WITH {_PAGES}, c AS (SELECT doc_id, page_no, {_sql_one_of(("paragraph", "table", "image", "paragraph"), "page_no")} AS kind, length(text) % 3 AS level, CASE WHEN page_no % 3 <> 0 THEN CASE WHEN role = 'user' THEN length(text) ELSE -length(text) END ELSE 0 END AS v,
  (length(text) % 150)::DOUBLE AS l, page_no * 20.0::DOUBLE AS r FROM p),
g AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'table') AS tables, count(*) FILTER (WHERE kind = 'image') AS images, count(*) FILTER (WHERE kind = 'paragraph' AND level > 0) AS headings, count(*) FILTER (WHERE kind = 'paragraph' AND level = 0) AS paragraphs,
  count(*) FILTER (WHERE page_no % 4 > 1) AS columns_pages, sum(v) > 0 AS serif, list(l ORDER BY l) AS ls, list(r ORDER BY r) AS rs FROM c GROUP BY 1)
SELECT doc_id, tables, images, headings, paragraphs, columns_pages, serif, least(108, greatest(36, ls[len(ls) // 2 + 1]))::DOUBLE AS "left", least(108, greatest(36, rs[len(rs) // 2 + 1]))::DOUBLE AS "right" FROM g""",
    "heading_sizes": f"""WITH {_PAGES}, h AS (SELECT doc_id, least(4, length(text) % 6) AS level, list(page_no * 1.5::DOUBLE + 10 ORDER BY page_no) AS s FROM p WHERE length(text) % 6 > 0 GROUP BY ALL), d AS (SELECT DISTINCT doc_id FROM p)
SELECT d.doc_id, l.level::INT AS level, round(coalesce(h.s[len(h.s) // 2 + 1], l.usual), 6) AS size FROM d CROSS JOIN (VALUES (1, 17.6::DOUBLE), (2, 14.85::DOUBLE), (3, 12.65::DOUBLE), (4, 11.55::DOUBLE)) l(level, usual) LEFT JOIN h ON h.doc_id = d.doc_id AND h.level = l.level""",
    "block_html": rf"""WITH {_LINES}, t AS (SELECT doc_id, line_no AS n, translate(line, '*`[|', '____') AS s, line_no % 8 AS k FROM ln),
u AS (SELECT *, CASE k WHEN 0 THEN '## ' WHEN 1 THEN '- ' WHEN 3 THEN '2. ' WHEN 4 THEN '> ' WHEN 5 THEN '### ' WHEN 6 THEN '| a ' WHEN 7 THEN '|' END || s || CASE WHEN k >= 6 THEN '| b |' ELSE '' END AS line FROM t WHERE k <> 2),
b AS (SELECT doc_id, n, line, trim(regexp_replace(line, '\s+$', '')) AS x, k FROM u)
SELECT doc_id, min(n) AS first_line, md5(CASE WHEN any_value(k) = 0 THEN '<h2>' || any_value(substr(line, 4)) || '</h2>' WHEN any_value(k) = 5 THEN '<h3>' || any_value(substr(line, 5)) || '</h3>' WHEN any_value(k) = 1 THEN '<ul><li>' || any_value(substr(x, 3)) || '</li></ul>'
  WHEN any_value(k) = 3 THEN '<ol><li>' || any_value(substr(x, 4)) || '</li></ol>' WHEN any_value(k) = 4 THEN '<blockquote>' || any_value(trim(substr(x, 2))) || '</blockquote>'
  ELSE '<table><thead><tr>' || max(CASE WHEN k = 6 THEN '<th>' || trim('a ' || s) || '</th><th>b</th>' END) || '</tr></thead><tbody>' || coalesce(max(CASE WHEN k = 7 THEN '<tr><td>' || trim(s) || '</td><td>b</td></tr>' END), '') || '</tbody></table>' END) AS html_md5
FROM b JOIN u USING (doc_id, n, line, k) GROUP BY doc_id, n // 8, CASE WHEN k >= 6 THEN 6 ELSE k END""",
    "nested_words": rf"""WITH {_PAGES}, s AS (SELECT doc_id, page_no, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM p), w AS (SELECT doc_id, page_no, (unnest(range(1, len(ws) + 1)) - 1)::INT AS word_no, unnest(ws) AS word FROM s),
y AS (SELECT *, word_no % 3 * 10 AS y0, 30 + 6 * (word_no % 20 * 30 + 12) / 600.0::DOUBLE AS y FROM w)
SELECT doc_id, page_no, word_no, word, CASE WHEN y >= y0 AND y <= y0 + 40 THEN round(y, 6) END AS baseline FROM y""",
    "lowest_pages": f"WITH {_PAGES}, k AS (SELECT doc_id, page_no, length(text) % 17 AS score, row_number() OVER (PARTITION BY doc_id ORDER BY length(text) % 17, page_no)::INT AS nth FROM p) SELECT * FROM k WHERE nth <= 4",
    "category_items": f"WITH {_ITEMS} SELECT slug, title, listed AND NOT needs AS available FROM i WHERE category = (SELECT min(category) FROM i)",
    "menu_items": f"""WITH {_ITEMS}, g AS (SELECT category, count(*) FILTER (WHERE listed) AS n FROM i GROUP BY 1), h AS (SELECT category, CASE WHEN regexp_matches(category, '[1-4]$') THEN n ELSE 0 END AS n_items, n > 0 AND regexp_matches(category, '[135]$') AS filled FROM g)
SELECT category, n_items::INT AS n_items, filled FROM h WHERE n_items > 0 OR filled""",
    "post_tools": f"""WITH {_ITEMS}, s AS (SELECT doc_id AS post, [(0, 'item-' || doc_id % 50 + 1), (1, 'item-' || doc_id % 50 * 3 + 1), (3, 'item-' || doc_id % 50 * 9 + 1)] AS l FROM documents), e AS (SELECT post, unnest(l) AS x FROM s)
SELECT post, x[1]::INT AS place, slug, title FROM e JOIN i ON i.slug = x[2] AND listed""",
    "curated_items": f"""WITH {_ITEMS}, w AS (SELECT doc_id AS seq, 'item-' || doc_id * 3 AS slug FROM documents) SELECT w.seq, w.slug, coalesce(i.title, 'Item ' || w.seq * 3) AS title, CASE WHEN i.listed THEN i.category END AS category FROM w LEFT JOIN i ON i.slug = w.slug""",
    "hit_cursor": "SELECT doc_id, CASE WHEN doc_id % 7 > 0 THEN (doc_id % 5 + 1) % (doc_id % 7) ELSE doc_id % 5 END AS following, CASE WHEN doc_id % 7 > 0 THEN (doc_id % 5 - 1 + doc_id % 7) % (doc_id % 7) ELSE doc_id % 5 END AS previous FROM documents",
    "other_documents": "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (ORDER BY source NULLS FIRST, doc_id) > 1",
    "sitemap_rows": f"""WITH {_ITEMS} SELECT 'https://example.org/' || lower(r_name) AS url, NULL AS changed, 'daily' AS frequency, 1.0::DOUBLE AS priority FROM region
UNION ALL SELECT 'https://example.org/tools/' || slug, '2025-01-01', 'weekly', CASE WHEN slug IN ('item-1', 'item-2') THEN 0.9::DOUBLE ELSE 0.8::DOUBLE END FROM i WHERE listed AND NOT needs UNION ALL SELECT 'https://example.org/blog/post-' || doc_id, '2024-01-01', 'monthly', 0.7::DOUBLE FROM documents""",
    "best_strategy": """WITH c AS (SELECT doc_id, n_chars AS o, CASE doc_id % 3 WHEN 0 THEN n_chars * 0.62::DOUBLE WHEN 1 THEN 900.0::DOUBLE END AS t, s, name, floor(n_chars * p / 100.0::DOUBLE + doc_id % 50)::BIGINT AS size
  FROM documents, (VALUES (0,'light',105),(1,'medium',90),(2,'strong',60),(3,'small',64),(4,'least',40)) v(s, name, p)),
b AS (SELECT *, min(CASE WHEN size < o THEN size END) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY size, s) AS nth FROM b WHERE before IS NULL OR t IS NULL OR before > t), f AS (SELECT *, least(size, o) AS best FROM k WHERE nth = 1)
SELECT doc_id, o AS original_size, best AS size, CASE WHEN size < o THEN name ELSE 'original' END AS mode, greatest(0, floor((1 - best::DOUBLE / o) * 100 + 0.5))::INT AS reduction, coalesce(best > t, false) AS missed FROM f""",
    "kept_sheets": f"WITH {_PAGES} SELECT doc_id::VARCHAR AS path, 's' || page_no AS sheet FROM p WHERE doc_id % 3 = 0 OR page_no IN (1, 4)",
}
