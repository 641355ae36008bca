"""Logical tables over the stored ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelab.functions.text import bound

PAGE_LINES = 60
PAGE_WORDS = 480


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents of pages: (doc_id, page_no from 1, role, text)."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page_no"), "role", "text")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as lines: (doc_id, line_no from 0, line)."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as uses of items: (event_id, ts, user_id, item)."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", "user_id", F.get_json_object("props", "$.k").cast("int").alias("item"))


def line_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of PAGE_LINES lines: (doc_id, page_no from 1, lines), each line with its line_no in the document, from 0."""
    page = lambda lines, p: F.transform(F.slice(lines, p * PAGE_LINES + 1, F.lit(PAGE_LINES)), lambda line, i: F.struct((p * PAGE_LINES + i).alias("line_no"), line.alias("line")))
    numbers = lambda lines: F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / PAGE_LINES).cast("int"))
    pages = bound(F.split("text", "\n", -1), lambda lines: F.transform(numbers(lines), lambda p: F.struct((p + 1).alias("page_no"), page(lines, p).alias("lines"))))
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.inline(pages))


def mono_pages(pages: DataFrame, size: float = 12.0, margin: float = 72.0) -> DataFrame:
    """Words of pages of lines (doc_id, page_no, lines), placed in a font of equal widths: (doc_id, page_no, pieces), with the pieces (piece_no, line_no, str, x, y, w, fs, bold) of a page in one row.

    A line of fewer than six words is set in 18 points, one that starts with a digit is bold. Pages are dealt before their lines are cut into words, so what comes together by page after
    that is shuffled no more. A word's place in its line is told from the spaces of the line.
    """
    n_parts = 2 * int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # many small parts: words take far more room than their line
    whole = pages.repartition(n_parts, "doc_id", "page_no").groupBy("doc_id", "page_no").agg(F.flatten(F.collect_list("lines")).alias("lines"))

    def piece(line: Column, word: Column, k: Column) -> Column:
        col = F.coalesce(F.get(line["spaces"], k - 1) + 1, F.lit(0))
        return F.struct(
            (line["line_no"].cast("long") * (1 << 32) + k).alias("piece_no"), line["line_no"].alias("line_no"), word.alias("str"), (F.lit(margin) + col * line["fs"] * 0.6).alias("x"),
            line["y"].alias("y"), (F.char_length(word) * line["fs"] * 0.6).alias("w"), line["fs"].alias("fs"), line["bold"].alias("bold"),
        )

    def placed(line: Column, words: Column) -> Column:
        spaces = F.filter(F.transform(F.split(line["line"], ""), lambda c, i: F.when(c == " ", i)), lambda i: i.isNotNull())
        fs, bold = F.when(F.size(words) < 6, F.lit(18.0)).otherwise(F.lit(size)), line["line"].rlike("^[0-9]")
        head = F.struct(line["line_no"].alias("line_no"), spaces.alias("spaces"), fs.alias("fs"), bold.alias("bold"), (F.lit(margin) + (line["line_no"] % PAGE_LINES) * size * 1.2).alias("y"))
        pieces = bound(head, lambda h: F.transform(words, lambda w, k: F.when(F.char_length(w) > 0, piece(h, w, k))))
        return F.filter(pieces, lambda i: i.isNotNull())

    pieces = F.flatten(F.transform("lines", lambda line: bound(F.split(line["line"], " "), lambda words: placed(line, words))))
    return whole.select("doc_id", "page_no", pieces.alias("pieces"))


def mono_pieces(pages: DataFrame, size: float = 12.0, margin: float = 72.0) -> DataFrame:
    """mono_pages() with a row for each piece: (doc_id, page_no, piece_no, line_no, str, x, y, w, fs, bold)."""
    return mono_pages(pages, size, margin).select("doc_id", "page_no", F.inline("pieces"))


def _page_texts(docs: DataFrame) -> DataFrame:
    """Texts as pages of PAGE_WORDS words, joined by one space: (doc_id, page_no from 1, text); texts without words have none."""
    page = lambda words, p: F.array_join(F.slice(words, p * PAGE_WORDS + 1, F.lit(PAGE_WORDS)), " ")
    numbers = lambda words: F.sequence(F.lit(0), F.floor((F.size(words) - 1) / PAGE_WORDS).cast("int"))
    pages = bound(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), lambda words: F.transform(numbers(words), lambda p: F.struct((p + 1).alias("page_no"), page(words, p).alias("text"))))
    return docs.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select("doc_id", F.inline(pages))


def _lines_of(text: Column) -> Column:
    """A page's text as an array of lines of six words. Lines, and cells below, are found as stretches of text; words are not listed."""
    return F.regexp_extract_all(text, F.lit("[^ ]++(?: [^ ]++){0,5}+"), F.lit(0))


def _set_line(style: Column, six: Column, k: Column) -> Column:
    """The k-th line of a page: the texts of its cells, and how they are placed."""
    by = lambda *v: F.when(style == 0, v[0]).when(style == 1, v[1]).when(style == 2, v[2]).otherwise(v[3])
    table = (style == 0) & (F.floor(k / 8) % 2 == 1)
    twos = F.regexp_extract_all(six, F.lit("[^ ]++(?: [^ ]++)?+"), F.lit(0))
    cells = F.when(style != 0, F.array(six)).when(~table, F.array(six)).when(k % 8 == 3, F.slice(twos, 2, 1)).otherwise(twos)
    base = by(60 + 18 * k - F.when(table & (k % 8 == 3), 5).otherwise(0), F.when(k == 0, 60).otherwise(90 + 14 * ((k - 1) % 40)), 60 + 14 * (k % 27), 60 + 14 * k + 10 * F.floor(k / 9)).cast("double")
    x = by(F.when(table, F.when(k % 8 == 3, 232).otherwise(72)).otherwise(72), F.when(k == 0, 100).otherwise(72 + 246 * F.floor((k - 1) / 40)), 72 + 170 * F.floor(k / 27), F.when(k % 5 == 0, 90).otherwise(72)).cast("double")
    per, most = by(F.when(table, 5).otherwise(8), F.when(k == 0, 0).otherwise(6), 5, 11).cast("double"), by(F.when(~table, 460.0), F.when(k > 0, 222.0), 150.0, 460.0)
    return F.struct(
        k.alias("k"), cells.alias("cells"), base.alias("base"), F.when((style == 3) & (k % 17 == 16), 16.0).otherwise(12.0).alias("size"), ((style == 3) & (k % 13 == 12)).alias("bold"), x.alias("x"),
        F.when(table, 160.0).otherwise(0.0).alias("gap"), per.alias("per"), F.when((style == 1) & (k == 0), 380.0).otherwise(0.0).alias("least"), most.alias("most"),
    )


def _set_cell(h: Column, t: Column, c: Column) -> Column:
    """The c-th cell of a line as a fragment (frag_no, text, n_chars, x0, x1, top, bottom, base, size, bold)."""
    x0 = h["x"] + h["gap"] * c
    return F.struct(
        (h["k"] * 4 + c).cast("long").alias("frag_no"), t.alias("text"), F.char_length(t).cast("long").alias("n_chars"), x0.alias("x0"), (x0 + F.greatest(h["least"], F.least(F.char_length(t) * h["per"], h["most"]))).alias("x1"),
        (h["base"] - 0.8 * h["size"]).alias("top"), (h["base"] + 0.22 * h["size"]).alias("bottom"), h["base"].alias("base"), h["size"].alias("size"), h["bold"].alias("bold"),
    )


def set_fragments(docs: DataFrame) -> DataFrame:
    """Texts set on pages: (doc_id, page_no, frag_no, text, n_chars, x0, x1, top, bottom, base, size, bold).

    Six words make a line, 80 lines a page. By doc_id % 4 a page has tables between prose (two words a cell, some cells wrapped), two columns under a title, three
    columns, or one column of indented paragraphs with larger and bold lines.
    """
    lines = _page_texts(docs).select("doc_id", "page_no", F.posexplode(_lines_of(F.col("text"))).alias("k", "six"))
    cells = lines.select("doc_id", "page_no", _set_line(F.col("doc_id") % 4, F.col("six"), F.col("k")).alias("h")).select("doc_id", "page_no", "h", F.posexplode("h.cells").alias("c", "t"))
    return cells.select("doc_id", "page_no", _set_cell(F.col("h"), F.col("t"), F.col("c")).alias("f")).select("doc_id", "page_no", "f.*")


def set_pages(docs: DataFrame) -> DataFrame:
    """set_fragments() with the fragments of a page in one row: (doc_id, page_no, frags). Pages are dealt as texts, before they are set, so rows of fragments are neither shuffled nor sorted."""
    n_parts = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # many small parts: fragments take far more room than their text
    whole = _page_texts(docs).repartition(n_parts, "doc_id", "page_no").groupBy("doc_id", "page_no").agg(F.collect_list("text").alias("texts"))
    lines = F.flatten(F.transform("texts", lambda text: F.transform(_lines_of(text), lambda six, k: _set_line(F.col("doc_id") % 4, six, k))))
    return whole.select("doc_id", "page_no", F.flatten(F.transform(lines, lambda h: F.transform(h["cells"], lambda t, c: _set_cell(h, t, c)))).alias("frags"))
