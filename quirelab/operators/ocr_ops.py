"""Recognised words as text pieces, and which pages need recognition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def flatten(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, word_no, line, word) from pages whose `blocks` nest paragraphs, lines and words."""
    lines = F.flatten(F.flatten(F.transform("blocks", lambda b: F.transform(b["paragraphs"], lambda p: p["lines"]))))
    words = F.flatten(F.transform(lines, lambda x: F.transform(x["words"], lambda w: F.struct(x.alias("line"), w.alias("word")))))
    return pages.select("doc_id", "page_no", F.posexplode(words).alias("word_no", "w")).select("doc_id", "page_no", "word_no", "w.line", "w.word")


def baseline(bx0: Column, by0: Column, bx1: Column, by1: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Height of a line's base at a word's centre; null if the line has none or it lies far from the word."""
    y = by0 + (by1 - by0) * ((x0 + x1) / 2 - bx0) / F.nullif(bx1 - bx0, F.lit(0.0))
    return F.when((y >= y0) & (y <= y1 + (y1 - y0)), y)


def slopes(words: DataFrame) -> DataFrame:
    """(doc_id, page_no, slope): upper median of the slopes between neighbours on one line; 0 for pages with fewer than five."""
    w = Window.partitionBy("doc_id", "page_no").orderBy("word_no")
    low = F.coalesce("baseline_y", "y1")
    h, mid = F.col("y1") - F.col("y0"), (F.col("x0") + F.col("x1")) / 2
    before = words.select("doc_id", "page_no", "word_no", "x0", "x1", h.alias("h"), low.alias("low"), mid.alias("mid"), F.lag("x1").over(w).alias("px1"), F.lag(h).over(w).alias("ph"), F.lag(low).over(w).alias("plow"), F.lag(mid).over(w).alias("pmid"))
    tall, dx = F.greatest("h", "ph"), F.col("mid") - F.col("pmid")
    s = (F.col("low") - F.col("plow")) / dx
    near = before.filter((F.col("x0") >= F.col("px1") - 2) & (dx > tall) & (F.col("x0") - F.col("px1") <= 3 * tall) & (F.abs(F.col("h") - F.col("ph")) <= 0.5 * tall)).withColumn("s", s).filter(F.abs("s") < 0.2)
    listed = near.groupBy("doc_id", "page_no").agg(F.sort_array(F.collect_list("s")).alias("l"))
    return listed.select("doc_id", "page_no", F.when(F.size("l") >= 5, F.element_at("l", (F.floor(F.size("l") / 2) + 1).cast("int"))).otherwise(0.0).alias("slope"))


def pieces(words: DataFrame, least: int = 10) -> DataFrame:
    """Words of enough confidence as pieces in points, the page's slope taken out."""
    good = words.filter((F.trim("text") != "") & (F.col("confidence") >= least))
    rows = good.join(slopes(good), ["doc_id", "page_no"], "left").withColumn("slope", F.coalesce("slope", F.lit(0.0)))
    sx, sy, h = F.col("pdf_w") / F.col("px_w"), F.col("pdf_h") / F.col("px_h"), F.col("y1") - F.col("y0")
    base = F.coalesce(F.col("baseline_y"), F.col("y1") - 0.2 * h) - F.col("slope") * (F.col("x0") + F.col("x1")) / 2
    return rows.select(
        "doc_id", "page_no", "word_no", F.trim("text").alias("str"), (F.col("x0") * sx).alias("x"), (base * sy).alias("y"), F.greatest(F.lit(1.0), (F.col("x1") - F.col("x0")) * sx).alias("w"),
        F.greatest(F.lit(4.0), F.coalesce(F.col("line_height"), h) * sy * 0.85).alias("fs"),
    )


def scanned(sizes: DataFrame, pieces: DataFrame, images: DataFrame) -> DataFrame:
    """(doc_id, page_no, scanned): under 25 characters that aren't spaces, and images over a quarter of the page."""
    by = ["doc_id", "page_no"]
    chars = pieces.groupBy(*by).agg(F.sum(F.char_length(F.regexp_replace("str", r"[\s\u00a0\ufeff]", ""))).alias("chars"))
    area = images.groupBy(*by).agg(F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"))
    rows = sizes.join(chars, by, "left").join(area, by, "left")
    return rows.select(*by, ((F.coalesce("chars", F.lit(0)) < 25) & (F.coalesce("area", F.lit(0.0)) >= 0.25 * F.col("width") * F.col("height"))).alias("scanned"))
