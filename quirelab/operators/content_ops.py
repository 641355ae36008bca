"""What a page shows: where its drawing operators paint images, and its HTML without elements that are hidden."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelab.functions.geometry import distinct_boxes, image_box

_MATRIX = "array<double>"


def _times(m: Column, n: Column) -> Column:
    """The matrix (a, b, c, d, e, f) that applies n first, then m."""
    pair = lambda x, y: [m[i] * x + m[i + 2] * y for i in (0, 1)]
    e, f = pair(n[4], n[5])
    return F.array(*pair(n[0], n[1]), *pair(n[2], n[3]), e + m[4], f + m[5])


def painted_images(operators: DataFrame, sizes: DataFrame, viewport: Column) -> DataFrame:
    """(doc_id, page_no, image_no, x0, y0, x1, y1) from operators (doc_id, page_no, op_no, op, matrix) and page sizes (doc_id, page_no, width, height).

    A fold over a page's operators, whose state is the matrix now and those saved: save and form put it by (a form applies its own matrix, if it has one), restore and end take the last
    one back, or the plain one if none is left; transform applies a matrix. Each paint gives the box of the unit square under it and the viewport, held to the page. Boxes with a side under 24
    go, and those within a point of one that stays. Null matrices leave all as it is. Operators of other names do nothing.
    """
    op = F.struct("op_no", "op", F.col("matrix").cast(_MATRIX).alias("matrix"))
    pages = operators.filter(F.col("op").isin("save", "restore", "transform", "form", "end", "paint")).groupBy("doc_id", "page_no").agg(F.sort_array(F.collect_list(op)).alias("ops"))
    plain = F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)]).cast(_MATRIX)

    def run(s: Column, o: Column) -> Column:
        puts, takes = o["op"].isin("save", "form"), o["op"].isin("restore", "end")
        moved = F.when(o["op"].isin("transform", "form") & o["matrix"].isNotNull(), _times(s["now"], o["matrix"])).otherwise(s["now"])
        back = F.coalesce(F.get(s["saved"], F.size(s["saved"]) - 1), plain)
        return F.struct(
            F.when(takes, back).otherwise(moved).alias("now"),
            F.when(puts, F.array_append(s["saved"], s["now"])).when(takes & (F.size(s["saved"]) > 0), F.slice(s["saved"], F.lit(1), F.size(s["saved"]) - 1)).otherwise(s["saved"]).alias("saved"),
            F.when(o["op"] == "paint", F.array_append(s["painted"], s["now"])).otherwise(s["painted"]).alias("painted"),
        )

    none = F.array().cast(f"array<{_MATRIX}>")
    start = F.struct(plain.alias("now"), none.alias("saved"), none.alias("painted"))
    painted = pages.select("doc_id", "page_no", F.aggregate("ops", start, run, lambda s: s["painted"]).alias("painted")).join(sizes, ["doc_id", "page_no"]).withColumn("view", viewport.cast(_MATRIX))

    def box(m: Column) -> Column:
        full = _times(F.col("view"), m)
        return image_box([full[i] for i in range(6)], F.col("width"), F.col("height"))

    boxes = F.filter(F.transform("painted", box), lambda b: b.isNotNull())
    return painted.select("doc_id", "page_no", F.posexplode(distinct_boxes(boxes)).alias("image_no", "b")).select("doc_id", "page_no", "image_no", "b.x0", "b.y0", "b.x1", "b.y1")


# What classes and ids hold of what a reader can have hidden, and elements hidden by name or by a class of their own.
HIDDEN_PARTS = {
    "cookies": (("cookie", "cmp", "consent", "gdpr"), ("cookie", "cmp", "consent", "gdpr")),
    "popups": (("popup", "overlay", "modal"), ("popup", "overlay")),
    "ads": (("ad-", "ads-"), ("ad-", "ads-")),
}
HIDDEN_NAMES = {"ads": "iframe", "print": "header footer nav aside"}
HIDDEN_CLASSES = {"ads": ("adsbygoogle", "ins"), "print": ("sidebar", None)}
VOID = "area base br col embed hr img input link meta source track wbr"
TOKEN = r"(?s)<!--.*?-->|<(?i:script|style|textarea|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?</(?i:script|style|textarea|title)\s*>|</?[A-Za-z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|<![^>]*>|[^<]+|<"


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a tag, without quotes; empty if it has none."""
    value = F.regexp_extract(tag, rf"(?is)^<[^>]*?\s{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1)
    return F.regexp_replace(value, "^[\"']|[\"']$", "")


def hides(tag: Column, features: tuple[str, ...]) -> Column:
    """Whether an opening tag is one that the features hide: parts of class and id whatever their case, element names, and single classes."""
    name, cls, own = F.lower(F.regexp_extract(tag, r"^<([A-Za-z][^\s/>]*)", 1)), _attribute(tag, "class"), _attribute(tag, "id")
    out = F.lit(False)
    for f in features:
        for value, parts in zip((cls, own), HIDDEN_PARTS.get(f, ((), ())), strict=True):
            for part in parts:
                out = out | F.lower(value).contains(part)
        if f in HIDDEN_NAMES:
            out = out | name.isin(*HIDDEN_NAMES[f].split())
        if f in HIDDEN_CLASSES:
            single, element = HIDDEN_CLASSES[f]
            has = F.array_contains(F.split(cls, r"[\x20\x09-\x0D]+"), single)
            out = out | (has & (name == element) if element else has)
    return out


def without_hidden(pages: DataFrame, by: str, features: tuple[str, ...] = ("cookies", "popups", "ads", "print")) -> DataFrame:
    """(by, html, n_hidden): pages without the elements that the features hide, and how many were cut.

    Tags are rows. Their nesting is a running sum of opening and closing tags of one name, so that others left open don't count; of one name and level, the tag after an opening one closes it. An
    element that is hidden is cut up to there, or to the page's end if it is never closed: a running maximum of these ends tells what lies within. Elements without content,
    scripts and styles are cut alone. Null html stays null. Rows that share a value of `by` must not be there.
    """
    t = pages.select(by, F.posexplode(F.regexp_extract_all("html", F.lit(f"({TOKEN})"), F.lit(1))).alias("pos", "t"))
    name = F.lower(F.regexp_extract("t", r"^</?([A-Za-z][^\s/>]*)", 1))
    t = t.withColumn("name", name).withColumn("alone", name.isin(*VOID.split(), "script", "style", "textarea", "title", "") | F.col("t").rlike(r"/>$"))
    t = t.withColumn("step", F.when(F.col("alone"), 0).when(F.col("t").startswith("</"), -1).otherwise(1)).withColumn("hides", F.col("t").rlike("^<[A-Za-z]") & hides(F.col("t"), features))
    depth = F.sum("step").over(Window.partitionBy(by, "name").orderBy("pos"))
    t = t.withColumn("level", F.when(F.col("step") == -1, depth + 1).otherwise(depth))
    closes = F.lead("pos").over(Window.partitionBy(by, "name", "alone", "level").orderBy("pos"))
    page = Window.partitionBy(by)
    end = F.when(F.col("alone"), F.col("pos")).otherwise(F.coalesce(closes, F.max("pos").over(page)))
    t = t.withColumn("end", F.when(F.col("hides"), end))
    upto = page.orderBy("pos")
    t = t.withColumn("outer", F.coalesce(F.max("end").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).withColumn("within", F.greatest("outer", F.coalesce("end", F.lit(-1))) >= F.col("pos"))
    kept = F.collect_list(F.when(~F.col("within"), F.struct("pos", "t")))
    done = t.groupBy(by).agg(F.array_join(F.transform(F.sort_array(kept), lambda x: x["t"]), "").alias("_shown"), F.count_if(F.col("hides") & (F.col("pos") > F.col("outer"))).alias("n"))
    shown = pages.select(by, "html").join(done, by, "left")
    return shown.select(by, F.when(F.col("html").isNotNull(), F.coalesce("_shown", F.lit(""))).alias("html"), F.coalesce("n", F.lit(0)).alias("n_hidden"))
