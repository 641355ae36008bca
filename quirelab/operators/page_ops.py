"""Page algebra: pages (doc_id, page_no, ...) are selected, split, merged, reordered and turned."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types

from quirelab.functions import ranges as R
from quirelab.functions.text import bound


def base_name(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)\.pdf$", "")


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("page_count"))


def _chosen(files: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages of files (doc_id, file_no, file_name, start, end): ranges become page numbers, so that the join is on equal keys."""
    per_page = files.filter("start <= end").withColumn("page_no", F.explode(F.sequence("start", "end")))
    return per_page.select("doc_id", "file_no", "file_name", "page_no").join(pages, ["doc_id", "page_no"])


def _span(label: str = "") -> Column:
    s, e = F.col("start"), F.col("end")
    return F.concat(F.lit(label), s.cast("string"), F.when(s != e, F.concat(F.lit("-"), e.cast("string"))).otherwise(F.lit("")))


def split_pages(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """docs (doc_id, name, ranges): one file for each range, `base_s[-e].pdf`, ranges clamped to the pages there are."""
    files = docs.select("doc_id", "name", F.posexplode("ranges").alias("file_no", "r")).select("doc_id", "file_no", "name", "r.start", "r.end")
    files = files.withColumn("file_name", F.concat(base_name(F.col("name")), F.lit("_"), _span(), F.lit(".pdf")))
    return _chosen(files, pages)


def extract_separate(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """One file for each range, `base_p{s}[-{e}].pdf`; overlapping ranges repeat pages. `page_count` is the length of the range."""
    files = docs.select("doc_id", "name", F.posexplode("ranges").alias("file_no", "r")).select("doc_id", "file_no", "name", "r.start", "r.end")
    files = files.withColumn("file_name", F.concat(base_name(F.col("name")), F.lit("_"), _span("p"), F.lit(".pdf")))
    counts = files.select("doc_id", "file_no", (F.col("end") - F.col("start") + 1).alias("page_count"))
    return _chosen(files, pages).join(counts, ["doc_id", "file_no"])


def extract_merged(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """One file of all pages in any range, in document order; the label and `page_count` go by the pages that were asked for."""
    asked = docs.withColumn("want", R.expand(F.col("ranges"))).filter("size(want) > 0")
    first, last = F.element_at("want", 1).cast("string"), F.element_at("want", -1).cast("string")
    label = F.concat(F.lit("p"), first, F.when(F.size("want") > 1, F.concat(F.lit("-"), last)).otherwise(F.lit("")))
    asked = asked.select("doc_id", F.concat(base_name(F.col("name")), F.lit("_extracted_"), label, F.lit(".pdf")).alias("file_name"), F.size("want").alias("page_count"), F.explode("want").alias("page_no"))
    return asked.join(pages, ["doc_id", "page_no"])


def remove_pages(pages: DataFrame, gone: DataFrame) -> DataFrame:
    """Pages without those listed in gone (doc_id, page_no); numbers that don't exist are ignored."""
    return pages.join(gone.select("doc_id", "page_no").distinct(), ["doc_id", "page_no"], "left_anti")


def islands(chosen: DataFrame) -> DataFrame:
    """(doc_id, page_no) to ranges of consecutive pages."""
    once = chosen.select("doc_id", "page_no").distinct()
    key = F.col("page_no") - F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no"))
    return once.withColumn("k", key).groupBy("doc_id", "k").agg(F.min("page_no").alias("start"), F.max("page_no").alias("end")).drop("k")


def merge(pages: DataFrame, job: str = "job_id", order: tuple[str, ...] = ("file_seq", "page_no")) -> DataFrame:
    """Pages of a merge job's files in file order, numbered anew."""
    return pages.withColumn("out_page", F.row_number().over(Window.partitionBy(job).orderBy(*order)))


def organize(pages: DataFrame, ops: DataFrame) -> DataFrame:
    """ops (doc_id, op_seq, type, original_index, rotation) drive the output: originals that don't exist are skipped, rotation
    adds up, blank pages are A4. Pages may repeat."""
    p = pages.withColumn("original_index", F.col("page_no") - 1)
    out = ops.join(p, ["doc_id", "original_index"], "left").filter((F.col("type") == "blank") | F.col("page_no").isNotNull())
    blank = F.col("type") == "blank"
    turned = F.when(blank, F.col("rotation")).otherwise(F.pmod(F.coalesce("page_rotation", F.lit(0)) + F.col("rotation"), F.lit(360)))
    return (
        out.withColumn("out_page", F.row_number().over(Window.partitionBy("doc_id").orderBy("op_seq")))
        .withColumn("out_rotation", turned)
        .withColumn("width", F.when(blank, F.lit(595.28)).otherwise(F.col("width")))
        .withColumn("height", F.when(blank, F.lit(841.89)).otherwise(F.col("height")))
    )


def move_selected(pages: DataFrame, selected: Column, front: bool = True) -> DataFrame:
    """Selected pages first (or last), each kind in its old order."""
    lead = F.when(selected, 0).otherwise(1) if front else F.when(selected, 1).otherwise(0)
    return pages.withColumn("new_seq", F.row_number().over(Window.partitionBy("doc_id").orderBy(lead, "page_no")))


def move_one(seq: Column, source: Column, target: Column) -> Column:
    """New place of each item when the item at `source` is put at `target`."""
    return (
        F.when(seq == source, target)
        .when((source < target) & (seq > source) & (seq <= target), seq - 1)
        .when((source > target) & (seq >= target) & (seq < source), seq + 1)
        .otherwise(seq)
    )


def insert_blank(pages: DataFrame, selected: Column) -> DataFrame:
    """A blank page after each document's last selected page, or at its end; numbered anew as `new_seq`."""
    at = pages.groupBy("doc_id").agg(F.coalesce(F.max(F.when(selected, F.col("page_no"))), F.max("page_no")).alias("page_no"))
    rows = pages.select("doc_id", "page_no", F.lit("original").alias("type"), F.lit(0).alias("k")).unionByName(at.select("doc_id", "page_no", F.lit("blank").alias("type"), F.lit(1).alias("k")))
    return rows.withColumn("new_seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no", "k"))).drop("k")


def rotate(pages: DataFrame, turns: DataFrame) -> DataFrame:
    """Adds the turns (doc_id, page_index, angle) to `rotation`, modulo 360; other pages stay."""
    t = turns.groupBy("doc_id", "page_index").agg(F.sum("angle").alias("angle"))
    p = pages.withColumn("page_index", F.col("page_no") - 1).join(t, ["doc_id", "page_index"], "left")
    return p.withColumn("rotation", F.pmod(F.col("rotation") + F.coalesce("angle", F.lit(0)), F.lit(360)).cast("int")).drop("angle", "page_index")


def append_capped(files: DataFrame, most: int = 20) -> DataFrame:
    """The first `most` files of each job."""
    return files.filter(F.col("file_seq").isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy("job_id").orderBy("file_seq"))).filter(F.col("_n") <= most).drop("_n")


@F.pandas_udf(types.ArrayType(types.StringType()))
def _told_apart(names: pd.Series) -> pd.Series:
    """Names of one group in order, each made different from all before it by the first number from 2 that does."""

    def one(own: list[str]) -> list[str]:
        taken: dict[str, int] = {}
        out = []
        for name in own:
            stem, dot, end = name.rpartition(".") if "." in name else (name, "", "")
            new = name
            while new in taken:
                taken[name] += 1
                new = f"{stem} ({taken[name]}){dot}{end}"
            taken[new] = 1
            out.append(new)
        return out

    return names.map(one)


def unique_names(files: DataFrame) -> DataFrame:
    """files (job_id, file_seq, name, ...) with `unique_name`: a name that its archive has already gets ` (n)` before its extension, n the first from 2 that no earlier
    file has, be it by its own name. Equal file_seq: ties by name. Null names stay null.

    Only names that agree but for such numbers can meet. Where all of them are one name its copies are numbered by a window; only groups that hold numbers of their own are
    settled name by name.
    """
    kin = F.regexp_replace("name", r"( \(\d+\))+(?=(\.[^.]*)?$)", "")
    group = Window.partitionBy("job_id", "_kin")
    rows = files.withColumn("_kin", kin).withColumn("_place", F.row_number().over(group.orderBy("file_seq", "name"))).withColumn("_mixed", F.min("name").over(group) != F.max("name").over(group))
    stem, end = F.regexp_replace("name", r"\.[^.]*$", ""), F.regexp_extract("name", r"(\.[^.]*)$", 1)
    plain = rows.filter("NOT coalesce(_mixed, false)").withColumn("unique_name", F.when((F.col("_place") == 1) | F.col("name").isNull(), F.col("name")).otherwise(F.concat(stem, F.lit(" ("), "_place", F.lit(")"), end)))
    mixed = rows.filter("_mixed")
    lists = mixed.groupBy("job_id", "_kin").agg(F.sort_array(F.collect_list(F.struct("_place", "name"))).alias("l"))
    lists = lists.select("job_id", "_kin", F.posexplode(_told_apart(F.transform("l", lambda x: x["name"]))).alias("_at", "unique_name")).withColumn("_place", F.col("_at") + 1).drop("_at")
    return plain.unionByName(mixed.join(lists, ["job_id", "_kin", "_place"])).drop("_kin", "_place", "_mixed")


def missing_contents(refs: DataFrame, objects: DataFrame) -> DataFrame:
    """(doc_id, page_no) of pages that refer (doc_id, page_no, ref) to an object that the document (doc_id, ref) does not have."""
    return refs.join(objects.select("doc_id", "ref").distinct(), ["doc_id", "ref"], "left_anti").select("doc_id", "page_no").distinct()


def clean_pieces(pieces: DataFrame) -> DataFrame:
    """Pieces (doc_id, page_no, piece_no, raw, x, y, w, fs): blank ones and those of half a point or less go, spaces around the text too, with their share of the box; of doubles the first stays."""
    edge = r"^[\s\u00a0\ufeff]+|[\s\u00a0\ufeff]+$"
    text = F.regexp_replace("raw", edge, "")
    lead = F.char_length("raw") - F.char_length(F.regexp_replace("raw", r"^[\s\u00a0\ufeff]+", ""))
    each = F.col("w") / F.char_length("raw")
    shown = pieces.filter((F.col("fs") > 0.5) & (text != "")).withColumn("str", text)
    shown = shown.withColumn("x", F.col("x") + lead * each).withColumn("w", F.greatest(F.lit(0.1), F.col("w") - (F.char_length("raw") - F.char_length("str")) * each))
    return dedup_pieces(shown.drop("raw"))


def dedup_pieces(pieces: DataFrame) -> DataFrame:
    """Of pieces with one text at one rounded place on a page, the first."""
    near = lambda c: F.floor(F.col(c) + 0.5)
    w = Window.partitionBy("doc_id", "page_no", "str", near("x"), near("y")).orderBy("piece_no")
    return pieces.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def distinct_pieces(pieces: Column) -> Column:
    """dedup_pieces() of the pieces of one page in an array: nothing is dealt or written."""
    near = lambda c: F.floor(c + 0.5)
    told = F.transform(pieces, lambda i: F.struct(F.struct(near(i["y"]), near(i["x"]), i["str"]).alias("place"), i["piece_no"].alias("piece_no"), i.alias("piece")))
    first = lambda s: F.filter(s, lambda i, k: (k == 0) | ~i["place"].eqNullSafe(F.get(s, k - 1)["place"]))
    return F.transform(bound(F.sort_array(told), first), lambda i: i["piece"])


def first_seen(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """Distinct keys with the place where each is first seen."""
    return rows.groupBy(key).agg(F.min(seq).alias("first_seq"))
