"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import Workspace
from ._text import WORD


def ranked(ws: Workspace, sources: DataFrame) -> DataFrame:
    """Sources (skey, source, source_size) with their rank from 0 in code-point order, null last. Ranges of sources are numbered each by itself, after the counts of those before."""
    dealt = sources.repartitionByRange(F.col("source").isNull(), "source").withColumn("range", F.spark_partition_id())
    dealt = ws.save(dealt, "sources")
    counts = dealt.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))  # one row a range
    place = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last()))
    return dealt.join(F.broadcast(before), "range").withColumn("rank", F.col("before") + place - 1).drop("range", "before")


def with_targets(ws: Workspace, sources: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Adds `target` to one row per source (skey, source, source_size).

    Sources in code-point order, null last, get the weights in turn. The whole size is shared by weight; a source stops at `most` times its own
    size and the excess is shared again, until none is above. Each round is one aggregate over the sources; only its sums come to the driver.
    """
    cycle = F.array(*[F.lit(w) for w in weights])
    s = ranked(ws, sources).withColumn("w", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int"))).withColumn("cap", F.lit(most) * F.col("source_size"))
    s = ws.save(s.select("skey", "source", "source_size", "w", "cap"), "weights")
    level, stopped = 0.0, -1
    while True:
        above = F.lit(stopped >= 0) & (F.col("cap") < F.col("w") * F.lit(level))
        got = s.agg(F.sum("source_size").alias("all"), F.sum(F.when(above, F.col("cap"))).alias("capped"), F.sum(F.when(~above, F.col("w"))).alias("w"), F.count_if(above).alias("n")).first()
        if got["n"] == stopped or not got["w"]:
            break
        stopped, level = got["n"], (got["all"] - (got["capped"] or 0)) / got["w"]
    return s.select("skey", "source", "source_size", F.least(F.col("cap").cast("double"), F.col("w") * F.lit(level)).alias("target"))


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    most: int = 3,
    seed: str = "mix",
) -> DataFrame:
    """Every row of `docs` with `size` (words), `source_size`, `target`, `copies` and `taken` = size * copies.

    Within a source each document expects target / source_size copies; the expectations are summed over the
    documents in a fixed order, one offset per source is added, and a document is emitted once for each whole
    number that its part of the sum crosses. Documents are ordered by (size class, salt, size, id, text digest), so that
    every size is taken at its share; salts are of id and text, so null ids, or one id of many texts, are dealt too. The prefix sum is in two levels: counts per (source, class, salt) first, then row numbers
    within each (source, class, salt), so that a source that holds most of the rows is spread over many tasks; there are
    sqrt(rows) / 64 + 1 salts. The offset comes from md5 of seed and source: reruns agree.

    Null or empty text: size 0, taken 0. Null source: a source of its own, last. Null id: ordered first, as one more
    value. Equal rows count as separate documents. A source or table without words: target 0, no copies. Input columns
    named like an output column are replaced.
    """
    text, ident = F.col(text_col), F.col(id_col).cast("string")
    out = ("size", "source_size", "target", "copies", "taken")
    base = docs.drop(*[c for c in out if c not in (id_col, text_col, source_col)])
    n_docs = base.select(F.count(F.lit(1)).alias("n")).first()["n"]
    salts = int((max(n_docs, 1) ** 0.5) / 64) + 1
    base = (
        base.withColumn("size", F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long"))
        .withColumn("_bits", F.length(F.bin("size")))
        .withColumn("_class", F.col("_bits") * 8 + F.expr("shiftright(size, greatest(_bits - 4, 0))"))
        .withColumn("_skey", F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n")))
        .withColumn("_digest", F.md5(F.coalesce(text, F.lit("")).cast("binary")))
        .withColumn("_salt", F.pmod(F.conv(F.substring(F.md5(F.concat(F.coalesce(ident, F.lit("")), F.lit("|"), "_digest").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(salts)))
    )
    cells = base.groupBy(F.col("_skey").alias("skey"), F.col("_class").alias("class"), F.col("_salt").alias("salt")).agg(
        F.min(source_col).alias("source"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")
    )
    sources = cells.groupBy("skey").agg(F.min("source").alias("source"), F.sum("size").alias("source_size"))
    targets = with_targets(Workspace(docs.sparkSession, "mix"), sources, weights, most)
    earlier = Window.partitionBy("skey").orderBy("class", "salt").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("skey")).cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    placed = (
        cells.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .select("skey", "class", "salt", "before")
        .join(targets.select("skey", "source_size", "target"), "skey")
        .select(
            F.col("skey").alias("_skey"), F.col("class").alias("_class"), F.col("salt").alias("_salt"), "before", "source_size", "target",
            F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("each"),
            offset.alias("offset"),
        )
    )
    order = Window.partitionBy("_skey", "_class", "_salt").orderBy("size", id_col, "_digest")
    k = F.col("before") + F.col("_k")
    copies = (F.floor(k * F.col("each") + F.col("offset")) - F.floor((k - 1) * F.col("each") + F.col("offset"))).cast("int")
    return (
        base.withColumn("_k", F.row_number().over(order))
        .join(placed, ["_skey", "_class", "_salt"])
        .withColumn("copies", copies)
        .withColumn("taken", F.col("size") * F.col("copies"))
        .drop("_skey", "_bits", "_class", "_salt", "_digest", "_k", "before", "each", "offset")
    )


def emit_copies(mixed: DataFrame) -> DataFrame:
    """Each row of mix_sources() as often as the mix takes it: repeated rows for copies over one, none for copies of null or 0. Other columns stay. Empty table: empty result."""
    return mixed.withColumn("_copy", F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies"))))).drop("_copy")
