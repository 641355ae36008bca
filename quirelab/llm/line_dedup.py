"""Line dedup over overlapping windows of consecutive lines, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import WORD

SALTS = 32


def salts_for(rows: int) -> int:
    """So many that a window which a third of the rows hold is dealt over tasks whose load grows as the square root of the rows alone."""
    return max(SALTS, int(rows**0.5) // 32)


def _ident(doc: Column, text: Column) -> Column:
    """Orders documents: null ids last, then by id, then by a digest of the text."""
    return F.struct(doc.isNull().alias("x"), doc.alias("d"), F.xxhash64(text).alias("t"))


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lines: int = 3) -> DataFrame:
    """Every row of `docs` with repeated passages of lines removed from `text`, plus `n_lines` and `n_removed`.

    Lines are the \\n-split parts of the whole text, compared as they are. Each run of `lines` consecutive lines with at
    least one that is not blank is a window. Of equal windows anywhere in the table the first, by (id, position), stays;
    a line covered by any later one is removed. Windows are judged on the input. Remaining lines are joined by \\n.

    First occurrences come from a minimum per window that is combined before the shuffle; the way back to the
    occurrences is keyed by (window, salt), so a window that occurs in a third of all documents is dealt over salts_for(rows) tasks. Windows are compared by two 64-bit hashes.

    Null text stays null, with no lines. Empty text has one blank line. A text of fewer than `lines` lines has no window
    and stays. Rows that share an id count as one document if their texts agree and as separate ones if not. Null ids come
    last. Input columns called n_lines or n_removed are replaced.
    """
    base = docs.drop(*[c for c in ("n_lines", "n_removed") if c not in (id_col, text_col)])
    text = F.col(text_col)
    parts = F.split(text, "\n", -1)
    salts = salts_for(base.select(F.count(F.lit(1)).alias("n")).first()["n"])
    some = base.filter(F.size(parts) >= lines).select(_ident(F.col(id_col), text).alias("doc"), parts.alias("part"))
    here = lambda i: [F.col("part")[i + j] for j in range(lines)]
    at = F.transform(
        F.sequence(F.lit(0), F.size("part") - lines),
        lambda i: F.struct(i.alias("pos"), F.xxhash64(*here(i)).alias("h1"), F.xxhash64(F.lit("second"), *here(i)).alias("h2"), F.concat(*here(i)).rlike(WORD).alias("shown")),
    )
    seen = (
        some.select("doc", F.explode(F.filter(at, lambda w: w["shown"])).alias("w"))
        .select("doc", F.col("w.pos").alias("pos"), F.col("w.h1").alias("h1"), F.col("w.h2").alias("h2"))
        .withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(salts)).cast("int"))
    )
    first = F.min(F.struct("doc", "pos"))
    partial = seen.groupBy("h1", "h2", "salt").agg(first.alias("first"), F.count(F.lit(1)).alias("n"))
    repeated = (
        partial.groupBy("h1", "h2")
        .agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.collect_list("salt").alias("salts"))
        .filter("n > 1")
        .select("h1", "h2", "first", F.explode("salts").alias("salt"))
    )
    later = seen.join(repeated, ["h1", "h2", "salt"]).filter(F.struct("doc", "pos") > F.col("first"))
    starts = later.groupBy("doc").agg(F.collect_set("pos").alias("_starts"))
    key = _ident(F.col(id_col), text)
    joined = base.withColumn("_key", F.to_json(key)).join(starts.select(F.to_json("doc").alias("_key"), "_starts"), "_key", "left")
    joined = joined.withColumn("_parts", parts)  # a column, or each line that stays would split the text anew
    gone = F.array_distinct(F.flatten(F.transform("_starts", lambda p: F.sequence(p, p + (lines - 1)))))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_parts") - 1), "_gone")
    kept = F.array_join(F.transform(stay, lambda i: F.col("_parts")[i]), "\n")
    return (
        joined.withColumn("n_lines", F.when(text.isNull(), 0).otherwise(F.size("_parts")).cast("long"))
        .withColumn("_gone", gone)
        .withColumn("n_removed", F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long"))
        .withColumn(text_col, F.when(F.col("n_removed") > 0, kept).otherwise(text))
        .drop("_key", "_starts", "_parts", "_gone")
    )
