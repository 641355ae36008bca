"""Audit of how far the sources of each language differ in their terms."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import Workspace
from .line_dedup import salts_for

TERM = r"[a-z\x{80}-\x{10FFFF}]+"  # after A-Z are in lower case, all but the other ASCII characters; a class that names what it holds is matched far faster
SCALE = 1_000_000_000


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)), in decimals, since the product may pass 64 bits."""
    return F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (n + 2), total + 2 * terms)


def _apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most SCALE + 1, so 64 bits hold it."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def source_divergence(docs: DataFrame, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language lies from its other sources (part `pair`, all of them), and
    which terms it uses most above its language (part `term`, the `top` first).

    Terms are runs of ASCII letters and code points beyond ASCII, A-Z in lower case, of the whole texts. A language keeps the terms that at least
    `min_docs` of its documents hold; its groups (lang, source) get a share of SCALE for each kept term, occurring or not. Two shares p and q
    lie floor((p - q)^2 / (p + q)) apart; a pair sums that over the kept terms. Ranks: value descending, then item in UTF-8 order.

    Each text is read once: its terms go out as they occur, and once more each kind once, so one aggregate, combined before the shuffle, counts
    occurrences and documents. Kept terms meet their language's groups by (lang, salt), so that a language of most rows is dealt over salts_for(terms)
    tasks; pairs meet by (lang, term), each unordered pair once. Only the first few of a group are ranked where ranks are limited.

    Null text, lang or source is read as ''. A group without kept terms still has its pairs, with value 0 where its language keeps none. A language of
    one source has no pairs. Every row is a document of its own, repeated ones and equal ids too. Empty table: no rows. Other columns are ignored.
    """
    ws = Workspace(docs.sparkSession, "divergence")
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    named = docs.select(F.coalesce(lang_col, F.lit("")).alias("lang"), F.coalesce(source_col, F.lit("")).alias("source"), text.alias("text"))
    terms = named.select("lang", "source", F.regexp_extract_all("text", F.lit(TERM), F.lit(0)).alias("terms"))
    twice = terms.select("lang", "source", F.posexplode(F.array("terms", F.array_distinct("terms"))).alias("which", "some"))
    found = twice.select("lang", "source", "which", F.explode("some").alias("term")).groupBy("lang", "source", "term")
    counts = ws.save(found.agg(F.count_if(F.col("which") == 0).alias("n"), F.count_if(F.col("which") == 1).alias("docs")), "counts")

    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs)
    kept = ws.save(kept.select("lang", "term", "lang_n"), "kept")
    inside = ws.save(counts.join(kept.select("lang", "term"), ["lang", "term"]).select("lang", "source", "term", "n"), "inside")
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = inside.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = named.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["total", "terms", "lang_total"])
    groups = ws.save(groups, "groups")

    salts = salts_for(kept.count())
    dealt = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(salts)))
    spread = groups.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    dense = dealt.join(spread, ["lang", "salt"]).join(inside, ["lang", "source", "term"], "left").na.fill(0, ["n"])
    p, q = _share(F.col("n"), F.col("total"), F.col("terms")), _share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    dense = ws.save(dense.select("lang", "source", "term", "n", p.alias("p"), q.alias("q")), "dense")

    a, b = dense.select("lang", "term", "source", "p"), dense.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("q"))
    sums = a.join(b, ["lang", "term"]).filter("source < other").groupBy("lang", "source", "other").agg(F.sum(_apart(F.col("p"), F.col("q"))).alias("value"))
    both = ws.save(sums.withColumn("side", F.explode(F.array(F.struct("source", F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("source").alias("item"))))).select("lang", "side.*", "value"), "pairs")
    others = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").filter("source <> item")
    pairs = others.join(both, ["lang", "source", "item"], "left").na.fill(0, ["value"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    terms = dense.filter("n > 0 AND p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    rank = F.row_number().over(order)
    ws.keep(groups, dense, both)
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).filter(F.col("rank") <= top))
