"""Searches and lists over catalogues and usage logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyword_search(items: DataFrame, query: str) -> DataFrame:
    """Items whose name, description or a tag holds the query; a blank query gives all. Tags are compared as they are written."""
    q = query.strip().lower()
    if not q:
        return items
    return items.filter(F.lower("name").contains(q) | F.lower("description").contains(q) | F.exists("tags", lambda t: t.contains(q)))


def available(listed: Column, needs_backend: Column, backend: bool) -> Column:
    return listed & (~needs_backend | F.lit(backend))


def filled(categories: DataFrame, items: DataFrame) -> DataFrame:
    """Categories that have an item listed."""
    return categories.join(items.filter("listed").select("category").distinct(), "category", "left_semi")


def lookup_in_order(wanted: DataFrame, items: DataFrame, key: str = "slug") -> DataFrame:
    """wanted (seq, slug) with what the items say of each; missing ones drop out. Order by seq."""
    return wanted.join(items, key)


def with_default_title(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """The known title of each slug, else the slug with capitals and spaces."""
    return wanted.join(known, "slug", "left").withColumn("title", F.coalesce("title", F.initcap(F.replace(F.col("slug"), F.lit("-"), F.lit(" ")))))


def by_category(items: DataFrame, category: str) -> DataFrame:
    return items.filter(F.col("category") == category)


def menu(categories: DataFrame) -> DataFrame:
    """Categories (category, items: array<struct<slug, listed>>) with their listed items alone; those left empty are dropped."""
    return categories.withColumn("items", F.filter("items", lambda i: i["listed"])).filter(F.size("items") > 0)


def tools_of_posts(posts: DataFrame, items: DataFrame) -> DataFrame:
    """(post, place, slug, title): the items that each post (post, slugs) names, in its order; unknown and unlisted ones drop out."""
    named = posts.select("post", F.posexplode("slugs").alias("place", "slug"))
    return named.join(items.filter("listed").select("slug", "title"), "slug").select("post", "place", "slug", "title")


def next_hit(at: Column, hits: Column, step: int = 1) -> Column:
    """The hit after (or before) `at`, around the end; `at` itself without hits."""
    return F.when(hits > 0, F.pmod(at + step, hits)).otherwise(at)


def all_but_first(rows: DataFrame, *order: str) -> DataFrame:
    """Rows but the first in this order, which one aggregate finds."""
    keys = F.struct(*order)
    first = rows.agg(F.min(keys).alias("_first"))
    return rows.join(F.broadcast(first), keys != F.col("_first")).drop("_first")  # one row


def sitemap(pages: DataFrame, items: DataFrame, posts: DataFrame, top: tuple[str, ...], base: str) -> DataFrame:
    """(url, changed, frequency, priority) of pages (path, changed, frequency, priority), available items (slug, changed) and posts (slug, changed)."""
    url = lambda part: F.concat(F.lit(base), part)
    tools = items.select(url(F.concat(F.lit("/tools/"), "slug")).alias("url"), "changed", F.lit("weekly").alias("frequency"), F.when(F.col("slug").isin(*top), 0.9).otherwise(0.8).alias("priority"))
    blog = posts.select(url(F.concat(F.lit("/blog/"), "slug")).alias("url"), "changed", F.lit("monthly").alias("frequency"), F.lit(0.7).alias("priority"))
    return pages.select(url(F.col("path")).alias("url"), "changed", "frequency", "priority").unionByName(tools).unionByName(blog)


def related(items: DataFrame, keys: Column, most: int = 3) -> DataFrame:
    """(id, rank, related_id): the first `most` other items that share a key (a category or tag) with each, in catalogue order `seq`.

    A key that very many items have is no pair of each with each: only its first most + 1 items can be among anyone's first.
    """
    keyed = items.select("id", "seq", F.explode(F.array_distinct(keys)).alias("key"))
    lead = keyed.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("seq", "id"))).filter(F.col("n") <= most + 1)
    lead = lead.groupBy("key").agg(F.collect_list(F.struct("seq", F.col("id").alias("related_id"))).alias("lead"))
    pairs = keyed.select("id", "key").join(lead, "key").select("id", F.explode("lead").alias("r")).select("id", "r.seq", "r.related_id").filter("id <> related_id").distinct()
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("seq", "related_id"))).filter(F.col("rank") <= most).select("id", "rank", "related_id")


def recent(events: DataFrame, most: int = 6) -> DataFrame:
    """(user_id, rank, item): the `most` items that each user used last, once each."""
    last = events.groupBy("user_id", "item").agg(F.max(F.struct("ts", "event_id")).alias("last"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("last")))
    return last.withColumn("rank", rank).filter(F.col("rank") <= most).select("user_id", "rank", "item")


def favourites(events: DataFrame) -> DataFrame:
    """(user_id, rank, item): items toggled an odd number of times, in the order they were last added."""
    odd = events.groupBy("user_id", "item").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("ts", "event_id")).alias("last")).filter("n % 2 = 1")
    return odd.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy("last"))).select("user_id", "rank", "item")


def best_candidate(candidates: DataFrame, target: Column, try_all: bool = False) -> DataFrame:
    """One row a document (doc_id, original_size, seq, name, size): candidates are tried in order until the smallest so far is within the target
    (without a target: the first alone); never larger than the original. `reduction` in percent; `missed` if the target isn't reached.

    With try_all the smallest so far starts at the original, and without a target all candidates are tried."""
    w = Window.partitionBy("doc_id").orderBy("seq")
    before = F.min(F.when(F.col("size") < F.col("original_size"), F.col("size")) if try_all else F.col("size")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    tried = candidates.withColumn("target", target).withColumn("before", before)
    go_on = F.col("target").isNull() if try_all else F.lit(False)
    tried = tried.filter(F.col("before").isNull() | go_on | (F.col("target").isNotNull() & (F.col("before") > F.col("target"))))
    best = tried.groupBy("doc_id", "original_size", "target").agg(F.min(F.struct("size", "seq", "name")).alias("b"))
    smaller = F.col("b.size") < F.col("original_size")
    size = F.when(smaller, F.col("b.size")).otherwise(F.col("original_size"))
    return best.select(
        "doc_id", "original_size", size.alias("size"), F.when(smaller, F.col("b.name")).otherwise(F.lit("original")).alias("mode"),
        F.greatest(F.lit(0), F.floor((1 - size / F.col("original_size")) * 100 + 0.5)).cast("int").alias("reduction"),
        F.coalesce(size > F.col("target"), F.lit(False)).alias("missed"),
    )
