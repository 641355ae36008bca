"""Operators over lines, words and positioned words."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types

from quirelab.functions import text as T


def word_rows(docs: DataFrame, text: Column, normal: bool = True) -> DataFrame:
    """(doc_id, word_no, word), word_no from 0."""
    return docs.select("doc_id", F.posexplode(T.words(text, normal)).alias("word_no", "word"))


def repeated_lines(lines: DataFrame, least: int = 3) -> DataFrame:
    """Keys of lines that a document has `least` times or more."""
    keyed = lines.select("doc_id", T.repeat_key(F.col("line")).alias("line_key")).filter("line_key <> ''")
    return keyed.groupBy("doc_id", "line_key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def paired(ref: DataFrame, out: DataFrame, words: Callable[[Column], Column], run: int = 12) -> DataFrame:
    """(ref_id, out_id, rw, ow): texts (id, text) of the two sides that share a run of `run` words, as word lists.

    The runs of each side meet as 64-bit hashes in one equi-join, each once a text; the texts of pairs alone are read again, and only pairs that share a run, word by word, stay. A run that
    all texts share pairs each reference that has it with all of them, since these are pairs.
    """
    # the hashes are plain numbers: arrays of structs are made distinct by comparing all with all
    hashes = lambda d, name: d.select(F.col("id").alias(name), words(F.col("text")).alias("w")).select(name, F.explode(F.array_distinct(_run_hashes(F.col("w"), run))).alias("h"))
    found = hashes(out, "out_id").join(hashes(ref, "ref_id"), "h").select("ref_id", "out_id").distinct()
    text = lambda d, key, name: d.select(F.col("id").alias(key), F.col("text").alias(name))
    both = found.join(text(ref, "ref_id", "rt"), "ref_id").join(text(out, "out_id", "ot"), "out_id").select("ref_id", "out_id", words(F.col("rt")).alias("rw"), words(F.col("ot")).alias("ow"))
    return both.filter(_once(F.struct("rw", "ow"), lambda p: F.arrays_overlap(_runs(p["rw"], run), _runs(p["ow"], run))))


def run_pairs(ref: DataFrame, out: DataFrame, run: int = 12) -> DataFrame:
    """(ref_id, out_id) of word lists (id, words) that share a run of `run` words."""
    spelled = lambda d: d.select("id", F.array_join("words", "\0").alias("text"))
    return paired(spelled(ref), spelled(out), lambda t: F.filter(F.split(t, "\0"), lambda w: w != ""), run).select("ref_id", "out_id")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with `value` computed once: where Spark moves a filter below a projection, it writes the projected expression wherever the filter names it, inside of lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _at(words: Column, run: int) -> Column:
    return F.when(F.size(words) >= run, F.sequence(F.lit(1), F.size(words) - (run - 1))).otherwise(F.array().cast("array<int>"))


def _runs(words: Column, run: int) -> Column:
    """Every run of `run` consecutive words, by position."""
    return F.transform(_at(words, run), lambda i: F.array_join(F.slice(words, i, run), " "))


def _run_hashes(words: Column, run: int) -> Column:
    """A 64-bit hash of every run."""
    return F.transform(_at(words, run), lambda i: F.xxhash64(F.slice(words, i, run)))


def _with_lists(pairs: DataFrame, ref: DataFrame, out: DataFrame) -> DataFrame:
    lists = lambda d, key, name: d.select(F.col("id").alias(key), F.col("words").alias(name))
    return pairs.join(lists(ref, "ref_id", "rw"), "ref_id").join(lists(out, "out_id", "ow"), "out_id")


def recall_of(both: DataFrame) -> DataFrame:
    """(ref_id, out_id, recall) of word lists (ref_id, out_id, rw, ow): share of the reference's words, with their counts, that the output has; 1 for none."""
    side = lambda c, need, have: F.transform(c, lambda w: F.struct(w.alias("word"), F.lit(need).alias("need"), F.lit(have).alias("have")))
    counts = both.select("ref_id", "out_id", F.inline(F.concat(side("rw", 1, 0), side("ow", 0, 1)))).groupBy("ref_id", "out_id", "word").agg(F.sum("need").alias("need"), F.sum("have").alias("have"))
    share = F.when(F.sum("need") > 0, F.sum(F.least("need", "have")) / F.sum("need"))
    got = counts.groupBy("ref_id", "out_id").agg(share.alias("recall"))
    return both.select("ref_id", "out_id").join(got, ["ref_id", "out_id"], "left").withColumn("recall", F.coalesce("recall", F.lit(1.0)))


def coverage_of(both: DataFrame, run: int = 12) -> DataFrame:
    """(ref_id, out_id, coverage) of word lists (ref_id, out_id, rw, ow): share of the reference's words inside a run of `run` words that the output has. References shorter than a run get their recall."""
    long_ = both.filter(F.size("rw") >= run)
    side = lambda c, mine: F.transform(_runs(F.col(c), run), lambda g, i: F.struct(g.alias("run"), F.when(F.lit(mine), i).alias("at"), F.lit(not mine).alias("has")))
    runs = long_.select("ref_id", "out_id", F.size("rw").alias("n"), F.inline(F.concat(side("rw", True), side("ow", False))))
    met = runs.groupBy("ref_id", "out_id", "n", "run").agg(F.collect_list("at").alias("at"), F.bool_or("has").alias("has"))
    spots = F.array_distinct(F.flatten(F.transform("at", lambda a: F.sequence(a, a + (run - 1)))))
    covered = met.select("ref_id", "out_id", "n", F.explode_outer(F.when(F.col("has"), spots)).alias("spot")).groupBy("ref_id", "out_id", "n").agg(F.count_distinct("spot").alias("covered"))
    return covered.select("ref_id", "out_id", (F.col("covered") / F.col("n")).alias("coverage")).unionByName(recall_of(both.filter(F.size("rw") < run)).withColumnRenamed("recall", "coverage"))


def multiset_recall(pairs: DataFrame, ref: DataFrame, out: DataFrame) -> DataFrame:
    """recall_of() pairs (ref_id, out_id) of word lists (id, words)."""
    return recall_of(_with_lists(pairs, ref, out))


def run_coverage(pairs: DataFrame, ref: DataFrame, out: DataFrame, run: int = 12) -> DataFrame:
    """coverage_of() pairs (ref_id, out_id) of word lists (id, words)."""
    return coverage_of(_with_lists(pairs, ref, out), run)


@F.pandas_udf(types.DoubleType())
def ordered_recall(ref: pd.Series, out: pd.Series) -> pd.Series:
    """Longest common subsequence of two word lists over the length of the first; memory in proportion to one list."""

    def one(a: np.ndarray, b: np.ndarray) -> float:
        if not len(a):
            return 1.0
        ids = {w: i for i, w in enumerate(dict.fromkeys([*a, *b]))}
        y = np.array([ids[w] for w in b], np.int64)
        row = np.zeros(len(y) + 1, np.int64)
        for w in a:
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(y == ids[w], row[:-1] + 1, 0)))
        return float(row[-1]) / len(a)

    return pd.Series([one(a, b) for a, b in zip(ref, out, strict=True)])


def lowest(metrics: DataFrame, by: str, score: str, most: int = 4) -> DataFrame:
    """The `most` lowest rows of each document."""
    w = Window.partitionBy("doc_id").orderBy(score, by)
    return metrics.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= most)


def find_word(words: DataFrame, query: str) -> DataFrame:
    """Words (doc_id, page_no, word_no, text, x0, x1) that hold the query, and the part of the box that its first occurrence takes. A blank query finds nothing."""
    t, q, w = F.lower("text"), query.strip().lower(), F.col("x1") - F.col("x0")
    at, n = F.locate(q, t) - 1, F.char_length(t)
    return words.filter(t.contains(q) & F.lit(q != "")).withColumn("hit_x0", F.col("x0") + w * at / n).withColumn("hit_x1", F.col("x0") + w * (at + len(q)) / n)


def find_phrase(words: DataFrame, query: str, by: tuple[str, ...] = ("doc_id", "page_no")) -> DataFrame:
    """One hit for each word of each place where consecutive words of a page hold the query's words in turn; places may overlap. A blank query finds nothing."""
    parts = query.strip().lower().split()
    w = Window.partitionBy(*by).orderBy("word_no")
    match = F.lit(len(parts) > 0)
    for i, p in enumerate(parts):
        match = match & F.coalesce(F.lead(F.lower("text"), i).over(w).contains(p), F.lit(False))
    starts = words.withColumn("_m", match).filter("_m").select(*by, F.col("word_no").alias("start_no"))
    spots = starts.withColumn("word_no", F.explode(F.sequence("start_no", F.col("start_no") + max(len(parts) - 1, 0))))
    return spots.join(words, [*by, "word_no"])


def nearest_rank(values: Column, p: float) -> Column:
    """Percentile of a list by nearest rank, without interpolation; 0 for an empty one."""
    n = F.size(values)
    i = F.least(n - 1, F.greatest(F.lit(0), F.floor(F.lit(p) * (n - 1) + 0.5).cast("int")))
    return F.when(n > 0, F.sort_array(values)[i]).otherwise(0.0)


def weighted_mode(rows: DataFrame, by: tuple[str, ...], value: Column, weight: Column, seq: Column) -> DataFrame:
    """The value of each group with the largest sum of weights; of equal ones the first seen."""
    g = rows.select(*by, value.alias("v"), weight.alias("w"), seq.alias("s")).groupBy(*by, "v").agg(F.sum("w").alias("w"), F.min("s").alias("s"))
    return g.groupBy(*by).agg(F.max_by("v", F.struct("w", -F.col("s"))).alias("value"), F.max("w").alias("weight"))


# What counts as white space.
BLANK = r"[\s\u000b\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def _fitting(word: Column, columns: Column) -> Column:
    """A word in parts of at most `columns` code points, cut between user-perceived characters; one that is longer stands alone."""
    pack = lambda parts, c: F.when(
        (F.size(parts) > 0) & (F.char_length(F.element_at(parts, -1)) + F.char_length(c) <= columns), F.concat(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(F.concat(F.element_at(parts, -1), c)))
    ).otherwise(F.array_append(parts, c))
    return F.aggregate(F.regexp_extract_all(word, F.lit(r"(\X)"), F.lit(1)), F.array().cast("array<string>"), pack)


def wrap_mono(text: Column, columns: Column) -> Column:
    """Lines of a paragraph in a font of equal widths, as an array.

    Words too long for a line are cut into parts first, each of which begins a line. The rest is one fold over words and spaces, whose state is the lines so far and the one being
    set: what fits is added, spaces that don't fit end a line and go, a word that doesn't fit begins one. Spaces at a line's end go. Empty text is one empty line; null stays null.
    """
    item = lambda t, fresh: F.struct(t.alias("t"), F.lit(fresh).alias("fresh"))
    tokens = F.regexp_extract_all(text, F.lit(f"({BLANK}+|(?:(?!{BLANK}).)+)"), F.lit(1))
    blank = lambda t: t.rlike(f"^{BLANK}")
    items = F.flatten(F.transform(tokens, lambda t: F.when(blank(t) | (F.char_length(t) <= columns), F.array(item(t, False))).otherwise(F.transform(_fitting(t, columns), lambda c: item(c, True)))))
    trimmed = lambda t: F.regexp_replace(t, f"{BLANK}+$", "")
    state = lambda done, now: F.struct(done.alias("done"), now.alias("now"))

    def place(s: Column, i: Column) -> Column:
        fits = ~i["fresh"] & (F.char_length(s["now"]) + F.char_length(i["t"]) <= columns)
        full = F.array_append(s["done"], trimmed(s["now"]))
        begun = F.when(trimmed(s["now"]) != "", full).otherwise(s["done"])
        return F.when(fits, state(s["done"], F.concat(s["now"], i["t"]))).when(blank(i["t"]), state(full, F.lit(""))).otherwise(state(begun, i["t"]))

    start = state(F.array().cast("array<string>"), F.lit(""))
    return F.aggregate(items, start, place, lambda s: F.array_append(s["done"], trimmed(s["now"])))


def without_blank_end(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, line_no, k, line) up to each document's last one that isn't blank."""
    last = F.max(F.when(F.col("line") != "", F.struct("line_no", "k"))).over(Window.partitionBy("doc_id"))
    return lines.withColumn("_last", last).filter(F.struct("line_no", "k") <= F.col("_last")).drop("_last")


def rank_of(rows: DataFrame, by: str, value: str, p: float) -> DataFrame:
    """(by, value): the percentile of each group by nearest rank, from counts of distinct values, so that no group's rows come together."""
    counts = rows.groupBy(by, value).agg(F.count(F.lit(1)).alias("_rows"))
    w = Window.partitionBy(by)
    counts = counts.withColumn("_upto", F.sum("_rows").over(w.orderBy(value))).withColumn("_all", F.sum("_rows").over(w))
    return counts.filter(F.col("_upto") > F.floor(F.lit(p) * (F.col("_all") - 1) + 0.5)).groupBy(by).agg(F.min(value).alias(value))
