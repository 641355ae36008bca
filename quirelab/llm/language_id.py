"""Language identification: known words by log frequency, unseen ones by ever shorter character n-grams."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ._store import Workspace, small_batches
from ._text import slices, thrifty

LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
GRAM = 4
WORDS = 60_000
GRAMS = 60_000
SMOOTH = 0.5
FLUSH = 200_000
#: Log frequencies that are summed in Spark are whole numbers of 1 / UNIT, so that no order of rows changes a sum.
UNIT = 1 << 32
CACHE = 200_000
#: Words whose places are looked at together, which bounds the memory of a task.
SLICE = 500


def _words(text: str | None) -> list[str]:
    """Runs of letters, with their combining marks, in lower case."""
    return LETTERS.findall(text.lower()) if text else []


def grams(word: str, n: int) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


COUNTS = pa.schema([("word", pa.string()), ("lang", pa.string()), ("n", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of words by language, given out whenever many words have come together."""
    words: dict[str, Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, count in words.items():
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array([lang] * len(count), pa.string()), pa.array(list(count.values()), pa.int64())], schema=COUNTS)
        words.clear()

    for batch in thrifty(batches):
        for lo, hi in slices(batch.column("text")):
            for text, lang in zip(*(batch.column(c).slice(lo, hi - lo).to_pylist() for c in ("text", "lang")), strict=True):
                words.setdefault(lang, Counter()).update(_words(text))
            if sum(map(len, words.values())) > FLUSH:
                yield from flush()
    yield from flush()


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of n-grams by language, from distinct words with their counts."""
    part: dict[str, Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, count in part.items():
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array([lang] * len(count), pa.string()), pa.array(list(count.values()), pa.int64())], schema=COUNTS)
        part.clear()

    for batch in thrifty(batches):
        for word, by_lang in zip(batch.column("word").to_pylist(), batch.column("by_lang").to_pylist(), strict=True):
            found = Counter(g for k in range(1, GRAM + 1) for g in grams(word, k))
            for lang, n in by_lang:
                count = part.setdefault(lang, Counter())
                for g, times in found.items():
                    count[g] += n * times
        if sum(map(len, part.values())) > FLUSH:
            yield from flush()
    yield from flush()


@dataclass
class Model:
    """Log frequency of words and n-grams in each language: the WORDS + GRAMS most frequent in memory, all others in tables (None: there are none)."""

    langs: list[str]
    prior: np.ndarray
    words: dict[str, int]
    grams: dict[str, int]
    logs: np.ndarray
    more_words: DataFrame | None = None
    more_grams: DataFrame | None = None
    tables: Workspace | None = None

    def close(self) -> None:
        """Drops the tables, once results of identify() have been made."""
        if self.tables is not None:
            self.tables.close()

    def unseen(self, words: list[str]) -> np.ndarray:
        """Row of each word: the mean over its positions of the longest known n-gram that starts there; nothing known: no evidence."""
        flat, size, get = [], [], self.grams.get
        for word in words:
            w, before = f"^{word}$", len(flat)
            for i in range(len(w)):
                for n in range(GRAM, 0, -1):
                    if (row := get(w[i : i + n])) is not None:
                        flat.append(row)
                        break
            size.append(len(flat) - before)
        out = np.zeros((len(words), len(self.langs)), np.float32)
        count = np.array(size)
        some = np.flatnonzero(count)
        if len(some):
            first = np.concatenate(([0], np.cumsum(count[some])[:-1]))
            out[some] = np.add.reduceat(self.logs[flat], first, axis=0) / count[some, None]
        return out


def _log_frequency(count: np.ndarray, tokens: np.ndarray, kinds: int) -> np.ndarray:
    return np.log((count + SMOOTH) / (tokens + SMOOTH * kinds))


def _tabled(counts: DataFrame, ws: Workspace, name: str) -> tuple[DataFrame, dict[str, tuple[int, int]]]:
    """Counts by word as a written table (word, total, by_lang), and each language's tokens and kinds."""
    table = ws.save(counts.groupBy("word", "lang").agg(F.sum("n").alias("n")).groupBy("word").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by_lang")), name)
    sums = table.select(F.explode("by_lang").alias("lang", "n")).groupBy("lang").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).collect()
    return table, {r["lang"]: (r["n"], r["kinds"]) for r in sums}


def _frequent(table: DataFrame, most: int) -> tuple[list, DataFrame | None]:
    """`most` rows at most, all whose count is of some magnitude (an eighth of a power of two) or more, and the table of the others."""
    table = table.withColumn("size", F.floor(F.log2("total") * 8))
    steps = table.groupBy("size").agg(F.count(F.lit(1)).alias("rows")).withColumn("rows", F.sum("rows").over(Window.orderBy(F.desc("size"))))  # some hundred rows at most
    got = steps.agg(F.max("rows").alias("all"), F.min(F.when(F.col("rows") <= most, F.col("size"))).alias("least")).first()
    more = None
    if (got["all"] or 0) > most:
        if got["least"] is not None:
            table, more = table.filter(F.col("size") >= got["least"]), table.filter(F.col("size") < got["least"])
        else:
            last = table.select("word").orderBy("word").limit(most).agg(F.max("word")).first()[0]
            table, more = table.filter(F.col("word") <= last), table.filter(F.col("word") > last)
    return sorted(table.select("word", "by_lang").collect(), key=lambda r: r["word"]), more


def train(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts words over all rows that have a text and a language, and n-grams over all those words, weighed by their counts.

    The WORDS most frequent words and GRAMS most frequent n-grams are kept in memory, the others as tables in the shared folder.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text is not null and lang is not null")
    ws = Workspace(docs.sparkSession, "language")
    by_word, words = _tabled(rows.mapInArrow(_count, "word string, lang string, n long"), ws, "words")
    langs = sorted(words)
    if not langs:
        return Model([], np.zeros(0), {}, {}, np.zeros((0, 0), np.float32))
    by_gram, parts = _tabled(by_word.select("word", "by_lang").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(_split, "word string, lang string, n long"), ws, "grams")
    index = {x: i for i, x in enumerate(langs)}

    def table(by: DataFrame, most: int, tokens: np.ndarray, kinds: int) -> tuple[list[str], np.ndarray, DataFrame | None]:
        top, more = _frequent(by, most)
        n = np.zeros((len(top), len(langs)))
        for i, r in enumerate(top):
            for lang, c in r["by_lang"].items():
                n[i, index[lang]] += c
        if more is not None:
            each = [F.log((F.coalesce(F.try_element_at("by_lang", F.lit(x)), F.lit(0)) + SMOOTH) / (float(t) + SMOOTH * kinds)) for x, t in zip(langs, tokens, strict=True)]
            more = more.select("word", F.array(*[F.round(x * UNIT).cast("long") for x in each]).alias("logs"))
        return [r["word"] for r in top], _log_frequency(n, tokens, kinds), more

    tokens = np.array([words[x][0] for x in langs], float)
    known, word_logs, more_words = table(by_word, WORDS, tokens, max(k for _, k in words.values()))
    pieces, gram_logs, more_grams = table(by_gram, GRAMS, np.array([parts[x][0] for x in langs], float), by_gram.count())
    prior = np.log(tokens + 1)
    logs = np.concatenate((word_logs, gram_logs)).astype(np.float32)
    return Model(langs, prior - prior.max(), {w: i for i, w in enumerate(known)}, {g: len(known) + i for i, g in enumerate(pieces)}, logs, more_words, more_grams, ws)


def _predict(m: Model, text_col: str, keep: list[str]):
    m = replace(m, more_words=None, more_grams=None, tables=None)  # tasks get no table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_known = len(m.logs)
        rows = np.concatenate((m.logs, np.zeros((CACHE, len(m.langs)), np.float32))) if m.langs else None
        seen = dict(m.words)
        used = n_known
        for batch in thrifty(batches):
            for lo, hi in slices(batch.column(text_col)):
                found = [_words(t) for t in batch.column(text_col).slice(lo, hi - lo).to_pylist()]
                size = np.fromiter(map(len, found), np.int64, len(found))
                lang, score = ["und"] * len(found), np.zeros(len(found))
                if m.langs and size.sum():
                    fresh = list(dict.fromkeys(w for doc in found for w in doc if w not in seen))
                    if used + len(fresh) > len(rows):
                        seen, used = dict(m.words), n_known
                        fresh = list(dict.fromkeys(w for doc in found for w in doc if w not in seen))
                        if used + len(fresh) > len(rows):
                            rows = np.concatenate((rows, np.zeros((len(fresh), len(m.langs)), np.float32)))
                    rows[used : used + len(fresh)] = m.unseen(fresh)
                    seen.update(zip(fresh, range(used, used + len(fresh)), strict=True))
                    used += len(fresh)
                    get = seen.__getitem__
                    at = np.fromiter((get(w) for doc in found for w in doc), np.int64, int(size.sum()))
                    some = np.flatnonzero(size)
                    first = np.concatenate(([0], np.cumsum(size[some])[:-1]))
                    total = np.add.reduceat(rows[at].astype(np.float64), first, axis=0) + m.prior
                    total -= total.max(axis=1, keepdims=True)
                    share = np.exp(total)
                    share /= share.sum(axis=1, keepdims=True)
                    best = share.argmax(axis=1)
                    score[some] = share[np.arange(len(some)), best]
                    for i, b in zip(some, best, strict=True):
                        lang[i] = m.langs[b]
                stay = [batch.column(c).slice(lo, hi - lo) for c in keep]
                yield pa.RecordBatch.from_arrays([*stay, pa.array(lang, pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])

    return run


def _begin(m: Model, text_col: str, keep: list[str]):
    """The sum over the words in memory (null: the text has no word), and the text's other words with their counts."""
    values, known, prior = m.logs, m.words, m.prior  # tasks get no table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate((values, np.zeros((1, values.shape[1]), np.float32))).astype(np.float64)
        get, other = known.get, len(values)
        for batch in thrifty(batches):
            for lo, hi in slices(batch.column(text_col)):
                sums, rest = [], []
                for t in batch.column(text_col).slice(lo, hi - lo).to_pylist():
                    words = _words(t)
                    at = np.fromiter((get(w, other) for w in words), np.int64, len(words))
                    sums.append((rows[at].sum(axis=0) + prior).tolist() if words else None)
                    rest.append(list(Counter(words[i] for i in np.flatnonzero(at == other)).items()))
                stay = [batch.column(c).slice(lo, hi - lo) for c in keep]
                more = pa.array([[{"word": w, "n": n} for w, n in r] for r in rest], pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())])))
                yield pa.RecordBatch.from_arrays([*stay, pa.array(sums, pa.list_(pa.float64())), more], names=[*keep, "_sums", "_more"])

    return run


_PLACES = pa.list_(pa.struct([("at", pa.int32()), ("size", pa.int32()), ("gram", pa.string()), ("n", pa.int64()), ("logs", pa.list_(pa.int64()))]))


def _places(m: Model):
    """For each unseen word, what its n-grams in memory settle (one entry, at -1), and for the places where a longer one may be in the table
    the n-grams to be looked up there (logs null), next to the longest that is in memory."""
    values, known, whole = m.logs, m.grams, m.more_grams is None  # tasks get no table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, get = np.round(values.astype(np.float64) * UNIT).astype(np.int64), known.get
        for batch in (b.slice(at, SLICE) for b in thrifty(batches) for at in range(0, b.num_rows, SLICE)):
            out = []
            for word in batch.column("word").to_pylist():
                w, settled, places = f"^{word}$", [], []
                for i in range(len(w)):
                    longer = []
                    row = None
                    for g in dict.fromkeys(w[i : i + n] for n in range(GRAM, 0, -1)):
                        if (row := get(g)) is not None:
                            break
                        longer.append(g)
                    if whole or not longer:
                        settled += [] if row is None else [row]
                        continue
                    places += [{"at": i, "size": len(g), "gram": g, "n": 1, "logs": None} for g in longer]
                    if row is not None:
                        places.append({"at": i, "size": 0, "gram": None, "n": 1, "logs": logs[row].tolist()})
                if settled:
                    places.append({"at": -1, "size": 0, "gram": None, "n": len(settled), "logs": logs[settled].sum(axis=0).tolist()})
                out.append(places)
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(out, _PLACES)], names=["word", "places"])

    return run


def _each(column: str, size: int) -> list[Column]:
    return [F.col(column)[i] for i in range(size)]


def _scored_by_tables(rows: DataFrame, m: Model, text_col: str, keep: list[str], schema: StructType) -> DataFrame:
    """As _predict, with the words and n-grams that are not in memory joined from their tables."""
    size = len(m.langs)
    ws = Workspace(rows.sparkSession, "language")
    begun = StructType([*schema.fields[: len(keep)], *StructType.fromDDL("_sums array<double>, _more array<struct<word: string, n: bigint>>").fields])
    first = ws.save(rows.mapInArrow(_begin(m, text_col, keep), begun).withColumn("_row", F.monotonically_increasing_id()), "begun")
    asked = first.select("_row", F.explode("_more").alias("m")).select("_row", "m.word", "m.n")
    unseen = asked.select("word").distinct()
    if m.more_words is not None:
        unseen = unseen.join(m.more_words.select("word"), "word", "left_anti")
    places = unseen.mapInArrow(_places(m), "word string, places array<struct<at: int, size: int, gram: string, n: bigint, logs: array<bigint>>>")
    places = places.select("word", F.explode("places").alias("p")).select("word", "p.*")
    if m.more_grams is not None:
        places = ws.save(places, "places")
        found = places.filter("gram is not null").drop("logs").join(m.more_grams.withColumnRenamed("word", "gram"), "gram")
        places = places.filter("gram is null").unionByName(found.select(*places.columns))
        places = places.groupBy("word", "at").agg(F.max_by(F.struct("n", "logs"), "size").alias("p")).select("word", "p.*")
    mean = [F.round(F.sum(x) / F.sum("n")).cast("long") for x in _each("logs", size)]
    logs = places.groupBy("word").agg(F.array(*mean).alias("logs"))
    if m.more_words is not None:
        logs = logs.unionByName(m.more_words)
    sums = asked.join(logs, "word").groupBy("_row").agg(F.array(*[F.sum(F.col("n") * x) for x in _each("logs", size)]).alias("_rest"))
    total = [s + F.coalesce(r / float(UNIT), F.lit(0.0)) for s, r in zip(_each("_sums", size), _each("_rest", size), strict=True)]
    ranked = F.array(*[F.struct(t.alias("total"), F.lit(-i).alias("place"), F.lit(x).alias("lang")) for i, (t, x) in enumerate(zip(total, m.langs, strict=True))])
    out = first.join(sums, "_row", "left").withColumn("_best", F.when(F.col("_sums").isNotNull(), F.array_max(ranked)))
    share = 1.0 / sum((F.exp(t - F.col("_best.total")) for t in total), F.lit(0.0))
    done = ws.save(out.select(*keep, F.coalesce("_best.lang", F.lit("und")).alias("lang_pred"), F.coalesce(share, F.lit(0.0)).alias("score")), "result")
    ws.keep(done)
    return done


def held_out(doc_id: Column) -> Column:
    """True for documents that no model may learn from: crc32 of the id's text leaves 2 modulo 4. A null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, model: Model, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Every row with lang_pred and score, told from its whole text alone. `keep` names the input columns to return, all by default.

    A word is a run of letters and their combining marks, lower-cased. A known word adds its log frequency in each language; an unseen
    one the mean over its positions of the longest known n-gram there, from GRAM characters down to one. The score is the
    winner's share of the likelihood, 0 to 1; ties go to the language that sorts first. With a model that has tables, the result is written in the shared
    folder, and other tables of the call are dropped.

    Null text, or text without a letter: `und`, score 0; so is all text if the model has no language. Repeated ids and null
    ids stay as rows. Empty table: empty result. Input columns called lang_pred or score are replaced.
    """
    small_batches(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    kept = docs.select(*keep)
    schema = StructType([*kept.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    rows = docs.select(*dict.fromkeys([*keep, text_col]))
    if model.more_words is not None or model.more_grams is not None:
        return _scored_by_tables(rows, model, text_col, keep, schema)
    return rows.mapInArrow(_predict(model, text_col, keep), schema)
