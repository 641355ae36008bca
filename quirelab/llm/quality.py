"""Quality rules: text measures, and a calibrated logistic regression over hashed word and character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import small_batches
from ._text import Words, as_bytes, slices, thrifty

BUCKET_BITS = 14
CHARACTERS = (2, 4)
SAMPLE = 3000
#: Bytes of text of the sample, which bound what comes to the driver.
SAMPLE_BYTES = 12 << 20
MIN_WORDS = 50
REPEAT_PERCENT = 50
KEEP_FROM = 0.5
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def _groups(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Document and bucket of every feature, one group after another: words, word pairs, character n-grams of each length.

    Character n-grams, of code points, run over the words joined by one space, so they see where words begin and end.
    """
    shift = np.uint64(64 - BUCKET_BITS)
    for k in (1, 2):
        at, h = words.windows(k)
        yield words.doc[at], (h >> shift).astype(np.int64)
    sums, inverse = words._prefix(0)
    begins = np.flatnonzero((words.buf[: len(sums) - 1] & 0xC0) != 0x80) if len(words.doc) else np.zeros(0, np.int64)
    owner = np.repeat(words.doc, words.end - words.start + 1)[begins]
    begins = np.append(begins, len(sums) - 1)
    for n in CHARACTERS:
        i = np.flatnonzero(owner[: max(len(owner) - n + 1, 0)] == owner[n - 1 :]) if len(owner) >= n else np.zeros(0, np.int64)
        h = (sums[begins[i + n]] - sums[begins[i]]) * inverse[begins[i]]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        yield owner[i], (h >> shift).astype(np.int64)


N_GROUPS = 2 + len(CHARACTERS)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's share of its features by (group, bucket), as indices and values."""
    for batch in thrifty(batches):
        quality = batch.column("quality").to_pylist()
        for lo, hi in slices(batch.column("text")):
            words = Words(as_bytes(batch.column("text").slice(lo, hi - lo)))
            at, value, doc = [], [], []
            for g, (d, b) in enumerate(_groups(words)):
                pair, n = np.unique(d << BUCKET_BITS | b, return_counts=True)
                d = pair >> BUCKET_BITS
                at.append((pair & ((1 << BUCKET_BITS) - 1)) | g << BUCKET_BITS)
                value.append((n / np.bincount(d, weights=n, minlength=hi - lo)[d]).astype(np.float32))
                doc.append(d)
            at, value, doc = map(np.concatenate, (at, value, doc))
            order = np.argsort(doc, kind="stable")
            cut = np.searchsorted(doc[order], np.arange(1, hi - lo))
            yield pa.RecordBatch.from_arrays(
                [pa.array(quality[lo:hi], pa.int32()), pa.array(np.split(at[order].astype(np.int32), cut), pa.list_(pa.int32())), pa.array(np.split(value[order], cut), pa.list_(pa.float32()))],
                schema=pa.schema([("quality", pa.int32()), ("at", pa.list_(pa.int32())), ("value", pa.list_(pa.float32()))]),
            )


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (score + self.bias) + self.shift, -40, 40)))


EMPTY = Model(np.zeros((N_GROUPS, 1 << BUCKET_BITS), np.float32), 0.0, 0.0, 40.0)


def _fit(y: np.ndarray, doc: np.ndarray, at: np.ndarray, value: np.ndarray, rounds: int = 150, l2: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam over the whole sample, both classes weighing the same."""
    w, b, size = np.zeros(N_GROUPS << BUCKET_BITS), 0.0, len(y)
    balance = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(doc, weights=value * w[at], minlength=size) + b
        g = balance * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / size
        gw, gb = np.bincount(at, weights=value * g[doc], minlength=len(w)) + l2 * w, g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a, c = 1 - 0.9**t, 1 - 0.999**t
        w -= 0.5 * (m / a) / (np.sqrt(v / c) + 1e-8)
        b -= 0.1 * (mb / a) / (np.sqrt(vb / c) + 1e-8)
    return w, b


def _calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt scaling: slope and shift by Newton's method, with the usual smoothed targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        s = p * (1 - p) + 1e-9
        ga, gb = ((p - t) * z).sum() + 1e-3 * (a - 1), (p - t).sum() + 1e-3 * b
        haa, hab, hbb = (s * z * z).sum() + 1e-3, (s * z).sum(), s.sum() + 1e-3
        det = haa * hbb - hab * hab
        a, b = a - (hbb * ga - hab * gb) / det, b - (haa * gb - hab * ga) / det
    return float(max(a, 1e-3)), float(b)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fits on at most `sample` labelled rows and `sample_bytes` of text, those whose ids hash smallest, one row an id; a quarter of them calibrates.

    Labels other than 0 and 1, null ids and null texts are left out, and so is each text of more than 1/16 of `sample_bytes`, alone: the others fit as if it were not there. Labelled
    rows of which every one is too long raise ValueError. Without both classes (no labels at all, or one kind): a model that keeps everything.
    """
    some = labels.filter(F.col("quality").isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min("quality").cast("int").alias("quality"))
    some = some.orderBy(F.xxhash64(id_col), id_col).limit(sample)
    rows = docs.select(id_col, F.col(text_col).alias("text")).filter("text is not null").join(F.broadcast(some), id_col)
    rows = rows.groupBy(id_col).agg(F.min("text").alias("text"), F.first("quality").alias("quality"))
    before = Window.orderBy(F.xxhash64(id_col), id_col)  # over `sample` rows at most, without their texts
    sized = rows.select(id_col, F.octet_length("text").alias("n"))
    few = sized.filter(F.col("n") <= sample_bytes // 16).withColumn("n", F.sum("n").over(before)).filter(F.col("n") <= sample_bytes).select(id_col)
    if few.isEmpty() and not sized.isEmpty():
        raise ValueError("every labelled text is longer than 1/16 of sample_bytes")
    rows = rows.join(F.broadcast(few), id_col)
    got = rows.select("text", "quality").mapInArrow(_features, "quality int, at array<int>, value array<float>").toArrow()
    y = got.column("quality").to_numpy().astype(float)
    if len(set(y.tolist())) < 2 or len(y) < 8:
        return EMPTY
    size = np.diff(got.column("at").combine_chunks().offsets.to_numpy())
    at, value = (got.column(c).combine_chunks().flatten().to_numpy() for c in ("at", "value"))
    order = np.lexsort((np.bincount(np.repeat(np.arange(len(y)), size), weights=value * (at % 977), minlength=len(y)), y))
    held = np.zeros(len(y), bool)
    held[order[::4]] = True  # a quarter of each class, whatever the order of rows
    doc = np.repeat(np.arange(len(y)), size)
    fit = ~held[doc]
    place = np.cumsum(~held) - 1
    w, b = _fit(y[~held], place[doc[fit]], at[fit], value[fit])
    z = np.bincount(doc, weights=value * w[at], minlength=len(y)) + b
    slope, shift = _calibrate(z[held], y[held])
    return Model(w.reshape(N_GROUPS, -1).astype(np.float32), float(b), slope, shift)


SCORED = pa.schema([("id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("quality", pa.float64())])


def _duplicate_lines(text: bytes | None) -> int:
    lines = [x for x in text.split(b"\n") if x.split()] if text else []
    return len(lines) - len(set(lines))


def _repeated_words(words: Words) -> np.ndarray:
    """Words of each text that stand in a 3-word window which the text has twice or more."""
    at, h = words.windows(3)
    doc = words.doc[at]
    order = np.lexsort((h, doc))
    same = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(words.doc), bool)
    for j in range(3):
        cover[at[twice] + j] = True
    return np.bincount(words.doc[cover], minlength=len(words.count))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in thrifty(batches):
            for lo, hi in slices(batch.column("text")):
                n, part = hi - lo, as_bytes(batch.column("text").slice(lo, hi - lo))
                words = Words(part)
                z = np.zeros(n)
                for g, (d, b) in enumerate(_groups(words)):
                    z += np.bincount(d, weights=model.weights[g][b], minlength=n) / np.maximum(np.bincount(d, minlength=n), 1)
                letters = np.concatenate(([0], np.cumsum((words.buf & 0xC0) != 0x80)))
                chars = np.bincount(words.doc, weights=letters[words.end] - letters[words.start], minlength=n).astype(np.int64)
                symbols = [int(SYMBOLS[np.frombuffer(t, np.uint8)].sum()) if t else 0 for t in part]
                columns = [words.count, chars, symbols, [_duplicate_lines(t) for t in part], _repeated_words(words), model.probability(z)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, n), *map(pa.array, columns)], schema=SCORED)

    return run


def quality(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures, base rules and verdict for every row.

    n_words, word_chars (code points in words), n_symbols (of #*$%&|<>), n_dup_lines (lines with a word, equal to an earlier line),
    n_repeat_words (words in 3-word windows that the text has twice or more); base_failed if n_words < MIN_WORDS or more than
    REPEAT_PERCENT of the words repeat; quality: the calibrated probability of a good text; kept: base rules passed and
    quality >= KEEP_FROM.

    Null or empty text: zeros, base_failed. Repeated ids and null ids stay as rows. Empty table: empty result. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = ", ".join(f"{f.name} {'double' if f.name == 'quality' else 'long'}" for f in SCORED)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    out = rows.mapInArrow(_score(model), schema).withColumnRenamed("id", id_col)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("quality") >= KEEP_FROM))
