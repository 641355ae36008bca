"""Removal of passages that an earlier document has, with a count-min prefilter."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import with_copies, without_copies
from ._text import Words, as_bytes, slices

BLOCK_BYTES = 6 << 20
#: Rows of the sketch, and counters of each for every window of the input, at least.
DEPTH, CELLS = 2, 8
#: Counters, or windows, that meet in one task.
SHARD = 3_000_000
#: (block, shard) pairs up to which blocks send straight to shards.
STRAIGHT = 1 << 21
SPREAD = np.uint64(0xD1B54A32D192ED03)


@dataclass(frozen=True)
class Layout:
    """How counters and windows are dealt: blocks of documents, shards of keys, and groups of `group` blocks between them where blocks and shards are many."""

    blocks: int
    bits: int
    shard_bits: int
    group: int
    coarse_bits: int

    @staticmethod
    def of(total_bytes: int) -> Layout:
        windows = max(total_bytes // 6, 1)
        blocks = max(1, math.ceil(total_bytes / BLOCK_BYTES))
        shard_bits = max(0, math.ceil(math.log2(DEPTH * windows / SHARD)))
        if blocks << shard_bits <= STRAIGHT:
            return Layout(blocks, math.ceil(math.log2(windows * CELLS)), shard_bits, 1, shard_bits)
        coarse = (shard_bits + 1) // 2
        return Layout(blocks, math.ceil(math.log2(windows * CELLS)), shard_bits, max(2, int(SHARD * 2**coarse / (DEPTH * windows / blocks))), coarse)


@dataclass
class Entries:
    """Distinct keys in order, each with whether it occurs more than once. Of windows also the rest of the hash, and the smallest document."""

    key: np.ndarray
    many: np.ndarray
    rest: np.ndarray | None = None
    lo: np.ndarray | None = None


PART = pa.schema([("node", pa.int64()), ("shard", pa.int64()), ("n", pa.int64()), ("low_bits", pa.int32()), ("high", pa.binary()), ("low", pa.binary()), ("many", pa.binary()), ("rest", pa.binary()), ("base", pa.int64()), ("lo", pa.binary())])
REPLY = pa.schema([("node", pa.int64()), ("shard", pa.int64()), ("n", pa.int64()), ("many", pa.binary()), ("base", pa.int64()), ("lo", pa.binary())])
PART_SQL = "node long, shard long, n long, low_bits int, high binary, low binary, many binary, rest binary, base long, lo binary"
REPLY_SQL = "node long, shard long, n long, many binary, base long, lo binary"


def _narrow(x: np.ndarray | None) -> tuple[int, bytes]:
    """Numbers as the fewest bytes that hold what they are above the smallest."""
    if x is None or not len(x):
        return 0, b""
    base, most = int(x.min()), int(x.max()) - int(x.min())
    return base, (x - base).astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64).tobytes()


def _wide(base: int, data: bytes, n: int) -> np.ndarray:
    kind = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[len(data) // n] if n else np.uint8
    return np.frombuffer(data, kind).astype(np.int64) + base


def _bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def _flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def pack_sorted(x: np.ndarray) -> tuple[int, bytes, bytes]:
    """Rice code of ascending numbers: of each gap the high part in unary, the low bits as they are, byte by byte and then bit by bit."""
    gap = np.diff(x, prepend=np.uint64(0))
    k = max(int(int(x[-1]) / len(x)).bit_length() - 1, 0)
    end = np.cumsum((gap >> np.uint64(k)).astype(np.int64) + 1)
    high = np.zeros(end[-1], np.uint8)
    high[end - 1] = 1
    whole = np.ascontiguousarray(gap).view(np.uint8).reshape(-1, 8)[:, : k // 8].tobytes()
    return k, _bits(high), whole + b"".join(_bits((gap >> np.uint64(j)).astype(np.uint8) & 1) for j in range(k // 8 * 8, k))


def unpack_sorted(k: int, high: bytes, low: bytes, n: int) -> np.ndarray:
    end = np.flatnonzero(np.unpackbits(np.frombuffer(high, np.uint8)))[:n] + 1
    gap = (np.diff(end, prepend=0) - 1).astype(np.uint64) << np.uint64(k)
    whole = np.zeros((n, 8), np.uint8)
    whole[:, : k // 8] = np.frombuffer(low, np.uint8, n * (k // 8)).reshape(n, k // 8)
    gap |= whole.view(np.uint64).ravel()
    at, size = n * (k // 8), -(-n // 8)
    for j in range(k // 8 * 8, k):
        gap |= np.unpackbits(np.frombuffer(low, np.uint8, size, at), count=n).astype(np.uint64) << np.uint64(j)
        at += size
    return np.cumsum(gap, dtype=np.uint64)


def _send(e: Entries, node: int, shift: int) -> pa.Table:
    """One row for each shard that entries fall into."""
    shard = (e.key >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(e.key), np.int64)
    edge = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
    rows = []
    for a, b in zip(edge, edge[1:], strict=False):
        if b > a:
            k, high, low = pack_sorted(e.key[a:b] - (np.uint64(int(shard[a]) << shift) if shift < 64 else np.uint64(0)))
            base, lo = _narrow(None if e.lo is None else e.lo[a:b])
            rows.append((node, int(shard[a]), b - a, k, high, low, _bits(e.many[a:b]), b"" if e.rest is None else e.rest[a:b].tobytes(), base, lo))
    return pa.Table.from_pylist([dict(zip(PART.names, r, strict=True)) for r in rows], PART)


def _grouped(key: np.ndarray, rest: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the keys, where each distinct one begins in it, and the place of each key among the distinct ones."""
    order = np.argsort(key)
    k = key[order]
    new = np.concatenate((np.ones(min(len(k), 1), bool), k[1:] != k[:-1]))
    if rest is not None and ((rest[order][1:] != rest[order][:-1]) & ~new[1:]).any():  # the first hash alone is not enough
        order = np.lexsort((rest, key))
        k, r = key[order], rest[order]
        new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    place = np.empty(len(key), np.int64)
    place[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), place


def _merge(parts: pa.Table, shift: int) -> tuple[Entries, list[np.ndarray]]:
    """The sum of several nodes' entries, and where each part's are in it. An entry of two nodes, or of one that has it more than once, occurs more than once."""
    rows = parts.to_pylist()
    n = [r["n"] for r in rows]
    prefix = [np.uint64(r["shard"] << shift if shift < 64 else 0) for r in rows]
    key = np.concatenate([p + unpack_sorted(r["low_bits"], r["high"], r["low"], r["n"]) for p, r in zip(prefix, rows, strict=True)])
    many = np.concatenate([_flags(r["many"], r["n"]) for r in rows])
    rest = np.concatenate([np.frombuffer(r["rest"], np.uint32) for r in rows])
    windows = len(rest) > 0
    order, first, place = _grouped(key, rest if windows else None)
    out = Entries(key[order[first]], np.logical_or.reduceat(many[order], first) | (np.diff(np.append(first, len(key))) > 1))
    if windows:
        out.rest = rest[order[first]]
        out.lo = np.minimum.reduceat(np.concatenate([_wide(r["base"], r["lo"], r["n"]) for r in rows])[order], first)
    return out, np.split(place, np.cumsum(n)[:-1])


def _answer(parts: pa.Table, e: Entries, place: list[np.ndarray]) -> pa.Table:
    """To each part, which of its entries occur more than once, and of these the smallest document."""
    rows = []
    for node, shard, at in zip(parts.column("node").to_pylist(), parts.column("shard").to_pylist(), place, strict=True):
        many = e.many[at]
        base, lo = _narrow(None if e.lo is None else e.lo[at[many]])
        rows.append({"node": node, "shard": shard, "n": len(at), "many": _bits(many), "base": base, "lo": lo})
    return pa.Table.from_pylist(rows, REPLY)


def _read(replies: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Flags of all entries of one node in order, and the smallest document of those that are set."""
    rows = sorted(replies.to_pylist(), key=lambda r: r["shard"])
    many = [_flags(r["many"], r["n"]) for r in rows]
    lo = [_wide(r["base"], r["lo"], int(m.sum())) for r, m in zip(rows, many, strict=True) if r["lo"]]
    return np.concatenate(many or [np.zeros(0, bool)]), np.concatenate(lo or [np.zeros(0, np.int64)])


def _up(shift: int, finer: int):
    """A group of blocks adds up its parts of a coarse shard, and sends on the sum by finer shards."""
    return lambda t: _send(_merge(t, shift)[0], t.column("up")[0].as_py(), finer)


def _top(shift: int):
    """All parts of one shard are added up; each sender gets its answer."""

    def one(t: pa.Table) -> pa.Table:
        return _answer(t, *_merge(t, shift))

    return one


def _down(shift: int):
    """A group of blocks passes the answers to its sum on to its blocks."""

    def one(parts: pa.Table, replies: pa.Table) -> pa.Table:
        e, place = _merge(parts, shift)
        e.many, lo = _read(replies)
        if e.lo is not None:
            e.lo[e.many] = lo
        return _answer(parts, e, place)

    return one


def _exchange(parts: DataFrame, layout: Layout, key_bits: int) -> DataFrame:
    """Answers (node, shard, n, many, base, lo) to the parts that blocks sent."""
    fine = key_bits - layout.shard_bits
    if layout.group == 1:
        return parts.groupBy("shard").applyInArrow(_top(fine), REPLY_SQL)
    coarse, inner = key_bits - layout.coarse_bits, layout.shard_bits - layout.coarse_bits
    parts = parts.withColumn("up", F.floor(F.col("node") / layout.group))
    top = parts.groupBy("up", "shard").applyInArrow(_up(coarse, fine), PART_SQL).groupBy("shard").applyInArrow(_top(fine), REPLY_SQL)
    back = top.withColumn("coarse", F.shiftright("shard", inner))
    return parts.groupBy("up", "shard").cogroup(back.groupBy("node", "coarse")).applyInArrow(_down(coarse), REPLY_SQL)


def _hashed(table: pa.Table, n: int) -> Iterator[tuple[np.ndarray, Words, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids and words of runs of documents, with first word, and both hashes, of each window."""
    ids = table.column("id").to_numpy(zero_copy_only=False)
    for lo, hi in slices(table.column("text")):
        words = Words(as_bytes(table.column("text").slice(lo, hi - lo)))
        at, h1 = words.windows(n)
        yield ids[lo:hi], words, at, h1, (words.windows(n, 1)[1] >> np.uint64(32)).astype(np.uint32)


def _cells(h1: np.ndarray, bits: int) -> list[np.ndarray]:
    """Counter of each window in each row of the sketch, counted through all rows."""
    out = []
    for row in range(DEPTH):
        out.append((h1 >> np.uint64(64 - bits)) + np.uint64(row << bits))
        h1 = h1 * SPREAD
    return out


def _sketch(n: int, layout: Layout, key_bits: int):
    """A block's part of the sketch: its counters that aren't zero."""

    def one(docs: pa.Table) -> pa.Table:
        h1 = np.concatenate([h for _, _, _, h, _ in _hashed(docs, n)] or [np.zeros(0, np.uint64)])
        cell, count = np.unique(np.concatenate(_cells(h1, layout.bits)), return_counts=True)
        return _send(Entries(cell, count > 1), docs.column("node")[0].as_py(), key_bits - layout.coarse_bits)

    return one


def _repeated(docs: pa.Table, replies: pa.Table, n: int, bits: int) -> tuple[Entries, np.ndarray, np.ndarray]:
    """Windows of a block whose estimated count, the least of their counters, is two or more; which windows these are, and each one's place among them."""
    h1, h2, doc = [], [], []
    for ids, words, at, a, b in _hashed(docs, n):
        h1.append(a), h2.append(b), doc.append(ids[words.doc[at]])
    h1, h2, doc = np.concatenate(h1), np.concatenate(h2), np.concatenate(doc).astype(np.int64)
    flag, _ = _read(replies)
    _, _, place = _grouped(np.concatenate(_cells(h1, bits)))
    keep = flag[place].reshape(DEPTH, -1).all(axis=0)
    a, b, d = h1[keep], h2[keep], doc[keep]
    order, first, place = _grouped(a, b)
    if not len(a):
        return Entries(a, np.zeros(0, bool), b, d), keep, place
    d = d[order]
    lo = np.minimum.reduceat(d, first)
    return Entries(a[order[first]], np.maximum.reduceat(d, first) > lo, b[order[first]], lo), keep, place


def _candidates(n: int, layout: Layout):
    def one(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows or not replies.num_rows:
            return PART.empty_table()
        return _send(_repeated(docs, replies, n, layout.bits)[0], docs.column("node")[0].as_py(), 64 - layout.coarse_bits)

    return one


def _remove(n: int, layout: Layout, out: pa.Schema):
    """Documents of a block without the words that windows of smaller ids cover."""

    def one(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return out.empty_table()
        exact = np.array(replies.column("exact").to_pylist(), bool)
        keep = place = least = np.zeros(0, np.int64)
        if exact.any():
            e, keep, place = _repeated(docs, replies.filter(pa.array(~exact)), n, layout.bits)
            many, lo = _read(replies.filter(pa.array(exact)))
            least = np.full(len(e.key), np.iinfo(np.int64).max)
            least[many] = lo
        seen = used = 0
        n_words, n_removed, kept = [], [], []
        for ids, words, at, _, _ in _hashed(docs, n):
            gone = np.zeros(len(words.doc) + 1, np.int64)
            if len(keep):
                some = np.flatnonzero(keep[seen : seen + len(at)])
                hit = least[place[used : used + len(some)]] < ids[words.doc[at[some]]]
                seen, used, some = seen + len(at), used + len(some), at[some[hit]]
                np.add.at(gone, some, 1)
                np.subtract.at(gone, some + n, 1)
            covered = np.cumsum(gone)[:-1] > 0
            removed = np.bincount(words.doc[covered], minlength=len(words.count))
            n_words += words.count.tolist()
            n_removed += removed.tolist()
            for d, w in enumerate(words.split):
                if removed[d]:
                    stays = ~covered[words.first[d] : words.first[d + 1]]
                    w = [w[i] for i in np.flatnonzero(stays)]
                kept.append(b" ".join(w))
        return pa.Table.from_arrays([docs.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), docs.column("copies")], schema=out)

    return one


def substring_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """(id_col, n_words, n_removed, kept) for every row: its words less those of passages that an earlier document has.

    A window is `window` consecutive words of one document, compared as they are. Each word is removed that is covered by a
    window whose words also start in a document with a smaller id. Windows are judged on the input. `kept` holds the
    remaining words, joined by one space.

    Documents are dealt into blocks of about BLOCK_BYTES by a hash of id and text, so that an id of very many texts is spread too. (1) Every block counts its windows in a count-min sketch of
    DEPTH rows with CELLS or more counters for each window of the input, so that its error is the same at every size. (2) The blocks' sketches
    are added up, counters saturating at two, in shards of about SHARD counters, and each block learns which of its own counters are two or more. An
    estimate, the least of a window's counters, is never below the true count, so no repeated window is lost. (3) Only windows estimated repeated are
    grouped exactly, by 96 bits of hash, in shards too, after each block has reduced them to its smallest id. (4) Blocks get the smallest
    id of each and cut their texts. Where (block, shard) pairs are more than STRAIGHT, groups of blocks add up their parts first and pass answers on,
    so pairs grow as the input to the power 1.5, and a window of every block is one entry a group. No task or driver holds the whole sketch.
    The shuffle of texts by block is made once and reused.

    Null or empty text, and text without words: no words, `kept` empty. Rows that share an id don't remove each other's words; equal rows are judged once, and all returned.
    A null id is kept whole and takes nothing from others. Empty table: empty result. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    layout = Layout.of(rows.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"])
    key_bits = layout.bits + (DEPTH - 1).bit_length()
    placed = without_copies(rows.filter(F.col("id").isNotNull())).select(F.pmod(F.xxhash64("id", "text"), F.lit(layout.blocks)).alias("node"), "id", "text", "copies")
    by_block = lambda: placed.groupBy("node")
    estimates = _exchange(by_block().applyInArrow(_sketch(window, layout, key_bits), PART_SQL), layout, key_bits)
    found = by_block().cogroup(estimates.groupBy("node")).applyInArrow(_candidates(window, layout), PART_SQL)
    firsts = _exchange(found, layout, 64)
    replies = estimates.withColumn("exact", F.lit(False)).unionByName(firsts.withColumn("exact", F.lit(True)))
    out = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("copies", pa.int64())])
    done = by_block().cogroup(replies.groupBy("node")).applyInArrow(_remove(window, layout, out), "id long, n_words long, n_removed long, kept string, copies long")
    unknown = rows.filter(F.col("id").isNull())
    split = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    whole = unknown.select("id", F.size(split).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.array_join(split, " ").alias("kept"))
    return with_copies(done).unionByName(whole).withColumnRenamed("id", id_col)
