"""SentencePiece BPE encoding and decoding by vectorised merge rounds over flat symbol arrays."""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import small_batches
from ._text import slices, thrifty

SPACE = "▁"
NONE = np.int64(1) << 40
#: Bytes of encoded parts that a worker remembers, each with what its entry takes.
CACHE, ENTRY = 48 << 20, 200
NORMAL, CONTROL, BYTE, UNKNOWN = range(4)


@dataclass(frozen=True)
class Vocabulary:
    """What merge rounds need of a model: pieces with scores and kinds, begin and end ids. Its size is the vocabulary's."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    bos: int
    eos: int
    name: str

    @staticmethod
    def load(path: str) -> Vocabulary:
        import sentencepiece

        with open(path, "rb") as f:
            blob = f.read()
        sp = sentencepiece.SentencePieceProcessor(model_proto=blob)
        ids = range(sp.vocab_size())
        if any(sp.is_unused(i) for i in ids):
            raise ValueError("models with unused pieces are not supported")
        if sp.encode("a  béﬁ") and sp.decode(sp.encode("  ﬁ ")) != "  ﬁ ":
            raise ValueError("only models with the identity normaliser are supported")
        kinds = tuple(BYTE if sp.is_byte(i) else CONTROL if sp.is_control(i) else UNKNOWN if sp.is_unknown(i) else NORMAL for i in ids)
        return Vocabulary(tuple(sp.id_to_piece(i) for i in ids), tuple(sp.get_score(i) for i in ids), kinds, sp.bos_id(), sp.eos_id(), hashlib.sha256(blob).hexdigest())


class Coder:
    """Lookup tables of a vocabulary, and the rounds."""

    def __init__(self, v: Vocabulary):
        n = self.n = len(v.pieces)
        self.v = v
        ids = {p: i for i, p in enumerate(v.pieces) if v.kinds[i] == NORMAL}
        order = np.argsort(-np.array(v.scores), kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        symbol = lambda s: ids.get(s, n + ord(s) if len(s) == 1 else None)
        pairs: dict[int, int] = {}
        for p, i in ids.items():
            for c in range(1, len(p)):
                a, b = symbol(p[:c]), symbol(p[c:])
                if a is not None and b is not None:
                    pairs[a << 21 | b] = i
        self.bits = max(8, (len(pairs) * 8).bit_length())
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.merged = np.zeros(1 << self.bits, np.int64)
        for k, i in pairs.items():
            at = self._slot(np.array([k]))[0]
            while self.key[at] >= 0:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.key[at], self.merged[at] = k, i
        self.rank = rank
        self.char = np.arange(n, n + 0x110000, dtype=np.int64)
        for p, i in ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        byte = [0] * 256
        for i, p in enumerate(v.pieces):
            if v.kinds[i] == BYTE:
                byte[int(p[3:5], 16)] = i
        self.byte = byte
        self.closed = not any(a != SPACE and b == SPACE for p in ids for a, b in zip(p, p[1:], strict=False))
        alone = "".join(c for c in "\n\r\t" if not any(c in p for p in ids if len(p) > 1))
        self.alone = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|[{alone}]" if alone else "")) if self.closed else re.compile(r"(?s).+")
        self.bytes = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else b" \xe2\x81\x87 " if k == UNKNOWN else p.replace(SPACE, " ").encode() for p, k in zip(v.pieces, v.kinds, strict=True)]
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def join(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece and rank of each pair of symbols; NONE where the two don't make a piece."""
        key = a << np.int64(21) | b
        at = self._slot(key)
        found = self.key[at]
        piece = np.where(found == key, self.merged[at], NONE)
        again = np.flatnonzero((found != key) & (found >= 0))
        while len(again):
            at[again] = (at[again] + 1) & ((1 << self.bits) - 1)
            found = self.key[at[again]]
            hit = found == key[again]
            piece[again[hit]] = self.merged[at[again[hit]]]
            again = again[~hit & (found >= 0)]
        rank = np.full(len(piece), NONE)
        ok = piece < NONE
        rank[ok] = self.rank[piece[ok]]
        return piece, rank

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word. All words go through the rounds together; each round merges every word's best pair."""
        text = "".join(words)
        sym = self.char[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        size = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), size)
        done_sym, done_word = [], []
        piece, rank = self._pairs(sym, word)
        while len(sym):
            start = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            best = np.minimum.reduceat(rank, start)
            length = np.diff(np.concatenate((start, [len(sym)])))
            if (best == NONE).any():
                over = np.repeat(best == NONE, length)
                done_sym.append(sym[over]), done_word.append(word[over])
                stay = ~over
                sym, word, piece, rank = sym[stay], word[stay], piece[stay], rank[stay]
                length, best = length[best < NONE], best[best < NONE]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(best, length))
            run = np.flatnonzero(np.concatenate(([True], np.diff(at) != 1)))
            nth = np.arange(len(at)) - np.repeat(run, np.diff(np.concatenate((run, [len(at)]))))
            at = at[nth % 2 == 0]
            at = self._one_by_one(at, sym, word, piece, rank)
            sym[at] = piece[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            new = np.cumsum(keep) - 1
            sym, word, piece, rank = sym[keep], word[keep], piece[keep], rank[keep]
            touched = new[at]
            touched = np.unique(np.concatenate((touched, touched[touched > 0] - 1)))
            nxt = np.minimum(touched + 1, len(sym) - 1)
            p, r = self.join(sym[touched], sym[nxt])
            apart = (nxt == touched) | (word[nxt] != word[touched])
            p[apart] = r[apart] = NONE
            piece[touched], rank[touched] = p, r
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        sym, word = sym[order], word[order]
        odd = sym >= self.n
        if odd.any():
            out: list[list[int]] = [[] for _ in words]
            for s, w in zip(sym.tolist(), word.tolist(), strict=True):
                out[w] += [s] if s < self.n else [self.byte[b] for b in chr(s - self.n).encode()]
            return [np.array(x, "<u4").tobytes() for x in out]
        flat = sym.astype("<u4").tobytes()
        end = (np.cumsum(np.bincount(word, minlength=len(words))) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *end[:-1]], end, strict=True)]

    def _pairs(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        piece, rank = np.full(len(sym), NONE), np.full(len(sym), NONE)
        if len(sym) > 1:
            p, r = self.join(sym[:-1], sym[1:])
            apart = word[1:] != word[:-1]
            p[apart] = r[apart] = NONE
            piece[:-1], rank[:-1] = p, r
        return piece, rank

    def _one_by_one(self, at: np.ndarray, sym: np.ndarray, word: np.ndarray, piece: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Leaves only the leftmost merge of a word where a pair that a merge makes would come before the other merges."""
        w = word[at]
        several = np.flatnonzero(np.concatenate((w[1:] == w[:-1], [False])) | np.concatenate(([False], w[1:] == w[:-1])))
        if not len(several):
            return at
        i = at[several]
        made, now = piece[i], rank[i]
        worse = np.zeros(len(i), bool)
        for j, left in ((i + 2, False), (i - 1, True)):
            inside = (j >= 0) & (j < len(sym))
            inside[inside] &= word[j[inside]] == word[i[inside]]
            o = sym[np.where(inside, j, 0)]
            r = self.join(o, made)[1] if left else self.join(made, o)[1]
            worse |= inside & (r < now)
        follow = np.flatnonzero(np.diff(i) == 2)
        if len(follow):
            worse[follow] |= (word[i[follow]] == word[i[follow + 1]]) & (self.join(made[follow], made[follow + 1])[1] < now[follow])
        if not worse.any():
            return at
        bad = np.isin(w, w[several[worse]])
        first = np.concatenate(([True], w[1:] != w[:-1]))
        return at[~bad | first]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text, without begin and end."""
        units = [self.alone.findall((SPACE + t).replace(" ", SPACE)) if t else [] for t in texts]
        if self.held > CACHE:
            self.known.clear()
            self.held = 0
        fresh = list(dict.fromkeys(u for row in units for u in row if u not in self.known))
        if fresh:
            ids = self.encode_words(fresh)
            self.known.update(zip(fresh, ids, strict=True))
            self.held += ENTRY * len(fresh) + 4 * sum(map(len, fresh)) + sum(map(len, ids))
        get = self.known.__getitem__
        return [b"".join(map(get, row)) for row in units]

    def decode(self, ids: bytes) -> str:
        """The text of little-endian 32-bit ids: the space that encoding put first is dropped, stray bytes become U+FFFD."""
        out = b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return out.removeprefix(b" ").decode("utf-8", "quire_each_byte")


codecs.register_error("quire_each_byte", lambda e: ("�" * (e.end - e.start), e.end))


@lru_cache(maxsize=2)
def _kept(name: str) -> list[Coder]:
    return []


def coder(v: Vocabulary) -> Coder:
    """One Coder for each vocabulary and Python worker."""
    if not (kept := _kept(v.name)):
        kept.append(Coder(v))
    return kept[0]


TOKENS = pa.schema([("id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])


def _run(v: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(v)
        begin, end = (np.array([x], "<u4").tobytes() for x in (v.bos, v.eos))
        for batch in thrifty(batches):
            for lo, hi in slices(batch.column("text")):
                ids = [begin + x + end for x in c.encode([t or "" for t in batch.column("text").slice(lo, hi - lo).to_pylist()])]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), pa.array(ids, pa.binary()), pa.array(map(c.decode, ids), pa.string())], schema=TOKENS)

    return run


def encode_decode(docs: DataFrame, vocabulary: Vocabulary, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids, decoded) for every row: token ids with begin and end, and the text that they decode to.

    ids are packed as little-endian unsigned 32-bit integers. Texts are cut where no piece can reach across (before a space mark
    that follows another character, and around characters that no longer piece holds); the distinct parts of a batch are
    encoded together and remembered, up to CACHE bytes and one run of texts more in a worker.

    Null and empty text: begin and end only, decoded empty. Repeated ids stay separate rows. Null ids stay. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(_run(vocabulary), "id long, ids binary, decoded string")
    return out.select(F.col("id").alias(id_col), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")
