"""The prefix trie of conversations, built as a Patricia tree.

Conversations with the same turns are one row. Rows are sorted; ranges of them go to tasks, which walk them with a stack of open points: places where
something ends or branches. A point that closes hands its sums to the point above it, and the nodes between the two, which have one child each,
follow from suffix sums along the edge. Prefixes of a range's first and last row may go on in the ranges beside it. They leave their task
unfinished, as two rows for each range, and one more walk of the same kind over these finishes them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import Workspace, small_batches
from ._text import WORD, thrifty

WIDTH = 16  # bytes of a turn's digest
RANGE_TURNS = 32  # so many first turns choose a row's range; rows that agree in them stay together
NOTHING = hashlib.sha256(b"").hexdigest()
_POINT = "struct<depth:long,members:long,low:long,kids:long,leaves:long,saved:long,ends:string>"
_WALKED = f"""part long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string,
own_key binary, parent_key binary, seq binary, words array<int>, points array<{_POINT}>"""
_FLUSH = 20_000


def sequences(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, seq, words): the turns of each conversation in order, as digests put end to end and as numbers of words.

    Ordered by turn, null first, equal turns by digest. Null role or text is empty. Rows with a null id belong to no conversation. Only digests
    are shuffled. Empty table: no rows. Other columns are ignored.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    turn = F.struct(F.col(turn_col).isNotNull().alias("there"), F.col(turn_col).alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("int").alias("words"))
    found = turns.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), turn.alias("t"))
    listed = found.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return listed.select("conv_id", F.unhex(F.array_join(F.transform("t", lambda t: F.hex(t["digest"])), "")).alias("seq"), F.transform("t", lambda t: t["words"]).alias("words"))


def with_heads_of(seqs: DataFrame, head_of: Column, length: Column) -> DataFrame:
    """Sequences whose first `length` turns are replaced by the first `length` turns of conversation `head_of` as it stands in `seqs`: fewer if that has fewer, none if it is absent."""
    heads = seqs.select(F.col("conv_id").alias("_of"), F.col("seq").alias("_seq"), F.col("words").alias("_words"))
    both = seqs.withColumn("_of", head_of).withColumn("_n", length.cast("int")).join(heads, "_of", "left")
    seq = F.concat(F.coalesce(F.substring("_seq", F.lit(1), F.col("_n") * WIDTH), F.lit(b"")), F.substring("seq", F.col("_n") * WIDTH + 1, F.greatest(F.octet_length("seq"), F.lit(1))))
    words = F.concat(F.coalesce(F.slice("_words", F.lit(1), F.col("_n")), F.array().cast("array<int>")), F.slice("words", F.col("_n") + 1, F.greatest(F.size("words"), F.lit(1))))
    return both.select("conv_id", seq.alias("seq"), words.alias("words"))


class _Open:
    """A point whose subtree is still being walked, with what has closed below it."""

    __slots__ = ("depth", "members", "low", "kids", "leaves", "saved", "ends", "key")

    def __init__(self, depth: int):
        self.depth, self.members, self.low, self.kids, self.leaves, self.saved, self.ends, self.key = depth, 0, None, 0, 0, 0, None, None

    def add(self, members: int, low: int | None, kids: int, leaves: int, saved: int) -> None:
        self.members += members
        if low is not None and (self.low is None or low < self.low):
            self.low = low
        self.kids += kids
        self.leaves += leaves
        self.saved += saved

    def raw(self) -> tuple:
        return self.depth, self.members, self.low, self.kids, self.leaves, self.saved, self.ends


def _common(a: bytes, b: bytes) -> int:
    """Turns that two sequences share at their start, by halving."""
    lo, hi = 0, min(len(a), len(b)) // WIDTH
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo * WIDTH : mid * WIDTH] == b[lo * WIDTH : mid * WIDTH] else (lo, mid - 1)
    return lo


class _Walk:
    """Walks sorted rows (seq, words, points) and yields nodes. In a range of many (`whole` false) the prefixes of its first and last row are handed on."""

    def __init__(self, part: int, whole: bool):
        self.part, self.whole = part, whole
        self.stack = [_Open(0)]
        self.first: tuple[bytes, list[int]] | None = None
        self.seq, self.words = b"", []
        self.on_first = 0  # turns that the current row shares with the first one
        self.handed: list[tuple] = []
        self.rows: list[tuple] = []

    def _key(self, p: _Open) -> bytes:
        if p.key is None:
            p.key = hashlib.md5(self.seq[: p.depth * WIDTH]).digest()
        return p.key

    def _close(self, p: _Open, above: _Open) -> None:
        leaves = p.leaves if p.kids else 1
        saved, rest = p.saved, p.members - 1
        kids, ends, own = p.kids, p.ends or NOTHING, self._key(p) if p.kids else None
        for depth in range(p.depth, above.depth, -1):
            saved += rest * self.words[depth - 1]
            top = depth == above.depth + 1
            self.rows.append((self.part, p.low, depth, None if top else p.low, p.members, kids, leaves, saved, ends, own, self._key(above) if top else None, None, None, None))
            kids, ends, own = 1, NOTHING, None
        above.add(p.members, p.low, 1, leaves, saved)

    def _down_to(self, depth: int) -> None:
        """Closes all points below `depth`, where the next row leaves the current one."""
        while self.stack[-1].depth > depth:
            p = self.stack.pop()
            if self.stack[-1].depth < depth:
                self.stack.append(_Open(depth))
            if not self.whole and p.depth <= self.on_first:
                self.handed.append(p.raw())
            else:
                self._close(p, self.stack[-1])

    def row(self, seq: bytes, words: list[int], points: list[dict]) -> None:
        if self.first is None:
            self.first, self.on_first = (seq, words), len(seq) // WIDTH
        else:
            shared = _common(self.seq, seq)
            self._down_to(shared)
            self.on_first = min(self.on_first, shared)
        self.seq, self.words = seq, words
        for point in points:
            i = len(self.stack)
            while self.stack[i - 1].depth > point["depth"]:
                i -= 1
            if self.stack[i - 1].depth < point["depth"]:
                self.stack.insert(i, _Open(point["depth"]))
                i += 1
            p = self.stack[i - 1]
            p.add(point["members"], point["low"], point["kids"], point["leaves"], point["saved"])
            p.ends = point["ends"] or p.ends

    def finish(self) -> None:
        if self.first is None:
            return
        if self.whole:
            self._down_to(0)
            root = self.stack[0]
            self.rows.append((self.part, root.low, 0, None, root.members, root.kids, root.leaves if root.kids else 1, root.saved, root.ends or NOTHING, self._key(root), None, None, None, None))
            return
        for (seq, words), points in ((self.first, self.handed[::-1]), ((self.seq, self.words), [p.raw() for p in self.stack])):
            if points:
                depth = points[-1][0]
                self.rows.append((self.part, *[None] * 10, seq[: depth * WIDTH], words[:depth], points))


def _walker(whole: bool, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = [f.name for f in schema.field("points").type.value_type]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
        columns[-1] = [None if c is None else [dict(zip(names, p, strict=True)) for p in c] for c in columns[-1]]
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = _Walk(-1 if whole else TaskContext.get().partitionId(), whole)
        for batch in thrifty(batches):
            seqs, words, points = (batch.column(c) for c in ("seq", "words", "points"))
            for i in range(batch.num_rows):
                w.row(seqs[i].as_py(), words[i].as_py(), points[i].as_py())
                if len(w.rows) >= _FLUSH:
                    yield out(w.rows)
                    w.rows.clear()
        w.finish()
        if w.rows:
            yield out(w.rows)

    return walk


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ends) from pieces (key, bucket, piece) sorted by both: SHA-256 of a key's pieces joined by commas, fed piece by piece."""
    now, sha = None, None
    for batch in thrifty(batches):
        keys, ends = [], []
        for key, piece in zip(batch.column("key"), batch.column("piece"), strict=True):
            key = key.as_py()
            if key != now:
                if now is not None:
                    keys.append(now)
                    ends.append(sha.hexdigest())
                now, sha = key, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(piece.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ends, pa.string())], names=["key", "ends"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([sha.hexdigest()], pa.string())], names=["key", "ends"])


def prefix_trie(seqs: DataFrame) -> DataFrame:
    """One row for each different prefix of the sequences (conv_id, seq, words), the empty one included, by the conversations that start with it, its members.

    conv_id: the smallest member; with depth it names the node. parent_conv_id: that of the node above (root: null). n_convs: members. n_children, n_leaves:
    nodes one turn longer, and childless nodes below it (itself, if childless). saved_tokens: over the subtree, (n_convs - 1) times the words of a node's last
    turn. ends_sha256: hash of the ids, ascending and comma-joined, of the members that end here (of the empty string: none).

    Equal sequences meet by digest, their number and smallest id combined before the shuffle; their ids are joined in pieces of 2^16 possible ids each, so that
    only the hash itself, which can't be divided, runs over a large group in one task, piece by piece. A task holds one row and the open points on
    its path. Hot points (the root, a common first turn) get one unfinished row a range; nodes find the point above them by (range, key).
    A conversation is one row of 20 bytes a turn. Rows that agree in RANGE_TURNS turns share a range, whatever their number: slower, not larger.

    Empty table: no nodes. Sequences without turns end at the root. conv_id must be unique, as sequences() leaves it.
    """
    spark = seqs.sparkSession
    small_batches(spark)
    ws = Workspace(spark, "trie")
    keyed = ws.save(seqs.withColumn("key", F.unhex(F.md5("seq"))), "keyed")
    pieces = keyed.groupBy("key", F.shiftright("conv_id", 16).alias("bucket")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")), ",").cast("binary").alias("piece"))
    ends = pieces.repartition("key").sortWithinPartitions("key", "bucket").select("key", "piece").mapInArrow(_listed, "key binary, ends string")
    classes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("conv_id").alias("low"), F.any_value("seq").alias("seq"), F.any_value("words").alias("words")).join(ends, "key")
    zero = F.lit(0).cast("long")
    point = F.struct((F.octet_length("seq") / WIDTH).cast("long").alias("depth"), "members", "low", zero.alias("kids"), zero.alias("leaves"), zero.alias("saved"), "ends")
    classes = ws.save(classes.select("seq", "words", F.array(point).alias("points")), "classes")

    schema = spark.createDataFrame([], _WALKED).schema
    arrow = _arrow_schema(schema)
    ranged = classes.repartitionByRange(F.substring("seq", F.lit(1), F.lit(RANGE_TURNS * WIDTH))).sortWithinPartitions("seq")
    walked = ws.save(ranged.mapInArrow(_walker(False, arrow), schema), "walked")
    borders = walked.filter("points IS NOT NULL").select("part", "seq", "words", "points")
    rest = ws.save(borders.select("seq", "words", "points").repartition(1).sortWithinPartitions("seq").mapInArrow(_walker(True, arrow), schema), "borders")

    nodes = walked.filter("points IS NULL").unionByName(rest).drop("seq", "words", "points")
    shared = borders.select("part", F.explode(F.transform("points", lambda p: F.unhex(F.md5(F.substring("seq", F.lit(1), (p["depth"] * WIDTH).cast("int")))))).alias("own_key")).distinct()
    above = nodes.filter("own_key IS NOT NULL").select("part", "own_key", "conv_id").unionByName(shared.join(rest.filter("own_key IS NOT NULL").select("own_key", "conv_id"), "own_key"))
    above = above.select("part", F.col("own_key").alias("parent_key"), F.col("conv_id").alias("_above"))
    ws.keep(walked, rest)
    return nodes.join(above, ["part", "parent_key"], "left").select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "_above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


def _arrow_schema(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
