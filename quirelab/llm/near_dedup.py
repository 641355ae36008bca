"""MinHash near-dedup: banded candidates, odd sketches to sift them, full sets to confirm them."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import components, flatten_parents
from ._store import Workspace, small_batches, without_copies
from ._text import Words, as_bytes, mix, slices, thrifty
from .line_dedup import salts_for

ROWS = 4
SAMPLES = 4096
SKETCH_BITS = 2048
BLOCK = 128
#: Documents outside its largest component from which a bucket is crowded; how often crowds are dealt out by finer bands.
CROWD, DEALS = 4096, 2
MISS = 1e-6


def bands_for(similarity: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands that leave a chance under `miss` that two sets of just this similarity share none."""
    return math.ceil(math.log(miss) / math.log(1 - similarity**rows))


def signatures(doc: np.ndarray, h: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """k MinHash values (32 bits) of each text's shingle hashes; texts without shingles keep the largest value."""
    sig = np.full((n_docs, k), 0xFFFFFFFF, np.uint32)
    if len(h):
        factor = mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
        cuts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        for j in range(k):
            sig[doc[cuts], j] = np.minimum.reduceat(((h * factor[j]) >> np.uint64(32)).astype(np.uint32), cuts)
    return sig


def odd_sketches(doc: np.ndarray, h: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Parity bitmaps of each text, and how many samples went in.

    The samples are one-permutation MinHash values: the least hash of each of SAMPLES ranges that has one. Hashes come sorted by
    text and value, so the least ones stand first. Each flips the bit that it is hashed to.
    """
    bin_ = h >> np.uint64(64 - SAMPLES.bit_length() + 1)
    least = np.concatenate(([True], (bin_[1:] != bin_[:-1]) | (doc[1:] != doc[:-1]))) if len(h) else np.zeros(0, bool)
    at = (mix(h[least] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SKETCH_BITS.bit_length() + 1)).astype(np.int64) + doc[least] * SKETCH_BITS
    odd = (np.bincount(at, minlength=n_docs * SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n_docs, SKETCH_BITS), axis=1), np.bincount(doc[least], minlength=n_docs)


def may_link(apart: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, similarity: float) -> np.ndarray:
    """False where two sets are not as similar as this, but for a chance of about 1e-6.

    apart: XOR population count of the sketches; sizes of the sets; samples in the sketches. At the threshold the union has
    (size_a + size_b) / (1 + similarity) shingles. They fill a number of ranges that the samples of the two sets tell closely; the share
    `similarity` of these agree, with the spread of a draw without replacement. What is left over flips bits, and flips of one bit cancel.
    """
    n, rate = size_a + size_b, np.log1p(-1 / SAMPLES)
    union, expect = n / (1 + similarity), lambda x: SAMPLES * -np.expm1(x * rate)
    filled = np.minimum(expect(union) * (in_a + in_b) / np.maximum(expect(size_a) + expect(size_b), 1e-9), union)
    load = union / SAMPLES
    uncertain = SAMPLES * np.exp(-load) * (1 - (1 + load) * np.exp(-load)) * (1 - n / 2 / union)
    spread = np.sqrt(filled * similarity * (1 - similarity) * (1 - filled / union) + similarity**2 * uncertain)
    flips = np.maximum(in_a + in_b - 2 * (similarity * filled - 5 * spread - 1), 0)
    mean = SKETCH_BITS / 2 * -np.expm1(flips * np.log1p(-2 / SKETCH_BITS))
    alike = np.minimum(size_a, size_b) >= similarity * np.maximum(size_a, size_b) - 1e-9
    left = np.exp(-4 * flips / SKETCH_BITS)
    noise = np.sqrt(np.maximum(SKETCH_BITS / 4 * (1 - left) - flips * left, 0))
    return alike & (apart <= np.minimum(flips, mean + 5 * noise + 1))


SIGNED = pa.schema([("id", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary()), ("sampled", pa.int32())])
SIGNED_SQL = "id long, n_shingles long, key binary, bands array<long>, sketch binary, sampled int"


def _sign(shingle: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in thrifty(batches):
            for lo, hi in slices(batch.column("text")):
                n = hi - lo
                doc, h = Words(as_bytes(batch.column("text").slice(lo, n)), lower=True).shingles(shingle)
                sizes = np.bincount(doc, minlength=n)
                first = np.concatenate(([0], np.cumsum(sizes)))
                keys = [hashlib.blake2b(h[first[i] : first[i + 1]].tobytes(), digest_size=16).digest() for i in range(n)]
                sig = signatures(doc, h, n, bands * rows)
                band = np.full((n, bands), 0x51ED270B, np.uint64)
                for r in range(rows):
                    band = mix(band * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::rows])
                sketch, sampled = odd_sketches(doc, h, n)
                lists = pa.ListArray.from_arrays(np.arange(0, band.size + 1, bands, dtype=np.int32), pa.array(band.ravel().view(np.int64)))
                rest = [pa.array([x.tobytes() for x in sketch], pa.binary()), pa.array(sampled.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, n), pa.array(sizes.astype(np.int64)), pa.array(keys, pa.binary()), lists, *rest], schema=SIGNED)

    return run


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _confirm(shingle: int, percent: int):
    """Keeps pairs whose full shingle sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in thrifty(batches):
            good = np.zeros(batch.num_rows, bool)
            for lo, hi in slices(batch.column("ta"), batch.column("tb")):
                n = hi - lo
                texts = [t for c in ("ta", "tb") for t in as_bytes(batch.column(c).slice(lo, n))]
                doc, h, h2 = Words(texts, lower=True).shingles(shingle, both=True)
                size = np.bincount(doc, minlength=2 * n)
                pair = doc % n
                order = np.lexsort((h2, h, pair))
                pair, h, h2 = pair[order], h[order], h2[order]
                both = np.bincount(pair[1:][(pair[1:] == pair[:-1]) & (h[1:] == h[:-1]) & (h2[1:] == h2[:-1])], minlength=n)
                good[lo:hi] = (both > 0) & (100 * both >= percent * (size[:n] + size[n:] - both))
            mask = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], schema=PAIRS)

    return run


def _bits(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, SKETCH_BITS // 64)


def _sift(similarity: float):
    """Keeps pairs whose sketches are near enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in thrifty(batches):
            apart = np.bitwise_count(_bits(batch.column("sketch_a")) ^ _bits(batch.column("sketch_b"))).sum(axis=1)
            n = {c: batch.column(c).to_numpy() for c in ("size_a", "size_b", "sampled_a", "sampled_b")}
            mask = pa.array(may_link(apart, n["size_a"], n["size_b"], n["sampled_a"], n["sampled_b"], similarity))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], schema=PAIRS)

    return run


def _across(similarity: float):
    """Pairs of different components between the two sides of a cell (or within it, if it has one side) whose sketches are near.

    Documents that share several buckets meet in the first of them alone.
    """

    def run(table: pa.Table) -> pa.Table:
        ids, comp, size, sampled = (table.column(c).to_numpy() for c in ("id", "root", "size", "sampled"))
        side = table.column("side").to_numpy()
        sketch = _bits(table.column("sketch"))
        bands = np.array(table.column("bands").to_pylist(), np.int64)[:, : table.column("band")[0].as_py()]
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        a, b = [], []
        for i in left:
            r = right if len(right) else left[left > i]
            r = r[comp[r] != comp[i]]
            r = r[~(bands[r] == bands[i]).any(axis=1)]
            apart = np.bitwise_count(sketch[r] ^ sketch[i]).sum(axis=1)
            near = r[may_link(apart, size[r], size[i], sampled[r], sampled[i], similarity)]
            a.append(np.maximum(ids[near], ids[i]))
            b.append(np.minimum(ids[near], ids[i]))
        cat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))
        return pa.Table.from_arrays([cat(a), cat(b)], schema=PAIRS)

    return run


def _cells(open_: DataFrame) -> DataFrame:
    """Members of open buckets (band, bucket, id, root, n_main, n_rest, is_main) dealt into cells (kind, i, j) of two sides, BLOCK of each at most or so.

    The bucket's largest component is in blocks of its own, which meet the blocks of the rest and never one another; blocks of the
    rest meet each other too. So a bucket of n members, m of which are not in its largest component, makes about m * n / BLOCK rows and not n * n / BLOCK.
    """
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    mains, rests = blocks("n_main"), blocks("n_rest")
    own = F.pmod(F.xxhash64("id", F.lit(7)), F.when(F.col("is_main"), mains).otherwise(rests)).cast("int")
    cell = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    block = F.col("_block")
    to_rests = F.transform(F.sequence(F.lit(0), rests - 1), lambda q: cell("main", block, q, 0))
    to_mains = F.transform(F.sequence(F.lit(0), mains - 1), lambda p: cell("main", p, block, 1))
    among = F.transform(
        F.sequence(F.lit(0), rests - 1),
        lambda q: F.struct(F.lit("rest").alias("kind"), F.least(block, q).alias("i"), F.greatest(block, q).alias("j"), (block > q).cast("int").alias("side")),
    )
    cells = F.when(F.col("is_main"), to_rests).otherwise(F.concat(to_mains, among))
    return open_.withColumn("_block", own).withColumn("_cell", F.explode(cells)).select("*", "_cell.*").drop("_block", "_cell", "n_main", "n_rest", "is_main")


def near_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, rows: int = ROWS) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for every row.

    A-Z is lower-cased; a document's set holds its distinct `shingle`-word shingles, or its whole word sequence if it is
    shorter. Documents with 100 * intersection >= percent * union are linked; component_id is the smallest id that links reach,
    and kept says that it is the document's own.

    1. One pass over the texts: MinHash values, `rows` of them to a band; one-permutation MinHash samples, folded into an odd sketch
       (SKETCH_BITS parity bits); and a digest of the whole set. As many bands as leave a pair at the very threshold a chance under MISS to share none.
    2. Equal sets are one class; only its smallest id goes on.
    3. Each bucket of a band has its smallest id as leader, found by salted minima. Every document picks the leader that most of
       its bands agree on; sketches sift these links, and the two full sets confirm them. The links form a forest.
    4. Buckets that still hold more than one component are searched whole, block of BLOCK against block, for pairs of different
       components whose sketches are near; full sets confirm these too. Pairs within a component are never looked at, and members
       of a bucket's largest component are sent to blocks of the others only. If more than CROWD are outside of that, the bucket's documents are dealt into
       buckets anew by bands of twice as many rows (as many bands as leave the same chance MISS), where documents that aren't alike meet far less, and 3 and 4 are done there.
    5. Components of all confirmed links. All tables in between are dropped.
    Sets are measured by 64-bit hashes of shingles, links confirmed by 128-bit ones.

    Null or empty text, and text without words: n_shingles 0, linked with nothing, kept. Rows that share an id are one
    document with each of its texts' sets: they get the same component_id. A null id is linked with nothing and has a null
    component_id, and is kept. Empty table: empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    similarity = percent / 100
    ws = Workspace(spark, "near")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = ws.save(texts.mapInArrow(_sign(shingle, bands_for(similarity, rows), rows), SIGNED_SQL), "signed")
    real = signed.filter("n_shingles > 0 and id is not null")
    classes = ws.save(real.groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
    same = real.join(classes.filter("n > 1").select("key", "rep"), "key").filter("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    reps = real.join(classes.select("key", F.col("rep").alias("id")), ["key", "id"], "left_semi").dropDuplicates(["key", "id"])
    reps = ws.save(reps.select("id", "key", F.col("n_shingles").alias("size"), "sketch", "sampled", "bands"), "reps")

    once = without_copies(texts.filter("id is not null")).drop("copies")  # or m copies of a row and n of another would meet m * n times

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        text = lambda c, new: once.select(F.col("id").alias(c), F.col("text").alias(new))
        both = pairs.join(text("a", "ta"), "a").join(text("b", "tb"), "b").select("a", "b", "ta", "tb")
        return ws.save(both.mapInArrow(_confirm(shingle, percent), "a long, b long"), name)

    links, roots, crowd, salts = same, None, None, salts_for(reps.count())
    for deal in range(DEALS):
        if deal:  # bands of twice as many rows part the documents of crowded buckets
            finer = texts.join(crowd, "id", "left_semi").mapInArrow(_sign(shingle, bands_for(similarity, rows << deal), rows << deal), SIGNED_SQL)
            reps = ws.save(finer.select("id", "key", "bands").dropDuplicates(["id", "key"]).join(reps.drop("bands"), ["id", "key"]), "reps")
        rooted = reps.select("id", "bands", F.col("id").alias("root")) if roots is None else reps.select("id", "bands").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        spread = rooted.select("id", "root", F.posexplode("bands").alias("band", "bucket")).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
        partial = spread.groupBy("band", "bucket", "salt").agg(F.min(F.struct("id", "root")).alias("leader"), F.count(F.lit(1)).alias("n"))
        shared = partial.groupBy("band", "bucket").agg(F.min("leader").alias("leader"), F.sum("n").alias("n"), F.collect_list("salt").alias("salts")).filter("n > 1")
        members = spread.join(shared.select("band", "bucket", "leader", F.explode("salts").alias("salt")), ["band", "bucket", "salt"])
        members = ws.save(members.select("band", "bucket", "id", F.col("leader.id").alias("leader"), (F.col("root") == F.col("leader.root")).alias("joined")), "members")

        votes = members.filter("not joined").groupBy("id", "leader").agg(F.count(F.lit(1)).alias("n"))
        tried = ws.save(votes.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "leader")).alias("best")).select(F.col("id").alias("a"), F.col("best.leader").alias("b")), "tried")
        side = lambda c: reps.select(F.col("id").alias(c), *[F.col(k).alias(f"{k}_{c}") for k in ("size", "sampled", "sketch")])  # noqa: E731, B023
        sifted = ws.save(tried.join(side("a"), "a").join(side("b"), "b").mapInArrow(_sift(similarity), "a long, b long"), "sifted")
        forest = confirmed(sifted, "forest")
        if roots is None:
            roots = flatten_parents(ws, forest.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("parent")))
        else:
            roots = components(ws, links.unionByName(forest))

        mixed = members.join(roots, "id", "left").select("band", "bucket", "id", F.coalesce("root", "id").alias("root"))
        sizes = mixed.groupBy("band", "bucket", "root").agg(F.count(F.lit(1)).alias("size"))
        kinds = sizes.groupBy("band", "bucket").agg(F.max(F.struct("size", "root")).alias("main"), F.sum("size").alias("all")).filter("all > main.size")
        open_ = ws.save(kinds.select("band", "bucket", F.col("main.root").alias("main"), F.col("main.size").alias("n_main"), (F.col("all") - F.col("main.size")).alias("n_rest")), "open")
        inside = ws.save(mixed.join(open_, ["band", "bucket"]).withColumn("is_main", F.col("root") == F.col("main")).drop("main"), "inside")  # both sides are written tables: Spark may split a crowded bucket
        crowded = F.lit(False) if deal + 1 == DEALS else F.col("n_rest") > CROWD
        pieces = _cells(inside.filter(~crowded).join(reps.select("id", "size", "sampled", "sketch", "bands"), "id"))
        cell = ["band", "bucket", "kind", "i", "j"]
        pieces = pieces.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *cell)  # few bytes, much work: not to be coalesced
        found = pieces.groupBy(*cell).applyInArrow(_across(similarity), "a long, b long").distinct()
        found = ws.save(found.join(tried, ["a", "b"], "left_anti"), "across")
        links = links.unionByName(roots.select(F.col("id").alias("a"), F.col("root").alias("b")))
        if not found.isEmpty():
            links = links.unionByName(confirmed(found, "more"))
        if deal + 1 == DEALS or open_.filter(crowded).isEmpty():
            break
        crowd = ws.save(inside.filter(crowded).select("id").distinct(), "crowd")
        roots = components(ws, links)
    total = components(ws, links)
    out = signed.select("id", "n_shingles").join(total, "id", "left").withColumn("component_id", F.coalesce("root", "id"))
    done = ws.save(out.select("id", "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")), "result")
    ws.keep(done)
    return done.withColumnRenamed("id", id_col)
