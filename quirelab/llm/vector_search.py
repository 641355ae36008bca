"""Nearest neighbours through learned partitions: a balanced cut of a neighbour graph, and a classifier that routes by it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import Workspace, small_batches

#: Vectors that teach a cut, at most.
SAMPLE = 4096
NEIGHBOURS = 10
LEAF = 500
#: Candidates, and queries, that meet in one group, at most or so.
BLOCK = 4096
#: Queries whose true neighbours among all vectors tell how far to probe.
CALIBRATE = 200


def usable(vector: Column) -> Column:
    """Not null, all components there and finite, and not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def parts_for(rows: int) -> tuple[int, int]:
    """Parts of the first cut, and of the second within each: about LEAF vectors to a leaf, as far as samples can teach that many apart."""
    leaves, most = max(rows / LEAF, 8), SAMPLE // 32
    if leaves <= most:
        return int(np.ceil(leaves)), 1
    side = int(min(np.ceil(leaves**0.5), most))
    return side, side


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for lo in range(0, len(x), 512):
        near = x[lo : lo + 512] @ x.T
        near[np.arange(len(near)), np.arange(lo, lo + len(near))] = -np.inf
        out[lo : lo + 512] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, parts: int, slack: float = 1.1, rounds: int = 12) -> np.ndarray:
    """Parts of at most slack times the mean size that cut few edges: grown from seeds, then refined by moves that gain."""
    n = len(graph)
    most = int(np.ceil(slack * n / parts))
    around: list[list[int]] = [list(r) for r in graph]
    for i, row in enumerate(graph):
        for j in row:
            around[j].append(i)
    part, size, queue_at = np.full(n, -1), np.zeros(parts, np.int64), 0
    order = np.random.default_rng(7).permutation(n)
    for p in range(parts):
        while queue_at < n and part[order[queue_at]] >= 0:
            queue_at += 1
        todo = [int(order[queue_at])] if queue_at < n else []
        while todo and size[p] < n // parts:
            i = todo.pop(0)
            if part[i] < 0:
                part[i] = p
                size[p] += 1
                todo += [j for j in around[i] if part[j] < 0]
    for i in order:
        if part[i] < 0:
            votes = np.bincount([part[j] for j in around[i] if part[j] >= 0] or [0], minlength=parts).astype(float)
            votes[size >= most] = -1
            part[i] = votes.argmax() if votes.max() > 0 else size.argmin()
            size[part[i]] += 1
    for _ in range(rounds):
        moved = 0
        for i in order:
            votes = np.bincount(part[around[i]], minlength=parts)
            gain = np.where(size < most, votes, -1)
            best = int(gain.argmax())
            if gain[best] > votes[part[i]]:
                size[part[i]] -= 1
                part[i] = best
                size[best] += 1
                moved += 1
        if not moved:
            break
    return part


@dataclass
class Cut:
    """A softmax classifier from a unit vector to the parts of a balanced cut."""

    weights: np.ndarray
    bias: np.ndarray

    def logs(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights + self.bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


@dataclass
class Router:
    """One cut, or a second one within each part of it. Leaf: part * (parts of the second cut) + part in that."""

    first: Cut
    second: list[Cut] | None = None

    @property
    def leaves(self) -> int:
        return len(self.first.bias) * (max(len(c.bias) for c in self.second) if self.second else 1)

    def logs(self, x: np.ndarray) -> np.ndarray:
        """Log probability of every leaf; leaves that there are not have none."""
        out = self.first.logs(x)
        if self.second is None:
            return out
        width = self.leaves // len(self.second)
        deep = np.full((len(x), len(self.second), width), -np.inf)
        for i, c in enumerate(self.second):
            deep[:, i, : len(c.bias)] = out[:, i, None] + c.logs(x)
        return deep.reshape(len(x), -1)

    def home(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the most probable part, and the most probable one in that."""
        part = self.first.logs(x).argmax(axis=1)
        if self.second is None:
            return part
        out = np.zeros(len(x), np.int64)
        for i in np.unique(part):
            at = part == i
            out[at] = i * (self.leaves // len(self.second)) + self.second[i].logs(x[at]).argmax(axis=1)
        return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(x: np.ndarray, parts: int) -> Cut:
    """Cuts the neighbour graph of unit vectors into balanced parts, and teaches a classifier each vector's own part and those of its neighbours."""
    x = np.unique(x, axis=0)
    parts = max(1, min(parts, len(x) // 16))
    w, b = np.zeros((x.shape[1], parts)), np.zeros(parts)
    if parts == 1:
        return Cut(w, b)
    graph = neighbour_graph(x, NEIGHBOURS)
    part = balanced_parts(graph, parts)
    goal = np.zeros((len(x), parts))
    np.add.at(goal, (np.arange(len(x)), part), 0.5)
    np.add.at(goal, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 0.5 / graph.shape[1])
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for t in range(1, 301):
        g = (np.exp(Cut(w, b).logs(x)) - goal) / len(x)
        for value, grad, m, v in ((w, x.T @ g + 1e-6 * w, mw, vw), (b, g.sum(axis=0), mb, vb)):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            value -= 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return Cut(w, b)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows, each scaled by the power of two that brings its largest component under 1: cosines stay what they are, to the last bit, and no norm overflows."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None])


CUTS = pa.schema([("leaf", pa.int32()), ("weights", pa.binary()), ("bias", pa.binary())])


def _fit_part(parts: int, dim: int):
    """The second cut of one part, from the sample of its vectors."""

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("place").slice(0, SAMPLE)
        cut = fit(unit(_matrix(table.column("vector"), dim)), parts)
        return pa.Table.from_pylist([{"leaf": table.column("leaf")[0].as_py(), "weights": cut.weights.astype(np.float32).tobytes(), "bias": cut.bias.astype(np.float32).tobytes()}], CUTS)

    return one


def _homes(router: Router, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = router.home(unit(_matrix(batch.column("vector"), dim)))
                yield pa.RecordBatch.from_pydict({f: batch.column(f) for f in batch.schema.names if f != "leaf"} | {"leaf": pa.array(leaf.astype(np.int32))})

    return run


def probed(logs: np.ndarray, mass: float, sizes: np.ndarray, least: int) -> np.ndarray:
    """Which leaves each query goes to: the most probable ones, up to this probability mass and until they hold `least` vectors."""
    order = np.argsort(-logs, axis=1, kind="stable")
    p = np.exp(np.take_along_axis(logs, order, axis=1))
    before = np.cumsum(p, axis=1) - p
    held = np.cumsum(sizes[order], axis=1) - sizes[order]
    out = np.zeros(logs.shape, bool)
    np.put_along_axis(out, order, (before < mass) | (held < least), axis=1)
    return out & (sizes > 0)


def _probe(router: Router, mass: float, sizes: np.ndarray, least: int, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                yes = probed(router.logs(unit(_matrix(part.column("vector"), dim))), mass, sizes, least)
                leaf = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(yes.sum(axis=1)))).astype(np.int32), pa.array(np.nonzero(yes)[1].astype(np.int32)))
                yield pa.RecordBatch.from_pydict({f: part.column(f) for f in ("query_id", "vector")} | {"leaf": leaf})

    return run


NEAR = pa.schema([("query", pa.int32()), ("leaf", pa.int32()), ("score", pa.float64())])


def _nearest_leaves(queries: np.ndarray, k: int):
    """The k nearest other vectors of each query in one partition, and their leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, leaf = np.full((len(queries), k), -np.inf), np.full((len(queries), k), -1, np.int32)
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                near = queries @ unit(_matrix(part.column("vector"), queries.shape[1])).T
                near[near > 1 - 1e-12] = -np.inf  # the query itself, or one as good as it
                score = np.concatenate((score, near), axis=1)
                leaf = np.concatenate((leaf, np.broadcast_to(part.column("leaf").to_numpy(), near.shape)), axis=1)
                best = np.argpartition(-score, k - 1, axis=1)[:, :k]
                score, leaf = np.take_along_axis(score, best, axis=1), np.take_along_axis(leaf, best, axis=1)
        some = np.isfinite(score)
        yield pa.RecordBatch.from_arrays([pa.array(np.nonzero(some)[0].astype(np.int32)), pa.array(leaf[some].astype(np.int32)), pa.array(score[some])], schema=NEAR)

    return run


def calibrated(router: Router, placed: DataFrame, asked: DataFrame, k: int, recall: float, dim: int) -> float:
    """Probability mass to probe so that a bounded sample of the queries reaches this share of its true neighbours, which are looked for among all vectors."""
    got = asked.orderBy(F.xxhash64("query_id"), "query_id").limit(CALIBRATE).select("vector").toArrow()
    if not got.num_rows:
        return 1.0
    x = unit(_matrix(got.column("vector"), dim))
    near = placed.select("vector", "leaf").mapInArrow(_nearest_leaves(x, k), "query int, leaf int, score double")
    best = near.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "leaf"))).filter(F.col("nth") <= k).toArrow()
    if not best.num_rows:
        return 1.0
    logs = router.logs(x)
    order = np.argsort(-logs, axis=1, kind="stable")
    p = np.exp(np.take_along_axis(logs, order, axis=1))
    before = np.zeros_like(p)
    np.put_along_axis(before, order, np.cumsum(p, axis=1) - p, axis=1)
    mass = np.sort(before[best.column("query").to_numpy(), best.column("leaf").to_numpy()])
    return float(mass[min(int(np.ceil(recall * len(mass))), len(mass)) - 1]) + 1e-9


FOUND = pa.schema([("query_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])


def _rerank(most: int, dim: int):
    """The best candidates of one block for each query of one, by cosine in double precision."""

    def one(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        if not candidates.num_rows or not queries.num_rows:
            return FOUND.empty_table()
        ids = candidates.column("ids").to_pylist()
        order = np.argsort([x[0] for x in ids])
        c, own = _matrix(candidates.column("vector"), dim)[order], [ids[i] for i in order]
        c_norm = np.linalg.norm(c, axis=1)
        first, alone = np.array([x[0] for x in own]), np.array([len(x) == 1 for x in own])
        query, q = queries.column("query_id").to_pylist(), _matrix(queries.column("vector"), dim)
        q_norm = np.linalg.norm(q, axis=1)
        who, found, score = [], [], []
        for lo in range(0, len(q), 256):
            near = (q[lo : lo + 256] @ c.T) / (q_norm[lo : lo + 256, None] * c_norm)
            for i, row in enumerate(near, lo):
                row[alone & (first == query[i])] = -np.inf
                for many in (4 * most, len(row)):  # all, if ids that several vectors share take up the first
                    at = np.flatnonzero(row >= -np.partition(-row, many - 1)[many - 1]) if many < len(row) else np.arange(len(row))
                    seen, left, best = {query[i]}, most, []
                    for j in at[np.argsort(-row[at], kind="stable")]:
                        if not left or row[j] == -np.inf:
                            break
                        if not seen.issuperset(own[j]):  # a vector whose ids are all nearer by another one takes no place
                            seen.update(own[j])
                            left -= 1
                            best.append(j)
                    if not left or len(at) == len(row):
                        break
                who += [query[i]] * len(best)
                found += [own[j] for j in best]
                score += row[best].tolist()
        return pa.Table.from_arrays([pa.array(who, pa.int64()), pa.array(found, pa.list_(pa.int64())), pa.array(score, pa.float64())], schema=FOUND)

    return one


def build(distinct: DataFrame, rows: int, dim: int, ws: Workspace) -> tuple[Router, DataFrame]:
    """The router, and all vectors with their leaves, written once. The first cut is taught by the vectors that hash smallest, SAMPLE at most; the second one of each part by as many of that part."""
    parts, inner = parts_for(rows)
    got = distinct.select("vector").orderBy(F.xxhash64("vector")).limit(SAMPLE).toArrow()
    router = Router(fit(unit(_matrix(got.column("vector"), dim)), parts))
    kept = "vector array<double>, ids array<long>, leaf int"
    placed = ws.save(distinct.mapInArrow(_homes(router, dim), kept), "first")
    if inner == 1:
        return router, placed
    sizes = placed.groupBy("leaf").count().withColumnRenamed("count", "n")
    some = placed.join(F.broadcast(sizes), "leaf").withColumn("place", F.xxhash64("vector", F.lit(3)))  # one row a part, `parts` at most
    some = some.filter(F.pmod("place", F.lit(1 << 20)) < F.ceil(F.lit(1.2 * SAMPLE * (1 << 20)) / F.col("n"))).select("leaf", "place", "vector")
    cuts = {r["leaf"]: r for r in some.groupBy("leaf").applyInArrow(_fit_part(inner, dim), "leaf int, weights binary, bias binary").collect()}  # as large as the router
    whole = Cut(np.zeros((dim, 1)), np.zeros(1))
    read = lambda r: Cut(np.frombuffer(r["weights"], np.float32).reshape(dim, -1).astype(np.float64), np.frombuffer(r["bias"], np.float32).astype(np.float64))
    router.second = [read(cuts[i]) if i in cuts else whole for i in range(len(router.first.bias))]
    return router, ws.save(placed.mapInArrow(_homes(router, dim), kept), "placed")


def nearest(vectors: DataFrame, queries: Column, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, recall: float = 0.95) -> DataFrame:
    """(query_id, rank, id_col, score): the k rows of largest cosine found for each row where `queries` holds, itself excepted.

    A neighbour graph of a bounded sample is cut into balanced parts; a softmax classifier learns them; with many vectors, each part is cut again by
    a sample of its own, so that leaves hold about LEAF vectors (beyond SAMPLE / 32 squared leaves, they grow). Every vector is indexed in
    its most probable leaf. Every query goes to its most probable leaves, and meets all vectors there, block by block, for exact cosines.
    How much probability a query probes is told by CALIBRATE queries: so much that they reach the share `recall` of their true neighbours among
    all vectors; and never less than leaves that hold k + 1 vectors.
    Equal vectors are searched once: only the k + 1 smallest ids of each can be among anyone's nearest, since ties go to smaller ids.

    Vectors null, zero, or with null or non-finite components take no part, nor do rows with a null id or of another length than most of
    the sample. Rows that share an id and a vector count once. Of different vectors of one id,
    the least (by its first differing component) is searched for, and the nearest one ranks the id, which takes one place. A query with fewer other rows
    gets all of them. Ties go to the smaller id. Long vectors: nothing depends on their length but work. Empty table: empty result. Other columns are ignored.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    ws = Workspace(spark, "nearest")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vector"), queries.alias("asks"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("vector")))
    lengths = rows.select(F.size("vector").alias("dim"), "id").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).groupBy("dim").count()
    dim = lengths.orderBy(F.desc("count"), "dim").first()
    if dim is None:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias(id_col), F.lit(0.0).alias("score")).limit(0)
    dim = dim["dim"]
    rows = rows.filter(F.size("vector") == dim)
    least = Window.partitionBy("vector").orderBy("id")
    distinct = (
        rows.select("id", "vector").withColumn("nth", F.dense_rank().over(least)).filter(F.col("nth") <= k + 1)
        .groupBy("vector").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    )
    router, placed = build(distinct, rows.count(), dim, ws)
    asked = rows.filter("asks").select(F.col("id").alias("query_id"), "vector").groupBy("query_id").agg(F.min("vector").alias("vector"))
    sizes = np.zeros(router.leaves, np.int64)
    for r in placed.groupBy("leaf").count().collect():  # one row a leaf
        sizes[r["leaf"]] = r["count"]
    mass = calibrated(router, placed, asked, k, recall, dim)
    asked = ws.save(asked.mapInArrow(_probe(router, mass, sizes, k + 1, dim), "query_id long, vector array<double>, leaf array<int>"), "asked")
    asked = asked.withColumn("leaf", F.explode("leaf"))
    load = asked.groupBy("leaf").count().select("leaf", F.ceil(F.col("count") / BLOCK).cast("int").alias("q_blocks"))
    held = spark.createDataFrame([(i, -(-int(n) // BLOCK)) for i, n in enumerate(sizes) if n], "leaf int, c_blocks int")
    blocks = F.broadcast(held.join(load, "leaf"))  # one row a leaf
    deal = lambda key, own, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int").alias(own)
    all_ = lambda other, n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(other)
    mine = placed.join(blocks, "leaf").select("leaf", "ids", "vector", deal(F.col("ids")[0], "c", "c_blocks"), all_("q", "q_blocks"))
    theirs = asked.join(blocks, "leaf").select("leaf", "query_id", "vector", deal(F.col("query_id"), "q", "q_blocks"), all_("c", "c_blocks"))
    found = mine.groupBy("leaf", "c", "q").cogroup(theirs.groupBy("leaf", "c", "q")).applyInArrow(_rerank(k + 1, dim), "query_id long, ids array<long>, score double")
    each = found.repartition("query_id").select("query_id", F.explode("ids").alias("id"), "score").filter("id <> query_id")
    each = each.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    done = ws.save(each.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score"), "result")
    ws.keep(done)
    return done
