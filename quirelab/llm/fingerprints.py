"""Fingerprints of documents that can be subtracted: invertible Bloom lookup sketches of paragraph digests. DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import Workspace, with_copies

# A line is cut after each sentence, and after 160 code points where no sentence ends, so that a text of one line is more than one digest.
PARAGRAPH = r"[^\n.!?]{1,160}[.!?]*|[.!?]+"
PARTS, CELLS = 3, 16
STEPS = 9  # of peeling, each over one part
REACH, SAMPLE = 40, 32  # about so many differing digests fit a sketch; so many digests of a set tell roughly how many differ
DEAL, PARAGRAPH_CHARS = 500_000, 70  # digests to a task; so many code points a digest, roughly, to tell their number
ROOM_BITS, SPLIT_BITS = 3, 6  # a larger sketch has 8 cells or more for each digest of its sets, the next one 64 times as many


def paragraphs(text: Column) -> Column:
    """The distinct digests of a text's paragraphs."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(p)))


def _check(key: Column) -> Column:
    return F.xxhash64(F.lit("check"), key).bitwiseAND(F.lit(0xFFFFFFFF))


def _spot(key: Column, part: int) -> Column:
    """The cell of a part that holds a key; parts have CELLS each."""
    return (F.shiftrightunsigned(key, 4 * part).bitwiseAND(F.lit(CELLS - 1)) + part * CELLS).cast("int")


def _row(cell: Column, n: Column, key: Column, check: Column, digest: Column | None = None) -> Column:
    return F.struct(cell.alias("cell"), n.cast("long").alias("n"), key.alias("key"), check.alias("check"), (F.lit(None) if digest is None else digest).cast("long").alias("digest"))


def _summed(rows: DataFrame, by: list[str]) -> DataFrame:
    """Cells of one place, told by `by`, added up: numbers as a sum, digests and check values by XOR. Cells with nothing in them go; recovered digests (cell -1) stay."""
    out = rows.groupBy(*by).agg(F.sum("n").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("check").alias("check"))
    return out.filter("cell = -1 OR n <> 0 OR key <> 0 OR check <> 0")


def sketch(sets: DataFrame, by: list[str]) -> DataFrame:
    """(by, cell, digest, n, key, check): the sketches of sets (by, key, sign). A digest goes into one cell of every part; a digest of sign -1 is subtracted, so the
    sketch of two sets of opposite signs is the difference of their sketches, in which common digests cancel out."""
    spots = F.array(*[_row(_spot(F.col("key"), j), F.col("sign"), F.col("key"), _check(F.col("key"))) for j in range(PARTS)])
    return _summed(sets.select(*by, F.inline(spots)), [*by, "cell"]).withColumn("digest", F.lit(None).cast("long"))


def peel(cells: DataFrame, by: list[str], steps: int = STEPS, named: bool = True) -> DataFrame:
    """Sketches as far as they can be peeled: a cell of one digest gives it away, it is taken out of its other cells, and these may then hold one.

    Recovered digests are rows of cell -1 with `digest` and its sign `n`; if not `named`, rows of cell -1 only tell the sum `n` of those of one sign, so that little goes from step to step.
    Cells that are still there tell that a sketch was too small. One part is
    peeled at a time, so that no digest is found twice. Nothing is shuffled if cells come dealt by some of `by`.
    """
    for step in range(steps):
        j = step % PARTS
        alone = (F.col("cell") >= j * CELLS) & (F.col("cell") < (j + 1) * CELLS) & (F.abs("n") == 1) & (F.col("check") == _check(F.col("key")))
        out = [_row(_spot(F.col("key"), i), -F.col("n"), F.col("key"), F.col("check")) for i in range(PARTS) if i != j]
        found = F.array(_row(F.lit(-1), F.col("n"), F.lit(0).cast("long"), F.lit(0).cast("long"), F.col("key" if named else "n")), *out)
        as_is = F.array(_row(F.col("cell"), F.col("n"), F.col("key"), F.col("check"), F.col("digest")))
        cells = _summed(cells.select(*by, F.inline(F.when(alone, found).otherwise(as_is))), [*by, "cell", "digest"])
    return cells


def within_reach(a: Column, b: Column) -> Column:
    """Whether one sketch may tell the difference of two sets, guessed from their sizes and the SAMPLE smallest digests of each. A wrong guess costs time alone."""
    low = lambda c: F.slice(F.sort_array(c), 1, SAMPLE)
    n, k = F.size(a) + F.size(b), F.least(F.lit(SAMPLE), F.greatest(F.size(a), F.size(b)))
    return F.when(n <= REACH, True).otherwise(n * (k - F.size(F.array_intersect(low(a), low(b)))) <= k * REACH)


def larger(sets: DataFrame, k: str, a: str, others: list[str], level: int = 0) -> DataFrame:
    """(k, tag, n_added, n_removed, parts): how the set `a` differs from each of `others`, by subtracting larger sketches, in the parts that the bits of `parts{tag}` name; a part is the digests with the same first SPLIT_BITS bits.

    Such a sketch has one cell for each value of the first bits of the digests; empty cells are no rows. Each set goes into it once and is subtracted from `a` as cells. A cell of one
    digest gives it away. Parts with a cell that holds more are named in `parts` and not counted; with 64 bits there are none. Nothing is shuffled if sets come dealt by `k`.
    """
    tags, ends = range(len(others)), [F.size(a)]
    for o in others:
        ends.append(ends[-1] + F.size(o))
    bits = F.least(F.lit(64), F.greatest(F.lit(SPLIT_BITS), F.ceil(F.log2(ends[-1].cast("double"))) + ROOM_BITS + SPLIT_BITS * level)).cast("int")
    at = F.posexplode(F.concat(a, *others)).alias("pos", "key")
    rows = sets.select(k, *[f"parts{t}" for t in tags], (64 - bits).alias("cut"), *[e.alias(f"end{i}") for i, e in enumerate(ends)], at)
    named = lambda t: F.expr(f"shiftright(parts{t}, cast(shiftrightunsigned(key, {64 - SPLIT_BITS}) as int)) & 1 = 1")
    sign = lambda t: F.when(named(t), F.when(F.col("pos") < F.col("end0"), 1).when((F.col("pos") >= F.col(f"end{t}")) & (F.col("pos") < F.col(f"end{t + 1}")), -1).otherwise(0)).otherwise(0)
    rows = rows.select(k, "key", F.expr("shiftleft(shiftrightunsigned(key, cut), cut)").alias("cell"), *[sign(t).alias(f"s{t}") for t in tags])
    rows = rows.filter(" OR ".join(f"s{t} <> 0" for t in tags)).withColumn("check", F.xxhash64(F.lit("check"), "key"))
    held = lambda t, c: F.bit_xor(F.when(F.col(f"s{t}") != 0, F.col(c)).otherwise(F.lit(0).cast("long")))
    cells = rows.groupBy(k, "cell").agg(*[x for t in tags for x in (F.sum(f"s{t}").alias(f"n{t}"), held(t, "key").alias(f"x{t}"), held(t, "check").alias(f"c{t}"))])
    alone = lambda t: (F.abs(f"n{t}") == 1) & (F.col(f"c{t}") == F.xxhash64(F.lit("check"), f"x{t}"))
    kept = lambda t: (F.col(f"n{t}") != 0) | (F.col(f"x{t}") != 0) | (F.col(f"c{t}") != 0)
    state = lambda t: F.when(alone(t), F.col(f"n{t}")).when(kept(t), F.lit(2).cast("long")).otherwise(F.lit(0).cast("long"))
    told = cells.select(k, F.shiftrightunsigned("cell", 64 - SPLIT_BITS).cast("int").alias("part"), *[state(t).alias(f"is{t}") for t in tags])
    count = lambda t, n: F.count_if(F.col(f"is{t}") == n)
    told = told.groupBy(k, "part").agg(*[x for t in tags for x in (count(t, 1).alias(f"added{t}"), count(t, -1).alias(f"removed{t}"), count(t, 2).alias(f"short{t}"))])
    sure = lambda t, c: F.sum(F.when(F.col(f"short{t}") == 0, F.col(f"{c}{t}")).otherwise(0)).alias(f"{c}{t}")
    name = lambda t: F.bit_or(F.when(F.col(f"short{t}") > 0, F.expr("shiftleft(1L, part)")).otherwise(F.lit(0).cast("long"))).alias(f"parts{t}")
    told = told.groupBy(k).agg(*[x for t in tags for x in (sure(t, "added"), sure(t, "removed"), name(t))])
    return told.select(k, F.inline(F.array(*[F.struct(F.lit(t).alias("tag"), F.col(f"added{t}").alias("n_added"), F.col(f"removed{t}").alias("n_removed"), F.col(f"parts{t}").alias("parts")) for t in tags])))


def differences(ws: Workspace, pairs: DataFrame, k: str, a: str, others: list[str], fits: list[str]) -> DataFrame:
    """(k, tag, n_added, n_removed): how many digests of the set `a` each of the sets `others`, tagged by place, has not, and the other way round; for equal sets there may be no row.

    Sketches of the sets are subtracted and peeled where the columns `fits` say that this may tell the difference (see within_reach). For the others, and where peeling fails, larger
    sketches are tried, again and again of the parts that failed alone. Between levels only numbers and names of failed parts are written. `pairs` should come dealt by `k`: then nothing is shuffled but these.
    """
    tags = range(len(others))
    none = F.array().cast("array<bigint>")
    sets = [F.when(F.col(f), F.concat(a, o)).otherwise(none) for o, f in zip(others, fits, strict=True)]
    ends = [sum((F.size(s) for s in sets[:t]), F.lit(0)).alias(f"end{t}") for t in tags]
    tag = F.expr("CASE " + " ".join(f"WHEN pos >= end{t} THEN {t}" for t in reversed(tags)) + " END")
    rows = pairs.filter(" OR ".join(fits)).select(k, F.size(a).alias("n"), *ends, F.posexplode(F.concat(*sets)).alias("pos", "key")).withColumn("tag", tag)
    start = F.expr("CASE tag " + " ".join(f"WHEN {t} THEN end{t}" for t in tags) + " END")
    rows = rows.select(k, "tag", "key", F.when(F.col("pos") - start < F.col("n"), 1).otherwise(-1).alias("sign"))
    left = peel(sketch(rows, [k, "tag"]), [k, "tag"], named=False)
    count = lambda sign: F.coalesce(F.sum(F.when((F.col("cell") == -1) & (F.col("digest") == sign), F.abs("n"))), F.lit(0).cast("long"))
    told = left.groupBy(k, "tag").agg(count(1).alias("n_added"), count(-1).alias("n_removed"), F.bool_or(F.col("cell") >= 0).alias("short"))
    done = ws.save(told.select(k, "tag", *[F.when(~F.col("short"), F.col(c)).otherwise(0).alias(c) for c in ("n_added", "n_removed")], F.col("short").cast("long").alias("parts")), "told")
    by_tag = lambda t: F.max(F.when(F.col("tag") == t, F.col("parts")))
    failed = lambda some: some.filter("parts <> 0").groupBy(k).agg(*[F.coalesce(by_tag(t), F.lit(0).cast("long")).alias(f"parts{t}") for t in tags])
    todo = pairs.join(failed(done), k, "left").withColumns({f"parts{t}": F.when(F.col(f) & (F.coalesce(f"parts{t}", F.lit(0)) == 0), F.lit(0)).otherwise(F.lit(-1)).cast("long") for t, f in enumerate(fits)})
    todo = todo.filter(" OR ".join(f"parts{t} <> 0" for t in tags))
    for level in range(64 // SPLIT_BITS + 1):
        told = ws.save(larger(todo, k, a, others, level), f"larger{level}")
        done = done.unionByName(told)
        if told.filter("parts <> 0").isEmpty():
            break
        todo = pairs.join(failed(told), k)
    return done.groupBy(k, "tag").agg(F.sum("n_added").alias("n_added"), F.sum("n_removed").alias("n_removed"))


def likeness(n_a: Column, n_b: Column, differing: Column) -> Column:
    """Digests of both over digests of either; 1 for two empty sets."""
    return F.when(n_a + n_b == 0, F.lit(1.0)).otherwise((n_a + n_b - differing) / (n_a + n_b + differing))


def _spelled() -> Column:
    """The cells of one sketch as text, in their order: place, number, digests and check value in hexadecimal."""
    wide = lambda c, n: F.lpad(F.lower(F.hex(c)), n, "0")
    return F.array_join(F.sort_array(F.collect_list(F.concat(wide(F.col("cell").cast("long"), 2), wide(F.col("n"), 4), wide(F.col("key"), 16), wide(F.col("check"), 8)))), "")


def ring(ws: Workspace, keys: DataFrame, order: list[str]) -> DataFrame:
    """Keys (k, order, others) with `place`, their number in `order`, and `before`, the k of the one before; the last one comes before the first. Ranges are numbered each by itself, after the counts of those before."""
    dealt = ws.save(keys.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("_range", (F.sum("n").over(Window.orderBy("_range")) - F.col("n")).alias("_before"), F.sum("n").over(Window.partitionBy()).alias("_all"))  # one row a range
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    placed = ws.save(dealt.join(before, "_range").withColumn("_place", F.col("_before") + place - 1).drop("_range", "_before"), "places")
    earlier = placed.select(((F.col("_place") + 1) % F.col("_all")).alias("_place"), F.col("k").alias("before"), F.col("n_chars").alias("before_chars"))
    return placed.join(earlier, "_place").withColumnRenamed("_place", "place").drop("_all")


def _in_buckets(ws: Workspace, df: DataFrame, name: str, digests: int) -> DataFrame:
    """A table of the shared folder that is read back dealt by k, DEAL digests or so to a bucket, so that what follows needs no shuffle. Buckets are a multiple of the session's shuffle partitions, or each task would write to all."""
    spark = ws.spark
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n *= max(1, min(digests // (DEAL * n), 100_000 // n))
    table = f"quirelab_{ws.root.rpartition('-')[2]}_{name}"
    df.write.format("parquet").bucketBy(n, "k").option("path", f"{ws.root}/{name}").saveAsTable(table)
    return spark.table(table)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_paragraphs, n_differing) of every row.

    A fingerprint is the sketch of a text's paragraphs (see PARAGRAPH), its cells in hexadecimal: equal texts have equal ones, and two can be subtracted.
    Likeness is told from such differences: peeling gives the digests that only one text has, hence the number in common. Where more differ than the
    cells can tell, larger sketches of the same paragraphs are tried.
    The edited text has the last floor(n_chars / 4) code points replaced by the first as many (or all) of the next document's; after the last comes the first.

    Documents are ordered by id, null last, then by digest of the text. Equal rows (id and text) count as one document; each gets its result. Null text is empty. A single
    document is its own next one. Empty texts have no paragraphs, an empty fingerprint, and are wholly alike. Empty table: no rows. Other columns are ignored.

    Copies of a row meet with one text kept before the shuffle, and are dealt again at the end. Texts are shuffled once, and a quarter of them, as heads
    for the document before, once more; from then on only digests travel. Places come from ranges, so that no task sees all ids.
    """
    ws = Workspace(docs.sparkSession, "fingerprints")
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.md5(text.cast("binary"))
    k = F.unhex(F.md5(F.concat_ws("|", digest, F.col(id_col).cast("string")).cast("binary")))
    base = docs.select(k.alias("k"), F.col(id_col).isNull().alias("x"), F.col(id_col).alias("d"), digest.alias("m"), text.alias("text"))
    keys = base.groupBy("k", "x", "d", "m").agg(F.count(F.lit(1)).alias("copies"), F.max(F.char_length("text")).cast("long").alias("n_chars"))
    placed = ws.save(ring(ws, keys, ["x", "d", "m"]).select("k", "place", F.col("d").alias(id_col), "copies", "n_chars", "before", "before_chars"), "ring")

    texts = base.groupBy("k").agg(F.any_value("text").alias("text"))
    head = F.expr("left(text, cast(before_chars div 4 as int))")
    heads = texts.join(placed.select("k", "before", "before_chars"), "k").select(F.col("before").alias("k"), head.alias("head"), paragraphs(F.col("text")).alias("next"))
    changed = F.concat(F.expr("left(text, cast(n_chars - n_chars div 4 as int))"), F.col("head"))
    seen = texts.join(placed.select("k", id_col, "copies", "n_chars"), "k").join(heads, "k").withColumn("changed", changed)
    seen = seen.select("k", id_col, "copies", "n_chars", F.sha2("changed", 256).alias("edited_sha256"), paragraphs(F.col("text")).alias("own"), paragraphs(F.col("changed")).alias("edited"), "next")
    chars = placed.agg(F.sum("n_chars").alias("n")).first()["n"] or 0
    seen = seen.withColumns({f"fits_{o}": within_reach(F.col("own"), F.col(o)) for o in ("edited", "next")})
    seen = _in_buckets(ws, seen, "paragraphs", chars // PARAGRAPH_CHARS * 4)

    apart = differences(ws, seen.select("k", "own", "edited", "next", "fits_edited", "fits_next"), "k", "own", ["edited", "next"], ["fits_edited", "fits_next"])
    n_of = lambda tag, name: F.sum(F.when(F.col("tag") == tag, F.col("n_added") + F.col("n_removed"))).alias(name)
    apart = ws.save(apart.groupBy("k").agg(n_of(0, "_edited"), n_of(1, "_next")), "apart")
    ws.keep(apart)

    def told(some: DataFrame) -> DataFrame:
        of = lambda column, tag: F.transform(column, lambda p: F.struct(F.lit(tag).alias("tag"), p.alias("key"), F.lit(1).alias("sign")))
        sets = some.select("k", F.inline(F.concat(of("own", 0), of("edited", 1))))
        spelled = sketch(sets, ["k", "tag"]).groupBy("k", "tag").agg(_spelled().alias("f"))
        marks = spelled.groupBy("k").agg(*[F.max(F.when(F.col("tag") == t, F.col("f"))).alias(c) for t, c in ((0, "fingerprint"), (1, "edited_fingerprint"))])
        n, m, o = F.size("own"), F.size("edited"), F.size("next")
        out = some.join(marks, "k", "left").join(apart, "k", "left").na.fill(0, ["_edited", "_next"]).na.fill("", ["fingerprint", "edited_fingerprint"])
        return out.select(
            id_col, "copies", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(n, m, F.col("_edited")).alias("near_edited"),
            likeness(n, o, F.col("_next")).alias("near_next"), n.cast("long").alias("n_paragraphs"), F.col("_edited").alias("n_differing"),
        )

    return with_copies(told(seen.filter("copies = 1")).unionByName(told(seen.filter("copies > 1"))), id_col)
