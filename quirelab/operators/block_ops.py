"""Columns, tables and paragraphs of pages, from fragments of rows: windows, events, and folds over the rows of one region.

Fragments are (by, row_no, frag_no, text, n_chars, x0, x1, top, bottom, base, size, bold); `by` names the region, a page or a part of one, so whatever
comes together in one task is bounded by a page. Operators of several steps write their input and a few small tables in between, so that no step is computed twice.
Tables are found and read from regions with their fragments in one row (by, frags), so that rows of fragments are not sorted, joined or written.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelab.functions.geometry import centred
from quirelab.functions.text import bound, join_lines, list_kind
from quirelab.operators.layout_ops import stretches
from quirelab.sources.store import written

# Fixed values. Rows of a zone lie within 2.5 sizes; a single fragment under 0.45 of the width is a label between cells; 12 percent of a zone's rows may cross a gap.
ZONE_GAP, LABEL, CROSSING = 2.5, 0.45, 0.12
EDGES = 1 << 20
TABLES = "array<struct<first_row:{0},last_row:{0},cols:array<struct<x0:double,x1:double>>>>"
SENTENCE_END = "[.!?:][\"')\\]]?$"


def _overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def _nth(value: Column, p: float, by: list[str]) -> Column:
    """The percentile of a region's values by nearest rank; nulls don't count. One order of the region serves all its rows, none of which sorts anything."""
    region = Window.partitionBy(*by)
    place = F.row_number().over(region.orderBy(value.asc_nulls_last()))
    return F.max(F.when(place == F.floor(F.lit(p) * (F.count(value).over(region) - 1) + 0.5) + 1, value)).over(region)


def with_rows(frags: DataFrame, by: list[str]) -> DataFrame:
    """Fragments with row_no for regions in which rows share their base line."""
    return frags.withColumn("row_no", F.dense_rank().over(Window.partitionBy(*by).orderBy("base")) - 1)


def rows_of_region(frags: DataFrame, by: list[str]) -> DataFrame:
    """(by, row_no, n_frags, x0, x1, top, bottom, base, size, n_chars, bold, text): base line and size of the first of the largest fragments."""
    main = F.struct("size", -F.col("x0"), -F.col("frag_no"))
    parts = F.sort_array(F.collect_list(F.struct("x0", "frag_no", "text")))
    return frags.groupBy(*by, "row_no").agg(
        F.count(F.lit(1)).alias("n_frags"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.max_by("base", main).alias("base"), F.max("size").alias("size"),
        F.sum("n_chars").alias("n_chars"), (F.sum(F.when(F.col("bold"), F.col("n_chars")).otherwise(0)) > 0.9 * F.sum("n_chars")).alias("bold"), F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"),
    )


# ---- columns of a page


def gutters(frags: DataFrame, by: list[str], nested: bool = False) -> DataFrame:
    """(by, gutter): where the columns of each region part; regions of one column are left out.

    A sweep over where fragments begin and end gives the number that cross each x in the middle 60 percent. Stretches of 4 and more that fewer cross than on either side
    are candidates. On both sides there must be running text that fills its column, or, unless nested, on one side, beside labels of a figure. The best has most full
    lines on its weaker side (twice), on the other, and fewest that cross; of equal ones the first.
    """
    shown = written(frags.filter("n_chars >= 2").select(*by, "x0", "x1"))
    box = shown.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("x0").alias("l"), F.max("x1").alias("r")).filter("n >= 10 AND r - l >= 150")
    box = box.withColumn("from", F.ceil(F.col("l") + 0.2 * (F.col("r") - F.col("l")))).withColumn("to", F.floor(F.col("l") + 0.8 * (F.col("r") - F.col("l"))))
    within = shown.join(box, by)
    first, last = F.floor(F.col("x0") + 1) + 1, F.ceil(F.col("x1") - 1) - 1  # whole x that a fragment crosses
    steps = F.array(F.struct(F.greatest("first", "from").alias("x"), F.lit(1).alias("d")), F.struct((F.least("last", "to") + 1).alias("x"), F.lit(-1).alias("d")))
    events = within.withColumn("first", first).withColumn("last", last).filter("first <= last AND first <= to AND last >= from").select(*by, "from", "to", F.inline(steps))
    ends = box.select(*by, "from", "to", F.inline(F.array(F.struct(F.col("from").alias("x"), F.lit(0).alias("d")))))
    region = Window.partitionBy(*by).orderBy("x")
    profile = events.unionByName(ends).filter("x <= to").groupBy(*by, "to", "x").agg(F.sum("d").alias("d")).withColumn("cross", F.sum("d").over(region))
    profile = profile.withColumn("_was", F.lag("cross").over(region)).filter("_was IS NULL OR _was <> cross")
    runs = profile.withColumn("x1", F.coalesce(F.lead("x").over(region) - 1, F.col("to"))).withColumn("before", F.lag("cross").over(region)).withColumn("after", F.lead("cross").over(region))
    runs = runs.filter("x1 - x >= 4 AND coalesce(before, cross) >= cross AND coalesce(after, cross) >= cross").select(*by, "cross", ((F.col("x") + F.col("x1")) / 2).alias("g"))
    left, right = F.col("x1") <= F.col("g") + 3, F.col("x0") >= F.col("g") - 3
    wide = F.col("x1") - F.col("x0")
    sides = within.join(runs, by).groupBy(*by, "g", "cross").agg(
        F.count_if(left).alias("nl"), F.count_if(right).alias("nr"), F.count_if(left & (wide >= 0.7 * (F.col("g") - F.col("l")))).alias("fl"), F.count_if(right & (wide >= 0.7 * (F.col("r") - F.col("g")))).alias("fr")
    )
    text = F.expr("fl >= 4 AND fr >= 4 AND fl + fr >= 0.15D * (nl + nr)")
    beside = F.lit(False) if nested else F.expr("(fl >= 0.4D * nl AND fl >= 8) OR (fr >= 0.4D * nr AND fr >= 8)")
    good = sides.filter(F.expr("nl >= 6 AND nr >= 6 AND cross <= 2 * (fl + fr)") & (text | beside)).withColumn("score", F.expr("2 * least(fl, fr) + greatest(fl, fr) - cross"))
    return good.groupBy(*by).agg(F.max_by("g", F.struct("score", -F.col("g"))).alias("gutter"))


def _split_once(items: DataFrame, by: list[str], level: int) -> DataFrame:
    """Items with the key of the part of their region that they go to: bands across the gutter, and columns between these, left first. Regions without a gutter stay whole."""
    items = written(items)
    cut = written(gutters(items.filter("n_chars IS NOT NULL"), by, nested=level > 0))
    r, order = Window.partitionBy(*by), ["top", "frag_no"]
    items = items.join(cut, by, "left")
    g, mid = F.col("gutter"), (F.col("x0") + F.col("x1")) / 2
    items = items.withColumn("_span", F.coalesce((F.col("x0") < g - 3) & (F.col("x1") > g + 3), F.lit(True))).withColumn("_left", mid < g)
    ordered = r.orderBy(*order)
    items = items.withColumn("_band", F.sum(F.when(F.lag("_span").over(ordered) == F.col("_span"), 0).otherwise(1)).over(ordered))
    band = Window.partitionBy(*by, "_band")
    side = lambda is_left, f, c: f(F.when(F.col("_left") if is_left else ~F.col("_left"), F.col(c))).over(band)
    lt, lb, rt, rb = side(True, F.min, "top"), side(True, F.max, "bottom"), side(False, F.min, "top"), side(False, F.max, "bottom")
    real = ~F.col("_span") & lt.isNotNull() & rt.isNotNull() & (_overlap(lt, lb, rt, rb) >= 0.3 * F.least(lb - lt, rb - rt))
    items = items.withColumn("_cols", real).withColumn("_rt", rt)
    # lines of the left side above all of the right one go on with what is above, if that runs across
    early = F.col("_cols") & F.col("_left") & (F.col("bottom") <= F.col("_rt") + 1)
    items = items.withColumn("_late", F.sum(F.when(early, 0).otherwise(1)).over(band.orderBy(*order)))
    across = F.max(F.when(~F.col("_cols"), F.col("_band"))).over(r.orderBy("_band").rangeBetween(-1, -1)).isNotNull()
    items = items.withColumn("_cols", F.col("_cols") & ~((F.col("_late") == 0) & across))
    items = items.withColumn("_flow", F.sum(F.when(F.lag("_cols").over(ordered) == F.col("_cols"), 0).otherwise(1)).over(ordered))
    edge = lambda is_left, c, p: _nth(F.when((F.col("n_chars").isNotNull()) & ((F.col("x1") <= g + 3) if is_left else (F.col("x0") >= g - 3)), F.col(c)), p, by)
    items = items.withColumn("_le", F.coalesce(edge(True, "x1", 0.9), g)).withColumn("_re", F.coalesce(edge(False, "x0", 0.1), g))
    part = F.when(~F.col("_cols"), F.col("_flow") * 2).otherwise(F.col("_flow") * 2 + F.when(F.col("_left"), 0).otherwise(1))
    lead = F.when(F.col("_cols") & ~F.col("_left"), F.col("_re")).otherwise(F.col("left"))
    end = F.when(F.col("_cols") & F.col("_left"), F.col("_le")).otherwise(F.col("right"))
    items = items.withColumn(f"part{level}", F.when(g.isNull(), 0).otherwise(part).cast("int")).withColumn("left", lead).withColumn("right", end)
    return items.withColumn(f"cut{level}", g.isNotNull()).withColumn("_open", F.col("_cols")).drop("gutter", *[c for c in items.columns if c.startswith("_")])


def split_regions(items: DataFrame, by: list[str]) -> DataFrame:
    """Items (by, frag_no, n_chars, x0, x1, top, bottom, left, right; n_chars null for images) with the region of their page that they are read in, region_no in order,
    its bounds left and right, and the page's number of columns, at most 3.

    Two rounds: a page is cut at its gutter into bands and columns, and so is each column once more. Bands that run across are read as they are.
    """
    once = written(_split_once(items, by, 0))
    again = _split_once(once.filter("_open").drop("_open"), [*by, "part0"], 1).drop("_open")
    whole = once.filter("NOT _open").drop("_open").withColumn("part1", F.lit(0)).withColumn("cut1", F.lit(False))
    page = Window.partitionBy(*by)
    out = whole.unionByName(again).withColumn("region_no", F.dense_rank().over(page.orderBy("part0", "part1")) - 1)
    columns = F.max(F.when(F.col("cut1"), 3).when(F.col("cut0"), 2).otherwise(1)).over(page)
    return out.withColumn("columns", columns).drop("part0", "part1", "cut0", "cut1")


# ---- tables


def numbered_rows(frags: Column) -> Column:
    """Fragments of a region, an array, with row_no: fragments that share their base line are a row, as in with_rows()."""
    fields = ("frag_no", "text", "n_chars", "x0", "x1", "top", "bottom", "base", "size", "bold")
    numbered = lambda bases: F.transform(frags, lambda f: F.struct((F.array_position(bases, f["base"]) - 1).cast("int").alias("row_no"), *[f[c].alias(c) for c in fields]))
    return bound(F.array_sort(F.array_distinct(F.transform(frags, lambda f: f["base"]))), numbered)


def _in_regions(frags: DataFrame, by: list[str], *fields: str) -> DataFrame:
    """(by, frags): the fragments of a region in one row. Regions without a key go."""
    return frags.na.drop(subset=by).groupBy(*by).agg(F.collect_list(F.struct(*fields)).alias("frags"))


def _medians_from(values: np.ndarray) -> np.ndarray:
    """The median of the values from each one on."""
    if (values == values[0]).all():
        return values
    seen, out = [], np.empty(len(values))
    for i in range(len(values) - 1, -1, -1):
        insort(seen, float(values[i]))
        out[i] = (seen[len(seen) // 2] + seen[(len(seen) - 1) // 2]) / 2
    return out


def _ranges(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from first[i] on, count[i] of them, for each i in turn, and the i that each belongs to."""
    return np.repeat(np.arange(len(count)), count), np.arange(count.sum()) + np.repeat(first - np.cumsum(count) + count, count)


def _turns(*keys: np.ndarray) -> np.ndarray:
    """Where an item begins that differs in some key from the one before it."""
    fresh = np.ones(len(keys[0]), bool)
    fresh[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return fresh


class _Sessions(NamedTuple):
    """Sessions of rows, each from row `first` to row `last`, over flat arrays: fragments row by row, rows (where their fragments begin and end, median size from each on to its
    session's end, several fragments or not), and where rows begin and end to cover an x, by x in each session."""

    x0: np.ndarray
    x1: np.ndarray
    n_chars: np.ndarray
    row: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    middle: np.ndarray
    strong: np.ndarray
    first: np.ndarray
    last: np.ndarray
    width: np.ndarray
    edge: np.ndarray
    step: np.ndarray
    edge_row: np.ndarray
    n_edges: np.ndarray


def _edges(session: np.ndarray, row: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, +1 or -1, row): where rows begin and end to be covered by their fragments, each x once, by x in each session."""
    x, d = np.concatenate((np.floor(x0), np.ceil(x1) + 1)), np.repeat([1, -1], len(x0))
    session, row = np.tile(session, 2), np.tile(row, 2)
    order = np.lexsort((d, x, row))
    order = order[np.cumsum(d[order]) == (d[order] > 0)]  # a row's first begin and last end of each stretch
    order = order[np.lexsort((x[order], session[order]))]
    return x[order], d[order], row[order]


def _accepted(s: _Sessions, at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(good, of, c0, c1): whether the ends of sessions `at`, from rows `first` on, are tables, and the columns of these ends.

    Where more than CROSSING of an end's rows cover an x is a column, up to a gap of half their median size, 2 at least. An end is no table if it is running text side by side,
    a list of markers, long texts, or a grid next to empty.
    """
    last, width = s.last[at], s.width[at]
    n_rows, strong = last - first + 1, np.append(0, np.cumsum(s.strong))
    n_strong, allowed, least = strong[last + 1] - strong[first], np.floor(n_rows * CROSSING), np.maximum(2.0, 0.5 * s.middle[first])
    of, i = _ranges((np.cumsum(s.n_edges) - s.n_edges)[at], s.n_edges[at])
    own = s.edge_row[i] >= first[of]
    of, i = of[own], i[own]
    x, cover = s.edge[i], np.cumsum(s.step[i])  # rows that begin also end, so the next end starts from 0
    busy = np.flatnonzero((cover[:-1] > allowed[of[:-1]]) & (x[1:] > x[:-1]))
    of, c0, c1 = of[busy], x[busy], x[busy + 1]
    fresh = _turns(of)
    fresh[1:] |= c0[1:] - c1[:-1] >= least[of[1:]]
    begin = np.flatnonzero(fresh)
    of, c0, c1 = of[begin], c0[begin], c1[np.append(begin[1:], len(busy))[: len(begin)] - 1]
    c1 = c1 - np.append(_turns(of)[1:], True)[: len(of)]  # inner columns end where their gap begins, the last one where it ends
    n_cols = np.bincount(of, minlength=len(at))
    good = (n_cols >= 2) & ((n_strong >= 3) | ((n_strong >= 2) & (n_cols >= 3)))
    of, c0, c1 = of[good[of]], c0[good[of]], c1[good[of]]
    col, k = _ranges(s.starts[first[of]], s.ends[last[of]] - s.starts[first[of]])
    w, share = s.x1[k] - s.x0[k], np.maximum(0.0, np.minimum(s.x1[k], c1[col]) - np.maximum(s.x0[k], c0[col]))
    inner, met = share > 0.5 * w, np.flatnonzero(share > 0)
    sums = lambda which, values=None: np.bincount(col[which], values, minlength=len(of))
    n, short = sums(inner), sums(inner & (s.n_chars[k] <= 4))
    mean, filled = sums(inner, w[inner]) / np.maximum(n, 1), sums(met[_turns(col[met], s.row[k[met]])])
    c = np.flatnonzero(_turns(of))
    which = of[c]
    wide = 0.3 * width[which]
    text = (n_cols[which] == 2) & (mean[c + 1] > wide) & ((mean[c] > wide) | (short[c] >= 0.7 * n[c]))
    good[which] = ~text & (_each(np.maximum, mean, c) <= 0.6 * width[which]) & (_each(np.add, filled, c) / (n_rows[which] * n_cols[which]) >= 0.3)
    return good, of, c0, c1


def _each(fold: np.ufunc, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return fold.reduceat(values, starts) if len(starts) else values[:0]


def _found_tables(row_no: pa.Array, n_chars: pa.Array, x0: pa.Array, x1: pa.Array, top: pa.Array, bottom: pa.Array, size: pa.Array, width: pa.Array) -> pa.Array:
    """Tables of regions, whose fragments are arrays side by side. Whole sessions are tried first, then the ends of those that fail, as many at once as EDGES allows."""
    length, kind = row_no.value_lengths().to_numpy(zero_copy_only=False), row_no.type.value_type
    region = np.repeat(np.arange(len(length)), length)
    row_no, n_chars, x0, x1, top, bottom, size = (c.flatten().to_numpy(zero_copy_only=False) for c in (row_no, n_chars, x0, x1, top, bottom, size))
    order, width = np.lexsort((row_no, region)), width.to_numpy(zero_copy_only=False)
    region, row_no, n_chars, x0, x1, top, bottom, size = (c[order] for c in (region, row_no, n_chars, x0, x1, top, bottom, size))
    starts = np.flatnonzero(_turns(region, row_no))
    ends, of, row_no = np.append(starts[1:], len(region))[: len(starts)], region[starts], row_no[starts]
    n_frags, size, top, bottom = ends - starts, _each(np.maximum, size, starts), _each(np.minimum, top, starts), _each(np.maximum, bottom, starts)
    strong = n_frags >= 2
    fits = strong | (_each(np.maximum, x1, starts) - _each(np.minimum, x0, starts) < LABEL * width[of])
    fresh = _turns(of)
    fresh[1:] |= ~(fits[1:] & fits[:-1] & (top[1:] - bottom[:-1] <= ZONE_GAP * np.maximum(size[1:], size[:-1])))
    rows = np.flatnonzero(strong)
    turn = _turns(np.cumsum(fresh)[rows])
    first, last = rows[turn], rows[np.append(turn[1:], True)[: len(rows)]]
    first, last = first[first < last], last[first < last]

    middle, turns = size.copy(), np.cumsum(_turns(size))
    for f, g in zip(first, last):
        if turns[f] != turns[g]:
            middle[f : g + 1] = _medians_from(size[f : g + 1])
    session, i = _ranges(starts[first], ends[last] - starts[first])
    row = np.repeat(np.arange(len(starts)), n_frags)
    edge, step, edge_row = _edges(session, row[i], x0[i], x1[i])
    n_edges = np.bincount(np.searchsorted(first, edge_row, "right") - 1, minlength=len(first))
    s = _Sessions(x0, x1, n_chars, row, starts, ends, middle, strong, first, last, width[of[first]], edge, step, edge_row, n_edges)

    good, cut, c0, c1 = _accepted(s, np.arange(len(first)), first)
    at, head, parts = [np.flatnonzero(good)], [first[good]], [(c0[good[cut]], c1[good[cut]], np.bincount(cut, minlength=len(first))[good])]
    failed = np.flatnonzero(~good)
    left, r = _ranges(first[failed] + 1, last[failed] - first[failed] - 1)
    left, r = failed[left[strong[r]]], r[strong[r]]
    blocks = np.flatnonzero(_turns(np.cumsum(n_edges[left]) // EDGES))
    for b, e in zip(blocks, np.append(blocks[1:], len(left))):
        good, cut, c0, c1 = _accepted(s, left[b:e], r[b:e])
        won = np.flatnonzero(good)
        won = won[_turns(left[b:e][won]) & ~np.isin(left[b:e][won], np.concatenate(at))]
        mine = np.isin(cut, won)
        at, head, parts = [*at, left[b:e][won]], [*head, r[b:e][won]], [*parts, (c0[mine], c1[mine], np.bincount(cut, minlength=e - b)[won])]

    at, head = np.concatenate(at), np.concatenate(head)
    c0, c1, n_cols = map(np.concatenate, zip(*parts))
    order = np.argsort(at)
    _, i = _ranges((np.cumsum(n_cols) - n_cols)[order], n_cols[order])
    at, head = at[order], head[order]
    listed = lambda lengths, **fields: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), pa.StructArray.from_arrays(list(fields.values()), list(fields)))
    cols = listed(n_cols[order], x0=pa.array(c0[i]), x1=pa.array(c1[i]))
    return listed(np.bincount(of[first[at]], minlength=len(length)), first_row=pa.array(row_no[head], kind), last_row=pa.array(row_no[last[at]], kind), cols=cols)


def with_tables(regions: DataFrame, left: Column, right: Column) -> DataFrame:
    """Regions (by, frags) with `tables`, an array of (first_row, last_row, cols): the tables of each region, between its bounds, with their columns (x0, x1) from the left.

    Rows of several fragments, and short labels between them, that follow each other closely are a session, from its first such row to its last. A session is a table, or
    the longest of its ends that is one, if it passes the tests of _accepted().
    """
    width = F.greatest(F.lit(50.0), right - left).cast("double")
    kind = regions.schema["frags"].dataType.elementType["row_no"].dataType.simpleString()
    return regions.withColumn("tables", F.arrow_udf(_found_tables, TABLES.format(kind))(*[f"frags.{c}" for c in ("row_no", "n_chars", "x0", "x1", "top", "bottom", "size")], width))


def rows_of_tables(row: Callable[[Column], Column]) -> Column:
    """A row for each of a region's `tables`. Inlined as they are, Spark would filter regions by how many tables they have, and look for these twice."""
    return F.inline(F.transform("tables", row))


def table_zones(frags: DataFrame, by: list[str], left: Column, right: Column) -> DataFrame:
    """(by, first_row, last_row, cols): the tables of each region as rows; see with_tables()."""
    regions = _in_regions(frags, by, "row_no", "n_chars", "x0", "x1", "top", "bottom", "size")  # no texts
    return with_tables(regions, left, right).select(*by, rows_of_tables(lambda t: F.struct(*[t[c].alias(c) for c in ("first_row", "last_row", "cols")])))


def cells_of(regions: DataFrame, by: list[str]) -> DataFrame:
    """(by, first_row, table_row, col_no, text, width): the filled cells of the tables of regions (by, frags, tables), and how wide their columns are.

    A fragment goes to the column that holds most of it, of equal ones the first. A row as close as lines of a text continues the row above where the table's rows are
    otherwise spaced out, or where it is a single fragment, if each of its cells is filled there: a fold over the rows, whose state is the row that is being continued.
    A table's fragments stay in one row from there to its cells.
    """

    def placed(f: Column, cols: Column) -> Column:
        share = lambda c, i: F.struct(_overlap(f["x0"], f["x1"], c["x0"], c["x1"]).alias("o"), (-i).alias("i"))
        col_no = (-F.array_max(F.transform(cols, share))["i"]).cast("bigint")
        return F.struct(f["row_no"].alias("row_no"), f["x0"].alias("x0"), f["frag_no"].alias("frag_no"), f["text"].alias("text"), f["base"].alias("base"), f["size"].alias("size"), col_no.alias("col_no"))

    def row(frags: Column) -> Column:
        main = F.array_max(F.transform(frags, lambda f: F.struct(f["size"].alias("size"), (-f["x0"]).alias("x"), (-f["frag_no"]).alias("no"), f["base"].alias("base"))))
        cells = F.transform(frags, lambda f: F.struct(f["col_no"].alias("col_no"), f["text"].alias("text")))
        return F.struct(main["size"].alias("size"), main["base"].alias("base"), F.array_distinct(F.transform(frags, lambda f: f["col_no"])).alias("cols"), cells.alias("cells"))

    inside = lambda t: F.sort_array(F.transform(F.filter("frags", lambda f: f["row_no"].between(t["first_row"], t["last_row"])), lambda f: placed(f, t["cols"])))
    rows = lambda t: bound(inside(t), lambda frags: F.transform(stretches(frags, lambda before, f: before["row_no"] == f["row_no"]), row))
    tables = regions.select(*by, rows_of_tables(lambda t: F.struct(t["first_row"].alias("first_row"), t["cols"].alias("cols"), rows(t).alias("rows"))))

    pitch = F.transform("rows", lambda r, i: (r["base"] - F.get("rows", i - 1)["base"]) / r["size"])
    middle = lambda p: (F.get(p, F.floor((F.size(p) - 1) / 2).cast("int")) + F.get(p, F.floor(F.size(p) / 2).cast("int"))) / 2
    loose = bound(F.sort_array(F.filter("pitch", lambda p: p.isNotNull())), middle) >= 1.45
    tables = tables.withColumn("pitch", pitch).withColumn("loose", loose)

    def take(s: Column, r: Column, i: Column) -> Column:
        close = F.coalesce((F.get("pitch", i) <= 1.3) & (F.col("loose") | (F.size(r["cells"]) == 1)), F.lit(False))
        goes_on = close & (F.size(F.array_except(r["cols"], s["cols"])) == 0)
        return bound(goes_on, lambda more: F.struct(F.when(more, s["cols"]).otherwise(r["cols"]).alias("cols"), F.array_append(s["out"], more).alias("out")))

    start = F.struct(F.array().cast("array<bigint>").alias("cols"), F.array().cast("array<boolean>").alias("out"))
    each = F.transform("rows", lambda r, i: F.struct(i.alias("i"), r.alias("row")))
    more = F.aggregate(each, start, lambda s, r: take(s, r["row"], r["i"]), lambda s: s["out"])
    said = bound(more, lambda m: F.transform("rows", lambda r, i: F.struct(F.get(m, i).alias("more"), r["cells"].alias("cells"))))
    wrapped = tables.select(*by, "first_row", "cols", F.posexplode(bound(said, lambda rows: stretches(rows, lambda before, r: r["more"]))).alias("table_row", "rows"))

    def add(text: Column, p: Column) -> Column:
        broken = p["more"] & text.rlike("[A-Za-z]-$") & p["text"].rlike("^[a-z]")
        return F.when(text.isNull(), p["text"]).when(broken, F.concat(F.substring(text, F.lit(1), F.char_length(text) - 1), p["text"])).otherwise(F.concat(text, F.lit(" "), p["text"]))

    def cell(parts: Column, i: Column) -> Column:
        text = F.aggregate(F.filter(parts, lambda p: p["col_no"] == i), F.lit(None).cast("string"), add)
        here, after = F.get("cols", i.cast("int")), F.get("cols", (i + 1).cast("int"))
        return F.struct(i.alias("col_no"), text.alias("text"), (F.coalesce(after["x0"], here["x1"]) - here["x0"]).alias("width"))

    parts = F.flatten(F.transform("rows", lambda r: F.transform(r["cells"], lambda c: F.struct(c["col_no"].alias("col_no"), c["text"].alias("text"), r["more"].alias("more")))))
    cells = bound(parts, lambda parts: F.transform(F.array_distinct(F.transform(parts, lambda p: p["col_no"])), lambda i: cell(parts, i)))
    return wrapped.select(*by, "first_row", "table_row", F.inline(cells))


def table_cells(frags: DataFrame, zones: DataFrame, by: list[str]) -> DataFrame:
    """The filled cells of tables (by, first_row, last_row, cols) as in cells_of()."""
    tables = zones.groupBy(*by).agg(F.collect_list(F.struct("first_row", "last_row", "cols")).alias("tables"))
    return cells_of(_in_regions(frags, by, "row_no", "x0", "x1", "frag_no", "text", "base", "size").join(tables, by), by)


# ---- paragraphs


def paragraphs(lines: DataFrame, by: list[str], left: Column, right: Column) -> DataFrame:
    """(by, para_no, first_row, n_lines, text, list, centered, indent) from lines (by, row_no, text, x0, x1, base, size, bold) of regions with bounds.

    Edges of the text, usual spacing and whether it is justified are told from all lines of the region. Then one fold over the lines, whose state is the paragraph so far:
    its list marker, whether it is centred, where it began and its least indent since. A line starts a paragraph if it has a marker, changes size or style, stands off,
    follows a short line or a sentence end by an indent, goes back out past a hanging indent, or changes between centred and not.
    """
    region = Window.partitionBy(*by)
    order = region.orderBy("row_no")
    lag = lambda c: F.lag(c).over(order)
    some = F.count(F.lit(1)).over(region)
    edge = lambda c, p, bound: F.when(some >= 4, _nth(F.col(c), p, by)).otherwise(bound)
    li = lines.withColumn("le", edge("x0", 0.1, left)).withColumn("re", edge("x1", 0.9, right)).withColumn("wide", F.greatest(F.lit(1.0), F.col("re") - F.col("le")))
    li = li.withColumn("just", F.count_if(F.col("x1") >= F.col("re") - 1.5 * F.col("size")).over(region) > 0.5 * some)
    li = li.withColumn("rise", F.col("base") - lag("base")).withColumn("fs0", lag("size")).withColumn("x00", lag("x0")).withColumn("x10", lag("x1")).withColumn("t0", lag("text")).withColumn("b0", lag("bold"))
    usual = (F.abs(F.col("size") - F.col("fs0")) < 0.5) & (F.col("rise") > 0.9 * F.col("size")) & (F.col("rise") < 2.5 * F.col("size"))
    li = li.withColumn("_d", F.when(usual, F.col("rise") / F.col("size")))
    li = li.withColumn("spacing", F.when(F.count("_d").over(region) >= 3, F.percentile("_d", 0.5).over(region)).otherwise(1.25))
    large, ended = F.greatest("size", "fs0"), F.col("t0").rlike(SENTENCE_END)
    gap = (F.col("rise") / large > F.col("spacing") * 1.3 + 0.1) | (F.col("rise") < 0)
    resized = F.abs(F.col("size") - F.col("fs0")) > 0.12 * large
    restyled = (F.col("b0") != F.col("bold")) & ((F.char_length("t0") < 90) | (F.char_length("text") < 90))
    short = F.when(F.col("just"), F.col("x10") < F.col("re") - F.greatest(2 * F.col("fs0"), 0.06 * F.col("wide"))).otherwise((F.col("x10") < F.col("re") - 0.25 * F.col("wide")) & ended)
    indented = (F.col("x0") > F.col("le") + 0.8 * F.col("size")) & (F.col("x0") < F.col("le") + 5 * F.col("size")) & (F.col("x00") < F.col("le") + 0.5 * F.col("size")) & ended
    no = lambda c: F.coalesce(c, F.lit(False))
    li = li.select(
        *by, "row_no", "x0", "size", "text", "le", "wide", list_kind(F.col("text")).alias("list"), centred(F.col("x0"), F.col("x1"), F.col("size"), left, right).alias("mid"), no(gap | resized).alias("off"), no(restyled).alias("restyled"),
        no(short).alias("short"), no(indented).alias("indented"), no(F.col("x10") - F.col("x00") > 0.85 * F.col("wide")).alias("full"), (F.col("x0") > F.col("le") + 0.5 * F.col("size")).alias("hangs"),
    )
    fold = ["row_no", "x0", "size", "list", "mid", "off", "restyled", "short", "indented", "full", "hangs"]
    state = "struct<para:int,list:string,mid:boolean,x0:double,least:double,out:array<struct<row_no:int,para_no:int>>>"

    def take(s: Column, n: Column) -> Column:
        outdent = F.coalesce((n["x0"] < s["least"] - 0.8 * n["size"]) & (s["least"] > s["x0"] + 0.8 * n["size"]), F.lit(False))
        turned = (n["mid"] != s["mid"]) & ~(n["mid"] & ~s["mid"] & n["full"])
        fresh = n["list"].isNotNull() | n["off"] | n["restyled"] | (n["short"] & ~(n["mid"] & s["mid"])) | (n["indented"] & s["list"].isNull()) | outdent | turned
        stays = s["list"].isNotNull() & n["list"].isNull() & ~n["off"] & n["hangs"] & ~n["short"]
        fresh = (s["para"] < 0) | (fresh & ~stays)
        para = F.when(fresh, s["para"] + 1).otherwise(s["para"])
        pick = lambda new, old: F.when(fresh, new).otherwise(old)
        out = F.array_append(s["out"], F.struct(n["row_no"].cast("int").alias("row_no"), para.alias("para_no")))
        return F.struct(
            para.alias("para"), pick(n["list"], s["list"]).alias("list"), pick(n["mid"], s["mid"]).alias("mid"), pick(n["x0"], s["x0"]).alias("x0"),
            pick(F.lit(None).cast("double"), F.least(s["least"], n["x0"])).alias("least"), out.alias("out"),
        ).cast(state)

    start = F.struct(
        F.lit(-1).alias("para"), F.lit(None).cast("string").alias("list"), F.lit(False).alias("mid"), F.lit(None).cast("double").alias("x0"), F.lit(None).cast("double").alias("least"),
        F.array().cast("array<struct<row_no:int,para_no:int>>").alias("out"),
    ).cast(state)
    listed = li.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*fold))).alias("lines"))
    numbered = listed.select(*by, F.inline(F.aggregate("lines", start, take, lambda s: s["out"])))
    paras = li.join(numbered, [*by, "row_no"]).groupBy(*by, "para_no").agg(F.sort_array(F.collect_list(F.struct("row_no", "x0", "size", "list", "mid", "text"))).alias("p"), F.first("le").alias("le"), F.first("wide").alias("wide"))
    head = F.col("p")[0]
    x0 = F.when(F.size("p") > 1, F.array_min(F.transform(F.slice("p", F.lit(2), F.size("p") - 1), lambda q: q["x0"]))).otherwise(head["x0"])
    inset = x0 - F.col("le")
    indent = F.when(~head["mid"] & (inset > 1.5 * head["size"]) & (inset < 0.5 * F.col("wide")), inset)
    return paras.select(
        *by, "para_no", head["row_no"].alias("first_row"), F.size("p").alias("n_lines"), join_lines(F.transform("p", lambda q: q["text"])).alias("text"), head["list"].alias("list"), head["mid"].alias("centered"), indent.alias("indent")
    )


def text_bounds(frags: DataFrame, by: list[str]) -> DataFrame:
    """Fragments with left and right, where their region's text begins and ends but for 2 percent of them."""
    return frags.withColumn("left", _nth(F.col("x0"), 0.02, by)).withColumn("right", _nth(F.col("x1"), 0.98, by))
