"""What grows with the tables: how operators join, and what they look at more than once."""

import random
import statistics
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quirelab.functions import text as X
from quirelab.operators import block_ops as B
from quirelab.operators import display_ops as D
from quirelab.operators import layout_ops as L
from quirelab.operators import page_ops as P
from quirelab.plans import block_queries as Q4
from quirelab.plans import detail_queries as X3
from quirelab.plans import display_queries as Q
from quirelab.plans import text_queries as X2
from quirelab.sources.store import written


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_written_tables_are_not_broadcast(spark):
    one = written(spark.range(1000).select(F.lit(1).alias("k"), "id"))  # a few KB on disk
    assert "Broadcast" not in plan(one.groupBy("k").agg(F.max("id").alias("m")).join(spark.range(10).withColumnRenamed("id", "k"), "k"))
    assert one.count() == 1000


def test_join_lines_looks_at_its_lines_once(spark):
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.col("id")), lambda i: F.concat(F.lit("exam-\nple"), i.cast("string"))), "\n")
    df = spark.range(20_000, 20_001).select(F.length(X.join_lines(F.split(text, "\n", -1))).alias("n"))  # 40,000 lines; once for each of them takes minutes
    began = time.time()
    assert df.first()["n"] == sum(len(f"example{i}") for i in range(1, 20_001)) + 19_999
    assert time.time() - began < 20


def test_lines_made_ready_for_display_stay_in_their_rows(spark, sf):
    for query in (Q.prepared_lines, Q.text_segments, Q.visual_lines):
        assert "Exchange" not in plan(query(spark, sf)) and "Window" not in plan(query(spark, sf))


def test_visual_order_of_a_long_line(spark):
    n = 30_000
    segs = spark.range(n).select(F.lit(1).alias("id"), F.col("id").alias("seg_no"), F.when(F.col("id") % 2 == 1, "N").when(F.col("id") % 4 == 0, "R").otherwise("L").alias("strong"))
    began = time.time()
    got = D.visual_order(segs, ["id"], F.lit(True)).orderBy("visual_no").select("seg_no", "level").collect()
    assert [r["seg_no"] for r in got] == list(range(n - 1, -1, -1)) and {(r["seg_no"] % 4, r["level"]) for r in got} == {(0, 1), (1, 1), (2, 2), (3, 1)}
    assert time.time() - began < 20


def test_pieces_are_dealt_by_page_once(spark, sf):
    for query in (X2.layout_rows, X2.layout_fragments):
        assert plan(query(spark, sf)).split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1


def test_rows_of_mixed_heights_are_those_of_a_loop(spark):
    """Pieces of one height that follow each other are placed as one; rows and their fragments are those of a loop over single pieces."""
    pieces = [(n, "abc"[: n % 3 + 1], float(n * 37 % 200), 100.0 + n * n % 9 * 4, 9.0 + n % 4, (8.0, 8.0, 12.0, 20.0)[n // 5 % 4], n % 2 == 0) for n in range(60)]
    rows = []
    for n, _, _, y, _, fs, _ in sorted(pieces, key=lambda p: ((p[3] - L.ASCENT * p[5] + p[3] + L.DESCENT * p[5]) / 2, p[0])):
        top, bottom = y - L.ASCENT * fs, y + L.DESCENT * fs
        home = next((r for r in rows[: -L.LOOK_BACK - 1 : -1] if max(0, min(bottom, r[1]) - max(top, r[0])) >= 0.5 * min(bottom - top, r[1] - r[0])), None)
        if home is None:
            rows.append([top, bottom, fs, [n]])
        else:
            home[3].append(n)
            if fs > home[2] * 1.05:
                home[:3] = top, bottom, fs
    df = spark.createDataFrame([(1, 1, pieces)], "doc_id long, page_no int, pieces array<struct<piece_no:long,str:string,x:double,y:double,w:double,fs:double,bold:boolean>>")
    got = {r["row_no"]: [p["piece_no"] for p in r["pieces"]] for r in L.rows_of(df).collect()}
    assert got == {i: sorted(r[3], key=lambda n: (pieces[n][2], n)) for i, r in enumerate(rows)} and len({len(r[3]) for r in rows}) > 2
    frags = L.fragments(L.rows_of(df)).orderBy("row_no", "frag_no").collect()
    for i, numbers in got.items():
        cut, end, last = [], None, None
        for n in numbers:
            _, s, x, _, w, fs, _ = pieces[n]
            size = min(fs, last or fs)
            if end is None or x - end > L.GAP * size:
                cut.append(s)
            else:
                cut[-1] += " " * (x - end > L.SCRIPT_GAP * size) + s
            end, last = max(end if end is not None else x + w, x + w), fs
        assert [f["text"] for f in frags if f["row_no"] == i] == cut and [f["frag_no"] for f in frags if f["row_no"] == i] == list(range(len(cut)))


def test_pieces_of_a_page_stay_in_one_row(spark, sf):
    """Rows of pieces would be sorted by page or row, and spilled where a task has many."""
    for query in (X2.layout_rows, X2.layout_fragments):
        assert "Window" not in plan(query(spark, sf)) and "Sort" not in plan(query(spark, sf))


def test_distinct_pieces_of_a_page(spark, sf):
    """The first of each text and rounded place stays, as in dedup_pieces(); the query sorts no rows of pieces."""
    pieces = [(9, "a", 1.4, 2.0), (3, "a", 0.6, 2.4), (4, "b", 1.0, 2.0), (5, "a", 1.5, 2.0), (6, None, 1.0, 2.0), (7, None, 1.2, 2.0)]
    df = spark.createDataFrame([(1, 1, pieces)], "doc_id long, page_no int, pieces array<struct<piece_no:long,str:string,x:double,y:double>>")
    got = df.select(F.inline(P.distinct_pieces(F.col("pieces"))))
    want = P.dedup_pieces(df.select("doc_id", "page_no", F.inline("pieces"))).drop("doc_id", "page_no")
    assert sorted(r["piece_no"] for r in got.collect()) == [3, 4, 5, 6] and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert "Window" not in plan(X3.distinct_pieces(spark, sf)) and "Sort" not in plan(X3.distinct_pieces(spark, sf))


def test_tables_of_a_page_are_found_in_one_row(spark, sf):
    """Pages are dealt once, as texts; rows of fragments are neither sorted nor joined, and tables are looked for once."""
    for query in (Q4.table_zones, Q4.table_columns, Q4.table_cells):
        shown = plan(query(spark, sf)).split("== Initial Plan ==")[-1]
        assert shown.count("Exchange hashpartitioning") == 1 and not any(step in shown for step in ("Window", "Sort", "Join"))
        assert shown.count("_found_tables(") == 1


def tables_of_a_loop(rows, width):
    """The tables of a region of rows (fragments (x0, x1, n_chars), top, bottom, size): every end of a session is tried at every whole x, as in the SQL."""
    sessions, before = [], None
    for r, (frags, top, bottom, size) in enumerate(rows):
        fits = len(frags) >= 2 or max(f[1] for f in frags) - min(f[0] for f in frags) < B.LABEL * width
        if fits and before and top - before[0] <= B.ZONE_GAP * max(size, before[1]):
            sessions[-1].append(r)
        elif fits:
            sessions.append([r])
        before = (bottom, size) if fits else None
    out = []
    for session in sessions:
        strong = [r for r in session if len(rows[r][0]) >= 2]
        for first in strong[:-1]:
            part = [rows[r] for r in range(first, strong[-1] + 1)]
            allowed, gap = int(len(part) * B.CROSSING), max(2.0, 0.5 * statistics.median(p[3] for p in part))
            cover = [x for frags, *_ in part for x in {x for a, b, _ in frags for x in range(int(a // 1), int(-(-b // 1)) + 1)}]
            cols = []
            for x in sorted({x for x in cover if cover.count(x) > allowed}):
                if cols and x - cols[-1][1] - 1 < gap:
                    cols[-1][1] = x
                else:
                    cols.append([x, x])
            cols = [(float(a), float(b + (c < len(cols) - 1))) for c, (a, b) in enumerate(cols)]
            share = lambda f, c: max(0.0, min(f[1], c[1]) - max(f[0], c[0]))
            inner = [[f for frags, *_ in part for f in frags if share(f, c) > 0.5 * (f[1] - f[0])] for c in cols]
            mean = [sum(f[1] - f[0] for f in i) / len(i) if i else 0.0 for i in inner]
            filled = sum(any(share(f, c) > 0 for f in p[0]) for p in part for c in cols)
            n_strong = sum(len(p[0]) >= 2 for p in part)
            if len(cols) < 2 or not (n_strong >= 3 or (n_strong >= 2 and len(cols) >= 3)):
                continue
            short = sum(f[2] <= 4 for f in inner[0]) >= 0.7 * len(inner[0])
            text = len(cols) == 2 and mean[1] > 0.3 * width and (mean[0] > 0.3 * width or short)
            if not text and max(mean) <= 0.6 * width and filled / (len(part) * len(cols)) >= 0.3:
                out.append((first, strong[-1], cols))
                break
    return out


@pytest.mark.parametrize("edges", [1, 60, 1 << 20])
def test_tables_are_those_of_a_loop(monkeypatch, edges):
    """However many ends of sessions are looked at together; regions without fragments or tables have none."""
    monkeypatch.setattr(B, "EDGES", edges)
    rng, regions = random.Random(3), [[]]
    for _ in range(150):
        at, y, rows = [rng.choice((0, 4, 60, 61, 150, 151.5, 290)) for _ in range(3)], 0.0, []
        for _ in range(rng.randrange(1, 12)):
            size = rng.choice((10.0, 10.0, 16.0))
            y += rng.choice((12, 12, 20, 60))
            frags = [(float(a), a + rng.choice((0.5, 3.0, 40.0, 80.0, 145.5, 250.0)), rng.choice((2, 9))) for a in rng.sample(at, rng.randrange(1, 4))]
            rows.append((frags, y - 8, y + 2, size))
        regions.append(rows)
    flat = lambda value: pa.array([[value(r, i, f) for i, r in enumerate(rows) for f in r[0]] for rows in regions])
    row_no, n_chars, x0, x1 = flat(lambda r, i, f: i), flat(lambda r, i, f: f[2]), flat(lambda r, i, f: f[0]), flat(lambda r, i, f: f[1])
    got = B._found_tables(row_no, n_chars, x0, x1, flat(lambda r, i, f: r[1]), flat(lambda r, i, f: r[2]), flat(lambda r, i, f: r[3]), pa.array([300.0] * len(regions))).to_pylist()
    want = [tables_of_a_loop(rows, 300.0) for rows in regions]
    assert [[(t["first_row"], t["last_row"], [(c["x0"], c["x1"]) for c in t["cols"]]) for t in tables] for tables in got] == want
    assert sum(map(len, want)) > 20 and any(first > 0 for tables in want for first, *_ in tables)
    assert B._found_tables(*[a.slice(0, 1) for a in (row_no, n_chars, x0, x1, x0, x1, x0)], pa.array([300.0])).to_pylist() == [[]]
