"""Columns, tables, paragraphs, display text and what pages show, on small cases made by hand."""

import pytest
from pyspark.sql import functions as F

from quirelab.operators import block_ops as B
from quirelab.operators import content_ops as C
from quirelab.operators import display_ops as D

FRAGMENT = "page int, row_no long, frag_no long, text string, n_chars long, x0 double, x1 double, top double, bottom double, base double, size double, bold boolean"


def fragments(spark, rows):
    """Rows of (text, x0, x1) at a base line each, in 10 points."""
    out = []
    for r, (base, frags) in enumerate(rows):
        out += [(1, r, r * 10 + k, t, len(t), float(a), float(b), base - 8.0, base + 2.2, float(base), 10.0, False) for k, (t, a, b) in enumerate(frags)]
    return spark.createDataFrame(out, FRAGMENT)


def zones(spark, rows, right=500.0):
    frags = fragments(spark, rows)
    return frags, B.table_zones(frags, ["page"], F.lit(0.0), F.lit(right))


def grid(n, step=20, cells=((0, 60), (150, 200), (300, 380)), at=0):
    return [(at + i * step, [(f"c{i}{k}", a, b) for k, (a, b) in enumerate(cells)]) for i in range(n)]


def test_table_is_found_between_text(spark):
    prose = [("words of a line", 0, 480)]
    rows = [(0, prose), *[(b + 20, f) for b, f in grid(4)], (100, prose)]
    got = zones(spark, rows)[1].collect()
    assert [(r["first_row"], r["last_row"], len(r["cols"])) for r in got] == [(1, 4, 3)]
    assert [tuple(c) for c in got[0]["cols"]] == [(0.0, 61.0), (150.0, 201.0), (300.0, 380.0)]


@pytest.mark.parametrize("rows", [
    grid(4, cells=((0, 160), (200, 480))),  # running text side by side
    [(20 * i, [(f"{i}.", 0, 12), ("a long item of a list", 40, 300)]) for i in range(4)],  # markers of a list
    grid(3, cells=((0, 20), (30, 480))),  # one column of long texts
    [(20 * i, [("a", 160 * i, 160 * i + 20), ("b", 160 * i + 60, 160 * i + 80)]) if i % 2 == 0 else (20 * i, [("c", 160 * i, 160 * i + 20)]) for i in range(3)][:2] + grid(1, at=90),  # one such row, and one apart
    grid(1), [(0, [("x", 0, 40)]), (20, [("y", 0, 40)])],
])
def test_what_is_no_table(spark, rows):
    assert zones(spark, rows)[1].count() == 0


def test_longest_end_that_is_a_table(spark):
    """A session whose first rows are too wide apart for columns: the rest is one."""
    rows = [(0, [("wide text that runs over", 0, 250), ("x", 290, 300)]), (20, [("wide text that runs over", 0, 310), ("x", 330, 340)]), *[(b + 40, f) for b, f in grid(3)]]
    got = zones(spark, rows)[1].collect()
    assert len(got) == 1 and got[0]["last_row"] == 4 and got[0]["first_row"] in (1, 2)


def test_gaps_part_tables(spark):
    rows = grid(3) + grid(3, at=200)
    assert [(r["first_row"], r["last_row"]) for r in zones(spark, rows)[1].orderBy("first_row").collect()] == [(0, 2), (3, 5)]


def test_wrapped_cells(spark):
    rows = [(0, [("alpha-", 0, 60), ("one", 150, 200), ("x", 300, 380)]), (12, [("beta", 0, 40)]), (32, [("gamma", 0, 60), ("two-", 150, 200), ("y", 300, 380)]), (44, [("Three", 150, 190)]), (64, [("delta", 0, 60), ("z", 300, 380)]), (76, [("new", 150, 180)]), (96, [("e", 0, 60), ("f", 150, 200), ("g", 300, 380)])]
    frags, found = zones(spark, rows)
    got = {(r["table_row"], r["col_no"]): r["text"] for r in B.table_cells(frags, found, ["page"]).collect()}
    # a continuation goes to filled cells only: the last but one begins a row of its own
    assert got == {(0, 0): "alphabeta", (0, 1): "one", (0, 2): "x", (1, 0): "gamma", (1, 1): "two- Three", (1, 2): "y", (2, 0): "delta", (2, 2): "z", (3, 1): "new", (4, 0): "e", (4, 1): "f", (4, 2): "g"}


# ---- columns


def page(spark, items):
    rows = [(1, i, len(t) if t else None, float(a), float(b), float(top), top + 10.0, 0.0, 500.0) for i, (t, a, b, top) in enumerate(items)]
    return spark.createDataFrame(rows, "page int, frag_no long, n_chars long, x0 double, x1 double, top double, bottom double, left double, right double")


def two_columns(n=10, at=20, left=(0, 230), right=(270, 500)):
    return [("text", *c, at + 14 * i) for i in range(n) for c in (left, right)]


def test_gutter(spark):
    assert [r["gutter"] for r in B.gutters(page(spark, two_columns()), ["page"]).collect()] == [250.0]
    assert B.gutters(page(spark, [("text", 0, 480, 14 * i) for i in range(20)]), ["page"]).isEmpty()
    assert B.gutters(page(spark, two_columns(3)), ["page"]).isEmpty()  # too few lines
    assert B.gutters(page(spark, two_columns(10, right=(270, 300))), ["page"]).count() == 1  # labels beside text
    assert B.gutters(page(spark, two_columns(10, right=(270, 300))), ["page"], nested=True).isEmpty()


def test_regions(spark):
    items = [("A title over both", 50, 450, 0), *two_columns(), (None, 100, 400, 200), *two_columns(at=240)]
    got = B.split_regions(page(spark, items), ["page"]).collect()
    at = {r["frag_no"]: r["region_no"] for r in got}
    assert at[0] == 0 and {at[i] for i in range(1, 21, 2)} == {1} and {at[i] for i in range(2, 21, 2)} == {2} and at[21] == 3 and {at[i] for i in range(22, 42, 2)} == {4} and {at[i] for i in range(23, 42, 2)} == {5}
    assert {r["columns"] for r in got} == {2}
    bounds = {r["region_no"]: (r["left"], r["right"]) for r in got}
    assert bounds[0] == (0.0, 500.0) and bounds[1] == (0.0, 230.0) and bounds[2] == (270.0, 500.0)


def test_nested_columns_and_one(spark):
    three = [("text", a, a + 150, 20 + 14 * i) for i in range(12) for a in (0, 175, 350)]
    got = B.split_regions(page(spark, three), ["page"]).collect()
    assert {r["columns"] for r in got} == {3} and [{r["region_no"] for r in got if r["x0"] == x} for x in (0, 175, 350)] == [{0}, {1}, {2}]
    one = B.split_regions(page(spark, [("text", 0, 480, 14 * i) for i in range(20)]), ["page"]).collect()
    assert {(r["region_no"], r["columns"]) for r in one} == {(0, 1)}


# ---- paragraphs


LINE = "page int, row_no long, text string, x0 double, x1 double, base double, size double, bold boolean"


def groups(spark, lines):
    """Lines as (text, x0, x1, base, size, bold); first rows of their paragraphs."""
    full = [(1, i, t, float(a), float(b), float(y), float(s), w) for i, (t, a, b, y, s, w) in enumerate(lines)]
    return B.paragraphs(spark.createDataFrame(full, LINE), ["page"], F.lit(0.0), F.lit(400.0)).orderBy("para_no").collect()


def body(n, x0=0, x1=400, at=0, size=10, bold=False, step=12):
    return [(f"line {i} goes on", x0, x1, at + step * i, size, bold) for i in range(n)]


@pytest.mark.parametrize("lines,first", [
    (body(6), [0]), (body(3) + body(3, at=60), [0, 3]), (body(3) + body(3, at=36, size=14, step=16), [0, 3]), (body(3) + body(3, at=36, bold=True), [0, 3]),
    (body(2) + [("ends here.", 0, 150, 24, 10, False)] + body(3, at=36), [0, 3]),  # a short line
    (body(3) + [("1. first", 0, 400, 36, 10, False), ("2. second", 0, 400, 48, 10, False)], [0, 3, 4]),
    ([("a line ends here.", 0, 400, 0, 10, False), ("Indented begins", 20, 400, 12, 10, False)] + body(3, at=24), [0, 1]),
    ([("• item", 0, 400, 0, 10, False), ("goes on", 15, 400, 12, 10, False), ("and on", 15, 400, 24, 10, False)] + body(2, at=36), [0, 3]),
    (body(3) + [("Centred", 170, 230, 36, 10, False)] + body(3, at=48), [0, 4]), (body(3, at=100) + body(3), [0, 3]),
])
def test_paragraph_breaks(spark, lines, first):
    got = groups(spark, lines)
    assert [r["first_row"] for r in got] == first and sum(r["n_lines"] for r in got) == len(lines)


def test_paragraph_text(spark):
    got = groups(spark, [("a hyphen-", 0, 400, 0, 10, False), ("ated word", 0, 400, 12, 10, False), ("and more", 0, 400, 24, 10, False), ("(a) an item", 40, 400, 36, 10, False), ("below", 60, 400, 48, 10, False)])
    assert got[0]["text"] == "a hyphenated word and more" and (got[1]["list"], got[1]["indent"]) == ("number", 60.0) and got[0]["indent"] is None


# ---- display text


def lines_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def test_prepared(spark):
    texts = ["a b\tc\nd", "中x", "́a", "क‍्", "‍a", "", None]
    got = [r["text"] for r in D.prepared(lines_of(spark, *texts), ["id"], {"deva": D.FONTS["deva"]}).orderBy("id").collect()]
    assert got == ["a b c\nd", "?x", "a", "क‍्", "a", "", ""]


def test_segments_and_order(spark):
    text = "ab مرحبا بك 12 cd"
    segs = D.segments(lines_of(spark, text), ["id"])
    got = [(r["text"], r["font"], r["strong"]) for r in segs.orderBy("seg_no").collect()]
    assert got == [("ab", "base", "L"), (" ", "base", "N"), ("مرحبا بك", "arab", "R"), (" ", "base", "N"), ("12", "base", "L"), (" ", "base", "N"), ("cd", "base", "L")]
    order = lambda rtl: [r["seg_no"] for r in D.visual_order(segs, ["id"], F.lit(rtl)).orderBy("visual_no").collect()]
    assert order(False) == [0, 1, 2, 3, 4, 5, 6] and order(True) == [4, 5, 6, 3, 2, 1, 0]


def test_marks_follow_what_they_stand_on(spark):
    got = [(r["text"], r["font"], r["strong"]) for r in D.segments(lines_of(spark, "क́xि́"), ["id"]).orderBy("seg_no").collect()]
    assert got == [("क́", "deva", "L"), ("x", "base", "L"), ("ि́", "deva", "L")]


@pytest.mark.parametrize("text,k,pieces,gaps", [
    ("abc", 1, ["abc"], ["", ""]), ("abc", 2, ["a", "bc"], ["", "", ""]), ("abc", 5, ["a", "b", "c", "", ""], [""] * 6), ("áb", 1, ["a"], ["", "́b"]), ("́ab́cd", 3, ["a", "b", "cd"], ["́", "", "́", ""]),
    ("a‍b", 2, ["a", "b"], ["", "", ""]), ("", 2, ["", ""], ["", "", ""]),
])
def test_over_glyphs(spark, text, k, pieces, gaps):
    got = spark.range(1).select(D.over_glyphs(F.lit(text), F.lit(k)).alias("p")).first()["p"]
    assert (got["pieces"], got["gaps"]) == (pieces, gaps) and "".join(g + p for g, p in zip(gaps, [*pieces, ""])) == text.replace("‍", "")


# ---- what pages show


def test_matrices_nest(spark):
    m = lambda a, b, c, d, e, f: [float(v) for v in (a, b, c, d, e, f)]
    ops = [
        ("transform", m(2, 0, 0, 2, 10, 10)), ("save", None), ("transform", m(50, 0, 0, 50, 5, 5)), ("paint", None), ("form", m(1, 0, 0, 1, 1, 0)), ("paint", None), ("end", None), ("restore", None), ("transform", m(0, 30, -20, 0, 100, 0)), ("paint", None),
        ("restore", None), ("transform", m(10, 0, 0, 10, 0, 0)), ("paint", None), ("transform", m(9, 0, 0, 9, 0, 0)), ("paint", None), ("paint", None),
    ]
    df = spark.createDataFrame([(1, 1, i, o, x) for i, (o, x) in enumerate(ops)], "doc_id long, page_no int, op_no int, op string, matrix array<double>")
    sizes = spark.createDataFrame([(1, 1, 300.0, 200.0)], "doc_id long, page_no int, width double, height double")
    got = [tuple(r)[3:] for r in C.painted_images(df, sizes, F.array(*[F.lit(v) for v in m(1, 0, 0, 1, 0, 0)])).orderBy("image_no").collect()]
    assert got == [(20.0, 20.0, 120.0, 120.0), (120.0, 20.0, 220.0, 120.0), (170.0, 10.0, 210.0, 70.0), (0.0, 0.0, 90.0, 90.0)]


@pytest.mark.parametrize("html,features,shown,n", [
    ("<p>a</p><div class='my-cookie'><p>x<div>y</div></p></div>b", ("cookies",), "<p>a</p>b", 1), ("<nav>n</nav><p>a<br></p><footer>f", ("print",), "<p>a<br></p>", 2), ("<div id=AD-9><iframe></iframe></div>c", ("ads",), "c", 1),
    ("<header><aside>x</aside></header>d", ("print",), "d", 1), ("</div><div class=modal>x</div></div>e", ("popups",), "</div></div>e", 1), ("<img class=ad-1>f<script>var a='<nav>'</script>", ("ads", "print"), "f<script>var a='<nav>'</script>", 1),
    ("<p class='x sidebar'>s</p><p class=sidebars>t</p>", ("print",), "<p class=sidebars>t</p>", 1), ("", ("ads",), "", 0), (None, ("ads",), None, 0), ("<ins class=adsbygoogle>i</ins><b class=adsbygoogle>j</b>", ("ads",), "<b class=adsbygoogle>j</b>", 1),
])
def test_hidden_elements(spark, html, features, shown, n):
    got = C.without_hidden(spark.createDataFrame([(1, html)], "page_id long, html string"), "page_id", features).first()
    assert (got["html"], got["n_hidden"]) == (shown, n)
