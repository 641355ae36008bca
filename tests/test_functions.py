"""Expressions against hand-made cases."""

import io
import random
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirelab.functions import geometry as G
from quirelab.functions import ranges as R
from quirelab.functions import scores as S
from quirelab.functions import text as X
from quirelab.operators import catalog_ops as C
from quirelab.operators import layout_ops as L
from quirelab.operators import page_ops as P
from quirelab.operators import text_ops as O
from quirelab.sources import files


def value(spark, column, **given_):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in given_.items()]) if given_ else spark.range(1)
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("spec,ranges,error", [("1-5, 8", [(1, 5), (8, 8)], None), ("5-2", None, "reversed"), ("a", None, "format"), ("", None, "empty"), ("11", None, "start"), ("2-11", None, "end"), ("0,x", None, "start"), ("3-4,1", [(3, 4), (1, 1)], None)])
def test_ranges(spark, spec, ranges, error):
    r = value(spark, R.parse_ranges(F.lit(spec), F.lit(10)))
    assert (r["ranges"] and [tuple(x) for x in r["ranges"]], r["error"]) == (ranges, error)


@pytest.mark.parametrize("spec,pages,error", [("3abc", [3], None), ("1-5", [1], None), ("x", None, "number"), ("12", None, "bounds"), (" , ", None, "empty")])
def test_page_list(spark, spec, pages, error):
    r = value(spark, R.parse_page_list(F.lit(spec), F.lit(10)))
    assert (r["ranges"] and [x["start"] for x in r["ranges"]], r["error"]) == (pages, error)


def test_chunks(spark):
    r = value(spark, R.fixed_ranges(F.lit(3), F.lit(7)))
    assert [tuple(x) for x in r["ranges"]] == [(1, 3), (4, 6), (7, 7)]
    assert value(spark, R.size_ranges(F.lit(7), F.lit(7)))["error"] == "too_large"
    assert value(spark, R.fixed_ranges(F.lit(0), F.lit(7)))["error"] == "size"


@settings(max_examples=15, deadline=None)
@given(st.sets(st.integers(1, 40), min_size=1))
def test_islands_and_expand_are_inverse(spark, pages):
    df = spark.createDataFrame([(1, p) for p in pages], "doc_id int, page_no int")
    back = P.islands(df).agg(F.collect_list(F.struct("start", "end")).alias("r")).select(R.expand(F.col("r")).alias("p")).first()["p"]
    assert back == sorted(pages)


def test_toggle_and_contains(spark):
    assert value(spark, R.toggle(F.array(F.lit(1), F.lit(4)), F.lit(2))) == [1, 2, 4]
    assert value(spark, R.toggle(F.array(F.lit(1), F.lit(4)), F.lit(4))) == [1]


def test_four_quarter_turns_change_nothing(spark):
    pages = spark.createDataFrame([(1, 1, 90), (1, 2, 0)], "doc_id int, page_no int, rotation int")
    turns = spark.createDataFrame([(1, 0, 90)] * 4, "doc_id int, page_index int, angle int")
    assert sorted(map(tuple, P.rotate(pages, turns).select("page_no", "rotation").collect())) == [(1, 90), (2, 0)]


def test_geometry(spark):
    assert value(spark, G.page_label(F.lit("{n} of {total}"), F.lit(4), F.lit(10), F.lit(3), F.lit(5))) == "11 of 3"
    assert value(spark, G.mirrored(F.lit("tl"), F.lit(2), F.lit(True), F.lit(True))) == "tr"
    assert value(spark, G.crop_box(F.lit(0), *map(F.lit, (0.0, 0.0, 100.0, 200.0, 20.0, 0.0, 100.0, 80.0)))).asDict() == pytest.approx({"x": 0, "y": 0, "w": 100, "h": 160})
    assert value(spark, G.crop_margin("top", F.lit(99.0), *map(F.lit, (0.0, 0.0, 100.0, 90.0)))).asDict() == pytest.approx({"top": 88, "left": 0, "width": 100, "height": 2})
    quad = F.expr("array(named_struct('x', 9.0, 'y', 0.0), named_struct('x', 0.0, 'y', 8.0), named_struct('x', 1.0, 'y', 1.0), named_struct('x', 8.0, 'y', 9.0))")
    assert [tuple(p) for p in value(spark, G.order_quad(quad))] == [(1, 1), (9, 0), (8, 9), (0, 8)]
    assert value(spark, G.contain(*map(F.lit, (10.0, 10.0, 0.0, 5.0)))) is None
    assert value(spark, G.overlap(*map(F.lit, (0.0, 5.0, 3.0, 9.0)))) == 2


def test_scores(spark):
    ok = {k: F.lit(True) for k in ("header", "eof", "xref", "trailer", "strict", "tolerant", "metadata")} | {"encrypted": F.lit(False), "object_errors": F.lit(0), "stream_errors": F.lit(0)}
    score = lambda **x: value(spark, S.health_score(ok | {k: F.lit(v) for k, v in x.items()}))
    assert score(metadata=False) == 97 and score(header=False) == 75 and score(object_errors=99) == 85
    assert value(spark, S.health_label(F.lit(75))) == "Good"
    assert [value(spark, S.file_size(F.lit(n))) for n in (0, 1023, 1024, 1536, 5 << 20)] == ["0 B", "1023 B", "1 KB", "1.5 KB", "5 MB"]
    assert value(spark, S.half_up(F.lit(-2.5))) == -2
    content = b"%PDF-1.4\n1 0 obj\nstream\nendstream\nendobj\nxref\ntrailer\n%%EOF"
    df = spark.createDataFrame([(content,), (b"junk obj 3 0 obj stream",), (b"",)], "content binary")
    got = [tuple(r) for r in df.select(*[c.alias(k) for k, c in S.byte_checks(F.col("content")).items()]).collect()]
    assert got[0][:5] == (True, True, True, True, False) and got[0][5:7] == (0, 0)
    assert got[1][:4] == (False, False, False, False) and got[1][5:7] == (1, 1) and got[2][:4] == (False,) * 4


def test_text(spark):
    assert value(spark, X.join_lines(F.array(F.lit("exam-"), F.lit("ple")))) == "example"
    assert value(spark, X.join_lines(F.array(F.lit("A-"), F.lit("B")))) == "A- B"
    assert value(spark, X.sanitize(F.lit("é\r\na\tb \x07c"))) == "é\na    b c"
    assert value(spark, X.words(F.lit("Co­op ﬁne-tuned, X1"))) == ["coop", "finetuned", "x1"]
    assert value(spark, X.font_style(F.lit("ABCDEF+Arial-BoldItalic"))).asDict() == {"bold": True, "italic": True}
    assert [value(spark, X.roman(F.lit(n))) for n in (1, 4, 1994, 0)] == ["I", "IV", "MCMXCIV", ""]
    assert [value(spark, X.alpha(F.lit(n))) for n in (1, 26, 27, 702, 703)] == ["a", "z", "aa", "zz", "aaa"]
    assert value(spark, X.transform_case(F.lit("ab cD"), F.lit("capitalize"))) == "Ab CD"
    assert value(spark, X.inline_markup(F.lit("**a** `b` [c](d)"))) == '<strong>a</strong> <code>b</code> <a href="d">c</a>'
    assert value(spark, X.is_rtl(F.lit("12 ال a"))) and not value(spark, X.is_rtl(F.lit("a ا")))
    assert value(spark, X.graphemes(F.lit("éa"))) == ["é", "a"]
    assert value(spark, X.hex_color(F.lit("#f00"))).asDict() == {"r": 1.0, "g": 0.0, "b": 0.0}
    assert value(spark, X.color(F.lit("rgba(255, 0, 0, 0.5)")))["a"] == 0.5 and value(spark, X.color(F.lit("red"))) is None
    assert value(spark, X.splice(F.lit("abcd"), F.lit(1), F.lit(3), "**", "**")) == "a**bc**d"
    assert value(spark, X.pdf_name(F.lit("a.MD"), F.lit("t"))) == "a.pdf" and value(spark, X.pdf_name(F.lit(None).cast("string"), F.lit("My Doc"))) == "my_doc.pdf"
    assert [t["kind"] for t in value(spark, X.code_tokens("if")(F.lit("if f(1) # x\n 'a'")))] == ["keyword", "function", "number", "comment", "string"]


def test_joined_lines_match_a_loop(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    got = dict(docs.select("doc_id", X.join_lines(F.split("text", "\n", -1))).collect())
    for doc_id, text in docs.select("doc_id", "text").collect():
        out = None
        for line in text.split("\n"):
            out = line if out is None else out + line if out == "" or out[-1].isspace() else out + " " + line
        assert got[doc_id] == out


def test_metrics(spark):
    ref = spark.createDataFrame([(1, ["a", "a", "b"])], "id int, words array<string>")
    out = spark.createDataFrame([(7, ["a", "b", "c"])], "id int, words array<string>")
    pairs = spark.createDataFrame([(1, 7)], "ref_id int, out_id int")
    assert O.multiset_recall(pairs, ref, out).first()["recall"] == pytest.approx(2 / 3)
    assert O.run_coverage(pairs, ref, out).first()["coverage"] == pytest.approx(2 / 3)
    long = spark.createDataFrame([(1, [str(i) for i in range(20)])], "id int, words array<string>")
    part = spark.createDataFrame([(7, ["x", *[str(i) for i in range(13)], "y"])], "id int, words array<string>")
    assert O.run_coverage(pairs, long, part).first()["coverage"] == pytest.approx(13 / 20)
    assert value(spark, O.nearest_rank(F.array(*[F.lit(float(x)) for x in (10, 20, 30, 40)]), 0.5)) == 30
    rows = spark.createDataFrame([(1, 12.0, 3, 0), (1, 9.0, 3, 1)], "d int, v double, w int, s int")
    assert O.weighted_mode(rows, ("d",), F.col("v"), F.col("w"), F.col("s")).first()["value"] == 12.0


@settings(max_examples=20, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("abc"), max_size=9))
def test_ordered_recall(a, b):
    import pandas as pd

    row = [0] * (len(b) + 1)
    for x in a:
        prev = row[:]
        for j, y in enumerate(b, 1):
            row[j] = prev[j - 1] + 1 if x == y else max(prev[j], row[j - 1])
    got = O.ordered_recall.func(pd.Series([a]), pd.Series([b]))[0]
    assert got == (row[-1] / len(a) if a else 1.0)


def test_catalogue(spark):
    items = spark.createDataFrame([("x", 0, ["c1"]), ("y", 1, ["c2"]), ("z", 2, ["c1", "c2"])], "id string, seq int, tags array<string>")
    got = [tuple(r) for r in C.related(items, F.col("tags")).orderBy("id", "rank").collect()]
    assert got == [("x", 1, "z"), ("y", 1, "z"), ("z", 1, "x"), ("z", 2, "y")]
    wanted = spark.createDataFrame([("a-b",), ("c",)], "slug string")
    known = spark.createDataFrame([("c", "See")], "slug string, title string")
    assert dict(C.with_default_title(wanted, known).collect()) == {"a-b": "A B", "c": "See"}


def test_files(spark, tmp_path):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="u"><sheets><sheet name="A"/><sheet name="B &amp; C"/></sheets></workbook>')
    (tmp_path / "a.xlsx").write_bytes(buf.getvalue())
    (tmp_path / "b.xlsx").write_bytes(b"no zip")
    df = files.read_files(spark, str(tmp_path)).select("name", files.sheet_names("content").alias("sheets"))
    assert dict(df.collect()) == {"a.xlsx": ["A", "B & C"], "b.xlsx": []}
    sheets = spark.createDataFrame([("p", "A"), ("p", "B"), ("q", "A")], "path string, sheet string")
    chosen = spark.createDataFrame([("p", "B")], "path string, sheet string")
    assert sorted(map(tuple, files.keep_sheets(sheets, chosen).collect())) == [("p", "B"), ("q", "A")]


@pytest.mark.parametrize("text,columns,expected", [
    ("aa bb  cc", 5, ["aa bb", "cc"]), ("", 5, [""]), ("abcdefgh", 3, ["abc", "def", "gh"]), (None, 3, None), ("a   b", 2, ["a", "b"]), ("  abcd", 3, ["abc", "d"]), ("x abcdef yz", 4, ["x", "abcd", "ef", "yz"]), ("e\u0301e\u0301e", 3, ["e\u0301", "e\u0301e"]),
])
def test_wrap(spark, text, columns, expected):
    assert value(spark, O.wrap_mono(F.lit(text).cast("string"), F.lit(columns))) == expected


def test_blank_queries_find_nothing(spark):
    words = spark.createDataFrame([(1, 1, i, w, 0.0, 9.0) for i, w in enumerate("of the of".split())], "doc_id long, page_no int, word_no int, text string, x0 double, x1 double")
    assert [O.find_word(words, q).count() for q in ("", "  ", "of")] == [0, 0, 2]
    assert [O.find_phrase(words, q).count() for q in ("", "  ", "of the")] == [0, 0, 2]


def test_names_of_an_archive_with_null(spark):
    names = ["a.txt", None, "a.txt", "a (2).txt", None, "a.txt", ".x", ".x", "b (3)", "b (3)"]
    got = P.unique_names(spark.createDataFrame([(1, i, n) for i, n in enumerate(names)], "job_id long, file_seq long, name string")).orderBy("file_seq").collect()
    assert [r["unique_name"] for r in got] == ["a.txt", None, "a (2).txt", "a (2) (2).txt", None, "a (3).txt", ".x", " (2).x", "b (3)", "b (3) (2)"]


@pytest.mark.parametrize("name,bold,italic", [
    ("ABCDEF+NimbusRomNo9L-Medi", True, False), ("CMBX10", True, False), ("CMTI10", False, True), ("Arial,Bd", True, False), ("Foo-It", False, True), ("Slanted", False, True), ("Minion SB", True, False), ("Abd", False, False),
    ("ABCDEF+Times-Roman", False, False), ("Helvetica-BoldOblique", True, True),
])
def test_font_style(spark, name, bold, italic):
    assert tuple(value(spark, X.font_style(F.lit(name)))) == (bold, italic)


def test_colours_and_numerals(spark):
    assert value(spark, X.color(F.lit("rgba(1,2,3,50%)")))["a"] == 0.5 and value(spark, X.color(F.lit("rgba(1 2 3 / 0.25)")))["a"] == 0.25 and value(spark, X.color(F.lit("rgb(1.2.3,2,3)")))["r"] is None
    red, white = F.struct(F.lit(1.0).alias("r"), F.lit(0.0).alias("g"), F.lit(0.0).alias("b")), F.struct(*[F.lit(1.0).alias(k) for k in "rgb"])
    assert tuple(value(spark, X.blend(red, F.lit(3.0), white))) == (1.0, 0.0, 0.0) and tuple(value(spark, X.blend(red, F.lit(0.25), white))) == (1.0, 0.75, 0.75)

    def alpha(n):
        out = ""
        while n > 0:
            n -= 1
            out, n = chr(97 + n % 26) + out, n // 26
        return out

    for n in (0, 1, 26, 27, 52, 702, 703, 18278, 18279, 475254, 475255, 2**63 - 1):
        assert value(spark, X.alpha(F.lit(n))) == alpha(n)
    assert value(spark, X.font_key(F.lit("Courier New"), F.lit("bold"), F.lit("italic"))) == "mono-bi" and value(spark, X.font_key(F.lit("Inter"), F.lit("400"), F.lit("normal"))) == "sans"


def test_code_tokens(spark):
    code = "<!-- a\nb --> 0xFF 1.5e-3 nil self undefined const $x = foo (`t\nu`, \"q\\\"\") /* c */ constant # end"
    got = [(t["kind"], t["text"]) for t in value(spark, X.code_tokens()(F.lit(code)))]
    assert got == [
        ("comment", "<!-- a\nb -->"), ("number", "0xFF"), ("number", "1.5e-3"), ("boolean", "nil"), ("boolean", "self"), ("boolean", "undefined"), ("keyword", "const"), ("function", "foo"), ("string", "`t\nu`"), ("string", '"q\\""'),
        ("comment", "/* c */"), ("comment", "# end"),
    ]


def test_archive_names(spark):
    """The first free number, whether a name has it by itself or was given it."""
    for names, expected in (
        (["a.pdf", "a (2).pdf", "a.pdf"], ["a.pdf", "a (2).pdf", "a (3).pdf"]), (["a.pdf", "a.pdf", "a (2).pdf"], ["a.pdf", "a (2).pdf", "a (2) (2).pdf"]), (["x", "x", "x.tar.gz", "x.tar.gz"], ["x", "x (2)", "x.tar.gz", "x.tar (2).gz"]),
    ):
        df = spark.createDataFrame([(1, i, n) for i, n in enumerate(names)], "job_id int, file_seq int, name string")
        assert [r["unique_name"] for r in P.unique_names(df).orderBy("file_seq").collect()] == expected


def test_word_files_and_text_sink(spark, tmp_path):
    buf = io.BytesIO()
    body = (
        '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b &lt; c</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p/></w:tc><w:tc><w:p/></w:tc></w:tr><w:tr><w:tc><w:p/></w:tc></w:tr></w:tbl>'
        '<w:p><w:pPr><w:pageBreakBefore/></w:pPr><w:r><w:t>next</w:t></w:r></w:p><w:p><w:pPr><w:pageBreakBefore w:val="false"/></w:pPr></w:p>'
    )
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="u"><w:body>{body}</w:body></w:document>')
    df = spark.createDataFrame([(1, buf.getvalue()), (2, b"no zip"), (3, None)], "id int, content binary")
    got = {r["id"]: r["d"] for r in df.select("id", files.docx_scan("content").alias("d")).collect()}
    assert [tuple(p) for p in got[1]["paragraphs"]] == [(1, "Head"), (1, "a b < c"), (1, ""), (1, ""), (1, ""), (2, "next"), (2, "")]
    assert got[1]["headings"] == ["Heading1"] and [tuple(t) for t in got[1]["tables"]] == [(2, 2)] and got[2]["paragraphs"] == got[3]["tables"] == []
    files.write_text(spark.createDataFrame([("é",), ("b",)], "t string"), str(tmp_path / "out"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["b", "é"]


def test_pagination(spark):
    """Nothing that fits a page is cut; a heading does not end a page; what is taller than a page is cut."""
    def tops(atoms):
        df = spark.createDataFrame([(1, float(t), float(b), k) for t, b, k in atoms], "doc_id long, top double, bottom double, keep_with_next boolean")
        return [r["top"] for r in L.paginate(df, 100.0).orderBy("page_no").collect()]

    assert tops([(0, 40, False), (50, 90, False)]) == [0.0]
    assert tops([(0, 60, False), (70, 120, False), (130, 160, False)]) == [0.0, 70.0]
    assert tops([(0, 60, False), (70, 90, True), (95, 140, False)]) == [0.0, 70.0]
    assert tops([(0, 250, False)]) == [0.0, 100.0, 200.0]


def test_lines_are_bold_by_characters(spark):
    frags = spark.createDataFrame([(1, 1, 0, 0, "short", 0.0, 1.0, 10.0, 12.0, 0, 5), (1, 1, 0, 1, "a very long bold text that outweighs it by far, as anyone can see", 2.0, 9.0, 10.0, 12.0, 64, 64)],
        "doc_id long, page_no int, row_no long, frag_no long, text string, x0 double, x1 double, base double, size double, n_bold long, n_chars long")
    assert L.lines_of(frags).first()["bold"] is True and L.lines_of(frags.withColumn("n_bold", F.col("n_bold") - 5)).first()["bold"] is False


def test_runs_drift(spark):
    """A run goes on while sizes are near what it began with, not what came last; sub- and superscripts have the line's size."""
    rows = [(0, "a", 0.0, 10.0, 5.0, 12.0), (1, "b", 7.0, 10.0, 5.0, 12.5), (2, "c", 13.0, 10.0, 5.0, 12.8), (3, "2", 18.0, 6.0, 3.0, 8.0), (4, "i", 21.0, 12.0, 3.0, 8.0)]
    df = spark.createDataFrame([(1, 1, 0, n, s, x, y, w, fs, False) for n, s, x, y, w, fs in rows], "doc_id long, page_no int, row_no long, piece_no long, str string, x double, y double, w double, fs double, bold boolean")
    lines = spark.createDataFrame([(1, 1, 0, 12.0, 10.0)], "doc_id long, page_no int, row_no long, size double, base double")
    got = [(r["text"], r["script"], r["size"]) for r in L.runs(df, lines).orderBy("run_no").collect()]
    assert got == [("a b", None, 12.0), ("c", None, 12.8), ("2", "sup", 12.0), ("i", "sub", 12.0)]


def test_pairs_by_runs(spark):
    rng = random.Random(1)
    lists = [[rng.choice("abcd") for _ in range(rng.randrange(0, 14))] for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(lists)), "id int, words array<string>")
    runs = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    expected = {(i, j) for i, a in enumerate(lists) for j, b in enumerate(lists) if runs(a) & runs(b)}
    assert {tuple(r) for r in O.run_pairs(df, df, 5).collect()} == expected


def test_script_runs(spark):
    """Spaces and punctuation between two pieces of a script are part of it, those at its edges are not."""
    got = [tuple(r) for r in value(spark, X.script_runs(F.lit("abc, العربية، نص 12 שלום")))]
    assert got == [("base", "abc, "), ("arabic", "العربية، نص"), ("base", " 12 "), ("hebrew", "שלום")]
    assert "".join(t for _, t in got) == "abc, العربية، نص 12 שלום" and value(spark, X.script_runs(F.lit(""))) == []
