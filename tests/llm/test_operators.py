"""Operators against brute force, round trips and held-out labels, and on awkward tables: nulls, empty and long texts, ties,
repeated rows, no rows, other columns with clashing names."""

import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from quirelab.llm import html_extract, language_id, license_scan, quality, vector_search
from quirelab.llm.line_dedup import line_dedup
from quirelab.llm.mixing import emit_copies, mix_sources
from quirelab.llm.near_dedup import bands_for, may_link, near_dedup, odd_sketches
from quirelab.llm._text import Words, mix
from quirelab.llm.substring_dedup import substring_dedup

CLASH = "size long, target string, n_words long, row long, id string, block int, n_lines string, score string, kept string, text2 string"


def base_rows():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    para = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = para(40)
    body = [para(60) for _ in range(12)]
    rows = [(i, b, "en", f"s{i % 3}") for i, b in enumerate(body)]
    rows += [(20, body[0], "en", "s0"), (21, body[0], None, None), (22, body[1].upper(), "fr", "s1"), (23, body[2] + " extra", "en", None)]
    rows += [(30, para(20) + " " + shared + " " + para(9), "en", "s0"), (31, shared, "de", "s1"), (32, para(3) + "\n" + shared.replace(" ", "\n"), "de", "")]
    rows += [(40, None, None, None), (41, "", "en", "s2"), (42, " \t\n\v ", "en", "s2"), (43, "one", "en", "s2"), (44, "one", "en", "s2"), (45, "é▁ 日本語 \x00\x07  nb", "ja", "é")]
    rows += [(None, body[3], "en", "s0"), (50, body[4], "en", "s0"), (50, body[4], "en", "s0"), (51, para(5000), "en", "s1"), (52, "x" * 70_000, "en", "s1"), (53, "a b c " * 3000, "en", "s2")]
    rows += [(60 + i, "l1\nl2\nl3\n" + para(4) + "\nq1\nq2", "en", "s0") for i in range(5)] + [(70, "l2\nl3\nq1\nl1\nl2\nl3", "en", "s0"), (71, "\n\n\n\n\n", "en", "s0")]
    return rows


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(*r, i, "t", 1, 2, "x", 3, "n", "s", "k", None) for i, r in enumerate(base_rows())]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {CLASH}").repartition(5).cache()


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.limit(0)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_quality(spark, awkward, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(None, 1, 0), (40, 0, 0), (1, None, 0), (2, 7, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(awkward, labels)
    got = quality.quality(awkward, model).collect()
    assert len(got) == awkward.count() and quality.quality(empty, model).count() == 0
    by = {r["doc_id"]: r for r in got}
    for doc_id, text, *_ in base_rows():
        w = words(text)
        r = by[doc_id]
        seen = Counter(zip(w, w[1:], w[2:]))
        cover = {i + j for i, t in enumerate(zip(w, w[1:], w[2:])) if seen[t] > 1 for j in range(3)}
        lines = [x for x in (text or "").split("\n") if words(x)]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(cover))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in text or "") and r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["base_failed"] == (len(w) < 50 or 2 * len(cover) > len(w)) and not (r["base_failed"] and r["kept"])
    assert quality.train(empty, labels) is quality.EMPTY and quality.train(awkward, labels.limit(0)) is quality.EMPTY


def test_quality_sees_characters():
    """Character n-grams are of code points, whatever their bytes."""
    got = [np.bincount(d, minlength=3).tolist() for d, _ in quality._groups(Words(["éa 日b".encode(), b"", b"x"]))]
    assert got == [[2, 0, 1], [1, 0, 0], [5, 0, 1], [3, 0, 0]]  # a word ends in a space


def test_quality_sample_is_bounded(spark):
    """Long texts and repeated ids don't widen what comes to the driver."""
    docs = spark.createDataFrame([(i, "good text here " * 20 if i % 2 else "bad $$ ## " * 20) for i in range(40)] + [(3, "good text here " * 20)] * 50 + [(100, "x" * 200_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(100, 0, 0)], "doc_id long, quality int, toxic int")
    small = quality.train(docs, labels, sample_bytes=9000)
    assert small is not quality.EMPTY
    got = {r["doc_id"]: r["quality"] for r in quality.quality(docs, small).collect()}
    assert got[1] > 0.5 > got[0]


def test_quality_learns(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")  # the smallest tables have too few labels to learn from
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    train, test = labels.filter("doc_id % 3 <> 0"), labels.filter("doc_id % 3 = 0")
    out = quality.quality(docs, quality.train(docs, train)).withColumnRenamed("quality", "p").join(test, "doc_id")
    good, bad = (out.filter(F.col("quality") == q).agg(F.avg((F.col("p") >= 0.5).cast("int"))).first()[0] for q in (1, 0))
    assert good >= 0.9 and bad <= 0.4


def test_language(spark, sf, awkward, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = docs.filter(~language_id.held_out(F.col("doc_id")))
    model = language_id.train(seen)
    out = language_id.identify(docs, model).filter(language_id.held_out(F.col("doc_id")))
    assert out.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] >= 0.95
    got = {r["doc_id"]: r for r in language_id.identify(awkward, model).collect()}
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert [got[i]["lang_pred"] for i in (40, 41, 42)] == ["und"] * 3 and got[45]["lang_pred"] in model.langs
    assert language_id.identify(empty, model).count() == 0
    none = language_id.train(empty)
    assert {r["lang_pred"] for r in language_id.identify(awkward, none).collect()} == {"und"}
    assert language_id.train(awkward).langs == ["de", "en", "fr", "ja"]


def test_language_backs_off(spark):
    docs = spark.createDataFrame([("abcabd abcabe", "x"), ("zyxzyw zyxzyv", "y")], "text string, lang string")
    model = language_id.train(docs)
    asked = spark.createDataFrame([(1, "abcabf"), (2, "zyxzyu!"), (3, "abcabd"), (4, "123 !")], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(asked, model).collect()}
    assert got == {1: "x", 2: "y", 3: "x", 4: "und"}


def test_language_against_brute_force(spark, sf):
    """Prediction and score of every document, from the definition."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()
    find = lambda t: regex.findall(r"\p{L}[\p{L}\p{M}]*", (t or "").lower())
    held = lambda d: zlib.crc32(str(d).encode()) % 4 == 2
    known, pieces = defaultdict(Counter), defaultdict(Counter)
    for r in rows:
        if not held(r["doc_id"]) and r["text"] is not None and r["lang"] is not None:
            for w in find(r["text"]):
                known[w][r["lang"]] += 1
    for w, by in known.items():
        for n in range(1, language_id.GRAM + 1):
            for g in language_id.grams(w, n):
                for lang, c in by.items():
                    pieces[g][lang] += c
    langs = sorted({lang for by in known.values() for lang in by})
    of = lambda table, lang: sum(by[lang] for by in table.values())
    tokens, parts = {x: of(known, x) for x in langs}, {x: of(pieces, x) for x in langs}
    kinds = max(sum(1 for by in known.values() if by[x]) for x in langs)

    def word(w, lang):
        if w in known:
            return np.log((known[w][lang] + 0.5) / (tokens[lang] + 0.5 * kinds))
        w, out = f"^{w}$", []
        for i in range(len(w)):
            g = next((w[i : i + n] for n in range(language_id.GRAM, 0, -1) if w[i : i + n] in pieces), None)
            if g is not None:
                out.append(np.log((pieces[g][lang] + 0.5) / (parts[lang] + 0.5 * len(pieces))))
        return sum(out) / len(out) if out else 0.0

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.train(docs.filter(~language_id.held_out(F.col("doc_id"))))
    got = {r["doc_id"]: r for r in language_id.identify(docs, model, keep=["doc_id"]).collect()}
    assert len(got) == len(rows) and {held(r["doc_id"]) for r in rows} == {True, False}
    memo = {}
    for r in rows:
        words_ = find(r["text"])
        total = {x: np.log(tokens[x] + 1) for x in langs}
        for w in words_:
            if w not in memo:
                memo[w] = [word(w, x) for x in langs]
            for x, v in zip(langs, memo[w], strict=True):
                total[x] += v
        top = max(total.values())
        share = 1 / sum(np.exp(v - top) for v in total.values())
        mine = got[r["doc_id"]]
        if not words_:
            assert (mine["lang_pred"], mine["score"]) == ("und", 0.0)
        else:
            assert total[mine["lang_pred"]] == pytest.approx(top, abs=1e-2) and mine["score"] == pytest.approx(share, abs=1e-2)


def test_language_words_and_ties(spark):
    """Combining marks are part of a word; a word may be of any length; with equal evidence the language that sorts first wins."""
    assert language_id._words("नमस्ते 3½x e\u0301t") == ["नमस्ते", "x", "e\u0301t"] and language_id._words("a" * 500) == ["a" * 500] and language_id._words("\u0301 12") == []
    model = language_id.train(spark.createDataFrame([("aa bb", "y"), ("aa bb", "x")], "text string, lang string"))
    got = language_id.identify(spark.createDataFrame([(1, "aa"), (2, "zz")], "doc_id long, text string"), model).collect()
    assert {(r["lang_pred"], r["score"]) for r in got} == {("x", 0.5)}


def test_language_counts_every_word(spark, sf, awkward, monkeypatch):
    """What does not fit in memory is looked up: a small memory gives the result of a large one."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").unionByName(awkward.select("doc_id", "text", "lang"))

    def run():
        model = language_id.train(docs.filter(~language_id.held_out(F.col("doc_id"))))
        return sorted((str(r["doc_id"]), r["lang_pred"], round(r["score"], 4)) for r in language_id.identify(docs, model, keep=["doc_id"]).collect())

    whole = run()
    for words, grams in ((50, 50), (50, 10**6), (10**6, 50)):
        monkeypatch.setattr(language_id, "WORDS", words)
        monkeypatch.setattr(language_id, "GRAMS", grams)
        assert run() == whole


def test_license(spark, awkward, empty):
    mit = dict(license_scan.KNOWN[:1])["MIT"]
    changed = "© 2020 Someone\nCopyright (c) 1999 A. Person\n" + mit.upper().replace(",", " ;").replace("LICENSE", "Licence")
    rows = [(1, changed), (2, mit + " and more"), (3, "text\n released under the  MIT licence \nLicensed under CC BY-NC 4.0.\nmore"), (4, None), (5, ""), (None, mit), (6, "Copyright 2001 X")]
    known = license_scan.known_digests(spark)
    got = {r["doc_id"]: (r["license"], r["notices"], r["n_notices"]) for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string"), known).collect()}
    assert got == {1: ("MIT", [], 0), 2: (None, [], 0), 3: (None, ["CC-BY-NC-4.0", "MIT"], 2), 4: (None, [], 0), 5: (None, [], 0), None: (None, [], 0), 6: (None, [], 0)}
    assert license_scan.license_scan(awkward, known).count() == awkward.count() and license_scan.license_scan(empty, known).count() == 0


def test_license_whole_texts(spark):
    """Whole licence texts, in the forms they usually have."""
    text = {n: t for n, t in reversed(license_scan.KNOWN) if len(t) > 300}
    mit = text["MIT"].removeprefix("MIT License\n")
    rows = [("MIT", f"The MIT License (MIT)\n\nCopyright (c) 2015 Jane Doe\n\n{mit}"), ("MIT", f"Copyright Jane Doe 2020\n{mit}"), ("MIT", f"MIT License\nCopyright The Frob Authors\nAll rights reserved.\n{mit}")]
    rows += [("ISC", f"ISC License\n\nCopyright Jane Doe, 2019-2021. All rights reserved.\n{text['ISC']}"), ("BSD-3-Clause", f"BSD 3-Clause License\nCopyright (c) 2001, X\nAll rights reserved.\n{text['BSD-3-Clause']}")]
    rows += [("BSD-2-Clause", re.sub("(?m)^[0-9][.]", "*", text["BSD-2-Clause"])), (None, f"{mit}\nAnd more."), (None, "All rights reserved.\nCopyright The Frob Authors")]
    folder = license_scan.Path(license_scan.__file__).parent / "licenses"
    assert len(license_scan.WHOLE) == len(list(folder.iterdir()))
    for name in license_scan.WHOLE:
        whole = (folder / f"{name}.txt").read_text()
        rows += [(name, whole), (None, whole[: len(whole) // 2])]
        if "END OF TERMS AND CONDITIONS" in whole:
            rows.append((name, whole.partition("END OF TERMS AND CONDITIONS")[0]))
    apache = (folder / "Apache-2.0.txt").read_text()
    rows += [("Apache-2.0", apache.replace("[yyyy] [name of copyright owner]", "2020 Jane Doe")), ("Apache-2.0", apache[apache.index("TERMS AND") :])]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["license"] for r in license_scan.license_scan(docs, license_scan.known_digests(spark)).collect()}
    assert [got[i] for i in range(len(rows))] == [n for n, _ in rows]


def test_license_odd_rows(spark):
    """Repeated ids share what is found, counts added; long texts are read to their end; columns of the result's names don't matter; a null id finds nothing."""
    mit, notice = dict(license_scan.KNOWN[:1])["MIT"], "Licensed under CC BY 4.0."
    rows = [(1, f"x\n{notice}\n{notice}"), (1, notice), (2, "word " * 60_000 + f"\n{notice}"), (3, mit), (3, "no licence"), (None, notice), (4, "licence license  LICENCE"), (5, "C: 1234\n" + notice)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("license", "notices", "n_notices", "digest", "id", "u", "lines", "whole")})
    got = sorted(map(tuple, license_scan.license_scan(df, license_scan.known_digests(spark)).collect()), key=str)
    one = (1, "CC-BY-4.0", ["CC-BY-4.0"], 3)
    expected = [one, one, (2, None, ["CC-BY-4.0"], 1), (3, "MIT", [], 0), (3, "MIT", [], 0), (None, None, [], 0), (4, None, [], 0), (5, None, ["CC-BY-4.0"], 1)]
    assert got == sorted(expected, key=str)
    assert license_scan.canonical("licence license  LICENCE") == ["license license license"]
    many = license_scan.known_digests(spark, tuple((f"L{i}", f"text {i}") for i in range(50)))
    assert license_scan.license_scan(spark.createDataFrame([(1, "Text 7!")], "doc_id long, text string"), many).first()["license"] == "L7"


def test_vectors(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(6, 16))
    x = centre[rng.integers(0, 6, 900)] + 0.6 * rng.normal(size=(900, 16))
    x[100:160] = x[100]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    bad = [(900, None), (950, [0.0] * 16), (1000, [float("nan")] * 16), (1050, [None] + [1.0] * 15), (1100, [float("inf")] + [1.0] * 15), (None, [1.0] * 16), (1150, [1.0] * 3), (150, rows[150][1])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("rank", F.lit("r"))
    got = defaultdict(list)
    for r in vector_search.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 900, 50))
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q, found in got.items():
        s = n @ n[q]
        s[q] = -9
        best = np.lexsort((np.arange(900), -s.round(12)))[:5]
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5] and q not in [v for _, v, _ in found]
        assert all(abs(score - s[v]) < 1e-9 for _, v, score in found)
        hit += len({v for _, v, _ in found} & set(best.tolist()))
    assert hit / (5 * len(got)) >= 0.9
    assert [v for _, v, _ in got[150]] == [100, 101, 102, 103, 104] and [v for _, v, _ in got[100]] == [101, 102, 103, 104, 105]
    assert vector_search.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    few = vector_search.nearest(df.filter("vec_id < 3"), F.col("vec_id") == 0).collect()
    assert len(few) == 2


def test_vectors_that_share_an_id(spark):
    """One vector of the query, whatever the order of rows; an id takes one place, by its nearest vector."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0])] + [(7, [0.01 * i, 1.0]) for i in range(1, 12)] + [(i, [0.2 + 0.1 * i, 1.0]) for i in range(1, 7)]
    for r in (rows, rows[::-1]):
        df = spark.createDataFrame(r, "vec_id long, embedding array<double>").coalesce(1)
        got = vector_search.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()
        assert [(x["rank"], x["vec_id"]) for x in got] == [(1, 7), (2, 1), (3, 2), (4, 3), (5, 4)]
        assert got[0]["score"] == pytest.approx(1 / (1 + 0.01**2) ** 0.5)


def recall_of(spark, x, **more):
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(4)
    got, hit, q = defaultdict(set), 0, range(0, len(x), 50)
    for r in vector_search.nearest(df, F.col("vec_id") % 50 == 0, **more).collect():
        got[r["query_id"]].add(r["vec_id"])
    for i in q:
        s = n @ n[i]
        s[i] = -9
        hit += len(set(np.argsort(-s)[:5].tolist()) & got[i])
    assert all(len(got[i]) == 5 for i in q)
    return hit / 5 / len(q)


def test_vectors_in_two_cuts_and_small_blocks(spark, monkeypatch):
    """Leaves of a second cut, and many blocks of candidates and queries: recall against brute force."""
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(60, 16))
    x = centre[rng.integers(0, 60, 3000)] + 0.5 * rng.normal(size=(3000, 16))
    assert recall_of(spark, x) >= 0.9
    monkeypatch.setattr(vector_search, "SAMPLE", 512)
    monkeypatch.setattr(vector_search, "LEAF", 40)
    monkeypatch.setattr(vector_search, "BLOCK", 16)
    assert vector_search.parts_for(3000) == (9, 9)
    assert recall_of(spark, x) >= 0.9


def test_vectors_probe_until_k_are_there(spark):
    """Few vectors, far apart: every query still gets k; with fewer others, all of them. Long vectors, and ties between different vectors, go by id."""
    rng = np.random.default_rng(6)
    x = np.concatenate([np.eye(40)[i] + 0.01 * rng.normal(size=(4, 40)) for i in range(40)])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    assert vector_search.nearest(df, F.col("vec_id") % 20 == 0, recall=0.01).groupBy("query_id").count().filter("count = 5").count() == 8
    long = spark.createDataFrame([(i, [1.0 if j in (0, i) else 0.0 for j in range(20_000)]) for i in range(7)], "vec_id long, embedding array<double>")
    got = vector_search.nearest(long, F.col("vec_id") == 3).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [0, 1, 2, 4, 5] and got[1]["score"] == pytest.approx(0.5)


def test_balanced_parts():
    graph = vector_search.neighbour_graph(np.random.default_rng(1).normal(size=(300, 8)), 5)
    part = vector_search.balanced_parts(graph, 6)
    assert np.bincount(part, minlength=6).max() <= np.ceil(1.1 * 50)


def components_by_force(rows, k, percent):
    sets = {}
    for d, text in rows:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(text)]
        sets.setdefault(d, []).append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [d for d in sets if d is not None]
    for i in ids:
        for j in ids:
            if i < j and any(a & b and 100 * len(a & b) >= percent * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {d: (len(s[0]), find(d) if d is not None else None) for d, s in sets.items()}


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_dedup(spark, awkward, empty, k, percent):
    got = near_dedup(awkward, shingle=k, percent=percent).collect()
    assert len(got) == awkward.count()
    expected = components_by_force([r[:2] for r in base_rows()], k, percent)
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == expected[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert near_dedup(empty).count() == 0


@pytest.mark.parametrize("bound", [4096, 3])
def test_near_dedup_chain_and_crowd(spark, monkeypatch, bound):
    """A chain whose ends aren't alike, and a crowd of near copies most pairs of which are under the threshold; with a small bound the crowd is dealt by finer bands."""
    dealt = []
    monkeypatch.setattr("quirelab.llm.near_dedup.CROWD", bound)
    monkeypatch.setattr("quirelab.llm.near_dedup.bands_for", lambda j, rows: dealt.append(rows) or bands_for(j, rows))
    rng = random.Random(9)
    base = [f"v{rng.randrange(500)}" for _ in range(120)]
    rows, w = [], list(base)
    for i in range(12):
        rows.append((i, " ".join(w)))
        for _ in range(2):
            w[rng.randrange(120)] = f"z{rng.randrange(10**6)}"
    crowd = [f"u{rng.randrange(500)}" for _ in range(150)]
    for i in range(150):
        c = list(crowd)
        for _ in range(4):
            c[rng.randrange(150)] = f"y{rng.randrange(10**6)}"
        rows.append((1000 + i, " ".join(c)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup(df, shingle=3, percent=85).collect()}
    assert got == components_by_force(rows, 3, 85) and dealt == ([4] if bound > 3 else [4, 8])


@pytest.mark.parametrize("n", [12, 150, 2000, 20_000])
def test_sketches_lose_nothing_and_sift(n):
    rng = np.random.default_rng(n)
    passed = {0.85: [], 0.6: []}
    for j, out in passed.items():
        for _ in range(40):
            u = round(n * 2 / (1 + j))
            m = int(np.ceil(j * u))
            h = mix(rng.integers(0, 2**63, u, dtype=np.uint64))
            half = (u - m) // 2
            a, b = np.sort(np.concatenate((h[:m], h[m : m + half]))), np.sort(np.concatenate((h[:m], h[m + half :])))
            sketch, sampled = odd_sketches(np.repeat([0, 1], [len(a), len(b)]), np.concatenate((a, b)), 2)
            apart = np.bitwise_count(sketch[0].view(np.uint64) ^ sketch[1].view(np.uint64)).sum()
            out.append(bool(may_link(np.array([apart]), np.array([len(a)]), np.array([len(b)]), sampled[:1], sampled[1:], 0.85 if j == 0.85 else 0.85)[0]))
    assert all(passed[0.85]) and (n < 100 or sum(passed[0.6]) == 0)
    assert (1 - 0.85**4) ** bands_for(0.85) <= 1e-6


def test_tokenizer_matches_the_library(spark, awkward, empty):
    import sentencepiece

    from quirelab.llm.piece_tokenizer import Vocabulary, coder, encode_decode
    from quirelab.llm.queries import piece_model

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    v = Vocabulary.load(piece_model())
    rng = random.Random(8)
    texts = ["", " ", "   a  b ", "abab" * 300, "a" * 999, "-" * 333, "\n\r\t x", "▁▁ ▁a", "<s><0x41>", "👩‍👧 é 日本"]
    texts += ["".join(rng.choice("aabet  \n▁éñ日1.=👩<0x>") for _ in range(rng.randrange(1, 120))) for _ in range(800)]
    for t, ids in zip(texts, coder(v).encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == sp.encode(t)
        whole = [1, *sp.encode(t), 2]
        assert coder(v).decode(np.array(whole, "<u4").tobytes()) == sp.decode(whole)
    assert coder(v).decode(np.array([3 + 0xE3, 3 + 0x81], "<u4").tobytes()) == sp.decode([3 + 0xE3, 3 + 0x81])
    got = encode_decode(awkward, v).collect()
    assert len(got) == awkward.count() and encode_decode(empty, v).count() == 0
    texts = defaultdict(list)
    for r in base_rows():
        texts[r[0]].append(r[1] or "")
    for r in got:
        expected = [1, *sp.encode(texts[r["doc_id"]][0]), 2]
        assert np.frombuffer(r["ids"], "<u4").tolist() == expected and r["n_tokens"] == len(expected) and r["decoded"] == sp.decode(expected)


def test_tokenizer_memory_is_bounded(monkeypatch):
    """What a worker remembers is counted in bytes and let go beyond a bound; ids stay the same."""
    from quirelab.llm import piece_tokenizer
    from quirelab.llm.queries import piece_model

    monkeypatch.setattr(piece_tokenizer, "CACHE", 100_000)
    c = piece_tokenizer.Coder(piece_tokenizer.Vocabulary.load(piece_model()))
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefgh") for _ in range(2000)) for _ in range(60)]
    first = [c.encode([t])[0] for t in texts]
    held = sum(piece_tokenizer.ENTRY + 4 * len(k) + len(v) for k, v in c.known.items())
    assert held == c.held < 100_000 + 20_000 and [c.encode([t])[0] for t in texts] == first


def test_substring_dedup(spark, awkward, empty):
    n, rows = 13, [r[:2] for r in base_rows()]
    first = {}
    for d, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words(t)
        for i in range(len(w) - n + 1):
            first.setdefault(tuple(w[i : i + n]), d)
    expected = defaultdict(list)
    for d, t in rows:
        w, gone = words(t), set()
        if d is not None:
            for i in range(len(w) - n + 1):
                if first[tuple(w[i : i + n])] < d:
                    gone.update(range(i, i + n))
        expected[d].append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    got = defaultdict(list)
    for r in substring_dedup(awkward).collect():
        got[r["doc_id"]].append((r["n_words"], r["n_removed"], r["kept"]))
    assert got == expected and substring_dedup(empty).count() == 0
    assert any(x[1] for v in expected.values() for x in v)


@pytest.mark.parametrize("straight", [1 << 21, 1])
def test_substring_dedup_many_blocks(spark, sf, monkeypatch, straight):
    """Small blocks and shards give the same result as one block, straight and by way of groups of blocks."""
    import quirelab.llm.substring_dedup as m

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one = sorted(map(tuple, substring_dedup(docs).collect()))
    monkeypatch.setattr(m, "BLOCK_BYTES", 40_000)
    monkeypatch.setattr(m, "SHARD", 9_000)
    monkeypatch.setattr(m, "STRAIGHT", straight)
    layout = m.Layout.of(docs.agg(F.sum(F.octet_length("text"))).first()[0])
    assert layout.blocks > 5 and layout.shard_bits > 2 and (layout.group > 1) == (straight == 1)
    assert sorted(map(tuple, substring_dedup(docs).collect())) == one


def test_sorted_numbers_are_packed():
    import quirelab.llm.substring_dedup as m

    rng = np.random.default_rng(5)
    for top, n in ((1, 1), (2, 2), (1 << 12, 700), (1 << 63, 900), ((1 << 64) - 1, 3), (1 << 40, 1)):
        x = np.unique(rng.integers(0, top, n, dtype=np.uint64))
        k, high, low = m.pack_sorted(x)
        assert (m.unpack_sorted(k, high, low, len(x)) == x).all()


def test_sketch_never_underestimates():
    """Counters of several nodes added up: a window of two documents is never taken for a single one, and few single ones for repeated."""
    import quirelab.llm.substring_dedup as m

    rng = np.random.default_rng(6)
    h = mix(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64))
    nodes = [np.append(h[i * 5000 : (i + 1) * 5000], h[:300]) for i in range(4)]
    bits = (20_000 * m.CELLS).bit_length()
    parts = []
    for i, x in enumerate(nodes):
        cell, count = np.unique(np.concatenate(m._cells(x, bits)), return_counts=True)
        parts.append(m._send(m.Entries(cell, count > 1), i, 64))
    e, _ = m._merge(m.pa.concat_tables(parts), 64)
    high = lambda x: np.logical_and.reduce([e.many[np.searchsorted(e.key, c)] for c in m._cells(x, bits)])
    assert high(h[:300]).all() and high(h[300:]).mean() < 0.03


def test_mixing(spark, awkward, empty):
    got = mix_sources(awkward).collect()
    assert len(got) == awkward.count() and mix_sources(empty).count() == 0
    sizes, by = defaultdict(int), defaultdict(list)
    for r in got:
        assert r["size"] == len(words(r["text"])) and 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * r["copies"]
        sizes[r["source"]] += r["size"]
        by[r["source"]].append(r)
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, free, target = float(sum(sizes.values())), set(names), {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            free.discard(s)
            left -= target[s]
    for s, rows in by.items():
        assert rows[0]["target"] == pytest.approx(target[s]) and rows[0]["source_size"] == sizes[s]
        assert abs(sum(r["taken"] for r in rows) - target[s]) <= 2 * max(r["size"] for r in rows) + 1
    again = mix_sources(awkward.repartition(3))
    assert sorted(str((r["doc_id"], r["taken"])) for r in got) == sorted(str((r["doc_id"], r["taken"])) for r in again.collect())
    assert emit_copies(again).count() == sum(r["copies"] for r in got)


def test_html(spark):
    page = (
        "<html><head><title>t</title><script>var a='<p>no</p>'</script><style>p{}</style></head><body><header class='site'>Site</header><nav><ul><li><a href=1>Home</a></li></ul></nav>"
        "<div class='cookie-notice'>We use cookies, please accept all of them now.</div><!-- <p>gone</p> --><article><h1>A &amp; B</h1><p>First  para\n with <a href=x>a link</a> inside.<p><b>Second<br>half &eacute;.</p>"
        "</article><div class='ad'>Buy this very good thing today.</div><form><p>Your name please</p></form><div id='comments'><p>A reader wrote a long comment here, with many words.</p></div><aside>More</aside><footer>&copy; x</footer>"
    )
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", "<p>"), (4, "u", "<article><p>x &lt; y</p></article>"), (4, "u", "<article><p>x &lt; y</p></article>"), (5, "u", "<article><p>" + "word " * 50_000 + "</article>"), (6, "u", "<<><a <p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("id", F.lit("clash"))
    got = html_extract.extract_main_text(df, html_extract.train(df)).collect()
    assert len(got) == len(rows) and html_extract.extract_main_text(df.limit(0)).count() == 0
    by = {r["page_id"]: r for r in got}
    assert by[1]["text"] == "A & B\n\nFirst para with a link inside.\n\nSecond half é." and by[1]["n_chars"] == len(by[1]["text"])
    assert by[2]["text"] == by[3]["text"] == "" and by[4]["text"] == "x < y" and by[5]["n_chars"] == 249_999


ARTICLE = "<nav><a href=1>Home</a></nav><article><h1>On the title of it</h1><p>First paragraph of the article, which has some words, and a comma.</p>{}<p>Another paragraph of the article, which has some words, too.</p></article><footer>F</footer>"
PROSE = "Others have done such things before, and we cite them."


@pytest.mark.parametrize(
    "inside,text",
    [
        ("<header class='entry-header'><h2>On squares</h2></header>", ["On squares"]), ("<p class='byline'>By A. Writer</p>", ["By A. Writer"]), ("<figure><img src=x><figcaption>Figure 1</figcaption></figure>", ["Figure 1"]),
        ("<p>is <math><msup><mi>a</mi><mn>2</mn></msup></math> here</p>", ["is a2 here"]), ("<math display='block'><mi>x</mi><mo>=</mo><mn>1</mn></math>", ["x=1"]), (f"<section class='related-work'><p>{PROSE}</p></section>", [PROSE]),
        (f"<section id='search'><h2>Search</h2><p>{PROSE}</p></section>", ["Search", PROSE]), ("<p class='tags-explained'>What tags are.</p>", ["What tags are."]), ("<noscript>Shown without scripts</noscript>", ["Shown without scripts"]),
        ("<div class='tags'>geometry, squares</div>", ["geometry, squares"]), ("<ul><li>one</li><li><a href=x>two</a></li></ul>", ["one", "two"]), ("<p>Pick <select><option>a</select> one, please.</p>", ["Pick one, please."]),
        ("<svg><title>no</title><text>Label</text></svg>", ["Label"]), ("<h2><button>Section</button></h2>", ["Section"]), ("<table><tr><td>1<td>2</table>", ["1", "2"]),
        (f"<div class='thread'><p>{PROSE}</p></div>", []), (f"<div class='comments'><p>{PROSE}</p></div>", []), (f"<aside><p>{PROSE}</p></aside>", []), ("<div class='share'>Share this</div>", []), (f"<div class='ad-slot'>{PROSE}</div>", []),
        ("<div class='cookie-notice'>We use cookies.</div>", []), ("<div class='related-posts'><h3>Related posts</h3><ul><li><a href=1>One post</a></ul></div>", []), ("<form><p>Your name</p><input></form>", []), (f"<div hidden>{PROSE}</div>", []),
    ],
)
def test_html_article(inside, text):
    """What is part of an article stays, whatever it is called; the same names outside, and what is no part of it, go."""
    got = html_extract.main_text(ARTICLE.format(inside)).split("\n\n")
    assert got == ["On the title of it", "First paragraph of the article, which has some words, and a comma.", *text, "Another paragraph of the article, which has some words, too."]


def test_html_cut_decides_without_names(spark, sf):
    """Pages whose elements and classes are all taken away: the cut changes labels, and finds the article better than costs alone."""
    pages = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/pages.parquet")
    model = html_extract.train(pages.filter("page_id % 2 = 0"))
    hits, found, all_, changed = [0, 0], [0, 0], 0, 0
    for (html,) in pages.filter("page_id % 2 = 1").select("html").collect():
        inside = Counter(b.text for b in html_extract.blocks(html[html.index("<article>") : html.index("</article>")]))
        bare = html_extract.blocks(re.sub(r"<(/?)(article|nav|footer)\b[^>]*>", r"<\1div>", re.sub(r' class="[^"]*"', "", html)), model)
        costs = [html_extract.cost(b, model, False) for b in bare]
        alone, cut = [c > 0 for c in costs], html_extract.min_cut(costs, html_extract.edges(bare, model))
        changed += alone != cut
        all_ += inside.total()
        for i, keep in enumerate((alone, cut)):
            got = Counter(b.text for b, k in zip(bare, keep, strict=True) if k)
            hits[i] += (got & inside).total()
            found[i] += got.total()
    assert changed > 0 and hits[1] / all_ >= 0.99 and hits[1] / found[1] >= 0.99 and hits[1] / found[1] > hits[0] / found[0]


@pytest.mark.parametrize("piece", ["<svg>", "<p <a '", "<textarea>", "<select>", "<div></p></q>", "</table>", "<table><td>", "<a href='", "<li>x", '<a ">" ', "<!--"])
def test_html_time_is_linear(piece):
    html_extract.main_text(piece * 100)
    began = time.process_time()
    html_extract.main_text(piece * 100_000)
    assert time.process_time() - began < 10


def test_min_cut_is_least():
    """Against every labelling of small graphs."""
    rng = random.Random(2)
    for _ in range(150):
        n = rng.randrange(1, 10)
        costs = [rng.uniform(-2, 2) for _ in range(n)]
        links = {(i, j): rng.uniform(0, 2) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5}
        price = lambda y: sum(abs(c) for c, k in zip(costs, y) if (c > 0) != k) + sum(w for (i, j), w in links.items() if y[i] != y[j])  # noqa: E731, B023
        best = min(price([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert price(html_extract.min_cut(costs, links)) == pytest.approx(best)


def test_line_dedup(spark, awkward, empty):
    docs = defaultdict(list)
    for d, t, *_ in base_rows():
        docs[d, t].append(t)
    order = sorted(docs, key=lambda k: (k[0] is None, k[0] or 0))
    first = {}
    for key in order:
        ls = key[1].split("\n") if key[1] is not None else []
        for i in range(len(ls) - 2):
            if words("".join(ls[i : i + 3])):
                first.setdefault(tuple(ls[i : i + 3]), (key, i))
    expected = {}
    for key in order:
        ls, gone = key[1].split("\n") if key[1] is not None else [], set()
        for i in range(len(ls) - 2):
            if words("".join(ls[i : i + 3])) and first[tuple(ls[i : i + 3])] != (key, i):
                gone.update(range(i, i + 3))
        expected[key[0]] = (len(ls), len(gone), None if key[1] is None else "\n".join(x for i, x in enumerate(ls) if i not in gone))
    got = line_dedup(awkward).collect()
    assert len(got) == awkward.count() and line_dedup(empty).count() == 0
    for r in got:
        assert (r["n_lines"], r["n_removed"], r["text"]) == expected[r["doc_id"]]
    plan = line_dedup(awkward)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


