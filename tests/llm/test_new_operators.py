"""Source divergence, prefix trie and fingerprints against brute force and on awkward tables; one row as a third of a table."""

import functools
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelab.llm import fingerprints as prints
from quirelab.llm import prefix_trie as trie
from quirelab.llm import quality, vector_search
from quirelab.llm.fingerprints import CELLS, PARAGRAPH, PARTS, fingerprints, paragraphs, peel, sketch
from quirelab.llm.near_dedup import near_dedup
from quirelab.llm.source_divergence import source_divergence
from quirelab.llm.substring_dedup import substring_dedup

DOCS = "doc_id long, text string, lang string, source string"
SCALE = 1_000_000_000


# ---- source divergence


def brute_divergence(rows, min_docs, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df, total, by = Counter(), Counter(), defaultdict(Counter)
        for la, so, terms in docs:
            if la == lang:
                df.update(set(terms))
                total.update(terms)
                by[so].update(terms)
        kept = [t for t in df if df[t] >= min_docs]
        share = lambda c: {t: 1 + SCALE * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        q = share(total)
        p = {so: share(c) for so, c in by.items()}
        apart = lambda a, b: (a - b) ** 2 // (a + b)
        for so in p:
            pairs = [(sum(apart(p[so][t], p[o][t]) for t in kept), o) for o in p if o != so]
            terms = [(apart(p[so][t], q[t]), t) for t in kept if by[so][t] > 0 and p[so][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, so, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)]
    return sorted(out)


def test_source_divergence(spark):
    rng = random.Random(1)
    words = ["Aa", "aa", "b", "Éé", "日本", "c'd", "x1y", "zz"]
    rows = [(i % 9, " ".join(rng.choices(words, k=rng.randrange(8))), rng.choice(["en", "en", "fr", None]), rng.choice(["s", "t", "u", None])) for i in range(80)]
    rows += [(None, None, "en", "none"), (1, "", "de", "s"), (1, "aa", "de", "t"), (3, "\x00 12 _ @", "xx", ""), (5, "a " * 4000, "en", "long")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS + ", item long, rank string").repartition(3)
    for min_docs, top in ((3, 2), (1, 10)):
        got = source_divergence(df, min_docs=min_docs, top=top)
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert sorted(map(tuple, got.collect())) == brute_divergence(rows, min_docs, top)
    assert source_divergence(df.limit(0)).count() == 0


def test_shares_pass_64_bits(spark):
    from quirelab.llm.source_divergence import _apart, _share

    big = 9_000_000_000_000_000_000
    got = spark.range(1).select(_share(F.lit(big), F.lit(big), F.lit(5).cast("long")).alias("p"), _apart(F.lit(SCALE + 1).cast("long"), F.lit(1).cast("long")).alias("f")).first()
    assert got["p"] == 1 + SCALE * (big + 2) // (big + 10) and got["f"] == SCALE**2 // (SCALE + 2)


# ---- prefix trie


def brute_trie(rows, grafted):
    conv = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            conv[c].append(((t is not None, t or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()), (role, text)))
    conv = {c: tuple(x[1] for x in sorted(ts)) for c, ts in conv.items()}
    built = {}
    for c, ts in conv.items():
        h = zlib.crc32(str(c).encode()) % 4 if grafted else 0
        built[c] = (conv.get(c - int(math.fmod(c, 20)), ())[:h] if grafted else ()) + ts[h:]
    nodes, kids = defaultdict(list), defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            nodes[ts[:d]].append(c)
    for k in nodes:
        if k:
            kids[k[:-1]].append(k)

    @functools.cache
    def below(k):
        own = (len(nodes[k]) - 1) * (len(k[-1][1].split()) if k else 0)
        each = [below(x) for x in kids[k]]
        return sum(a for a, _ in each) or 1, own + sum(b for _, b in each)

    row = lambda k, m: (min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), len(kids[k]), *below(k), hashlib.sha256(",".join(map(str, sorted(c for c in m if len(built[c]) == len(k)))).encode()).hexdigest())
    return sorted((row(k, m) for k, m in list(nodes.items())), key=str)


def built_trie(df, grafted):
    seqs = trie.sequences(df)
    if grafted:
        c = F.col("conv_id")
        seqs = trie.with_heads_of(seqs, c - c % 20, F.crc32(c.cast("string").cast("binary")) % 4)
    return sorted(map(tuple, trie.prefix_trie(seqs).collect()), key=str)


@pytest.mark.parametrize("seed,grafted", [(0, True), (1, False), (2, False), (3, True)])
def test_prefix_trie(spark, seed, grafted):
    rng = random.Random(seed)
    rows = []
    for c in range(150):
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c * (7 if seed == 3 else 1) - 20, t if rng.random() < 0.95 else None, rng.choice(["u", "u", "a", None]), rng.choice(["x", "x", "x", "y z", "w", None] if seed else ["x", "x", "x y"])))
    rows += [(None, 0, "u", "x"), (None, None, None, None)] + [(5000, t, "u", "x") for t in range(300)] + [(5001, t, "u", "x" if t < 200 else "v") for t in range(260)] + rows[:3]
    df = spark.createDataFrame([(*r, "e") for r in rows], "conv_id long, turn long, role string, text string, depth string").repartition(4)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")  # so that small ranges go to tasks of their own
    try:
        assert built_trie(df, grafted) == brute_trie(rows, grafted)
    finally:
        spark.conf.unset(key)


def test_prefix_trie_of_one_range_for_each_row(spark):
    rows = [(c, t, "u", w) for c, words in enumerate(["abc", "abd", "ab", "xyz", "xy", "abc", "q", "abcde"]) for t, w in enumerate(words)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        assert built_trie(df, False) == brute_trie(rows, False)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_prefix_trie_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert built_trie(df, True) == [] and built_trie(spark.createDataFrame([(None, 1, "u", "x")], df.schema), False) == []
    alone = spark.createDataFrame([(7, 0, "u", "a"), (7, 1, "u", "b"), (7, 2, "u", "c")], df.schema)  # an absent head leaves one turn at most
    assert built_trie(alone, True) == brute_trie([tuple(r) for r in alone.collect()], True)


# ---- fingerprints


def brute_fingerprints(rows):
    docs = sorted({(i is None, i or 0, hashlib.md5((t or "").encode()).hexdigest(), t or "") for i, t in rows})
    parts = lambda t: set(re.findall(PARAGRAPH, t))
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    out = {}
    for at, d in enumerate(docs):
        text, after = d[3], docs[(at + 1) % len(docs)][3]
        n = len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        p = parts(text)
        out[d] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), like(p, parts(edited)), like(p, parts(after)), len(p), len(p ^ parts(edited)))
    return Counter((i, *out[(i is None, i or 0, hashlib.md5((t or "").encode()).hexdigest(), t or "")]) for i, t in rows)


def test_fingerprints(spark):
    rng = random.Random(2)
    para = lambda n: " ".join(rng.choice(["ab", "c.", "d!", "éf", "g", "日本"]) for _ in range(n))
    rows = [(i, "\n".join(para(rng.randrange(30)) for _ in range(rng.choice([0, 1, 5, 40])))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "x" * 50_000), (103, "".join(f"w{i}. " for i in range(4000))), (103, "".join(f"w{i}. " for i in range(3900))), (None, "a. b."), (None, "a. c."), (104, rows[3][1]), (105, rows[3][1])] + [(106, "same. row.")] * 30
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, place string, k long").repartition(5)
    got = fingerprints(df).collect()
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"], r["n_paragraphs"], r["n_differing"]) for r in got) == brute_fingerprints(rows)
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add(r["fingerprint"])
    assert by[104] == by[105] and len(by[106]) == 1 and by[100] == by[101] == {""} and by[102] != by[106]
    assert fingerprints(df.limit(0)).count() == 0
    one = fingerprints(df.filter("doc_id = 102")).first()
    assert one["near_next"] == 1.0


def test_sketches_give_their_difference(spark):
    a = "\n".join(f"line {i}" for i in range(100))
    b = "\n".join(f"line {i}" for i in range(4, 103))
    d = spark.createDataFrame([("x", a, 1), ("x", b, -1)], "k string, text string, sign int")
    sets = d.select("k", F.explode(paragraphs(F.col("text"))).alias("key"), "sign")
    left = peel(sketch(sets, ["k"]), ["k"])
    told = {r["digest"]: r["n"] for r in left.filter("cell = -1").collect()}
    digest = {r["t"]: r["h"] for r in spark.createDataFrame([(f"line {i}",) for i in range(103)], "t string").withColumn("h", F.xxhash64("t")).collect()}
    assert left.filter("cell >= 0").isEmpty()
    assert told == {digest[f"line {i}"]: 1 if i < 4 else -1 for i in (*range(4), *range(100, 103))}
    full = peel(sketch(sets.filter("sign = 1"), ["k"]), ["k"])  # a hundred digests are too many for one sketch
    assert 0 < full.filter("cell >= 0").count() <= PARTS * CELLS


def test_unlike_texts_are_not_put_into_small_sketches(spark, monkeypatch):
    """Of texts with hundreds of paragraphs apart, only the fingerprints themselves are sketched: each digest of the text and of the edited text once."""
    rows = [(i, "".join(f"w{i}-{j}. " for j in range(300))) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    put, sketched = [], prints.sketch
    monkeypatch.setattr(prints, "sketch", lambda sets, by: put.append(sets.count()) or sketched(sets, by))
    got = fingerprints(df).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "n_chars", "edited_sha256", "near_edited", "near_next", "n_paragraphs", "n_differing")) for r in got) == brute_fingerprints(rows)
    assert 6 * 500 < sum(put) < 6 * 700


@pytest.mark.parametrize("guess", [True, False])
def test_likeness_does_not_hang_on_guesses(spark, monkeypatch, guess):
    """All pairs tried in a small sketch, or none; larger sketches that begin far too small."""
    monkeypatch.setattr(prints, "within_reach", lambda a, b: F.lit(guess))
    monkeypatch.setattr(prints, "ROOM_BITS", -6)
    rows = [(i, "".join(f"w{j}. " for j in range(i % 3, n))) for i, n in enumerate([0, 1, 3, 30, 60, 60, 300, 303, 3000, 0, 2500])] + [(None, None), (3, "a. a. b"), (3, "a. a. b")]
    got = fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "n_chars", "edited_sha256", "near_edited", "near_next", "n_paragraphs", "n_differing")) for r in got) == brute_fingerprints(rows)


def test_fingerprints_use_no_python(spark, sf):
    plan = fingerprints(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "MapIn" not in plan


# ---- rows that make up much of a table


def test_one_long_label_costs_itself_only(spark):
    rows = [(i, ("good words here " if i % 2 else "bad stuff there ") * 40) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(41)], "doc_id long, quality int, toxic int")
    docs = lambda extra: spark.createDataFrame(rows + extra, "doc_id long, text string")
    model = quality.train(docs([]), labels, sample_bytes=1 << 20)
    again = quality.train(docs([(40, "good " * 30000)]), labels, sample_bytes=1 << 20)
    assert np.array_equal(model.weights, again.weights) and model.weights.any()
    with pytest.raises(ValueError, match="longer"):
        quality.train(spark.createDataFrame([(40, "good " * 30000)], "doc_id long, text string"), labels, sample_bytes=1 << 20)


def test_one_row_as_a_third(spark):
    text, near = " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(61))
    rows = [(1, text)] * 300 + [(2, near)] * 300 + [(i, f"other {i} " * 20) for i in range(10, 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter(tuple(r) for r in near_dedup(df, shingle=3, percent=85).select("doc_id", "component_id", "kept").collect())
    assert got[(1, 1, True)] == 300 and got[(2, 1, False)] == 300 and sum(got.values()) == len(rows)
    cut = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup(df).collect())
    assert cut[(1, 60, 0, text)] == 300 and cut[(2, 61, 60, "w60")] == 300 and sum(cut.values()) == len(rows)


def test_very_large_and_very_small_components(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 8))
    rows = [(i, (v * (1e200 if i % 3 == 0 else 1e-200 if i % 3 == 1 else 1)).tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in vector_search.nearest(df, F.col("vec_id") % 20 == 0, k=3, recall=1.0).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in (0, 20, 40):
        near = u @ u[q]
        near[q] = -2
        best = np.argsort(-near)[:3]
        assert [got[(q, k + 1)][0] for k in range(3)] == best.tolist()
        assert np.allclose([got[(q, k + 1)][1] for k in range(3)], near[best])


# ---- learned costs of pages


def read_simply(html):
    """The article between its tags, cut at every tag that isn't known to stand within a line."""
    import html as entities

    inside = html[html.index("<article>") + 9 : html.index("</article>")]
    cut = re.sub(r"<(?!/?(?:a|b|i|em|strong|span|br|code|sup|sub)\b)[^>]*>", "\0", re.sub(r"<!--.*?-->|<(script|style)\b.*?</\1>", "", inside, flags=re.S))
    parts = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br\b[^>]*>", " ", p))).split()) for p in cut.split("\0")]
    return "\n\n".join(p for p in parts if p)


@pytest.fixture(scope="module")
def learned(spark, sf):
    from quirelab.llm import html_extract

    pages = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/pages.parquet")
    return pages, html_extract.train(pages)


def test_pages_as_read_simply(learned):
    from quirelab.llm import html_extract

    pages, model = learned
    for r in pages.select("html").collect():
        assert html_extract.main_text(r["html"], model) == read_simply(r["html"])
        foreign = r["html"].replace('class="ad"', 'class="werbung"')
        assert html_extract.main_text(foreign, model) == read_simply(r["html"])


PAGE = "<nav><a href=x>Home</a></nav><article><h1>Title here</h1><p>First paragraph of the text, which is long enough.</p>{}<p>Second paragraph of the text, with a few words.</p></article>{}<footer>(c) someone</footer>"
OTHER = "I liked this article very much, thank you for writing it."


@pytest.mark.parametrize("inside,outside,kept", [
    (f"<section class='promotion-of-health'><p>{OTHER}</p></section>", "", True), ("", f"<div class=c2><div class=u><p>{OTHER}</p></div></div>", False), ("", f"<div class=werbung><p>{OTHER}</p></div>", False),
    (f"<div class=ad><p>{OTHER}</p></div>", "", False), (f"<article><p>{OTHER}</p></article>", "", False), ("", f"<article class=comment><p>{OTHER}</p></article>", False), (f"<p hidden>{OTHER}</p>", "", False),
    (f"<section class=related-work><p>{OTHER}</p></section>", "", True), (f"<aside><p>{OTHER}</p></aside>", "", False),
])
def test_learned_costs_decide(learned, inside, outside, kept):
    from quirelab.llm import html_extract

    assert (OTHER in html_extract.main_text(PAGE.format(inside, outside), learned[1])) == kept


def test_names_start_at_nothing(learned):
    from quirelab.llm import html_extract

    shown = ~np.isnan(learned[1].names)
    assert 0 < shown.sum() < 50 and learned[1].weight("c:ad") < -1 and not np.isnan(learned[1].names[html_extract.bucket("c:ad")])
