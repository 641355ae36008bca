"""The stages of the corpus pipeline, each against what it should do to its own input."""

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, f in pipeline.STAGES:
        docs = f(spark, docs, sf).cache()
        out.append((name, docs))
    return dict(out)


def test_columns(stages, spark, sf):
    names = list(stages)
    assert names == ["language_id", "line_dedup", "near_dedup", "mixing", "sentencepiece"]
    for n in names[:-1]:
        assert stages[n].columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_language_keeps_clean_documents(stages, spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert stages["language_id"].count() >= 0.97 * docs.count()
    odd = spark.createDataFrame([(1, None, "en", "s", 0), (2, "123 456", "en", "s", 7)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = pipeline.identify_language(spark, docs.unionByName(odd.withColumn("doc_id", -F.col("doc_id"))), sf).filter("doc_id < 0").count()
    assert kept == 0


def test_each_stage_works_on_all_before(stages):
    assert stages["line_dedup"].count() == stages["language_id"].count()
    lines = stages["line_dedup"]
    assert lines.filter(F.char_length("text") != F.col("n_chars")).count() == 0
    near = pipeline.near_dedup(lines, shingle=5, percent=80)
    assert stages["near_dedup"].count() == near.filter("kept").count()
    mixed = pipeline.mix_sources(stages["near_dedup"])
    assert stages["mixing"].count() == mixed.agg(F.sum("copies")).first()[0]
    assert stages["sentencepiece"].count() == stages["mixing"].count()


def test_tokens_decode_to_the_text(stages):
    text = stages["mixing"].select("doc_id", F.sha2("text", 256).alias("a")).distinct()
    assert stages["sentencepiece"].select("doc_id", F.col("decoded_sha256").alias("a")).distinct().exceptAll(text).count() == 0


def test_run(spark, sf, stages):
    assert pipeline.run(spark, sf).count() == stages["sentencepiece"].count()


ODD = [(1, None, "en", "s", None), (2, "", None, "s", 0), (3, " \n\t", "en", None, 3), (None, "la li lu le", "en", "s", 11), (4, "la li lu le", "en", "s", 11), (4, "la li lu le", "en", "s", 11), (5, "ka ki ku ke " * 9000, "fr", "t", 9), (6, "123 !", "fr", "t", 5)]
ODD += [(10 + i, "same\nlines\nhere\n" + "na ni nu ne no " * 20 + f"x{i}", "en", "s", 1) for i in range(4)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_odd_rows(spark, sf, name):
    """Nulls, empty and long texts, repeated rows, columns with clashing names, and an empty table."""
    stage = dict(pipeline.STAGES)[name]
    odd = spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit("x") for c in ("id", "score", "size", "n_lines", "kept", "_text", "block")})
    out = stage(spark, odd, sf)
    rows = sorted(out.collect(), key=str)
    ids = [r["doc_id"] for r in rows]
    if name == "language_id":
        assert sorted(ids, key=str) == sorted([None, 4, 4, 5, 10, 11, 12, 13], key=str)
    elif name == "line_dedup":
        assert len(rows) == len(ODD) and {r["doc_id"]: r["text"] for r in rows}[1] is None
        assert [r["text"].startswith("same") for r in rows if (r["doc_id"] or 0) >= 10] == [True, False, False, False]
    elif name == "near_dedup":
        assert sorted(ids, key=str) == sorted([1, 2, 3, None, 4, 4, 5, 6, 10], key=str)
    elif name == "mixing":
        assert set(ids) <= {r[0] for r in ODD} and out.columns == list(pipeline.COLUMNS)
    else:
        assert len(rows) == len(ODD) and {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2)} == {2}
    assert stage(spark, odd.limit(0), sf).count() == 0


def test_run_on_an_empty_table(spark, sf, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
