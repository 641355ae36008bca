"""A corpus from raw documents: language, repeated lines, near copies, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as Parquet in the shared
folder and reads them again as the next one's documents.

Every stage takes an empty table and returns one, and ignores columns that are not those of documents. Texts of any length
go through whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelab.llm import language_id, piece_tokenizer
from quirelab.llm._store import Workspace
from quirelab.llm.line_dedup import line_dedup
from quirelab.llm.mixing import emit_copies, mix_sources
from quirelab.llm.near_dedup import near_dedup
from quirelab.llm.queries import piece_model

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document whose best language has less of the likelihood than this has no language.
LEAST_SCORE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that the classifier recognises; null text, text without letters, or torn between languages, goes.

    Repeated and null ids stay as rows, each by its own text. Where no row has a language to learn from, all go."""
    model = language_id.train(docs.filter(~language_id.held_out(F.col("doc_id"))))
    rows = docs.select(*COLUMNS).filter("text is not null").withColumn("_text", F.md5("text"))  # texts don't travel: the verdict is one of the text alone
    found = language_id.identify(rows, model, keep=["_text"])
    gone = found.filter((F.col("lang_pred") == "und") | (F.col("score") < LEAST_SCORE)).select("_text").distinct()
    gone = Workspace(spark, "pipeline").save(gone, "no-language")
    model.close()
    return rows.join(gone, "_text", "left_anti").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines that a repeated passage of three lines covers.

    Null text stays null, with a null n_chars; empty text stays. Rows that share id and text count as one document and lose the same lines. Null ids come last."""
    out = line_dedup(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more; of a group the smallest id stays.

    Null and empty texts are nobody's copies and stay, and so do rows with a null id. Rows that share an id stay or go together."""
    rows = docs.select(*COLUMNS)
    gone = near_dedup(rows, shingle=5, percent=80).filter(~F.col("kept")).select("doc_id").distinct()
    return rows.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target mixture takes them.

    Texts without words, null ones too, weigh nothing and are taken like others of their source. A null source is a source of its own. Equal rows count separately."""
    return emit_copies(mix_sources(docs.select(*COLUMNS))).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of the token ids of each document, and a digest of what they decode to.

    Null and empty text: begin and end alone. Repeated and null ids stay as rows."""
    out = piece_tokenizer.encode_decode(docs, piece_tokenizer.Vocabulary.load(piece_model()))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix),
    ("sentencepiece", tokenize),
]

#: Language scores, MinHash candidates and token merges are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ws = Workspace(spark, "pipeline")
    before = None
    for name, stage in STAGES:
        after = ws.save(stage(spark, docs, sf_dir), name)
        if before is not None:
            ws.drop(before)
        docs = before = after
    return docs
