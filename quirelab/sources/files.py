"""Files as rows: bytes, sheet names of workbooks, text of word-processor files; text files as a sink."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, name, size_bytes, content); many small files share a task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size_bytes"), "content")


def _names(content: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("xl/workbook.xml"))
    return [s.attrib["name"] for s in root.iter() if s.tag.rpartition("}")[2] == "sheet"]


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _value(e: ElementTree.Element) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == "val"), None)


def _text(p: ElementTree.Element) -> str:
    return "".join(t.text or "" if _local(t) == "t" else " " for t in p.iter() if _local(t) in ("t", "tab", "br"))


def _docx(content: bytes) -> dict:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = next(e for e in ElementTree.fromstring(z.read("word/document.xml")).iter() if _local(e) == "body")
    page, paragraphs, styles, tables = 1, [], [], []
    for e in body.iter():
        kind = _local(e)
        if kind == "p":
            page += any(_local(x) == "pageBreakBefore" and _value(x) in (None, "true", "1", "on") for x in e.iter())
            paragraphs.append({"page": page, "text": _text(e)})
        elif kind == "pStyle" and re.fullmatch(r"Heading\d|Title", _value(e) or ""):
            styles.append(_value(e))
        elif kind == "tbl":
            rows = [r for r in e.iter() if _local(r) == "tr"]
            tables.append({"rows": len(rows), "columns": max((sum(_local(c) == "tc" for c in r.iter()) for r in rows), default=0)})
    return {"paragraphs": paragraphs, "headings": styles, "tables": tables}


def _tolerant(read, otherwise):
    def one(content: bytes | None):
        try:
            return read(content) if content else otherwise
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, OSError, StopIteration):
            return otherwise

    return one


@F.pandas_udf(types.ArrayType(types.StringType()))
def sheet_names(content: pd.Series) -> pd.Series:
    """Sheet names of a workbook; an empty list for anything that can't be read as one."""
    return content.map(_tolerant(_names, []))


def _struct(**fields: types.DataType) -> types.StructType:
    return types.StructType([types.StructField(k, t) for k, t in fields.items()])


DOCX = _struct(
    paragraphs=types.ArrayType(_struct(page=types.IntegerType(), text=types.StringType())), headings=types.ArrayType(types.StringType()),
    tables=types.ArrayType(_struct(rows=types.IntegerType(), columns=types.IntegerType())),
)


@F.pandas_udf(DOCX)
def docx_scan(content: pd.Series) -> pd.DataFrame:
    """Paragraphs of a word-processor file with the page that they stand on by page breaks before paragraphs, styles of its headings, and sizes of its tables; empty lists for anything that can't be read as one."""
    return pd.DataFrame([_tolerant(_docx, {"paragraphs": [], "headings": [], "tables": []})(c) for c in content], columns=["paragraphs", "headings", "tables"])


def keep_sheets(sheets: DataFrame, chosen: DataFrame) -> DataFrame:
    """Sheets (path, sheet) that are chosen; a file for which none is chosen keeps all."""
    some = chosen.select("path").distinct().withColumn("_some", F.lit(True))
    hit = chosen.select("path", "sheet").distinct().withColumn("_hit", F.lit(True))
    both = sheets.join(some, "path", "left").join(hit, ["path", "sheet"], "left")
    return both.filter(F.col("_some").isNull() | F.col("_hit")).drop("_some", "_hit")


def write_text(texts: DataFrame, path: str) -> None:
    """One text column as UTF-8 text files."""
    texts.select(F.col(texts.columns[0]).cast("string").alias("value")).write.mode("errorifexists").text(path)
