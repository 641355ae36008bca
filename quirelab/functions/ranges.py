"""Page ranges as array<struct<start, end>> columns: parsing, chunking, expanding, membership.

Parsers give struct<ranges, error>: error is null, or a code of the first part that is wrong.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGES = "array<struct<start:int,end:int>>"
SPACE = r"[\s ﻿]+"


def _parts(spec: Column) -> Column:
    trimmed = F.transform(F.split(F.coalesce(spec, F.lit("")), ","), lambda p: F.regexp_replace(p, f"^{SPACE}|{SPACE}$", ""))
    return F.filter(trimmed, lambda p: p != "")


def _result(parts: Column, one, error) -> Column:
    """Ranges of the parts, or the error of the first bad one."""
    errors = F.filter(F.transform(parts, error), lambda e: e.isNotNull())
    first = F.when(F.size(parts) == 0, F.lit("empty")).otherwise(F.get(errors, F.lit(0)))
    return F.struct(F.when(first.isNull(), F.transform(parts, one)).cast(RANGES).alias("ranges"), first.alias("error"))


def parse_ranges(spec: Column, total: Column) -> Column:
    """"1-5, 8" to ranges: order and overlaps stay. Errors: empty, format, start, end (out of 1..total), reversed."""
    start = lambda p: F.regexp_extract(p, r"^(\d+)(?:-(\d+))?$", 1)
    last = lambda p: F.regexp_extract(p, r"^(\d+)(?:-(\d+))?$", 2)
    number = lambda s: F.try_to_number(F.when(s == "", None).otherwise(s), F.lit("9" * 18)).cast("long")

    def bounds(p: Column) -> tuple[Column, Column]:
        a = number(start(p))
        return a, F.coalesce(number(last(p)), a)

    def error(p: Column) -> Column:
        a, b = bounds(p)
        return (
            F.when(~p.rlike(r"^\d+(-\d+)?$"), "format")
            .when(a.isNull() | (a < 1) | (a > total), "start")
            .when((b < 1) | (b > total), "end")
            .when(a > b, "reversed")
        )

    def one(p: Column) -> Column:
        a, b = bounds(p)
        return F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))

    return _result(_parts(spec), one, error)


def parse_page_list(spec: Column, total: Column) -> Column:
    """"1, 3, 5" to one-page ranges; what follows a part's leading number is ignored. Errors: empty, number, bounds."""
    lead = lambda p: F.regexp_extract(p, r"^([+-]?\d+)", 1)
    number = lambda p: F.when(lead(p) != "", lead(p)).cast("int")
    error = lambda p: F.when(lead(p) == "", "number").when((number(p) < 1) | (number(p) > total), "bounds")
    return _result(_parts(spec), lambda p: F.struct(number(p).alias("start"), number(p).alias("end")), error)


def fixed_ranges(n: Column, total: Column) -> Column:
    """Chunks of n pages, the last one short. Error: size."""
    at = F.when((n >= 1) & (total >= 1), F.sequence(F.lit(1), total, F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    ranges = F.transform(at, lambda i: F.struct(i.cast("int").alias("start"), F.least(i + n - 1, total).cast("int").alias("end")))
    error = F.when(n < 1, F.lit("size"))
    return F.struct(F.when(error.isNull(), ranges).cast(RANGES).alias("ranges"), error.alias("error"))


def size_ranges(n: Column, total: Column) -> Column:
    """As fixed_ranges, but a chunk must be smaller than the document. Errors: size, too_large."""
    error = F.when((n < 1) | (n != F.floor(n)), "size").when(n >= total, "too_large")
    whole = fixed_ranges(n.cast("int"), total)
    return F.struct(F.when(error.isNull(), whole["ranges"]).cast(RANGES).alias("ranges"), error.alias("error"))


def expand(ranges: Column) -> Column:
    """Page numbers of ranges, once each, ascending."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(ranges, lambda r: F.sequence(r["start"], r["end"])))))


def contains(ranges: Column, page: Column) -> Column:
    return F.exists(ranges, lambda r: (page >= r["start"]) & (page <= r["end"]))


def selected_pages(mode: Column, first: Column, last: Column, total: Column) -> Column:
    """All pages, or first..last as far as there are pages; none if a bound is missing or they are reversed."""
    some = F.when((first <= last) & (first <= F.least(last, total)), F.sequence(first, F.least(last, total)))
    empty = F.array().cast("array<int>")
    whole = F.when(total > 0, F.sequence(F.lit(1), total)).otherwise(empty)
    return F.when(mode == "all", whole).otherwise(F.coalesce(some, empty))


def toggle(pages: Column, page: Column) -> Column:
    """The sorted page list without the page if it has it, else with it."""
    return F.when(F.array_contains(pages, page), F.filter(pages, lambda p: p != page)).otherwise(F.array_sort(F.array_append(pages, page)))
