"""Sizes, names, scores and labels, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_BYTES = 50 * 1024 * 1024
# Image name endings and media types that are taken.
IMAGE_ENDINGS = ("jpg", "jpeg", "png", "webp", "gif", "bmp")
IMAGE_TYPES = ("image/jpeg", "image/png", "image/webp", "image/gif", "image/bmp")


def half_up(x: Column) -> Column:
    """Rounds halves toward positive infinity."""
    return F.floor(x + 0.5)


def extension(name: Column) -> Column:
    return F.lower(F.element_at(F.split(name, r"\."), -1))


def pdf_error(name: Column, mime: Column, size: Column) -> Column:
    return F.when(~(F.coalesce(mime == "application/pdf", F.lit(False)) | F.lower(name).endswith(".pdf")), "type").when(size > MAX_BYTES, "size")


def image_error(name: Column, mime: Column, size: Column) -> Column:
    known = extension(name).isin(*IMAGE_ENDINGS) | F.coalesce(mime.isin(*IMAGE_TYPES), F.lit(False))
    return F.when(~known, "type").when(size > MAX_BYTES, "size")


def file_size(n: Column) -> Column:
    """1024-based size with one decimal at most, none if it is zero."""
    i = F.when(n < 1024, 0).when(n < 1024**2, 1).when(n < 1024**3, 2).otherwise(3)
    tenths = F.floor(n * 10 / F.pow(F.lit(1024.0), i) + 0.5).cast("long")
    whole, rest = F.floor(tenths / 10).cast("string"), (tenths % 10).cast("string")
    unit = F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB"))), i + 1)
    return F.concat(whole, F.when(tenths % 10 == 0, F.lit("")).otherwise(F.concat(F.lit("."), rest)), F.lit(" "), unit)


def report_size(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, F.format_string("%.1f KB", n / 1024)).otherwise(F.format_string("%.2f MB", n / 1024**2))


def password_score(p: Column) -> Column:
    one = lambda c: F.when(c, 1).otherwise(0)
    n = F.char_length(p)
    return one(n > 5) + one(n > 8) + one(p.rlike("[A-Z]")) + one(p.rlike("[a-z]")) + one(p.rlike("[0-9]")) + one(p.rlike("[^A-Za-z0-9]"))


def password_label(score: Column) -> Column:
    return F.when(score == 0, "None").when(score < 3, "Weak").when(score < 5, "Medium").otherwise("Strong")


def health_score(c: dict[str, Column]) -> Column:
    """100 less what each finding takes; object and stream errors take 15 and 10 at most."""
    lost = lambda ok, n: F.when(ok, 0).otherwise(n)
    total = (
        100 - lost(c["header"], 25) - lost(c["eof"], 15) - lost(c["xref"], 20) - lost(c["trailer"], 15)
        - F.when(c["encrypted"] & ~c["strict"], 30).otherwise(0) - lost(c["strict"], 20) - lost(c["tolerant"], 30)
        - F.least(c["object_errors"] * 3, F.lit(15)) - F.least(c["stream_errors"] * 2, F.lit(10)) - lost(c["metadata"], 3)
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("int")


def health_label(score: Column) -> Column:
    return F.when(score >= 90, "Excellent").when(score >= 70, "Good").when(score >= 50, "Fair").otherwise("Poor")


def recovery(encrypted: Column, tolerant: Column, recoverable: Column, critical: Column, fixable: Column) -> Column:
    """Status code and chance of repair from counts of critical and fixable issues."""
    status = (
        F.when(encrypted, "locked").when(~tolerant & ~recoverable, "unreadable").when(critical == 0, "healthy").when(fixable >= critical, "repairable").otherwise("partial")
    )
    chance = F.when(encrypted | (~tolerant & ~recoverable), "Low").when(critical == 0, "High").when((fixable >= critical) & (critical <= 2), "High").otherwise("Medium")
    return F.struct(status.alias("status"), chance.alias("chance"))


def recovery_rate(recovered: Column, total: Column) -> Column:
    return F.when(total > 0, half_up(recovered / total * 100)).otherwise(0).cast("int")


def byte_checks(content: Column) -> dict[str, Column]:
    """Signs of a sound file in its bytes: head, tail, cross references, trailer, encryption, unbalanced streams and objects."""
    n = F.octet_length(content)
    text = lambda start, size: F.decode(F.substring(content, start, size), "ISO-8859-1")
    whole = F.decode(content, "ISO-8859-1")
    tail = lambda k: F.substring(whole, -k, k)
    two, one = text(1, 2 << 20), text(1, 1 << 20)
    near = lambda a, b: F.abs(F.regexp_count(one, F.lit(a)) - F.regexp_count(one, F.lit(b)))
    return {
        "header": F.coalesce(F.substring(content, 1, 5) == F.to_binary(F.lit("255044462D"), F.lit("hex")), F.lit(False)),
        "eof": tail(1024).contains("%%EOF"),
        "xref": two.contains("xref") | two.contains("/XRef"),
        "trailer": two.contains("trailer") | two.contains("/Root"),
        "encrypted": text(1, 65536).contains("/Encrypt") | tail(65536).contains("/Encrypt"),
        "stream_errors": near(r"\bstream\b", r"\bendstream\b"),
        "object_errors": near(r"\d+\s+\d+\s+obj\b", r"\bendobj\b"),
        "size": n,
    }


def issues(c: dict[str, Column]) -> Column:
    """What is wrong with a file, as array<struct<id, severity, category, fixable>>."""

    def issue(when: Column, name: str, severity: Column | str, category: str, fixable: bool = True) -> Column:
        level = F.lit(severity) if isinstance(severity, str) else severity
        return F.when(when, F.struct(F.lit(name).alias("id"), level.alias("severity"), F.lit(category).alias("category"), F.lit(fixable).alias("fixable")))

    many = lambda n, most: F.when(n > most, "critical").otherwise("warning")
    return F.array_compact(F.array(
        issue(~c["header"], "no-header", "critical", "structure"), issue(~c["eof"], "no-eof", "critical", "structure"), issue(~c["xref"], "no-xref", "critical", "xref"),
        issue(~c["trailer"], "no-trailer", "critical", "xref"), issue(c["encrypted"], "encrypted", "critical", "structure", False),
        issue(c["object_errors"] > 0, "object-mismatch", many(c["object_errors"], 5), "objects"), issue(c["stream_errors"] > 0, "stream-mismatch", many(c["stream_errors"], 3), "encoding"),
        issue(~c["strict"] & c["tolerant"], "strict-parse-fail", "warning", "structure"), issue(~c["strict"] & ~c["tolerant"] & ~c["recoverable"], "unreadable", "critical", "structure", False),
        issue(~c["metadata"] & c["strict"], "corrupt-metadata", "info", "metadata"),
    ))


def tail_candidates(content: Column) -> Column:
    """Rebuilt files, as array<struct<kind, content>>: from the header (put there if the first 1024 bytes have none) to the last object's end, with a
    fresh tail, first with the old trailer, if it names a root, less its pointers to earlier tables. None without an object's end."""
    text = F.decode(content, "ISO-8859-1")
    head = F.substring(text, 1, 1024)
    before = F.regexp_extract(head, r"(?s)^(.*)%PDF-", 1)
    body = F.when(head.contains("%PDF-"), F.substring(text, F.char_length(before) + 1, F.char_length(text))).otherwise(F.concat(F.lit("%PDF-1.7\n"), text))
    objects = F.regexp_extract(body, r"(?s)^(.*endobj)", 1)
    tail = F.substring(body, F.char_length(objects) - 5, F.char_length(body))
    trailer = F.regexp_extract(tail, r"(?s)trailer\s*(<<.*?>>)\s*(?:startxref|\z)", 1)
    fresh = F.regexp_replace(trailer, r"/(Prev|XRefStm)\s+\d+", "")
    file = lambda kind, end: F.struct(F.lit(kind).alias("kind"), F.encode(F.concat(objects, end), "ISO-8859-1").alias("content"))
    whole = file("rebuilt-tail", F.concat(F.lit("\ntrailer\n"), fresh, F.lit("\nstartxref\n0\n%%EOF\n")))
    bare = file("rebuilt-tail-no-trailer", F.lit("\nstartxref\n0\n%%EOF\n"))
    both = F.when(trailer.rlike(r"/Root\s+\d+\s+\d+\s+R"), F.array(whole, bare)).otherwise(F.array(bare))
    return F.when(body.contains("endobj"), both).otherwise(F.filter(both, lambda c: F.lit(False)))
