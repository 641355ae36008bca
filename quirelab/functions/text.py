"""Text as expressions; vectorised Python only for what Spark has no function for (normal forms, graphemes, numerals)."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types

SPACES = r"[\s\u00a0\ufeff]"
# Characters that a page holds, by font size in points; other sizes hold OTHER_CAPACITY.
CAPACITY = {10: 4000, 12: 3000, 14: 2200}
OTHER_CAPACITY = 1800
MARKDOWN_PAGE_WORDS = 450
# List markers.
BULLET = "^[•●◦▪■□–—‣⁃∙·*\\-]\\s*"
NUMBER = r"^(\(?\d{1,2}[.)]|\(?[a-zA-Z][.)]|\(?[ivxIVX]{1,4}[.)])\s+"
# What names of bold and of italic fonts hold, whatever the case.
BOLD_NAME = r"(?i)bold|black|heavy|semibold|demi|[-,_ ]?medi(um)?\b|[-,]bd\b|cmbx|cmb10|cmssbx|\bsb\b"
ITALIC_NAME = r"(?i)italic|oblique|ital\b|[-,]it\b|cmti|cmmi|cmsl|cmitt|slanted"
# How a colour is written.
COLOR = r"rgba?\(\s*([\d.]+)[,\s]+([\d.]+)[,\s]+([\d.]+)(?:\s*[,/]\s*([\d.]+%?))?\s*\)"
# Names of font families by kind, looked for in this order.
FAMILIES = (
    ("mono", "mono|courier|consolas|menlo|monaco"),
    ("sans", r"sans-serif|system-ui|-apple-system|blinkmacsystemfont|segoe|helvetica|arial|inter\b"),
    ("serif", "serif|georgia|times|merriweather|baskerville|garamond"),
)


@F.pandas_udf(types.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(types.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(types.ArrayType(types.StringType()))
def graphemes(s: pd.Series) -> pd.Series:
    """User-perceived characters."""
    import regex

    return s.map(lambda t: regex.findall(r"\X", t), na_action="ignore")


def sanitize(text: Column) -> Column:
    """NFC; line ends become LF, tabs four spaces, no-break spaces spaces; other control characters go."""
    t = F.regexp_replace(nfc(text), "\r\n?", "\n")
    t = F.replace(F.replace(t, F.lit("\t"), F.lit("    ")), F.lit("\u00a0"), F.lit(" "))
    return F.regexp_replace(t, r"[\x00-\x09\x0B-\x1F\x7F]", "")


def xml_safe(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x09\x0A\x0D\x20-\uD7FF\uE000-\uFFFD\x{10000}-\x{10FFFF}]", "")


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def decode_entities(text: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def pdf_name(name: Column, title: Column) -> Column:
    """The name with .pdf for .md, .markdown or .txt; without a name, the title in lower case with _ for spaces."""
    return F.coalesce(F.regexp_replace(name, r"(?i)\.(md|markdown|txt)$", ".pdf"), F.concat(F.regexp_replace(F.lower(title), f"{SPACES}+", "_"), F.lit(".pdf")))


def splice(text: Column, start: Column, end: Column, prefix: str, suffix: str = "", placeholder: str = "") -> Column:
    """Puts prefix and suffix around characters start..end (0-based, end excluded), or around a placeholder where that is empty."""
    chosen = F.when(end > start, F.substring(text, start + 1, end - start)).otherwise(F.lit(placeholder))
    return F.concat(F.substring(text, F.lit(1), start), F.lit(prefix), chosen, F.lit(suffix), F.substring(text, end + 1, F.char_length(text)))


def words(text: Column, normal: bool = True) -> Column:
    """Lower-case words of letters and digits; dashes and soft hyphens inside words are dropped. Only text that isn't all ASCII goes to Python for its normal form."""
    t = F.lower(F.coalesce(nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text) if normal else text)
    t = F.regexp_replace(t, r"[\u00ad\u2010-\u2015-]", "")
    return F.filter(F.split(t, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def text_stats(text: Column, points: int = 12, double_spaced: bool = False) -> Column:
    """Characters, words, and pages that the text would fill."""
    room = CAPACITY.get(points, OTHER_CAPACITY) * (0.75 if double_spaced else 1)
    n, w = F.char_length(text), F.regexp_count(text, F.lit(r"[^\s\u00a0\ufeff]+"))
    pages = F.when(w == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(n / room)))
    return F.struct(n.cast("long").alias("chars"), w.cast("long").alias("words"), pages.cast("long").alias("pages"))


def markdown_stats(text: Column) -> Column:
    n, w = F.char_length(text), F.regexp_count(text, F.lit(r"[^\s\u00a0\ufeff]+"))
    lines = F.size(F.split(text, "\n", -1))
    pages = F.greatest(F.lit(1), F.ceil(w / MARKDOWN_PAGE_WORDS))
    return F.struct(n.cast("long").alias("chars"), w.cast("long").alias("words"), lines.cast("long").alias("lines"), pages.cast("long").alias("pages"))


def font_style(name: Column) -> Column:
    """Whether a font's name, without the tag of a subset, says bold or italic."""
    bare = F.regexp_replace(name, "^[A-Z]{6}\\+", "")
    return F.struct(bare.rlike(BOLD_NAME).alias("bold"), bare.rlike(ITALIC_NAME).alias("italic"))


def font_key(family: Column, weight: Column, style: Column) -> Column:
    """sans, serif or mono, with -b for a weight of 600 or more and i for any style but normal."""
    kind = F.lit("sans")
    for name, pattern in reversed(FAMILIES):
        kind = F.when(F.lower(family).rlike(pattern), name).otherwise(kind)
    number = F.coalesce(F.nullif(F.regexp_extract(weight, r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(0)), F.lit(400))
    bold, italic = (weight == "bold") | (number >= 600), style != "normal"
    mark = F.concat(F.when(bold, F.lit("b")).otherwise(F.lit("")), F.when(italic, F.lit("i")).otherwise(F.lit("")))
    return F.concat(kind, F.when(mark == "", F.lit("")).otherwise(F.concat(F.lit("-"), mark)))


def list_kind(text: Column) -> Column:
    """bullet or number by the marker that a line begins with, else null; a bullet needs more than two characters."""
    return F.when(text.rlike(BULLET) & (F.char_length(text) > 2), "bullet").when(text.rlike(NUMBER), "number")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row, however often and in whatever lambda body refers to it."""
    return F.transform(F.array(value), body)[0]


def join_lines(lines: Column) -> Column:
    """Lines of a paragraph as one text: a word hyphenated at a line's end is joined, other lines get one space, unless the text so far is empty or ends in space.

    What stands before a line depends on the line before it alone, since an empty line leaves a space behind, so lines are looked at side by side. They are bound once:
    what a lambda refers to is computed anew for each element."""
    broken = lambda first, second: first.rlike("[A-Za-z]-$") & second.rlike("^[a-z]")

    def placed(lines: Column, line: Column, i: Column) -> Column:
        before, after = F.get(lines, i - 1), F.coalesce(F.get(lines, i + 1), F.lit(""))
        space = F.when((i == 0) | broken(before, line) | before.rlike(r"\s$") | (before == ""), "").otherwise(" ")
        return F.concat(space, F.when(broken(line, after), F.substring(line, F.lit(1), F.char_length(line) - 1)).otherwise(line))

    return F.coalesce(bound(lines, lambda ls: F.array_join(F.transform(ls, lambda line, i: placed(ls, line, i)), "")), F.lit(""))


def repeat_key(text: Column) -> Column:
    """What counts as the same running head: lower case, digits as #, single spaces."""
    t = F.regexp_replace(F.lower(text), r"\d+", "#")
    return F.regexp_replace(F.regexp_replace(t, f"{SPACES}+", " "), "^ | $", "")


def is_rtl(text: Column) -> Column:
    """The first letter is Arabic."""
    return F.coalesce(F.regexp_extract(text, r"(\p{L})", 1).rlike(r"[\u0600-\u06ff\u0750-\u077f\u08a0-\u08ff\ufb50-\ufdff\ufe70-\ufeff]"), F.lit(False))


def url_with_scheme(url: Column) -> Column:
    t = F.regexp_replace(url, f"^{SPACES}+|{SPACES}+$", "")
    return F.when(t.rlike("(?i)^https?://"), t).otherwise(F.concat(F.lit("https://"), t))


def inline_markup(text: Column) -> Column:
    """**bold**, `code` and [text](url) as HTML."""
    t = F.regexp_replace(text, r"\*\*(.+?)\*\*", "<strong>$1</strong>")
    t = F.regexp_replace(t, "`(.+?)`", "<code>$1</code>")
    return F.regexp_replace(t, r"\[(.+?)\]\((.+?)\)", '<a href="$2">$1</a>')


def color(css: Column) -> Column:
    """rgb() or rgba() as parts from 0 to 1, opacity as a number or in percent; null for anything else."""
    part = lambda i: F.regexp_extract(css, COLOR, i).try_cast("double")
    alpha = F.regexp_extract(css, COLOR, 4)
    share = F.regexp_replace(alpha, "%$", "").try_cast("double") / F.when(alpha.endswith("%"), 100.0).otherwise(1.0)
    return F.when(css.rlike(COLOR), F.struct((part(1) / 255).alias("r"), (part(2) / 255).alias("g"), (part(3) / 255).alias("b"), F.when(alpha == "", 1.0).otherwise(share).alias("a")))


def hex_color(code: Column) -> Column:
    """#rgb or #rrggbb as parts from 0 to 1."""
    h = F.regexp_replace(code, "^#", "")
    full = F.when(F.length(h) == 3, F.regexp_replace(h, "(.)", "$1$1")).otherwise(h)
    part = lambda i: F.conv(F.substring(full, i, 2), 16, 10).cast("double") / 255
    return F.when(full.rlike("^[0-9a-fA-F]{6}$"), F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))


def blend(c: Column, a: Column, backdrop: Column) -> Column:
    """A colour of opacity a, held within 0 and 1, over a backdrop."""
    a = F.greatest(F.lit(0.0), F.least(F.lit(1.0), a))
    return F.struct(*[(c[k] * a + backdrop[k] * (1 - a)).alias(k) for k in "rgb"])


def transform_case(text: Column, how: Column) -> Column:
    """upper, lower, or capital first letters of words with the rest unchanged."""
    marked = F.array_join(F.transform(F.split(text, r"(?<=\s)"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.char_length(w)))), "")
    return F.when(how == "uppercase", F.upper(text)).when(how == "lowercase", F.lower(text)).when(how == "capitalize", marked).otherwise(text)


def roman(n: Column) -> Column:
    """Roman numerals of 1..3999: each digit picks its letters."""

    def digit(d: Column, one: str, five: str, ten: str) -> Column:
        forms = ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]
        return F.element_at(F.array(*map(F.lit, forms)), (d + 1).cast("int"))

    place = lambda k: F.floor(n / k) % 10
    thousands = F.repeat(F.lit("M"), F.floor(n / 1000).cast("int"))
    return F.when(n >= 1, F.concat(thousands, digit(place(100), "C", "D", "M"), digit(place(10), "X", "L", "C"), digit(place(1), "I", "V", "X"))).otherwise(F.lit(""))


def alpha(n: Column) -> Column:
    """a..z, aa.. : numerals without zero, of any length; empty below 1."""

    def step(acc: Column, _: Column) -> Column:
        left = acc["left"] - 1
        letter = F.chr(F.pmod(left, F.lit(26)) + 97)
        more = F.struct(F.call_function("div", left, F.lit(26)).alias("left"), F.concat(letter, acc["out"]).alias("out"))
        return F.when(acc["left"] > 0, more).otherwise(acc)

    start = F.struct(n.cast("long").alias("left"), F.lit("").alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda acc: acc["out"])  # 26^14 is beyond a long


def blocked_url(url: Column) -> Column:
    """Requests that an ad filter drops; it looks for the bare letters, so /uploads is one too."""
    u = F.lower(url)
    return u.contains("ads") | u.contains("doubleclick.net") | u.contains("googleadservices.com") | u.contains("adnxs.com")


# Words of programming languages.
KEYWORDS = (
    "const let var function return if else for while import export from class async await def public private protected interface type struct new try catch finally throw switch case break continue default void"
    " package func select defer go match impl trait fn mut val lambda enum extends implements static readonly as in of yield"
)
CONSTANTS = "true false null undefined nil None self this super"


def code_pattern(keywords: str = KEYWORDS, constants: str = CONSTANTS) -> re.Pattern:
    """One alternative for each kind of token, in the order in which they are tried. The forms of comments, strings and numbers."""
    any_of = lambda names: "|".join(map(re.escape, names.split()))
    kinds = {
        "comment": r"//[^\n]*|/\*.*?\*/|#[^\n]*|<!--.*?-->",
        "string": r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|`[^`]*`",
        "number": r"\b(?:0x[0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)\b",
        "keyword": rf"\b(?:{any_of(keywords)})\b",
        "boolean": rf"\b(?:{any_of(constants)})\b",
        "function": r"\b[A-Za-z_$][\w$]*(?=\s*\()",
    }
    return re.compile("|".join(f"(?P<{k}>{p})" for k, p in kinds.items()), re.S | re.A)


def code_tokens(keywords: str = KEYWORDS, constants: str = CONSTANTS):
    """A vectorised function from source text to (kind, text) tokens: comments, strings, numbers, keywords, constants, calls."""
    pattern = code_pattern(keywords, constants)

    @F.pandas_udf(types.ArrayType(types.StructType([types.StructField("kind", types.StringType()), types.StructField("text", types.StringType())])))
    def tokens(s: pd.Series) -> pd.Series:
        return s.map(lambda code: [{"kind": m.lastgroup, "text": m.group()} for m in pattern.finditer(code)], na_action="ignore")

    return tokens


# Characters of scripts that are set from right to left or shaped; whatever else has a letter or digit is base text.
SCRIPTS = {"arabic": r"\u0600-\u06ff\u0750-\u077f\u08a0-\u08ff\ufb50-\ufdff\ufe70-\ufeff", "hebrew": r"\u0590-\u05ff\ufb1d-\ufb4f", "devanagari": r"\u0900-\u097f", "thai": r"\u0e00-\u0e7f"}


def script_pattern() -> str:
    """Runs of one script, which take in the spaces and punctuation between two pieces of it, and runs of anything else."""
    each = [rf"[{c}](?:[{c}\p{{M}}\u200c\u200d]|[\s\p{{P}}]+[{c}])*" for c in SCRIPTS.values()]
    return "|".join([*each, f"[^{''.join(SCRIPTS.values())}]+"])


def script_runs(text: Column) -> Column:
    """The text cut into runs of one script each, as array<struct<script, text>>; base: no script of SCRIPTS."""
    name = lambda run: functools.reduce(lambda rest, k: F.when(run.rlike(f"^[{SCRIPTS[k]}]"), k).otherwise(rest), SCRIPTS, F.lit("base"))
    return F.transform(F.regexp_extract_all(text, F.lit(f"({script_pattern()})"), F.lit(1)), lambda run: F.struct(name(run).alias("script"), run.alias("text")))


def shown_text(text: Column, covered: str) -> Column:
    """Text for a font that covers the characters of the class `covered`: marks and joiners that stray go, other uncovered characters become ?, white space but line ends spaces."""
    t = F.regexp_replace(text, r"[^\S\n]|\u00a0|\ufeff", " ")
    t = F.regexp_replace(t, rf"(?![{covered}\n ])[\p{{M}}\u200c\u200d]", "")
    return F.regexp_replace(t, rf"(?![{covered}\n ])(?s:.)", "?")
