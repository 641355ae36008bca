"""Text made ready for display: which font draws each character, runs of one font and direction, their visual order, and texts dealt over glyphs.

Lines are (by, text). A pattern cuts a line into stretches of characters that are treated alike; what goes from one stretch to the next is told by neighbours in
the array of them. So a line never leaves its row, nothing is shuffled, and the work grows with the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelab.functions.text import bound

# The code points that each fallback font is asked for, in the order in which fonts are asked. What the base font covers it draws.
FONTS = {
    "deva": r"\u0900-\u097f\ua8e0-\ua8ff\u1cd0-\u1cff",
    "arab": r"\u0600-\u06ff\u0750-\u077f\u08a0-\u08ff\ufb50-\ufdff\ufe70-\ufeff",
    "noto": r"\u00a0-\u024f\u02b0-\u036f\u0370-\u03ff\u0400-\u052f\u1e00-\u1eff\u2000-\u218f",
    "sym": r"\u2300-\u27bf\u2900-\u297f\u2b00-\u2bff",
    "math": r"\u2190-\u22ff\u27f0-\u27ff",
}
BASE = r"\x20-\x7e\u00a1-\u00ff"
JOINING = r"^[\p{M}\u200c\u200d\ufe00-\ufe0f]"
CONTROLS = r"^[\u200c\u200d]"
NONE = r"[^\x{0}-\x{10ffff}]"
BLANK = r"^[\s\u000b\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def _font(ch: Column, fonts: dict[str, str], base: str) -> Column:
    """Who draws a character: base, else the first font asked that has it, else null."""
    out = F.when(ch.rlike(f"^[{base}]"), "base")
    for name, ranges in fonts.items():
        out = out.when(ch.rlike(f"^[{ranges}]"), name)
    return out


def _strong(font: Column, ch: Column) -> Column:
    """R or L by letters and marks (and digits, left to right), N for what takes its neighbours' direction."""
    arabic = F.when(ch.rlike(r"^[\p{L}\p{M}]"), "R").otherwise("N")
    return F.when(font == "arab", arabic).when(font.isin("sym", "math"), "N").when(ch.rlike(r"^[\p{L}\p{M}\p{Nd}]"), "L").otherwise("N")


def _cut(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _starts(items: Column, fresh: Callable[[Column, Column], Column]) -> Column:
    """Where the stretches of an array begin: at the first item, and at each that is `fresh`, of item and place."""
    return F.filter(F.transform(items, lambda x, i: F.when((i == 0) | fresh(x, i), i)), lambda i: i.isNotNull())


def prepared_text(text: Column, fonts: dict[str, str] = FONTS, base: str = BASE) -> Column:
    """What can be drawn of a text. White space beyond the base font becomes a space, characters that no font has become ?; marks that no font has go, and so do joiners
    unless a font has them or the last character before that had a font was drawn by a fallback font. Line ends stay."""
    ranges, joining, controls, blank = "".join(fonts.values()), JOINING[2:-1], CONTROLS[2:-1], BLANK[2:-1]
    drawn = f"[{ranges}&&[^{base}{blank}{controls}]]" if fonts else NONE  # by a fallback font
    silent = f"[{controls}[[{joining}]&&[^{base}{ranges}]]]"  # says nothing of what comes after
    plain = f"[{base}&&[^{controls}]]"  # most of a text: looked for first, as long classes take their time for each character
    other = f"[[{blank}[^{base}{ranges}{joining}]]&&[^{base}{controls}]]"

    def out(tokens: Column, t: Column, i: Column) -> Column:
        follows = F.coalesce(F.get(tokens, i - 1).rlike(f"^{drawn}"), F.lit(False))
        heard = F.when(follows, F.regexp_replace(t, f"[^{base}{ranges}{controls}]", "")).otherwise(F.regexp_replace(t, f"[^{base}{ranges}]", ""))
        shown = F.regexp_replace(F.regexp_replace(t, f"[[{blank}]&&[^{base}\\n]]", " "), f"[^{base}\\n]", "?")
        return F.when(t.rlike(f"^{plain}"), t).when(t.rlike(f"^{silent}"), heard).when(t.rlike(f"^{drawn}"), t).otherwise(shown)

    return F.coalesce(bound(_cut(text, f"{plain}+|{silent}+|{drawn}+|{other}+"), lambda ts: F.array_join(F.transform(ts, lambda t, i: out(ts, t, i)), "")), F.lit(""))


def prepared(lines: DataFrame, by: list[str], fonts: dict[str, str] = FONTS, base: str = BASE) -> DataFrame:
    """(by, text): lines as prepared_text()."""
    return lines.select(*by, prepared_text(F.col("text"), fonts, base).alias("text"))


def _run_pattern(fonts: dict[str, str], base: str) -> str:
    """Matches runs of one font and direction: of the base font or no font, or from a character that a fallback font draws on, with the marks and joiners that follow it."""
    ranges, joining, letters = "".join(fonts.values()), JOINING[2:-1], r"\p{L}\p{M}\p{Nd}"
    plain = f"[{base}[^{ranges}]]" if fonts else f"[{base}[^{base}]]"
    runs, before = [f"[[{letters}]&&{plain}]+", f"[[^{letters}]&&{plain}]+"], base
    for name, own in fonts.items():
        strong = r"\p{L}\p{M}" if name == "arab" else letters
        kinds = [f"[[{own}]&&[^{before}]]"] if name in ("sym", "math") else [f"[[{own}]&&[^{before}]&&[{neg}{strong}]]" for neg in ("", "^")]
        runs += [f"{k}[{joining}{k}]*" for k in kinds]
        before += own
    return "|".join(runs)


def segments_of(text: Column, fonts: dict[str, str] = FONTS, base: str = BASE) -> Column:
    """Prepared text as an array of struct<text, font, strong>, runs of one font and direction.

    Marks and joiners stay with the font of what they stand on, unless that is the base font; from the first one that a fallback font draws, the others follow it. They take the
    direction with it. Neutral characters between two runs of one fallback font and direction join these, if that font has them; every font has the space.
    """
    named = F.transform(_cut(text, _run_pattern(fonts, base)), lambda t: F.struct(t.alias("text"), F.coalesce(_font(t, fonts, base), F.lit("base")).alias("font")))
    runs = F.transform(named, lambda r: F.struct(r["text"].alias("text"), r["font"].alias("font"), _strong(r["font"], r["text"]).alias("strong")))

    def link(rs: Column, r: Column, i: Column) -> Column:
        prev, after = F.get(rs, i - 1), F.get(rs, i + 1)
        covered = F.lit(False)
        for name, ranges in fonts.items():
            covered = F.when(prev["font"] == name, r["text"].rlike(rf"^[ {ranges}]*\z")).otherwise(covered)
        return F.coalesce((r["strong"] == "N") & (prev["font"] != "base") & (after["font"] == prev["font"]) & (after["strong"] == prev["strong"]) & ((r["font"] == prev["font"]) | covered), F.lit(False))

    def joined(rs: Column, starts: Column) -> Column:
        parts = lambda s, j: F.slice(rs, s + 1, F.coalesce(F.get(starts, j + 1), F.size(rs)) - s)
        return F.transform(starts, lambda s, j: F.struct(F.array_join(F.transform(parts(s, j), lambda r: r["text"]), "").alias("text"), F.get(rs, s)["font"].alias("font"), F.get(rs, s)["strong"].alias("strong")))

    begun = lambda ls: _starts(ls, lambda x, i: ~(x | F.get(ls, i - 1)))
    return bound(runs, lambda rs: bound(bound(F.transform(rs, lambda r, i: link(rs, r, i)), begun), lambda starts: joined(rs, starts)))


def segments(lines: DataFrame, by: list[str], fonts: dict[str, str] = FONTS, base: str = BASE) -> DataFrame:
    """(by, seg_no, text, font, strong): lines as segments_of()."""
    out = lines.select(*by, F.posexplode(segments_of(F.col("text"), fonts, base)).alias("seg_no", "s"))
    return out.select(*by, F.col("seg_no").cast("long").alias("seg_no"), "s.text", "s.font", "s.strong")


def visual_places(strong: Column, rtl: Column) -> Column:
    """struct<level, visual_no> of the segments of a line, by their directions R, L or N: visual_no is their place from the left, in lines that run right to left where `rtl` is true.

    Neutral segments have the level of their nearest strong neighbours if these agree, else the line's. Stretches of level 1 and up are read backwards, and in these stretches of
    level 2 forwards again.
    """
    level_of = lambda s: F.when(s == "R", 1).when(rtl, 2).otherwise(0)
    edge = F.when(rtl, "R").otherwise("L")

    def levels(ss: Column, starts: Column) -> Column:
        def of(s: Column, j: Column) -> Column:
            end = F.coalesce(F.get(starts, j + 1), F.size(ss))
            before, after = F.coalesce(F.get(ss, s - 1), edge), F.coalesce(F.get(ss, end), edge)
            neutral = F.when(before == after, level_of(before)).otherwise(F.when(rtl, 1).otherwise(0))
            return F.when(F.get(ss, s) == "N", F.array_repeat(neutral, end - s)).otherwise(F.transform(F.slice(ss, s + 1, end - s), level_of))

        return F.flatten(F.transform(starts, of))

    def places(lv: Column, starts: Column) -> Column:
        def of(a: Column, j: Column) -> Column:
            end = F.coalesce(F.get(starts, j + 1), F.size(lv))
            parts = _starts(F.slice(lv, a + 1, end - a), lambda v, o: (v == 1) | (F.get(lv, a + o - 1) == 1))  # stretches of level 2, others one by one
            back = lambda ps: F.flatten(F.transform(ps, lambda p, k: (lambda q: F.transform(F.sequence(p, q), lambda o: end - 1 - q - p + o))(F.coalesce(F.get(ps, k + 1), end - a) - 1)))
            return F.when(F.get(lv, a) == 0, F.sequence(a, end - 1)).otherwise(bound(parts, back))

        return F.flatten(F.transform(starts, of))

    leveled = bound(strong, lambda ss: bound(_starts(ss, lambda s, i: (s == "N") != (F.get(ss, i - 1) == "N")), lambda starts: levels(ss, starts)))
    placed = lambda lv: bound(_starts(lv, lambda v, i: (v >= 1) != (F.get(lv, i - 1) >= 1)), lambda starts: places(lv, starts))
    return bound(leveled, lambda lv: F.zip_with(lv, placed(lv), lambda v, p: F.struct(v.alias("level"), p.alias("visual_no"))))


def visual_order(segs: DataFrame, by: list[str], rtl: Column) -> DataFrame:
    """Segments with their level and visual_no, as visual_places()."""
    row = F.struct(*[c for c in segs.columns if c not in by])
    listed = segs.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("seg_no", row.alias("row")))).alias("s"), F.first(rtl).alias("rtl"))
    order = visual_places(F.transform("s", lambda x: x["row"]["strong"]), F.col("rtl"))
    return listed.select(*by, F.inline(F.zip_with("s", order, lambda x, o: F.struct(x["row"].alias("row"), o.alias("o"))))).select(*by, "row.*", "o.level", "o.visual_no").select(*segs.columns, "level", "visual_no")


def over_glyphs(text: Column, k: Column) -> Column:
    """A cluster's text over its k glyphs, as struct<pieces, gaps>: pieces of text without non-spacing marks, one a glyph, and what stands before, between and after them.

    Format characters go. Where there are fewer pieces than glyphs, first characters are cut off the longest piece, of equal ones the first, time and again: the cuts are the k - n
    first of all (length left, place) in order. Pieces beyond k go to the last gap; missing ones are empty.
    """
    tokens = F.regexp_extract_all(F.regexp_replace(text, r"\p{Cf}", ""), F.lit(r"(\p{Mn}+|\P{Mn}+)"), F.lit(1))
    mark = lambda t: t.rlike(r"^\p{Mn}")
    free = F.size(F.filter(tokens, lambda t: ~mark(t)))
    cuts = F.flatten(F.transform(tokens, lambda t, i: F.when(mark(t) | (F.char_length(t) < 2), F.array().cast("array<struct<left:int,at:int>>")).otherwise(
        F.transform(F.sequence(F.lit(2), F.char_length(t)), lambda n: F.struct((-n).alias("left"), i.alias("at")))
    )))
    chosen = F.slice(F.sort_array(cuts), F.lit(1), F.greatest(k - free, F.lit(0)))
    n_of = lambda i: F.size(F.filter(chosen, lambda c: c["at"] == i))
    token = lambda s, m: F.struct(s.alias("s"), F.lit(m).alias("mark"))
    cut = lambda t, n: F.concat(F.transform(F.slice(F.split(t, ""), F.lit(1), n), lambda c: token(c, False)), F.array(token(F.substring(t, n + 1, F.char_length(t)), False)))
    small = F.flatten(F.transform(tokens, lambda t, i: F.when(mark(t), F.array(token(t, True))).otherwise(cut(t, n_of(i)))))

    def add(s: Column, t: Column) -> Column:
        piece = ~t["mark"] & (F.size(s["pieces"]) < k)
        return F.when(piece, F.struct(F.array_append(s["pieces"], t["s"]).alias("pieces"), F.array_append(s["gaps"], s["now"]).alias("gaps"), F.lit("").alias("now"))).otherwise(
            F.struct(s["pieces"].alias("pieces"), s["gaps"].alias("gaps"), F.concat(s["now"], t["s"]).alias("now"))
        )

    none = F.array().cast("array<string>")
    pad = lambda s: F.array_repeat(F.lit(""), F.greatest(k - F.size(s["pieces"]), F.lit(0)))
    done = lambda s: F.struct(F.concat(s["pieces"], pad(s)).alias("pieces"), F.concat(F.array_append(s["gaps"], s["now"]), pad(s)).alias("gaps"))
    return F.aggregate(small, F.struct(none.alias("pieces"), none.alias("gaps"), F.lit("").alias("now")), add, done)
