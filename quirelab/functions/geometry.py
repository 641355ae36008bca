"""Places and sizes on a page, as expressions. Points; the origin is bottom-left unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

A4 = (595.28, 841.89)
# Margins by name; a name that is not listed counts as medium.
LABEL_MARGIN = {"small": 18.0, "medium": 36.0, "recommended": 54.0}
IMAGE_SCALE = {"small": 0.25, "medium": 0.5, "large": 0.8}


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def page_label(fmt: Column, page_no: Column, first: Column, start: Column, end: Column) -> Column:
    """The label of a page in start..end, else null: {n} counts from `first`, {total} is the number of labelled pages."""
    text = F.replace(F.replace(fmt, F.lit("{n}"), (first + page_no - start).cast("string")), F.lit("{total}"), (end - start + 1).cast("string"))
    return F.when(page_no.between(start, end), text)


def mirrored(position: Column, page_no: Column, facing: Column, cover: Column) -> Column:
    """Left and right change places on left pages of facing pages; with a cover, even pages are left."""
    left = facing & F.when(cover, page_no % 2 == 0).otherwise(page_no % 2 == 1)
    return F.when(left, F.concat(F.substring(position, 1, 1), F.translate(F.substring(position, 2, 1), "lr", "rl"))).otherwise(position)


def mono_width(text: Column, size: Column) -> Column:
    """Width in a font whose characters are all 0.6 of its size wide."""
    return F.char_length(text) * size * 0.6


def label_margin(name: Column) -> Column:
    out = F.lit(36.0)
    for k, v in LABEL_MARGIN.items():
        out = F.when(name == k, v).otherwise(out)
    return out


def anchored(position: Column, width: Column, height: Column, w: Column, h: Column, margin: Column) -> tuple[Column, Column]:
    """Lower left corner of a w x h box at one of nine positions (t m b, l c r)."""
    side, level = F.substring(position, 2, 1), F.substring(position, 1, 1)
    x = F.when(side == "l", margin).when(side == "c", width / 2 - w / 2).otherwise(width - margin - w)
    y = F.when(level == "t", height - margin - h).when(level == "m", height / 2 - h / 2).otherwise(margin)
    return x, y


def turned_corner(cx: Column, cy: Column, w: Column, h: Column, degrees: Column) -> tuple[Column, Column]:
    """Where the lower left corner of a box goes that is turned about its centre."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    return cx - w / 2 * c + h / 2 * s, cy - w / 2 * s - h / 2 * c


def crop_box(rotation: Column, mx: Column, my: Column, mw: Column, mh: Column, top: Column, left: Column, width: Column, height: Column) -> Column:
    """Box in page space of a crop given in percent of the page as it is seen, origin top-left. The full page: null."""
    t, l, w, h = (c / 100 for c in (top, left, width, height))
    r = F.pmod(rotation, F.lit(360))
    on_side, upside = r.isin(90, 270), r == 180
    x = F.when(r == 90, t).when(upside, 1 - l - w).when(r == 270, 1 - t - h).otherwise(l)
    y = F.when(r == 90, l).when(upside, t).when(r == 270, 1 - l - w).otherwise(1 - t - h)
    cw, ch = F.when(on_side, h).otherwise(w), F.when(on_side, w).otherwise(h)
    box = F.struct((mx + x * mw).alias("x"), (my + y * mh).alias("y"), (cw * mw).alias("w"), (ch * mh).alias("h"))
    return F.when(~((top == 0) & (left == 0) & (width == 100) & (height == 100)), box)


def crop_margin(edge: str, value: Column, top: Column, left: Column, width: Column, height: Column) -> Column:
    """The crop after one margin is set, never under 2 percent of the page."""
    bottom, right = 100 - (top + height), 100 - (left + width)
    other = {"top": bottom, "bottom": top, "left": right, "right": left}[edge]
    v = F.greatest(F.lit(0.0), F.least(100 - other - 2, F.coalesce(value, F.lit(0.0))))
    rest = 100 - v - other
    parts = {"top": top, "left": left, "width": width, "height": height}
    if edge in ("top", "left"):
        parts[edge] = v
    parts["height" if edge in ("top", "bottom") else "width"] = rest
    return F.struct(*[c.alias(k) for k, c in parts.items()])


def image_fit(iw: Column, ih: Column, orientation: Column, fit: Column, margin: Column) -> Column:
    """Page size and place of an image on a page of its own: fit inside, fill, or original size at most."""
    wide = F.when(orientation == "auto", iw > ih).otherwise(orientation == "landscape")
    pw, ph = F.when(wide, A4[1]).otherwise(A4[0]), F.when(wide, A4[0]).otherwise(A4[1])
    aw, ah = F.greatest(F.lit(0.0), pw - margin * 2), F.greatest(F.lit(0.0), ph - margin * 2)
    inside = F.least(aw / iw, ah / ih)
    scale = F.when(fit == "fill", F.greatest(aw / iw, ah / ih)).when(fit == "original", F.least(inside, F.lit(1.0))).otherwise(inside)
    w, h = iw * scale, ih * scale
    return F.struct(pw.alias("page_w"), ph.alias("page_h"), (margin + (aw - w) / 2).alias("x"), (margin + (ah - h) / 2).alias("y"), w.alias("w"), h.alias("h"))


# Slide page sizes and margins in points; a name that is not listed is A4, or no margin.
PAGE_SIZES = {"A4": A4, "Letter": (612.0, 792.0), "Legal": (612.0, 1008.0), "A3": (841.89, 1190.55)}
SLIDE_MARGINS = {"none": 0.0, "small": 36.0, "medium": 72.0, "large": 108.0}


def slide_fit(size: Column, orientation: Column, margin: Column, fit: Column, w: Column, h: Column) -> Column:
    """Page and place of a w x h slide: centred inside the margins, scaled to fit or as it is."""
    pw, ph, m = F.lit(A4[0]), F.lit(A4[1]), F.lit(0.0)
    for name, (a, b) in PAGE_SIZES.items():
        pw, ph = F.when(size == name, a).otherwise(pw), F.when(size == name, b).otherwise(ph)
    for name, points in SLIDE_MARGINS.items():
        m = F.when(margin == name, points).otherwise(m)
    wide = orientation == "landscape"
    pw, ph = F.when(wide, ph).otherwise(pw), F.when(wide, pw).otherwise(ph)
    scale = F.when(fit, F.least((pw - m * 2) / w, (ph - m * 2) / h)).otherwise(1.0)
    box = {"page_w": pw, "page_h": ph, "x": m + (pw - m * 2 - w * scale) / 2, "y": m + (ph - m * 2 - h * scale) / 2, "w": w * scale, "h": h * scale}
    return F.struct(*[c.alias(k) for k, c in box.items()])


def centred(x0: Column, x1: Column, fs: Column, left: Column, right: Column) -> Column:
    """A line clearly shorter than the space between left and right, about its middle, and indented."""
    w = right - left
    near = F.abs((x0 + x1) / 2 - (left + right) / 2) < F.greatest(1.5 * fs, 0.03 * w)
    return (x1 - x0 < 0.85 * w) & near & (x0 > left + 2 * fs)


def image_box(m: list[Column], width: Column, height: Column, least: float = 24.0) -> Column:
    """Box on the page of the unit square under the matrix (a, b, c, d, e, f), clamped to the page; null if a side is under `least`."""
    a, b, c, d, e, f = m
    xs, ys = F.array(e, a + e, c + e, a + c + e), F.array(f, b + f, d + f, b + d + f)
    x0, x1 = F.greatest(F.lit(0.0), F.array_min(xs)), F.least(width, F.array_max(xs))
    y0, y1 = F.greatest(F.lit(0.0), F.array_min(ys)), F.least(height, F.array_max(ys))
    return F.when((x1 - x0 >= least) & (y1 - y0 >= least), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def distinct_boxes(boxes: Column, near: float = 1.0) -> Column:
    """Boxes in order, without those all of whose edges lie within `near` of one that stays."""
    same = lambda p, q: (F.abs(p["x0"] - q["x0"]) < near) & (F.abs(p["y0"] - q["y0"]) < near) & (F.abs(p["x1"] - q["x1"]) < near) & (F.abs(p["y1"] - q["y1"]) < near)
    none = F.filter(boxes, lambda b: F.lit(False))
    return F.aggregate(boxes, none, lambda kept, b: F.when(F.exists(kept, lambda k: same(k, b)), kept).otherwise(F.array_append(kept, b)))


def contain(bw: Column, bh: Column, nw: Column, nh: Column) -> Column:
    """Scale and offsets that show an image whole in a box; null unless all sizes are positive."""
    s = F.least(bw / nw, bh / nh)
    return F.when((bw > 0) & (bh > 0) & (nw > 0) & (nh > 0), F.struct(s.alias("scale"), ((bw - nw * s) / 2).alias("dx"), ((bh - nh * s) / 2).alias("dy")))


def order_quad(points: Column) -> Column:
    """Four points (x, y; y down) as top-left, top-right, bottom-right, bottom-left: left pair and right pair, each by y."""
    p = F.array_sort(points)
    by_y = lambda a, b: F.when(a["y"] <= b["y"], F.array(a, b)).otherwise(F.array(b, a))
    left, right = by_y(p[0], p[1]), by_y(p[2], p[3])
    return F.struct(left[0].alias("tl"), right[0].alias("tr"), right[1].alias("br"), left[1].alias("bl"))
