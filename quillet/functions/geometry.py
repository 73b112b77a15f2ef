"""Boxes as columns: a box is a struct (x, y, width, height) of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), width.cast("double").alias("width"), height.cast("double").alias("height"))


def area(b: Column) -> Column:
    return F.greatest(b["width"], F.lit(0.0)) * F.greatest(b["height"], F.lit(0.0))


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    return _share(intersection(a, b), F.least(area(a), area(b)))


def iou(a: Column, b: Column) -> Column:
    i = intersection(a, b)
    return _share(i, area(a) + area(b) - i)


def nearness(a: Column, b: Column) -> Column:
    """1 where centres are one, 0 from a diagonal on."""
    dx = (a["x"] + a["width"] / 2) - (b["x"] + b["width"] / 2)
    dy = (a["y"] + a["height"] / 2) - (b["y"] + b["height"] / 2)
    size = F.greatest(F.hypot(a["width"], a["height"]), F.hypot(b["width"], b["height"]), F.lit(1.0))
    return F.greatest(F.lit(0.0), 1 - F.hypot(dx, dy) / size)


def score_of(shared: Column, first: Column, second: Column, near: Column) -> Column:
    """0.6 overlap + 0.3 IoU + 0.1 nearness, from the common area and both areas."""
    return _share(shared, F.least(first, second)) * 0.6 + _share(shared, first + second - shared) * 0.3 + near * 0.1


def score(a: Column, b: Column) -> Column:
    """0.6 overlap + 0.3 IoU + 0.1 nearness of centres."""
    return score_of(intersection(a, b), area(a), area(b), nearness(a, b))


# Names of layout categories, and of the browser's filters.
CATEGORIES = {
    "title": ("title", "doc_title", "paragraph_title"),
    "plain_text": ("plain_text", "text", "paragraph", "reference", "abstract", "code", "page_header", "page_footer"),
    "table": ("table", "table_caption", "table_note"),
    "figure": ("figure", "image", "chart", "figure_title", "figure_note"),
    "abandoned": ("abandoned", "vision_footnote"),
    "formula": ("formula",),
    "seal": ("seal",),
}
FILTERS = {
    "titles": ("title", "doc_title", "paragraph_title"),
    "text": ("plain_text", "text", "paragraph", "reference", "abstract", "code", "page_header", "page_footer"),
    "tables": ("table", "table_caption"),
    "figures": ("figure", "image", "chart", "figure_title"),
    "notes": ("note", "notes", "vision_footnote", "abandoned", "table_note", "figure_note"),
}


def _named(label: Column, groups: dict[str, tuple[str, ...]], otherwise: Column) -> Column:
    token = F.regexp_replace(F.lower(F.trim(F.coalesce(label, F.lit("unknown")))), r"[\s-]+", "_")
    out = otherwise if otherwise is not None else token
    for name, members in reversed(groups.items()):
        out = F.when(token.isin(*members), name).otherwise(out)
    return out


def category(label: Column) -> Column:
    """A label's canonical category; an unknown one stays itself, normalised."""
    return _named(label, CATEGORIES, None)


def block_filter(label: Column) -> Column:
    """The browser's filter that a label belongs to, or null."""
    return _named(label, FILTERS, F.lit(None).cast("string"))


def turned(b: Column, clockwise: bool = True) -> Column:
    """A normalised box after the page turns by a quarter."""
    if clockwise:
        return box(1 - b["y"] - b["height"], b["x"], b["height"], b["width"])
    return box(b["y"], 1 - b["x"] - b["width"], b["height"], b["width"])


def cropped(b: Column, to: Column) -> Column:
    """A normalised box relative to a crop, or null outside it."""
    x1, y1 = F.greatest(b["x"], to["x"]), F.greatest(b["y"], to["y"])
    x2 = F.least(b["x"] + b["width"], to["x"] + to["width"])
    y2 = F.least(b["y"] + b["height"], to["y"] + to["height"])
    inside = box((x1 - to["x"]) / to["width"], (y1 - to["y"]) / to["height"], (x2 - x1) / to["width"], (y2 - y1) / to["height"])
    return F.when((x2 > x1) & (y2 > y1), inside)


def rescaled(b: Column, width: Column, height: Column, to_width: Column, to_height: Column) -> Column:
    sx, sy = to_width / width, to_height / height
    return box(F.round(b["x"] * sx), F.round(b["y"] * sy), F.round(b["width"] * sx), F.round(b["height"] * sy))


def clamped(x: Column) -> Column:
    """Between 0 and 1, to four digits."""
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), 4)


def pixels(b: Column, width: Column, height: Column) -> Column:
    """A normalised box in pixels; halves go up."""
    up = lambda x: F.floor(x + 0.5).cast("int")
    return F.struct(up(b["x"] * width).alias("x"), up(b["y"] * height).alias("y"), up(b["width"] * width).alias("width"), up(b["height"] * height).alias("height"))


def downscaled(width: Column, height: Column, side: int = 1000, area: int = 1_000_000) -> Column:
    """(width, height) of a page image that is to be smaller where its longer side or its area is over the bound."""
    scale = F.when((F.greatest(width, height) > side) | (width * height > area), F.least(F.lit(1.0), F.lit(float(side)) / F.greatest(width, height))).otherwise(1.0)
    return F.struct(F.greatest(F.lit(1), F.round(width * scale).cast("int")).alias("width"), F.greatest(F.lit(1), F.round(height * scale).cast("int")).alias("height"))


def rectangles(annotations: Column) -> Column:
    """Boxes of the rectangles among an array of annotations."""
    return F.transform(F.filter(annotations, lambda a: a["kind"] == "rectangle"), lambda a: F.struct(*[a[c].alias(c) for c in ("x", "y", "width", "height")]))
