"""Recognised pages: joining hyphenated lines, paragraph breaks, and boxes of layout detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# Category of each detector class, in order of its number.
CLASSES = [
    "title", "title", "plain_text", "abandoned", "caption", "footnote", "plain_text", "header", "footer", "table", "caption", "footnote",
    "figure", "figure", "footnote", "abandoned", "abandoned", "title", "code", "reference", "plain_text", "footer", "plain_text",
]
LEAST_SCORE, DOMINANT, MARGIN, SMALLEST = 0.5, 0.60, 5, 10


def class_category(number: Column) -> Column:
    return F.coalesce(F.try_element_at(F.array(*map(F.lit, CLASSES)), number.cast("int") + 1), F.lit("plain_text"))


def merge_hyphens(lines: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Lines (text, x, y, width, height, confidence) with those that a hyphen continues in lower case joined to the line before.

    Islands of joined lines are numbered in order; text is joined without the hyphen, the box grows to the right and down, confidence is the highest.
    """
    by = W.partitionBy(*key).orderBy(*order)
    hyphen = F.lag(F.rtrim("text").endswith("-")).over(by)
    joins = F.coalesce(hyphen, F.lit(False)) & F.ltrim("text").rlike(r"^\p{Ll}")
    rows = lines.withColumn("line", F.sum(F.when(joins, 0).otherwise(1)).over(by))
    fields = ["text", "x", "y", "width", "height", "confidence"]
    found = rows.groupBy(*key, "line").agg(F.array_sort(F.collect_list(F.struct(*order, *fields))).alias("p"), F.max(F.col("x") + F.col("width")).alias("right"), F.max(F.col("y") + F.col("height")).alias("bottom"), F.max("confidence").alias("confidence"))
    begun = F.transform("p", lambda r, i: F.when(i == 0, r["text"]).otherwise(F.ltrim(r["text"])))
    text = F.array_join(F.transform(begun, lambda s, i: F.when(i == F.size("p") - 1, s).otherwise(F.regexp_replace(s, r"- *$", ""))), "")
    first = F.col("p")[0]
    return found.select(*key, "line", text.alias("text"), first["x"].alias("x"), first["y"].alias("y"), (F.col("right") - first["x"]).alias("width"), (F.col("bottom") - first["y"]).alias("height"), "confidence", F.size("p").alias("lines"))


def paragraph_breaks(lines: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``lines`` with a further line end after a sentence's end that an upper-case start follows."""
    following = F.lead("text").over(W.partitionBy(*key).orderBy(*order))
    ends = F.rtrim("text").rlike(r"[.!?]$") & F.ltrim(following).rlike(r"^\p{Lu}")
    return lines.withColumn("text", F.when(ends, F.concat("text", F.lit("\n"))).otherwise(F.col("text")))


def decode(detections: DataFrame, key: list[str], model: float) -> DataFrame:
    """Detections (class, score, x1, y1, x2, y2, page_width, page_height) to (key..., category, score, x, y, width, height) on their page.

    Where no box of a page exceeds the model's square of side ``model``, all of them are scaled from it to the page; boxes are clamped to the page.
    """
    kept = detections.where((F.col("score") >= LEAST_SCORE) & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))
    outside = F.max(F.greatest("x2", "y2")).over(W.partitionBy(*key)) > model
    scale = lambda side: F.when(outside, 1.0).otherwise(F.col(side) / model)
    kept = kept.withColumn("sx", scale("page_width")).withColumn("sy", scale("page_height"))
    for low, high, by, side in (("x1", "x2", "sx", "page_width"), ("y1", "y2", "sy", "page_height")):
        kept = kept.withColumn(low, F.greatest(F.col(low) * F.col(by), F.lit(0.0))).withColumn(high, F.least(F.col(high) * F.col(by), F.col(side)))
    extent = lambda low, high: F.greatest(F.round(F.col(high) - F.col(low)), F.lit(1.0)).cast("int")
    return kept.select(*key, class_category(F.col("class")).alias("category"), "score", F.round("x1").cast("int").alias("x"), F.round("y1").cast("int").alias("y"), extent("x1", "x2").alias("width"), extent("y1", "y2").alias("height"), "page_width", "page_height")


def bypassed(regions: DataFrame, key: list[str]) -> DataFrame:
    """(key..., regions, bypass): pages with fewer than two regions or with one that covers most of the page."""
    share = F.col("width") * F.col("height") / (F.col("page_width") * F.col("page_height"))
    found = regions.groupBy(*key).agg(F.count(F.lit(1)).alias("regions"), F.max(share).alias("largest"))
    return found.select(*key, "regions", ((F.col("regions") < 2) | F.coalesce(F.col("largest") > DOMINANT, F.lit(False))).alias("bypass"))


def crops(regions: DataFrame) -> DataFrame:
    """``regions`` with crop_x, crop_y, crop_width, crop_height: the box and a margin within the page; too small ones go."""
    x1, y1 = F.greatest(F.col("x") - MARGIN, F.lit(0)), F.greatest(F.col("y") - MARGIN, F.lit(0))
    x2 = F.least(F.col("x") + F.col("width") + MARGIN, F.col("page_width").cast("int"))
    y2 = F.least(F.col("y") + F.col("height") + MARGIN, F.col("page_height").cast("int"))
    cut = regions.withColumns({"crop_x": x1, "crop_y": y1, "crop_width": x2 - x1, "crop_height": y2 - y1})
    return cut.where((F.col("crop_width") >= SMALLEST) & (F.col("crop_height") >= SMALLEST))
