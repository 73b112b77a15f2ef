"""Files brought in and taken out: classification of a batch, recordings as samples, pages, collections as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillet.functions.geometry import rectangles
from quillet.functions.text import alphanumerics, asset_path, file_kind, file_name
from quillet.operators.relational import latest


def classified(files: DataFrame) -> DataFrame:
    """(place, path, name, kind) of a batch (place, path): of equal paths without regard to case the first; kind is null for files that can't be read."""
    first = latest(files.withColumn("__low", F.lower("path")), ["__low"], F.asc("place")).drop("__low")
    return first.select("place", "path", file_name(F.col("path")).alias("name"), file_kind(F.col("path")).alias("kind"))


def import_counts(files: DataFrame) -> DataFrame:
    """(imported, rejected, skipped): files taken, files of unknown kinds, repeated paths; one row."""
    done = classified(files).agg(F.count_if(F.col("kind").isNotNull()).alias("imported"), F.count_if(F.col("kind").isNull()).alias("rejected"))
    total = files.agg(F.count(F.lit(1)).alias("__n"))
    return done.join(F.broadcast(total)).select("imported", "rejected", (F.col("__n") - F.col("imported") - F.col("rejected")).alias("skipped"))  # one row each


def contents(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, size, content) of the files under a path that can be read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.select("path", file_kind(F.col("path")).alias("kind"), F.col("length").alias("size"), "content").where("kind is not null")


def is_scanned(text: Column) -> Column:
    """Whether a PDF has too little text of its own to do without recognition; so has one whose text couldn't be read."""
    return text.isNull() | (alphanumerics(text) < 50)


def mono(samples: Column, channels: Column) -> Column:
    """Interleaved channels averaged; a rest that is no whole frame goes."""
    frames = F.floor(F.size(samples) / channels).cast("int")
    at = F.when(frames > 0, F.sequence(F.lit(0), frames - 1)).otherwise(F.array().cast("array<int>"))
    mixed = F.transform(at, lambda i: F.aggregate(F.slice(samples, i * channels + 1, channels), F.lit(0.0), lambda s, x: s + x) / channels)
    return F.when(channels <= 1, samples.cast("array<double>")).otherwise(mixed)


def resampled(samples: Column, source: Column, target: Column) -> Column:
    """Linear interpolation between sample rates."""
    n = F.floor(F.size(samples) * target / source).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    value = lambda i: F.coalesce(F.get(samples, i), F.element_at(samples, -1)).cast("double")

    def one(i: Column) -> Column:
        place = i * source / target
        low = F.floor(place).cast("int")
        return value(low) + (value(low + 1) - value(low)) * (place - low)

    return F.when((source == target) | (F.size(samples) == 0), samples.cast("array<double>")).otherwise(F.transform(at, one))


def export_fragments(collections: DataFrame, items: DataFrame, assets: DataFrame, extractions: DataFrame, transcriptions: DataFrame, notes: DataFrame, annotations: DataFrame, at: str) -> DataFrame:
    """(collection_id, part, updated_at, item_id, fragment): the JSON documents of all collections, version 2, in pieces.

    A collection is a head (part 0), a piece an item (part 1, newest first) and an end (part 2); its pieces in order of (part, updated_at descending, item_id), one after
    another, are its document. An item's piece holds its assets with text and marked boxes and its notes; no row holds a collection.
    extractions, transcriptions: (asset_id, text), one row an asset; the first that has a text gives it. ``at``: the time of the export.
    """
    marks = annotations.groupBy("asset_id").agg(rectangles(F.array_sort(F.collect_list(F.struct("page", "created_at", "id", "kind", "x", "y", "width", "height")))).alias("boxes"))
    a = assets.withColumnRenamed("id", "asset_id").join(marks, "asset_id", "left")
    for name, texts in (("x", extractions), ("t", transcriptions)):
        a = a.join(texts.select("asset_id", F.col("text").alias(name)), "asset_id", "left")
    boxes = F.coalesce("boxes", F.expr("cast(array() as array<struct<x:double,y:double,width:double,height:double>>)"))
    shown = F.struct(file_name(F.col("path")).alias("filename"), "type", "size", asset_path(F.col("path")).alias("path"), F.coalesce("x", "t").alias("text"), boxes.alias("bboxes"))
    placed = F.array_sort(F.collect_list(F.struct("sort_index", "created_at", "asset_id", shown.alias("v"))))
    per_item = a.groupBy("item_id").agg(F.transform(placed, lambda r: r["v"]).alias("assets"))
    note = F.struct((-F.col("created_at")).alias("o"), "id", F.struct("content", F.col("created_at").alias("createdAt"), F.col("updated_at").alias("updatedAt")).alias("v"))
    own_notes = notes.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(note)), lambda r: r["v"]).alias("notes"))
    rows = items.withColumnRenamed("id", "item_id").join(per_item, "item_id", "left").join(own_notes, "item_id", "left")
    none = lambda c: F.coalesce(c, F.array().cast(rows.schema[c].dataType)).alias(c)
    keep = {"ignoreNullFields": "false"}
    item = F.to_json(F.struct(F.col("item_id").alias("id"), "title", "metadata", F.col("created_at").alias("createdAt"), F.col("updated_at").alias("updatedAt"), none("assets"), none("notes")), keep)
    first = items.groupBy("collection_id").agg(F.min(F.struct((-F.col("updated_at")).alias("o"), "id"))["id"].alias("item_id")).select("item_id", F.lit("").alias("mark"))
    pieces = rows.select("collection_id", F.lit(1).alias("part"), "updated_at", "item_id", item.alias("json")).join(first, "item_id", "left")
    pieces = pieces.select("collection_id", "part", "updated_at", "item_id", F.concat(F.coalesce("mark", F.lit(",")), "json").alias("fragment"))
    own = F.to_json(F.struct("id", "name", "description", F.col("created_at").alias("createdAt"), F.col("updated_at").alias("updatedAt")), keep)
    head = F.concat(F.lit(f'{{"version":2,"exportedAt":"{at}","collection":'), own, F.lit(',"items":['))
    edge = lambda part, fragment: collections.select(F.col("id").alias("collection_id"), F.lit(part).alias("part"), F.lit(None).cast("long").alias("updated_at"), F.lit(None).cast("string").alias("item_id"), fragment.alias("fragment"))
    known = pieces.join(collections.select(F.col("id").alias("collection_id")), "collection_id", "left_semi")
    return edge(0, head).unionByName(known).unionByName(edge(2, F.lit("]}")))


def write_export(fragments: DataFrame, path: str) -> None:
    """A folder a collection under ``path``; its files in order of their names, one after another, are the document.

    Pieces are dealt by range, so that a large collection is written by several tasks.
    """
    order = ["collection_id", "part", F.desc("updated_at"), "item_id"]
    fragments.repartitionByRange(*order).sortWithinPartitions(*order).select("collection_id", F.col("fragment").alias("value")).write.mode("overwrite").partitionBy("collection_id").text(path)


def richness(tables: list[DataFrame]) -> int:
    """Rows of all tables together."""
    return sum(t.count() for t in tables)


def prefer_other(current: list[DataFrame], other: list[DataFrame]) -> bool:
    """Whether another store is to replace the current one: only if it has more rows."""
    return richness(other) > richness(current)
