"""Relational operators: newest row by key, audits, coverage, and functional rewrites of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__place", place).where(F.col("__place") == 1).drop("__place")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    return child.join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def visible(source: Column) -> Column:
    return source.isNull() | (source != "manual_deleted")


def manual(source: Column) -> Column:
    return F.coalesce(source, F.lit("")).isin("manual", "manual_deleted")


def in_scope(asset: Column, wanted: Column) -> Column:
    return (asset == wanted) | asset.isNull()


def has_text(text: Column) -> Column:
    return F.length(F.trim(F.coalesce(text, F.lit("")))) > 0


def ascii_like(text: Column, part: str) -> Column:
    """Substring test that folds A-Z only."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(text, upper, lower).like(f"%{part.translate(str.maketrans(upper, lower))}%")


def any_column_like(df: DataFrame, part: str) -> DataFrame:
    return df.where(reduce(lambda a, b: a | b, [ascii_like(F.col(c).cast("string"), part) for c in df.columns]))


def upsert(old: DataFrame, new: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """``new`` over ``old`` by key; columns in ``keep`` stay as they were where the key existed. Null keys equal none."""
    a, b = old.withColumn("__is", F.lit(True)).alias("o"), new.withColumn("__is", F.lit(True)).alias("n")
    both = a.join(b, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    was, comes = F.col("o.__is").isNotNull(), F.col("n.__is").isNotNull()
    pick = lambda c: F.when(was & (~comes | F.lit(c in keep)), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
    return both.select(*[pick(c).alias(c) for c in old.columns])


def replace_in_scope(old: DataFrame, new: DataFrame, scope: list[str]) -> DataFrame:
    """Rows of every scope that ``new`` has are exchanged for those of ``new``."""
    return old.join(new.select(*scope).distinct(), scope, "left_anti").unionByName(new)


def without(df: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """Cascade: rows whose key is in ``gone`` (one column) are deleted."""
    return df.join(gone.toDF(key), key, "left_anti")


def merged_text(df: DataFrame, keys: list[str], order: list[str], text: str, separator: str = " ") -> DataFrame:
    """Texts of each key in order, joined."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("__t"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r["__t"]), separator).alias(text))
