"""Exact deduplication against a persistent digest index, bucketed and sorted by hash.

The index is a Parquet table of one row for each distinct text ever admitted: its SHA-256 digest, the document that stays and
the batch that brought it. It is bucketed and sorted by digest, so a new batch is laid out once into the
same buckets and meets the index in a sort-merge anti-join that moves no index row; what is new is
appended. The number of buckets is written beside the index and read again by whoever opens it. Every append adds a file to each bucket; a bucket of
several files is sorted again, alone, when it is read. A batch has a name: run again under the same name, after
a failure behind its append, it owns what it appended then and appends nothing twice. The text itself is read once and never shuffled: only digests are.

Skew: copies are counted map-side before any exchange, so a text that a third of all rows share
reaches a reducer as one row from each map task. Only the last join, which tells every row its
group, meets the hot digest, and both of its inputs are plain exchanges that adaptive execution splits.
``keep_distinct`` needs no such join: a group names the place of the row that stays.

Defined results: null text counts as empty; texts are equal when identical after each run of white
space is replaced by one space (leading and trailing runs too); of equal texts the row with the smallest
doc_id stays; a text that an earlier batch admitted belongs to that batch's document. Rows that repeat a
doc_id with an equal text are all reported, and ``keep_distinct`` returns one of them. Rows without doc_id come after all others: where
no equal text has a doc_id, one of them stays, each is reported with keep_id null, and with kept true, as rows of a group without any id are told apart by
``keep_distinct`` only. Empty tables give empty results. Columns besides doc_id and text are never looked at, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillet.llm.common import BLANK, new_path, shuffle_partitions, staged
from quillet.llm.places import Places


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK, " ")


def digest(text: Column) -> Column:
    """32 bytes that stand for a whole text from here on."""
    return F.unhex(F.sha2(normalised(text), 256))


class DigestIndex:
    """A bucketed, sorted table (digest, keep_id, batch) at ``path``; opened again by a later session from the path alone."""

    schema = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("keep_id", T.LongType()), T.StructField("batch", T.StringType())])

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        self.buckets = self._spec(buckets)
        self.name = f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def _spec(self, buckets: int | None) -> int:
        """The number of buckets written beside the index, or else the one asked for, written now."""
        beside = self.path + ".spec"
        try:
            written = self.spark.read.schema("buckets int").json(beside).first()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            written = None
        if written is None:
            buckets = buckets or shuffle_partitions(self.spark)
            self.spark.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.json(beside)
            return buckets
        if buckets not in (None, written["buckets"]):
            raise ValueError(f"the index at {self.path} has {written['buckets']} buckets, not {buckets}")
        return written["buckets"]

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, fresh: DataFrame) -> None:
        out = fresh.select("digest", "keep_id", "batch").repartition(self.buckets, "digest")
        (
            out.write.mode("append").format("parquet").option("path", self.path)
            .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)
        )


def _admitted(groups: DataFrame, index: DigestIndex, batch: str) -> tuple[DataFrame, DataFrame]:
    """``groups`` (digest, keep_id, ...) not met in other batches, which are appended, and those met, with their owner's keep_id."""
    known = index.rows()
    others = known.where(F.col("batch") != batch).select("digest", F.col("keep_id").alias("known_id"))
    fresh = staged(groups.hint("merge").join(others, "digest", "left_anti"), "digest-fresh")
    rest = [c for c in groups.columns if c not in ("digest", "keep_id")]
    seen = staged(groups.join(others.hint("merge"), "digest").select("digest", F.col("known_id").alias("keep_id"), *rest), "digest-seen")
    mine = known.where(F.col("batch") == batch).select("digest")
    index.append(fresh.hint("merge").join(mine, "digest", "left_anti").withColumn("batch", F.lit(batch)))
    return fresh, seen


def exact_dedup(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """Admit a batch to the index. One row per input row: doc_id, digest, keep_id, group_size (in this batch), kept."""
    rows = staged(docs.select("doc_id", digest(F.col("text")).alias("digest")), "digests")
    groups = rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    fresh, seen = _admitted(staged(groups, "digest-groups"), index, batch or uuid.uuid4().hex)
    owners = fresh.withColumn("admitted", F.lit(True)).unionByName(seen.withColumn("admitted", F.lit(False)))
    kept = F.col("admitted") & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return rows.join(staged(owners, "digest-owners"), "digest").select("doc_id", "digest", "keep_id", "group_size", kept.alias("kept"))


def keep_distinct(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, one of each text that is new to the index, with their own columns."""
    spark = docs.sparkSession
    index = index or DigestIndex(spark, new_path(spark, "digest-index"))
    placed = Places(docs)
    rows = staged(placed.bare(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest")), "digests")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "file", "at")).alias("first")
    groups = staged(rows.groupBy("digest").agg(first).select("digest", F.col("first.doc_id").alias("keep_id"), "first.file", "first.at"), "digest-groups")
    fresh, _ = _admitted(groups, index, batch or uuid.uuid4().hex)
    return placed.only(fresh)
