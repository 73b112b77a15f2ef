"""Importance resampling towards a target distribution, on hashed n-grams.

1. One Arrow scan of either table hashes each run of 1 to ``most`` words to one of ``buckets`` and counts by ``np.bincount``: one vector
   a partition, whatever it holds. ``treeReduce`` merges the vectors on the executors, so the driver gets a few of them at most.
2. A bucket's gain is floor(1000 ln) of the smoothed ratio of its shares in target and raw texts. The gains (one number a
   bucket, which bounds the broadcast) go to a second scan that gathers them by bucket and sums each document's with
   bincount weights; the floored mean is its weight.
3. Each document draws Gumbel noise from a hash of its id, and the ``percent`` highest sums of weight and noise are taken: sampling
   without replacement in proportion to exp(weight / 1000), the same in each run.

Ranks come without a sort in one task: scores are integers in a range that the gains bound, so their histogram gives the lowest
score taken; only rows from there on are dealt by range, sorted within partitions and numbered by (partition, place) plus the
rows of the partitions before.

Defined results: null and empty texts have no features and weight 0; a null doc_id draws its noise as the empty
text; rows that repeat a doc_id are documents each, and of rows equal in score and doc_id any takes the smaller rank; an empty table
gives an empty result; with an empty target its shares are uniform. Columns besides doc_id and text are ignored, and kept by ``resampled``.
"""

from __future__ import annotations

import math
import operator
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillet.llm.common import spread, staged
from quillet.llm.lsh import slices
from quillet.llm.terms import terms

BUCKETS, MOST, LEAST, PERCENT, SEED = 10_000, 1, 20, 10, 2024


class _Hashes(dict):
    """crc32 of each word, kept while there is room."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 150_000:
            self.clear()
        h = self[word] = zlib.crc32(word)
        return h


_hashes = _Hashes()


def feature_hashes(words: list[bytes], most: int = MOST) -> np.ndarray:
    """crc32 of every run of 1 to ``most`` words, joined by one space."""
    runs = list(map(_hashes.__getitem__, words))
    out, longer = [runs], runs
    for n in range(2, most + 1):
        longer = [zlib.crc32(b" " + w, h) for h, w in zip(longer, words[n - 1 :], strict=False)]
        out.append(longer)
    return np.array([h for part in out for h in part], np.int64)


def _hashed(part: pa.RecordBatch, most: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features of a slice, features a row, words a row."""
    words = [terms(t) for t in part.column("text").cast(pa.binary()).to_pylist()]
    found = [feature_hashes(w, most) for w in words]
    return (np.concatenate(found) if found else np.empty(0, np.int64)) % buckets, np.array([len(f) for f in found], np.int64), np.array([len(w) for w in words], np.int64)


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, most: int = MOST) -> np.ndarray:
    """Features of all of ``docs`` by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in slices(batches):
            total += np.bincount(_hashed(part, most, buckets)[0], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["vector"])

    none = docs.sparkSession.createDataFrame([(np.zeros(buckets, np.int64).tobytes(),)], "vector binary")
    vectors = docs.select("text").mapInArrow(run, "vector binary").union(none)
    return vectors.rdd.map(lambda r: np.frombuffer(r["vector"], np.int64)).treeReduce(operator.add)


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of target share over raw share of each bucket, one added to each count."""
    width, s_all, t_all = len(raw), float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + width) / ((s + 1) * (t_all + width)))) for s, t in zip(map(float, raw), map(float, target), strict=True)], np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of sha256(seed:doc_id)."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """Every row of ``docs`` with n_words, n_features, weight and score before its own columns other than these."""
    gain = gains(bucket_counts(docs, buckets, most), bucket_counts(target, buckets, most))
    sent = docs.sparkSession.sparkContext.broadcast(gain)
    own = [c for c in docs.columns if c not in ("n_words", "n_features", "weight", "score")]
    bare = docs.select(*own)
    schema = "n_words long, n_features long, weight long, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bare.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            at, size, words = _hashed(part, most, buckets)
            total = np.bincount(np.repeat(np.arange(len(size)), size), weights=sent.value[at], minlength=len(size)).astype(np.int64)
            weight = np.floor_divide(total, np.maximum(size, 1))
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(size), pa.array(weight), *part.columns], names=["n_words", "n_features", "weight", *part.schema.names])

    return bare.mapInArrow(run, schema).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def _taken(able: DataFrame, percent: int) -> tuple[int, int | None]:
    """How many rows are drawn, and the lowest score among them."""
    histogram = sorted(((r["score"], r["count"]) for r in able.groupBy("score").count().collect()), reverse=True)  # bounded by the range of scores
    most = sum(c for _, c in histogram) * percent // 100
    left = most
    for score, count in histogram if most else ():
        left -= count
        if left <= 0:
            return most, score
    return most, None


def draw(rows: DataFrame, least: int = LEAST, percent: int = PERCENT) -> DataFrame:
    """``rows`` (doc_id, n_words, n_features, weight, score, written already) with rank, null where a row isn't drawn."""
    able = F.col("n_words") >= least
    most, low = _taken(rows.where(able), percent)
    if low is None:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    high = able & (F.col("score") >= low)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("lot")]
    dealt = rows.where(high).withColumn("lot", F.monotonically_increasing_id()).repartitionByRange(spread(most, 200_000, 8), *order).sortWithinPartitions(*order)
    placed = staged(dealt.drop("lot").withColumn("at", F.monotonically_increasing_id()), "drawn")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    before, offsets = 0, []
    for r in placed.groupBy(part.alias("part")).count().orderBy("part").collect():  # a row a partition
        offsets.append((r["part"], before))
        before += r["count"]
    starts = rows.sparkSession.createDataFrame(offsets, "part long, before long")
    rank = F.col("before") + place + 1
    ranked = placed.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("rank", F.when(rank <= most, rank))
    return rows.where(~high).withColumn("rank", F.lit(None).cast("long")).unionByName(ranked.select(*rows.columns, "rank"))


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, most: int = MOST, least: int = LEAST, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row: the ``percent`` best of those with ``least`` words have a rank."""
    bare = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return draw(staged(scored(bare, target, buckets, most, seed).select("doc_id", "n_words", "n_features", "weight", "score"), "weights"), least, percent)


def resampled(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, most: int = MOST, least: int = LEAST, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that are drawn, with their own columns: all above the lowest score taken, the smallest doc_ids at it."""
    rows = staged(scored(docs, target, buckets, most, seed), "weighted")
    able = rows.where(F.col("n_words") >= least)
    taken, low = _taken(able.select("score"), percent)
    bare = able.select(*[c for c in docs.columns if c in rows.columns], "score")
    if low is None:
        return bare.limit(0).drop("score")
    over = bare.where(F.col("score") > low)
    return over.union(bare.where(F.col("score") == low).orderBy(F.asc_nulls_last("doc_id")).limit(taken - over.count())).drop("score")
