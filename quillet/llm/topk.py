"""Exact top-k by inner product over a vector-approximation file.

Vectors become integers, floor(1024 x), and are written once with a quantised copy of one byte a component: cells of equal
width 2^s over the range of all components. For a query q and a cell's lower corner c the score lies in
[q.c + L, q.c + U], where L and U depend on q alone. Queries are taken in blocks of ``BLOCK``:

1. every partition scans the cells only (one column) and gives, for each query, the k-th largest of its lower bounds;
   the largest of these over all partitions is below the true k-th score, so it is a safe threshold;
2. every partition scans the cells again and gives the rows whose upper bound reaches the threshold, as candidates.

Then, for the candidates of all blocks at once, exact vectors are joined by row in order of bounds: first those of the k highest
upper bounds of each query, whose k-th score is the next threshold; then those whose upper bound still reaches it. All
others can't be among the best k, and their exact vectors meet no query.

Driver and executors hold one block of queries at a time, whose size doesn't grow with the data. Candidates are rows; a query
with many equal ones has as many.

Defined results: null or empty vectors and those holding null or non-finite components take no part, nor do rows without
vec_id; only vectors of the query's length are scored; ties go to the smaller vec_id; rows that repeat a vec_id are
candidates each, but never of a query with their own vec_id; of query rows that repeat a vec_id the least vector asks. Empty
tables give empty results. Columns besides vec_id and the vector are ignored. Integers beyond 64 bits become the ends of
that range; scores are summed without overflow (in Python integers where the table's largest numbers ask for it), and those
beyond 64 bits become its ends, and tie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillet.llm.common import new_path, staged

BLOCK, ROWS = 4096, 512
_CANDIDATE = "query_id long, row long, upper long"
_LEAST, _MOST = -(2**63), 2**63 - 1


def integers(vector: Column) -> Column:
    """floor(1024 x) of each component, or null where the vector takes no part."""
    whole = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & whole, F.transform(vector, lambda x: F.floor(x.cast("double") * 1024).cast("long")))


def _encode(low: int, shift: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            flat, size = np.asarray(v.flatten()), np.diff(np.asarray(v.offsets))
            above = flat.astype(np.uint64) - np.array(low).astype(np.uint64)  # exact even where the range is wider than an int64
            codes = (above >> np.uint64(shift)).astype(np.uint8)
            at = np.concatenate([[0], np.cumsum(size)])
            cut = lambda a, n=1: pa.array([a[i:j].tobytes() for i, j in zip(at, at[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("vec_id"), pa.array(size, pa.int32()), cut(codes), cut(flat.astype("<i8"))], names=["row", "vec_id", "dim", "cells", "exact"])

    return run


def _number(size: int) -> type:
    """A type that holds sums of magnitude ``size`` exactly."""
    return np.float64 if size < 2**53 else np.int64 if size < 2**62 else object


def _long(x: np.ndarray) -> pa.Array:
    """Scores or bounds as 64-bit integers; what lies beyond becomes the end of the range."""
    return pa.array(np.array([min(max(int(y), _LEAST), _MOST) for y in x], np.int64) if x.dtype == object else x.astype(np.int64), pa.int64())


class _Block:
    """A block of queries of one length."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, low: int, shift: int, k: int):
        self.ids, self.k, self.low, self.shift = ids, k, low, shift
        dtype = _number(2 * q.shape[1] * max(-int(q.min()), int(q.max()), 1) * (abs(low) + (256 << shift)))
        self.q = q.astype(dtype)
        width = (1 << shift) - 1
        self.under, self.over = np.minimum(self.q, 0).sum(1) * width, np.maximum(self.q, 0).sum(1) * width
        self.none = -(1 << 300) if dtype is object else self.q.dtype.type(-(2**62))

    def base(self, ids: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Scores of cells' lower corners, queries by rows; a query's own row is out."""
        corner = cells.astype(object if self.q.dtype == object else np.int64) * (1 << self.shift) + self.low
        out = self.q @ corner.T.astype(self.q.dtype)
        own = self.ids[:, None] == ids[None, :]
        out[own] = self.none
        return out

    def best(self, scores: np.ndarray) -> np.ndarray:
        """The k largest scores of each row, in any order."""
        cut = scores.shape[1] - self.k
        return (np.sort(scores, 1) if scores.dtype == object else np.partition(scores, cut, 1))[:, cut:]


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(dim, rows, ids, cells) of up to ROWS rows of one length."""
    for at in range(0, batch.num_rows, ROWS):
        b = batch.slice(at, ROWS)
        rows, ids, dims = (np.asarray(b.column(c)) for c in ("row", "vec_id", "dim"))
        cells = b.column("cells").to_pylist()
        for d in np.unique(dims):
            on = np.flatnonzero(dims == d)
            yield int(d), rows[on], ids[on], np.frombuffer(b"".join(cells[i] for i in on), np.uint8).reshape(len(on), d)


def _thresholds(blocks: dict[int, _Block]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {d: np.full((len(x.ids), x.k), x.none, x.q.dtype) for d, x in blocks.items()}
        for batch in batches:
            for d, _, ids, cells in _parts(batch):
                if d in blocks:
                    best[d] = blocks[d].best(np.concatenate([best[d], blocks[d].base(ids, cells)], 1))
        for d, x in blocks.items():
            kth = best[d].min(1)
            on = np.flatnonzero(kth > x.none)
            yield pa.RecordBatch.from_arrays([pa.array(x.ids[on], pa.int64()), _long((kth + x.under)[on])], names=["query_id", "least"])

    return run


def _reaching(blocks: dict[int, _Block], least: dict[int, np.ndarray]):
    """(query_id, row, upper) where a row's upper bound reaches the query's threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, rows, ids, cells in _parts(batch):
                if d in blocks:
                    x = blocks[d]
                    upper = x.base(ids, cells) + x.over[:, None]
                    able = (upper >= least[d][:, None]) & (x.ids[:, None] != ids[None, :])
                    i, j = np.nonzero(able.astype(bool))
                    if len(i):
                        yield pa.RecordBatch.from_arrays([pa.array(x.ids[i], pa.int64()), pa.array(rows[j], pa.int64()), _long(upper[i, j])], names=["query_id", "row", "upper"])

    return run


def _products(top: int):
    """Rows of a query's and a candidate's exact vectors to their inner products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                dims, q, v = np.asarray(b.column("dim")), b.column("q").to_pylist(), b.column("exact").to_pylist()
                for d in np.unique(dims):
                    on = np.flatnonzero(dims == d)
                    x, y = (np.frombuffer(b"".join(w[i] for i in on), "<i8").reshape(len(on), d).astype(_number(int(d) * top * top)) for w in (q, v))
                    few = pa.array(on)
                    yield pa.RecordBatch.from_arrays([b.column("query_id").take(few), b.column("vec_id").take(few), _long((x * y).sum(1))], names=["query_id", "vec_id", "score"])

    return run


def _query_blocks(queries: DataFrame, block: int) -> Iterator[list]:
    rows = []
    for r in queries.toLocalIterator():
        rows.append(r)
        if len(rows) == block:
            yield rows
            rows = []
    if rows:
        yield rows


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``vectors`` where ``is_query`` holds."""
    spark = vectors.sparkSession
    ready = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col(vector)).alias("v")).where("v is not null and vec_id is not null")
    low, high = ready.agg(F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if low is None:
        return none
    shift = max(0, (high - low).bit_length() - 8)
    numbered = ready.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v")
    file = staged(numbered.mapInArrow(_encode(low, shift), "row long, vec_id long, dim int, cells binary, exact binary"), "va-file")
    asked = file.where(is_query).groupBy("vec_id", "dim").agg(F.min("exact").alias("exact")).groupBy("vec_id").agg(F.min(F.struct("dim", "exact")).alias("q"))
    asked = staged(asked.select(F.col("vec_id").alias("query_id"), "q.dim", F.col("q.exact").alias("q")), "va-queries")
    cells = file.select("row", "vec_id", "dim", "cells")
    folder = new_path(spark, "va-candidates")
    some = False
    for n, rows in enumerate(_query_blocks(asked, block)):
        rows.sort(key=lambda r: r["query_id"])
        blocks = {}
        for d in sorted({r["dim"] for r in rows}):
            own = [r for r in rows if r["dim"] == d]
            q = np.stack([np.frombuffer(r["q"], "<i8") for r in own])
            blocks[d] = _Block(np.array([r["query_id"] for r in own]), q, low, shift, k)
        bound = cells.mapInArrow(_thresholds(blocks), "query_id long, least long").groupBy("query_id").agg(F.max("least").alias("least"))
        known = {r["query_id"]: r["least"] for r in bound.collect()}  # a block of queries at most
        least = {d: np.array([known.get(int(i), _LEAST) for i in x.ids], np.int64) for d, x in blocks.items()}
        cells.mapInArrow(_reaching(blocks, least), _CANDIDATE).write.parquet(f"{folder}/block={n}")
        some = True
    if not some:
        return none
    candidates = spark.read.schema(_CANDIDATE).parquet(f"{folder}/*")

    def scored(rows: DataFrame) -> DataFrame:
        met = rows.select("query_id", "row").join(file.select("row", "vec_id", "exact"), "row").join(asked, "query_id")
        return staged(met.select("query_id", "vec_id", "dim", "q", "exact").mapInArrow(_products(max(abs(low), abs(high))), "query_id long, vec_id long, score long"), "va-scores")

    bounds = W.partitionBy("query_id").orderBy(F.desc("upper"), "row")
    first = staged(candidates.withColumn("n", F.row_number().over(bounds)).where(F.col("n") <= k).drop("n"), "va-first")
    found = scored(first)
    kth = staged(found.groupBy("query_id").agg(F.min("score").alias("kth")), "va-kth")
    later = candidates.join(kth, "query_id").where("upper >= kth").join(first, ["query_id", "row"], "left_anti")
    found = found.union(scored(later))
    ranked = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
