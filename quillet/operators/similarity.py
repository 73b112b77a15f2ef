"""The k most similar vectors of every vector, exactly, by blocked matrix products that leave out blocks which can't hold any.

1. Vectors become unit vectors and go to the most similar of at most ``PIVOTS`` pivots of their length; dealt by range of (length, pivot, similarity) and cut into
   blocks of at most ``ROWS``, a block is a small ball: its centre and radius bound what any of its vectors can be to any of another block.
2. A block compared with itself gives each of its rows a k-th similarity to begin with; the least of these is what another block must be able to reach.
   Blocks (not vectors) are joined where the balls' bound reaches it.
3. Blocks meet in a product of the written blocks' partitions, so no vector is shuffled: a task reads one partition of either side, holds the second and streams the
   first. Pairs whose balls can't reach each other are left out before and, as the k-th similarities rise, while they are compared; a vector gives at most k rows a task.
4. A window keeps the best k of all, after each task has kept its own.

Defined results: null or empty vectors, those with null or non-finite components and those of length zero take no part; only vectors
of one number of components are compared; similarities are rounded to six digits and ties go to the smaller vec_id; rows that repeat a vec_id are
vectors each, but never similar to one of their own vec_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillet.sources.shared import staged

#: Pivots at most; rows of a block; blocks of a partition on average; blocks of one side that are joined with all of the other in a task of ``cells``.
PIVOTS, ROWS, GROUP, CHUNK = 256, 512, 16, 256
_UNITS = "vec_id long, dim int, unit binary"
_BLOCKS = "block long, part int, dim int, ids binary, units binary, kth binary, centre array<double>, radius double, least double"


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, dims, out = [], [], []
        for vec_id, v in zip(b.column("vec_id").to_pylist(), b.column("v").to_pylist(), strict=True):
            x = np.array(v, float) if v and None not in v else np.empty(0)
            norm = float(np.sqrt(x @ x)) if len(x) else 0.0
            if 0 < norm < np.inf:
                ids.append(vec_id)
                dims.append(len(x))
                out.append((x / norm).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], names=["vec_id", "dim", "unit"])


def _rows(units: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(units), "<f8").reshape(-1, dim)


def _placed(pivots: dict[int, np.ndarray]):
    """The most similar pivot of each vector's own length, and how similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, units = np.asarray(b.column("dim")), b.column("unit").to_pylist()
            pivot, near = np.full(len(dims), -1, np.int32), np.zeros(len(dims))
            for d in set(dims.tolist()) & pivots.keys():
                on = np.flatnonzero(dims == d)
                like = _rows([units[i] for i in on], d) @ pivots[d].T
                pivot[on], near[on] = like.argmax(1), like.max(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pivot), pa.array(near)], names=["vec_id", "dim", "unit", "pivot", "near"])

    return run


def _compared(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray) -> np.ndarray:
    """Rounded similarities; of rows with one id, none."""
    like = np.round(q @ c.T, 6)
    like[q_ids[:, None] == c_ids[None, :]] = -np.inf
    return like


def _cut(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held: list[tuple[int, bytes]] = []
        kind: tuple[int, int] | None = None

        def block() -> pa.RecordBatch:
            ids, x = np.array([h[0] for h in held], np.int64), _rows([h[1] for h in held], kind[0])
            like = _compared(x, ids, x, ids)
            kth = np.partition(like, len(ids) - k, 1)[:, len(ids) - k] if len(ids) > k else np.full(len(ids), -np.inf)
            centre = x.mean(0)
            radius = float(np.sqrt(((x - centre) ** 2).sum(1).max()))
            row = [[(part << 24) + seq], [part], [kind[0]], [ids.tobytes()], [x.tobytes()], [kth.tobytes()], [centre.tolist()], [radius], [float(max(kth.min(), -2.0))]]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.float64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], names=["block", "part", "dim", "ids", "units", "kth", "centre", "radius", "least"])

        for b in batches:
            for vec_id, dim, unit, pivot in zip(*(b.column(c).to_pylist() for c in ("vec_id", "dim", "unit", "pivot")), strict=True):
                if held and (kind != (dim, pivot) or len(held) == ROWS):
                    yield block()
                    held, seq = [], seq + 1
                kind = (dim, pivot)
                held.append((vec_id, unit))
        if held:
            yield block()

    return run


def _reach(a: np.ndarray, ra: float, b: np.ndarray, rb: float) -> float:
    """The highest similarity of unit vectors of two balls, with room for rounding."""
    apart = max(0.0, float(np.sqrt(((a - b) ** 2).sum())) - ra - rb)
    return 1 - apart * apart / 2 + 2e-6


def _kept(found: list[np.ndarray], k: int) -> list[np.ndarray]:
    """(row, id, similarity) of each row's k best, ties by id, in order of rows."""
    order = np.lexsort((found[1], -found[2], found[0]))
    found = [x[order] for x in found]
    place = np.arange(len(order)) - np.searchsorted(found[0], found[0])
    return [x[place < k] for x in found]


def _met(k: int):
    """The best k of each asking block's rows among the blocks that it meets one after another."""
    numbers = lambda column, i, kind: np.frombuffer(column[i].as_buffer(), kind)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, x, kth, ball = None, None, None, None, None
        found: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            columns = ((block << 10) + found[0], ids[found[0]], found[1], found[2])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["row", "vec_id", "similar_id", "similarity"])

        for b in batches:
            c = {name: b.column(name) for name in b.schema.names}
            for i in range(len(b)):
                dim = c["dim"][i].as_py()
                if c["q_block"][i].as_py() != block:
                    if block is not None:
                        yield out()
                    block, ids, x, kth = c["q_block"][i].as_py(), numbers(c["q_ids"], i, "<i8").copy(), numbers(c["q_units"], i, "<f8").reshape(-1, dim).copy(), numbers(c["q_kth"], i, "<f8").copy()
                    ball = c["q_centre"][i].values.to_numpy(), c["q_radius"][i].as_py()
                    found = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
                if _reach(*ball, c["centre"][i].values.to_numpy(), c["radius"][i].as_py()) < kth.min():
                    continue
                other = numbers(c["ids"], i, "<i8")
                like = _compared(x, ids, numbers(c["units"], i, "<f8").reshape(-1, dim), other)
                row, at = np.nonzero((like >= kth[:, None]) & (like > -np.inf))
                found = _kept([np.concatenate(f) for f in zip(found, (row, other[at], like[row, at]), strict=True)], k)
                full = np.flatnonzero(np.bincount(found[0], minlength=len(kth)) == k)
                kth[full] = np.maximum(kth[full], found[2][np.searchsorted(found[0], full, side="right") - 1])
        if block is not None:
            yield out()

    return run


def blocks_of(vectors: DataFrame, k: int, vector: str = "embedding") -> DataFrame:
    """Steps 1 and the first of 2: the written blocks."""
    units = staged(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).alias("v")).mapInArrow(_units, _UNITS), "units")
    n = units.count()
    some = units.orderBy(F.xxhash64("vec_id"), "vec_id", "unit").limit(min(PIVOTS, -(-n // ROWS))).collect() if n else []
    pivots = {d: _rows([r["unit"] for r in some if r["dim"] == d], d) for d in {r["dim"] for r in some}}
    order = ["dim", "pivot", "near", "vec_id", "unit"]
    placed = units.mapInArrow(_placed(pivots), f"{_UNITS}, pivot int, near double")
    dealt = placed.repartitionByRange(max(1, -(-n // (ROWS * GROUP))), *order).sortWithinPartitions(*order)
    return staged(dealt.mapInArrow(_cut(k), _BLOCKS), "blocks")


def _reaches() -> Column:
    """Whether a block (centre, radius, least) may find in another's ball (c, r) what it hasn't in itself."""
    gap = F.sqrt(F.aggregate(F.zip_with("centre", "c", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    apart = F.greatest(F.lit(0.0), gap - F.col("radius") - F.col("r"))
    return 1 - apart * apart / 2 + 2e-6 >= F.col("least")


def cells(blocks: DataFrame) -> DataFrame:
    """(part, with, block, asks): which blocks meet, by partitions, to see how much is left out; one row for a block of either side, and only centres are joined."""
    many = max(1, -(-blocks.count() // CHUNK))
    ball = blocks.select("block", "part", "dim", "centre", "radius", "least")
    left = ball.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
    right = ball.select(F.col("block").alias("b"), F.col("part").alias("with"), "dim", F.col("centre").alias("c"), F.col("radius").alias("r")).withColumn("chunk", F.pmod(F.xxhash64("b"), F.lit(many)).cast("int"))
    pairs = staged(left.join(right, ["dim", "chunk"]).where(_reaches()).select("part", "with", "block", "b"), "pairs")
    asking = pairs.select("part", "with", "block").distinct().withColumn("asks", F.lit(True))
    return asking.unionByName(pairs.select("part", "with", F.col("b").alias("block")).distinct().withColumn("asks", F.lit(False)))


def similar_all(vectors: DataFrame, k: int = 5, vector: str = "embedding") -> DataFrame:
    """(vec_id, rank, similar_id, similarity) for every vector."""
    blocks = blocks_of(vectors, k, vector)
    asking = blocks.select(F.col("block").alias("q_block"), F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("units").alias("q_units"), F.col("kth").alias("q_kth"), "centre", "radius", "least")
    other = blocks.select("dim", "ids", "units", F.col("centre").alias("c"), F.col("radius").alias("r"))
    # no equality of columns, which would be a join by shuffle; the hint asks for the product of partitions at any size
    pairs = asking.join(other.hint("shuffle_replicate_nl"), F.when(F.col("q_dim") - F.col("dim") == 0, _reaches()))
    pairs = pairs.select("q_block", "q_ids", "q_units", "q_kth", F.col("centre").alias("q_centre"), F.col("radius").alias("q_radius"), "dim", "ids", "units", F.col("c").alias("centre"), F.col("r").alias("radius"))
    heaps = pairs.mapInArrow(_met(k), "row long, vec_id long, similar_id long, similarity double")
    place = F.row_number().over(W.partitionBy("row").orderBy(F.desc("similarity"), "similar_id"))
    return heaps.withColumn("rank", place).where(F.col("rank") <= k).select("vec_id", "rank", "similar_id", "similarity")
