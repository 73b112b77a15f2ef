"""Token counts by separator scan of flat token files.

A flat token file is a stream of ids in which an end-of-document id closes each document; it has no index. Here a stream is stored as
fixed-size blocks (file, block, data), so that any number of tasks scan one file. Each block is searched for the
separator in one vectorised comparison; what it gives is the number of separators, the ids before the first and after the last, and the lengths of
the documents that lie inside. A prefix scan in two levels (over the sums of runs of blocks, one small row a run, and inside each run by itself,
so one large file uses many tasks) then says which document each block begins in and how many ids of it came before, and only documents that cross a block's edge are stitched, by summing their parts.

Defined results: null and empty texts are documents of no token; special strings in a text are ordinary text, so no separator
can occur inside a document; repeated rows are separate documents; ids after the last separator of a file belong to an unfinished document, reported
as not closed; an empty table gives an empty result. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillet.llm.common import staged
from quillet.llm.lsh import slices
from quillet.llm.tokens import encoder

#: Ids in a block.
BLOCK = 1 << 16
#: Blocks in a run; the prefix scan goes over runs, by their sums, and inside each run by itself.
RUN = 256


def _write(path: str, end_id: int, block: int):
    """Documents of a partition to one stream's blocks, and for each document the place it was given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, file = encoder(path, special=False), TaskContext.get().partitionId()
        end, size = np.asarray([end_id], enc.dtype).tobytes(), block * enc.dtype.itemsize
        held, number, document = bytearray(), 0, 0

        def out(blocks: list[bytes], docs: list[int]) -> pa.RecordBatch:
            n, m = len(blocks), len(docs)
            place = [*range(number - n, number)] + [*range(document - m, document)]
            return pa.RecordBatch.from_arrays(
                [pa.array([file] * (n + m), pa.int64()), pa.array(place, pa.int64()), pa.array(blocks + [None] * m, pa.binary()), pa.array([None] * n + docs, pa.int64()), pa.array([enc.dtype.itemsize] * (n + m), pa.int32())],
                names=["file", "place", "data", "doc_id", "width"],
            )

        for part in slices(batches):
            blocks, docs = [], part.column("doc_id").to_pylist()
            for text in part.column("text").to_pylist():
                held += enc.encode(text or "")
                held += end
                while len(held) >= size:
                    blocks.append(bytes(held[:size]))
                    del held[:size]
            number, document = number + len(blocks), document + len(docs)
            yield out(blocks, docs)
        if held:
            number += 1
            yield out([bytes(held)], [])

    return run


def flat_files(docs: DataFrame, tokenizer: str, end_id: int, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Writes ``docs`` as flat streams. Returns (file, block, data, width) and the order of writing (file, ordinal, doc_id)."""
    bare = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    both = staged(bare.mapInArrow(_write(tokenizer, end_id, block), "file long, place long, data binary, doc_id long, width int"), "flat")
    blocks = both.where("data is not null").select("file", F.col("place").alias("block"), "data", "width")
    return blocks, both.where("data is null").select("file", F.col("place").alias("ordinal"), "doc_id")


def read_flat(spark: SparkSession, path: str, width: int = 2, block: int = BLOCK) -> DataFrame:
    """Blocks of flat files that stand as raw little-endian ids at ``path``, each under 2 GB; files are numbered by path."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    order = files.select("path").distinct().select("path", (F.row_number().over(W.orderBy("path")) - 1).cast("long").alias("file"))
    size = block * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                for k, at in enumerate(range(0, len(data), size)):
                    yield pa.RecordBatch.from_pydict({"path": [name], "block": pa.array([k], pa.int64()), "data": [data[at : at + size]], "width": pa.array([width], pa.int32())})

    return files.mapInArrow(run, "path string, block long, data binary, width int").join(order, "path").select("file", "block", "data", "width")


def _scan(end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            count, head, tail, inner = [], [], [], []
            for data, width in zip(part.column("data").to_pylist(), part.column("width").to_pylist(), strict=True):
                ids = np.frombuffer(data, f"<u{width}")
                at = np.flatnonzero(ids == end_id)
                count.append(len(at))
                head.append(int(at[0]) if len(at) else len(ids))
                tail.append(int(len(ids) - at[-1] - 1) if len(at) else 0)
                inner.append(np.diff(at) - 1)
            yield pa.RecordBatch.from_arrays(
                [part.column("file"), part.column("block"), pa.array(count, pa.int64()), pa.array(head, pa.int64()), pa.array(tail, pa.int64()), pa.array(inner, pa.list_(pa.int64()))],
                names=["file", "block", "ends", "head", "tail", "inner"],
            )

    return run


def count_tokens(blocks: DataFrame, end_id: int) -> DataFrame:
    """(file, ordinal, tokens, closed): the length of each document, the separator not counted."""
    found = staged(blocks.mapInArrow(_scan(end_id), "file long, block long, ends long, head long, tail long, inner array<long>"), "scanned")
    cut = found.withColumn("run", F.floor(F.col("block") / RUN))
    sums = cut.groupBy("file", "run").agg(F.sum("ends").alias("ends"))
    earlier = lambda w: F.coalesce(F.sum("ends").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ahead = sums.select("file", "run", earlier(W.partitionBy("file").orderBy("run")).alias("ahead"))
    within = cut.withColumn("first", earlier(W.partitionBy("file", "run").orderBy("block")))
    placed = within.join(ahead, ["file", "run"]).withColumn("first", F.col("first") + F.col("ahead")).drop("run", "ahead")
    inside = placed.where("ends > 1").select("file", F.posexplode("inner").alias("k", "tokens"), "first").select("file", (F.col("first") + 1 + F.col("k")).alias("ordinal"), "tokens", F.lit(True).alias("closed"))
    heads = placed.select("file", F.col("first").alias("ordinal"), F.col("head").alias("tokens"), (F.col("ends") > 0).alias("closed"))
    tails = placed.where("ends > 0 and tail > 0").select("file", (F.col("first") + F.col("ends")).alias("ordinal"), F.col("tail").alias("tokens"), F.lit(False).alias("closed"))
    edges = heads.unionByName(tails).groupBy("file", "ordinal").agg(F.sum("tokens").alias("tokens"), F.max("closed").alias("closed")).where("closed or tokens > 0")
    return inside.unionByName(edges)
