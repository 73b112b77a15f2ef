"""MinHash near-deduplication of documents: equal sets first, then banded candidates, verified on full sets.

Documents with the same shingle set are one unit, counted map-side, so a group of a third of all rows is one row from
here on. Signatures, never sets, of all units are dealt into buckets; sets are made again, from the text, for the units that share
a bucket at all, which are chosen by place, so no text is shuffled. Chance collisions stay rare at any size because a band asks for ``rows`` equal places at once.
With 40 bands of 6 places a pair of similarity 0.8 is missed with probability 5e-6.

Defined results: null text and text without words have an empty set and are linked with nothing; texts shorter than
a shingle count as one shingle; rows that share a doc_id are each reported; a document's component is the smallest doc_id
reachable over links, null where no reachable row has a doc_id; an empty table gives an empty result; further columns are kept by ``keep_one``, whatever
their names, and ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.llm.common import staged
from quillet.llm.lsh import band_keys, link, shingle_set, slices
from quillet.llm.places import Places

BANDS, ROWS = 40, 6


def _signatures(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = [shingle_set(t or b"", words) for t in part.column("text").to_pylist()]
            some = [i for i, s in enumerate(sets) if len(s)]
            keys: list = [None] * len(sets)
            if some:
                made = band_keys([sets[i] for i in some], bands, rows)
                for i, k in zip(some, made, strict=True):
                    keys[i] = k
            same = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("doc_id", "file", "at")), pa.array([len(s) for s in sets], pa.int64()), pa.array(same, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "file", "at", "n", "same", "keys"],
            )

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            items = [shingle_set(t or b"", words) for t in part.column("text").to_pylist()]
            same = [xxhash.xxh3_128_digest(s.tobytes()) for s in items]
            yield pa.RecordBatch.from_arrays([pa.array(same, pa.binary()), pa.array([s.view(np.int64) for s in items], pa.list_(pa.int64()))], names=["same", "items"])

    return run


def _linked(placed: Places, words: int, percent: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """Every row as (doc_id, file, at, n, same), and of each distinct set (same) the first row of its component as ``head``."""
    bare = placed.bare(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    signed = staged(bare.mapInArrow(_signatures(words, bands, rows), "doc_id long, file long, at long, n long, same binary, keys array<long>"), "signatures")
    head = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "file", "at")
    units = signed.where("n > 0").groupBy("same").agg(F.min(head).alias("head"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    units = staged(units.select(F.monotonically_increasing_id().alias("unit"), "*"), "units")

    def sets_of(wanted: DataFrame) -> DataFrame:
        chosen = staged(units.join(wanted, "unit", "left_semi").select("unit", "same", "head.file", "head.at"), "wanted")
        texts = placed.only(chosen).select(F.col("text").cast("binary").alias("text"))
        return texts.mapInArrow(_sets(words), "same binary, items array<long>").join(chosen.select("same", "unit"), "same").select("unit", "items")

    parts = link(units.select("unit", "keys"), units.select("unit", "n"), sets_of, percent)
    first = staged(units.select("unit", "head").join(parts, "unit").groupBy("component").agg(F.min("head").alias("first")), "firsts")
    named = units.select("same", "unit", "head").join(parts, "unit", "left").withColumn("component", F.coalesce("component", "unit"))
    named = named.join(first, "component", "left").select("same", F.coalesce("first", "head").alias("head"))  # plain rows by component: a large one can be split
    return signed.drop("keys"), staged(named, "named")


def components(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id."""
    signed, named = _linked(Places(docs), words, percent, bands, rows)
    out = signed.select("doc_id", "n", "same").join(named, "same", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("head.doc_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, that of the smallest doc_id, and the rows that are linked with nothing, with their own columns."""
    placed = Places(docs)
    signed, named = _linked(placed, words, percent, BANDS, ROWS)
    kept = signed.where("n = 0").select("file", "at").union(named.select("head.file", "head.at").distinct())
    return placed.only(kept)
