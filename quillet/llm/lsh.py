"""One-permutation MinHash with optimal densification, banded buckets and star-shaped candidate edges.

A text becomes the sorted set of 64-bit hashes of its word shingles. One permutation does: the hash range is cut
into as many bins as the signature has places and the least hash of each bin is taken, which in sorted order is the first.
An empty bin copies the bin that a universal hash of (bin, attempt) names, at the first attempt that finds one
filled; equal sets agree everywhere and each place still agrees with the probability of the Jaccard similarity.

``link`` joins all pairs of units with the similarity asked for that share a bucket, in three steps of which each leaves the
next one less:

1. every member of a bucket is compared with one centre, the least id, so candidates are linear in the members; verified links
   are contracted to components, and a bucket of thousands of near copies mostly becomes one;
2. where a bucket still holds several, members outside its largest component are compared with all of that one;
3. members still outside are compared with each other and with those that step 2 joined to the largest.

Steps 2 and 3 ship bounded chunks of sets against chunks, and compare them in array operations; no pair of units becomes a row
but a link, of which a unit has at most one with each component of a chunk. Chunks meet in cells of a few chunks of either side, and cells are what tasks
are dealt by, so a bucket or component of a third of all units is spread like any other.
No pair of a bucket is left out unless both are connected already.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillet.llm.common import staged
from quillet.llm.components import connected_components, extended

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_S = [np.uint64(x) for x in (30, 27, 31)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = (x ^ (x >> _S[0])) * _B
    x = (x ^ (x >> _S[1])) * _C
    return x ^ (x >> _S[2])


class WordHashes(dict):
    """64-bit hash of each word, kept while there is room."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 150_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = WordHashes()


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words of a text in UTF-8, A-Z lower-cased."""
    words = text.lower().split()  # bytes: A-Z only, and exactly the six ASCII blanks
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def shingle_set(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of a text in UTF-8, A-Z lower-cased; a shorter text is one shingle."""
    return shingles(word_hashes(text), n)


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """``shingle_set`` from the words' hashes."""
    if not len(h):
        return np.empty(0, np.uint64)
    n = min(n, len(h))
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = mixed(out * _A + h[k : len(h) - n + 1 + k])
    return np.unique(mixed(out + np.uint64(n)))


def band_keys(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """len(sets) x bands keys of non-empty sets."""
    k = bands * rows
    edges = (np.arange(k, dtype=np.float64) / k * 2.0**64).astype(np.uint64)
    sig = np.zeros((len(sets), k), np.uint64)
    full = np.zeros((len(sets), k), bool)
    for i, s in enumerate(sets):
        at = np.searchsorted(s, edges)
        end = np.append(at[1:], len(s))
        full[i] = at < end
        sig[i] = s[np.minimum(at, len(s) - 1)]
        if len(s) == 1:
            sig[i], full[i] = s[0], True
    row, place = np.nonzero(~full)
    attempt = 1
    while len(row):
        probe = (mixed(place.astype(np.uint64) * _A + np.uint64(attempt)) % np.uint64(k)).astype(np.int64)
        hit = full[row, probe]
        sig[row[hit], place[hit]] = sig[row[hit], probe[hit]]
        row, place = row[~hit], place[~hit]
        attempt += 1
    parts = sig.reshape(len(sets), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _C, (len(sets), bands)).copy()
    for r in range(rows):
        key = mixed(key * _A + parts[:, :, r])
    return key.view(np.int64)


def slices(batches: Iterator, most: int = 256) -> Iterator:
    """Record batches in slices of at most ``most`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of (a, b) whose sets reach the similarity. Each pair moves the set of b once; the centre's set is met in the last join."""
    left = sets.select(F.col("unit").alias("b"), F.col("items").alias("y"))
    right = sets.select(F.col("unit").alias("a"), F.col("items").alias("x"))
    joined = pairs.join(left, "b").join(right, "a")
    both = F.size(F.array_intersect("x", "y"))
    return joined.select("a", "b", both.alias("i"), (F.size("x") + F.size("y") - both).alias("u")).where(F.col("i") * 100 >= F.col("u") * percent).select("a", "b")


#: Sets in a chunk, and items of all of them; a set larger than that is a chunk nearly alone.
CHUNK, ITEMS = 64, 1 << 18
#: Chunks of either side that make a cell.
CELL = 8


def _held(chunk: pa.ListScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A list of (unit, component, items) as arrays: units, components, where each set starts and ends, all items in a row."""
    rows = chunk.values
    items = rows.field("items")
    return rows.field("unit").to_numpy(), rows.field("component").to_numpy(), items.offsets.to_numpy(), items.values.to_numpy().view(np.uint64)


def _crossed(percent: int):
    """Rows of two lists of (unit, component, items) to links between units of different components; one a unit of the left is enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 4):
            out: list[tuple[int, int]] = []
            for left, right in zip(part.column("x"), part.column("y"), strict=True):
                asks, asked, cuts, theirs = _held(left)
                units, parts, ends, flat = _held(right)
                size, starts, flat = np.diff(ends), ends[:-1] - ends[0], flat[ends[0] : ends[-1]]
                for k, unit in enumerate(asks):
                    own = theirs[cuts[k] : cuts[k + 1]]
                    able = (parts != asked[k]) & (units != unit) & (np.minimum(size, len(own)) * 100 >= np.maximum(size, len(own)) * percent)
                    if able.any():
                        at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
                        both = np.add.reduceat(own[at] == flat, starts, dtype=np.int64)
                        hit = np.flatnonzero(able & (both * 100 >= (size + len(own) - both) * percent))
                        _, one = np.unique(parts[hit], return_index=True)
                        out += [(int(unit), int(u)) for u in units[hit[one]]]
            yield pa.RecordBatch.from_arrays([pa.array([min(p) for p in out], pa.int64()), pa.array([max(p) for p in out], pa.int64())], names=["a", "b"])

    return run


def _dealt(rows: DataFrame, sizes: DataFrame, key: str, each: int) -> DataFrame:
    """rows (key, unit, component) with a chunk for each, of the ``many`` of its key: about ``each`` sets and ``ITEMS`` items, whichever is less.

    Only numbers meet by key here, in a join that can be split or broadcast.
    """
    sized = rows.select(key, "unit", "component").join(sizes, "unit")
    many = sized.groupBy(key).agg(F.greatest(F.ceil(F.count(F.lit(1)) / each), F.ceil(F.sum("n") / ITEMS)).alias("many"))
    return staged(sized.join(many, key).select(key, "unit", "component", "many", F.pmod(F.xxhash64("unit"), "many").alias("chunk")), "dealt")


def _met(left: DataFrame, right: DataFrame, sets: DataFrame, key: str, percent: int, same: bool = False) -> DataFrame:
    """Links (a, b) between two dealt tables' sets of one key; ``same``: both are one table, whose pairs of chunks meet once.

    The chunks of a key are cut into strips of ``CELL``, and a strip of either side makes a cell (i, j). Sets are sent to the
    cells of their strip, so a task has bounded cells of a key, never all of it, and a key of one strip is sent once.
    """
    strips = lambda side: side.groupBy(key).agg(F.ceil(F.first("many") / CELL).alias("strips"))
    own, all_ = F.floor(F.col("chunk") / CELL), F.explode(F.sequence(F.lit(0).cast("long"), F.col("strips") - 1))

    def held(side: DataFrame, other: DataFrame, i: Column, j: Column, name: str) -> DataFrame:
        cells = side.join(strips(other), key).select(key, "unit", "component", "chunk", i.alias("i"), j.alias("j"))
        cells = cells.where("i <= j") if same else cells
        rows = cells.join(sets, "unit").repartition(key, "i", "j")
        return rows.groupBy(key, "i", "j", "chunk").agg(F.collect_list(F.struct("unit", "component", "items")).alias(name))

    met = held(left, right, own, all_, "x").join(held(right, left, all_, own, "y").withColumnRenamed("chunk", "other"), [key, "i", "j"])
    met = met.where("chunk <= other") if same else met
    return met.select("x", "y").mapInArrow(_crossed(percent), "a long, b long").distinct()


def link(keyed: DataFrame, units: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int = 80) -> DataFrame:
    """Components of the links between units.

    keyed: (unit long, keys array<long>) and units: (unit, n), one row a distinct set each. sets_of: from a table of units to (unit, items array<long>).
    Returns (unit, component) of the units in a component of two or more.
    """
    dealt = keyed.select(F.explode("keys").alias("key"), "unit")
    shared = dealt.groupBy("key").agg(F.min("unit").alias("centre"), F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = staged(shared.select("key", "centre"), "buckets")
    members = staged(dealt.join(shared, "key"), "members")
    sizes = staged(units.select("unit", "n").join(members.select("unit").distinct(), "unit"), "sizes")
    sets = staged(sets_of(sizes.select("unit")), "sets")

    first = members.where("centre < unit").select(F.col("centre").alias("a"), F.col("unit").alias("b")).distinct()
    of = lambda end: sizes.select(F.col("unit").alias(end), F.col("n").alias(f"n_{end}"))
    first = first.join(of("a"), "a").join(of("b"), "b")
    first = first.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent).select("a", "b")
    parts = connected_components(_verified(first, sets, percent))

    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(parts.withColumnRenamed("node", "unit"), "unit", "left").withColumn("component", F.coalesce("component", "unit"))

    here = staged(placed(members.select("key", "unit")), "placed")
    held = here.groupBy("key", "component").agg(F.count(F.lit(1)).alias("many"))
    largest = held.groupBy("key").agg(F.max(F.struct("many", "component")).alias("top"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    out = here.join(largest.select("key", F.col("top.component").alias("hub")), "key").where("component <> hub")
    out = staged(out, "outside")
    if not out.limit(1).count():
        return parts.withColumnRenamed("node", "unit")
    asks = out.select("unit", "component", "hub").distinct()
    hubs = here.select("unit", "component").distinct().join(out.select(F.col("hub").alias("component")).distinct(), "component", "left_semi").withColumn("hub", F.col("component"))
    met = _met(_dealt(asks, sizes, "hub", CHUNK // 4), _dealt(hubs, sizes, "hub", CHUNK), sets, "hub", percent)
    parts = extended(parts, staged(met, "links"))

    again = placed(out.select("key", "unit", F.col("hub")))
    hub_now = parts.select(F.col("node").alias("hub"), F.col("component").alias("hub_now"))
    again = again.join(hub_now, "hub", "left").withColumn("joined", F.col("component") == F.coalesce("hub_now", "hub"))
    again = staged(again.select("key", "unit", "component", "joined"), "placed")
    open_ = again.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    again = staged(again.join(open_, "key"), "outside")
    rest = _dealt(again.where("not joined"), sizes, "key", CHUNK // 2)
    links = _met(rest, rest, sets, "key", percent, same=True).union(_met(rest, _dealt(again.where("joined"), sizes, "key", CHUNK), sets, "key", percent))
    parts = extended(parts, staged(links.distinct(), "links"))
    return parts.withColumnRenamed("node", "unit")
