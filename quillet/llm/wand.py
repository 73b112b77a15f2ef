"""Ranked lexical search: WAND in each document shard, shard heaps merged.

``LexicalIndex.build`` reads each text once. A task cuts its rows into shards of at most ``DOCS`` documents or ``BYTES`` of text and writes,
for each term of a shard, the document ordinals in order and the term's occurrences there, besides one row with the shard's doc_ids and
lengths. Nothing is shuffled to build it, and a shard is bounded whatever the corpus holds.

``LexicalIndex.search`` takes items in blocks of about ``ITEMS``. The items' terms (never the corpus's) get their weights, their postings meet the
items that ask for them by a join on the term, and each (shard, block) is one group: bounded by a shard and a block. In it:

- a term's maximum impact in the shard is the largest contribution of its postings;
- per item, terms stand in ascending order of maximum impact, and the pivot is the first at which the cumulated maxima reach the
  heap's threshold: documents that hold only terms before the pivot can't enter and are never scored, and the walk jumps to
  the next document of a term from the pivot on. The walk advances by windows of ordinals, so that the pivot's documents are found and scored as arrays;
- candidates get the contributions of the terms before the pivot from the largest down, and leave as soon as what is left can't lift them;
- the shard's best k of each item go out, and a window over these keeps the best k of all.

Score (all 64-bit integers but the weight's logarithm): w = floor(1000 ln((2N + 2) / (2 df + 1))); a document of n of all L terms of N documents
has m = 25 + (75 n N) div L; a term with tf occurrences adds w ((10^9 tf) div (1000 tf + 8 m)), as often as the item repeats it.

Defined results: null texts and texts without a term count nowhere and are never found; items without a term, and terms that no document
holds, find nothing; only scores above 0 are given, fewer than k if there are fewer; ties go to the smaller doc_id, null last; rows that
repeat a doc_id are documents each, and rows that repeat an item_id are items each, ranked apart. Empty tables give empty results.
Columns besides the ids and the texts are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillet.llm.common import new_path, spread, staged
from quillet.llm.lsh import slices
from quillet.llm.terms import terms

#: Documents and bytes of text in a shard at most (one longer text is a shard); items in a block on average; results an item.
DOCS, BYTES, ITEMS, TOP = 16_384, 32 << 20, 256, 10
#: Items' distinct terms that are sent to all executors at most; more are joined by shuffling.
SENT = 200_000
_SEGMENTS = "shard long, term string, docs long, terms long, ordinals binary, counts binary"
#: Stands for a null doc_id.
_NONE = -(2**63)


class _Vocabulary(dict):
    def __missing__(self, term: bytes) -> int:
        n = self[term] = len(self)
        return n


class _Shard:
    """Postings of some documents, as sorted (ordinal, term) keys with their counts."""

    def __init__(self) -> None:
        self.words, self.ids, self.sizes, self.keys, self.counts, self.bytes = _Vocabulary(), [], [], [], [], 0

    def add(self, ids: list[int | None], texts: list[bytes | None]) -> None:
        at, found, owners = len(self.ids), [], []
        for doc_id, text in zip(ids, texts, strict=True):
            words = terms(text)
            if words:
                owners.append((len(self.ids), len(words)))
                found.append(np.fromiter(map(self.words.__getitem__, words), np.int64, len(words)))
                self.ids.append(_NONE if doc_id is None else doc_id)
                self.sizes.append(len(words))
                self.bytes += len(text)
        if len(self.ids) > at:
            ordinal = np.repeat([o for o, _ in owners], [n for _, n in owners])
            key, count = np.unique((ordinal << 32) | np.concatenate(found), return_counts=True)
            self.keys.append(key)
            self.counts.append(count.astype("<i4"))

    def segment(self, shard: int) -> Iterator[pa.RecordBatch]:
        """The row of documents, then a row a term."""
        names = ["shard", "term", "docs", "terms", "ordinals", "counts"]
        if not self.ids:
            return
        one = [[shard], [None], [len(self.ids)], [sum(self.sizes)], [np.array(self.ids, "<i8").tobytes()], [np.array(self.sizes, "<i8").tobytes()]]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(one, kinds, strict=True)], names=names)
        sorted_words = sorted(self.words)
        place = np.empty(len(sorted_words), np.int64)
        place[[self.words[w] for w in sorted_words]] = np.arange(len(sorted_words))
        key, count = np.concatenate(self.keys), np.concatenate(self.counts)
        term = place[key & 0xFFFFFFFF]
        order = np.argsort(term, kind="stable")
        ordinals, count, df = (key[order] >> 32).astype("<i4"), count[order], np.bincount(term, minlength=len(place))
        for lo in range(0, len(df), 20_000):
            some = df[lo : lo + 20_000]
            ends = np.concatenate([[0], np.cumsum(some)])
            on = slice(df[:lo].sum(), df[:lo].sum() + ends[-1])
            cut = lambda v: pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer((ends * 4).astype("<i4").tobytes()), pa.py_buffer(v[on].tobytes())])  # noqa: B023, E731
            occurrences = np.add.reduceat(count[on].astype(np.int64), ends[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), shard)), pa.array([w.decode() for w in sorted_words[lo : lo + 20_000]]), pa.array(some), pa.array(occurrences), cut(ordinals), cut(count)], names=names)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard, now = TaskContext.get().partitionId() << 32, _Shard()
    for part in slices(batches, 64):
        now.add(part.column("doc_id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist())
        if len(now.ids) >= DOCS or now.bytes >= BYTES:
            yield from now.segment(shard)
            shard, now = shard + 1, _Shard()
    yield from now.segment(shard)


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, item_id, block, term, times), a row for each distinct term of an item."""
    for part in slices(batches):
        rows = []
        for item, item_id, block, text in zip(*(part.column(c).to_pylist() for c in ("item", "item_id", "block")), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
            word, times = np.unique(np.array(terms(text), object), return_counts=True)
            rows += [(item, item_id, block, w.decode(), int(n)) for w, n in zip(word, times, strict=True)]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["item", "item_id", "block", "term", "times"])


def best(lists: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ordinals and scores of the k best documents of a shard: WAND over (ordinals, contributions), a pair a term.

    ids: what breaks ties, by ordinal. Only scores above 0 are given.
    """
    lists = sorted((x for x in lists if len(x[0])), key=lambda x: int(x[1].max()))
    reach = np.cumsum([int(c.max()) for _, c in lists])
    at, score = np.empty(0, np.int64), np.empty(0, np.int64)
    least, lo, width = 1, 0, 64
    while lo < len(ids):
        pivot = int(np.searchsorted(reach, least))  # documents with terms before it alone can't enter
        ahead = [(o, c, int(np.searchsorted(o, lo))) for o, c in lists[pivot:]]
        ahead = [x for x in ahead if x[2] < len(x[0])]
        if not ahead:
            break
        lo = min(int(o[s]) for o, _, s in ahead)
        got = np.zeros(width, np.int64)
        for o, c, s in ahead:
            e = int(np.searchsorted(o, lo + width))
            got[o[s:e] - lo] += c[s:e]
        few = np.flatnonzero(got)
        some = got[few]
        for t in range(pivot - 1, -1, -1):
            able = some + reach[t] >= least
            few, some = few[able], some[able]
            if not len(few):
                break
            o, c = lists[t]
            where = np.searchsorted(o, few + lo)
            hit = where < len(o)
            hit[hit] = o[where[hit]] == few[hit] + lo
            some[hit] += c[where[hit]]
        able = some >= least
        at, score = np.concatenate([at, few[able] + lo]), np.concatenate([score, some[able]])
        if len(at) > k:
            order = np.lexsort((ids[at], -score))[:k]
            at, score = at[order], score[order]
        if len(at) == k:
            least = max(1, int(score.min()))  # an equal score may still win by its id
        lo, width = lo + width, min(4096, 2 * width)
    return at, score


def _search(documents: int, length: int, k: int):
    def run(group: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int | None, int]] = []
        rows = group.to_pylist()
        own = next(r for r in rows if r["term"] is None)
        ids, sizes = np.frombuffer(own["ordinals"], "<i8"), np.frombuffer(own["counts"], "<i8")
        ties = np.where(ids == _NONE, np.iinfo(np.int64).max, ids)
        m = 25 + (75 * sizes * documents) // max(1, length)
        lists: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        for r in rows:
            if r["term"] is not None:
                at, tf = np.frombuffer(r["ordinals"], "<i4"), np.frombuffer(r["counts"], "<i4").astype(np.int64)
                adds = r["w"] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[at]))
                for a in r["asks"]:
                    lists.setdefault((a["item"], a["item_id"]), []).append((at, adds if a["times"] == 1 else adds * a["times"]))
        for (item, item_id), x in lists.items():
            at, score = best(x, ties, k)
            found += [(item, item_id, None if i == _NONE else i, s) for i, s in zip(ids[at].tolist(), score.tolist(), strict=True)]
        columns = list(zip(*found, strict=True)) or [()] * 4
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item", "item_id", "doc_id", "score"])

    return run


class LexicalIndex:
    """Segments of document shards at a path; a corpus is indexed once and searched often."""

    def __init__(self, spark: SparkSession, path: str):
        self.segments = spark.read.schema(_SEGMENTS).parquet(path)

    @classmethod
    def build(cls, docs: DataFrame, path: str | None = None) -> LexicalIndex:
        spark = docs.sparkSession
        path = path or new_path(spark, "lexical-index")
        bare = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        bare.mapInArrow(_segments, _SEGMENTS).write.option("compression", "zstd").parquet(path)
        return cls(spark, path)

    def search(self, items: DataFrame, k: int = TOP) -> DataFrame:
        """(item_id, rank, doc_id, score) of each row of ``items`` (item_id, text)."""
        bare = items.select(F.col("item_id").cast("long").alias("item_id"), "text").withColumn("item", F.monotonically_increasing_id())
        bare = staged(bare, "items")
        blocks = spread(bare.count(), ITEMS)
        placed = bare.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
        asked = staged(placed.mapInArrow(_asked, "item long, item_id long, block long, term string, times long"), "asked")
        shards, postings = self.segments.where("term is null"), self.segments.where("term is not null")
        documents, length = shards.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()

        wanted = asked.groupBy("block", "term").agg(F.collect_list(F.struct("item", "item_id", "times")).alias("asks"))  # at most a block's items
        names = staged(asked.select("term").distinct(), "terms")
        few = names.count() <= SENT
        sent = F.broadcast if few else lambda df: df
        df = postings.select("term", "docs").join(sent(names), "term").groupBy("term").agg(F.sum("docs").alias("df"))
        weight = F.floor(1000 * F.log((2.0 * documents + 2) / (2.0 * F.col("df") + 1)))
        wanted = staged(wanted.join(df.select("term", weight.alias("w")), "term"), "wanted")
        met = postings.join(sent(wanted) if few else wanted, "term").select("shard", "block", "term", "ordinals", "counts", "w", "asks")
        own = shards.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), "term", "ordinals", "counts")
        groups = met.unionByName(own, allowMissingColumns=True).groupBy("shard", "block")
        heaps = groups.applyInArrow(_search(documents, length, k), "item long, item_id long, doc_id long, score long")
        place = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        return heaps.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best of all ``docs`` for each of ``items``."""
    return LexicalIndex.build(docs).search(items, k)
