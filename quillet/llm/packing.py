"""Lexical retrieval packing: sequences filled with each seed's nearest unused documents by BM25.

A document's ids, with an end id, are cut into whole windows, which are sequences of their own, and a tail
shorter than a window. Tails are dealt by range of two min-hashes of their ids, so that documents of like words come to
the same partition and a hot group is cut by doc_id into as many as it needs. In a partition, shards of ``SHARD``
tails have an inverted index of BM25 weights each. The first unused tail of a shard is the seed of a window; the index returns
unused neighbours by score and they fill it; the one that overflows is cut, and what is left of it is the next seed. An open window is carried into
the next shard. The last one of a partition is cut into sequences whose lengths are powers of two, which need no
padding, so no sequence is padded at all.

Memory: one shard of tails and its index, under 30 MB; no id is shuffled but those of tails, in two bytes each.
Scores never decide whether an id is packed, only beside which: all ids lie in exactly one piece.

Defined results: null text is empty and still has its end id; repeated rows are packed each; an empty table gives an empty
result; columns besides doc_id and text are ignored. The order in a partition is fixed by (min-hashes, doc_id, crc), so a lost
partition is packed again alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.llm.common import shuffle_partitions, spread, staged
from quillet.llm.lsh import mixed, slices
from quillet.llm.tokens import encoder

WINDOW, SHARD, EACH = 2048, 384, 16_384
K1, B = 1.2, 0.75
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [p.split()[0] for p in PIECES.split(", ")]


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _cut(path: str, end_id: int, window: int, words: int):
    """Texts to (doc_id, tokens, crcs of whole windows, tail, two min-hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, most=words)
        first = mixed(np.arange(enc.tokenizer.get_vocab_size(), dtype=np.uint64) + np.uint64(1))  # each id is hashed once, not each of its uses
        second = mixed(first + np.uint64(7)) >> np.uint64(1)
        first >>= np.uint64(1)
        for part in slices(batches):
            n, crcs, tails, one, two = [], [], [], [], []
            for text in part.column("text").to_pylist():
                ids = np.append(np.frombuffer(enc.encode(text or ""), enc.dtype), np.asarray([end_id], enc.dtype))
                whole = len(ids) // window
                n.append(len(ids))
                crcs.append([_crc(ids[k * window : (k + 1) * window]) for k in range(whole)])
                tail = ids[whole * window :]
                tails.append(tail.astype("<u4" if enc.dtype.itemsize > 2 else "<u2").tobytes())
                one.append(int(first[tail].min()) if len(tail) else 0)
                two.append(int(second[tail].min()) if len(tail) else 0)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(tails, pa.binary()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array([enc.dtype.itemsize] * len(n), pa.int64())],
                names=["doc_id", "n", "crcs", "tail", "one", "two", "width"],
            )

    return run


class _Index:
    """Inverted index of BM25 weights over one shard's tails."""

    def __init__(self, tails: list[np.ndarray]):
        each = [np.unique(t, return_counts=True) for t in tails]
        self.own = [t for t, _ in each]
        size = np.array([len(t) for t in tails], np.float32)
        sizes = [len(t) for t, _ in each]
        doc = np.repeat(np.arange(len(tails)), sizes)
        term = np.concatenate([t for t, _ in each])
        tf = np.concatenate([c for _, c in each]).astype(np.float32)
        order = np.argsort(term, kind="stable")
        self.terms, starts = np.unique(term[order], return_index=True)
        self.start, self.end = starts, np.append(starts[1:], len(term))
        df = (self.end - self.start).astype(np.float32)
        idf = np.log1p((len(tails) - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * size / max(1.0, float(size.mean())))
        self.doc = doc[order]
        self.weight = np.repeat(idf, self.end - self.start) * tf[order] * (K1 + 1) / (tf[order] + norm[self.doc])
        self.many = len(tails)

    def scores(self, terms: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        at = at[self.terms[at] == terms]
        start, size = self.start[at], self.end[at] - self.start[at]
        total = int(size.sum())
        if not total:
            return np.zeros(self.many)
        spot = np.arange(total) + np.repeat(start - (np.cumsum(size) - size), size)
        return np.bincount(self.doc[spot], self.weight[spot], self.many)


class _Packer:
    """Fills windows and gives out pieces; sequences count up from ``first``."""

    def __init__(self, first: int, window: int):
        self.window, self.next, self.rows = window, first, []
        self.open: list[tuple] = []  # (doc_id, n, start in the document, ids)
        self.filled, self.seed = 0, None

    def whole(self, doc_id: int, n: int, crcs: list[int]) -> None:
        for k, crc in enumerate(crcs):
            self.rows.append((doc_id, k * self.window, self.window, crc, n, self.next, 0))
            self.next += 1

    def _close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc_id, n, start, ids in pieces:
            self.rows.append((doc_id, start, len(ids), _crc(ids), n, self.next, at))
            at += len(ids)
        self.next += 1

    def put(self, doc_id: int, n: int, start: int, ids: np.ndarray) -> bool:
        """Adds a tail; true if the window closed and a cut tail (or nothing) begins the next."""
        closed = False
        while len(ids):
            room = self.window - self.filled
            self.open.append((doc_id, n, start, ids[:room]))
            self.filled += len(ids[:room])
            start, ids = start + len(ids[:room]), ids[room:]
            if self.filled == self.window:
                self._close(self.open)
                self.open, self.filled, closed = [], 0, True
        return closed

    def shard(self, tails: list[tuple]) -> None:
        """tails: (doc_id, n, start, ids)."""
        index = _Index([t[3] for t in tails])
        free = np.ones(len(tails), bool)
        first = 0
        while True:
            if not self.open:
                while first < len(tails) and not free[first]:
                    first += 1
                if first == len(tails):
                    return
                free[first] = False
                self.seed = index.own[first]
                if self.put(*tails[first]):
                    continue
            score = np.where(free, index.scores(self.seed), -1.0)
            for d in np.argsort(-score, kind="stable"):
                if not free[d]:
                    return  # every tail of the shard is used; the window stays open
                free[d] = False
                if self.put(*tails[d]):
                    self.seed = index.own[d] if self.open else None
                    break
            else:
                return

    def finish(self) -> None:
        left = self.filled
        pieces = self.open
        while left:
            size = 1 << (left.bit_length() - 1)
            took, rest, room = [], [], size
            for doc_id, n, start, ids in pieces:
                if room:
                    took.append((doc_id, n, start, ids[:room]))
                if len(ids) > room:
                    rest.append((doc_id, n, start + room, ids[room:]))
                room = max(0, room - len(ids))
            self._close(took)
            pieces, left = rest, left - size
        self.open, self.filled = [], 0

    def given(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * len(_NAMES)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=_NAMES)


def _pack(window: int, shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer, tails = _Packer(TaskContext.get().partitionId() << 40, window), []
        for part in slices(batches):
            for doc_id, n, crcs, tail, width in zip(*(part.column(c).to_pylist() for c in ("doc_id", "n", "crcs", "tail", "width")), strict=True):
                packer.whole(doc_id, n, crcs)
                if tail:
                    tails.append((doc_id, n, len(crcs) * window, np.frombuffer(tail, f"<u{width}")))
                if len(tails) == shard:
                    packer.shard(tails)
                    tails = []
            if len(packer.rows) > 4096:
                yield packer.given()
        if tails:
            packer.shard(tails)
        packer.finish()
        yield packer.given()

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW, shard: int = SHARD, words: int = 400_000) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. words: a generation of the encoder's cache."""
    bare = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cut = staged(bare.mapInArrow(_cut(tokenizer, end_id, window, words), "doc_id long, n long, crcs array<long>, tail binary, one long, two long, width long"), "tails")
    parts = min(spread(cut.count(), EACH), 1 << 20)
    parts = max(parts, min(shuffle_partitions(docs.sparkSession), spread(cut.count(), 2048)))
    dealt = cut.repartitionByRange(parts, "one", "two", "doc_id").sortWithinPartitions("one", "two", "doc_id", F.crc32("tail"))
    return dealt.mapInArrow(_pack(window, shard), PIECES)
