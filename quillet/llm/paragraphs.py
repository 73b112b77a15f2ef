"""Substring deduplication by paragraph MinHash banding.

A paragraph is what stands between line ends; those of at least ``LEAST`` words take part. Equal paragraphs are one unit, counted
map-side; signatures of units are banded (16 bands of 3 places: a pair of similarity 0.8 is missed with probability
1e-5), colliding ones are verified by exact Jaccard similarity of their word shingles and clustered by connected components. In each
cluster the first paragraph, by doc_id and place, stays; the others are removed.

A passage is a run of words, wherever it starts and across line ends, that stands elsewhere too (A-Z lower-cased, any blanks between). Runs of
``GRAM`` words are sampled by winnowing, so that each ``PASSAGE`` words in a row hold a sampled one and equal words the same; runs that are met
twice are units of their own. Of the places of a run the first, by doc_id and place, stays; runs that follow each other within ``GRAM`` words at one
distance from one text's first places, or at any in the text itself, are one result. So every repeated passage of ``PASSAGE`` words or more is found, and what is reported is repeated
word for word; up to ``PASSAGE - GRAM`` words at either end of it may lie outside the result, and repeated runs of ``GRAM`` words and more
are reported where they are sampled. Altered copies are found as paragraphs.

Texts are read twice: once for signatures of paragraphs and sampled runs, once for the full sets of paragraphs that share a bucket. The second time
only texts that hold such are chosen, by place, and meet their paragraphs in a shuffle; other texts never move. Signatures are read from their table
for one row of each unit, chosen by number, and don't move either: only hashes, numbers and places do.

Defined results: null and empty texts have no paragraph; an empty table gives an empty result; copies inside a document are
found too; rows that repeat a doc_id or have none are told apart by place, those without one last; positions are code points. A passage's paragraph is
the number of the line it starts in, its cluster_size the most places that a run of it has; it may overlap others and whole paragraphs. Further columns, whatever
their names, are kept by ``cleaned`` and ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillet.llm.common import staged
from quillet.llm.lsh import band_keys, link, mixed, shingles, shingle_set, slices, word_hashes
from quillet.llm.places import Places, fresh, numbered

LEAST, BANDS, ROWS = 20, 16, 3
PASSAGE, GRAM = 50, 26

_POWER = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_POWER), -1, 1 << 64))
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_MARKED = "text_no long, doc_id long, file long, at long, first_unit long, paragraphs array<struct<paragraph:int,start:int,length:int,n:int,same:binary,keys:array<long>>>, runs array<struct<word:int,start:int,end:int,paragraph:int,run:long>>"


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n words in a row."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    power = np.full(len(h), _POWER)
    power[0] = 1
    back = np.full(len(h), _BACK)
    back[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * np.cumprod(power), dtype=np.uint64)])
    return mixed((sums[n:] - sums[:-n]) * np.cumprod(back)[: len(h) - n + 1])


def _sliding(f, x: np.ndarray, n: int) -> np.ndarray:
    """f (minimum or maximum) of each n in a row."""
    k = 1
    while 2 * k <= n:
        x, k = f(x[:-k], x[k:]), 2 * k
    return f(x[: len(x) - (n - k)], x[n - k :]) if n > k else x


def sampled(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the sampled runs of ``GRAM`` words: the least of those in some ``PASSAGE`` words in a row."""
    if len(h) < PASSAGE:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    wide, x = PASSAGE - GRAM + 1, runs(h, GRAM)
    edge = np.zeros(wide - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.maximum, np.concatenate([edge, _sliding(np.minimum, x, wide), edge]), wide) == x)
    return at, x[at]


class _Text:
    """A text's words: their hashes, where they start and end in code points, and in which line."""

    def __init__(self, text: str):
        data = text.encode()
        self.hashes = word_hashes(data)
        raw = np.frombuffer(data, np.uint8)
        inside = np.concatenate([[False], ~_BLANK[raw], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        ends_of_lines = np.flatnonzero(raw == 0x0A)
        self.line_of = np.searchsorted(ends_of_lines, edges[0::2])
        if len(data) != len(text):
            chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            edges, ends_of_lines = chars[edges], chars[ends_of_lines]
        self.start, self.end = edges[0::2], edges[1::2]
        self.lines = np.concatenate([[0], ends_of_lines + 1]), np.append(ends_of_lines, len(text))

    def paragraphs(self, least: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(number, start, length, word hashes) of lines with enough words."""
        first = np.searchsorted(self.line_of, np.arange(len(self.lines[0]) + 1))
        for k in np.flatnonzero(np.diff(first) >= least):
            yield int(k), int(self.lines[0][k]), int(self.lines[1][k] - self.lines[0][k]), self.hashes[first[k] : first[k + 1]]


def _marked(words: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        texts = units = TaskContext.get().partitionId() << 40
        for part in slices(batches, 64):
            lines, sets, samples, first = [], [], [], []
            for text in part.column("text").to_pylist():
                t = _Text(text)
                rows = []
                first.append(units)
                for k, start, length, h in t.paragraphs(least):
                    s = shingles(h, words)
                    rows.append({"paragraph": k, "start": start, "length": length, "n": len(s), "same": xxhash.xxh3_128_digest(s.tobytes())})
                    sets.append(s)
                units += len(rows)
                lines.append(rows)
                at, run_ = sampled(t.hashes)
                samples.append((at, t.start[at], t.end[at + GRAM - 1] if len(at) else at, t.line_of[at], run_.view(np.int64)))
            keys = iter(band_keys(sets, BANDS, ROWS)) if sets else iter(())
            for rows in lines:
                for r in rows:
                    r["keys"] = next(keys)
            sizes = np.cumsum([0] + [len(s[0]) for s in samples])
            flat = [np.concatenate(c) if samples else np.empty(0, np.int64) for c in zip(*samples, strict=True)]
            inner = pa.StructArray.from_arrays([*(pa.array(c, pa.int32()) for c in flat[:4]), pa.array(flat[4], pa.int64())], names=["word", "start", "end", "paragraph", "run"])
            texts_here = pa.array(range(texts, texts + part.num_rows), pa.int64())
            texts += part.num_rows
            kind = pa.list_(pa.struct([("paragraph", pa.int32()), ("start", pa.int32()), ("length", pa.int32()), ("n", pa.int32()), ("same", pa.binary()), ("keys", pa.list_(pa.int64()))]))
            yield pa.RecordBatch.from_arrays(
                [texts_here, *(part.column(c) for c in ("doc_id", "file", "at")), pa.array(first, pa.int64()), pa.array(lines, kind), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), inner)],
                names=["text_no", "doc_id", "file", "at", "first_unit", "paragraphs", "runs"],
            )

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            units, items = [], []
            for wanted, text in zip(part.column("wanted").to_pylist(), part.column("text").to_pylist(), strict=True):
                lines = text.split("\n")
                for w in wanted:
                    units.append(w["unit"])
                    items.append(shingle_set(lines[w["paragraph"]].encode(), words).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(units, pa.int64()), pa.array(items, pa.list_(pa.int64()))], names=["unit", "items"])

    return run


def _similar(placed: Places, marked: DataFrame, words: int, percent: int) -> DataFrame:
    """Rows for whole paragraphs."""
    each = marked.select("text_no", "doc_id", "file", "at", "first_unit", F.posexplode("paragraphs").alias("k", "p"))
    each = each.select((F.col("first_unit") + F.col("k")).alias("unit"), "text_no", "doc_id", "file", "at", "p.*")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "unit", "paragraph", "file", "at", "n")
    firsts = staged(each.groupBy("same").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("many")), "paragraph-units")
    units = firsts.select(F.col("first.unit").alias("unit"), F.col("first.n").alias("n"), "same", "many", "first")
    # signatures stay where they were written: of each unit the first paragraph's row is read, by number
    keyed = numbered(each.select("unit", "keys"), "unit", units.select("unit"))

    def sets_of(wanted: DataFrame) -> DataFrame:
        spots = units.join(wanted, "unit", "left_semi").select("unit", "first.file", "first.at", "first.paragraph")
        spots = staged(spots.groupBy("file", "at").agg(F.collect_list(F.struct("unit", "paragraph")).alias("wanted")), "paragraph-spots")
        texts = placed.only(spots.select("file", "at"), places=True).select(F.col(placed.file).alias("file"), F.col(placed.at).alias("at"), "text")
        return texts.join(spots, ["file", "at"]).select("wanted", "text").mapInArrow(_sets(words), "unit long, items array<long>")

    parts = link(keyed, units.select("unit", "n"), sets_of, percent)
    named = units.select("same", "unit", "many", "first").join(parts, "unit", "left").withColumn("component", F.coalesce("component", "unit"))
    heads = named.groupBy("component").agg(F.min("first").alias("head"), F.sum("many").alias("cluster_size")).where("cluster_size > 1")
    heads = staged(heads, "paragraph-heads")  # a join of plain rows can split a large component
    named = staged(named.select("same", "component").join(heads, "component").select("same", "head", "cluster_size"), "paragraph-named")
    rows = each.select("doc_id", "file", "at", "paragraph", "start", "length", "unit", "same").join(named, "same")
    removed = F.col("unit") != F.col("head.unit")
    return rows.select("doc_id", "file", "at", "paragraph", "start", "length", F.col("head.doc_id").alias("keep_doc_id"), F.col("head.paragraph").alias("keep_paragraph"), "cluster_size", removed.alias("removed"))


def _repeated(marked: DataFrame) -> DataFrame:
    """Rows for passages."""
    each = marked.select("text_no", "doc_id", "file", "at", F.explode("runs").alias("r"))
    each = each.select("r.run", "text_no", "r.word", "doc_id", "file", "at", "r.start", "r.end", "r.paragraph")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_no", "word", "paragraph")
    twice = each.groupBy("run").agg(F.count(F.lit(1)).alias("many"), F.min(place).alias("head")).where("many > 1")
    met = each.join(staged(twice, "runs-repeated"), "run").withColumn("shift", F.col("word") - F.col("head.word"))
    within = F.col("text_no") == F.col("head.text_no")  # what a text repeats of itself is one result at any distance, as it repeats in turns
    met = met.withColumn("kind", F.struct("head.text_no", F.when(within, (F.col("shift") != 0).cast("long")).otherwise(F.col("shift")).alias("by")))
    by_text = Window.partitionBy("text_no").orderBy("word")
    gap = F.col("word") - F.lag("word").over(by_text)
    other = ~F.col("kind").eqNullSafe(F.lag("kind").over(by_text)) | (gap > GRAM)
    met = met.withColumn("chain", F.sum(F.coalesce(other, F.lit(True)).cast("int")).over(by_text.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min(F.struct("word", "paragraph", "head", "shift")).alias("first")
    rows = met.groupBy("text_no", "chain").agg(F.first("doc_id").alias("doc_id"), F.first("file").alias("file"), F.first("at").alias("at"), first, F.min("start").alias("start"), F.max("end").alias("end"), F.max("many").alias("cluster_size"))
    removed = (F.col("text_no") != F.col("first.head.text_no")) | (F.col("first.shift") != 0)
    return rows.select("doc_id", "file", "at", "first.paragraph", "start", (F.col("end") - F.col("start")).alias("length"), F.col("first.head.doc_id").alias("keep_doc_id"), F.col("first.head.paragraph").alias("keep_paragraph"), "cluster_size", removed.alias("removed"))


def _found(placed: Places, words: int, percent: int, least: int) -> DataFrame:
    bare = placed.bare(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).where(F.col("text").isNotNull())
    marked = staged(bare.mapInArrow(_marked(words, least), _MARKED), "paragraphs")
    similar = _similar(placed, marked, words, percent).withColumn("whole", F.lit(True))
    return similar.unionByName(_repeated(marked).withColumn("whole", F.lit(False)))


def clusters(docs: DataFrame, words: int = 5, percent: int = 80, least: int = LEAST) -> DataFrame:
    """One row a paragraph or passage that another one repeats: doc_id, paragraph, start, length, keep_doc_id, keep_paragraph, cluster_size, removed, whole (a paragraph)."""
    return _found(Places(docs), words, percent, least).drop("file", "at")


@F.udf(T.StringType())
def _without(text, gone):
    """``text`` without spans (start, end, whole); a whole paragraph goes with its line end, the last ones with the one before."""
    last = len(text)
    for a, b, whole in sorted(gone, reverse=True):
        last = a - 1 if whole and b == last else last
    spans = [(a, b + whole) for a, b, whole in gone] + [(max(last, 0), len(text))]
    out, at = [], 0
    for a, b in sorted(spans):
        out.append(text[at : max(at, a)])
        at = max(at, b)
    return "".join(out)


def cleaned(docs: DataFrame, words: int = 5, percent: int = 80, least: int = LEAST) -> DataFrame:
    """``docs`` without removed paragraphs and passages; texts that lose none are untouched, and not moved."""
    placed = Places(docs)
    span = F.struct("start", (F.col("start") + F.col("length")).alias("end"), "whole")
    gone = _found(placed, words, percent, least).where("removed").groupBy("file", "at").agg(F.collect_set(span).alias("gone"))
    name = fresh(docs.columns, "place_gone")
    gone = staged(gone.select(F.col("file").alias(placed.file), F.col("at").alias(placed.at), F.col("gone").alias(name)), "paragraphs-gone")
    keys = gone.select(F.col(placed.file).alias("file"), F.col(placed.at).alias("at"))
    cut = placed.only(keys, places=True).join(gone, [placed.file, placed.at])
    cut = cut.select(*[_without("text", name).alias("text") if c == "text" else F.col(f"`{c}`") for c in placed.columns])
    return placed.only(keys, others=True).unionAll(cut)
