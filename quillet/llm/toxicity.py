"""Toxic spans by a linear-chain conditional random field; its marginals aggregate to document scores and offsets.

Only documents are labelled, so tokens get their labels first, then the field learns from them:

1. Of either label at most ``FIT`` documents, chosen by hash of doc_id, are the sample. Each whole text gives its distinct words and prefixes
   once; summed by label they have an evidence: the log ratio of their shares in toxic and clean documents, less its standard error.
2. In a toxic document the tokens whose evidence is nearly the document's best (or strong by itself) are tagged B, or I after another; all other
   tokens of it, and all of clean documents, are O. Windows around tagged tokens and ``CALM`` windows elsewhere, chosen by hash, go to the driver.
3. The field has three states (O, B, I), learned transitions and hashed features of a token (word, prefixes, suffixes, shape, length) and of its
   neighbours; the gradient is that of the exact likelihood, by forward-backward.
4. A document's highest marginal and the sum of its marginals are the two inputs of a logistic map to its score, fitted on the sample
   with the labels' own frequencies.

Scoring is one scan without a shuffle: a slice's tokens stand in one chain that starts anew at each document, and forward and backward vectors are
found for equal pieces of the chain side by side, from the products of their transfer matrices; a text is never cut.
The model is ``WIDTH`` numbers a state, whatever the corpus.

Defined results: null texts and texts without a letter have no token and score as having marginal 0; repeated rows score alike; rows with
a null doc_id or no label teach nothing and are scored; of labels that repeat a doc_id the largest counts; without labels of both kinds all
scores are 0; empty tables give empty results. Columns besides doc_id and text (and the label, in training) are never looked at.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.llm.common import staged
from quillet.llm.lsh import slices

#: Documents of either label to fit on at most (the hash takes a few more or less); hashed features; affixes kept as evidence; words a process keeps.
FIT, WIDTH, AFFIXES, CACHE = 3_000, 1 << 16, 50_000, 200_000
#: Evidence that counts by itself, the least that counts at all, how far from a document's best; tokens around a tagged one, windows elsewhere.
STRONG, FLOOR, NEAR, AROUND, CALM = 4.0, 0.5, 0.5, 4, 4
#: Marginal from which a token belongs to a span.
SURE = 0.5
O, B, I = range(3)  # noqa: E741
_LETTERS = re.compile(r"[^\W\d_]+")
#: Marginals of 0 and 1 count as these.
_LEAST = 1e-4


def affixes(word: str) -> list[str]:
    """A word, in lower case, and its prefixes of 3 to 6 letters."""
    low = word.lower()
    return [f"={low[:40]}", *(low[:n] for n in range(3, min(6, len(low)) + 1))]


#: Salts of a token's own features: bias, shape, length, word, prefixes of 2 to 6 letters, suffixes of 3 and 4; then those for its neighbours.
_SALTS = np.arange(1, 14, dtype=np.int64)


def token_features(words: list[str], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each word [word, feature]; its feature for the token after it; its feature for the token before it. ``width`` stands for none."""
    rows = []
    for word in words:
        low = word.lower()
        n = len(low)
        rows.append((
            0, 2 if word.isupper() else word[:1].isupper(), min(n, 12), zlib.crc32(low.encode()), zlib.crc32(low[:2].encode()) if n > 1 else -1,
            zlib.crc32(low[:3].encode()) if n > 2 else -1, zlib.crc32(low[:4].encode()) if n > 3 else -1, zlib.crc32(low[:5].encode()) if n > 4 else -1,
            zlib.crc32(low[:6].encode()) if n > 5 else -1, zlib.crc32(low[-3:].encode()) if n > 2 else -1, zlib.crc32(low[-4:].encode()) if n > 3 else -1,
        ))
    code = np.array(rows, np.int64).reshape(-1, 11)
    place = lambda c, salt: ((((c + salt * 0x9E3779B1) & 0xFFFFFFFF) * 0x85EBCA6B) >> 9 & 0xFFFFFFFF) % width
    own = np.where(code < 0, width, place(code, _SALTS[:11]))
    return own, place(code[:, 3], _SALTS[11]), place(code[:, 3], _SALTS[12])


class Field:
    """Weights [state, feature], transitions [from, to] and starts: log potentials of the chain."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray, starts: np.ndarray):
        self.weights, self.moves, self.starts = weights, moves, starts

    @classmethod
    def blank(cls, width: int = WIDTH) -> Field:
        moves, starts = np.zeros((3, 3)), np.zeros(3)
        moves[O, I] = starts[I] = -30.0  # a span begins with B
        return cls(np.zeros((3, width + 1)), moves, starts)  # the last feature stands for none

    def rows(self, words: list[str]) -> np.ndarray:
        """Log potentials by state that each token gives itself, the token after it and the token before it: 9 numbers a word."""
        own, after, before = token_features(words, self.weights.shape[1] - 1)
        return np.concatenate([self.weights[:, own].sum(2), self.weights[:, after], self.weights[:, before]]).T

    def marginals(self, logs: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a chain with log potentials [token, state] that starts anew where ``first``: the states' marginals, normalised forward vectors and backward vectors.

        The chain is cut into pieces of equal length; the pieces' transfer matrices give the vectors at their ends, then all pieces run side by side.
        """
        n = len(logs)
        long = max(1, math.isqrt(n))
        wide = -(-n // long)
        own = np.ones((wide * long, 3))
        own[:n] = np.exp(logs - logs.max(1, keepdims=True))
        new = np.ones(wide * long, bool)
        new[:n] = first
        own, new = own.reshape(wide, long, 3).transpose(1, 0, 2).copy(), new.reshape(wide, long).T.copy()[:, :, None]
        step, start = np.exp(self.moves), np.exp(self.starts)
        whole = np.broadcast_to(np.eye(3), (wide, 3, 3)).copy()
        for t in range(long):
            moved = (whole.reshape(-1, 3) @ step).reshape(wide, 3, 3)
            whole = np.where(new[t][:, None], whole.sum(2, keepdims=True) * start, moved) * own[t][:, None, :]
            whole /= whole.sum((1, 2), keepdims=True)
        ahead, back = np.empty((wide, 3)), np.empty((wide, 3))
        a = b = np.full(3, 1 / 3)
        for j in range(wide):
            ahead[j] = a
            a = a @ whole[j]
            a /= a.sum()
        for j in range(wide - 1, -1, -1):
            back[j] = b
            b = whole[j] @ b
            b /= b.sum()
        forward, backward = np.empty_like(own), np.empty_like(own)
        a, b = ahead, back
        for t in range(long):
            a = np.where(new[t], start, a @ step) * own[t]
            a /= a.sum(1, keepdims=True)
            forward[t] = a
        for t in range(long - 1, -1, -1):
            backward[t] = b
            b = np.where(new[t], ((own[t] * b) @ start)[:, None], (own[t] * b) @ step.T)
            b /= b.sum(1, keepdims=True)
        flat = lambda x: x.transpose(1, 0, 2).reshape(-1, 3)[:n]
        forward, backward = flat(forward), flat(backward)
        both = forward * backward
        return both / both.sum(1, keepdims=True), forward, backward

    @classmethod
    def fit(cls, windows: list[tuple[list[str], list[int]]], width: int = WIDTH, rounds: int = 40, rate: float = 0.4, decay: float = 2e-5) -> Field:
        """By AdaGrad on the exact gradient over all windows (tokens, states)."""
        field = cls.blank(width)
        if not windows:
            return field
        words: dict[str, int] = {}
        ids = np.array([words.setdefault(w, len(words)) for tokens, _ in windows for w in tokens])
        gold = np.array([s for _, states in windows for s in states])
        first = np.zeros(len(ids), bool)
        first[np.cumsum([0] + [len(t) for t, _ in windows[:-1]])] = True
        own, after, before = token_features(list(words), width)
        flat, many = own.ravel(), own.shape[1]
        n, inner = len(ids), np.flatnonzero(~first)
        target = np.eye(3)[gold]
        squares = [np.full_like(x, 1e-6) for x in (field.weights, field.moves, field.starts)]
        for _ in range(rounds):
            logs = field.weights[:, own].sum(2).T[ids]
            logs[inner] += field.weights[:, after[ids[inner - 1]]].T
            logs[inner - 1] += field.weights[:, before[ids[inner]]].T
            p, forward, backward = field.marginals(logs, first)
            off = (p - target) / n
            by = lambda at, x, m: np.stack([np.bincount(at, x[:, s], m) for s in range(3)], 1)
            grad = by(flat, np.repeat(by(ids, off, len(words)), many, 0), width + 1).T
            grad += by(after[ids[inner - 1]], off[inner], width + 1).T + by(before[ids[inner]], off[inner - 1], width + 1).T
            grad[:, width] = 0
            scaled = np.exp(logs[inner] - logs[inner].max(1, keepdims=True)) * backward[inner]
            pair = forward[inner - 1][:, :, None] * np.exp(field.moves) * scaled[:, None, :]
            pair /= pair.sum((1, 2), keepdims=True)
            seen = np.bincount(gold[inner - 1] * 3 + gold[inner], minlength=9).reshape(3, 3)
            grads = [grad, (pair.sum(0) - seen) / n, off[first].sum(0)]
            for x, g, g2 in zip((field.weights, field.moves, field.starts), grads, squares, strict=True):
                g = g + decay * x * (np.abs(x) < 29)
                g2 += g * g
                x -= rate * g / np.sqrt(g2)
            field.moves[O, I] = field.starts[I] = -30.0
        return field


class Tagger:
    """Marginals of whole texts; potentials of words are kept while there is room."""

    def __init__(self, field: Field):
        self.field, self.known, self.table = field, {}, np.empty((1024, 9))

    def _ids(self, words: list[list[str]]) -> np.ndarray:
        new = {w for found in words for w in found}.difference(self.known)
        if new:
            at = len(self.known)
            if at + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.empty((max(len(self.table), len(new)), 9))])
            self.table[at : at + len(new)] = self.field.rows(list(new))
            self.known.update(zip(new, range(at, at + len(new)), strict=True))
        return np.array([i for found in words for i in map(self.known.__getitem__, found)], np.int64)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of being inside a span, of the tokens of all texts one after another, and how many tokens each text has."""
        if len(self.known) > CACHE:
            self.known.clear()
        found = [_LETTERS.findall(t) if t else [] for t in texts]
        size = np.array([len(f) for f in found], np.int64)
        ids = self._ids(found)
        if not len(ids):
            return np.empty(0), size
        first = np.zeros(len(ids), bool)
        first[(np.cumsum(size) - size)[size > 0]] = True
        inner = np.flatnonzero(~first)
        logs = self.table[ids, :3]
        logs[inner] += self.table[ids[inner - 1], 3:6]
        logs[inner - 1] += self.table[ids[inner], 6:]
        return 1 - self.field.marginals(logs, first)[0][:, O], size


def summed(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The inputs of a document's score: log odds of its highest marginal, log of 1 + the sum of those from 0.05 up."""
    owner = np.repeat(np.arange(len(size)), size)
    top = np.zeros(len(size))
    np.maximum.at(top, owner, p)
    top = np.clip(top, _LEAST, 1 - _LEAST)
    return np.stack([np.log(top / (1 - top)), np.log1p(np.bincount(owner, p * (p >= 0.05), len(size)))], 1)


def calibrated(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Bias and slopes of a logistic map, drawn towards (0, 1, 0) where labels are few; by Newton steps."""
    prior = np.array([0.0, 1.0, 0.0])
    at, z = prior.copy(), np.concatenate([np.ones((len(x), 1)), x], 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ at, -30, 30)))
        grad = z.T @ (weight * (p - y)) + (at - prior)
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.eye(3), grad)
        at = at - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return at


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(affix, toxic, docs), summed in a task while there is room."""
    found: Counter[tuple[str, int]] = Counter()

    def given() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.int32()), pa.array(list(found.values()), pa.int64())], names=["affix", "toxic", "docs"])
        found.clear()
        return out

    for part in slices(batches, 64):
        for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), strict=True):
            found.update((a, toxic) for a in {a for w in set(_LETTERS.findall(text or "")) for a in affixes(w)})
        if len(found) > 300_000:
            yield given()
    yield given()


def tagged(words: list[str], evidence: dict[str, float]) -> list[int]:
    """States of a toxic document's tokens."""
    own = [max(evidence.get(a, 0.0) for a in affixes(w)) for w in words]
    least = min(STRONG, max(FLOOR, max(own, default=0.0) - NEAR))
    hit = [e >= least for e in own]
    return [O if not h else I if k and hit[k - 1] else B for k, h in enumerate(hit)]


def _windowed(evidence: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            out = []
            for lot, text, toxic in zip(*(part.column(c).to_pylist() for c in ("lot", "text", "toxic")), strict=True):
                words = _LETTERS.findall(text or "")
                states = tagged(words, evidence) if toxic else [O] * len(words)
                near = sorted({k for k, s in enumerate(states) if s != O}, key=lambda k: zlib.crc32(f"{lot}:{k}".encode()))[:CALM]
                calm = [zlib.crc32(f"{lot}/{k}".encode()) % len(words) for k in range(CALM)] if words else []
                for k in sorted({*near, *calm}):
                    lo, hi = max(0, k - AROUND), k + AROUND + 1
                    out.append((lot, k, [w[:64] for w in words[lo:hi]], states[lo:hi]))
            columns = list(zip(*out, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["lot", "at", "words", "states"])

    return run


def _inputs(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(field)
        for part in slices(batches, 64):
            x = summed(*tagger(part.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([part.column("lot"), part.column("toxic"), pa.array(x[:, 0]), pa.array(x[:, 1])], names=["lot", "toxic", "top", "total"])

    return run


def spans(text: str, p: np.ndarray, least: float = SURE) -> list[dict[str, float]]:
    """Offsets (code points, end exclusive) of runs of tokens with a marginal of at least ``least``, with their highest marginal."""
    out: list[dict[str, float]] = []
    on, previous = p >= least, -2
    for k, m in enumerate(_LETTERS.finditer(text) if on.any() else ()):
        if on[k]:
            if previous == k - 1:
                out[-1] |= {"end": m.end(), "p": max(out[-1]["p"], float(p[k]))}
            else:
                out.append({"start": m.start(), "end": m.end(), "p": float(p[k])})
            previous = k
    return out


class ToxicityModel:
    """A fitted field and the map from its marginals to scores; ``scale`` is None where nothing could be learned."""

    def __init__(self, field: Field, scale: np.ndarray | None):
        self.field, self.scale = field, scale

    @classmethod
    def train(cls, docs: DataFrame, labels: DataFrame, fit: int = FIT) -> ToxicityModel:
        """docs: doc_id, text; labels: doc_id, toxic (0 or 1). Only documents that have a label teach."""
        known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
        count = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
        if len(count) < 2:
            return cls(Field.blank(), None)
        lot = F.xxhash64(F.lit(7), "doc_id")
        share = {t: min(1.0, fit / c) for t, c in count.items()}
        most = F.when(F.col("toxic") == 1, int(share[1] * (1 << 30))).otherwise(int(share[0] * (1 << 30)))
        few = known.where(F.pmod(lot, F.lit(1 << 30)) < most).orderBy("doc_id").limit(3 * fit)  # near 2 fit rows at most
        bare = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        taught = bare.join(F.broadcast(few), "doc_id").select(lot.alias("lot"), "text", "toxic")

        counted = taught.mapInArrow(_counted, "affix string, toxic int, docs long").groupBy("affix")
        of = lambda t: F.coalesce(F.sum(F.when(F.col("toxic") == t, F.col("docs"))), F.lit(0)).alias("ab"[1 - t])
        sums = staged(counted.agg(of(1), of(0)).where("a > 1"), "affixes")
        seen = {r["toxic"]: r["count"] for r in taught.groupBy("toxic").count().collect()}
        a, b, toxic, clean = F.col("a") + 0.5, F.col("b") + 0.5, seen.get(1, 0) + 1.0, seen.get(0, 0) + 1.0
        proof = F.log(a / toxic) - F.log(b / clean) - F.sqrt(1 / a + 1 / b)
        best = sums.select("affix", proof.alias("evidence")).where(F.col("evidence") >= FLOOR).orderBy(F.desc("evidence"), "affix").limit(AFFIXES)
        evidence = {r["affix"]: r["evidence"] for r in best.collect()}

        order = ["lot", "at", "words"]
        windows = taught.mapInArrow(_windowed(evidence), "lot long, at long, words array<string>, states array<int>").orderBy(*order).limit(4 * fit * 2 * CALM)
        field = Field.fit([(r["words"], r["states"]) for r in windows.collect()])  # FIT x CALM windows of 2 AROUND + 1 tokens
        rows = taught.mapInArrow(_inputs(field), "lot long, toxic int, top double, total double").orderBy("lot", "top", "total").limit(6 * fit).collect()
        y = np.array([r["toxic"] for r in rows], float)
        weight = np.where(y == 1, 1 / share[1], 1 / share[0])
        return cls(field, calibrated(np.array([(r["top"], r["total"]) for r in rows]).reshape(-1, 2), y, weight / weight.mean() if len(rows) else weight))

    def score(self, docs: DataFrame) -> DataFrame:
        """(doc_id, score, spans) of every row; spans: start, end and highest marginal."""
        sent = docs.sparkSession.sparkContext.broadcast((self.field, self.scale))  # bounded by WIDTH
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            field, scale = sent.value
            tagger = Tagger(field)
            for part in slices(batches, 64):
                if scale is None:
                    score, found = np.zeros(part.num_rows), [[]] * part.num_rows
                else:
                    texts = part.column("text").to_pylist()
                    p, size = tagger(texts)
                    score = 1 / (1 + np.exp(-np.clip(scale[0] + summed(p, size) @ scale[1:], -30, 30)))
                    ends = np.cumsum(size)
                    found = [spans(t or "", p[e - n : e]) for t, e, n in zip(texts, ends, size, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score), pa.array(found, kind)], names=["doc_id", "score", "spans"])

        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, spans array<struct<start: long, end: long, p: double>>")
