"""Quality classifier from weak labels: overlapping heuristics, their accuracies by EM, and a hashed linear scorer.

1. Heuristic labellers vote junk or clean on each document or abstain. Votes are a few small integers a document.
2. Expectation-maximisation (two classes, labellers independent given the class, each with its own rates of voting junk, voting clean and abstaining)
   runs on the histogram of vote patterns over all documents. Patterns are at most 3^labellers, whatever the corpus.
3. Posterior labels train a logistic scorer on hashed features of word shapes and measures; it is fitted on a sample of at most
   ``FIT`` documents, chosen by hash of doc_id, and scores all of them.

A document is read twice, whole both times; nothing but votes and the sample's hashed features leaves the executors' scan.

Defined results: null text and text without words score 0 and are rejected; repeated rows score alike; a table without
votes is scored by the prior; an empty table gives an empty result. Columns besides doc_id and text are kept by
``keep_good`` and ignored elsewhere.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.llm.common import staged
from quillet.llm.lsh import slices

#: Documents that the scorer is fitted on at most, and its features.
FIT, WIDTH = 8_000, 4096
JUNK, CLEAN, NONE = 1, 0, 2
LABELLERS = ("repeats", "shouts", "marks", "fragments", "echoes", "exclaims", "cased", "flows", "letters", "sentences")
#: Bytes by class: a lower case, A upper case, 0 digit, x part of a letter beyond ASCII, others themselves.
_CLASS = bytes(0x61 if 0x61 <= b <= 0x7A else 0x41 if 0x41 <= b <= 0x5A else 0x30 if 0x30 <= b <= 0x39 else 0x78 if b >= 0x80 else b for b in range(256))
_LETTERS, _WORDLIKE = frozenset(b"aAx"), frozenset(b"aAx0")
#: What plain prose has; a text of few words is drawn towards it, as its own shares say little.
_PROSE = {"top": 0.04, "repeat": 0.1, "upper": 0.0, "lower": 0.95, "alpha": 0.9, "marks": 0.0, "bare": 0.0, "echo": 0.0, "shout": 0.0, "stops": 0.08, "length": 0.28}
_FEW = 8


class _Shapes(dict):
    """What a shape counts for: its feature, its length, and whether it is upper, lower, alphabetic, marked, bare, shouted, ending."""

    def __missing__(self, shape: bytes) -> tuple:
        if len(self) >= 50_000:
            self.clear()
        short = bytes(b for i, b in enumerate(shape[:64]) if i == 0 or b != shape[i - 1])[:8]
        body = shape.rstrip(b".,;:!?")
        last, before = shape[-1], shape[-2] if len(shape) > 1 else 0x61
        found = self[shape] = (
            1 + zlib.crc32(b"s" + short) % (WIDTH - 1), len(shape),
            len(shape) > 1 and 0x41 in shape and 0x61 not in shape and shape.count(b"A") > 1,
            0x61 in shape[1:] or shape[:1] in b"ax",
            bool(body) and _LETTERS.issuperset(body),
            last not in _WORDLIKE and before not in _WORDLIKE and len(shape) > 2,
            _WORDLIKE.isdisjoint(shape),
            last == 0x21,
            last in b".?",
        )
        return found


_shapes = _Shapes()


def measures(text: str) -> tuple[dict[str, float], Counter] | None:
    """Shares between 0 and 1 of a text's words, and how often it has each shape of word; None without words."""
    data = text.encode()
    words = data.split()
    n = len(words)
    if not n:
        return None
    counts = Counter(words)
    kinds = Counter(data.translate(_CLASS).split())
    sums = [0] * 8
    for shape, c in kinds.items():
        for k, v in enumerate(_shapes[shape][1:]):
            sums[k] += v * c
    chars, upper, lower, alpha, marks, bare, shout, stops = sums
    own = {
        "top": (max(counts.values()) - 1) / n, "repeat": 1 - len(counts) / n, "upper": upper / n, "lower": lower / n, "alpha": alpha / n, "marks": marks / n,
        "bare": bare / n, "echo": sum(map(eq, words, words[1:])) / n, "shout": shout / n, "stops": stops / n, "length": min(1.0, chars / n / 20),
    }
    sure = n / (n + _FEW)
    return {k: v * sure + _PROSE[k] * (1 - sure) for k, v in own.items()}, kinds


def votes(m: dict[str, float] | None) -> list[int]:
    """Each labeller's vote, in the order of LABELLERS."""
    if m is None:
        return [JUNK] + [NONE] * (len(LABELLERS) - 1)

    def vote(junk: bool, clean: bool = False) -> int:
        return JUNK if junk else CLEAN if clean else NONE

    calm = max(m["echo"], m["marks"], m["bare"], m["upper"], m["shout"]) < 0.08
    return [
        vote(m["top"] > 0.2),
        vote(m["upper"] > 0.3),
        vote(m["marks"] > 0.15),
        vote(m["bare"] > 0.12),
        vote(m["echo"] > 0.12),
        vote(m["shout"] > 0.25),
        vote(m["lower"] < 0.5, m["lower"] > 0.75),
        vote(False, calm),
        vote(m["alpha"] < 0.5, m["alpha"] > 0.7),
        vote(False, 0.01 < m["stops"] < 0.4),
    ]


def features(m: dict[str, float] | None, kinds: Counter, width: int = WIDTH) -> tuple[list[int], list[float]]:
    """Hashed features: root shares of word shapes, runs of a class as one; each measure in tenths."""
    if m is None:
        return [0], [1.0]
    f: dict[int, float] = {}
    total = sum(kinds.values()) + _FEW
    for shape, c in kinds.items():
        k = _shapes[shape][0]
        f[k] = f.get(k, 0.0) + c / total
    out = {k: math.sqrt(v) for k, v in f.items()}
    for name, v in m.items():
        k = 1 + zlib.crc32(f"{name}:{int(v * 10)}".encode()) % (width - 1)
        out[k] = out.get(k, 0.0) + 0.5
    out[0] = 1.0
    return list(out), list(out.values())


def expectation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100, prior: float = 0.15) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over vote patterns (rows of 0, 1, 2) and their counts: posterior of junk a pattern, rates [class, labeller, vote], prior of junk."""
    junk, clean = (patterns == JUNK).sum(1), (patterns == CLEAN).sum(1)
    # a labeller that votes junk is believed at first, and each round re-estimates all of them
    post = np.where(junk + clean == 0, prior, (junk * 3 + prior) / (junk * 3 + clean + 1))
    rates = np.zeros((2, patterns.shape[1], 3))
    for _ in range(rounds):
        w = np.stack([(1 - post) * counts, post * counts])
        for v in range(3):
            rates[:, :, v] = (w @ (patterns == v) + 0.1) / (w.sum(1, keepdims=True) + 0.3)
        prior = float(np.clip(w[1].sum() / max(1e-9, w.sum()), 1e-3, 0.7))
        logs = np.array([np.log(rates[c, np.arange(patterns.shape[1]), patterns]).sum(1) for c in (0, 1)])
        logs += np.log([[1 - prior], [prior]])
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -60, 60)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return post, rates, prior


def fit(rows: list[tuple[list[int], list[float], float]], width: int = WIDTH, rounds: int = 12, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Weights of a logistic scorer of goodness by AdaGrad over soft labels."""
    w, g2 = np.zeros(width), np.full(width, 1e-6)
    order = np.random.default_rng(7)
    packed = [(np.asarray(k), np.asarray(v), y) for k, v, y in rows]
    for _ in range(rounds):
        for i in order.permutation(len(packed)):
            k, v, y = packed[i]
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(w[k] @ v)))))
            g = (p - y) * v + decay * w[k]
            g2[k] += g * g
            w[k] -= rate * g / np.sqrt(g2[k])
    return w


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        out = []
        for text in part.column("text").to_pylist():
            found = measures(text or "")
            out.append("".join(map(str, votes(found and found[0]))))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "pattern"])


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        ks, vs = [], []
        for text in part.column("text").to_pylist():
            found = measures(text or "")
            k, v = features(*(found or (None, Counter())))
            ks.append(k)
            vs.append(v)
        yield pa.RecordBatch.from_arrays([part.column("pattern"), pa.array(ks, pa.list_(pa.int32())), pa.array(vs, pa.list_(pa.float64()))], names=["pattern", "k", "v"])


def _scored(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            scores = []
            for text in part.column("text").to_pylist():
                found = measures(text or "")
                if found is None:
                    scores.append(0.0)
                    continue
                k, v = features(*found)
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, float(weights[k] @ np.asarray(v)))))))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


class QualityModel:
    """Labeller rates, prior and scorer weights; ``train`` gathers patterns of all documents and features of a bounded sample."""

    def __init__(self, rates: np.ndarray, prior: float, weights: np.ndarray, posterior: dict[str, float]):
        self.rates, self.prior, self.weights, self.posterior = rates, prior, weights, posterior

    @classmethod
    def train(cls, docs: DataFrame, sample: int = FIT) -> QualityModel:
        bare = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        voted = staged(bare.mapInArrow(_vote, "doc_id long, pattern string"), "votes")
        seen = voted.groupBy("pattern").count().orderBy("pattern").collect()  # at most 3^10 rows
        if not seen:
            return cls(np.zeros((2, len(LABELLERS), 3)), 0.5, np.zeros(WIDTH), {})
        patterns = np.array([[int(c) for c in r["pattern"]] for r in seen])
        post, rates, prior = expectation(patterns, np.array([r["count"] for r in seen], float))
        belief = {r["pattern"]: float(p) for r, p in zip(seen, post, strict=True)}
        total = sum(r["count"] for r in seen)
        share = min(1.0, sample / total)
        chosen = bare.where(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else bare
        chosen = chosen.withColumn("lot", F.xxhash64(F.lit(5), "doc_id", "text"))
        found = chosen.mapInArrow(_sample, "doc_id long, lot long, pattern string, k array<int>, v array<double>")
        rows = found.orderBy("lot", "doc_id").limit(2 * sample).collect()  # the same rows whatever order tasks end in
        return cls(rates, prior, fit([(r["k"], r["v"], 1 - belief[r["pattern"]]) for r in rows]), belief)

    def score(self, docs: DataFrame) -> DataFrame:
        """(doc_id, score): the probability that a document is good, from its whole text."""
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scored(self.weights), "doc_id long, score double")


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        pattern = next(_vote(iter([part]))).column("pattern")
        rest = next(_featured(iter([pa.RecordBatch.from_arrays([pattern, part.column("text")], names=["pattern", "text"])])))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lot"), *rest.columns], names=["doc_id", "lot", "pattern", "k", "v"])


def _kept(weights: np.ndarray, least: float, schema: pa.Schema | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            ids = pa.RecordBatch.from_arrays([pa.nulls(part.num_rows, pa.int64()), part.column("text")], names=["doc_id", "text"])
            scores = next(_scored(weights)(iter([ids]))).column("score").to_numpy()
            yield part.filter(pa.array(scores >= least))

    return run


def keep_good(docs: DataFrame, model: QualityModel, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score at least ``least``, with their own columns; one pass without a join."""
    return docs.mapInArrow(_kept(model.weights, least), docs.schema)
