"""Language identification by known words first, shorter and shorter character n-grams for the rest.

Training counts words and the n-grams (4 to 1, with word ends) of each language on at most ``FIT`` documents a language,
chosen by hash of doc_id, and keeps each language's ``WORDS`` most frequent words and ``GRAMS`` of each n. A known word
scores its log frequency in each language; an unseen one the mean log frequency of its longest n-grams of which any is known, so
n falls only as far as it must. A document's score is the sum over all words of its whole text; a word's scores are
kept, so each distinct word is worked out once a process.

The model is bounded by its parameters and the number of languages, not by the corpus. Prediction is one scan without a shuffle.

Defined results: null text and text without a letter are ``und`` with score 0, and so is all text if nothing was learned; ties
go to the language first by name; repeated rows are predicted alike; an empty table gives an empty result; columns
besides doc_id and text (and lang, in training) are never looked at. Rows without doc_id are predicted like any other;
op6 does not learn from them, and its held_out is null there.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillet.llm.common import staged
from quillet.llm.lsh import slices

#: Documents a language to fit on at most; words, and n-grams of each n, that each language keeps; longest n.
FIT, WORDS, GRAMS, LONGEST = 4_000, 20_000, 8_000, 4
#: Pieces whose scores a process keeps.
CACHE = 60_000
_LETTERS = re.compile(r"[^\W\d_]+")


def grams(word: str, n: int) -> list[str]:
    """The n-grams of a word between its ends; at n = 1 its letters alone."""
    marked = f"<{word}>" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, n, item, count): words as n = 0."""
    found: dict[str, Counter[str]] = {}

    def given() -> pa.RecordBatch:
        total: Counter[tuple[str, int, str]] = Counter()
        for lang, words in found.items():
            for w, c in words.items():
                total[lang, 0, w] += c
                for n in range(1, LONGEST + 1):
                    for g in grams(w, n):
                        total[lang, n, g] += c
        rows = list(zip(*((*k, c) for k, c in total.items()), strict=True)) or [()] * 4
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.string()), pa.array(rows[3], pa.int64())], names=["lang", "n", "item", "count"])

    for part in slices(batches):
        for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist(), strict=True):
            found.setdefault(lang, Counter()).update(_LETTERS.findall((text or "").lower()))
        if sum(map(len, found.values())) > 50_000:
            yield given()
    yield given()


class LanguageModel:
    """Log frequencies by language of known words and n-grams."""

    def __init__(self, langs: list[str], known: list[dict[str, np.ndarray]]):
        self.langs, self.known = langs, known
        self.cache: dict[str, int] = {}
        self.table = np.empty((CACHE, len(langs) + 1))

    @classmethod
    def train(cls, docs: DataFrame, fit: int = FIT, words: int = WORDS, top: int = GRAMS) -> LanguageModel:
        """docs: doc_id, text, lang; rows without a lang teach nothing."""
        named = docs.where(F.col("lang").isNotNull())
        sizes = named.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"))
        share = F.least(F.lit(1.0), F.lit(float(fit)) / F.col("docs"))
        sizes = staged(sizes.select("lang", (share * (1 << 30)).cast("long").alias("most")), "langs")
        chosen = named.join(sizes, "lang").where(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 30)) < F.col("most"))
        counted = chosen.select("lang", "text").mapInArrow(_count, "lang string, n int, item string, count long")
        total = staged(counted.groupBy("lang", "n", "item").agg(F.sum("count").alias("count")), "gram-counts")
        mass = {(r["lang"], r["n"]): r["mass"] for r in total.groupBy("lang", "n").agg(F.sum("count").alias("mass")).collect()}
        place = F.row_number().over(W.partitionBy("lang", "n").orderBy(F.desc("count"), "item"))
        best = total.withColumn("place", place).where(F.col("place") <= F.when(F.col("n") == 0, words).otherwise(top))
        langs = sorted({k[0] for k in mass})
        known: list[dict[str, np.ndarray]] = [{} for _ in range(LONGEST + 1)]
        floor = np.array([[math.log(0.1 / (mass.get((lang, n), 0) + 1)) for lang in langs] for n in range(LONGEST + 1)])
        at = {lang: i for i, lang in enumerate(langs)}
        for r in best.select("lang", "n", "item", "count").toLocalIterator():  # at most WORDS + 4 GRAMS a language
            row = known[r["n"]].get(r["item"])
            if row is None:
                row = known[r["n"]][r["item"]] = floor[r["n"]].copy()
            row[at[r["lang"]]] = math.log((r["count"] + 0.1) / (mass[r["lang"], r["n"]] + 1))
        return cls(langs, known)

    def word(self, word: str) -> np.ndarray:
        """Scores of one word by language: its own frequency, else those of its longest known n-grams."""
        own = self.known[0].get(word)
        if own is not None:
            return own
        for n in range(min(LONGEST, len(word) + 2), 0, -1):
            some = [v for v in map(self.known[n].get, grams(word, n)) if v is not None]
            if some:
                return np.add.reduce(some) / len(some)
        return np.zeros(len(self.langs))

    def _piece(self, piece: str, out: np.ndarray) -> None:
        """To ``out``: summed scores by language of the words inside a blank-separated piece, then the number of their letters."""
        words = _LETTERS.findall(piece.lower())
        if len(words) == 1:
            out[:-1] = self.word(words[0])
            out[-1] = len(words[0])
            return
        out[:] = 0
        for w in words:
            out[:-1] += self.word(w)
            out[-1] += len(w)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs:
            return "und", 0.0
        total, alone = np.zeros((2, len(self.langs) + 1))
        rows, times = [], []
        for piece, c in Counter(text.split()).items():
            at = self.cache.get(piece)
            if at is None:
                if len(piece) > 64:
                    self._piece(piece, alone)
                    total += c * alone
                    continue
                if len(self.cache) == CACHE:
                    total += np.array(times, float) @ self.table[rows]
                    rows, times = [], []
                    self.cache.clear()
                at = self.cache[piece] = len(self.cache)
                self._piece(piece, self.table[at])
            rows.append(at)
            times.append(c)
        if rows:
            total += np.array(times, float) @ self.table[rows]
        score = total[:-1]
        if not total[-1]:
            return "und", 0.0
        best = int(score.argmax())
        return self.langs[best], float(1 / np.exp(score - score[best]).sum())

    def score(self, docs: DataFrame) -> DataFrame:
        """(doc_id, lang_pred, score) of every row."""
        sent = docs.sparkSession.sparkContext.broadcast((self.langs, self.known))  # bounded by WORDS, GRAMS and the languages

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = LanguageModel(*sent.value)
            for part in slices(batches):
                found = [model.predict(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
