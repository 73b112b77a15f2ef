"""A tagging model's windows as rows: long texts are cut into overlapping windows of tokens, and predictions of windows become a text's entities.

The model runs elsewhere: ``token_windows`` gives what it reads, ``windowed_entities`` takes a table of what it says. A window's tags are decoded alone; entities
that touch an edge inside the text are left to the neighbouring window; offsets are the text's; what several windows find is consolidated in order.
Everything is joins, windows and folds in expressions, and a group is a window or a text's entities.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from quillet.functions.text import sanitize_value
from quillet.operators.decode import BIO_TYPES, bio_type, consolidated, is_institution, named, passes
from quillet.operators.entities import bio_spans, inside_windows

#: Tokens of a window, and tokens that two neighbours share.
SIZE, OVERLAP = 256, 32


_SPANS = T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


@cache
def _in_words() -> np.ndarray:
    """Whether a code point is a letter or digit."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


def _words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of a text's words, their lengths in UTF-8 and all their bytes."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    edge = np.diff(np.concatenate(([0], _in_words()[points].view(np.int8), [0])).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    coded = np.frombuffer(text.encode(), np.uint8)
    if len(coded) == len(points):
        size, kept = end - start, _in_words()[coded]
    else:
        wide = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        at = np.concatenate(([0], np.cumsum(wide)))
        size, kept = at[end] - at[start], np.repeat(_in_words()[points], wide)
    return start, end, size, coded[kept]


@F.arrow_udf(_SPANS)
def token_spans(texts: pa.Array) -> pa.Array:
    """Runs of letters and digits of a text with their offsets in characters."""
    found = [_words(t or "") for t in texts.to_pylist()]
    start, end, size, coded = (np.concatenate(x) for x in zip(*found, strict=True)) if found else _words("")
    upto = lambda n, kind: pa.py_buffer(np.concatenate(([0], np.cumsum(n))).astype(kind))
    tokens = pa.LargeStringArray.from_buffers(len(size), upto(size, np.int64), pa.py_buffer(coded)).cast(pa.string())
    fields = pa.StructArray.from_arrays([tokens, pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["token", "start", "end"])
    return pa.ListArray.from_buffers(pa.list_(fields.type), len(found), [None, upto([len(f[0]) for f in found], np.int32)], children=[fields])


_TEXTS = T.ArrayType(T.StringType())


@F.arrow_udf(_TEXTS)
def cuts(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """What of a text lies in each of its spans (start, end)."""
    rows = zip(texts.to_pylist(), spans.to_pylist(), strict=True)
    return pa.array([[None if t is None else t[s["start"] : s["end"]] for s in own] for t, own in rows], pa.list_(pa.string()))


def token_windows(tokens: DataFrame, key: str, size: int = SIZE, overlap: int = OVERLAP, count: str | None = None) -> DataFrame:
    """Tokens (key, i from 0, ...) once for each window that holds them, with ``window``, the place of the window's first token.

    Windows start ``size - overlap`` apart; the last one is the first that reaches the text's end. ``count`` names a column with the number of the text's
    tokens, where it is known with the token; without it the tokens are counted and joined, which moves them all.
    """
    step = size - overlap
    rows = tokens.withColumnRenamed(count, "__n") if count else tokens.join(tokens.groupBy(key).agg((F.max("i") + 1).alias("__n")), key)
    last = F.when(F.col("__n") > size, F.ceil((F.col("__n") - size) / step)).otherwise(0)
    low, high = F.greatest(F.lit(0), F.ceil((F.col("i") - size + 1) / step)), F.least(F.floor(F.col("i") / step), last)
    return rows.withColumn("window", F.explode(F.sequence(low * step, high * step, F.lit(step).cast("long")))).drop("__n")


def windowed_entities(predictions: DataFrame, texts: DataFrame, key: str, text: str, threshold: float = 0.5) -> DataFrame:
    """(key, entity_type, value, start, end, confidence, source) from predictions (key, window, i, start, end, label, score) of all tokens of all windows.

    Offsets of predictions are those of the text. Labels that are no entity's, and those below their type's threshold, count as outside.
    Predictions are read twice: for the windows' edges, and for what passes; these alone are shuffled, together. A text meets all its spans in one
    row, so that it is cut in one pass.
    """
    edges = predictions.groupBy(key, "window").agg(F.min("start").alias("window_start"), F.max("end").alias("window_end"))
    good = predictions.where(passes(F.col("label"), F.col("score"), threshold) & bio_type(F.col("label")).isNotNull()).select(key, "window", "i", "start", "end", "label", "score")
    dealt = good.unionByName(edges, allowMissingColumns=True).repartition(key)
    own = W.partitionBy(key, "window")
    at = {"window_start": F.max("window_start").over(own), "window_end": F.max("window_end").over(own), "last": F.col("window") == F.max("window").over(W.partitionBy(key))}
    spans = bio_spans(dealt.withColumns(at).where("label is not null"), [key, "window", *at], ["i"]).drop("n")
    inner = inside_windows(spans.withColumn("first", F.col("window") == 0))
    kind = named(F.col("entity_type"), BIO_TYPES)
    held = inner.select(key, F.struct("start", "end", kind.alias("entity_type"), "confidence").alias("s")).groupBy(key).agg(F.collect_list("s").alias("__s"))
    met = held.join(texts.select(key, F.col(text).alias("__text")), key)
    places = F.transform("__s", lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end")))
    rows = met.select(key, F.explode_outer(F.arrays_zip("__s", cuts("__text", places).alias("__v"))).alias("e"))
    value = sanitize_value(F.col("e.__v"))
    rows = rows.select(key, F.col("e.__s.entity_type").alias("entity_type"), value.alias("value"), "e.__s.start", "e.__s.end", "e.__s.confidence").where("value <> ''")
    rows = rows.withColumn("entity_type", F.when((F.col("entity_type") == "organization") & is_institution(F.col("value")), "institution").otherwise(F.col("entity_type")))
    return consolidated(rows.repartition(key).withColumn("source", F.lit("onnx")), key)  # what is derived from a value isn't shuffled
