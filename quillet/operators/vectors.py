"""Cosine similarity of embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null for different lengths, empty vectors and zero norms."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), 1 - dot(a, b) / norm)


def similar(vectors: DataFrame, target: int, k: int = 5) -> DataFrame:
    """The k vectors most like one of them; the target is one row."""
    one = vectors.where(F.col("vec_id") == target).select(F.col("embedding").alias("__t")).limit(1)
    rows = vectors.where(F.col("vec_id") != target).join(F.broadcast(one))
    rows = rows.withColumn("similarity", F.round(1 - cosine_distance(F.col("embedding"), F.col("__t")), 6)).where("similarity is not null")
    return rows.select("vec_id", "label", "similarity").orderBy(F.desc("similarity"), "vec_id").limit(k)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_blob(values):
    """Little-endian 32-bit floats of a blob; null where its length is no multiple of four."""
    import numpy as np

    return values.map(lambda v: None if v is None or len(v) % 4 else np.frombuffer(v, "<f4").tolist())


@F.pandas_udf(T.BinaryType())
def encode_blob(values):
    import numpy as np

    return values.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())
