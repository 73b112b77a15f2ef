"""Where models come in: one protocol each for what is done outside, and the wrapper that runs it over a table in Arrow batches.

A plug-in is made once a task by ``make`` on the executor, so models are loaded there and never pickled. What fails for one row
is that row's error; it doesn't fail the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Recogniser(Protocol):
    """Text and regions (text, x, y, width, height, confidence) of a page image."""

    def recognise(self, image: bytes) -> dict: ...


class Transcriber(Protocol):
    """Segments (start, end, text) of a recording."""

    def transcribe(self, samples: bytes) -> list[dict]: ...


class Embedder(Protocol):
    def embed(self, text: str) -> list[float]: ...


class EntityEngine(Protocol):
    """Entities (entity_type, value, start, end, confidence) of a text."""

    def extract(self, text: str) -> list[dict]: ...


class Parser(Protocol):
    """Tokens (i, text, pos, dep, head) of a text."""

    def parse(self, text: str) -> list[dict]: ...


class Generator(Protocol):
    def generate(self, prompt: str, max_tokens: int) -> str: ...


class Geocoder(Protocol):
    """Latitude and longitude of a place, or None."""

    def find(self, place: str) -> tuple[float, float] | None: ...


class PageRenderer(Protocol):
    """Page images of a document, from page 1 on."""

    def pages(self, document: bytes) -> list[bytes]: ...


def applied(df: DataFrame, make: Callable[[], Callable[..., object]], inputs: list[str], output: str, kind: str) -> DataFrame:
    """``df`` with ``output`` (of SQL type ``kind``) and ``error`` from a plug-in's function over the columns ``inputs``; a row with a null input has neither."""

    @F.pandas_udf(f"value {kind}, error string")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = make()

        def one(args: tuple) -> tuple:
            if any(a is None for a in args):
                return None, None
            try:
                return call(*args), None
            except Exception as e:  # the row's error, whatever the model raised
                return None, f"{type(e).__name__}: {e}"

        for rows in batches:
            done = [one(args) for args in rows.itertuples(index=False, name=None)]
            yield pd.DataFrame({"value": [d[0] for d in done], "error": [d[1] for d in done]})

    out = df.withColumn("__out", run(F.struct(*inputs)))
    return out.select(*df.columns, F.col("__out.value").alias(output), F.col("__out.error").alias("error"))


def transcript(segments: Column) -> Column:
    """The text of segments, a space between them."""
    return F.array_join(F.transform(segments, lambda s: F.trim(s["text"])), " ")


def geocoded(places: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Entities with where they lie: places by a gazetteer (value, latitude, longitude) are resolved or not found, others are skipped, and what was settled before stays."""
    g = gazetteer.groupBy("value").agg(F.min(F.struct("latitude", "longitude")).alias("at")).withColumnRenamed("value", "__v")
    met = places.join(g, F.col("value") == F.col("__v"), "left")
    pending = F.coalesce(F.col("geo_status"), F.lit("pending")) == "pending"
    status = F.when(~pending, F.col("geo_status")).when(F.col("entity_type") != "place", "skipped").when(F.col("at").isNull(), "not_found").otherwise("resolved")
    here = status == "resolved"
    lat, lon = (F.when(pending & here, F.col(f"at.{c}")).when(~pending, F.col(c)) for c in ("latitude", "longitude"))
    return met.withColumns({"geo_status": status, "latitude": lat, "longitude": lon}).select(*places.columns)


def geocode_counts(entities: DataFrame) -> DataFrame:
    """(item_id, resolved, not_found, pending)."""
    n = lambda s: F.count_if(F.col("geo_status") == s).alias(s)
    return entities.where("entity_type = 'place'").groupBy("item_id").agg(n("resolved"), n("not_found"), n("pending"))
