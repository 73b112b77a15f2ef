"""Enrichment of items and assets end to end: their texts, entities and triples stored in one step, and the embedding backfill with its report.

Each function works on all targets of a batch at once: texts are joined and grouped, engines run over them, and what was found automatically before is exchanged for
what is found now. A target is an item, or an asset of an item; what people entered stays and protects its places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.operators.decode import engine
from quillet.operators.entities import distinct_triples, extract, triples, unprotected
from quillet.operators.relational import has_text, latest, manual, merged_text
from quillet.operators.store import Store

_SOURCES = ("extractions", "transcriptions")


def item_texts(store: Store) -> DataFrame:
    """(item_id, text) of every item: its extractions, then its transcriptions, each in order of assets and time; empty where it has none."""
    place = store["assets"].select(F.col("id").alias("asset_id"), "item_id", F.coalesce("sort_index", F.lit(0)).alias("sort_index"))
    rows = None
    for k, name in enumerate(_SOURCES):
        own = store[name].join(place, "asset_id").select("item_id", F.lit(k).alias("source_order"), "sort_index", "created_at", F.coalesce("text_content", F.lit("")).alias("text"))
        rows = own if rows is None else rows.unionByName(own)
    texts = merged_text(rows, ["item_id"], ["source_order", "sort_index", "created_at"], "text")
    return store["items"].select(F.col("id").alias("item_id")).join(texts, "item_id", "left").withColumn("text", F.coalesce("text", F.lit("")))


def asset_texts(store: Store) -> DataFrame:
    """(item_id, asset_id, text) of every asset: its oldest extraction and its oldest transcription, what is empty left out."""
    out = store["assets"].select("item_id", F.col("id").alias("asset_id"))
    for name in _SOURCES:
        oldest = latest(store[name], ["asset_id"], F.asc("created_at"), F.asc("id")).select("asset_id", F.nullif(F.coalesce("text_content", F.lit("")), F.lit("")).alias(name))
        out = out.join(oldest, "asset_id", "left")
    return out.select("item_id", "asset_id", F.concat_ws(" ", *_SOURCES).alias("text"))


def _target(texts: DataFrame) -> str:
    return "asset_id" if "asset_id" in texts.columns else "item_id"


def entity_candidates(store: Store, texts: DataFrame, model: DataFrame | None = None, kind: str | None = None) -> DataFrame:
    """(item_id[, asset_id], entity_type, value, start, end, confidence, source): what an engine finds in ``texts`` (``item_texts`` or ``asset_texts``) above the
    confidence gate, without what an item's manual entities, deleted ones too, equal or overlap.

    model: (target, entity_type, value, start, end, confidence, source) of models over the same texts, if any.
    """
    key = _target(texts)
    full = texts.where(has_text(F.col("text")))
    item = [] if key == "item_id" else ["item_id"]  # goes along, so that what is found needs no join
    found = extract(full, key, "text", *item).drop("place")
    found = found if model is None else found.unionByName(model.drop(*item).join(full.select(key, *item), key).select(*found.columns))
    placed = engine(found, key, kind)
    kept = store["entities"].where(manual(F.col("source"))).select("item_id", "entity_type", "value", F.col("start_offset").alias("start"), F.col("end_offset").alias("end"))
    return unprotected(placed, kept)


def _exchanged(store: Store, name: str, texts: DataFrame, fresh: DataFrame, stays) -> Store:
    """Rows of the targets but those that stay go, ``fresh`` rows come."""
    scope = ["item_id", "asset_id"] if _target(texts) == "asset_id" else ["item_id"]
    gone = store[name].where(~stays).join(texts.select(*scope).distinct(), scope, "left_anti")
    kept = store[name].where(stays).unionByName(gone)
    return store.set(**{name: kept}).insert(name, fresh)


def with_entities(store: Store, texts: DataFrame, now: int, model: DataFrame | None = None, kind: str | None = None) -> Store:
    """The candidates of ``texts`` in place of the targets' automatic entities; targets without text lose theirs."""
    found = entity_candidates(store, texts, model, kind)
    asset = F.col("asset_id") if "asset_id" in found.columns else F.lit(None).cast("string")
    name = F.sha2(F.concat_ws("\x1f", "item_id", F.coalesce(asset, F.lit("")), "entity_type", "value", "start", "end", "source"), 256)
    fresh = found.select(F.concat(F.lit("ent-"), name).alias("id"), "item_id", asset.alias("asset_id"), "entity_type", "value", F.col("start").cast("long").alias("start_offset"), F.col("end").cast("long").alias("end_offset"), "confidence", "source", F.lit("pending").alias("geo_status"), F.lit(now).cast("long").alias("created_at"))
    return _exchanged(store, "entities", texts, fresh, manual(F.col("source")))


def with_triples(store: Store, texts: DataFrame, now: int) -> Store:
    """The triples of ``texts``, the first of each without regard to case, in place of the targets' triples; targets without text lose theirs."""
    key = _target(texts)
    found = distinct_triples(triples(texts.where(has_text(F.col("text"))), key, "text", placed=True), key, "place").drop("place")
    found = found if key == "item_id" else found.join(texts.select("item_id", "asset_id"), "asset_id")
    asset = F.col("asset_id") if key == "asset_id" else F.lit(None).cast("string")
    name = F.sha2(F.concat_ws("\x1f", "item_id", F.coalesce(asset, F.lit("")), "subject", "predicate", "object"), 256)
    fresh = found.select(F.concat(F.lit("tri-"), name).alias("id"), "item_id", asset.alias("asset_id"), "subject", "predicate", "object", F.lit(now).cast("long").alias("created_at"))
    return _exchanged(store, "triples", texts, fresh, F.lit(False))


def backfill_candidates(store: Store, force: bool = False, limit: int | None = None) -> DataFrame:
    """(asset_id, item_id) of assets that have text and, unless ``force``, no vector, the first ``limit`` by id."""
    texts = asset_texts(store).where(has_text(F.col("text"))).select("asset_id", "item_id")
    rows = texts if force else texts.join(store["vec_assets"].select("asset_id"), "asset_id", "left_anti")
    return rows if limit is None else rows.orderBy("asset_id").limit(limit)


def backfilled(store: Store, vectors: DataFrame, force: bool = False, limit: int | None = None) -> tuple[Store, DataFrame]:
    """The store with the candidates' vectors, and one row about it: assets with text, candidates, embedded, failed, missing afterwards.

    vectors: (asset_id, embedding), what a model gave; a candidate without a vector, or with an empty one, failed.
    """
    asked = backfill_candidates(store, force, limit)
    came = asked.join(vectors.where("embedding is not null and size(embedding) > 0").select("asset_id", "embedding"), "asset_id")
    after = store.put("vec_assets", came.select("asset_id", "item_id", "embedding"))
    has = store["assets"].select(F.col("id").alias("asset_id"))
    state = has.join(asset_texts(store).select("asset_id", has_text(F.col("text")).alias("text")), "asset_id")
    for name, rows in (("asked", asked), ("came", came), ("now", after["vec_assets"])):
        state = state.join(rows.select("asset_id").distinct().withColumn(name, F.lit(True)), "asset_id", "left")
    count = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    asked_, came_, now_ = (F.coalesce(c, F.lit(False)) for c in ("asked", "came", "now"))
    report = state.agg(count(F.col("text")).alias("with_text"), count(asked_).alias("candidates"), count(came_).alias("embedded"), count(asked_ & ~came_).alias("failed"), count(F.col("text") & ~now_).alias("missing"))
    return after, report
