"""Schemas of the corpus tables, their keys, and migrations recorded by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tables and columns.
DDL = {
    "collections": "id string not null, name string not null, description string, created_at bigint not null, updated_at bigint not null",
    "items": "id string not null, title string not null, collection_id string not null, metadata string, created_at bigint not null, updated_at bigint not null",
    "assets": "id string not null, item_id string not null, path string not null, type string not null, size bigint, created_at bigint not null, sort_index bigint not null",
    "notes": "id string not null, item_id string not null, content string not null, created_at bigint not null, updated_at bigint not null, asset_id string",
    "jobs": "id string not null, type string not null, status string not null, asset_id string not null, result string, error string, created_at bigint not null, updated_at bigint not null",
    "extractions": "id string not null, asset_id string not null, text_content string not null, method string not null, confidence double, created_at bigint not null",
    "transcriptions": "id string not null, asset_id string not null, text_content string not null, language string, duration_ms bigint, model string not null, segments string, confidence double, created_at bigint not null",
    "layouts": "id string not null, asset_id string not null, regions string not null, blocks string not null, model string not null, image_width bigint not null, image_height bigint not null, created_at bigint not null",
    "entities": "id string not null, item_id string not null, entity_type string not null, value string not null, start_offset bigint, end_offset bigint, confidence double, source string, model_name string, created_at bigint not null, latitude double, longitude double, geo_status string, asset_id string",
    "triples": "id string not null, item_id string not null, subject string not null, predicate string not null, object string not null, created_at bigint not null, asset_id string",
    "annotations": "id string not null, asset_id string not null, page bigint not null, kind string not null, color string not null, x double not null, y double not null, width double not null, height double not null, created_at bigint not null, updated_at bigint not null",
    "topics": "id string not null, name string not null, created_at bigint not null",
    "item_topics": "id string not null, item_id string not null, topic_id string not null, created_at bigint not null",
    "llm_results": "id string not null, target_id string not null, target_type string not null, job_type string not null, result string not null, created_at bigint not null",
    "vec_assets": "asset_id string not null, item_id string not null, embedding array<float>",
    "app_settings": "key string not null, value string not null",
    "_migrations": "id bigint not null, name string not null, applied_at bigint not null",
}
#: Values that a column may take.
CHECKS = {
    ("entities", "entity_type"): ("person", "organization", "place", "date", "misc", "institution", "custom"),
    ("annotations", "kind"): ("rectangle", "underline"),
    ("llm_results", "target_type"): ("asset", "item", "collection", "unknown"),
}
#: Tables that the browser offers, in its order, and those that it hides.
BROWSED = ("collections", "items", "assets", "notes", "jobs", "extractions", "transcriptions", "entities", "triples", "topics", "item_topics", "vec_assets", "layouts", "llm_results", "annotations")
HIDDEN = ("app_settings", "_migrations", "fts_items")


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[name])


def key(name: str) -> str:
    """The primary key's column."""
    return {"vec_assets": "asset_id", "app_settings": "key"}.get(name, "id")


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], schema(name))


def valid(name: str, rows: DataFrame) -> DataFrame:
    """``rows`` with the checks of their table: a value outside is an error of the query."""
    for (table, column), allowed in CHECKS.items():
        if table == name:
            ok = F.col(column).isNull() | F.col(column).isin(*allowed)
            rows = rows.withColumn(column, F.when(ok, F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"{name}.{column}: not allowed: "), F.col(column)))))
    return rows


def migrated(spark: SparkSession, done: DataFrame, scripts: dict[str, str], now_s: int) -> tuple[DataFrame, list[str]]:
    """Runs the statements of scripts that ``done`` doesn't name, in the order of their names, and returns the record with them added, and their names.

    The record holds a few rows; scripts run one after another, and one that fails leaves those after it unrun and unrecorded.
    """
    from quillet.functions.text import split_statements

    known = {r["name"] for r in done.select("name").collect()}
    ran: list[str] = []
    for name in sorted(set(scripts) - known):
        for statement in split_statements(scripts[name]):
            spark.sql(statement)
        ran.append(name)
    fresh = spark.createDataFrame([(len(known) + i + 1, n, now_s) for i, n in enumerate(ran)], schema("_migrations"))
    return done.unionByName(fresh), ran


def is_applied(done: DataFrame, name: str) -> bool:
    return done.where(F.col("name") == name).limit(1).count() > 0
