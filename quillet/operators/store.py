"""The repositories as functions from tables to tables.

A ``Store`` is a set of named DataFrames; every write gives a new store whose plans hold the change, and nothing is written until a table
is saved, so a series of writes is one plan a table, and a store that is dropped leaves no trace. Reads are filters and windows that Spark pushes
to the scan. Ids and times come from the caller, so that results repeat. Joins with what a caller
passes (a few rows) and cascades over ids are anti- and semi-joins, that Spark broadcasts where its own statistics show a small side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillet.functions.text import topic
from quillet.operators.relational import in_scope, latest, manual, visible
from quillet.sources.schemas import DDL, empty, key, schema, valid


class MissingParent(ValueError):
    """A row was to be inserted under a parent that doesn't exist."""


def updated(df: DataFrame, where: Column, /, **values) -> DataFrame:
    """Columns set where ``where`` holds; a value of None leaves its column as it is."""
    new = {c: v if isinstance(v, Column) else F.lit(v) for c, v in values.items() if v is not None}
    hit = F.coalesce(where, F.lit(False))
    return df.withColumns({c: F.when(hit, v.cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, v in new.items()})


def newest(df: DataFrame, *keys: str) -> DataFrame:
    return latest(df, list(keys), F.desc("created_at"), F.desc(key_of(df)))


def key_of(df: DataFrame) -> str:
    return "id" if "id" in df.columns else df.columns[0]


def affected(before: DataFrame, after: DataFrame, by: str = "id") -> int:
    """Rows that a write added, removed or changed."""
    cols = [c for c in before.columns if c != by]
    a, b = (d.select(by, F.xxhash64(*cols).alias("h")) for d in (before, after))
    both = a.alias("a").join(b.alias("b"), by, "full_outer")
    return both.where(~F.col("a.h").eqNullSafe(F.col("b.h"))).count()


class Store:
    def __init__(self, spark: SparkSession, **tables: DataFrame):
        self.spark = spark
        self.tables = {n: tables.get(n) if tables.get(n) is not None else empty(spark, n) for n in DDL}

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def set(self, **tables: DataFrame) -> Store:
        return Store(self.spark, **{**self.tables, **tables})

    # rows

    def insert(self, name: str, rows: list[dict] | DataFrame, **defaults) -> Store:
        """Rows added; columns they lack are the defaults, or null."""
        if not isinstance(rows, DataFrame):
            fields = schema(name).fields
            rows = self.spark.createDataFrame([tuple({**defaults, **r}.get(f.name) for f in fields) for r in rows], schema(name))
        return self.set(**{name: self[name].unionByName(valid(name, rows), allowMissingColumns=True)})

    def find(self, name: str, id_: str) -> DataFrame:
        """The row with a primary key, or none."""
        return self[name].where(F.col(key(name)) == id_).limit(1)

    def delete(self, name: str, where: Column) -> Store:
        return self.set(**{name: self[name].where(~F.coalesce(where, F.lit(False)))})

    def update(self, table: str, id_: str, /, **values) -> Store:
        return self.set(**{table: updated(self[table], F.col(key(table)) == id_, **values)})

    def _child(self, name: str, parent: str, parent_key: str, row: dict, **defaults) -> Store:
        if not self.find(parent, row[parent_key]).count():
            raise MissingParent(f"{parent}: no row {row[parent_key]!r}")
        return self.insert(name, [row], **defaults)

    # collections, items, assets

    def create_collection(self, row: dict, now: int) -> Store:
        return self.insert("collections", [row], created_at=now, updated_at=now)

    def update_collection(self, id_: str, now: int, name: str | None = None, description: str | None = None) -> Store:
        return self.update("collections", id_, name=name, description=description, updated_at=now)

    def collections(self) -> DataFrame:
        return self["collections"].orderBy(F.desc("updated_at"), "id")

    def collection_named(self, part: str) -> DataFrame:
        return self["collections"].where(F.contains(F.lower("name"), F.lit(part.lower())))

    def create_item(self, row: dict, now: int) -> Store:
        return self._child("items", "collections", "collection_id", row, created_at=now, updated_at=now)

    def update_item(self, id_: str, now: int, title: str | None = None, metadata: str | None = None) -> Store:
        return self.update("items", id_, title=title, metadata=metadata, updated_at=now)

    def items_of(self, collection: str) -> DataFrame:
        return self["items"].where(F.col("collection_id") == collection).orderBy(F.desc("updated_at"), "id")

    def create_asset(self, row: dict, now: int) -> Store:
        return self._child("assets", "items", "item_id", row, created_at=now, sort_index=0)

    def assets_of(self, item: str) -> DataFrame:
        return self["assets"].where(F.col("item_id") == item).orderBy("sort_index", "created_at", "id")

    # facts by item or asset

    def of_item(self, name: str, item: str) -> DataFrame:
        rows = self[name].where(F.col("item_id") == item)
        return rows.where(visible(F.col("source"))) if name == "entities" else rows

    def in_scope(self, name: str, item: str, asset: str) -> DataFrame:
        """Rows of an asset and those of its item as a whole; entities without deleted ones, in their order."""
        rows = self.of_item(name, item).where(in_scope(F.col("asset_id"), F.lit(asset)))
        if name == "entities":
            return rows.orderBy("created_at", "start_offset", "value")
        return rows.orderBy(F.desc("created_at"), "id")

    def create_entity(self, row: dict, now: int) -> Store:
        return self.insert("entities", [row], start_offset=0, end_offset=0, confidence=1.0, geo_status="pending", created_at=now)

    def soft_delete_entity(self, id_: str) -> Store:
        """Kept as manually deleted, so that later extraction doesn't find it again."""
        return self.update("entities", id_, source="manual_deleted")

    def delete_automatic(self, item: str, asset: str | None = None) -> Store:
        """Entities of an item (of all its assets), or of one asset, that nobody touched by hand."""
        scope = F.col("item_id") == item if asset is None else (F.col("item_id") == item) & (F.col("asset_id") == asset)
        return self.delete("entities", scope & ~manual(F.col("source")))

    def replace_automatic(self, rows: DataFrame, item: str, asset: str | None = None) -> Store:
        return self.delete_automatic(item, asset).insert("entities", rows)

    def replace_triples(self, rows: DataFrame, item: str, asset: str | None = None) -> Store:
        scope = F.col("item_id") == item if asset is None else (F.col("item_id") == item) & (F.col("asset_id") == asset)
        return self.delete("triples", scope).insert("triples", rows)

    def create_note(self, row: dict, now: int) -> Store:
        return self.insert("notes", [row], created_at=now, updated_at=now)

    def annotations(self, asset: str, page: int | None = None) -> DataFrame:
        rows = self["annotations"].where(F.col("asset_id") == asset)
        rows = rows if page is None else rows.where(F.col("page") == page)
        return rows.orderBy(F.desc("updated_at"), F.desc("created_at"), "id")

    def replace_annotations(self, rows: DataFrame, asset: str, page: int) -> Store:
        return self.delete("annotations", (F.col("asset_id") == asset) & (F.col("page") == page)).insert("annotations", rows)

    # one row an asset: extractions, transcriptions, layouts, vectors

    def newest_of(self, name: str, asset: str) -> DataFrame:
        return newest(self[name].where(F.col("asset_id") == asset), "asset_id")

    def all_of(self, name: str, asset: str) -> DataFrame:
        return self[name].where(F.col("asset_id") == asset).orderBy(F.desc("created_at"), "id")

    def put(self, name: str, rows: DataFrame) -> Store:
        """Rows in place of those of the same assets; the id of an asset's row changes."""
        kept = self[name].join(rows.select("asset_id").distinct(), "asset_id", "left_anti")
        return self.set(**{name: kept.select(*self[name].columns).unionByName(rows, allowMissingColumns=True)})

    def upsert(self, name: str, rows: DataFrame) -> Store:
        """As ``put``, but an asset that has a row keeps that row's id and, in extractions and transcriptions, when it was created."""
        if "id" not in self[name].columns:
            return self.put(name, rows)
        old = newest(self[name], "asset_id").select("asset_id", F.col("id").alias("__id"))
        rows = rows.join(old, "asset_id", "left").withColumn("id", F.coalesce("__id", "id")).drop("__id")
        return self.put(name, rows)

    def update_text(self, name: str, asset: str, text: str) -> Store:
        """Only the text of an asset's newest row."""
        row = self.newest_of(name, asset).select(F.col("id").alias("__hit"))
        marked = self[name].join(row, F.col("id") == F.col("__hit"), "left")
        marked = marked.withColumn("text_content", F.when(F.col("__hit").isNotNull(), F.lit(text)).otherwise(F.col("text_content")))
        return self.set(**{name: marked.select(*self[name].columns)})

    # topics

    def find_topic(self, name: str) -> DataFrame:
        return self["topics"].where(F.col("name") == topic(F.lit(name))).limit(1)

    def ensure_topics(self, names: list[str], now: int) -> Store:
        """Topics by normalised name, made where missing; ids are derived from names."""
        wanted = self.spark.createDataFrame([(n,) for n in names], "name string").select(topic(F.col("name")).alias("name")).where("name <> ''").distinct()
        fresh = wanted.join(self["topics"].select("name"), "name", "left_anti")
        return self.insert("topics", fresh.select(F.concat(F.lit("topic-"), F.sha2("name", 256)).alias("id"), "name", F.lit(now).cast("long").alias("created_at")))

    def link_topics(self, item: str, names: list[str], now: int) -> Store:
        """Links made where missing: repeating it changes nothing."""
        s = self.ensure_topics(names, now)
        wanted = s["topics"].join(self.spark.createDataFrame([(n,) for n in names], "n string").select(topic(F.col("n")).alias("name")).distinct(), "name", "left_semi")
        links = wanted.select(F.lit(item).alias("item_id"), F.col("id").alias("topic_id")).join(s["item_topics"].select("item_id", "topic_id"), ["item_id", "topic_id"], "left_anti")
        return s.insert("item_topics", links.select(F.concat_ws("-", F.lit("link"), "item_id", "topic_id").alias("id"), "item_id", "topic_id", F.lit(now).cast("long").alias("created_at")))

    def unlink_topic(self, item: str, topic_id: str | None = None) -> Store:
        hit = F.col("item_id") == item
        return self.delete("item_topics", hit if topic_id is None else hit & (F.col("topic_id") == topic_id))

    def topics_of(self, item: str) -> DataFrame:
        links = self["item_topics"].where(F.col("item_id") == item).select(F.col("topic_id").alias("id"))
        return self["topics"].join(links, "id", "left_semi").orderBy("name")

    def items_with(self, topic_id: str) -> int:
        return self["item_topics"].where(F.col("topic_id") == topic_id).count()

    # jobs, results, settings

    def update_job(self, id_: str, now: int, status: str | None = None, error: str | None = None, progress: int | None = None) -> Store:
        result = None if progress is None else F.to_json(F.struct(F.lit(progress).alias("progress")))
        return self.update("jobs", id_, status=status, error=error, result=result, updated_at=now)

    def pending_jobs(self) -> DataFrame:
        return self["jobs"].where("status = 'pending'").orderBy("created_at", "id")

    def newest_job(self, asset: str) -> DataFrame:
        return newest(self["jobs"].where(F.col("asset_id") == asset), "asset_id")

    def put_result(self, target_id: str, target_type: str, job_type: str, result: str, now: int) -> Store:
        id_ = f"llr-{target_type}-{target_id}-{job_type}"
        row = {"id": id_, "target_id": target_id, "target_type": target_type, "job_type": job_type, "result": result, "created_at": now}
        return self.delete("llm_results", F.col("id") == id_).insert("llm_results", [row])

    def result_for(self, target_id: str, target_type: str, job_type: str | None = None) -> DataFrame:
        rows = self["llm_results"].where((F.col("target_id") == target_id) & (F.col("target_type") == target_type))
        return (rows if job_type is None else rows.where(F.col("job_type") == job_type)).orderBy(F.desc("created_at"), "id").limit(1)

    def setting(self, name: str, value: str | None = None, delete: bool = False) -> Store | DataFrame:
        """The row of a setting; with a value or ``delete``, the store after it."""
        hit = F.col("key") == name
        if delete:
            return self.delete("app_settings", hit)
        if value is None:
            return self["app_settings"].where(hit)
        return self.delete("app_settings", hit).insert("app_settings", [{"key": name, "value": value}])

    def settings(self) -> DataFrame:
        return self["app_settings"].orderBy("key")

    # cascades

    def _gone(self, name: str, column: str, ids: DataFrame) -> DataFrame:
        return self[name].join(ids.toDF(column), column, "left_anti").select(*self[name].columns)

    def delete_asset(self, id_: str) -> Store:
        """An asset with what hangs on it alone; entities, triples, notes and vectors of it stay behind, as audits show."""
        ids = self["assets"].where(F.col("id") == id_).select("id")
        tables = {n: self._gone(n, "asset_id", ids) for n in ("jobs", "extractions", "transcriptions", "layouts", "annotations")}
        return self.set(assets=self._gone("assets", "id", ids), **tables)

    def _delete_items(self, ids: DataFrame) -> Store:
        assets = self["assets"].join(ids.toDF("item_id"), "item_id", "left_semi").select("id")
        tables = {n: self._gone(n, "asset_id", assets) for n in ("jobs", "extractions", "transcriptions", "layouts", "annotations")}
        tables |= {n: self._gone(n, "item_id", ids) for n in ("notes", "entities", "triples", "item_topics", "vec_assets", "assets")}
        results = self["llm_results"]
        for kind, gone in (("item", ids), ("asset", assets)):
            results = results.join(gone.toDF("__gone"), (F.col("target_type") == kind) & (F.col("target_id") == F.col("__gone")), "left_anti")
        return self.set(items=self._gone("items", "id", ids), llm_results=results, **tables)

    def delete_item(self, id_: str) -> Store:
        """An item with all that hangs on it, and its collection when that becomes empty."""
        own = self["items"].where(F.col("id") == id_)
        after = self._delete_items(own.select("id"))
        emptied = own.select("collection_id").join(after["items"].select("collection_id"), "collection_id", "left_anti")
        return after.set(collections=after._gone("collections", "id", emptied))

    def delete_collection(self, id_: str) -> Store:
        after = self._delete_items(self["items"].where(F.col("collection_id") == id_).select("id"))
        results = after["llm_results"].where(~((F.col("target_type") == "collection") & (F.col("target_id") == id_)))
        return after.set(llm_results=results).delete("collections", F.col("id") == id_)

    def delete_if_empty(self, id_: str) -> Store:
        used = self["items"].where(F.col("collection_id") == id_).select("collection_id").distinct()
        gone = self["collections"].where(F.col("id") == id_).select("id").join(used.toDF("id"), "id", "left_anti")
        return self.set(collections=self._gone("collections", "id", gone))

    # audits

    def orphans(self) -> DataFrame:
        """(audit, orphans) for each reference between tables."""
        ids = lambda name: self[name].select(F.col("id").alias("__of"))

        def count(name: str, child: DataFrame) -> DataFrame:
            return child.agg(F.count(F.lit(1)).alias("orphans")).select(F.lit(name).alias("audit"), "orphans")

        def lost(child: str, column: str, parent: str) -> DataFrame:
            return self[child].where(F.col(column).isNotNull()).join(ids(parent), F.col(column) == F.col("__of"), "left_anti")

        out = count("assets", lost("assets", "item_id", "items"))
        for name, column, parent in (("items", "collection_id", "collections"), ("notes", "asset_id", "assets"), ("entities", "asset_id", "assets"), ("triples", "asset_id", "assets")):
            out = out.unionByName(count(name, lost(name, column, parent)))
        vectors = lost("vec_assets", "asset_id", "assets").select("asset_id").union(lost("vec_assets", "item_id", "items").select("asset_id")).distinct()
        results = self["llm_results"]
        for kind, parent in (("asset", "assets"), ("item", "items"), ("collection", "collections")):
            results = results.join(ids(parent), (F.col("target_type") == kind) & (F.col("target_id") == F.col("__of")), "left_anti")
        return out.unionByName(count("vec_assets", vectors)).unionByName(count("llm_results", results))

    def outputs(self) -> DataFrame:
        """(asset_id, type, extraction, transcription, layout): which assets have which output, yes or no; a row an asset."""
        out = self["assets"].select(F.col("id").alias("asset_id"), "type")
        for table, name in (("extractions", "extraction"), ("transcriptions", "transcription"), ("layouts", "layout")):
            has = self[table].select("asset_id").distinct().withColumn(name, F.lit("yes"))
            out = out.join(has, "asset_id", "left").withColumn(name, F.coalesce(name, F.lit("no")))
        return out

    def markers(self, item: str) -> DataFrame:
        """Resolved places of an item with both coordinates."""
        return self.of_item("entities", item).where("entity_type = 'place' and latitude is not null and longitude is not null")

    def pending_places(self, item: str) -> DataFrame:
        return self.of_item("entities", item).where("entity_type = 'place' and geo_status = 'pending'")
