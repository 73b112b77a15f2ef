"""Registered queries of the repositories: reads, writes, cascades and audits over the corpus tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillet.operators.store import affected, newest
from quillet.plans.registry import query
from quillet.sources import corpus
from quillet.sources import schemas

# The corpus tables in SQL, as ``corpus.store`` makes them.
_COLLECTIONS = "(SELECT 'n' || n_nationkey AS id, n_name AS name, n_nationkey::BIGINT AS created_at, n_nationkey::BIGINT * 10 AS updated_at FROM nation)"
_ITEMS = """(SELECT 'c' || c_custkey AS id, c_name AS title, 'n' || c_nationkey AS collection_id, '{"seg": "' || c_mktsegment || '"}' AS metadata, c_custkey AS created_at, c_custkey % 97 AS updated_at FROM customer)"""
_ASSETS = "(SELECT 'o' || o_orderkey AS id, 'c' || o_custkey AS item_id, '/data/assets/' || o_orderkey || '.png' AS path, ['image', 'pdf', 'audio'][o_orderkey % 3 + 1] AS type, o_orderkey AS created_at, o_orderkey % 5 AS sort_index FROM orders)"
_LINE = "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey"
_EXTRACTIONS = f"(SELECT 'e' || {_LINE} AS id, 'o' || l_orderkey AS asset_id, 't' || l_partkey AS text_content, l_partkey AS created_at FROM lineitem WHERE l_returnflag = 'A')"
_TRANSCRIPTIONS = f"(SELECT 't' || {_LINE} AS id, 'o' || l_orderkey AS asset_id, 's' || l_suppkey AS text_content, l_partkey AS created_at FROM lineitem WHERE l_returnflag = 'R')"
_LAYOUTS = "(SELECT 'o' || l_orderkey AS asset_id FROM lineitem WHERE l_returnflag = 'N' AND l_linenumber = 1)"
_ENTITIES = """(SELECT 'x' || o_orderkey AS id, 'c' || o_custkey AS item_id, ['person', 'organization', 'place', 'date', 'misc'][o_orderkey % 5 + 1] AS entity_type, 'v' || (o_orderkey % 13) AS value, o_orderkey % 41 AS start_offset,
    ['rule_based', 'onnx', 'manual', 'manual_deleted', NULL][o_orderkey // 2 % 5 + 1] AS source, o_orderkey AS created_at, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey * 0.5::DOUBLE END AS latitude, CASE WHEN o_orderkey % 4 = 0 THEN 'resolved' ELSE 'pending' END AS geo_status,
    CASE WHEN o_orderkey % 3 > 0 THEN 'o' || (o_orderkey + o_orderkey % 2) END AS asset_id FROM orders)"""
_TRIPLES = "(SELECT 'r' || o_orderkey AS id, 'c' || o_custkey AS item_id, 's' || (o_orderkey % 7) AS subject, o_orderkey AS created_at, CASE WHEN o_orderkey % 2 = 0 THEN 'o' || o_orderkey END AS asset_id FROM orders)"
_NOTES = "(SELECT 'm' || o_orderkey AS id, 'c' || o_custkey AS item_id, o_orderkey AS created_at, CASE WHEN o_orderkey % 2 = 0 THEN 'o' || (o_orderkey * 3) END AS asset_id FROM orders WHERE o_orderkey % 5 = 0)"
_ANNOTATIONS = f"(SELECT 'a' || {_LINE} AS id, 'o' || l_orderkey AS asset_id, l_linenumber::BIGINT AS page, l_partkey AS created_at, l_suppkey AS updated_at FROM lineitem WHERE l_linenumber <= 3)"
_TOPICS = "(SELECT DISTINCT 'topic-' || sha256(upper(trim(p_brand))) AS id, upper(trim(p_brand)) AS name FROM part)"
_LINKS = "(SELECT 'c' || c_custkey AS item_id, 'topic-' || sha256(upper(trim(p_brand))) AS topic_id FROM customer JOIN part ON p_partkey = c_custkey)"
_JOBS = "(SELECT 'j' || event_id AS id, event_type AS type, ['pending', 'running', 'complete', 'error'][event_id % 4 + 1] AS status, 'o' || user_id AS asset_id, event_id AS created_at FROM events)"
_RESULTS = "(SELECT 'q' || event_id AS id, ['o', 'c', 'n', 'z'][event_id % 4 + 1] || user_id AS target_id, ['asset', 'item', 'collection', 'unknown'][event_id % 4 + 1] AS target_type, event_type AS job_type, event_id AS created_at FROM events)"
_VECTORS = "(SELECT 'o' || vec_id AS asset_id, 'c' || label AS item_id FROM embeddings)"
_VISIBLE = "(source IS NULL OR source <> 'manual_deleted')"
_MANUAL = "coalesce(source, '') IN ('manual', 'manual_deleted')"


@query(f"SELECT id, name FROM {_COLLECTIONS} WHERE id = 'n3' UNION ALL SELECT id, title FROM {_ITEMS} WHERE id = 'c7' UNION ALL SELECT id, path FROM {_ASSETS} WHERE id = 'o9'")
def store_find_by_id(spark, sf):
    s = corpus.store(spark, sf)
    out = s.find("collections", "n3").select("id", "name")
    return out.unionByName(s.find("items", "c7").select("id", F.col("title").alias("name"))).unionByName(s.find("assets", "o9").select("id", F.col("path").alias("name")))


@query(f"SELECT id, title, updated_at FROM {_ITEMS} WHERE collection_id = 'n4'")
def store_items_of_collection(spark, sf):
    return corpus.store(spark, sf).items_of("n4").select("id", "title", "updated_at")


@query(f"SELECT id, type, sort_index, row_number() OVER (ORDER BY sort_index, created_at) AS place FROM {_ASSETS} WHERE item_id = 'c10'")
def store_assets_of_item(spark, sf):
    rows = corpus.store(spark, sf).assets_of("c10").select("id", "type", "sort_index")
    return rows.withColumn("place", F.monotonically_increasing_id() + 1).withColumn("place", F.row_number().over(_by("place")).cast("long"))


def _by(*columns):
    from pyspark.sql.window import Window

    return Window.orderBy(*columns)  # rows of one item


@query(f"SELECT id, name FROM {_COLLECTIONS} WHERE contains(lower(name), 'n')")
def store_collection_name_contains(spark, sf):
    return corpus.store(spark, sf).collection_named("N").select("id", "name")


@query(f"SELECT collection_id, count(*) AS items, max(created_at) AS newest FROM (SELECT collection_id, created_at FROM {_ITEMS} UNION ALL SELECT 'n1', 999999) GROUP BY collection_id")
def store_create_item(spark, sf):
    s = corpus.store(spark, sf).create_item({"id": "c-new", "title": "New", "collection_id": "n1"}, 999999)
    return s["items"].groupBy("collection_id").agg(F.count(F.lit(1)).alias("items"), F.max("created_at").alias("newest"))


@query(f"SELECT id, CASE WHEN id = 'c5' THEN 'Renamed' ELSE title END AS title, metadata, CASE WHEN id = 'c5' THEN 12345 ELSE updated_at END AS updated_at FROM {_ITEMS}")
def store_update_item(spark, sf):
    return corpus.store(spark, sf).update_item("c5", 12345, title="Renamed")["items"].select("id", "title", "metadata", "updated_at")


@query("SELECT 1::BIGINT AS changed, 1::BIGINT AS added, 1::BIGINT AS removed")
def store_rows_affected(spark, sf):
    s = corpus.store(spark, sf)
    counts = [affected(s["collections"], after["collections"]) for after in (s.update_collection("n1", 1, name="X"), s.create_collection({"id": "n99", "name": "Y"}, 2), s.delete("collections", F.col("id") == "n2"))]
    return spark.createDataFrame([tuple(counts)], "changed bigint, added bigint, removed bigint")


@query(f"SELECT id, entity_type, value FROM {_ENTITIES} WHERE item_id = 'c10' AND (asset_id = 'o2' OR asset_id IS NULL) AND {_VISIBLE}")
def store_entities_in_scope(spark, sf):
    return corpus.store(spark, sf).in_scope("entities", "c10", "o2").select("id", "entity_type", "value")


@query(f"SELECT coalesce(CASE WHEN id = 'x8' THEN 'manual_deleted' ELSE source END, 'none') AS source, count(*) AS n FROM {_ENTITIES} GROUP BY 1")
def store_soft_delete_entity(spark, sf):
    return corpus.store(spark, sf).soft_delete_entity("x8")["entities"].groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT count(*) AS rows, count_if({_MANUAL})::BIGINT AS manual FROM {_ENTITIES} WHERE item_id <> 'c10' OR {_MANUAL}")
def store_delete_automatic(spark, sf):
    e = corpus.store(spark, sf).delete_automatic("c10")["entities"]
    return e.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce("source", F.lit("")).isin("manual", "manual_deleted")).alias("manual"))


@query(f"SELECT id, item_id, subject FROM {_TRIPLES} WHERE NOT (item_id = 'c10' AND asset_id IS NOT NULL AND asset_id = (SELECT min(asset_id) FROM {_TRIPLES} WHERE item_id = 'c10')) UNION ALL SELECT 'r-new', 'c10', 'we'")
def store_replace_triples(spark, sf):
    s = corpus.store(spark, sf)
    asset = s["triples"].where("item_id = 'c10'").agg(F.min("asset_id")).first()[0] or "none"
    new = spark.createDataFrame([("r-new", "c10", "we", "are", "here", 1, asset)], schemas.schema("triples"))
    return s.replace_triples(new, "c10", asset)["triples"].select("id", "item_id", "subject")


@query(f"SELECT id, page FROM {_ANNOTATIONS} WHERE asset_id = 'o2' AND page = 1 UNION ALL SELECT id, -page FROM {_ANNOTATIONS} WHERE asset_id = 'o3'")
def store_annotations_by_page(spark, sf):
    s = corpus.store(spark, sf)
    return s.annotations("o2", 1).select("id", "page").unionByName(s.annotations("o3").select("id", (-F.col("page")).alias("page")))


@query(f"SELECT id, asset_id, page FROM {_ANNOTATIONS} WHERE NOT (asset_id = 'o2' AND page = 1) UNION ALL SELECT 'a-new', 'o2', 1")
def store_replace_annotations(spark, sf):
    new = spark.createDataFrame([("a-new", "o2", 1, "rectangle", "red", 0.0, 0.0, 1.0, 1.0, 1, 1)], schemas.schema("annotations"))
    return corpus.store(spark, sf).replace_annotations(new, "o2", 1)["annotations"].select("id", "asset_id", "page")


@query(f"SELECT id, asset_id, text_content FROM {_EXTRACTIONS} QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY created_at DESC, id DESC) = 1")
def store_newest_extraction(spark, sf):
    return newest(corpus.store(spark, sf)["extractions"], "asset_id").select("id", "asset_id", "text_content")


@query(f"""
    WITH n AS (SELECT 'new-' || asset_id AS id, asset_id FROM (SELECT DISTINCT asset_id FROM {_EXTRACTIONS}) WHERE asset_id LIKE '%1' UNION ALL SELECT 'new-x', 'x'),
    f AS (SELECT asset_id, id FROM {_EXTRACTIONS} QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY created_at DESC, id DESC) = 1)
    SELECT id, asset_id, text_content FROM {_EXTRACTIONS} WHERE asset_id NOT IN (SELECT asset_id FROM n) UNION ALL SELECT coalesce(f.id, n.id), n.asset_id, 'again' FROM n LEFT JOIN f USING (asset_id)
""")
def store_upsert_extraction(spark, sf):
    s = corpus.store(spark, sf)
    keys = s["extractions"].select("asset_id").distinct().where("asset_id like '%1'").union(spark.createDataFrame([("x",)], "asset_id string"))
    new = keys.select(F.concat(F.lit("new-"), "asset_id").alias("id"), "asset_id", F.lit("again").alias("text_content"), F.lit("ocr").alias("method"), F.lit(1.0).alias("confidence"), F.lit(0).cast("long").alias("created_at"))
    return s.upsert("extractions", new)["extractions"].select("id", "asset_id", "text_content")


@query(f"SELECT asset_id, count(*) AS n, min(id) AS id FROM (SELECT id, asset_id FROM {_TRANSCRIPTIONS} WHERE asset_id <> 'o2' UNION ALL SELECT 'fresh', 'o2') GROUP BY asset_id")
def store_put_transcription(spark, sf):
    new = spark.createDataFrame([("fresh", "o2", "t", None, None, "m", "[]", None, 1)], schemas.schema("transcriptions"))
    return corpus.store(spark, sf).put("transcriptions", new)["transcriptions"].groupBy("asset_id").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))


@query(f"SELECT id, CASE WHEN id = (SELECT id FROM {_EXTRACTIONS} WHERE asset_id = 'o3' ORDER BY created_at DESC, id DESC LIMIT 1) THEN 'mended' ELSE text_content END AS text_content FROM {_EXTRACTIONS}")
def store_update_text(spark, sf):
    return corpus.store(spark, sf).update_text("extractions", "o3", "mended")["extractions"].select("id", "text_content")


@query(f"SELECT name FROM {_TOPICS} UNION SELECT 'FRESH' AS name")
def store_ensure_topics(spark, sf):
    return corpus.store(spark, sf).ensure_topics([" brand#11 ", "fresh", "Fresh", " "], 5)["topics"].select("name")


@query(f"SELECT item_id, count(*) AS topics FROM (SELECT item_id, topic_id FROM {_LINKS} UNION SELECT 'c3', 'topic-' || sha256(x) FROM (VALUES ('BRAND#12'), ('NEW ONE')) v(x)) GROUP BY item_id")
def store_link_topics(spark, sf):
    s = corpus.store(spark, sf).link_topics("c3", ["new one", "Brand#12", "NEW ONE"], 5).link_topics("c3", ["New one"], 6)
    return s["item_topics"].groupBy("item_id").agg(F.count(F.lit(1)).alias("topics"))


@query(f"SELECT t.name, (SELECT count(*) FROM {_LINKS} x WHERE x.topic_id = t.id) AS items FROM {_LINKS} l JOIN {_TOPICS} t ON t.id = l.topic_id WHERE l.item_id = 'c4'")
def store_topics_of_item(spark, sf):
    s = corpus.store(spark, sf)
    counts = s["item_topics"].groupBy(F.col("topic_id").alias("id")).agg(F.count(F.lit(1)).alias("items"))
    return s.topics_of("c4").join(counts, "id").select("name", "items")


@query(f"SELECT count(*) AS links, count_if(item_id = 'c4')::BIGINT AS of_item FROM {_LINKS} WHERE item_id <> 'c4'")
def store_unlink_topics(spark, sf):
    return corpus.store(spark, sf).unlink_topic("c4")["item_topics"].agg(F.count(F.lit(1)).alias("links"), F.count_if(F.col("item_id") == "c4").alias("of_item"))


@query(f"""SELECT id, CASE WHEN id = 'j4' THEN 'running' ELSE status END AS status, CASE WHEN id = 'j4' THEN 40 END AS progress FROM {_JOBS}""")
def store_update_job(spark, sf):
    from quillet.functions.jsons import progress_of

    j = corpus.store(spark, sf).update_job("j4", 77, status="running", progress=40)["jobs"]
    return j.select("id", "status", progress_of(F.col("result")).alias("progress"))


@query(f"SELECT id, asset_id FROM {_JOBS} QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY created_at DESC, id DESC) = 1")
def store_newest_job(spark, sf):
    return newest(corpus.store(spark, sf)["jobs"], "asset_id").select("id", "asset_id")


@query(f"SELECT id, target_id, target_type, job_type, created_at, NULL AS written FROM {_RESULTS} UNION ALL SELECT 'llr-asset-o1-summary', 'o1', 'asset', 'summary', 9, 'second'")
def store_put_result(spark, sf):
    s = corpus.store(spark, sf).put_result("o1", "asset", "summary", "first", 8).put_result("o1", "asset", "summary", "second", 9)
    return s["llm_results"].select("id", "target_id", "target_type", "job_type", "created_at", F.when(F.col("id").startswith("llr-"), F.col("result")).alias("written"))


@query("SELECT n_name AS key, CASE WHEN n_nationkey = 1 THEN 'set' ELSE n_regionkey::VARCHAR END AS value FROM nation WHERE n_nationkey < 5 AND n_nationkey <> 2")
def store_settings(spark, sf):
    s = corpus.store(spark, sf)
    names = {r["n_nationkey"]: r["n_name"] for r in corpus.read(spark, sf, "nation").where("n_nationkey in (1, 2)").collect()}  # two settings
    return s.setting(names[1], "set").setting(names[2], delete=True).settings()


_LEFT = """SELECT 'assets' AS kind, count(*) AS n FROM {assets} WHERE {asset} UNION ALL SELECT 'items', count(*) FROM {items} WHERE {item} UNION ALL SELECT 'collections', count(*) FROM {collections} WHERE {collection} UNION ALL SELECT 'extractions', count(*) FROM {extractions} WHERE {on_asset}
    UNION ALL SELECT 'entities', count(*) FROM {entities} WHERE {of_item} UNION ALL SELECT 'notes', count(*) FROM {notes} WHERE {of_item} UNION ALL SELECT 'vec_assets', count(*) FROM {vectors} WHERE {of_item} UNION ALL SELECT 'llm_results', count(*) FROM {results} WHERE {result}"""


def _left(**where: str) -> str:
    return _LEFT.format(assets=_ASSETS, items=_ITEMS, collections=_COLLECTIONS, extractions=_EXTRACTIONS, entities=_ENTITIES, notes=_NOTES, vectors=_VECTORS, results=_RESULTS, **({k: "TRUE" for k in ("asset", "item", "collection", "on_asset", "of_item", "result")} | where))


def _counted(s):
    names = ("assets", "items", "collections", "extractions", "entities", "notes", "vec_assets", "llm_results")
    rows = [s[n].agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("kind"), "n") for n in names]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query(_left(asset="id <> 'o4'", on_asset="asset_id <> 'o4'"))
def store_delete_asset(spark, sf):
    return _counted(corpus.store(spark, sf).delete_asset("o4"))


_OF_ITEM = f"(SELECT id FROM {_ASSETS} WHERE item_id = 'c10')"


@query(_left(asset="item_id <> 'c10'", item="id <> 'c10'", on_asset=f"asset_id NOT IN {_OF_ITEM}", of_item="item_id <> 'c10'", result=f"NOT (target_type = 'item' AND target_id = 'c10') AND NOT (target_type = 'asset' AND target_id IN {_OF_ITEM})", collection=f"id <> (SELECT collection_id FROM {_ITEMS} WHERE id = 'c10') OR (SELECT count(*) FROM {_ITEMS} WHERE collection_id = (SELECT collection_id FROM {_ITEMS} WHERE id = 'c10')) > 1"))
def store_delete_item(spark, sf):
    return _counted(corpus.store(spark, sf).delete_item("c10"))


_IN_COLLECTION = f"(SELECT id FROM {_ITEMS} WHERE collection_id = 'n4')"
_ITS_ASSETS = f"(SELECT id FROM {_ASSETS} WHERE item_id IN {_IN_COLLECTION})"


@query(_left(asset=f"item_id NOT IN {_IN_COLLECTION}", item="collection_id <> 'n4'", collection="id <> 'n4'", on_asset=f"asset_id NOT IN {_ITS_ASSETS}", of_item=f"item_id NOT IN {_IN_COLLECTION}", result=f"NOT (target_type = 'item' AND target_id IN {_IN_COLLECTION}) AND NOT (target_type = 'asset' AND target_id IN {_ITS_ASSETS}) AND NOT (target_type = 'collection' AND target_id = 'n4')"))
def store_delete_collection(spark, sf):
    return _counted(corpus.store(spark, sf).delete_collection("n4"))


@query(f"SELECT id FROM {_COLLECTIONS} WHERE id <> 'n7' OR EXISTS (SELECT 1 FROM {_ITEMS} WHERE collection_id = 'n7')")
def store_delete_if_empty(spark, sf):
    s = corpus.store(spark, sf).create_collection({"id": "n-empty", "name": "E"}, 1)
    return s.delete_if_empty("n7").delete_if_empty("n-empty")["collections"].select("id")


@query(f"""
    SELECT 'assets' AS audit, count(*) AS orphans FROM {_ASSETS} WHERE item_id NOT IN (SELECT id FROM {_ITEMS}) UNION ALL SELECT 'items', count(*) FROM {_ITEMS} WHERE collection_id NOT IN (SELECT id FROM {_COLLECTIONS})
    UNION ALL SELECT 'notes', count(*) FROM {_NOTES} WHERE asset_id IS NOT NULL AND asset_id NOT IN (SELECT id FROM {_ASSETS}) UNION ALL SELECT 'entities', count(*) FROM {_ENTITIES} WHERE asset_id IS NOT NULL AND asset_id NOT IN (SELECT id FROM {_ASSETS})
    UNION ALL SELECT 'triples', count(*) FROM {_TRIPLES} WHERE asset_id IS NOT NULL AND asset_id NOT IN (SELECT id FROM {_ASSETS}) UNION ALL SELECT 'vec_assets', count(*) FROM {_VECTORS} WHERE asset_id NOT IN (SELECT id FROM {_ASSETS}) OR item_id NOT IN (SELECT id FROM {_ITEMS})
    UNION ALL SELECT 'llm_results', count(*) FROM {_RESULTS} WHERE (target_type = 'asset' AND target_id NOT IN (SELECT id FROM {_ASSETS})) OR (target_type = 'item' AND target_id NOT IN (SELECT id FROM {_ITEMS})) OR (target_type = 'collection' AND target_id NOT IN (SELECT id FROM {_COLLECTIONS})) OR target_type = 'unknown'
""")
def store_orphan_audits(spark, sf):
    return corpus.store(spark, sf).orphans()


@query(f"SELECT id AS asset_id, type, " + ", ".join(f"CASE WHEN id IN (SELECT asset_id FROM {t}) THEN 'yes' ELSE 'no' END AS {n}" for t, n in ((_EXTRACTIONS, "extraction"), (_TRANSCRIPTIONS, "transcription"), (_LAYOUTS, "layout"))) + f" FROM {_ASSETS}")
def asset_output_matrix(spark, sf):
    return corpus.store(spark, sf).outputs()


@query(f"SELECT id, 'marker' AS kind FROM {_ENTITIES} WHERE item_id = 'c10' AND {_VISIBLE} AND entity_type = 'place' AND latitude IS NOT NULL UNION ALL SELECT id, 'pending' FROM {_ENTITIES} WHERE item_id = 'c10' AND {_VISIBLE} AND entity_type = 'place' AND geo_status = 'pending'")
def store_places_of_item(spark, sf):
    s = corpus.store(spark, sf)
    return s.markers("c10").select("id", F.lit("marker").alias("kind")).unionByName(s.pending_places("c10").select("id", F.lit("pending").alias("kind")))


@query(f"SELECT item_id, count_if(geo = 'resolved')::BIGINT AS resolved, count_if(geo = 'not_found')::BIGINT AS not_found, count_if(geo = 'pending')::BIGINT AS pending FROM (SELECT item_id, CASE WHEN geo_status <> 'pending' THEN geo_status WHEN value IN ('v1', 'v2', 'v3') THEN 'resolved' ELSE 'not_found' END AS geo FROM {_ENTITIES} WHERE entity_type = 'place') GROUP BY item_id")
def geocode_job_counts(spark, sf):
    from quillet.plugins import geocode_counts, geocoded

    gazetteer = spark.createDataFrame([(f"v{i}", float(i), -float(i)) for i in (1, 2, 3, 3)], "value string, latitude double, longitude double")
    return geocode_counts(geocoded(corpus.store(spark, sf)["entities"], gazetteer))


_TABLES = {
    "collections": _COLLECTIONS, "items": _ITEMS, "assets": _ASSETS, "notes": _NOTES, "jobs": _JOBS, "extractions": _EXTRACTIONS, "transcriptions": _TRANSCRIPTIONS, "entities": _ENTITIES, "triples": _TRIPLES,
    "topics": _TOPICS, "item_topics": _LINKS, "vec_assets": _VECTORS, "layouts": _LAYOUTS, "llm_results": _RESULTS, "annotations": _ANNOTATIONS,
}


@query(" UNION ALL ".join(f"SELECT {k + 1} AS place, '{n}' AS name, (SELECT count(*) FROM {q}) AS \"rows\"" for k, (n, q) in enumerate(_TABLES.items())))
def browser_tables(spark, sf):
    s, out = corpus.store(spark, sf), None
    for k, name in enumerate(corpus.table_list(s.tables), 1):
        row = s[name].agg(F.count(F.lit(1)).alias("rows")).select(F.lit(k).alias("place"), F.lit(name).alias("name"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, '{t}' AS type, {n == 'id'} AS is_primary_key, (SELECT count({n}) FROM {_ITEMS}) AS present, (SELECT count(DISTINCT {n}) FROM {_ITEMS}) AS different" for n, t in (("id", "string"), ("title", "string"), ("collection_id", "string"), ("metadata", "string"), ("created_at", "bigint"), ("updated_at", "bigint"))))
def browser_describe(spark, sf):
    items = corpus.store(spark, sf)["items"]
    found = corpus.described("items", items)
    counts = items.agg(*[f(c["name"]).alias(f"{n}_{c['name']}") for c in found for n, f in (("p", F.count), ("d", F.countDistinct))])  # one row
    rows = F.explode(F.array(*[F.struct(F.lit(c["name"]).alias("name"), F.lit(c["type"]).alias("type"), F.lit(c["is_primary_key"]).alias("is_primary_key"), F.col(f"p_{c['name']}").alias("present"), F.col(f"d_{c['name']}").alias("different")) for c in found]))
    return counts.select(rows.alias("r")).select("r.*")


@query("SELECT '{\"n_nationkey\":' || n_nationkey || ',\"raw\":\"' || base64(n_name::BLOB) || '\",\"none\":null}' AS row FROM nation")
def browser_rows_as_json(spark, sf):
    return corpus.as_json(corpus.read(spark, sf, "nation").select("n_nationkey", F.col("n_name").cast("binary").alias("raw"), F.lit(None).cast("string").alias("none")))
