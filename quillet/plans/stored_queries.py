"""Registered queries over what is written first: the item index and stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillet.operators import enrich
from quillet.operators.item_index import ItemIndex, canonical_items
from quillet.operators.similarity import similar_all
from quillet.operators.tables import StoredTable
from quillet.operators.entities import TRIPLE, VERBS
from quillet.plans import store_queries as sq
from quillet.plans.corpus_queries import _NOTE, _PATTERNS, STRICT, _bm25
from quillet.plans.registry import query
from quillet.operators import search as fts
from quillet.sources import corpus
from quillet.sources.corpus import read
from quillet.sources.shared import new_path


@query(_bm25(STRICT).replace("doc_id, source, round", "doc_id, round"))
def fts_search_stored(spark, sf):
    path = new_path(spark, "text-index")
    fts.write_index(read(spark, sf, "documents"), path)
    return fts.stored_search(spark, path, STRICT)


def _items_sql(terms: list[str], fields: str = "t, m, x") -> str:
    """Ranks of the three columns' phrases, after the batches of ``_indexed``."""
    words = lambda c: rf"regexp_extract_all(lower(strip_accents(coalesce({c}, ''))), '[\p{{L}}\p{{N}}]+')"
    held = lambda f, w: f"len(list_filter(range(1, len({f}) + 1), lambda i: {' AND '.join(f"{f}[i + {k}] = '{v}'" for k, v in enumerate(w.split()))}))"
    tf = ", ".join("(" + " + ".join(held(f, w) for f in fields.split(", ")) + f") AS t{k}" for k, w in enumerate(terms))
    n = len(terms)
    part = " + ".join(f"CASE WHEN ln((n - d{i} + 0.5) / (d{i} + 0.5)) > 0 THEN ln((n - d{i} + 0.5) / (d{i} + 0.5)) ELSE 1e-6 END * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * l / (total / n)))" for i in range(n))
    full, some = (j.join(f"t{i} > 0" for i in range(n)) for j in (" AND ", " OR "))
    return f"""
        WITH items AS (
            SELECT CAST(doc_id AS VARCHAR) AS item_id, 'Legajo ' || coalesce(source, '') || CASE WHEN source = 'src3' THEN ' copia nueva' ELSE '' END AS title, '{{"lang": "' || coalesce(lang, '') || '"}}' AS metadata,
                CASE WHEN source = 'src3' THEN substr(text, 1, 400) || ' the trash' ELSE text END AS text
            FROM documents WHERE source IS DISTINCT FROM 'src5'),
        w AS (SELECT item_id, {words('title')} AS t, {words('metadata')} AS m, {words('text')} AS x FROM items),
        c AS (SELECT item_id, len(t) + len(m) + len(x) AS l, {tf} FROM w),
        f AS (SELECT count(*)::DOUBLE AS n, sum(l)::DOUBLE AS total, {", ".join(f"count_if(t{i} > 0)::DOUBLE AS d{i}" for i in range(n))}, count_if({full}) AS nf FROM c)
        SELECT item_id, round(-({part}), 6) AS rank, CASE WHEN nf = 0 AND {n} > 1 THEN 'relaxed' ELSE 'strict' END AS strategy
        FROM c, f WHERE ({full}) OR (nf = 0 AND ({some})) ORDER BY rank, item_id LIMIT 50
    """


def _indexed(spark, sf) -> ItemIndex:
    """Every document as an item; those of one source indexed anew with other titles and texts, those of another taken out."""
    docs = read(spark, sf, "documents")
    items = docs.select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("Legajo "), F.coalesce("source", F.lit(""))).alias("title"), F.concat(F.lit('{"lang": "'), F.coalesce("lang", F.lit("")), F.lit('"}')).alias("metadata"), "source")
    texts = docs.select(F.col("doc_id").cast("string").alias("item_id"), F.lit(0).alias("source_order"), F.lit(0).alias("sort_index"), F.lit(0).alias("created_at"), "text")
    index = ItemIndex(spark, new_path(spark, "item-index"))
    index.add(canonical_items(items, texts))
    again = items.where("source = 'src3'").withColumn("title", F.concat("title", F.lit(" copia nueva")))
    fresh = texts.withColumn("text", F.concat(F.substring("text", 1, 400), F.lit(" the trash")))
    index.add(canonical_items(again, fresh, again.select(F.col("id").alias("item_id"))))
    index.remove(items.where("source = 'src5'").select(F.col("id").alias("item_id")))
    return index


@query(_items_sql(["copia nueva", "trash"]))
def item_index_increments(spark, sf):
    return _indexed(spark, sf).search(["copia-nueva", "trash"], 50)


@query(_items_sql(["legajo src3", "lang en", "zzqq"]))
def item_index_merged_relaxed(spark, sf):
    index = _indexed(spark, sf)
    index.merge()
    return index.search(["legajo src3", "lang: en", "zzqq"], 50)


@query(_items_sql(["src7"], "t"))
def item_index_title_only(spark, sf):
    return _indexed(spark, sf).search(["src7"], 50, fields=("title",))


@query("""
    SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE o_orderpriority END AS state, o_orderdate AS created_at, CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 1 ELSE o_totalprice END AS price FROM orders
    UNION ALL SELECT -1 - c_custkey, 'new', DATE '1990-01-01', c_acctbal FROM customer
""")
def stored_upsert(spark, sf):
    orders = read(spark, sf, "orders")
    rows = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("state"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("price"))
    kept = StoredTable.create(rows, new_path(spark, "orders"), "id", 16)
    day = F.lit("1990-01-01").cast(rows.schema["created_at"].dataType)
    kept.upsert(orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.lit("closed").alias("state"), day.alias("created_at"), (F.col("o_totalprice") + 1).alias("price")), ["created_at"])
    kept.upsert(read(spark, sf, "customer").select((-1 - F.col("c_custkey")).alias("id"), F.lit("new").alias("state"), day.alias("created_at"), F.col("c_acctbal").alias("price")))
    return StoredTable(spark, kept.path).read()


@query("""
    WITH t AS (SELECT o_custkey AS item_id, o_orderkey % 3 AS asset_id, o_orderkey AS id, o_orderpriority AS value FROM orders)
    SELECT * FROM (SELECT * FROM t WHERE asset_id <> 1 UNION ALL SELECT DISTINCT item_id, asset_id, -item_id, 'automatic' FROM t WHERE asset_id = 1)
    WHERE item_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)
""")
def stored_replace_and_cascade(spark, sf):
    rows = read(spark, sf, "orders").select(F.col("o_custkey").alias("item_id"), (F.col("o_orderkey") % 3).alias("asset_id"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("value"))
    kept = StoredTable.create(rows, new_path(spark, "entities"), "item_id", 16)
    fresh = rows.where("asset_id = 1").select("item_id", "asset_id").distinct().select("item_id", "asset_id", (-F.col("item_id")).alias("id"), F.lit("automatic").alias("value"))
    kept.replace(fresh, ["item_id", "asset_id"])
    kept.delete(read(spark, sf, "customer").where("c_nationkey = 3").select("c_custkey"))
    return StoredTable(spark, kept.path).read()


@query("""
    WITH s AS (SELECT a.vec_id, b.vec_id AS similar_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
    SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, similar_id) AS INTEGER) AS rank, similar_id, similarity FROM s QUALIFY rank <= 5
""")
def similar_assets_all_pairs(spark, sf):
    return similar_all(read(spark, sf, "embeddings"))


def _passages(spark, sf):
    """The corpus store, its assets' extractions being passages."""
    s = corpus.store(spark, sf)
    text = corpus.notes_text(spark, sf).select(F.concat(F.lit("e"), F.col("doc_id").cast("string")).alias("id"), F.concat(F.lit("o"), F.col("doc_id").cast("string")).alias("asset_id"), F.col("text").alias("text_content"), F.col("doc_id").alias("created_at"))
    rows = text.withColumns({"method": F.lit("ocr"), "confidence": F.lit(1.0)})
    return s.set(extractions=rows.select(*s["extractions"].columns))


_FOUND = " UNION ALL ".join(f"SELECT doc_id, '{name}' AS entity_type, unnest(regexp_extract_all(text, '{p}')) AS value, text FROM {_NOTE}" for name, p in _PATTERNS)


@query(f"""
    WITH m AS ({_FOUND}),
    c AS (SELECT 'c' || o_custkey AS item_id, 'o' || doc_id AS asset_id, entity_type, value, strpos(text, value) - 1 AS start_offset, strpos(text, value) - 1 + length(value) AS end_offset, 1.0::DOUBLE AS confidence, 'rule_based' AS source FROM m JOIN orders ON o_orderkey = doc_id),
    e AS (SELECT *, start_offset + 5 AS end_offset, (o % 100) / 100.0::DOUBLE AS confidence FROM (SELECT *, CAST(substr(id, 2) AS BIGINT) AS o FROM {sq._ENTITIES})),
    g AS (SELECT c.*, CASE WHEN entity_type = 'institution' THEN 'organization' ELSE entity_type END AS g FROM c)
    SELECT item_id, asset_id, entity_type, value, start_offset, end_offset, confidence, source FROM e WHERE {sq._MANUAL} OR NOT EXISTS (SELECT 1 FROM orders WHERE 'c' || o_custkey = e.item_id AND 'o' || o_orderkey = e.asset_id)
    UNION ALL SELECT item_id, asset_id, entity_type, value, start_offset, end_offset, confidence, source FROM g WHERE NOT EXISTS (
        SELECT 1 FROM e p WHERE {sq._MANUAL.replace("source", "p.source")} AND p.item_id = g.item_id AND CASE WHEN p.entity_type = 'institution' THEN 'organization' ELSE p.entity_type END = g.g AND (lower(p.value) = lower(g.value) OR (g.start_offset < p.end_offset AND p.start_offset < g.end_offset)))
""")
def enrich_asset_entities(spark, sf):
    s = _passages(spark, sf)
    after = enrich.with_entities(s, enrich.asset_texts(s), 1, kind="rule")
    return after["entities"].select("item_id", "asset_id", "entity_type", "value", "start_offset", "end_offset", "confidence", "source")


@query(f"""
    WITH x AS (SELECT 'c' || o_custkey AS item_id, string_agg(text, ' ' ORDER BY o_orderkey % 5, o_orderkey) AS e FROM {_NOTE} n JOIN orders ON o_orderkey = n.doc_id GROUP BY o_custkey),
    y AS (SELECT item_id, string_agg(t.text_content, ' ' ORDER BY sort_index, t.created_at, t.text_content) AS t FROM {sq._TRANSCRIPTIONS} t JOIN {sq._ASSETS} a ON a.id = t.asset_id GROUP BY item_id),
    w AS (SELECT coalesce(x.item_id, y.item_id) AS item_id, concat_ws(' ', e, t) AS text FROM x FULL JOIN y USING (item_id)),
    s AS (SELECT item_id, unnest(string_split_regex(text, '[.;\n]')) AS s, '{TRIPLE}' AS p FROM w),
    r AS (SELECT item_id, trim(regexp_extract(s, p, 1)) AS subject, trim(regexp_extract(s, p, 2)) AS predicate, trim(regexp_extract(s, p, 3)) AS object FROM s)
    SELECT DISTINCT item_id, subject, predicate, object FROM r WHERE subject <> '' AND predicate <> '' AND object <> '' AND item_id IN (SELECT id FROM {sq._ITEMS})
    UNION ALL SELECT r.item_id, r.subject, 'es', 'o' || (substr(r.id, 2)::BIGINT % 11) FROM {sq._TRIPLES} r WHERE item_id NOT IN (SELECT id FROM {sq._ITEMS})
""")
def enrich_item_triples(spark, sf):
    s = _passages(spark, sf)
    return enrich.with_triples(s, enrich.item_texts(s), 1)["triples"].select("item_id", "subject", "predicate", "object")


@query(f"""
    WITH a AS (SELECT id AS asset_id, EXISTS (SELECT 1 FROM {sq._EXTRACTIONS} e WHERE e.asset_id = a.id) OR EXISTS (SELECT 1 FROM {sq._TRANSCRIPTIONS} t WHERE t.asset_id = a.id) AS has, EXISTS (SELECT 1 FROM {sq._VECTORS} v WHERE v.asset_id = a.id) AS had, substr(id, 2)::BIGINT % 3 > 0 AS given FROM {sq._ASSETS} a)
    SELECT 'missing' AS run, count_if(has) AS with_text, count_if(has AND NOT had) AS candidates, count_if(has AND NOT had AND given) AS embedded, count_if(has AND NOT had AND NOT given) AS failed, count_if(has AND NOT had AND NOT given) AS missing FROM a
    UNION ALL SELECT 'all', count_if(has), count_if(has), count_if(has AND given), count_if(has AND NOT given), count_if(has AND NOT had AND NOT given) FROM a
""")
def embedding_backfill_report(spark, sf):
    s = corpus.store(spark, sf)
    given = s["assets"].select(F.col("id").alias("asset_id"), F.array(F.lit(0.5).cast("float"), F.lit(1.0).cast("float")).alias("embedding")).where("cast(substring(asset_id, 2) as long) % 3 > 0")
    runs = [enrich.backfilled(s, given, force)[1].select(F.lit(name).alias("run"), "*") for name, force in (("missing", False), ("all", True))]
    return runs[0].unionByName(runs[1])
