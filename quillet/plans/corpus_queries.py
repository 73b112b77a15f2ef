"""Registered queries over the corpus views, each with the DuckDB SQL of the same result."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillet.functions import geometry as g
from quillet.functions import text as t
from quillet.operators import decode as de
from quillet.operators import entities as en
from quillet.operators import layout as lay
from quillet.operators import pages
from quillet.operators import relational as rel
from quillet.operators import search as fts
from quillet.operators import vectors as vec
from quillet.operators import windows as win
from quillet.plans.registry import ORACLES, QUERIES, query
from quillet.sources import corpus
from quillet.sources.corpus import read
from quillet.streaming import jobs

_TOK = r"regexp_extract_all(lower(strip_accents(coalesce(text, ''))), '[\p{L}\p{N}]+')"


def _bm25(terms: list[str], where: str = "TRUE", limit: int = 20, relaxed: bool = True) -> str:
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{w}')) AS t{i}" for i, w in enumerate(terms))
    part = " + ".join(
        f"CASE WHEN ln((n - d{i} + 0.5) / (d{i} + 0.5)) > 0 THEN ln((n - d{i} + 0.5) / (d{i} + 0.5)) ELSE 1e-6 END * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * l / (total / n)))" for i in range(len(terms))
    )
    full = " AND ".join(f"t{i} > 0" for i in range(len(terms)))
    some = " OR ".join(f"t{i} > 0" for i in range(len(terms)))
    loose = f"(nf = 0 AND {str(relaxed and len(terms) > 1).upper()})"
    return f"""
        WITH w AS (SELECT doc_id, source, {_TOK} AS w FROM documents), c AS (SELECT doc_id, source, len(w) AS l, {tf} FROM w),
        f AS (SELECT count(*)::DOUBLE AS n, sum(l)::DOUBLE AS total, {", ".join(f"count_if(t{i} > 0)::DOUBLE AS d{i}" for i in range(len(terms)))}, count_if({full}) AS nf FROM c)
        SELECT doc_id, source, round(-({part}), 6) AS rank, CASE WHEN {loose} THEN 'relaxed' ELSE 'strict' END AS strategy
        FROM c, f WHERE (({full}) OR ({loose} AND ({some}))) AND {where} ORDER BY rank, doc_id LIMIT {limit}
    """


STRICT, NONE = ["the", "disgusting", "trash"], ["disgusting", "zzqq", "trash"]


@query(_bm25(STRICT))
def fts_search_strict(spark, sf):
    return fts.search(read(spark, sf, "documents"), STRICT, carry=("source",))


@query(_bm25(NONE))
def fts_search_fallback_switch(spark, sf):
    return fts.search(read(spark, sf, "documents"), NONE, carry=("source",))


@query(_bm25(["scum"], "source = 'src3'"))
def fts_search_scoped(spark, sf):
    # the collection is a filter on scored rows: document frequencies stay global
    return fts.search(read(spark, sf, "documents"), ["scum"], carry=("source",), scope=F.col("source") == "src3")


@query(f"SELECT doc_id, source FROM ({_bm25(['the', 'trash'], limit=50)}) WHERE source IN ('src1', 'src2', 'src3', 'src4') ORDER BY doc_id DESC")
def search_by_text_postfilter(spark, sf):
    top = fts.search(read(spark, sf, "documents"), ["the", "trash"], limit=50, carry=("source",))
    return top.where(F.col("source").isin("src1", "src2", "src3", "src4")).select("doc_id", "source").orderBy(F.desc("doc_id"))


@query(r"SELECT lang, count(*) AS docs, sum(len(w))::BIGINT AS tokens, max(len(w))::BIGINT AS longest FROM (SELECT lang, " + _TOK + r" AS w FROM documents) GROUP BY lang")
def fts_tokens_stats(spark, sf):
    w = read(spark, sf, "documents").select("lang", F.size(t.tokens(F.col("text"))).cast("long").alias("n"))
    return w.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("tokens"), F.max("n").alias("longest"))


@query(r"SELECT token, count(*) AS docs, sum(tf)::BIGINT AS tf FROM (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(" + _TOK + r") AS token FROM documents) GROUP BY 1, 2) GROUP BY token")
def fts_index_terms(spark, sf):
    return fts.index(read(spark, sf, "documents"), positions=False).groupBy("token").agg(F.count(F.lit(1)).alias("docs"), F.sum("tf").alias("tf"))


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


@query(f"SELECT doc_id, source FROM documents WHERE translate(text, {_AZ}) LIKE '%licensed under cc%' ORDER BY doc_id DESC LIMIT 50")
def search_global_like_fallback(spark, sf):
    return read(spark, sf, "documents").where(rel.ascii_like(F.col("text"), "Licensed Under CC")).select("doc_id", "source").orderBy(F.desc("doc_id")).limit(50)


@query("SELECT doc_id, len(regexp_extract_all(text, '(?i)trash|scum'))::BIGINT AS hits, len(string_split_regex(text, '(?i)trash|scum'))::BIGINT AS gaps FROM documents WHERE regexp_matches(text, '(?i)trash|scum')")
def fts_highlight_segments(spark, sf):
    d = read(spark, sf, "documents").where(F.col("text").rlike("(?i)trash|scum")).withColumn("p", t.highlight(F.col("text"), "trash|scum"))
    hits = F.size(F.filter("p", lambda p: p["hit"])).cast("long")
    return d.select("doc_id", hits.alias("hits"), (hits + 1).alias("gaps"))


@query(r"""
    WITH q AS (SELECT p_partkey, p_type || ' AND foo-bar ^baz: "' || p_name || '" near ' || p_name AS q FROM part),
    r AS (SELECT p_partkey, list_filter(list_filter(string_split_regex(regexp_replace(regexp_replace(q, '["()*^]', '', 'g'), '[-:,.]', ' ', 'g'), ' +'), lambda w: w <> ''), lambda w: upper(w) NOT IN ('AND', 'OR', 'NOT', 'NEAR')) AS a,
          list_filter(list_transform(list_filter(string_split_regex(q, ' +'), lambda w: w <> '' AND w NOT IN ('AND', 'OR', 'NOT', 'NEAR')), lambda w: regexp_replace(w, '[()"\-*^:,./\\]', '', 'g')), lambda w: w <> '') AS b FROM q)
    SELECT p_partkey, array_to_string(list_filter(a, lambda w, i: i = 1 OR w <> a[i - 1]), ' ') AS match_terms, array_to_string(list_transform(b, lambda w: '"' || w || '"'), ' ') AS store_query FROM r
""")
def query_sanitize_variants(spark, sf):
    q = F.concat("p_type", F.lit(' AND foo-bar ^baz: "'), "p_name", F.lit('" near '), "p_name")
    return read(spark, sf, "part").select("p_partkey", F.array_join(t.match_terms(q), " ").alias("match_terms"), t.quoted(t.store_terms(q)).alias("store_query"))


@query("SELECT conv_id, string_agg(text, ' ' ORDER BY CASE WHEN role = 'user' THEN 1 ELSE 0 END, turn, text) AS text FROM conversations GROUP BY conv_id")
def item_text_assembly(spark, sf):
    return rel.merged_text(corpus.texts(spark, sf), ["conv_id"], ["source_order", "turn"], "text")


@query("SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS n FROM conversations) WHERE n = 1 AND text <> ''")
def asset_text_assembly(spark, sf):
    return rel.latest(corpus.texts(spark, sf), ["conv_id"], F.asc("turn"), F.asc("text")).where("text <> ''").select("conv_id", "turn", "text")


@query("""
    SELECT v.vec_id, v.label, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity
    FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE v.vec_id <> 0 ORDER BY similarity DESC, vec_id LIMIT 5
""")
def similar_assets_topk(spark, sf):
    return vec.similar(read(spark, sf, "embeddings"), 0)


_COVER = "SELECT {by} count(*) AS total, count_if(l.doc_id IS NOT NULL)::BIGINT AS labelled, count_if(l.doc_id IS NULL AND length(trim(coalesce(d.text, ''))) > 0)::BIGINT AS missing FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id {group}"


def _coverage(spark, sf, *by):
    have = read(spark, sf, "labels").select("doc_id").distinct().withColumn("has", F.lit(True))
    d = read(spark, sf, "documents").join(have, "doc_id", "left")
    return d.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if("has").alias("labelled"), F.count_if(F.col("has").isNull() & rel.has_text(F.col("text"))).alias("missing"))


@query(_COVER.format(by="", group=""))
def embedding_coverage(spark, sf):
    return _coverage(spark, sf)


@query(_COVER.format(by="d.lang,", group="GROUP BY d.lang"))
def embedding_coverage_by_type(spark, sf):
    return _coverage(spark, sf, "lang")


@query("SELECT doc_id, source FROM documents d WHERE length(trim(coalesce(text, ''))) > 0 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) ORDER BY n_chars, doc_id LIMIT 100")
def embedding_backfill_candidates(spark, sf):
    d = read(spark, sf, "documents").where(rel.has_text(F.col("text")))
    return d.join(read(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti").orderBy("n_chars", "doc_id").select("doc_id", "source").limit(100)


@query("SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS lines, (SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_orderkey = o_orderkey) AS suppliers FROM orders")
def item_enrichment_counts(spark, sf):
    n = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("l_suppkey").alias("suppliers"))
    return read(spark, sf, "orders").select("o_orderkey").join(n, "o_orderkey", "left").na.fill(0)


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def collections_non_empty(spark, sf):
    return read(spark, sf, "customer").join(read(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def collections_empty(spark, sf):
    urgent = read(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")
    return rel.orphans(read(spark, sf, "customer"), "c_custkey", urgent, "o_custkey").select("c_custkey", "c_name")


@query("SELECT c_custkey, count(o_orderkey) AS items FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def collection_item_counts(spark, sf):
    n = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("items"))
    return read(spark, sf, "customer").select("c_custkey").join(n, "c_custkey", "left").na.fill(0)


@query("SELECT 'labels' AS relation, count(*) AS orphans FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.doc_id % 2 = 0) UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')")
def orphan_audit(spark, sf):
    a = rel.orphans(read(spark, sf, "labels"), "doc_id", read(spark, sf, "documents").where("doc_id % 2 = 0"), "doc_id")
    b = rel.orphans(read(spark, sf, "lineitem"), "l_orderkey", read(spark, sf, "orders").where("o_orderstatus = 'F'"), "o_orderkey")
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias("orphans")).select(F.lit(name).alias("relation"), "orphans")
    return one(a, "labels").unionByName(one(b, "lineitem"))


@query("""
    SELECT target_type, count(*) AS n, min(ms) AS first_ms, max(ms) AS last_ms FROM (
        SELECT CASE WHEN i.doc_id IS NOT NULL THEN 'item' WHEN s.s_suppkey IS NOT NULL THEN 'asset' ELSE 'unknown' END AS target_type, CASE WHEN t > 0 AND t < 1000000000000 THEN t * 1000 ELSE t END AS ms
        FROM (SELECT user_id * 7 AS u, CASE WHEN event_id % 5 = 0 THEN epoch_us(ts) // 1000000 ELSE epoch_us(ts) // 1000 END AS t FROM events) e
        LEFT JOIN (SELECT DISTINCT doc_id FROM documents) i ON i.doc_id = u LEFT JOIN (SELECT DISTINCT s_suppkey FROM supplier) s ON s.s_suppkey = u) GROUP BY target_type
""")
def llm_target_inference(spark, sf):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    e = read(spark, sf, "events").select((F.col("user_id") * 7).alias("u"), t.to_millis(F.when(F.col("event_id") % 5 == 0, F.floor(ms / 1000)).otherwise(ms)).alias("ms"))
    i = read(spark, sf, "documents").select(F.col("doc_id").alias("u")).distinct().withColumn("i", F.lit(True))
    s = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("u")).distinct().withColumn("s", F.lit(True))
    kind = F.when(F.col("i"), "item").when(F.col("s"), "asset").otherwise("unknown")
    return e.join(i, "u", "left").join(s, "u", "left").groupBy(kind.alias("target_type")).agg(F.count(F.lit(1)).alias("n"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(spark, sf):
    return rel.latest(read(spark, sf, "events"), ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_type, event_id, round(value, 4) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_result_per_job_type(spark, sf):
    return rel.latest(read(spark, sf, "events"), ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", "event_id", F.round("value", 4).alias("value"))


@query("SELECT doc_id, lag(doc_id) OVER w AS previous, lead(doc_id) OVER w AS next FROM documents WINDOW w AS (PARTITION BY source ORDER BY n_chars DESC, doc_id)")
def sibling_navigation(spark, sf):
    w = W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return read(spark, sf, "documents").select("doc_id", F.lag("doc_id").over(w).alias("previous"), F.lead("doc_id").over(w).alias("next"))


_ENT = """(SELECT o_orderkey AS id, o_orderkey % 50 AS item_id, ['person','organization','institution','place','date','misc','custom'][o_orderkey % 7 + 1] AS entity_type, 'v' || (o_orderkey % 13) AS value,
    o_orderkey % 50 * 3 % 41 AS start, o_orderkey % 50 * 3 % 41 + 5 + o_orderkey % 9 AS "end", (o_orderkey % 100) / 100.0::DOUBLE AS confidence, ['rule_based','onnx','manual','manual_deleted',NULL][o_orderkey % 5 + 1] AS source,
    CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 4 END AS asset_id FROM orders)"""


@query(f"SELECT id, entity_type, value, start FROM {_ENT} WHERE item_id = 7 AND (asset_id = 1 OR asset_id IS NULL) AND (source IS NULL OR source <> 'manual_deleted') AND (confidence IS NULL OR confidence > 0.5)")
def visible_entities_scoped(spark, sf):
    e = corpus.entities(spark, sf).where((F.col("item_id") == 7) & rel.in_scope(F.col("asset_id"), F.lit(1)) & rel.visible(F.col("source")))
    return e.where(F.col("confidence").isNull() | (F.col("confidence") > 0.5)).orderBy("start", "value", "id").select("id", "entity_type", "value", "start")


@query(f"SELECT entity_type, array_position(['person','organization','institution','place','date','misc','custom'], entity_type)::BIGINT AS place, count(*) AS n, count(DISTINCT value) AS distinct_values FROM {_ENT} WHERE source IS NULL OR source <> 'manual_deleted' GROUP BY entity_type")
def entities_grouped_by_type(spark, sf):
    order = F.array(*[F.lit(x) for x in ("person", "organization", "institution", "place", "date", "misc", "custom")])
    e = corpus.entities(spark, sf).where(rel.visible(F.col("source")))
    return e.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("distinct_values")).withColumn("place", F.array_position(order, F.col("entity_type")))


@query(f"""
    WITH e AS (SELECT *, CASE WHEN entity_type = 'institution' THEN 'organization' ELSE entity_type END AS fam FROM {_ENT})
    SELECT id, item_id, value FROM e c WHERE coalesce(source, '') NOT IN ('manual', 'manual_deleted') AND confidence > 0.89 AND NOT EXISTS (
        SELECT 1 FROM e p WHERE p.source IN ('manual', 'manual_deleted') AND p.id % 11 = 0 AND p.item_id = c.item_id AND p.fam = c.fam AND (lower(p.value) = lower(c.value) OR (c.start < p."end" AND p.start < c."end")))
""")
def ner_confidence_and_protected(spark, sf):
    e = corpus.entities(spark, sf)
    m = rel.manual(F.col("source"))
    return en.unprotected(e.where(~m), e.where(m & (F.col("id") % 11 == 0))).select("id", "item_id", "value")


@query("SELECT DISTINCT upper(trim(p_brand)) AS topic FROM part WHERE upper(trim(p_brand)) LIKE upper(trim(' brand#1')) || '%' ORDER BY topic LIMIT 20")
def topic_search_prefix(spark, sf):
    return read(spark, sf, "part").select(t.topic(F.col("p_brand")).alias("topic")).distinct().where(F.col("topic").startswith("BRAND#1")).orderBy("topic").limit(20)


@query("SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(v, ','), lambda x: upper(trim(x))), lambda x: x <> ''), '|') AS topics FROM (SELECT p_partkey, p_brand || ', ,' || p_type || ',x ' AS v FROM part)")
def topic_normalise_split(spark, sf):
    return read(spark, sf, "part").select("p_partkey", F.array_join(t.topics(F.concat("p_brand", F.lit(", ,"), "p_type", F.lit(",x "))), "|").alias("topics"))


@query("WITH s AS (SELECT l_orderkey, list(DISTINCT l_returnflag) FILTER (l_linenumber % 2 = 0) AS a, list(DISTINCT l_returnflag) FILTER (l_linenumber % 2 = 1) AS b FROM lineitem GROUP BY 1) SELECT l_orderkey, array_to_string(list_sort(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x))), ',') AS added, array_to_string(list_sort(list_filter(coalesce(b, []), lambda x: NOT list_contains(coalesce(a, []), x))), ',') AS removed FROM s")
def topic_set_diff(spark, sf):
    even = F.col("l_linenumber") % 2 == 0
    s = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(even, F.col("l_returnflag"))).alias("a"), F.collect_set(F.when(~even, F.col("l_returnflag"))).alias("b"))
    return s.select("l_orderkey", F.array_join(F.array_sort(F.array_except("a", "b")), ",").alias("added"), F.array_join(F.array_sort(F.array_except("b", "a")), ",").alias("removed"))


@query(f"SELECT s_suppkey, s_name, s_nationkey FROM supplier WHERE translate(s_suppkey::VARCHAR, {_AZ}) LIKE '%1%' OR translate(s_name, {_AZ}) LIKE '%1%' OR s_nationkey::VARCHAR LIKE '%1%' ORDER BY s_name DESC, s_suppkey LIMIT 10 OFFSET 10")
def table_browser_page(spark, sf):
    return corpus.browse(read(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey"), page=2, page_size=10, sort="s_name", direction="desc", search="1")


@query("SELECT l_orderkey, count(*) AS assets, arg_min(l_linenumber, CASE WHEN l_returnflag = 'R' THEN 0 WHEN l_returnflag = 'A' THEN 1 ELSE 2 END * 100 + l_linenumber) AS primary_line FROM lineitem GROUP BY l_orderkey")
def item_primary_asset(spark, sf):
    order = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2) * 100 + F.col("l_linenumber")
    return read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("assets"), F.min_by("l_linenumber", order).alias("primary_line"))


_NOTE = """(SELECT o_orderkey AS doc_id, 'En la ciudad de Buenos Aires, a ' || (o_orderkey % 28 + 1) || ' de ' || ['enero','marzo','mayo','julio','octubre','diciembre'][o_orderkey % 6 + 1] || ' de ' || (o_orderkey % 60 + 1800) || ', Don '
    || ['Manuel Belgrano','Juan Larrea','Mariano Moreno','José de San Martín'][o_orderkey % 4 + 1] || ' fue vocal. El Cabildo de Luján escribió un acta; recibida el ' || strftime(o_orderdate, '%d/%m/%Y') || ' junto al río Paraná y la Luna. Legajo 125/05/18100, del 3 de nivoso de 1790; oyó a Fray Luis de León, Sor Ana y al Real Convento Mayor, no a don Luis.' AS text FROM orders)"""


_UP, _WORDS = "[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+", "( +[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+)*"
_PATTERNS = (
    ("person", f"(Don|Doña|Dr\\.?|Fray|Sor|Fr\\.) +{_UP}{_WORDS}"),
    ("place", f"((ciudad|villa|pueblo|provincia) +de|río|sierra) +{_UP}( +((de|del|la|las|los|y) +)?{_UP})*"),
    ("date", "\\b[0-9][0-9]? +de +[a-záéíóúñ]+ +de +[0-9][0-9][0-9][0-9]\\b"),
    ("date", "\\b[0-9][0-9]?/[0-9][0-9]?/[0-9][0-9][0-9][0-9]\\b"),
    ("institution", f"(Real|Cabildo|Iglesia|Convento|Universidad|Audiencia){_WORDS}"),
)


@query(
    "WITH m AS ("
    + " UNION ALL ".join(
        f"SELECT doc_id, {rule} AS rule, '{name}' AS entity_type, unnest(regexp_extract_all(text, '{p}')) AS value, text FROM {_NOTE}" for rule, (name, p) in enumerate(_PATTERNS)
    )
    + """) SELECT doc_id, entity_type, value, (strpos(text, value) - 1)::INTEGER AS start, (strpos(text, value) - 1 + length(value))::INTEGER AS "end", 1.0::DOUBLE AS confidence, 'rule_based' AS source,
        (row_number() OVER (PARTITION BY doc_id ORDER BY strpos(text, value), rule) - 1)::INTEGER AS place FROM m"""
)
def ner_rule_all_with_offsets(spark, sf):
    return en.extract(corpus.notes_text(spark, sf), "doc_id", "text")


def _fold(entities: str, columns: str, order: str, derived: str, related: str, better: str, last_only: bool = True) -> str:
    """A fold in order over each item's entities: ``related`` compares a kept ``k`` with the next ``x``; the first kept one that holds (or the last one) is left to the better."""
    at = f"CASE WHEN len(kept) > 0 AND coalesce(({related.replace('k.', 'kept[len(kept)].')}), FALSE) THEN len(kept) ELSE 0 END" if last_only else f"coalesce(list_min(list_filter(range(1, len(kept) + 1), lambda i: coalesce(({related.replace('k.', 'kept[i].')}), FALSE))), 0)"
    names = [c.strip() for c in columns.split(",")]
    fields = ", ".join(f'"{c}" := "{c}"' for c in names)
    return f"""
        WITH RECURSIVE d AS (SELECT *, {derived} FROM ({entities})),
        e AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY {order}) AS n, struct_pack({fields}) AS x FROM d),
        f AS (SELECT item_id, 1::BIGINT AS n, [x] AS kept FROM e WHERE n = 1
              UNION ALL SELECT item_id, n, CASE WHEN i = 0 THEN list_append(kept, x) WHEN {better.replace('k.', 'kept[i].')} THEN list_concat(kept[1:i - 1], [x], kept[i + 1:len(kept)]) ELSE kept END
              FROM (SELECT e.item_id, e.n, f.kept, e.x, {at} AS i FROM f JOIN e ON e.item_id = f.item_id AND e.n = f.n + 1)),
        z AS (SELECT item_id, unnest(kept) AS x FROM (SELECT item_id, kept FROM f QUALIFY n = max(n) OVER (PARTITION BY item_id)))
        SELECT item_id, x.entity_type AS entity_type, x.value AS value, x.start AS start, x."end" AS "end", x.confidence AS confidence, x.source AS source FROM z
    """


_SANE = r"""regexp_replace(value, '^[«» ]+|[«» ]+$', '', 'g')"""
_RANKS = "CASE source WHEN 'rule_based' THEN 1 WHEN 'onnx' THEN 2 WHEN 'spacy' THEN 3 WHEN 'llm' THEN 4 ELSE 9 END AS r, CASE entity_type WHEN 'institution' THEN 5 WHEN 'date' THEN 4 WHEN 'person' THEN 3 WHEN 'place' THEN 3 WHEN 'organization' THEN 2 ELSE 1 END AS t"
_FAMILY = "CASE WHEN entity_type = 'institution' THEN 'organization' ELSE entity_type END AS g"
_OVER = '(k.start < x."end" AND x.start < k."end")'
_ENTITY = "entity_type, value, start, end, confidence, source"
_LINE_SPANS = """SELECT l_orderkey AS item_id, ['person', 'organization', 'institution', 'place', 'date', 'misc'][l_partkey % 6 + 1] AS entity_type, ['Ana', 'Ana Paz', '«Ana»', 'Lima', 'Real Audiencia', 'El  Cabildo', 'ANA  PAZ'][l_partkey // 3 % 7 + 1] AS value,
    l_partkey % 29 * 2 AS start, l_partkey % 29 * 2 + 3 + l_suppkey % 9 AS "end", [0.5, 0.55, 0.9, 0.97][l_suppkey % 4 + 1]::DOUBLE AS confidence, ['rule_based', 'onnx', 'spacy', 'llm', NULL][(l_linenumber + l_suppkey) % 5 + 1] AS source FROM lineitem"""
_MERGE = dict(
    columns=f"{_ENTITY}, r, t, g, n", order='start NULLS FIRST, "end" NULLS FIRST, r, value, entity_type, confidence NULLS FIRST, source NULLS FIRST', derived=f"{_RANKS}, {_FAMILY}, lower(regexp_replace({_SANE}, ' +', ' ', 'g')) AS n",
    related=f'{_OVER} OR (k.n = x.n AND ((abs(k.start - x.start) <= 2 AND abs(k."end" - x."end") <= 2) OR k.entity_type = x.entity_type))',
    better="""CASE WHEN coalesce(k.source, '') = 'rule_based' AND k.entity_type = 'date' THEN FALSE WHEN coalesce(x.source, '') = 'rule_based' AND x.entity_type = 'date' THEN TRUE
        WHEN coalesce(x.source, '') = 'onnx' AND coalesce(k.source, '') NOT IN ('onnx', 'spacy') AND x.g IN ('person', 'place', 'organization') AND x.g = k.g AND x.confidence >= k.confidence + 0.05::DOUBLE THEN TRUE
        WHEN coalesce(k.source, '') = 'onnx' AND coalesce(x.source, '') NOT IN ('onnx', 'spacy') AND k.g IN ('person', 'place', 'organization') AND x.g = k.g AND k.confidence >= x.confidence + 0.05::DOUBLE THEN FALSE
        WHEN coalesce(k.source, '') = 'rule_based' AND k.entity_type = 'institution' AND x.g = 'organization' THEN FALSE WHEN coalesce(x.source, '') = 'rule_based' AND x.entity_type = 'institution' AND k.g = 'organization' THEN TRUE
        WHEN k.t <> x.t THEN x.t > k.t WHEN x."end" - x.start > k."end" - k.start AND x.confidence >= k.confidence THEN TRUE WHEN k."end" - k.start > x."end" - x.start AND k.confidence >= x.confidence THEN FALSE
        WHEN x.confidence <> k.confidence THEN x.confidence > k.confidence ELSE x.r > k.r END""",
)


@query(_fold(f"SELECT item_id, entity_type, value, start, \"end\", confidence, source FROM {_ENT} WHERE source IN ('rule_based', 'onnx')", **_MERGE))
def ner_merge_sources(spark, sf):
    e = corpus.entities(spark, sf).where("source in ('rule_based', 'onnx')").select("item_id", "entity_type", "value", "start", "end", "confidence", "source")
    return en.merge_sources(e, "item_id")


@query(_fold(_LINE_SPANS, **_MERGE))
def ner_merge_line_spans(spark, sf):
    return en.merge_sources(corpus.line_spans(spark, sf), "item_id")


_LETTERS_SQL = r"len(regexp_extract_all(value, '[\p{L}\p{N}]'))"


@query(_fold(
    f"SELECT * FROM ({_LINE_SPANS}) WHERE source = 'onnx'", f"{_ENTITY}, g, n, q", 'start, "end", value, entity_type, confidence, source',
    f"""{_FAMILY}, lower(regexp_replace({_SANE}, ' +', ' ', 'g')) AS n, {_LETTERS_SQL} + 50 + CASE WHEN contains(value, ' ') THEN 10 ELSE 0 END + CASE WHEN regexp_matches(value, '[\\p{{L}}\\p{{N}}]$') THEN 5 ELSE 0 END + "end" - start + CASE WHEN confidence >= 0.9 THEN 5 ELSE 0 END AS q""",
    f"""k.g = x.g AND ({_OVER} OR ((abs(k.start - x.start) <= 24 OR abs(k."end" - x."end") <= 24) AND (contains(k.n, x.n) OR contains(x.n, k.n))))""", "x.q > k.q",
))
def ner_consolidate_onnx(spark, sf):
    return de.consolidated(corpus.line_spans(spark, sf).where("source = 'onnx'"), "item_id")


def _dedup_sql(entities: str) -> str:
    return _fold(
        f"SELECT * REPLACE ({_SANE} AS value) FROM ({entities})", f"{_ENTITY}, g, n, q", 'start, "end", value, source NULLS FIRST, entity_type, confidence NULLS FIRST',
        f"""{_FAMILY}, trim(regexp_replace(lower(value), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS n, {_LETTERS_SQL} + "end" - start + CASE WHEN confidence >= 0.9 THEN 10 ELSE 0 END + CASE WHEN contains(value, ' ') THEN 5 ELSE 0 END AS q""",
        f"""k.g = x.g AND ({_OVER} OR (x.n <> '' AND k.n = x.n) OR (abs(k.start - x.start) <= 8 AND abs(k."end" - x."end") <= 8 AND (starts_with(k.n, x.n) OR starts_with(x.n, k.n))))""", "x.q > k.q", last_only=False,
    )


@query(_dedup_sql(_LINE_SPANS))
def ner_dedup_line_spans(spark, sf):
    return en.dedup_document(corpus.line_spans(spark, sf), "item_id")


@query("""
    WITH e AS (SELECT *, CASE WHEN entity_type = 'institution' THEN 'organization' ELSE entity_type END AS g, row_number() OVER () AS id FROM (""" + _LINE_SPANS + """))
    SELECT item_id, entity_type, value, start, "end", confidence, source FROM e c WHERE source IS NOT NULL AND source <> 'rule_based' AND confidence > 0.89 AND NOT EXISTS (
        SELECT 1 FROM e p WHERE p.source IS NULL AND p.item_id = c.item_id AND p.g = c.g AND (lower(p.value) = lower(c.value) OR (c.start < p."end" AND p.start < c."end")))
""")
def ner_protected_line_spans(spark, sf):
    e = corpus.line_spans(spark, sf)
    return en.unprotected(e.where("source <> 'rule_based'"), e.where("source is null"))


@query("""
    WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount, CASE WHEN (l_partkey + l_linenumber) % 4 = 0 THEN 'B-' WHEN (l_partkey + l_linenumber) % 4 = 3 THEN 'O-' ELSE 'I-' END || ['PER','LOC'][l_suppkey % 2 + 1] AS label, l_linenumber * 5 AS start, l_linenumber * 5 + 4 AS "end", l_discount AS score FROM lineitem),
    f AS (SELECT *, substr(label, 3) AS entity_type FROM p WHERE label NOT LIKE 'O-%'),
    o AS (SELECT *, CASE WHEN coalesce(lag(entity_type) OVER w <> entity_type, TRUE) OR (label LIKE 'B-%' AND start > lag("end") OVER w) THEN 1 ELSE 0 END AS opens FROM f WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_discount)),
    g AS (SELECT *, sum(opens) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_discount ROWS UNBOUNDED PRECEDING) AS grp FROM o)
    SELECT l_orderkey, min(entity_type) AS entity_type, min(start) AS start, max("end") AS "end", round(avg(score), 6) AS confidence, count(*) AS n FROM g GROUP BY l_orderkey, grp
""")
def ner_bio_aggregate(spark, sf):
    k = (F.col("l_partkey") + F.col("l_linenumber")) % 4
    tag = F.when(k == 0, "B-").when(k == 3, "O-").otherwise("I-")
    label = F.concat(tag, F.when(F.col("l_suppkey") % 2 == 0, "PER").otherwise("LOC"))
    p = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", label.alias("label"), (F.col("l_linenumber") * 5).alias("start"), (F.col("l_linenumber") * 5 + 4).alias("end"), F.col("l_discount").alias("score"))
    return en.bio_spans(p, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_discount"])


@query("SELECT doc_id, w AS start, least(w + 256, n) AS stop FROM (SELECT doc_id, n, unnest(range(0, CASE WHEN n > 256 THEN ((n - 256 + 223) // 224) * 224 ELSE 0 END + 1, 224)) AS w FROM (SELECT doc_id, n_chars AS n FROM documents))")
def ner_token_windows(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.explode(de.windows(F.col("n_chars"))).alias("w"))
    return d.select("doc_id", "w.start", F.col("w.end").alias("stop"))


_TOKENS = r"""
    g AS (SELECT doc_id, text, regexp_extract_all(text, '[\p{L}\p{N}]+') AS w, string_split_regex(text, '[\p{L}\p{N}]+') AS gaps FROM documents WHERE text IS NOT NULL),
    t AS (SELECT doc_id, k - 1 AS i, w[k] AS v, length(w[k]) AS n, length(gaps[k]) AS gap FROM (SELECT *, unnest(range(1, len(w) + 1)) AS k FROM g)),
    tok AS (SELECT doc_id, i, v, n, CAST(sum(gap + n) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) - n AS start FROM t)
"""
_TAGS = "CASE n WHEN 9 THEN 'B-PER' WHEN 10 THEN 'I-PER' WHEN 11 THEN 'B-LOC' WHEN 12 THEN 'I-LOC' WHEN 13 THEN 'B-MISC' ELSE 'O' END"


def _tokens(spark, sf):
    d = read(spark, sf, "documents").where("text is not null").select("doc_id", win.token_spans(F.col("text")).alias("found"))
    # an outer generator, as for an inner one the optimiser asks first whether there is anything, and the function runs twice
    found = d.select("doc_id", F.size("found").alias("total"), "found").select("doc_id", "total", F.posexplode_outer("found").alias("i", "m")).where("i is not null")
    return found.select("doc_id", "total", F.col("i").cast("long").alias("i"), F.col("m.token").alias("v"), "m.start", "m.end")


_WINDOWED = """w AS (SELECT tok.doc_id, i, v, n, start, start + n AS "end", 224 * k AS win FROM tok JOIN (SELECT doc_id, max(i) + 1 AS total FROM tok GROUP BY doc_id) z ON z.doc_id = tok.doc_id,
    LATERAL (SELECT unnest(range(greatest(0, CAST(ceil((i - 255) / 224) AS BIGINT)), least(i // 224, CASE WHEN total > 256 THEN CAST(ceil((total - 256) / 224) AS BIGINT) ELSE 0 END) + 1)) AS k))"""


@query(f"WITH {_TOKENS}, {_WINDOWED} SELECT doc_id, win AS \"window\", count(*) AS tokens, min(i) AS first_token, min(start) AS start, max(\"end\") AS \"end\" FROM w GROUP BY doc_id, win")
def ner_window_tokens(spark, sf):
    rows = win.token_windows(_tokens(spark, sf), "doc_id", count="total")
    return rows.groupBy("doc_id", "window").agg(F.count(F.lit(1)).alias("tokens"), F.min("i").alias("first_token"), F.min("start").alias("start"), F.max("end").alias("end"))


@query(_fold(
    f"""WITH {_TOKENS}, {_WINDOWED}, p AS (SELECT *, {_TAGS} AS label, (start % 7 + 3) / 10.0::DOUBLE AS score FROM w),
    edge AS (SELECT doc_id, win, min(start) AS ws, max("end") AS we, max(win) OVER (PARTITION BY doc_id) AS lastwin FROM p GROUP BY doc_id, win),
    good AS (SELECT *, substr(label, 3) AS kind FROM p WHERE label <> 'O' AND score >= CASE WHEN label LIKE '%MISC' THEN 0.65 ELSE 0.3 END),
    o AS (SELECT *, CASE WHEN coalesce(lag(kind) OVER q <> kind, TRUE) OR (label LIKE 'B-%' AND start > lag("end") OVER q) THEN 1 ELSE 0 END AS opens FROM good WINDOW q AS (PARTITION BY doc_id, win ORDER BY i)),
    grp AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, win ORDER BY i ROWS UNBOUNDED PRECEDING) AS grp FROM o),
    spans AS (SELECT doc_id, win, min(kind) AS kind, min(start) AS start, max("end") AS "end", round(avg(score), 6) AS confidence FROM grp GROUP BY doc_id, win, grp),
    kept AS (SELECT s.* FROM spans s JOIN edge e ON e.doc_id = s.doc_id AND e.win = s.win WHERE NOT (s.win <> 0 AND s.start <= e.ws) AND NOT (s.win <> e.lastwin AND s."end" >= e.we))
    SELECT kept.doc_id AS item_id, CASE kind WHEN 'PER' THEN 'person' WHEN 'LOC' THEN 'place' ELSE 'misc' END AS entity_type, substr(text, kept.start + 1, kept."end" - kept.start) AS value, kept.start, kept."end", confidence, 'onnx' AS source FROM kept JOIN documents USING (doc_id)""",
    f"{_ENTITY}, g, n, q", 'start, "end", value, entity_type, confidence',
    rf"""{_FAMILY}, lower(regexp_replace(value, '\s+', ' ', 'g')) AS n, {_LETTERS_SQL} + 50 + CASE WHEN contains(value, ' ') THEN 10 ELSE 0 END + 5 + "end" - start + CASE WHEN confidence >= 0.9 THEN 5 ELSE 0 END AS q""",
    f"""k.g = x.g AND ({_OVER} OR ((abs(k.start - x.start) <= 24 OR abs(k."end" - x."end") <= 24) AND (contains(k.n, x.n) OR contains(x.n, k.n))))""", "x.q > k.q",
))
def ner_windowed_predictions(spark, sf):
    # a model's answers as a table: tags by the length of a token
    rows = win.token_windows(_tokens(spark, sf), "doc_id", count="total")
    tag = F.get(F.array(*[F.lit(x) for x in ("B-PER", "I-PER", "B-LOC", "I-LOC", "B-MISC")]), (F.length("v") - 9).cast("int"))
    said = rows.select("doc_id", "window", "i", "start", "end", F.coalesce(tag, F.lit("O")).alias("label"), ((F.col("start") % 7 + 3) / 10.0).alias("score"))
    return win.windowed_entities(said, read(spark, sf, "documents"), "doc_id", "text").withColumnRenamed("doc_id", "item_id")


@query(rf"""
    SELECT doc_id, trim(r[1]) AS subject, trim(r[2]) AS predicate, trim(r[3]) AS object FROM (
        SELECT doc_id, [regexp_extract(s, p, 1), regexp_extract(s, p, 2), regexp_extract(s, p, 3)] AS r FROM (SELECT doc_id, unnest(string_split_regex(text, '[.;\n]')) AS s, '{en.TRIPLE}' AS p FROM {_NOTE})) WHERE r[1] <> '' AND r[2] <> '' AND r[3] <> ''
""")
def triples_regex(spark, sf):
    return en.triples(corpus.notes_text(spark, sf), "doc_id", "text")


@query("SELECT user_id, count(*) AS triples FROM (SELECT DISTINCT user_id, lower(event_type), event_id % 3, floor(value)::BIGINT % 4 FROM events) GROUP BY user_id")
def triples_dedupe(spark, sf):
    e = read(spark, sf, "events")
    shout = F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type"))
    rows = e.select("user_id", "event_id", shout.alias("subject"), (F.col("event_id") % 3).cast("string").alias("predicate"), (F.floor("value") % 4).cast("string").alias("object"))
    return en.distinct_triples(rows, "user_id", "event_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("triples"))


def _boxes(spark, sf):
    c = read(spark, sf, "lineitem")
    a = g.box(F.col("l_partkey") % 97, F.col("l_suppkey") % 89, 20 + F.col("l_partkey") % 50, 10 + F.col("l_suppkey") % 40)
    b = g.box(F.col("l_suppkey") % 97, F.col("l_partkey") % 89, 20 + F.col("l_suppkey") % 50, 10 + F.col("l_partkey") % 40)
    return c.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", a.alias("a"), b.alias("b"))


_BOX = """(SELECT l_orderkey, l_linenumber, (l_partkey % 97)::DOUBLE AS ax, (l_suppkey % 89)::DOUBLE AS ay, (20 + l_partkey % 50)::DOUBLE AS aw, (10 + l_suppkey % 40)::DOUBLE AS ah,
    (l_suppkey % 97)::DOUBLE AS bx, (l_partkey % 89)::DOUBLE AS "by", (20 + l_suppkey % 50)::DOUBLE AS bw, (10 + l_partkey % 40)::DOUBLE AS bh FROM lineitem)"""


@query(f"""
    WITH i AS (SELECT *, greatest(least(ax + aw, bx + bw) - greatest(ax, bx), 0) * greatest(least(ay + ah, "by" + bh) - greatest(ay, "by"), 0) AS i FROM {_BOX})
    SELECT l_orderkey, l_linenumber, round(i / least(aw * ah, bw * bh), 6) AS overlap, round(i / (aw * ah + bw * bh - i), 6) AS iou,
        round(0.6 * (i / least(aw * ah, bw * bh)) + 0.3 * (i / (aw * ah + bw * bh - i)) + 0.1 * greatest(0, 1 - sqrt((ax + aw / 2 - bx - bw / 2) ** 2 + (ay + ah / 2 - "by" - bh / 2) ** 2) / greatest(sqrt(aw * aw + ah * ah), sqrt(bw * bw + bh * bh), 1)), 6) AS score FROM i
""")
def layout_overlap_iou(spark, sf):
    b = _boxes(spark, sf)
    return b.select("l_orderkey", "l_linenumber", F.round(g.overlap(F.col("a"), F.col("b")), 6).alias("overlap"), F.round(g.iou(F.col("a"), F.col("b")), 6).alias("iou"), F.round(g.score(F.col("a"), F.col("b")), 6).alias("score"))


_CATEGORY = "CASE {} WHEN 'doc_title' THEN 'title' WHEN 'text' THEN 'plain_text' WHEN 'paragraph' THEN 'plain_text' WHEN 'image' THEN 'figure' ELSE {} END"


@query(f"""
    WITH b AS (SELECT l_orderkey, l_linenumber AS block_id, ['doc_title', 'text', 'table_body', 'image', 'footnote', 'paragraph'][l_partkey % 6 + 1] AS label, l_partkey % 3 AS bg, x.ax, x.ay, x.aw, x.ah FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey % 97)::DOUBLE AS ax, (l_suppkey % 89)::DOUBLE AS ay, (20 + l_partkey % 50)::DOUBLE AS aw, (10 + l_suppkey % 40)::DOUBLE AS ah FROM lineitem) x),
    r AS (SELECT l_orderkey, l_linenumber AS region_id, ['doc_title', 'text', 'table_body', 'image', 'footnote', 'paragraph'][l_suppkey % 6 + 1] AS category, l_suppkey % 3 AS rg, (l_suppkey % 97)::DOUBLE AS bx, (l_partkey % 89)::DOUBLE AS "by", (20 + l_suppkey % 50)::DOUBLE AS bw, (10 + l_partkey % 40)::DOUBLE AS bh FROM lineitem),
    i AS (SELECT *, greatest(least(ax + aw, bx + bw) - greatest(ax, bx), 0) * greatest(least(ay + ah, "by" + bh) - greatest(ay, "by"), 0) AS i FROM b JOIN r USING (l_orderkey)),
    s AS (SELECT *, 0.6 * (i / least(aw * ah, bw * bh)) + 0.3 * (i / (aw * ah + bw * bh - i)) + 0.1 * greatest(0, 1 - sqrt((ax + aw / 2 - bx - bw / 2) ** 2 + (ay + ah / 2 - "by" - bh / 2) ** 2) / greatest(sqrt(aw * aw + ah * ah), sqrt(bw * bw + bh * bh), 1)) AS score FROM i),
    t AS (SELECT *, CASE WHEN bg > 0 AND bg = rg AND score >= 0.15 THEN 1 WHEN {_CATEGORY.format("label", "label")} = {_CATEGORY.format("category", "category")} AND score >= 0.25 THEN 2 WHEN score >= 0.4 THEN 3 END AS tier FROM s),
    p AS (SELECT l_orderkey, block_id, region_id, score FROM t WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY l_orderkey, block_id ORDER BY tier, score DESC, region_id) = 1)
    SELECT DISTINCT b.l_orderkey, b.block_id, p.region_id, round(p.score, 6) AS score FROM b LEFT JOIN p ON p.l_orderkey = b.l_orderkey AND p.block_id = b.block_id
""")
def layout_block_region_match(spark, sf):
    b = _boxes(spark, sf)
    names = F.array(*[F.lit(x) for x in ("doc_title", "text", "table_body", "image", "footnote", "paragraph")])
    blocks = b.select("l_orderkey", F.col("l_linenumber").alias("block_id"), F.get(names, (F.col("l_partkey") % 6).cast("int")).alias("label"), F.col("a").alias("bbox"), (F.col("l_partkey") % 3).alias("group"))
    regions = b.select("l_orderkey", F.col("l_linenumber").alias("region_id"), F.get(names, (F.col("l_suppkey") % 6).cast("int")).alias("category"), F.col("b").alias("bbox"), (F.col("l_suppkey") % 3).alias("group"))
    return lay.match_regions(blocks, regions, ["l_orderkey"])


@query("SELECT l_orderkey, count(*) AS everything, count_if(k IN (0, 5))::BIGINT AS titles, count_if(k = 1)::BIGINT AS texts, count_if(k = 2)::BIGINT AS tables, count_if(k IN (3, 4))::BIGINT AS figures FROM (SELECT l_orderkey, l_partkey % 6 AS k FROM lineitem) GROUP BY l_orderkey")
def layout_filter_counts(spark, sf):
    names = F.array(*[F.lit(x) for x in ("doc_title", "Plain Text", "table", "image", "chart", "Paragraph-Title")])
    c = read(spark, sf, "lineitem").select("l_orderkey", F.get(names, (F.col("l_partkey") % 6).cast("int")).alias("label"))
    return lay.filter_counts(c, ["l_orderkey"]).select("l_orderkey", F.col("all").alias("everything"), "titles", F.col("text").alias("texts"), "tables", "figures")


@query()
def reading_order_columns(spark, sf):
    r = _boxes(spark, sf).select((F.col("l_orderkey") % 200).alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("region_id"), F.col("a.x").alias("x"), F.col("a.y").alias("y"), F.col("a.width").alias("width"), F.col("a.height").alias("height"), F.lit(150.0).alias("page_width"), F.lit(140.0).alias("page_height"))
    return lay.reading_order(r, ["page"])


@query("SELECT conv_id, string_agg(CASE WHEN role = 'system' THEN '## ' || trim(text) WHEN role = 'user' THEN '---' || chr(10) || trim(text) || chr(10) || '---' ELSE trim(text) END, chr(10) || chr(10) ORDER BY turn, text) AS body FROM conversations GROUP BY conv_id")
def block_text_render(spark, sf):
    text = F.trim("text")
    shown = F.when(F.col("role") == "system", F.concat(F.lit("## "), text)).when(F.col("role") == "user", F.concat(F.lit("---\n"), text, F.lit("\n---"))).otherwise(text)
    c = read(spark, sf, "conversations").withColumn("body", shown)
    return rel.merged_text(c, ["conv_id"], ["turn", "text"], "body", "\n\n")


@query("""SELECT l_orderkey, l_linenumber, round(1 - y - h, 6) AS rx, round(x, 6) AS ry, round((greatest(x, 0.2) - 0.2) / 0.5, 6) AS cx, round((least(x + w, 0.7) - greatest(x, 0.2)) / 0.5, 6) AS cw
    FROM (SELECT l_orderkey, l_linenumber, l_discount * 5 AS x, l_tax * 5 AS y, 0.3::DOUBLE AS w, 0.25::DOUBLE AS h FROM lineitem) WHERE least(x + w, 0.7) > greatest(x, 0.2) AND least(y + h, 0.9) > greatest(y, 0.1)""")
def annotation_rotate_crop(spark, sf):
    b = g.box(F.col("l_discount") * 5, F.col("l_tax") * 5, F.lit(0.3), F.lit(0.25))
    to = g.box(F.lit(0.2), F.lit(0.1), F.lit(0.5), F.lit(0.8))
    d = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", g.turned(b).alias("r"), g.cropped(b, to).alias("c")).where("c is not null")
    return d.select("l_orderkey", "l_linenumber", F.round("r.x", 6).alias("rx"), F.round("r.y", 6).alias("ry"), F.round("c.x", 6).alias("cx"), F.round("c.width", 6).alias("cw"))


@query("SELECT page_id, length(regexp_replace(html, '<[^>]+>', '', 'g'))::BIGINT AS n, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?i)<br[^>]*>', chr(10), 'g'), '(?i)<li[^>]*>', '• ', 'g'), '(?i)</(p|div|li|h[1-6])>', chr(10), 'g'), '<[^>]+>', '', 'g'), '[ \\t\\n\\r\\x0B\\f]+', ' ', 'g')) AS body FROM pages".replace("\\\\", "\\"))
def note_plaintext(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.length(F.regexp_replace("html", "<[^>]+>", "")).cast("long").alias("n"), t.note_text(F.col("html")).alias("body"))


@query(r"SELECT doc_id, CASE WHEN length(f) > 120 THEN rtrim(substr(f, 1, 119)) || '…' ELSE f END AS preview FROM (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\r\x0B\f]+', ' ', 'g')) AS f FROM documents)")
def text_preview(spark, sf):
    return read(spark, sf, "documents").select("doc_id", t.preview(F.col("text")).alias("preview"))


@query(r"SELECT p_partkey, trim(regexp_replace(lower(strip_accents(trim(' Año_' || p_type || '-É '))), '[^a-z0-9]+', ' ', 'g')) AS key FROM part")
def metadata_key_normalise(spark, sf):
    return read(spark, sf, "part").select("p_partkey", t.metadata_key(F.concat(F.lit(" Año_"), "p_type", F.lit("-É "))).alias("key"))


@query(r"""SELECT p_partkey, lower(p_name) AS value FROM part""")
def entity_value_sanitise(spark, sf):
    return read(spark, sf, "part").select("p_partkey", t.normalize_value(F.concat(F.lit(' «"'), "p_name", F.lit('".» '))).alias("value"))


@query(r"SELECT doc_id, n, n >= 50 AS good FROM (SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}]', '', 'g'))::INTEGER AS n FROM documents)")
def text_quality_gate(spark, sf):
    return read(spark, sf, "documents").select("doc_id", t.alphanumerics(F.col("text")).alias("n")).withColumn("good", F.col("n") >= 50)


@query(r"""SELECT doc_id, length(c)::INTEGER AS n, right(c, 20) AS tail FROM (SELECT doc_id, CASE WHEN length(text) <= 1152 THEN text WHEN regexp_extract(h, '(?s)^(.*[.\n！。])', 1) = '' THEN h ELSE regexp_extract(h, '(?s)^(.*[.\n！。])', 1) END AS c FROM (SELECT doc_id, text, substr(text, 1, 1152) AS h FROM documents))""")
def prompt_context_truncate(spark, sf):
    c = t.for_context(F.col("text"), 1024, 512)
    return read(spark, sf, "documents").select("doc_id", c.alias("c")).select("doc_id", F.length("c").alias("n"), F.expr("right(c, 20)").alias("tail"))


@query("""SELECT kind, count(*) AS n FROM (SELECT CASE p_size % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'pdf' WHEN 2 THEN 'audio' END AS kind FROM part QUALIFY row_number() OVER (PARTITION BY p_type, p_size % 4 ORDER BY p_partkey) = 1) GROUP BY kind""")
def file_classify_dedupe(spark, sf):
    ext = F.get(F.array(*[F.lit(x) for x in (".JPG", ".pdf", ".Mp3", ".exe")]), (F.col("p_size") % 4).cast("int"))
    case = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_type")).otherwise(F.lower("p_type"))
    files = read(spark, sf, "part").select("p_partkey", F.concat(F.lit("/in/"), case, ext).alias("path")).withColumn("__l", F.lower("path"))
    return rel.latest(files, ["__l"], F.asc("p_partkey")).groupBy(t.file_kind(F.col("path")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, count(*) AS items, sum(n)::BIGINT AS assets, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS ids FROM (SELECT o_custkey, o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders) GROUP BY o_custkey")
def export_collection_flat(spark, sf):
    assets = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct("l_linenumber", "l_partkey")).alias("assets"))
    items = read(spark, sf, "orders").join(assets, "o_orderkey", "left").withColumn("assets", F.coalesce("assets", F.expr("cast(array() as array<struct<l_linenumber:int,l_partkey:bigint>>)")))
    nested = items.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "assets"))).alias("items"))
    size = F.aggregate("items", F.lit(0).cast("long"), lambda s, i: s + F.size(i["assets"]))
    return nested.select("o_custkey", F.size("items").cast("long").alias("items"), size.alias("assets"), F.array_join(F.transform("items", lambda i: i["o_orderkey"].cast("string")), ",").alias("ids"))


@query("SELECT coalesce(o.c_custkey, n.k) AS c_custkey, coalesce(n.name, o.c_name) AS c_name FROM customer o FULL JOIN (SELECT c_custkey * 2 AS k, 'new ' || c_name AS name FROM customer) n ON o.c_custkey = n.k")
def upsert_by_key(spark, sf):
    old = read(spark, sf, "customer").select("c_custkey", "c_name")
    return rel.upsert(old, old.select((F.col("c_custkey") * 2).alias("c_custkey"), F.concat(F.lit("new "), "c_name").alias("c_name")), "c_custkey", [])


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 3 <> 0 UNION ALL SELECT l_orderkey, 1, 0.0 FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey % 3 = 0)")
def replace_in_scope(spark, sf):
    old = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    new = old.where("l_orderkey % 3 = 0").select("l_orderkey").distinct().select("l_orderkey", F.lit(1).alias("l_linenumber"), F.lit(0.0).alias("l_quantity"))
    return rel.replace_in_scope(old, new, ["l_orderkey"])


@query("SELECT count(*) AS lines, count(DISTINCT l_orderkey) AS orders FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3))")
def cascade_delete_survivors(spark, sf):
    customers = read(spark, sf, "customer").where("c_nationkey = 3").select("c_custkey")
    orders = read(spark, sf, "orders").join(customers.toDF("o_custkey"), "o_custkey", "left_semi").select("o_orderkey")
    return rel.without(read(spark, sf, "lineitem"), "l_orderkey", orders).agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("l_orderkey").alias("orders"))


@query("SELECT event_id, event_type, user_id FROM events WHERE event_id % 4 = 0 ORDER BY ts, event_id LIMIT 64")
def job_queue_pending(spark, sf):
    return read(spark, sf, "events").where("event_id % 4 = 0").orderBy("ts", "event_id").limit(64).select("event_id", "event_type", "user_id")


@query("SELECT user_id, event_type, max(event_id) AS event_id, count(*) AS requests FROM events GROUP BY user_id, event_type")
def job_coalesce_batches(spark, sf):
    return jobs.coalesced(read(spark, sf, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"]).drop("ts")


@query("""
    WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events), g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
    SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM g GROUP BY user_id, k
""")
def debounce_sessions(spark, sf):
    return jobs.debounced(read(spark, sf, "events"), "user_id", "ts", "6 hours")


@query(f"SELECT e.id, e.value, CASE WHEN n.n_nationkey IS NULL THEN 'not_found' ELSE 'resolved' END AS geo_status, round(n.n_nationkey * 1.5::DOUBLE, 2) AS latitude FROM {_ENT} e LEFT JOIN nation n ON 'v' || n.n_nationkey = e.value AND n.n_nationkey < 9 WHERE e.entity_type = 'place' AND (e.source IS NULL OR e.source <> 'manual_deleted')")
def geocode_pending_join(spark, sf):
    places = corpus.entities(spark, sf).where((F.col("entity_type") == "place") & rel.visible(F.col("source"))).select("id", "value")
    gazetteer = read(spark, sf, "nation").where("n_nationkey < 9").select(F.concat(F.lit("v"), F.col("n_nationkey").cast("string")).alias("value"), F.round(F.col("n_nationkey") * 1.5, 2).alias("latitude"))
    return places.join(gazetteer, "value", "left").select("id", "value", F.when(F.col("latitude").isNull(), "not_found").otherwise("resolved").alias("geo_status"), "latitude")


@query("SELECT sum(n)::BIGINT AS score FROM (SELECT count(*) AS n FROM nation UNION ALL SELECT count(*) FROM customer UNION ALL SELECT count(*) FROM orders UNION ALL SELECT count(*) FROM labels)")
def corpus_richness(spark, sf):
    one = [read(spark, sf, n).agg(F.count(F.lit(1)).alias("n")) for n in ("nation", "customer", "orders", "labels")]
    return one[0].unionByName(one[1]).unionByName(one[2]).unionByName(one[3]).agg(F.sum("n").alias("score"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 1")
def sql_front_select(spark, sf):
    read(spark, sf, "nation").createOrReplaceTempView("nation")
    return corpus.select(spark, "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = :r", {"r": 1})


@query("SELECT p_partkey, CASE WHEN b < 1024 THEN printf('%d B', b) WHEN b < 1048576 THEN CASE WHEN b / 1024.0 < 10 THEN printf('%.1f KB', round(b / 1024.0::DOUBLE, 1)) ELSE printf('%.0f KB', round(b / 1024.0::DOUBLE)) END ELSE printf('%.1f MB', round(b / 1048576.0::DOUBLE, 1)) END AS size FROM (SELECT p_partkey, (p_size * p_size * p_partkey % 5000000) AS b FROM part)")
def file_sizes(spark, sf):
    return read(spark, sf, "part").select("p_partkey", t.format_bytes(F.col("p_size") * F.col("p_size") * F.col("p_partkey") % 5000000).alias("size"))


# Lines and detections of synthetic pages: a page an order, in the order of all columns used.
_LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_discount"]
_LINE = """(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount, ['con-', 'tado ', 'Acta.', 'folio- '][(l_partkey + l_suppkey) % 4 + 1] AS text,
    l_partkey % 97 AS x, l_suppkey % 89 AS y, 20 + l_partkey % 50 AS width, 10 + l_suppkey % 40 AS height, l_discount AS confidence FROM lineitem)"""
_DETECTION = """(SELECT l_orderkey, l_linenumber, l_partkey % 25 AS class, (l_suppkey % 10) / 10.0 AS score, (l_partkey % 97 * 7)::DOUBLE AS x1, (l_suppkey % 89 * 7)::DOUBLE AS y1,
    (l_partkey % 97 * 7 + l_suppkey % 61 * 5 - 10)::DOUBLE AS x2, (l_suppkey % 89 * 7 + l_partkey % 53 * 3 - 6)::DOUBLE AS y2, 1700.0::DOUBLE AS page_width, 2200.0::DOUBLE AS page_height FROM lineitem)"""
_DECODED = f"""(SELECT l_orderkey, [{", ".join(f"'{c}'" for c in pages.CLASSES)}] AS names, class, score, page_width, page_height, greatest(x1 * sx, 0) AS x1, greatest(y1 * sy, 0) AS y1, least(x2 * sx, page_width) AS x2, least(y2 * sy, page_height) AS y2
    FROM (SELECT *, CASE WHEN far > 800 THEN 1.0::DOUBLE ELSE page_width / 800 END AS sx, CASE WHEN far > 800 THEN 1.0::DOUBLE ELSE page_height / 800 END AS sy
        FROM (SELECT *, max(greatest(x2, y2)) OVER (PARTITION BY l_orderkey) AS far FROM {_DETECTION} WHERE score >= 0.5 AND x2 > x1 AND y2 > y1)))"""
_REGION = f"""(SELECT l_orderkey, coalesce(names[class + 1], 'plain_text') AS category, score, round(x1)::INTEGER AS x, round(y1)::INTEGER AS y, greatest(round(x2 - x1), 1)::INTEGER AS width, greatest(round(y2 - y1), 1)::INTEGER AS height, page_width, page_height FROM {_DECODED})"""


def _lines(spark, sf):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    text = F.element_at(F.array(*map(F.lit, ["con-", "tado ", "Acta.", "folio- "])), ((p + s) % 4 + 1).cast("int"))
    return read(spark, sf, "lineitem").select("l_orderkey", *_LINE_ORDER, text.alias("text"), (p % 97).alias("x"), (s % 89).alias("y"), (20 + p % 50).alias("width"), (10 + s % 40).alias("height"), F.col("l_discount").alias("confidence"))


def _regions(spark, sf):
    p, s, d = F.col("l_partkey"), F.col("l_suppkey"), "double"
    corner = {"x1": p % 97 * 7, "y1": s % 89 * 7, "x2": p % 97 * 7 + s % 61 * 5 - 10, "y2": s % 89 * 7 + p % 53 * 3 - 6}
    found = read(spark, sf, "lineitem").select("l_orderkey", (p % 25).alias("class"), (s % 10 / 10.0).alias("score"), *(c.cast(d).alias(n) for n, c in corner.items()), F.lit(1700.0).alias("page_width"), F.lit(2200.0).alias("page_height"))
    return pages.decode(found, ["l_orderkey"], 800.0)


@query(f"""
    WITH f AS (SELECT *, CASE WHEN coalesce(lag(rtrim(text) LIKE '%-') OVER w, FALSE) AND regexp_matches(ltrim(text), '^[a-z]') THEN 0 ELSE 1 END AS opens FROM {_LINE} WINDOW w AS (PARTITION BY l_orderkey ORDER BY {", ".join(_LINE_ORDER)})),
    n AS (SELECT *, sum(opens) OVER w AS line FROM f WINDOW w AS (PARTITION BY l_orderkey ORDER BY {", ".join(_LINE_ORDER)} ROWS UNBOUNDED PRECEDING)),
    k AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY l_orderkey, line) AS many FROM n WINDOW w AS (PARTITION BY l_orderkey, line ORDER BY {", ".join(_LINE_ORDER)}))
    SELECT l_orderkey, CAST(line AS BIGINT) AS line, string_agg(CASE WHEN i < many THEN regexp_replace(CASE WHEN i > 1 THEN ltrim(text) ELSE text END, '- *$', '') WHEN i > 1 THEN ltrim(text) ELSE text END, '' ORDER BY i) AS text,
        min(x) FILTER (i = 1) AS x, min(y) FILTER (i = 1) AS y, max(x + width) - min(x) FILTER (i = 1) AS width, max(y + height) - min(y) FILTER (i = 1) AS height, max(confidence) AS confidence, CAST(count(*) AS INTEGER) AS lines FROM k GROUP BY l_orderkey, line
""")
def ocr_merge_hyphens(spark, sf):
    return pages.merge_hyphens(_lines(spark, sf), ["l_orderkey"], _LINE_ORDER)


@query(f"""
    SELECT l_orderkey, l_linenumber, CASE WHEN regexp_matches(rtrim(text), '[.!?]$') AND regexp_matches(ltrim(lead(text) OVER (PARTITION BY l_orderkey ORDER BY {", ".join(_LINE_ORDER)})), '^[A-Z]') THEN text || chr(10) ELSE text END AS text FROM {_LINE}
""")
def ocr_detect_paragraphs(spark, sf):
    return pages.paragraph_breaks(_lines(spark, sf), ["l_orderkey"], _LINE_ORDER).select("l_orderkey", "l_linenumber", "text")


@query(f"SELECT * FROM {_REGION}")
def detections_decode(spark, sf):
    return _regions(spark, sf)


@query(f"SELECT l_orderkey, count(*) AS regions, count(*) < 2 OR max(width * height / (page_width * page_height)) > 0.6 AS bypass FROM {_REGION} GROUP BY l_orderkey")
def layout_bypass(spark, sf):
    return pages.bypassed(_regions(spark, sf), ["l_orderkey"])


@query(f"""
    SELECT *, x2 - crop_x AS crop_width, y2 - crop_y AS crop_height FROM (SELECT l_orderkey, category, greatest(x - 5, 0) AS crop_x, greatest(y - 5, 0) AS crop_y, least(x + width + 5, 1700) AS x2, least(y + height + 5, 2200) AS y2 FROM {_REGION}) WHERE x2 - crop_x >= 10 AND y2 - crop_y >= 10
""".replace("SELECT *, x2", "SELECT l_orderkey, category, crop_x, crop_y, x2", 1))
def region_crops(spark, sf):
    return pages.crops(_regions(spark, sf)).select("l_orderkey", "category", "crop_x", "crop_y", "crop_width", "crop_height")


@query("""
    SELECT l_orderkey, l_linenumber, start, "end" FROM (SELECT l_orderkey, l_linenumber, l_partkey % 300 AS start, l_partkey % 300 + 4 + l_suppkey % 9 AS "end", l_linenumber = 1 AS first, l_linenumber = 4 AS last FROM lineitem)
    WHERE NOT (NOT first AND start <= 32) AND NOT (NOT last AND "end" >= 256)
""")
def ner_prune_window_edges(spark, sf):
    start = F.col("l_partkey") % 300
    e = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", start.alias("start"), (start + 4 + F.col("l_suppkey") % 9).alias("end"), F.lit(32).alias("window_start"), F.lit(256).alias("window_end"), (F.col("l_linenumber") == 1).alias("first"), (F.col("l_linenumber") == 4).alias("last"))
    return en.inside_windows(e).select("l_orderkey", "l_linenumber", "start", "end")


@query(_dedup_sql(f"SELECT item_id, entity_type, value, start, \"end\", confidence, source FROM {_ENT}"))
def ner_dedup_document(spark, sf):
    e = corpus.entities(spark, sf).select("item_id", "entity_type", "value", "start", "end", "confidence", "source")
    return en.dedup_document(e, "item_id")
