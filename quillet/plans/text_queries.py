"""Registered queries of texts, JSON, notes, search, decoding, layouts, prompts, files and queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillet import plugins
from quillet.functions import geometry as g
from quillet.functions import jsons, notes
from quillet.functions import text as t
from quillet.operators import decode as de
from quillet.operators import layout as lay
from quillet.operators import prompts
from quillet.operators import relational as rel
from quillet.operators import search as fts
from quillet.plans import store_queries as sq
from quillet.plans.registry import query
from quillet.sources import media
from quillet.sources.corpus import read
from quillet.streaming import jobs


def _picked(values, at):
    return F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))


# search

_DOCS = "(SELECT o_orderkey AS item_id, 's' || (o_orderkey % 4) AS collection_id, ['São Paulo', 'l''eau vive', 'L’eau', 'eau l', 'vive São Tomé', 'sao paulo paulo'][o_orderkey % 6 + 1] || ' ' || o_orderpriority AS text FROM orders)"


def _docs(spark, sf):
    k = F.col("o_orderkey")
    return read(spark, sf, "orders").select(k.alias("item_id"), F.concat(F.lit("s"), (k % 4).cast("string")).alias("collection_id"), F.concat(_picked(("São Paulo", "l'eau vive", "L’eau", "eau l", "vive São Tomé", "sao paulo paulo"), k % 6), F.lit(" "), "o_orderpriority").alias("text"))


def _phrase_sql(first: str, second: str | None, limit: int) -> str:
    """BM25 of one phrase of one or two tokens."""
    hit = f"x = '{first}'" + (f" AND w[i + 1] = '{second}'" if second else "")
    return f"""
        WITH w AS (SELECT item_id, regexp_extract_all(lower(strip_accents(text)), '[\\p{{L}}\\p{{N}}]+') AS w FROM {_DOCS}), c AS (SELECT item_id, len(w) AS l, len(list_filter(w, lambda x, i: {hit})) AS f FROM w),
        s AS (SELECT count(*)::DOUBLE AS n, sum(l)::DOUBLE AS total, count_if(f > 0)::DOUBLE AS d FROM c)
        SELECT item_id, round(-(greatest(ln((n - d + 0.5) / (d + 0.5)), CASE WHEN ln((n - d + 0.5) / (d + 0.5)) > 0 THEN 0 ELSE 1e-6 END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / (total / n)))), 6) AS rank, 'strict' AS strategy
        FROM c, s WHERE f > 0 ORDER BY rank, item_id LIMIT {limit}
    """


@query(_phrase_sql("sao", None, 30))
def fts_search_accents(spark, sf):
    return fts.search(_docs(spark, sf), ["São"], limit=30, key="item_id")


@query(_phrase_sql("l", "eau", 30))
def fts_search_phrase(spark, sf):
    return fts.search(_docs(spark, sf), ["l'eau"], limit=30, key="item_id")


@query("SELECT 'São AND zzz' AS query, '\"São\" \"zzz\"' AS sanitised, 2 AS terms, 5::BIGINT AS matches, 'relaxed' AS strategy")
def fts_search_debug(spark, sf):
    return fts.search_with_debug(_docs(spark, sf), "São AND zzz", limit=5, key="item_id")[1]


def _items(spark, sf):
    """Items of documents; their texts come as one extraction each."""
    d = read(spark, sf, "documents")
    items = d.select(F.col("doc_id").cast("string").alias("id"), F.coalesce("source", F.lit("-")).alias("collection_id"), F.concat(F.lit("Title "), (F.col("doc_id") % 50).cast("string")).alias("title"), F.concat(F.lit('{"lang": "'), F.coalesce("lang", F.lit("")), F.lit('"}')).alias("metadata"), F.col("n_chars").alias("updated_at"))
    texts = d.select(F.col("doc_id").cast("string").alias("item_id"), F.lit(0).alias("source_order"), F.lit(0).alias("sort_index"), F.lit(0).alias("created_at"), F.coalesce("text", F.lit("")).alias("text"))
    return fts.item_documents(items, texts)


_ITEM_DOCS = """(SELECT doc_id::VARCHAR AS item_id, coalesce(source, '-') AS collection_id, 'Title ' || (doc_id % 50) AS title, n_chars AS updated_at, coalesce(text, '') AS body, 'Title ' || (doc_id % 50) || ' {"lang":"' || coalesce(lang, '') || '"} ' || coalesce(text, '') AS text FROM documents)"""
_IT = rf"(SELECT *, regexp_extract_all(lower(strip_accents(text)), '[\p{{L}}\p{{N}}]+') AS w FROM {_ITEM_DOCS})"


def _ranked_items(word: str) -> str:
    return f"""(SELECT i.*, -(greatest(ln((n - d + 0.5) / (d + 0.5)), CASE WHEN ln((n - d + 0.5) / (d + 0.5)) > 0 THEN 0 ELSE 1e-6 END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(w) / (total / n)))) AS rank
        FROM (SELECT *, len(list_filter(w, lambda x: x = '{word}')) AS f FROM {_IT}) i, (SELECT count(*)::DOUBLE AS n, sum(len(w))::DOUBLE AS total, count_if(list_contains(w, '{word}'))::DOUBLE AS d FROM {_IT}) s WHERE f > 0)"""


@query(f"SELECT item_id, title, updated_at, 'ranked' AS found_by FROM (SELECT *, round(rank, 6) AS r FROM {_ranked_items('17')} ORDER BY r, item_id LIMIT 50) WHERE collection_id < 'src5'")
def item_search_ranked(spark, sf):
    return fts.search_items(_items(spark, sf), "17").join(_items(spark, sf).where("collection_id < 'src5'").select("item_id"), "item_id", "left_semi")


@query(f"SELECT item_id, title, updated_at, 'like' AS found_by FROM {_ITEM_DOCS} WHERE lower(title) LIKE '%itle%' OR lower(text) LIKE '%itle%'")
def item_search_like_fallback(spark, sf):
    return fts.search_items(_items(spark, sf), "itle")


@query(f"""
    WITH top AS (SELECT *, row_number() OVER (ORDER BY round(rank, 6), item_id) AS k FROM {_ranked_items('title')} WHERE collection_id = (SELECT max(collection_id) FROM {_ITEM_DOCS}) ORDER BY round(rank, 6), item_id LIMIT 5),
    p AS (SELECT k, item_id, '--- ' || title || ' ---' || chr(10) || substr(body, 1, 1200) || chr(10) || chr(10) AS part FROM top WHERE body <> ''),
    b AS (SELECT *, coalesce(sum(strlen(part)) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
    SELECT CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS place, item_id, substr(part, 1, list_max(list_filter(range(0, length(part) + 1), lambda n: strlen(substr(part, 1, n)) <= 2500 - before))) AS part FROM b WHERE before < 2500
""")
def ask_context_budget(spark, sf):
    items = _items(spark, sf)
    collection = items.agg(F.max("collection_id")).first()[0]
    return fts.context(items, "title", collection, budget=2500)


# texts

@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'TEXTO ' || p_name WHEN 1 THEN p_name ELSE '\"' || p_name || '\"' END AS body FROM part")
def model_text_cleaned(spark, sf):
    k = F.col("p_partkey") % 3
    raw = F.when(k == 0, F.concat(F.lit(" Texto corregido: TEXTO "), "p_name", F.lit("<end_of_turn>rest<eos>"))).when(k == 1, F.concat(F.lit("```text\n"), "p_name", F.lit("\n```"))).otherwise(F.concat(F.lit('"'), "p_name", F.lit('"\n')))
    return read(spark, sf, "part").select("p_partkey", t.model_text(raw).alias("body"))


@query("SELECT p_partkey, '[' || p_partkey || ', [2]]' AS array FROM part")
def model_array_cleaned(spark, sf):
    return read(spark, sf, "part").select("p_partkey", t.model_array(F.concat(F.lit("Here it is: ["), F.col("p_partkey").cast("string"), F.lit(", [2]] and more<eos>"))).alias("array"))


@query(r"SELECT p_partkey, p_name AS manual, 'a\n' || left(p_name, 7) || '…' AS log, p_name || '.png' AS file, 'assets/' || p_name || '.png' AS asset, 'new/' || p_name AS moved, CASE p_partkey % 3 WHEN 0 THEN 'a_v2.png' WHEN 1 THEN 'a_v' || (p_size + 1) || '.png' ELSE 'a.b_v2' END AS next, p_name || '_page_' || p_size || '.png' AS page FROM part")
def text_helpers(spark, sf):
    k, name = F.col("p_partkey") % 3, F.col("p_name")
    version = F.when(k == 0, "a.png").when(k == 1, F.concat(F.lit("a_v"), F.col("p_size").cast("string"), F.lit(".png"))).otherwise("a.b")
    p = read(spark, sf, "part")
    return p.select(
        "p_partkey", t.manual_value(F.concat(F.lit(" «—"), name, F.lit("”’ "))).alias("manual"), t.log_preview(F.concat(F.lit("a\n"), name, F.lit("........................")), 10).alias("log"), t.file_name(F.concat(F.lit("C:\\x\\"), name, F.lit(".png"))).alias("file"),
        t.asset_path(F.concat(F.lit("C:\\assets\\old\\assets\\"), name, F.lit(".png"))).alias("asset"), t.moved_path(F.concat(F.lit("old/"), name), "old/", "new/").alias("moved"), F.when(k == 2, "a.b_v2").otherwise(t.next_version(version)).alias("next"), t.page_file(name, F.col("p_size")).alias("page"),
    )


@query("SELECT event_id, CASE WHEN m >= 1440 THEN (m // 1440) || ' d ago' WHEN m >= 60 THEN (m // 60) || ' h ago' WHEN m > 0 THEN m || ' min ago' ELSE 'a moment ago' END AS age, CASE WHEN trunc(value - 3) >= 1 THEN trunc(value - 3)::INTEGER ELSE 1 END AS page, ['ogg', 'm4a', 'mp3', 'webm'][event_id % 4 + 1] AS extension FROM (SELECT *, (event_id * 37 % 5000) AS m FROM events)")
def small_labels(spark, sf):
    minutes = F.col("event_id") * 37 % 5000
    now = F.lit(10**12)
    mime = _picked(("audio/OGG", "audio/mp4", "audio/mpeg;x", "video/x"), F.col("event_id") % 4)
    return read(spark, sf, "events").select("event_id", t.age_label(now - minutes * 60000 - 5, now).alias("age"), t.layout_page(F.col("value") - 3).alias("page"), t.dictation_extension(mime).alias("extension"))


@query("""SELECT c_custkey, c_name || ' {"a b":"x  y","n":[1,2]}' AS good, c_name || ' not {json' AS bad FROM customer""")
def item_search_text(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", t.search_text(F.col("c_name"), F.lit('{ "a b" : "x  y",\n "n": [1, 2] }')).alias("good"), t.search_text(F.col("c_name"), F.lit("not {json")).alias("bad"))


@query("SELECT p_partkey, '{\"v\": ' || p_size || '}' AS framed, 'bare ' || p_name AS bare FROM part")
def framed_output(spark, sf):
    body = F.concat(F.lit('{"v": '), F.col("p_size").cast("string"), F.lit("}"))
    out = F.concat(F.lit("loading\n===EMBED_BEGIN===\n"), body, F.lit("\n===EMBED_END===\nbye"))
    return read(spark, sf, "part").select("p_partkey", t.framed(out, "EMBED").alias("framed"), t.framed(F.concat(F.lit(" bare "), "p_name", F.lit("\n")), "EMBED").alias("bare"))


# notes



@query("SELECT p_partkey, TRUE AS plain, '<p>' || p_name || ' &lt;x<br>y</p><p>&quot;' || p_type || '&quot; &amp; more</p>' AS html, FALSE AS tagged FROM part")
def note_legacy_to_html(spark, sf):
    raw = F.concat("p_name", F.lit(' <x\r\ny\n\n\n"'), "p_type", F.lit('" & more '))
    return read(spark, sf, "part").select("p_partkey", notes.is_plain(raw).alias("plain"), notes.plain_to_html(raw).alias("html"), notes.is_plain(F.concat(F.lit("<b>"), "p_name", F.lit("</b>"))).alias("tagged"))


# what is written, and what a browser makes of it
_HREFS = [
    (" x.org", "https://x.org/"), ("HTTP://Y", "http://y/"), ("mailto:a@b", "mailto:a@b"), ("javascript:alert(1)", None), ("#top ", "#top"), ("http://Ex.ORG:80/a b?q=é#ñ", "http://ex.org/a%20b?q=%C3%A9#%C3%B1"), ("https:\\\\x.org\\p", "https://x.org/p"),
    ("http://x.org:8080/a/./b/../c", "http://x.org:8080/a/c"), ("TEL:+34 600", "tel:+34 600"), ("http://x y/", None), ("https://x.org:99999/", None), ("ftp://x.org", None), ("https://ñandú.org/", "https://xn--and-6ma2c.org/"), ("http://u:p@X.org", "http://u:p@x.org/"), (" ", None),
]
_SQL = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"


@query(f"SELECT p_partkey, CASE WHEN p_partkey % {len(_HREFS) + 1} = {len(_HREFS)} THEN 'https://x.org/' || p_partkey || '?n=' || replace(p_name, ' ', '%20') ELSE [{', '.join(_SQL(b) for _, b in _HREFS)}][p_partkey % {len(_HREFS) + 1} + 1] END AS href FROM part")
def note_links(spark, sf):
    k, n = F.col("p_partkey"), len(_HREFS) + 1
    raw = F.when(k % n == n - 1, F.concat(F.lit("X.org/"), k.cast("string"), F.lit("?n="), F.col("p_name"))).otherwise(F.get(F.array(*[F.lit(a) for a, _ in _HREFS]), (k % n).cast("int")))
    return read(spark, sf, "part").select("p_partkey", notes.link(raw).alias("href"))


@query("""
    WITH h AS (SELECT p_partkey, list_reduce(list_transform(range(0, len(x), 2), lambda i: CAST('0x' || substr(x, CAST(i AS INTEGER) + 1, 2) AS HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT, 14695981039346656037::HUGEINT) AS h FROM (SELECT p_partkey, hex(encode(p_name || ' ñ')) AS x FROM part))
    SELECT p_partkey, CAST(CASE WHEN h >= 9223372036854775808::HUGEINT THEN h - 18446744073709551616::HUGEINT ELSE h END AS BIGINT) AS key FROM h
""")
def text_cache_key(spark, sf):
    return read(spark, sf, "part").select("p_partkey", t.cache_key(F.concat("p_name", F.lit(" ñ"))).alias("key"))


@query("SELECT p_partkey, p_name || ' ?a??' AS sound FROM part")
def text_sound(spark, sf):
    broken = F.concat(F.encode("p_name", "UTF-8"), F.unhex(F.lit("20EDB29D61EDA080EDBFBF"))).cast("string")
    return read(spark, sf, "part").select("p_partkey", t.sound_text(broken).alias("sound"))


@query("SELECT page_id, count(*) AS n FROM (SELECT page_id FROM pages) GROUP BY page_id")
def note_sanitised_pages(spark, sf):
    shown = read(spark, sf, "pages").select("page_id", notes.rendered(F.col("html")).alias("h"))
    bad = F.col("h").rlike(r"(?i)<\s*(script|style|iframe|object|div|section|article|html|body|head|span|img)\b") | F.col("h").rlike(r"(?i)href=\"javascript")
    return shown.where(~bad).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, p_partkey % 3 = 0 AS empty, p_partkey % 2 = 1 AS changed FROM part")
def note_states(spark, sf):
    k = F.col("p_partkey")
    content = F.when(k % 3 == 0, "<p> <br></p><script>x</script>").otherwise(F.concat(F.lit("<p>"), "p_name", F.lit("</p>")))
    after = F.when(k % 2 == 1, F.concat(F.lit("<div>other "), "p_name", F.lit("</div>"))).otherwise(F.concat(F.lit("<section>"), "p_name", F.lit("</section>")))
    return read(spark, sf, "part").select("p_partkey", notes.is_empty(content).alias("empty"), notes.changed(F.concat(F.lit("<p>"), "p_name", F.lit("</p>")), after).alias("changed"))


# JSON

@query("SELECT p_partkey, p_size AS page, 'unknown' AS category, p_retailprice AS x, 0.0::DOUBLE AS width, 'text' AS label, '' AS content, 0 AS block_order FROM part")
def layout_parse(spark, sf):
    regions = F.concat(F.lit('[{"page": '), F.col("p_size").cast("string"), F.lit(', "bbox": {"x": '), F.col("p_retailprice").cast("string"), F.lit("}}]"))
    p = read(spark, sf, "part").select("p_partkey", F.element_at(jsons.regions(regions), 1).alias("r"), F.element_at(jsons.blocks(F.lit('[{"label": "text", "bbox": {}}]')), 1).alias("b"))
    return p.select("p_partkey", "r.page", "r.category", "r.bbox.x", "r.bbox.width", "b.label", "b.content", F.col("b.order").alias("block_order"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS segments, CASE WHEN p_partkey % 2 = 0 THEN trim(p_name) ELSE '' END AS body, CASE WHEN p_partkey % 2 = 0 THEN p_size::VARCHAR END AS size, CASE WHEN p_partkey % 2 = 0 THEN 'null' END AS none FROM part")
def json_lenient(spark, sf):
    even = F.col("p_partkey") % 2 == 0
    segments = jsons.segments(F.when(even, F.to_json(F.array(F.struct(F.lit(0.0).alias("start"), F.lit(1.0).alias("end"), F.concat(F.lit(" "), "p_name").alias("text"))))).otherwise("{broken"))
    record = jsons.metadata(F.when(even, F.concat(F.lit('{"size": '), F.col("p_size").cast("string"), F.lit(', "none": null}'))).otherwise("no json"))
    return read(spark, sf, "part").select("p_partkey", F.size(segments).alias("segments"), plugins.transcript(segments).alias("body"), F.try_element_at(record, F.lit("size")).alias("size"), F.try_element_at(record, F.lit("none")).alias("none"))


@query("""SELECT p_partkey, p_partkey % 3 = 0 AS is_json, p_partkey % 3 <> 1 AS can_expand, 'Size' AS labels, TRUE AS same FROM part""")
def json_cells(spark, sf):
    k = F.col("p_partkey") % 3
    value = F.when(k == 0, F.concat(F.lit('{"a": '), F.col("p_size").cast("string"), F.lit("}"))).when(k == 1, F.col("p_name")).otherwise(F.repeat(F.lit("long "), 30))
    cell = jsons.cell(value, "-")
    technical = jsons.technical([("File name", F.col("p_name"), ["file", "nombre"]), ("Size", t.format_bytes(F.col("p_size").cast("long") * 2048), ["size of file"]), ("Path", F.lit(""), [])], F.array(F.lit(" Nómbre "), F.lit("other")))
    one, two = F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.col("p_name")), F.create_map(F.lit("a"), F.col("p_name"), F.lit("b"), F.lit("1"))
    return read(spark, sf, "part").select("p_partkey", cell["is_json"].alias("is_json"), cell["can_expand"].alias("can_expand"), F.array_join(F.transform(technical, lambda e: e["label"]), ",").alias("labels"), (jsons.signature(one) == jsons.signature(two)).alias("same"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 1 END AS n, CASE p_partkey % 3 WHEN 2 THEN 'Ana' ELSE p_name END AS subject FROM part")
def triples_parse_llm_json(spark, sf):
    q = F.concat(F.lit('{"subject": "'), "p_name", F.lit('", "predicate": "is", "object": "'), "p_type", F.lit('"}'))
    whole = F.concat(F.lit("```json\n["), q, F.lit(', {"subject": "x", "predicate": "", "object": "y"},\n'), q, F.lit(' {"sujeto": "Ana", "predicado": "ve", "objeto": "mar"},]\n```'))
    broken = F.concat(F.lit('Answer: ['), q, F.lit(', {"subject": "z", }, {"subject": oops}]'))
    spanish = F.lit('{“sujeto”: “Ana”, "predicado": "ve", "objeto": "mar"}')
    k = F.col("p_partkey") % 3
    found = jsons.triples(F.when(k == 0, whole).when(k == 1, broken).otherwise(spanish))
    return read(spark, sf, "part").select("p_partkey", F.size(found).alias("n"), found[0]["subject"].alias("subject"))


# decoding and routing

@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount, ['B-LOC', 'B-MISC', 'O'][list_position(v, list_max(v))] AS label, round(1 / (exp(v[1] - list_max(v)) + exp(v[2] - list_max(v)) + exp(v[3] - list_max(v))), 6) AS score
    FROM (SELECT *, [l_tax * 50, l_discount * 40, 1.0]::DOUBLE[] AS v FROM lineitem)
""")
def ner_best_label(spark, sf):
    logits = F.array(F.col("l_tax") * 50, F.col("l_discount") * 40, F.lit(1.0))
    best = de.best_label(logits, ["B-LOC", "B-MISC", "O"])
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", best["label"].alias("label"), F.round(best["score"], 6).alias("score"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_suppkey % 3 = 0 THEN l_discount >= 0.03 WHEN l_suppkey % 3 = 1 THEN l_discount >= 0.065 ELSE FALSE END AS passes FROM lineitem")
def ner_thresholds(spark, sf):
    label = _picked(("B-PER", "I-MISC", "O"), F.col("l_suppkey") % 3)
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", de.passes(label, F.col("l_discount") * 10, 0.5).alias("passes"))


_ROUTE = "(SELECT l_orderkey AS doc, l_partkey AS id, l_suppkey AS id2, l_linenumber AS n, ['person', 'place', 'date', 'institution', 'misc'][l_partkey % 5 + 1] AS entity_type, ['onnx', 'spacy', 'rule_based'][l_suppkey % 3 + 1] AS source FROM lineitem)"


@query(f"""
    WITH f AS (SELECT *, max(CASE WHEN entity_type IN ('person', 'place') AND source = 'onnx' THEN 1 ELSE 0 END) OVER w AS oc, max(CASE WHEN entity_type IN ('person', 'place') AND source = 'spacy' THEN 1 ELSE 0 END) OVER w AS sc, max(CASE WHEN entity_type = 'misc' AND source = 'onnx' THEN 1 ELSE 0 END) OVER w AS om FROM {_ROUTE} WINDOW w AS (PARTITION BY doc))
    SELECT doc, id, id2, n FROM f WHERE CASE entity_type WHEN 'date' THEN source = 'rule_based' WHEN 'institution' THEN source <> 'spacy' WHEN 'misc' THEN source = CASE WHEN om = 1 THEN 'onnx' ELSE 'spacy' END ELSE source = CASE WHEN oc = 1 THEN 'onnx' WHEN sc = 1 THEN 'spacy' ELSE 'rule_based' END END
""")
def ner_hybrid_routing(spark, sf):
    e = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("id2"), F.col("l_linenumber").alias("n"), _picked(("person", "place", "date", "institution", "misc"), F.col("l_partkey") % 5).alias("entity_type"), _picked(("onnx", "spacy", "rule_based"), F.col("l_suppkey") % 3).alias("source"))
    return de.routed(e, "doc").select("doc", "id", "id2", "n")


@query("SELECT conv_id, turn, count(*) AS paragraphs, sum(length(p))::BIGINT AS chars FROM (SELECT conv_id, turn, unnest(regexp_extract_all(text || chr(10) || chr(10) || 'x' || chr(10), '([^\\n]*[^ \\t\\r\\n\\f\\v][^\\n]*\\n)+')) AS p FROM conversations) GROUP BY conv_id, turn")
def ner_paragraph_spans(spark, sf):
    spans = de.spans_of_paragraphs(F.concat("text", F.lit("\n\nx\n")))
    c = read(spark, sf, "conversations").select("conv_id", "turn", F.explode(spans).alias("s"))
    return c.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("paragraphs"), F.sum(F.col("s.end") - F.col("s.start")).alias("chars"))


@query("SELECT p_partkey, p_partkey % 4 < 2 AS institution, ['person', 'place', 'date', NULL][p_partkey % 4 + 1] AS spacy, ['person', 'institution', NULL, 'misc'][p_partkey % 4 + 1] AS alias, strpos(lower('El ' || p_name || ' y ' || p_name), lower(p_name)) - 1 AS start FROM part")
def ner_names(spark, sf):
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    value = F.concat(_picked(("«Real ", " cabildo ", "El Real ", "x"), k), name)
    return read(spark, sf, "part").select(
        "p_partkey", de.is_institution(value).alias("institution"), de.named(_picked(("PER", "GPE", "TIME", "NORP"), k), de.SPACY_TYPES).alias("spacy"), de.aliased(_picked((" Persona", "Institución", "thing", "otro"), k)).alias("alias"),
        de.span_of(F.concat(F.lit("El "), F.upper(name), F.lit(" y "), name), name)["start"].cast("long").alias("start"),
    )


@query("SELECT p_partkey, 'Ana-' || p_partkey AS value, 2 AS start, 6 + length(p_partkey::VARCHAR)::INTEGER AS stop, 'person' AS entity_type, 0.7::DOUBLE AS confidence FROM part UNION ALL SELECT p_partkey, 'Real Audiencia', 10 + length(p_partkey::VARCHAR)::INTEGER, 25 + length(p_partkey::VARCHAR)::INTEGER, 'institution', 0.9 FROM part")
def ner_decode_chunks(spark, sf):
    key = F.col("p_partkey").cast("string")
    chunk = F.concat(F.lit("x Ana-"), key, F.lit(" y, Real Audiencia."))
    n = F.length(key)

    def piece(text, start, end, label, score):
        return F.struct(F.lit(text).alias("piece"), start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(label).alias("label"), F.lit(score).alias("score"))

    at = n + 10
    pieces = F.array(piece("An", F.lit(2), F.lit(4), "B-PER", 0.8), piece("##a", F.lit(4), F.lit(5), "B-PER", 0.6), piece("y", at - 3, at - 2, "O", 0.9), piece("Real", at, at + 4, "B-ORG", 0.9), piece("Audiencia", at + 5, at + 14, "I-ORG", 0.9))
    found = read(spark, sf, "part").select("p_partkey", F.explode(de.decode(chunk, pieces)).alias("e"))
    return found.select("p_partkey", "e.value", "e.start", F.col("e.end").alias("stop"), "e.entity_type", F.round("e.confidence", 6).alias("confidence"))


# layouts

def _blocks(spark, sf):
    return _as_blocks(read(spark, sf, "lineitem"))


def _as_blocks(li):
    labels = ("doc_title", "text", "table", "image", "vision_footnote", "paragraph")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", _picked(labels, F.col("l_partkey") % 6).alias("label"), (F.col("l_linenumber") - 2).alias("page"), F.concat(F.lit("c"), F.col("l_suppkey").cast("string")).alias("content"))


_BLOCK = "(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ['doc_title', 'text', 'table', 'image', 'vision_footnote', 'paragraph'][l_partkey % 6 + 1] AS label, greatest(l_linenumber - 2, 1) AS page, 'c' || l_suppkey AS content FROM lineitem)"


@query(f"SELECT l_orderkey, page, count(*) AS blocks, (SELECT array_to_string(list_sort(list(DISTINCT y.page)), ',') FROM {_BLOCK} y WHERE y.l_orderkey = x.l_orderkey) AS pages FROM {_BLOCK} x GROUP BY l_orderkey, page")
def layout_pages_counts(spark, sf):
    b = _blocks(spark, sf)
    every = lay.pages_of(b, b.where("l_linenumber > 3"), ["l_orderkey"]).select("l_orderkey", F.array_join("pages", ",").alias("pages"))
    return lay.page_counts(b, ["l_orderkey"]).join(every, "l_orderkey")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, label FROM {_BLOCK} WHERE page = 2 AND label IN ('text', 'paragraph')")
def layout_filter_type(spark, sf):
    return lay.of_type(lay.on_page(_blocks(spark, sf), 2), "text").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "label")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE label WHEN 'doc_title' THEN '## ' || content WHEN 'table' THEN '---' || chr(10) || content || chr(10) || '---' WHEN 'image' THEN NULL WHEN 'vision_footnote' THEN 'Note: ' || content ELSE content END AS block, CASE l_partkey % 6 WHEN 0 THEN '## ' || content WHEN 1 THEN content WHEN 2 THEN '---' || chr(10) || content || chr(10) || '---' WHEN 3 THEN NULL WHEN 4 THEN '```' || chr(10) || content || chr(10) || '```' ELSE NULL END AS region FROM {_BLOCK}")
def layout_texts(spark, sf):
    category = _picked(("Title", "plain text", "table", "figure", "code", "Footer"), F.col("l_partkey") % 6)
    return _blocks(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", lay.block_text(F.col("label"), F.col("content")).alias("block"), lay.region_text(category, F.concat(F.lit(" "), "content")).alias("region"))


@query("""
    SELECT l_orderkey, l_linenumber AS block_id, 'c' || l_suppkey AS preview, 'region' AS overlay_source, (l_partkey % 97)::DOUBLE AS x, (l_suppkey % 89)::DOUBLE AS y FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1
""")
def layout_block_overlays(spark, sf):
    views = _views(spark, sf)
    return views.select("l_orderkey", "block_id", "preview", "overlay_source", F.col("overlay_bbox.x").alias("x"), F.col("overlay_bbox.y").alias("y"))


@query("SELECT l_orderkey, count(*) AS views, count_if(fits)::BIGINT AS matched, min(prev) AS first_preview FROM (SELECT l_orderkey, 'c' || l_suppkey AS prev, TRUE AS fits FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1) GROUP BY l_orderkey")
def layout_block_views(spark, sf):
    return _views(spark, sf).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("views"), F.count_if(F.col("overlay_source") == "region").alias("matched"), F.min("preview").alias("first_preview"))


def _views(spark, sf):
    one = _as_blocks(rel.latest(read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_orderkey", "l_linenumber"], F.asc("l_partkey"), F.asc("l_suppkey")))
    box = g.box(F.col("l_partkey") % 97, F.col("l_suppkey") % 89, F.lit(10), F.lit(10))
    b = one.select("l_orderkey", F.col("l_linenumber").alias("block_id"), "label", "content", box.alias("bbox"), F.lit(None).cast("int").alias("order"), F.lit(0).alias("group"), "page")
    r = one.select("l_orderkey", F.col("l_linenumber").alias("region_id"), F.col("label").alias("category"), box.alias("bbox"), F.lit(0).alias("group"), "page")
    return lay.block_views(b, r, ["l_orderkey"])


@query("SELECT l_orderkey, string_agg('p' || l_suppkey, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY l_linenumber) AS text FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1) GROUP BY l_orderkey")
def document_page_text(spark, sf):
    one = rel.latest(_blocks(spark, sf), ["l_orderkey", "l_linenumber"], F.asc("l_partkey"), F.asc("l_suppkey"))
    return lay.document_text(one.select("l_orderkey", F.col("l_linenumber").alias("page"), F.concat(F.lit("p"), F.col("l_suppkey").cast("string")).alias("text")), ["l_orderkey"])


@query("SELECT l_orderkey, max(l_partkey) AS width, max(l_suppkey) AS height, count(*) AS regions, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) AS pages FROM lineitem GROUP BY l_orderkey")
def layout_accumulated(spark, sf):
    region = F.array(F.struct(F.col("l_suppkey").alias("x")))
    pages = read(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("page"), F.col("l_partkey").alias("width"), F.col("l_suppkey").alias("height"), region.alias("regions"), region.alias("blocks"))
    a = lay.accumulated(pages, ["l_orderkey"])
    return a.select("l_orderkey", "width", "height", F.size("regions").cast("long").alias("regions"), F.array_join(F.transform("blocks", lambda b: b["page"].cast("string")), ",").alias("pages"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(least(greatest(l_quantity / 40, 0), 1), 4) AS c, floor(l_discount * 5 * 1700 + 0.5)::INTEGER AS px, CASE WHEN greatest(w, h) > 1000 OR w * h > 1000000 THEN round(w * least(1.0, 1000.0 / greatest(w, h)))::INTEGER ELSE w::INTEGER END AS width, printf('x:%.2f y:%.2f w:%.2f h:%.2f', l_discount, l_tax, 0.5::DOUBLE, 1.0::DOUBLE) AS label FROM (SELECT *, (l_partkey % 1900 + 10)::DOUBLE AS w, (l_suppkey % 1900 + 10)::DOUBLE AS h FROM lineitem)")
def page_geometry(spark, sf):
    box = g.box(F.col("l_discount"), F.col("l_tax"), F.lit(0.5), F.lit(1.0))
    wide = g.box(F.col("l_discount") * 5, F.col("l_tax"), F.lit(0.5), F.lit(1.0))
    small = g.downscaled((F.col("l_partkey") % 1900 + 10).cast("double"), (F.col("l_suppkey") % 1900 + 10).cast("double"))
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", g.clamped(F.col("l_quantity") / 40).alias("c"), g.pixels(wide, F.lit(1700), F.lit(2200))["x"].alias("px"), small["width"].alias("width"), lay.box_label(box).alias("label"))


def _region_rows(spark, sf, pages: int | None = 200):
    k = F.col("l_orderkey")
    return read(spark, sf, "lineitem").select((k % pages if pages else k).alias("page"), F.concat_ws("-", k, "l_linenumber", "l_partkey", "l_suppkey").alias("region_id"), (F.col("l_partkey") % 900).cast("int").alias("x"), (F.col("l_suppkey") * 7 % 1100).cast("int").alias("y"), (F.col("l_partkey") % 300 + 40).cast("int").alias("width"), (F.col("l_suppkey") % 40 + 8).cast("int").alias("height"))


@query()
def reading_order_gaps(spark, sf):
    return lay.gap_filled_order(_region_rows(spark, sf), ["page"])


def _overlap_sql(page: str) -> str:
    return f"""
        WITH RECURSIVE r AS (SELECT {page} AS page, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS region_id, (l_partkey % 900)::INTEGER AS x, (l_suppkey * 7 % 1100)::INTEGER AS y, (l_partkey % 300 + 40)::INTEGER AS width, (l_suppkey % 40 + 8)::INTEGER AS height FROM lineitem),
        e AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY x, y, region_id) AS n FROM r),
        f AS (SELECT page, n, [struct_pack(a := x, b := x + width)] AS spans, 0 AS k FROM e WHERE n = 1
              UNION ALL SELECT page, n, CASE WHEN pos = 0 THEN list_append(spans, struct_pack(a := a, b := b)) ELSE list_concat(spans[1:pos - 1], [struct_pack(a := least(a, spans[pos].a), b := greatest(b, spans[pos].b))], spans[pos + 1:len(spans)]) END, CAST(CASE WHEN pos = 0 THEN len(spans) ELSE pos - 1 END AS INTEGER)
              FROM (SELECT *, coalesce(list_position(shared, list_max(list_filter(shared, lambda s: s >= least(200, b - a) AND s > 0))), 0) AS pos
                    FROM (SELECT e.page, e.n, f.spans, e.x AS a, e.x + e.width AS b, list_transform(f.spans, lambda s: least(e.x + e.width, s.b) - greatest(e.x, s.a)) AS shared FROM f JOIN e ON e.page = f.page AND e.n = f.n + 1)))
        SELECT e.page, region_id, x, y, width, height, f.k AS "column" FROM e JOIN f ON f.page = e.page AND f.n = e.n
    """


@query(_overlap_sql("l_orderkey % 200"))
def columns_by_overlap(spark, sf):
    return lay.overlap_columns(_region_rows(spark, sf), ["page"])


@query(_overlap_sql("l_orderkey"))
def columns_by_overlap_pages(spark, sf):
    return lay.overlap_columns(_region_rows(spark, sf, None), ["page"])


@query()
def columns_by_grid(spark, sf):
    return lay.grid_columns(_region_rows(spark, sf), ["page"])


# prompts

@query("""SELECT doc_id AS job_id, ['summarize', 'extract_entities', 'classify', 'ask'][doc_id % 4 + 1] AS job, CASE doc_id % 4 WHEN 0 THEN 'asset' WHEN 3 THEN 'collection' ELSE 'item' END AS target_type, ['a', 'i', 'i', 'k'][doc_id % 4 + 1] AS target_id, [512, 1024, 256, 512][doc_id % 4 + 1] AS max_tokens,
    trim(coalesce(text, '')) <> '' AS ready, CASE WHEN trim(coalesce(text, '')) = '' THEN 'no text' END AS error FROM documents""")
def llm_requests(spark, sf):
    kind = _picked(("summarize_asset", "extract_entities", "classify", "ask"), F.col("doc_id") % 4)
    jobs_ = read(spark, sf, "documents").select(F.col("doc_id").alias("job_id"), kind.alias("kind"), F.lit("i").alias("item_id"), F.lit("a").alias("asset_id"), F.lit("k").alias("collection_id"), "text", F.lit("one, two").alias("extra"))
    return prompts.requests(jobs_, 2048).select("job_id", "job", "target_type", "target_id", "max_tokens", F.col("prompt").isNotNull().alias("ready"), "error")


# files and recordings

@query("SELECT (SELECT count(DISTINCT k) FROM (SELECT p_type || p_size % 4 AS k, p_size FROM part WHERE p_size % 4 <> 3)) AS imported, (SELECT count(DISTINCT p_type) FROM part WHERE p_size % 4 = 3) AS rejected, (SELECT count(*) FROM part) - (SELECT count(DISTINCT p_type || p_size % 4) FROM part) AS skipped")
def import_counts(spark, sf):
    ext = _picked((".JPG", ".pdf", ".Mp3", ".exe"), F.col("p_size") % 4)
    case = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_type")).otherwise(F.lower("p_type"))
    return media.import_counts(read(spark, sf, "part").select(F.col("p_partkey").alias("place"), F.concat(F.lit("/in/"), case, ext).alias("path")))


@query("SELECT vec_id, round((embedding[1]::DOUBLE + embedding[2]::DOUBLE) / 2, 5) AS first, len(embedding) // 2 AS frames, len(embedding) * 2 AS samples, round((embedding[1]::DOUBLE + embedding[2]::DOUBLE) / 2, 5) AS between FROM embeddings WHERE len(embedding) % 2 = 0")
def audio_samples(spark, sf):
    e = read(spark, sf, "embeddings").where(F.size("embedding") % 2 == 0).withColumns({"m": media.mono(F.col("embedding"), F.lit(2)), "r": media.resampled(F.col("embedding"), F.lit(8000), F.lit(16000))})
    return e.select("vec_id", F.round(F.col("m")[0], 5).alias("first"), F.size("m").cast("long").alias("frames"), F.size("r").cast("long").alias("samples"), F.round(F.col("r")[1], 5).alias("between"))


@query("SELECT 'n' || n_nationkey AS id, 2 AS version, n_name AS name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS items, (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = n_nationkey) AS assets FROM nation")
def export_documents(spark, sf):
    pieces = _fragments(spark, sf)
    d = F.from_json(F.concat("fragment", F.lit("]}")), "version int, collection struct<id: string, name: string>")
    heads = pieces.where("part = 0").select(F.col("collection_id").alias("id"), d.alias("d")).select("id", "d.version", F.col("d.collection.name").alias("name"))
    item = F.from_json(F.ltrim(F.col("fragment"), F.lit(",")), "assets array<struct<path: string>>")
    sums = pieces.where("part = 1").groupBy(F.col("collection_id").alias("id")).agg(F.count(F.lit(1)).alias("items"), F.sum(F.size(item["assets"])).alias("assets"))
    return heads.join(sums, "id", "left").select("id", "version", "name", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("assets", F.lit(0)).alias("assets"))


_AT = "2020-01-01T00:00:00.000Z"


def _fragments(spark, sf):
    from quillet.operators.store import newest
    from quillet.sources import corpus

    s = corpus.store(spark, sf)
    texts = lambda name: newest(s[name], "asset_id").select("asset_id", F.col("text_content").alias("text"))
    return media.export_fragments(s["collections"], s["items"], s["assets"], texts("extractions"), texts("transcriptions"), s["notes"], s["annotations"], _AT)


_NEWEST = "(SELECT asset_id, text_content FROM {} QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY created_at DESC, id DESC) = 1)"
_X, _T = _NEWEST.format(sq._EXTRACTIONS), _NEWEST.format(sq._TRANSCRIPTIONS)


@query(f"""
    WITH box AS (SELECT 'o' || l_orderkey AS asset_id, list(struct_pack(x := l_discount, y := l_tax, width := 0.1::DOUBLE, height := 0.2::DOUBLE) ORDER BY l_linenumber, l_partkey, 'a' || {sq._LINE}) FILTER (l_partkey % 2 = 0) AS b FROM lineitem WHERE l_linenumber <= 3 GROUP BY l_orderkey),
    a AS (SELECT 'c' || o_custkey AS item_id, list(struct_pack(filename := o_orderkey || '.png', "type" := ['image', 'pdf', 'audio'][o_orderkey % 3 + 1], size := o_orderkey * 7, path := 'assets/' || o_orderkey || '.png', text := coalesce(x.text_content, t.text_content), bboxes := coalesce(b, [])) ORDER BY o_orderkey % 5, o_orderkey) AS assets
        FROM orders LEFT JOIN box ON box.asset_id = 'o' || o_orderkey LEFT JOIN {_X} x ON x.asset_id = 'o' || o_orderkey LEFT JOIN {_T} t ON t.asset_id = 'o' || o_orderkey GROUP BY o_custkey),
    n AS (SELECT 'c' || o_custkey AS item_id, list(struct_pack(content := '<p>' || o_orderpriority || '</p>', "createdAt" := o_orderkey, "updatedAt" := o_orderkey) ORDER BY -o_orderkey) AS notes FROM orders WHERE o_orderkey % 5 = 0 GROUP BY o_custkey),
    i AS (SELECT i.*, row_number() OVER (PARTITION BY collection_id ORDER BY updated_at DESC, id) AS k, coalesce(assets, []) AS assets, coalesce(notes, []) AS notes FROM {sq._ITEMS} i LEFT JOIN a ON a.item_id = i.id LEFT JOIN n ON n.item_id = i.id)
    SELECT collection_id, 1 AS part, updated_at, id AS item_id, CASE WHEN k > 1 THEN ',' ELSE '' END || to_json(struct_pack(id := id, title := title, metadata := metadata, "createdAt" := created_at, "updatedAt" := updated_at, assets := assets, notes := notes))::VARCHAR AS fragment FROM i
    UNION ALL SELECT id, 0, NULL, NULL, '{{"version":2,"exportedAt":"{_AT}","collection":' || to_json(struct_pack(id := id, name := name, description := NULL::VARCHAR, "createdAt" := created_at, "updatedAt" := updated_at))::VARCHAR || ',"items":[' FROM {sq._COLLECTIONS}
    UNION ALL SELECT id, 2, NULL, NULL, ']}}' FROM {sq._COLLECTIONS}
""")
def export_whole(spark, sf):
    return _fragments(spark, sf)


# queues

@query("SELECT count(*) AS waiting, count(DISTINCT user_id) AS targets FROM (SELECT user_id FROM events WHERE event_id < 10 UNION SELECT user_id FROM events WHERE event_id < 40)")
def job_offered(spark, sf):
    e = read(spark, sf, "events").select("user_id", "event_id")
    waiting = e.where("event_id < 10").dropDuplicates(["user_id"])
    return jobs.offered(waiting, e.where("event_id < 40"), ["user_id"]).agg(F.count(F.lit(1)).alias("waiting"), F.countDistinct("user_id").alias("targets"))


@query("SELECT kind, count(*) AS jobs FROM (SELECT unnest(CASE event_id % 3 WHEN 0 THEN ['ner', 'fts', 'embed'] WHEN 1 THEN ['geocode'] ELSE ['fts', 'ner'] END) AS kind FROM events WHERE event_id % 2 = 0) GROUP BY kind")
def job_chain(spark, sf):
    done = read(spark, sf, "events").select(_picked(("ocr", "ner", "enrich"), F.col("event_id") % 3).alias("kind"), F.col("user_id").alias("target"), F.when(F.col("event_id") % 2 == 0, "complete").otherwise("error").alias("status"))
    return jobs.triggered(done).groupBy("kind").agg(F.count(F.lit(1)).alias("jobs"))


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def job_states(spark, sf):
    return jobs.states(read(spark, sf, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id"]).drop("ts")


@query("SELECT conv_id, turn, text AS asset_text FROM (SELECT conv_id, turn, trim(e || CASE WHEN e <> '' AND u <> '' THEN ' ' ELSE '' END || u) AS text FROM (SELECT conv_id, turn // 2 AS turn, coalesce(first(text ORDER BY turn) FILTER (role <> 'user'), '') AS e, coalesce(first(text ORDER BY turn) FILTER (role = 'user'), '') AS u FROM conversations GROUP BY ALL)) WHERE text <> ''".replace("trim(e ||", "(e ||"))
def asset_text_both(spark, sf):
    c = read(spark, sf, "conversations").withColumn("asset", F.floor(F.col("turn") / 2))
    oldest = lambda user: rel.latest(c.where((F.col("role") == "user") == user), ["conv_id", "asset"], F.asc("turn")).select("conv_id", "asset", F.col("text").alias("u" if user else "e"))
    both = oldest(False).join(oldest(True), ["conv_id", "asset"], "full_outer")
    text = F.concat_ws(" ", F.nullif("e", F.lit("")), F.nullif("u", F.lit("")))
    return both.select("conv_id", F.col("asset").alias("turn"), text.alias("asset_text")).where("asset_text <> ''")


@query("SELECT l_orderkey, array_to_string(list_sort(list_distinct(list_concat(list(l_returnflag), list(l_linestatus)))), ',') AS topics FROM lineitem GROUP BY l_orderkey")
def topic_set_union(spark, sf):
    s = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("a"), F.collect_set("l_linestatus").alias("b"))
    return s.select("l_orderkey", F.array_join(F.array_sort(F.array_union("a", "b")), ",").alias("topics"))
