"""Full-text search: BM25 over folded tokens, all phrases first, any phrase if no row has all.

A query's terms become phrases of tokens; a term of several tokens needs them side by side. One scan gives each document's length and how often it holds
each of the query's few phrases; only texts that may hold one (a test of the folded text for the phrase's first token) are cut into
tokens, the others only counted. Corpus figures are one row beside it, so a query costs a scan, a partial aggregate and a top-k, and no token is shuffled.

``facts`` written once, and ``stored_search`` over a written index, serve many queries: an index is partitioned by the hash of
its tokens, so a query reads the partitions of its own tokens alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillet.functions.text import fold, match_terms, quoted, search_text, store_terms, tokens
from quillet.operators.relational import ascii_like, merged_text

K1, B, FLOOR = 1.2, 0.75, 1e-6
#: Partitions of a written index.
PARTS = 64


def phrases(spark: SparkSession, terms: list[str]) -> list[list[str]]:
    """Each term's tokens, folded as documents are; terms without a token vanish, equal phrases count once."""
    if not terms:
        return []
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(terms)], "i int, t string").select("i", tokens(F.col("t")).alias("w")).orderBy("i").collect()  # a query's terms
    return [list(p) for p in dict.fromkeys(tuple(r["w"]) for r in rows if r["w"])]


def _count(words: Column, phrase: list[str]) -> Column:
    """How often a phrase stands in an array of tokens."""
    if len(phrase) == 1:
        return F.size(F.filter(words, lambda w: w == phrase[0]))
    return F.size(F.filter(words, lambda w, i: (w == phrase[0]) & F.reduce(F.array(*[F.get(words, i + k) == p for k, p in enumerate(phrase) if k]), F.lit(True), lambda a, b: a & F.coalesce(b, F.lit(False)))))


def index(docs: DataFrame, key: str = "doc_id", text: str = "text", positions: bool = True) -> DataFrame:
    """(token, key, tf, positions)."""
    if not positions:
        return docs.select(key, F.explode(tokens(F.col(text))).alias("token")).groupBy("token", key).agg(F.count(F.lit(1)).alias("tf"))
    spots = docs.select(key, F.posexplode(tokens(F.col(text))).alias("position", "token"))
    return spots.groupBy("token", key).agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("position")).alias("positions"))


def write_index(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> None:
    """The inverted index, partitioned by token, and each document's length, at ``path``: a rebuild from the documents."""
    part = F.pmod(F.xxhash64("token"), F.lit(PARTS))
    index(docs, key, text).withColumn("part", part).repartition("part").sortWithinPartitions("token").write.mode("overwrite").partitionBy("part").parquet(f"{path}/tokens")
    docs.select(key, F.size(tokens(F.col(text))).cast("long").alias("len")).write.mode("overwrite").parquet(f"{path}/lengths")


def ranked(hits: DataFrame, facts: DataFrame, n: int, key: str, carry: tuple[str, ...], relaxed: bool, scope: Column | None, limit: int | None) -> DataFrame:
    """Rows of (key, carry..., __len, __tf) with the corpus figures, ranked."""
    each = range(n)
    full = F.forall("__tf", lambda x: x > 0)
    hits = hits.join(F.broadcast(facts))  # one row
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("__len") / (F.col("__total") / F.col("__n")))

    def part(i: int) -> Column:
        df, f = F.col("__df")[i], F.col("__tf")[i]
        idf = F.log((F.col("__n") - df + 0.5) / (df + 0.5))
        return F.when(idf > 0, idf).otherwise(F.lit(FLOOR)) * f * (K1 + 1) / (f + norm)

    rank = part(0)
    for i in each[1:]:
        rank = rank + part(i)
    loose = (F.col("__full") == 0) & F.lit(relaxed and n > 1)
    found = hits.where(full | loose)
    found = found if scope is None else found.where(scope)
    found = found.select(key, *carry, F.round(-rank, 6).alias("rank"), F.when(loose, "relaxed").otherwise("strict").alias("strategy"))
    return found if limit is None else found.orderBy("rank", key).limit(limit)


def nothing(docs: DataFrame, key: str, carry: tuple[str, ...] = ()) -> DataFrame:
    return docs.select(key, *carry, F.lit(0.0).alias("rank"), F.lit("empty").alias("strategy")).where(F.lit(False))


def search(docs: DataFrame, terms: list[str], limit: int | None = 20, key: str = "doc_id", text: str = "text", relaxed: bool = True, carry: tuple[str, ...] = (), scope: Column | None = None) -> DataFrame:
    """(key, carry..., rank, strategy), best (most negative) first. ``scope`` filters before the limit; document frequencies stay global."""
    asked = phrases(docs.sparkSession, terms)
    if not asked:
        return nothing(docs, key, carry)
    folded = docs.select(key, *carry, fold(F.coalesce(F.col(text), F.lit(""))).alias("__f"))
    # a text's length is the number of places where a run of letters and digits starts: counted, not cut
    length = F.regexp_count("__f", F.lit(r"[\p{L}\p{N}]+"))
    may = F.lit(False)
    for p in asked:
        may = may | F.contains(F.col("__f"), F.lit(p[0]))
    words = F.regexp_extract_all("__f", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    tf = F.when(may, F.transform(F.array(words), lambda w: F.array(*[_count(w, p) for p in asked]))[0]).otherwise(F.array(*[F.lit(0)] * len(asked)))
    counted = folded.select(key, *carry, length.alias("__len"), tf.alias("__tf"))
    facts = counted.agg(
        F.count(F.lit(1)).alias("__n"), F.sum("__len").alias("__total"), F.array(*[F.count_if(F.col("__tf")[i] > 0) for i in range(len(asked))]).alias("__df"), F.count_if(F.forall("__tf", lambda x: x > 0)).alias("__full")
    )
    return ranked(counted.where(F.exists("__tf", lambda x: x > 0)), facts, len(asked), key, carry, relaxed, scope, limit)


def stored_search(spark: SparkSession, path: str, terms: list[str], limit: int | None = 20, key: str = "doc_id", relaxed: bool = True) -> DataFrame:
    """``search`` over a written index: only the partitions of the query's tokens are read."""
    asked = phrases(spark, terms)
    lengths = spark.read.parquet(f"{path}/lengths")
    if not asked:
        return nothing(lengths, key, ())
    wanted = list(dict.fromkeys(t for p in asked for t in p))
    places = {r["t"]: r["p"] for r in spark.createDataFrame([(t,) for t in wanted], "t string").select("t", F.pmod(F.xxhash64("t"), F.lit(PARTS)).alias("p")).collect()}  # a query's tokens
    rows = spark.read.parquet(f"{path}/tokens").where(F.col("part").isin(*set(places.values())) & F.col("token").isin(*wanted))
    by = rows.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("token", "positions"))).alias("m"))
    at = lambda t: F.coalesce(F.col("m")[t], F.array().cast("array<int>"))

    def count(p: list[str]) -> Column:
        return F.size(F.filter(at(p[0]), lambda x: F.reduce(F.array(F.lit(True), *[F.array_contains(at(t), x + k) for k, t in enumerate(p) if k]), F.lit(True), lambda a, b: a & b)))

    hits = by.select(key, F.array(*[count(p) for p in asked]).alias("__tf")).where(F.exists("__tf", lambda x: x > 0)).join(lengths.withColumnRenamed("len", "__len"), key)
    figures = lengths.agg(F.count(F.lit(1)).alias("__n"), F.sum("len").alias("__total"))
    df = hits.agg(F.array(*[F.count_if(F.col("__tf")[i] > 0) for i in range(len(asked))]).alias("__df"), F.count_if(F.forall("__tf", lambda x: x > 0)).alias("__full"))
    return ranked(hits, figures.join(F.broadcast(df)), len(asked), key, (), relaxed, None, limit)


def _listed(spark: SparkSession, terms_of, query: str) -> list[str]:
    return list(spark.range(1).select(terms_of(F.lit(query)).alias("t")).first()["t"])  # one query


def search_with_debug(docs: DataFrame, query: str, limit: int = 20, **how) -> tuple[DataFrame, DataFrame]:
    """``search`` for a user's query, and one row about it: what was asked, by which strategy, terms and matches."""
    spark = docs.sparkSession
    terms = _listed(spark, store_terms, query)
    found = search(docs, terms, limit, **how)
    asked = spark.range(1).select(F.lit(query).alias("query"), quoted(F.array(*[F.lit(t) for t in terms]).cast("array<string>")).alias("sanitised"), F.lit(len(set(terms))).alias("terms"))
    seen = found.agg(F.count(F.lit(1)).alias("matches"), F.first("strategy").alias("strategy"))
    return found, asked.join(F.broadcast(seen)).withColumn("strategy", F.coalesce("strategy", F.lit("strict" if terms else "empty")))


def item_documents(items: DataFrame, texts: DataFrame) -> DataFrame:
    """(item_id, collection_id, title, updated_at, text): an item's title, metadata and assembled text, as they are searched.

    texts: (item_id, source_order, sort_index, created_at, text).
    """
    body = merged_text(texts, ["item_id"], ["source_order", "sort_index", "created_at"], "text").withColumnRenamed("text", "body")
    rows = items.withColumnRenamed("id", "item_id").join(body, "item_id", "left")
    whole = F.concat(search_text(F.col("title"), F.col("metadata")), F.lit(" "), F.coalesce("body", F.lit("")))
    return rows.select("item_id", "collection_id", "title", "updated_at", F.coalesce("body", F.lit("")).alias("body"), whole.alias("text"))


def reindexed(documents: DataFrame, fresh: DataFrame) -> DataFrame:
    """Items indexed anew in place of what was indexed of them; others stay."""
    return documents.join(fresh.select("item_id").distinct(), "item_id", "left_anti").unionByName(fresh)


def search_items(items: DataFrame, query: str, collection: str | None = None, most: int = 50) -> DataFrame:
    """Items found for a user's query, newest first: the ``most`` best by rank, of them those of the collection;
    where nothing at all ranks, those whose title or metadata holds the query. items: as ``item_documents``."""
    terms = _listed(items.sparkSession, store_terms, query)
    top = search(items, terms, most, key="item_id", carry=("collection_id", "title", "updated_at"))
    inside = F.lit(True) if collection is None else F.col("collection_id") == collection
    like = items.where(ascii_like(F.col("title"), query) | ascii_like(F.col("text"), query)).where(inside) if query.strip() else items.where(F.lit(False))
    any_ = top.agg((F.count(F.lit(1)) > 0).alias("__any"))
    ranked = top.where(inside).select("item_id", "title", "updated_at", F.lit("ranked").alias("found_by"))
    plain = like.join(F.broadcast(any_)).where(~F.col("__any")).select("item_id", "title", "updated_at", F.lit("like").alias("found_by"))  # one row
    return ranked.unionByName(plain).orderBy(F.desc("updated_at"), "item_id")


def fitting(text: Column, octets: Column) -> Column:
    """The longest prefix of whole characters within a number of bytes."""
    cut = lambda less: F.try_validate_utf8(F.substring(F.encode(text, "UTF-8"), F.lit(1), (octets - less).cast("int")).cast("string"))
    return F.when(F.octet_length(text) <= octets, text).otherwise(F.coalesce(*[cut(k) for k in range(4)]))


def context(items: DataFrame, question: str, collection: str, snippet: int = 1200, budget: int = 6000, most: int = 5) -> DataFrame:
    """(place, item_id, part): what a question about a collection is answered from, best item first, each under its title, all within the budget.

    The budget counts bytes in UTF-8, a snippet characters. The part that would pass the budget is cut at a character and is the last; items without text take no room.
    """
    terms = _listed(items.sparkSession, match_terms, question)
    top = search(items, terms, most, key="item_id", relaxed=False, carry=("collection_id", "title", "body"), scope=F.col("collection_id") == collection)
    part = F.concat(F.lit("--- "), F.col("title"), F.lit(" ---\n"), F.substring("body", 1, snippet), F.lit("\n\n"))
    rows = top.where("body <> ''").select("item_id", "rank", part.alias("part"))
    by = W.orderBy("rank", "item_id")  # at most ``most`` rows
    before = F.coalesce(F.sum(F.octet_length("part")).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.select(F.row_number().over(by).alias("place"), "item_id", "part", before.alias("before")).where(F.col("before") < budget)
    return rows.select("place", "item_id", fitting(F.col("part"), F.lit(budget) - F.col("before")).alias("part"))
