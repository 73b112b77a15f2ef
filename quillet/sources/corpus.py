"""Corpus views over the Parquet tables, the guarded SQL front and the table browser."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillet.functions.text import split_statements
from quillet.operators.relational import any_column_like
from quillet.operators.store import Store
from quillet.sources.schemas import BROWSED, HIDDEN, key


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as text sources: extractions (0) from assistant and system, transcriptions (1) from users."""
    c = read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.when(F.col("role") == "user", 1).otherwise(0).alias("source_order"), "text")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities made of orders: type, span, confidence and source by key arithmetic."""
    k = F.col("o_orderkey")
    types = F.array(*[F.lit(t) for t in ("person", "organization", "institution", "place", "date", "misc", "custom")])
    sources = F.array(*[F.lit(t) for t in ("rule_based", "onnx", "manual", "manual_deleted", None)])
    return read(spark, sf_dir, "orders").select(
        k.alias("id"), (k % 50).alias("item_id"), F.get(types, (k % 7).cast("int")).alias("entity_type"), F.concat(F.lit("v"), (k % 13).cast("string")).alias("value"),
        (k % 50 * 3 % 41).alias("start"), (k % 50 * 3 % 41 + 5 + k % 9).alias("end"), ((k % 100) / 100.0).alias("confidence"), F.get(sources, (k % 5).cast("int")).alias("source"),
        F.when(k % 3 > 0, k % 4).alias("asset_id"),
    )


def line_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities made of order lines: an order's lines are the entities of an item."""
    pick = lambda values, at: F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("item_id"), pick(("person", "organization", "institution", "place", "date", "misc"), p % 6).alias("entity_type"), pick(("Ana", "Ana Paz", "«Ana»", "Lima", "Real Audiencia", "El  Cabildo", "ANA  PAZ"), F.floor(p / 3) % 7).alias("value"),
        (p % 29 * 2).alias("start"), (p % 29 * 2 + 3 + s % 9).alias("end"), pick((0.5, 0.55, 0.9, 0.97), s % 4).alias("confidence"), pick(("rule_based", "onnx", "spacy", "llm", None), (F.col("l_linenumber") + s) % 5).alias("source"),
    )


def notes_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spanish passages made of orders."""
    k = F.col("o_orderkey")
    months = F.array(*[F.lit(m) for m in ("enero", "marzo", "mayo", "julio", "octubre", "diciembre")])
    names = F.array(*[F.lit(m) for m in ("Manuel Belgrano", "Juan Larrea", "Mariano Moreno", "José de San Martín")])
    text = F.concat(
        F.lit("En la ciudad de Buenos Aires, a "), (k % 28 + 1).cast("string"), F.lit(" de "), F.get(months, (k % 6).cast("int")), F.lit(" de "), (k % 60 + 1800).cast("string"),
        F.lit(", Don "), F.get(names, (k % 4).cast("int")), F.lit(" fue vocal. El Cabildo de Luján escribió un acta; recibida el "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" junto al río Paraná y la Luna. Legajo 125/05/18100, del 3 de nivoso de 1790; oyó a Fray Luis de León, Sor Ana y al Real Convento Mayor, no a don Luis."),
    )
    return read(spark, sf_dir, "orders").select(k.alias("doc_id"), text.alias("text"))


_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_RESTRICTED = ("pragma", "attach", "detach", "vacuum")


class Refused(ValueError):
    """A statement that the SQL front doesn't run."""


def normalised(sql: str) -> str:
    return " ".join(sql.split()).lower()


def _bare(sql: str) -> str:
    """Normalised, string literals emptied, so that what they hold isn't taken for SQL."""
    return normalised(re.sub(r"'(?:[^']|'')*'", "''", sql))


def _refuse(bare: str, single: bool) -> None:
    if single and ";" in bare:
        raise Refused("only one statement is allowed")
    if any(re.search(rf"\b{word}\b", bare) for word in _RESTRICTED):
        raise Refused("restricted statement")


def check_rows(sql: str) -> None:
    """A statement that returns rows: SELECT or WITH, or a change with RETURNING."""
    bare = _bare(sql)
    _refuse(bare, True)
    if not re.match(r"(select|with)\b", bare) and not (re.match(r"(insert|update|delete)\b", bare) and " returning " in bare + " "):
        raise Refused("only statements that return rows are allowed")


def check_execute(sql: str) -> None:
    _refuse(_bare(sql), True)


def check_batch(sql: str) -> None:
    _refuse(_bare(sql), False)


def parameters(values: list | dict) -> list | dict:
    """JSON values as SQL parameters: truth as 1 and 0, objects and arrays as JSON text."""

    def one(v):
        if isinstance(v, bool):
            return int(v)
        return json.dumps(v, ensure_ascii=False) if isinstance(v, dict | list) else v

    return {k: one(v) for k, v in values.items()} if isinstance(values, dict) else [one(v) for v in values]


def select(spark: SparkSession, sql: str, args: dict | list | None = None) -> DataFrame:
    """One statement that returns rows, run by Spark, which knows no RETURNING: a change is for ``operators.store``."""
    check_rows(sql)
    if not re.match(r"(select|with)\b", _bare(sql)):
        raise Refused("changes are made through the store")
    return spark.sql(sql, args=parameters(args) if args else None)


def execute_batch(spark: SparkSession, script: str) -> list[DataFrame]:
    """The statements of a script, one after another; Spark has no transaction over several."""
    check_batch(script)
    return [spark.sql(s) for s in split_statements(script)]


def as_json(df: DataFrame) -> DataFrame:
    """(row): each row as a JSON object; binary as base64, nulls kept."""
    shown = [F.base64(c).alias(c) if t == "binary" else F.col(f"`{c}`") for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*shown), {"ignoreNullFields": "false"}).alias("row"))


def table_list(tables: dict[str, DataFrame]) -> list[str]:
    """Tables that the browser offers and the store has, in the offered order."""
    return [n for n in BROWSED if n in tables and n not in HIDDEN]


def described(name: str, df: DataFrame) -> list[dict]:
    """(name, type, nullable, is_primary_key) of a table's columns."""
    return [{"name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable, "is_primary_key": f.name == key(name)} for f in df.schema.fields]


def has_column(df: DataFrame, name: str) -> bool:
    return name in df.columns


def has_table(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def quoted_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def identifier(name: str, allowed: list[str]) -> str:
    if not _NAME.fullmatch(name) or name not in allowed:
        raise ValueError(f"not allowed: {name!r}")
    return name


def browse(df: DataFrame, page: int = 1, page_size: int = 50, sort: str | None = None, direction: str = "asc", search: str = "") -> DataFrame:
    """A page of a table: searched in every column, sorted by a checked column, sizes clamped to 1..100."""
    if search:
        df = any_column_like(df, search)
    size, page = min(100, max(1, page_size)), max(1, page)
    by = sort if sort in df.columns else df.columns[0]
    order = F.desc(by) if direction.lower() == "desc" else F.asc(by)
    return df.orderBy(order, *[c for c in df.columns if c != by]).offset((page - 1) * size).limit(size)


def store(spark: SparkSession, sf_dir: str) -> Store:
    """The corpus tables made of the order tables: nations are collections, customers items, orders assets; the rest hangs on these."""
    n, c, o, li = (read(spark, sf_dir, t) for t in ("nation", "customer", "orders", "lineitem"))
    text = lambda prefix, column: F.concat(F.lit(prefix), F.col(column).cast("string"))
    long = lambda column: F.col(column).cast("long")
    k = F.col("o_orderkey")
    pick = lambda values, at: F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))
    line_id = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    asset = text("o", "l_orderkey").alias("asset_id")
    results = read(spark, sf_dir, "events")
    return Store(
        spark,
        collections=n.select(text("n", "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("description"), long("n_nationkey").alias("created_at"), (long("n_nationkey") * 10).alias("updated_at")),
        items=c.select(text("c", "c_custkey").alias("id"), F.col("c_name").alias("title"), text("n", "c_nationkey").alias("collection_id"), F.concat(F.lit('{"seg": "'), "c_mktsegment", F.lit('"}')).alias("metadata"), long("c_custkey").alias("created_at"), (long("c_custkey") % 97).alias("updated_at")),
        assets=o.select(text("o", "o_orderkey").alias("id"), text("c", "o_custkey").alias("item_id"), F.concat(F.lit("/data/assets/"), k.cast("string"), F.lit(".png")).alias("path"), pick(("image", "pdf", "audio"), k % 3).alias("type"), (k * 7).alias("size"), k.alias("created_at"), (k % 5).alias("sort_index")),
        extractions=li.where("l_returnflag = 'A'").select(F.concat(F.lit("e"), line_id).alias("id"), asset, text("t", "l_partkey").alias("text_content"), F.lit("ocr").alias("method"), F.col("l_discount").alias("confidence"), long("l_partkey").alias("created_at")),
        transcriptions=li.where("l_returnflag = 'R'").select(F.concat(F.lit("t"), line_id).alias("id"), asset, text("s", "l_suppkey").alias("text_content"), F.lit("es").alias("language"), F.lit(None).cast("long").alias("duration_ms"), F.lit("m").alias("model"), F.lit("[]").alias("segments"), F.col("l_tax").alias("confidence"), long("l_partkey").alias("created_at")),
        layouts=li.where("l_returnflag = 'N' and l_linenumber = 1").select(F.concat(F.lit("l"), line_id).alias("id"), asset, F.lit("[]").alias("regions"), F.lit("[]").alias("blocks"), F.lit("m").alias("model"), F.lit(0).cast("long").alias("image_width"), F.lit(0).cast("long").alias("image_height"), long("l_partkey").alias("created_at")),
        entities=o.select(
            text("x", "o_orderkey").alias("id"), text("c", "o_custkey").alias("item_id"), pick(("person", "organization", "place", "date", "misc"), k % 5).alias("entity_type"), F.concat(F.lit("v"), (k % 13).cast("string")).alias("value"), (k % 41).alias("start_offset"), (k % 41 + 5).alias("end_offset"),
            ((k % 100) / 100.0).alias("confidence"), pick(("rule_based", "onnx", "manual", "manual_deleted", None), F.floor(k / 2) % 5).alias("source"), F.lit(None).cast("string").alias("model_name"), k.alias("created_at"),
            F.when(k % 4 == 0, k * 0.5).alias("latitude"), F.when(k % 4 == 0, k * 0.25).alias("longitude"), F.when(k % 4 == 0, "resolved").otherwise("pending").alias("geo_status"), F.when(k % 3 > 0, F.concat(F.lit("o"), (k + k % 2).cast("string"))).alias("asset_id"),
        ),
        triples=o.select(text("r", "o_orderkey").alias("id"), text("c", "o_custkey").alias("item_id"), F.concat(F.lit("s"), (k % 7).cast("string")).alias("subject"), F.lit("es").alias("predicate"), F.concat(F.lit("o"), (k % 11).cast("string")).alias("object"), k.alias("created_at"), F.when(k % 2 == 0, text("o", "o_orderkey")).alias("asset_id")),
        notes=o.where("o_orderkey % 5 = 0").select(text("m", "o_orderkey").alias("id"), text("c", "o_custkey").alias("item_id"), F.concat(F.lit("<p>"), "o_orderpriority", F.lit("</p>")).alias("content"), k.alias("created_at"), k.alias("updated_at"), F.when(k % 2 == 0, F.concat(F.lit("o"), (k * 3).cast("string"))).alias("asset_id")),
        annotations=li.where("l_linenumber <= 3").select(F.concat(F.lit("a"), line_id).alias("id"), asset, long("l_linenumber").alias("page"), F.when(F.col("l_partkey") % 2 == 0, "rectangle").otherwise("underline").alias("kind"), F.lit("red").alias("color"), F.col("l_discount").alias("x"), F.col("l_tax").alias("y"), F.lit(0.1).alias("width"), F.lit(0.2).alias("height"), long("l_partkey").alias("created_at"), long("l_suppkey").alias("updated_at")),
        topics=read(spark, sf_dir, "part").select(F.upper(F.trim("p_brand")).alias("name")).distinct().select(F.concat(F.lit("topic-"), F.sha2("name", 256)).alias("id"), "name", F.lit(0).cast("long").alias("created_at")),
        item_topics=c.join(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("c_custkey"), F.concat(F.lit("topic-"), F.sha2(F.upper(F.trim("p_brand")), 256)).alias("topic_id")), "c_custkey").select(F.concat_ws("-", F.lit("link"), text("c", "c_custkey"), "topic_id").alias("id"), text("c", "c_custkey").alias("item_id"), "topic_id", F.lit(0).cast("long").alias("created_at")),
        jobs=results.select(text("j", "event_id").alias("id"), F.col("event_type").alias("type"), pick(("pending", "running", "complete", "error"), F.col("event_id") % 4).alias("status"), text("o", "user_id").alias("asset_id"), F.lit(None).cast("string").alias("result"), F.lit(None).cast("string").alias("error"), F.col("event_id").alias("created_at"), F.col("event_id").alias("updated_at")),
        llm_results=results.select(text("q", "event_id").alias("id"), F.concat(pick(("o", "c", "n", "z"), F.col("event_id") % 4), F.col("user_id").cast("string")).alias("target_id"), pick(("asset", "item", "collection", "unknown"), F.col("event_id") % 4).alias("target_type"), F.col("event_type").alias("job_type"), F.round("value", 3).cast("string").alias("result"), F.col("event_id").alias("created_at")),
        vec_assets=read(spark, sf_dir, "embeddings").select(text("o", "vec_id").alias("asset_id"), text("c", "label").alias("item_id"), "embedding"),
        app_settings=n.where("n_nationkey < 5").select(F.col("n_name").alias("key"), text("", "n_regionkey").alias("value")),
    )
