"""Every corpus query against DuckDB on the smallest tables, and the operators without SQL on small cases."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillet.functions import text as t
from quillet.operators import entities as en
from quillet.operators import layout, pages, relational
from quillet.plans import ORACLES, QUERIES
from quillet.sources import corpus

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    return sorted(tuple("-" if v is None or pd.isna(v) else f"{float(v):.6g}" if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        want = duck.execute(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_text(spark):
    assert one(spark, t.match_terms(F.lit("foo-bar AND foo^bar  x near x x"))) == ["foo", "bar", "foobar", "x"]
    assert one(spark, t.store_terms(F.lit("foo-bar AND and"))) == ["foobar", "and"]
    assert one(spark, t.repair_mojibake(F.lit("JosÃ©"))) == "José"
    assert one(spark, t.json_objects(F.lit('[{"a": "}"}, {"b": {"c": 1}}]'))) == ['{"a": "}"}', '{"b": {"c": 1}}']
    assert one(spark, t.topics(F.lit(" a, ,b,A"))) == ["A", "B"]
    assert [(r["part"], r["hit"]) for r in one(spark, t.highlight(F.lit("aXbx"), "x"))] == [("a", False), ("X", True), ("b", False), ("x", True)]


def test_offsets_slice_back(spark):
    docs = corpus.notes_text(spark, SF)
    bad = en.extract(docs, "doc_id", "text").join(docs, "doc_id").where("substring(text, start + 1, end - start) not like concat('%', value, '%')")
    assert bad.count() == 0


def test_merge_prefers_rule_dates(spark):
    e = spark.createDataFrame([(1, "date", "1810", 0, 4, 1.0, "rule_based"), (1, "misc", "1810", 0, 4, 1.0, "onnx"), (1, "place", "Lima", 9, 13, 0.9, "onnx")], "item_id int, entity_type string, value string, start int, end int, confidence double, source string")
    got = {(r["entity_type"], r["source"]) for r in en.merge_sources(e, "item_id").collect()}
    assert got == {("date", "rule_based"), ("place", "onnx")}


def test_reading_order(spark):
    boxes = [(1, 1, 0.0, 0.0, 700.0, 30.0)] + [(1, 10 + i, 20.0, 100.0 + 50 * i, 300.0, 20.0) for i in range(4)] + [(1, 20 + i, 420.0, 100.0 + 50 * i, 300.0, 20.0) for i in range(4)] + [(1, 30, None, None, None, None)]
    df = spark.createDataFrame(boxes, "page int, region_id int, x double, y double, width double, height double").withColumn("page_width", F.lit(800.0)).withColumn("page_height", F.lit(500.0))
    got = [r["region_id"] for r in layout.reading_order(df, ["page"]).orderBy("place").collect()]
    assert got == [1, 10, 11, 12, 13, 20, 21, 22, 23, 30]


def test_upsert_keeps_columns(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k int, v string, id int")
    new = spark.createDataFrame([(2, "c", 99), (3, "d", 30)], "k int, v string, id int")
    assert {tuple(r) for r in relational.upsert(old, new, "k", ["id"]).collect()} == {(1, "a", 10), (2, "c", 20), (3, "d", 30)}


@pytest.mark.parametrize("sql", ["DROP TABLE x", "SELECT 1; SELECT 2", "PRAGMA x"])
def test_front_refuses(spark, sql):
    with pytest.raises(ValueError):
        corpus.select(spark, sql)


def test_stream_coalesces(spark, tmp_path):
    from quillet.streaming import jobs

    spark.createDataFrame([(1, 7, "a"), (2, 7, "a"), (3, 8, "a")], "event_id long, user_id long, kind string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, user_id long, kind string").parquet(str(tmp_path / "in"))
    seen = []
    jobs.run_coalesced(stream, ["user_id"], lambda df: seen.extend(map(tuple, df.select("user_id", "event_id", "requests").collect())), str(tmp_path / "cp")).awaitTermination()
    assert sorted(seen) == [(7, 2, 2), (8, 3, 1)]


def test_dedup_looks_at_all_kept(spark):
    e = [(1, "person", "Ana Paz", 0, 7, 0.8, "onnx"), (1, "place", "Lima", 20, 24, 0.9, "onnx"), (1, "person", "ana  paz", 90, 98, 0.8, "onnx"), (1, "institution", "Lima", 40, 44, 0.9, "onnx"), (1, "organization", "Lima", 60, 64, 0.5, "onnx")]
    df = spark.createDataFrame(e, "item_id int, entity_type string, value string, start int, end int, confidence double, source string")
    assert sorted((r["entity_type"], r["start"]) for r in en.dedup_document(df, "item_id").collect()) == [("institution", 40), ("person", 90), ("place", 20)]


def test_hyphen_chain(spark):
    lines = [(1, i, s, i, 10 * i, 5, 5, 0.1 * i) for i, s in enumerate(["con- ", " ti-", "nuo.", "Fin"])]
    df = spark.createDataFrame(lines, "page int, n int, text string, x int, y int, width int, height int, confidence double")
    got = [(r["text"], r["x"], r["width"], r["height"]) for r in pages.merge_hyphens(df, ["page"], ["n"]).orderBy("line").collect()]
    assert got == [("continuo.", 0, 7, 25), ("Fin", 3, 5, 5)]
    assert [r["text"] for r in pages.paragraph_breaks(df, ["page"], ["n"]).orderBy("n").collect()] == ["con- ", " ti-", "nuo.\n", "Fin"]
