"""What rules find is made once and shuffled once on its way past an item's manual entities."""

from pyspark.sql import functions as F

from quillet.operators import entities as en
from quillet.plans import QUERIES

SF = "/root/testdata/sf0.001"
KIND = "item_id int, entity_type string, value string, start int, end int, confidence double"


def test_candidates_are_shuffled_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["enrich_asset_entities"](spark, SF)._jdf.queryExecution().executedPlan().toString()
        c = spark.createDataFrame([(1, "person", "Ana", 0, 3, 1.0)], KIND)
        own = en.unprotected(c, c)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("rule_matches(") == 1
    assert own.count("Exchange") == 1 and "Join" not in own


def test_nulls_and_equal_places(spark):
    c = [(1, "person", "a", 5, 5, 1.0), (1, "person", None, 20, 30, 1.0), (1, "person", "b", None, None, 1.0), (1, "person", "c", 30, 40, 1.0), (None, "person", "d", 0, 9, 1.0), (1, None, "e", 0, 9, 1.0), (2, "person", "a", 0, 9, 1.0), (1, "person", "f", 0, 9, 0.5), (1, "place", "g", 0, 9, 1.0), (1, "place", "g", 0, 9, 1.0)]
    p = [(1, "person", None, 40, 50, 1.0), (1, "person", "z", None, 99, 1.0), (1, "person", "y", 10, 20, 1.0), (1, "person", "x", 0, 10, 1.0), (None, "person", "d", 0, 9, 1.0), (1, None, "e", 0, 9, 1.0)]
    got = en.unprotected(spark.createDataFrame(c, KIND), spark.createDataFrame(p, KIND))
    assert got.schema == spark.createDataFrame(c, KIND).schema
    rows = got.collect()
    assert sorted(str(tuple(r)) for r in rows) == sorted(str(x) for x in c if x[2] not in ("a", "f") or x[0] == 2)
    assert got.where(F.col("value") == "g").count() == 2
