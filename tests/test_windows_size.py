"""Tokens and windowed predictions are read and shuffled a fixed, small number of times."""

import re

from pyspark.sql import functions as F

from quillet.functions.text import sanitize_value, sanitized
from quillet.operators import windows
from quillet.plans import QUERIES

SF = "/root/testdata/sf0.001"


def test_tokens_are_the_pattern_s(spark):
    texts = ["Año 1810, «Luján»_y", "", None, "x", "  ", "a\U0001d400b é́ ² ½ x_1 𝟙", "日本語 text\n\tß"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc int, text string").select("doc", windows.token_spans("text").alias("m")).collect()
    for r in rows:
        assert [tuple(m) for m in r["m"]] == [(m.group(), *m.span()) for m in re.finditer(r"[^\W_]+", texts[r["doc"]] or "")]


def test_known_counts_need_no_join(spark):
    tokens = spark.range(600).select(F.lit(1).alias("doc"), F.col("id").alias("i"), F.lit(600).alias("n"))
    counted, joined = windows.token_windows(tokens, "doc", count="n"), windows.token_windows(tokens.drop("n"), "doc")
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, joined.collect()))
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()


def test_predictions_are_shuffled_together(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["ner_windowed_predictions"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("token_spans(") == 2  # for edges and for what passes; an inner generator would run each twice
    assert plan.count("Exchange hashpartitioning") <= 4 and plan.count("SortMergeJoin") == 1  # edges, predictions with edges, texts, found values


def test_clean_values_take_the_short_way(spark):
    values = ["Ana", "Ana Paz", "a", "", "«Ana»", "Ana.", " x", "é", "JosÃ©", "a\n", "a\nb", "(a)", "-", "a b\t"]
    got = spark.createDataFrame([(v,) for v in values], "v string").select("v", sanitize_value(F.col("v")).alias("s")).collect()
    assert {r["v"]: r["s"] for r in got} == {v: sanitized(v) for v in values}
