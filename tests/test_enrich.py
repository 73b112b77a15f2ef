"""Enrichment of targets, windowed predictions, protection and folds on small cases."""

import random

from pyspark.sql import functions as F

from quillet.operators import decode as de
from quillet.operators import enrich, layout, windows
from quillet.operators import entities as en
from quillet.operators.store import Store

TEXT = "Don Juan Pérez fue vocal. El Cabildo se reunió el 3 de mayo de 1810."


def store(spark):
    s = Store(spark)
    s = s.insert("collections", [{"id": "k", "name": "K", "created_at": 1, "updated_at": 1}])
    s = s.insert("items", [{"id": i, "title": i, "collection_id": "k", "created_at": 1, "updated_at": 1} for i in ("i", "j")])
    s = s.insert("assets", [{"id": a, "item_id": i, "path": a, "type": "image", "created_at": 1, "sort_index": n} for a, i, n in (("a", "i", 1), ("b", "i", 0), ("c", "j", 0))])
    s = s.insert("extractions", [{"id": "e1", "asset_id": "a", "text_content": TEXT, "method": "ocr", "created_at": 1}, {"id": "e2", "asset_id": "b", "text_content": "Antes.", "method": "ocr", "created_at": 9}])
    s = s.insert("transcriptions", [{"id": "t", "asset_id": "b", "text_content": "Luego.", "model": "m", "created_at": 0}])
    return s.insert("entities", [{"id": n, "item_id": i, "asset_id": a, "entity_type": "date", "value": v, "start_offset": 0, "end_offset": 4, "confidence": 1.0, "source": o, "created_at": 0} for n, i, a, v, o in (("m", "i", None, "3 de mayo de 1810", "manual_deleted"), ("x", "i", "a", "old", "rule_based"), ("y", "j", "c", "old", "rule_based"))])


def test_texts_in_order(spark):
    s = store(spark)
    assert {r["item_id"]: r["text"] for r in enrich.item_texts(s).collect()} == {"i": f"Antes. {TEXT} Luego.", "j": ""}
    assert {r["asset_id"]: r["text"] for r in enrich.asset_texts(s).collect()} == {"a": TEXT, "b": "Antes. Luego.", "c": ""}


def test_entities_are_exchanged_in_scope(spark):
    s = store(spark)
    got = enrich.with_entities(s, enrich.item_texts(s), 5)["entities"].collect()
    assert {(r["item_id"], r["value"]) for r in got} == {("i", "3 de mayo de 1810"), ("i", "Don Juan Pérez"), ("i", "Cabildo")}  # the date is protected, j has no text and loses its own
    assert next(r for r in got if r["value"] == "Cabildo")["start_offset"] == len("Antes. ") + TEXT.index("Cabildo")
    only = enrich.asset_texts(s).where("asset_id = 'a'")
    model = spark.createDataFrame([("a", "place", "vocal", 19, 24, 0.95, "onnx"), ("a", "place", "weak", 19, 24, 0.5, "onnx"), ("zz", "place", "vocal", 0, 5, 0.99, "onnx")], "asset_id string, entity_type string, value string, start int, end int, confidence double, source string")
    after = enrich.with_entities(s, only, 5, model)["entities"]
    assert {(r["asset_id"], r["value"]) for r in after.collect()} == {(None, "3 de mayo de 1810"), ("c", "old"), ("a", "vocal"), ("a", "Cabildo")}


def test_triples_are_exchanged_in_scope(spark):
    s = store(spark).insert("triples", [{"id": n, "item_id": i, "asset_id": a, "subject": "s", "predicate": "es", "object": "o", "created_at": 0} for n, i, a in (("1", "i", "a"), ("2", "i", "b"), ("3", "j", None))])
    after = enrich.with_triples(s, enrich.asset_texts(s).where("asset_id = 'a'"), 5)["triples"]
    assert {(r["item_id"], r["asset_id"], r["subject"], r["object"]) for r in after.collect()} == {("i", "b", "s", "o"), ("j", None, "s", "o"), ("i", "a", "Don Juan Pérez", "vocal")}
    assert {r["item_id"] for r in enrich.with_triples(s, enrich.item_texts(s), 5)["triples"].collect()} == {"i"}


def test_backfill(spark):
    s = store(spark).insert("vec_assets", [{"asset_id": "b", "item_id": "i", "embedding": [1.0]}])
    given = spark.createDataFrame([("a", [0.5]), ("b", []), ("c", [1.0])], "asset_id string, embedding array<float>")
    assert [r["asset_id"] for r in enrich.backfill_candidates(s).collect()] == ["a"]
    assert [r["asset_id"] for r in enrich.backfill_candidates(s, force=True, limit=1).collect()] == ["a"]
    after, report = enrich.backfilled(s, given, force=True)
    assert tuple(report.first()) == (2, 2, 1, 1, 0)
    assert {r["asset_id"] for r in after["vec_assets"].collect()} == {"a", "b"}


def test_window_edges_are_left_to_the_neighbour(spark):
    text = " ".join(f"w{k}" for k in range(25))
    tokens = spark.createDataFrame([(1, text)], "doc int, text string").select("doc", F.posexplode(windows.token_spans("text")).alias("i", "m")).select("doc", "i", "m.token", "m.start", "m.end")
    rows = windows.token_windows(tokens, "doc", 10, 4)
    assert sorted((r["window"], r["n"]) for r in rows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).collect()) == [(0, 10), (6, 10), (12, 10), (18, 7)]
    label = F.when(F.col("i") == 9, "B-PER").when(F.col("i") == 10, "I-PER").when(F.col("i") == 20, "B-ORG").otherwise("O")
    said = rows.withColumns({"label": label, "score": F.lit(0.9)})
    got = windows.windowed_entities(said, spark.createDataFrame([(1, text)], "doc int, text string"), "doc", "text").collect()
    assert [(r["entity_type"], r["value"]) for r in sorted(got, key=lambda r: r["start"])] == [("person", "w9 w10"), ("organization", "w20")]


def test_protection_is_the_plain_condition(spark):
    r = random.Random(6)
    make = lambda n: [(r.randrange(3), r.choice(["person", "institution", "organization"]), r.choice("abcdefgh") * r.randint(1, 2), *(lambda at: (at, at + r.choice([0, 1, 5, 300])))(r.randrange(600)), r.choice([0.5, 0.9, 1.0])) for _ in range(n)]
    kind = "item_id int, entity_type string, value string, start int, end int, confidence double"
    c, p = make(120), make(8) + [(0, "person", "Q", None, None, 1.0)]
    family = lambda t: "organization" if t == "institution" else t
    hit = lambda a, b: a[0] == b[0] and family(a[1]) == family(b[1]) and (a[2].lower() == b[2].lower() or (b[3] is not None and a[3] < b[4] and b[3] < a[4]))
    want = sorted(a for a in c if a[5] > 0.89 and not any(hit(a, b) for b in p))
    got = en.unprotected(spark.createDataFrame(c, kind), spark.createDataFrame(p, kind))
    assert sorted(map(tuple, got.collect())) == want and want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert " OR " not in plan and "NestedLoop" not in plan


def test_folds_run_no_python(spark):
    e = spark.createDataFrame([(1, "person", "Ana", 0, 3, 0.9, "onnx")], "doc int, entity_type string, value string, start int, end int, confidence double, source string")
    for df in (en.merge_sources(e, "doc"), en.dedup_document(e, "doc"), de.consolidated(e, "doc")):
        assert "Python" not in df._jdf.queryExecution().executedPlan().toString() and df.count() == 1


def test_boxes_that_meet_are_paired_once(spark):
    blocks = spark.createDataFrame([(1, 1, "text", (0.0, 0.0, 100.0, 100.0), 0), (1, 2, "text", (500.0, 500.0, 1.0, 1.0), 0), (2, 3, "text", (0.0, 0.0, 5.0, 5.0), 1)], "page int, block_id int, label string, bbox struct<x:double,y:double,width:double,height:double>, group int")
    regions = spark.createDataFrame([(1, 7, "table", (0.0, 0.0, 100.0, 100.0), 0), (1, 8, "text", (2.0, 2.0, 90.0, 90.0), 0), (2, 9, "seal", (4.0, 4.0, 5.0, 5.0), 1), (3, 9, "seal", (4.0, 4.0, 5.0, 5.0), 1)], "page int, region_id int, category string, bbox struct<x:double,y:double,width:double,height:double>, group int")
    got = {r["block_id"]: r["region_id"] for r in layout.match_regions(blocks, regions, ["page"]).collect()}
    assert got == {1: 8, 2: None, 3: None}
