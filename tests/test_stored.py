"""The item index and stored tables: batches against rebuilds, what is read and rewritten, failed batches."""

import json
import os
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillet.operators.item_index import FIELDS, ItemIndex, canonical_items
from quillet.operators import similarity
from quillet.operators.tables import StoredTable
from quillet.plans import QUERIES
from quillet.sources import media

ITEM = "item_id string, title string, metadata string, text string"


def found(index, terms, **how):
    return [(r["item_id"], r["rank"], r["strategy"]) for r in index.search(terms, **how).collect()]


def test_batches_rank_as_a_rebuild(spark, tmp_path):
    first = [("a", "Acta de Luján", '{"k": "cabildo"}', "el río y la villa"), ("b", "Carta", None, "villa vieja, villa nueva"), ("c", None, "", "río"), ("d", "Mapa", "", "")]
    second = [("b", "Carta", "nueva", "río río"), ("e", "Acta", "", "la villa de Lujan")]
    rest = [r for r in first if r[0] == "c"] + second
    grown, built = ItemIndex(spark, str(tmp_path / "grown"), 8), ItemIndex(spark, str(tmp_path / "built"), 8)
    assert grown.search(["villa"]).count() == 0 and grown.figures() == (0, 0)
    grown.add(spark.createDataFrame(first, ITEM))
    grown.add(spark.createDataFrame(second, ITEM))
    grown.remove(spark.createDataFrame([("a",), ("d",), ("a",), ("nowhere",)], "item_id string"))
    built.add(spark.createDataFrame(rest, ITEM))
    for terms in (["villa"], ["rio"], ["río", "villa"], ["acta", "nueva"], ["zz", "lujan", "rio"], ["la-villa de"], [], ["!"]):
        want = found(built, terms)
        assert found(grown, terms) == want
    assert grown.figures() == built.figures() == (3, 10)
    assert sorted(map(tuple, grown.items().collect())) == sorted(map(tuple, built.items().collect()))
    grown.merge()
    assert found(ItemIndex(spark, str(tmp_path / "grown"), 8), ["río", "villa"]) == found(built, ["río", "villa"])
    grown.remove(spark.createDataFrame([("e",)], "item_id string"))
    grown.add(spark.createDataFrame(first[:1], ITEM))
    assert {r[0] for r in found(grown, ["acta"])} == {"a"}


def test_phrases_stay_inside_a_field(spark, tmp_path):
    index = ItemIndex(spark, str(tmp_path), 4)
    index.add(spark.createDataFrame([("a", "rey de", "españa", ""), ("b", "", "", "rey de España, rey de España")], ITEM))
    assert [r[0] for r in found(index, ["rey-de españa".replace(" ", "-")])] == ["b"]
    assert [r[0] for r in found(index, ["españa"], fields=("metadata",))] == ["a"]
    assert index.postings(["rey"], ("text",)).first()["positions"] == [0, 3]
    assert FIELDS == ("title", "metadata", "text")


def test_only_the_tokens_partitions_are_read(spark, tmp_path):
    index = ItemIndex(spark, str(tmp_path), 16)
    index.add(spark.createDataFrame([(str(k), f"t{k}", "", " ".join(f"w{j}" for j in range(k))) for k in range(40)], ITEM))
    want = found(index, ["w3"])
    part = spark.range(1).select(F.pmod(F.xxhash64(F.lit("w3")), F.lit(16))).first()[0]
    for d, _, _ in os.walk(tmp_path / "generation=0" / "postings"):
        if "/part=" in d and not d.endswith(f"/part={part}"):
            shutil.rmtree(d)
    assert found(ItemIndex(spark, str(tmp_path), 16), ["w3"]) == want and len(want) == 20


def test_a_batch_that_failed_does_not_exist(spark, tmp_path):
    index = ItemIndex(spark, str(tmp_path), 4)
    index.add(spark.createDataFrame([("a", "one", "", "")], ITEM))
    with pytest.raises(ValueError, match="twice"):
        index.add(spark.createDataFrame([("a", "two", "", ""), ("a", "three", "", "")], ITEM))
    assert found(index, ["two"]) == [] and len(found(index, ["one"])) == 1
    assert index.add(spark.createDataFrame([("a", "four", "", "")], ITEM)) == 2
    assert found(index, ["two"]) == found(index, ["one"]) == [] and len(found(index, ["four"])) == 1


def test_canonical_items_of_some_ids(spark):
    items = spark.createDataFrame([("a", "A", None), ("b", "B", "m")], "id string, title string, metadata string")
    texts = spark.createDataFrame([("a", 1, 0, 0, "late"), ("a", 0, 1, 0, "second"), ("a", 0, 0, 5, "first"), ("b", 0, 0, 0, "x")], "item_id string, source_order int, sort_index int, created_at int, text string")
    got = canonical_items(items, texts, spark.createDataFrame([("a",), ("gone",)], "item_id string")).collect()
    assert [tuple(r) for r in got] == [("a", "A", "", "first second late")]


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(f"{path}/rows") for f in names if f.endswith(".parquet")}


def test_a_row_rewrites_a_bucket(spark, tmp_path):
    path = str(tmp_path / "t")
    kept = StoredTable.create(spark.range(200).select("id", F.col("id").cast("string").alias("v"), (F.col("id") * 2).alias("at")), path, "id", 16)
    before = files(path)
    places = kept.upsert(spark.createDataFrame([(7, "new", 9)], "id long, v string, at long"), ["at"])
    after = files(path)
    changed = {f for f in before.keys() ^ after.keys()} | {f for f in before.keys() & after.keys() if before[f] != after[f]}
    assert len(places) == 1 and {f.split("__bucket=")[1].split("/")[0] for f in changed} == {str(places[0])}
    again = StoredTable(spark, path)  # as another session opens it
    assert again.read().count() == 200
    assert tuple(again.read().where("id = 7").first()) == (7, "new", 14)


def test_buckets_empty_and_fill(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(1, "a", 1), (1, "a", 2), (1, "b", 3), (2, "a", 4), (None, "a", 5)]
    kept = StoredTable.create(spark.createDataFrame(rows, "item int, asset string, n int"), path, "item", 4)
    kept.replace(spark.createDataFrame([(1, "a", 9)], "item int, asset string, n int"), ["item", "asset"])
    assert sorted((r["item"] or 0, r["asset"], r["n"]) for r in kept.read().collect()) == [(0, "a", 5), (1, "a", 9), (1, "b", 3), (2, "a", 4)]
    kept.delete(spark.createDataFrame([(1,), (2,), (77,)], "x int"))
    assert [(r["item"], r["n"]) for r in kept.read().collect()] == [(None, 5)]
    assert kept.delete(spark.createDataFrame([], "x int")) == []
    kept.upsert(spark.createDataFrame([(2, "z", 1)], "item int, asset string, n int"))
    kept.recover()
    assert sorted((r["item"] or 0, r["n"]) for r in kept.read().collect()) == [(0, 5), (2, 1)]
    with pytest.raises(ValueError, match="holds item"):
        kept.replace(spark.createDataFrame([], "item int, asset string, n int"), ["asset"])


def test_all_pairs_are_brute_force(spark, monkeypatch):
    r = np.random.default_rng(3)
    for name, value in (("ROWS", 16), ("GROUP", 2), ("PIVOTS", 16), ("CHUNK", 4)):
        monkeypatch.setattr(similarity, name, value)
    centres = r.normal(0, 1, (12, 6))
    vectors = [(k, (centres[k % 12] + r.normal(0, 0.02, 6)).round(4).tolist()) for k in range(400)]
    vectors += [(400 + k, r.normal(0, 1, 3).tolist()) for k in range(30)]
    vectors += [(k, vectors[3][1]) for k in (3, 500, 501, 502, 503, 504, 505, 506)] + [(600, None), (601, []), (602, [0.0] * 6), (603, [1.0, None, 2.0]), (604, [float("nan")] * 6), (605, [1.0] * 9)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
    blocks = similarity.blocks_of(df, 4)
    assert similarity.cells(blocks).where("not asks").count() < blocks.count() * blocks.select("part").distinct().count()  # blocks are left out
    got = sorted((x["vec_id"], x["rank"], x["similar_id"], round(x["similarity"], 6)) for x in similarity.similar_all(df, 4).collect())
    able = [(k, np.array(v)) for k, v in vectors if v and None not in v and np.isfinite(v).all() and np.any(v)]
    want = []
    for k, v in able:
        all_ = sorted((-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 6), j) for j, w in able if j != k and len(w) == len(v))
        want += [(k, p + 1, j, -s) for p, (s, j) in enumerate(all_[:4])]
    near = lambda rows: [(a, b, round(d, 5)) for a, b, _, d in rows]
    assert near(got) == near(sorted(want))
    assert sum(a != b for a, b in zip(got, sorted(want), strict=True)) <= 4  # ties of the last digit may fall either way
    assert similarity.similar_all(df.limit(0)).count() == 0


def test_written_export_is_json(spark, tmp_path):
    pieces = QUERIES["export_whole"](spark, "/root/testdata/sf0.001")
    media.write_export(pieces, str(tmp_path / "out"))
    folders = sorted(d for d in os.listdir(tmp_path / "out") if d.startswith("collection_id="))
    assert len(folders) == 25
    items = 0
    for d in folders:
        names = sorted(f for f in os.listdir(tmp_path / "out" / d) if f.startswith("part-"))
        whole = json.loads("".join((tmp_path / "out" / d / f).read_text() for f in names))
        assert whole["version"] == 2 and f"collection_id={whole['collection']['id']}" == d
        assert [(-i["updatedAt"], i["id"]) for i in whole["items"]] == sorted((-i["updatedAt"], i["id"]) for i in whole["items"])
        items += len(whole["items"])
    assert items == pieces.where("part = 1").count()
