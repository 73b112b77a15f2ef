"""Operators without SQL on small cases: merging, decoding, notes, guards, stored search, page folds, queues."""

import random

import pytest
from pyspark.sql import functions as F

from quillet import plugins
from quillet.functions import jsons, notes
from quillet.functions import text as t
from quillet.operators import decode as de
from quillet.operators import entities as en
from quillet.operators import layout as lay
from quillet.operators import search as fts
from quillet.operators.store import MissingParent, Store
from quillet.sources import corpus, schemas
from quillet.streaming import jobs

ENT = "doc int, entity_type string, value string, start int, end int, confidence double, source string"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def merged(spark, *rows):
    return [tuple(r)[1:] for r in en.merge_sources(spark.createDataFrame([(1, *r) for r in rows], ENT), "doc").orderBy("start").collect()]


def test_merge_rules(spark):
    a, b = ("misc", "X", 0, 5, 0.5, "rule_based"), ("misc", "X", 0, 5, 0.5, "spacy")
    assert merged(spark, a, b) == [b]  # the later one of the higher rank
    assert merged(spark, ("person", "Ana", 0, 3, 0.9, "rule_based"), ("person", "«Ana  »", 90, 93, 0.9, "rule_based")) == [("person", "Ana", 0, 3, 0.9, "rule_based")]
    assert merged(spark, ("institution", "Real", 0, 4, 0.9, "rule_based"), ("organization", "Real Audiencia", 0, 14, 0.92, "onnx"))[0][1] == "Real"
    assert merged(spark, ("organization", "A", 0, 4, 0.6, "rule_based"), ("organization", "A B", 0, 6, 0.7, "onnx"))[0][5] == "onnx"
    assert len(merged(spark, ("person", "A", 0, 3, 1.0, "onnx"), ("person", "B", 3, 6, 1.0, "onnx"))) == 2


def test_merge_against_a_plain_fold(spark):
    r = random.Random(1)
    rank = {"rule_based": 1, "onnx": 2, "spacy": 3}
    rows = []
    for doc in range(30):
        for _ in range(12):
            at = r.randrange(40)
            rows.append((doc, r.choice(["person", "place", "date", "institution", "organization", "misc"]), r.choice(["a b", "A  b", "c", "«c»"]), at, at + r.randint(1, 6), r.choice([0.5, 0.55, 0.9]), r.choice(list(rank))))
    got = {}
    for x in en.merge_sources(spark.createDataFrame(rows, ENT), "doc").collect():
        got.setdefault(x["doc"], []).append(tuple(x)[1:])
    group = lambda k: "organization" if k == "institution" else k
    kind = {"institution": 5, "date": 4, "person": 3, "place": 3, "organization": 2, "misc": 1}

    def better(a, b):
        """a earlier, b later: type, value, start, end, confidence, source."""
        core = ("person", "place", "organization", "institution")
        if a[0] == "date" and a[5] == "rule_based":
            return a
        if b[0] == "date" and b[5] == "rule_based":
            return b
        for x, y in ((b, a), (a, b)):
            if x[5] == "onnx" and y[5] == "rule_based" and x[0] in core and group(x[0]) == group(y[0]) and x[4] >= y[4] + 0.05:
                return x
        for x, y in ((a, b), (b, a)):
            if x[5] == "rule_based" and x[0] == "institution" and y[0] in ("institution", "organization"):
                return x
        key = lambda e: kind[e[0]]
        if key(a) != key(b):
            return max(a, b, key=key)
        if b[3] - b[2] > a[3] - a[2] and b[4] >= a[4]:
            return b
        if a[3] - a[2] > b[3] - b[2] and a[4] >= b[4]:
            return a
        if a[4] != b[4]:
            return b if b[4] > a[4] else a
        return b if rank[b[5]] > rank[a[5]] else a

    value = lambda e: " ".join(e[1].strip("«»").split()).lower()
    for doc in range(30):
        kept = []
        for e in sorted((x[1:] for x in rows if x[0] == doc), key=lambda e: (e[2], e[3], rank[e[5]], e[1])):
            if kept:
                p = kept[-1]
                near = abs(p[2] - e[2]) <= 2 and abs(p[3] - e[3]) <= 2
                if (p[2] < e[3] and e[2] < p[3]) or (value(p) == value(e) and (near or p[0] == e[0])):
                    kept[-1] = better(p, e)
                    continue
            kept.append(e)
        assert got[doc] == kept


def test_rules_on_negatives(spark):
    d = spark.createDataFrame([(1, "Don José de Larrea y doña Ana; Cabildo, el 3 de nivoso de 1810, 125/05/18100 y 25/05/1810. Río Negro, río Bueno de la Cruz.")], "doc_id int, text string")
    got = {(r["entity_type"], r["value"]) for r in en.extract(d, "doc_id", "text").collect()}
    assert got == {("person", "Don José"), ("institution", "Cabildo"), ("date", "3 de nivoso de 1810"), ("date", "25/05/1810"), ("place", "río Bueno")}


def test_offsets_of_long_texts(spark):
    text = "x " * 500 + "Don Luis é " * 400
    got = sorted(r["start"] for r in en.extract(spark.createDataFrame([(1, text)], "doc_id int, text string"), "doc_id", "text").collect())
    assert got == [1000 + 11 * k for k in range(400)]


def piece(word, start, label, score=0.9):
    return {"piece": word, "start": start, "end": start + len(word.lstrip("#")), "label": label, "score": score}


def test_decoding():
    text = "Juan de la Cruz y St. Gall-en, O’Hara; x"
    assert [(e["value"], e["entity_type"]) for e in de.decoded(text, [piece("Juan", 0, "B-PER"), piece("de", 5, "I-PER"), piece("la", 8, "I-PER"), piece("Cruz", 11, "I-PER")])] == [("Juan de la Cruz", "person")]
    # a beginning inside a word, and one in lower case behind a joiner, go on; a new capital does not
    assert [e["value"] for e in de.decoded(text, [piece("Gall", 22, "B-LOC"), piece("##-en", 26, "B-LOC")])] == ["Gall-en"]
    assert [e["value"] for e in de.decoded(text, [piece("Juan", 0, "B-PER"), piece("de", 5, "B-PER"), piece("Cruz", 11, "B-PER")])] == ["Juan de", "Cruz"]
    assert [e["entity_type"] for e in de.decoded(text, [piece("Juan", 0, "B-PER"), piece("Cruz", 11, "I-LOC"), piece("y", 16, "O")])] == ["person", "place"]
    assert de.decoded(text, [piece("x", 39, "B-MISC")]) == []  # one letter is no entity
    assert de.joined_pieces(["▁San", "[UNK]", "##ta", ",", "Fe"]) == "Santa, Fe" and de.joined_pieces(["Ġa", "b"]) == "a b"
    assert de.labels_of({"1": "B-X", "0": "O"}) == ["O", "B-X"] and de.labels_of(None) == de.LABELS
    assert de.surface_score("JosÃ©") == 0 and de.surface_score("a b") == 2 + 50 + 10 + 5


def test_consolidate_dedup_and_engines(spark):
    rows = [(1, "person", "Ana", 0, 3, 0.9, "onnx"), (1, "person", "Ana Paz", 0, 7, 0.8, "onnx"), (1, "date", "1810", 20, 24, 1.0, "rule_based"), (1, "date", "1811", 30, 34, 1.0, "onnx"), (2, "place", "Lima", 0, 4, 1.0, "spacy"), (2, "place", "Lima", 50, 54, 1.0, "rule_based")]
    e = spark.createDataFrame(rows, ENT)
    assert {r["value"] for r in de.consolidated(e.where("source = 'onnx' and entity_type = 'person'"), "doc").collect()} == {"Ana Paz"}
    assert {(r["doc"], r["value"]) for r in de.engine(e, "doc").collect()} == {(1, "Ana Paz"), (1, "1810"), (2, "Lima")}
    assert {r["source"] for r in de.engine(e, "doc", "spacy").collect()} == {"rule_based", "spacy"}


def test_review(spark):
    answer = '```json\n[{"value": "ana", "type": "Persona", "confidence": 2}, {"value": "Lima", "type": "lugar"}, {"value": "Ana", "type": "person"}, {"value": "X", "type": "thing"}, {"value": "Paz", "type": "otro"}]\n```'
    a = spark.createDataFrame([(1, "In LIMA Ana rests", answer)], "doc int, text string, answer string")
    c = spark.createDataFrame([(1, "person", "Ana", 8, 11, 0.4, "onnx")], ENT)
    p = spark.createDataFrame([(1, "misc", "paz", 90, 93, 1.0, "manual")], ENT)
    got = sorted((r["entity_type"], r["value"], r["start"], r["end"], r["confidence"]) for r in de.reviewed(a, c, p, "doc").collect())
    assert got == [("person", "ana", 8, 11, 1.0), ("place", "Lima", 3, 7, 0.95)]
    assert de.review_request(c, "doc").first()["candidates"] == '[{"value":"Ana","type":"person","confidence":0.4}]'


def test_chunks_and_windows(spark):
    cut = de.packed_chunks(lambda s: len(s.split()), 3)
    text = "a b\n\n \nc d e f g\nh\n"
    assert [text[c["start"] : c["end"]] for c in one(spark, cut(F.lit(text)))] == ["a b\n", "c d e ", "f g\nh\n"]
    assert one(spark, cut(F.lit("  "))) == []
    assert [(w["start"], w["end"]) for w in one(spark, de.windows(F.lit(300)))] == [(0, 256), (224, 300)]


def test_clauses(spark):
    tokens = [(0, "La", "DET", "det", 1), (1, "reina", "NOUN", "nsubj", 2), (2, "fundó", "VERB", "ROOT", 2), (3, "villas", "NOUN", "obj", 2), (4, "ver", "VERB", "x", 2)]
    d = spark.createDataFrame([(tokens,)], "t array<struct<i:int,text:string,pos:string,dep:string,head:int>>")
    got = d.select(de.clauses(F.col("t")).alias("c")).first()["c"]
    assert [tuple(x) for x in got] == [("La reina", "fundó", "villas")]


def test_notes(spark):
    html = '<div>a<script>bad()</script> <b>b</b> <a href="javascript:x">c</a><a href="x.org">d</a><p> </p><br></div>'
    assert one(spark, notes.sanitise(F.lit(html))) == '<p>a b c<a href="https://x.org/" target="_blank" rel="noopener noreferrer nofollow">d</a><br></p>'
    assert one(spark, notes.sanitise(F.lit("a < b &amp; c"))) == "<p>a &lt; b &amp; c</p>"
    assert one(spark, notes.rendered(F.lit("a & b\n\nc"))) == "<p>a &amp; b</p><p>c</p>" and one(spark, notes.rendered(F.lit(None).cast("string"))) == ""
    assert one(spark, notes.is_empty(F.lit("<style>x</style><p> </p>"))) and not one(spark, notes.is_empty(F.lit("x")))


def test_json_errors(spark):
    with pytest.raises(Exception, match="not a JSON array"):
        spark.createDataFrame([("{broken",)], "r string").select(jsons.regions(F.col("r"))).collect()
    assert one(spark, jsons.triples(F.lit("nothing here"))) == []


def test_text_cases(spark):
    assert one(spark, t.repair_mojibake(F.lit("JosÃ©"))) == "José" and one(spark, t.repair_mojibake(F.lit("Ã日"))) == "Ã日"
    assert one(spark, t.store_terms(F.lit('a(AND)b "x-y" or NOT.z'))) == ["a", "b", "xy", "or", "z"]
    assert one(spark, t.model_text(F.lit('"' + "long " * 20 + '"'))) == ("long " * 20).strip() and one(spark, t.model_text(F.lit("'short'"))) == "'short'"
    assert t.split_statements("a; ;b;\n") == ["a", "b"]


def test_guards(spark):
    for bad in ("SELECT 1; SELECT 2", "drop table x", "with x as (select 1) select * from pragma x", "delete from x"):
        with pytest.raises(corpus.Refused):
            corpus.check_rows(bad)
    corpus.check_rows("SELECT 'a;b' AS update")
    corpus.check_rows("INSERT INTO t VALUES (1) RETURNING id")
    corpus.check_execute("DELETE FROM x")
    corpus.check_batch("a; b")
    with pytest.raises(corpus.Refused):
        corpus.check_batch("a; ATTACH x")
    assert corpus.parameters([True, None, {"a": 1}, 2.5]) == [1, None, '{"a": 1}', 2.5]
    assert corpus.select(spark, "SELECT :a AS a", {"a": True}).first()["a"] == 1
    assert corpus.quoted_name("a`b") == "`a``b`"


def test_store_refuses_orphans_and_bad_values(spark):
    s = Store(spark)
    with pytest.raises(MissingParent):
        s.create_item({"id": "i", "title": "t", "collection_id": "none"}, 1)
    s = s.create_collection({"id": "c", "name": "n"}, 1).create_item({"id": "i", "title": "t", "collection_id": "c"}, 2).create_asset({"id": "a", "item_id": "i", "path": "p", "type": "pdf"}, 3)
    assert s.find("assets", "a").first()["sort_index"] == 0
    assert s.delete_item("i")["collections"].count() == 0 and s.delete_asset("a")["items"].count() == 1
    with pytest.raises(Exception, match="not allowed"):
        s.create_entity({"id": "e", "item_id": "i", "entity_type": "thing", "value": "v"}, 1)["entities"].collect()


def test_migrations(spark):
    done = schemas.empty(spark, "_migrations")
    done, ran = schemas.migrated(spark, done, {"2": "SELECT 1; SELECT 2", "1": "SELECT 3"}, 9)
    assert ran == ["1", "2"] and schemas.is_applied(done, "2") and schemas.migrated(spark, done, {"2": "SELECT 1"}, 9)[1] == []


def test_stored_search_equals_scan(spark, tmp_path):
    d = spark.createDataFrame([(k, f"L'eau {'vive' if k % 3 else 'L eau'} São {k % 5}") for k in range(60)], "doc_id long, text string")
    fts.write_index(d, str(tmp_path))
    for terms in (["l'eau"], ["São", "3"], ["vive", "zzz"], ["..."]):
        assert fts.stored_search(spark, str(tmp_path), terms).collect() == fts.search(d, terms).collect()


def test_reindexed(spark):
    a = spark.createDataFrame([("1", "x"), ("2", "y")], "item_id string, text string")
    b = spark.createDataFrame([("2", "z")], "item_id string, text string")
    assert sorted(map(tuple, fts.reindexed(a, b).collect())) == [("1", "x"), ("2", "z")]


def test_page_folds(spark):
    boxes = [("a", 0, 0, 100, 20), ("b", 0, 40, 100, 20), ("c", 300, 0, 100, 20), ("d", 310, 50, 90, 20), ("e", 0, 100, 400, 20)]
    d = spark.createDataFrame([(1, *b) for b in boxes], "page int, region_id string, x int, y int, width int, height int")
    order = {r["region_id"]: r["reading_order"] for r in lay.gap_filled_order(d, ["page"]).collect()}
    assert sorted(order, key=order.get) == ["a", "b", "e", "c", "d"]  # the wide box's centre, 200, lies 150 from the left column's and 152 from the right one's
    assert {r["region_id"]: r["column"] for r in lay.overlap_columns(d.where("region_id <> 'e'"), ["page"]).collect()} == {"a": 0, "b": 0, "c": 1, "d": 1}
    assert {r["region_id"]: r["column"] for r in lay.grid_columns(d.where("region_id <> 'e'"), ["page"]).collect()} == {"a": 0, "b": 0, "c": 1, "d": 1}
    text = spark.createDataFrame([(1, 0, "x"), (1, 1, ""), (1, 2, "y")], "page int, reading_order int, text string")
    assert lay.page_text(text, ["page"]).first()["text"] == "x\ny"


def test_plugin_isolates_rows(spark):
    d = spark.createDataFrame([("a",), (None,), ("bad",)], "text string")

    def make():
        def embed(text):
            if text == "bad":
                raise ValueError("no")
            return [float(len(text))]

        return embed

    got = [(r["v"], r["error"]) for r in plugins.applied(d, make, ["text"], "v", "array<float>").collect()]
    assert got == [([1.0], None), (None, None), (None, "ValueError: no")]


def test_queues(spark, tmp_path):
    waiting = spark.createDataFrame([(k,) for k in range(60)], "item int")
    assert jobs.offered(waiting, spark.createDataFrame([(1,), (99,), (99,)], "item int"), ["item"]).count() == 61
    with pytest.raises(jobs.Full):
        jobs.offered(waiting, spark.createDataFrame([(k,) for k in range(100, 106)], "item int"), ["item"])
    told, seen = [], []
    waiting.write.parquet(str(tmp_path / "in"))

    def fail(batch):
        raise RuntimeError("down")

    stream = spark.readStream.schema("item int").parquet(str(tmp_path / "in"))
    jobs.run_serially(stream, {"fts": fail, "ner": lambda b: seen.append(b.count())}, str(tmp_path / "cp"), lambda n, r: told.append(r)).awaitTermination()
    assert seen == [60] and told == [{"fts": "RuntimeError: down", "ner": None}]
    newest = jobs.newest_request(spark.createDataFrame([("u", 1, "old"), ("u", 2, "new")], "key string, seq int, q string"), "key", "seq")
    assert newest.first()["q"] == "new"
