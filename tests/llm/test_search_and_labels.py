"""Toxicity, ranked search and importance resampling on small tables with nulls, empty and long texts, repeats and clashing columns, against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillet.llm import queries, resampling, toxicity, wand
from quillet.llm.common import new_path

SCHEMA = "doc_id long, text string, score long, rank string, term string, weight long, n_words long, spans string, shard long, item_id long"
SF = "/root/testdata/sf0.001"


def rows():
    r = random.Random(5)
    words = ["".join(r.choice("abdeilnorst") for _ in range(r.randint(1, 3))) for _ in range(150)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    texts = [None, "", " \n.,! ", "one", "É ÜBER ſtraße 日本語, don't_stop 42x42 A-b", prose(30_000), *(prose(r.randint(1, 60)) for _ in range(300))]
    texts += [texts[9]] * 3 + ["zebra " + prose(20), "Zebra zebra\x00" + prose(20)]
    return [(k, x, 1, "r", "t", 2, 3, "s", 4, 5) for k, x in enumerate(texts)] + [(9, texts[9], 1, "r", "t", 2, 3, "s", 4, 5), (None, texts[10], 1, "r", "t", 2, 3, "s", 4, 5)]


@pytest.fixture(scope="module")
def data():
    return rows()


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.createDataFrame(data, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(data, items, k):
    found = [(i, Counter(terms(x))) for i, x, *_ in data]
    found = [(i, c, sum(c.values())) for i, c in found if c]
    n_docs, total = len(found), sum(n for *_, n in found)
    df = Counter(t for _, c, _ in found for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in found:
            m = 25 + 75 * n * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if s > 0:
                scores.append((-s, math.inf if i is None else i, i))
        out += [(item, p + 1, i, -s) for p, (s, _, i) in enumerate(sorted(scores, key=lambda x: x[:2])[:k])]
    return sorted(out, key=str)


def test_ranked_search_is_brute_force(spark, docs, data):
    items = [(7, data[9][1]), (7, data[40][1]), (8, None), (9, "nothing-here"), (10, "zebra Zebra " + data[50][1]), (None, data[60][1] + " " + data[61][1]), (11, data[5][1][:4000])]
    got = wand.ranked_search(docs, spark.createDataFrame([(i, x, 3, "t") for i, x in items], "item_id long, text string, score int, term string"), 7)
    assert sorted(map(tuple, got.collect()), key=str) == ranked(data, items, 7)


def test_shards_and_blocks_do_not_change_ranks(spark, docs, data, monkeypatch):
    monkeypatch.setattr(wand, "ITEMS", 2)
    monkeypatch.setattr(wand, "SENT", 3)
    items = [(k, data[k][1]) for k in range(20, 30)]
    path = new_path(spark, "t")
    wand.LexicalIndex.build(docs.repartition(40), path)
    got = wand.LexicalIndex(spark, path).search(spark.createDataFrame(items, "item_id long, text string"), 10)  # opened again
    assert sorted(map(tuple, got.collect()), key=str) == ranked(data, items, 10)


def test_walk_finds_what_sorting_finds():
    r = np.random.default_rng(2)
    for _ in range(200):
        n = int(r.integers(1, 2000))
        lists = [(np.sort(r.choice(n, int(r.integers(0, n + 1)), replace=False)).astype("<i4"), None) for _ in range(int(r.integers(0, 9)))]
        lists = [(o, r.integers(0, int(10 ** r.integers(1, 5)), len(o))) for o, _ in lists]
        total = np.zeros(n, np.int64)
        for o, c in lists:
            total[o] += c
        ids = r.integers(0, 50, n)
        at, score = wand.best(lists, ids, 5)
        want = [k for k in np.lexsort((ids, -total)) if total[k] > 0][:5]
        order = np.lexsort((ids[at], -score))
        assert [(score[k], ids[at[k]]) for k in order] == [(total[k], ids[k]) for k in want]


def test_search_of_empty_tables(docs, none):
    assert wand.ranked_search(none, docs.select("item_id", "text")).count() == 0
    assert wand.ranked_search(docs, none.select("item_id", "text")).count() == 0


def weighed(data, target, most, buckets, least, percent, seed):
    runs = lambda w: [" ".join(w[k : k + n]) for n in range(1, most + 1) for k in range(len(w) - n + 1)]
    at = lambda text: [zlib.crc32(f.encode()) % buckets for f in runs(terms(text))]
    s, t = Counter(), Counter()
    for _, x, *_ in data:
        s.update(at(x))
    for x in target:
        t.update(at(x))
    gain = [math.floor(1000 * math.log((t[k] + 1) * (s.total() + buckets) / ((s[k] + 1) * (t.total() + buckets)))) for k in range(buckets)]
    out = []
    for i, x, *_ in data:
        f = at(x)
        w = sum(gain[k] for k in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(terms(x)), len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], math.inf if x[0] is None else x[0]))
    drawn = able[: len(able) * percent // 100]
    return sorted(((*x, None) for x in out), key=str), [(x[0], x[4], k + 1) for k, x in enumerate(drawn)]


@pytest.mark.parametrize(("most", "percent"), [(1, 10), (2, 45), (1, 0), (1, 100)])
def test_resampling_is_brute_force(spark, docs, data, most, percent):
    target = [x for _, x, *_ in data[100:120]] + [None, ""]
    got = resampling.resample(docs, spark.createDataFrame([(x,) for x in target], "text string"), 500, most, 20, percent, 11).collect()
    want, drawn = weighed(data, target, most, 500, 20, percent, 11)
    assert sorted(((*r[:5], None) for r in got), key=str) == want
    assert sorted(((r["doc_id"], r["score"], r["rank"]) for r in got if r["rank"]), key=lambda x: x[2]) == drawn
    kept = resampling.resampled(docs, spark.createDataFrame([(x,) for x in target], "text string"), 500, most, 20, percent, 11)
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted(d[0] or -1 for d in drawn)


def test_resampling_of_empty_tables(docs, none):
    assert resampling.resample(none, docs).count() == 0
    assert resampling.resample(docs, none).count() == docs.count()


def test_resampled_keeps_columns_with_its_texts(docs):
    kept = resampling.resampled(docs, docs, percent=50)
    assert {"doc_id", "text", "rank", "term", "item_id"} <= set(kept.columns)


@pytest.mark.parametrize("name", ["op12_ranked_search", "op13_resampling"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, SF).toPandas()[list(want.columns)]
    text = lambda df: sorted(df.astype(object).where(df.notna(), None).astype(str).itertuples(index=False, name=None))
    assert text(got.astype("Int64")) == text(want.astype("Int64"))


def test_marginals_are_those_of_all_paths():
    r = np.random.default_rng(4)
    field = toxicity.Field.blank(8)
    field.moves, field.starts = r.normal(0, 2, (3, 3)), r.normal(0, 2, 3)
    sizes = [1, 4, 2, 6, 1, 5]
    logs = r.normal(0, 3, (sum(sizes), 3))
    first = np.zeros(len(logs), bool)
    first[np.cumsum([0, *sizes[:-1]])] = True
    got, at = field.marginals(logs, first)[0], 0
    for n in sizes:
        want = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=n):
            p = math.exp(field.starts[path[0]] + sum(logs[at + k, s] for k, s in enumerate(path)) + sum(field.moves[a, b] for a, b in zip(path, path[1:], strict=False)))
            want[np.arange(n), path] += p
        assert np.allclose(got[at : at + n], want / want.sum(1, keepdims=True))
        at += n


def labelled(n, seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abdeilnorst") for _ in range(r.randint(2, 7))) for _ in range(800)]
    out = []
    for k in range(n):
        own = [r.choice(words) for _ in range(r.randint(20, 120))]
        toxic = int(r.random() < 0.2)
        for _ in range(3 * toxic):
            own.insert(r.randrange(len(own)), r.choice(["gruzz" + r.choice(words), "Vexx", "vexx,"]))
        out.append((k, " ".join(own), toxic))
    return out


def test_toxicity_finds_spans_and_documents(spark):
    known, fresh = labelled(400, 1), labelled(200, 2)
    docs = spark.createDataFrame([(k, x, "clash", 0) for k, x, _ in known], "doc_id long, text string, spans string, toxic int")
    labels = spark.createDataFrame([(k, t) for k, _, t in known] + [(k, t) for k, _, t in known[:50]] + [(None, 1), (5000, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.ToxicityModel.train(docs, labels)
    new = [(k, x) for k, x, _ in fresh] + [(7, fresh[7][1]), (None, fresh[8][1]), (900, None), (901, ""), (902, "1 2 3 ..."), (903, "plain words " * 30_000 + "vexx vexx gruzzab")]
    got = model.score(spark.createDataFrame([(k, x, 9.0) for k, x in new], "doc_id long, text string, score double").repartition(3)).collect()
    assert len(got) == len(new)
    by = {r["doc_id"]: r for r in got}
    right = sum((by[k]["score"] >= 0.3) == bool(t) for k, _, t in fresh)
    assert right >= 0.97 * len(fresh)
    assert len({r["score"] for r in got if r["doc_id"] == 7}) == 1
    assert by[900]["score"] == by[901]["score"] == by[902]["score"] < 0.3 and not by[900]["spans"]
    assert by[903]["score"] >= 0.3
    marked = [(x[s["start"] : s["end"]].lower(), t) for k, x, t in fresh for s in by[k]["spans"]]
    assert sum("gruzz" in w or "vexx" in w for w, _ in marked) >= 0.95 * len(marked) > 0
    assert sum("gruzz" in w or "vexx" in w for w, _ in marked) >= 0.9 * sum(bool(t) for *_, t in fresh)


def test_toxicity_without_labels(spark, docs, none):
    for labels in (none.select("doc_id", F.lit(1).alias("toxic")), docs.select("doc_id", F.lit(1).alias("toxic"))):
        got = toxicity.ToxicityModel.train(docs, labels).score(docs).collect()
        assert len(got) == docs.count() and {r["score"] for r in got} == {0.0}
    few = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, 1).otherwise(0).alias("toxic"))
    assert toxicity.ToxicityModel.train(docs, few).score(none).count() == 0
