"""All-pairs similarity moves each vector a fixed number of times, however many blocks meet."""

import random

import pytest

from quillet.operators import similarity


def _vectors(n):
    r = random.Random(8)
    return [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(n)]


@pytest.mark.parametrize("rows,group", [(8, 2), (64, 1)])
def test_no_vector_is_shuffled_to_meet(spark, monkeypatch, rows, group):
    monkeypatch.setattr(similarity, "ROWS", rows)
    monkeypatch.setattr(similarity, "GROUP", group)
    data = _vectors(300)
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = similarity.similar_all(df, 3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and plan.count("Exchange") == 1  # of what was found, by vector
    norm = lambda v: sum(x * x for x in v) ** 0.5
    seen = {r["vec_id"]: r["embedding"] for r in df.collect()}
    like = lambda a, b: round(sum(x * y for x, y in zip(a, b, strict=True)) / norm(a) / norm(b), 6)
    want = {i: [s for s, _ in sorted(((like(v, w), -j) for j, w in seen.items() if j != i), reverse=True)[:3]] for i, v in seen.items()}
    have = {}
    for r in sorted(got.collect(), key=lambda r: (r["vec_id"], r["rank"])):
        have.setdefault(r["vec_id"], []).append(r["similarity"])
    assert have.keys() == want.keys()
    assert all(abs(a - b) < 2e-6 for i in want for a, b in zip(have[i], want[i], strict=True))
