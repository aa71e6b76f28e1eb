import random

import pytest
from pyspark.sql import functions as F

from kappaloom.llm import topk_search
from kappaloom.llm.topk_search import top_k

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=5):
    import math
    usable = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows
              if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, own in usable:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in usable if (i, v) != (q, own))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, rows, **settings):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    return sorted(map(tuple, top_k(df, F.col("vec_id") % 50 == 0, **settings).collect()))


def test_against_brute_force_with_ties_and_copies(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK_ROWS", 40)
    monkeypatch.setattr(topk_search, "QUERY_ROWS", 4)
    rnd = random.Random(1)
    rows = [(i, [rnd.randint(-3, 3) / 4 for _ in range(6)]) for i in range(400)]
    rows += [(i, [0.5] * 6) for i in range(400, 600)]
    rows += [(700, [0.0] * 6), (750, [1.0, 2.0])]
    assert run(spark, rows, pivots=7, sample_rows=50) == brute(rows)


def test_unusable_vectors_and_few_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (None, [1.0, 1.0]),
            (4, [float("inf"), 0.0]), (5, [0.5, 0.5]), (50, [2.0, 0.0]), (50, [2.0, 0.0])]
    assert run(spark, rows) == brute(rows)


def test_repeated_ids(spark):
    """Each different vector of an id is a candidate, and a query of its own; equal rows count once."""
    assert (50, 1, 1, 5 * 256 * 256) in run(spark, [(50, [1.0, 0.0]), (1, [0.1, 0.0]), (1, [5.0, 0.0]), (2, [3.0, 0.0])])
    rnd = random.Random(3)
    rows = [(rnd.choice([0, 0, 50, 7, 7, *range(20)]), [rnd.randint(-2, 2) / 2 for _ in range(rnd.choice([2, 3]))])
            for _ in range(200)]
    rows += [(50, [1.0, 0.5]), (50, [1.0, 0.5, 0.0]), (0, [1.0, 0.5])] * 2
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [(1, [1.0])]) == [] and run(spark, [(0, [])]) == []


def test_hot_vector_searches_no_pair_of_copies(spark):
    rows = [(i, [0.25, 0.5]) for i in range(3000)]
    assert run(spark, rows) == [
        (q, r + 1, i, 64 * 64 + 128 * 128) for q in range(0, 3000, 50)
        for r, i in enumerate([i for i in range(6) if i != q][:5])]


@pytest.mark.parametrize("scale", [1, 256])
def test_large_components_stay_exact(spark, scale):
    rows = [(0, [3e5, -2e5, 1.0]), (1, [3e5, 1e5, 2.0]), (2, [-3e5, 2e5, 4.0]), (3, [1e5, 1e5, 1e5])]
    got = run(spark, rows, scale=scale)
    vec = {i: [int(x * scale) for x in v] for i, v in rows}
    assert [s for *_, s in got] == sorted((sum(a * b for a, b in zip(vec[0], vec[i])) for i in (1, 2, 3)), reverse=True)
