import itertools

import numpy as np
import pytest

from tagweave.llm import embedding_dedup as E


def brute(rows, min_cosine):
    out = {}
    for (i, a), (j, b) in itertools.combinations(rows, 2):
        a, b = np.array(a, float), np.array(b, float)
        d = np.square(a / np.linalg.norm(a) - b / np.linalg.norm(b)).sum()
        if d <= 2 * (1 - min_cosine):
            out[min(i, j), max(i, j)] = round(d, 6)
    return out


@pytest.mark.parametrize("dim,block,cosine,cell", [(64, 8, 0.95, 50_000), (20, 8, 0.8, 20), (5, 2, 0.9, 5), (1, 8, 0.9, 50_000)])
def test_against_brute_force(spark, monkeypatch, dim, block, cosine, cell):
    monkeypatch.setattr(E, "CELL_VECTORS", cell)  # small, so that more grid dimensions are used
    rng = np.random.default_rng(3)
    x = rng.standard_normal((120, dim))
    x[60:] = x[:60] + rng.standard_normal((60, dim)) * rng.uniform(0, 0.4, (60, 1))
    rows = [(k, v.astype(np.float32).tolist()) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>")
    got = {(r.vec_id_a, r.vec_id_b): r.sq_dist for r in E.near_vectors(df, cosine, block).collect()}
    want = brute(rows, cosine)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (2, [2.0, 0.001], 0), (2, [2.0, 0.0], 0), (3, [0.0, 0.0], 0), (4, None, 0), (5, [], 0), (6, [nan, 1.0], 0), (7, [inf, 1.0], 0), (None, [1.0, 0.0], 0), (8, [1.0, None], 0), (9, [1.0, 0.0, 0.0], 0), (10, [1e300, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>, block int")
    got = {(r.vec_id_a, r.vec_id_b): r.sq_dist for r in E.near_vectors(df).collect()}
    assert got == {(1, 2): 0.0, (1, 10): 0.0, (2, 10): 0.0}
    assert E.near_vectors(df.limit(0)).collect() == []


def test_groups_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((60, 24))
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(100 + k, (x[k % 9] * (1 + k % 2) + (k % 5 > 2) * 0.05 * rng.standard_normal(24)).tolist()) for k in range(80)]
    root = {i: i for i, _ in rows}
    for a, b in sorted(brute(rows, 0.95)):
        low, high = sorted((root[a], root[b]))
        root = {i: low if r == high else r for i, r in root.items()}
    df = spark.createDataFrame([*rows, *rows[:5], (None, [1.0] * 24), (500, None), (501, [0.0] * 24)], "vec_id int, embedding array<double>")
    got = {r.vec_id: (r.root, r.group_size) for r in E.vector_groups(df).collect()}
    sizes = {r: sum(v == r for v in root.values()) for r in root.values()}
    assert got == {i: (r, sizes[r]) for i, r in root.items()} and max(sizes.values()) > 5
    assert E.vector_groups(df.limit(0)).collect() == []


def test_thousands_of_equal_vectors_are_one(spark):
    df = spark.range(20_000).selectExpr("id as vec_id", "array(1.0d, cast(id % 3 as double), 2.0d) as embedding")
    got = E.vector_groups(df)
    assert sorted(tuple(r) for r in got.groupBy("root", "group_size").count().collect()) == [(0, 6667, 6667), (1, 13333, 13333)]
    assert E._near_units(E._distinct(df, "vec_id", "embedding")[0], 0.95, 8, 7).count() == 1
