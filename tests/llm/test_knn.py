"""Vector search against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratakb.llm import knn


def clustered(n, seed=1, dim=64):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 15, dim))
    x = centres[rng.integers(0, len(centres), n)] + rng.standard_normal((n, dim)) * 0.35
    return (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)


def exact(x, k, least):
    s = x.astype(float) @ x.T.astype(float)
    np.fill_diagonal(s, -2)
    out = set()
    for i in range(len(x)):
        for j in np.argsort(-s[i])[:k]:
            if s[i, j] >= least:
                out.add((i, int(j)))
    return out


def frame(spark, x, query=True):
    rows = [(i, [float(v) for v in r], bool(query) if isinstance(query, bool) else i in query) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "key long, vec array<float>, query boolean")


def test_close_pairs_are_found(spark):
    x = clustered(3000)
    got = {(r.key, r.near) for r in knn.most_similar(frame(spark, x), k=10, min_sim=0.8, cell_rows=800).collect()}
    want = exact(x, 10, 0.8)
    assert len(got & want) >= 0.97 * len(want) and len(got & want) >= 0.97 * len(got)


def test_query_set_recall(spark):
    x = clustered(2000, 2)
    asked = set(range(0, 2000, 100))
    got = {(r.key, r.near) for r in knn.most_similar(frame(spark, x, asked), k=10, distance=1.0, success=0.98, scan=True, cell_rows=500).collect()}
    want = {p for p in exact(x, 10, -1) if p[0] in asked}
    assert {a for a, _ in got} == asked and len(got & want) >= 0.9 * len(want)


def test_hot_cell_is_split_without_loss(spark):
    x = clustered(900, 3)
    x[:300] = x[0]  # a third of all rows are one vector
    one = {(r.key, r.near) for r in knn.most_similar(frame(spark, x), k=3, min_sim=0.9, cell_rows=60, scan=True).collect() if r.key >= 300}
    want = {p for p in exact(x, 3, 0.9) if p[0] >= 300}
    assert len(one & want) >= 0.97 * len(want)


def test_odd_vectors(spark):
    x = clustered(60, 4)
    rows = [(i, [float(v) for v in r], True) for i, r in enumerate(x)]
    rows += [(100, None, True), (101, [1.0] * 63, True), (102, [0.0] * 64, True), (103, [float("nan")] * 64, True), (104, [None] + [1.0] * 63, True), (105, [float("inf")] + [0.0] * 63, True)]
    rows += [(0, [float(v) for v in x[0]], True), (106, [float(v) * 1e-20 for v in x[1]], None)]
    df = spark.createDataFrame(rows, "key long, vec array<float>, query boolean")
    got = knn.most_similar(df, k=5, min_sim=0.5).collect()
    assert {r.key for r in got} <= set(range(60)) and {r.near for r in got} <= {*range(60), 106}
    assert all(r.key != r.near for r in got) and len({(r.key, r.near) for r in got}) == len(got)
    assert any(r.key == 1 and r.near == 106 and r.sim > 0.999 for r in got)
    assert knn.most_similar(df.limit(0)).count() == 0


def test_usable_units():
    col = pa.array([[3.0, 4.0], None, [0.0, 0.0], [1.0, None], [float("inf"), 1.0], [1e-30, 0.0]], pa.list_(pa.float32()))
    at, unit = knn.usable_units(col, 2)
    assert at.tolist() == [0, 5] and np.allclose(unit, [[0.6, 0.8], [1.0, 0.0]])


@pytest.mark.parametrize("m", [1, 2, 5])
def test_probes_start_at_home_and_differ(m):
    x = clustered(200, 5)
    cells = knn.Cells(7, 64, m, 1.5)
    home, _, _ = cells.home(x)
    rows, visited = cells.probes(x, 0.4, 0.99, 4)
    for i in range(200):
        mine = visited[rows == i]
        assert mine[0] == home[i] and len(set(mine)) == len(mine) <= 4


@pytest.mark.parametrize("m", [2, 4, 7])
def test_few_cells_are_those_of_the_general_order_without_its_scores(m, monkeypatch):
    """Three cells a query are the nearest ones; the likelihoods of all steps of all rows took most of the search before."""
    x = clustered(3000, 14)
    table = knn.Cells(121, 64, m, 1.5)
    r, c = table._probes(x, 0.45, 0.98, 3)
    want = set(zip(r.tolist(), c.tolist()))
    scored, cdf = [], knn._normal_cdf
    monkeypatch.setattr(knn, "_normal_cdf", lambda z: scored.append(np.size(z)) or cdf(z))
    r, c = table.probes(x, 0.45, 0.98, 3)
    assert set(zip(r.tolist(), c.tolist())) == want and len(r) == 3 * len(x)
    assert sum(scored) < len(x)
    r, c = table.probes(x, 0.05, 0.98, 3)  # where the success adds up before, fewer are visited
    assert len(r) < 3 * len(x)


def test_best_of_a_list():
    q, c = np.array([1, 0, 0, 0, 1, 0]), np.array([2, 1, 2, 0, 2, 1])
    s = np.array([0.1, 0.2, 0.5, 0.5, 0.9, 0.7], np.float32)
    got = knn._best(q, c, s, np.arange(2), np.array([30, 20, 10]), 2)  # the better of two cosines of a pair, ties by the key
    assert [z.tolist() for z in got[:2]] == [[0, 0, 1], [1, 2, 2]] and np.allclose(got[2], [0.7, 0.5, 0.9])
    q, c, s = knn._best(q, c, -s, np.arange(2), np.array([30, 20, 10]), 9)
    assert q.tolist() == [0, 0, 0, 1] and c.tolist() == [1, 2, 0, 2] and np.allclose(s, [-0.2, -0.5, -0.5, -0.1])


def test_extra_columns(spark):
    df = frame(spark, clustered(50, 6)).withColumn("cell", F.lit("x")).withColumn("near", F.lit(1))
    assert knn.most_similar(df, k=2, min_sim=0.1).columns == ["key", "near", "sim"]


def test_many_keys_of_one_vector(spark):
    x = clustered(9000, 8)
    x[:3000] = x[0]
    got = {}
    for r in knn.most_similar(frame(spark, x), k=10, min_sim=0.85).collect():
        got.setdefault(r.key, []).append((r.near, r.sim))
    for i in range(3000):  # ties go to the smallest keys
        assert sorted(n for n, _ in got[i]) == [j for j in range(11) if j != i][:10] and min(s for _, s in got[i]) > 0.9999


def test_search_of_a_cell_holds_few_pairs():
    x = clustered(3000, 9)
    x[:] = x[0] + np.random.default_rng(1).standard_normal(x.shape).astype(np.float32) * 0.01
    x /= np.linalg.norm(x, axis=1)[:, None]
    yes = np.ones(len(x), bool)
    q, c, s = knn.search_cell(np.arange(len(x)), yes, yes, x, 5, 0.85, 6, 3, 0.35, True, 20)
    assert len(q) < 0.1 * len(x) ** 2  # all 9 million pairs are close
    q, c, _ = knn._best(q, c, s, np.arange(len(x)), np.arange(len(x)), 5)
    want = exact(x, 5, 0.85)
    assert len(set(zip(q.tolist(), c.tolist())) & want) >= 0.99 * len(want)


def test_rows_inserted_again_take_no_place(spark):
    x = clustered(400, 10)
    df = frame(spark, x, set(range(0, 400, 20)))
    many = df.unionByName(df).unionByName(df).unionByName(df.where("key = 7").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(200)))).drop("n"))
    asked = {"k": 10, "distance": 1.0, "success": 0.98, "scan": True}
    once = {(r.key, r.near) for r in knn.most_similar(df, **asked).collect()}
    again = [(r.key, r.near) for r in knn.most_similar(many, **asked).collect()]
    assert set(again) == once and len(again) == len(once) == 20 * 10


@pytest.mark.parametrize("m", [3, 5, 7])
def test_recall_does_not_depend_on_the_directions(m):
    """Share of close pairs whose cells are visited, with as many directions as large collections have."""
    x = clustered(6000, 11)
    s = x @ x.T
    np.fill_diagonal(s, -1)
    q, c = np.nonzero(s[:400] >= 0.85)
    table = knn.Cells(20, 64, m, 1.5)
    home = table.home(x)[0]
    rows, cells = table.probes(x[:400], 0.45, 0.97)
    visited = set(zip(rows.tolist(), cells.tolist()))
    assert np.mean([(i, home[j]) in visited for i, j in zip(q, c)]) >= 0.95


def test_sims_are_those_of_the_given_vectors(spark):
    x = clustered(600, 12)
    asked = set(range(0, 600, 10))
    scaled = x * np.random.default_rng(1).uniform(0.1, 9, (len(x), 1)).astype(np.float32)
    y = scaled.astype(float) / np.linalg.norm(scaled.astype(float), axis=1)[:, None]
    for r in knn.most_similar(frame(spark, scaled, asked), k=10, distance=1.0, success=0.98, scan=True).collect():
        assert abs(r.sim - y[r.key] @ y[r.near]) < 1e-12
    limit = float(np.sort((y @ y.T)[np.triu_indices(600, 1)])[-800]) - 1e-12  # a pair lies right at the threshold
    got = {(r.key, r.near) for r in knn.most_similar(frame(spark, scaled), k=600, min_sim=limit, scan=True).collect()}
    assert got == {(i, j) for i in range(600) for j in range(600) if i != j and y[i] @ y[j] >= limit}


def test_rows_and_queries_of_a_hot_cell_are_split(spark):
    """With the least cells everything is split on the grid, and every query still meets every row."""
    x = clustered(1200, 13)
    got = {(r.key, r.near) for r in knn.most_similar(frame(spark, x), k=10, min_sim=0.8, cell_rows=20, distance=0.6, success=0.999, scan=True).collect()}
    want = exact(x, 10, 0.8)
    assert len(got & want) >= 0.99 * len(want)
