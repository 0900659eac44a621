import random

from stratakb.operators.graph import connected_components


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components_match_union_find(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)]
    edges += [(i, i + 1) for i in range(200, 260)] + [(300, 300), (None, 5), (7, None), (200, 201)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == brute(edges)


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0
