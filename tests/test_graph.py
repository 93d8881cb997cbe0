"""Components with hubs, and similar junctions against all pairs."""

import random

import pytest

from junctura.operators import graph as G


def test_components_with_hubs(spark):
    rng = random.Random(4)
    edges = [(0, k) for k in range(1, 300)] + [(1000 + k, 1000 + k + 1) for k in range(40)] + [(2000, 2000 + rng.randrange(1, 90)) for _ in range(200)] + [(2050, 1020)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    parent = {}

    def find(v):
        parent.setdefault(v, v)
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    want = {v: find(v) for v in parent}
    for hub in (10, 1_000_000):
        assert {r.v: r.root for r in G.components(df, hub=hub).collect()} == want


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.75, 1.0])
def test_similar_junctions_are_those_of_all_pairs(spark, threshold):
    rng = random.Random(8)
    edges = sorted({(f"m{rng.randrange(3)}", *sorted(rng.sample(range(14), 2)), rng.randrange(3)) for _ in range(160)})
    near = {}
    for m, i, j, n in edges:
        if n > 0:
            near.setdefault((m, i), set()).add(j)
            near.setdefault((m, j), set()).add(i)
    want = {(m, i, j): len(a & b) / len(a | b) for (m, i), a in near.items() for (k, j), b in near.items() if m == k and i < j and len(a & b) / len(a | b) >= threshold}
    got = G.similar_junctions(spark.createDataFrame(edges, "module_id string, i int, j int, n int"), threshold).collect()
    assert {(r.module_id, r.i, r.j): r.similarity for r in got} == pytest.approx(want) and len(got) == len(want)
    assert len(want) > 3 or threshold > 0.5
