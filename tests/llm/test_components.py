import random

import pytest

from voxelgrove.llm.components import HUB, contract


def union_find(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in list(parent)}


N = 1000
RNG = random.Random(4)
GRAPHS = {
    "path": [(k, k + 1) for k in range(N)],
    "star": [(0, k) for k in range(1, N)] + [(N + k, N + N) for k in range(50)],
    "zigzag": [(k, N - k) for k in range(N // 2)] + [(k + 1, N - k) for k in range(N // 2)],
    "random": [(RNG.randrange(N), RNG.randrange(N)) for _ in range(N)] + [(3, 3), (5, 6), (6, 5)],
    "two hubs that share leaves": [(900 + k % 2, k // 2) for k in range(600)] + [(0, 2000)],
    "none": [],
}


@pytest.mark.parametrize("hub", [HUB, 1, 20])
@pytest.mark.parametrize("name", GRAPHS)
def test_same_as_union_find(spark, name, hub):
    edges = GRAPHS[name]
    got = {r.node: r.root for r in contract(spark.createDataFrame(edges, "a long, b long"), hub=hub).collect()}
    assert got == union_find([(a, b) for a, b in edges if a != b])
