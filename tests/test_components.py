import random

from webloom.operators.components import connected_components


def brute(edges):
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_chain_star_and_random(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5000 + rng.randrange(80), 5000 + rng.randrange(80)) for _ in range(60)]
    df = spark.createDataFrame([*edges, (7, 7), (None, 3)], "src long, dst long")
    want = brute([(a, b) for a, b in edges if a != b])
    assert {r.node: r.component for r in connected_components(df).collect()} == want
    assert connected_components(df.limit(0)).collect() == []
