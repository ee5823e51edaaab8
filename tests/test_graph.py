import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom.operators import graph


def reach(edges, n):
    r = np.eye(n, dtype=bool)
    for a, b in edges:
        r[a, b] = True
    for k in range(n):
        r |= r[:, k : k + 1] & r[k : k + 1, :]
    return r


@pytest.mark.parametrize("kind", ["random", "chain", "cycles"])
def test_strong_components_against_closure(spark, kind):
    rng = random.Random(4)
    n = 24
    edges = {
        "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(30)],
        "chain": [(i, i + 1) for i in range(9)],
        "cycles": [(i, (i + 1) % 5) for i in range(5)] + [(10 + i, 10 + (i + 3) % 7) for i in range(7)] + [(4, 12), (20, 3), (16, 21), (21, 22)],
    }[kind]
    r = reach(edges, n)
    name = lambda i: f"n{i:02d}"
    nodes = spark.createDataFrame([(name(i), False) for i in range(n)], "id string, is_onion boolean")
    e = spark.createDataFrame([(name(a), name(b), 1) for a, b in edges], "src string, dst string, weight long")
    same = r & r.T
    want = {name(i): name(int(np.flatnonzero(same[i])[0])) for i in range(n)}
    c = graph.strong_components(nodes, e)
    assert {x.id: x.component for x in c.collect()} == want
    top = max(set(want.values()), key=lambda x: (sum(v == x for v in want.values()), [-ord(ch) for ch in x]))
    k = int(top[1:])
    part = lambda i: "core" if same[i, k] else "in" if r[i, k] else "out" if r[k, i] else "tendrils"
    assert {x.id: x.part for x in graph.bow_tie(nodes, e, c).collect()} == {name(i): part(i) for i in range(n)}


@pytest.mark.parametrize("ring", [True, False])
def test_long_chains_and_rings_take_few_rounds(spark, ring, monkeypatch):
    n, rounds, write = 5000, [], graph.Scratch.write
    monkeypatch.setattr(graph.Scratch, "write", lambda self, df, name: rounds.append(name) or write(self, df, name))
    nodes = spark.range(n).select(F.format_string("n%05d", "id").alias("id"))
    at = lambda c: F.format_string("n%05d", c % n)
    e = spark.range(n if ring else n - 1).select(at(F.col("id")).alias("src"), at(F.col("id") + 1).alias("dst"), F.lit(1).alias("weight"))
    got = graph.strong_components(nodes, e)
    assert got.count() == n and got.select("component").distinct().count() == (1 if ring else n)
    assert sum(name.startswith("both") for name in rounds) < 40 and len(rounds) < 150


def test_components_behind_pivots(spark):
    """Dense parts, in which no node has a single neighbour, in a row: only searches tell them apart."""
    rng, rows = random.Random(9), []
    for part in range(90):
        mine = [f"p{part:02d}-{i}" for i in range(5)]
        rows += [(a, b, 1) for a in mine for b in mine if a != b]
        rows += [(rng.choice(mine), f"p{later:02d}-{rng.randrange(5)}", 1) for later in rng.sample(range(part + 1, 95), min(4, 94 - part))]
    e = spark.createDataFrame(rows, "src string, dst string, weight long")
    got = {r.id: r.component for r in graph.strong_components(graph.nodes_of(e), e).collect()}
    assert got == {i: (f"{i[:3]}-0" if int(i[1:3]) < 90 else i) for i in got} and len(got) >= 450


def test_rounds_shuffle_ranks_and_fronts_only(spark):
    nodes = spark.range(200).select(F.col("id").cast("string"))
    e = spark.range(600).select((F.col("id") % 200).cast("string").alias("src"), (F.col("id") * 7 % 200).cast("string").alias("dst"), F.lit(1).alias("weight"))
    plans, bucketed = {}, graph.Scratch.bucketed
    def seen(self, df, name, *keys, laid=False):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return bucketed(self, df, name, *keys, laid=laid)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    graph.Scratch.bucketed = seen
    try:
        ranks = graph.pagerank(nodes, e, fixed=3).agg(F.sum("pagerank")).first()[0]
        graph.bow_tie(nodes, e)
    finally:
        graph.Scratch.bucketed = bucketed
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert ranks == pytest.approx(1)
    # ranks lie with the shares: one exchange, of what they hand on; a search's fronts join where they lie
    assert plans["ranks2"].count("Exchange hashpartitioning") == 1, plans["ranks2"]
    assert plans["masks2"].count("Exchange hashpartitioning") == 1, plans["masks2"]


def test_rounds_that_run_out_raise(spark):
    nodes = spark.range(9).select(F.col("id").cast("string"), F.lit(False).alias("is_onion"))
    e = spark.createDataFrame([(str(i), str((i + 1) % 9), 1) for i in range(9)], "src string, dst string, weight long")
    with pytest.raises(RuntimeError):
        graph.reachable(e, nodes.where("id = '0'"), max_rounds=3)
    with pytest.raises(RuntimeError):
        graph.strong_components(nodes, e, max_rounds=0)


def test_pagerank_settles_where_the_matrix_does(spark):
    edges = [(0, 1, 2), (1, 2, 1), (2, 0, 1), (0, 2, 1), (3, 0, 5), (1, 4, 1)]  # 4 dangles, nothing leads to 3
    nodes = spark.createDataFrame([(i,) for i in range(5)], "id long")
    e = spark.createDataFrame(edges, "src long, dst long, weight long")
    for weighted in (True, False):
        m = np.zeros((5, 5))
        for a, b, w in edges:
            m[b, a] = w if weighted else 1
        m[:, 4] = 1
        m /= m.sum(axis=0)
        x = np.full(5, 0.2)
        for _ in range(500):
            x = 0.85 * m @ x + 0.15 / 5
        got = {r.id: r.pagerank for r in graph.pagerank(nodes, e, tol=1e-4, use_weights=weighted).collect()}
        assert [got[i] for i in range(5)] == pytest.approx(x.tolist(), abs=2e-3)
    assert {r.pagerank for r in graph.pagerank(nodes, e, tol=0.0, max_iter=2).collect()} == {0.0}


def test_document_of_any_graph(spark):
    nodes = spark.createDataFrame([("b", True), ("a\"c", False)], "id string, is_onion boolean")
    e = spark.createDataFrame([("b", "a\"c", 2), ("a\"c", "b", 1)], "src string, dst string, weight long")
    text = lambda n, x: "".join(r.json for r in graph.document(n, x).collect())
    got = json.loads(text(nodes, e))
    assert got == {"nodes": [{"id": 'a"c', "is_onion": False}, {"id": "b", "is_onion": True}], "edges": [{"src": 'a"c', "dst": "b", "weight": 1}, {"src": "b", "dst": 'a"c', "weight": 2}]}
    assert json.loads(text(nodes.limit(0), e.limit(0))) == {"nodes": [], "edges": []}
