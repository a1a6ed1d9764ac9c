"""Graphs as rows against the operators over tables of runs and edges, and what they may shuffle."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions.lineage import stored
from spanloom.operators import bundles, graph
from spanloom.plans import catalog
from spanloom.plans.views import view

SF = "/root/testdata/sf0.001"
FACTS = ["input_flawed", "verifier", "unscored_reason"]


def tables(spark, text):
    """Random graphs, some with circles, loops, a null graph, missing ends, null times and scores that are null or not a number."""
    r = random.Random(5)
    name = (lambda i: f"r{i}") if text else (lambda i: i)
    runs, edges = [], []
    for g in [None, *range(1, 60)]:
        n = r.choice([1, 2, 3, 5, 8, 90])
        at = list(range(n))
        r.shuffle(at)
        for i in range(n):
            runs.append((g, name(i), r.choice([None, at[i], at[i] // 2]), r.choice([None, 0.1, 0.4, 0.6, 0.9, float("nan")]), r.random() < 0.3, r.random() < 0.3, r.choice([None, "payload_missing", "other"])))
        for _ in range(r.choice([0, n, 2 * n])):
            a, b = r.randrange(n + 1), r.randrange(n + 1)
            edges.append((g, name(min(a, b) if g and g % 3 else a), name(max(a, b) if g and g % 3 else b)))
    edges += [(1, None, name(0)), (1, name(0), None), (77, name(0), name(1))]
    kind = "string" if text else "long"
    return (stored(spark.createDataFrame(runs, f"graph_id long, run_id {kind}, end_time long, score double, input_flawed boolean, verifier boolean, unscored_reason string")),
            stored(spark.createDataFrame(edges, f"graph_id long, from_run_id {kind}, to_run_id {kind}")))


def rows(df, *columns):
    return sorted(repr(tuple(x)) for x in df.select(*columns).collect())


@pytest.mark.parametrize("text", [False, True])
def test_graphs_as_rows(spark, text):
    runs, edges = tables(spark, text)
    g = stored(bundles.components(bundles.gathered(runs, edges, FACTS)))
    s = stored(graph.condense(runs, edges))
    links = stored(graph.scc_edges(s, edges))
    assert rows(bundles.sccs(g), *s.columns) == rows(s, *s.columns)
    assert rows(bundles.links(g), "graph_id", "src", "dst") == rows(links, "graph_id", "src", "dst")
    assert rows(bundles.topological(g), "graph_id", "scc", "topo", "depth") == rows(graph.topological(s, links), "graph_id", "scc", "topo", "depth")
    want = graph.edge_drop_origins(s, links, runs).where("graph_id is not null")  # its joins don't find facts without a graph
    assert rows(graph.drop_origins(g).where("graph_id is not null"), *want.columns) == rows(want, *want.columns)
    of = {(x.graph_id, x.run_id): x.scc for x in graph.membership(s).collect()}
    assert {(x.graph_id, x.run_id): x.scc for x in bundles.runs(g).collect()} == of


def test_edges_of_orders(spark):
    o = catalog.Orders(spark, SF)
    assert rows(bundles.edges(o.gathered()), "graph_id", "from_run_id", "to_run_id") == rows(view(spark, SF, "v_edges"), "graph_id", "from_run_id", "to_run_id")


@pytest.mark.parametrize("name", ["a02_condense", "a03_topological", "a06_edge_drop_origins", "a15_a16_confidence"])
def test_one_shuffle(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_no_rows(spark):
    runs, edges = tables(spark, False)
    g = bundles.components(bundles.gathered(runs.where("false"), edges, FACTS))
    assert bundles.sccs(g).count() == bundles.topological(g).count() == graph.drop_origins(g).count() == 0
    g = bundles.components(bundles.gathered(runs, edges.where("false"), FACTS))
    assert bundles.links(g).count() == 0 and bundles.sccs(g).where(F.col("n") > 1).count() == 0


def test_shadow_of_rows(spark):
    runs, edges = tables(spark, False)
    g = stored(bundles.components(bundles.gathered(runs, edges, FACTS)))
    found = bundles.runs(g).where("graph_id is not null and run_id % 3 = 1").select("graph_id", F.col("scc"), F.col("scc").alias("run_id")).distinct()
    want = graph.shadow(found, bundles.links(g))
    assert 0 < want.count() < found.count() and rows(bundles.shadow(found, g), "graph_id", "scc", "run_id") == rows(want, "graph_id", "scc", "run_id")


@pytest.mark.parametrize("name", ["a09_cycle_origins", "a10_deterministic_origins"])
def test_graphs_that_matter(spark, monkeypatch, name):
    """Only graphs with a cycle, or with a failed run, are kept and joined."""
    kept = []
    monkeypatch.setattr(catalog, "stored", lambda df: kept.append(stored(df)) or kept[-1])
    catalog.QUERIES[name](spark, SF).count()
    n = spark.read.parquet(f"{SF}/orders.parquet").count()
    assert 0 < kept[0].count() < n / 3


@pytest.mark.parametrize("text", [False, True])
def test_topology_of_rows(spark, text):
    """Also links from and to unknown ends, from and to themselves, several times, and shapes that random links hardly give."""
    runs, edges = tables(spark, text)
    name = (lambda i: f"r{i}") if text else (lambda i: i)
    spec = [[(0, i) for i in range(1, 5)], [(0, 1), (0, 2), (1, 3), (2, 3)], [(i, j) for i in range(4) for j in range(4)], [(0, 1), (0, 2), (1, 3), (1, 4)], [(0, 1), (1, 2), (2, 3)], [(0, 1), (1, 2), (2, 1)], [(0, 1), (0, 1), (0, 0)], [(0, None), (0, 1), (None, 1), (1, 9), (9, 2)], []]
    kind, shapes = "string" if text else "long", list(enumerate(spec, 100))
    nodes = [(g, name(i), i, 1.0, False, False, None) for g, es in shapes for i in range(max([0, *(x for e in es for x in e if x is not None and x < 9)]) + 1)] + [(100, None, None, 1.0, False, False, None)]
    runs = stored(runs.union(spark.createDataFrame(nodes, f"graph_id long, run_id {kind}, end_time long, score double, input_flawed boolean, verifier boolean, unscored_reason string")))
    edges = stored(edges.union(spark.createDataFrame([(g, *(None if x is None else name(x) for x in e)) for g, es in shapes for e in es], f"graph_id long, from_run_id {kind}, to_run_id {kind}")))
    s = stored(graph.condense(runs, edges))
    want = graph.topology(runs, edges, s, graph.topological(s, graph.scc_edges(s, edges))).where("graph_id is not null")
    g = bundles.components(bundles.gathered(runs, edges, FACTS))
    got = graph.topologies(g).where("graph_id is not null")
    assert got.dtypes == want.dtypes and rows(got, *want.columns) == rows(want, *want.columns)
    assert {x.primary for x in want.select("primary").collect()} == {"disconnected", "single_node", "mesh", "pipeline_with_feedback", "cyclic_graph", "pipeline", "star", "hierarchy", "dag"}
    assert graph.topologies(g.where("false")).count() == 0


def test_topology_takes_one_shuffle(spark):
    plan = catalog.QUERIES["a05_topology"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
