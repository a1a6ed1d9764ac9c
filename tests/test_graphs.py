"""Graph operators on random graphs against brute force; independence of row order and partitioning."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import graph, reconstruct


def random_graphs(n=25, seed=1):
    r = random.Random(seed)
    runs, edges = [], []
    for g in range(n):
        k = r.randint(1, 7)
        ends = r.sample(range(100), k)
        for i in range(k):
            runs.append((g, i, ends[i], f"agent{i % 3}", None if r.random() < 0.15 else round(r.random(), 2), r.choice([None, 1.0, 2.5])))
        for _ in range(r.randint(0, 9)):
            a, b = r.randrange(k), r.randrange(k)
            if a != b or r.random() < 0.2:
                edges.append((g, a, b))
    return runs, sorted(set(edges))


RUNS = "graph_id long, run_id long, end_time long, agent_name string, score double, cost_usd double"
EDGES = "graph_id long, from_run_id long, to_run_id long"


@pytest.fixture(scope="module")
def data():
    return random_graphs()


@pytest.fixture(scope="module")
def frames(spark, data):
    return spark.createDataFrame(data[0], RUNS), spark.createDataFrame(data[1], EDGES)


def brute_reach(edges, g, gone=None):
    succ = {}
    for h, a, b in edges:
        if h == g and gone not in (a, b):
            succ.setdefault(a, set()).add(b)
    out = set()
    for s in succ:
        todo, seen = list(succ[s]), set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += succ.get(x, ())
        out |= {(s, x) for x in seen}
    return out


def test_reach_and_condense(data, frames):
    runs, edges = data
    paths = graph.reach(frames[1])
    got = {(x.graph_id, x.src, x.dst) for x in paths.collect()}
    assert got == {(g, a, b) for g in range(25) for a, b in brute_reach(edges, g)}
    sccs = {(x.graph_id, x.scc): x for x in graph.condense(*frames).collect()}
    end = {(g, i): e for g, i, e, *_ in runs}
    score = {(g, i): s for g, i, _, _, s, _ in runs}
    for (g, scc), x in sccs.items():
        same = [i for h, i, *_ in runs if h == g and (i == scc or ((g, i, scc) in got and (g, scc, i) in got))]
        assert x.scc == min(same) and x.members == sorted(same, key=lambda i: (end[g, i], i)) and x.exit_run == x.members[-1] and x.score == score[g, x.exit_run]
    assert sum(x.n for x in sccs.values()) == len(runs)


def test_long_chain_in_linear_time(spark):
    """A graph of 10,000 components in a row, and one of 10,000 runs on one cycle."""
    import time

    n = 10_000
    runs = spark.range(2 * n).selectExpr(f"cast(id div {n} as long) as graph_id", "id as run_id", "id as end_time", "cast(null as double) as score")
    edges = spark.range(2 * n - 1).selectExpr(f"cast(id div {n} as long) as graph_id", "id as from_run_id", "id + 1 as to_run_id").where(f"from_run_id <> {n - 1}")
    edges = edges.union(spark.sql(f"select 1L, {2 * n - 1}L, {n}L"))
    began = time.time()
    sccs = reconstruct.cut(graph.condense(runs, edges))
    order = graph.topological(sccs, graph.scc_edges(sccs, edges)).collect()
    assert time.time() - began < 40  # of which the walks take well under a second
    assert sorted((x.graph_id, x.scc, x.topo, x.depth) for x in order) == [(0, i, i + 1, i + 1) for i in range(n)] + [(1, n, 1, 1)]
    under = graph.shadow(sccs.where("scc % 2000 = 500").select("graph_id", "scc"), graph.scc_edges(sccs, edges)).collect()
    assert [(x.graph_id, x.scc) for x in under] == [(0, 500)]


def test_topological_order(frames):
    sccs = reconstruct.cut(graph.condense(*frames))
    links = graph.scc_edges(sccs, frames[1])
    order = {(x.graph_id, x.scc): (x.topo, x.depth) for x in graph.topological(sccs, links).collect()}
    nodes, preds = {}, {}
    for x in sccs.collect():
        nodes.setdefault(x.graph_id, {})[x.scc] = (x.end_time, x.exit_run)
    for x in links.collect():
        preds.setdefault((x.graph_id, x.dst), set()).add(x.src)
    for g, mine in nodes.items():
        done, depth = [], {}
        while len(done) < len(mine):
            free = [s for s in mine if s not in done and preds.get((g, s), set()) <= set(done)]
            best = min(free, key=lambda s: mine[s])
            depth[best] = 1 + max((depth[p] for p in preds.get((g, best), ())), default=0)
            done.append(best)
            assert order[g, best] == (len(done), depth[best])


def test_articulation_points(data, frames):
    runs, edges = data

    def parts(g, gone=None):
        ids = {i for h, i, *_ in runs if h == g and i != gone}
        both = {(h, a, b) for h, a, b in edges} | {(h, b, a) for h, a, b in edges}
        near = brute_reach(both, g, gone)
        return len({min([i] + [b for a, b in near if a == i]) for i in ids})

    want = set()
    for g in range(25):
        ids = [i for h, i, *_ in runs if h == g]
        for v in ids if len(ids) >= 3 else []:
            linked = any(h == g and a != b and v in (a, b) for h, a, b in edges)
            if parts(g, v) > parts(g) - (0 if linked else 1):
                want.add((g, v))
    assert {(x.graph_id, x.run_id) for x in graph.articulation_points(*frames).collect()} == want


def test_weak_shape_edges(spark):
    """A link through an unknown run connects but doesn't count; a long line needs no recursion; a graph without links stays."""
    n = 3000
    runs = spark.createDataFrame([(0, 1, 1, "a", 1.0, None), (0, 2, 2, "a", 1.0, None), (2, 5, 5, "a", 1.0, None)] + [(1, i, i, "a", 1.0, None) for i in range(n)], RUNS)
    edges = spark.createDataFrame([(0, 1, 9), (0, 9, 2), (0, 2, 8), (2, 5, 5)] + [(1, i, i + 1) for i in range(n - 1)], EDGES)
    got = {x.graph_id: x for x in graph.weak_shape(runs, edges).collect()}
    assert {g: x.components for g, x in got.items()} == {0: 1, 1: 1, 2: 1}
    assert {g: sorted(x.points) for g, x in got.items()} == {0: [], 1: list(range(1, n - 1)), 2: []}


def shapes(spark, spec):
    runs = [(g, i, i, "a", 1.0, None) for g, (n, _) in enumerate(spec) for i in range(n)]
    edges = [(g, a, b) for g, (_, es) in enumerate(spec) for a, b in es]
    r, e = spark.createDataFrame(runs, RUNS), spark.createDataFrame(edges, EDGES)
    s = reconstruct.cut(graph.condense(r, e))
    return {x.graph_id: x for x in graph.topology(r, e, s, graph.topological(s, graph.scc_edges(s, e))).collect()}


def test_topology(spark):
    spec = [(3, [(0, 1), (1, 2)]), (1, []), (2, []), (4, [(0, 1), (0, 2), (0, 3)]), (4, [(0, 1), (0, 2), (1, 3), (2, 3)]), (3, [(0, 1), (1, 2), (2, 1)]), (5, [(0, 1), (1, 2), (2, 1), (0, 3), (3, 4)]), (7, [(0, 1), (0, 2), (1, 3), (1, 4), (2, 5), (2, 6)]),
            (3, [(0, 1), (1, 0), (1, 2), (2, 1)]), (4, [(0, 1), (0, 2), (1, 3), (2, 3), (0, 3)])]
    want = ["pipeline", "single_node", "disconnected", "star", "star", "pipeline_with_feedback", "cyclic_graph", "hierarchy", "mesh", "dag"]
    got = shapes(spark, spec)
    assert [got[g].primary for g in range(len(spec))] == want
    assert got[0].chain and got[0].depth == 3 and got[0].articulation_points == 1 and not got[3].chain


def test_order_independence(spark, data):
    runs, edges = data
    facts = "graph_id long, run_id long, input_flawed boolean, verifier boolean, unscored_reason string"

    def run(seed, parts):
        r = random.Random(seed)
        a, b = r.sample(runs, len(runs)), r.sample(edges, len(edges))
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        rd, ed = spark.createDataFrame(a, RUNS), spark.createDataFrame(b, EDGES)
        s = reconstruct.cut(graph.condense(rd, ed))
        links = reconstruct.cut(graph.scc_edges(s, ed))
        f = spark.createDataFrame([(g, i, False, False, None) for g, i, *_ in runs], facts)
        o = graph.edge_drop_origins(s, links, f)
        out = sorted(map(tuple, o.select("graph_id", "scc", "kind", "drop").collect()), key=str)
        chains = sorted((x.graph_id, x.path) for x in graph.degradation_chains(s, links).collect())
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        return out, chains

    assert run(1, 3) == run(2, 7)


def test_unknown_is_never_an_origin(frames, data):
    sccs = reconstruct.cut(graph.condense(*frames))
    links = graph.scc_edges(sccs, frames[1])
    facts = frames[0].select("graph_id", "run_id", F.lit(False).alias("input_flawed"), F.lit(False).alias("verifier"), F.lit(None).cast("string").alias("unscored_reason"))
    assert graph.edge_drop_origins(sccs, links, facts).where("score is null").count() == 0
    cost = {x.graph_id: x for x in graph.downstream_cost(frames[0].where("run_id = 0"), frames[0], frames[1]).collect()}
    for g, x in cost.items():
        hit = {0} | {b for a, b in brute_reach(data[1], g) if a == 0}
        known = [c for h, i, *_, c in data[0] if h == g and i in hit and c is not None]
        assert (x.cost, x.priced, x.total) == (sum(known) if known else None, len(known), len(hit))


def by_graph(rows):
    out = {}
    for x in rows:
        out.setdefault(x[0], []).append(x)
    return out


def condensed(frames):
    """The components and their links, as frames and by graph: {scc: (score, end, exit run)} and {(src, dst)}."""
    sccs = reconstruct.cut(graph.condense(*frames))
    links = reconstruct.cut(graph.scc_edges(sccs, frames[1]))
    nodes, pairs = {}, {}
    for x in sccs.collect():
        nodes.setdefault(x.graph_id, {})[x.scc] = (x.score, x.end_time, x.exit_run)
    for x in links.collect():
        pairs.setdefault(x.graph_id, set()).add((x.src, x.dst))
    return sccs, links, nodes, pairs


@pytest.fixture(scope="module")
def many(spark):
    runs, edges = random_graphs(120, 7)
    return runs, edges, (spark.createDataFrame(runs, RUNS), spark.createDataFrame(edges, EDGES))


def test_propagation_path(many):
    """Every way from the start to the target is listed; the shortest counts, then the worst scores, unknown last."""
    sccs, links, nodes, pairs = condensed(many[2])
    starts = sccs.groupBy("graph_id").agg(F.min_by("scc", "end_time").alias("scc"))
    ends = sccs.groupBy("graph_id").agg(F.max_by("scc", "end_time").alias("scc"))
    got = {x.graph_id: (x.start, x.path) for x in graph.propagation_path(starts, sccs, links, ends).collect()}
    longer = 0
    for g, mine in nodes.items():
        start, end = min(mine, key=lambda s: mine[s][1]), max(mine, key=lambda s: mine[s][1])
        ways, todo = [], [[start]]
        while todo:
            way = todo.pop()
            if way[-1] == end:
                ways.append(way)
            todo += [[*way, b] for a, b in pairs.get(g, ()) if a == way[-1]]
        key = lambda s: (mine[s][0] is None, mine[s][0] or 0, mine[s][1], mine[s][2])  # noqa: B023, E731
        want = min(ways, key=lambda w: (len(w), [key(s) for s in w[1:]])) if ways else [start]
        assert got[g] == (start, want)
        longer += len(want) > 2
    assert longer


def test_manifestation(many):
    sccs, links, nodes, pairs = condensed(many[2])
    checks = {(g, r) for g, r, *_ in many[0] if (g + 2 * r) % 3}
    got = by_graph(graph.manifestation(sccs, links, many[2][0].where("(graph_id + 2 * run_id) % 3 <> 0")).collect())
    moved = 0
    for g, mine in nodes.items():
        preds = lambda level: {a for a, b in pairs.get(g, ()) if b in level}  # noqa: B023, E731
        want = set()
        for sink in set(mine) - {a for a, _ in pairs.get(g, ())}:
            run, level, seen = mine[sink][2], {sink}, {sink}
            if (g, run) in checks:
                while level := preds(level) - seen:
                    seen |= level
                    makers = [(mine[s][1], mine[s][2]) for s in level if (g, mine[s][2]) not in checks]
                    if makers:
                        run = max(makers)[1]
                        moved += 1
                        break
            want.add(run)
        assert {x.run_id for x in got[g]} == want
    assert moved


def test_deliverable(many):
    runs, edges, frames = many
    facts = frames[0].select("graph_id", "run_id", "end_time", F.expr("run_id % 3 <> 1").alias("has_output"), F.expr("(graph_id + run_id) % 3 <> 0").alias("verifier"))
    got = {x.graph_id: x.run_id for x in reconstruct.deliverable(facts, frames[1]).collect()}
    walked = closed = 0
    for g in {x[0] for x in runs}:
        end = {r: e for h, r, e, *_ in runs if h == g}
        mine = [(a, b) for h, a, b in edges if h == g]
        made, checks = (lambda r: r % 3 != 1), (lambda r: (g + r) % 3 != 0)  # noqa: B023
        last = lambda rs: max(rs, key=lambda r: (end[r], r))  # noqa: B023, E731
        tips = [r for r in end if r not in {a for a, _ in mine}]
        closed += not tips
        at, seen = last(tips or [r for r in end if made(r) and r in {b for _, b in mine}] or list(end)), set()
        while checks(at) and at not in seen:
            seen.add(at)
            before = [a for a, b in mine if b == at]
            makers, others = [r for r in before if made(r) and not checks(r)], [r for r in before if r not in seen]
            if not makers and not others:
                break
            walked += 1
            at = last(makers or others)
            if makers:
                break
        assert got[g] == at
    assert walked and closed and len(got) == len({x[0] for x in runs})


def test_chain_origins(spark):
    """Four steps down from a healthy start, beside the same graph with a flawed input and one that has another origin."""
    scores = [0.9, 0.75, 0.6, 0.45, 0.3]
    runs = spark.createDataFrame([(g, i, i, "a", x, None) for g in range(3) for i, x in enumerate(scores)], RUNS)
    edges = spark.createDataFrame([(g, i, i + 1) for g in range(3) for i in range(4)], EDGES)
    sccs, links, *_ = condensed((runs, edges))
    chains = graph.degradation_chains(sccs, links)
    assert {(x.graph_id, x.head, tuple(x.path), round(x.drop, 6)) for x in chains.collect()} == {(g, 0, (0, 1, 2, 3, 4), 0.6) for g in range(3)}
    facts = runs.select("graph_id", "run_id", F.expr("graph_id = 1 and run_id = 1").alias("input_flawed"))
    got = graph.chain_origins(chains, sccs, sccs.where("graph_id = 2 and scc = 3"), facts).collect()
    assert [(x.graph_id, x.run_id, x.score, round(x.drop, 6)) for x in got] == [(0, 1, 0.75, 0.6)]
