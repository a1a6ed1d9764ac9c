"""Graph analytics over all graphs at once, keyed by graph_id. No graph object is ever built; a graph may hold a cycle.

runs: graph_id, run_id, end_time, agent_name, score (null: unknown), cost_usd …; edges: graph_id, from_run_id, to_run_id.
Ties break on (end_time, run_id), so results don't depend on row order or partitioning. Loops run over iterations only
(logarithmic for closures), each ended by a reliable checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import clamp
from ..functions.lineage import cut, stored
from . import bundles, walks


@dataclass(frozen=True)
class Config:
    """Thresholds and penalties."""

    threshold: float = 0.5
    gap: float = 0.25
    min_drop: float = 0.10
    chain_drop: float = 0.30
    chain_edges: int = 2
    chain_step: float = 0.05
    max_rounds: int = 10
    loop_z: float = 3.0
    loop_history: int = 5
    unknown_cap: float = 0.6
    cycle_penalty: float = 0.8
    multi_penalty: float = 0.8
    single_channel_penalty: float = 0.75
    line_penalty: float = 0.8
    line_full_depth: int = 18


CONFIG = Config()


def closure(pairs: DataFrame, key: list[str]) -> DataFrame:
    """key…, src, dst: all pairs joined by a path of one step or more. Each round doubles the length of the paths, so there are
    as many rounds as the logarithm of the longest shortest path. Only the pairs that the round before found are carried on: a pair
    twice as far begins with one of these. Circles end it, as pairs found before aren't found again."""
    fresh = every = stored(pairs.select(*key, "src", "dst").distinct())
    while True:
        far = every.select(*key, F.col("src").alias("dst"), F.col("dst").alias("far"))
        longer = fresh.join(far, [*key, "dst"]).select(*key, "src", F.col("far").alias("dst")).distinct()
        fresh = stored(longer.join(every, [*key, "src", "dst"], "left_anti"))
        if fresh.isEmpty():
            return every
        every = every.union(fresh)


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.select("graph_id", F.col("from_run_id").alias("src"), F.col("to_run_id").alias("dst"))


def reach(edges: DataFrame) -> DataFrame:
    """(graph_id, src, dst): dst is downstream of src (of itself only within a cycle)."""
    return closure(_pairs(edges), ["graph_id"])


def condense(runs: DataFrame, edges: DataFrame) -> DataFrame:
    """One row a strongly connected component: graph_id, scc (least member), members (by time), exit_run, score (the exit's),
    min_score, n, self_loop, end_time. One linear walk a graph finds the cycles. A cycle has a link that goes down in the order of ids, so
    graphs without one aren't walked."""
    kind = edges.schema["from_run_id"].dataType
    links = _pairs(edges).where("src <> dst")
    cycles = walks.linked(links.join(links.where("src > dst").select("graph_id").distinct(), "graph_id", "left_semi"), ["graph_id"])
    own = walks.each_graph(cycles, walks.strong_parts, [T.StructField("run_id", kind), T.StructField("scc", kind)])
    of = runs.join(own, ["graph_id", "run_id"], "left").withColumn("scc", F.coalesce("scc", "run_id"))
    loops = edges.where("from_run_id = to_run_id").select("graph_id", F.col("from_run_id").alias("run_id"), F.lit(True).alias("_loop")).distinct()
    order = F.struct("end_time", "run_id")
    return of.join(loops, ["graph_id", "run_id"], "left").groupBy("graph_id", "scc").agg(
        F.transform(F.sort_array(F.collect_list(order)), lambda x: x["run_id"]).alias("members"), F.max_by("run_id", order).alias("exit_run"), F.max_by("score", order).alias("score"),
        F.min("score").alias("min_score"), F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_or("_loop"), F.lit(False)).alias("self_loop"), F.max("end_time").alias("end_time"))


def membership(sccs: DataFrame) -> DataFrame:
    return sccs.select("graph_id", F.explode("members").alias("run_id"), "scc")


def scc_edges(sccs: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, src, dst): distinct edges between components."""
    of = membership(sccs)
    out = edges.join(of.select("graph_id", F.col("run_id").alias("from_run_id"), F.col("scc").alias("src")), ["graph_id", "from_run_id"])
    out = out.join(of.select("graph_id", F.col("run_id").alias("to_run_id"), F.col("scc").alias("dst")), ["graph_id", "to_run_id"])
    return out.where("src <> dst").select("graph_id", "src", "dst").distinct()


def topological(sccs: DataFrame, links: DataFrame) -> DataFrame:
    """(graph_id, scc, topo, depth): Kahn's order with ties by (end_time, exit run), and the longest path to each, in nodes. One walk a graph
    with a heap of what is free."""
    node = F.sort_array(F.collect_list(F.struct("scc", "end_time", "exit_run"))).alias("_n")
    each = sccs.groupBy("graph_id").agg(node).join(walks.linked(links, ["graph_id"]), "graph_id", "left")
    each = each.select("graph_id", *(F.col(f"_n.{c}").alias(c) for c in ("scc", "end_time", "exit_run")), "src", "dst")
    return walks.each_graph(each, walks.kahn, [sccs.schema["scc"], T.StructField("topo", T.IntegerType()), T.StructField("depth", T.IntegerType())])


def loop_anomalies(sccs: DataFrame, runs: DataFrame, baselines: DataFrame | None = None, cfg: Config = CONFIG) -> DataFrame:
    """(graph_id, scc, rounds, limit_kind): cycles with too many rounds, by the limit or against the agent's past rounds.

    Rounds are the largest group of attempts of one agent in the cycle (runs.attempt_of), else the number of members; at least 2
    for a run that repeats itself. baselines: agent_name, mean, std, n of past rounds.
    """
    inside = membership(sccs.where("n > 1 or self_loop")).join(runs.select("graph_id", "run_id", "attempt_of", "agent_name"), ["graph_id", "run_id"])
    groups = inside.where("attempt_of is not null").groupBy("graph_id", "scc", "attempt_of").agg(F.count(F.lit(1)).alias("k"))
    busiest = groups.groupBy("graph_id", "scc").agg(F.max_by("attempt_of", F.struct("k", "attempt_of")).alias("agent"), F.max("k").alias("k"))
    names = inside.groupBy("graph_id", "scc", "agent_name").agg(F.count(F.lit(1)).alias("m")).groupBy("graph_id", "scc").agg(F.min_by("agent_name", F.struct(-F.col("m"), "agent_name")).alias("name"))
    cycles = sccs.where("n > 1 or self_loop").join(busiest, ["graph_id", "scc"], "left").join(names, ["graph_id", "scc"], "left")
    rounds = F.when(F.col("self_loop"), F.greatest(F.lit(2), F.coalesce("k", "n"))).otherwise(F.coalesce("k", "n"))
    cycles = cycles.select("graph_id", "scc", F.coalesce("agent", "name").alias("agent_name"), rounds.alias("rounds"))
    if baselines is None:
        return cycles.where(F.col("rounds") > cfg.max_rounds).select("graph_id", "scc", "rounds", F.lit("max_iterations").alias("limit_kind"))
    cycles = cycles.join(baselines.select("agent_name", "mean", "std", "n"), "agent_name", "left")
    kind = F.when(F.col("rounds") > cfg.max_rounds, "max_iterations").when((F.col("n") >= cfg.loop_history) & (F.col("rounds") > F.col("mean") + cfg.loop_z * F.col("std")), "statistical")
    return cycles.withColumn("limit_kind", kind).where("limit_kind is not null").select("graph_id", "scc", "rounds", "limit_kind")


def weak_shape(runs: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, components, points): the number of weakly connected components, and the runs whose removal splits one.

    A graph's links are one row, as in ``topological``; the walk over it is linear. Runs without an id are left out.
    """
    nodes = runs.groupBy("graph_id").agg(F.collect_set("run_id").alias("nodes"))
    links = _pairs(edges).where("src <> dst").groupBy("graph_id").agg(F.collect_set(F.struct("src", "dst")).alias("links"))
    each = nodes.join(links, "graph_id", "left").select("graph_id", "nodes", F.col("links.src").alias("src"), F.col("links.dst").alias("dst"))
    out = T.StructType([each.schema["graph_id"], T.StructField("components", T.LongType()), T.StructField("points", each.schema["nodes"].dataType)])

    def walk(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = zip(*(part.column(c).to_pylist() for c in ("nodes", "src", "dst")), strict=True)
            found = [walks.pieces(nodes, list(zip(src or [], dst or [], strict=True))) for nodes, src, dst in rows]
            counts, points = pa.array([n for n, _ in found], pa.int64()), pa.array([p for _, p in found], part.column("nodes").type)
            yield pa.RecordBatch.from_arrays([part.column("graph_id"), counts, points], names=out.names)

    return each.mapInArrow(walk, out)


def articulation_points(runs: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, run_id) whose removal splits its component."""
    return weak_shape(runs, edges).select("graph_id", F.explode("points").alias("run_id"))


def topology(runs: DataFrame, edges: DataFrame, sccs: DataFrame, order: DataFrame) -> DataFrame:
    """One row a graph: counts, components, fan-out, depth, cycles, two-way pairs, articulation points, the shape, and whether it is a line."""
    links = _pairs(edges).distinct()
    nodes = runs.select("graph_id", F.col("run_id").alias("id")).distinct()
    g = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    out_degree = links.groupBy("graph_id", F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out"))
    in_degree = links.groupBy("graph_id", F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in"))
    degrees = nodes.join(out_degree, ["graph_id", "id"], "left").join(in_degree, ["graph_id", "id"], "left").na.fill(0, ["out", "in"])
    shape = degrees.groupBy("graph_id").agg(F.sum("out").alias("e"), F.max("out").alias("fan"), F.max("in").alias("fan_in"), F.count_if(F.col("in") == 0).alias("roots"),
                                           F.min(F.when(F.col("in") == 0, F.col("id"))).alias("root"), F.max(F.when(F.col("in") > 0, F.col("in"))).alias("in_rest"), F.count_if((F.col("out") == 0) & (F.col("in") > 0)).alias("leaves"))
    pairs = links.join(links.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst")), ["graph_id", "src", "dst"]).where("src < dst").groupBy("graph_id").agg(F.count(F.lit(1)).alias("two_way"))
    of = membership(sccs)
    within = links.where("src <> dst").join(of.select("graph_id", F.col("run_id").alias("src"), F.col("scc").alias("a")), ["graph_id", "src"]).join(of.select("graph_id", F.col("run_id").alias("dst"), F.col("scc").alias("b")), ["graph_id", "dst"])
    dense = within.where("a = b").groupBy("graph_id", F.col("a").alias("scc")).agg(F.count(F.lit(1)).alias("k")).join(sccs.select("graph_id", "scc", "n"), ["graph_id", "scc"])
    dense = dense.groupBy("graph_id").agg(F.bool_or((F.col("n") >= 4) & (F.col("k") / (F.col("n") * (F.col("n") - 1)) >= 0.5)).alias("dense"))
    cyc = sccs.groupBy("graph_id").agg(F.count_if(F.col("n") >= 2).alias("cycles"), F.count(F.lit(1)).alias("supers"), F.bool_or("self_loop").alias("loops"))
    cl = scc_edges(sccs, edges)
    cdeg = cl.groupBy("graph_id", F.col("src").alias("scc")).agg(F.count(F.lit(1)).alias("o")).groupBy("graph_id").agg(F.max("o").alias("c_out"), F.sum("o").alias("c_e"))
    cind = cl.groupBy("graph_id", F.col("dst").alias("scc")).agg(F.count(F.lit(1)).alias("i")).groupBy("graph_id").agg(F.max("i").alias("c_in"))
    depth = order.groupBy("graph_id").agg(F.max("depth").alias("depth"))
    spokes = links.join(shape.select("graph_id", "root"), "graph_id").where("src = root").select("graph_id", F.col("dst").alias("id")).distinct()
    n_spokes = spokes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("spokes"))
    to_one = links.join(spokes.select("graph_id", F.col("id").alias("src")), ["graph_id", "src"]).groupBy("graph_id").agg(F.count_distinct("src").alias("feeding"), F.count_distinct("dst").alias("fed"), F.count(F.lit(1)).alias("feeds"))
    comp = weak_shape(runs, edges).select("graph_id", "components", F.size("points").cast("long").alias("articulation_points"))
    t = g
    for part in (shape, pairs, dense, cyc, cdeg, cind, depth, n_spokes, to_one, comp):
        t = t.join(part, "graph_id", "left")
    return _classified(t.na.fill(0, ["two_way", "c_out", "c_e", "c_in", "spokes", "feeding", "fed", "feeds"]).na.fill(False, ["dense"]))


def topologies(graphs: DataFrame) -> DataFrame:
    """``topology`` of graphs as rows (see ``bundles``), without a shuffle."""
    return _classified(bundles.counts(graphs))


def _classified(t: DataFrame) -> DataFrame:
    """The shape of each graph by what was counted of it."""
    c_line = ((F.col("supers") == 1) & (F.col("c_e") == 0)) | ((F.col("supers") > 1) & (F.col("c_e") == F.col("supers") - 1) & (F.col("components") == 1) & (F.col("c_in") <= 1) & (F.col("c_out") <= 1))
    line = ((F.col("n") == 1) & (F.col("e") == 0)) | ((F.col("n") > 1) & (F.col("e") == F.col("n") - 1) & (F.col("components") == 1) & (F.col("fan") <= 1) & (F.col("fan_in") <= 1))
    pure = (F.col("spokes") == F.col("n") - 1) & (F.col("e") == F.col("n") - 1)
    gathered = (F.col("spokes") == F.col("n") - 2) & (F.col("spokes") > 0) & (F.col("feeding") == F.col("spokes")) & (F.col("fed") == 1) & (F.col("e") == 2 * F.col("spokes"))
    star = (F.col("roots") == 1) & (F.col("n") > 1) & (pure | gathered)
    tree = (F.col("roots") == 1) & (F.coalesce(F.col("in_rest"), F.lit(1)) == 1)
    acyclic = (F.col("cycles") == 0) & ~F.col("loops")
    primary = (F.when(F.col("components") > 1, "disconnected").when(F.col("n") == 1, "single_node").when((F.col("cycles") > 0) & ((F.col("two_way") >= 2) | F.col("dense")), "mesh")
               .when((F.col("cycles") > 0) & c_line, "pipeline_with_feedback").when(F.col("cycles") > 0, "cyclic_graph").when(acyclic & line, "pipeline").when(acyclic & star, "star")
               .when(acyclic & tree & (F.col("depth") >= 3), "hierarchy").otherwise("dag"))
    return t.select("graph_id", F.col("n").alias("node_count"), F.col("e").alias("edge_count"), "components", F.col("fan").alias("max_fan_out"), "depth", F.col("cycles").alias("scc_count"), F.col("two_way").alias("bidirectional_pairs"),
                   primary.alias("primary"), ((F.col("depth") >= 3) & primary.isin("pipeline", "pipeline_with_feedback")).alias("chain"), "articulation_points")


def unknown_upstream(sccs: DataFrame, facts: DataFrame, links: DataFrame) -> DataFrame:
    """(graph_id, scc) with an ancestor whose score is unknown and could hide an origin: sources without payload and runs with an
    empty result set can't. facts: graph_id, run_id, unscored_reason."""
    sources = sccs.join(links.select("graph_id", F.col("dst").alias("scc")).distinct(), ["graph_id", "scc"], "left_anti").select("graph_id", "scc", F.lit(True).alias("source"))
    blind = sccs.where("score is null").join(facts.select("graph_id", F.col("run_id").alias("exit_run"), "unscored_reason"), ["graph_id", "exit_run"], "left").join(sources, ["graph_id", "scc"], "left")
    blind = blind.where("not (coalesce(source, false) and unscored_reason <=> 'payload_missing') and not (unscored_reason <=> 'zero_result_set')")
    return walks.below(links, blind.select("graph_id", F.col("scc").alias("src")), ["graph_id"]).withColumnRenamed("dst", "scc")


def edge_drop_origins(sccs: DataFrame, links: DataFrame, facts: DataFrame, cfg: Config = CONFIG) -> DataFrame:
    """Scored components by how quality stood around them: graph_id, scc, run_id, score, base, drop, base_assumed, recovered and
    kind: drop (broke here after healthy inputs), propagating or recovered (degraded with no measured input), or null.

    facts: graph_id, run_id, input_flawed, verifier, unscored_reason. A flawed input excludes a run unless all measured
    inputs were healthy and it is no verifier. One aggregation over incoming and one over outgoing links.
    """
    score = sccs.select("graph_id", "scc", "score", "exit_run")
    src, dst = (score.select("graph_id", F.col("scc").alias(c), F.col("score").alias(f"{c}_score"), F.col("exit_run").alias(f"{c}_run")) for c in ("src", "dst"))
    reasons = facts.select("graph_id", F.col("run_id").alias("src_run"), "unscored_reason")
    rooted = links.groupBy("graph_id", F.col("dst").alias("src")).agg(F.lit(1).alias("has_pred")).select("graph_id", "src", "has_pred")
    into = links.join(src, ["graph_id", "src"]).join(reasons, ["graph_id", "src_run"], "left").join(rooted, ["graph_id", "src"], "left")
    bare = F.col("has_pred").isNull() & F.col("unscored_reason").eqNullSafe("payload_missing")
    into = into.groupBy("graph_id", F.col("dst").alias("scc")).agg(F.max("src_score").alias("best"), F.min("src_score").alias("worst"), F.bool_and(bare).alias("only_bare"))
    out = links.join(dst, ["graph_id", "dst"]).groupBy("graph_id", F.col("src").alias("scc")).agg(F.bool_and(F.coalesce(F.col("dst_score") >= cfg.threshold, F.lit(False))).alias("cured"))
    own = facts.select("graph_id", F.col("run_id").alias("exit_run"), "input_flawed", "verifier")
    return _judged(sccs.where("score is not null").join(into, ["graph_id", "scc"], "left").join(out, ["graph_id", "scc"], "left").join(own, ["graph_id", "exit_run"], "left"), cfg)


def drop_origins(graphs: DataFrame, cfg: Config = CONFIG) -> DataFrame:
    """``edge_drop_origins`` of graphs as rows (see ``bundles``), without a shuffle."""
    return _judged(bundles.around(graphs, cfg.threshold), cfg)


def _judged(s: DataFrame, cfg: Config) -> DataFrame:
    """Kinds of scored components, from best and worst input, only_bare, cured, input_flawed and verifier."""
    observed = F.col("best").isNotNull()
    source_like = F.coalesce("only_bare", F.lit(True))
    base = F.when(observed, F.col("best")).when(source_like, F.lit(1.0))
    drop = F.greatest(F.lit(0.0), base - F.col("score"))
    healthy = F.coalesce(F.col("worst") >= cfg.threshold, F.lit(False))
    broke = F.coalesce(healthy & (drop >= cfg.gap) & (drop >= cfg.min_drop), F.lit(False))
    degraded = F.col("score") < cfg.threshold
    recovered = F.coalesce("cured", F.lit(False))
    flawed = F.coalesce("input_flawed", F.lit(False)) & ~(healthy & ~F.coalesce("verifier", F.lit(False)))
    kind = F.when(broke, "drop").when(~observed & degraded & ~recovered, "propagating").when(~observed & degraded, "recovered")
    return s.where(~flawed).select("graph_id", "scc", F.col("exit_run").alias("run_id"), "score", base.alias("base"), drop.alias("drop"), (~observed & source_like).alias("base_assumed"),
                                   recovered.alias("recovered"), F.col("n").alias("iterations"), "end_time", kind.alias("kind"))


def degradation_chains(sccs: DataFrame, links: DataFrame, cfg: Config = CONFIG) -> DataFrame:
    """(graph_id, head, path, drop): from a healthy component on to its worst successor while the score falls by a step at least.

    The next component is a function of the present one, so one walk a graph tells the end of every chain. A chain that lies on
    the path of another recorded chain isn't recorded again: a head on another path is a suffix of it.
    """
    at = sccs.where("score is not null").groupBy("graph_id").agg(F.collect_list(F.struct("scc", F.col("score").cast("double").alias("score"), "end_time", "exit_run")).alias("_n"))
    at = at.where(F.exists("_n", lambda x: x["score"] >= cfg.threshold) & (F.size("_n") > cfg.chain_edges))
    each = at.join(walks.linked(links, ["graph_id"]), "graph_id").select("graph_id", *(F.col(f"_n.{c}").alias(c) for c in ("scc", "score", "end_time", "exit_run")), "src", "dst")
    kind = sccs.schema["scc"].dataType

    def walk(*graph: list) -> list[tuple]:
        return walks.falls(*graph, cfg.threshold, cfg.chain_step, cfg.chain_edges, cfg.chain_drop)

    return walks.each_graph(each, walk, [T.StructField("head", kind), T.StructField("path", T.ArrayType(kind)), T.StructField("drop", T.DoubleType())])


def chain_origins(chains: DataFrame, sccs: DataFrame, origins: DataFrame, facts: DataFrame) -> DataFrame:
    """In graphs without another origin, the first run of each chain that eroded, with the chain's whole drop; a run whose input was
    flawed already is none. facts: graph_id, run_id, input_flawed."""
    left = chains.join(origins.select("graph_id").distinct(), "graph_id", "left_anti").select("graph_id", F.element_at("path", 2).alias("scc"), "drop")
    found = left.join(sccs.select("graph_id", "scc", F.col("exit_run").alias("run_id"), "score"), ["graph_id", "scc"])
    return found.join(facts.where("input_flawed").select("graph_id", "run_id"), ["graph_id", "run_id"], "left_anti")


def cycle_origins(sccs: DataFrame, runs: DataFrame, edges: DataFrame, origins: DataFrame, cfg: Config = CONFIG) -> DataFrame:
    """Inside cycles that are no origin as a whole: members that fell from healthy predecessors; of each cycle the worst, with its ties."""
    inside = sccs.where("n > 1").join(origins.select("graph_id", "scc"), ["graph_id", "scc"], "left_anti").select("graph_id", "scc", "members")
    inside = inside.select("graph_id", "scc", F.explode("members").alias("run_id")).join(runs.select("graph_id", "run_id", "score", "end_time"), ["graph_id", "run_id"])
    pred = edges.where("from_run_id <> to_run_id").join(runs.select("graph_id", F.col("run_id").alias("from_run_id"), F.col("score").alias("s")), ["graph_id", "from_run_id"])
    pred = pred.groupBy("graph_id", F.col("to_run_id").alias("run_id")).agg(F.max("s").alias("base"), F.min("s").alias("worst"))
    fell = inside.join(pred, ["graph_id", "run_id"]).where((F.col("worst") >= cfg.threshold) & (F.col("base") - F.col("score") >= F.lit(max(cfg.gap, cfg.min_drop))))
    low = fell.groupBy("graph_id", "scc").agg(F.min("score").alias("score"))
    return fell.join(low, ["graph_id", "scc", "score"]).groupBy("graph_id", "scc", "score").agg(
        F.min_by("run_id", F.struct("end_time", "run_id")).alias("run_id"), F.max(F.col("base") - F.col("score")).alias("drop"), F.sort_array(F.collect_list("run_id")).alias("tied"))


def drill(candidates: DataFrame, sccs: DataFrame, runs: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, scc, run_id, real_drop, tied): who inside a cycle is to blame for a candidate.

    candidates: graph_id, scc, run_id (the exit), member (of the cycle, if one qualified; else null). The qualified member if it has a score;
    else the member with the lowest score, the first by time among equals, who are all named in ``tied``. real_drop: from the best
    score among its predecessors in the graph, 0 at least, null if none is scored. A candidate that is no cycle, or whose members have no
    score, stays as it is.
    """
    order = F.struct("end_time", "run_id")
    scored = runs.where("score is not null").select("graph_id", "run_id", "score", "end_time")
    inside = candidates.select("graph_id", "scc", "member").join(sccs.where("n > 1").select("graph_id", "scc", F.explode("members").alias("run_id")), ["graph_id", "scc"])
    picked = inside.join(scored, ["graph_id", "run_id"]).groupBy("graph_id", "scc").agg(
        F.min_by(F.struct("run_id", "score"), F.struct((~F.coalesce(F.col("run_id") == F.col("member"), F.lit(False))).alias("other"), "score", "end_time", "run_id")).alias("p"),
        F.bool_or(F.coalesce(F.col("run_id") == F.col("member"), F.lit(False))).alias("qualified"), F.min("score").alias("worst"), F.collect_list(F.struct("score", order.alias("o"))).alias("all"))
    equal = F.transform(F.sort_array(F.transform(F.filter("all", lambda x: x["score"] == F.col("worst")), lambda x: x["o"])), lambda o: o["run_id"])
    picked = picked.withColumn("tied", F.when(~F.col("qualified") & (F.size(equal) > 1), equal))
    above = edges.select("graph_id", F.col("to_run_id").alias("at"), F.col("from_run_id").alias("run_id")).join(scored, ["graph_id", "run_id"]).groupBy("graph_id", "at").agg(F.max("score").alias("best"))
    picked = picked.select("graph_id", "scc", F.col("p.run_id").alias("at"), F.col("p.score").alias("own"), "tied").join(above, ["graph_id", "at"], "left")
    out = candidates.select("graph_id", "scc", "run_id").join(picked, ["graph_id", "scc"], "left")
    drop = F.when(F.col("best").isNotNull(), F.greatest(F.lit(0.0), F.col("best") - F.col("own")))
    return out.select("graph_id", "scc", F.coalesce("at", "run_id").alias("run_id"), drop.alias("real_drop"), "tied")


def shadow(candidates: DataFrame, links: DataFrame) -> DataFrame:
    """Candidates (graph_id, scc, …) without another candidate among their ancestors; ``links`` between components have no cycle."""
    under = walks.below(links, candidates.select("graph_id", F.col("scc").alias("src")), ["graph_id"])
    return candidates.join(under.withColumnRenamed("dst", "scc"), ["graph_id", "scc"], "left_anti")


def deterministic_origins(breaches: DataFrame, sccs: DataFrame, written: DataFrame, links: DataFrame, order: DataFrame) -> DataFrame:
    """Origins by hard evidence. breaches: graph_id, scc, key, value (that its run wrote); written: the same of all runs.

    A breach whose value an ancestor had written already is secondary. Where all of a graph's are, the earliest stays, with its
    upstream unknown.
    """
    what = ["graph_id", "key", "value"]
    wanted = breaches.select(*what).distinct()
    seeds = written.join(wanted, what, "left_semi").select(*what, F.col("scc").alias("src"))
    above = walks.below(links.join(wanted, "graph_id").select(*what, "src", "dst"), seeds, what).withColumnRenamed("dst", "scc")
    first = breaches.join(above, ["graph_id", "scc", "key", "value"], "left_anti").select("graph_id", "scc").distinct()
    rest = breaches.join(first.select("graph_id").distinct(), "graph_id", "left_anti").join(order.select("graph_id", "scc", "topo"), ["graph_id", "scc"])
    rest = rest.groupBy("graph_id").agg(F.min_by("scc", "topo").alias("scc"))
    both = first.withColumn("unknown_upstream", F.lit(False)).unionByName(rest.withColumn("unknown_upstream", F.lit(True)))
    return both.join(sccs.select("graph_id", "scc", F.col("exit_run").alias("run_id"), "score"), ["graph_id", "scc"])


def merge_channels(content: DataFrame, deterministic: DataFrame) -> DataFrame:
    """(graph_id, run_id, via): content, deterministic, or both."""
    c = content.select("graph_id", "run_id", F.lit(True).alias("c")).distinct()
    d = deterministic.select("graph_id", "run_id", F.lit(True).alias("d")).distinct()
    via = F.when(F.col("c") & F.col("d"), "both").when(F.col("c"), "content").otherwise("deterministic")
    return c.join(d, ["graph_id", "run_id"], "full").select("graph_id", "run_id", via.alias("via"))


def attribution(score: Column, base: Column, drop: Column, iterations: Column, cfg: Config = CONFIG, single_channel: Column | None = None, line_depth: Column | None = None,
                ties: Column | None = None, multi: Column | None = None, unknown: Column | None = None) -> Column:
    """How sure it is that the fault began here: drop, severity and input quality, then discounts and a cap for unknown upstream."""
    gap = clamp(F.coalesce(drop, F.lit(0.0)) / 0.5)
    severity = F.coalesce(clamp((cfg.threshold - score) / cfg.threshold), F.lit(0.0))
    before = F.coalesce(clamp((base - cfg.threshold) / (1 - cfg.threshold)), F.lit(0.0))
    raw = 0.5 * gap + 0.3 * severity + 0.2 * before
    raw = raw * F.when(iterations > 1, cfg.cycle_penalty).otherwise(1.0)
    if single_channel is not None:
        raw = raw * F.when(single_channel, cfg.single_channel_penalty).otherwise(1.0)
    if line_depth is not None:
        ramp = F.least(F.lit(1.0), F.sqrt(F.greatest(F.lit(0), line_depth - 2) / (cfg.line_full_depth - 2)))
        raw = raw * (1 - (1 - cfg.line_penalty) * ramp)
    if ties is not None:
        raw = raw / F.greatest(F.lit(1), ties)
    if multi is not None:
        raw = raw * F.when(multi, cfg.multi_penalty).otherwise(1.0)
    if unknown is not None:
        raw = F.when(unknown, F.least(raw, F.lit(cfg.unknown_cap))).otherwise(raw)
    return clamp(raw)


def observation(score: Column, drop: Column, base_assumed: Column, deterministic: Column, cfg: Config = CONFIG) -> Column:
    """How sure it is that the output is defective: 0.95 by hard evidence, else the stronger of severity and measured drop."""
    severity = F.coalesce(clamp((cfg.threshold - score) / cfg.threshold), F.lit(0.0))
    fell = F.when(base_assumed, F.lit(0.0)).otherwise(F.coalesce(clamp(drop / 0.5) * 0.7, F.lit(0.0)))
    return F.when(deterministic, F.lit(0.95)).otherwise(clamp(F.greatest(severity, fell)))


# Ceilings of confidence by report type.
TYPE_CAPS = {"composition_failure": 0.4, "root_cause_external": 0.5, "multi_culprit": 0.8, "verification_gap": 0.6, "terminal_defect_unlocalized": 0.6}


def capped(confidence: Column, report_type: Column, single_channel: Column, deterministic: Column, base_assumed: Column) -> Column:
    caps = F.create_map(*(x for k, v in TYPE_CAPS.items() for x in (F.lit(k), F.lit(v))))
    most = F.least(F.coalesce(F.element_at(caps, report_type), F.lit(1.0)), F.when((report_type == "cut_point") & single_channel, 0.7).otherwise(1.0),
                   F.when(deterministic, 0.95).when(base_assumed, 0.6).otherwise(1.0))
    return F.least(confidence, most)


def propagation_path(culprits: DataFrame, sccs: DataFrame, links: DataFrame, targets: DataFrame) -> DataFrame:
    """(graph_id, start, path): the shortest way from each culprit's component to its graph's target; among equals the one through the
    worst scores, unknown last, then by time. One walk a graph with a culprit, linear but for the paths themselves."""
    starts = culprits.groupBy("graph_id").agg(F.collect_set("scc").alias("starts"))
    ends = targets.groupBy("graph_id").agg(F.collect_set("scc").alias("ends"))
    nodes = sccs.groupBy("graph_id").agg(F.collect_list(F.struct("scc", "score", "end_time", "exit_run")).alias("_n"))
    each = starts.join(ends, "graph_id", "left").join(walks.linked(links, ["graph_id"]), "graph_id", "left").join(nodes, "graph_id", "left")
    each = each.select("graph_id", "starts", "ends", *(F.col(f"_n.{c}").alias(c) for c in ("scc", "score", "end_time", "exit_run")), "src", "dst")
    kind = sccs.schema["scc"].dataType
    return walks.each_graph(each, walks.shortest, [T.StructField("start", kind), T.StructField("path", T.ArrayType(kind))])


def downstream_cost(culprits: DataFrame, runs: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, cost, priced, total) over culprits and all downstream of them; cost null where none of them has a price, each run once."""
    own = culprits.select("graph_id", "run_id")
    below = walks.below(_pairs(edges), own.withColumnRenamed("run_id", "src"), ["graph_id"]).withColumnRenamed("dst", "run_id")
    hit = own.union(below).distinct().join(runs.select("graph_id", "run_id", "cost_usd"), ["graph_id", "run_id"])
    return hit.groupBy("graph_id").agg(F.sum("cost_usd").alias("cost"), F.count("cost_usd").alias("priced"), F.count(F.lit(1)).alias("total"))


def manifestation(sccs: DataFrame, links: DataFrame, verifiers: DataFrame) -> DataFrame:
    """(graph_id, run_id) where a failure surfaced: sinks, from verifiers back level by level to the producer that ended last.
    One walk a graph with such a sink."""
    node = sccs.select("graph_id", "scc", F.col("exit_run").alias("run_id"), "end_time").join(verifiers.select("graph_id", "run_id", F.lit(True).alias("v")), ["graph_id", "run_id"], "left").na.fill(False, ["v"])
    tips = node.join(links.select("graph_id", F.col("src").alias("scc")).distinct(), ["graph_id", "scc"], "left_anti")
    found = tips.where("not v").select("graph_id", "run_id")
    sinks = tips.where("v").groupBy("graph_id").agg(F.collect_list("scc").alias("sinks"))
    all_ = node.groupBy("graph_id").agg(F.collect_list(F.struct("scc", "run_id", "end_time", "v")).alias("_n"))
    each = sinks.join(walks.linked(links, ["graph_id"]), "graph_id", "left").join(all_, "graph_id")
    each = each.select("graph_id", "sinks", *(F.col(f"_n.{c}").alias(c) for c in ("scc", "run_id", "end_time", "v")), "src", "dst")
    behind = walks.each_graph(each, walks.producers, [T.StructField("run_id", sccs.schema["exit_run"].dataType)])
    return found.unionByName(behind).distinct()


def significant_drops(runs: DataFrame, edges: DataFrame, least: float = 0.2) -> DataFrame:
    """(graph_id, run_id, drop): falls of more than ``least`` below the best predecessor."""
    score = runs.where("score is not null").select("graph_id", "run_id", "score")
    best = edges.join(score.select("graph_id", F.col("run_id").alias("from_run_id"), F.col("score").alias("s")), ["graph_id", "from_run_id"]).groupBy("graph_id", F.col("to_run_id").alias("run_id")).agg(F.max("s").alias("best"))
    return score.join(best, ["graph_id", "run_id"]).withColumn("drop", F.col("best") - F.col("score")).where(F.col("drop") > least).select("graph_id", "run_id", "drop")


def verification_gaps(runs: DataFrame, verdicts: DataFrame, culprits: DataFrame, edges: DataFrame, cfg: Config = CONFIG) -> DataFrame:
    """(graph_id, run_id, reason): verifiers whose verdict and the end of their graph don't go together.

    A score under the threshold says that the verifier's verdict was wrong. That is a gap where the end agrees: it passed the work
    (not issued_fail) and the end is bad, or it failed work whose end is ok (verdict_scored_incorrect). Issuing FAIL on work that ended badly
    would have been right, so there either the flag or the score is wrong (verifier_flag_conflict). A verifier with a good score that passed
    work below a culprit of a bad end (any work, where nothing is below one) is a gap as well (passed_bad_terminal). runs: score, verifier, issued_fail
    (if known); verdicts: verdict (ok, bad, not_checkable).
    """
    fail = F.coalesce("issued_fail", F.lit(False)) if "issued_fail" in runs.columns else F.lit(False)
    v = runs.where("verifier and score is not null").withColumn("issued_fail", fail).join(verdicts.select("graph_id", "verdict"), "graph_id")
    bad, ok, low = F.col("verdict") == "bad", F.col("verdict") == "ok", F.col("score") < cfg.threshold
    reason = F.when(low & F.col("issued_fail") & bad, "verifier_flag_conflict").when(low & F.when(F.col("issued_fail"), ok).otherwise(bad), "verdict_scored_incorrect")
    wrong = v.withColumn("reason", reason).where("reason is not null").select("graph_id", "run_id", "reason")
    below = walks.below(_pairs(edges), culprits.select("graph_id", F.col("run_id").alias("src")), ["graph_id"]).withColumnRenamed("dst", "run_id")
    some = below.select("graph_id", F.lit(True).alias("some")).distinct()
    passed = v.where(bad & ~low & ~F.col("issued_fail")).join(below.withColumn("below", F.lit(True)), ["graph_id", "run_id"], "left").join(some, "graph_id", "left")
    return wrong.unionByName(passed.where("below or some is null").select("graph_id", "run_id", F.lit("passed_bad_terminal").alias("reason")))


def score_overrides(gaps: DataFrame, runs: DataFrame) -> DataFrame:
    """(graph_id, run_id, original, effective): verifiers whose pass the end refutes count as 0.1; the score itself stays."""
    hit = gaps.where("reason = 'passed_bad_terminal'").join(runs.where("score is not null").select("graph_id", "run_id", F.col("score").alias("original")), ["graph_id", "run_id"])
    return hit.select("graph_id", "run_id", "original", F.lit(0.1).alias("effective"))


def hypotheses(culprits: DataFrame) -> DataFrame:
    """(graph_id, origin, weight): tied origins (column tied) share the confidence, what is left is unresolved (null origin)."""
    each = culprits.select("graph_id", "confidence", F.explode("tied").alias("origin"), (F.col("confidence") / F.size("tied")).alias("weight")).select("graph_id", "origin", "weight")
    return each.unionByName(culprits.select("graph_id", F.lit(None).cast(culprits.schema["tied"].dataType.elementType).alias("origin"), (1 - F.col("confidence")).alias("weight")))


def classify(facts: DataFrame) -> DataFrame:
    """graph_id, class: the first that fits. facts has one row a graph: measured, n_candidates, flawed_source, anomaly, anomaly_is_candidate,
    recovered, terminal (ok, bad or null), deterministic_only, fabrication, composition."""
    one, none = F.col("n_candidates") == 1, F.col("n_candidates") == 0
    kind = (F.when(~F.col("measured") & none & ~F.col("anomaly"), "unclassified").when(none & F.col("flawed_source"), "root_cause_external")
            .when(F.col("anomaly") & (none | F.col("anomaly_is_candidate")), F.when(F.col("n_candidates") > 1, "multi_culprit").otherwise("loop_detected"))
            .when(one & F.col("recovered") & (F.col("terminal") == "ok"), "degraded_recovered").when(one & F.col("recovered") & (F.col("terminal") == "bad") & F.col("deterministic_only"), "terminal_defect_unlocalized")
            .when(one, "cut_point").when(F.col("n_candidates") > 1, "multi_culprit").when((F.col("terminal") == "bad") & F.col("fabrication"), "cut_point")
            .when((F.col("terminal") == "bad") & F.col("composition"), "composition_failure").otherwise("unclassified"))
    return facts.select("graph_id", kind.alias("class"))


def findings(runs: DataFrame, drops: DataFrame, anomalies: DataFrame, breaches: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Typed facts (graph_id, kind, channel, subject, certainty, fact_key, value), numbered by graph in a fixed order."""
    text = lambda c: F.col(c).cast("string")
    pick = lambda df, kind, channel, subject, certainty, key, value: df.select("graph_id", F.lit(kind).alias("kind"), F.lit(channel).alias("channel"), subject.alias("subject"), F.lit(certainty).alias("certainty"), key.alias("fact_key"), value.alias("value"))
    run = text("run_id")
    parts = [
        pick(runs.where("score is not null"), "content_score", "judge", run, 0.7, F.concat(F.lit("score:"), run), F.round("score", 6).cast("string")),
        pick(runs.where("coalesce(input_flawed, false)"), "input_flawed", "judge", run, 0.7, F.concat(F.lit("input:"), run), F.lit("flawed")),
        pick(drops, "content_drop", "judge", run, 0.7, F.concat(F.lit("drop:"), run), F.round("drop", 6).cast("string")),
        pick(anomalies, "loop_anomaly", "deterministic", text("scc"), 0.95, F.concat(F.lit("loop:"), text("scc")), text("rounds")),
        pick(breaches, "contract_breach", "deterministic", text("scc"), 0.95, F.concat(F.lit("param:"), F.col("key")), F.col("value")),
        pick(verdicts, "terminal_content", "terminal", F.lit("deliverable"), 0.7, F.lit("terminal"), F.col("verdict"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reconcile(found: DataFrame) -> DataFrame:
    """Facts that hold more than one value: a divergence finding each, with the values."""
    return found.groupBy("graph_id", "fact_key").agg(F.sort_array(F.collect_set("value")).alias("values")).where("size(values) > 1").select("graph_id", F.lit("representation_divergence").alias("kind"), "fact_key", F.concat_ws(",", "values").alias("values"))


def defects(candidates: DataFrame, anomalies: DataFrame, gaps: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Defects (graph_id, kind, origin_kind, origin, recovered) and the findings each rests on, with a role.

    A finding of the origin is supporting; the origin's own score supports a content defect under the threshold and is refuting from it on,
    and is context for other defects. How the graph ended: a bad end supports, a good one refutes what wasn't recovered, anything
    else is context."""
    origin = F.col("run_id").cast("string").alias("origin")
    made = candidates.select("graph_id", F.when(F.col("via") == "deterministic", "contract").otherwise("content").alias("kind"), F.lit("localized").alias("origin_kind"), origin, F.coalesce("recovered", F.lit(False)).alias("recovered"))
    made = made.unionByName(anomalies.select("graph_id", F.lit("loop").alias("kind"), F.lit("localized").alias("origin_kind"), F.col("scc").cast("string").alias("origin"), F.lit(False).alias("recovered")))
    asserted = gaps.where("reason <> 'verifier_flag_conflict'")  # a conflict is evidence and blames nobody
    made = made.unionByName(asserted.select("graph_id", F.lit("verification").alias("kind"), F.lit("localized").alias("origin_kind"), origin, F.lit(False).alias("recovered")))
    score = F.when(F.col("kind") != "content", "context").when(F.col("value").try_cast("double") < CONFIG.threshold, "supporting").otherwise("refuting")
    end = F.when(F.col("value") == "bad", "supporting").when((F.col("value") == "ok") & ~F.col("recovered"), "refuting").otherwise("context")
    role = F.when(F.col("f_kind") == "terminal_content", end).when(F.col("subject") == F.col("origin"), F.when(F.col("f_kind") == "content_score", score).otherwise("supporting"))
    refs = made.join(found.select("graph_id", F.col("kind").alias("f_kind"), "subject", "fact_key", "value"), "graph_id").withColumn("role", role).where("role is not null")
    return made, refs.select("graph_id", "kind", "origin", "fact_key", "role")


def report_type(defect_rows: DataFrame) -> DataFrame:
    """(graph_id, report_type) from defects (kind, origin_kind, origin, recovered, quality_unmeasured); the first rule that fits."""
    k = lambda *kinds: F.col("kind").isin(*kinds)
    here = F.col("origin_kind") == "localized"
    live = k("content") & ~F.col("recovered")
    a = defect_rows.groupBy("graph_id").agg(
        F.bool_or(k("content", "contract", "loop")).alias("primary"), F.bool_or(k("verification")).alias("verification"), F.bool_or(F.col("origin_kind") == "external").alias("external"),
        F.count_distinct(F.when(k("content", "contract", "loop") & here & ~(k("content") & F.col("recovered")), F.col("origin"))).alias("origins"), F.bool_or(k("loop") & here).alias("loop"),
        F.bool_or(k("content")).alias("content"), F.bool_or(live).alias("live"), F.bool_or(live & here).alias("live_here"), F.bool_or(live & (F.col("origin_kind") == "unlocalized")).alias("live_nowhere"),
        F.bool_or(k("contract")).alias("contract"), F.bool_or(k("contract") & here).alias("contract_here"), F.bool_or(k("contract") & F.col("quality_unmeasured")).alias("unmeasured"))
    c = F.col
    kind = (F.when(~c("primary") & ~c("verification"), "unclassified").when(c("external"), "root_cause_external").when(c("origins") >= 2, "multi_culprit").when(c("loop"), "loop_detected").when(c("live_here"), "cut_point")
            .when(c("content") & ~c("live") & ~c("contract"), "degraded_recovered").when(c("contract_here") & c("live_nowhere"), "terminal_defect_unlocalized")
            .when(c("contract_here") & ~c("live"), F.when(c("unmeasured"), "cut_point").otherwise("degraded_recovered")).when(c("live") & ~c("live_here"), "composition_failure").when(c("verification"), "verification_gap").otherwise("unclassified"))
    return a.select("graph_id", kind.alias("report_type"))


QUALITY_TYPES = ["cut_point", "multi_culprit", "composition_failure", "root_cause_external", "verification_gap", "terminal_defect_unlocalized"]


def escalate(reports: DataFrame, shipped: DataFrame) -> DataFrame:
    """degraded_recovered becomes shipped_with_latent_defect where a breach is known to have reached the deliverable."""
    hit = shipped.where("status = 'propagated'").select("graph_id", F.lit(True).alias("_s")).distinct()
    return reports.join(hit, "graph_id", "left").withColumn("report_type", F.when((F.col("report_type") == "degraded_recovered") & F.col("_s"), "shipped_with_latent_defect").otherwise(F.col("report_type"))).drop("_s")


def incident_key(report_type_: Column, flags: Column, terminal_bad: Column) -> Column:
    """The incident that a report and its flags give, or null."""
    has = lambda f: F.array_contains(flags, f)
    return (F.when((report_type_ == "loop_detected") | has("loop_anomaly"), "loop_detected").when(report_type_ == "shipped_with_latent_defect", "latent_defect").when(report_type_.isin(*QUALITY_TYPES), "degraded_quality")
            .when(has("failed_runs"), "terminal_failure").when(has("terminal_form_breach"), "latent_defect").when(has("cost_overrun"), "cost_overrun").when(terminal_bad, "terminal_failure"))


def candidacy(nodes: DataFrame, cfg: Config = CONFIG) -> DataFrame:
    """(graph_id, run_id, reason): why each run is, or isn't, an origin. nodes carries the joined facts named below."""
    c = F.col
    reason = (F.when(c("is_culprit"), "culprit").when(c("shadowed"), "shadowed_by_ancestor").when(c("in_loop"), "in_anomalous_loop").when(c("unscored_reason").isNotNull(), F.concat(F.lit("unscored_"), c("unscored_reason"))).when(c("score").isNull(), "unscored")
              .when(c("input_flawed"), "input_flawed").when(c("verifier") & (c("score") < cfg.threshold), "verifier_low_score").when((c("kind") == "recovered"), "recovered_boundary").when(c("score") < cfg.threshold, F.when(c("base") < cfg.threshold, "inherited").otherwise("drop_too_small"))
              .when(c("drop") >= cfg.min_drop, "minor_drop").otherwise("healthy"))
    return nodes.select("graph_id", "run_id", reason.alias("reason"))


def fabrication_origin(runs: DataFrame, verdicts: DataFrame, order: DataFrame, candidates: DataFrame) -> DataFrame:
    """In graphs that end badly without a candidate: the earliest run that is no verifier and carries a content flag, at 0.65."""
    bad = verdicts.where("bad").select("graph_id").join(candidates.select("graph_id").distinct(), "graph_id", "left_anti")
    flagged = runs.where("not verifier and content_flag").join(bad, "graph_id", "left_semi").join(order.select("graph_id", F.col("scc").alias("run_id"), "topo"), ["graph_id", "run_id"])
    return flagged.groupBy("graph_id").agg(F.min_by("run_id", "topo").alias("run_id")).withColumn("confidence", F.lit(0.65))


def composition_suspect(runs: DataFrame, verdicts: DataFrame, candidates: DataFrame, drops: DataFrame, cfg: Config = CONFIG) -> DataFrame:
    """Graphs that end badly while every run is scored and healthy and nothing dropped."""
    bad = verdicts.where("bad").select("graph_id").join(candidates.select("graph_id").distinct(), "graph_id", "left_anti").join(drops.select("graph_id").distinct(), "graph_id", "left_anti")
    fine = runs.groupBy("graph_id").agg(F.bool_and(F.coalesce(F.col("score") >= cfg.threshold, F.lit(False))).alias("fine")).where("fine")
    return bad.join(fine, "graph_id", "left_semi")


def peer_facts(signals: DataFrame, runs: DataFrame) -> DataFrame:
    """(graph_id, run_id, n_empty_peers): other runs of the graph with an empty result set."""
    empty = signals.where("name = 'zero_result_set'").select("graph_id", "run_id", F.lit(1).alias("e")).distinct()
    each = runs.select("graph_id", "run_id").join(empty, ["graph_id", "run_id"], "left").na.fill(0, ["e"])
    total = empty.groupBy("graph_id").agg(F.count(F.lit(1)).alias("t"))
    return each.join(total, "graph_id", "left").select("graph_id", "run_id", (F.coalesce("t", F.lit(0)) - F.col("e")).alias("n_empty_peers"))
