"""From spans to graphs: runs, edges and their roll-ups, for all traces at once.

Spans: trace_id, span_id, parent_span_id, name, kind (10 agent, 11 tool), start_time, end_time, attributes MAP, error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.columns import uuid5_url
from ..functions.lineage import cut

AGENT, TOOL = 10, 11


def open_runs(spans: DataFrame) -> DataFrame:
    """(run_key, trace_id, span_id, …): each agent span opens a run; of repeated span ids the first by start."""
    first = F.row_number().over(W.partitionBy("trace_id", "span_id").orderBy("start_time", "name"))
    return spans.where(F.col("kind") == AGENT).withColumn("_n", first).where("_n = 1").drop("_n").withColumn("run_key", F.concat_ws(":", "trace_id", "span_id"))


def assign_owners(spans: DataFrame) -> DataFrame:
    """spans with run_key of the nearest agent span at or above each; null where the parents break off or run in a circle.

    Pointer doubling: after step i a span points to its ancestor 2^i up, or to the agent that stopped the walk. A walk longer than its
    trace has spans runs in a circle.
    """
    agent = F.col("kind") == AGENT
    now = spans.select("trace_id", "span_id", F.when(agent, F.col("span_id")).alias("owner"), F.when(~agent, F.col("parent_span_id")).alias("up")).dropDuplicates(["trace_id", "span_id"])
    now = cut(now)
    longest, walked = now.groupBy("trace_id").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0], 1
    while walked <= longest and not now.where("owner is null and up is not null").isEmpty():
        walked *= 2
        above = now.select("trace_id", F.col("span_id").alias("up"), F.col("owner").alias("o2"), F.col("up").alias("u2"))
        now = cut(now.join(above, ["trace_id", "up"], "left").select("trace_id", "span_id", F.coalesce("owner", "o2").alias("owner"), F.when(F.coalesce("owner", "o2").isNull(), F.col("u2")).alias("up")))
    owner = now.where("owner is not null").select("trace_id", "span_id", F.concat_ws(":", "trace_id", "owner").alias("run_key"))
    return spans.join(owner, ["trace_id", "span_id"], "left")


def build_runs(owned: DataFrame) -> DataFrame:
    """One row a run: identity, model, usage, tool digest, status, times and graph. One aggregation by run_key."""
    a = lambda k: F.nullif(F.trim(F.try_element_at("attributes", F.lit(k))), F.lit(""))
    is_opener = F.concat_ws(":", "trace_id", "span_id") == F.col("run_key")
    order = F.struct("start_time", "span_id")
    opener = lambda c, name: F.max(F.when(is_opener, c)).alias(name)
    total = lambda k, name: F.coalesce(F.max(F.when(is_opener, a(k).try_cast("double"))), F.sum(a(k).try_cast("double"))).alias(name)
    tool = F.struct("start_time", "span_id", F.coalesce(a("tool.name"), F.col("name")).alias("name"), F.left(F.sha2(F.coalesce(a("tool.args"), F.lit("")), 256), F.lit(12)).alias("args_sha"), F.when(F.col("error"), "error").otherwise("ok").alias("status"))
    rows = owned.where("run_key is not null").groupBy("run_key").agg(
        F.first("trace_id").alias("trace_id"), opener(F.coalesce(a("agent.name"), F.col("name")), "agent_name"), opener(a("agent.version"), "agent_version"),
        F.coalesce(F.max(F.when(is_opener, a("model"))), F.min_by(a("model"), F.when(a("model").isNotNull(), order))).alias("model_name"),
        total("tokens.in", "tokens_in"), total("tokens.out", "tokens_out"), total("cost", "cost_usd"),
        F.sort_array(F.collect_list(F.when(F.col("kind") == TOOL, tool))).alias("tools"),
        F.when(F.bool_or("error"), "failed").otherwise("ok").alias("status"),
        F.coalesce(F.max(F.when(is_opener, F.col("start_time"))), F.min("start_time")).alias("started_at"), F.coalesce(F.max(F.when(is_opener, F.col("end_time"))), F.max("end_time")).alias("ended_at"),
        F.min_by(a("correlation.id"), F.when(a("correlation.id").isNotNull(), order)).alias("header"), opener(a("service.name"), "service"), opener(a("input"), "input"), opener(a("output"), "output"))
    digest = F.when(F.size("tools") > 0, F.to_json(F.transform("tools", lambda t: F.struct(t["name"].alias("name"), t["args_sha"].alias("args_sha"), t["status"].alias("status")))))
    return rows.select("run_key", uuid5_url(F.col("run_key")).alias("run_id"), F.coalesce("header", "trace_id").alias("graph_key"), uuid5_url(F.coalesce("header", "trace_id")).alias("graph_id"),
                       "trace_id", "agent_name", "agent_version", "model_name", F.floor("tokens_in").alias("tokens_in"), F.floor("tokens_out").alias("tokens_out"), "cost_usd", digest.alias("tool_calls"),
                       "status", "started_at", "ended_at", "service", "input", "output")


def graph_types(runs: DataFrame) -> DataFrame:
    """(graph_id, graph_type): the first service name by start and key."""
    return runs.groupBy("graph_id").agg(F.min_by("service", F.when(F.col("service").isNotNull(), F.struct("started_at", "run_key"))).alias("graph_type"))


def spawn_edges(owned: DataFrame, runs: DataFrame) -> DataFrame:
    """Agent spans whose parent span belongs to a run of another agent: parent run → run."""
    key = runs.select("run_key", "agent_name", "graph_id")
    child = owned.where(F.col("kind") == AGENT).select("trace_id", F.col("parent_span_id").alias("up"), F.col("run_key").alias("to_key"))
    parent = owned.select("trace_id", F.col("span_id").alias("up"), F.col("run_key").alias("from_key"))
    pairs = child.join(parent, ["trace_id", "up"]).where("from_key <> to_key")
    pairs = pairs.join(key.select(F.col("run_key").alias("to_key"), F.col("agent_name").alias("to_name"), "graph_id"), "to_key").join(key.select(F.col("run_key").alias("from_key"), F.col("agent_name").alias("from_name")), "from_key")
    return pairs.where("not (from_name <=> to_name)").select("graph_id", "from_key", "to_key", F.lit("SPAWN").alias("type"), F.lit("parent_span").alias("detection_rule"))


def resolve_by_name(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """requests (graph_id, trace_id, owner_key, target_name, …) with to_key: the run of that name in the same graph, same trace first, then by start and key."""
    named = runs.select("graph_id", F.col("agent_name").alias("target_name"), F.col("trace_id").alias("run_trace"), "started_at", F.col("run_key").alias("found"))
    both = requests.join(named, ["graph_id", "target_name"], "left").where("found is null or found <> owner_key")
    best = F.min_by("found", F.when(F.col("found").isNotNull(), F.struct((F.col("run_trace") != F.col("trace_id")), "started_at", "found")))
    return both.groupBy(*requests.columns).agg(best.alias("to_key"))


def delegation_edges(owned: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tool spans that name an agent: target run → caller; and the (owner, target) pairs that no run answers."""
    target = F.try_element_at("attributes", F.lit("delegate.to"))
    asked = owned.where((F.col("kind") == TOOL) & target.isNotNull() & F.col("run_key").isNotNull()).select("trace_id", F.col("run_key").alias("owner_key"), target.alias("target_name"))
    asked = asked.join(runs.select(F.col("run_key").alias("owner_key"), "graph_id"), "owner_key").distinct()
    found = resolve_by_name(asked, runs)
    edges = found.where("to_key is not null").select("graph_id", F.col("to_key").alias("from_key"), F.col("owner_key").alias("to_key"), F.lit("TOOL_DELEGATION").alias("type"), F.lit("tool_target").alias("detection_rule"))
    return edges, found.where("to_key is null").select("owner_key", "target_name").distinct()


def a2a_edges(owned: DataFrame, runs: DataFrame, enabled: bool = False) -> DataFrame:
    """Peer messages (attribute a2a.task_id): peer → caller, or caller → peer for server spans. Off unless asked for."""
    peer = F.try_element_at("attributes", F.lit("a2a.peer"))
    asked = owned.where(F.lit(enabled) & F.try_element_at("attributes", F.lit("a2a.task_id")).isNotNull() & F.col("run_key").isNotNull())
    asked = asked.select("trace_id", F.col("run_key").alias("owner_key"), peer.alias("target_name"), (F.col("kind") == 2).alias("server"))
    asked = asked.join(runs.select(F.col("run_key").alias("owner_key"), "graph_id"), "owner_key").distinct()
    found = resolve_by_name(asked, runs).where("to_key is not null")
    return found.select("graph_id", F.when(F.col("server"), F.col("owner_key")).otherwise(F.col("to_key")).alias("from_key"), F.when(F.col("server"), F.col("to_key")).otherwise(F.col("owner_key")).alias("to_key"),
                        F.lit("A2A").alias("type"), F.lit("a2a_message").alias("detection_rule"))


def sequential_edges(openers: DataFrame, signature: str) -> DataFrame:
    """Runs opened by spans of the signature name under one parent, chained by start and span id."""
    after = F.lead("run_key").over(W.partitionBy("trace_id", "parent_span_id").orderBy("start_time", "span_id"))
    return openers.where(F.col("name").rlike(signature)).withColumn("to_key", after).where("to_key is not null").select(F.col("trace_id").alias("graph_key"), F.col("run_key").alias("from_key"), "to_key", F.lit("SEQUENTIAL").alias("type"), F.lit("task_order").alias("detection_rule"))


def framework_profile(openers: DataFrame, signature: str) -> DataFrame:
    """run_key, role, input, output of runs whose span name fits the signature (first group: the role); payloads out of JSON."""
    attribute = lambda k: F.try_element_at("attributes", F.lit(k))
    fits = F.col("name").rlike(signature)
    unwrap = lambda k: F.when(fits, F.coalesce(F.get_json_object(attribute(k), "$.raw"), F.get_json_object(attribute(k), "$.description"), attribute(k))).otherwise(attribute(k))
    return openers.select("run_key", F.when(fits, F.nullif(F.regexp_extract("name", signature, 1), F.lit(""))).alias("role"), unwrap("input").alias("input"), unwrap("output").alias("output"))


RULE_ORDER = ["parent_span", "tool_target", "a2a_message", "task_order", "stored_run"]


def dedup_edges(edges: DataFrame) -> DataFrame:
    """One edge per (from, to, type): the first by rule order."""
    rank = F.array_position(F.array(*map(F.lit, RULE_ORDER)), F.col("detection_rule"))
    key = ["graph_id", "from_key", "to_key", "type"]
    return edges.groupBy(*key).agg(F.min_by("detection_rule", F.when(rank > 0, rank).otherwise(99)).alias("detection_rule"))


def graph_rollup(runs: DataFrame) -> DataFrame:
    """Bounds, number of runs and cost of each graph; the cost is null where no run has a price."""
    return runs.groupBy("graph_id").agg(F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at"), F.count(F.lit(1)).alias("run_count"), F.sum("cost_usd").alias("total_cost_usd"))


def known_edges(runs: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose ends are both known runs of their graph."""
    ids = runs.select("graph_id", "run_id").distinct()
    out = edges.join(ids.withColumnRenamed("run_id", "from_run_id"), ["graph_id", "from_run_id"], "left_semi")
    return out.join(ids.withColumnRenamed("run_id", "to_run_id"), ["graph_id", "to_run_id"], "left_semi")


def remap(spans: DataFrame, graph_keys: DataFrame, tie: list[str], stored_runs: DataFrame | None = None, a2a: bool = False, signature: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs, edges and graphs again from all stored spans of finished graphs.

    ``stored_runs`` (graph_id, trace_id, run_key, agent_name, started_at) answer the delegations for which the spans have no run: those whose
    spans are lost. ``a2a`` adds edges of peer messages, ``signature`` (of span names) the order of a framework's tasks."""
    owned = cut(assign_owners(latest_spans_of(spans, graph_keys, tie)))
    runs = cut(build_runs(owned))
    tools, open_ = delegation_edges(owned, runs)
    edges = spawn_edges(owned, runs).unionByName(tools)
    if stored_runs is not None:
        asked = open_.join(runs.select(F.col("run_key").alias("owner_key"), "graph_id", "trace_id"), "owner_key")
        found = resolve_by_name(asked.select("graph_id", "trace_id", "owner_key", "target_name"), stored_runs).where("to_key is not null")
        edges = edges.unionByName(found.select("graph_id", F.col("to_key").alias("from_key"), F.col("owner_key").alias("to_key"), F.lit("TOOL_DELEGATION").alias("type"), F.lit("stored_run").alias("detection_rule")))
    if a2a:
        edges = edges.unionByName(a2a_edges(owned, runs, enabled=True))
    if signature:
        chained = sequential_edges(owned.where((F.col("kind") == AGENT) & (F.concat_ws(":", "trace_id", "span_id") == F.col("run_key"))), signature)
        edges = edges.unionByName(chained.join(runs.select(F.col("run_key").alias("from_key"), "graph_id"), "from_key").select("graph_id", "from_key", "to_key", "type", "detection_rule"))
    return runs, dedup_edges(edges), graph_rollup(runs)


def latest_spans_of(spans: DataFrame, graph_keys: DataFrame, tie: list[str]) -> DataFrame:
    from ..sources.traces import latest_spans, spans_for_traces

    return latest_spans(spans_for_traces(spans, graph_keys.select(F.col("graph_key").alias("trace_id"))), tie)


def sinks(runs: DataFrame, edges: DataFrame) -> DataFrame:
    """Runs that no edge leaves; an edge from a run to itself leaves it."""
    return runs.join(edges.select("graph_id", F.col("from_run_id").alias("run_id")), ["graph_id", "run_id"], "left_anti")


def roots(runs: DataFrame, edges: DataFrame) -> DataFrame:
    """Runs that no edge enters."""
    return runs.join(edges.select("graph_id", F.col("to_run_id").alias("run_id")), ["graph_id", "run_id"], "left_anti")


def ends(runs: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, root_run_id, terminal_run_id: the root that starts first and the sink that ends last; a graph without roots, or without
    sinks, takes all its runs for them. runs: run_id, started_at, end_time."""
    key = ["graph_id", "run_id"]
    entered, left = (edges.select("graph_id", F.col(c).alias("run_id"), F.lit(True).alias(name)).distinct() for c, name in (("to_run_id", "entered"), ("from_run_id", "left")))
    known = runs.join(entered, key, "left").join(left, key, "left")
    return known.groupBy("graph_id").agg(F.min_by("run_id", F.struct(F.coalesce("entered", F.lit(False)), "started_at", "run_id")).alias("root_run_id"),
                                         F.max_by("run_id", F.struct(F.col("left").isNull(), "end_time", "run_id")).alias("terminal_run_id"))


def deliverable(runs: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, run_id) of the run whose output is delivered.

    The sink that ends last; without sinks the last run that has output and isn't a source, or else the last of all. From a verifier
    the walk goes to the last of its predecessors that have output and aren't verifiers, and ends there. Without any it goes to the last
    predecessor that it hasn't met, and on if that is a verifier too. runs: run_id, end_time, has_output, verifier (null: false).
    """
    key, end = ["graph_id", "run_id"], F.struct("end_time", "run_id")
    has, checks = F.coalesce("has_output", F.lit(False)), F.coalesce("verifier", F.lit(False))
    from_sinks = sinks(runs, edges).groupBy("graph_id").agg(F.max_by("run_id", end).alias("run_id"))
    fed = edges.select("graph_id", F.col("to_run_id").alias("run_id"), F.lit(True).alias("fed")).distinct()
    closed = runs.join(from_sinks, "graph_id", "left_anti").join(fed, key, "left")
    fallback = closed.groupBy("graph_id").agg(F.max_by("run_id", F.struct(has & F.coalesce("fed", F.lit(False)), "end_time", "run_id")).alias("run_id"))

    before = edges.select("graph_id", F.col("to_run_id").alias("run_id"), F.col("from_run_id").alias("prev")).distinct()
    before = before.join(runs.where(checks).select(*key), key, "left_semi")
    before = before.join(runs.select("graph_id", F.col("run_id").alias("prev"), "end_time", (has & ~checks).alias("made"), checks.alias("again")), ["graph_id", "prev"])
    step = cut(before.groupBy(*key).agg(F.max_by("prev", F.when(F.col("made"), F.struct("end_time", "prev"))).alias("maker"), F.sort_array(F.collect_list(F.struct("end_time", "prev", "again")), False).alias("prevs")))

    at, ended = cut(from_sinks.unionByName(fallback).withColumn("met", F.array("run_id"))), None
    fresh = F.get(F.filter("prevs", lambda x: ~F.array_contains("met", x["prev"])), F.lit(0))
    while not at.isEmpty():  # a walk meets no run twice
        here = at.join(step, key, "left").withColumn("next", F.when(F.col("maker").isNull(), fresh))
        to = F.coalesce("maker", "next.prev", "run_id")
        here = cut(here.select("graph_id", to.alias("run_id"), F.array_append("met", to).alias("met"), F.coalesce("next.again", F.lit(False)).alias("on")))
        done = here.where("not on").select(*key)
        ended, at = done if ended is None else ended.unionByName(done), here.where("on").drop("on")
    return ended if ended is not None else at.select(*key)
