"""Queries over streams with state: each feeds its rows in turns, and every turn is a new start of the stream from its checkpoint."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import folder, stored
from ..operators import reconstruct
from ..streaming import chain, live
from .catalog import Orders, _picked, _spans, query
from .views import sql, table, view


def in_turns(spark: SparkSession, rows: DataFrame, turn: str, turns: int, fold: Callable[[DataFrame, int], None], path: str) -> None:
    """Feeds ``rows`` to ``fold`` as a stream, one value of ``turn`` after another. The stream stops after each and starts again."""
    rows = stored(rows)
    plain = rows.drop(turn)
    for k in range(turns):
        rows.where(F.col(turn) == k).drop(turn).write.mode("append").parquet(f"{path}/in")
        live.drain_batches(spark.readStream.schema(plain.schema).parquet(f"{path}/in"), path, fold)


def _path(spark: SparkSession) -> str:
    return f"{folder(spark)}/stream-{uuid.uuid4().hex}"


@query("""with u as (select conv_id, min(turn) as turn from conversations where role = 'user' group by 1)
    select cast(c.conv_id as varchar) as graph_key, cast(c.conv_id as varchar) || ':s' || cast(u.turn as varchar) as from_key, cast(c.conv_id as varchar) || ':s' || cast(c.turn as varchar) as to_key
    from conversations c join u on u.conv_id = c.conv_id where c.role = 'assistant' and c.turn > 0""")
def g17_deferred_delegations(spark, sf_dir):
    """Assistant turns ask for the agent ``user``; they come first, then the later user turns, and the first user turns last: each answer
    is replaced as a better one arrives."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    first = c.where("role = 'user'").groupBy("conv_id").agg(F.min("turn").alias("first"))
    c = c.join(first, "conv_id").where("role = 'user' or turn > 0")
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.concat(F.lit("s"), "turn"))
    asks = F.col("role") == "assistant"
    rows = c.select(F.col("conv_id").cast("string").alias("graph_id"), F.col("conv_id").cast("string").alias("trace_id"), key.alias("run_key"), F.when(~asks, F.col("role")).alias("agent_name"), F.timestamp_seconds("turn").alias("started_at"), F.when(asks, "user").alias("target_name"),
                    F.when(asks, 0).when(F.col("turn") != F.col("first"), 1).otherwise(2).alias("at"))
    path = _path(spark)
    state = chain.DeferredDelegations(path)
    in_turns(spark, rows, "at", 3, state.fold, path)
    return state.edges(spark).select(F.col("graph_id").alias("graph_key"), "from_key", "to_key")


@query("""with u as (select conv_id, min(turn) as turn from conversations where role = 'user' group by 1)
    select cast(c.conv_id as varchar) || ':s' || cast(u.turn as varchar) as from_key, cast(c.conv_id as varchar) || ':s' || cast(c.turn as varchar) as to_key, c.conv_id % 3 = 0 as from_store
    from conversations c join u on u.conv_id = c.conv_id where c.role = 'assistant'""")
def g17_stored_runs(spark, sf_dir):
    """A re-map that lacks the spans of the users' runs of every third conversation: these delegations are closed against the stored runs."""
    spans = _spans(spark, sf_dir)
    done = spans.select(F.col("trace_id").alias("graph_key")).distinct()
    whole = reconstruct.build_runs(reconstruct.cut(reconstruct.assign_owners(spans)))
    lost = (F.col("trace_id").cast("bigint") % 3 == 0) & (F.col("attributes")["agent.name"] == "user")
    _, edges, _ = reconstruct.remap(spans.where(~F.coalesce(lost, F.lit(False))), done, ["name"], stored_runs=whole.where("agent_name = 'user'"))
    return edges.where("type = 'TOOL_DELEGATION'").select("from_key", "to_key", (F.col("detection_rule") == "stored_run").alias("from_store"))


@query("""with b as (select graph_id, run_id, case when run_id <= 2 then 0 when run_id <= 4 then 1 else 2 end as turn from v_runs),
      g as (select graph_id, count(*) filter (where turn = 0) as n0, count(*) filter (where turn = 1) as n1, count(*) filter (where turn = 2) as n2 from b group by 1),
      s as (select *, graph_id % 3 as kind from g)
    select graph_id, 1 as generation, case kind when 0 then n0 else n0 + n1 end as run_count, 0 as late_count from s where kind in (0, 1)
    union all select graph_id, 2, n0 + n1, n1 from s where kind = 0 and n1 > 0
    union all select graph_id, case when kind = 0 and n1 > 0 then 3 else 2 end, n0 + n1 + n2, case when kind = 0 then n1 + n2 else n2 end from s where kind in (0, 1) and n2 > 0""")
def w05_reanalysis(spark, sf_dir):
    """Graphs complete in the first turn, in the second, or never; later runs are delivered twice. One announcement a generation."""
    turn = F.when(F.col("run_id") <= 2, 0).when(F.col("run_id") <= 4, 1).otherwise(2)
    runs = view(spark, sf_dir, "v_runs").select("graph_id", "run_id", F.timestamp_seconds("run_id").alias("arrival_ts"), F.lit(False).alias("closes"), turn.alias("at"))
    ends = runs.select("graph_id").distinct().where("graph_id % 3 < 2").select("graph_id", F.lit(None).cast("long").alias("run_id"), F.lit(None).cast("timestamp").alias("arrival_ts"), F.lit(True).alias("closes"), (F.col("graph_id") % 3).cast("int").alias("at"))
    again = runs.where("at = 1").withColumn("at", F.lit(2))
    path = _path(spark)
    state = chain.Generations(path)
    in_turns(spark, runs.union(ends).union(again), "at", 4, state.fold, path)
    return state.announced.state(spark).select("graph_id", "generation", "run_count", "late_count")


BREAKERS = """with i as (select o_custkey as agent, o_orderkey as incident_id from orders where o_orderkey % 3 = 0),
      n as (select agent, count(*) as opened, count(*) filter (where incident_id % 2 = 0) as kept from i group by 1)"""


@query(f"""{BREAKERS} select cast(agent as varchar) as agent_name, 'closed' as from_state, 'open' as to_state, 1 as at from n where opened >= 3
    union all select cast(agent as varchar), 'open', 'closed', 2 from n where opened >= 3 and kept < 3
    union all select cast(agent as varchar), 'closed', 'open', 3 from n where opened >= 3 and kept < 3 and agent % 2 = 0""")
def w09_breaker_transitions(spark, sf_dir):
    """Incidents open, odd ones are resolved, and those of every second agent open again."""
    state = _breakers(spark, sf_dir)
    return state.signals.changes(spark).select("agent_name", "from_state", "to_state", F.unix_timestamp("at").cast("int").alias("at"))


@query(f"""{BREAKERS} select cast(agent as varchar) as agent_name, case when kept >= 3 or (agent % 2 = 0 and opened >= 3) then 'open' else 'closed' end as state, case when agent % 2 = 0 then opened else kept end as open_incidents,
    case when opened < 3 then null when kept < 3 and agent % 2 = 0 then 3 else 1 end as opened_at from n""")
def t11_breaker_state(spark, sf_dir):
    """The same incidents: opened_at is that of the last time the breaker opened, also after it has closed."""
    state = _breakers(spark, sf_dir)
    return state.agents.state(spark).select("agent_name", "state", "open_incidents", F.unix_timestamp("opened_at").cast("int").alias("opened_at"))


def _breakers(spark: SparkSession, sf_dir: str) -> chain.Breakers:
    i = sql(spark, sf_dir, "select o_custkey as agent, o_orderkey as incident_id from orders where o_orderkey % 3 = 0")
    row = lambda status, at: (F.col("agent").cast("string").alias("agent_name"), "incident_id", F.lit(status).alias("status"), F.timestamp_seconds(F.lit(at)).alias("at"), F.lit(at - 1).alias("turn"))
    rows = i.select(*row("open", 1)).union(i.where("incident_id % 2 = 1").select(*row("resolved", 2))).union(i.where("incident_id % 2 = 1 and agent % 2 = 0").select(*row("open", 3)))
    path = _path(spark)
    state = chain.Breakers(path)
    in_turns(spark, rows, "turn", 3, state.fold, path)
    return state


@query("select event_id as id, 6 as deliveries, event_type as payload from events where event_id % 9 = 0 and event_id % 7 <= 1")
def w08_dead_letters(spark, sf_dir):
    """Messages of seven turns. Every ninth never succeeds, others at the first or the third delivery; a message delivered again counts on."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("payload"), (F.col("event_id") % 7).cast("int").alias("at"))
    again = e.where("id % 9 = 0 and at = 0").withColumn("at", F.lit(3))
    path = _path(spark)
    state = chain.Deliveries(path, lambda due: due.where("id % 9 <> 0 and (id % 9 <> 3 or deliveries >= 3)"))
    in_turns(spark, e.union(again), "at", 7, state.fold, path)
    return state.dead_letters(spark)


CHAIN = f"""with r as (select *, case when run_id <= 2 then 0 when run_id <= 4 then 1 else 2 end as turn, not exists (select 1 from v_edges e where e.graph_id = v_runs.graph_id and e.to_run_id = v_runs.run_id) as root from v_runs),
      g as (select graph_id, bool_and(ended_at is not null) filter (where root) as ended, max(turn) as last from r group by 1),
      c as (select graph_id, case when ended then 0 when last < 2 then last + 1 end as done, coalesce(ended, false) as ended from g),
      t as (select c.graph_id, c.done, c.ended, coalesce(bool_or(r.status = 'failed'), false) as failed, min(r.score) as worst from c join r on r.graph_id = c.graph_id and r.turn <= c.done where c.done is not null group by 1, 2, 3),
      f as (select *, failed or coalesce(worst < 0.2, false) as flagged, {_picked('cast(graph_id as varchar)', 25)} as picked from t)"""


@query(f"""{CHAIN} select graph_id, case when ended then 'root_ended' else 'quiet' end as complete, flagged, case when flagged then 'flagged' when picked then 'sampled' end as why, failed and flagged as run_failed, coalesce(worst < 0.2, false) as low_score from f""")
def w10_incident_stream(spark, sf_dir):
    """Runs in three turns an hour apart, of which the second delivers the first again: completion, triage, routing and incidents in one stream."""
    state = _analysis(spark, sf_dir)
    raised = state.incidents.state(spark).where("is_new").groupBy("graph_id").agg(F.collect_set("incident_key").alias("keys"))
    has = lambda key: F.coalesce(F.array_contains("keys", key), F.lit(False)).alias(key)
    done = state.graphs.state(spark).where("complete is not null").select("graph_id", "complete")
    rows = done.join(state.triage.state(spark), "graph_id").join(state.deep.state(spark), "graph_id", "left").join(raised, "graph_id", "left")
    return rows.select("graph_id", "complete", "flagged", "why", has("run_failed"), has("low_score"))


def _analysis(spark: SparkSession, sf_dir: str) -> chain.Analysis:
    each = Orders(spark, sf_dir).gathered(F.col("ended_at").isNotNull().alias("ended"))
    roots = F.array_except("nodes.run_id", "dst").alias("roots")
    turn = F.when(F.col("run_id") <= 2, 0).when(F.col("run_id") <= 4, 1).otherwise(2)
    rows = each.select("graph_id", roots, F.inline("nodes")).select("graph_id", "run_id", F.array_contains("roots", F.col("run_id")).alias("root"), "ended", "failed", F.col("score").cast("double").alias("score"),
                                                                    F.timestamp_seconds(turn * 3600).alias("arrival_ts"), turn.alias("at"))
    twice = F.when(F.col("at") == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array("at"))
    path = _path(spark)
    state = chain.Analysis(path, "30 minutes", 25)
    in_turns(spark, rows.withColumn("at", F.explode(twice)), "at", 3, state.fold, path)
    return state
