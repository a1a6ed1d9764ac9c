"""Stateful steps of the live pipeline, each a foreachBatch function over change logs.

Every class folds micro-batches into ``ChangeLog`` tables below a folder. Its ``fold`` can be run again with the same batch number
and changes nothing then; a stream that is stopped goes on from its checkpoint with the next number. State is joined by key, so a
batch costs what its graphs, agents or messages cost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import stored
from ..operators.reconstruct import resolve_by_name
from ..operators.scoring import deep_worklist
from .changelog import ChangeLog


def _last(rows: DataFrame, key: list[str], at: str) -> DataFrame:
    """One row a key: the last by ``at``, ties by the row itself."""
    others = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(at, *(c for c in others if c != at))).alias("_x")).select(*(F.col(c if c in key else f"_x.{c}").alias(c) for c in rows.columns))


class DeferredDelegations:
    """Tool calls that name an agent, answered as soon as a run of that name is known in their graph, in whichever batch it comes.

    Batches have graph_id, trace_id, run_key, agent_name, started_at and, where the row is a request of that run, target_name. A request stays
    on file after its answer: when its graph gains runs it is resolved again, so that a better candidate (same trace first, then by
    start) replaces an earlier one and the edges don't depend on how the rows were cut into batches.
    """

    def __init__(self, path: str):
        self.runs = ChangeLog(f"{path}/runs", "run_key string, graph_id string, trace_id string, agent_name string, started_at timestamp", ["run_key"])
        self.asked = ChangeLog(f"{path}/asked", "owner_key string, target_name string, graph_id string, trace_id string, from_key string", ["owner_key", "target_name"])

    def fold(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = _last(batch.where("target_name is null").select("run_key", "graph_id", "trace_id", "agent_name", "started_at"), ["run_key"], "started_at")
        self.runs.write(own, batch_id)
        touched = batch.select("graph_id").distinct()
        runs = self.runs.before(spark, batch_id + 1).join(touched, "graph_id", "left_semi")
        new = batch.where("target_name is not null").select(F.col("run_key").alias("owner_key"), "target_name", "graph_id", "trace_id").dropDuplicates(["owner_key", "target_name"])
        old = self.asked.before(spark, batch_id).join(touched, "graph_id", "left_semi")
        fresh = new.join(old, ["owner_key", "target_name"], "left_anti").withColumn("from_key", F.lit(None).cast("string"))
        asked = stored(old.withColumn("known", F.lit(True)).unionByName(fresh.withColumn("known", F.lit(False))))
        found = resolve_by_name(asked.select("graph_id", "trace_id", "owner_key", "target_name"), runs).select("owner_key", "target_name", F.col("to_key").alias("answer"))
        now = asked.join(found, ["owner_key", "target_name"], "left").where("not known or not (answer <=> from_key)")
        self.asked.write(now.withColumn("from_key", F.col("answer")), batch_id)

    def edges(self, spark: SparkSession) -> DataFrame:
        """graph_id, from_key (the run of that name), to_key (the caller), type, detection_rule."""
        return self.asked.state(spark).where("from_key is not null").select("graph_id", "from_key", F.col("owner_key").alias("to_key"), F.lit("TOOL_DELEGATION").alias("type"), F.lit("tool_target").alias("detection_rule"))

    def unresolved(self, spark: SparkSession) -> DataFrame:
        """(owner_key, target_name) that no run answers so far."""
        return self.asked.state(spark).where("from_key is null").select("owner_key", "target_name")


class Generations:
    """Graphs announced once complete, and once more for each batch in which they grow after that.

    Batches have graph_id, run_id (null in a row that says only that the graph is complete), arrival_ts and closes. Redelivered runs are
    no growth. A graph that is complete without runs is silent until some come. ``analyse`` gets the announced graphs (graph_id,
    generation, run_count, late_count, late_at), all their runs, and the number of the batch.
    """

    def __init__(self, path: str, analyse: Callable[[DataFrame, DataFrame, int], None] | None = None):
        self.runs = ChangeLog(f"{path}/runs", "graph_id long, run_id long, arrival_ts timestamp", ["graph_id", "run_id"])
        self.graphs = ChangeLog(f"{path}/graphs", "graph_id long, complete boolean, generation int, run_count long, late_count long, late_at timestamp", ["graph_id"])
        self.announced = ChangeLog(f"{path}/announced", "graph_id long, generation int, run_count long, late_count long, late_at timestamp", ["graph_id", "generation"])
        self.analyse = analyse

    def fold(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.where("run_id is not null").groupBy("graph_id", "run_id").agg(F.min("arrival_ts").alias("arrival_ts"))
        self.runs.write(rows.join(self.runs.before(spark, batch_id).select("graph_id", "run_id"), ["graph_id", "run_id"], "left_anti"), batch_id)
        grown = self.runs.changes(spark).where(F.col("_v") == batch_id).groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"), F.max("arrival_ts").alias("last_at"))
        closing = batch.groupBy("graph_id").agg(F.bool_or(F.coalesce("closes", F.lit(False))).alias("closes"))
        x = closing.join(grown, "graph_id", "left").join(self.graphs.before(spark, batch_id), "graph_id", "left")
        zero = lambda c: F.coalesce(c, F.lit(0))
        was, n = F.coalesce("complete", F.lit(False)), zero("n")
        late = was & (n > 0)
        up = (late | (~was & F.col("closes") & (zero("run_count") + n > 0))).cast("int")
        x = x.select("graph_id", (was | F.col("closes")).alias("complete"), (zero("generation") + up).cast("int").alias("generation"), (zero("run_count") + n).alias("run_count"),
                     (zero("late_count") + F.when(late, n).otherwise(0)).alias("late_count"), F.when(late, F.col("last_at")).otherwise(F.col("late_at")).alias("late_at"), (up > 0).alias("announce"))
        x = stored(x)
        self.graphs.write(x, batch_id)
        self.announced.write(x.where("announce"), batch_id)
        if self.analyse:
            told = self.announced.changes(spark).where(F.col("_v") == batch_id).drop("_v")
            self.analyse(told, self.runs.before(spark, batch_id + 1).join(told.select("graph_id"), "graph_id", "left_semi"), batch_id)


class Breakers:
    """A breaker an agent: open while ``limit`` or more distinct open incidents name it. opened_at is set as it opens and stays on file when
    it closes. Batches have agent_name, incident_id, status and at; of several rows of an incident the last counts."""

    def __init__(self, path: str, limit: int = 3):
        self.incidents = ChangeLog(f"{path}/incidents", "agent_name string, incident_id long, status string, at timestamp", ["agent_name", "incident_id"])
        self.agents = ChangeLog(f"{path}/agents", "agent_name string, state string, open_incidents long, opened_at timestamp, updated_at timestamp", ["agent_name"])
        self.signals = ChangeLog(f"{path}/signals", "agent_name string, from_state string, to_state string, at timestamp", ["agent_name", "at"])
        self.limit = limit

    def fold(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        self.incidents.write(_last(batch.select("agent_name", "incident_id", "status", "at"), ["agent_name", "incident_id"], "at"), batch_id)
        touched = batch.groupBy("agent_name").agg(F.max("at").alias("now"))
        count = self.incidents.before(spark, batch_id + 1).join(touched, "agent_name").groupBy("agent_name", "now").agg(F.count_if(F.col("status") == "open").alias("open_incidents"))
        x = count.join(self.agents.before(spark, batch_id).select("agent_name", F.col("state").alias("was"), "opened_at"), "agent_name", "left").withColumn("was", F.coalesce("was", F.lit("closed")))
        x = x.withColumn("state", F.when(F.col("open_incidents") >= self.limit, "open").otherwise("closed"))
        opens = (F.col("state") == "open") & (F.col("was") == "closed")
        x = stored(x.withColumn("opened_at", F.when(opens, F.col("now")).otherwise(F.col("opened_at"))))
        self.agents.write(x.withColumn("updated_at", F.col("now")), batch_id)
        self.signals.write(x.where("state <> was").select("agent_name", F.col("was").alias("from_state"), F.col("state").alias("to_state"), F.col("now").alias("at")), batch_id)


class Deliveries:
    """Messages handed to ``handle`` until it succeeds, with each batch anew; after more than ``most`` deliveries a message is a dead letter.

    Batches have id and payload. ``handle`` takes (id, payload, deliveries) and returns the ids that it has done. Deliveries are counted
    by batch, so a batch that is run again after a failure counts once; a message that arrives again doesn't start over.
    """

    def __init__(self, path: str, handle: Callable[[DataFrame], DataFrame], most: int = 5):
        self.messages = ChangeLog(f"{path}/messages", "id long, payload string, deliveries int, state string", ["id"])
        self.handle, self.most = handle, most

    def fold(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = self.messages.before(spark, batch_id)
        fresh = batch.select("id", "payload").groupBy("id").agg(F.min("payload").alias("payload")).join(known, "id", "left_anti")
        due = known.where("state = 'pending'").select("id", "payload", (F.col("deliveries") + 1).alias("deliveries"))
        due = stored(due.unionByName(fresh.withColumn("deliveries", F.lit(1))))
        over = due.where(F.col("deliveries") > self.most)
        done = self.handle(due.where(F.col("deliveries") <= self.most)).select("id", F.lit(True).alias("done")).distinct()
        handled = due.where(F.col("deliveries") <= self.most).join(done, "id", "left").withColumn("state", F.when(F.col("done"), "done").otherwise("pending")).drop("done")
        self.messages.write(handled.unionByName(over.withColumn("state", F.lit("dead"))), batch_id)

    def dead_letters(self, spark: SparkSession) -> DataFrame:
        """id, deliveries, payload of messages that were given up."""
        return self.messages.state(spark).where("state = 'dead'").select("id", "deliveries", "payload")


class Analysis:
    """Intake to incidents in one stream: runs are kept, graphs complete as their roots have ended or after ``gap`` without arrivals,
    complete graphs are triaged, flagged ones and ``percent`` of the others go on to deep analysis, and flagged ones raise incidents.

    Batches have graph_id, run_id, root, ended, failed (booleans), score and arrival_ts. Each step reads what the one before has
    written for this batch and writes a table of its own; all of them are keyed, so redelivered runs and repeated batches change nothing.
    """

    def __init__(self, path: str, gap: str = "30 seconds", percent: float = 10, low: float = 0.2):
        self.runs = ChangeLog(f"{path}/runs", "graph_id long, run_id long, root boolean, ended boolean, failed boolean, score double, arrival_ts timestamp", ["graph_id", "run_id"])
        self.graphs = ChangeLog(f"{path}/graphs", "graph_id long, last_at timestamp, complete string", ["graph_id"])
        self.clock = ChangeLog(f"{path}/clock", "name string, at timestamp", ["name"])
        self.triage = ChangeLog(f"{path}/triage", "graph_id long, flagged boolean, hard array<string>", ["graph_id"])
        self.deep = ChangeLog(f"{path}/deep", "graph_id long, why string", ["graph_id"])
        self.incidents = ChangeLog(f"{path}/incidents", "graph_id long, incident_key string, trigger string, is_new boolean", ["graph_id", "incident_key"])
        self.gap, self.percent, self.low = gap, percent, low

    def fold(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        now = lambda log: log.changes(spark).where(F.col("_v") == batch_id).drop("_v")
        self.runs.write(_last(batch.select(*self.runs.schema.names), ["graph_id", "run_id"], "arrival_ts"), batch_id)
        latest = batch.agg(F.max("arrival_ts").alias("at")).unionByName(self.clock.before(spark, batch_id).select("at")).agg(F.max("at").alias("at"))
        self.clock.write(latest.select(F.lit("arrivals").alias("name"), "at"), batch_id)

        # Complete: by ended roots in the touched graphs, by silence in any open one.
        touched = batch.groupBy("graph_id").agg(F.max("arrival_ts").alias("new_at"))
        known = self.graphs.before(spark, batch_id)
        facts = self.runs.before(spark, batch_id + 1, by="graph_id").groupBy("graph_id").agg(F.bool_and(F.when(F.col("root"), F.col("ended"))).alias("roots_ended"), F.bool_or("failed").alias("failed"), F.min("score").alias("worst"))
        graphs = known.join(touched, "graph_id", "full").where("complete is null").join(facts, "graph_id", "left")
        graphs = stored(graphs.withColumn("last_at", F.greatest("last_at", "new_at")).crossJoin(F.broadcast(now(self.clock).select("at"))))  # one row
        quiet = F.col("last_at") + F.expr(f"interval {self.gap}") <= F.col("at")
        graphs = graphs.withColumn("complete", F.when(F.col("roots_ended") & F.col("new_at").isNotNull(), "root_ended").when(quiet, "quiet"))
        self.graphs.write(graphs.where("new_at is not null or complete is not null"), batch_id)

        hard = F.array_compact(F.array(F.when(F.col("failed"), "run_failed"), F.when(F.col("worst") < self.low, "low_score")))
        self.triage.write(graphs.where("complete is not null").select("graph_id", hard.alias("hard")).withColumn("flagged", F.size("hard") > 0), batch_id)
        triaged = now(self.triage)
        self.deep.write(deep_worklist(triaged, self.deep.before(spark, batch_id), self.percent), batch_id)
        raised = now(self.deep).where("why = 'flagged'").join(triaged, "graph_id").select("graph_id", F.explode("hard").alias("incident_key"), F.array_join("hard", ",").alias("trigger"))
        seen = self.incidents.before(spark, batch_id).select("graph_id", "incident_key", F.lit(False).alias("is_new"))
        self.incidents.write(raised.join(seen, ["graph_id", "incident_key"], "left").withColumn("is_new", F.coalesce("is_new", F.lit(True))), batch_id)
