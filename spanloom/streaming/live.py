"""Structured Streaming: intake, finalisation, late data, baselines, routing.

State is kept by Spark's own operators (deduplication within a watermark, session windows, aggregations); what needs tables
goes through foreachBatch, keyed by batch, so that a repeated batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.reports import baselines, merge_baselines


def stream_spans(spark: SparkSession, path: str, schema: StructType, key: list[str], arrival: str, lateness: str = "10 minutes") -> DataFrame:
    """A folder of Parquet files as a stream; redelivered rows (same ``key``) within the watermark are dropped."""
    return spark.readStream.schema(schema).parquet(path).withWatermark(arrival, lateness).dropDuplicatesWithinWatermark(key)


def finalize_quiet(stream: DataFrame, graph: str, arrival: str, gap: str = "30 seconds") -> DataFrame:
    """A row for each graph whose arrivals paused for ``gap``: graph, first and last arrival, rows. The session closes when the
    watermark passes its end, so the stream must carry a watermark on ``arrival``."""
    w = F.session_window(arrival, gap)
    return stream.groupBy(graph, w).agg(F.count(F.lit(1)).alias("n"), F.min(arrival).alias("first_at"), F.max(arrival).alias("last_at")).drop("session_window")


def finalize_root_ended(batch: DataFrame, runs: DataFrame, edges: DataFrame, graphs: DataFrame) -> DataFrame:
    """Graphs touched by a micro-batch whose roots have all ended."""
    from ..operators.reports import ended_roots

    return ended_roots(graphs, runs, edges).join(batch.select("graph_id").distinct(), "graph_id", "left_semi")


def emit_once(batch: DataFrame, completed: DataFrame) -> DataFrame:
    """Completed graphs of a batch that weren't emitted before; empty ones (n = 0) stay silent."""
    return batch.where("n > 0").dropDuplicates(["graph_id"]).join(completed.select("graph_id"), "graph_id", "left_anti")


def late_runs(batch: DataFrame, stored: DataFrame, completed: DataFrame) -> DataFrame:
    """graph_id, late_count, last_at of truly new runs of graphs that were completed before."""
    new = batch.join(stored.select("graph_id", "run_id"), ["graph_id", "run_id"], "left_anti").join(completed.select("graph_id"), "graph_id", "left_semi")
    return new.groupBy("graph_id").agg(F.count(F.lit(1)).alias("late_count"), F.max("arrival_ts").alias("last_at"))


def route(completed: DataFrame, flags: DataFrame, percent: float) -> tuple[DataFrame, DataFrame]:
    """Triage rows of completed graphs, and those of them that go on to deep analysis."""
    from ..operators.scoring import deep_worklist

    triage = completed.join(flags, "graph_id", "left").withColumn("flagged", F.coalesce(F.size("hard") > 0, F.lit(False)))
    return triage, deep_worklist(triage, triage.where("false"), percent)


def quarantine(stream: DataFrame, payload: str, parsed: str) -> tuple[DataFrame, DataFrame]:
    """Rows that parsed, and dead letters (payload, error)."""
    return stream.where(F.col(parsed).isNotNull()), stream.where(F.col(parsed).isNull()).select(F.col(payload).alias("payload"), F.lit("not_parsed").alias("error"))


def control_signals(before: DataFrame, after: DataFrame) -> DataFrame:
    """Transitions of breakers between two snapshots (agent_name, state)."""
    x = after.select("agent_name", "state").join(before.select("agent_name", F.col("state").alias("was")), "agent_name", "left")
    return x.where("not (state <=> was)").select("agent_name", F.coalesce("was", F.lit("closed")).alias("from_state"), F.col("state").alias("to_state")).where("from_state <> to_state")


def new_incidents(changes: DataFrame) -> DataFrame:
    return changes.where("is_new").select("graph_id", "incident_key", "trigger")


def merging_baselines(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that folds each batch of completed runs into the table of baselines: one snapshot a batch, so that a batch
    that is run again writes the same snapshot again."""

    def fold(batch: DataFrame, batch_id: int) -> None:
        own = baselines(batch)
        old = batch.sparkSession.read.schema(own.schema).parquet(f"{path}/v={batch_id - 1}") if batch_id else None
        (own if old is None else merge_baselines(old, own)).write.mode("overwrite").parquet(f"{path}/v={batch_id}")

    return fold


def _earlier(own: DataFrame, path: str, batch_id: int) -> DataFrame:
    """What the batches before this one wrote below ``path``; a batch that is run again doesn't see its own rows."""
    spark = own.sparkSession
    return spark.read.schema(StructType([*own.schema.fields, StructField("v", LongType())])).parquet(path).where(F.col("v") < batch_id).drop("v") if batch_id else own.where("false")


def emitting_once(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes each batch's completed graphs (graph_id, n) that no batch before has emitted."""

    def emit(batch: DataFrame, batch_id: int) -> None:
        ids = batch.select("graph_id", "n")
        emit_once(ids, _earlier(ids, path, batch_id)).write.mode("overwrite").parquet(f"{path}/v={batch_id}")

    return emit


def collecting_late(path: str, stored: DataFrame, completed: DataFrame) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps each batch's runs (graph_id, run_id, arrival_ts) of completed graphs; a run that is delivered again,
    in this batch or a later one, isn't new. ``late_runs`` counts them."""

    def collect(batch: DataFrame, batch_id: int) -> None:
        new = batch.select("graph_id", "run_id", "arrival_ts").groupBy("graph_id", "run_id").agg(F.min("arrival_ts").alias("arrival_ts"))
        new = new.join(completed.select("graph_id"), "graph_id", "left_semi").join(stored.select("graph_id", "run_id"), ["graph_id", "run_id"], "left_anti")
        new.join(_earlier(new, path, batch_id), ["graph_id", "run_id"], "left_anti").write.mode("overwrite").parquet(f"{path}/v={batch_id}")

    return collect


def drain_batches(stream: DataFrame, path: str, each: Callable[[DataFrame, int], None]) -> None:
    """Runs a stream over all that is there, batch by batch."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def drain(stream: DataFrame, path: str) -> None:
    """Runs a stream in append mode over all that is there into Parquet at ``path``."""
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
