"""Scores of runs, verdicts of graphs, flags, policies and breakers. Unknown stays null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.columns import clamp, degenerate, repetition_ratio, sampled

KEY = ["graph_id", "run_id"]
# Weights of the channels, the least weight without a judge, and ceilings by judge flag.
WEIGHTS = {"schema": 0.35, "judge": 0.40, "heuristics": 0.15}
FLOOR = 0.5
FLAG_CAPS = {"missing_content": 0.55, "ignored_instruction": 0.55, "factual_error": 0.45, "unverifiable": 0.60}


def heuristics(runs: DataFrame, baselines: DataFrame | None = None) -> DataFrame:
    """graph_id, run_id, heuristics: 1 minus penalties; null where nothing fired or there is no output, 0 for a blank one.

    runs may carry error_spans and retries; baselines: agent_name, metric = tokens_out, mean, std.
    """
    x = runs
    if baselines is not None:
        b = baselines.where("metric = 'tokens_out' and std > 0").select("agent_name", F.col("mean").alias("_m"), F.col("std").alias("_s"))
        x = x.join(b, "agent_name", "left").withColumn("_z", (F.col("tokens_out") - F.col("_m")) / F.col("_s"))
    else:
        x = x.withColumn("_z", F.lit(None).cast("double"))
    have = lambda c: F.col(c) if c in x.columns else F.lit(0)
    rep = repetition_ratio(F.trim("output"))
    lost = (F.when(rep > 0.5, F.least(F.lit(0.6), (rep - 0.5) * 2)).otherwise(0.0) + F.when(have("error_spans") > 0, 0.3).otherwise(0.0) + F.when(F.col("status") == "failed", 0.5).when(F.col("status") == "degraded", 0.2).otherwise(0.0)
            + F.least(F.lit(0.3), 0.1 * have("retries")) + F.when(F.abs("_z") > 3, 0.2).otherwise(0.0))
    score = F.when(F.col("output").isNull(), F.lit(None)).when(F.trim("output") == "", 0.0).when(lost > 0, clamp(1 - lost))
    return x.select(*KEY, score.alias("heuristics"))


def judged(judge: DataFrame) -> DataFrame:
    """graph_id, run_id, judge, input_flawed, flags: the judge's score in [0, 1], under the ceiling of its flags."""
    cap = reduce(F.least, (F.when(F.array_contains(F.coalesce("flags", F.array().cast("array<string>")), k), v).otherwise(1.0) for k, v in FLAG_CAPS.items()))
    return judge.select(*KEY, F.least(clamp(F.col("task_score").cast("double")), cap).alias("judge"), "input_flawed", "flags")


def composite(parts: DataFrame, weights: dict[str, float] = WEIGHTS, floor: float = FLOOR) -> DataFrame:
    """graph_id, run_id, score, effective_weights, reason from the columns schema, judge and heuristics (null: didn't report).

    The weighted mean over the channels that reported; without a judge, only where the others weigh ``floor`` or more.
    """
    there = lambda k: F.when(F.col(k).isNotNull(), F.lit(weights[k])).otherwise(0.0)
    total = reduce(lambda a, b: a + b, (there(k) for k in weights))
    mean = reduce(lambda a, b: a + b, (there(k) * F.coalesce(F.col(k), F.lit(0.0)) for k in weights)) / F.nullif(total, F.lit(0.0))
    enough = (total > 0) & (F.col("judge").isNotNull() | (total >= floor))
    used = F.map_filter(F.create_map(*(x for k in weights for x in (F.lit(k), there(k) / total))), lambda _, w: w > 0)
    return parts.select(*KEY, F.when(enough, clamp(mean)).alias("score"), F.when(enough, used).alias("effective_weights"), F.when(~enough, "insufficient_components").alias("reason"))


def unscored_reason(runs: DataFrame) -> DataFrame:
    """graph_id, run_id, reason of runs without a score; runs: output, score, zero_result, node_kind, judged."""
    why = (F.when(F.col("output").isNull(), "payload_missing").when(F.trim("output") == "", "empty_output").when(F.col("zero_result"), "zero_result_set")
           .when(F.col("node_kind").isin("deterministic", "tool"), "judge_skipped_deterministic_node").otherwise("insufficient_components"))
    return runs.where("score is null").select(*KEY, why.alias("reason"))


def all_signals(parts: list[DataFrame], runs: DataFrame, content: tuple[str, ...] = ("numeric_content_lost", "number_not_derivable", "unit_inconsistency", "language_mismatch")) -> DataFrame:
    """The union of checks; content checks don't apply to verifiers. Any DataFrame of the same columns can be added."""
    every = reduce(lambda a, b: a.unionByName(b), parts)
    return every.join(runs.where("verifier").select(*KEY, F.lit(True).alias("_v")), KEY, "left").where(F.col("_v").isNull() | ~F.col("name").isin(*content)).drop("_v")


def expected_language(leaves: DataFrame) -> DataFrame:
    """graph_id, run_id, expected_lang where the input names one language, and only one."""
    k = leaves.where(F.lower("key_name").isin("lang", "language", "locale")).select(*KEY, F.lower(F.left("value", F.lit(2))).alias("l"))
    return k.groupBy(*KEY).agg(F.count_distinct("l").alias("n"), F.min("l").alias("expected_lang")).where("n = 1").drop("n")


def judge_worklist(runs: DataFrame, originating: DataFrame) -> DataFrame:
    """Runs of graphs without a hard check that already shows where the fault began."""
    return runs.join(originating.select("graph_id").distinct(), "graph_id", "left_anti")


HARD = ["failed_runs", "cost_overrun", "loop_anomaly", "schema_violation", "degenerate_output", "artifact_integrity_fail", "missing_required_section", "terminal_form_breach", "duplicate_side_effect", "tool_args_invalid"]
SOFT = ["loop_fingerprint", "retry_storm", "cost_anomaly", "token_anomaly", "sensitive_data_exposure", "prompt_injection_signature", "uninspected_media"]


def triage_flags(runs: DataFrame, signals: DataFrame, deliverables: DataFrame, budget: float | None = None) -> DataFrame:
    """graph_id, hard, soft: flags of each graph in a fixed order; only hard ones page.

    deliverables: graph_id, run_id. One aggregation over runs and one over signals; costs that are null exceed nothing.
    """
    end = deliverables.select(*KEY, F.lit(True).alias("_d"))
    own = runs.join(end, KEY, "left").groupBy("graph_id").agg(
        F.bool_or(F.col("status") == "failed").alias("failed_runs"), (F.coalesce(F.sum("cost_usd") > budget, F.lit(False)) if budget is not None else F.lit(False)).alias("cost_overrun"),
        F.coalesce(F.bool_or(F.when(F.col("_d"), degenerate(F.col("output")))), F.lit(False)).alias("degenerate_output"))
    named = signals.groupBy("graph_id").agg(F.collect_set("name").alias("names"))
    x = own.join(named, "graph_id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    flag = lambda f: F.when(F.col(f), F.lit(f)) if f in own.columns else F.when(F.array_contains("names", f), F.lit(f))
    return x.select("graph_id", F.array_compact(F.array(*map(flag, HARD))).alias("hard"), F.array_compact(F.array(*map(flag, SOFT))).alias("soft"))


def terminal_verdict(ends: DataFrame, fails: DataFrame, judge: DataFrame) -> DataFrame:
    """graph_id, verdict (ok, bad, not_checkable), score. A hard fail on the deliverable beats the judge; a blank or opaque one can't be
    judged; a partly visible one scores 0.85 at most. ends: graph_id, run_id, output, state."""
    hard = fails.select("graph_id", F.lit(True).alias("_f")).distinct()
    x = ends.join(hard, "graph_id", "left").join(judge.select("graph_id", F.col("verdict").alias("_v"), F.col("score").alias("_s")), "graph_id", "left")
    shown = F.col("output").isNotNull() & (F.trim("output") != "") & (F.col("state") != "opaque")
    verdict = F.when(F.col("_f"), "bad").when(~shown | F.col("_v").isNull(), "not_checkable").otherwise(F.col("_v"))
    score = F.when(F.col("_f"), 0.0).when(shown, F.when(F.col("state") == "partial", F.least(F.col("_s"), F.lit(0.85))).otherwise(F.col("_s")))
    return x.select("graph_id", verdict.alias("verdict"), score.alias("score"))


def stale_verdicts(verdicts: DataFrame, fails: DataFrame, fingerprint: str) -> DataFrame:
    """graph_id, stale, cause: bad verdicts by a hard check that no longer fails; by what changed. verdicts: verdict, deterministic, rules_hash."""
    again = fails.select("graph_id", F.lit(True).alias("_f")).distinct()
    x = verdicts.join(again, "graph_id", "left")
    stale = (F.col("verdict") == "bad") & F.col("deterministic") & F.col("_f").isNull()
    cause = F.when(F.col("rules_hash").isNull(), "unstamped").when(F.col("rules_hash") != fingerprint, "rules_changed").otherwise("payload_diverged")
    return x.select("graph_id", stale.alias("stale"), F.when(stale, cause).alias("cause"))


def evaluate_policies(facts: DataFrame, policies: DataFrame) -> DataFrame:
    """graph_id, policy, decision, detail for every rule that fires on a graph. Rules are few and broadcast.

    facts: graph_id, flags, signals, report_type, cost, min_score; policies: name, predicate (JSON), action, enabled.
    """
    kind = "struct<flags_any:array<string>,signals_any:array<string>,report_types_any:array<string>,cost_over:double,score_below:double>"
    p = policies.where("enabled").select(F.col("name").alias("policy"), "action", F.from_json("predicate", kind).alias("p")).where("p is not null")
    x = facts.join(F.broadcast(p))
    hit = lambda c, name: F.array_intersect(F.col(f"p.{name}"), F.col(c))
    parts = [F.when(F.size(hit("flags", "flags_any")) > 0, F.concat(F.lit("flags_any: "), F.array_join(hit("flags", "flags_any"), ", "))),
             F.when(F.size(hit("signals", "signals_any")) > 0, F.concat(F.lit("signals_any: "), F.array_join(hit("signals", "signals_any"), ", "))),
             F.when(F.array_contains("p.report_types_any", F.col("report_type")), F.concat(F.lit("report_types_any: "), F.col("report_type"))),
             F.when(F.col("cost") > F.col("p.cost_over"), F.lit("cost_over")), F.when(F.col("min_score") < F.col("p.score_below"), F.lit("score_below"))]
    fired = F.array_compact(F.array(*parts))
    return x.withColumn("fired", fired).where("size(fired) > 0").select("graph_id", "policy", F.when(F.col("action") == "block", "would_block").otherwise("would_warn").alias("decision"), F.array_join("fired", "; ").alias("detail"))


def breakers(incidents: DataFrame, reports: DataFrame, runs: DataFrame, limit: int = 3) -> DataFrame:
    """agent_name, open_incidents, state: open where ``limit`` or more distinct open incidents name the agent's runs as culprits."""
    culprits = incidents.where("status = 'open'").join(reports.where("is_latest"), ["incident_id", "graph_id"]).select("incident_id", "graph_id", F.explode("culprit_run_ids").alias("run_id"))
    count = culprits.join(runs.select(*KEY, "agent_name"), KEY).groupBy("agent_name").agg(F.count_distinct("incident_id").alias("open_incidents"))
    return count.withColumn("state", F.when(F.col("open_incidents") >= limit, "open").otherwise("closed"))


def deep_worklist(verdicts: DataFrame, done: DataFrame, percent: float) -> DataFrame:
    """Graphs to analyse in depth: flagged ones, and a fixed sample of the others; those done before are left out."""
    pick = F.when(F.col("flagged"), "flagged").when(sampled(F.col("graph_id").cast("string"), percent), "sampled")
    return verdicts.select("graph_id", pick.alias("why")).where("why is not null").dropDuplicates(["graph_id"]).join(done.select("graph_id"), "graph_id", "left_anti")


def newest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    w = W.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
