"""Facts that travel between runs: parameters, required sections and claims in later payloads, and what they say of a verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checks import KEY, section_present, signal


def contract_propagation(violations: DataFrame, leaves: DataFrame) -> DataFrame:
    """graph_id, key, from, to, status, basis: did a rewritten parameter reach the deliverable? propagated, corrected or unverified.

    leaves: json_leaves of the deliverables (by graph_id). Without such a parameter, a path whose extension is one of the two values decides.
    """
    params = leaves.select("graph_id", F.lower("key_name").alias("key"), F.lower("value").alias("v")).groupBy("graph_id", "key").agg(F.count_distinct("v").alias("n"), F.min("v").alias("v")).where("n = 1").drop("n")
    paths = leaves.select("graph_id", F.nullif(F.lower(F.regexp_extract("value", "\\.([A-Za-z0-9]+)$", 1)), F.lit("")).alias("ext")).where("ext is not null").groupBy("graph_id").agg(F.count_distinct("ext").alias("m"), F.min("ext").alias("ext")).where("m = 1").drop("m")
    x = violations.join(params, ["graph_id", "key"], "left").join(paths, "graph_id", "left").withColumn("seen", F.coalesce("v", "ext"))
    status = F.when(F.col("seen") == F.lower("to"), "propagated").when(F.col("seen") == F.lower("from"), "corrected").otherwise("unverified")
    return x.select("graph_id", "key", "from", "to", status.alias("status"), F.when(F.col("v").isNotNull(), "param").when(F.col("ext").isNotNull(), "path").alias("basis")).distinct()


def required_facts(runs: DataFrame, rules: DataFrame) -> DataFrame:
    """graph_id, claim, found_in, not_checkable, checked: by rule, the producers that show the section, and how many could be read.

    rules: name, match, pattern, case_sensitive; few, so broadcast. runs: agent_name, output.
    """
    both = runs.join(F.broadcast(rules.select(F.col("name").alias("claim"), "match", "pattern", F.coalesce("case_sensitive", F.lit(False)).alias("exact"))))
    hit = section_present(F.col("output"), F.col("match"), F.col("pattern"), F.col("exact"))
    return _presence(both.withColumn("hit", F.when(F.col("output").isNotNull(), hit)))


def _presence(rows: DataFrame) -> DataFrame:
    names = F.sort_array(F.collect_set(F.when(F.col("hit"), F.col("agent_name"))))
    return rows.groupBy("graph_id", "claim").agg(names.alias("found_in"), F.count_if(F.col("hit").isNull()).alias("not_checkable"), F.count("hit").alias("checked"))


def fact_propagation(claims: DataFrame, runs: DataFrame, paths: DataFrame) -> DataFrame:
    """claims (graph_id, run_id, claim) of source runs against the payloads of all runs downstream; in the input or the output, without regard to case."""
    below = claims.withColumnRenamed("run_id", "src").join(paths, ["graph_id", "src"]).select("graph_id", F.col("dst").alias("run_id"), "claim").distinct()
    x = below.join(runs.select(*KEY, "agent_name", F.lower(F.concat_ws("\n", "input", "output")).alias("t"), (F.col("input").isNull() & F.col("output").isNull()).alias("blind")), KEY)
    return _presence(x.withColumn("hit", F.when(~F.col("blind"), F.contains("t", F.lower("claim")))))


def field_drop(facts: DataFrame) -> DataFrame:
    """A warning for each claim that no payload downstream holds, though some could be read."""
    lost = facts.where("size(found_in) = 0 and checked > 0").withColumn("run_id", F.lit(None).cast("bigint"))
    return signal(lost, "structured_field_drop", "warn", "claim_absent", claim=F.col("claim"), checked=F.col("checked"))


def reconcile_evidence(reports: DataFrame, facts: DataFrame, last_producer: DataFrame) -> DataFrame:
    """graph_id, origin, weight: where a required fact stands in some payloads and not in the deliverable's, the confidence is split 60:40 between the
    reported origin and the last producer. reports: graph_id, run_id, confidence; last_producer: graph_id, run_id, agent_name."""
    split = facts.join(last_producer.select("graph_id", F.col("run_id").alias("last_run"), "agent_name"), "graph_id").where("size(found_in) > 0 and not array_contains(found_in, agent_name)").groupBy("graph_id").agg(F.min("last_run").alias("last_run"))
    x = reports.join(split, "graph_id", "left")
    rows = F.when(F.col("last_run").isNull() | (F.col("last_run") == F.col("run_id")), F.array(F.struct(F.col("run_id").alias("origin"), F.col("confidence").alias("weight")))).otherwise(
        F.array(F.struct(F.col("run_id").alias("origin"), (F.col("confidence") * 0.6).alias("weight")), F.struct(F.col("last_run").alias("origin"), (F.col("confidence") * 0.4).alias("weight"))))
    return x.select("graph_id", F.inline(rows))


def requirement_provenance(violations: DataFrame, verdicts: DataFrame) -> DataFrame:
    """graph_id, slug, key: whether the terminal reasoning names the value that a parameter was rewritten to, or the one that was asked for."""
    x = violations.join(verdicts.select("graph_id", F.lower("reasoning").alias("r")), "graph_id")
    slug = F.when(F.contains("r", F.lower("from")), "terminal_asks_for_original").when(F.contains("r", F.lower("to")), "terminal_accepts_rewrite")
    return x.select("graph_id", slug.alias("slug"), "key").where("slug is not null").distinct()


def terminal_axes(verdicts: DataFrame, flags: DataFrame, propagation: DataFrame) -> DataFrame:
    """graph_id, decided_by, contract_conformance, caveat: the content axis and the contract axis of a verdict, side by side.

    flags: graph_id, hard (array); propagation: of ``contract_propagation``.
    """
    p = propagation.groupBy("graph_id").agg(F.bool_or(F.col("status") == "propagated").alias("shipped"), F.bool_and(F.col("status") == "corrected").alias("restored"))
    x = verdicts.join(flags.select("graph_id", "hard"), "graph_id", "left").join(p, "graph_id", "left")
    hard = F.arrays_overlap("hard", F.array(F.lit("artifact_integrity_fail"), F.lit("missing_required_section")))
    form = F.when(F.col("shipped"), "shipped").when(F.col("restored"), "restored").when(F.col("shipped").isNotNull(), "unverified")
    caveat = F.when((F.col("verdict") == "ok") & F.col("shipped"), "ok_content_breached_contract").when((F.col("verdict") == "bad") & F.col("restored"), "bad_content_kept_contract")
    return x.select("graph_id", F.when(F.coalesce(hard, F.lit(False)), "deterministic").otherwise("judge").alias("decided_by"), form.alias("contract_conformance"), caveat.alias("caveat"))


def notes(runs: DataFrame, verdicts: DataFrame, signals: DataFrame) -> DataFrame:
    """graph_id, slug, n: graph-level remarks: runs that nobody scored, runs without payload, and a good end over failed checks."""
    blind = runs.groupBy("graph_id").agg(F.count_if(F.col("score").isNull()).alias("unscored"), F.count_if(F.col("unscored_reason") == "payload_missing").alias("no_payload"))
    a = blind.select("graph_id", F.inline(F.array(F.struct(F.lit("unscored_runs").alias("slug"), F.col("unscored").alias("n")), F.struct(F.lit("payload_missing").alias("slug"), F.col("no_payload").alias("n"))))).where("n > 0")
    fails = signals.where("severity = 'fail'").groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    b = verdicts.where("verdict = 'ok'").join(fails, "graph_id").select("graph_id", F.lit("verdict_conflict").alias("slug"), "n")
    return a.unionByName(b)
