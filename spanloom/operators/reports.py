"""Summary queries and governed tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions.columns import wilson
from ..functions.jsonview import json_leaves

KEY = ["graph_id", "run_id"]


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of rows: a top-k with offset."""
    return df.orderBy(*order).offset(offset).limit(limit)


def incident_inbox(incidents: DataFrame, reports: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    latest = reports.where("is_latest").select("incident_id", "report_type", "confidence", "culprit_run_ids")
    return page(incidents.join(latest, "incident_id", "left"), [F.col("created_at").desc(), F.col("incident_id")], limit, offset)


def graph_list(graphs: DataFrame, runs: DataFrame) -> DataFrame:
    """Graphs with their number of priced runs: the counts are made first, then joined."""
    priced = runs.groupBy("graph_id").agg(F.count("cost_usd").alias("priced_runs"))
    return graphs.join(priced, "graph_id", "left").withColumn("priced_runs", F.coalesce("priced_runs", F.lit(0)))


def ended_roots(graphs: DataFrame, runs: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id of active graphs whose runs without incoming edges have all ended."""
    roots = runs.join(edges.select("graph_id", F.col("to_run_id").alias("run_id")), KEY, "left_anti").join(graphs.where("status = 'active'").select("graph_id"), "graph_id", "left_semi")
    return roots.groupBy("graph_id").agg(F.bool_and(F.col("ended_at").isNotNull()).alias("ended")).where("ended").select("graph_id")


def graph_activity(graphs: DataFrame, runs: DataFrame) -> DataFrame:
    last = runs.groupBy("graph_id").agg(F.max(F.greatest("started_at", "ended_at")).alias("last_activity"))
    return graphs.select("graph_id").join(last, "graph_id", "left")


def last_clean(graphs: DataFrame, incidents: DataFrame) -> DataFrame:
    """graph_id, baseline_graph_id: the last graph of the same type that finished before it and has no incident; one window a type."""
    bad = incidents.select("graph_id", F.lit(True).alias("bad")).distinct()
    g = graphs.where("finalized_at is not null").join(bad, "graph_id", "left")
    w = W.partitionBy("graph_type").orderBy("finalized_at", "graph_id").rowsBetween(W.unboundedPreceding, -1)
    return g.select("graph_id", F.last(F.when(F.col("bad").isNull(), F.col("graph_id")), ignorenulls=True).over(w).alias("baseline_graph_id"))


def open_incidents_by_agent(incidents: DataFrame, reports: DataFrame, runs: DataFrame) -> DataFrame:
    culprits = incidents.where("status = 'open'").join(reports.where("is_latest").select("incident_id", "culprit_run_ids"), "incident_id").select("incident_id", "graph_id", F.explode("culprit_run_ids").alias("run_id"))
    return culprits.join(runs.select(*KEY, "agent_name"), KEY).groupBy("agent_name").agg(F.count_distinct("incident_id").alias("n"))


def verdicts_of_version(verdicts: DataFrame, runs: DataFrame, agent: str, version: str) -> DataFrame:
    return verdicts.join(runs.where((F.col("agent_name") == agent) & (F.col("agent_version") == version)).select("graph_id"), "graph_id", "left_semi")


def _board() -> list[Column]:
    return [F.sum("cost_usd").alias("total_cost"), F.count(F.lit(1)).alias("runs"), F.count("cost_usd").alias("priced_runs"), (F.count_if(F.col("status") == "failed") / F.count(F.lit(1))).alias("failure_rate"), F.avg("score").alias("avg_score")]


def leaderboard(runs: DataFrame) -> DataFrame:
    return runs.groupBy("agent_name").agg(*_board())


def leaderboard_by_version(runs: DataFrame) -> DataFrame:
    return runs.groupBy("agent_name", "agent_version", "model_name", "prompt_hash").agg(*_board())


def version_compare(runs: DataFrame, verdicts: DataFrame, incidents: DataFrame) -> DataFrame:
    """By agent and version: runs, graphs, mean score, share of judged graphs that are flagged or end badly, incidents; null where nothing was judged."""
    g = runs.groupBy("agent_name", "agent_version").agg(F.count(F.lit(1)).alias("runs"), F.count_distinct("graph_id").alias("graphs"), F.avg("score").alias("avg_score"))
    of = runs.select("agent_name", "agent_version", "graph_id").distinct()
    v = of.join(verdicts.select("graph_id", "verdict", "flagged"), "graph_id").groupBy("agent_name", "agent_version").agg(F.count(F.lit(1)).alias("judged"), F.count_if("flagged").alias("f"), F.count_if(F.col("verdict") == "bad").alias("b"))
    i = of.join(incidents.select("graph_id", "incident_id"), "graph_id").groupBy("agent_name", "agent_version").agg(F.count_distinct("incident_id").alias("incidents"))
    x = g.join(v, ["agent_name", "agent_version"], "left").join(i, ["agent_name", "agent_version"], "left")
    return x.select("agent_name", "agent_version", "runs", "graphs", "avg_score", F.coalesce("judged", F.lit(0)).alias("judged"), F.try_divide("f", "judged").alias("flag_rate"), F.try_divide("b", "judged").alias("bad_rate"), F.coalesce("incidents", F.lit(0)).alias("incidents"))


def suggest_schema(runs: DataFrame, least: int = 5, newest_runs: int = 100) -> DataFrame:
    """By agent and key of its newest JSON outputs: type, whether every output has it, whether it may be null, and why a key is refused."""
    recent = runs.where(F.schema_of_variant(F.try_parse_json("output")).startswith("OBJECT"))
    recent = recent.withColumn("_n", F.row_number().over(W.partitionBy("agent_name").orderBy(F.col("started_at").desc(), "graph_id", "run_id"))).where(F.col("_n") <= newest_runs)
    total = recent.groupBy("agent_name").agg(F.count(F.lit(1)).alias("samples")).where(F.col("samples") >= least)
    keys = recent.select("agent_name", F.explode(F.try_variant_get(F.try_parse_json("output"), "$", "map<string,variant>")).alias("key", "v"))
    t = F.schema_of_variant("v")
    kind = F.when(t.rlike("^(BIGINT|INT|SMALLINT|TINYINT)"), "integer").when(t.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "number").when(t == "STRING", "string").when(t == "BOOLEAN", "boolean").when(t.startswith("OBJECT"), "object").when(t.startswith("ARRAY"), "array").otherwise("null")
    g = keys.groupBy("agent_name", "key").agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.nullif(kind, F.lit("null"))).alias("types"), F.bool_or(kind == "null").alias("nullable")).join(total, "agent_name")
    types = F.when(F.size(F.array_except("types", F.array(F.lit("integer"), F.lit("number")))) == 0, F.when(F.array_contains("types", "number"), "number").otherwise(F.when(F.size("types") > 0, "integer")))
    return g.select("agent_name", "key", F.coalesce(types, F.when(F.size("types") == 1, F.element_at("types", 1))).alias("type"), (F.col("n") == F.col("samples")).alias("required"), "nullable",
                    F.when((F.size("types") > 1) & types.isNull(), "mixed_types").alias("reason"))


ENFORCED = ["type", "required", "properties", "items", "enum"]


def check_contract(contracts: DataFrame) -> DataFrame:
    """agent_name, ord, ignored: keywords of a contract that no check enforces; problems: it isn't a JSON object."""
    leaves = json_leaves(contracts, ["agent_name", "ord"], "json_schema").where("key_name not like '[%'").select("agent_name", "ord", F.explode(F.slice(F.split(F.concat_ws(".", "parent_path", "key_name"), "\\."), 2, 1)).alias("k")).distinct()
    ignored = leaves.where(~F.col("k").isin(*ENFORCED) & (F.col("k") != "$")).groupBy("agent_name", "ord").agg(F.sort_array(F.collect_set("k")).alias("ignored"))
    x = contracts.join(ignored, ["agent_name", "ord"], "left")
    bad = ~F.coalesce(F.schema_of_variant(F.try_parse_json("json_schema")).startswith("OBJECT"), F.lit(False))
    return x.select("agent_name", "ord", F.array_join(F.coalesce("ignored", F.array().cast("array<string>")), ",").alias("ignored"), F.when(bad, "not_an_object").alias("problems"))


def replace_contract(contracts: DataFrame, new: DataFrame) -> DataFrame:
    return contracts.join(new.select("agent_name", "version_glob"), ["agent_name", "version_glob"], "left_anti").unionByName(new)


def calibration(labels: DataFrame, verdicts: DataFrame) -> DataFrame:
    """By prompt and model: labels, agreements, precision and recall of bad. A missing verdict counts against recall; rates without denominator are null."""
    x = labels.join(verdicts.select("graph_id", "verdict", "prompt_hash", "model"), "graph_id", "left")
    bad, said = F.col("label") == "bad", F.coalesce(F.col("verdict") == "bad", F.lit(False))
    g = x.groupBy("prompt_hash", "model").agg(F.count(F.lit(1)).alias("labels"), F.count_if(F.col("label") == F.col("verdict")).alias("agreements"), F.count_if(bad & said).alias("tp"), F.count_if(said).alias("p"), F.count_if(bad).alias("b"))
    return g.select("prompt_hash", "model", "labels", "agreements", F.try_divide("tp", "p").alias("precision_bad"), F.try_divide("tp", "b").alias("recall_bad"))


IDENTITY = ["agent_version", "model_name", "prompt_hash"]


def version_diff(runs: DataFrame, pairs: DataFrame) -> DataFrame:
    """graph_id, agent_name, changed: what differs in the agents' latest identity against the baseline graph; null is a value here."""
    latest = runs.groupBy("graph_id", "agent_name").agg(F.max_by(F.struct(*IDENTITY), F.struct("started_at", "run_id")).alias("i"))
    now = pairs.select("graph_id", "baseline_graph_id").join(latest, "graph_id")
    old = latest.select(F.col("graph_id").alias("baseline_graph_id"), "agent_name", F.col("i").alias("o"))
    x = now.join(old, ["baseline_graph_id", "agent_name"])
    changed = F.array_compact(F.array(*(F.when(~F.col(f"i.{c}").eqNullSafe(F.col(f"o.{c}")), F.lit(c)) for c in IDENTITY)))
    return x.select("graph_id", "agent_name", F.array_join(changed, ",").alias("changed")).where("changed <> ''")


def baselines(runs: DataFrame, metrics: tuple[str, ...] = ("tokens_out", "cost_usd")) -> DataFrame:
    """agent_name, graph_type, metric, n, mean, m2, std: with a count of its own for each metric."""
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics))
    x = runs.select("agent_name", "graph_type", F.explode(pairs).alias("p")).where("p.x is not null")
    g = x.groupBy("agent_name", "graph_type", "p.metric").agg(F.count(F.lit(1)).alias("n"), F.avg("p.x").alias("mean"), F.var_pop("p.x").alias("v"), F.stddev_samp("p.x").alias("std"))
    return g.select("agent_name", "graph_type", "metric", "n", "mean", (F.col("v") * F.col("n")).alias("m2"), "std")


def merge_baselines(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two tables of baselines as one (Chan's formula)."""
    key = ["agent_name", "graph_type", "metric"]
    left, right = a.select(*key, *(F.col(c).alias(f"{c}1") for c in ("n", "mean", "m2"))), b.select(*key, *(F.col(c).alias(f"{c}2") for c in ("n", "mean", "m2")))
    x = left.join(right, key, "full").na.fill(0, ["n1", "n2", "mean1", "mean2", "m21", "m22"])
    n, d = F.col("n1") + F.col("n2"), F.col("mean2") - F.col("mean1")
    m2 = F.col("m21") + F.col("m22") + d * d * F.col("n1") * F.col("n2") / n
    return x.select(*key, n.alias("n"), (F.col("mean1") + d * F.col("n2") / n).alias("mean"), m2.alias("m2"), F.when(n > 1, F.sqrt(m2 / (n - 1))).alias("std"))


def upsert_incidents(incidents: DataFrame, new: DataFrame) -> DataFrame:
    """Incidents after new ones (graph_id, incident_key, trigger, at): resolved or superseded ones open again, acknowledged ones stay, other
    live ones of the graph are superseded; with is_new."""
    key = ["graph_id", "incident_key"]
    x = incidents.withColumn("_old", F.lit(True)).join(new.select(*key, F.col("trigger").alias("_t"), F.col("at").alias("_at"), F.lit(True).alias("_new")), key, "full")
    touched = new.select("graph_id", F.lit(True).alias("_g")).distinct()
    x = x.join(touched, "graph_id", "left")
    status = (F.when(F.col("_old").isNull(), "open").when(F.col("_new") & F.col("status").isin("resolved", "superseded"), "open").when(F.col("_new"), F.col("status"))
              .when(F.col("_g") & F.col("status").isin("open", "acknowledged"), "superseded").otherwise(F.col("status")))
    return x.select("graph_id", "incident_key", F.coalesce("trigger", "_t").alias("trigger"), status.alias("status"), F.coalesce("created_at", "_at").alias("created_at"), F.coalesce("_at", "updated_at").alias("updated_at"),
                    (F.col("_old").isNull() | (F.coalesce("_new", F.lit(False)) & F.col("status").isin("resolved", "superseded"))).alias("is_new"))


def version_reports(reports: DataFrame, new: DataFrame) -> DataFrame:
    """Reports with new ones appended as the next versions of their incident, in order of ``at``; one latest each."""
    top = reports.groupBy("incident_id").agg(F.max("version").alias("_v"))
    order = F.row_number().over(W.partitionBy("incident_id").orderBy("at", "report_id"))
    add = new.join(top, "incident_id", "left").withColumn("version", (F.coalesce("_v", F.lit(0)) + order).cast("int")).drop("_v")
    both = reports.drop("is_latest").unionByName(add.select(*(c for c in reports.columns if c != "is_latest")))
    return both.withColumn("is_latest", F.col("version") == F.max("version").over(W.partitionBy("incident_id")))


def hmac_sha256(text: Column, key: str) -> Column:
    """HMAC by two plain hashes over padded keys."""
    raw = key.encode()
    if len(raw) > 64:
        import hashlib

        raw = hashlib.sha256(raw).digest()
    raw = raw.ljust(64, b"\0")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in raw).hex()))
    return F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), text.cast("binary")), 256))), 256)


def evidence_sha(evidence: Column) -> Column:
    return F.sha2(evidence, 256)


def append_ledger(tail: str, start: int, reports: DataFrame, key: str) -> DataFrame:
    """Ledger rows of one batch of reports (report_id, evidence) in order of report_id, chained on ``tail``.

    A chain can't be cut into parts that are made apart, as every hash takes in the one before. What is sorted into the one task that
    makes it is two short columns; it keeps the last hash only, and signatures are made by other tasks. A row takes some microseconds.
    """
    each = reports.select("report_id", evidence_sha(F.col("evidence")).alias("evidence_sha256")).repartition(1).sortWithinPartitions("report_id")
    fields = T.StructType([T.StructField("id", T.LongType()), each.schema["report_id"], *(T.StructField(c, T.StringType()) for c in ("evidence_sha256", "prev_hash", "chain_hash"))])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = tail, start
        for rows in parts:
            hashes = [last]
            for evidence in rows.column(1).to_pylist():
                hashes.append(hashlib.sha256((hashes[-1] + evidence).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(range(at, at + rows.num_rows), pa.int64()), rows.column(0), rows.column(1), pa.array(hashes[:-1], pa.string()), pa.array(hashes[1:], pa.string())], names=fields.names)
            last, at = hashes[-1], at + rows.num_rows

    parts = int(reports.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return each.mapInArrow(run, fields).repartition(parts, "id").withColumn("hmac_sig", hmac_sha256(F.col("chain_hash"), key))


def verify_ledger(ledger: DataFrame, reports: DataFrame, key: str) -> DataFrame:
    """report_id, found, valid, detail. Every row is checked by itself against the row before it; a report is valid if no row up to its own is bad.

    Only (id, hashes) are ordered, in ranges by id: the first bad id is one aggregate.
    """
    x = ledger.join(reports.select("report_id", evidence_sha(F.col("evidence")).alias("now")), "report_id", "left")
    before = ledger.select((F.col("id") + 1).alias("id"), F.col("chain_hash").alias("before"))
    x = x.join(before, "id", "left")
    why = (F.when(F.col("before").isNotNull() & (F.col("before") != F.col("prev_hash")), "broken_link").when(F.sha2(F.concat("prev_hash", "evidence_sha256"), 256) != F.col("chain_hash"), "chain_hash_differs")
           .when(F.col("now").isNotNull() & (F.col("now") != F.col("evidence_sha256")), "evidence_differs"))
    checked = x.withColumn("why", why).withColumn("signed", F.col("hmac_sig") == hmac_sha256(F.col("chain_hash"), key))
    first = checked.where("why is not null").agg(F.min("id").alias("bad"), F.min_by("why", "id").alias("bad_why"))
    last = checked.groupBy("report_id").agg(F.max("id").alias("id"), F.max_by("signed", "id").alias("signed"))
    out = reports.select("report_id").join(last, "report_id", "left").join(F.broadcast(first))
    valid = F.col("id").isNotNull() & (F.col("bad").isNull() | (F.col("bad") > F.col("id"))) & F.coalesce("signed", F.lit(False))
    return out.select("report_id", F.col("id").isNotNull().alias("found"), valid.alias("valid"), F.when(F.col("id").isNull(), "not_found").when(F.col("bad") <= F.col("id"), F.col("bad_why")).when(~F.col("signed"), "signature_differs").alias("detail"))


def live_verdict(graphs: DataFrame, incidents: DataFrame, reports: DataFrame) -> DataFrame:
    """graph_id, badge: the newest incident that isn't superseded (else the newest), its report type; without any, passed or unanalysed."""
    top = incidents.groupBy("graph_id").agg(F.max_by("incident_id", F.struct(F.col("status") != "superseded", "updated_at", "incident_id")).alias("incident_id"))
    x = graphs.select("graph_id", "status").join(top, "graph_id", "left").join(reports.where("is_latest").select("incident_id", "report_type"), "incident_id", "left")
    return x.select("graph_id", F.when(F.col("incident_id").isNotNull(), F.coalesce("report_type", F.lit("incident"))).when(F.col("status") == "active", "unanalysed").otherwise("passed").alias("badge"))


def sum_with_coverage(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.sum(column).alias("total"), F.count(column).alias("priced"), F.count(F.lit(1)).alias("total_runs"))


def latest_status(events: DataFrame) -> DataFrame:
    """The status of each incident from an append-only table of changes."""
    return events.groupBy("incident_id").agg(F.max_by("status", F.struct("at", "status")).alias("status"))


def judge_spend(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """By graph: calls, priced and unpriced, tokens, cost (null if none has a price), models. prices: model, prompt_price, completion_price."""
    x = calls.join(F.broadcast(prices), "model", "left")
    cost = F.coalesce("reported_cost", F.col("prompt_tokens") * F.col("prompt_price") + F.col("completion_tokens") * F.col("completion_price"))
    return x.withColumn("c", cost).groupBy("graph_id").agg(F.count(F.lit(1)).alias("calls"), F.count("c").alias("priced"), F.count_if(F.col("c").isNull()).alias("unpriced"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"), F.sum("c").alias("cost"), F.array_join(F.sort_array(F.collect_set("model")), ",").alias("models"))


def node_states(runs: DataFrame, threshold: float = 0.5) -> DataFrame:
    state = F.when(F.col("status") == "failed", "failed").when(F.col("score").isNull(), "unscored").when(F.col("score") < threshold, "degraded").otherwise("healthy")
    return runs.withColumn("state", state).groupBy("graph_id", "state").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("score").isNotNull()).alias("measured"))


def span_census(spans: DataFrame, kind: str) -> DataFrame:
    return spans.groupBy(F.upper(F.coalesce(kind, F.lit("no-kind"))).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def trace_quality(runs: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, check, level (ok, warn, gap), n, total: what a trace carries, by check. One aggregation a table."""
    g = runs.groupBy("graph_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce("agent_name", F.lit("")) != "").alias("names"), F.count_if(F.coalesce("output", F.lit("")) != "").alias("payloads"), F.count("status").alias("statuses"),
                                     F.count("cost_usd").alias("costs"), F.count("tokens_out").alias("tokens"), F.count("model_name").alias("models"), F.count("score").alias("scores"))
    linked = edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("edges"))
    g = g.join(linked, "graph_id", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))
    checks = [("names", "gap"), ("payloads", "gap"), ("statuses", "warn"), ("costs", "warn"), ("tokens", "warn"), ("models", "warn"), ("scores", "warn")]
    rows = [F.struct(F.lit(c).alias("check"), F.when(F.col(c) == F.col("total"), "ok").when(F.col(c) > 0, "warn").otherwise(worst).alias("level"), F.col(c).alias("n")) for c, worst in checks]
    rows.append(F.struct(F.lit("edges").alias("check"), F.when((F.col("edges") > 0) | (F.col("total") == 1), "ok").otherwise("gap").alias("level"), F.col("edges").alias("n")))
    return g.select("graph_id", F.explode(F.array(*rows)).alias("r"), "total").select("graph_id", "r.check", "r.level", "r.n", "total")


def claims(quality: DataFrame) -> DataFrame:
    """graph_id, claim, holds (true, false or null for unknown): can faults be placed, costs be summed, the end be judged?"""
    at = lambda check, level: F.bool_or((F.col("check") == check) & (F.col("level") == level))
    g = quality.groupBy("graph_id").agg(at("edges", "gap").alias("no_edges"), at("names", "gap").alias("no_names"), at("scores", "ok").alias("all_scores"), at("costs", "ok").alias("all_costs"), (at("costs", "warn") & F.bool_or((F.col("check") == "costs") & (F.col("n") == 0))).alias("no_costs"), at("payloads", "gap").alias("no_payloads"))
    rows = F.array(F.struct(F.lit("localisation").alias("claim"), F.when(F.col("no_edges") | F.col("no_names"), False).when(F.col("all_scores"), True).alias("holds")),
                   F.struct(F.lit("cost").alias("claim"), F.when(F.col("all_costs"), True).when(F.col("no_costs"), False).alias("holds")),
                   F.struct(F.lit("terminal").alias("claim"), F.when(F.col("no_payloads"), False).otherwise(True).alias("holds")))
    return g.select("graph_id", F.explode(rows).alias("r")).select("graph_id", "r.claim", "r.holds")


def determinism(rounds: DataFrame, threshold: float = 0.5, band: float = 0.1) -> DataFrame:
    """By run over repeats (column round): mean, deviation, least and greatest score, whether it crosses the threshold, and whether the mean
    is so near it that it may (flip_risk)."""
    return rounds.groupBy(*KEY).agg(F.count(F.lit(1)).alias("rounds"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.min("score").alias("lo"), F.max("score").alias("hi"),
                                    ((F.min("score") < threshold) & (F.max("score") >= threshold)).alias("flips"), (F.abs(F.avg("score") - threshold) <= band + 1e-9).alias("flip_risk"))


# Fixed value: the report type of a round that gave no report.
NO_REPORT = "no_report"


def verdict_determinism(rounds: DataFrame) -> DataFrame:
    """By graph over repeats (graph_id, round, report_type, culprits): rounds, no_report_rounds, inconclusive (no round gave a report), stable
    (all gave one verdict), distribution (verdict to number of rounds), and the set of culprits that came most often (the one that came
    first among equals) with its share and the number of sets. A verdict is a report type with its culprits, in order."""
    culprits = F.array_sort(F.array_distinct(F.coalesce("culprits", F.array().cast("array<string>"))))
    r = rounds.select("graph_id", "round", "report_type", culprits.alias("culprits"))
    name = F.concat(F.coalesce("report_type", F.lit("None")), F.lit("|culprits="), F.when(F.size("culprits") > 0, F.array_join("culprits", ",")).otherwise("-"))
    total = r.groupBy("graph_id").agg(F.count(F.lit(1)).alias("rounds"), F.count_if(F.col("report_type") == NO_REPORT).alias("no_report_rounds"))
    kinds = r.groupBy("graph_id", name.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))
    kinds = kinds.groupBy("graph_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("verdict", "n")))).alias("distribution"))
    sets = r.groupBy("graph_id", "culprits").agg(F.count(F.lit(1)).alias("n"), F.min("round").alias("first"))
    modal = sets.groupBy("graph_id").agg(F.max_by(F.struct("culprits", "n"), F.struct("n", -F.col("first"))).alias("m"), F.count(F.lit(1)).alias("distinct_sets"))
    x = total.join(kinds, "graph_id").join(modal, "graph_id").withColumn("inconclusive", F.col("no_report_rounds") == F.col("rounds"))
    return x.select("graph_id", "rounds", "no_report_rounds", "inconclusive", (~F.col("inconclusive") & (F.size("distribution") == 1)).alias("stable"), "distribution",
                    F.col("m.culprits").alias("modal_culprits"), (F.col("m.n") / F.col("rounds")).alias("modal_fraction"), "distinct_sets")


def cell_rates(verdicts: DataFrame, cells: DataFrame) -> DataFrame:
    """By cell over its repeats: incident (share with an incident), differs (of faulted cells whose topology has controls: share whose report type
    isn't the most common one among these controls' rounds, the least among equals), hit (where the origin is known: share that names it)
    and unstable. verdicts: cell, incident, report_type, culprits; cells: cell, topology, control, faulted, origin."""
    v = verdicts.join(cells, "cell")
    count = v.where("control").groupBy("topology", "report_type").agg(F.count(F.lit(1)).alias("k"))
    most = count.groupBy("topology").agg(F.max("k").alias("k"))
    base = count.join(most, ["topology", "k"]).groupBy("topology").agg(F.min("report_type").alias("base"), F.lit(True).alias("has_controls"))  # null (clean) only if no other is as common
    v = v.join(base, "topology", "left")
    share = lambda test: F.avg(test.cast("int"))
    return v.groupBy("cell", "topology", "control", "faulted", "origin").agg(
        share(F.col("incident")).alias("incident"), share(F.when(F.col("faulted") & F.col("has_controls"), ~F.col("report_type").eqNullSafe(F.col("base")))).alias("differs"),
        share(F.when(F.col("origin").isNotNull(), F.coalesce(F.array_contains("culprits", F.col("origin")), F.lit(False)))).alias("hit"),
        (F.count_distinct(F.coalesce("report_type", F.lit("clean"))) > 1).alias("unstable"))


def scoreboard(rates: DataFrame) -> DataFrame:
    """metric, value (mean rate over cells), lo, hi, cells. ``rates`` as ``cell_rates`` gives them. The Wilson intervals count cells: a control
    that ever raised an incident is a false positive, a faulted cell is told apart, or its origin named, from half of its rounds on.
    unstable_cells has the number of cells whose report type changes; it has no interval."""
    parts = [("false_positive_rate", rates.where("control"), "incident", F.col("incident") > 0), ("discrimination", rates.where("differs is not null"), "differs", F.col("differs") >= 0.5), ("attribution_accuracy", rates.where("hit is not null"), "hit", F.col("hit") >= 0.5)]
    out = None
    for metric, cells, rate, counts in parts:
        one = cells.agg(F.avg(rate).alias("value"), F.count_if(counts).alias("h"), F.count(F.lit(1)).alias("n"))
        _, lo, hi = wilson(F.col("h"), F.nullif("n", F.lit(0)))
        one = one.select(F.lit(metric).alias("metric"), "value", F.coalesce(lo, F.lit(0.0)).alias("lo"), F.coalesce(hi, F.lit(1.0)).alias("hi"), F.col("n").alias("cells"))
        out = one if out is None else out.unionByName(one)
    unstable = rates.agg(F.count_if("unstable").cast("double").alias("value"), F.count(F.lit(1)).alias("cells"))
    return out.unionByName(unstable.select(F.lit("unstable_cells").alias("metric"), "value", F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), "cells"))


def golden_diff(now: DataFrame, stored: DataFrame) -> DataFrame:
    return now.exceptAll(stored).withColumn("side", F.lit("added")).unionByName(stored.exceptAll(now).withColumn("side", F.lit("missing")))


def node_reasons(parts: dict[str, DataFrame]) -> DataFrame:
    """graph_id, run_id, reasons: codes of all sources (each: graph_id, run_id, severity, code) in one list, fails first."""
    rank = lambda s: F.when(s == "fail", 0).when(s == "warn", 1).otherwise(2)
    out = None
    for source, df in parts.items():
        p = df.select(*KEY, rank(F.col("severity")).alias("rank"), F.lit(source).alias("source"), "code")
        out = p if out is None else out.unionByName(p)
    return out.distinct().groupBy(*KEY).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "source", "code"))), lambda x: F.concat(x["source"], F.lit(":"), x["code"])), ",").alias("reasons"))


