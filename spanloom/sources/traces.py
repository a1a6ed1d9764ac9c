"""Reading, flattening and keeping spans and run tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

SPAN_KINDS = {"INTERNAL": 1, "SERVER": 2, "CLIENT": 3, "PRODUCER": 4, "CONSUMER": 5, "AGENT": 10, "TOOL": 11}
ZERO_PARENT = "^0+$"


def read_otlp(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(export VARIANT, _corrupt): one export a file, an array of exports a file, or, with ``lines``, one a line.

    What doesn't parse has a null export and its text in ``_corrupt``; elements of an array that aren't objects are dropped.
    """
    text = spark.read.text(path, wholetext=not lines).where(F.trim("value") != "")
    parsed = text.select("value", F.try_parse_json("value").alias("v")).select("value", "v", F.schema_of_variant("v").alias("kind"))
    bad = parsed.where("v is null").select(F.lit(None).cast("variant").alias("export"), F.col("value").alias("_corrupt"))
    one = parsed.where(F.col("kind").startswith("OBJECT")).select(F.col("v").alias("export"), F.lit(None).cast("string").alias("_corrupt"))
    many = parsed.where(F.col("kind").startswith("ARRAY")).select(F.explode(F.try_variant_get("v", "$", "array<variant>")).alias("export"))
    many = many.where(F.schema_of_variant("export").startswith("OBJECT")).withColumn("_corrupt", F.lit(None).cast("string"))
    return one.unionByName(many).unionByName(bad)


def _field(v: str | Column, *names: str, kind: str = "variant") -> Column:
    return F.coalesce(*(F.try_variant_get(v, f"$.{n}", kind) for n in names))


def flatten_exports(exports: DataFrame) -> DataFrame:
    """(span VARIANT, resource_attributes VARIANT): every span of every scope of every resource; camelCase and snake_case keys."""
    resources = exports.where("export is not null").select(F.explode_outer(_field("export", "resourceSpans", "resource_spans", kind="array<variant>")).alias("r"))
    scopes = resources.select(_field("r", "resource.attributes").alias("resource_attributes"), F.explode_outer(_field("r", "scopeSpans", "scope_spans", "instrumentationLibrarySpans", kind="array<variant>")).alias("s"))
    return scopes.select(F.explode(_field("s", "spans", kind="array<variant>")).alias("span"), "resource_attributes")


def _entries(list_: Column) -> Column:
    """(k, v) of a list of {key, value}, as it is; entries without a key go, and of repeated keys the last stays."""
    entries = F.transform(list_, lambda e: F.struct(F.try_variant_get(e, "$.key", "string").alias("k"), F.try_variant_get(e, "$.value", "variant").alias("v")))
    entries = F.filter(entries, lambda e: F.coalesce(e["k"] != "", F.lit(False)))
    return F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda x: x["k"] == e["k"]))


def _quoted(text: Column) -> Column:
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _opened(value: Column, depth: int) -> Column:
    """A typed value as JSON text, its wrappers opened down to ``depth`` lists or maps; bad numbers are null, what has no wrapper stays."""
    get = lambda kind, *names: F.coalesce(*(F.try_variant_get(value, f"$.{n}", kind) for n in names))
    whole, number = (get("string", *names).try_cast(kind).cast("string") for names, kind in ((("intValue", "int_value"), "bigint"), (("doubleValue", "double_value"), "double")))
    text = F.coalesce(F.to_json(get("variant", "stringValue", "string_value", "boolValue", "bool_value", "bytesValue", "bytes_value")), whole, number)
    if depth:
        inner = lambda v: F.coalesce(_opened(v, depth - 1), F.lit("null"))
        items = get("array<variant>", "arrayValue.values", "array_value.values", "arrayValue", "array_value")
        pairs = get("array<variant>", "kvlistValue.values", "kvlist_value.values", "kvlistValue", "kvlist_value")
        text = F.coalesce(text, F.concat(F.lit("["), F.array_join(F.transform(items, inner), ","), F.lit("]")),
                          F.concat(F.lit("{"), F.array_join(F.transform(_entries(pairs), lambda e: F.concat(_quoted(e["k"]), F.lit(":"), inner(e["v"]))), ","), F.lit("}")))
    typed = F.to_json(value).rlike('^\\{"(string|bool|bytes|int|double|array|kvlist)(Value|_value)"')
    return F.when(typed, text).otherwise(F.to_json(value))


def _scalar(value: Column) -> Column:
    """One attribute value as text: typed wrappers are opened, lists and maps three deep; bad numbers are null."""
    get = lambda n: F.try_variant_get(value, f"$.{n}", "string")
    wrapped = F.coalesce(get("stringValue"), get("string_value"), get("boolValue"), get("bool_value"),
                         get("intValue").try_cast("bigint").cast("string"), get("int_value").try_cast("bigint").cast("string"),
                         get("doubleValue").try_cast("double").cast("string"), get("double_value").try_cast("double").cast("string"), get("bytesValue"), get("bytes_value"), _opened(value, 3))
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), wrapped).otherwise(F.try_variant_get(value, "$", "string"))


def decode_attributes(bag: Column) -> Column:
    """MAP<STRING,STRING> of a list of {key, value} or of a plain object; of repeated keys the last counts. Lists and maps come out as JSON."""
    last = F.transform(_entries(F.try_variant_get(bag, "$", "array<variant>")), lambda e: F.struct(e["k"], _scalar(e["v"])))
    plain = F.try_variant_get(bag, "$", "map<string,variant>")
    return F.coalesce(F.map_from_entries(last), F.transform_values(plain, lambda _, v: _scalar(v)))


def unix_nanos(value: Column) -> Column:
    """A time from unix nanoseconds (number or digits) or ISO text; floors to microseconds, null where it is neither."""
    digits = F.when(value.rlike("^\\d{1,19}$"), F.timestamp_micros(F.floor(value.try_cast("decimal(20,0)") / 1000).cast("bigint")))
    return F.coalesce(digits, F.try_to_timestamp(value))


def normalize_spans(raw: DataFrame) -> DataFrame:
    """The spans table: rows without ids go, all-zero parents are none, kinds become numbers, times timestamps."""
    text = lambda *names: _field("span", *names, kind="string")
    kind = text("kind")
    named = F.upper(F.regexp_replace(kind, "^SPAN_KIND_", ""))
    number = F.coalesce(kind.try_cast("int"), F.element_at(F.create_map(*(x for k, v in SPAN_KINDS.items() for x in (F.lit(k), F.lit(v)))), named))
    status = F.upper(F.coalesce(text("status.code"), text("status")))
    parent = text("parentSpanId", "parent_span_id")
    out = raw.select(
        text("traceId", "trace_id").alias("trace_id"), text("spanId", "span_id").alias("span_id"),
        F.when(~parent.rlike(ZERO_PARENT) & (parent != ""), parent).alias("parent_span_id"), text("name").alias("name"), F.coalesce(number, F.lit(0)).alias("kind"),
        unix_nanos(text("startTimeUnixNano", "start_time_unix_nano", "start_time")).alias("start_time"), unix_nanos(text("endTimeUnixNano", "end_time_unix_nano", "end_time")).alias("end_time"),
        decode_attributes(_field("span", "attributes")).alias("attributes"), decode_attributes(F.col("resource_attributes")).alias("resource_attributes"),
        F.coalesce(status.rlike("^(2|.*ERROR)$"), F.lit(False)).alias("error"))
    return out.where("coalesce(trace_id, '') <> '' and coalesce(span_id, '') <> ''")


def write_spans(spans: DataFrame, path: str) -> None:
    """Appends spans by start date; a missing time stays null."""
    spans.withColumn("day", F.to_date("start_time")).write.mode("append").partitionBy("day").parquet(path)


def spans_for_traces(spans: DataFrame, trace_ids: DataFrame) -> DataFrame:
    return spans.join(trace_ids.select("trace_id").distinct(), "trace_id", "left_semi")


def latest_spans(spans: DataFrame, tie: list[str]) -> DataFrame:
    """One row per (trace_id, span_id): the greatest end_time, then the least ``tie`` columns."""
    order = W.partitionBy("trace_id", "span_id").orderBy(F.col("end_time").desc_nulls_last(), *tie)
    return spans.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def split_payloads(runs: DataFrame, column: str, limit: int = 65_536) -> tuple[DataFrame, DataFrame]:
    """Runs with a prefix of at most ``limit`` bytes (whole characters) and the byte count; the long texts as (run_id, kind, text)."""
    n = F.octet_length(column)
    prefix = F.regexp_replace(F.make_valid_utf8(F.substring(F.col(column).cast("binary"), 1, limit).cast("string")), "�+$", "")
    long = runs.where(n > limit).select("run_id", F.lit(column).alias("kind"), F.col(column).alias("text"))
    return runs.withColumn(f"{column}_bytes", n).withColumn(column, F.when(n > limit, prefix).otherwise(F.col(column))), long


def resolve_payloads(runs: DataFrame, payloads: DataFrame, column: str) -> DataFrame:
    """Runs with the full text where it is kept apart, the prefix otherwise."""
    full = payloads.where(F.col("kind") == column).select("run_id", F.col("text").alias("_full"))
    return runs.join(full, "run_id", "left").withColumn(column, F.coalesce("_full", column)).drop("_full")


def load_rules(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Contracts, check rules, policies and baselines: small tables, one Parquet folder each; Spark broadcasts what is small."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("contracts", "check_rules", "policies", "agent_stats")}


# ---- upserts: each gives the merged table; the caller swaps it in ----------------------------------------------------

GRAPH_STATES = ["active", "finalized", "analyzed"]


def upsert_graphs(graphs: DataFrame, batch: DataFrame) -> DataFrame:
    """Earliest start, latest end, first known type, and a status that never goes back."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, GRAPH_STATES)), F.col("status")), F.lit(0))
    both = graphs.withColumn("_old", F.lit(0)).unionByName(batch.withColumn("_old", F.lit(1))).withColumn("_rank", rank)
    return both.groupBy("graph_id").agg(F.min_by("graph_type", F.when(F.col("graph_type").isNotNull(), F.struct("_old", "started_at"))).alias("graph_type"),
                                        F.max_by("status", "_rank").alias("status"), F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at"))


def upsert_runs(runs: DataFrame, batch: DataFrame, refresh: bool = False) -> DataFrame:
    """First write wins; with ``refresh`` the batch replaces."""
    key = ["graph_id", "run_id"]
    return batch.unionByName(runs.join(batch.select(*key), key, "left_anti")) if refresh else runs.unionByName(batch.join(runs.select(*key), key, "left_anti"))


def upsert_edges(edges: DataFrame, batch: DataFrame) -> DataFrame:
    key = ["graph_id", "from_run_id", "to_run_id", "type"]
    return edges.unionByName(batch.dropDuplicates(key).join(edges.select(*key), key, "left_anti"))


def alert_feed(changes: DataFrame, reports: DataFrame) -> DataFrame:
    """New incidents with the context of their latest report; n/a where it has none."""
    latest = reports.where("is_latest").select("incident_id", "culprit_run_ids", "confidence", "downstream_cost_usd")
    show = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("n/a"))
    return changes.where("is_new").join(latest, "incident_id", "left").select("incident_id", "graph_id", "trigger", F.coalesce(F.element_at("culprit_run_ids", 1).cast("string"), F.lit("n/a")).alias("culprit"),
                                                                             show("confidence").alias("confidence"), show("downstream_cost_usd").alias("cost"))


def report_json(reports: DataFrame, findings: DataFrame, defects: DataFrame) -> DataFrame:
    """One JSON text a report, with its findings and defects in order."""
    found = findings.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("idx", "kind", "subject"))).alias("findings"))
    wrong = defects.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("idx", "kind", "origin_kind"))).alias("defects"))
    rows = reports.join(found, "graph_id", "left").join(wrong, "graph_id", "left")
    return rows.select("graph_id", F.to_json(F.struct("report_type", "findings", "defects")).alias("json"))
