"""Steps whose cost must not grow faster than their input: rounds, shuffles, files and repeated reads."""

import re

from pyspark.sql import functions as F

from spanloom.functions import schemas
from spanloom.functions.jsonview import json_leaves
from spanloom.functions.lineage import folder, stored
from spanloom.operators import checks, graph, walks
from spanloom.plans import catalog, streams


def line(spark, n, verifier=False):
    """One graph: a line of n components with falling scores."""
    rows = [(1, i, i, 1.0 - i / n, i, 1) for i in range(n)]
    s = spark.createDataFrame(rows, "graph_id long, scc long, exit_run long, score double, end_time long, n int")
    return stored(s), stored(spark.createDataFrame([(1, i, i + 1) for i in range(n - 1)], "graph_id long, src long, dst long"))


def jobs(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    rows = run().collect()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    spark.sparkContext.setJobGroup("rest", "rest")
    return rows, n


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_long_propagation_path(spark):
    s, links = line(spark, 40)
    rows, n = jobs(spark, "path", lambda: graph.propagation_path(s.where("scc = 3"), s, links, s.where("scc = 39")))
    assert [x.path for x in rows] == [list(range(3, 40))] and n < 20


def test_long_line_of_verifiers(spark):
    s, links = line(spark, 40)
    rows, n = jobs(spark, "verifiers", lambda: graph.manifestation(s, links, s.where("scc > 0").select("graph_id", F.col("scc").alias("run_id"))))
    assert [x.run_id for x in rows] == [0] and n < 20


def test_long_chain(spark):
    s, links = line(spark, 18)
    rows, n = jobs(spark, "chain", lambda: graph.degradation_chains(s, links))
    assert [(x.head, x.path) for x in rows] == [(0, list(range(18)))] and n < 20


def test_order_of_a_line_needs_no_heap(monkeypatch):
    monkeypatch.setattr(walks.heapq, "heapify", None)
    assert walks.kahn([1, 2, 3], [5, 6, None], [1, 2, 3], [3, 1], [1, 2]) == [(3, 1, 1), (1, 2, 2), (2, 3, 3)]


def test_batches_are_of_many_files(spark):
    path, seen = f"{folder(spark)}/growth-stream", []
    df = spark.range(1000).repartition(6).withColumn("k", F.col("id") % 7)
    catalog._in_files(df, path, "k", lambda batch, i: seen.append((batch.count(), batch.select(F.input_file_name()).distinct().count())))
    assert sum(n for n, _ in seen) == 1000 and len(seen) == 3 and max(f for _, f in seen) > 1


def test_values_of_one_schema_stay_where_they_are(spark, monkeypatch):
    rules = schemas.schema_rules(spark.createDataFrame([('{"type":"object"}',)], "js string"), "js", "js")
    monkeypatch.setattr(schemas, "cut", lambda df: df)
    values = stored(spark.range(50).select("id", F.lit('{"type":"object"}').alias("js"), F.parse_json(F.lit("1")).alias("v")))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        bad = schemas.breaches(values, ["id"], rules, "js", depth=0)
        assert "SortMergeJoin" not in plan(bad) and bad.count() == 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_json_is_parsed_once(spark):
    leaves = json_leaves(spark.createDataFrame([(1, '{"a":{"b":[1,2]}}')], "id long, t string"), ["id"], "t")
    assert "parse_json" not in plan(leaves) and sorted(x.value for x in leaves.collect()) == ["1", "2"]


def test_leaves_are_not_broadcast(spark):
    """Not even few: how many there are can't be told from the files, as Spark takes the VARIANT beside them for most of these."""
    runs = spark.createDataFrame([(1, 0, "ask acme", '{"hits":[],"q":"acme"}'), (2, 0, "ask", '{"hits":["acme"]}')], "graph_id long, run_id long, input string, output string")
    none = checks.zero_result_set(runs)
    assert "Broadcast" not in plan(none) and [x.graph_id for x in none.collect()] == [1]
    leaves = json_leaves(runs, ["graph_id", "run_id"], "output").where("value = 'acme'")
    assert "Broadcast" not in plan(leaves.groupBy("graph_id").count().join(runs, "graph_id"))


def test_trigrams_are_not_shuffled(spark):
    corpus = spark.createDataFrame([("the cat and the dog and the bird", "en"), ("der hund und die katze und der vogel", "de")], "text string, lang string")
    found = checks.detect_language(corpus.select(F.monotonically_increasing_id().alias("id"), "text", F.col("lang").alias("own")), stored(checks.train_lang_profiles(corpus)))
    assert not re.search(r"hashpartitioning\((id#\d+L?, )?gram#", plan(found)) and {x.lang for x in found.collect()} == {"en", "de"}


def test_payloads_are_read_once(spark):
    runs = spark.createDataFrame([(1, 0, "10\n20", "a;10;20\nb;30;77\nc;5;6")], "graph_id long, run_id long, input string, output string")
    out = checks.number_not_derivable(runs.withColumn("output", F.regexp_replace("output", "zz-marker", "")))
    assert "zz-marker" not in plan(out) and [x.params["count"] for x in out.collect()] == ["4"]


def test_figures_stay_in_their_row(spark, monkeypatch):
    """Nothing is shuffled or multiplied by the factors, and only the runs with a lost figure are stored."""
    kept = []
    monkeypatch.setattr(checks, "stored", lambda df: kept.append(df) or stored(df))
    runs = spark.createDataFrame([(i, 0, "rate: 2\n10\n20", f"a;10;{20 + i % 2}\nb;40;2000") for i in range(10)], "graph_id long, run_id long, input string, output string")
    assert [x.params["count"] for x in checks.number_not_derivable(runs).collect()] == ["1"] * 5
    assert len(kept) == 1 and kept[0].count() == 5 and not re.search("Exchange|Generate", plan(kept[0]))


def test_figures_at_the_tolerance(spark, monkeypatch):
    """A figure lower by just the tolerance, two buckets of a logarithm away; figures without end; a batch in parts; another run's figures and rates."""
    rows = [(1, 0, "1", "a;1;0.9999\nb;1;0.9998"), (2, 0, "9" * 400, f"a;1;{'9' * 400}\nb;0;-1"), (3, 0, "rate: 3\n7\n-2", "a;21;-6\nb;6;14;-0.6666"), (4, 0, None, "a;1;2\nb;-0;0,0"), (5, 0, "0", "a;0;0,0\nb;-0;3"), (6, 0, "rate: 3 rate: 0,7 rate: 13\n11", "a;143;7,7\nb;33;99"), (None, 0, "1", "a;5;6\nb;7;8")]
    runs = spark.createDataFrame(rows, "graph_id long, run_id long, input string, output string")
    for size in (1 << 18, 1):
        monkeypatch.setattr(checks, "FIGURES", size)
        got = {x.graph_id: x.params["count"] for x in checks.number_not_derivable(runs.coalesce(1)).collect()}
        assert got == {1: "1", 2: "4", 3: "2", 4: "3", 5: "1", 6: "1"}, size


def test_incident_stream_reads_lines_once(spark, monkeypatch):
    fed = []
    monkeypatch.setattr(streams, "in_turns", lambda spark, rows, *rest: fed.append(rows))
    streams._analysis(spark, "/root/testdata/sf0.001")
    assert "Join" not in plan(fed[0]) and plan(fed[0]).count("Exchange") == 1
