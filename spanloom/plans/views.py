"""The driver tables seen as traces. Each view is SQL that Spark and other engines read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

ORDERED = "l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus"

#: Orders as graphs: a line is a run, lines in order are a pipeline with short cuts, and every seventh order goes back once at its end.
VIEWS = {
    "v_runs": f"""select l_orderkey as graph_id, node as run_id, node as end_time, cast(l_suppkey as string) as agent_name, l_returnflag as agent_version, l_linestatus as model_name,
        case when l_quantity < 25 then l_returnflag || l_linestatus end as prompt_hash, case when l_quantity >= 5 then l_extendedprice end as cost_usd,
        case when l_returnflag = 'R' and l_tax > 0.06 then 'failed' else 'ok' end as status, case when l_tax >= 0.01 then round(1 - l_discount * 10, 4) end as score,
        case when l_tax >= 0.02 then cast(l_quantity as bigint) end as tokens_out, l_shipdate as started_at, case when l_tax < 0.07 then l_shipdate end as ended_at, l_discount > 0.08 as input_flawed, l_suppkey % 5 = 0 as verifier,
        case when l_tax >= 0.01 then null when l_quantity < 20 then 'payload_missing' when l_quantity < 30 then 'zero_result_set' else 'insufficient_components' end as unscored_reason
        from (select *, cast(row_number() over (partition by l_orderkey order by {ORDERED}) as bigint) as node from lineitem) x""",
    "v_last": "select graph_id, max(run_id) as n from v_runs group by graph_id",
    "v_edges": """select r.graph_id, r.run_id as from_run_id, r.run_id + 1 as to_run_id from v_runs r join v_last l on l.graph_id = r.graph_id where r.run_id < l.n
        union all select r.graph_id, r.run_id, r.run_id + 2 from v_runs r join v_last l on l.graph_id = r.graph_id where r.run_id % 2 = 1 and r.run_id + 2 <= l.n
        union all select graph_id, n, n - 1 from v_last where graph_id % 7 = 0 and n >= 2""",
    "v_conv": """select conv_id as graph_id, turn as run_id, turn as end_time, role as agent_name, text as output, lag(text) over (partition by conv_id order by turn) as input,
        round((length(text) % 97) / 96.0e0, 4) as judge from conversations""",
    "v_calls": """select user_id as graph_id, cast(date_part('day', ts) as bigint) as run_id, cast(row_number() over (partition by user_id, cast(date_part('day', ts) as bigint) order by ts, event_id) as bigint) as pos, case when event_type = 'purchase' then 'create_order' else event_type end as name,
        case when event_type in ('error', 'purchase') then 'same' else substring(props, 1, 7) end as args_sha, case when event_type = 'error' then 'error' else 'ok' end as status from events""",
    "v_graphs": "select o_orderkey as graph_id, o_orderpriority as graph_type, case when o_orderstatus = 'O' then 'active' else 'finalized' end as status, o_orderdate as started_at, case when o_orderstatus <> 'O' then o_orderdate end as finalized_at from orders",
    "v_incidents": "select o_orderkey as incident_id, o_orderkey as graph_id, 'degraded_quality' as incident_key, o_orderpriority as trigger, case when o_orderstatus = 'F' then 'open' when o_orderstatus = 'O' then 'resolved' else 'superseded' end as status, o_orderdate as created_at, o_orderdate as updated_at from orders where o_orderkey % 3 = 0",
    "v_reports": """select o_orderkey as incident_id, o_orderkey as graph_id, 2 * o_orderkey + v as report_id, v as version, v = 2 as is_latest, case when o_custkey % 2 = 0 then 'cut_point' else 'multi_culprit' end as report_type, round(o_totalprice / 600000.0, 4) as confidence,
        o_orderpriority || cast(o_custkey as string) as evidence from orders cross join (select 1 as v union all select 2) w where o_orderkey % 3 = 0""",
    "v_verdicts": "select o_orderkey as graph_id, case when o_totalprice > 300000 then 'bad' when o_totalprice > 200000 then 'not_checkable' else 'ok' end as verdict, o_totalprice > 250000 as flagged, o_totalprice > 300000 as bad, o_orderpriority as prompt_hash, o_orderstatus as model, round(o_totalprice / 600000.0, 4) as score from orders where o_orderkey % 2 = 0",
    "v_judgements": "select d.doc_id as graph_id, case when l.quality = 0 then 'bad' else 'ok' end as label, d.source as prompt_hash, d.lang as model, case when d.n_chars % 5 = 0 then null when d.n_chars < 400 then 'bad' else 'ok' end as verdict from labels l join documents d on d.doc_id = l.doc_id",
}
NEEDS = {"v_last": ["v_runs"], "v_edges": ["v_runs", "v_last"]}


def half_up(query: str) -> str:
    """Each round(x, n) as a floor that every engine computes alike; ties, and sums just below them, go up."""
    while found := re.search(r"\bround\(", query):
        depth, comma, end = 1, None, found.end()
        while depth:
            c = query[end]
            depth += (c == "(") - (c == ")")
            if c == "," and depth == 1:
                comma = end
            end += 1
        n = int(query[comma + 1 : end - 1])
        query = f"{query[:found.start()]}(floor(({query[found.end():comma]}) * 1e{n} + 0.501) / 1e{n}){query[end:]}"
    return query


def with_views(query: str) -> str:
    """The query after the definitions of the views that it names, needed ones first."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in wanted:
            wanted.append(name)

    query = half_up(query)
    for name in VIEWS:
        if re.search(rf"\b{name}\b", query):
            add(name)
    if not wanted:
        return query
    parts = ", ".join(f"{n} as ({half_up(VIEWS[n])})" for n in wanted)
    found = re.match(r"\s*with(\s+recursive)?\s+", query)
    if found:
        return f"with{found[1] or ''} {parts}, {query[found.end():]}"
    return f"with {parts} {query}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    """Runs SQL over the driver tables of a folder, and the views above."""
    text = with_views(query)
    used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]
    for t in used:
        text = re.sub(rf"(?<=from )\b{t}\b|(?<=join )\b{t}\b", "{" + t + "}", text)
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used if "{" + t + "}" in text})


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return sql(spark, sf_dir, f"select * from {name}")
