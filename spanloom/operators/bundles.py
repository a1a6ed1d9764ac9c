"""Whole graphs as rows: what a graph's steps share stands in one row, so that components, their order and the scores around them need no
shuffle after the one that gathers a graph.

A gathered graph has graph_id, nodes (structs with run_id, end_time, score and facts of the run), src and dst (ids of the ends of its links).
``components`` adds comps (structs, by end time and exit run) with tail and head (distinct links between them, as positions in comps), and
at (the position of each node's component). The work in a batch is done for all its graphs at once, on flat arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import walks

OWN = ("run_id", "end_time", "score")
#: Graphs with more components get their order from a heap each.
LONG = 64


def gathered(runs: DataFrame, edges: DataFrame, facts: list[str] | None = None) -> DataFrame:
    """One row a graph, from runs and edges (graph_id, from_run_id, to_run_id)."""
    nodes = runs.groupBy("graph_id").agg(F.collect_list(F.struct(*OWN, *(facts or []))).alias("nodes"))
    links = edges.groupBy("graph_id").agg(F.collect_list(F.struct("from_run_id", "to_run_id")).alias("_l"))
    return nodes.join(links, "graph_id", "left").select("graph_id", "nodes", F.col("_l.from_run_id").alias("src"), F.col("_l.to_run_id").alias("dst"))


def flattened(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All elements, and the row of each."""
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten(), np.repeat(np.arange(len(lists)), n)


def _codes(values: pa.Array) -> tuple[np.ndarray, int, pa.Array]:
    """Numbers in the order of the values, 0 for null; how many there are; the value of each number, if it isn't a null."""
    if pa.types.is_integer(values.type) and len(values) and not values.null_count:
        plain = values.to_numpy().astype(np.int64)
        low, high = int(plain.min()), int(plain.max())
        if high - low < 1 << 20:
            return plain - low + 1, high - low + 2, pa.array(np.arange(low - 1, high + 1), pa.int64()).cast(values.type, safe=False)
    met = values.dictionary_encode()
    order = pc.sort_indices(met.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(1, len(order) + 1)
    index = pc.fill_null(met.indices, -1).to_numpy(zero_copy_only=False)
    first = pa.nulls(1, values.type)
    return np.where(index < 0, 0, np.append(rank, 0)[index]), len(order) + 1, pa.concat_arrays([first, met.dictionary.take(order)])


def _starts(groups: np.ndarray) -> np.ndarray:
    """Where each group of equal neighbours begins."""
    return np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])) if len(groups) else np.zeros(0, np.int64)


def _listed(values: pa.Array, rows: np.ndarray, n: int) -> pa.ListArray:
    """``values``, in the order of their rows, as one list a row."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32()), values)


def _most(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The largest value in each of ``n`` rows, or 0."""
    out = np.zeros(n, np.int64)
    np.maximum.at(out, rows, values)
    return out


def _least(scores: pa.Array, starts: np.ndarray) -> pa.Array:
    """The least score of each group: null without any, not a number only where there is nothing else."""
    if not len(starts):
        return scores
    known = scores.is_valid().to_numpy(zero_copy_only=False)
    plain = np.where(known, pc.fill_null(scores.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False), np.nan)
    return pa.array(np.fmin.reduceat(plain, starts), pa.float64(), mask=~np.logical_or.reduceat(known, starts)).cast(scores.type)


def components(graphs: DataFrame) -> DataFrame:
    """Adds comps, tail, head and at. comps: scc (least member), members (by time), exit_run, score (the exit's), min_score, n, self_loop,
    end_time, and the facts of the exit run."""
    node = graphs.schema["nodes"].dataType.elementType
    kind, facts = node["run_id"].dataType, [f for f in node.fields if f.name not in OWN]
    comp = T.StructType([T.StructField("scc", kind), T.StructField("members", T.ArrayType(kind)), T.StructField("exit_run", kind), T.StructField("score", node["score"].dataType), T.StructField("min_score", node["score"].dataType),
                         T.StructField("n", T.LongType()), T.StructField("self_loop", T.BooleanType()), T.StructField("end_time", node["end_time"].dataType), *facts])
    whole = T.ArrayType(T.IntegerType())
    out = T.StructType([*graphs.schema.fields, T.StructField("comps", T.ArrayType(comp)), T.StructField("tail", whole), T.StructField("head", whole), T.StructField("at", whole)])
    kinds = to_arrow_schema(out)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            n = part.num_rows
            nodes, row = flattened(part.column("nodes"))
            (src, link_row), (dst, _) = flattened(part.column("src")), flattened(part.column("dst"))
            ids, times, scores = (pc.struct_field(nodes, c) for c in OWN)
            code, span, values = _codes(pa.concat_arrays([ids, src.cast(ids.type), dst.cast(ids.type)]))
            own, s, d = np.split(code, [len(ids), len(ids) + len(src)])
            real = (s > 0) & (d > 0)  # both ends known
            met, index = np.unique(np.concatenate([row * span + own, link_row[real] * span + s[real], link_row[real] * span + d[real]]), return_inverse=True)
            v, s, d = np.split(index, [len(ids), len(ids) + int(real.sum())])
            # A cycle has a link that goes down in the order of ids: other graphs aren't walked.
            link_row = link_row[real]
            down = np.zeros(n, bool)
            down[link_row[s > d]] = True
            walked = down[link_row] & (s != d)
            label = np.arange(len(met))
            for x, least in walks.strong_parts(s[walked].tolist(), d[walked].tolist()):
                label[x] = least
            # Nodes by row, time and id; each component's nodes together, the last is its exit.
            time = _codes(times)[0]
            lex = np.lexsort((own, time, row))
            inner = lex[np.argsort(label[v[lex]], kind="stable")]
            starts = _starts(label[v[inner]])
            exits = inner[np.append(starts[1:], len(inner)) - 1] if len(inner) else inner
            place = np.lexsort((own[exits], time[exits], row[exits]))  # components by row, time and exit
            rank = np.empty(len(place), np.int64)
            rank[place] = np.arange(len(place))
            of = np.full(len(met), -1)  # of a label: the number of its component
            of[label[v[exits]]] = rank
            inner = inner[np.argsort(of[label[v[inner]]], kind="stable")]
            exits, number = exits[place], of[label[v]]
            starts = _starts(number[inner])
            comp_row, size = row[exits], np.diff(np.append(starts, len(inner)))
            loops = np.zeros(len(met), bool)
            loops[s[s == d]] = True
            first = np.searchsorted(comp_row, np.arange(n))
            fields = [values.take(pa.array(met[label[v[exits]]] % span)), pa.ListArray.from_arrays(pa.array(np.append(starts, len(inner)), pa.int32()), ids.take(pa.array(inner))), ids.take(pa.array(exits)), scores.take(pa.array(exits)),
                      _least(scores.take(pa.array(inner)), starts), pa.array(size, pa.int64()), pa.array(np.logical_or.reduceat(loops[v[inner]], starts) if len(starts) else np.zeros(0, bool)), times.take(pa.array(exits)),
                      *(pc.struct_field(nodes, f.name).take(pa.array(exits)) for f in facts)]
            inside = np.zeros(len(met), bool)
            inside[v] = True
            kept = inside[s] & inside[d]
            tail, head = of[label[s[kept]]], of[label[d[kept]]]
            pairs = np.unique((tail * len(exits) + head)[tail != head])
            tail, head = pairs // max(len(exits), 1), pairs % max(len(exits), 1)
            flat = pa.StructArray.from_arrays([x.cast(k.type) for x, k in zip(fields, kinds.field("comps").type.value_type, strict=True)], fields=list(kinds.field("comps").type.value_type))
            ends = (_listed(pa.array(x - first[comp_row[tail]], pa.int32()), comp_row[tail], n) for x in (tail, head))
            added = [_listed(flat, comp_row, n), *ends, _listed(pa.array(number - first[row], pa.int32()), row, n)]
            yield pa.RecordBatch.from_arrays([*part.columns, *(x.cast(kinds.field(c).type) for x, c in zip(added, ("comps", "tail", "head", "at"), strict=True))], names=out.names)

    return graphs.mapInArrow(run, out)


def sccs(graphs: DataFrame) -> DataFrame:
    """One row a component, as ``graph.condense`` gives it."""
    return graphs.select("graph_id", F.inline("comps")).select("graph_id", "scc", "members", "exit_run", "score", "min_score", "n", "self_loop", "end_time")


def linked(graphs: DataFrame) -> DataFrame:
    """graph_id, src and dst: the links between components by their ids, as two lists a graph."""
    return graphs.select("graph_id", *(F.transform(c, lambda i: F.get(F.col("comps.scc"), i)).alias(name) for c, name in (("tail", "src"), ("head", "dst"))))


def links(graphs: DataFrame) -> DataFrame:
    """(graph_id, src, dst): distinct links between components, by their ids."""
    return linked(graphs).select("graph_id", F.inline(F.arrays_zip("src", "dst")))


def shadow(candidates: DataFrame, graphs: DataFrame) -> DataFrame:
    """(graph_id, scc, run_id) of candidates without another one among their ancestors, as ``graph.shadow``. Links are read only where a graph
    has several candidates."""
    each = candidates.groupBy("graph_id").agg(F.collect_list(F.struct("scc", "run_id")).alias("_c"))
    ends = linked(graphs.where(F.size("tail") > 0))
    each = each.join(ends.withColumnRenamed("graph_id", "_g"), (F.col("graph_id") == F.col("_g")) & (F.size("_c") > 1), "left").select("graph_id", "_c.scc", "_c.run_id", "src", "dst")
    return walks.each_graph(each, walks.unshadowed, [candidates.schema["scc"], candidates.schema["run_id"]])


def runs(graphs: DataFrame) -> DataFrame:
    """graph_id, what ``nodes`` holds of each run, and scc, the component that it belongs to."""
    of = F.transform("at", lambda i: F.get(F.col("comps.scc"), i)).alias("scc")
    return graphs.select("graph_id", F.inline(F.arrays_zip("nodes", of))).select("graph_id", "nodes.*", "scc")


def edges(graphs: DataFrame) -> DataFrame:
    """(graph_id, from_run_id, to_run_id)."""
    return graphs.select("graph_id", F.inline(F.arrays_zip(F.col("src").alias("from_run_id"), F.col("dst").alias("to_run_id"))))


def _positions(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """The row of each component, the place where each row begins, and the ends of all links as flat positions."""
    row = flattened(part.column("comps"))[1]
    first = np.searchsorted(row, np.arange(part.num_rows))
    (tail, link_row), (head, _) = flattened(part.column("tail")), flattened(part.column("head"))
    return row, first, link_row, first[link_row] + tail.to_numpy(zero_copy_only=False), first[link_row] + head.to_numpy(zero_copy_only=False)


def _ordered(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Of each component its row, its place in topological order, the longest path to it in nodes, and whether it has a place."""
    row, first, link_row, tail, head = _positions(part)
    topo, depth = np.arange(len(row)) - first[row] + 1, np.ones(len(row), np.int64)
    size = np.bincount(row, minlength=part.num_rows)
    slow = size > LONG
    slow[link_row[tail > head]] = True
    fast = ~slow[link_row]
    by_place = np.argsort(topo[tail[fast]], kind="stable")
    a, b = tail[fast][by_place], head[fast][by_place]
    for x in np.split(np.arange(len(a)), _starts(topo[a])[1:]):
        np.maximum.at(depth, b[x], depth[a[x]] + 1)
    done = np.ones(len(row), bool)
    cuts = np.searchsorted(link_row, np.arange(part.num_rows + 1))
    for r in np.flatnonzero(slow):
        at, own = range(size[r]), slice(cuts[r], cuts[r + 1])
        done[first[r] : first[r] + size[r]] = False
        for x, t, far in walks.kahn(at, at, at, (tail[own] - first[r]).tolist(), (head[own] - first[r]).tolist()):
            topo[first[r] + x], depth[first[r] + x], done[first[r] + x] = t, far, True
    return row, topo, depth, done


def topological(graphs: DataFrame) -> DataFrame:
    """(graph_id, scc, topo, depth), as ``graph.topological``. Where every link goes on in time, the order of the components is the one."""
    kind = graphs.schema["comps"].dataType.elementType["scc"].dataType
    out = T.StructType([graphs.schema["graph_id"], T.StructField("scc", kind), T.StructField("topo", T.IntegerType()), T.StructField("depth", T.IntegerType())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            row, topo, depth, done = _ordered(part)
            kept = np.flatnonzero(done)
            ids = pc.struct_field(part.column("comps").flatten(), "scc")
            yield pa.RecordBatch.from_arrays([part.column("graph_id").take(pa.array(row[kept])), ids.take(pa.array(kept)), pa.array(topo[kept], pa.int32()), pa.array(depth[kept], pa.int32())], names=out.names)

    return graphs.select("graph_id", F.transform("comps", lambda c: F.struct(c["scc"].alias("scc"))).alias("comps"), "tail", "head").mapInArrow(run, out)


#: What is counted of a graph; the last two are flags.
COUNTS = ("n", "e", "fan", "fan_in", "roots", "in_rest", "two_way", "spokes", "feeding", "fed", "cycles", "supers", "c_e", "c_out", "c_in", "depth", "components", "articulation_points", "dense", "loops")


def counts(graphs: DataFrame) -> DataFrame:
    """One row a graph with what ``graph.topology`` counts: distinct runs and links, degrees, two-way pairs, what the first root leads to (spokes)
    and these in turn, cycles, the longest path, and weak components with their articulation points."""
    kinds = {"depth": T.IntegerType(), "dense": T.BooleanType(), "loops": T.BooleanType()}
    out = T.StructType([graphs.schema["graph_id"], *(T.StructField(c, kinds.get(c, T.LongType())) for c in COUNTS)])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            n = part.num_rows
            per, most = (lambda rows: np.bincount(rows, minlength=n)), (lambda rows, x: _most(rows, x, n))
            ids, row = flattened(part.column("ids"))
            (src, link_row), (dst, _) = flattened(part.column("src")), flattened(part.column("dst"))
            code, span, _ = _codes(pa.concat_arrays([ids, src.cast(ids.type), dst.cast(ids.type)]))
            own, s, d = np.split(code, [len(ids), len(ids) + len(src)])
            met, index = np.unique(np.concatenate([row * span + own, link_row * span + s, link_row * span + d]), return_inverse=True)
            at, s, d = np.split(index, [len(ids), len(ids) + len(src)])
            m, of, known = len(met), met // span, met % span > 0
            pair = np.unique(s * m + d)
            s, d = pair // max(m, 1), pair % max(m, 1)
            node = np.unique(at)
            inner = np.zeros(m, bool)
            inner[node] = known[node]
            # Degrees of the runs; the ends of a link may be no runs, or unknown.
            leaves, enters = np.bincount(s, minlength=m) * inner, np.bincount(d, minlength=m) * inner
            roots = node[enters[node] == 0]
            first = roots[known[roots]]
            root = np.full(n, -1)
            root[of[first][::-1]] = first[::-1]
            near = d[s == root[of[s]]]
            spoke = np.zeros(m, bool)
            spoke[near] = known[near]
            fed = np.unique(d[spoke[s]])
            two_way = (s < d) & known[s] & np.isin(d * m + s, pair)
            # Components: links within one, and between them.
            comp_row, _, depth, done = _ordered(part)
            begins, comps = np.searchsorted(comp_row, np.arange(n)), part.column("comps").flatten()
            size, loops = (pc.struct_field(comps, c).to_numpy(zero_copy_only=False) for c in ("n", "self_loop"))
            comp = np.full(m, -1)
            comp[at] = begins[row] + flattened(part.column("at"))[0].to_numpy(zero_copy_only=False)
            inside = (s != d) & inner[s] & inner[d] & (comp[s] == comp[d])
            dense = (size >= 4) & (np.bincount(comp[s[inside]], minlength=len(size)) / np.maximum(size * (size - 1), 1) >= 0.5)
            _, _, tail_row, tail, head = _positions(part)
            far = most(comp_row[done], depth[done])
            # Weak components, a graph at a time.
            real = (s != d) & known[s] & known[d]
            a, b, runs = s[real].tolist(), d[real].tolist(), node[known[node]].tolist()
            ends, stops = np.searchsorted(of[s[real]], np.arange(n + 1)), np.searchsorted(of[node[known[node]]], np.arange(n + 1))
            weak = [walks.pieces(runs[i:j], list(zip(a[k:x], b[k:x], strict=True))) for i, j, k, x in zip(stops, stops[1:], ends, ends[1:], strict=False)]
            fan_in = most(of[node], enters[node])
            made = [per(of[node]), per(of[s[inner[s]]]), most(of[node], leaves[node]), fan_in, per(of[roots]), pa.array(fan_in, pa.int64(), mask=fan_in == 0), per(of[s[two_way]]), per(of[near]), per(of[np.unique(s[spoke[s]])]), per(of[fed[known[fed]]]),
                    per(comp_row[size >= 2]), per(comp_row), per(tail_row), most(comp_row, np.bincount(tail, minlength=len(size))), most(comp_row, np.bincount(head, minlength=len(size))), pa.array(far, pa.int32(), mask=far == 0), [x for x, _ in weak], [len(x) for _, x in weak],
                    per(comp_row[dense]) > 0, per(comp_row[loops]) > 0]
            yield pa.RecordBatch.from_arrays([part.column("graph_id"), *(pa.array(x, k.type) for x, k in zip(made, list(to_arrow_schema(out))[1:], strict=True))], names=out.names)

    wanted = F.transform("comps", lambda c: F.struct(c["n"].alias("n"), c["self_loop"].alias("self_loop"))).alias("comps")
    return graphs.select("graph_id", F.col("nodes.run_id").alias("ids"), "src", "dst", wanted, "tail", "head", "at").mapInArrow(run, out)


def around(graphs: DataFrame, threshold: float) -> DataFrame:
    """Scored components with what stands around them: graph_id, scc, exit_run, score, n, end_time, input_flawed, verifier, and best, worst, only_bare
    (all of its inputs are sources without payload; null without inputs) and cured (all that it leads to is healthy; null where nothing is)."""
    comp = graphs.schema["comps"].dataType.elementType
    names = ["scc", "exit_run", "score", "n", "end_time", "input_flawed", "verifier"]
    flags = [T.StructField(c, T.BooleanType()) for c in ("only_bare", "cured")]
    out = T.StructType([graphs.schema["graph_id"], *(comp[c] for c in names), T.StructField("best", T.DoubleType()), T.StructField("worst", T.DoubleType()), *flags])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            row, _, _, tail, head = _positions(part)
            comps, n = part.column("comps").flatten(), len(row)
            column = lambda c: pc.struct_field(comps, c)
            known = column("score").is_valid().to_numpy(zero_copy_only=False)
            score = pc.fill_null(column("score").cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
            fed, leads, rated = np.bincount(head, minlength=n) > 0, np.bincount(tail, minlength=n) > 0, np.zeros(n, bool)
            best, worst, seen = np.full(n, -np.inf), np.full(n, np.nan), known[tail]
            np.maximum.at(best, head[seen], score[tail[seen]])
            np.fmin.at(worst, head[seen], score[tail[seen]])
            rated[head[seen]] = True
            bare = ~fed & pc.fill_null(pc.equal(column("unscored_reason"), "payload_missing"), False).to_numpy(zero_copy_only=False)
            only_bare, cured = np.ones(n, bool), np.ones(n, bool)
            only_bare[head[~bare[tail]]] = False
            fine = known & ((score >= threshold) | np.isnan(score))  # not a number is the highest
            cured[tail[~fine[head]]] = False
            kept = pa.array(np.flatnonzero(known))
            made = [pa.array(best, mask=~rated), pa.array(worst, mask=~rated, from_pandas=False), pa.array(only_bare, mask=~fed), pa.array(cured, mask=~leads)]
            yield pa.RecordBatch.from_arrays([part.column("graph_id").take(pa.array(row).take(kept)), *(column(c).take(kept) for c in names), *(x.take(kept) for x in made)], names=out.names)

    wanted = F.transform("comps", lambda c: F.struct(*(c[x].alias(x) for x in [*names, "unscored_reason"]))).alias("comps")
    return graphs.select("graph_id", wanted, "tail", "head").mapInArrow(run, out)
