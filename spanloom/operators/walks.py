"""Walks over one graph at a time, linear in its nodes and links, over Arrow batches that Spark has dealt out by graph.

A graph's nodes and links are one row; all graphs run in parallel. ``key`` names the columns that tell graphs apart.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def each_graph(rows: DataFrame, walk: Callable[..., list[tuple]], out: list[T.StructField], key: int = 1) -> DataFrame:
    """``walk`` of each row's columns after the first ``key`` ones gives rows of ``out``, which come out with the row's key."""
    schema = T.StructType([*rows.schema.fields[:key], *out])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            at: list[int] = []
            found: list[list] = [[] for _ in out]
            for i, values in enumerate(zip(*(part.column(c).to_pylist() for c in range(key, part.num_columns)), strict=True)):
                for x in walk(*values):
                    at.append(i)
                    for column, v in zip(found, x, strict=True):
                        column.append(v)
            place = pa.array(at, pa.int64())
            kinds = [to_arrow_type(f.dataType) for f in out]
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(place) for c in range(key)), *(pa.array(c, k) for c, k in zip(found, kinds, strict=True))], names=schema.names)

    return rows.mapInArrow(run, schema)


def _near(src: list | None, dst: list | None) -> dict:
    near: dict = {}
    for v, w in zip(src or [], dst or [], strict=True):
        near.setdefault(v, []).append(w)
        near.setdefault(w, [])
    return near


def strong_parts(src: list, dst: list) -> list[tuple]:
    """(node, least member of its strongly connected component), for components of several nodes: one depth-first walk (Tarjan, 1972)."""
    near, place, low, open_, path, out = _near(src, dst), {}, {}, set(), [], []
    for root in near:
        if root in place:
            continue
        walk = [(root, iter(near[root]))]
        place[root] = low[root] = len(place)
        path.append(root)
        open_.add(root)
        while walk:
            v, rest = walk[-1]
            for w in rest:
                if w not in place:
                    place[w] = low[w] = len(place)
                    path.append(w)
                    open_.add(w)
                    walk.append((w, iter(near[w])))
                    break
                if w in open_:
                    low[v] = min(low[v], place[w])
            else:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[v])
                if low[v] == place[v]:
                    part = [path.pop()]
                    while part[-1] != v:
                        part.append(path.pop())
                    open_.difference_update(part)
                    if len(part) > 1:
                        out += [(x, min(part)) for x in part]
    return out


def kahn(ids: list, times: list, names: list, src: list | None, dst: list | None) -> list[tuple]:
    """(node, place from 1, nodes on the longest path to it) in topological order; ties by time (null first) and name."""
    key = {v: (t is not None, t, n) if t is not None else (False, n) for v, t, n in zip(ids, times, names, strict=True)}
    after: dict = {v: [] for v in ids}
    left, depth = dict.fromkeys(ids, 0), dict.fromkeys(ids, 1)
    for v, w in zip(src or [], dst or [], strict=True):
        if v in key and w in key:
            after[v].append(w)
            left[w] += 1
    if all(key[v] < key[w] for v in after for w in after[v]):  # the order of the keys is the one; no heap is needed
        out = []
        for v in sorted(ids, key=key.__getitem__):
            d = depth[v] + 1
            out.append((v, len(out) + 1, d - 1))
            for w in after[v]:
                if depth[w] < d:
                    depth[w] = d
        return out
    free = [(key[v], v) for v in ids if not left[v]]
    heapq.heapify(free)
    out = []
    while free:
        _, v = heapq.heappop(free)
        out.append((v, len(out) + 1, depth[v]))
        for w in after[v]:
            depth[w] = max(depth[w], depth[v] + 1)
            left[w] -= 1
            if not left[w]:
                heapq.heappush(free, (key[w], w))
    return out


def flooded(src: list, dst: list, seeds: list) -> list[tuple]:
    """The nodes that some seed reaches by one link or more."""
    near, met = _near(src, dst), set()
    front = list(seeds)
    while front:
        v = front.pop()
        for w in near.get(v, ()):
            if w not in met:
                met.add(w)
                front.append(w)
    return [(v,) for v in met]


def _order(time, name) -> tuple:
    """(time, name) as a key: an unknown time comes first."""
    return (time is not None, time if time is not None else 0, name)


def _quality(score) -> tuple:
    """A score as a key: from bad to good, not a number and then unknown last."""
    return (1, False, 9.9) if score is None else (0, score != score, score if score == score else 0.0)


def shortest(starts: list, ends: list | None, ids: list | None, scores: list, times: list, names: list, src: list | None, dst: list | None) -> list[tuple]:
    """(start, path) to each end that a start reaches, or the start alone. One flood back from an end gives all distances; a path then takes
    the least node by (score, time, name) that is one step nearer, which makes it the least of the shortest ones."""
    key = {v: (*_quality(s), *_order(t, n)) for v, s, t, n in zip(ids or [], scores or [], times or [], names or [], strict=True)}
    links = [(v, w) for v, w in zip(src or [], dst or [], strict=True) if w in key]
    near, back = _near([v for v, _ in links], [w for _, w in links]), _near([w for _, w in links], [v for v, _ in links])
    out, met = [], set()
    for end in ends or []:
        far, front = {end: 0}, [end]
        while front:
            up = []
            for w in front:
                for v in back.get(w, ()):
                    if v not in far:
                        far[v] = far[w] + 1
                        up.append(v)
            front = up
        for v in starts:
            if v in far:
                path = [v]
                while path[-1] != end:
                    path.append(min((w for w in near[path[-1]] if far.get(w) == far[path[-1]] - 1), key=key.__getitem__))
                met.add(v)
                out.append((v, path))
    return out + [(v, [v]) for v in starts if v not in met]


def producers(sinks: list, ids: list, names: list, times: list, verifier: list, src: list | None, dst: list | None) -> list[tuple]:
    """For each sink the last by (time, name) among the nearest nodes above it that are no verifiers, or its own name."""
    fact = {v: (_order(t, n), n, c) for v, t, n, c in zip(ids, times, names, verifier, strict=True)}
    back, out = _near(dst, src), set()
    for sink in sinks:
        met, front, made = {sink}, [sink], []
        while front and not made:
            front = [p for w in front for p in back.get(w, ()) if p in fact and not (p in met or met.add(p))]
            made = [fact[p][:2] for p in front if not fact[p][2]]
        out.add(max(made)[1] if made else fact[sink][1])
    return [(n,) for n in out]


def falls(ids: list, scores: list, times: list, names: list, src: list, dst: list, healthy: float, step: float, edges: int, drop: float) -> list[tuple]:
    """(head, path, drop): from each healthy node on to the worst next one while the score falls by ``step`` at least; paths of more than
    ``edges`` nodes that fall by ``drop`` in all, but for those within another."""
    score = dict(zip(ids, scores, strict=True))
    key = {v: (s != s, s if s == s else 0.0, *_order(t, n)) for v, s, t, n in zip(ids, scores, times, names, strict=True)}
    after: dict = {}
    for v, w in zip(src, dst, strict=True):
        if v in score and w in score and not score[v] - score[w] < step and (v not in after or key[w] < key[after[v]]):
            after[v] = w
    end: dict = {}  # of a node: the last of its chain, and the chain's length
    for v in score:
        chain = []
        while v not in end and v in after:
            chain.append(v)
            v = after[v]
        last, n = end.setdefault(v, (v, 1))
        for w in reversed(chain):
            n += 1
            end[w] = (last, n)
    good = [v for v in score if not score[v] < healthy and end[v][1] > edges and not score[v] - score[end[v][0]] < drop]  # not a number is the highest
    inner: set = set()
    for v in good:
        w = after.get(v)
        while w is not None and w not in inner:
            inner.add(w)
            w = after.get(w)
    out = []
    for v in good:
        if v not in inner:
            path = [v]
            while path[-1] in after:
                path.append(after[path[-1]])
            out.append((v, path, score[v] - score[path[-1]]))
    return out


def pieces(nodes: list, links: list[tuple]) -> tuple[int, list]:
    """Weakly connected components that hold some of ``nodes``, and the nodes whose removal splits one: one depth-first walk with low
    links (Hopcroft and Tarjan, 1973), linear in nodes and links. Ends of links that are no nodes connect, but don't count."""
    near: dict = {v: [] for v in nodes}
    for v, w in links:
        near.setdefault(v, []).append(w)
        near.setdefault(w, []).append(v)
    known, place, low, count, points = set(nodes), {}, {}, 0, []
    for root in near:
        if root in place:
            continue
        place[root] = low[root] = len(place)
        up, walk = {root: None}, [(root, iter(near[root]))]
        while walk:
            v, rest = walk[-1]
            for w in rest:
                if w not in place:
                    place[w] = low[w] = len(place)
                    up[w] = v
                    walk.append((w, iter(near[w])))
                    break
                low[v] = min(low[v], place[w])
            else:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[v])
        holds, apart = {v: int(v in known) for v in up}, {v: [] for v in up}
        for v in reversed(up):  # children before their parents
            above = up[v]
            if above is not None:
                holds[above] += holds[v]
                if low[v] >= place[above] and holds[v]:
                    apart[above].append(holds[v])
        count += holds[root] > 0
        points += [v for v in up if v in known and len(apart[v]) + (holds[root] - 1 > sum(apart[v])) > 1]
    return count, points


def linked(links: DataFrame, key: list[str]) -> DataFrame:
    """key…, src and dst: the distinct links (key…, src, dst) of each graph as two lists."""
    each = links.groupBy(*key).agg(F.collect_set(F.struct("src", "dst")).alias("_l"))
    return each.select(*key, F.col("_l.src").alias("src"), F.col("_l.dst").alias("dst"))


def below(links: DataFrame, seeds: DataFrame, key: list[str]) -> DataFrame:
    """(key…, dst): what lies below some seed (key…, src) by ``links`` (key…, src, dst); a seed itself only if another, or a cycle, leads
    to it. Graphs without seeds aren't walked."""
    start = seeds.groupBy(*key).agg(F.collect_set("src").alias("seeds"))
    rows = linked(links, key).join(start, key).select(*key, "src", "dst", "seeds")
    return each_graph(rows, flooded, [T.StructField("dst", links.schema["dst"].dataType)], len(key))


def unshadowed(ids: list, names: list, src: list | None, dst: list | None) -> list[tuple]:
    """(node, name) of those that no other of them reaches. One alone isn't reached, as links have no cycle."""
    under = {v for (v,) in flooded(src, dst, ids)} if src and len(ids) > 1 else ()
    return [(v, n) for v, n in zip(ids, names, strict=True) if v not in under]
