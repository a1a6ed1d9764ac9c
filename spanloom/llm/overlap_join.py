"""N-gram Jaccard join by T-occurrence search with DivideSkip (Li, Lu and Lu, 2008).

A document of n shingles shares at least T = ceil(n * percent / 100) of them with any partner. So of its inverted lists any T - 1 may be
set aside: a partner stands in one of the others. The long lists are the ones to set aside, as they cost most to merge.

* First over all documents, to find those that may have a partner at all. Of each set only a beginning is listed, by order of hash: its
  n - T + 1 smallest values hold one that both sides have, and with e more values, 1 + e such values. So with half as many more listed,
  each side can drop its e most frequent values, be they a passage that a third of all documents share, and some rare value remains that both
  list. Whoever meets nobody in such a list is done.
* Then over whole sets of the others. Their lists are counted again; each keeps all but its T - 1 longest ones. Documents that meet in
  these lists form clusters, which are dealt into blocks of like sizes and bounded weight.
* Within a block, or a pair of blocks, the search itself: a query merges its short lists, L of the longest left out; documents that occur T - L
  times are then looked up in each long list by binary search. A link that joins nothing new isn't looked for. First each block alone,
  then the heads of what is linked, and at last the pairs of blocks that still have different components. A task says which
  components its links make one.

Values are 64-bit hashes; documents with the same set of shingles are one from the start.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import components
from .minhash import _texts, shingle_sets

#: Documents and values of one block, and the ratio of sizes within a band.
BLOCK_DOCS, BLOCK_VALUES, BAND = 512, 1 << 18, 1.05
#: Cost of a probe against that of a merged entry: more of it leaves fewer lists out of the merge.
PROBE = 0.01


def least(n, percent: int):
    """Shingles that a set of n shares with any partner, at least."""
    return -(-n * percent // 100)


def _sums(h: np.ndarray, cut: np.ndarray) -> list[np.ndarray]:
    out = []
    for salt in (0, 1):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(common.mix(h ^ np.uint64(salt * 0xA5A5A5A5A5A5)), dtype=np.uint64)])
        out.append((total[cut[1:]] - total[cut[:-1]]).view(np.int64))
    return out


def sets(docs: DataFrame, size: int, percent: int | None = None) -> DataFrame:
    """doc_id, n, two sums that name the set, and its values in order: all, or with ``percent`` the beginning that is listed."""
    fields = [docs.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("n", "s1", "s2")), T.StructField("list", T.ArrayType(T.LongType(), False))]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for rows in common.batches(part):
                h, cut = shingle_sets(rows.column(1).to_pylist(), size)
                n = np.diff(cut)
                take = n if percent is None else n - least(n, percent) + (n > 0) + extra(n, percent)
                at = np.repeat(cut[:-1] - np.concatenate([[0], np.cumsum(take)[:-1]]), take) + np.arange(int(take.sum()))
                values = (h[at] >> np.uint64(1)).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(take)]).astype(np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n), *map(pa.array, _sums(h, cut)), lists], names=[f.name for f in fields])

    return docs.select("doc_id", "text").mapInArrow(common.task(run), T.StructType(fields))


def extra(n, percent: int):
    """Values listed beyond the necessary beginning: half as many, as far as the set goes. It never falls as n grows."""
    need = least(n, percent)
    return np.maximum(np.minimum((n - need + 1) // 2, need - 1), 0)


def _counted(rows: DataFrame, drop: Column) -> DataFrame:
    """(rep, value): of each set of ``rows`` (rep, number, n, list) the values that others list too, without its ``drop`` most frequent. The
    values travel with the number of their set alone, which takes few bytes."""
    values = rows.select("number", F.explode("list").alias("value"))
    several = values.groupBy("value").agg(F.count(F.lit(1)).cast("int").alias("times")).where("times > 1")
    found = values.join(several, "value").groupBy("number").agg(F.sort_array(F.collect_list(F.struct("times", "value"))).alias("found"))
    found = found.join(rows.select("rep", "number", "n"), "number").withColumn("keep", (F.size("found") - drop).cast("int")).where("keep > 0")
    return found.select("rep", F.explode(F.slice("found", F.lit(1), F.col("keep"))["value"]).alias("value"))


def _least(n: Column, percent: int) -> Column:
    return F.floor((n * percent + 99) / 100)


def overlap_links(values: list[np.ndarray], query: np.ndarray, label: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (i, j) between sets of ``values`` (sorted, without repeats) that join what ``label`` and the links before keep apart.

    Sets not marked in ``query`` are indexed and those marked probe them; with no marks, each set probes the ones before it."""
    own = not query.any()
    index = np.flatnonzero(~query)
    size = np.array([len(v) for v in values], np.int64)
    flat, holder = np.concatenate([values[i] for i in index]), np.repeat(index, size[index])
    order = np.lexsort((holder, flat))
    flat, holder = flat[order], holder[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    kinds, begin = flat[new], np.flatnonzero(new)
    length = np.diff(np.concatenate([begin, [len(flat)]]))
    many = len(values)
    entry = (np.cumsum(new) - 1) * many + holder  # sorted: each list in turn, documents in order
    label, links = label.copy(), []
    for q in range(many) if own else np.flatnonzero(query):
        n, need = len(values[q]), least(len(values[q]), percent)
        at = np.searchsorted(kinds, values[q])
        at = at[(at < len(kinds)) & (kinds[np.minimum(at, len(kinds) - 1)] == values[q])]
        if len(at) < need:
            continue
        at = at[np.argsort(length[at], kind="stable")]
        out = min(need - 1, int(need / (PROBE * math.log2(length[at[-1]] + 1) + 1)))
        short, long = at[: len(at) - out], at[len(at) - out :]
        run = length[short]
        place = np.repeat(begin[short] - np.concatenate([[0], np.cumsum(run)[:-1]]), run) + np.arange(int(run.sum()))
        times = np.bincount(holder[place], minlength=many)
        wanted = -(-percent * (n + size) // (100 + percent))
        fit = (times >= need - out) & (times + out >= wanted) & (100 * np.minimum(n, size) >= percent * np.maximum(n, size)) & (label != label[q])
        if own:
            fit[q:] = False
        some = np.flatnonzero(fit)
        if not len(some):
            continue
        probe = long[:, None] * many + some[None, :]
        spot = np.minimum(np.searchsorted(entry, probe), len(entry) - 1)
        both = times[some] + (entry[spot] == probe).sum(0)
        for other in some[both >= wanted[some]]:
            if label[other] != label[q]:
                links.append((int(q), int(other)))
                label[label == label[other]] = label[q]
    return links


def _merged(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(label, least label that ``pairs`` connect it with), where these differ."""
    over: dict[int, int] = {}

    def top(x: int) -> int:
        while over.get(x, x) != x:
            x = over[x]
        return x

    for x, y in pairs:
        x, y = top(x), top(y)
        over[max(x, y)] = min(x, y)
    return [(x, top(x)) for x in over if top(x) != x]


def _searched(units: DataFrame, percent: int) -> DataFrame:
    """(comp, least): which components of each unit of ``units`` (unit, role, rep, comp, list) its links make one, each with the least of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, role, rep, comp, values = None, [], [], [], []

        def links() -> pa.RecordBatch:
            names, label = np.unique(np.array(comp, np.int64), return_inverse=True)
            found = overlap_links(values, np.array(role) == 1, label, percent) if len(names) > 1 and 0 in role else []
            pairs = _merged([(comp[i], comp[j]) for i, j in found])
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], names=["comp", "least"])

        for batch in batches:
            lists = batch.column(4)
            cuts, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            for k, (u, r, i, c) in enumerate(zip(*(batch.column(x).to_pylist() for x in range(4)), strict=True)):
                if u != unit:
                    if len(rep) > 1:
                        yield links()
                    unit, role, rep, comp, values = u, [], [], [], []
                role.append(r)
                rep.append(i)
                comp.append(c)
                values.append(flat[cuts[k] : cuts[k + 1]].copy())
        if len(rep) > 1:
            yield links()

    rows = units.select("unit", "role", "rep", "comp", "list").repartition("unit").sortWithinPartitions("unit", "role", "rep")
    return rows.mapInArrow(common.task(run), "comp long, least long")


def _blocks(docs: DataFrame) -> DataFrame:
    """``docs`` (cluster, rep, n, …) with band and part, the name of its block, and several: whether its cluster has more than one. Blocks
    hold like sizes of one cluster and are bounded in documents and values."""
    parts = lambda: F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_DOCS, F.sum("n") / BLOCK_VALUES))
    whole = docs.groupBy("cluster").agg((parts() > 1).alias("several"))
    docs = docs.join(whole, "cluster").withColumn("band", F.when(F.col("several"), F.floor(F.log("n") / math.log(BAND) + 1e-9)).otherwise(0).cast("int"))
    many = docs.groupBy("cluster", "band").agg(parts().alias("parts"))
    return docs.join(many, ["cluster", "band"]).withColumn("part", F.pmod(F.xxhash64("rep"), "parts").cast("int")).drop("parts")


def _unit(*columns: str) -> Column:
    return F.concat_ws(":", *columns).alias("unit")


def _relabelled(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """``rows`` with comp replaced by what ``merged`` (comp, least) has for it."""
    return rows.join(merged, "comp", "left").withColumn("comp", F.coalesce("least", "comp")).drop("least")


def _clusters(full: DataFrame, percent: int, s: common.Scratch) -> DataFrame:
    """(rep, cluster): documents that meet in lists that count."""
    lists = s.written(_counted(full, _least(F.col("n"), percent) - 1))
    first = lists.groupBy("value").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).where("first <> last").select("value", "first")
    meet = lists.join(first, "value").where("rep <> first").select(F.col("rep").alias("a"), F.col("first").alias("b")).distinct()
    return components(meet, s).select(F.col("node").alias("rep"), F.col("comp").alias("cluster"))


def _cluster_comps(full: DataFrame, percent: int, s: common.Scratch) -> tuple[DataFrame, DataFrame | None]:
    """(rep, comp) of documents of ``full`` (rep, number, n, list) that may have a partner, and (a, b): links between these components, if any."""
    docs = s.written(_blocks(full.select("rep", "n", "list").join(_clusters(full, percent, s), "rep")).withColumn("comp", F.col("rep")))
    merged = s.written(_searched(docs.select(_unit("cluster", "band", "part"), F.lit(0).alias("role"), "rep", "comp", "list"), percent))
    comps = s.written(_relabelled(docs.drop("list"), merged))
    # Heads of components of several members in clusters of several blocks, as long as these heads fill several blocks and still link.
    wide = docs.where("several").select("rep", "list")
    if wide.isEmpty():
        return comps.select("rep", "comp"), None
    several = True
    while several:
        heads = comps.where("several").groupBy("comp").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select(F.col("comp").alias("rep"))
        heads = s.written(_blocks(comps.select("cluster", "rep", "n").join(heads, "rep").dropDuplicates(["rep"])))
        more = s.written(_searched(heads.select(_unit("cluster", "band", "part"), F.lit(0).alias("role"), "rep", F.col("rep").alias("comp")).join(wide, "rep"), percent))
        several = not more.isEmpty() and not heads.where("several").isEmpty()
        comps = s.written(_relabelled(comps, more))

    # Pairs of blocks whose sizes may be near each other and that have different components.
    key = ["cluster", "band", "part"]
    about = comps.where("several").groupBy(*key).agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("comp").alias("c1"), F.max("comp").alias("c2"))
    reach = math.ceil(math.log(100 / percent) / math.log(BAND)) + 1
    a = about.select("cluster", *(F.col(c).alias(f"a_{c}") for c in about.columns[1:]), F.explode(F.sequence(F.col("band") - reach, F.col("band"))).alias("b_band"))
    b = about.select("cluster", *(F.col(c).alias(f"b_{c}") for c in about.columns[1:]))
    pairs = a.join(b, ["cluster", "b_band"]).where("b_band < a_band or b_part < a_part").where(F.col("b_high") * 100 >= F.col("a_low") * percent)
    pairs = s.written(pairs.where("least(a_c1, b_c1) <> greatest(a_c2, b_c2)").select(_unit("cluster", "a_band", "a_part", "b_band", "b_part"), "cluster", "a_band", "a_part", "b_band", "b_part"))
    side = lambda x, role: pairs.select("unit", F.lit(role).alias("role"), "cluster", F.col(f"{x}_band").alias("band"), F.col(f"{x}_part").alias("part"))
    units = side("a", 0).union(side("b", 1)).join(comps.select(*key, "rep", "comp"), key).join(wide, "rep")
    links = s.written(_searched(units, percent).select(F.col("comp").alias("a"), F.col("least").alias("b")))
    return comps.select("rep", "comp"), None if links.isEmpty() else links


def overlap_join(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of ``docs`` (doc_id: an integer): documents are linked whose sets of distinct
    ``size``-word shingles have 100 * intersection >= percent * union; shorter texts have their whole sequence as one shingle.

    A null or empty text, or one without words, has no shingles and is linked with nothing. A row without an id goes with a document of
    the same set, if there is one; else it is linked with nothing and its component_id is null. Rows that repeat an id are one document,
    whose links are those of all its texts. Texts may be of any length. Other columns are ignored; no rows give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with common.Scratch(docs.sparkSession, "overlap") as s:
        return s.result(_overlap_join(docs, size, percent, s))


def _overlap_join(docs: DataFrame, size: int, percent: int, s: common.Scratch) -> DataFrame:
    name = ["n", "s1", "s2"]
    with common.Scratch(docs.sparkSession, "beginnings") as first:
        begun = first.written(sets(docs, size, percent).withColumn("number", F.monotonically_increasing_id()))
        every = s.written(begun.select("doc_id", *name))
        classes = s.written(every.where("n > 0 and doc_id is not null").groupBy(*name).agg(F.min("doc_id").alias("rep")))
        reps = begun.join(classes, name).where("doc_id = rep").select("rep", *name, "number", "list").dropDuplicates(["rep", *name])
        low = _least(F.col("n"), percent)  # a partner's size, at least: what it lists beyond the necessary is the least of both
        drop = F.greatest(F.least(F.floor((low - _least(low, percent) + 1) / 2), _least(low, percent) - 1), F.lit(0))
        lists = first.written(_counted(reps, drop))
        met = lists.groupBy("value").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("value")
        near = lists.join(met, "value").select(F.col("rep").alias("doc_id")).distinct()
        texts = _texts(docs, near, s)  # the ids are written by then: the beginnings can go
    full = sets(texts, size).where("n > 0").dropDuplicates(["doc_id", *name]).withColumnRenamed("doc_id", "rep")
    comps, links = _cluster_comps(s.written(full.withColumn("number", F.monotonically_increasing_id())), percent, s)

    # An id with several texts links their sets.
    several = every.where("n > 0").groupBy("doc_id").agg(F.min(F.struct(*name)).alias("x"), F.max(F.struct(*name)).alias("y")).where("x <> y").select("doc_id")
    several = s.written(several.where("doc_id is not null"))
    comps = comps.distinct()
    if not several.isEmpty():
        same = every.join(several, "doc_id").join(classes, name).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        for c in "ab":
            same = same.join(comps.select(F.col("rep").alias(c), "comp"), c, "left").withColumn(c, F.coalesce("comp", c)).drop("comp")
        links = same.select("a", "b") if links is None else links.union(same.select("a", "b"))
    out = every.select("doc_id", *name).join(classes, name, "left").withColumn("rep", F.coalesce("rep", "doc_id")).join(comps, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    if links is not None:
        out = _relabelled(out, components(links, s).select(F.col("node").alias("comp"), F.col("comp").alias("least")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"))
