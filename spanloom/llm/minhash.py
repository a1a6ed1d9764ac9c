"""MinHash near-dedup: bottom-k sketches from one hash function.

The k smallest hashes of a document's shingles are its sketch. Documents with the same set of shingles count as one from the
start. Inverted lists of retained values give candidates; the overlap of two sketches within the sketch of their union
estimates their Jaccard similarity and filters; the full sets, made again from the texts, decide.

Two documents at the threshold share so many values of their sketches that listing a document under its rarest few is enough:
if o values are common, the rarest common one is among the k - o + 1 rarest of either side. o is set so that a linked pair has
fewer with a probability of one in a million at most; where both sets are complete, o is exact.

* First level, all documents, k = 32. Lists of up to ``SHORT`` members give all their pairs.
* Second level, only members of longer lists, k = 1,024: nearly always the whole set. Lists are kept by bands of sizes 5 % apart,
  since two sets of like size must share nearly 8/9 of their values: the larger document probes the bands of partners down to 4/5
  of its size. A common passage, or a group of copies that have drifted apart, gives long lists on the first level and few on this.
  In some rounds one pivot a list meets the others, so that groups of copies become one component with few comparisons. In
  the last round the rows outside a list's largest component meet all rows of other components.

Within the joins, places in the two orders and parity words (a bit for each of 512 buckets; differing bits can't outnumber the
values in one set only) shut out pairs that can't reach the threshold, so these make no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import components

#: Sizes of the sketches of the first and the second level, and bits of the parity words.
K, K2, BITS = 32, 1024, 512
#: Lists up to this length give all pairs at once. Rounds of pivots in longer ones. Members of one pivot in one task.
SHORT, ROUNDS, MEMBERS = 6, 4, 400
#: Up to so many ids (some 60 MB with their table) are broadcast.
BROADCAST = 1 << 20
#: Ratio of sizes within one band of the second level.
BAND = 1.05
#: Chance that a pair at the threshold shares fewer values than assumed, and the standard deviations that this is.
MISS, SIGMAS = 1e-6, 4.9


def least_common(k: int, share: float) -> int:
    """The number of successes that k draws of chance ``share`` fail to reach with a probability of MISS at most."""
    total, n = 0.0, 0
    while n < k:
        total += math.comb(k, n) * share**n * (1 - share) ** (k - n)
        if total > MISS:
            break
        n += 1
    return n


def shingle_sets(texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's shingles in a row, and the cuts between texts. Shorter texts: their whole sequence."""
    lists = [common.words_of(t, lower=True) for t in texts]
    counts = np.array([len(x) for x in lists], np.int64)
    flat = np.empty(int(counts.sum()), dtype=object)
    flat[:] = [w for x in lists for w in x]
    ids, words = pd.factorize(flat) if len(flat) else (np.zeros(0, np.int64), [])
    digest = xxhash.xxh3_64_intdigest
    word = np.array([digest(w) for w in words], np.uint64)[ids] if len(flat) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(texts)), counts)
    end = np.cumsum(counts)
    left = end[doc] - np.arange(len(flat))
    full = np.flatnonzero(left >= size)
    base = np.uint64(0x9E3779B97F4A7C15)
    h = np.zeros(len(full), np.uint64)
    for k in range(size):
        h = h * base + word[full + k]
    owner = doc[full]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        extra = np.array([digest(b" ".join(lists[i])) for i in short], np.uint64)
        h, owner = np.concatenate([h, extra]), np.concatenate([owner, short])
    h = common.mix(h)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(len(texts) + 1))


def sketches(docs: DataFrame, size: int, k: int, parity: bool = False) -> DataFrame:
    """doc_id, n (number of shingles), two sums that name the set, its sketch of k values, and the parity words of the whole set."""
    fields = [docs.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("n", "s1", "s2")), *(T.StructField(c, T.ArrayType(T.LongType(), False)) for c in ("sketch", "parity")[: 1 + parity])]
    names = [x.name for x in fields]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for rows in common.batches(part):
                h, cut = shingle_sets(rows.column(1).to_pylist(), size)
                n = np.diff(cut)
                sums = []
                for salt in (0, 1):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(common.mix(h ^ np.uint64(salt * 0xA5A5A5A5A5A5)), dtype=np.uint64)])
                    sums.append((total[cut[1:]] - total[cut[:-1]]).view(np.int64))
                take = np.minimum(n, k)
                at = np.repeat(cut[:-1] - np.concatenate([[0], np.cumsum(take)[:-1]]), take) + np.arange(int(take.sum()))
                values = (h[at] >> np.uint64(1)).view(np.int64)  # positive, in the same order
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(take)]).astype(np.int32)), pa.array(values))]
                if parity:
                    bucket = np.repeat(np.arange(len(n)), n) * BITS + (common.mix(h) % np.uint64(BITS)).astype(np.int64)
                    odd = (np.bincount(bucket, minlength=len(n) * BITS) & 1).astype(np.uint8)
                    words = np.packbits(odd).view(np.int64)
                    lists.append(pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * (BITS // 64)), pa.array(words)))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n), pa.array(sums[0]), pa.array(sums[1]), *lists], names=names)

    return docs.select("doc_id", "text").mapInArrow(common.task(run), T.StructType(fields))


def _estimate(a: Column, b: Column) -> Column:
    """Jaccard similarity from the k smallest values of the union: the part of them that both sketches hold."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, K)
    return F.size(F.array_intersect(union, F.array_intersect(a, b))) / F.size(union)


def _ranked(sketched: DataFrame) -> DataFrame:
    """rep, s1, size, k, found: the values of each sketch that occur in others too, the rarest first, with the place of each in the
    order of all its values (those that occur once come first)."""
    values = sketched.select("rep", "s1", F.col("n").alias("size"), F.size("sketch").alias("k"), F.explode("sketch").alias("value"))
    several = values.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found = values.join(several, "value").groupBy("rep", "s1", "size", "k").agg(F.sort_array(F.collect_list(F.struct("n", "value"))).alias("found"))
    return found.withColumn("own", F.col("k") - F.size("found"))


def _lists(reps: DataFrame, share: float) -> DataFrame:
    """(value, rep, size) of the first level: the rarest values of each sketch that occur in several."""
    # Of a set so small that its partners' sketches are complete too, the least number of common values is exact.
    rooms = [k - (math.ceil(share * k - 1e-9) if k <= share * K else least_common(k, share)) + 1 for k in range(1, K + 1)]
    room = F.element_at(F.array(*map(F.lit, rooms)), F.col("k")) - F.col("own")
    return (_ranked(reps).withColumn("room", room.cast("int")).where("room > 0")
            .select("rep", "size", F.explode(F.slice("found", F.lit(1), F.col("room"))).alias("x")).select(F.col("x.value").alias("value"), "rep", "size"))


def _short_pairs(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of the lists of up to SHORT members, and the members of longer lists."""
    about = lists.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    lists = lists.join(about, "value")
    groups = lists.where(F.col("n") <= SHORT).groupBy("value").agg(F.sort_array(F.collect_list(F.struct("rep", "size"))).alias("m"))
    each = groups.select("m", F.posexplode("m").alias("i", "x")).select("x", F.explode(F.slice("m", F.col("i") + 2, F.lit(SHORT))).alias("y"))
    pairs = each.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), F.col("x.size").alias("an"), F.col("y.size").alias("bn"))
    return pairs, lists.where(F.col("n") > SHORT).select("rep").distinct()


def _like_sizes(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _second_lists(sketched: DataFrame, percent: int, s: common.Scratch) -> tuple[DataFrame, DataFrame]:
    """(value, band, rep, size, k, place, parity) of the second level, twice: what is filed and what is probed.

    A document is filed under its band for partners as large or larger, and probes its own band and the smaller ones."""
    share = percent / 100
    both = share / (1 + share)  # common values are at least this part of both sizes together
    n, k = F.col("size"), F.col("k")
    ranked = s.written(_ranked(sketched).join(sketched.select("rep", "s1", "parity"), ["rep", "s1"]))
    band = lambda x: F.floor(F.log(x) / math.log(BAND) + 1e-9).cast("int")

    def rows(rooms: Column, bands: Column) -> DataFrame:
        some = ranked.withColumn("band", bands).withColumn("room", (rooms - F.col("own")).cast("int")).where("room > 0")
        each = some.select("rep", "size", "k", "own", "parity", "band", F.posexplode(F.slice("found", F.lit(1), F.col("room"))).alias("i", "x"))
        return each.select(F.col("x.value").alias("value"), "band", "rep", "size", "k", (F.col("own") + F.col("i")).alias("place"), "parity")

    whole = F.ceil(n / share) <= K2
    filed = rows(F.when(whole, n - F.ceil(2 * both * n - 1e-9) + 1).otherwise(k - F.floor(share * k - SIGMAS * math.sqrt(share * (1 - share)) * F.sqrt(k)) + 1), band(n))
    low = F.greatest(F.ceil(F.pow(F.lit(BAND), F.col("band")) - 1e-6), F.ceil(share * n - 1e-9))
    part = F.least(F.lit(1.0), both * (1 + F.least(low, n) / n))
    sampled = k - F.floor(part * k - SIGMAS * F.sqrt(part * (1 - part) * k)) + 1
    probed = rows(F.when(F.greatest(n, F.pow(F.lit(BAND), F.col("band") + 1)) <= K2, n - F.ceil(part * n - 1e-9) + 1).otherwise(sampled), F.explode(F.sequence(band(F.greatest(F.ceil(share * n - 1e-9), F.lit(1))), band(n))))
    filed = s.written(filed)
    there = filed.select("value", "band").distinct()
    return filed, s.written(probed.join(there, ["value", "band"], "left_semi"))


def _possible(percent: int) -> Column:
    """Whether rows x and y of one list may be documents at the threshold: other components, like sizes, and neither the places of the
    value nor the parity words shut it out. The value may be taken as the first that both have: with that one the pair passes."""
    need = F.ceil(percent / (100 + percent) * (F.col("x.size") + F.col("y.size")) - F.lit(1e-9))
    apart = sum((F.bit_count(F.get("x.parity", F.lit(i)).bitwiseXOR(F.get("y.parity", F.lit(i)))) for i in range(BITS // 64)), F.lit(0))
    whole = (F.col("x.size") <= K2) & (F.col("y.size") <= K2)
    return ((F.col("x.comp") != F.col("y.comp")) & _like_sizes("x.size", "y.size", percent) & (apart + 2 * need <= F.col("x.size") + F.col("y.size"))
            & (~whole | (F.least(F.col("x.k") - F.col("x.place"), F.col("y.k") - F.col("y.place")) >= need)))


def _candidates(filed: DataFrame, probed: DataFrame, comps: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs (a, b) of different components in one list: a pivot with each other member, or in the last round each row outside the
    list's largest component with each row of another component."""
    label = lambda rows: rows.join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    x, y = label(filed), label(probed)
    key = ["value", "band"]
    sizes = y.groupBy(*key, "comp").agg(F.count(F.lit(1)).alias("n"))
    about = sizes.groupBy(*key).agg(F.count(F.lit(1)).alias("comps"), F.max(F.struct("n", "comp"))["comp"].alias("main")).where("comps > 1").drop("comps")
    on = F.expr("x.value = y.value and x.band = y.band") & _possible(percent)
    pair = lambda joined: joined.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), F.col("x.size").alias("an"), F.col("y.size").alias("bn"))
    if turn < ROUNDS:
        first = F.struct(F.xxhash64("rep", F.lit(turn)), *(c for c in x.columns if c not in key))
        pivots = x.join(about, key, "left_semi").groupBy(*key).agg(F.min(first).alias("p")).select(*key, "p.*")
        return pair(pivots.alias("x").join(y.alias("y"), on))
    x, y = (rows.join(about, key) for rows in (x, y))
    outside = pair(x.where("comp <> main").alias("x").join(y.alias("y"), on))
    return outside.union(pair(x.where("comp = main").alias("x").join(y.where("comp <> main").alias("y"), on)).select("b", "a", "bn", "an"))


def _promising(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, an, bn) of like sizes whose sketches of the first level let the threshold seem possible."""
    share = percent / 100
    pairs = pairs.where(_like_sizes("an", "bn", percent)).select("a", "b").distinct()
    a = reps.select(F.col("rep").alias("a"), F.col("sketch").alias("ask"))
    b = reps.select(F.col("rep").alias("b"), F.col("sketch").alias("bsk"))
    out = pairs.join(a, "a").join(b, "b")
    return out.where(_estimate(F.col("ask"), F.col("bsk")) >= share - SIGMAS * math.sqrt(share * (1 - share) / K)).select("a", "b")


def _texts(docs: DataFrame, ids: DataFrame, s: common.Scratch) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) whose ids are in ``ids`` (doc_id, each once): few enough ids go to the executors whole, so that
    only the texts needed are shuffled later; more are joined by shuffling both."""
    ids = s.written(ids)
    small = ids.limit(BROADCAST + 1).count() <= BROADCAST
    return docs.select("doc_id", "text").join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")


def _confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int, s: common.Scratch) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= percent * union. A pivot's members are dealt over several
    groups when they are many; a group is read in order, the pivot first, so a task holds one set at a time."""
    fan = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("parts"))
    member = pairs.join(fan, "a").select(F.col("b").alias("doc_id"), F.col("a").alias("pivot"), F.pmod(F.xxhash64("b"), "parts").alias("part"), F.lit(1).alias("role"))
    pivot = fan.select(F.col("a").alias("doc_id"), F.col("a").alias("pivot"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"))
    roles = member.union(pivot)
    roles = s.written(roles)
    rows = _texts(docs, roles.select("doc_id").distinct(), s).join(roles, "doc_id").select("pivot", "part", "role", "doc_id", "text")
    rows = rows.repartition("pivot", "part").sortWithinPartitions("pivot", "part", "role")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, bases = None, []
        for whole in parts:
            for rows in common.batches(whole):
                h, cut = shingle_sets(rows.column(4).to_pylist(), size)
                a, b = [], []
                for i, (p, part, role, doc) in enumerate(zip(*(rows.column(k).to_pylist() for k in range(4)), strict=True)):
                    own = h[cut[i] : cut[i + 1]]
                    if role == 0:
                        bases = [*(bases if group == (p, part) else []), own.copy()]
                        group = (p, part)
                    elif group == (p, part) and len(own):
                        both = [(len(np.intersect1d(base, own, assume_unique=True)), len(base)) for base in bases]
                        if any(100 * n >= percent * (size_of + len(own) - n) for n, size_of in both):
                            a.append(p)
                            b.append(doc)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(common.task(run), "a long, b long")


def _joined(comps: DataFrame, links: DataFrame, s: common.Scratch) -> DataFrame:
    """``comps`` (node, comp) with the components that ``links`` (a, b) connect made one."""
    label = lambda c: comps.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_comp"))
    between = links.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b"))
    new = components(between, s)
    every = comps.union(new.join(comps, "node", "left_anti").select("node", F.col("node").alias("comp")))
    root = new.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
    return s.written(every.join(root, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of ``docs`` (doc_id: an integer).

    A null or empty text has no shingles and is linked with nothing. A row without an id goes with a
    document of the same set of shingles, if there is one; else it is linked with nothing, its component_id is null and it is kept.
    Rows that repeat an id are one document, whose links are those of all its texts. Other columns are ignored; no rows give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with common.Scratch(docs.sparkSession, "minhash") as s:
        return s.result(_near_duplicates(docs, size, percent, s))


def _near_duplicates(docs: DataFrame, size: int, percent: int, s: common.Scratch) -> DataFrame:
    share, name = percent / 100, ["n", "s1", "s2"]
    every = s.written(sketches(docs, size, K))
    classes = s.written(every.where("n > 0 and doc_id is not null").groupBy(*name).agg(F.min("doc_id").alias("rep")))
    reps = every.join(classes, name).where("doc_id = rep").select("rep", *name, "sketch").dropDuplicates(["rep", *name])
    reps = s.written(reps)

    pairs, long = _short_pairs(s.written(_lists(reps, share)))
    pairs = s.written(_promising(pairs, reps, percent))
    links = s.written(_confirmed(pairs, docs, size, percent, s))
    several = every.where("n > 0").groupBy("doc_id").agg(F.min(F.struct(*name)).alias("x"), F.max(F.struct(*name)).alias("y")).where("x <> y").select("doc_id")
    same = every.join(several, "doc_id").join(classes, name).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    comps = components(links.union(same), s)

    fine = sketches(_texts(docs, long.withColumnRenamed("rep", "doc_id"), s), size, K2, parity=True).where("n > 0").dropDuplicates(["doc_id", *name]).withColumnRenamed("doc_id", "rep")
    filed, probed = _second_lists(s.written(fine), percent, s)
    tested, turn = None, 0
    while turn <= ROUNDS:
        pairs = _promising(_candidates(filed, probed, comps, turn, percent), reps, percent)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti").join(tested.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti")
        pairs = s.written(pairs)
        tested = pairs if tested is None else tested.union(pairs)
        good = s.written(_confirmed(pairs, docs, size, percent, s))
        found = not good.isEmpty()
        comps = _joined(comps, good, s) if found else comps
        turn = turn + 1 if found or turn == ROUNDS else ROUNDS  # pivots that link nothing more: on to the round of all pairs
    out = every.join(classes, name, "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    out = out.join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component_id", F.coalesce("comp", "rep"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_first(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each group of near duplicates; columns as given, whatever their names.

    Each distinct pair of id and text is a document of its own here, so rows without an id, and texts that share one, are compared like
    any others. Rows that repeat both stay or go together."""
    row = F.struct(*(docs[f"`{c}`"].alias(c) for c in docs.columns)).alias("row")  # in one column, the given names clash with none here
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row)
    with common.Scratch(docs.sparkSession, "keep") as s:
        rows, names = common.numbered(given.drop("row"), s)
        found = _near_duplicates(rows.select(F.col("doc").alias("doc_id"), "text"), size, percent, s)
        stay = found.where("kept").select(F.col("doc_id").alias("doc")).distinct()
        return common.matched(given, stay, names, s, "left_semi").select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
