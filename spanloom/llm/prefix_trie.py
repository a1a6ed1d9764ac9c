"""Conversation prefix trie from composable fingerprints.

A conversation is rebuilt from the head of its base (the conversation at the hundred below) and its own later turns. Neither texts nor
turns are copied for that: a sequence of turns has an element of a monoid, (b^n, h) with n turns and their hash polynomial h modulo
a prime, and the element of a head put before a suffix is the product of both. A turn enters as the 128-bit key of its role and text.

Nodes of the trie are the distinct fingerprints at each depth. That they are the distinct sequences is verified, not assumed: no
two different stored turns may have the same key, and all members of a node must refer to turns of one key at their last place; by
induction over the depth their sequences are then equal. Should either fail, all is done again with other seeds.

A node belongs to its smallest member, and the nodes of one conversation are the lower end of its path. So a sum over a subtree is a sum
over paths: what a conversation owns counts as a whole for the nodes above, and from each place on for its own nodes. No node meets all
its ancestors, and all sums are combined before they are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: The modulus of the fingerprints, the base of their polynomial and its inverse.
PRIME = (1 << 61) - 1
BASE = 0x1234567DEADBEEF % PRIME
INVERSE = pow(BASE, -1, PRIME)
#: Conversations that share a base, and the numbers of turns that a head may have (0 to HEADS - 1).
GROUP, HEADS = 100, 6
#: Rows of one run of a window, and ids in one piece of a list.
RUN, PIECE = 4096, 4096


def _times(a: Column, b: Column) -> Column:
    wide = T.DecimalType(19, 0)
    return (a.cast(wide) * b.cast(wide) % F.lit(PRIME).cast(wide)).cast("long")


def _value(k1: Column, k2: Column) -> Column:
    """The element's value of one turn: its key modulo the prime."""
    return F.pmod(F.pmod(k1, F.lit(PRIME)) + F.pmod(k2, F.lit(1 << 31)) * F.lit(1 << 29) % F.lit(PRIME), F.lit(PRIME))


def then(a: Column, b: Column) -> Column:
    """The product of two elements: the sequence a, then b."""
    return F.struct(_times(a["m"], b["m"]).alias("m"), F.pmod(_times(a["f"], b["m"]) + b["f"], F.lit(PRIME)).alias("f"))


def _element(m, f) -> Column:
    return F.struct(F.lit(m).cast("long").alias("m"), F.lit(f).cast("long").alias("f") if not isinstance(f, Column) else f.alias("f"))


def _products(rows: DataFrame) -> DataFrame:
    """``rows`` (conv, part, i, h, v, …) with the product of the turns of the piece (conv, part) from the h-th turn of the conversation
    up to each: m and f, and own, the number of its turns. One pass over sorted rows, a task holds one element."""
    schema = T.StructType([*rows.schema.fields, T.StructField("m", T.LongType()), T.StructField("f", T.LongType())])
    n = len(rows.columns)
    conv, part, i, h, v = (rows.columns.index(c) for c in ("conv", "part", "i", "h", "v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, m, f = None, 1, 0
        for batch in batches:
            ms, fs = [], []
            for a, b, place, first, value in zip(*(batch.column(k).to_pylist() for k in (conv, part, i, h, v)), strict=True):
                if (a, b) != at:
                    at, m, f = (a, b), 1, 0
                if place >= first:
                    m, f = m * BASE % PRIME, (f * BASE + value) % PRIME
                ms.append(m)
                fs.append(f)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n)), pa.array(ms, pa.int64()), pa.array(fs, pa.int64())], names=schema.names)

    return rows.repartition("conv", "part").sortWithinPartitions("conv", "part", "i").mapInArrow(common.task(run), schema)


def _head_length(conv: Column) -> Column:
    return (F.crc32(conv.cast("string").cast("binary")) % HEADS).cast("int")


def stored_turns(turns: DataFrame, seed: int, s: common.Scratch) -> tuple[DataFrame, DataFrame]:
    """(conv, part, i, k1, k2, size) of every turn, i its place in its conversation, and (conv, part, n, offset) of the pieces.

    Turns are dealt out by ranges, so a conversation of any length spans as many pieces as it needs; only their counts meet."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    each = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), text.alias("text"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), "role", "text"]
    each = each.repartitionByRange(*order).sortWithinPartitions(*order)
    keys = (F.xxhash64(F.lit(seed), F.length("role"), "role", "text").alias("k1"), F.xxhash64(F.lit(seed + 1), "text", F.length("role"), "role").alias("k2"))
    each = each.select("conv", F.monotonically_increasing_id().alias("at"), *keys, F.length("text").alias("size"))
    stored = s.written(each.withColumn("part", F.shiftright("at", 33)))
    pieces = stored.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    pieces = s.written(pieces.withColumn("offset", F.coalesce(F.sum("n").over(W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))))
    placed = stored.join(pieces.select("conv", "part", "first", "offset"), ["conv", "part"])
    return placed.select("conv", "part", (F.col("at") - F.col("first") + F.col("offset")).alias("i"), "k1", "k2", "size"), pieces


def _keys_are_exact(turns: DataFrame, seed: int) -> bool:
    """Whether no two different contents of turns have the same key."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    each = turns.where("conv_id is not null").select(role.alias("role"), text.alias("text")).distinct()
    keys = each.select(F.xxhash64(F.lit(seed), F.length("role"), "role", "text").alias("k1"), F.xxhash64(F.lit(seed + 1), "text", F.length("role"), "role").alias("k2"))
    return keys.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def paths(turns: DataFrame, seed: int, s: common.Scratch) -> DataFrame:
    """(conv, depth, f, k1, k2, size, ends) of every place of every rebuilt conversation, the root included: f names the sequence up to
    there, k1 and k2 its last turn, size that turn's characters; ends: whether the conversation ends there."""
    placed, pieces = stored_turns(turns, seed, s)
    placed = s.written(placed)
    v = _value(F.col("k1"), F.col("k2"))

    # Heads: at most HEADS - 1 turns of each base, with the products of their beginnings.
    turn = F.struct("i", v.alias("v"), "k1", "k2", "size")
    heads = placed.where((F.col("conv") % GROUP == 0) & (F.col("i") < HEADS - 1)).groupBy("conv").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    grown = lambda acc, x: F.concat(acc, F.array(then(F.element_at(acc, -1), F.struct(F.lit(BASE).alias("m"), x["v"].alias("f")))))
    heads = heads.select(F.col("conv").alias("base"), "turns", F.aggregate("turns", F.array(_element(1, 0)), grown).alias("grown"))
    convs = pieces.groupBy("conv").agg(F.sum("n").alias("n")).withColumn("base", F.col("conv") - F.col("conv") % GROUP).withColumn("h", _head_length(F.col("conv")))
    convs = convs.join(heads, "base", "left").withColumn("head", F.least("h", F.coalesce(F.size("turns"), F.lit(0)), F.lit(HEADS)))
    convs = convs.withColumn("head", F.when(F.col("turns").isNull(), 0).otherwise(F.col("head"))).withColumn("length", F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = s.written(convs.withColumn("start", F.coalesce(F.get("grown", F.col("head")), _element(1, 0))))

    # Products within pieces, then of the pieces before each, then all that stands before it together.
    own = s.written(_products(placed.withColumn("h", _head_length(F.col("conv"))).withColumn("v", v)).where("i >= h"))
    whole = own.groupBy("conv", "part").agg(F.max_by(F.struct("m", "f"), "i").alias("x"))
    before = F.array_sort(F.collect_list(F.struct("part", "x")).over(W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)))
    starts = whole.withColumn("before", before).join(convs.select("conv", "start", "head", "length"), "conv")
    starts = starts.select("conv", "part", "head", "length", F.aggregate("before", F.col("start"), lambda acc, p: then(acc, p["x"])).alias("start"))
    own = own.join(starts, ["conv", "part"]).withColumn("depth", (F.col("head") + F.col("i") - F.col("h") + 1).cast("long"))
    own = own.select("conv", "depth", then(F.col("start"), F.struct("m", "f"))["f"].alias("f"), "k1", "k2", "size", (F.col("depth") == F.col("length")).alias("ends"))

    place = F.struct(F.lit(0).alias("i"), F.lit(0).cast("long").alias("f"), *(F.lit(0).cast("long").alias(c) for c in ("k1", "k2")), F.lit(0).alias("size"))
    begun = F.transform(F.slice("turns", F.lit(1), F.col("head")), lambda x, j: F.struct((j + 1).alias("i"), F.get("grown", j + 1)["f"].alias("f"), x["k1"].alias("k1"), x["k2"].alias("k2"), x["size"].alias("size")))
    begun = convs.select("conv", "length", F.explode(F.concat(F.array(place), F.coalesce(begun, F.array().cast(T.ArrayType(place_type()))))).alias("x"))
    begun = begun.select("conv", F.col("x.i").cast("long").alias("depth"), "x.f", "x.k1", "x.k2", "x.size", (F.col("x.i") == F.col("length")).alias("ends"))
    return begun.unionByName(own)


def place_type() -> T.StructType:
    return T.StructType([T.StructField("i", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("f", "k1", "k2")), T.StructField("size", T.IntegerType())])


def _sums_below(owned: DataFrame, s: common.Scratch) -> DataFrame:
    """``owned`` (conv, depth, w) with rest: the sum of w from each depth on in its conversation. Runs of bounded length are summed
    each, then the runs' totals."""
    runs = owned.withColumn("run", F.floor(F.col("depth") / RUN))
    totals = runs.groupBy("conv", "run").agg(F.sum("w").alias("w"))
    after = totals.select("conv", "run", F.coalesce(F.sum("w").over(W.partitionBy("conv").orderBy(F.desc("run")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("after"))
    inner = F.sum("w").over(W.partitionBy("conv", "run").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, 0))
    return runs.withColumn("rest", inner).join(after, ["conv", "run"]).withColumn("rest", F.col("rest") + F.col("after")).drop("run", "after", "w")


def _digests(ends: DataFrame) -> DataFrame:
    """(depth, f, ends_sha256): the hash of the decimal ids of each node's ends (conv, depth, f), in order, with commas between them.

    Ids are sorted by ranges and written out in pieces there; a hash takes its bytes in order, so a node's pieces pass through one task
    as a stream, some 30 kB a row, and only the state of the hash is held."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids = None, []
        for batch in batches:
            out: list[tuple] = []
            for depth, f, conv in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if ids and ((depth, f) != at or len(ids) == PIECE):
                    out.append((*at, ids[0], ",".join(map(str, ids))))
                    ids = []
                at = (depth, f)
                ids.append(conv)
            yield _batch(out, listed)
        if ids:
            yield _batch([(*at, ids[0], ",".join(map(str, ids)))], listed)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            out = []
            for depth, f, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                if (depth, f) != at:
                    if state:
                        out.append((*at, state.hexdigest()))
                    at, state = (depth, f), hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            yield _batch(out, named)
        if state:
            yield _batch([(*at, state.hexdigest())], named)

    listed = T.StructType([*(T.StructField(c, T.LongType()) for c in ("depth", "f", "first")), T.StructField("ids", T.StringType())])
    named = T.StructType([*(T.StructField(c, T.LongType()) for c in ("depth", "f")), T.StructField("ends_sha256", T.StringType())])
    order = ["depth", "f", "conv"]
    texts = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(common.task(pieces), listed)
    return texts.repartition("depth", "f").sortWithinPartitions("depth", "f", "first").mapInArrow(common.task(hashed), named)


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    kinds = [pa.string() if isinstance(x.dataType, T.StringType) else pa.int64() for x in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=schema.names)


def prefix_trie(turns: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of each node of the trie of rebuilt
    conversations; ``turns`` has conv_id (an integer), turn, role and text.

    A null role or text counts as empty. A null turn comes first; turns of one number are ordered by role and text, and rows that repeat
    all of these are turns that repeat. Rows without a conv_id belong to no conversation and are left out. Conversations may have any
    number of turns and texts any length. Other columns are ignored; without a conversation there is no root, and no rows come out.
    """
    with common.Scratch(turns.sparkSession, "trie") as s:
        seed = 0
        while not _keys_are_exact(turns, seed):
            seed += 2
        while True:
            path = s.written(paths(turns, seed, s))
            by = path.groupBy("depth", "f").agg(
                F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv"), F.max("size").alias("size"),
                F.min("k1").alias("k1"), F.min("k2").alias("k2"), F.max("k1").alias("other1"), F.max("k2").alias("other2"))
            nodes = s.written(by.withColumn("above", F.pmod(_times(F.col("f") - _value(F.col("k1"), F.col("k2")) + F.lit(PRIME), F.lit(INVERSE)), F.lit(PRIME))))
            if nodes.where("k1 <> other1 or k2 <> other2").isEmpty():
                break
            seed += 2
            while not _keys_are_exact(turns, seed):
                seed += 2
        return s.result(_measured(nodes, path, s))


def _measured(nodes: DataFrame, path: DataFrame, s: common.Scratch) -> DataFrame:
    up = [(F.col("depth") - 1).alias("depth"), F.col("above").alias("f")]
    nodes = nodes.select("depth", "f", "conv", "n_convs", "size", "above")
    children = nodes.where("depth > 0").groupBy(*up).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = s.written(nodes.join(children, ["depth", "f"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))

    # Each conversation's own nodes, the sums from each on, and what it has as a whole for the nodes above its own.
    weight = F.when(F.col("depth") > 0, (F.col("n_convs") - 1) * F.col("size")).otherwise(0).cast("long")
    owned = nodes.select("conv", "depth", weight.alias("w"))
    rest = s.written(_sums_below(owned, s))
    owners = nodes.groupBy("conv").agg(F.min("depth").alias("begins"), F.sum(weight).alias("whole"), F.max((F.col("n_children") == 0).cast("int")).alias("leaf"))
    above = path.select("conv", "depth", "f").join(owners, "conv").where("depth < begins")
    passing = above.groupBy("depth", "f").agg(F.sum("whole").alias("passing"), F.sum("leaf").alias("leaves"))
    own = owners.select("conv", "leaf").join(rest, "conv")
    table = nodes.join(passing, ["depth", "f"], "left").join(own, ["conv", "depth"])
    table = s.written(table.select(
        "depth", "f", "above", "conv", "n_convs", "n_children", (F.coalesce("leaves", F.lit(0)) + F.col("leaf")).alias("n_leaves"), (F.coalesce("passing", F.lit(0)) + F.col("rest")).alias("saved_tokens")))

    parents = nodes.where("n_children > 0").select(F.col("depth").alias("up"), F.col("f").alias("above"), F.col("conv").alias("parent_conv_id"))
    table = s.written(table.withColumn("up", F.col("depth") - 1).join(parents, ["up", "above"], "left"))
    digests = _digests(path.where("ends"))
    nothing = F.lit(hashlib.sha256().hexdigest())
    return table.join(digests, ["depth", "f"], "left").select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"), F.col("n_leaves").cast("long").alias("n_leaves"), "saved_tokens",
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
