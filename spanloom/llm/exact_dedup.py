"""Exact dedup: static binary-fuse filters per immutable snapshot screen incoming digests.

A snapshot's digests are dealt into shards by digest. Each shard gets one static filter (three-wise binary fuse, 8-bit
fingerprints: about nine bits a digest, no false negatives, one false positive in 256). A batch's digests meet only the
filter of their shard. Positives join the exact buckets and are compared byte for byte; the others are new, and copies
within the batch are grouped by themselves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Digests of one shard: a filter of some 40 KB, built in one task.
SHARD_ROWS = 32_768


def normalised(text: Column) -> Column:
    """Each run of separators becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{common.SPACE}+", " ")


# ---- binary fuse filter ---------------------------------------------------------------------------------------------

ARITY = 3


def fuse_layout(n: int) -> tuple[int, int]:
    """Length of a segment (a power of two) and number of start segments for n keys (Graf and Lemire, 2022)."""
    n = max(n, 1)
    seg = 1 << int(np.floor(np.log(n) / np.log(3.33) + 2.25)) if n > 1 else 4
    seg = min(max(seg, 4), 1 << 18)
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    return seg, max(1, -(-int(np.ceil(n * factor)) // seg) - (ARITY - 1))


def _places(keys: np.ndarray, seed: int, seg: int, starts: int) -> tuple[np.ndarray, np.ndarray]:
    h = common.mix(keys + np.uint64(seed))
    first = ((h >> np.uint64(32)) * np.uint64(starts * seg)) >> np.uint64(32)
    mask = np.uint64(seg - 1)
    at = np.stack([first, (first + np.uint64(seg)) ^ ((h >> np.uint64(18)) & mask), (first + np.uint64(2 * seg)) ^ (h & mask)], 1)
    print_ = common.mix(h) & np.uint64(255)
    return at.astype(np.int64), print_.astype(np.uint8)


def build_fuse(keys: np.ndarray) -> bytes:
    """The filter of distinct unsigned 64-bit keys: a header (seed, segment length, start segments) and the fingerprints."""
    keys = np.unique(keys.astype(np.uint64))
    seg, starts = fuse_layout(len(keys))
    for seed in range(1, 200):
        if seed % 20 == 0:
            starts += max(1, starts // 8)
        size = (starts + ARITY - 1) * seg
        at, prints = _places(keys, seed * 0x9E3779B97F4A7C15 & (2**64 - 1), seg, starts)
        count, index = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for k in range(ARITY):
            np.add.at(count, at[:, k], 1)
            np.bitwise_xor.at(index, at[:, k], np.arange(len(keys)))
        rounds, left = [], len(keys)
        while left:  # peel, a whole layer of cells that hold one key at a time
            cells = np.flatnonzero(count == 1)
            if not len(cells):
                break
            owner = index[cells]
            owner, pick = np.unique(owner, return_index=True)
            rounds.append((owner, cells[pick]))
            left -= len(owner)
            for k in range(ARITY):
                np.subtract.at(count, at[owner, k], 1)
                np.bitwise_xor.at(index, at[owner, k], owner)
        if left:
            continue
        table = np.zeros(size, np.uint8)
        for owner, cells in reversed(rounds):
            others = table[at[owner, 0]] ^ table[at[owner, 1]] ^ table[at[owner, 2]]
            table[cells] = prints[owner] ^ others ^ table[cells]
        return np.array([seed, seg, starts], np.int64).tobytes() + table.tobytes()
    raise RuntimeError("no filter found")


def in_fuse(blob: bytes, keys: np.ndarray) -> np.ndarray:
    """True where a key may be in the filter; always true for its own keys."""
    seed, seg, starts = np.frombuffer(blob[:24], np.int64).tolist()
    table = np.frombuffer(blob, np.uint8, offset=24)
    at, prints = _places(keys.astype(np.uint64), seed * 0x9E3779B97F4A7C15 & (2**64 - 1), seg, starts)
    return (table[at[:, 0]] ^ table[at[:, 1]] ^ table[at[:, 2]]) == prints


# ---- the operator ---------------------------------------------------------------------------------------------------


def _digests(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"))


def _groups(digests: DataFrame, shards: int) -> DataFrame:
    key = F.conv(F.substring(F.hex("digest"), 1, 15), 16, 10).cast("long")
    return (digests.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
            .withColumn("key", key).withColumn("shard", (F.col("key") % shards).cast("int")))


def screen(batch: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Rows of ``batch`` (digest, key, shard, …) whose digest passes the filter of their shard of ``snapshot``."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": pdf.shard[:1], "filter": [build_fuse(pdf.key.to_numpy())]})

    filters = snapshot.select("shard", "key").groupBy("shard").applyInPandas(build, "shard int, filter binary")

    def test(mine: pd.DataFrame, its: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(its):
            return mine.iloc[:0]
        return mine[in_fuse(its["filter"].iloc[0], mine.key.to_numpy())]

    return batch.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(test, batch.schema)


def exact_dedup(docs: DataFrame, batch: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``batch`` is true for the rows of the incoming batch, the others are the snapshot; both are deduplicated together.
    By default the batch is the half of the documents with an odd checksum of their id. Texts are compared after
    ``normalised``. Null texts equal empty ones. A null doc_id stays only in a group without any other id. Rows that
    repeat the id that stays are all kept, as they are one document. No rows give no rows; other columns are ignored.
    """
    batch = common.crc_mod("doc_id", 2) == 1 if batch is None else batch
    with common.Scratch(docs.sparkSession, "exact") as s:
        return s.result(_exact_dedup(docs, batch, s))


def _exact_dedup(docs: DataFrame, batch: Column, s: common.Scratch) -> DataFrame:
    digests = s.written(
        docs.select("doc_id", "text", F.coalesce(batch, F.lit(False)).cast("int").alias("side"))
        .select("doc_id", "side", F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest")))
    shards = max(1, -(-digests.count() // SHARD_ROWS))
    old = s.written(_groups(digests.where("side = 0"), shards))
    new = s.written(_groups(digests.where("side = 1"), shards))

    maybe = screen(new, old)
    met = maybe.alias("a").join(old.alias("b"), "digest").select("digest", F.col("a.keep_id").alias("a_id"), F.col("b.keep_id").alias("b_id"))
    same = _same_bytes(s.written(met), docs).withColumn("sides", F.array(F.lit(0), F.lit(1)))
    sides = old.withColumn("side", F.lit(0)).unionByName(new.withColumn("side", F.lit(1))).join(same, "digest", "left")
    groups = (sides.withColumn("sides", F.coalesce("sides", F.array("side"))).groupBy("digest", "sides")
              .agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
              .withColumn("side", F.explode("sides")).drop("sides"))
    return digests.join(groups, ["digest", "side"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def _same_bytes(met: DataFrame, docs: DataFrame) -> DataFrame:
    """Digests of the pairs (digest, a_id, b_id) whose normalised texts are the same bytes: one pair a digest, so no group
    is spelled out. Rows without an id can't be looked up; for them the digest decides."""
    wanted = met.select("digest", F.explode(F.array("a_id", "b_id")).alias("doc_id"))
    texts = docs.select("doc_id", normalised(F.col("text")).alias("body")).join(wanted, "doc_id")
    texts = texts.where(F.unhex(F.sha2("body", 256)) == F.col("digest"))  # a repeated id may hold another text
    same = texts.groupBy("digest").agg((F.min("body") == F.max("body")).alias("same")).where("same").select("digest")
    return same.unionByName(met.where("a_id is null or b_id is null").select("digest"))
