"""Suffix-array dedup: removes every byte that a 100-byte string covers which also starts earlier.

The suffix work is kept to where it is needed. Texts fall into runs of window starts (``anchors``); a run whose bytes equal
those of an earlier run is a repeat as a whole, which one shuffle of hashes shows. Only runs that share an anchor and 42
bytes beside it with a different run can hold further repeats: their bytes are dealt by anchor into bounded parts. In each
part, shards of runs get a Burrows-Wheeler transform each; the transforms are merged by interleave refinement, which gives
the intervals of suffixes with common prefixes of 100 bytes; in an interval every start but the earliest is a repeat.
Anchors with more than ``HEAVY`` such runs would overfill a part: their windows are compared by a 128-bit hash instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .anchors import SIDE, WINDOW, runs
from .bwt import Shard, merge

#: Text that is looked at together, and the most of one text. Bytes of a shard and of a part.
PIECE, SHARD_BYTES, PART_BYTES, HEAVY = 2 << 20, 1 << 20, 3 << 20, 20_000

_RUN = pa.schema([(c, pa.int64()) for c in ("anchor", "key", "doc", "start")] + [(c, pa.int32()) for c in ("count", "offset", "left", "right")])
_RUN_DDL = "anchor long, key long, doc long, start long, count int, offset int, left int, right int"


def _runs(rows: pa.RecordBatch) -> pa.RecordBatch:
    docs, texts, shift = [], [], []
    for doc, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
        raw = (text or "").encode()
        for at in range(0, max(len(raw) - WINDOW + 1, 0), PIECE - WINDOW + 1):
            docs.append(doc)
            texts.append(raw[at : at + PIECE])
            shift.append(at)
    out, group, total = [], 0, 0
    for i in range(len(texts) + 1):
        if i == len(texts) or (total and total + len(texts[i]) > PIECE):
            if i > group:
                r = runs(texts[group:i])
                out.append([r["anchor"].view(np.int64), r["key"].view(np.int64), np.array(docs[group:i], np.int64)[r["text"]], r["start"] + np.array(shift[group:i], np.int64)[r["text"]], *(r[c].astype(np.int32) for c in ("count", "offset", "left", "right"))])
            group, total = i, 0
        total += len(texts[i]) if i < len(texts) else 0
    cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, t.to_pandas_dtype()) for t in _RUN.types]
    if len(cols[0]):  # of equal runs here, all but the first are settled: they go by their document, with a negative count
        order = np.lexsort((cols[3], cols[2], cols[1], cols[0]))
        cols = [c[order] for c in cols]
        again = np.zeros(len(order), bool)
        again[1:] = (cols[0][1:] == cols[0][:-1]) & (cols[1][1:] == cols[1][:-1])
        same = np.zeros(len(order), bool)
        same[1:] = again[1:] & (cols[2][1:] == cols[2][:-1]) & (cols[3][1:] == cols[3][:-1])
        cols[0] = np.where(again, common.mix(cols[2].view(np.uint64)).view(np.int64), cols[0])
        cols[1] = np.where(again, 0, cols[1])
        cols[4] = np.where(again, -cols[4], cols[4])
        cols = [c[~same] for c in cols]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=_RUN)


def _settle(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor, key, doc, start. Gives settled repeats (count < 0), and the first run of each key where an anchor
    has several keys. Between batches only one row waits."""
    last, waiting, several = None, None, False  # the last row, the only first run so far of its anchor, whether there were more
    for rows in parts:
        cols = [rows.column(i).to_numpy(zero_copy_only=False) for i in range(8)]
        if not len(cols[0]):
            continue
        head = [np.concatenate([[last[i] if last else 0], cols[i][:-1]]) for i in range(4)]
        equal = [cols[i] == head[i] for i in range(4)]
        if not last:
            equal[0][0] = False
        settled = cols[4] < 0
        again = ~settled & equal[0] & equal[1]
        again_other = again & ~(equal[2] & equal[3])
        first = np.flatnonzero(~settled & ~again)
        out = [np.flatnonzero(settled | again_other)]
        extra = None
        if len(first):
            a = cols[0][first]
            new = np.concatenate([[True], a[1:] != a[:-1]])
            group = np.cumsum(new) - 1
            number = np.bincount(group)
            goes_on = bool(last) and a[0] == last[0] and (waiting is not None or several)
            if goes_on:
                if waiting is not None:
                    extra = waiting
                number[0] += 1
            emit = number[group] > 1
            out.append(first[emit])
            several = bool(emit[-1])
            waiting = None if several else [c[first[-1]] for c in cols]
        last = [c[-1] for c in cols]
        pick = np.concatenate(out)
        result = [c[pick] for c in cols]
        result[4] = np.where(np.arange(len(pick)) < len(out[0]), -np.abs(result[4]), result[4])
        if extra is not None:
            result = [np.concatenate([[e], r]).astype(r.dtype) for e, r in zip(extra, result, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in result], schema=_RUN)


def _merged(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, doc, start, count, body) of one bounded part: the starts that repeat an earlier one, as (doc, start, count)."""
    doc, start, count, bodies = [], [], [], []
    for rows in parts:
        doc += rows.column(1).to_pylist()
        start += rows.column(2).to_pylist()
        count += rows.column(3).to_pylist()
        bodies += rows.column(4).to_pylist()
    if not bodies:
        return
    doc, start, count = (np.array(x, np.int64) for x in (doc, start, count))
    shards, owners, at, total = [], [], 0, 0
    for i in range(len(bodies) + 1):
        if i == len(bodies) or (total > SHARD_BYTES and len(shards) < 250):
            shards.append(Shard(bodies[at:i]))
            owners.append(np.arange(at, i))
            at, total = i, 0
        total += len(bodies[i]) if i < len(bodies) else 0
    source, interval = merge(shards, WINDOW)
    which, offset, number = [], [], []
    for k, shard in enumerate(shards):
        own = np.searchsorted(shard.begin, shard.suffixes, side="right") - 1
        place = shard.suffixes - shard.begin[own]
        run = owners[k][own]
        full = place < count[run]  # starts of whole windows
        which.append(run[full])
        offset.append(place[full])
        number.append(interval[source == k][full])
    run, place, group = np.concatenate(which), np.concatenate(offset), np.concatenate(number)
    docs, starts = doc[run], start[run] + place
    order = np.lexsort((starts, docs, group))
    docs, starts, group = docs[order], starts[order], group[order]
    again = np.zeros(len(order), bool)
    again[1:] = group[1:] == group[:-1]
    again[1:] &= (docs[1:] != docs[:-1]) | (starts[1:] != starts[:-1])
    docs, starts = docs[again], starts[again]
    order = np.lexsort((starts, docs))
    docs, starts = docs[order], starts[order]
    if len(docs):  # neighbouring starts make one row
        cut = np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]) | (starts[1:] != starts[:-1] + 1)]))
        yield pa.RecordBatch.from_arrays([pa.array(docs[cut]), pa.array(starts[cut]), pa.array(np.diff(np.concatenate([cut, [len(docs)]])).astype(np.int32))], names=["doc", "start", "count"])


def _bodies(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for rows in common.batches(part):
            out: list[list] = [[], [], [], [], []]
            for doc, text, wanted in zip(*(rows.column(i).to_pylist() for i in range(3)), strict=True):
                raw = (text or "").encode()
                for w in wanted:
                    if w["start"] + w["count"] + WINDOW - 1 <= len(raw):
                        for c, v in zip(out, (w["anchor"], doc, w["start"], w["count"], raw[w["start"] : w["start"] + w["count"] + WINDOW - 1]), strict=True):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.binary())], names=["anchor", "doc", "start", "count", "body"])


def _windows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of heavy anchors: each window by its hash."""
    for rows in parts:
        h, d, s = [], [], []
        for _, doc, start, count, body in zip(*(rows.column(i).to_pylist() for i in range(5)), strict=True):
            h += [hashlib.blake2b(body[j : j + WINDOW], digest_size=16).digest() for j in range(count)]
            d += [doc] * count
            s += range(start, start + count)
        yield pa.RecordBatch.from_arrays([pa.array(h, pa.binary()), pa.array(d, pa.int64()), pa.array(s, pa.int64())], names=["hash", "doc", "start"])


def _cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for rows in common.batches(part):
            n_bytes, removed, spans, digests, kept = [], [], [], [], []
            for text, found in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True):
                raw = (text or "").encode()
                out, end, gone, n = [], 0, 0, 0
                for x in sorted(((x["start"], x["start"] + x["count"] + WINDOW - 1) for x in found or [])):
                    a, b = x[0], min(x[1], len(raw))
                    if a > end or (n == 0 and a >= end):
                        if a < len(raw):
                            out.append(raw[end:a])
                            n += 1
                            gone += b - a
                            end = b
                    elif b > end:
                        gone += b - end
                        end = b
                out.append(raw[end:])
                rest = b"".join(out)
                n_bytes.append(len(raw))
                removed.append(gone)
                spans.append(n)
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def repeated_spans(docs: DataFrame, s: common.Scratch, heavy: int | None = None) -> DataFrame:
    """(doc, start, count): starts of 100-byte strings that also start earlier; ``docs`` has doc (long, not null) and text."""
    heavy = HEAVY if heavy is None else heavy

    def first(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for rows in common.batches(part):
                yield _runs(rows)

    dealt = docs.mapInArrow(common.task(first), _RUN_DDL).repartition("anchor").sortWithinPartitions("anchor", "key", "doc", "start")
    found = s.written(dealt.mapInArrow(common.task(_settle), _RUN_DDL))
    settled = found.where("count < 0").select("doc", "start", (-F.col("count")).alias("count"))

    # Of the first runs, those that share the bytes beside the anchor on a side on which they have windows; only these windows.
    edge = found.where("count > 0").withColumn("l", F.when((F.col("left") >= 0) & (F.col("offset") >= SIDE), F.col("left")))
    edge = edge.withColumn("r", F.when((F.col("right") >= 0) & (F.col("offset") - F.col("count") + 1 <= SIDE), F.col("right")))
    for c in "lr":
        twice = edge.where(F.col(c).isNotNull()).groupBy("anchor", c).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor", c, F.lit(True).alias(f"has_{c}"))
        edge = edge.join(twice, ["anchor", c], "left")
    low = F.when(F.col("has_l"), F.lit(0)).otherwise(F.greatest(F.lit(0), F.col("offset") - SIDE))
    high = F.when(F.col("has_r"), F.col("count")).otherwise(F.least(F.col("count"), F.col("offset") - SIDE + 1))
    edge = edge.where("has_l or has_r").select("anchor", "doc", (F.col("start") + low).alias("start"), (high - low).cast("int").alias("count")).where("count > 0")
    wanted = edge.groupBy("doc").agg(F.collect_list(F.struct("anchor", "start", "count")).alias("wanted"))
    body = s.written(docs.join(wanted, "doc").select("doc", "text", "wanted").mapInArrow(common.task(_bodies), "anchor long, doc long, start long, count int, body binary"))

    sizes = body.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("body")).alias("bytes"))
    crowded = s.written(sizes.where(F.col("n") > heavy).select("anchor"))
    bytes_, = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()
    parts = max(1, -(-int(bytes_) // PART_BYTES))
    light = body.join(crowded, "anchor", "left_anti").select("anchor", "doc", "start", "count", "body")
    merged = s.written(light.repartition(parts, "anchor").mapInArrow(common.task(_merged), "doc long, start long, count int"))
    windows = body.join(crowded, "anchor").select("anchor", "doc", "start", "count", "body").mapInArrow(common.task(_windows), "hash binary, doc long, start long")
    first_of = windows.groupBy("hash").agg(F.min(F.struct("doc", "start")).alias("first"))
    rest = windows.join(first_of, "hash").where("struct(doc, start) <> first").select("doc", "start", F.lit(1).alias("count"))
    return settled.unionByName(merged).unionByName(rest)


def remove_repeats(docs: DataFrame, heavy: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes left) of each row of ``docs`` (doc_id: an integer).

    A null text counts as empty. Each distinct pair of id and text is a document: rows without an id come after all others, each text on
    its own, and rows that repeat both get the same result. Texts under 100 bytes are untouched. Other columns are ignored; no rows
    give no rows.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with common.Scratch(docs.sparkSession, "repeats") as s:
        base, names = common.numbered(given, s)
        base = base.select("doc", "text") if names is None else base.select("doc", "text").dropDuplicates(["doc"])
        spans = repeated_spans(base, s, heavy).groupBy("doc").agg(F.collect_list(F.struct("start", "count")).alias("found"))
        rows = common.matched(given, spans, names, s)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType())])
    return rows.select("doc_id", "text", "found").mapInArrow(common.task(_cut), schema)
