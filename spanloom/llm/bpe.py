"""Byte-level BPE encoding and decoding: corpus-level merge replay.

A part of the corpus is reduced to its distinct pieces (matches of the pre-splitting pattern). All their bytes form one
linked array of tokens. An inverted index leads from each rank to the positions of the pairs that merge to it; a heap of
ranks replays the merges in order, each for all positions at once, and looks up only the touched neighbours again.
Ranks are read on the driver, broadcast (a vocabulary file, some 50,000 entries) and never trained.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

#: Distinct pieces kept from one batch to the next; beyond it a task starts a new memory of pieces.
PIECES = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _distinct(at: np.ndarray) -> np.ndarray:
    at = np.sort(at)
    return at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) > 1 else at


class Merges:
    """The pairs of tokens whose joined bytes are a token, sorted for look-up by arrays of pairs."""

    def __init__(self, ranks: dict[bytes, int]):
        top = max(ranks.values()) + 1
        self.token = [b""] * top
        for token, rank in ranks.items():
            self.token[rank] = token
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        found = [(ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        table = np.array(sorted(found), np.int64).reshape(-1, 2)
        self.key, self.rank = table[:, 0].copy(), table[:, 1].copy()

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge, or -1."""
        key = left << 32 | right
        if not len(self.key) or not len(key):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[at] == key) & (left >= 0) & (right >= 0), self.rank[at], -1)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all pieces in a row, and the number of tokens of each piece."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        n = int(sizes.sum())
        tok = np.full(n + 2, -1, np.int64)  # a cell without a token at both ends
        tok[1:-1] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        piece = np.full(n + 2, -1, np.int64)
        piece[1:-1] = np.repeat(np.arange(len(pieces)), sizes)
        nxt, prv, alive = np.arange(1, n + 3), np.arange(-1, n + 1), np.ones(n + 2, bool)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(at: np.ndarray) -> None:
            """Files the pairs that start at these positions under the ranks of their merges."""
            to = nxt[at]
            rank = np.where(piece[at] == piece[to], self.of(tok[at], tok[to]), -1)
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)], strict=True):
                r = int(rank[start])
                if r not in index:
                    index[r] = []
                    heapq.heappush(heap, r)
                index[r].append(at[start:end])

        enter(np.arange(1, n))
        while heap:
            r = heapq.heappop(heap)
            at = _distinct(np.concatenate(index.pop(r)))
            at = at[alive[at]]
            to = nxt[at]
            ok = (piece[at] == piece[to]) & (self.of(tok[at], tok[to]) == r)
            at, to = at[ok], to[ok]
            if not len(at):
                continue
            linked = np.concatenate([[False], to[:-1] == at[1:]])  # shares its left token with the pair before it
            run = np.arange(len(at)) - np.maximum.accumulate(np.where(linked, 0, np.arange(len(at))))
            keep = run % 2 == 0  # leftmost first: every other pair of a run
            at, to = at[keep], to[keep]
            after = nxt[to]
            tok[at], alive[to], nxt[at] = r, False, after
            prv[after] = at
            before = prv[at]
            enter(_distinct(np.concatenate([before[before > 0], at])))
        left = alive[1:-1]
        return tok[1:-1][left], np.bincount(piece[1:-1][left], minlength=len(pieces))


@lru_cache(maxsize=2)
def _worker(blob: bytes) -> Merges:
    import pickle

    return Merges(pickle.loads(blob))


class _Codec:
    """Encodes texts piece by piece; what a piece gives is kept for the next batches of the task."""

    def __init__(self, merges: Merges, pattern: str):
        self.merges, self.find = merges, regex.compile(pattern).findall
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.counts, self.ids, self.bytes = np.zeros(0, np.int64), [], []

    def encode(self, texts: list[str | None]) -> Iterator[tuple[int, str, bytes]]:
        """Number of ids, the ids joined by commas, and the bytes that they decode to, for each text."""
        if len(self.known) > PIECES:
            self.clear()
        known, split, new = self.known, [], []
        for t in texts:
            pieces = self.find(t) if t else []
            split.append(pieces)
            for p in set(pieces).difference(known):
                known[p] = len(known)
                new.append(p)
        tokens, counts = self.merges.encode([p.encode() for p in new])
        at, token, tokens = 0, self.merges.token, tokens.tolist()
        for n in counts.tolist():
            ids = tokens[at : at + n]
            self.ids.append(",".join(map(str, ids)))
            self.bytes.append(b"".join([token[i] for i in ids]))
            at += n
        self.counts = np.concatenate([self.counts, counts])
        ids_of, bytes_of = self.ids.__getitem__, self.bytes.__getitem__
        for pieces in split:
            which = list(map(known.__getitem__, pieces))
            yield int(self.counts[which].sum()) if which else 0, ",".join(map(ids_of, which)), b"".join(map(bytes_of, which))


def bpe_codec(docs: DataFrame, ranks: dict[bytes, int], pattern: str, keep: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each whole text; with ``keep`` also token_ids and decoded.

    A null text counts as empty: no tokens, hashes of the empty string. Rows without an id are encoded too; repeated rows
    give repeated rows; other columns are ignored; no rows give no rows. One pass, no shuffle.
    """
    import pickle

    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(pickle.dumps(ranks))
    fields = [docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if keep:
        fields += [T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _Codec(_worker(shared.value), pattern)
        gc.disable()  # millions of strings live on and no cycles are made: looking for them takes longer than the merges
        for part in parts:
            for rows in common.batches(part, most=4 << 20):
                n, ids, decoded, kept, raw = [], [], [], [], []
                for count, text, data in codec.encode(rows.column(rows.schema.get_field_index("text")).to_pylist()):
                    n.append(count)
                    ids.append(hashlib.sha256(text.encode()).hexdigest())
                    decoded.append(hashlib.sha256(data).hexdigest())
                    if keep:
                        kept.append([int(i) for i in text.split(",")] if text else [])
                        raw.append(data)
                out = [rows.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
                out += [pa.array(kept, pa.list_(pa.int32())), pa.array(raw, pa.binary())] if keep else []
                yield pa.RecordBatch.from_arrays(out, names=[f.name for f in fields])

    return docs.select("doc_id", "text").mapInArrow(common.task(run), T.StructType(fields))
