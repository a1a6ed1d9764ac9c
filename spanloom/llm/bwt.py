"""Merging Burrows-Wheeler transforms by interleave refinement (after Holt and McMillan, 2014).

A shard is a list of byte strings, each closed by two bytes 0xFF (which no UTF-8 text holds) and read as a cycle. Its
transform lists, in the order of its suffixes, the two bytes before each suffix; two bytes make one symbol here, so that a
step of the refinement covers two bytes. From the transforms alone the merge refines which shard the next suffix in the common
order comes from: after step h the order is right for the first 2h bytes, and neighbours are known to share them or not. The
suffixes of all shards are never sorted together.
"""

from __future__ import annotations

import numpy as np

CLOSE = b"\xff\xff"


class Shard:
    def __init__(self, bodies: list[bytes]):
        sizes = np.array([len(b) + 2 for b in bodies], np.int64)
        self.begin = np.cumsum(sizes) - sizes
        text = np.frombuffer(b"".join(b + CLOSE for b in bodies), np.uint8).astype(np.int64)
        n = len(text)
        begin, size = np.repeat(self.begin, sizes), np.repeat(sizes, sizes)
        place = np.arange(n) - begin

        def after(k: int) -> np.ndarray:
            return begin + (place + k) % size

        key = text.copy()
        for k in range(1, 7):
            key = key * 256 + text[after(k)]
        depth, order, rank = 7, None, None
        while True:  # prefix doubling, to at least 100 bytes
            order = np.argsort(key)
            new = np.zeros(n, np.int64)
            new[1:] = np.diff(key[order]) != 0
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new)
            if depth >= 100:
                break
            key = rank * n + rank[after(depth)]
            depth *= 2
        self.suffixes = order
        before = (text[after(-2)] * 256 + text[after(-1)]).astype(np.uint16)
        self.transform = before[order]


def merge(shards: list[Shard], depth: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """The shard of each suffix in the common order of the first ``depth`` bytes, and the number of its interval: suffixes with
    the same number have a common prefix of at least ``depth`` bytes."""
    sizes = [len(s.transform) for s in shards]
    source = np.repeat(np.arange(len(shards), dtype=np.uint8), sizes)
    interval = np.zeros(len(source), np.int32)
    transforms = np.concatenate([s.transform for s in shards])
    symbols = transforms
    by, new = np.empty_like(symbols), np.zeros(len(symbols), bool)
    for _ in range(-(-depth // 2)):
        place = np.argsort(symbols, kind="stable")  # of 16-bit numbers: a radix sort
        source, had = source[place], interval[place]
        by = symbols[place]
        np.not_equal(by[1:], by[:-1], out=new[1:])
        new[1:] |= had[1:] != had[:-1]
        interval = np.cumsum(new, dtype=np.int32)
        symbols = np.empty_like(transforms)
        symbols[np.argsort(source, kind="stable")] = transforms  # each shard's transform runs along its own suffixes
        if interval[-1] == len(interval) - 1:
            break  # no two suffixes are alike any more
    return source, interval
