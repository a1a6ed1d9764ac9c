"""Content-defined segments of windows: which windows of ``WINDOW`` bytes can be equal at all.

Every window of 100 bytes has an anchor, the 16 bytes in it with the least hash (leftmost on ties). Equal windows have equal
anchors at equal offsets. Neighbouring windows mostly share one anchor, so a text falls into runs of window starts, some
43 starts each; equal windows lie in runs with equal anchors.
"""

from __future__ import annotations

import numpy as np

from . import common

WINDOW, ANCHOR = 100, 16
#: A window that holds an anchor also holds so many bytes before or after it.
SIDE = (WINDOW - ANCHOR) // 2
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


def runs(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Runs of window starts, in order: text (its index), start (first window), count (windows), anchor (its hash), offset of
    the anchor from the start, key (a hash of all bytes that the run's windows cover, and of the offset), and left and right (16 bits of
    hash of the ``SIDE`` bytes before and after the anchor, or -1 where the text has fewer)."""
    lens = np.array([len(t) for t in texts], np.int64)
    buf = np.frombuffer(b"".join(texts) + bytes(WINDOW), np.uint8)
    n = int(lens.sum())
    empty = np.zeros(0, np.int64)
    ends = np.cumsum(lens)
    owner = np.repeat(np.arange(len(texts)), np.maximum(lens - WINDOW + 1, 0))
    if not len(owner):
        return {"text": empty, "start": empty, "count": empty, "anchor": empty.view(np.uint64), "offset": empty, "key": empty.view(np.uint64), "left": empty, "right": empty}
    begin = ends - lens
    widths = np.maximum(lens - WINDOW + 1, 0)
    at = begin[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(widths) - widths, widths)  # of each window, in buf
    wide = buf.astype(np.uint64)
    for k in (1, 2, 4):
        wide = wide[: len(wide) - k] | (wide[k:] << np.uint64(8 * k))
    grams = common.mix(wide[: n + WINDOW - 23] * np.uint64(_BASE) + common.mix(wide[8 : n + WINDOW - 15]))
    low = (grams & ~np.uint64((1 << 24) - 1)) | np.arange(len(grams), dtype=np.uint64)  # 40 bits of hash, then the place
    size, span = 1, WINDOW - ANCHOR + 1
    while size * 2 <= span:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    low = np.minimum(low[: len(low) - (span - size)], low[span - size :])
    anchor = (low[at] & np.uint64((1 << 24) - 1)).astype(np.int64)
    first = np.ones(len(at), bool)
    first[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    i = np.flatnonzero(first)
    count = np.diff(np.concatenate([i, [len(at)]]))
    start, q = at[i], anchor[i]
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((buf[:n].astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), dtype=np.uint64)])
    unpowers = _powers(_INVERSE, n + 1)

    def spans(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (prefix[stop] - prefix[start]) * unpowers[start]

    key = common.mix(spans(start, start + count - 1 + WINDOW) + (q - start).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019) + count.astype(np.uint64))
    side = []
    for a, b in ((q - SIDE, q), (q + ANCHOR, q + ANCHOR + SIDE)):
        inside = (a >= begin[owner[i]]) & (b <= ends[owner[i]])
        a, b = np.where(inside, a, 0), np.where(inside, b, 0)
        side.append(np.where(inside, (common.mix(spans(a, b)) >> np.uint64(48)).astype(np.int64), -1))
    return {"text": owner[i], "start": start - begin[owner[i]], "count": count, "anchor": grams[q], "offset": q - start, "key": key, "left": side[0], "right": side[1]}
