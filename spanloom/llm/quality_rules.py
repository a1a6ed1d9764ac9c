"""Quality rules: repetition coverage.

Words of a text get dense numbers; rolling hashes of several n-gram lengths over these numbers show which n-grams occur
again in the same text. Measured are the characters inside repeated n-grams (the first occurrence doesn't count) and
inside repeated lines. One pass over the rows, no shuffle; numpy works on parts of a few megabytes at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

#: Largest share of a text's word characters inside repeated n-grams, by n (Rae et al., 2021).
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of lines that repeat an earlier one, and of word characters in them; symbols a word; mean length of words.
LINE_LIMIT, LINE_CHAR_LIMIT, SYMBOL_LIMIT = 0.30, 0.20, 0.10
SYMBOLS = b"#*$%&|<>"

_COLUMNS = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"),
            ("base_failed", "boolean"), ("kept", "boolean"), ("dup_line_chars", "long"), *((f"dup_{n}gram_chars", "long") for n in NGRAM_LIMITS)]
_IS_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))


def _sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of values[cuts[i]:cuts[i + 1]]."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[cuts[1:]] - total[cuts[:-1]]


def _covered(hit: np.ndarray, n: int) -> np.ndarray:
    """True for the n words from each window start that is hit."""
    total = np.concatenate([np.zeros(n, np.int64), np.cumsum(hit, dtype=np.int64)])
    return total[n:] - total[:-n] > 0


def measure(texts: list[str | None]) -> dict[str, np.ndarray]:
    """The measures of each text; null or empty texts have none of anything and fail."""
    raws = [t.encode() if t else b"" for t in texts]
    lists = [r.split() for r in raws]
    n_words = np.array([len(x) for x in lists], np.int64)
    cuts = np.concatenate([[0], np.cumsum(n_words)])
    flat = np.empty(cuts[-1], dtype=object)
    flat[:] = [w for x in lists for w in x]
    ids = pd.factorize(flat)[0].astype(np.int64) if len(flat) else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(texts)), n_words)
    left = cuts[1:][doc] - np.arange(len(flat))  # words from here to the end of the text

    buf = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
    space = _IS_SPACE[buf]
    ends = np.cumsum([len(r) + 1 for r in raws])
    at = np.concatenate([[0], ends]).astype(np.int64)
    starts_char = (buf & 0xC0) != 0x80
    word_chars = _sums(starts_char & ~space, at)
    n_symbols = _sums(_IS_SYMBOL[buf], at)
    edge = np.diff(np.concatenate([[1], space.view(np.int8)]).astype(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    seen = np.concatenate([[0], np.cumsum(starts_char)])
    length = seen[end] - seen[begin]  # of each word, in characters

    # Three-word windows, with exact numbers instead of hashes.
    def renumbered(code: np.ndarray) -> np.ndarray:
        return pd.factorize(code)[0].astype(np.int64)

    out = {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols}
    repeat = np.zeros(len(flat), bool)
    full = np.flatnonzero(left >= 3)
    if len(full):
        width = int(ids.max()) + 1
        pair = renumbered(ids[full] * width + ids[full + 1])
        triple = renumbered(pair * width + ids[full + 2])
        own = pd.Series(doc[full] * (int(triple.max()) + 1) + triple)
        repeat[full] = own.duplicated(keep=False).to_numpy()
    out["n_repeat_words"] = _sums(_covered(repeat, 3), cuts)

    scrambled = common.mix(ids.astype(np.uint64) + np.uint64(1))
    salt = common.mix(doc.astype(np.uint64) + np.uint64(1 << 40))
    base = np.uint64(0x9E3779B97F4A7C15)
    rolled, size = scrambled.copy(), 1
    for n in NGRAM_LIMITS:
        while size < n:  # one word more: the hash of n - 1 words times the base, plus the next word
            rolled[:-size] = rolled[:-size] * base + scrambled[size:]
            size += 1
        hit = np.zeros(len(flat), bool)
        full = np.flatnonzero(left >= n)
        hit[full] = pd.Series(common.mix(rolled[full]) ^ salt[full]).duplicated().to_numpy()
        out[f"dup_{n}gram_chars"] = _sums(np.where(_covered(hit, n), length, 0), cuts)

    dup_lines, lines, line_chars = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for i, raw in enumerate(raws):
        earlier: set[bytes] = set()
        for line in raw.split(b"\n"):
            if not line or line.isspace():
                continue
            lines[i] += 1
            if line in earlier:
                dup_lines[i] += 1
                line_chars[i] += len(b"".join(line.split()).decode())
            earlier.add(line)
    out |= {"n_dup_lines": dup_lines, "dup_line_chars": line_chars}

    failed = (n_words < 50) | (100 * out["n_repeat_words"] > 50 * n_words)
    kept = ~failed & (dup_lines <= LINE_LIMIT * lines) & (line_chars <= LINE_CHAR_LIMIT * word_chars) & (n_symbols <= SYMBOL_LIMIT * n_words)
    for n, most in NGRAM_LIMITS.items():
        kept &= out[f"dup_{n}gram_chars"] <= most * word_chars
    return out | {"base_failed": failed, "kept": kept}


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id and the measures and verdict of each whole text, one row per row of ``docs``.

    A null or empty text has zero counts and fails. Repeated rows are judged alike, a null doc_id is returned as it is,
    other columns are ignored, no rows give no rows.
    """
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.LongType() if k == "long" else T.BooleanType()) for c, k in _COLUMNS)])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for rows in common.batches(part):
                found = measure(rows.column(rows.schema.get_field_index("text")).to_pylist())
                yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(found[c]) for c, _ in _COLUMNS)], names=["doc_id", *(c for c, _ in _COLUMNS)])

    return docs.select("doc_id", "text").mapInArrow(common.task(run), schema)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text the rules keep."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for rows in common.batches(part):
                yield rows.filter(pa.array(measure(rows.column(rows.schema.get_field_index("text")).to_pylist())["kept"]))

    return docs.mapInArrow(common.task(run), docs.schema)
