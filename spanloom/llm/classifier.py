"""Quality classifier: supervised subword embeddings.

Words and character n-grams of a text are hashed to rows of a learned table; the rows' mean is the text's embedding and a
softmax over it gives the label's probability. Numpy gradient descent trains it on a bounded sample of labelled rows. As
the mean and the output layer are linear, scoring needs one number a row, ``table @ (w1 - w0)``, summed over a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Rows of the table, its width, and the lengths of character n-grams (in bytes).
ROWS, WIDTH, NGRAMS = 1 << 16, 8, (3, 5)
#: The documented bound on labelled rows that train: those whose ids have the smallest hashes.
SAMPLE, EPOCHS, RATE = 3_000, 4, 0.5

_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_POWERS = np.array([pow(0x100000001B3, i, 1 << 64) for i in range(64)], np.uint64)


def features(texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For words, pairs of words and each n-gram length: the table rows of all texts in a row, and where each text's begin and end."""
    raws = [t.encode() if t else b"" for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raws])
    starts = ends - np.array([len(r) + 1 for r in raws])
    buf = np.frombuffer(b"".join(r + b"\n" for r in raws), np.uint8)
    space = _SPACE[buf]
    ids, cuts = [], []
    edge = np.diff(np.concatenate([[1], space.view(np.int8)]).astype(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(begin):
        place = np.arange(len(buf)) - np.repeat(np.concatenate([[0], begin]), np.diff(np.concatenate([[0], begin, [len(buf)]])))
        part = np.where(space, np.uint64(0), (buf.astype(np.uint64) + np.uint64(1)) * _POWERS[place & 63])
        word = np.add.reduceat(part, begin)
        ids += [_row(word, 0), _row(word[1:] - word[:-1], 1)]  # of a pair the difference: any repeated word gives the same row
    else:
        ids += [np.zeros(0, np.int64)] * 2
    at = np.searchsorted(begin, np.concatenate([starts, ends[-1:]])) if len(raws) else np.zeros(1, np.int64)
    cuts += [at, np.minimum(at, len(ids[1]))]
    wide = buf.astype(np.uint64)
    for n in NGRAMS:
        h = np.zeros(max(0, len(buf) - n + 1), np.uint64)
        for k in range(n):
            h |= wide[k : len(buf) - n + 1 + k] << np.uint64(8 * k)
        ids.append(_row(h, n))
        cuts.append(np.minimum(np.concatenate([starts, ends[-1:]]), len(h)))  # the last n - 1 reach into the next text: left out below
    return ids, cuts


def _row(h: np.ndarray, kind: int) -> np.ndarray:
    return (((h + np.uint64(kind * 7919)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 16)).astype(np.int64)


def _spans(cuts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Begin and end of each text's features, without n-grams that cross into the next text."""
    out = [(cuts[0][:-1], cuts[0][1:])]
    for n, at in zip((2, *NGRAMS), cuts[1:], strict=True):
        out.append((at[:-1], np.maximum(at[:-1], at[1:] - n + 1)))
    return out


def train(texts: list[str], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Weight of each table row and a bias, so that sigmoid(mean weight + bias) is the probability of label 1."""
    rng = np.random.default_rng(7)
    table = rng.normal(0, 0.1, (ROWS, WIDTH)).astype(np.float32)
    out = np.zeros((WIDTH, 2), np.float32)
    n1 = float((labels == 1).sum())
    bias = np.log([(len(labels) - n1 + 1) / (len(labels) + 2), (n1 + 1) / (len(labels) + 2)]).astype(np.float32)
    docs = []
    for start in range(0, len(texts), 256):
        ids, cuts = features(texts[start : start + 256])
        spans = _spans(cuts)
        for i in range(len(texts[start : start + 256])):
            rows = np.concatenate([f[b[i] : e[i]] for f, (b, e) in zip(ids, spans, strict=True)])
            docs.append(np.unique(rows, return_counts=True))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(docs)):
            rows, counts = docs[i]
            share = (counts / max(1, counts.sum())).astype(np.float32)[:, None]
            mean = (table[rows] * share).sum(0)
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(labels[i])] -= 1
            grad = out @ p
            out -= rate * np.outer(mean, p)
            table[rows] -= rate * 50 * share * grad  # a row's share of a text is small: a larger step for the table
    return (table @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def score(texts: list[str | None], weights: np.ndarray, bias: float) -> np.ndarray:
    ids, cuts = features(texts)
    total, n = np.zeros(len(texts)), np.zeros(len(texts))
    for rows, (begin, end) in zip(ids, _spans(cuts), strict=True):
        run = np.concatenate([[0.0], np.cumsum(weights[rows], dtype=np.float64)])
        total += run[end] - run[begin]
        n += end - begin
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + bias, -40, 40)))


def quality_classifier(docs: DataFrame, labels: DataFrame, held_out) -> DataFrame:
    """doc_id, held_out, score and predicted of each whole text; only labels of rows that aren't ``held_out`` are learned.

    Null and empty texts get the share of label 1 as their score. Labels that are null, or of unknown documents, teach
    nothing; of several labels of one document the smallest counts; without labels every score is 0.5. Rows without an id
    are scored. Other columns are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    known = (labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
             .where(~held_out).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE))
    sample = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(known), "doc_id").dropDuplicates(["doc_id"])

    def fit(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [part.to_pandas() for part in parts]
        if rows:
            rows = pd.concat(rows).sort_values(["doc_id"])
            weights, bias = train(rows.text.tolist(), rows.quality.to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()]), pa.array([bias])], names=["weights", "bias"])

    model = sample.coalesce(1).mapInArrow(common.task(fit), "weights binary, bias double").collect()
    weights = spark.sparkContext.broadcast((bytes(model[0].weights), model[0].bias) if model else (bytes(4 * ROWS), 0.0))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = np.frombuffer(weights.value[0], np.float32), weights.value[1]
        for part in parts:
            for rows in common.batches(part):
                found = score(rows.column(2).to_pylist(), table, bias)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(found), pa.array((found >= 0.7).astype(np.int32))], names=schema.names)

    return docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(common.task(run), schema)
