"""Language ID: cross-parsing entropy.

A suffix automaton of each language's labelled text gives the longest match from any point of a new text. Parsing a text
greedily into such matches, each followed by one literal character, takes few phrases in its own language and many in
others (Ziv and Merhav, 1993). The language with the lowest phrases * log2(training length) / length wins. Texts are
parsed whole, by numpy in thousands of blocks of ``BLOCK`` characters at a time: first every block as if a phrase began with it,
then again each block that was entered in another state than assumed, until all fit together. Parses that begin
apart soon fall in step, so that this takes few rounds, and the outcome is that of one parse from beginning to end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: The documented bound on training text: this many documents a language at most (those with the smallest hash in each of
#: as many buckets of ids), and of a longer one this many pieces of this many characters, spread evenly over its whole text.
DOCS, PIECES, PIECE = 24, 5, 200
BLOCK, LANES = 256, 8_192


_REST = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """Lower case, each run of other characters than letters as one space: junk between words says nothing of a language."""
    return _REST.sub(" ", text.lower())


class Automaton:
    """The suffix automaton of a text (Blumer et al., 1985) with a dense table of transitions; 0 is the initial state and -1 none."""

    def __init__(self, text: str):
        self.alphabet = {c: i + 1 for i, c in enumerate(dict.fromkeys(text))}  # 0: a character that never occurs
        self.length = len(text)
        step: list[dict[int, int]] = [{}]
        link, size, last = [-1], [0], 0
        for c in (self.alphabet[c] for c in text):
            cur = len(step)
            step.append({})
            size.append(size[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in step[p]:
                step[p][c] = cur
                p = link[p]
            if p >= 0:
                q = step[p][c]
                if size[q] == size[p] + 1:
                    link[cur] = q
                else:
                    copy = len(step)
                    step.append(dict(step[q]))
                    size.append(size[p] + 1)
                    link.append(link[q])
                    while p >= 0 and step[p].get(c) == q:
                        step[p][c] = copy
                        p = link[p]
                    link[q] = link[cur] = copy
            last = cur
        self.table = np.full((len(step), len(self.alphabet) + 1), -1, np.int32)
        for state, moves in enumerate(step):
            self.table[state, list(moves)] = list(moves.values())

    def codes(self, points: np.ndarray) -> np.ndarray:
        """Columns of the table for code points."""
        own = np.array([ord(c) for c in self.alphabet], np.int64)
        small = np.zeros(max(int(own.max()) + 2, 256) if len(own) else 256, np.int32)
        small[own] = list(self.alphabet.values())
        return small[np.minimum(points, len(small) - 1)]

    def parse(self, blocks: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of phrases that end in each row of code points (-1 fills up a row), and the state after it, from the states before."""
        code = self.codes(np.maximum(blocks, 0))
        count = np.zeros(len(blocks), np.int64)
        for t in range(blocks.shape[1]):
            to = self.table[state, code[:, t]]
            there = blocks[:, t] >= 0
            ends = there & (to < 0)
            count += ends
            state = np.where(ends, 0, np.where(there, to, state))
        return count, state

    def phrases(self, blocks: np.ndarray, owners: np.ndarray) -> np.ndarray:
        """Number of phrases of each text; ``owners``: the text of each block, in order."""
        first = np.ones(len(blocks), bool)
        first[1:] = owners[1:] != owners[:-1]
        before, after, count = (np.zeros(len(blocks), np.int64) for _ in range(3))
        todo = np.arange(len(blocks))
        while len(todo):
            for i in range(0, len(todo), LANES):
                now = todo[i : i + LANES]
                count[now], after[now] = self.parse(blocks[now], before[now])
            entered = np.where(first, 0, np.concatenate([[0], after[:-1]]))
            todo = np.flatnonzero(entered != before)
            before = entered
        last = np.append(first[1:], True)
        return np.bincount(owners, count + (last & (after > 0)), int(owners[-1]) + 1)


def entropies(texts: list[str], models: list[Automaton]) -> np.ndarray:
    """Bits a character of each text under each model; texts aren't empty."""
    points = [np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.int64) for t in texts]
    owners = np.repeat(np.arange(len(texts)), [-(-len(p) // BLOCK) for p in points])
    blocks = np.full((len(owners), BLOCK), -1, np.int64)
    row = 0
    for p in points:
        n = -(-len(p) // BLOCK)
        blocks[row : row + n].reshape(-1)[: len(p)] = p
        row += n
    sizes = np.array([len(p) for p in points])
    return np.stack([model.phrases(blocks, owners) * np.log2(max(model.length, 2)) / sizes for model in models], 1)


def train(docs: DataFrame) -> dict[str, str]:
    """Training text by language, of documents (doc_id, text, lang): ``DOCS`` of them at most, each with the same room."""
    rank = F.xxhash64("doc_id")
    known = docs.where("text is not null and lang is not null and doc_id is not null and length(text) > 0")
    picked = known.groupBy("lang", F.pmod(rank, F.lit(DOCS)).alias("bucket")).agg(F.min_by("doc_id", F.struct(rank, "doc_id")).alias("doc_id")).select("lang", "doc_id")
    n = F.length("text")
    spread = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda i: F.substring("text", F.floor(i * (n - PIECE) / (PIECES - 1)).cast("int") + 1, F.lit(PIECE)))
    text = F.when(n <= PIECES * PIECE, F.col("text")).otherwise(F.array_join(spread, " "))
    rows = known.select("doc_id", "lang", text.alias("text")).join(F.broadcast(picked), ["lang", "doc_id"]).distinct().collect()
    out: dict[str, str] = {}
    for row in sorted(rows):
        out[row.lang] = out.get(row.lang, "") + " " + letters(row.text)
    return out


def identify(texts: list[str | None], langs: list[str], models: list[Automaton]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    names, scores = ["und"] * len(texts), np.zeros(len(texts))
    full = [i for i, t in enumerate(texts) if t and langs and any(map(str.isalpha, t))]
    if full:
        bits = entropies([letters(texts[i]) for i in full], models)
        weight = np.exp2(-4 * (bits - bits.min(1, keepdims=True)))
        best = bits.argmin(1)
        for i, k, w in zip(full, best, weight, strict=True):
            names[i], scores[i] = langs[k], w[k] / w.sum()
    return names, scores


def language_id(docs: DataFrame, held_out) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each whole text; only rows that aren't ``held_out`` teach.

    ``und`` with score 0 where a text is null or has no letter, or where nothing was learned. Equal entropies go to the
    language that is first by code point. Rows without an id are scored; other columns are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    texts = train(docs.where(~held_out).select("doc_id", "text", "lang"))
    shared = spark.sparkContext.broadcast(sorted(texts.items()))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, models = [x for x, _ in shared.value], [Automaton(t) for _, t in shared.value]
        for part in parts:
            for rows in common.batches(part):
                names, scores = identify(rows.column(2).to_pylist(), langs, models)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(names, pa.string()), pa.array(scores)], names=schema.names)

    return docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(common.task(run), schema)
