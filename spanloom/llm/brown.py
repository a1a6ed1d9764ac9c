"""LM scoring: Brown class-based n-grams.

Exchange clustering deals words into classes; P(word | before) = P(class | class before) * P(word | class), smoothed, and with
a share of each class kept for words never seen (as large as the class's share of words seen once). That share goes in two parts to such
words: most of it evenly over as many unseen words as the class has words seen once (Good and Turing's estimate), and ``SPELLED`` of it
by spelling: a chain of byte pairs, learned from the words seen once, gives every spelling a probability. A text's score is the log10
of the product over its words and its end.

Every word has a class of its own choice. As in Brown's algorithm the frequent words come first: those with at least one in
``FREQUENT`` training tokens (so at most that many) are items of their own, and each other word begins in one of ``FORMS``
items by its ending. In each round of the exchange the corpus gives each item's neighbours by class, half of the items move to
the class that raises the likelihood most, and the classes go out again (after Uszkoreit and Brants, 2008). Then each other word
of training, down to those seen once, leaves its form: all its neighbours by class are brought together, and it moves by the same
rule. A last round moves frequent words among all these classes. Only words never seen in training keep the class of their
form. Only item tables of bounded size reach the driver; words, counts, contexts and scores stay distributed.

A task turns its documents into chunks with a vocabulary of their own, kept in buckets by chunk. Vocabularies, not texts, are
shuffled by word, with the classes of each word's neighbours, and come back to their chunk with the corpus counts and classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

CLASSES, ROUNDS = 32, 3
FREQUENT, FORMS = 1 << 16, 1024
#: A chunk ends after so many distinct words or tokens.
CHUNK_WORDS, CHUNK_TOKENS = 200_000, 2_000_000
#: So many words of a vocabulary make a row.
BLOCK = 1000
#: The end of a text, as a word: no word holds a separator.
END = "\n"
#: Weight of the unigram of classes in the transition from a class.
PRIOR = 20.0
#: Part of the share of unseen words that goes by spelling.
SPELLED = 0.1


def chunks(docs: DataFrame) -> DataFrame:
    """Rows of two kinds. Documents: chunk, doc_id, held_out, ids (words as numbers in the chunk). Vocabularies: chunk, id (of the first word), words,
    n (in training rows), for ``BLOCK`` words each."""
    fields = pa.schema([("chunk", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("ids", pa.list_(pa.int32())), ("id", pa.int32()), ("words", pa.list_(pa.string())), ("n", pa.list_(pa.int64()))])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 24
        number: dict[bytes, int] = {END.encode(): 0}
        count, tokens = np.zeros(1, np.int64), 0

        def vocabulary() -> pa.RecordBatch:
            starts = np.arange(0, len(number), BLOCK, dtype=np.int32)
            cuts, n = pa.array(np.append(starts, np.int32(len(number)))), len(starts)
            words = pa.ListArray.from_arrays(cuts, pa.array([w.decode() for w in number], pa.string()))
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.nulls(n, fields.field("ids").type), pa.array(starts), words, pa.ListArray.from_arrays(cuts, pa.array(count))], schema=fields)

        for part in parts:
            for rows in common.batches(part):
                lists = [[*common.words_of(t, lower=True), b"\n"] for t in rows.column(2).to_pylist()]
                sizes = np.array([len(x) for x in lists], np.int64)
                flat = np.empty(int(sizes.sum()), dtype=object)
                flat[:] = [w for x in lists for w in x]
                codes, words = pd.factorize(flat)
                own = np.array([number.setdefault(w, len(number)) for w in words], np.int32)
                ids = own[codes]
                train = np.repeat(~np.array(rows.column(1).to_pylist(), bool), sizes)
                count = np.concatenate([count, np.zeros(len(number) - len(count), np.int64)]) + np.bincount(ids[train], minlength=len(number))
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                n = len(lists)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk)), rows.column(0), rows.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)), pa.nulls(n, pa.int32()), pa.nulls(n, fields.field("words").type), pa.nulls(n, fields.field("n").type)], schema=fields)
                tokens += len(ids)
                if len(number) > CHUNK_WORDS or tokens > CHUNK_TOKENS:
                    yield vocabulary()
                    chunk, number, count, tokens = chunk + 1, {END.encode(): 0}, np.zeros(1, np.int64), 0
        if tokens:
            yield vocabulary()

    return docs.mapInArrow(common.task(run), "chunk long, doc_id long, held_out boolean, ids array<int>, id int, words array<string>, n array<long>")


def spelling(words: DataFrame) -> np.ndarray:
    """log10 P(byte | byte before), 257 x 257, over ``words`` (word); 256 stands before the first byte and after the last."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(257 * 257, np.int64)
        for rows in parts:
            after = _bytes(rows.column(0).to_pylist())
            before = np.concatenate([[256], after[:-1]])
            table += np.bincount(before[: len(after)] * 257 + after, minlength=257 * 257)
        met = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(table[met])], names=["pair", "n"])

    table = np.zeros(257 * 257)
    for pair, n in words.select("word").mapInArrow(common.task(run), "pair long, n long").groupBy("pair").agg(F.sum("n")).collect():  # 66,049 rows at most
        table[pair] = n
    table = table.reshape(257, 257)
    part = (table.sum(0) + 1) / (table.sum() + 257)
    return np.log10((table + 5 * part) / (table.sum(1, keepdims=True) + 5))


def _bytes(words: list[str]) -> np.ndarray:
    """The bytes of all words in a row, 256 after each; the end of a text has none of its own."""
    raw = np.frombuffer("".join(w.strip(END) + END for w in words).encode(), np.uint8).astype(np.int64)  # no other word holds the end
    return np.where(raw == ord(END), 256, raw)


def spelled(words: list[str], chain: np.ndarray) -> np.ndarray:
    """log10 of the probability of each word's spelling."""
    after = _bytes(words)
    each = chain[np.concatenate([[256], after[:-1]])[: len(after)], after]
    total = np.cumsum(each)[after == 256]
    return np.diff(total, prepend=0.0)


def _by_id(own: pa.Table, column: str) -> np.ndarray:
    """A column of a chunk's vocabulary, in the order of its numbers."""
    out = np.zeros(len(own), np.int64)
    out[own["id"].to_numpy()] = own[column].to_numpy()
    return out


def _flat(docs: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all words of some documents in a row, and the documents' cuts."""
    lists = docs["ids"].combine_chunks()
    cuts = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))])
    return lists.flatten().to_numpy(), cuts


def itemized(rows: DataFrame, own: DataFrame) -> DataFrame:
    """items (twice the item) of each training text; ``own``: of (chunk), id, item of all words."""

    def run(docs: pa.Table, own: pa.Table) -> pa.Table:
        flat, cuts = _flat(docs := docs.filter(pc.invert(docs["held_out"])))
        return pa.table({"items": pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array((_by_id(own, "item") * 2).astype(np.int32)[flat]))})

    texts = rows.where("ids is not null").select("chunk", "held_out", "ids")
    return texts.groupBy("chunk").cogroup(own.select("of", "id", "item").groupBy("of")).applyInArrow(common.group(run), "items array<int>")


#: So many bytes hold a word's neighbours at most: the number of each class before and after it.
WIDE = 2 * CLASSES * 4


def _packed(who: np.ndarray, codes: np.ndarray, n: np.ndarray) -> pa.Array:
    """The neighbours of ``n[k]`` tokens of each word k, of which ``codes`` has two bytes a token (in the order of k, as ``who`` says): these
    bytes, or from ``WIDE`` bytes on how often each occurs."""
    wide = 2 * n >= WIDE
    sizes = np.where(wide, WIDE, 2 * n)
    data, is_wide, far = np.empty(int(sizes.sum()), np.uint8), np.repeat(wide, sizes), wide[who]
    data[~is_wide] = codes[~far].ravel()
    number = (np.cumsum(wide) - 1)[who[far]]
    data[is_wide] = np.bincount((number[:, None] * 2 * CLASSES + codes[far]).ravel(), minlength=int(wide.sum()) * 2 * CLASSES).astype("<u4").view(np.uint8)
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _unpacked(met: pa.Array, group: np.ndarray, n: int) -> np.ndarray:
    """How often each class stands before and after the words of each of ``n`` groups of packed neighbours."""
    ends = np.frombuffer(met.buffers()[1], np.int32)[met.offset : met.offset + len(met) + 1]
    data = np.frombuffer(met.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    sizes = np.diff(ends)
    wide = sizes == WIDE
    is_wide = np.repeat(wide, sizes)
    out = np.bincount(np.repeat(group, sizes)[~is_wide] * 2 * CLASSES + data[~is_wide], minlength=n * 2 * CLASSES).reshape(n, 2 * CLASSES)
    np.add.at(out, group[wide], data[is_wide].view("<u4").reshape(-1, 2 * CLASSES))
    return out


def neighbours(rows: DataFrame, own: DataFrame, classes: np.ndarray, first: int, end: int) -> DataFrame:
    """word, of (its chunk), id, met (packed neighbours in training) of each chunk's words whose item is ``first`` or a later one."""
    shared = rows.sparkSession.sparkContext.broadcast(classes)

    def run(docs: pa.Table, own: pa.Table) -> pa.Table:
        item = _by_id(own, "item")
        cls = shared.value[item]
        flat, cuts = _flat(docs.filter(pc.invert(docs["held_out"])))
        after = cls[flat]
        before = np.concatenate([after[:0], [shared.value[end]], after[:-1]])[: len(flat)]
        before[cuts[:-1]] = shared.value[end]
        after = np.concatenate([after[1:], after[:1]])  # what stands last is an end
        others = np.flatnonzero(item >= first)
        place = np.zeros(len(item), np.int64)
        place[others] = np.arange(len(others))
        at = np.flatnonzero(item[flat] >= first)
        at = at[np.argsort(flat[at], kind="stable")]
        who = place[flat[at]]
        met = _packed(who, np.stack([before[at], CLASSES + after[at]], 1).astype(np.uint8), np.bincount(who, minlength=len(others)))
        row = np.zeros(len(item), np.int64)
        row[own["id"].to_numpy()] = np.arange(len(item))
        own = own.take(row[others])
        return pa.table({"word": own["word"], "of": own["of"], "id": own["id"], "met": met})

    texts = rows.where("ids is not null").select("chunk", "held_out", "ids")
    return texts.groupBy("chunk").cogroup(own.select("of", "id", "item", "word").groupBy("of")).applyInArrow(common.group(run), "word string, of long, id int, met binary")


def _whole(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in the order of their first column, cut only where that changes."""
    kept: list[pa.RecordBatch] = []
    for rows in parts:
        if rows.num_rows == 0:
            continue
        if kept and kept[-1].column(0)[-1] != rows.column(0)[0]:
            yield pa.Table.from_batches(kept).combine_chunks()
            kept = []
        starts = np.flatnonzero(_starts(rows.column(0)))
        if starts[-1]:
            yield pa.Table.from_batches([*kept, rows.slice(0, starts[-1])]).combine_chunks()
            kept = []
        kept.append(rows.slice(starts[-1]))
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks()


def _starts(words: pa.Array) -> np.ndarray:
    """Where another word begins."""
    return np.concatenate([[True], pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)])


def placed(found: DataFrame, classes: np.ndarray, table: np.ndarray, first: int) -> DataFrame:
    """of, id, c (count in the corpus), item and new (the word if training lacks it) for each row of ``neighbours``. Each word of training moves
    to the class with the highest likelihood: item ``first`` plus the class, and another ``CLASSES`` if it was seen once. Others keep that of their form."""
    shared = found.sparkSession.sparkContext.broadcast((classes, table))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, counts = shared.value
        for rows in _whole(parts):
            word, chunk, number, met, form = (c.chunk(0) for c in rows.columns)
            start = _starts(word)
            group = np.cumsum(start) - 1
            sums = _unpacked(met, group, int(start.sum()))
            own = of[first + form.to_numpy()[start]]
            c = sums[:, :CLASSES].sum(1)
            cls = np.where(c > 0, best(sums[:, :CLASSES].astype(np.float64), sums[:, CLASSES:].astype(np.float64), own, counts), own)
            item = (first + cls + CLASSES * (c == 1)).astype(np.int32)
            new = word.take(pa.array(np.arange(len(word)), mask=c[group] > 0))
            yield pa.RecordBatch.from_arrays([chunk, number, pa.array(c[group]), pa.array(item[group]), new], names=["of", "id", "c", "item", "new"])

    by_word = found.repartition("word").sortWithinPartitions("word").withColumn("form", _form())
    return by_word.mapInArrow(common.task(run), "of long, id int, c long, item int, new string")


def _form() -> Column:
    return (F.crc32(F.substring("word", -3, 3).cast("binary")) % FORMS).cast("int")


_ENCODED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, log_words double, items array<int>, spelled array<float>"


def encoded(rows: DataFrame, vocabulary: DataFrame, total: int, distinct: int, chain: np.ndarray) -> DataFrame:
    """Each document with its base score, the sum of the log counts of its known words, its items (twice the item, plus one if the word is
    unknown), and the log chance of each unknown word's spelling. ``vocabulary``: of (chunk), id, c, item, new (an unknown word)."""
    shared = rows.sparkSession.sparkContext.broadcast(chain)
    texts = rows.where("ids is not null").select("chunk", "doc_id", "held_out", "ids")

    def run(docs: pa.Table, own: pa.Table) -> pa.Table:
        c, item = _by_id(own, "c"), _by_id(own, "item")
        base = np.log10((c + 1) / (total + distinct + 1))
        log_w = np.log10(np.maximum(c, 1))
        by_spelling = np.zeros(len(own))
        new = own.filter(pc.equal(own["c"], 0))
        by_spelling[new["id"].to_numpy()] = spelled(new["new"].to_pylist(), shared.value)
        code = (item * 2 + (c == 0)).astype(np.int32)
        flat, cuts = _flat(docs)
        unknown = np.concatenate([[0], np.cumsum(c[flat] == 0)])[cuts]
        sums = [np.array([x[ids].sum() for ids in np.split(flat, cuts[1:-1])], np.float64) for x in (base, log_w)]
        return pa.table({"doc_id": docs["doc_id"], "held_out": docs["held_out"], "n_tokens": np.diff(cuts), "n_known": np.diff(cuts) - np.diff(unknown), "base_score": sums[0], "log_words": sums[1],
                         "items": pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(code[flat])),
                         "spelled": pa.ListArray.from_arrays(pa.array(unknown.astype(np.int32)), pa.array(by_spelling[flat[c[flat] == 0]].astype(np.float32)))})

    return texts.groupBy("chunk").cogroup(vocabulary.groupBy("of")).applyInArrow(common.group(run), _ENCODED)


def _pairs(rows: pa.RecordBatch, column: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Items of all texts in a row, whether each is unknown, the item before each (a text begins after an end), and the texts' cuts."""
    lists = rows.column(column)
    cuts = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.to_numpy()[cuts[0] : cuts[-1]]
    cuts = cuts - cuts[0]
    item = flat.astype(np.int64) >> 1
    before = np.concatenate([[end], item[:-1]]) if len(item) else item
    before[cuts[:-1][cuts[:-1] < len(item)]] = end
    return item, (flat & 1).astype(bool), before, cuts


def contexts(train: DataFrame, classes: np.ndarray, end: int) -> DataFrame:
    """For each item: how often an item of each class stands before it (l0, l1, …) and after it (r0, r1, …)."""
    shared = train.sparkSession.sparkContext.broadcast(classes)
    names = [f"{side}{k}" for side in "lr" for k in range(CLASSES)]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.astype(np.int64)
        sums = [np.zeros(len(of) * CLASSES, np.int64) for _ in "lr"]
        for rows in parts:
            item, _, before, _ = _pairs(rows, 0, end)
            sums[0] += np.bincount(item * CLASSES + of[before], minlength=len(sums[0]))
            sums[1] += np.bincount(before * CLASSES + of[item], minlength=len(sums[1]))
        left, right = (s.reshape(len(of), CLASSES) for s in sums)
        met = np.flatnonzero(left.any(1) | right.any(1))
        if len(met):
            yield pa.RecordBatch.from_arrays([pa.array(met), *(pa.array(np.ascontiguousarray(m[met, k])) for m in (left, right) for k in range(CLASSES))], names=["item", *names])

    found = train.select("items").mapInArrow(common.task(run), T.StructType([T.StructField(c, T.LongType()) for c in ("item", *names)]))
    return found.groupBy("item").agg(*(F.sum(c).alias(c) for c in names))


def transitions(found: DataFrame, classes: np.ndarray) -> np.ndarray:
    """Counts of class pairs, from the items' right neighbours."""
    shared = found.sparkSession.sparkContext.broadcast(classes)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((CLASSES, CLASSES), np.int64)
        for rows in parts:
            right = np.stack([rows.column(1 + k).to_numpy() for k in range(CLASSES)], 1)
            np.add.at(table, shared.value[rows.column(0).to_numpy()], right)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), *(pa.array(np.ascontiguousarray(table[:, k])) for k in range(CLASSES))], names=["cls", *(f"r{k}" for k in range(CLASSES))])

    names = [f"r{k}" for k in range(CLASSES)]
    each = found.select("item", *names).mapInArrow(common.task(run), T.StructType([T.StructField(c, T.LongType()) for c in ("cls", *names)]))
    table = np.zeros((CLASSES, CLASSES), np.float64)
    for row in each.groupBy("cls").agg(*(F.sum(c) for c in names)).collect():
        table[row[0]] = row[1:]
    return table


def class_pairs(train: DataFrame, classes: np.ndarray, end: int) -> np.ndarray:
    """Counts of class pairs straight from the texts; a task gives one small table."""
    shared = train.sparkSession.sparkContext.broadcast(classes)
    names = [f"r{k}" for k in range(CLASSES)]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(CLASSES * CLASSES, np.int64)
        for rows in parts:
            item, _, before, _ = _pairs(rows, 0, end)
            table += np.bincount(shared.value[before] * CLASSES + shared.value[item], minlength=CLASSES * CLASSES)
        table = table.reshape(CLASSES, CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), *(pa.array(np.ascontiguousarray(table[:, k])) for k in range(CLASSES))], names=["cls", *names])

    each = train.select("items").mapInArrow(common.task(run), T.StructType([T.StructField(c, T.LongType()) for c in ("cls", *names)]))
    out = np.zeros((CLASSES, CLASSES), np.float64)
    for row in each.groupBy("cls").agg(*(F.sum(c) for c in names)).collect():
        out[row[0]] = row[1:]
    return out


def best(left: np.ndarray, right: np.ndarray, own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The class with the highest likelihood for each row of neighbours by class, its own counts taken out of its present class first."""
    before, after = counts.sum(1) + 0.5 * CLASSES, counts.sum(0) + 0.5 * CLASSES
    forth = np.log((counts + 0.5) / before[:, None] / after[None, :])
    gain = right @ forth.T + left @ forth
    n_right, n_left = right.sum(1, keepdims=True), left.sum(1, keepdims=True)
    gone_r = np.log(np.maximum(counts[own] - right, 0) + 0.5) - np.log(np.maximum(before[own][:, None] - n_right, 0.5)) - np.log(after)[None, :]
    gone_l = np.log(np.maximum(counts.T[own] - left, 0) + 0.5) - np.log(np.maximum(after[own][:, None] - n_left, 0.5)) - np.log(before)[None, :]
    gain[np.arange(len(own)), own] = (right * gone_r).sum(1) + (left * gone_l).sum(1)
    return gain.argmax(1)


def exchange(found: DataFrame, classes: np.ndarray, table: np.ndarray, turn: int) -> np.ndarray:
    """Moves every second item to its best class."""
    shared = found.sparkSession.sparkContext.broadcast((classes, table))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, counts = shared.value
        for rows in parts:
            item = rows.column(0).to_numpy()
            left, right = (np.stack([rows.column(1 + side * CLASSES + k).to_numpy() for k in range(CLASSES)], 1).astype(np.float64) for side in (0, 1))
            moved = np.where((item + turn) % 2 == 0, best(left, right, of[item], counts), of[item])
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(moved)], names=["item", "cls"])

    moved = found.mapInArrow(common.task(run), "item long, cls long").toPandas()
    out = classes.copy()
    out[moved["item"].to_numpy(np.int64)] = moved["cls"].to_numpy(np.int64)
    return out


def score_texts(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each whole text (doc_id: an integer).

    Learns from the rows that aren't ``held_out``. A null text counts as empty: its only token is the end. Without training
    rows every probability is 1 and the scores are 0. Repeated rows count and are scored each time, a null doc_id is kept,
    other columns are ignored, no rows give no rows.
    """
    spark = docs.sparkSession
    with common.Scratch(spark, "brown") as s, common.Scratch(spark, "words") as word_tables, common.Scratch(spark, "counts") as count_table:
        return s.result(_score_texts(docs, held_out, s, word_tables, count_table))


def _score_texts(docs: DataFrame, held_out: Column, s: common.Scratch, word_tables: common.Scratch, count_table: common.Scratch) -> DataFrame:
    spark = docs.sparkSession
    rows = word_tables.bucketed(chunks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")), "chunk", shuffle=False)
    counts = count_table.written(rows.where("ids is null").select("n", F.posexplode("words").alias("at", "word")).selectExpr("word", "n[at] as n").groupBy("word").agg(F.sum("n").alias("c")))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum((F.col("c") > 0).cast("long")), F.lit(0))).first()

    # At most FREQUENT words have so large a share of the tokens; the end is one more.
    top = counts.where(((F.col("c") > 0) & (F.col("c") * FREQUENT >= total)) | (F.col("word") == END)).orderBy(F.desc("c"), "word").collect()
    first = len(top)
    frequent = F.broadcast(spark.createDataFrame([(r.word, r.c, i) for i, r in enumerate(top)], "word string, c long, rank int"))
    end = next((i for i, r in enumerate(top) if r.word == END), 0)
    chain = spelling(counts.where(F.col("c") == 1))
    count_table.free()
    own = rows.where("ids is null").select("chunk", "id", F.posexplode("words").alias("at", "word")).selectExpr("chunk as of", "id + at as id", "word").join(frequent, "word", "left").withColumn("item", F.coalesce("rank", first + _form()))

    train = count_table.written(itemized(rows, own))
    classes = np.arange(first + FORMS) % CLASSES
    for turn in range(ROUNDS):
        found = s.written(contexts(train, classes, end))
        classes = exchange(found, classes, transitions(found, classes), turn)
    table = class_pairs(train, classes, end)
    count_table.free()

    each = placed(neighbours(rows, own, classes, first, end), classes, table, first)
    each = each.unionByName(own.where("rank is not null").select("of", "id", "c", "item", F.expr("if(c = 0, word, null)").alias("new")))
    text = s.written(encoded(rows, each, total, distinct, chain))
    word_tables.free()  # all that is needed of the words is in ``text``
    train = text.where("not held_out")
    classes = np.concatenate([classes[:first], np.arange(2 * CLASSES) % CLASSES])  # the items of ``placed``
    found = s.written(contexts(train, classes, end))
    classes = exchange(found.where(F.col("item") < first), classes, transitions(found, classes), ROUNDS)
    table = class_pairs(train, classes, end)

    n, once = np.zeros(len(classes)), np.zeros(len(classes))
    n[:first], once[:first] = [r.c for r in top], [r.c == 1 for r in top]
    for item, tokens in found.where(F.col("item") >= first).select("item", sum(F.col(f"l{k}") for k in range(CLASSES))).collect():  # 64 rows
        n[item], once[item] = tokens, tokens * (item >= first + CLASSES)
    size, alone = np.bincount(classes, n, CLASSES), np.bincount(classes, once, CLASSES)
    prior = (size + 0.5) / (size.sum() + 0.5 * CLASSES)
    forth = np.log10((table + PRIOR * prior) / (table.sum(1, keepdims=True) + PRIOR))
    fresh = np.clip((alone + 0.5) / (size + 1), 1e-9, 0.9)
    known = np.log10(1 - fresh) - np.log10(np.maximum(size, 1))
    shared = spark.sparkContext.broadcast((classes, forth, known, np.log10(fresh), np.log10(alone + 1)) if total else None)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in parts:
            result = np.zeros(rows.num_rows)
            if shared.value is not None:
                of, step, emit, new, unseen = shared.value
                item, unknown, before, cuts = _pairs(rows, 6, end)
                cls = of[item]
                each = step[of[before], cls] + np.where(unknown, new[cls], emit[cls])
                each[unknown] += np.logaddexp(math.log(SPELLED) + math.log(10) * rows.column(7).flatten().to_numpy().astype(np.float64), math.log(1 - SPELLED) - math.log(10) * unseen[cls[unknown]]) / math.log(10)
                total_of = np.concatenate([[0.0], np.cumsum(each)])
                result = total_of[cuts[1:]] - total_of[cuts[:-1]] + rows.column(5).to_numpy()
            yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(4)), pa.array(np.full(rows.num_rows, total, np.int64)), rows.column(4), pa.array(result)],
                                             names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return text.mapInArrow(common.task(run), schema)
