"""Source divergence audit: a K-squared quadtree over the matrix of groups and terms.

Rows are the groups (language, source), columns the kept terms of the language, cells the terms' shares in the group. Most cells
are empty: an empty cell has the same share all along its row, so where both rows of a pair are empty over a range of columns, the range is
priced at once. The matrix is cut into tiles, ``BLOCK`` columns (dealt by the terms' hash) by two blocks of ``ROWS`` groups; a tile
becomes a K-squared tree with K = 2: each node tells which of its four quadrants hold anything. One traversal goes down the tree for
all pairs of rows together, each pair once for both directions, as long as either side holds something; a quadrant pair without anything is priced by its number of
columns, a leaf by its cells. Tiles give one sum a pair, and the first ``TOP`` terms a group; Spark adds these up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Columns and rows of the blocks that a tile is made of; terms listed of a group; documents that a kept term needs.
BLOCK, ROWS, TOP, LEAST = 2048, 32, 200, 3
#: Bytes of text whose terms are counted at once: the more, the fewer rows are shuffled.
PIECE = 16 << 20
#: Leaves of a tile's pairs that are priced at once.
LEAVES = 1 << 16
#: Shares are counted in billionths.
SCALE = 1_000_000_000
#: Letters A-Z become small, other bytes below 128 that are no letters separate terms.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _tokens(text: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of all texts, one after the other, as a dictionary array; and how many each text has."""
    text = text.cast(pa.large_string())
    at = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    raw = text.buffers()[2].slice(at[0], at[-1] - at[0]).to_pybytes() if at[-1] > at[0] else b""
    raw, at = np.frombuffer(raw.translate(LETTERS), np.uint8), at - at[0]
    letter = raw != 32
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    edges = at[:-1][at[:-1] < at[1:]]  # no term reaches into the next text
    begins[edges] = letter[edges]
    counts = np.diff(np.searchsorted(np.flatnonzero(begins), at))
    raw, starts = raw[letter], np.flatnonzero(begins[letter])
    places = pa.py_buffer(np.append(starts, len(raw)).astype(np.int64))
    return pa.LargeStringArray.from_buffers(len(starts), places, pa.py_buffer(raw)).dictionary_encode(), counts


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, term, g, n, docs) over ``docs`` (lang, g, text): how often the term occurs in the group and in how many documents. Rows are
    dealt by lang and term."""
    schema = "lang string, term string, g long, n long, docs long"

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for rows in common.batches(part, most=PIECE):
                words, counts = _tokens(rows.column("text"))
                if not len(words):
                    continue
                kinds, many = len(words.dictionary), len(rows)
                lang, g = (rows.column(k).dictionary_encode() for k in ("lang", "g"))
                group = lang.indices.to_numpy().astype(np.int64) * len(g.dictionary) + g.indices.to_numpy()
                key = (np.repeat(group, counts) * kinds + words.indices.to_numpy()) * many + np.repeat(np.arange(many), counts)
                key.sort()  # by group, term and document
                once = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                cell = key[once] // many
                first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
                cell, n, held = cell[first], np.diff(np.append(once[first], len(key))), np.diff(np.append(first, len(once)))
                group, term = cell // kinds, cell % kinds
                yield pa.RecordBatch.from_arrays(
                    [
                        lang.dictionary.take(pa.array(group // len(g.dictionary))).cast(pa.string()),
                        words.dictionary.take(pa.array(term)).cast(pa.string()),
                        g.dictionary.take(pa.array(group % len(g.dictionary))),
                        pa.array(n, pa.int64()),
                        pa.array(held, pa.int64()),
                    ],
                    names=["lang", "term", "g", "n", "docs"],
                )

    found = docs.select("lang", "g", "text").mapInArrow(common.task(run), schema).repartition("lang", "term")
    return found.groupBy("lang", "term", "g").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _lists(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, lang, term, total, lead, g, n) in order of terms to rows (h, lang, term, total, lead, r, x): the cells x (g, n) that a term has
    among the groups of block r. A term that goes on in the next batch has several rows; one of all has ``lead``."""
    for part in parts:
        if not len(part):
            continue
        lang, term = (part.column(k).dictionary_encode() for k in ("lang", "term"))
        g = part.column("g").to_numpy()
        key = (lang.indices.to_numpy().astype(np.int64) * len(term.dictionary) + term.indices.to_numpy()) * (int(g.max()) // ROWS + 1) + g // ROWS
        order = np.argsort(key, kind="stable")
        key, g = key[order], g[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        lead = np.logical_or.reduceat(part.column("lead").to_numpy(zero_copy_only=False)[order], first)
        cells = pa.StructArray.from_arrays([pa.array(g), part.column("n").take(pa.array(order))], ["g", "n"])
        x = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)).astype(np.int32)), cells)
        heads = [part.column(k).take(pa.array(order[first])) for k in ("h", "lang", "term", "total")]
        yield pa.RecordBatch.from_arrays([*heads, pa.array(lead), pa.array(g[first] // ROWS), x], names=["h", "lang", "term", "total", "lead", "r", "x"])


def _share(n: str, size: str) -> Column:
    """1 + floor(SCALE * (n + 1) / (size + kinds)) of columns, exact at any count."""
    return F.expr(f"1L + cast({SCALE} as decimal(10, 0)) * cast({n} + 1 as decimal(20, 0)) div cast({size} + kinds as decimal(20, 0))")


class Tree:
    """A K-squared tree (K = 2) over the cells (row, column) of a sparse matrix: for each level, which quadrants of each node that holds
    something hold something themselves, and where the nodes below are."""

    def __init__(self, row: np.ndarray, column: np.ndarray, levels: int):
        code = np.zeros(len(row), np.int64)
        for bit in range(levels):
            code |= ((row >> bit) & 1) << (2 * bit + 1) | ((column >> bit) & 1) << (2 * bit)
        self.order = np.argsort(code)
        code = code[self.order]
        self.levels, self.below = levels, []
        nodes = np.unique(code >> (2 * levels)) if len(code) else np.zeros(0, np.int64)
        for level in range(levels):
            children = np.unique(code >> (2 * (levels - level - 1)))
            below = np.full((len(nodes), 4), -1, np.int32)
            below[np.searchsorted(nodes, children >> 2), children & 3] = np.arange(len(children))
            self.below.append(below)
            nodes = children

    def joint(self, rows: int, columns: int, one: np.ndarray, other: np.ndarray):
        """Walks the tree for all pairs of a row marked in ``one`` and a row marked in ``other``, each pair once, the smaller row first.
        Yields (row, other row, columns, width): ranges of 2**k rows each (as prefix, k) that both are empty over so many columns;
        and lastly the leaves (row, other row, cell or -1, cell or -1) at which either holds something."""
        a = b = column = np.zeros(1, np.int32)
        x = y = np.zeros(1, np.int32) if len(self.order) else np.full(1, -1, np.int32)
        if not len(self.order):
            yield a, b, np.full(1, columns, np.int64), self.levels
            return
        for level in range(self.levels):
            width = self.levels - level - 1
            size = -(-rows // (1 << width))
            held = [np.add.reduceat(m.astype(np.int64), np.arange(0, rows, 1 << width)) > 0 for m in (one, other)]
            wanted = np.triu((held[0][:, None] & held[1][None, :]) | (held[1][:, None] & held[0][None, :]), 1 if width == 0 else 0)
            wanted = np.pad(wanted, (0, 2))  # children past the last row
            below, found = np.vstack([self.below[level], np.full((1, 4), -1, np.int32)]), []  # the last row is that of node -1
            for i in (0, 1):
                for j in (0, 1):
                    both = np.flatnonzero(wanted[2 * a + i, 2 * b + j])
                    u, v, c, px, py = a[both], b[both], column[both], x[both], y[both]
                    for k in (0, 1):
                        nc, nx, ny = 2 * c + k, below[px, 2 * i + k], below[py, 2 * j + k]
                        some = (nx >= 0) | (ny >= 0)
                        empty = np.flatnonzero(~some & (nc << width < columns))
                        if len(empty):
                            yield 2 * u[empty] + i, 2 * v[empty] + j, np.minimum(1 << width, columns - (nc[empty] << width)), width
                        some = np.flatnonzero(some)
                        found.append((2 * u[some] + i, 2 * v[some] + j, nc[some], nx[some], ny[some]))
            a, b, column, x, y = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.append(self.order, -1).astype(np.int32)
        yield a, b, order[x], order[y]


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def pair_sums(row: np.ndarray, column: np.ndarray, share: np.ndarray, empty: np.ndarray, columns: int, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The matrix of sums over ``columns`` columns of (p - q)^2 / q, each rounded down, for rows marked in ``one`` (p) and in ``other`` (q).
    Cells (row, column) have a ``share``; ``empty`` is the share of each row's other cells."""
    rows = len(empty)
    tree = Tree(row, column, max(1, int(max(rows, columns, 2) - 1).bit_length()))
    sums, blank = np.zeros(rows * rows, np.int64), np.zeros((rows, rows), np.int64)
    *ranges, leaves = [*tree.joint(rows, columns, one, other)] if len(row) else [*tree.joint(rows, columns, one, other), None]
    for a, b, n, width in ranges:
        size = -(-rows // (1 << width))
        part = np.zeros(size * size, np.int64)
        np.add.at(part, a.astype(np.int64) * size + b, n.astype(np.int64))
        part = part.reshape(size, size)
        part = part + np.triu(part, 1).T
        blank += np.repeat(np.repeat(part, 1 << width, 0), 1 << width, 1)[:rows, :rows]
    for at in range(0, len(leaves[0]) if leaves else 0, LEAVES):
        a, b, x, y = (c[at : at + LEAVES] for c in leaves)
        p, q = np.where(x >= 0, share[x], empty[a]), np.where(y >= 0, share[y], empty[b])
        a, b, square = a.astype(np.int64), b.astype(np.int64), (p - q) * (p - q)
        np.add.at(sums, a * rows + b, square // q)
        np.add.at(sums, b * rows + a, square // p)
    return sums.reshape(rows, rows) + blank * _apart(empty[:, None], empty[None, :])


def _shares(n: np.ndarray, of: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (n + 1) / of), exact at any count."""
    if len(n) and int(n.max()) >= (1 << 63) // SCALE - 1:
        return np.array([1 + SCALE * (int(x) + 1) // int(y) for x, y in zip(n, of, strict=True)], np.int64)
    return 1 + SCALE * (n + 1) // of


def _flat(lists: pa.ChunkedArray) -> np.ndarray:
    return lists.combine_chunks().flatten().to_numpy()


def _tile(table: pa.Table) -> pa.Table:
    """The pairs (g, h, value) of one tile, and for tiles on the diagonal the first terms (g, term, value) of its groups."""
    lang, i, j = (table.column(k)[0].as_py() for k in ("lang", "i", "j"))
    head, cells = (table.filter(pc.is_null(table.column("term"), nan_is_null=False) if x else pc.is_valid(table.column("term"))) for x in (True, False))
    groups, empty, sizes = (_flat(head.column(k)) for k in ("g", "x", "size"))
    first = np.repeat(head.column("side").to_numpy() == i, pc.list_value_length(head.column("g")).to_numpy())
    order = np.argsort(groups)
    groups, empty, sizes, first = groups[order], empty[order], sizes[order], first[order]
    words = cells.column("term").combine_chunks().dictionary_encode()
    by_name = pc.sort_indices(words.dictionary).to_numpy()  # by UTF-8 bytes
    terms, number = words.dictionary.take(pa.array(by_name)), np.argsort(by_name)[words.indices.to_numpy()]
    row = np.searchsorted(groups, _flat(cells.column("g")))
    column = np.repeat(number, pc.list_value_length(cells.column("g")).to_numpy())
    share = _shares(_flat(cells.column("x")), sizes[row])
    sums = pair_sums(row, column, share, empty, head.column("m")[0].as_py(), first, first if i == j else ~first)
    a, b = np.nonzero((first[:, None] & first[None, :] & ~np.eye(len(groups), dtype=bool)) if i == j else first[:, None] != first[None, :])
    out = [(pa.array(groups[a]), pa.array(groups[b]), pa.nulls(len(a), pa.string()), pa.array(sums[a, b]))]
    if i == j and len(row):
        q = np.zeros(len(terms), np.int64)
        q[number] = cells.column("q").to_numpy()
        more = np.flatnonzero(share > q[column])
        value = _apart(share[more], q[column[more]])
        order = np.lexsort((column[more], -value, row[more]))
        r = row[more][order]
        order = order[np.arange(len(r)) - np.searchsorted(r, r) < TOP]
        out += [(pa.array(groups[row[more][order]]), pa.nulls(len(order), pa.int64()), terms.take(pa.array(column[more][order])), pa.array(value[order]))]
    return pa.concat_tables(pa.table([pa.array([lang] * len(x[0]), pa.string()), *x], names=["lang", "g", "h", "term", "value"]) for x in out)


def divergence(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: how far each group (lang, source) of ``docs`` is from the other sources of its language
    (part 'pair', item the other source) and which terms set it apart from the language as a whole (part 'term').

    Null text, lang and source count as empty. A term is kept with ``LEAST`` documents of the language at least; a language
    without any gives pairs of value 0. A group without terms has the share of an absent term all over. Ties are ranked by item. Repeated
    rows count each time; ids and other columns are ignored; no rows give no rows. The pairs of a language are as many as the square of its
    sources: that is the result, and no task holds more than two blocks of them.
    """
    docs = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    with common.Scratch(docs.sparkSession, "divergence") as s:
        return s.result(_divergence(docs, s))


def _divergence(docs: DataFrame, s: common.Scratch) -> DataFrame:
    numbers = docs.select("lang", "source").distinct().withColumn("g", F.row_number().over(W.partitionBy("lang").orderBy("source")).cast("long") - 1)
    numbers = s.written(numbers.withColumn("r", F.floor(F.col("g") / ROWS)).withColumn("many", F.max("r").over(W.partitionBy("lang"))))
    counts = term_counts(docs.join(numbers.select("lang", "source", "g"), ["lang", "source"]))
    one = W.partitionBy("h", "lang", "term")  # the hash comes first as numbers are sorted faster; rows are where they belong already
    kept = counts.withColumn("h", F.xxhash64("term")).withColumns({"total": F.sum("n").over(one), "docs": F.sum("docs").over(one), "lead": F.col("g") == F.min("g").over(one)})
    kept = kept.where(F.col("docs") >= LEAST).select("h", "lang", "term", "total", "lead", "g", "n")
    lists = s.written(kept.mapInArrow(common.task(_lists), "h long, lang string, term string, total long, lead boolean, r long, x array<struct<g: long, n: long>>"))
    langs = lists.where("lead").groupBy("lang").agg(F.count(F.lit(1)).alias("kinds"), F.sum("total").alias("lang_size"))
    sizes = lists.select("lang", F.inline("x")).groupBy("lang", "g").agg(F.sum("n").alias("size"))
    groups = numbers.join(langs, "lang", "left").join(sizes, ["lang", "g"], "left")
    about = s.written(groups.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("kinds", "lang_size", "size")}))
    langs = about.select("lang", "many", "kinds", "lang_size").distinct()

    block = F.pmod("h", F.ceil(F.col("kinds") / BLOCK))
    tiles = F.explode(F.sequence(F.lit(0).cast("long"), F.col("many")))  # the other block of rows
    ends = [F.least("r", "o").alias("i"), F.greatest("r", "o").alias("j"), F.col("r").alias("side")]
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    placed = lists.join(langs, "lang").withColumns({"block": block, "q": _share("total", "lang_size")})
    cells = placed.withColumn("o", tiles).select("lang", "block", *ends, none("long", "m"), "term", "q", "x.g", F.col("x.n").alias("x"), none("array<long>", "size"))

    blocks = placed.where("lead").groupBy("lang", "block").agg(F.count(F.lit(1)).alias("m"))
    heads = about.where("kinds > 0").withColumn("p", _share("0", "size")).withColumn("size", F.expr("size + kinds"))
    heads = heads.groupBy("lang", "r").agg(F.first("many").alias("many"), F.collect_list(F.struct("g", "p", "size")).alias("x")).join(blocks, "lang")
    heads = heads.withColumn("o", tiles).select("lang", "block", *ends, "m", none("string", "term"), none("long", "q"), "x.g", F.col("x.p").alias("x"), "x.size")
    found = cells.unionByName(heads).groupBy("lang", "block", "i", "j").applyInArrow(_tile, "lang string, g long, h long, term string, value long")
    found = s.written(found)

    name = lambda g, source: about.select("lang", F.col("g").alias(g), F.col("source").alias(source))
    sums = found.where("h is not null").groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    bare = about.where("kinds = 0").select("lang", "g")
    bare = bare.join(bare.withColumnRenamed("g", "h"), "lang").where("g <> h").select("lang", "g", "h", F.lit(0).cast("long").alias("value"))
    pairs = sums.unionByName(bare).join(name("h", "item"), ["lang", "h"]).select("lang", "g", F.lit("pair").alias("part"), "item", "value")
    terms = found.where("term is not null").select("lang", "g", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    place = F.row_number().over(W.partitionBy("lang", "g").orderBy(F.desc("value"), "item"))
    ranked = pairs.withColumn("rank", place).unionByName(terms.withColumn("rank", place).where(F.col("rank") <= TOP))
    return ranked.join(name("g", "source"), ["lang", "g"]).select("lang", "source", "part", "item", "value", "rank")
