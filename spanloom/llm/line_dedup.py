"""Line dedup: segment-partition edit join (after PassJoin, Li et al., 2011), with DataFrame operations only.

Two lines within ``EDITS`` edits share one of EDITS + 1 segments, at a place that differs by few characters. Each distinct line
is filed under the hashes of its segments, with its length; it probes the segments of lines as long or up to EDITS shorter at
the places that the multi-match-aware selection leaves. Counts of letters, of which an edit changes two by one at most, are
compared inside the join, so that lines with a segment in common but much else apart make no rows. The others are verified by a
banded bit-parallel edit distance. Equal lines are one line from the start; linked lines form classes.

A line is named by a 64-bit hash. Blank lines are no lines here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

#: Edits, and the characters that a line needs to be compared by them; shorter lines are only compared exactly.
EDITS, SHORTEST = 2, 24
#: Frequent letters whose counts screen pairs: four bits each in one number.
LETTERS = "etaonirshdlucmpg"
BITS = 4


def _segments(n: int, length: Column) -> list[tuple[Column, Column]]:
    """Start (from 0) and length of each of n even segments: the last ones are longer by one where it doesn't divide."""
    short, long = F.floor(length / n), length % n
    out = []
    for i in range(n):
        extra = F.greatest(F.lit(0), F.lit(i) - (F.lit(n) - long))
        out.append(((short * i + extra).cast("int"), (short + (F.lit(i) >= F.lit(n) - long).cast("int")).cast("int")))
    return out


def _keys(line: Column, length: Column, edits: int, probes: bool) -> Column:
    """The keys under which a line is filed (its own segments), or all that it probes. A place outside the line gives a key of other
    text: at worst one more pair to verify."""
    n = edits + 1
    out = []
    for less in range(edits + 1 if probes else 1):
        other = length - less
        for i, (start, size) in enumerate(_segments(n, other), 1):
            low, high = (max(-(i - 1), less - (n - i)), min(i - 1, less + (n - i))) if probes else (0, 0)
            for shift in range(low, high + 1):
                out.append(F.xxhash64(other, F.lit(i), F.substring(line, start + (shift + 1), size)))
    return F.array(*out)


def _measures(line: Column) -> list[Column]:
    """Length, and the letters' counts modulo 16 in one number."""
    packed = F.lit(0).cast("long")
    for i, x in enumerate(LETTERS):
        count = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(x), F.lit("")))
        packed = packed.bitwiseOR(F.shiftleft((count % (1 << BITS)).cast("long"), BITS * i))
    return [F.length(line).alias("length"), packed.alias("letters")]


def edit_distance(a: Column, b: Column, most: int) -> Column:
    """Edits between a and b (lists of characters), if ``most`` or fewer and the lengths differ by no more; otherwise a larger number.

    Bit-parallel along a band (after Hyyrö, 2003): a word of 2 * most + 1 bits holds the vertical differences of the band's cells
    in one column of the table. First the cell at the band's edge is followed down its diagonal, then along the last row.
    """
    width = 2 * most + 1
    full = (1 << width) - 1
    rows = F.size(a)

    def step(acc: Column, j: Column) -> Column:
        char = F.get(b, j)
        match = F.lit(0)
        for bit in range(width):
            match = match + F.when(F.get(a, j + (most - (width - 1) + bit)) == char, F.lit(1 << bit)).otherwise(F.lit(0))
        vp, vn, dist, mask = acc["vp"], acc["vn"], acc["dist"], acc["mask"]

        def with_match(x: Column) -> Column:
            d0 = ((((x.bitwiseAND(vp)) + vp).bitwiseXOR(vp)).bitwiseOR(x).bitwiseOR(vn)).bitwiseAND(F.lit(full))

            def with_d0(d: Column) -> Column:
                hp = vn.bitwiseOR(F.lit(full) - d.bitwiseOR(vp))
                hn = d.bitwiseAND(vp)
                down = d.bitwiseAND(F.lit(1 << (width - 1))) == 0
                diagonal = j < rows - most
                along = F.when(hp.bitwiseAND(mask) != 0, 1).when(hn.bitwiseAND(mask) != 0, -1).otherwise(0)
                d1 = F.shiftright(d, 1)
                return F.struct(
                    hn.bitwiseOR(F.lit(full) - d1.bitwiseOR(hp)).alias("vp"), d1.bitwiseAND(hp).alias("vn"),
                    (dist + F.when(diagonal, down.cast("int")).otherwise(along)).alias("dist"),
                    F.when(diagonal, mask).otherwise(F.shiftright(mask, 1)).alias("mask"))

            return F.element_at(F.transform(F.array(d0), with_d0), 1)

        return F.element_at(F.transform(F.array(match), with_match), 1)

    first = F.struct(F.lit(full ^ ((1 << most) - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(most).alias("dist"), F.lit(1 << (width - 2)).alias("mask"))
    steps = F.when(F.size(b) > 0, F.sequence(F.lit(0), F.size(b) - 1))
    return F.aggregate(steps, first, step, lambda acc: acc["dist"])


def _characters(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit("(?s)."), F.lit(0))


def _lines(docs: DataFrame) -> DataFrame:
    """doc, line_no, line, h of every line with a word; ``docs`` has doc (a number for each document) and text."""
    each = docs.dropDuplicates(["doc"]) if "again" in docs.columns else docs
    each = each.select("doc", F.posexplode(F.split(F.col("text"), "\n", -1)).alias("line_no", "line"))
    return each.where(F.col("line").rlike("[^\\x20\\x09-\\x0D]")).withColumn("h", F.xxhash64("line"))


def distinct_lines(lines: DataFrame, s: common.Scratch) -> DataFrame:
    """Each text once: h, first (doc, line_no), line, length, letters; in buckets by h."""
    each = lines.groupBy("h").agg(F.min(F.struct("doc", "line_no")).alias("first"), F.min("line").alias("line"))
    return s.bucketed(each.select("*", *_measures(F.col("line"))), "h")


def line_links(distinct: DataFrame, s: common.Scratch, edits: int = EDITS) -> DataFrame:
    """(a, b), a < b: hashes of different lines within ``edits`` edits; ``distinct`` as ``distinct_lines`` gives it."""
    lines = distinct.where(F.col("length") >= SHORTEST)
    rows = lambda probes: lines.select("h", "letters", F.explode(_keys(F.col("line"), F.col("length"), edits, probes)).alias("key"))
    a, b = rows(False).hint("shuffle_hash").alias("a"), rows(True).alias("b")  # the smaller side is hashed: no sort of the probes
    apart, top = F.lit(0).cast("long"), (1 << BITS) - 1
    for i in range(len(LETTERS)):
        one, two = (F.shiftrightunsigned(f"{side}.letters", BITS * i).bitwiseAND(F.lit(top)) for side in "ab")
        gap = (one - two).bitwiseAND(F.lit(top))
        apart = apart + F.least(gap, F.lit(1 << BITS) - gap)
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.h") != F.col("b.h")) & (apart <= 2 * edits))
    pairs = s.written(pairs.select(F.least("a.h", "b.h").alias("a"), F.greatest("a.h", "b.h").alias("b")).distinct())
    sides = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("h"))
    # The characters become lists in the aggregation: inside the fold they would be taken apart again at every step.
    side = lambda c: F.max(F.when(F.col("h") == F.col(c), _characters(F.col("line"))))
    texts = distinct.select("h", "line").join(sides, "h").groupBy("a", "b").agg(side("a").alias("left"), side("b").alias("right"))
    texts = texts.where(F.abs(F.size("left") - F.size("right")) <= edits)
    texts = texts.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a", "b")  # few bytes, much work
    return s.written(texts.where(edit_distance(F.col("left"), F.col("right"), edits) <= edits).select("a", "b"))


def decisions(docs: DataFrame, s: common.Scratch, edits: int = EDITS) -> DataFrame:
    """Every line (doc, line_no, h) of ``docs`` (doc, text) with its links, the first document of its class, and whether it is kept: the
    first line of its class, by document and place."""
    lines = _lines(docs)
    distinct = distinct_lines(lines, s)
    links = line_links(distinct, s, edits)
    comps = components(links, s)
    of = distinct.select("h", "first").join(comps.withColumnRenamed("node", "h"), "h", "left").withColumn("comp", F.coalesce("comp", "h"))
    number = links.select(F.explode(F.array("a", "b")).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("links"))
    heads = of.groupBy("comp").agg(F.min("first").alias("head"))
    table = s.written(of.join(heads, "comp").join(number, "h", "left").select("h", "first", "head", F.coalesce("links", F.lit(0)).alias("links")))
    every = lines.select("doc", "line_no", "h").join(table, "h")
    here = F.struct("doc", "line_no")
    return every.select("doc", "line_no", "links", F.col("head.doc").alias("class_doc"), (here == F.col("head")).alias("kept"), (here != F.col("first")).alias("copy"))


def _numbered(docs: DataFrame, s: common.Scratch) -> tuple[DataFrame, DataFrame | None]:
    rows, names = common.numbered(docs, s)
    return (rows, None) if names is None else (rows.withColumn("again", F.lit(True)), names)


def line_dedup(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """doc_id, n_lines, n_copies, n_near, n_links and class_id of each row of ``docs`` (doc_id: an integer).

    n_copies: lines whose exact text stands earlier (smaller doc_id, or higher up); n_near: lines that stand first with their text
    but belong to the class of an earlier line. Both are removed. n_links: links of the document's lines to different texts.
    class_id: the smallest doc_id with a line of the same class as one of its lines; without lines its own.
    Null and empty texts have no lines. Each distinct pair of id and text is a document: rows without an id come after all others, each
    text on its own (class_id is null if no document with an id has a line of the class); rows that repeat both get the same result.
    Very long lines are compared whole. Other columns are ignored; no rows give no rows.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with common.Scratch(docs.sparkSession, "lines") as s:
        rows, names = _numbered(given, s)
        each = decisions(rows, s, edits).groupBy("doc").agg(
            F.count(F.lit(1)).alias("n_lines"), F.count_if("copy").alias("n_copies"), F.count_if(~F.col("copy") & ~F.col("kept")).alias("n_near"),
            F.sum("links").alias("n_links"), F.min("class_doc").alias("class_id"))
        if names is not None:
            each = each.join(names.select(F.col("doc").alias("class_id"), F.col("of").alias("class_of")), "class_id").drop("class_id").withColumnRenamed("class_of", "class_id")
        rows = common.matched(given, each.withColumn("found", F.lit(True)), names, s)
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_lines", "n_copies", "n_near", "n_links")]
    return rows.select("doc_id", *zero, F.when(F.col("found"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))


def drop_lines(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """The rows of ``docs``, columns as given, without the lines that ``line_dedup`` removes. A document of which no line is left
    goes: all that it said stands in earlier documents. A document without any line stays. Rows without an id are told apart by their
    texts, as are texts that share an id."""
    row = F.struct(*(docs[f"`{c}`"].alias(c) for c in docs.columns)).alias("row")  # in one column, the given names clash with none here
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row)
    with common.Scratch(docs.sparkSession, "lines") as s:
        rows, names = _numbered(given.drop("row"), s)
        gone = decisions(rows, s, edits).where("not kept").groupBy("doc").agg(F.collect_set("line_no").alias("gone"))
        rows = common.matched(given, gone, names, s)
    parts = F.split(F.col("row.text"), "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n"))
    rows = rows.select("row", "gone", text.alias("left_over")).where(F.col("gone").isNull() | F.col("left_over").rlike("[^\\x20\\x09-\\x0D]"))
    return rows.select(*(F.col("left_over" if c == "text" else f"row.`{c}`").alias(c) for c in docs.columns))
