"""What the operators share: scratch tables in the shared folder, tokens, hashes."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters that separate words, as a class of a regular expression.
SPACE = "[\\x20\\x09-\\x0D]"
#: Maps A-Z of UTF-8 bytes to a-z and leaves every other byte as it is.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a session within one process may leave that unset (tests): it gets a folder made here."""
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    wanted = spark.conf.get("spark.checkpoint.dir", None)
    if not wanted:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        wanted = tempfile.mkdtemp(prefix="spanloom-")
        atexit.register(shutil.rmtree, wanted, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(wanted)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


class Scratch:
    """Tables that one call of an operator writes to the shared folder: lineage ends there and every executor can read them.

    ``result`` writes what the call returns to a table that outlives it. All others go with ``free``, at the end of a ``with``
    block at the latest. No other call's tables are touched, however many run at once.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.tables = spark, name, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        self.free()

    def _new(self) -> tuple[str, str]:
        name = f"spanloom_{self.name}_{uuid.uuid4().hex}"
        return name, f"{shared_dir(self.spark)}/{name}"

    def result(self, df: DataFrame) -> DataFrame:
        _, path = self._new()
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def written(self, df: DataFrame) -> DataFrame:
        name, path = self._new()
        self.tables.append((None, path))
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, key: str, shuffle: bool = True) -> DataFrame:
        """Like ``written``, with the rows in buckets by ``key``: later joins on it don't shuffle this side again. Without ``shuffle`` each
        task writes a file for each of its buckets; for a key of which a task has few values."""
        name, path = self._new()
        self.tables.append((name, path))
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        (df.repartition(n, key) if shuffle else df).write.option("compression", "zstd").option("path", path).bucketBy(n, key).saveAsTable(name)
        return self.spark.table(name)

    def free(self) -> None:
        """Deletes this call's tables but its results."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name, path in self.tables:
            if name:
                self.spark.sql(f"drop table if exists {name}")
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        self.tables = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def numbered(rows: DataFrame, s: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` (doc_id, text, …) with ``doc``, a number for each document, in the order of ids, those without an id last.

    Where every row has an id of its own, that is the number. Otherwise each distinct pair of id and text is a document: rows without
    an id, or with different texts under one id, stay apart, and rows that repeat both are one document. Second: a table of doc, its
    id (of) and the text's hash (body) for ``matched``, or None.
    """
    doc_id = F.col("doc_id").cast("long")
    odd = rows.groupBy(doc_id.alias("doc_id")).agg(F.count(F.lit(1)).alias("n")).where("doc_id is null or n > 1")
    if odd.isEmpty():
        return rows.withColumn("doc", doc_id), None
    key = [doc_id.alias("of"), F.coalesce(F.sha2("text", 256), F.lit("")).alias("body")]
    order = [F.col("of").asc_nulls_last(), "body"]
    each = rows.select(*key).distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    names = s.written(each.select(F.monotonically_increasing_id().alias("doc"), "of", "body"))
    rows = rows.withColumns({"_of": key[0], "_body": key[1]}).join(names, F.expr("_of <=> of and _body = body")).drop("_of", "_body", "of", "body")
    return rows, names


def matched(rows: DataFrame, found: DataFrame, names: DataFrame | None, s: Scratch, how: str = "left") -> DataFrame:
    """``rows`` (doc_id, text, …) with the columns of ``found`` (doc, …), which first becomes a table that outlives the call. That table grows
    with the documents, so it is never broadcast: the plan is the same at every size."""
    doc_id = F.col("doc_id").cast("long")
    if names is None:
        found = s.result(found.withColumnRenamed("doc", "_of")).hint("merge")
        return rows.join(found, doc_id == F.col("_of"), how).drop("_of")
    found = s.result(found.join(names, "doc").drop("doc").withColumnsRenamed({"of": "_of", "body": "_body"})).hint("merge")
    return rows.join(found, doc_id.eqNullSafe(F.col("_of")) & (F.coalesce(F.sha2("text", 256), F.lit("")) == F.col("_body")), how).drop("_of", "_body")


def crc_mod(column: str, n: int) -> Column:
    """crc32 of an id written as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers (the splitmix finaliser)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """Maximal runs without the six separators, as UTF-8 bytes; ``bytes.split`` cuts at exactly these six."""
    if not text:
        return []
    raw = text.encode()
    return (raw.translate(LOWER) if lower else raw).split()


def batches(rows: pa.RecordBatch, text: str = "text", most: int = 2 << 20):
    """Cuts a batch where its texts pass ``most`` bytes; a single longer text makes a part of its own."""
    at = rows.schema.get_field_index(text)
    sizes = pa.compute.fill_null(pa.compute.binary_length(rows.column(at)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield rows.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield rows.slice(start)


def release() -> None:
    """Gives memory back: Spark keeps a Python worker for later tasks, and what the allocators hold counts against the executor."""
    gc.enable()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def task(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow that gives its memory back when it ends."""

    def wrapped(parts: Iterator) -> Iterator:
        try:
            yield from run(parts)
        finally:
            release()

    return wrapped


def group(run: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A function for applyInArrow over two sides that gives its memory back after each group."""

    def wrapped(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return run(left, right)
        finally:
            release()

    return wrapped
