"""Keyed tables that streams fold batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


class ChangeLog:
    """A table of one row a key, kept as the changes of each micro-batch.

    A batch reads the state before it (``before``) and writes its changes (``write``) to a folder with its number. A batch that is run again,
    after a restart or a lost driver, sees the same state and writes the same folder again, so nothing counts twice. Every
    ``every``-th batch also writes the whole state, so a read goes over few batches however long the stream has run.
    """

    def __init__(self, path: str, schema: str, key: list[str], every: int = 20):
        self.path, self.schema, self.key, self.every = path, StructType.fromDDL(schema), key, every

    def _read(self, spark: SparkSession, path: str, name: str) -> DataFrame:
        return spark.read.schema(StructType([*self.schema.fields, StructField(name, LongType())])).parquet(path).withColumnRenamed(name, "_v")

    def _latest(self, rows: DataFrame) -> DataFrame:
        names = self.schema.names
        others = [c for c in names if c not in self.key]
        return rows.groupBy(*self.key).agg(F.max_by(F.struct(*(others or ["_v"])), "_v").alias("_x")).select(*(F.col(c if c in self.key else f"_x.{c}").alias(c) for c in names))

    def before(self, spark: SparkSession, batch_id: int, by: str | None = None) -> DataFrame:
        """The latest row of each key by the batches before ``batch_id``. With ``by``, a column of the key, the rows are dealt by it alone, so that what
        groups or joins by it next needs no other shuffle."""
        if batch_id <= 0:
            return spark.createDataFrame([], self.schema)
        whole = (batch_id - 1) // self.every * self.every
        rows = self._read(spark, f"{self.path}/changes", "v").where((F.col("_v") < batch_id) & (F.col("_v") >= (whole + 1 if whole else 0)))
        rows = rows.unionByName(self._read(spark, f"{self.path}/whole", "w").where(F.col("_v") == whole)) if whole else rows
        return self._latest(rows.repartition(by) if by else rows)

    def write(self, changes: DataFrame, batch_id: int) -> None:
        """``changes`` has one row a key at most."""
        spark = changes.sparkSession
        changes.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/changes/v={batch_id}")
        if batch_id and batch_id % self.every == 0:
            now = self.before(spark, batch_id).withColumn("_v", F.lit(0)).unionByName(self.changes(spark).where(F.col("_v") == batch_id))
            self._latest(now).write.mode("overwrite").parquet(f"{self.path}/whole/w={batch_id}")

    def changes(self, spark: SparkSession) -> DataFrame:
        """All changes, with the number of their batch (_v)."""
        return self._read(spark, f"{self.path}/changes", "v")

    def state(self, spark: SparkSession) -> DataFrame:
        """The latest row of each key."""
        return self._latest(self.changes(spark))
