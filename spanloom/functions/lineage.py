"""Lineage cuts for iterative plans."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a session within one process may leave that unset (tests): it gets a folder made here."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        wanted = spark.conf.get("spark.checkpoint.dir", None)
        if not wanted:
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            wanted = tempfile.mkdtemp(prefix="spanloom-")
            atexit.register(shutil.rmtree, wanted, ignore_errors=True)
        context.setCheckpointDir(wanted)
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in that folder."""
    folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The rows as Parquet in the same folder, read again: for tables that later steps join or add to in many ways."""
    path = f"{folder(df.sparkSession)}/spanloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
