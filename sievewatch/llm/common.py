"""Shared helpers: tables written between the steps of a job, and null-safe columns."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewatch.session import ensure_checkpoint_dir


def work_path(spark: SparkSession, tag: str) -> str:
    """A fresh folder below the shared checkpoint folder; every executor and the driver can reach it."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{tag}-{uuid.uuid4().hex}"


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage like ``checkpoint()`` does and survives lost executors, but stays compressed,
    prunes columns and tells Catalyst its size, so that joins with it are planned by measured bytes.
    """
    spark = df.sparkSession
    path = work_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one job, dropped together once a table written later stands in for them.

    What reads them must have been written before: nothing lazy may depend on a dropped table.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root = spark, work_path(spark, tag)

    def stage(self, df: DataFrame, tag: str) -> DataFrame:
        path = f"{self.root}/{tag}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def text_of(column: str = "text") -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def worker_store(name: str) -> dict:
    """A dict that lives as long as the Python worker, for tables that several tasks of one worker use.

    Functions travel by value, so a module's own globals would last for one task only.
    """
    return sys.modules.setdefault(f"_llm_store_{name}", types.ModuleType(name)).__dict__.setdefault("held", {})


def text_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches, as rows of text are large; a session that has set its own size keeps it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def lean(run: Callable) -> Callable:
    """A function over batches that gives memory back when it ends: workers are reused, and keep what they once held."""

    def wrapped(batches: Iterable) -> Iterator:
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
                if trim is not None:
                    trim(0)

    return wrapped
