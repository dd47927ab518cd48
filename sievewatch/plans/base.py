"""Registry of runnable queries: each one next to the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewatch.functions.names import literal_array

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

AS_OF = "2002-01-01 00:00:00"
PART_ROWS = 500_000


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under a name, with its equivalent SQL when there is one."""
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


def measured_broadcasts(spark: SparkSession) -> None:
    """Broadcast by the sizes AQE measures, not by those of files: rows derived from a small file may be many times its size."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if limit != "-1" and spark.conf.get("spark.sql.adaptive.enabled") == "true":
        if spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None:
            spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", limit)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # The files hold timestamps without a zone; read them as UTC instants.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.parquet.inferTimestampNTZ.enabled", "false")
    measured_broadcasts(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """The rows of a table of one or a few file splits, dealt out so that every core derives its share."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, key)


def parts_by_rows(df: DataFrame) -> int:
    """Parts of at most about PART_ROWS rows. AQE joins parts up to a number of bytes, and compressed keys are so few bytes a row
    that a task would sort and group millions of them; parts dealt out by number stay as they are."""
    return max(1, ceil(df.count() / PART_ROWS))


def pick(values: tuple[str, ...], index: Column) -> Column:
    """``values[index]``; the SQL twin is ``sql_pick``."""
    return F.element_at(literal_array(values), (index + 1).cast("int"))


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_pick(values: tuple[str, ...], index: str) -> str:
    return f"({sql_list(values)})[(({index}) + 1)::BIGINT]"
