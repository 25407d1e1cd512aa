"""Stored tables that are changed by key: only the partitions that a change touches are written again.

Rows lie in hash buckets of their key (column ``bucket``). A change reads the buckets of its keys, and Spark's
dynamic overwrite stages their new rows and swaps the partitions when the job commits; a job that fails, or
is tried again, leaves the table as it was or as it should be. Facts are appended by run: a run that is repeated
replaces its own rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.report import patch, upsert
from .io import bucketed, fact_rows

BUCKETS = 64


def _write(rows: DataFrame, path: str, by: str, sort: list[str]) -> None:
    rows.repartition(by).sortWithinPartitions(by, *sort).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def create(rows: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """A stored table of ``rows``, in ``buckets`` partitions by its keys."""
    _write(bucketed(rows, keys, buckets), path, "bucket", keys)


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def _touched(spark: SparkSession, path: str, changes: DataFrame) -> DataFrame:
    few = changes.select("bucket").distinct()  # as many integers as the table has buckets at most
    return spark.read.parquet(path).join(F.broadcast(few), "bucket", "left_semi").drop("bucket")


def upsert_stored(spark: SparkSession, path: str, source: DataFrame, keys: list[str], order: str, buckets: int = BUCKETS) -> None:
    """Rows of ``source`` inserted or updated by key; the last by ``order`` wins, columns that it lacks stay."""
    rows = bucketed(source, keys, buckets)
    _write(bucketed(upsert(_touched(spark, path, rows), source, keys, order), keys, buckets), path, "bucket", keys)


def patch_stored(spark: SparkSession, path: str, changes: DataFrame, key: str, buckets: int = BUCKETS) -> None:
    """Given columns set where the key is equal; null changes and unknown keys change nothing."""
    rows = bucketed(changes, [key], buckets)
    _write(bucketed(patch(_touched(spark, path, rows), changes, key), [key], buckets), path, "bucket", [key])


def append_stored(rows: DataFrame, path: str, run: str, stamps: dict[str, str] | None = None) -> None:
    """Facts as they are stored (``fact_rows``), stamped with constants, as the partition ``run`` of a log."""
    stamped = fact_rows(rows).withColumns({c: F.lit(v) for c, v in (stamps or {}).items()})
    stamped.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)
