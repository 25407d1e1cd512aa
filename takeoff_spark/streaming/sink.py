"""A sink that takes each batch of a stream once, however often it is tried."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def batch_writer(path: str):
    """For foreachBatch: batch i becomes the partition batch=i of the table; trying it again replaces what it wrote."""

    def write(df: DataFrame, batch: int) -> None:
        rows = df.withColumn("batch", F.lit(batch).cast("long"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return write


def append_once(rows: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Start a stream that writes what is there into the table at ``path``."""
    return rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch_writer(path)).start()


def read_batches(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table's rows, without their batch; empty where no batch has had rows."""
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).drop("batch")
