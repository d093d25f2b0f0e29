"""Parquet tables of a folder, dealt over the cores where their files alone wouldn't be."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables of up to so many bytes are dealt anew when they have few files; what that shuffles never exceeds this.
SPREAD_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small table in as many partitions as there are cores. One row group is read by one task, however
    costly its rows are; tables beyond SPREAD_BYTES, or with files for every second core, stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df if size > SPREAD_BYTES or 2 * len(df.inputFiles()) > cores else df.repartition(cores)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))
