"""Reading the input tables: one Parquet file or folder per table under a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` below ``folder``; any path that Spark's readers can open."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(frame: DataFrame) -> DataFrame:
    """``frame`` over all cores if it is read from fewer files than there are: a small file of one row group is one task, and work on its texts would use one core."""
    wanted = frame.sparkSession.sparkContext.defaultParallelism
    return frame if len(frame.inputFiles()) >= wanted else frame.repartition(wanted)
