"""Scans and sinks. Paths go to Spark's own readers, so any store that Spark reads will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """One ``word`` for each line of a text file."""
    return spark.read.text(path).withColumnRenamed("value", "word")


def write_partitions(df: DataFrame, path: str) -> None:
    """A folder for each value of ``part``."""
    df.write.mode("overwrite").partitionBy("part").parquet(path)
