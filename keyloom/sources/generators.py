"""Synthetic key/value tables, generated on the executors."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import MIN_LONG, HashExpr, fast_hash


def string_table(words: DataFrame, rows: int, shuffle_seed: int | None = None) -> DataFrame:
    """``rows`` unique string keys from distinct words: q words with their index, then "a-b" with the sum of indices.

    q = ceil(sqrt(rows)); pairs come in row-major order. Words are taken in ascending order.
    """
    if rows < 1:
        raise ValueError("at least one row is made")
    spark, q = words.sparkSession, math.isqrt(rows - 1) + 1
    chosen = words.select("word").distinct().orderBy("word").limit(q)  # q = sqrt(rows) rows
    indexed = chosen.withColumn("i", (F.row_number().over(Window.orderBy("word")) - 1).cast("bigint"))
    base = indexed.select(F.col("word").alias("key"), F.col("i").alias("value"))
    at = spark.range(rows - q).select((F.col("id") / q).cast("bigint").alias("i"), (F.col("id") % q).alias("j"))
    second = indexed.select(F.col("word").alias("second"), F.col("i").alias("j"))
    pairs = at.join(indexed, "i").join(second, "j").select(F.concat_ws("-", "word", "second").alias("key"), (F.col("i") + F.col("j")).alias("value"))
    made = base.unionByName(pairs)
    return made if shuffle_seed is None else made.orderBy(F.rand(shuffle_seed))


def int_table(spark: SparkSession, rows: int, hash_expr: HashExpr = fast_hash) -> DataFrame:
    """Uniform integer keys that any run reproduces: the hash of the row number, with the row number as value."""
    return spark.range(rows).select(hash_expr(F.col("id")).alias("key"), F.col("id").alias("value"))


def descending_table(spark: SparkSession, rows: int) -> DataFrame:
    return spark.range(rows, 0, -1).select(F.col("id").cast("int").alias("key"), F.col("id").cast("int").alias("value"))


def two_band_table(spark: SparkSession, rows: int) -> DataFrame:
    """rows/2 keys i and as many keys 2**63 + i."""
    half = spark.range(rows // 2)
    low = half.select(F.col("id").alias("hash"), F.col("id").alias("key"), F.col("id").alias("value"))
    return half.select((F.col("id") + F.lit(MIN_LONG)).alias("hash"), F.col("id").alias("key"), F.col("id").alias("value")).unionByName(low)
