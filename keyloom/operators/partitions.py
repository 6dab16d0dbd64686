"""Radix partitioning by the top bits of a hash, with histograms, offsets and keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import HashExpr, fast_hash, top_bits


def partition_rows(df: DataFrame, bits: int, hash_expr: HashExpr = fast_hash, width: int = 64) -> DataFrame:
    """Adds ``part``. The physical layout is the caller's: ``deal`` shuffles by it, an aggregate doesn't need to."""
    return df.withColumn("part", top_bits(hash_expr(F.col("key")), bits, width))


def deal(df: DataFrame, bits: int) -> DataFrame:
    """One Spark partition for each radix partition."""
    return df.repartitionById(1 << bits, F.col("part").cast("int"))


def histogram(df: DataFrame) -> DataFrame:
    """Rows and distinct keys of each partition that has any."""
    return df.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("key").alias("keys"))


def offsets(df: DataFrame) -> DataFrame:
    """Rows of each partition and the position of its first row when partitions are laid end to end.

    The running sum reads one row for each partition (2**bits at most), not the data.
    """
    sizes = df.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0)).cast("bigint"))


def partition_table(df: DataFrame, order: list[str]) -> DataFrame:
    """(part, key, value): a keyed table for each partition; the first row of a key in ``order`` wins."""
    by = F.struct(*order) if len(order) > 1 else F.col(order[0])
    return df.groupBy("part", "key").agg(F.min_by("value", by).alias("value"))
