"""Keyed first and last values, distinct keys and wrap-around sums; all combine map-side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import u64_sum


def _sequence(order: list[str]):
    return F.struct(*order) if len(order) > 1 else F.col(order[0])


def last_value(df: DataFrame, order: list[str]) -> DataFrame:
    """(key, value) of each key's last row in ``order``, as repeated assignment to a map leaves it."""
    return df.groupBy("key").agg(F.max_by("value", _sequence(order)).alias("value"))


def first_value(df: DataFrame, order: list[str]) -> DataFrame:
    """(key, value) of each key's first row in ``order``, as insertion into a map keeps it."""
    return df.groupBy("key").agg(F.min_by("value", _sequence(order)).alias("value"))


def distinct_keys(df: DataFrame) -> DataFrame:
    return df.agg(F.countDistinct("key").alias("keys"), F.count(F.lit(1)).alias("rows"))


def wrapping_sum(df: DataFrame) -> DataFrame:
    """The values' sum modulo 2**64 as text; 0 for no rows."""
    return df.agg(F.coalesce(u64_sum(F.col("value")), F.lit(0)).cast("decimal(20,0)").cast("string").alias("total"))
