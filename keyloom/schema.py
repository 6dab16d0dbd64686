"""Relations are DataFrames with a ``key`` column and a payload column; there is no other schema system."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_value(df: DataFrame, key: str | Column, value: str | Column) -> DataFrame:
    """Project any table onto (key, value); Catalyst prunes the scan to the columns used."""
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(as_column(key).alias("key"), as_column(value).alias("value"))


def require_same_key_type(left: DataFrame, right: DataFrame, key: str = "key") -> None:
    """Joins never coerce: differing key types raise instead of being cast."""
    a, b = left.schema[key].dataType, right.schema[key].dataType
    if a != b:
        raise TypeError(f"join keys differ in type: {a.simpleString()} and {b.simpleString()}")


def require_integral(df: DataFrame, key: str = "key") -> None:
    kind = df.schema[key].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"an integer key is needed, not {kind}")
