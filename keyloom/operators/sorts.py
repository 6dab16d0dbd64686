"""Hash-ordered and unsigned-integer sorts. Output is in order; ``ranked`` forms carry the position as a column.

Both are a range exchange with sampled bounds and a sort in each partition, so the fan-out follows
the rows. The position is the place in the partition plus the rows of those before it, and runs of
equal rows may lie in several partitions: no digit, key or window gathers them in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import HashExpr, fast_hash, hash_tag, unsigned_order
from ..schema import require_integral
from ..storage import number_rows


def hash_sort(df: DataFrame, hash_expr: HashExpr = fast_hash) -> DataFrame:
    """(hash, key, value) by unsigned hash, then key: a range exchange and a sort in each partition."""
    return prehashed_sort(hash_tag(df, hash_expr))


def prehashed_sort(df: DataFrame) -> DataFrame:
    """Sorts (hash, key, value) by the hash that it carries."""
    return df.orderBy(unsigned_order(F.col("hash")), "key")


def hash_sort_single(df: DataFrame, hash_expr: HashExpr = fast_hash) -> DataFrame:
    """The one-thread variant: one partition, for relations known to be small."""
    return hash_tag(df, hash_expr).coalesce(1).sortWithinPartitions(unsigned_order(F.col("hash")), "key")


def uint_sort(df: DataFrame) -> DataFrame:
    """(key, value) by unsigned key: negative BIGINTs stand for the upper half and come last."""
    require_integral(df)
    return df.orderBy(unsigned_order(F.col("key")))


def comparison_sort(df: DataFrame) -> DataFrame:
    """The baseline beside the radix variants: Spark's own sort by key, whatever its type."""
    return df.orderBy("key")


def hash_rank(df: DataFrame, *ties: Column, mask: int | None = None) -> DataFrame:
    """(hash, key, value, pos) with pos from 0 in (hash, key, ties) order; ``mask`` puts the hash's bits under it first."""
    lead = [] if mask is None else [F.col("hash").bitwiseAND(F.lit(mask))]
    return number_rows(df, [*lead, unsigned_order(F.col("hash")), F.col("key"), *ties], "pos")


def uint_rank(df: DataFrame, *ties: Column) -> DataFrame:
    """(key, value, pos) with pos from 0 in unsigned order."""
    require_integral(df)
    return number_rows(df, [unsigned_order(F.col("key")), *ties], "pos")
