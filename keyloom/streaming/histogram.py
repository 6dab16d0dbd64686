"""Beyond the batch operators: the partition histogram and keyed last value over a stream of (key, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import HashExpr, fast_hash
from ..operators.partitions import partition_rows


def streaming_histogram(stream: DataFrame, bits: int, hash_expr: HashExpr = fast_hash) -> DataFrame:
    """Rows of each radix partition; state is one row a partition."""
    return partition_rows(stream, bits, hash_expr).groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
