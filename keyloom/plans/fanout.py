"""How many radix bits a relation of n rows is dealt by."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession

# The least and the largest number of radix bits.
LEAST_BITS, MOST_BITS = 6, 14


def fanout_bits(rows: int) -> int:
    """Small inputs: the first fan-out above the row count. Else the bits whose number of levels is nearest to whole; the larger on ties."""
    if rows < 0:
        raise ValueError("a row count can't be negative")
    if rows < 1 << MOST_BITS:
        return max(LEAST_BITS, rows.bit_length())

    def waste(bits: int) -> float:
        levels = math.log(rows) / math.log(1 << bits)
        return abs(levels - round(levels))

    return min(range(MOST_BITS, LEAST_BITS - 1, -1), key=waste)


def shuffle_partitions(input_bytes: int, cores: int, target_bytes: int = 128 << 20) -> int:
    """Shuffle partitions that hold about ``target_bytes`` each, at least two for each core."""
    return max(2 * cores, math.ceil(input_bytes / target_bytes))


def apply_shuffle_partitions(spark: SparkSession, input_bytes: int) -> int:
    n = shuffle_partitions(input_bytes, spark.sparkContext.defaultParallelism)
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    return n
