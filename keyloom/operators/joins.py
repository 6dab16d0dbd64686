"""Equi-joins of (key, value) relations.

``join`` is the ANSI inner join; the strategy hint only picks the physical plan.
``lookup_join`` keeps one build row for each key by an explicit rule and treats a
missing key as 0. ``staircase_join`` is the opt-in merge whose duplicate runs give
m + n - 1 pairs. Null keys never match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import u64_sum
from ..schema import require_same_key_type
from ..storage import number_rows
from .aggregates import first_value, last_value

STRATEGIES = {"auto": None, "merge": "merge", "hash": "shuffle_hash"}


def join(r: DataFrame, s: DataFrame, strategy: str = "auto") -> DataFrame:
    """(key, r_value, s_value) for each pair of rows with equal keys. Broadcasting is left to Spark's own check of sizes."""
    require_same_key_type(r, s)
    hint = STRATEGIES[strategy]
    left = r.select("key", F.col("value").alias("r_value"))
    right = s.select("key", F.col("value").alias("s_value"))
    return left.join(right.hint(hint) if hint else right, "key")


def prehashed_join(r: DataFrame, s: DataFrame) -> DataFrame:
    """Joins (hash, key, value) relations by the hashes they carry, which are trusted, and then by key."""
    require_same_key_type(r, s)
    left = r.select("hash", "key", F.col("value").alias("r_value"))
    right = s.select("hash", "key", F.col("value").alias("s_value"))
    return left.join(right.hint("merge"), ["hash", "key"]).select("key", "r_value", "s_value")


def lookup_join(r: DataFrame, s: DataFrame, order: list[str], wins: str = "last", strategy: str = "auto") -> DataFrame:
    """Every row of r with the value that s has for its key, else 0.

    ``order`` names columns of s that put its rows in sequence; the last or the first
    row of a key wins. The build side is reduced map-side before it is shuffled.
    """
    require_same_key_type(r, s)
    pick = {"last": last_value, "first": first_value}[wins]
    hint = STRATEGIES[strategy]
    right = pick(s, order).withColumnRenamed("value", "s_value")
    left = r.select("key", F.col("value").alias("r_value"))
    return left.join(right.hint(hint) if hint else right, "key", "left").select("key", "r_value", F.coalesce("s_value", F.lit(0)).alias("s_value"))


def join_sum(joined: DataFrame) -> DataFrame:
    """The global sum of both values, modulo 2**64 (as text), and the number of pairs."""
    total = u64_sum(F.col("r_value").cast("decimal(20,0)") + F.col("s_value").cast("decimal(20,0)"))
    return joined.agg(F.coalesce(total, F.lit(0)).cast("decimal(20,0)").cast("string").alias("total"), F.count(F.lit(1)).alias("pairs"))


def staircase_join(r: DataFrame, s: DataFrame, order: list[str | Column], exact_ends: bool = False) -> DataFrame:
    """The merge that advances one side at a time: (r_1..r_m, s_1), then (r_m, s_2..s_n) for each key.

    ``exact_ends`` also drops the pairs that the merge loses when a side ends: keys are
    then taken in their own order, so they must be non-negative integers.
    Both halves are equi-joins with one row a key on one side, so a hot key costs m + n. Rows are
    numbered by (key, order) over all tasks, and a key's first and last rows come from aggregates.
    """
    require_same_key_type(r, s)

    def numbered(df: DataFrame, side: str) -> tuple[DataFrame, DataFrame]:
        """Rows (key, x_value, x_row), and for each key (first row, last row, first value, last value)."""
        rows = number_rows(df.filter(F.col("key").isNotNull()), ["key", *order], "_row").select("key", F.col("value").alias(f"{side}_value"), F.col("_row").alias(f"{side}_row"))
        value, row = f"{side}_value", f"{side}_row"
        ends = rows.groupBy("key").agg(F.min(row).alias(f"{side}_first"), F.max(row).alias(f"{side}_last"), F.min_by(value, row).alias(f"{side}_head"), F.max_by(value, row).alias(f"{side}_tail"))
        return rows, ends

    (left, left_ends), (right, right_ends) = numbered(r, "r"), numbered(s, "s")
    along_r = left.join(right_ends, "key").join(left_ends, "key") if exact_ends else left.join(right_ends, "key")
    along_s = right.join(left_ends, "key").join(right_ends.select("key", "s_first"), "key").filter("s_row > s_first")
    if exact_ends:
        ends = r.agg(F.max("key").alias("last_r")).join(s.agg(F.max("key").alias("last_s")), how="full")  # one row
        ends = F.broadcast(ends)
        along_r = along_r.join(ends).filter("NOT (key = last_s AND s_first = s_last) OR r_row = r_first")
        along_s = along_s.join(ends).filter("key <> last_r")
    along_r = along_r.select("key", "r_value", F.col("s_head").alias("s_value"))
    return along_r.unionByName(along_s.select("key", F.col("r_tail").alias("r_value"), "s_value"))
