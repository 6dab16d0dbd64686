"""The registered queries over the driver's tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import hash_tag as tag
from ..functions.hashing import identity_hash, middle_bits, portable_hash, top_bits
from ..operators import aggregates, joins, partitions, sorts
from ..schema import key_value
from ..sources import generators
from ..sources.tables import table
from .fanout import fanout_bits

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

HASH_15 = portable_hash(15)
SQL_MD5 = "md5(CAST({} AS VARCHAR))"
SQL_HEX = "CAST(('0x' || left(md5(CAST({} AS VARCHAR)), {})) AS BIGINT)"


def register(sql: str) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        ORACLES[query.__name__] = sql
        return query

    return add


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_value(table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_value(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


def _line_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with columns that put the lines of an order in sequence; equal sequences have equal values."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(F.col("l_orderkey").alias("key"), F.col("l_partkey").alias("value"), "l_linenumber", "l_partkey")


LINE_ORDER = ["l_linenumber", "l_partkey"]
_LOOKUP = """
WITH s AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber {0}, l_partkey {0}) AS i FROM lineitem)
SELECT CAST(sum(o_custkey + coalesce(l_partkey, 0)) AS VARCHAR) AS total, count(*) AS pairs
FROM orders LEFT JOIN (SELECT * FROM s WHERE i = 1) ON l_orderkey = o_orderkey"""
_JOIN_SUM = "SELECT CAST(sum(l_partkey + o_custkey) AS VARCHAR) AS total, count(*) AS pairs FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


@register(_JOIN_SUM)
def join_merge(spark, sf_dir):
    return joins.join_sum(joins.join(_lines(spark, sf_dir), _orders(spark, sf_dir), "merge"))


@register(_JOIN_SUM)
def join_hash(spark, sf_dir):
    return joins.join_sum(joins.join(_lines(spark, sf_dir), _orders(spark, sf_dir), "hash"))


@register(_JOIN_SUM)
def join_prehashed(spark, sf_dir):
    return joins.join_sum(joins.prehashed_join(tag(_lines(spark, sf_dir)), tag(_orders(spark, sf_dir))))


@register("SELECT l_orderkey AS key, l_partkey AS r_value, o_custkey AS s_value FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def join_rows(spark, sf_dir):
    return joins.join(_lines(spark, sf_dir), _orders(spark, sf_dir))


@register(_LOOKUP.format("DESC"))
def join_lookup_last(spark, sf_dir):
    return joins.join_sum(joins.lookup_join(_orders(spark, sf_dir), _line_sequence(spark, sf_dir), LINE_ORDER, "last"))


@register(_LOOKUP.format("ASC"))
def join_lookup_first(spark, sf_dir):
    return joins.join_sum(joins.lookup_join(_orders(spark, sf_dir), _line_sequence(spark, sf_dir), LINE_ORDER, "first", "hash"))


_STAIRCASE = """
WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS m FROM events WHERE event_type = 'click'),
s AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE event_type = 'view'),
e AS (SELECT (SELECT max(user_id) FROM r) AS last_r, (SELECT max(user_id) FROM s) AS last_s)
SELECT r.user_id AS key, r.event_id AS r_value, s.event_id AS s_value FROM r JOIN s USING (user_id), e WHERE """


def _events(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return key_value(table(spark, sf_dir, "events").filter(F.col("event_type") == kind), "user_id", "event_id")


@register(_STAIRCASE + "s.i = 1 OR r.i = m")
def join_staircase(spark, sf_dir):
    return joins.staircase_join(_events(spark, sf_dir, "click"), _events(spark, sf_dir, "view"), ["value"])


@register(_STAIRCASE + "CASE WHEN r.user_id = last_s AND n = 1 THEN r.i = 1 WHEN r.user_id = last_r THEN s.i = 1 ELSE s.i = 1 OR r.i = m END")
def join_staircase_exact(spark, sf_dir):
    return joins.staircase_join(_events(spark, sf_dir, "click"), _events(spark, sf_dir, "view"), ["value"], exact_ends=True)


@register("SELECT o_orderkey AS key, o_custkey AS value FROM orders")
def scan_key_value(spark, sf_dir):
    return _orders(spark, sf_dir)


@register(f"SELECT {SQL_HEX.format('o_orderkey', 15)} AS hash, o_orderkey AS key, o_custkey AS value FROM orders")
def hash_tag(spark, sf_dir):
    return tag(_orders(spark, sf_dir), HASH_15)


@register(f"SELECT {SQL_HEX.format('o_orderkey', 3)} // 4 AS part, count(*) AS rows, count(DISTINCT o_orderkey) AS keys FROM orders GROUP BY 1")
def radix_partition_hist(spark, sf_dir):
    return partitions.histogram(partitions.partition_rows(_orders(spark, sf_dir), 10, portable_hash(3), width=12))


@register(f"SELECT {SQL_HEX.format('o_orderkey', 5)} % 1024 AS part, count(*) AS rows FROM orders GROUP BY 1")
def radix_partition_level2(spark, sf_dir):
    part = middle_bits(portable_hash(5)(F.col("key")), 10, 10)
    return _orders(spark, sf_dir).groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"))


@register("SELECT o_custkey >> 7 AS part, count(*) AS rows, count(DISTINCT o_custkey) AS keys FROM orders GROUP BY 1")
def radix_partition_identity(spark, sf_dir):
    by_customer = key_value(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey")
    return partitions.histogram(partitions.partition_rows(by_customer, 57, identity_hash))


@register("SELECT CAST(CASE WHEN o_custkey < 700 THEN 1 ELSE 0 END AS BIGINT) AS part, count(*) AS rows FROM orders GROUP BY 1")
def int_partition_hist(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select((F.col("o_custkey") - 700).alias("key"))
    return keys.groupBy(top_bits(F.col("key"), 1).alias("part")).agg(F.count(F.lit(1)).alias("rows"))


@register(
    f"""WITH h AS (SELECT {SQL_HEX.format('o_orderkey', 3)} // 4 AS part, count(*) AS rows FROM orders GROUP BY 1)
SELECT part, rows, CAST(coalesce(sum(rows) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM h"""
)
def partition_offsets(spark, sf_dir):
    return partitions.offsets(partitions.partition_rows(_orders(spark, sf_dir), 10, portable_hash(3), width=12))


@register(
    f"""WITH s AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS i FROM lineitem)
SELECT {SQL_HEX.format('l_orderkey', 3)} // 4 AS part, l_orderkey AS key, l_partkey AS value FROM s WHERE i = 1"""
)
def partitioned_table(spark, sf_dir):
    dealt = partitions.partition_rows(_line_sequence(spark, sf_dir), 10, portable_hash(3), width=12)
    return partitions.partition_table(dealt, LINE_ORDER)


_PICK = "SELECT l_orderkey AS key, l_partkey AS value FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber {0}, l_partkey {0}) AS i FROM lineitem) WHERE i = 1"


@register(_PICK.format("DESC"))
def last_value_by_key(spark, sf_dir):
    return aggregates.last_value(_line_sequence(spark, sf_dir), LINE_ORDER)


@register(_PICK.format("ASC"))
def first_value_by_key(spark, sf_dir):
    return aggregates.first_value(_line_sequence(spark, sf_dir), LINE_ORDER)


@register("SELECT count(DISTINCT l_orderkey) AS keys, count(*) AS rows FROM lineitem")
def distinct_keys(spark, sf_dir):
    return aggregates.distinct_keys(_lines(spark, sf_dir))


@register("WITH t AS (SELECT sum(CAST(9223372036854775807 - o_orderkey AS HUGEINT) * CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE -1 END) AS n FROM orders) SELECT CAST(((n % 18446744073709551616) + 18446744073709551616) % 18446744073709551616 AS VARCHAR) AS total FROM t")
def u64_sum(spark, sf_dir):
    huge = (F.lit(2**63 - 1) - F.col("o_orderkey")) * F.when(F.col("o_custkey") % 2 == 0, 1).otherwise(-1)
    return aggregates.wrapping_sum(table(spark, sf_dir, "orders").select(huge.alias("value")))


_RANKED = "SELECT {hash} AS hash, o_orderkey AS key, o_custkey AS value, row_number() OVER (ORDER BY {order}) - 1 AS pos FROM orders"
_H15 = SQL_HEX.format("o_orderkey", 15)


@register(_RANKED.format(hash=_H15, order=f"{_H15}, o_orderkey, o_custkey"))
def hash_sort(spark, sf_dir):
    return sorts.hash_rank(tag(_orders(spark, sf_dir), HASH_15), F.col("value"))


@register(_RANKED.format(hash=_H15, order=f"{_H15}, o_orderkey, o_custkey"))
def prehashed_sort(spark, sf_dir):
    carried = tag(_orders(spark, sf_dir), HASH_15).select("hash", "key", "value")
    return sorts.hash_rank(carried, F.col("value"))


@register(_RANKED.format(hash=_H15, order=f"{_H15} % 64, {_H15}, o_orderkey, o_custkey"))
def masked_hash_sort(spark, sf_dir):
    return sorts.hash_rank(tag(_orders(spark, sf_dir), HASH_15), F.col("value"), mask=63)


@register(f"SELECT {_H15} AS hash, o_orderkey AS key, o_custkey AS value FROM orders")
def hash_sort_single(spark, sf_dir):
    return sorts.hash_sort_single(_orders(spark, sf_dir), HASH_15)


@register("SELECT c_custkey - 700 AS key, c_nationkey AS value, row_number() OVER (ORDER BY CASE WHEN c_custkey < 700 THEN 1 ELSE 0 END, c_custkey, c_nationkey) - 1 AS pos FROM customer")
def uint_sort(spark, sf_dir):
    keys = key_value(table(spark, sf_dir, "customer"), F.col("c_custkey") - 700, "c_nationkey")
    return sorts.uint_rank(keys, F.col("value"))


@register(
    """WITH w AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS i FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]+')) AS word FROM documents) ORDER BY word LIMIT 100)
SELECT word AS key, i AS value FROM w
UNION ALL SELECT a.word || '-' || b.word, a.i + b.i FROM range(9900) t(n) JOIN w a ON a.i = n // 100 JOIN w b ON b.i = n % 100"""
)
def gen_strings(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), 0)).alias("word"))
    return generators.string_table(words, 10_000)


@register(f"SELECT {SQL_HEX.format('n', 15)} AS key, n AS value FROM range(1000) t(n)")
def gen_ints(spark, sf_dir):
    return generators.int_table(spark, 1000, HASH_15)


@register("SELECT o_orderkey AS key, o_custkey AS value FROM orders")
def comparison_sort(spark, sf_dir):
    return sorts.comparison_sort(_orders(spark, sf_dir))


@register("SELECT CAST(1000 - n AS INTEGER) AS key, CAST(1000 - n AS INTEGER) AS value FROM range(1000) t(n)")
def gen_descending(spark, sf_dir):
    return generators.descending_table(spark, 1000)


@register("SELECT n AS hash, n AS key, n AS value FROM range(512) t(n) UNION ALL SELECT n - 9223372036854775807 - 1, n, n FROM range(512) t(n)")
def gen_two_band(spark, sf_dir):
    return generators.two_band_table(spark, 1024)


@register("SELECT n, CAST(bits AS BIGINT) AS bits FROM (VALUES (5, 6), (63, 6), (64, 7), (1024, 11), (10000, 14), (16383, 14), (16384, 14), (50000, 8), (65536, 8), (262144, 9), (500000, 9), (1000000, 10), (5000000, 11), (8388608, 12), (10000000, 12), (50000000, 13), (100000000, 13), (1000000000, 10)) t(n, bits)")
def fanout_table(spark, sf_dir):
    sizes = [5, 63, 64, 1024, 10_000, 16_383, 16_384, 50_000, 65_536, 262_144, 500_000, 1_000_000, 5_000_000, 8_388_608, 10_000_000, 50_000_000, 100_000_000, 1_000_000_000]
    return spark.createDataFrame([(n, fanout_bits(n)) for n in sizes], "n int, bits bigint")
