import random

import pytest
from pyspark.sql import functions as F

from keyloom.functions.hashing import identity_hash, top_bits, unsigned_order
from keyloom.operators import sorts
from keyloom.sources.generators import descending_table, int_table, two_band_table

MASK = 2**64 - 1


def wrap(x):
    return x - 2**64 if x >= 2**63 else x


def keys(df, column="key"):
    return [r[column] for r in df.select(column).collect()]


@pytest.mark.parametrize("rows", [0, 1, 5, 12345])
def test_descending_rows_come_out_ascending(spark, rows):
    out = sorts.hash_sort(descending_table(spark, rows), identity_hash).collect()
    assert [(r["hash"], r["key"], r["value"]) for r in out] == [(i, i, i) for i in range(1, rows + 1)]


def test_large_descending(spark):
    assert keys(sorts.hash_sort(descending_table(spark, 2**18), identity_hash)) == list(range(1, 2**18 + 1))


def test_two_bands_sort_as_unsigned(spark):
    out = keys(sorts.prehashed_sort(two_band_table(spark, 1024)), "hash")
    assert [x & MASK for x in out] == sorted(x & MASK for x in out)
    assert out[0] == 0 and out[512] == -(2**63)


@pytest.mark.parametrize("rows", [0, 1, 2**16])
def test_random_ints_match_python(spark, rows):
    df = int_table(spark, rows)
    out = [(r["key"], r["value"]) for r in sorts.uint_sort(df).collect()]
    assert out == sorted(((r["key"], r["value"]) for r in df.collect()), key=lambda r: r[0] & MASK)


def test_unsigned_extremes(spark):
    df = spark.createDataFrame([(wrap(k), i) for i, k in enumerate([2**64 - 1, 2**63, 2**63 - 1, 1, 0])], "key bigint, value int")
    assert [x & MASK for x in keys(sorts.uint_sort(df))] == [0, 1, 2**63 - 1, 2**63, 2**64 - 1]
    ranked = {r["key"] & MASK: r["pos"] for r in sorts.uint_rank(df, F.col("value")).collect()}
    assert ranked == {0: 0, 1: 1, 2**63 - 1: 2, 2**63: 3, 2**64 - 1: 4}


def test_integer_sort_refuses_other_types(spark):
    with pytest.raises(TypeError):
        sorts.uint_sort(spark.createDataFrame([("a", 1)], "key string, value int"))


def test_single_partition_variant(spark):
    out = sorts.hash_sort_single(descending_table(spark, 100), identity_hash)
    assert out.rdd.getNumPartitions() == 1 and keys(out) == list(range(1, 101))


def test_ranks_are_a_permutation_with_payload(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(-50, 50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "key bigint, value bigint")
    ranked = sorts.uint_rank(df, F.col("value")).collect()
    assert sorted(r["pos"] for r in ranked) == list(range(3000))
    by_pos = [(r["key"], r["value"]) for r in sorted(ranked, key=lambda r: r["pos"])]
    assert by_pos == sorted(rows, key=lambda r: (r[0] & MASK, r[1]))


def test_all_keys_equal(spark):
    df = spark.createDataFrame([(7, i) for i in range(100)], "key bigint, value bigint")
    assert sorted(r["pos"] for r in sorts.uint_rank(df, F.col("value")).collect()) == list(range(100))
    assert sorts.uint_rank(df.limit(0), F.col("value")).count() == 0


def test_string_hash_sort_keeps_rows(spark):
    df = spark.createDataFrame([(f"w{i % 37}", i) for i in range(500)], "key string, value bigint")
    out = sorts.hash_sort(df).collect()
    assert sorted((r["key"], r["value"]) for r in out) == sorted((f"w{i % 37}", i) for i in range(500))
    h = [(r["hash"] & MASK, r["key"]) for r in out]
    assert h == sorted(h)
    digits = [r[0] for r in sorts.hash_sort(df).select(top_bits(F.col("hash"), 5)).collect()]
    assert digits == sorted(digits) and max(digits) < 32
    assert unsigned_order(F.col("key")) is not None
