from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyloom.functions.hashing import hash_tag
from keyloom.operators import aggregates, joins
from keyloom.sources.generators import string_table

SCHEMA = "key bigint, value bigint"


def merge_model(r, s, exact):
    """Which pairs of a key's rows the one-step merge keeps, by a table of cases: (key, value) lists, non-negative keys."""
    left, right = defaultdict(list), defaultdict(list)
    for rows, side in ((r, left), (s, right)):
        for k, v in sorted(rows):
            side[k].append(v)

    def kept(k, i, j):
        if exact and k == max(right) and len(right[k]) == 1:  # the other side ends at once
            return i == 0
        if exact and k == max(left):
            return j == 0
        return j == 0 or i == len(left[k]) - 1

    return sorted((k, a, b) for k in left.keys() & right.keys() for i, a in enumerate(left[k]) for j, b in enumerate(right[k]) if kept(k, i, j))


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def triples(df):
    return sorted((r["key"], r["r_value"], r["s_value"]) for r in df.collect())


@pytest.mark.parametrize("strategy", ["auto", "merge", "hash"])
def test_inner_join_with_duplicates_misses_and_nulls(spark, strategy):
    r = frame(spark, [(1, 10), (1, 11), (2, 20), (None, 1), (9, 90)])
    s = frame(spark, [(1, 100), (1, 101), (2, 200), (None, 2), (8, 80)])
    assert triples(joins.join(r, s, strategy)) == [(1, 10, 100), (1, 10, 101), (1, 11, 100), (1, 11, 101), (2, 20, 200)]


def test_strategies_plan_as_named(spark):
    r, s = frame(spark, [(i, i) for i in range(50)]), frame(spark, [(i, i) for i in range(50)])
    plan = lambda df: df._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan(joins.join(r, s, "merge"))
    assert "ShuffledHashJoin" in plan(joins.join(r, s, "hash"))


def test_key_types_must_be_equal(spark):
    with pytest.raises(TypeError):
        joins.join(frame(spark, [(1, 1)]), spark.createDataFrame([("1", 1)], "key string, value bigint"))


def test_all_joins_agree_on_unique_strings(spark):
    words = spark.createDataFrame([(f"w{i:03}",) for i in range(60)], "word string")
    r, s = string_table(words, 2500), string_table(words, 2500, shuffle_seed=3)
    total = 2 * sum(x["value"] for x in r.collect())
    every = [joins.join(r, s, k) for k in joins.STRATEGIES] + [joins.prehashed_join(hash_tag(r), hash_tag(s)), joins.lookup_join(r, s, ["value"], "last"), joins.lookup_join(r, s, ["value"], "first", "hash"), joins.staircase_join(r, s, ["value"])]
    for joined in every:
        assert tuple(joins.join_sum(joined).first()) == (str(total), 2500)


def test_lookup_rules_and_missing_keys(spark):
    r = frame(spark, [(1, 5), (1, 6), (3, 7)])
    s = spark.createDataFrame([(1, 100, 1), (1, 200, 2), (2, 1, 1)], "key bigint, value bigint, seq int")
    assert triples(joins.lookup_join(r, s, ["seq"], "last")) == [(1, 5, 200), (1, 6, 200), (3, 7, 0)]
    assert triples(joins.lookup_join(r, s, ["seq"], "first")) == [(1, 5, 100), (1, 6, 100), (3, 7, 0)]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 5), max_size=9), st.lists(st.integers(0, 5), max_size=9))
def test_staircase_matches_the_merge(spark, a, b):
    r, s = [(k, 10 + i) for i, k in enumerate(a)], [(k, 100 + i) for i, k in enumerate(b)]
    assert triples(joins.staircase_join(frame(spark, r), frame(spark, s), ["value"])) == merge_model(r, s, False)
    assert triples(joins.staircase_join(frame(spark, r), frame(spark, s), ["value"], exact_ends=True)) == merge_model(r, s, True)


def test_sums_wrap(spark):
    big = frame(spark, [(1, 2**63 - 1)] * 3)
    assert aggregates.wrapping_sum(big).first()[0] == str(3 * (2**63 - 1) % 2**64)
    assert aggregates.wrapping_sum(frame(spark, [(1, -5)])).first()[0] == str(2**64 - 5)
    assert aggregates.wrapping_sum(big.limit(0)).first()[0] == "0"
    assert tuple(joins.join_sum(joins.join(big, big)).first()) == (str(9 * 2 * (2**63 - 1) % 2**64), 9)


def test_first_and_last_values(spark):
    df = spark.createDataFrame([(1, 5, 2), (1, 6, 1), (2, 7, 1)], "key int, value int, seq int")
    assert sorted(map(tuple, aggregates.last_value(df, ["seq"]).collect())) == [(1, 5), (2, 7)]
    assert sorted(map(tuple, aggregates.first_value(df, ["seq", "value"]).collect())) == [(1, 6), (2, 7)]
    assert tuple(aggregates.distinct_keys(df).first()) == (2, 3)
    assert aggregates.last_value(df.filter(F.lit(False)), ["seq"]).count() == 0
