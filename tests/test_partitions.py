import math

import pytest
from pyspark.sql import functions as F

from keyloom.functions.hashing import identity_hash, middle_bits, top_bits
from keyloom.operators import partitions
from keyloom.plans.fanout import fanout_bits, shuffle_partitions
from keyloom.sources.generators import descending_table, int_table, string_table
from keyloom.sources.tables import word_list, write_partitions
from keyloom.streaming.histogram import streaming_histogram

MIN = -(2**63)


def bands(spark):
    rows = [x for i in range(5) for x in ((i, i), (i + MIN, i), (i + MIN + 1024, i))]
    return spark.createDataFrame(rows, "key bigint, value bigint")


def test_two_bands_fall_into_two_partitions(spark):
    dealt = partitions.partition_rows(bands(spark), 1, identity_hash)
    assert sorted(map(tuple, partitions.histogram(dealt).collect())) == [(0, 5, 5), (1, 10, 10)]
    table = partitions.partition_table(dealt, ["value"])
    assert {p: n for p, n in table.groupBy("part").count().collect()} == {0: 5, 1: 10}


def test_first_row_of_a_key_wins(spark):
    df = partitions.partition_rows(spark.createDataFrame([(1, 5, 2), (1, 6, 1)], "key bigint, value int, seq int"), 3)
    assert [(r["key"], r["value"]) for r in partitions.partition_table(df, ["seq"]).collect()] == [(1, 6)]


def test_offsets_lay_partitions_end_to_end(spark):
    dealt = partitions.partition_rows(int_table(spark, 5000), 6)
    rows = sorted(map(tuple, partitions.offsets(dealt).collect()))
    assert rows[0][2] == 0 and all(a[1] + a[2] == b[2] for a, b in zip(rows, rows[1:])) and rows[-1][1] + rows[-1][2] == 5000
    assert partitions.offsets(dealt.limit(0)).count() == 0


def test_dealing_puts_one_radix_partition_in_each(spark):
    dealt = partitions.deal(partitions.partition_rows(int_table(spark, 1000), 3), 3)
    seen = dealt.select("part", F.spark_partition_id().alias("at")).distinct().collect()
    assert sorted((r["part"], r["at"]) for r in seen) == [(i, i) for i in range(8)]


def test_bits(spark):
    df = spark.createDataFrame([(-1,), (0,), (2**63 - 1,), (MIN,)], "h bigint")
    assert [r[0] for r in df.select(top_bits(F.col("h"), 1)).collect()] == [1, 0, 0, 1]
    assert [r[0] for r in df.select(top_bits(F.col("h"), 0)).collect()] == [0, 0, 0, 0]
    assert [r[0] for r in df.select(middle_bits(F.col("h"), 8, 3)).collect()] == [7, 0, 7, 0]
    with pytest.raises(ValueError):
        top_bits(F.col("h"), 65)


def test_fanout():
    table = {0: 6, 5: 6, 63: 6, 64: 7, 1024: 11, 10_000: 14, 16_383: 14, 16_384: 14, 50_000: 8, 65_536: 8, 2**18: 9, 10**6: 10, 10**7: 12, 10**9: 10}
    assert {n: fanout_bits(n) for n in table} == table
    assert all(6 <= fanout_bits(n) <= 14 for n in range(1, 200_000, 997))
    with pytest.raises(ValueError):
        fanout_bits(-1)
    assert shuffle_partitions(10 << 40, 4000) == 81_920 and shuffle_partitions(1, 8) == 16


@pytest.mark.parametrize("rows", [1, 2, 9, 10, 2500])
def test_generated_strings(spark, rows):
    words = spark.createDataFrame([(f"w{i:03}",) for i in range(60)], "word string")
    made = {r["key"]: r["value"] for r in string_table(words, rows).collect()}
    q = math.ceil(math.sqrt(rows))
    want = {f"w{i:03}": i for i in range(q)} | {f"w{n // q:03}-w{n % q:03}": n // q + n % q for n in range(rows - q)}
    assert made == want and len(made) == rows
    with pytest.raises(ValueError):
        string_table(words, 0)


def test_int_table_is_reproducible(spark):
    assert int_table(spark, 100).collect() == int_table(spark, 100).collect()
    assert descending_table(spark, 0).count() == 0


def test_sink_has_a_folder_for_each_partition(spark, tmp_path):
    dealt = partitions.partition_rows(int_table(spark, 200), 2)
    write_partitions(dealt, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.select("key", "value", "part").collect())) == sorted(map(tuple, dealt.select("key", "value", "part").collect()))


def test_streaming_histogram(spark, tmp_path):
    table = int_table(spark, 500)
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    query = streaming_histogram(stream, 2).writeStream.outputMode("complete").format("memory").queryName("hist").start()
    query.processAllAvailable()
    query.stop()
    want = partitions.histogram(partitions.partition_rows(table, 2)).select("part", "rows")
    assert sorted(map(tuple, spark.table("hist").collect())) == sorted(map(tuple, want.collect()))


def test_word_list_reads_lines(spark, tmp_path):
    (tmp_path / "words").write_text("b\na\n\nb\n")
    assert [r["word"] for r in word_list(spark, f"file://{tmp_path}/words").collect()] == ["b", "a", "", "b"]
