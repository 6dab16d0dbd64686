"""Sharding by a keyed Feistel permutation of global row numbers.

Rows are numbered in the order (doc_id, text_crc32, size), nulls first. The permutation maps
0..n-1 onto itself: a Feistel network over the least power of two that holds n, walked again
while it lands at n or above. Row number p becomes place q = permute(p); its shard is
q mod shards and its slot q div shards, so shard sizes differ by one at most, slots have no
gaps, and the place of any row is computed from its number, n and the key alone.

Defined cases: null text has no bytes (size 1, crc32 null); null doc_ids come first; rows equal
in all three columns are interchangeable, so the result is the same on every run; an empty
table gives no rows. Columns beside doc_id and text are ignored.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, number_rows

# Fixed values of the round function: a prime modulus and two odd multipliers below it.
PRIME, MULTIPLIER, ADDEND = 2_147_483_647, 1_103_515_245, 12_345
ROUNDS = 6
#: Steps of the walk in one pass; what is still outside (2**-24 of the rows or less) takes another.
WALK = 24


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    keys, x = [], (seed * 2 + 1) % PRIME
    for _ in range(rounds):
        x = (x * MULTIPLIER + ADDEND) % PRIME
        keys.append(x)
    return keys


def half_widths(n: int) -> tuple[int, int]:
    """Bits of the left and the right half: together the least domain that holds n."""
    bits = max(2, (max(n, 1) - 1).bit_length())
    if bits > 60:
        raise ValueError("at most 2**60 rows")
    return bits // 2, bits - bits // 2


def permute_once(x: Column, n: int, seed: int) -> Column:
    """One pass of the network over the domain. An even number of rounds brings the widths back."""
    a, b = half_widths(n)
    state = F.struct(F.shiftrightunsigned(x, b).alias("l"), x.bitwiseAND(F.lit((1 << b) - 1)).alias("r"))
    steps = F.array(*[F.struct(F.lit(k).cast("bigint").alias("key"), F.lit((1 << (a if i % 2 == 0 else b)) - 1).cast("bigint").alias("mask")) for i, k in enumerate(round_keys(seed))])

    def mixed(r: Column, key: Column) -> Column:  # a square of a 31-bit number fits a BIGINT
        return F.aggregate(F.array(F.lit(MULTIPLIER).cast("bigint")), (r + key) % PRIME, lambda y, m: (((y * m + ADDEND) % PRIME) * ((y * m + ADDEND) % PRIME) + key) % PRIME)

    def step(s: Column, k: Column) -> Column:
        return F.struct(s["r"].alias("l"), s["l"].bitwiseXOR(mixed(s["r"], k["key"]).bitwiseAND(k["mask"])).alias("r"))

    return F.aggregate(steps, state, step, lambda s: F.shiftleft(s["l"], b).bitwiseOR(s["r"]))


def permuted(df: DataFrame, column: str, n: int, seed: int) -> DataFrame:
    """Replaces row numbers 0..n-1 by their places."""
    again = F.sequence(F.lit(1), F.lit(WALK))
    walk = F.aggregate(again, permute_once(F.col(column), n, seed), lambda x, _: F.when(x < n, x).otherwise(permute_once(x, n, seed)))
    df = df.withColumn(column, walk)
    while not df.filter(F.col(column) >= n).isEmpty():
        df = checkpointed(df.withColumn(column, F.when(F.col(column) < n, F.col(column)).otherwise(walk)))
    return df


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = 2024) -> DataFrame:
    """(doc_id, size, text_crc32, row_number, place, shard, slot) for every row of ``docs``."""
    utf8 = F.col("text").cast("binary")
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"), F.crc32(utf8).cast("bigint").alias("text_crc32"))
    narrow = checkpointed(narrow)  # a few bytes a row; the texts are read once
    n = narrow.count()
    numbered = number_rows(narrow, ["doc_id", "text_crc32", "size"])
    placed = permuted(checkpointed(numbered.withColumn("place", F.col("row_number"))), "place", n, seed)
    return placed.withColumns({"shard": (F.col("place") % shards).cast("int"), "slot": F.expr(f"place div {int(shards)}")})


def permute_python(x: int, n: int, seed: int) -> int:
    """The same permutation of one number, for readers and tests that compute where a row lies."""
    a, b = half_widths(n)

    def once(x: int) -> int:
        l, r = x >> b, x & ((1 << b) - 1)
        for i, key in enumerate(round_keys(seed)):
            y = ((r + key) % PRIME * MULTIPLIER + ADDEND) % PRIME
            l, r = r, l ^ ((y * y + key) % PRIME & ((1 << (a if i % 2 == 0 else b)) - 1))
        return l << b | r

    x = once(x)
    while x >= n:
        x = once(x)
    return x
