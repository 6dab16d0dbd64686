"""Hashes and radix digits as Columns. 64-bit values are unsigned numbers kept in wrapped BIGINTs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HashExpr = Callable[[Column], Column]

MIN_LONG = -(2**63)
TWO_64 = 2**64


def fast_hash(key: Column) -> Column:
    """The default hash: xxhash64, a signed BIGINT whose bits are read as unsigned."""
    return F.xxhash64(key)


def identity_hash(key: Column) -> Column:
    return key.cast("bigint")


def portable_hash(digits: int) -> HashExpr:
    """The first hex digits (15 at most) of the key text's md5 as a BIGINT: the same value in any SQL engine."""
    if not 1 <= digits <= 15:
        raise ValueError("1 to 15 hex digits fit a signed BIGINT")
    return lambda key: F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, digits), 16, 10).cast("bigint")


def hash_tag(df: DataFrame, hash_expr: HashExpr = fast_hash) -> DataFrame:
    """(key, value) -> (hash, key, value)."""
    return df.select(hash_expr(F.col("key")).alias("hash"), "key", "value")


def top_bits(h: Column, bits: int, width: int = 64) -> Column:
    """The partition of a hash: its top ``bits`` of ``width``, by a logical shift. 0 bits: one partition."""
    if not 0 <= bits <= width:
        raise ValueError(f"{bits} of {width} bits")
    return F.lit(0).cast("bigint") if bits == 0 else F.shiftrightunsigned(h.cast("bigint"), width - bits)


def middle_bits(h: Column, mask_bits: int, bits: int) -> Column:
    """A later radix level: the top ``bits`` of the lowest ``mask_bits``."""
    mask = (1 << mask_bits) - 1 if mask_bits < 64 else -1
    return F.shiftrightunsigned(h.bitwiseAND(F.lit(mask)), max(0, mask_bits - bits))


def unsigned_order(key: Column) -> Column:
    """A BIGINT whose signed order is the unsigned order of ``key``."""
    return key.cast("bigint").bitwiseXOR(F.lit(MIN_LONG))


def u64_sum(value: Column) -> Column:
    """SUM modulo 2**64 as a decimal: it wraps where sum(BIGINT) would raise. The sum has 38 digits, room for 10**18 rows."""
    return F.pmod(F.sum(value.cast("decimal(28,0)")), F.lit(str(TWO_64)).cast("decimal(20,0)"))
