"""Spark-native key/value analytics: joins, hash-ordered sorts, radix partitioning, wrap-around sums."""
