"""What the operators share: tables in the shared folder, row numbers, connected components."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import checkpointed, discard, fresh, number_rows, shared_folder, written

__all__ = ["WORD", "checkpointed", "components", "discard", "fresh", "lean", "number_rows", "shared_folder", "written"]

#: What separates words: the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same work on batches, after which the Python worker gives what it freed back to the system.

    Workers wait for their next task with all the memory that they ever touched, beside the executor's own.
    """

    @functools.wraps(run)
    def leaner(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # another C library
            pass

    return leaner


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the least node reachable.

    Large-star and small-star rounds: each node links its greater neighbours, then its lesser
    ones, to the least that it knows. A round is a shuffle by node whose groups only take a
    minimum (a hot node is pre-aggregated map-side), and it ends as edges stop changing.
    Null ends are dropped; self loops give a component of one.
    """
    edges = edges.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL")
    kind = edges.schema["a"].dataType
    nodes = written(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct())
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None if not now.isEmpty() else ()
    while seen != ():
        both = now.union(now.select("b", "a"))  # a knows b
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = large.filter("a <> b")
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        before, now = now, written(small.filter("a <> b").distinct())
        discard(before)
        sign = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        seen = () if sign == seen else sign
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("component"))
    return out.select(F.col("node").cast(kind), F.col("component").cast(kind))
