"""Vectors in tiles: what exact and approximate search share.

A tile holds up to ``rows`` vectors of one length as a matrix, sorted by id. The query set meets
the shards tile by tile: query tiles are copied to every slot of shards, so a task multiplies
matrices and no pair of single rows is ever formed. Each task keeps the best of a query over its
tiles and the lists of the tasks are merged by query.

Vectors take part if neither they nor their id are null and all components are finite numbers
(search by inner product also leaves out zero vectors); empty ones don't. Rows equal in id and
vector count as one; rows of one id with different vectors are each a candidate, never for their
own id, and as queries share one list: the best of all their pairs, where a vec_id may come more
than once. Vectors are only compared with those of their length. An empty table gives no rows,
other columns are ignored, and scores that tie go to the smaller vec_id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TILE_ROWS, QUERY_ROWS = 8_192, 1_024
TILE = "tile bigint, dim int, ids binary, data binary"
NEAR = "query_id bigint, vec_id bigint, score {0}"
#: (query ids, query matrix, shard ids, shard matrix) -> (query places, shard places, scores)
Match = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def distinct_rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) as doubles, of rows equal in both one; the shuffle that drops them happens only if an id repeats."""
    narrow = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id IS NOT NULL AND embedding IS NOT NULL")
    ids = narrow.groupBy("vec_id").count()
    return narrow if ids.filter("count > 1").isEmpty() else narrow.dropDuplicates()


def tiles(vectors: DataFrame, rows: int, zero: bool) -> DataFrame:
    """(tile, dim, ids, data): packed vectors; ``zero`` keeps zero vectors. Data are doubles, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def packed(dim: int, least: int) -> Iterator[pa.RecordBatch]:
            ids, data = (np.concatenate(x) for x in zip(*held[dim]))
            at = 0
            while len(ids) - at >= least and at < len(ids):
                some = slice(at, at + rows)
                order = np.argsort(ids[some], kind="stable")
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([dim], pa.int32()), pa.array([ids[some][order].tobytes()], pa.binary()), pa.array([data[some][order].tobytes()], pa.binary())], ["tile", "dim", "ids", "data"])
                at += rows
            held[dim] = [(ids[at:], data[at:])]

        for batch in batches:
            lists = batch.column(1)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            ends = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)  # a null component is not a number
            length = np.diff(ends)
            for dim in np.unique(length[length > 0]):
                own = np.flatnonzero(length == dim)
                data = flat[ends[:-1][own][:, None] + np.arange(dim)]
                good = np.isfinite(data).all(axis=1)
                if not zero:
                    good &= data.any(axis=1)
                held.setdefault(int(dim), []).append((ids[own][good], data[good]))
                if sum(len(x) for x, _ in held[int(dim)]) >= rows:
                    yield from packed(int(dim), rows)
        for dim in held:
            yield from packed(dim, 1)

    return vectors.select("vec_id", "embedding").mapInArrow(run, TILE).withColumn("tile", F.monotonically_increasing_id())


def nearest(vectors: DataFrame, is_query, k: int, match: Match, kind: str, zero: bool, rows: int = TILE_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best of what ``match`` finds, ties to the smaller vec_id."""
    spark = vectors.sparkSession
    clean = distinct_rows(vectors)
    slots = max(2 * spark.sparkContext.defaultParallelism, -(-vectors.count() // rows))
    shards = tiles(clean, rows, zero).withColumn("slot", F.pmod(F.shiftrightunsigned("tile", 33) + F.col("tile").bitwiseAND(F.lit((1 << 33) - 1)), F.lit(slots)))
    queries = tiles(clean.filter(is_query), query_rows, zero).select("dim", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    copied = queries.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(slots - 1).cast("bigint"))))
    met = shards.select("slot", "dim", "ids", "data").join(copied, ["slot", "dim"])
    numbers = np.int64 if kind == "bigint" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, q_ids = (np.frombuffer(batch[c][i].as_buffer(), np.int64) for c in ("ids", "q_ids"))
                dim = batch["dim"][i].as_py()
                data, q_data = (np.frombuffer(batch[c][i].as_buffer(), np.float64).reshape(-1, dim) for c in ("data", "q_data"))
                q, v, score = match(q_ids, q_data, ids, data)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[q]), pa.array(ids[v]), pa.array(score.astype(numbers, copy=False))], ["query_id", "vec_id", "score"])

    found = met.mapInArrow(run, NEAR.format(kind))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    # the limit on rank is also applied in each task before the shuffle: lists merge tile, task, query
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def first_k(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k greatest; among equals the smaller column, by partial selection. -inf never counts."""
    n = score.shape[1]
    if n > k:
        least = np.partition(score, n - k, axis=1)[:, n - k]
        row, column = np.nonzero((score >= least[:, None]) & (score > -np.inf))
    else:
        row, column = np.nonzero(score > -np.inf)
    order = np.lexsort((column, -score[row, column], row))
    row, column = row[order], column[order]
    start = np.searchsorted(row, np.arange(score.shape[0]))
    keep = np.arange(len(row)) - start[row] < k
    return row[keep], column[keep]


def own_places(q_ids: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the queries' ids lie in a shard, as pairs (query place, shard place)."""
    left = np.searchsorted(ids, q_ids, "left")
    n = np.searchsorted(ids, q_ids, "right") - left
    return np.repeat(np.arange(len(q_ids)), n), np.arange(n.sum()) + np.repeat(left - np.cumsum(n) + n, n)
