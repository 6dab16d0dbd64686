"""Importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Features of a text are hashed into ``BUCKETS``: each word, and one to three neighbouring word
shapes (runs of small letters, capitals, digits and of each other character; a word that repeats
the one before has a shape of its own). Two bag-of-n-gram models are counted: raw over
all documents, target over documents labelled good. With the raw counts brought to the target's
mass and ``PSEUDO`` counts added to either, a document's log importance is the sum over its
features of log target - log raw. Its key is that plus Gumbel noise drawn from its doc_id, and
the k greatest keys are the sample: importance sampling without replacement. k is the number of
documents that the target model explains nearly as well as the raw one or better (log importance
of -``SLACK`` or more: a short text tells the two apart by little).

The raw model counts every document. Target documents are a sample of ``MOST_TARGETS`` labelled
ids at most (those of least hash), known to every task; that is the only bound. Keys are numbers
only, ranked by a distributed sort; texts are never shuffled but scored again with the threshold.

Defined cases: a text without words (or null) has log importance minus infinity and is never
drawn; without target labels all ratios are 1 and every document with words is kept; a null
doc_id draws the noise of null. Rows that tie with the last key are all kept, so repeated rows
stay or go together. Labels that are null or repeated count once if any is good.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, fresh, lean, number_rows
from .neardup import ODD, mixed, slices, stretch_hashes, stretches, word_places

BITS, PSEUDO, MOST_TARGETS, SLACK = 16, 5.0, 50_000, 2.0
BUCKETS = 1 << BITS
# Fixed value: the shape of a repeated word.
REPEATED = np.uint64(0x27D4EB2F165667C5)

#: Kinds of bytes: small letters (and all beyond ASCII), capitals, digits; others are a kind each.
KIND = np.arange(256, dtype=np.uint8)
KIND[97:123], KIND[128:], KIND[65:91], KIND[48:58] = 1, 1, 2, 3
VALUE = mixed(np.arange(1, 257, dtype=np.uint64) * ODD[1])


def features(texts: pa.Array) -> list[np.ndarray]:
    """Bucket numbers of each text's features, by array operations over all texts together."""
    starts, words, shapes = [], [], []
    ends, parts = stretches(texts)
    for at, raw, breaks in parts:
        start, end = word_places(raw, breaks)
        if not len(start):
            continue
        kind = KIND[raw]
        new = np.ones(len(raw), bool)  # a run of a kind counts once
        np.not_equal(kind[1:], kind[:-1], out=new[1:])
        new[start] = True
        place = np.concatenate([[0], np.cumsum(new)])
        starts.append(start + at)
        words.append(stretch_hashes(VALUE[raw], start, end))
        shapes.append(stretch_hashes(VALUE[kind[new]], place[start], place[end]))
    if not starts:
        return [np.empty(0, np.int64)] * len(texts)
    w, s = np.concatenate(words), np.concatenate(shapes)
    bound = np.searchsorted(np.concatenate(starts), ends)
    again = np.zeros(len(w), bool)
    np.equal(w[1:], w[:-1], out=again[1:])
    again[bound[:-1][bound[:-1] < len(w)]] = False
    s = np.where(again, REPEATED, s)
    two, three = s[:-1] * ODD[0] + s[1:] * ODD[1] + ODD[1], s[:-2] * ODD[0] + s[1:-1] * ODD[1] + s[2:] * ODD[2] + ODD[2]
    w, one, two, three = (((h ^ (h >> np.uint64(31))) * ODD[1] >> np.uint64(64 - BITS)).astype(np.int64) for h in (w, s * ODD[0], two, three))
    return [np.concatenate([w[a:b], one[a:b], two[a : max(a, b - 1)], three[a : max(a, b - 2)]]) for a, b in zip(bound[:-1].tolist(), bound[1:].tolist())]


def target_ids(labels: DataFrame, most: int = MOST_TARGETS) -> np.ndarray:
    """Sorted doc_ids labelled good: ``most`` at most, those of least hash."""
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    rows = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).toArrow()
    return np.sort(rows["doc_id"].to_numpy())


def log_ratios(docs: DataFrame, targets: np.ndarray) -> np.ndarray:
    """log(target / raw) for each bucket: counts of all documents, added up in tasks and then by bucket."""
    ids = docs.sparkSession.sparkContext.broadcast(targets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((2, BUCKETS), np.int64)
        for batch in slices(batches):
            is_target = np.isin(batch["doc_id"].to_numpy(zero_copy_only=False), ids.value)
            found = features(batch["text"])
            own[1] += np.bincount(np.concatenate(found), minlength=BUCKETS)
            good = [f for f, t in zip(found, is_target.tolist()) if t]
            if good:
                own[0] += np.bincount(np.concatenate(good), minlength=BUCKETS)
        some = np.flatnonzero(own[1])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(own[0, some]), pa.array(own[1, some])], ["bucket", "target", "raw"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(lean(count), "bucket bigint, target bigint, raw bigint")
    sums = rows.groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")).toArrow()  # at most BUCKETS rows
    target, raw = np.zeros(BUCKETS), np.zeros(BUCKETS)
    target[sums["bucket"].to_numpy()], raw[sums["bucket"].to_numpy()] = sums["target"].to_numpy(), sums["raw"].to_numpy()
    if not target.sum():
        return np.zeros(BUCKETS)
    return np.log((target + PSEUDO) / (raw * (target.sum() / raw.sum()) + PSEUDO))


def with_log_importance(docs: DataFrame, ratios: np.ndarray, name: str) -> DataFrame:
    table = docs.sparkSession.sparkContext.broadcast(ratios)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            score = [float(table.value[f].sum()) if len(f) else float("-inf") for f in features(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], [*batch.schema.names, name])

    schema = docs.select("*", F.lit(0.0).alias(name)).schema
    return docs.mapInArrow(lean(run), schema)


def gumbel(doc_id: Column, seed: int) -> Column:
    """Standard Gumbel noise that a doc_id always draws."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id.cast("bigint")), 12)
    return -F.log(-F.log((bits + 0.5) / float(1 << 52)))


def resample(docs: DataFrame, labels: DataFrame, seed: int = 3, k: int | None = None, most: int = MOST_TARGETS) -> DataFrame:
    """The drawn rows of ``docs`` with log_importance and gumbel_key (renamed if ``docs`` has such columns)."""
    weight, key = fresh(docs, "log_importance", "gumbel_key")
    ratios = log_ratios(docs, target_ids(labels, most))
    narrow = with_log_importance(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), ratios, "w").drop("text")
    keys = checkpointed(narrow.filter(F.col("w") > float("-inf")).select("w", (F.col("w") + gumbel(F.col("doc_id"), seed)).alias("key")))
    if k is None:
        k = keys.filter(F.col("w") >= -SLACK).count()
    last = number_rows(keys.select((-F.col("key")).alias("key")), ["key"]).filter(F.col("row_number") == k - 1).head()
    scored = with_log_importance(docs, ratios, weight).withColumn(key, F.col(weight) + gumbel(F.col("doc_id"), seed))
    if last is None:  # k is 0 or more than there are
        return scored.filter(F.lit(k > 0) & (F.col(weight) > float("-inf")))
    return scored.filter(F.col(key) >= -last["key"])
