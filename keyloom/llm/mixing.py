"""Mixing sources to target weights by systematic sampling.

Sizes count words. Sources in code-point order (null last) weigh 5, 2, 1, 5, 2, 1, ...; each
gets its weight's share of all words, but no more than ``most`` times its own, and what is over
is shared again by weight among the others. A document's expected copies are its source's
target / size; documents are laid in the order (size, doc_id, text hash), the expected copies
are summed up, one random offset for each source is added, and a document is emitted once for
each whole number that its stretch crosses. Order by size keeps the words taken near the target;
where one long document still decides, the offset does: of ``TRIES`` random ones, the source takes
that whose words come nearest to its target (the first on ties). Sources may be many: they are
numbered and summed up like rows, and only two sums of them reach the driver at a time.

Defined cases: null text or one without words has size 0, is copied like any other document of
its source, and takes no words; a source without words has target 0 and no copies; an empty
table gives no rows. Texts of any length count whole. Equal rows are interchangeable, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, fresh, number_rows, written

WEIGHTS = (5, 2, 1)
MOST_TIMES = 3
#: Steps of a random offset, and offsets of a source that are tried.
OFFSETS, TRIES = 4096, 16


def source_targets(sizes: DataFrame, most: int = MOST_TIMES) -> DataFrame:
    """(source, source_size, weight, ...) -> also target, the columns staying.

    Water filling: the level is what is left by weight after the sources that it fills, and is
    found again until it fills no more of them. Each time the sources are summed up where they lie.
    """
    sums = sizes.agg(F.sum("source_size"), F.sum("weight")).first()
    level = sums[0] / sums[1] if sums[0] else 0.0
    cap = most * F.col("source_size")
    while True:
        fits = cap >= F.lit(level) * F.col("weight")
        weight, full = sizes.agg(F.sum(F.when(fits, F.col("weight"))), F.sum(F.when(~fits, cap))).first()
        now = ((sums[0] or 0) - (full or 0)) / weight if weight else level
        if now <= level:
            break
        level = now
    return sizes.withColumn("target", F.least(cap.cast("double"), F.lit(level) * F.col("weight")))


def offset(source: Column, seed: int, nth: int = 0) -> Column:
    """One of the source's random offsets in (0, 1): a multiple of 1/4096 and half a step more, so sums with it stay exact."""
    text = F.concat(F.coalesce(F.concat(F.lit("s"), source), F.lit("null")), F.lit(f"/{seed}/{nth}"))
    digits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")
    return (digits % OFFSETS + 0.5) / OFFSETS


def emitted(rate: Column, k: Column, u: Column) -> Column:
    """Whole numbers crossed by the k-th stretch of length ``rate``, from offset u on."""
    return (F.floor(rate * (k + 1) + u) - F.floor(rate * k + u)).cast("bigint")


def mix_counts(docs: DataFrame, seed: int = 11, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES) -> DataFrame:
    """(doc_id, source, size, text_key, source_size, target, copies, taken), one row for each row of ``docs``."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64("text").alias("text_key"))
    narrow = checkpointed(narrow)  # a few bytes a row; the texts are read once
    numbered = written(number_rows(narrow, [F.col("source").isNull(), F.col("source").cast("binary"), "size", "doc_id", "text_key"]))
    sizes = numbered.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"), F.min("row_number").alias("first_row"))
    # sources stand in the order of their first rows
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    plan = source_targets(written(number_rows(sizes, ["first_row"], "nth").withColumn("weight", weight)), most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.withColumn("rate", rate).select(F.col("source").alias("of"), "source_size", "target", "first_row", "rate")
    k = F.col("row_number") - F.col("first_row")
    joined = numbered.join(plan, F.col("source").eqNullSafe(F.col("of")))
    # of a few random offsets the one that brings the source nearest to its target
    tries = [F.sum(F.col("size") * emitted(F.col("rate"), k, offset(F.col("of"), seed, i))) for i in range(TRIES)]
    missed = [F.struct(F.abs(t - F.first("target")).alias("by"), F.lit(i).alias("i"), offset(F.first("of"), seed, i).alias("u")) for i, t in enumerate(tries)]
    chosen = written(joined.groupBy(F.col("of").alias("chosen")).agg(F.least(*missed)["u"].alias("u")))
    out = joined.join(chosen, F.col("source").eqNullSafe(F.col("chosen")))
    out = out.withColumn("copies", emitted(F.col("rate"), k, F.col("u"))).withColumn("taken", F.col("copies") * F.col("size"))
    return out.drop("of", "first_row", "rate", "chosen", "u", "row_number")


def mix_documents(docs: DataFrame, seed: int = 11, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES) -> DataFrame:
    """The documents themselves, each as often as ``mix_counts`` says; the columns of ``docs`` stay.

    Rows meet their counts by (doc_id, text hash, source). Rows equal in these share their
    counts: their sum is dealt out evenly among them. The counts have a row for a document, so
    they are never broadcast: at every size the texts are shuffled once to meet them.
    """
    key, id_, n, copies, nth = fresh(docs, "_key", "_id", "_n", "_copies", "_nth")
    row_key = lambda text_key: F.xxhash64(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), text_key)
    row_id = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1))
    counts = mix_counts(docs, seed, weights, most).select(row_key(F.col("text_key")).alias(key), row_id.alias(id_), "copies")
    counts = written(counts.groupBy(key, id_).agg(F.sum("copies").alias(copies), F.count(F.lit(1)).alias(n)).filter(F.col(copies) > 0))
    keyed = docs.withColumns({key: row_key(F.xxhash64("text")), id_: row_id})
    out = keyed.join(counts.filter(F.col(n) == 1).hint("merge"), [key, id_])
    if not counts.filter(F.col(n) > 1).isEmpty():
        several = keyed.join(counts.filter(F.col(n) > 1).hint("merge"), [key, id_])
        several = several.withColumn(nth, F.row_number().over(Window.partitionBy(key, id_).orderBy(key)) - 1)
        extra = (F.col(nth) < F.col(copies) % F.col(n)).cast("bigint")
        several = several.withColumn(copies, F.floor(F.col(copies) / F.col(n)).cast("bigint") + extra).drop(nth)
        out = out.unionByName(several)
    return out.select(*[F.col(c) for c in docs.columns], F.explode(F.array_repeat(F.lit(0), F.col(copies).cast("int"))).alias(nth)).drop(nth)
