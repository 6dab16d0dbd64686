"""Tables in the shared folder, and row numbers that no single task gives out."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a folder of our own in local mode (tests), else an error:
    executors on other machines wouldn't see it."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not folder:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='keyloom-')}"
        _gone_at_exit(spark, folder)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder)
    return folder


def _gone_at_exit(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage; partitions and the order in them stay. The files go when nothing refers to them, or with the application."""
    spark = df.sparkSession
    shared_folder(spark)
    context = spark.sparkContext._jsc.sc()
    context.conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    _gone_at_exit(spark, context.getCheckpointDir().get())  # this application's own folder in the shared one
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder, which goes when the application ends."""
    spark = df.sparkSession
    at = f"{shared_folder(spark).rstrip('/')}/keyloom-{uuid.uuid4().hex}"
    df.write.parquet(at)
    _gone_at_exit(spark, at)
    out = spark.read.schema(df.schema).parquet(at)
    out.written_at = at
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names for working columns that clash with none of the frame's (whose case doesn't count)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def number_rows(df: DataFrame, order: list[Column | str], name: str = "row_number") -> DataFrame:
    """Row numbers 0.. in ``order`` without one task that sees all rows.

    A range exchange (a random last key also splits runs of equal rows), a sort in each
    partition and a checkpoint, so that every later read sees the same partitions; then the
    place in the partition plus the rows of the partitions before it (one row a partition).
    Rows equal in ``order`` are numbered among themselves arbitrarily. ``df`` should be narrow.
    """
    salt, at, part, start = fresh(df, "_salt", "_at", "_part", "_start")
    salted = df.withColumn(salt, F.rand(7))
    fixed = checkpointed(salted.repartitionByRange(*order, F.col(salt)).sortWithinPartitions(*order, salt).drop(salt))
    tagged = fixed.withColumn(at, F.monotonically_increasing_id()).withColumn(part, F.shiftrightunsigned(F.col(at), 33))
    sizes = tagged.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(part, F.coalesce(F.sum("n").over(before), F.lit(0)).cast("bigint").alias(start))
    row = F.col(start) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    return tagged.join(starts, part).withColumn(name, row).drop(at, part, start)
