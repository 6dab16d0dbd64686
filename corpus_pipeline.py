"""From raw documents to tokens: quality, near duplicates, secrets, mixture, encoding.

Each stage reads all that its predecessor kept, and all but the last return the columns of
documents. ``run`` writes each stage's rows as Parquet in the shared folder and reads them again.

Defined cases: documents without words (null, empty, white space alone) go in the quality stage; a
null doc_id or source is a value like any other. Of rows that repeat a text one stays: the smallest
doc_id, null last. Texts of any length count whole. Other columns stay as they are, whatever their
names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyloom.llm import mixing, neardup, quality, secrets, tokenizing
from keyloom.llm.common import discard, written
from keyloom.sources.tables import table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling against the labelled good documents; what isn't drawn goes."""
    return quality.resample(docs, table(spark, sf_dir, "labels")).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Grouped prefix join; one document of each component stays."""
    return neardup.keep_one(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are replaced by a mark."""
    return secrets.redact_documents(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Systematic sampling to the sources' target weights; a document comes as often as it is emitted."""
    return mixing.mix_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: token counts and digests of ids and decoded bytes for each document emitted."""
    return tokenizing.encode_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: Hashed models, compression and tokenisation are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, read = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        discard(*read)
        read = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
