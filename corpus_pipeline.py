"""A training corpus from ``documents``: each stage works on all that the one before it kept.

Every stage takes empty tables, nulls in any column, empty and very long texts, repeated rows and further
columns, whatever their names. Null and empty texts have a log weight of 0 in ``quality`` and stay where
the threshold is below that, have no lines to lose, are never near duplicates, have size 0 in the mixture (they are
taken as often as their source) and give no token ids. Rows that repeat a doc_id are judged each by its own text; rows
that repeat doc_id and text share their fate in the first two stages, and ``near_dedup`` leaves one. A null
source is a source of its own. Further columns pass through to the mixture; ``encode`` returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditframe.llm import bpe, dart, importance, lines, mixing
from auditframe.session import materialize


#: Rows that pass to a Python worker at a time: whole texts, so a batch of Spark's 10,000 would hold tens of MB, on both
#: sides of every task. It is set for the session, as the plans that stages return are run later.
BATCH_ROWS = 2_000


def _batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps; without labels of both kinds all of them."""
    _batches(spark)
    model = importance.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return importance.importance_sample(docs, model).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that fuzzily repeat an earlier one."""
    _batches(spark)
    return lines.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the smallest doc_id; documents without words stay."""
    _batches(spark)
    return dart.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    _batches(spark)
    return mixing.repeat_rows(mixing.mix(docs)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens, ids_sha256 of every row, and whether its ids decode to its text."""
    _batches(spark)
    import public_tokenizers

    both = bpe.bpe_encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decoded="decoded")
    same = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return both.select("doc_id", "source", "lang", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), same.alias("decodes"))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixture", mixture), ("encode", encode)]

#: No stage but the mixture can be expressed in SQL; each is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
