"""The corpus pipeline: documents to token ids in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written
as Parquet and reread as the next one's ``docs``. All but the last return the
columns of ``documents``; the last returns the ids of each document's copies.

SQL cannot express the stages (a trained classifier, SimHash components, a
tokenizer), so there is no ORACLE_SQL; tests/llm holds run() against the stages'
operators, which have plain statements in tests of their own.

Defined results: null texts are clean, keep no lines, have fingerprint zero and
no ids; documents that line dedup empties are one SimHash group, of which one
document stays; an empty table passes through as an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialmetrics.llm import bpe, lines, mixing, simhash, toxicity
from dialmetrics.llm.queries import tokenizer_path
from dialmetrics.session import ensure_checkpoint_dir


BATCH_ROWS = 500            # documents of an Arrow batch: the stages' workers live side by side in an executor
BLOCK_BYTES = 4_000_000     # text of a block of the tokenizer


BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """For the stage's own job, which runs when its rows are written; ``run`` puts the caller's setting back."""
    spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity is below the limit."""
    small_batches(spark)
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One occurrence of each group of lines; ``n_chars`` follows the text."""
    small_batches(spark)
    kept = lines.dedup_lines(docs).select(*docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) \
        if "n_chars" in docs.columns else kept


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    small_batches(spark)
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight asks for."""
    return mixing.emit(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_tokens, ids`` (little-endian unsigned 32-bit), and whether the ids give the text back."""
    small_batches(spark)
    content = bpe.load(tokenizer_path())
    ids = bpe.encode(docs.select("doc_id", "lang", "source", "text"), content, block_bytes=BLOCK_BYTES)
    both = bpe.decode(ids, content)
    return both.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", dedup_lines),
    ("simhash", dedup_documents),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared checkpoint folder."""
    folder = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = spark.conf.get(BATCH_SETTING)
    try:
        for name, stage in STAGES:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
    finally:
        spark.conf.set(BATCH_SETTING, before)
    return docs
