"""From raw documents to packed training sequences, in five stages.

Each stage reads what the one before it has kept, as Parquet in a folder that driver and executors share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm import ngram_join, packing, quality, secret_scan, toxicity
from rivulet.llm.common import bounded_batches, shared_folder
from rivulet.llm.queries import JSON_VOCABULARY, PATTERN


def _apart(docs: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run a step while all columns but doc_id and text bear other names, so none clashes with a column that the step adds."""
    names = {c: c if c in ("doc_id", "text") else f"document_column_{i}" for i, c in enumerate(docs.columns)}
    return step(docs.withColumnsRenamed(names)).select(*[F.col(new).alias(old) for old, new in names.items()])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that pass the limits and the isolation forest.

    Null and empty texts fail the limits and go; repeated rows share a verdict; an empty table stays empty. A text of any length
    is read whole. Columns may have any names. Without labels only the limits decide.
    """
    bounded_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _apart(docs, lambda d: quality.judge(d, labels).where("kept"))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the string-kernel machine does not predict to be toxic.

    Null and empty texts stay; repeated rows share a verdict; an empty table stays empty. A text of any length is scored whole. Columns may have
    any names. Without labels of both kinds all stay.
    """
    bounded_batches(spark)
    machine = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _apart(docs, lambda d: toxicity.score(d, machine).where("predicted = 0"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of similar ones, the one with the smallest id; of rows that repeat id and text the first by their other columns.

    Texts without a word, and null ones, all stay; an empty table stays empty. Texts of any length are compared whole. Columns may have any names.
    """
    bounded_batches(spark)
    return _apart(docs, ngram_join.keep_one_of_each)


def secret_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put a mark in place of every secret; n_chars follows the text. Null texts stay null."""
    bounded_batches(spark)
    clean = _apart(docs, lambda d: secret_scan.scan(d).withColumn("text", F.when(F.col("text").isNotNull(), F.col("redacted"))))
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType))) if "n_chars" in docs.columns else clean


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the documents' tokens into sequences of power-of-two lengths.

    Null and empty texts are one sequence of the end mark; repeated rows are packed each for itself; an empty table gives no rows. Only doc_id and
    text are read, texts of any length whole.
    """
    bounded_batches(spark)
    return packing.pack(docs.select("doc_id", "text"), JSON_VOCABULARY, PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("ngram_jaccard_join", near_duplicates),
    ("secret_scan", secret_removal),
    ("packing", pack_sequences),
]

#: The stages fit models and tokenise, which SQL cannot express; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed sequences of the documents that every stage keeps."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark, "corpus-pipeline")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = f"{folder}/{i}-{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    raise ValueError("STAGES is empty")
