"""One registered query per operator, over its whole tables, and the pipeline's parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm import alignment, chat, embedding_dedup, html_main, ngram_join, oracle, packing, quality, secret_scan, sharding, tokens, toxicity, urls, whitening
from rivulet.llm.common import bounded_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {
    "op2_rendezvous_sharding": oracle.SHARDING,
    "op4_p_stable_embeddings": oracle.EMBEDDINGS,
    "op9_lsh_forest_jaccard": oracle.NGRAM_JOIN,
    "op10_prefix_targets": oracle.CHAT,
    "op11_block_tree_text": oracle.MAIN_TEXT,
}

JSON_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
RANK_VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def query(name: str, *tables: str):
    """Register a function of the named tables."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            bounded_batches(spark)
            return fn(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables])

        QUERIES[name] = run
        return fn

    return wrap


@query("op1_power_of_two_packing", "documents")
def _packing(documents: DataFrame) -> DataFrame:
    return packing.piece_table(documents, JSON_VOCABULARY, PATTERN)


@query("op2_rendezvous_sharding", "documents")
def _sharding(documents: DataFrame) -> DataFrame:
    return sharding.shard_table(documents, shards=24)


@query("op3_tree_bpe", "documents")
def _bpe(documents: DataFrame) -> DataFrame:
    return tokens.token_digests(documents, RANK_VOCABULARY, PATTERN)


@query("op4_p_stable_embeddings", "embeddings")
def _embeddings(embeddings: DataFrame) -> DataFrame:
    return embedding_dedup.link_vectors(embeddings, threshold=0.93)


@query("op5_isolation_quality", "documents", "labels")
def _quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return quality.quality_table(documents, labels)


@query("op6_url_models", "pages")
def _urls(pages: DataFrame) -> DataFrame:
    return urls.judge_urls(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "url_score")


@query("op7_entropy_secrets", "documents")
def _secrets(documents: DataFrame) -> DataFrame:
    return secret_scan.scan_table(documents)


@query("op8_string_kernel_toxicity", "documents", "labels")
def _toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return toxicity.toxicity_table(documents, labels)


@query("op9_lsh_forest_jaccard", "documents")
def _join(documents: DataFrame) -> DataFrame:
    return ngram_join.join_table(documents)


@query("op10_prefix_targets", "conversations")
def _chat(conversations: DataFrame) -> DataFrame:
    spark = conversations.sparkSession
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.explode(F.array(F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role")))).alias("x")).select("conv_id", "x.turn", "x.role", F.lit(probe).alias("text"))
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.expand(rows))


@query("op11_block_tree_text", "pages")
def _main_text(pages: DataFrame) -> DataFrame:
    return html_main.extract(pages.select("page_id", "url", "html")).drop("html")


@query("op12_arrow_alignment", "documents")
def _alignment(documents: DataFrame) -> DataFrame:
    return alignment.align(documents, JSON_VOCABULARY, PATTERN, PIECE_MODEL)


@query("op13_feast_whitening", "embeddings")
def _whitening(embeddings: DataFrame) -> DataFrame:
    return whitening.whiten(embeddings)
