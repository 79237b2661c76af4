"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofia.llm import centroids, lm, oracle, tokens
from asofia.llm.chat import collapse_and_render
from asofia.llm.classifier import quality_scores, train
from asofia.llm.decontam import contaminated
from asofia.llm.jaccard import jaccard_components
from asofia.llm.manifest import manifest
from asofia.llm.packing import packed_sequences
from asofia.llm.rules import LINE_LIMIT, NGRAM_LIMITS, quality_rules
from asofia.llm.simhash import simhash_components
from asofia.llm.urls import RULES, judge_urls
from asofia.llm.warc import round_trip


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_read(spark, sf_dir, "pages"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_read(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_read(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return lm.pseudo_likelihood(docs, lm.train(docs))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_sequences(_read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(_read(spark, sf_dir, "pages"), rules)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return tokens.token_counts(docs, tokens.train(docs, tokenizer_path("piece_bpe_32k.model")))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_and_render(_read(spark, sf_dir, "conversations"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality_scores(docs, train(docs, _read(spark, sf_dir, "labels")))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.centroid_clusters(_read(spark, sf_dir, "embeddings"))


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_read(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id has an even CRC-32 is tampered with: its text's line breaks are deleted."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return manifest(_read(spark, sf_dir, "documents"), {"text": text})


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_quality_rules": op3_quality_rules,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_packing": op5_packing,
    "op6_url_filters": op6_url_filters,
    "op7_token_counts": op7_token_counts,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_simhash_near_dedup": op12_simhash_near_dedup,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc": oracle.WARC,
    "op2_ngram_jaccard_join": oracle.JACCARD,
    "op3_quality_rules": oracle.rules(NGRAM_LIMITS, LINE_LIMIT),
    "op6_url_filters": oracle.URLS,
    "op8_chat_formatting": oracle.CHATS,
    "op11_centroid_clustering": oracle.centroids(centroids.CLUSTERS, centroids.ROUNDS),
    "op13_merkle_manifest": oracle.MANIFEST,
}
