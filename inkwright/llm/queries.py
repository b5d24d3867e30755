"""One query for each operator, over whole tables, and its SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embed_dedup, merkle, mixing, packing, quality, secrets, sharding, simhash, substring_dedup, token_counts, token_store, topk, variants


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(sharding.shard(_table(spark, sf_dir, "documents")))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.mix(_table(spark, sf_dir, "documents")))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.remove_repeats(_table(spark, sf_dir, "documents")))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = token_store.write_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_store.read_tokens(segments).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.link(_table(spark, sf_dir, "embeddings"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return packing.pack(found).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = secrets.train(secrets.labelled_findings(spark), secrets.Vocabulary.load(public_tokenizers.path("word_bpe_49k.json")))
    return secrets.findings(_table(spark, sf_dir, "documents"), forest)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return rated.select("doc_id", "scores.*", "keep")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.word_forms(variants.vocabulary(_table(spark, sf_dir, "documents")))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digest(_table(spark, sf_dir, "documents"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_mixing": op2_mixing,
    "op3_exact_topk": op3_exact_topk,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_token_output": op5_token_output,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_packing": op7_packing,
    "op8_secret_scan": op8_secret_scan,
    "op9_quality": op9_quality,
    "op10_simhash": op10_simhash,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_token_counts": op13_token_counts,
}

ORACLES = {
    "op2_mixing": mixing.ORACLE_SQL,
    "op3_exact_topk": topk.ORACLE_SQL,
    "op6_embedding_dedup": embed_dedup.ORACLE_SQL,
    "op11_spelling_variants": variants.ORACLE_SQL,
    "op12_merkle_manifest": merkle.ORACLE_SQL,
}
