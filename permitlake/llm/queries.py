"""The registered queries of the operators: (spark, sf_dir) -> DataFrame.

Those without oracle SQL are compared with a brute-force version, an exact round trip or
held-out accuracy in tests/llm.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permitlake.llm import (
    collocations,
    conversation_trie,
    decontamination,
    fingerprints,
    license_scan,
    lm_scoring,
    oracle,
    packing,
    quality,
    secret_scan,
    sharding,
    simhash_dedup,
    suffix_dedup,
    toxicity,
)
from permitlake.llm.common import ship_package, table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        added=packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json")),
    )
    return packed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents")).select(
        "doc_id", F.sha2("candidate", 256).alias("candidate_sha256"), "start", "starts",
        "length", "probability", "is_secret",
    )


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    ).drop("text_hash")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return shards.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "hilbert",
    )


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.label_documents(table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def _shipped(query: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {
        "op1_packing": op1_packing,
        "op2_lm_scoring": op2_lm_scoring,
        "op3_secret_scan": op3_secret_scan,
        "op4_fingerprints": op4_fingerprints,
        "op5_quality": op5_quality,
        "op6_decontamination": op6_decontamination,
        "op7_sharding": op7_sharding,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_simhash_dedup": op9_simhash_dedup,
        "op10_toxicity": op10_toxicity,
        "op11_license_scan": op11_license_scan,
        "op12_conversation_trie": op12_conversation_trie,
        "op13_collocations": op13_collocations,
    }
    return {name: _shipped(query) for name, query in found.items()}


def oracle_sql() -> dict[str, str]:
    return {
        "op12_conversation_trie": oracle.CONVERSATION_TRIE,
        "op13_collocations": oracle.COLLOCATIONS,
    }
