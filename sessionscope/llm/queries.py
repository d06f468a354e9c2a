"""The registered queries of this subpackage: thin callers of the operators, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionscope.llm import bpe, exact_dups, fingerprints, lexical, licenses, mixing, near_dups, neighbours, pii, prefix_trie, sharding, toxicity, url_filters
from sessionscope.llm.oracles import ORACLES  # noqa: F401


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.kd_tree_shards(_read(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _count_of(kind: str) -> Column:
    return F.size(F.filter("pii", lambda s: s["kind"] == kind))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_read(spark, sf_dir, "documents")).select("doc_id", "pii")
    base = F.filter("pii", lambda s: s["rank"] < len(pii.BASE_KINDS))
    counts = [_count_of(k).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    score = F.coalesce(F.array_max(F.transform("pii", lambda s: s["score"])), F.lit(0.0))  # of the surest span
    digests = [F.sha2(pii.span_list(base), 256).alias("base_sha256"), pii.span_list(F.col("pii")).alias("spans")]
    return found.select("doc_id", *counts, *digests, F.size("pii").cast("long").alias("n_spans"), score.alias("score"))


def op3_odd_sketch_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(_read(spark, sf_dir, "documents"), config=near_dups.NearDupConfig(shingle=2))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels, config = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), toxicity.ToxicityConfig()
    model = toxicity.fit(docs, labels, config=config)
    scored = toxicity.score_toxicity(docs, model)
    predicted = F.when(F.col("score") >= config.threshold, 1).otherwise(0)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edits(_read(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(_read(spark, sf_dir, "pages"), _read(spark, sf_dir, "labels"))


def op8_hash_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.hash_threshold_mix(_read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_read(spark, sf_dir, "documents"))


def op10_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return neighbours.nearest_neighbours(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op11_extendible_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return exact_dups.mark_copies(docs, exact_dups.build_index(docs))


def op12_wavelet_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build_index(_read(spark, sf_dir, "documents"))
    return lexical.search(index, _read(spark, sf_dir, "benchmark"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.with_end_digests(prefix_trie.build_trie(prefix_trie.rebuild(_read(spark, sf_dir, "conversations"))))


QUERIES = {
    f.__name__: f
    for f in (
        op1_kd_shards, op2_pii, op3_odd_sketch_dups, op4_toxicity, op5_fingerprints, op6_bpe, op7_url_templates, op8_hash_mix, op9_licenses, op10_ivf_pq, op11_extendible_hash,
        op12_wavelet_search, op13_prefix_trie,
    )
}
