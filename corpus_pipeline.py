"""Corpus pipeline: toxicity, near-duplicates, personal data, source mix, tokens.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionscope.llm import bpe, mixing, near_dups, pii, toxicity
from sessionscope.operators.staging import stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under the threshold stay; weights are learnt from labels outside the held-out third."""
    config = toxicity.ToxicityConfig()
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), config=config)
    return toxicity.drop_toxic(docs, model, config=config)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates stays: five-word shingles, similarity from 0.8."""
    return near_dups.drop_near_duplicates(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind; n_chars follows the new text where that changed."""
    redacted = pii.redact(pii.find_pii(docs))
    length = F.when(F.size("pii") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return redacted.withColumn("n_chars", length).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it; those it takes 0 times go."""
    copies = mixing.hash_threshold_mix(docs).where("copies <> 1").select(F.col("doc_id").alias("__id"), F.col("copies").alias("__copies")).distinct()
    joined = docs.join(copies, F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    wanted = joined.where("__copies is null or __copies > 0")
    return wanted.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.coalesce("__copies", F.lit(1))))).select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("pii", redact_pii),
    ("mix", mix_sources),
    ("tokens", encode_tokens),
]

#: SQL can't express the first two stages.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        docs = docs if i == len(STAGES) - 1 else stage(docs, f"pipeline-{name}")
    return docs
