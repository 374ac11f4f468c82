"""A training corpus in stages: each takes all rows its predecessor kept.

Documents that fail the quality rules go, and so do the failing lines of the others; of each group of near copies
(five-word shingles, similarity 0.8 or more) the smallest id stays; documents that hold a benchmark item go; personal data are replaced by
surrogates; what is left is encoded. All stages but the last return the columns of
documents. Every stage is written as Parquet and read back before the next one
starts, so a lost executor costs tasks of one stage only.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.llm.bpe import encode_documents
from logwarden.llm.common import settle
from logwarden.llm.decontaminate import drop_leaks
from logwarden.llm.line_quality import keep_clean
from logwarden.llm.near_dedup import one_per_group
from logwarden.llm.pii import key_of, replace_entities

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_per_group(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates of a wider format are longer than what they replace, so n_chars follows the text."""
    others = [c for c in docs.columns if c != "text"]
    new = replace_entities(docs.select(F.struct(*others).alias("rest"), F.char_length("text").alias("before"), "text"), key=key_of(spark))
    old = {c: F.col("rest")[c] for c in others}
    more = F.coalesce(F.char_length("text") - F.col("before"), F.lit(0))
    longer = (old["n_chars"] + more).cast(docs.schema["n_chars"].dataType)
    return new.select(*[F.col(c) if c == "text" else (longer if c == "n_chars" else old[c]).alias(c) for c in docs.columns])


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, token count, token ids and whether they decode to the text of the stage before."""
    coded = encode_documents(docs.withColumn("doc_id", F.struct("doc_id", F.xxhash64("text").alias("h"))), VOCABULARY, decode=True)
    return coded.select(
        F.col("doc_id.doc_id").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        "ids",
        (F.xxhash64("decoded") == F.col("doc_id.h")).alias("decodes"),
    )


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("PII", pii_surrogates),
    ("BPE encoding and decoding", bpe_encoding),
]

# the stages on fingerprints, surrogates and tokens have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
