"""Registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.llm.bpe import encode_documents
from logwarden.llm.collocations import collocations
from logwarden.llm.decontaminate import find_leaks
from logwarden.llm.html_extract import extract_pages
from logwarden.llm.lexical_search import build_index, search
from logwarden.llm.license_scan import scan_licenses
from logwarden.llm.line_quality import measure_lines
from logwarden.llm.pii import entities_and_surrogates, key_of
from logwarden.llm.secret_scan import scan_secrets
from logwarden.llm.simhash import near_duplicates
from logwarden.llm.substring_dedup import remove_repeats
from logwarden.llm.token_files import round_trip
from logwarden.llm.warc import archive_round_trip

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_table(spark, sf_dir, "documents"))


def op4_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("_key")


def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(_table(spark, sf_dir, "pages"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure_lines(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = encode_documents(_table(spark, sf_dir, "documents"), path, decode=True)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities_and_surrogates(_table(spark, sf_dir, "documents").select("doc_id", "text"), key=key_of(spark))


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_table(spark, sf_dir, "pages"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_simhash_near_duplicates,
        op2_token_files,
        op3_secret_scan,
        op4_benchmark_leaks,
        op5_warc_round_trip,
        op6_substring_dedup,
        op7_line_quality,
        op8_license_scan,
        op9_bpe_round_trip,
        op10_pii_surrogates,
        op11_main_text,
        op12_collocations,
        op13_lexical_search,
    )
}
