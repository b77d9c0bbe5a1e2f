"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seapoint.llm import oracle
from seapoint.llm.bpe import token_digests
from seapoint.llm.decontamination import benchmark_hits
from seapoint.llm.html_text import extract_text
from seapoint.llm.language_id import identify_languages
from seapoint.llm.lm_scoring import score_documents
from seapoint.llm.mixing import document_rates
from seapoint.llm.periodic_runs import run_digests
from seapoint.llm.pii import personal_data
from seapoint.llm.shingle_join import link_documents
from seapoint.llm.substring_dedup import remove_repeats
from seapoint.llm.token_alignment import align_tokens
from seapoint.llm.vector_join import link_vectors
from seapoint.llm.warc import archive_round_trip

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = benchmark_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def _warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(_table(spark, sf_dir, "pages")).drop("url")


def queries() -> dict[str, Query]:
    return {
        "op1_substring_dedup": lambda spark, sf_dir: remove_repeats(_table(spark, sf_dir, "documents")),
        "op2_benchmark_decontamination": _decontamination,
        "op3_warc": _warc,
        "op4_html_extraction": lambda spark, sf_dir: extract_text(_table(spark, sf_dir, "pages")),
        "op5_source_mixing": lambda spark, sf_dir: document_rates(
            _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
        ),
        "op6_language_id": lambda spark, sf_dir: identify_languages(_table(spark, sf_dir, "documents")),
        "op7_lm_scoring": lambda spark, sf_dir: score_documents(_table(spark, sf_dir, "documents")),
        "op8_ngram_jaccard_join": lambda spark, sf_dir: link_documents(_table(spark, sf_dir, "documents")),
        "op9_pii": lambda spark, sf_dir: personal_data(_table(spark, sf_dir, "documents")),
        "op10_embedding_near_dedup": lambda spark, sf_dir: link_vectors(_table(spark, sf_dir, "embeddings")),
        "op11_token_alignment": lambda spark, sf_dir: align_tokens(
            _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
        ),
        "op12_periodic_runs": lambda spark, sf_dir: run_digests(_table(spark, sf_dir, "documents")),
        "op13_byte_bpe": lambda spark, sf_dir: token_digests(
            _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
        ),
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
