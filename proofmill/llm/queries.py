"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.llm import oracles
from proofmill.llm.alignment import align_tokens
from proofmill.llm.chat import preference_pairs, swapped_answers
from proofmill.llm.decontaminate import find_leaks
from proofmill.llm.importance import importance_draw
from proofmill.llm.jaccard import jaccard_components
from proofmill.llm.licenses import scan_licenses
from proofmill.llm.mixing import mix_sources
from proofmill.llm.perplexity import judge
from proofmill.llm.quality import score_quality
from proofmill.llm.secrets import find_secrets
from proofmill.llm.substrings import remove_repeats
from proofmill.llm.tokens import count_tokens
from proofmill.llm.vectors import near_vectors
from proofmill.tables import read_table

TOKENIZER, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation against itself with another's last answer, as prompt and two masked completions."""
    turns = read_table(spark, sf_dir, "conversations")
    return preference_pairs(turns, swapped_answers(turns), "conv_id")


def op2_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item."""
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_quality_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document. The cache is new at each call, so a timing is of the whole work."""
    import public_tokenizers

    return count_tokens(read_table(spark, sf_dir, "documents"), Path(public_tokenizers.path(TOKENIZER)).read_bytes(), "json")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return find_secrets(read_table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in every document."""
    return scan_licenses(read_table(spark, sf_dir, "documents"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document in the mix."""
    return mix_sources(read_table(spark, sf_dir, "documents"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of every vector."""
    return near_vectors(read_table(spark, sf_dir, "embeddings"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated words removed from every document."""
    return remove_repeats(read_table(spark, sf_dir, "documents"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles and component of every document."""
    return jaccard_components(read_table(spark, sf_dir, "documents"))


def op11_importance_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document in a draw towards the benchmark's words."""
    return importance_draw(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, perplexity and verdict of every document."""
    return judge(read_table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers' tokens in every document."""
    import public_tokenizers

    return align_tokens(read_table(spark, sf_dir, "documents"), *(Path(public_tokenizers.path(name)).read_bytes() for name in (TOKENIZER, PIECES)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_preference_format": op1_preference_format,
        "op2_benchmark_leaks": op2_benchmark_leaks,
        "op3_quality_vote": op3_quality_vote,
        "op4_token_counts": op4_token_counts,
        "op5_secret_scan": op5_secret_scan,
        "op6_license_scan": op6_license_scan,
        "op7_source_mix": op7_source_mix,
        "op8_embedding_near_dedup": op8_embedding_near_dedup,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_ngram_jaccard": op10_ngram_jaccard,
        "op11_importance_draw": op11_importance_draw,
        "op12_quality_rules": op12_quality_rules,
        "op13_token_alignment": op13_token_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
