"""The training-data operators as named queries with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .byte_bpe import round_trip_digest
from .common import table
from .language_id import fit, identify
from .ngram_join import jaccard_components
from .oracle import ORACLE_SQL
from .packing import pack
from .prefix_trie import prefix_trie
from .projection_forest import near_duplicates
from .quality import quality_scores
from .quotes import conversations_without_quotes
from .ranked_search import ranked
from .secrets import fit_network, scan
from .token_files import token_file_digest
from .topk_search import top_k
from .warc_zip import package_round_trip


def op1_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages without quotes in reply order, with what they quote; nulls, repeats and ties as in quotes."""
    return conversations_without_quotes(table(spark, sf_dir, "conversations"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in its sequence; empty and null texts are the end id alone."""
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record as read back from its package; null html is an empty payload."""
    return package_round_trip(table(spark, sf_dir, "pages"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text's ids and of the bytes that they decode to; null texts are empty."""
    return round_trip_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of secrets of every text, by patterns and a network that is trained on the same table."""
    docs = table(spark, sf_dir, "documents")
    return scan(docs, fit_network(docs))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of near copies; documents without words link with nothing."""
    return jaccard_components(table(spark, sf_dir, "documents"))


def op7_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links and component within its label; unusable vectors link with nothing."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids as read back from token files; rows without doc_id take no part."""
    return token_file_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best others for every fiftieth vector; unusable vectors take no part."""
    return top_k(table(spark, sf_dir, "embeddings"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language by cross-parsing; null texts and texts without letters are und."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score; null and empty texts are scored like any other."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations; rows without conv_id take no part."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents for every benchmark item; items and documents without terms are in no result."""
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quotation_links": op1_quotation_links,
    "op2_packing": op2_packing,
    "op3_warc_packages": op3_warc_packages,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_secret_scan": op5_secret_scan,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_projection_forest": op7_projection_forest,
    "op8_token_files": op8_token_files,
    "op9_exact_top_k": op9_exact_top_k,
    "op10_language_id": op10_language_id,
    "op11_quality_classifier": op11_quality_classifier,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_ranked_search": op13_ranked_search,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
