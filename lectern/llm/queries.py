"""The registered query of each corpus operator; each takes ``(spark, sf_dir)``."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import ann, bpe, codes, itq, language, mixing, packing, quality, quotes, secrets, simhash, suffix, trie
from lectern.llm.common import tables

Query = Callable[[SparkSession, str], DataFrame]
RANKS = "byte_bpe_50k.tiktoken"


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document; trees learnt from the training folds of the labels."""
    documents, labels = tables(spark, sf_dir, "documents", "labels")
    return quality.classify(documents, labels)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every web page, with text models learnt from the documents."""
    documents, pages = tables(spark, sf_dir, "documents", "pages")
    return language.identify_pages(pages, language.learn(documents))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every 20th vector."""
    (embeddings,) = tables(spark, sf_dir, "embeddings")
    return ann.search(embeddings, every=20)


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document when bytes that repeat earlier ones go."""
    (documents,) = tables(spark, sf_dir, "documents")
    return suffix.deduplicate(documents).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op5_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message without quotes, in reply order."""
    (messages,) = tables(spark, sf_dir, "conversations")
    return quotes.conversations(messages)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document, with digests of ids and bytes."""
    (documents,) = tables(spark, sf_dir, "documents")
    return bpe.round_trip(documents, public_tokenizers.path(RANKS))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    (documents,) = tables(spark, sf_dir, "documents")
    return simhash.near_duplicates(documents)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 2048 tokens."""
    (documents,) = tables(spark, sf_dir, "documents")
    return packing.pack(documents, public_tokenizers.path(RANKS))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    (documents,) = tables(spark, sf_dir, "documents")
    return secrets.scan(documents).select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2("base_spans", 256).alias("base_sha256"), "spans",
    )


def op10_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and representative of every vector."""
    (embeddings,) = tables(spark, sf_dir, "embeddings")
    return itq.near_duplicates(embeddings)


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, rebuilt with shared first turns."""
    (messages,) = tables(spark, sf_dir, "conversations")
    return trie.build(messages, trie.with_heads)


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix of sources takes every document."""
    (documents,) = tables(spark, sf_dir, "documents")
    return mixing.mix(documents)


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product code and error of every vector."""
    (embeddings,) = tables(spark, sf_dir, "embeddings")
    return codes.compress(embeddings)


QUERIES: dict[str, Query] = {
    "op1_quality": op1_quality,
    "op2_language": op2_language,
    "op3_ann": op3_ann,
    "op4_suffix": op4_suffix,
    "op5_quotes": op5_quotes,
    "op6_bpe": op6_bpe,
    "op7_simhash": op7_simhash,
    "op8_packing": op8_packing,
    "op9_secrets": op9_secrets,
    "op10_itq": op10_itq,
    "op11_trie": op11_trie,
    "op12_mixing": op12_mixing,
    "op13_codes": op13_codes,
}
# The others cannot be said in SQL; the tests hold them against brute force.
ORACLE: dict[str, str] = {
    "op4_suffix": suffix.SQL,
    "op5_quotes": quotes.SQL,
    "op10_itq": itq.SQL,
    "op11_trie": trie.SQL,
    "op13_codes": codes.SQL,
}
