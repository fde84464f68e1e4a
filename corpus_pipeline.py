"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows its predecessor
kept and returns a DataFrame, which is written as Parquet and read again for the
next one.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import language, packing, secrets, simhash, suffix
from lectern.llm.common import row_hash, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


HASH = ["hash0", "hash1"]


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rows that language identification rejects: texts without a letter.

    The models learn from the ``lang`` column; a row is then judged by its whole
    text, however long, and the languages of its source.  Rows are told apart by a hash
    of all their columns, so null and repeated ids do no harm: null and empty texts go,
    equal rows share their fate.  An empty table stays empty, other columns are kept.
    """
    rows = docs.withColumn("hash", F.struct(*row_hash(docs)))
    judged = language.identify(rows, "hash", language.learn(docs), F.col("text"), host=F.col("source"))
    rejected = written(judged.filter("rejected").select("hash.*").distinct(), "rejected")
    return docs.withColumns(dict(zip(HASH, row_hash(docs)))).join(rejected, HASH, "left_anti").select(docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near copies: the one of smallest id.

    Copies are linked by the SimHash operator, with its three-word shingles of whole
    texts and at most three differing bits.  Rows, not ids, are compared: different
    texts under one id both stay, and rows with a null id stay unless a row before them is
    a copy.  Rows with equal ids stand in the order of a hash of all their columns;
    equal rows are one.  Texts without words are copies of each other.  An empty table
    stays empty.
    """
    rows = docs.withColumns(dict(zip(HASH, row_hash(docs))))
    repeated = written(simhash.repeated_rows(rows, "doc_id", tuple(HASH)), "repeated")
    # Joined one way at every size, so that work grows as the input does.
    left = rows.join(repeated.hint("merge"), HASH, "left_anti")
    twice = written(rows.groupBy(HASH).count().filter("count > 1").select(HASH), "equal-rows")
    if not twice.isEmpty():
        left = left.join(twice, HASH, "left_anti").unionByName(left.join(twice, HASH, "left_semi").dropDuplicates(HASH))
    return left.select(docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut bytes of 100-byte strings that an earlier document has from every text."""
    return suffix.rewrite(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every span the secret scan finds by a mark; all documents stay."""
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", keep_known_languages),
    ("simhash_dedup", keep_one_of_near_copies),
    ("suffix_dedup", cut_repeated_passages),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]
# Several stages cannot be said in SQL; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
