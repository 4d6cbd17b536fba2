"""A training corpus from documents: quality, near copies, benchmark passages, secrets, tokens.

Each stage takes what its predecessor kept; all but the last return the columns of documents.

Defined results: a null or empty text is scored for quality as the empty text, has no near copies, no
benchmark passage, no secret and no tokens; texts of any length are taken whole. Of near copies (five
words, 0.8) the smallest doc_id stays, of equal rows one; rows with a null doc_id are never near copies.
All copies of a text in which a window of a benchmark item occurs go, also those of one doc_id. Further columns of
documents are kept as they are, whatever their names; those named like what the last stage adds
(n_tokens, ids_sha256, decoded_sha256) are replaced there. Empty documents give an empty result;
without labels every score is 0.5, and all documents stay; without benchmark items none are dropped there.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import bpe, decontam, minhash, quality, secrets
from riskloom.llm.common import shared_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each group of near copies (similarity 0.8 or more)."""
    return minhash.representatives(docs, percent=80)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which a window of a benchmark item occurs."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each secret in the texts by the name of its kind."""
    return secrets.redacted(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the texts; the columns of documents with n_tokens, ids_sha256 and decoded_sha256."""
    return bpe.tokenized(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_copies_stage),
    ("benchmark decontamination", benchmark_stage),
    ("secret scans", secrets_stage),
    ("byte-level BPE", tokens_stage),
]

#: SQL has no boosted trees and no byte-pair merges; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex[:12]}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{top}/{k}")
        docs = spark.read.parquet(f"{top}/{k}")
    return docs
