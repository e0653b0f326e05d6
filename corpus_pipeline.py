"""The corpus pipeline: five stages over ``documents``, each a training-data operator.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again
as the next stage's ``docs``. All but the last keep the columns of ``docs``. Null and empty
texts, ties, repeated rows, null ids and other columns are taken as each stage says; an empty
table goes through all stages as an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ledgerflow.llm import bpe, minhash, mixing, quality, secrets
from ledgerflow.llm.common import read, remove, temporary
from ledgerflow.session import work_dir

#: SQL cannot express the stages (trained statistics, hashes, a schedule, merges): tests/llm checks each
#: against a brute-force version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood-ratio threshold. The trusted text is that of the
    labelled good documents. Null, empty and short texts fail the base rules; rows that repeat are judged alike;
    rows with a null id are judged like others."""
    trusted = read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality.kept_documents(docs, trusted)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates: five-word shingles, 80 per cent.
    A text of fewer words is one shingle; documents without words are in no group and stay."""
    return minhash.drop_near_duplicates(docs, shingle=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and ``n_chars`` brought up to date. Null texts stay null."""
    return secrets.mask_secrets(docs)


def mixing_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture (sources weighted by the square root of their sizes). A null
    source is one of its own; every row is placed once, repeated ones and those of null ids too."""
    return mixing.in_mixed_order(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, valid, position) of every document: ``position`` counts
    the documents before it in the mixture that the stage before wrote. A null text has no tokens."""
    import public_tokenizers

    return bpe.round_trip(mixing.written_order(docs), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                          public_tokenizers.PATTERN, keep=("position",))


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", mixing_order),
    ("byte-level BPE encoding and decoding", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written in the shared work folder and read again.

    Tables that a stage stored on its way are deleted once its result is written, and so is its input, unless that
    is ``documents``. The table that the last stage reads stays."""
    docs = read(spark, sf_dir, "documents")
    folder = work_dir(spark, "llm", f"pipeline-{uuid.uuid4().hex}")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        with temporary(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        if i:
            remove(spark, f"{folder}/{i - 1}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
