"""The registered queries of the training-data operators: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm import (
    bpe, fingerprints, hnsw, importance, interpolation, manifest, minhash, mixing, oracles, quality, rendering, secrets, substrings,
    toxicity,
)
from ledgerflow.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: DuckDB SQL per query, where SQL can express it over whole tables in reasonable time.
ORACLES: dict[str, str] = {
    "op11_importance_resampling": oracles.OP11, "op13_merkle_manifest": oracles.OP13,
}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the documents that the labels call good."""
    return read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed n-gram log-likelihood ratio against the labelled good documents, with the base rules."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality_rules(docs, trusted(spark, sf_dir)).select("doc_id", "quality.*")


@query
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pattern and sliding-window entropy spans of every document."""
    return secrets.scan_secrets(read(spark, sf_dir, "documents"))


@query
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document and the bytes decoded from them, as hashes."""
    import public_tokenizers

    return bpe.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                          public_tokenizers.PATTERN)


@query
def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: 3-word shingles, similarity of 85 per cent or more."""
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, percent=85)


@query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents without the 13-word windows that a smaller doc_id has too."""
    return substrings.dedup_substrings(read(spark, sf_dir, "documents"))


@query
def op1_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigram deleted-interpolation score of every document, beside the add-0.1 unigram score."""
    return interpolation.score_texts(read(spark, sf_dir, "documents"), order=3)


@query
def op8_hnsw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors of every vector whose id is divisible by 50."""
    return hnsw.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, by a classifier trained on the label model's posterior labels."""
    return toxicity.score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op3_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in Pfair order, sources weighted by the square root of their sizes."""
    return mixing.mix_sources(read(spark, sf_dir, "documents"))


@query
def op4_html_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page, laid out."""
    return rendering.extract_text(read(spark, sf_dir, "pages"))


@query
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents drawn towards the benchmark texts' distribution of words."""
    return importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op12_one_permutation_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return fingerprints.fingerprint_pairs(read(spark, sf_dir, "documents"))


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and the root that its tampered text would give."""
    docs = read(spark, sf_dir, "documents")
    tampered, changed = manifest.without_newlines(docs)
    return manifest.manifest(docs, tampered=tampered, changed=changed)
