"""Registered queries of the subpackage: ``queries()`` and ``oracle_sql()``."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ann, byte_bpe, divergence, fingerprints, licenses, ngram_lm, packing, retrieval_packing, simhash, suffix_dedup, token_files, toxicity, vector_codes
from .common import table

WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts, and their likeness."""
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op2_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all documents' token pieces in sequences of 2048."""
    return packing.pattern_packing(table(spark, sf_dir, "documents"), WORD_VOCABULARY)


def op3_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical digests of all documents, and the licences that whole texts are."""
    return licenses.license_scan(table(spark, sf_dir, "documents"), licenses.known_digests(spark))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from the labels outside the held-out third."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of all documents and back."""
    return byte_bpe.byte_bpe_round_trip(table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)


def op6_cross_polytope_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all embeddings to every hundredth."""
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op7_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the components that near fingerprints form."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents that a 100-byte passage which also starts earlier covers."""
    return suffix_dedup.repeated_bytes(table(spark, sf_dir, "documents"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents under a model of those outside the held-out seventh."""
    return ngram_lm.language_model_scores(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole document, written to bit-packed files and read back."""
    return token_files.token_files(table(spark, sf_dir, "documents"), WORD_VOCABULARY)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the term shares of each source are from its lang's other sources, and its own terms."""
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings' parts and their errors."""
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


def op13_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all documents' token pieces in sequences of documents that share words."""
    return retrieval_packing.retrieval_packing(table(spark, sf_dir, "documents"), WORD_VOCABULARY)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_iblt_fingerprints, op2_pattern_packing, op3_license_digests, op4_toxicity, op5_byte_bpe, op6_cross_polytope_ann, op7_simhash_vptree, op8_suffix_dedup, op9_lm_scores, op10_token_files,
           op11_source_divergence, op12_vector_codes, op13_retrieval_packing)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op3_license_digests": licenses.oracle_sql(), "op11_source_divergence": divergence.oracle_sql(),
            "op12_vector_codes": vector_codes.oracle_sql()}
