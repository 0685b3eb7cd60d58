"""The queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import additive, alignment, candidates, gam, interactions, minhash, mixing, ogg, oracles, packing, perplexity, suffixes, tagpaths, viterbi
from .common import table


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file is."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_ogg_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.store_texts(table(spark, sf_dir, "documents"), keep_media=False)


def op2_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), keep_ids=False)


def op3_gam_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gam.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_viterbi_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viterbi.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), keep=False)


def op6_tag_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagpaths.extract(table(spark, sf_dir, "pages"))


def op7_additive_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive.nearest(table(spark, sf_dir, "embeddings"))


def op8_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_bottom_k_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op10_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_boosted_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.digest(candidates.find(table(spark, sf_dir, "documents")))


def op12_subset_zeta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.filter_interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_bitset_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.cross_tokenizer(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_ogg_payload, op2_nnls_packing, op3_gam_quality, op4_viterbi_counts, op5_suffix_dedup, op6_tag_path_text, op7_additive_nearest, op8_pivotal_mixing, op9_bottom_k_near_dedup, op10_cross_entropy_difference, op11_boosted_candidates, op12_subset_zeta, op13_bitset_alignment)}
ORACLE_SQL: dict[str, str] = oracles.SQL
