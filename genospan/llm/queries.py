"""Queries opN_<name>: each operator over its whole table, digested to the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import langid, minhash, mixing, neighbours, pieces, repeats, simhash, tokencount, tokenfile, toxicity
from .common import table
from .mixing_sql import mix_sql
from .repeats_sql import repeats_sql

BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file, on this host and on the executors alike."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_curve_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_digests(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), vocabulary(BYTE_BPE))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_digests(table(spark, sf_dir, "documents"), vocabulary(BYTE_BPE))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"), vocabulary(PIECES), digests=True)


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.edited_fingerprints(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_curve_neighbours, op2_suffix_array_dedup, op3_token_counts, op4_token_files, op5_mix_sources, op6_toxicity, op7_sentencepiece, op8_simhash_near_dedup, op9_language_id, op10_minhash_fingerprints)}

#: DuckDB SQL of those queries that SQL can express.
ORACLE_SQL: dict[str, str] = {"op2_suffix_array_dedup": repeats_sql(), "op5_mix_sources": mix_sql()}
