"""Corpus pipeline: documents through five stages, each written as Parquet and read again.

1. language ID: documents whose language is not identified go;
2. SimHash near-dedup: classes of SimHash fingerprints of five-word shingles,
   and MinHash bands for what three bits can't see, give candidates; of
   documents linked by a Jaccard similarity of 0.8 or more one stays, the
   smallest doc_id;
3. suffix-array dedup: passages of 100 bytes or more that also start earlier
   are cut from the texts, and a text that is left without a word goes;
4. mixing: every document stands as often as the mix takes it;
5. SentencePiece: ids and decoded digests of what is left.

All but the last stage return the columns of documents. ``n_chars`` follows
the text where a stage changes it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genospan.llm import langid, mixing, nearcopies, pieces, repeats
from genospan.llm.common import scratch
from genospan.llm.queries import PIECES, vocabulary
from genospan.plans.runtime import importable

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return nearcopies.drop_near_copies(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return repeats.cut_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return mixing.apply_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return pieces.encode_documents(docs, vocabulary(PIECES), digests=True)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", passage_dedup),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode),
]

#: SQL has no bundled vectors, SimHash balls or SentencePiece; tests hold run() against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents table."""
    docs = importable(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
