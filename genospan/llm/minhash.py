"""Document fingerprints by MinHash, banded near-duplicate search, and the fingerprint of an edited text.

A signature holds, for each of several universal hash functions over 64-bit
shingle hashes, 16 bits of the smallest value, mixed first: the smallest of
many values is small, so its own top bits say little. Equal places estimate the
Jaccard similarity of two shingle sets. ``nearcopies`` joins bands of
signatures in Spark and verifies the pairs that meet on their shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parallelism
from .simhash import shingles

WORDS = 5
PLACES = 128
SEED = 42
_CHUNK = 2048


def _universal(places: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, places, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, places, dtype=np.uint64)


def signature(hashes: np.ndarray, places: int = PLACES, seed: int = SEED) -> np.ndarray:
    """16 bits a place: of the mixed min over shingles of (a*x+b) mod 2^64; an empty set gives all ones."""
    if not len(hashes):
        return np.full(places, 0xFFFF, dtype=">u2")
    a, b = _universal(places, seed)
    least = np.full(places, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(hashes), _CHUNK):
        x = hashes[at : at + _CHUNK]
        np.minimum(least, (a[:, None] * x[None, :] + b[:, None]).min(axis=1), out=least)
    return (_mixed(least) >> np.uint64(48)).astype(">u2")


def _mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64-bit values after which every bit depends on all bits."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    """Share of equal places."""
    return float((one == other).mean())


def edited(text: str, following: str) -> str:
    """The last floor(n/3) code points replaced by the first as many (or all) of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def with_next(docs: DataFrame, extra: int = 0) -> DataFrame:
    """(doc_id, text, next) in descending doc_id order; after the last comes the first.

    Rows of one id stand in order of their text's hash; null ids come last. A
    text moves once: rows are dealt by ranges of doc_id, and each range also
    gets the row that starts the following one.
    """
    spark = docs.sparkSession
    n = parallelism(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = rows.select("doc_id")
    # Descending places: bounds fall, and part i holds ids in (bounds[i], bounds[i-1]].
    bounds = sorted({int(b) for b in ids.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n)}, reverse=True) if n > 1 else []
    part = F.when(F.col("doc_id").isNull(), len(bounds)).otherwise(F.lit(len(bounds)) - _rank(bounds))
    heads = ids.groupBy(part.alias("part")).agg(F.max("doc_id").alias("head")).orderBy("part").collect()
    if not heads:
        return rows.select("doc_id", "text", F.col("text").alias("next")).limit(0)
    # head of a part -> the part before it (the last part for the first head).
    before = {r["head"]: heads[i - 1]["part"] for i, r in enumerate(heads)}

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("doc_id").to_pylist()
            also = [i for i, d in enumerate(own) if d in before]
            yield _tag(batch, batch.column("part"), 0)
            if also:
                yield _tag(batch.take(pa.array(also)), pa.array([before[own[i]] for i in also], pa.int32()), 1)

    def _tag(batch: pa.RecordBatch, to: pa.Array, guest: int) -> pa.RecordBatch:
        return pa.record_batch([to.cast(pa.int32()), pa.array([guest] * batch.num_rows, pa.int8()), batch.column("doc_id"), batch.column("text")], names=["part", "guest", "doc_id", "text"])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out: list[tuple] = []
            for now, guest, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if held is not None and held[0] == now:
                    if not held[1]:
                        out.append((held[2], held[3], text))
                    elif guest:
                        continue  # only the first guest follows the part's own rows
                held = (now, guest, doc_id, text)
            if out:
                yield pa.record_batch([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.string())], names=["doc_id", "text", "next"])

    dealt = rows.withColumn("part", part.cast("int")).mapInArrow(spread, "part int, guest byte, doc_id long, text string")
    dealt = dealt.repartitionById(len(bounds) + 1, F.col("part"))
    order = [F.col("part"), F.col("guest"), F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    return dealt.sortWithinPartitions(*order).mapInArrow(pair, "doc_id long, text string, next string")


def _rank(bounds: list[int]):
    """Number of bounds below doc_id, as a balanced tree of comparisons."""

    def tree(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("doc_id") > rising[mid], tree(mid + 1, hi)).otherwise(tree(lo, mid))

    rising = bounds[::-1]
    return tree(0, len(rising))


def edited_fingerprints(docs: DataFrame, words: int = WORDS, places: int = PLACES, seed: int = SEED) -> DataFrame:
    """Fingerprints of every text and of its edited form, with their likeness.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next). A null text is empty; texts without a word share
    one fingerprint; equal texts have equal fingerprints. One document alone is
    its own next; an empty table gives no rows. Only doc_id and text are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str, np.ndarray] | None = None
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                out = []
                for text, following in zip(part.column("text").to_pylist(), part.column("next").to_pylist(), strict=True):
                    new = edited(text, following)
                    if last is None or last[0] != text:
                        last = text, signature(shingles(text.encode(), words, seed), places, seed)
                    mine = last[1]
                    theirs = mine if new == text else signature(shingles(new.encode(), words, seed), places, seed)
                    last = following, mine if following == text else signature(shingles(following.encode(), words, seed), places, seed)
                    out.append((len(text), hashlib.sha256(new.encode()).hexdigest(), mine.tobytes().hex(), theirs.tobytes().hex(), likeness(mine, theirs), likeness(mine, last[1])))
                yield pa.record_batch([part.column("doc_id"), *(pa.array(x) for x in zip(*out, strict=True))], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return with_next(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
