"""SimHash near-duplicates, found by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most ``2r + 1`` bits meet in the balls of
radius ``r`` around them once a bit that differs is out of sight. The 64 bits
are cut into three blocks. With one block masked, every fingerprint emits all
variants within half the remaining radius (itself and each single-bit flip);
for a pair within 3 bits some mask leaves at most 2 differing bits, unless all
three lie in one block, and then both emit the same unflipped variant under
that block's mask. The variants are shuffled, and pairs that collide are
deduplicated and verified: that is 132 variants a fingerprint, where the plain
radius-2 ball has 2081.

Inside a bucket no pair list is built. Members of one bucket differ in at most
two unmasked bits, so those with equal masked bits are chained, and masked
contents one bit apart are looked up, which is linear in the bucket. Contents
three bits apart matter only for members that agree in every unmasked bit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components_of, keep_once, parallelism, stash, texts_of
from .graph import connected_components

#: (first bit, bits) of the blocks that are masked in turn.
BLOCKS = ((0, 21), (21, 21), (42, 22))
RADIUS = 3
_FULL = (1 << 64) - 1
_CHUNK = 1 << 16
#: Bytes of a text that are cut into words at once.
_PIECE = 1 << 18


def shingles(text: bytes, words: int = 5, seed: int = 42) -> np.ndarray:
    """64-bit hashes of the word shingles of a lower-cased (A-Z) text, repeats included; too few words: the whole sequence; none: empty.

    A long text is cut into words piece by piece; each piece takes the last words of the one before along.
    """
    digest = xxhash.xxh64_intdigest
    parts, carried, at = [], [], 0
    while at < len(text):
        end = _word_end(text, at + _PIECE)
        tokens = carried + text[at:end].lower().split()
        at = end
        if len(tokens) >= words:
            line = b" ".join(tokens)
            ends = list(accumulate(len(t) + 1 for t in tokens))
            parts.append(np.array([digest(line[s : e - 1], seed) for s, e in zip([0, *ends], ends[words - 1 :], strict=False)], dtype=np.uint64))
            carried = tokens[len(tokens) - words + 1 :]
        else:
            carried = tokens
    if parts:
        return np.concatenate(parts) if len(parts) > 1 else parts[0]
    return np.array([digest(b" ".join(carried), seed)] if carried else [], dtype=np.uint64)


_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _word_end(text: bytes, at: int) -> int:
    """The first place from ``at`` on that is between words, or the end."""
    if at >= len(text):
        return len(text)
    found = _BLANK.search(text, at)
    return found.start() if found else len(text)


def bits_of(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes; none give 0."""
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), _CHUNK):
        part = hashes[i : i + _CHUNK].astype(">u8").view(np.uint8)
        counts += np.unpackbits(part.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of a UTF-8 text, repeats counted; no word gives 0."""
    return bits_of(shingles(text, words, seed))


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of every document; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, words, seed) for t in texts_of(batch.column(1))], dtype=np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _mask(block: int) -> int:
    first, bits = BLOCKS[block]
    return ((1 << bits) - 1) << first


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(fps), 4096):
            fp = fps[at : at + 4096]
            for block in range(len(BLOCKS)):
                seen = _FULL ^ _mask(block)
                flips = np.array([0, *(1 << j for j in range(64) if seen >> j & 1)], dtype=np.uint64)
                variants = (fp & np.uint64(seen))[:, None] ^ flips[None, :]
                n = variants.size
                yield pa.record_batch(
                    [
                        pa.array(np.full(n, block, dtype=np.int8)),
                        pa.array(variants.ravel().view(np.int64)),
                        pa.array(np.repeat(fp, len(flips)).view(np.int64)),
                    ],
                    names=["block", "variant", "fp"],
                )


def _triples(group: np.ndarray, x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of equal group whose x differ in exactly 3 bits; (group, x) is sorted and has no repeats."""
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    key = (group << np.int64(bits)) | x
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    for s, n in zip(starts[sizes > 1], sizes[sizes > 1], strict=True):
        own = x[s : s + n]
        if n <= 1024:
            i, j = np.nonzero(np.triu(np.bitwise_count(own[:, None] ^ own[None, :]) == 3, 1))
            left.append(s + i)
            right.append(s + j)
        else:
            for three in combinations(range(bits), 3):
                want = key[s : s + n] ^ np.int64(sum(1 << b for b in three))
                at = np.searchsorted(key[s : s + n], want)
                hit = np.flatnonzero((at < n) & (key[s + np.minimum(at, n - 1)] == want))
                left.append(s + hit)
                right.append(s + at[hit])
    return np.concatenate(left), np.concatenate(right)


def links_in(block: int, variant: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the same components as all links within each bucket (equal ``variant``)."""
    first, bits = BLOCKS[block]
    order = np.argsort(variant, kind="stable")
    variant, fp = variant[order], fp[order]
    group = np.cumsum(np.r_[False, variant[1:] != variant[:-1]]).astype(np.int64)
    x = ((fp >> np.uint64(first)) & np.uint64((1 << bits) - 1)).astype(np.int64)
    order = np.lexsort((fp, x, group))
    variant, fp, group, x = variant[order], fp[order], group[order], x[order]
    same = np.flatnonzero((group[1:] == group[:-1]) & (x[1:] == x[:-1]))
    left, right = [fp[same]], [fp[same + 1]]
    lead = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (x[1:] != x[:-1])])
    key = (group[lead] << np.int64(bits)) | x[lead]
    for bit in range(bits):
        want = key ^ np.int64(1 << bit)
        at = np.minimum(np.searchsorted(key, want), len(key) - 1)
        hit = np.flatnonzero((key[at] == want) & (want > key))
        left.append(fp[lead[hit]])
        right.append(fp[lead[at[hit]]])
    plain = np.flatnonzero((fp & np.uint64(_FULL ^ _mask(block))) == variant)
    i, j = _triples(group[plain], x[plain], bits) if len(plain) else ([], [])
    left.append(fp[plain[i]] if len(plain) else fp[:0])
    right.append(fp[plain[j]] if len(plain) else fp[:0])
    a, b = np.concatenate(left), np.concatenate(right)
    near = np.bitwise_count(a ^ b) <= RADIUS  # verification
    return a[near], b[near]


def _collide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (block, variant); the last bucket of a batch waits for the next batch."""
    held: list[np.ndarray] = [np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)]

    def solve(block: np.ndarray, variant: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        ab = [[np.empty(0, np.uint64)], [np.empty(0, np.uint64)]]
        for k in range(len(BLOCKS)):
            v, f = variant[block == k], fp[block == k]
            if len(v) > 1:
                again = v[1:] == v[:-1]
                shared = np.r_[again, False] | np.r_[False, again]
                if shared.any():
                    for to, got in zip(ab, links_in(k, v[shared], f[shared]), strict=True):
                        to.append(got)
        a, b = (np.concatenate(x) for x in ab)
        if len(a):
            node, root = components_of(a, b)
            yield pa.record_batch(
                [pa.array(node[node != root].view(np.int64)), pa.array(root[node != root].view(np.int64))], names=["a", "b"]
            )

    for batch in batches:
        new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        cols = [
            np.concatenate([held[0], new[0].astype(np.int64)]),
            np.concatenate([held[1], new[1].view(np.uint64)]),
            np.concatenate([held[2], new[2].view(np.uint64)]),
        ]
        if not len(cols[0]):
            continue
        last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
        cut = len(last) - int(last[::-1].argmin()) if not last.all() else 0
        yield from solve(*(c[:cut] for c in cols))
        held = [c[cut:] for c in cols]
    yield from solve(*held)


def near_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints that span every component of "3 or fewer bits differ"."""
    n = parallelism(fps.sparkSession)
    spread = fps.select("fp").where("fp is not null").distinct().mapInArrow(_variants, "block byte, variant long, fp long")
    return spread.repartition(n, "block", "variant").sortWithinPartitions("block", "variant").mapInArrow(_collide, "a long, b long")


def simhash_components(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """SimHash class of every document: (doc_id, fingerprint, component_id).

    Null or blank texts have fingerprint zero and are linked like any other;
    repeated rows share a class; a null doc_id is kept and never names a class
    unless nothing else is in it; an empty table gives no rows. Only doc_id
    and text are read, so further columns cannot clash.
    """
    fps = stash(fingerprints(docs, words, seed), "simhash-fp")
    by_fp = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = connected_components(near_links(fps), "simhash")
    rooted = by_fp.join(roots, by_fp.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    rooted = stash(rooted, "simhash-roots")
    named = rooted.join(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("fp", "component_id")
    return fps.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_copies(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """Documents with one of each SimHash class: the one whose doc_id is smallest.

    Rows that repeat the kept doc_id stay once, the one whose text hashes lowest.
    """
    return keep_once(docs, simhash_components(docs, words, seed).where("doc_id <=> component_id").select("doc_id"))
