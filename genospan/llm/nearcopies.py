"""Near copies by word shingles: candidates by SimHash balls and MinHash bands, verified by Jaccard similarity.

SimHash fingerprints that are equal form a bucket, those whose balls meet are
pairs at once; a band of a MinHash signature is a bucket, too. Fingerprints
see most copies, bands the rest (a pair at similarity 0.8 misses all 32 with a
chance of 5e-8, where three of 64 SimHash bits see few such pairs).

No bucket is paired out. Its members are first held against its smallest one,
twice; a large group of copies is joined by that at one pair a member. Buckets
that still span several components are paired out where they are small. The
members of larger ones (texts that share much but too little) are held against
one more, the one that is in most such buckets, and then paired by the rarest
of the shingles that they have and it hasn't or the other way round. Of two
similar sets that are not both similar to it, the first half or so of these, in
order of how few members differ there, must have one in common; what a whole
group shares is not among them, so a group's pairs don't grow with its square.
Pairs whose signatures agree in under 0.6 of 128 places (5.8 standard
deviations below 0.8) are not verified.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, once, stash, texts_of
from .graph import connected_components
from .minhash import PLACES, SEED, WORDS, signature
from .simhash import bits_of, near_links, shingles

BANDS = 32
LIKE = 0.8
#: Signatures below this share of equal places are too far apart for LIKE.
LIKELY = 0.6
#: A bucket of at most so many members is paired out.
SMALL = 16


def near_classes(docs: DataFrame, words: int = WORDS, like: float = LIKE, seed: int = SEED) -> DataFrame:
    """(doc_id, class_id): documents linked by a Jaccard similarity of ``like`` or more of their word shingles; smallest doc_id of the class.

    Null and blank texts are one class, repeated rows share theirs, a null
    doc_id names a class only where nothing else is in it; an empty table
    gives no rows. Only doc_id and text are read.
    """
    rooted = stash(_rooted(docs, words, like, seed), "copies-rooted")
    return rooted.join(rooted.groupBy("root").agg(F.min("doc_id").alias("class_id")), "root").select("doc_id", "class_id")


def drop_near_copies(docs: DataFrame, words: int = WORDS, like: float = LIKE, seed: int = SEED) -> DataFrame:
    """Documents with one of each class of ``near_classes``: the one whose doc_id is smallest.

    Rows that repeat the kept doc_id stay once, the one whose text hashes lowest.
    """
    rooted = stash(_rooted(docs, words, like, seed), "copies-rooted")
    kept = rooted.groupBy("root").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    ids = rooted.select(F.col("doc_id").alias("_gone")).distinct()
    gone = stash(ids.join(kept, F.col("_gone").eqNullSafe(kept["doc_id"]), "left_anti"), "copies-gone")
    return once(docs.join(bounded_broadcast(gone), docs["doc_id"].cast("long").eqNullSafe(F.col("_gone")), "left_anti"))


def _node(own: np.ndarray) -> int:
    """Name of a shingle set."""
    return int(np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), np.int64)[0])


def _signed(docs: DataFrame, words: int, seed: int) -> DataFrame:
    """(doc_id, node, sig, fp) of every row: texts with equal shingle sets are one node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, signs, fps = [], [], []
            for at in range(0, batch.num_rows, 256):
                for text in texts_of(batch.column("text").slice(at, 256)):
                    hashes = shingles(text, words, seed)
                    own = np.unique(hashes)
                    nodes.append(_node(own))
                    signs.append(signature(own, PLACES, seed).tobytes())
                    fps.append(bits_of(hashes))
            yield pa.record_batch([batch.column("doc_id"), pa.array(nodes, pa.int64()), pa.array(signs, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "node", "sig", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, node long, sig binary, fp long")


def _sets(docs: DataFrame, words: int, seed: int) -> DataFrame:
    """(node, own): shingle sets of the texts, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = [np.unique(shingles(t, words, seed)) for t in texts_of(batch.column("text").slice(at, 256))]
                yield pa.record_batch([pa.array([_node(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "own"])

    return docs.select("text").mapInArrow(run, "node long, own binary")


def _bands(unique: DataFrame, seed: int) -> DataFrame:
    """(bucket, node): a bucket a band of the signature."""
    places = PLACES // BANDS
    factors = np.random.default_rng(seed).integers(0, 1 << 63, places, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), ">u2").reshape(-1, BANDS, places).astype(np.uint64)
                key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15), sig.shape[:2]).copy()
                for i in range(places):
                    key = (key ^ sig[:, :, i]) * factors[i]
                    key ^= key >> np.uint64(29)
                yield pa.record_batch([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(part.column("node").to_numpy(zero_copy_only=False), BANDS))], names=["bucket", "node"])

    return unique.select("node", "sig").mapInArrow(run, "bucket long, node long")


def _shared(buckets: DataFrame) -> DataFrame:
    """Rows of buckets with more than one member."""
    return buckets.join(buckets.groupBy("bucket").count().where("count > 1").select("bucket"), "bucket")


def _rooted(docs: DataFrame, words: int, like: float, seed: int) -> DataFrame:
    """(doc_id, root) of every row: one root a class."""
    signed = stash(_signed(docs, words, seed), "copies-signed")
    unique = stash(signed.dropDuplicates(["node"]).select("node", "sig", "fp"), "copies-unique")
    # Equal fingerprints are a bucket; those whose balls meet are pairs of their smallest nodes.
    by_print = unique.select(F.xxhash64("fp", F.lit(seed)).alias("bucket"), "node")
    open_ = stash(_shared(by_print.union(_bands(unique, seed))), "copies-buckets")
    lead = unique.groupBy("fp").agg(F.min("node").alias("node"))
    balls = near_links(unique).join(lead.select(F.col("fp").alias("a"), F.col("node").alias("x")), "a").join(lead.select(F.col("fp").alias("b"), F.col("node").alias("y")), "b")
    balls = stash(balls.select("x", "y"), "copies-balls")
    met = open_.select("node").union(balls.select("x")).union(balls.select("y")).distinct()
    ids = signed.select("doc_id", "node").join(met, "node").groupBy("node").agg(F.min("doc_id").alias("_met"))
    ids = stash(ids.select("_met").distinct(), "copies-met")
    texts = docs.join(bounded_broadcast(ids), docs["doc_id"].cast("long").eqNullSafe(F.col("_met")), "left_semi")
    sets = stash(_sets(texts, words, seed).join(met, "node", "left_semi").dropDuplicates(["node"]), "copies-sets")

    def both(pairs: DataFrame, of: DataFrame, value: str) -> DataFrame:
        a = of.select(F.col("node").alias("x"), F.col(value).alias("a"))
        b = of.select(F.col("node").alias("y"), F.col(value).alias("b"))
        return pairs.join(a, "x").join(b, "y")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs that are similar enough."""
        near = both(pairs.distinct(), unique, "sig").mapInArrow(_keep(_agreeing), "x long, y long")
        near = stash(near, "copies-likely")
        return stash(both(near, sets, "own").mapInArrow(_keep(_similar(like)), "x long, y long"), "copies-links")

    links, rest = None, open_
    for first in (True, False):
        heads = rest.groupBy("bucket").agg(F.min("node").alias("y"))
        tried = rest.join(heads, "bucket").where("node != y").select("bucket", F.col("node").alias("x"), "y")
        good = verified(tried.select("x", "y").union(balls) if first else tried.select("x", "y"))
        links = good if links is None else links.union(good)
        if first:
            rest = stash(tried.join(good, ["x", "y"], "left_anti").select("bucket", F.col("x").alias("node")), "copies-rest")
    roots = connected_components(links, "copies-heads")
    more = verified(_across(open_, sets, roots, like))
    if more.limit(1).count():
        roots = connected_components(roots.select(F.col("node").alias("x"), F.col("root").alias("y")).union(more), "copies")
    return signed.select("doc_id", "node").join(roots, "node", "left").select("doc_id", F.coalesce("root", "node").alias("root"))


def _across(buckets: DataFrame, sets: DataFrame, roots: DataFrame, like: float) -> DataFrame:
    """Pairs (x, y) of two components that, once verified, link all that similar pairs of one bucket and two components do."""
    rooted = buckets.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    size = rooted.groupBy("bucket").agg(F.count("*").alias("size"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("bucket", "size")
    mixed = stash(rooted.join(size, "bucket"), "copies-mixed")
    pairs = _paired_out(mixed.where(F.col("size") <= SMALL))
    large = mixed.where(F.col("size") > SMALL)
    if not large.limit(1).count():
        return pairs
    # A bucket's head is the node that is in most buckets, so that buckets of one group have few heads.
    times = large.groupBy("node").agg(F.count("*").alias("times"))
    top = F.max(F.struct("times", "node", "root"))
    heads = large.join(times, "node").groupBy("bucket").agg(top.alias("h")).select("bucket", F.col("h.node").alias("head"), F.col("h.root").alias("led"))
    members = stash(large.join(heads, "bucket").where("node != head").select("head", "led", "node", "root").distinct(), "copies-members")
    led = members.where("root != led").select(F.col("node").alias("x"), F.col("head").alias("y"))
    both = members.drop("led").join(sets, "node").join(sets.select(F.col("node").alias("head"), F.col("own").alias("base")), "head")
    return pairs.union(led).union(_by_rare_shingles(both, like))


def _prefixes(n: int, base: int, size: int, like: float) -> tuple[bool, int, int]:
    """Of a set of ``n`` that differs from its head's ``base`` in ``size`` shingles: is it near, and how many of those tell its pairs.

    Sets x and y are similar if they differ in at most far * (x + y) shingles,
    so what they differ by from the head has (size + size - far * (x + y)) / 2
    in common at least. The two bounds are the least of that over all partners
    that are not near and, for a set that isn't, over all near ones.
    """
    far = (1 - like) / (1 + like)
    reach = far * (n + n / like)
    if size <= far * (n + base) + 1e-9:
        return True, size - math.floor((size + far * (base - n)) / 2 - 1e-9), 0
    apart = max(1, math.ceil(max((size + far * (base - n)) / 2, size - reach) - 1e-9))
    near = max(1, math.ceil(max((size + 1 - reach) / 2, size - reach) - 1e-9))
    return False, size - apart + 1, size - near + 1


def _by_rare_shingles(members: DataFrame, like: float) -> DataFrame:
    """Pairs (x, y), x < y, of unequal roots that share one of the rarest shingles that two similar sets can't both miss.

    ``members`` has node, root and own and, unless that is the empty set, the
    head a node is held against and its set, ``base``; members of one head
    meet. What counts is what a set and the base do not share, so the text of
    the group pairs nobody. Two sets that are similar to the base make no pair.
    """
    if "base" not in members.columns:
        members = members.withColumns({"head": F.lit(0).cast("long"), "base": F.lit(b"")})
    names = ["head", "node", "root", "n", "size", "short", "long", "near", "shingle"]

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for head, node, root, own, base in zip(*(batch.column(c).to_pylist() for c in ("head", "node", "root", "own", "base")), strict=True):
                x, y = np.frombuffer(own, np.int64), np.frombuffer(base, np.int64)
                d = np.setxor1d(x, y, assume_unique=True)
                near, short, long = _prefixes(len(x), len(y), len(d), like)
                for at in range(0, len(d), 1 << 16):
                    part = d[at : at + (1 << 16)]
                    same = [pa.array(np.full(len(part), v, np.int64)) for v in (head, node, root, len(x), len(d), short, long)]
                    yield pa.record_batch([*same, pa.array(np.full(len(part), near)), pa.array(part)], names=names)

    spelled = members.select("head", "node", "root", "own", "base").mapInArrow(spell, ", ".join(f"{c} {'boolean' if c == 'near' else 'long'}" for c in names))
    spelled = stash(spelled, "copies-spelled")
    often = spelled.groupBy("head", "shingle").agg(F.count("*").alias("often"))
    nth = F.row_number().over(Window.partitionBy("head", "node").orderBy("often", "shingle"))
    told = spelled.join(often, ["head", "shingle"]).withColumn("nth", nth).where((F.col("nth") <= F.greatest("short", "long")) & (F.col("often") > 1))
    rare = stash(told.drop("often"), "copies-rare")
    a, b = rare.where("not near").alias("a"), rare.where("nth <= short").alias("b")
    alike = (F.col("a.root") != F.col("b.root")) & (F.least("a.n", "b.n") >= like * F.greatest("a.n", "b.n") - 1e-9)
    reached = F.when(F.col("b.near"), F.col("a.nth") <= F.col("a.long")).otherwise((F.col("a.nth") <= F.col("a.short")) & (F.col("a.node") < F.col("b.node")))
    # The first shingle they share leaves no more to share than what follows it on either side.
    left = 1 + F.least(F.col("a.size") - F.col("a.nth"), F.col("b.size") - F.col("b.nth"))
    needed = (F.col("a.size") + F.col("b.size") - (1 - like) / (1 + like) * (F.col("a.n") + F.col("b.n"))) / 2
    meet = (F.col("a.head") == F.col("b.head")) & (F.col("a.shingle") == F.col("b.shingle")) & alike & reached & (left >= needed - 1e-9)
    return a.join(b, meet).select(F.least("a.node", "b.node").alias("x"), F.greatest("a.node", "b.node").alias("y"))


def _paired_out(members: DataFrame) -> DataFrame:
    """All pairs of unequal roots within each bucket; buckets are small."""
    m = members.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("node", "root"))).alias("m"))
    one = m.select("m", F.posexplode("m").alias("i", "p"))
    return one.select(F.col("p.node").alias("x"), F.col("p.root").alias("r"), F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("q")).where("r != q.root").select("x", F.col("q.node").alias("y"))


def _keep(test):
    """Pairs (x, y) whose values ``a`` and ``b`` pass the test of two columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                good = pa.array(test(batch.column("a"), batch.column("b")), pa.bool_())
                yield pa.record_batch([batch.column("x").filter(good), batch.column("y").filter(good)], names=["x", "y"])

    return run


def _agreeing(a: pa.Array, b: pa.Array) -> np.ndarray:
    one, other = (np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(-1, PLACES) for c in (a, b))
    return (one == other).mean(axis=1) >= LIKELY


def _similar(like: float):
    def run(a: pa.Array, b: pa.Array) -> list[bool]:
        good = []
        for one, other in zip(a, b, strict=True):
            x, y = np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(other.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            good.append(both >= like * (len(x) + len(y) - both))
        return good

    return run
