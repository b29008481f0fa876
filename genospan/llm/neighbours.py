"""Approximate nearest neighbours on shifted space-filling curves.

Vectors are projected to a few random directions, several times over; each
projection, shifted by a random offset, is put on a Hilbert curve, which gives
several orderings of the same vectors. All orderings are range-partitioned and
sorted together, cut into blocks of consecutive keys, and a query looks into
the blocks around its own place on every curve; what it finds there is merged
and ranked by exact distance on the original vectors.

How many blocks to look into is not fixed. For a bounded sample of queries the
true neighbours are found by brute force, in blocks, and the window is the
smallest that reaches ``recall`` of them. On vectors with structure it stays
near the query; on vectors without (such as uniform noise in many dimensions)
no ordering keeps neighbours together and the window grows to what recall needs.

Equal vectors are one entry of the index that knows its smallest ids: copies
never crowd a block, and none that could be among a query's neighbours is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parallelism, sampled, stash

CURVES = 6
PROJECTED = 8
BITS = 4
BLOCK = 512
#: Most blocks joined into one task's group, which bounds its memory.
MOST_BLOCKS = 32
RECALL = 0.95
#: Rows that scales are fitted on, and queries that the window is fitted on, at most about.
FIT_ROWS = 10_000
FIT_QUERIES = 96
SEED = 42
#: Queries in one group, at most about.
MOST_QUERIES = 20_000


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of rows of unsigned cell coordinates, most significant bits first.

    The coordinates become the curve's transposed index by undoing, from the
    top bit down, the exchanges and inversions of each level, and a Gray
    decode; the index is read off bit plane by bit plane.
    """
    x = cells.astype(np.uint64).T.copy()
    n = len(x)
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        bit, low = one << np.uint64(level), (one << np.uint64(level)) - one
        for i in range(n):
            high = (x[i] & bit) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        bit = one << np.uint64(level)
        flip ^= np.where((x[n - 1] & bit) != 0, bit - one, np.uint64(0))
    x ^= flip
    key = np.zeros(x.shape[1], dtype=np.uint64)
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << one | (x[i] >> np.uint64(level) & one)
    return key


class Curves:
    """The fitted curves: a centre, and per curve directions, scales and a shift."""

    def __init__(self, sample: np.ndarray, curves: int = CURVES, projected: int = PROJECTED, bits: int = BITS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        self.bits = bits
        self.centre = sample.mean(axis=0)
        self.direction = [np.linalg.qr(rng.standard_normal((dim, dim)))[0][:, : min(projected, dim)] for _ in range(curves)]
        self.shift = [rng.random(min(projected, dim)) for _ in range(curves)]
        self.scale = [np.maximum(((sample - self.centre) @ d).std(axis=0), 1e-12) for d in self.direction]

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """(curves, rows) of signed keys."""
        out = []
        for d, shift, scale in zip(self.direction, self.shift, self.scale, strict=True):
            z = (vectors - self.centre) @ d / scale
            even = 1 / (1 + np.exp(-1.702 * z))  # about the normal distribution function: cells hold alike many rows
            cells = np.floor((even * 0.75 + 0.25 * shift) * (1 << self.bits)).clip(0, (1 << self.bits) - 1)
            out.append(hilbert_keys(cells, self.bits).view(np.int64))
        return np.stack(out)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64)


def usable(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v) without vectors that are null, zero, or hold null or non-finite components; v is array<double>."""
    v = F.col("v")
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where(v.isNotNull() & F.coalesce(fine, F.lit(False)))


def _nearest(q: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, exact distance) of all pairs as near as each query's k-th nearest candidate, ties and near ties included."""
    squares, own = (c * c).sum(axis=1)[None], (q * q).sum(axis=1)[:, None]
    square = own - 2 * q @ c.T + squares
    if k < len(c):
        # Rounding of the expanded square is far below this share of its terms.
        margin = 1e-12 * (own[:, 0] + squares.max()) + 1e-300
        limit = np.partition(square, k - 1, axis=1)[:, k - 1] + margin
        i, j = np.nonzero(square <= limit[:, None])
    else:
        i, j = np.divmod(np.arange(len(q) * len(c)), max(len(c), 1))
    d = np.empty(len(i))
    for at in range(0, len(i), 1 << 16):
        part = slice(at, at + (1 << 16))
        diff = q[i[part]] - c[j[part]]
        d[part] = np.sqrt((diff * diff).sum(axis=1))
    return i, j, d


def _first_k(i: np.ndarray, d: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k first pairs by (distance, tie)."""
    order = np.lexsort((tie, d, i))
    i = i[order]
    nth = np.arange(len(i)) - np.searchsorted(i, i, side="left")
    return order[nth < k]


def search(table: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for rows whose id is divisible by ``every``.

    Distance is Euclidean in double precision; ties go to the smaller id; the
    query's own row is no candidate, its equal copies under other ids are.
    Vectors of another length than most have no distance to the rest and take
    no part; rows that repeat id and vector are one row; a null id is neither
    query nor candidate; fewer candidates than k give fewer rows; an empty
    table gives none. Only the two columns are read.
    """
    spark = table.sparkSession
    rows = usable(table, id_col, vec_col).where("id is not null")
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sizes:
        return empty
    dim, total = sizes[0]["n"], sizes[0]["count"]
    rows = rows.where(F.size("v") == dim).distinct()
    # One entry a distinct vector, with the k+1 smallest ids (the limit is applied before the shuffle, too).
    vector = rows.withColumn("h", F.xxhash64("v"))
    nth = F.row_number().over(Window.partitionBy("h", "v").orderBy("id"))
    ids = vector.withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("h", "v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    asked = vector.where(F.col("id") % every == 0).select("h", "v").distinct().withColumn("asked", F.lit(True))
    entries = ids.join(asked, ["h", "v"], "left").select(F.xxhash64("h", F.element_at("ids", 1)).alias("e"), "v", "ids", F.coalesce("asked", F.lit(False)).alias("asked"))
    entries = stash(entries, "ann-entries")
    sample = entries.where(sampled(FIT_ROWS / total, SEED, "e")).select("v").limit(2 * FIT_ROWS).toPandas()["v"]
    curves = Curves(np.stack([np.asarray(x) for x in sample]) if len(sample) else np.eye(dim))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for c, keys in enumerate(curves.keys(_matrix(batch.column("v")))):
                yield pa.record_batch([pa.array(np.full(len(keys), c, np.int32)), pa.array(keys), *batch.columns], names=["curve", "key", *batch.schema.names])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            curve = batch.column("curve").to_numpy(zero_copy_only=False)
            at = np.empty(len(curve), dtype=np.int64)
            for c in np.unique(curve):
                own = np.flatnonzero(curve == c)
                at[own] = seen.get(int(c), 0) + np.arange(len(own))
                seen[int(c)] = seen.get(int(c), 0) + len(own)
            yield pa.record_batch([*batch.columns, pa.array(at // BLOCK)], names=[*batch.schema.names, "local"])

    n = parallelism(spark)
    laid = entries.mapInArrow(place, "curve int, key long, e long, v array<double>, ids array<long>, asked boolean")
    laid = laid.repartitionByRange(n, "curve", "key", "e").sortWithinPartitions("curve", "key", "e")
    laid = laid.mapInArrow(blocks, "curve int, key long, e long, v array<double>, ids array<long>, asked boolean, local long").withColumn("part", F.spark_partition_id())
    laid = stash(laid, "ann-laid")
    # Number the blocks along each curve: partitions times curves rows come to the driver.
    count = laid.groupBy("curve", "part").agg((F.max("local") + 1).alias("blocks")).orderBy("curve", "part").collect()
    offset, ends = {}, {}
    for r in count:
        offset[r.curve, r.part] = ends.get(r.curve, 0)
        ends[r.curve] = ends.get(r.curve, 0) + r.blocks
    numbers = spark.createDataFrame([(c, p, o, ends[c]) for (c, p), o in offset.items()], "curve int, part int, first long, blocks long")
    laid = laid.join(numbers, ["curve", "part"]).withColumn("block", F.col("first") + F.col("local"))
    width = _window(laid, entries, k, recall, max(ends.values()))

    # Blocks are joined to about half the window, so a query asks a handful of them however wide it is.
    coarse = max(1, min(MOST_BLOCKS, width // 2))
    unit = lambda b: F.floor(b / coarse)
    reach = F.sequence(unit(F.greatest(F.lit(0), F.col("block") - width)), unit(F.least(F.col("blocks") - 1, F.col("block") + width)))
    # A group holds at most about MOST_QUERIES queries: they are dealt to as many parts as that takes, each with the block's candidates.
    waiting = laid.where("asked").groupBy("curve", unit(F.col("block")).alias("b")).count().agg(F.max("count")).first()[0] or 0
    parts = max(1, -(-waiting * (2 * width // coarse + 2) // MOST_QUERIES))
    asking = laid.where("asked").select(F.col("curve").alias("q_curve"), F.explode(reach).alias("q_block"), F.pmod("e", F.lit(parts)).alias("q_part"), F.col("e").alias("q"), F.col("v").alias("q_v"))
    standing = laid.select(F.col("curve").alias("c_curve"), unit(F.col("block")).alias("c_block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("c_part"), F.col("e").alias("c"), F.element_at("ids", 1).alias("c_first"), F.col("v").alias("c_v"))
    found = standing.groupBy("c_curve", "c_block", "c_part").cogroup(asking.groupBy("q_curve", "q_block", "q_part")).applyInPandas(_rank_block(k + 1), "q long, c long, first long, d double")
    best = found.distinct().withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy("d", "first"))).where(F.col("nth") <= k + 1)
    named = best.join(entries.select(F.col("e").alias("c"), F.explode("ids").alias("vec_id")), "c").select("q", "d", "vec_id")
    top = named.withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy("d", "vec_id"))).where(F.col("nth") <= k + 1).select("q", "d", "vec_id")
    queries = vector.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "h", "v")
    keyed = queries.join(entries.where("asked").select(F.col("e").alias("q"), "v", F.xxhash64("v").alias("h")), ["h", "v"]).select("query_id", "q")
    mine = keyed.join(top, "q").where("query_id != vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "vec_id"))
    return mine.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("d").alias("score"))


def _rank_block(k: int):
    """The k nearest entries of a block for each query that asks it, ties to the smaller first id."""

    def run(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        empty = np.empty(0, np.int64)
        if candidates.empty or queries.empty:
            return pd.DataFrame({"q": empty, "c": empty, "first": empty, "d": np.empty(0)})
        c, ids, first = np.stack(candidates["c_v"].to_numpy()), candidates["c"].to_numpy(), candidates["c_first"].to_numpy()
        out = []
        for at in range(0, len(queries), 256):
            part = queries.iloc[at : at + 256]
            i, j, d = _nearest(np.stack(part["q_v"].to_numpy()), c, k)
            best = _first_k(i, d, first[j], k)
            i, j, d = i[best], j[best], d[best]
            out.append(pd.DataFrame({"q": part["q"].to_numpy()[i], "c": ids[j], "first": first[j], "d": d}))
        return pd.concat(out)

    return run


def _window(laid: DataFrame, entries: DataFrame, k: int, recall: float, most: int) -> int:
    """Blocks to look into on each side of a query's own, from a sample of queries answered by brute force."""
    asked = entries.where("asked")
    total = asked.count()
    if not total:
        return 0
    few = asked.where(sampled(FIT_QUERIES / total, SEED + 1, "e")).select("e", "v").limit(2 * FIT_QUERIES).toPandas()
    if few.empty:
        few = asked.orderBy("e").limit(FIT_QUERIES).select("e", "v").toPandas()
    q, names = np.stack([np.asarray(x) for x in few["v"]]), few["e"].to_numpy()

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, e, d = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for batch in batches:
            if batch.num_rows:
                own = batch.column("e").to_numpy(zero_copy_only=False)
                m = _matrix(batch.column("v"))
                for at in range(0, len(m), 4096):
                    a, b, x = _nearest(q, m[at : at + 4096], k + 1)
                    i, e, d = np.concatenate([i, a]), np.concatenate([e, own[at + b]]), np.concatenate([d, x])
                    best = _first_k(i, d, e, k + 1)
                    i, e, d = i[best], e[best], d[best]
        yield pa.record_batch([pa.array(names[i]), pa.array(e), pa.array(d)], names=["q", "e", "d"])

    near = entries.select("e", "v").mapInArrow(brute, "q long, e long, d double").where("q != e")
    true = near.withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy("d", "e"))).where(F.col("nth") <= k).select("q", "e")
    true = stash(true, "ann-true")
    there = laid.select("curve", "block", "e")
    ours = there.join(true.select(F.col("q").alias("e")).distinct(), "e").select(F.col("e").alias("q"), "curve", F.col("block").alias("own"))
    theirs = there.join(true, "e").select("q", "e", "curve", "block")
    need = theirs.join(ours, ["q", "curve"]).groupBy("q", "e").agg(F.min(F.abs(F.col("block") - F.col("own"))).alias("need"))
    got = need.agg(F.expr(f"percentile_disc({recall}) within group (order by need)")).first()[0]
    return int(min(most, got or 0))
