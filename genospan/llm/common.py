"""Shared plumbing of the training-data operators: tables, shared-folder stashes, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from genospan.plans.runtime import importable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: Paths this session has made below the shared folder and not deleted yet, by application.
_MADE: dict[str, set[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset a local session (tests) gets a temporary one; on a
    cluster there is no safe default, so that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='genospan-')}")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; ``purge`` deletes it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return path


def purge(spark: SparkSession) -> int:
    """Delete what this session's operators left in the shared folder, once their results are written; the number of paths."""
    paths = _MADE.pop(spark.sparkContext.applicationId, set())
    for path in paths:
        drop_path(spark, path)
    return len(paths)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` once to the shared folder and read it back.

    Unlike ``checkpoint()`` this computes the plan a single time and keeps
    column pruning on the way back; unlike ``localCheckpoint`` it survives a
    lost executor. The write's own shuffle files go as soon as it is done.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    with bounded(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Settings of the operators' own writes: shuffle files go when the write ends, not whenever the driver next
#: collects garbage, and Arrow batches stay small beside an executor's heap, however long the texts are.
_BOUNDED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


@contextmanager
def bounded(spark: SparkSession) -> Iterator[None]:
    """Writes within run under ``_BOUNDED``; the session's own settings are back afterwards."""
    before = {k: spark.conf.get(k, None) for k in _BOUNDED}
    for k, v in _BOUNDED.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Ids up to so many (16 bytes each in a task's table) are sent to every executor; more are joined by a shuffle.
MOST_IDS = 1_000_000


def bounded_broadcast(ids: DataFrame) -> DataFrame:
    """A stashed table of ids, marked for broadcast where it is small."""
    return F.broadcast(ids) if ids.limit(MOST_IDS + 1).count() <= MOST_IDS else ids


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _MADE.get(spark.sparkContext.applicationId, set()).discard(path)


def drop_stash(df: DataFrame) -> None:
    """Delete the files behind a stashed frame that nothing reads any more."""
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        drop_path(df.sparkSession, f)


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    return df.mapInArrow(fn, schema)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is the empty text."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def learn_fold(doc_id: str | Column = "doc_id") -> Column:
    """True for rows a model may learn from: crc32 of the decimal id leaves a remainder other than 1."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 != 1, F.lit(False))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True where the remainder is 1; a null id has none and counts as not held out."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def hash_bound(fraction: float) -> int:
    """Signed 64-bit bound below which that fraction of all hashes lie, however small it is."""
    return min((1 << 63) - 1, -(1 << 63) + round(max(0.0, fraction) * 2.0**64))


def sampled(fraction: float, seed: int, *key: str) -> Column:
    """True for a fixed pseudo-random share of keys; all of them from 1 on."""
    return F.lit(True) if fraction >= 1 else F.xxhash64(*key, F.lit(seed)) < F.lit(hash_bound(fraction))


def keep_once(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is in ``kept``; of rows that repeat one, that whose text hashes lowest."""
    kept = kept.select(F.col("doc_id").alias("_keep")).distinct()
    return once(docs.join(kept, docs["doc_id"].eqNullSafe(kept["_keep"]), "left_semi"))


def once(docs: DataFrame) -> DataFrame:
    """One row a doc_id: that whose text hashes lowest, of equal ones any. Rows move only if some id repeats."""
    if not docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        return docs
    nth = next(f"_nth{i}" for i in range(len(docs.columns) + 1) if f"_nth{i}" not in docs.columns)
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))
    return docs.withColumn(nth, first).where(F.col(nth) == 1).drop(nth)


def components_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Connected components of the links a-b: (nodes, smallest node of each node's component)."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = index[: len(a)], index[len(a) :]
    root = np.arange(len(nodes))
    while True:
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        while True:
            jumped = root[root]
            if np.array_equal(jumped, root):
                break
            root = jumped
        if np.array_equal(before, root):
            return nodes, nodes[root]


#: Longer keys are not remembered beyond the call that learned them.
LONG_KEY = 64


class Recall:
    """A bounded memory of strings met, in two generations: the older one goes when the younger is full."""

    def __init__(self, most: int):
        self.half = max(1, most // 2)
        self.passing: list = []
        self.young: dict = {}
        self.old: dict = {}

    def holding(self, rows: list[list], learn: Callable[[list], dict]) -> dict:
        """A dict that has every key of ``rows``; keys in neither generation are learned together."""
        for k in self.passing:
            self.young.pop(k, None)
        fresh = set().union(*rows).difference(self.young)
        if len(self.young) + len(fresh) > self.half:
            self.old, self.young = self.young, {}
            fresh = set().union(*rows)
        young, old = self.young, self.old
        new = []
        for k in fresh:
            if k in old:
                young[k] = old[k]
            else:
                new.append(k)
        if new:
            young.update(learn(new))
        self.passing = [k for k in new if len(k) > LONG_KEY]
        return young
