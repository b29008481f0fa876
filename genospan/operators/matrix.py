"""Calls as numpy blocks inside Arrow batches: counts by variant, sums by sample, sums of partial results."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import packing
from ..functions.counts import subset
from ..sources.genotypes import COUNTS, DENSE, Genotypes

_STORED = COUNTS[:3]


_DOSE = np.array([0.0, 1.0, 2.0, np.nan])


def block(column: pa.Array) -> np.ndarray:
    """(rows, n) doubles of a list column; null elements are NaN. All rows have one length."""
    rows = len(column)
    flat = column.flatten()
    values = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    return values.reshape(rows, -1) if rows else np.empty((0, 0))


def with_doses(data: Genotypes, places: list[int] | None) -> tuple[DataFrame, str]:
    """The table with what ``doses`` needs, and the name of that column: dosages where there are any, else the calls."""
    if not data.has("ds"):
        return data.table, data.calls
    gt = F.transform(subset(F.col("gt"), places), lambda g: g.cast("double"))
    ds = F.zip_with(subset(F.col("ds"), places), gt, lambda d, g: F.coalesce(d, g))  # a call stands in for an unknown dosage
    return data.wide.withColumn("dose", F.coalesce(ds, gt)), "dose"


def doses(batch: pa.RecordBatch, n: int, places: np.ndarray | None) -> np.ndarray:
    """(rows, chosen samples) doubles, NaN where unknown."""
    return block(batch.column("dose")) if "dose" in batch.schema.names else _DOSE[packing.chosen(batch, n, places)]


def slices(batch: pa.RecordBatch, n: int, cells: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``cells`` calls."""
    step = max(1, cells // max(n, 1))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def typed(table: DataFrame, columns: list[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in table.schema}
    return ", ".join(f"`{c}` {kinds[c]}" for c in columns)


def counted(data: Genotypes, keep: list[str], places: list[int] | None = None, groups: dict[str, list[int] | None] | None = None) -> DataFrame:
    """``keep`` columns of the table and, a group of samples, {group}_het, {group}_alt and {group}_miss.

    One group, ``all``, holds the chosen samples unless ``groups`` says
    otherwise. Saved counts are taken where they answer; else each batch of
    calls is counted in packed form, in one pass for all groups.
    """
    groups = groups or {"all": places}
    names = [f"{g}_{k}" for g in groups for k in ("het", "alt", "miss")]
    if all(p is None for p in groups.values()) and all(data.has(c) for c in _STORED):
        return data.table.select(*keep, *[F.col(_STORED[i % 3]).cast("long").alias(x) for i, x in enumerate(names)])
    if data.sparse:
        return _counted_carriers(data, keep, groups, names)
    n = data.n
    chosen = [None if p is None else np.asarray(p, dtype=np.int64) for p in groups.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = [packing.select_mask(n, p) for p in chosen]
        for batch in batches:
            if batch.num_rows:
                c = packing.counts(packing.packed_of(batch, n), masks)
                got = [pa.array(np.ascontiguousarray(c[g, :, k])) for g in range(len(masks)) for k in range(3)]
                yield pa.record_batch([*[batch.column(x) for x in keep], *got], names=[*keep, *names])

    wanted = list(dict.fromkeys([*keep, data.calls]))
    return data.table.select(*wanted).mapInArrow(run, typed(data.table, keep) + "".join(f", {x} long" for x in names))


def _counted_carriers(data: Genotypes, keep: list[str], groups: dict[str, list[int] | None], names: list[str]) -> DataFrame:
    """``counted`` of a sparse dataset: only calls that aren't hom-ref are looked at."""
    n = data.n
    chosen = [None if p is None else np.asarray(p, dtype=np.int64) for p in groups.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        member = np.zeros((len(chosen), n), dtype=bool)
        for mask, p in zip(member, chosen, strict=True):
            mask[slice(None) if p is None else p] = True
        for batch in batches:
            row, at, call = packing.owners_of(batch.column("carriers"))
            cell, got = row * 4 + call, []
            for mask in member:
                c = np.bincount(cell[mask[at]], minlength=4 * batch.num_rows).reshape(-1, 4)
                got += [pa.array(np.ascontiguousarray(c[:, k])) for k in (1, 2, 3)]
            yield pa.record_batch([*[batch.column(x) for x in keep], *got], names=[*keep, *names])

    wanted = list(dict.fromkeys([*keep, "carriers"]))
    return data.table.select(*wanted).mapInArrow(run, typed(data.table, keep) + "".join(f", {x} long" for x in names))


def by_call(table: DataFrame, *columns: str) -> DataFrame:
    """(sidx, call, *columns): a row a call that isn't hom-ref of a sparse table."""
    one = table.select(*columns, F.explode("carriers").alias("_c"))
    return one.select(F.shiftright("_c", 2).cast("int").alias("sidx"), F.col("_c").bitwiseAND(3).cast("int").alias("call"), *columns)


def ranked(sites: DataFrame, name: str) -> DataFrame:
    """(vidx, name): the place of every vidx in their order. A task ranks 65,536 neighbours at most."""
    ids = sites.select("vidx", F.shiftright("vidx", 16).alias("_run"))
    before = F.coalesce(F.sum("count").over(Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a run
    runs = ids.groupBy("_run").count().select("_run", before.alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_run").orderBy("vidx")) - 1
    return ids.withColumn("_rank", rank).join(runs, "_run").select("vidx", (F.col("_before") + F.col("_rank")).alias(name))


def summed(table: DataFrame, partial: Callable[[pa.RecordBatch], np.ndarray], shape: tuple[int, ...], n: int) -> np.ndarray:
    """Sum of ``partial`` over all batches: within partitions, then among the square root of their number, then here."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(shape), False
        for batch in batches:
            for part in slices(batch, n):
                total += partial(part)
                some = True
        if some:
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["m"])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(shape), False
        for batch in batches:
            for m in batch.column(0).to_pylist():
                total += np.frombuffer(m).reshape(shape)
                some = True
        if some:
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["m"])

    parts = table.mapInArrow(first, "m binary")
    few = max(1, math.isqrt(table.rdd.getNumPartitions()))
    rows = parts.repartition(few).mapInArrow(second, "m binary").collect()
    return sum((np.frombuffer(bytes(r.m)).reshape(shape) for r in rows), np.zeros(shape))


def spread_sums(table: DataFrame, partial: Callable[[pa.RecordBatch], np.ndarray], n: int, names: list[str], wide: int) -> DataFrame:
    """(k, *names): per-sample sums; a partition sends one row a sample, whatever its number of variants."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((len(names), n)), False
        for batch in batches:
            for part in slices(batch, wide):
                total += partial(part)
                some = True
        if some:
            yield pa.record_batch([pa.array(np.arange(n, dtype=np.int32)), *(pa.array(t) for t in total)], names=["k", *names])

    parts = table.mapInArrow(run, "k int, " + ", ".join(f"{x} double" for x in names))
    return parts.groupBy("k").agg(*[F.sum(x).alias(x) for x in names])


def sample_tallies(data: Genotypes, places: list[int] | None = None, sparse: bool = False) -> DataFrame:
    """(k, het, alt, miss): calls of every chosen sample by category; a partition sends one row a sample.

    ``sparse`` reads the saved carriers of rare variants, and the calls of the
    other variants only. A sparse dataset's carriers are grouped by sample.
    """
    if data.sparse:
        calls = data.long if data.long is not None and places is None else by_call((data if places is None else data.only(places)).table)
        return calls.groupBy(F.col("sidx").alias("k")).agg(*[F.count_if(F.col("call") == c).alias(x) for c, x in ((1, "het"), (2, "alt"), (3, "miss"))])
    n = data.n
    at = None if places is None else np.asarray(places, dtype=np.int64)
    size = n if at is None else len(at)

    def rows(total: np.ndarray) -> pa.RecordBatch:
        some = np.flatnonzero(total.any(axis=0))
        return pa.record_batch([pa.array(some.astype(np.int32)), *(pa.array(t[some]) for t in total)], names=["k", "het", "alt", "miss"])

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, size), dtype=np.int64)
        for batch in batches:
            for part in slices(batch, n, 1 << 22):
                packing.sample_tally(packing.chosen(part, n, at), total)
        yield rows(total)

    def light(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(4 * n, dtype=np.int64)
        for batch in batches:
            total += np.bincount(batch.column("carriers").flatten().to_numpy(zero_copy_only=False), minlength=4 * n)
        by_call = total.reshape(n, 4).T[1:]
        yield rows(by_call if at is None else by_call[:, at])

    schema = "k int, het long, alt long, miss long"
    if sparse and data.has("carriers"):
        few = max(1, n // DENSE)
        parts = data.table.where(F.col("n_other") <= few).select("carriers").mapInArrow(light, schema)
        if data.table.where(F.col("n_other") > few).select("n_other").limit(1).count():
            parts = parts.union(data.table.where(F.col("n_other") > few).select(data.calls).mapInArrow(dense, schema))
    else:
        parts = data.table.select(data.calls).mapInArrow(dense, schema)
    return parts.groupBy("k").agg(*[F.sum(x).alias(x) for x in ("het", "alt", "miss")])
