"""Parameters that act as operators: regions, sample and variant lists, ranges, genotype categories."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CATEGORIES = ("hom_ref", "het", "hom_alt", "missing")


def parse_region(fn: str, region: str | None, open_ended: bool = False) -> tuple[str, int | None, int | None] | None:
    """``chr:start-end``; with ``open_ended`` also ``chr`` and ``chr:start-`` and a check that start <= end."""
    if region is None:
        return None
    m = re.fullmatch(r"([^:]*)(?::(\d+)-(\d*))?", region)
    if m is None or (not open_ended and not m[3]):
        raise ValueError(f"{fn}: invalid region '{region}'")
    if not m[1]:
        raise ValueError(f"{fn}: empty chromosome in region '{region}'")
    start, end = (int(x) if x else None for x in (m[2], m[3]))
    if open_ended and start is not None and end is not None and start > end:
        raise ValueError(f"{fn}: region start {start} is after its end {end}")
    return m[1], start, end


def in_region(region: tuple[str, int | None, int | None] | None) -> Column:
    if region is None:
        return F.lit(True)
    chrom, start, end = region
    out = F.col("CHROM") == chrom
    if start is not None:
        out &= F.col("POS") >= start
    if end is not None:
        out &= F.col("POS") <= end
    return out


def resolve_samples(fn: str, samples, iids: Sequence[str | None]) -> list[int]:
    """Sample places in file order; ``samples`` lists ids or 0-based places."""
    samples = list(samples)
    if not samples:
        raise ValueError(f"{fn}: samples list must not be empty")
    at = {iid: i for i, iid in enumerate(iids)} if any(isinstance(s, str) for s in samples) else {}
    found = []
    for s in samples:
        if isinstance(s, str):
            if s not in at:
                raise ValueError(f"{fn}: sample '{s}' not found")
            found.append(at[s])
        elif s is None or not 0 <= s < len(iids):
            raise ValueError(f"{fn}: sample index {s} out of range (0..{len(iids) - 1})")
        else:
            found.append(int(s))
    for s in found:
        if found.count(s) > 1 if len(found) < 1000 else False:
            raise ValueError(f"{fn}: duplicate sample index {s}")
    if len(set(found)) < len(found):
        raise ValueError(f"{fn}: duplicate sample index in list")
    return sorted(found)


def chosen_variants(fn: str, variants, table: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` of the asked variants: a scalar, list, ``{chrom,pos[,ref,alt]}`` or ``{start,stop}``.

    All wishes of a list are looked up in ``table`` by one join on the site columns; a range is two bounds on ``vidx``.
    """
    if variants is None:
        raise ValueError(f"{fn}: variants must not be NULL")
    if isinstance(variants, dict):
        keys = {k for k, v in variants.items() if v is not None}
        if {"start", "chrom"} <= keys:
            raise ValueError(f"{fn}: ambiguous variants: both start and chrom are given")
        if {"start", "stop"} <= keys:
            lo, hi = _places(fn, [variants["start"], variants["stop"]], table)
            if lo > hi:
                raise ValueError(f"{fn}: variants start is after stop")
            return rows.where(F.col("vidx").between(lo, hi))
        if not {"chrom", "pos"} <= keys:
            raise ValueError(f"{fn}: variants must have either start and stop or chrom and pos")
    listed = [variants] if isinstance(variants, (int, str, dict)) else list(variants)
    if not listed:
        raise ValueError(f"{fn}: variants list must not be empty")
    got = _places(fn, listed, table)
    if len(set(got)) < len(got):
        raise ValueError(f"{fn}: duplicate variant index in list")
    if len(got) <= 1000:
        return rows.where(F.col("vidx").isin(got))
    wanted = table.sparkSession.createDataFrame([(v,) for v in got], "vidx long")  # as long as the caller's list
    return rows.join(wanted, "vidx", "left_semi")


_WISH = "nth int, id string, chrom string, pos int, ref string, alt string"


def _places(fn: str, listed: list, table: DataFrame) -> list[int]:
    """vidx of each wish, in order: of repeated ids the last, of repeated sites the first."""
    indexes, wishes = {}, []
    for i, v in enumerate(listed):
        if isinstance(v, bool) or v is None:
            raise ValueError(f"{fn}: variants must not be NULL")
        if isinstance(v, int):
            indexes[i] = v
        elif isinstance(v, dict):
            wishes.append((i, None, str(v["chrom"]), int(v["pos"]), v.get("ref"), v.get("alt")))
        else:
            parts = v.split(":")
            site = len(parts) in (2, 4) and parts[1].isdigit()
            wishes.append((i, v, parts[0] if site else None, int(parts[1]) if site else None, *(parts[2:] if len(parts) == 4 and site else (None, None))))
    if indexes:
        total = table.count()
        for v in indexes.values():
            if not 0 <= v < total:
                raise ValueError(f"{fn}: variant index {v} out of range (0..{total - 1})")
    found = dict(indexes)
    if wishes:
        asked = table.sparkSession.createDataFrame(wishes, _WISH)
        if len(wishes) <= 100_000:
            asked = F.broadcast(asked)
        sites = table.select("vidx", "ID", "CHROM", "POS", "REF", "ALT")
        by_id = sites.join(asked, sites["ID"] == asked["id"]).groupBy("nth").agg(F.max("vidx").alias("named"), F.lit(None).cast("long").alias("placed"))
        by_site = sites.join(asked, (sites["CHROM"] == asked["chrom"]) & (sites["POS"] == asked["pos"]) & (asked["ref"].isNull() | ((sites["REF"] == asked["ref"]) & (sites["ALT"] == asked["alt"]))))
        by_site = by_site.groupBy("nth").agg(F.lit(None).cast("long").alias("named"), F.min("vidx").alias("placed"))
        hits = by_id.unionByName(by_site).groupBy("nth").agg(F.coalesce(F.max("named"), F.max("placed")).alias("vidx"))
        found |= {r.nth: r.vidx for r in hits.collect()}
        for i, name, chrom, pos, *_ in wishes:
            if i not in found:
                if name is not None and len(name.split(":")) not in (1, 2, 4):
                    raise ValueError(f"{fn}: invalid CPRA format '{name}'")
                raise ValueError(f"{fn}: variant '{name or f'{chrom}:{pos}'}' not found")
    return [found[i] for i in range(len(listed))]


def parse_range(fn: str, name: str, given: dict | None, low: float, high: float) -> tuple[float, float] | None:
    if given is None:
        return None
    lo, hi = given.get("min", low), given.get("max", high)
    lo, hi = low if lo is None else lo, high if hi is None else hi
    if not low <= lo <= hi <= high:
        raise ValueError(f"{fn}: {name} must be within [{low}, {high}] with min <= max")
    return lo, hi


@dataclass(frozen=True)
class CategoryFilter:
    """Which genotype categories match."""

    values: tuple[int, ...]
    missing: bool

    def matches(self, g: Column) -> Column:
        hit = g.isin(*self.values) if self.values else F.lit(False)
        return F.when(g.isNull(), F.lit(self.missing)).otherwise(hit)


def parse_categories(fn: str, genotype_range: dict | None, include_genotypes: list[str] | None) -> CategoryFilter | None:
    if genotype_range and include_genotypes:
        raise ValueError(f"{fn}: genotype_range and include_genotypes are mutually exclusive")
    if include_genotypes:
        names = [str(x).strip().lower() for x in include_genotypes]
        for n in names:
            if n not in CATEGORIES:
                raise ValueError(f"{fn}: invalid include_genotypes value '{n}'")
        return CategoryFilter(tuple(i for i, c in enumerate(CATEGORIES[:3]) if c in names), "missing" in names)
    if genotype_range:
        lo, hi = parse_range(fn, "genotype_range", genotype_range, 0, 2)
        return CategoryFilter(tuple(g for g in (0, 1, 2) if lo <= g <= hi), bool(genotype_range.get("include_missing")))
    return None
