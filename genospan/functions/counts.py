"""Genotype counts of a call array, ploidy classes and sex-aware counting, as columns."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bounds of the pseudo-autosomal regions of X (end of the first; start and end of the second).
PAR = {"grch38": (2781479, 155701383, 156030895), "grch37": (2699520, 154931044, 155260560)}


def constant_array(values: list, kind: str) -> Column:
    """A foldable array literal, however long."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def subset(array: Column, places: list[int] | None) -> Column:
    """Elements at ``places`` (all where None)."""
    return array if places is None else F.transform(constant_array(places, "int"), lambda i: F.get(array, i))


def counts_of(group: str, size: int) -> Column:
    """The category counts of a counted group of ``size`` samples as one struct."""
    het, alt, miss = (F.col(f"{group}_{k}") for k in ("het", "alt", "miss"))
    return F.struct((F.lit(size) - het - alt - miss).cast("long").alias("hom_ref"), het.alias("het"), alt.alias("hom_alt"), miss.alias("missing"))


def stats_struct(c: Column) -> Column:
    """Counts with derived rates; where nothing is observed the rates are NaN."""
    n = c.hom_ref + c.het + c.hom_alt
    nan = F.lit(float("nan"))
    af = F.when(n > 0, (c.het + 2 * c.hom_alt) / (2 * n)).otherwise(nan)
    total = n + c.missing
    return F.struct(
        c.hom_ref.alias("hom_ref"),
        c.het.alias("het"),
        c.hom_alt.alias("hom_alt"),
        c.missing.alias("missing"),
        n.alias("n"),
        af.alias("af"),
        F.when(n > 0, F.least(af, 1 - af)).otherwise(nan).alias("maf"),
        F.when(total > 0, c.missing / total).otherwise(nan).alias("missing_rate"),
        (c.het + c.hom_alt).alias("carrier_count"),
        F.when(n > 0, c.het / n).otherwise(nan).alias("het_rate"),
    )


def ploidy_class(build: str, fn: str) -> Column:
    """auto, x, y or mt of CHROM and POS."""
    key = (build or "none").lower()
    key = {"hg38": "grch38", "hg19": "grch37", "b38": "grch38", "b37": "grch37"}.get(key, key)
    if key not in (*PAR, "none"):
        raise ValueError(f"{fn}: unknown build '{build}'")
    name = F.regexp_replace(F.lower("CHROM"), "^chr", "")
    par = F.lit(False)
    if key in PAR:
        first, start, end = PAR[key]
        par = ((F.col("POS") > 0) & (F.col("POS") <= first)) | F.col("POS").between(start, end)
    return (
        F.when(name.isin("x", "23") & ~par, "x")
        .when(name.isin("y", "24"), "y")
        .when(name.isin("mt", "m", "26"), "mt")
        .otherwise("auto")
    )


def sex_aware(cls: Column, sizes: dict[str, int], has_sex: bool) -> dict[str, Column]:
    """hom_ref, het, hom_alt, missing, alleles observed and ALT alleles under the ploidy of ``cls``, of the groups all, m and f.

    Y counts males, MT everyone, both haploid; X females diploid and males
    haploid; a haploid het and a call of unknown sex are missing.
    """
    c, m, f = (counts_of(g, sizes[g]) for g in ("all", "m", "f"))

    def pick(auto: Column, x: Column, y: Column, mt: Column) -> Column:
        return F.when(cls == "auto", auto).when(cls == "mt", mt).when(F.lit(not has_sex), None).when(cls == "x", x).otherwise(y)

    ref = pick(c.hom_ref, f.hom_ref + m.hom_ref, m.hom_ref, c.hom_ref)
    het = pick(c.het, f.het, F.lit(0), F.lit(0))
    alt = pick(c.hom_alt, f.hom_alt + m.hom_alt, m.hom_alt, c.hom_alt)
    observed = pick(2 * (c.hom_ref + c.het + c.hom_alt), 2 * (f.hom_ref + f.het + f.hom_alt) + m.hom_ref + m.hom_alt, m.hom_ref + m.hom_alt, c.hom_ref + c.hom_alt)
    alleles = pick(c.het + 2 * c.hom_alt, f.het + 2 * f.hom_alt + m.hom_alt, m.hom_alt, c.hom_alt)
    return {"hom_ref": ref, "het": het, "hom_alt": alt, "missing": F.lit(sizes["all"]) - ref - het - alt, "observed": observed, "alt_alleles": alleles}
