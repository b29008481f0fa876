"""Per-variant and per-sample statistics: allele frequency, Hardy-Weinberg, missingness."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.counts import counts_of, ploidy_class, sex_aware
from ..functions.numerics import hwe_test
from ..functions.params import in_region, parse_region, resolve_samples
from ..sources.genotypes import COUNTS, SITE, Genotypes
from .matrix import by_call, counted, with_doses
from .shape import sample_counts


def selected(data: Genotypes, fn: str, samples, region) -> tuple[Genotypes, list[int] | None]:
    """The region's variants, and the places of the chosen samples."""
    places = None
    if samples is not None:
        if data.samples is None and any(isinstance(s, str) for s in samples):
            raise ValueError(f"{fn}: without a .psam samples must be LIST(INTEGER)")
        places = resolve_samples(fn, samples, data.iids() if data.samples is not None else [None] * data.n)
    where = parse_region(fn, region)
    return data.within(None if where is None else in_region(where)), places


def _by_sex(data: Genotypes, places: list[int] | None, build: str, fn: str, *more: str) -> tuple[DataFrame, dict[str, int]]:
    """Site columns, ``_cls`` and the counts of everyone, males and females; with the size of each group.

    Only X and Y ask for a sex. Where counts are saved the calls of their
    chromosomes alone are read.
    """
    if data.sparse and places is None and data.samples is not None:
        return _sparse_by_sex(data, build, fn, *more)
    sexes = data.sexes() if data.has_sex() else [0] * data.n
    index = range(data.n) if places is None else places
    groups = {"all": places, "m": [i for i in index if sexes[i] == 1], "f": [i for i in index if sexes[i] == 2]}
    sizes = {"all": len(index), "m": len(groups["m"]), "f": len(groups["f"])}
    data = Genotypes(data.table.withColumn("_cls", ploidy_class(build, fn)), data.samples, data.n)
    keep = [*SITE, "_cls", *more]
    if places is not None or not data.has("n_het"):
        return counted(data, keep, groups=groups), sizes
    sexed = F.col("_cls").isin("x", "y")
    none = {f"{g}_{k}": F.lit(0).cast("long") for g in ("m", "f") for k in ("het", "alt", "miss")}
    out = counted(data.where(~sexed), keep).withColumns(none)
    labels = [r.CHROM for r in data.table.where(sexed).select("CHROM").distinct().collect()]  # spellings of X and Y
    if labels:
        out = out.unionByName(counted(data.where(F.col("CHROM").isin(labels) & sexed), keep, groups=groups))
    return out, sizes


def _sparse_by_sex(data: Genotypes, build: str, fn: str, *more: str) -> tuple[DataFrame, dict[str, int]]:
    """``_by_sex`` of a sparse dataset: the carriers of X and Y meet their sexes by a join; all else is saved counts."""
    table = data.table.withColumn("_cls", ploidy_class(build, fn))
    sexes = data.samples.where(F.col("SEX").isin(1, 2)).select("sidx", "SEX") if data.has_sex() else None
    sizes = {"all": data.n, "m": 0, "f": 0}
    groups = {"m": 1, "f": 2}
    if sexes is not None:
        found = {r.SEX: r["count"] for r in sexes.groupBy("SEX").count().collect()}
        sizes |= {g: found.get(s, 0) for g, s in groups.items()}
    saved = {f"all_{k}": F.col(c).cast("long") for k, c in zip(("het", "alt", "miss"), COUNTS[:3], strict=True)}
    kept = [*SITE, "_cls", *more]
    by_group = [(f"{g}_{k}", s, c) for g, s in groups.items() for c, k in ((1, "het"), (2, "alt"), (3, "miss"))]
    out = table.select("vidx", *kept, *[c.alias(k) for k, c in saved.items()])
    if sexes is None:
        return out.withColumns({name: F.lit(0).cast("long") for name, *_ in by_group}).drop("vidx"), sizes
    sexed = data.within(ploidy_class(build, fn).isin("x", "y"))
    calls = (by_call(sexed.table, "vidx") if sexed.long is None else sexed.long).join(sexes, "sidx")
    own = calls.groupBy("vidx").agg(*[F.count_if((F.col("SEX") == s) & (F.col("call") == c)).alias(name) for name, s, c in by_group])
    return out.join(own, "vidx", "left").select(*kept, *saved, *[F.coalesce(name, F.lit(0)).alias(name) for name, *_ in by_group]), sizes


def freq(data: Genotypes, samples=None, region: str | None = None, counts: bool = False, dosage: bool = False, build: str = "GRCh38") -> DataFrame:
    """ALT frequency of every variant, ploidy-aware on X, Y and MT; ``counts`` and ``dosage`` add columns."""
    data, places = selected(data, "freq", samples, region)
    if dosage:
        data = data.summed if data.summed is not None and places is None else _with_dosage_sums(data, places)
    more = [c for c in ("_n", "_sum", "_square") if data.has(c)]
    table, sizes = _by_sex(data, places, build, "freq", *more)
    c = sex_aware(F.col("_cls"), sizes, data.has_sex())
    out = table.withColumns({f"_{k}": v for k, v in c.items()})
    alt_freq = F.when(F.col("_observed") > 0, F.col("_alt_alleles") / F.col("_observed"))
    observed = F.coalesce("_observed", F.lit(0)).cast("int")
    extra = []
    if dosage:
        auto = F.col("_cls") == "auto"
        ref, het, alt = F.col("_hom_ref"), F.col("_het"), F.col("_hom_alt")
        # Without dosages the calls are the dosages.
        n, sum_, square = (F.col("_n"), F.col("_sum"), F.col("_square")) if more else (ref + het + alt, het + 2 * alt, het + 4 * alt)
        alt_freq = F.when(auto, F.try_divide(sum_, 2 * n)).otherwise(alt_freq)
        observed = F.when(auto, 2 * n).otherwise(observed).cast("int")
        p, mean = F.try_divide(sum_, 2 * n), F.try_divide(sum_, n)  # of no known call, null
        r2 = F.try_divide(F.try_divide(square, n) - mean * mean, 2 * p * (1 - p))
        extra = [F.when(auto & (n > 0) & (p > 0) & (p < 1), r2).alias("IMP_R2") if more else F.lit(None).cast("double").alias("IMP_R2")]
    columns = [F.col(f"_{k}").cast("int").alias(f"{k.upper()}_CT") for k in ("hom_ref", "het", "hom_alt", "missing")] if counts else []
    return out.select(*SITE, alt_freq.alias("ALT_FREQ"), observed.alias("OBS_CT"), *columns, *extra)


def _with_dosage_sums(data: Genotypes, places: list[int] | None) -> Genotypes:
    """Number, sum and sum of squares of the known dosages, as columns; as it is where there are none."""
    if not data.has("ds"):
        return data
    table, dose = with_doses(data, places)
    known = F.filter(dose, lambda d: d.isNotNull())
    sums = {"_n": F.size(known), "_sum": F.aggregate(known, F.lit(0.0), lambda a, d: a + d), "_square": F.aggregate(known, F.lit(0.0), lambda a, d: a + d * d)}
    return Genotypes(table.withColumns(sums).drop(dose), data.samples, data.n)


def hardy(data: Genotypes, samples=None, region: str | None = None, midp: bool = False, build: str = "GRCh38") -> DataFrame:
    """Observed and expected heterozygosity and the exact test, joint with male hemizygotes on X.

    Counts and tests are narrow: a worker remembers the count sets it has tested.
    """
    data, places = selected(data, "hardy", samples, region)
    has_sex = data.has_sex()
    table, sizes = _by_sex(data, places, build, "hardy")
    c, m, f = (counts_of(g, sizes[g]) for g in ("all", "m", "f"))
    auto, x, y = F.col("_cls") == "auto", F.col("_cls") == "x", F.col("_cls") == "y"
    known = auto | (F.col("_cls") == "mt") | F.lit(has_sex)
    pick = lambda a, fx, my, mt: F.when(~known, None).when(auto, a).when(x, fx).when(y, my).otherwise(mt).cast("long")
    counts = table.select(
        *SITE,
        "_cls",
        pick(c.hom_ref, f.hom_ref, m.hom_ref, c.hom_ref).alias("r"),
        pick(c.het, f.het, F.lit(0), F.lit(0)).alias("h"),
        pick(c.hom_alt, f.hom_alt, m.hom_alt, c.hom_alt).alias("a"),
        F.when(x & known, m.hom_ref).otherwise(0).cast("long").alias("mr"),
        F.when(x & known, m.hom_alt).otherwise(0).cast("long").alias("ma"),
    )

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in ("_cls", "r", "h", "a", "mr", "ma")), strict=True)
            got = [hwe_test(k, *row, midp) if k in ("auto", "x") and row[0] is not None and sum(row[:3]) else None for k, *row in rows]
            yield pa.record_batch([*batch.columns, pa.array(got, pa.float64())], names=[*batch.schema.names, "P_HWE"])

    out = counts.mapInArrow(test, "CHROM string, POS int, ID string, REF string, ALT string, _cls string, r long, h long, a long, mr long, ma long, P_HWE double")
    n = F.col("r") + F.col("h") + F.col("a")
    p = (2 * F.col("r") + F.col("h")) / (2 * n)
    good = F.col("_cls").isin("auto", "x") & (n > 0)
    return out.select(
        *SITE,
        F.col("ALT").alias("A1"),
        F.col("r").cast("int").alias("HOM_REF_CT"),
        F.col("h").cast("int").alias("HET_CT"),
        F.col("a").cast("int").alias("HOM_ALT_CT"),
        F.when(good, F.col("h") / n).alias("O_HET"),
        F.when(good, 2 * p * (1 - p)).alias("E_HET"),
        "P_HWE",
    )


def missing(data: Genotypes, mode: str = "variant", samples=None, region: str | None = None) -> DataFrame:
    """Missing calls by variant or by sample; not ploidy-aware."""
    if mode not in ("variant", "sample"):
        raise ValueError("missing: mode must be 'variant' or 'sample'")
    if mode == "sample" and data.samples is None:
        raise ValueError("missing: sample mode requires a .psam file")
    data, places = selected(data, "missing", samples, region)
    if mode == "variant":
        c = F.col("all_miss")
        n = F.lit(len(places) if places is not None else data.n)
        return counted(data, list(SITE), places).select(*SITE, c.cast("int").alias("MISSING_CT"), (n - c).cast("int").alias("OBS_CT"), F.when(n > 0, c / n).otherwise(0.0).alias("F_MISS"))
    by_sample = data.samples.join(sample_counts(data, places), "sidx")
    g = F.col("genotypes")
    total = g.hom_ref + g.het + g.hom_alt + g.missing
    fid = F.col("FID") if "FID" in data.samples.columns else F.lit(None).cast("string").alias("FID")
    return by_sample.select(fid, "IID", g.missing.cast("int").alias("MISSING_CT"), (total - g.missing).cast("int").alias("OBS_CT"), F.when(total > 0, g.missing / total).otherwise(0.0).alias("F_MISS"))
