"""Genotype shaping: variant, genotype (tidy) and sample orientation with every projection mode."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.counts import constant_array, counts_of, stats_struct, subset
from ..functions.packing import MISSING
from ..functions.params import CategoryFilter, chosen_variants, in_region, parse_categories, parse_range, parse_region, resolve_samples
from ..settings import setting
from ..sources.genotypes import SITE, Genotypes, load, load_many, vcf
from .matrix import by_call, counted, ranked, sample_tallies

MODES = ("auto", "array", "list", "columns", "struct", "counts", "stats", "text")
ORIENTS = ("variant", "genotype", "sample")
_MOST_ARRAY = 100_000  # the longest fixed-size array; beyond it auto means list


def read_genotypes(spark: SparkSession, path: str, pvar=None, psam=None, orient: str = "variant", **options) -> DataFrame:
    """Variant-oriented calls of one matrix; only ``orient='variant'``."""
    fn = "read_pgen"
    if orient not in ORIENTS:
        raise ValueError(f"{fn}: invalid orient value '{orient}'")
    if orient != "variant":
        raise ValueError(f"{fn}: orient := '{orient}' is not supported")
    return shape(load(spark, fn, path, pvar=pvar, psam=psam), fn, orient="variant", **options)


def read_fileset(spark: SparkSession, paths, pgen: str | None = None, pvar=None, psam=None, combine_samples: str = "implicit", orient: str = "variant", **options) -> DataFrame:
    """Unified reader over one fileset or a list or glob of shards."""
    fn = "read_pfile"
    if orient not in ORIENTS:
        raise ValueError(f"{fn}: invalid orient value '{orient}'")
    shards = not isinstance(paths, str) or any(c in paths for c in "*?[")
    if shards and options.get("variants") is not None and len(list(paths) if not isinstance(paths, str) else [1, 2]) > 1:
        raise ValueError(f"{fn}: variants cannot be given with multiple files")
    return shape(load_many(spark, fn, paths, psam, pgen, pvar, combine_samples, samples_required=orient != "variant"), fn, orient=orient, **options)


def read_vcf(spark: SparkSession, path: str, genotypes: str = "auto", phased: bool = False, region: str | None = None, min_gq: int | None = None, min_dp: int | None = None, max_dp: int | None = None, halfcall: str = "missing") -> DataFrame:
    """chrom, pos, id, ref, alt and genotypes (array, list or columns) of a VCF file."""
    fn = "read_vcf"
    if genotypes in ("struct", "counts", "stats"):
        raise ValueError(f"{fn}: genotypes := '{genotypes}' is not supported")
    data = vcf(spark, path, region, min_gq, min_dp, max_dp, halfcall, fn)
    out = shape(data, fn, genotypes=genotypes, phased=phased)
    return out.select(*[F.col(f"`{c}`").alias(c.lower()) if c in SITE else F.col(f"`{c}`") for c in out.columns])


def _element(data: Genotypes, fn: str, dosages: bool, phased: bool, places: list[int] | None, keep: CategoryFilter | None) -> Column:
    """The array of elements of the asked kind; those outside the category filter are null."""
    gt = subset(F.col("gt"), places)
    if dosages:
        plain = F.transform(gt, lambda g: g.cast("double"))
        return F.coalesce(F.zip_with(subset(F.col("ds"), places), plain, lambda d, g: F.coalesce(d, g)), plain) if data.has("ds") else plain
    masked = gt if keep is None else F.transform(gt, lambda g: F.when(keep.matches(g), g))
    if not phased:
        return masked
    phase = subset(F.col("phase"), places) if data.has("phase") else F.transform(gt, lambda g: F.lit(False))

    def pair(g: Column, p: Column) -> Column:
        first = F.when(g == 2, 1).when((g == 1) & F.coalesce(p, F.lit(False)), 1).otherwise(0)
        second = F.when(g == 2, 1).when((g == 1) & ~F.coalesce(p, F.lit(False)), 1).otherwise(0)
        return F.when(g.isNotNull(), F.array(first.cast("tinyint"), second.cast("tinyint")))

    return F.zip_with(masked, phase, pair)


def shape(
    data: Genotypes,
    fn: str,
    orient: str = "variant",
    genotypes: str = "auto",
    dosages: bool = False,
    phased: bool = False,
    region: str | None = None,
    samples=None,
    variants=None,
    af_range: dict | None = None,
    ac_range: dict | None = None,
    genotype_range: dict | None = None,
    include_genotypes: list[str] | None = None,
    **given_variants,
) -> DataFrame:
    """Project and filter a dataset; options follow the reader's."""
    if given_variants:
        raise TypeError(f"{fn}: unknown parameter {sorted(given_variants)[0]}")
    if genotypes not in MODES:
        raise ValueError(f"{fn}: invalid genotypes value '{genotypes}'")
    if dosages and phased:
        raise ValueError(f"{fn}: dosages and phased cannot both be true")
    if genotypes in ("counts", "stats"):
        if phased or dosages:
            raise ValueError(f"{fn}: genotypes := '{genotypes}' is incompatible with {'phased' if phased else 'dosages'}")
        if orient == "genotype":
            raise ValueError(f"{fn}: aggregate modes require orient variant or sample; '{genotypes}' is not compatible with orient := 'genotype'")
    if genotypes == "text" and (orient == "genotype" or phased or dosages):
        raise ValueError(f"{fn}: genotypes := 'text' requires orient variant or sample and calls without phase or dosages")
    if orient == "genotype" and genotypes in ("columns", "struct"):
        raise ValueError(f"{fn}: genotypes := '{genotypes}' is not compatible with orient := 'genotype'")
    if genotypes == "text" and data.summed is not None:
        data = data.summed
    keep = parse_categories(fn, genotype_range, include_genotypes)
    if keep and dosages:
        raise ValueError(f"{fn}: genotype filters cannot be combined with dosages")
    if samples is not None and data.samples is None and any(isinstance(s, str) for s in samples):
        raise ValueError(f"{fn}: without a .psam samples must be LIST(INTEGER)")
    if genotypes in ("columns", "struct") and data.samples is None:
        raise ValueError(f"{fn}: genotypes := '{genotypes}' requires a .psam/.fam file")
    by_name = samples is not None and any(isinstance(s, str) for s in samples)
    places = resolve_samples(fn, samples, data.iids() if by_name else range(data.n)) if samples is not None else None
    count = len(places) if places is not None else data.n
    if genotypes == "array" and count > _MOST_ARRAY:
        raise ValueError(f"{fn}: array mode holds at most {_MOST_ARRAY} samples")

    whole = data
    where = parse_region(fn, region, open_ended=True)
    data = data.within(None if where is None else in_region(where))
    if variants is not None:
        data = Genotypes(chosen_variants(fn, variants, whole.sites, data.table), data.samples, data.n)
    limits = {name: parse_range(fn, name, given, 0, high) for name, given, high in (("af_range", af_range, 1.0), ("ac_range", ac_range, 2.0 * count))}
    by_row = orient == "variant" and genotypes in ("counts", "stats")
    if by_row or any(limits.values()) or (keep and orient != "genotype"):
        stored = data.table.columns
        data = Genotypes(counted(data, list(SITE) if by_row else stored, places), data.samples, data.n)
        het, alt, miss = (F.col(f"all_{k}") for k in ("het", "alt", "miss"))
        n, ac = F.lit(count) - miss, het + 2 * alt
        for name, value in (("af_range", F.try_divide(ac, 2 * n)), ("ac_range", ac)):
            if limits[name]:
                data = data.where((n > 0) & (value >= limits[name][0]) & (value <= limits[name][1]))
        if keep and orient != "genotype":
            hit = sum((((F.lit(count) - het - alt - miss), het, alt)[v] for v in keep.values), F.lit(0))
            data = data.where(hit + (miss if keep.missing else F.lit(0)) > 0)
        if not by_row:
            data = Genotypes(data.table.select(*stored), data.samples, data.n)
    site = list(SITE)
    if by_row:
        c = counts_of("all", count)
        return data.table.select(*site, c.alias("genotypes")) if genotypes == "counts" else data.table.select(*site, c.alias("c")).select(*site, stats_struct(F.col("c")).alias("genotypes"))
    if orient == "genotype" and data.sparse and keep and 0 not in keep.values and not (dosages or phased):
        return _tidy_carriers(data if places is None else data.only(places), _people(data, fn), places, keep)
    if orient == "genotype":
        return _tidy(data, fn, data.wide, places, dosages, phased, keep)
    if orient == "sample":
        return _by_sample(data, fn, places, genotypes, dosages, phased, keep)
    names = whole.iids(places) if genotypes in ("columns", "struct") else []
    if data.sparse and places is not None and not (dosages or phased):  # calls of the chosen samples alone are unpacked
        data, places = data.only(places), None
    if genotypes == "text" and data.sparse:
        return _carriers_text(data.table, data.n, keep).select(*site, "genotypes")
    table = data.wide
    element = _element(data, fn, dosages, phased, places, keep)
    if genotypes == "text":
        return table.select(*site, F.array_join(F.transform(element, lambda g: F.coalesce(g.cast("string"), F.lit("."))), "").alias("genotypes"))
    if genotypes in ("columns", "struct"):
        wide = table.select(*site, element.alias("g"))
        each = [F.get("g", i).alias(str(name)) for i, name in enumerate(names)]
        return wide.select(*site, *each) if genotypes == "columns" else wide.select(*site, F.struct(*each).alias("genotypes"))
    return table.select(*site, element.alias("genotypes"))


def _carriers_text(table: DataFrame, n: int, keep: CategoryFilter | None) -> DataFrame:
    """A character a call, of ``n`` a row: what stands between two carriers is hom-ref, written by the run."""
    shown = lambda v: str(v) if keep is None or v in keep.values else "."
    place = lambda c: F.shiftright(c, 2).cast("int")

    def piece(c: Column, i: Column) -> Column:
        before = F.coalesce(place(F.get("carriers", i - 1)), F.lit(-1))
        call = c.bitwiseAND(3)
        return F.concat(F.repeat(F.lit(shown(0)), place(c) - before - 1), F.when(call == 1, shown(1)).when(call == 2, shown(2)).otherwise("."))

    last = F.coalesce(place(F.get("carriers", F.size("carriers") - 1)), F.lit(-1))
    rest = F.repeat(F.lit(shown(0)), F.lit(n) - last - 1)
    return table.withColumn("genotypes", F.concat(F.array_join(F.transform("carriers", piece), ""), rest))


def _people(data: Genotypes, fn: str) -> DataFrame:
    if data.samples is None:
        raise ValueError(f"{fn}: orient genotype or sample requires a .psam file")
    return data.samples


def _long(data: Genotypes, table: DataFrame, element: Column, places: list[int] | None, *columns: str) -> DataFrame:
    """One row a call: the given columns, sidx and the element ``g``."""
    sidx = F.col("k") if places is None else F.get(constant_array(places, "int"), F.col("k"))
    return table.select(*columns, F.posexplode(element).alias("k", "g")).withColumn("sidx", sidx).drop("k")


def _tidy(data: Genotypes, fn: str, table: DataFrame, places, dosages, phased, keep) -> DataFrame:
    people = _people(data, fn)
    long = _long(data, table, _element(data, fn, dosages, phased, places, None), places, *SITE)
    if keep:
        total = F.get("g", 0) + F.get("g", 1) if phased else F.col("g")
        long = long.where(keep.matches(total))
    columns = [c for c in people.columns if c != "sidx"]
    return long.join(people, "sidx").select(*SITE, *columns, F.col("g").alias("genotype"))


def _tidy_carriers(data: Genotypes, people: DataFrame, places: list[int] | None, keep: CategoryFilter) -> DataFrame:
    """``_tidy`` of a sparse dataset where hom-ref calls aren't asked for: its carriers are the rows."""
    wanted = [*[v for v in keep.values if v], *([MISSING] if keep.missing else [])]
    long = by_call(data.table, *SITE).where(F.col("call").isin(wanted))
    if places is not None:
        long = long.withColumn("sidx", F.get(constant_array(places, "int"), F.col("sidx")))
    columns = [c for c in people.columns if c != "sidx"]
    g = F.when(F.col("call") != MISSING, F.col("call")).cast("tinyint")
    return long.join(people, "sidx").select(*SITE, *columns, g.alias("genotype"))


def _by_sample(data: Genotypes, fn: str, places, genotypes: str, dosages: bool, phased: bool, keep) -> DataFrame:
    people = _people(data, fn)
    columns = [c for c in people.columns if c != "sidx"]
    if places is not None:
        people = people.where(F.col("sidx").isin(places))
    if genotypes in ("counts", "stats"):
        out = people.join(sample_counts(data, places), "sidx")
        if keep:
            hit = sum((F.col(f"genotypes.{('hom_ref', 'het', 'hom_alt')[v]}") for v in keep.values), F.lit(0))
            out = out.where(hit + (F.col("genotypes.missing") if keep.missing else F.lit(0)) > 0)
        last = F.col("genotypes") if genotypes == "counts" else stats_struct(F.col("genotypes"))
        return out.select(*columns, last.alias("genotypes"))
    variants = data.sites.count()
    if genotypes == "text" and data.sparse:
        return _sample_text(data, people, variants, keep).select(*columns, "genotypes")
    table = data.wide
    cells = variants * (len(places) if places is not None else data.n)
    if cells > setting(data.spark, "max_matrix_elements"):
        raise ValueError(f"{fn}: orient := 'sample' would require {cells} genotype values, more than max_matrix_elements")
    named = genotypes in ("columns", "struct")
    element = _element(data, fn, dosages, phased and not named, places, None)
    plain = subset(F.col("gt"), places)
    pairs = F.zip_with(element, plain, lambda e, g: F.struct(e.alias("e"), g.alias("g")))
    long = _long(data, table, pairs, places, "vidx")
    row = F.array_sort(F.collect_list(F.struct("vidx", "g")))
    out = long.groupBy("sidx").agg(row.alias("r"))
    if keep:
        out = out.where(F.exists("r", lambda x: keep.matches(x.g.g)))
    value = F.transform("r", lambda x: x.g.e if keep is None else F.when(keep.matches(x.g.g), x.g.e))
    out = out.select("sidx", value.alias("genotypes"))
    joined = people.join(out, "sidx")
    if genotypes == "text":
        return joined.select(*columns, F.array_join(F.transform("genotypes", lambda g: F.coalesce(g.cast("string"), F.lit("."))), "").alias("genotypes"))
    if not named:
        return joined.select(*columns, "genotypes")
    names = [r.ID or f"{r.CHROM}:{r.POS}" for r in table.orderBy("vidx").select("ID", "CHROM", "POS").collect()]
    if len(set(names)) < len(names):
        raise ValueError(f"{fn}: duplicate variant name '{next(x for x in names if names.count(x) > 1)}'")
    each = [F.get("genotypes", i).alias(x) for i, x in enumerate(names)]
    return joined.select(*columns, *each) if genotypes == "columns" else joined.select(*columns, F.struct(*each).alias("genotypes"))


def _sample_text(data: Genotypes, people: DataFrame, variants: int, keep: CategoryFilter | None) -> DataFrame:
    """People with a character a variant, in order of vidx: only calls that aren't hom-ref move to their sample."""
    calls = (by_call(data.table, "vidx") if data.long is None else data.long).join(ranked(data.sites, "_at"), "vidx")
    carried = calls.groupBy("sidx").agg(F.sort_array(F.collect_list(F.col("_at").cast("long") * 4 + F.col("call"))).alias("carriers"))
    table = people.join(carried, "sidx", "left").withColumn("carriers", F.coalesce("carriers", F.array().cast("array<long>")))
    if not variants:
        return table.select(*people.columns, F.lit("").alias("genotypes")).limit(0)
    if keep:
        wanted = [*[v for v in keep.values if v], *([MISSING] if keep.missing else [])]
        table = table.where(F.exists("carriers", lambda c: c.bitwiseAND(3).isin(wanted)) | (F.lit(0 in keep.values) & (F.size("carriers") < variants)))
    return _carriers_text(table, variants, keep)


def sample_counts(data: Genotypes, places: list[int] | None = None) -> DataFrame:
    """(sidx, genotypes) counts of every sample.

    Calls are summed by sample within each partition. With the setting
    sample_counts_sparse only the saved carriers of rare variants are read.
    """
    spark = data.spark
    everyone = data.samples.select("sidx") if data.samples is not None else spark.range(data.n).select(F.col("id").cast("int").alias("sidx"))
    c = sample_tallies(data, places, bool(setting(spark, "sample_counts_sparse")))
    if places is not None:
        where = spark.createDataFrame(pa.table({"k": pa.array(range(len(places)), pa.int32()), "sidx": pa.array(places, pa.int32())}))
        everyone, c = everyone.join(where.select("sidx"), "sidx"), c.join(where, "k")
    else:
        c = c.withColumnRenamed("k", "sidx")
    total = data.sites.agg(F.count("*").alias("variants"))
    got = everyone.join(c.select("sidx", "het", "alt", "miss"), "sidx", "left").join(F.broadcast(total))  # one row
    het, alt, miss = (F.coalesce(F.col(x), F.lit(0)) for x in ("het", "alt", "miss"))
    counts = F.struct((F.col("variants") - het - alt - miss).alias("hom_ref"), het.alias("het"), alt.alias("hom_alt"), miss.alias("missing"))
    return got.select("sidx", counts.alias("genotypes"))
