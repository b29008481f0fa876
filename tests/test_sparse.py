"""A sparse dataset, held as the calls that aren't hom-ref, gives what the same calls give as lists."""

import re
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

import genospan as gs
from genospan.functions import packing
from genospan.operators.matrix import by_call
from genospan.plans.derived import dataset, text_fileset
from genospan.queries import QUERIES

ld_module = sys.modules["genospan.operators.ld"]

SITES = "vidx long, CHROM string, POS int, ID string, REF string, ALT string"
N = 37


@pytest.fixture(scope="module")
def pair(spark):
    rng = np.random.default_rng(5)
    calls = rng.choice([0, 1, 2, 3], (70, N), p=[0.7, 0.15, 0.1, 0.05])
    calls[3] = 0
    calls[7] = 3
    chrom = ["1"] * 40 + ["X"] * 20 + ["Y"] * 10
    site = [(i, chrom[i], 100 * i, f"v{i}", "A", "G") for i in range(len(calls))]
    people = spark.createDataFrame([(i, f"s{i}", i % 3, float(i * i % 17), float(i % 5 > 2)) for i in range(N)], "sidx int, IID string, SEX int, y double, sick double").persist()
    dense = spark.createDataFrame([(*s, [None if g == 3 else int(g) for g in row]) for s, row in zip(site, calls, strict=True)], SITES + ", gt array<tinyint>")
    rows = []
    for s, row in zip(site, calls, strict=True):
        at = np.flatnonzero(row)
        rows.append((*s, *(int((row == k).sum()) for k in (1, 2, 3)), len(at), [int(4 * i + row[i]) for i in at]))
    sparse = spark.createDataFrame(rows, SITES + ", n_het int, n_hom_alt int, n_missing int, n_other int, carriers array<long>")
    return gs.Genotypes(dense.persist(), people, N), gs.Genotypes(sparse.persist(), people, N)


def same(a, b, digits=9):
    tidy = lambda df: sorted((tuple(round(x, digits) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)
    assert a.columns == b.columns
    assert repr(tidy(a)) == repr(tidy(b))


SOME = [30, 2, 17, 5, 11, 23]


@pytest.mark.parametrize("samples", [None, SOME])
def test_sparse_statistics(pair, samples):
    for call in (
        lambda d: gs.freq(d, counts=True, build="none", samples=samples),
        lambda d: gs.hardy(d, midp=True, build="none", samples=samples),
        lambda d: gs.missing(d, samples=samples),
        lambda d: gs.missing(d, "sample", samples=samples),
        lambda d: gs.ld(d, window_kb=1, r2_threshold=0, samples=samples),
        lambda d: gs.ld(d, "v2", "v50", samples=samples),
    ):
        same(*map(call, pair))


@pytest.mark.parametrize("samples", [None, SOME])
def test_sparse_shapes(pair, samples):
    for options in (
        {"genotypes": "counts"}, {"genotypes": "stats"}, {"genotypes": "list"}, {"genotypes": "text"}, {"genotypes": "text", "include_genotypes": ["het", "missing"]},
        {"orient": "sample", "genotypes": "counts"}, {"orient": "genotype", "include_genotypes": ["hom_alt", "missing"]}, {"orient": "genotype", "include_genotypes": ["hom_ref"]},
        {"af_range": {"min": 0.1, "max": 0.3}, "region": "X", "genotypes": "counts"}, {"genotype_range": {"min": 1, "max": 2}},
    ):
        same(*(gs.shape(d, "read_pfile", samples=samples, **options) for d in pair))


@pytest.mark.parametrize("samples", [None, SOME])
@pytest.mark.parametrize("how", [{}, {"center": True}, {"no_mean_imputation": True}])
def test_sparse_scores(pair, samples, how):
    weights = pair[0].table.select(F.col("ID").alias("id"), F.when(F.col("vidx") % 2 == 0, "A").otherwise("G").alias("allele"), ((F.col("vidx") % 5) / 2.0).alias("weight"))
    same(*(gs.score(d, weights, samples=samples, **how) for d in pair), digits=7)


def test_sparse_save(spark, pair, tmp_path):
    pair[1].write(str(tmp_path / "saved"))
    again = gs.load(spark, "test", str(tmp_path / "saved"))
    assert again.sparse and again.n == N and "packed" not in again.table.columns
    same(gs.freq(again, build="none"), gs.freq(pair[0], build="none"))
    twice = gs.read_fileset(spark, [str(tmp_path / "saved")] * 2, combine_samples="identical", genotypes="text")
    assert twice.count() == 2 * pair[0].table.count()


def test_derived_dataset_is_as_large_as_its_carriers(spark):
    """It was a dense matrix: at 60 times the tables, 270 GB of packed calls."""
    data = dataset(spark, "/root/testdata/sf0.001")
    assert data.sparse and "packed" not in data.table.columns
    stored, other = data.table.agg(F.sum(F.size("carriers")), F.sum("n_other")).first()
    assert stored == other < data.n * data.table.count()


def test_cost_does_not_depend_on_the_number_of_samples(spark, pair):
    """Two variants over 2^28 samples: dense calls would be half a GB a row."""
    n = 1 << 28
    few = pair[1].table.where("vidx < 2")
    d = gs.Genotypes(few, None, n)
    got = gs.shape(d, "read_pfile", genotypes="counts").agg(F.sum("genotypes.hom_ref")).first()[0]
    assert got == 2 * n - few.agg(F.sum("n_other")).first()[0]
    assert gs.ld(d, "v0", "v1").first().OBS_CT > n - N
    assert gs.missing(d).agg(F.max("OBS_CT")).first()[0] <= n


def test_carriers_round_trip():
    rng = np.random.default_rng(2)
    codes = rng.choice([0, 1, 2, 3], (9, 21), p=[0.6, 0.2, 0.1, 0.1]).astype(np.uint8)
    import pyarrow as pa

    offsets, values = packing.carriers_of(codes)
    column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
    assert (packing.spread(column, 21) == codes).all() and (packing.spread(column.slice(3, 4), 21) == codes[3:7]).all()


def test_sparse_regressions(pair):
    """Fits from counts by call; with covariates or chosen samples, from the calls themselves."""
    import itertools

    for phenotype, options in itertools.product(("y", "sick"), ({}, {"samples": SOME}, {"covariates": {"age": [float(i % 7) for i in range(N)]}}, {"region": "X:0-4500", "firth": False})):
        same(*(gs.glm(d, phenotype, **options) for d in pair), digits=5)
    same(*(gs.glm(d, [None if i % 6 == 0 else float(i) for i in range(N)]) for d in pair), digits=6)
    same(*(gs.glm(d, [1.0 + i % 2 for i in range(N)]) for d in pair), digits=5)
    for bad, text in (([1.0] * N, "constant phenotype"), ([None] * N, "at least 3"), ([1.0], "phenotype length"), ("nope", "has no column")):
        with pytest.raises(ValueError, match=text):
            gs.glm(pair[1], bad)


def test_sparse_components(spark, pair):
    """Every matrix a table: true eigenvalues, axes of unit length at right angles."""
    sparse = pair[1]
    rng = np.random.default_rng(1)
    n, m = 60, 400
    g = rng.binomial(2, rng.uniform(0.05, 0.95, (3, m))[np.repeat([0, 1, 2], 20)]).T
    g[rng.random(g.shape) < 0.02] = 3
    rows = [(i, "1", i, f"v{i}", "A", "G", *(int((r == c).sum()) for c in (1, 2, 3)), int((r > 0).sum()), [int(4 * j + r[j]) for j in np.flatnonzero(r)]) for i, r in enumerate(g)]
    table = spark.createDataFrame(rows, SITES + ", n_het int, n_hom_alt int, n_missing int, n_other int, carriers array<long>")
    grouped = gs.Genotypes(table, spark.createDataFrame([(i, f"s{i}") for i in range(n)], "sidx int, IID string"), n)
    x = np.where(g == 3, np.nan, g.astype(float))
    f = np.nanmean(x, axis=1, keepdims=True) / 2
    z = np.nan_to_num((x - 2 * f) / np.sqrt(2 * f * (1 - f)))
    true = np.linalg.eigvalsh(z.T @ z / m)[::-1]
    assert all(abs(r.EIGENVALUE - t) < 0.02 * t for r, t in zip(gs.pca(grouped, "pcs", n_pcs=2).collect(), true, strict=False))
    rows = {r.IID: (r.PC1, r.PC2) for r in gs.pca(sparse, n_pcs=2).collect()}
    x = np.array([rows[f"s{i}"] for i in range(N)])
    assert np.allclose(x.T @ x, np.eye(2), atol=1e-9)
    few = gs.pca(sparse, n_pcs=1, samples=SOME).collect()
    assert {r.IID for r in few} == {f"s{i}" for i in SOME}


def test_text_folder_in_order_of_its_parts(spark, tmp_path):
    """Lines of a folder are numbered by the names of its parts, though Spark packs the largest first."""
    folder = tmp_path / "v.pvar"
    folder.mkdir()
    (folder / "part-0.txt").write_text("##x\n#CHROM\tPOS\tID\tREF\tALT\n1\t0\tv0\tA\tG\n")
    (folder / "part-1.txt").write_text("".join(f"1\t{i}\tv{i}\tA\tG\n" for i in range(1, 2000)))
    (folder / "part-2.txt").write_text("1\t2000\tv2000\tA\tG\n")
    got = gs.read_variants(spark, str(folder)).where("vidx != POS").count(), gs.read_variants(spark, str(folder)).count()
    assert got == (0, 2001)


def test_only_the_asked_text_files_are_written(spark):
    """A variant file took the whole matrix as VCF text with it."""
    import glob

    prefix = text_fileset(spark, "/root/testdata/sf0.001", (".pvar",)).removeprefix("file://")
    assert [p.removeprefix(prefix) for p in glob.glob(prefix + "*")] == [".pvar"]


SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_dealt_out_once(spark):
    """Lines went to their order, to their call and to their part, with tasks that grew with the tables."""
    physical = plan_of(QUERIES["host_group_having"](spark, SF))[1]
    assert "vidx" in physical and not re.search(r"hashpartitioning\(vidx#\d+L?, sidx#", physical)
    assert "REPARTITION_BY_NUM" in physical


def test_places_are_chosen_before_calls_are_made(spark):
    """Every variant was counted and tested for the 150 of X, Y and MT."""
    data = dataset(spark, SF)
    where = F.col("CHROM").isin("c2", "X")
    some = data.within(where)
    same(some.table, data.table.where(where))
    same(some.long, by_call(some.table, "vidx").select("vidx", "sidx", "call"))
    assert data.within(None) is data
    tested = plan_of(QUERIES["hardy_sex_aware_midp"](spark, SF))[0]
    assert "Filter" not in tested.split("MapInArrow")[0]  # nothing is left to choose after the tests


def test_sample_counts_need_no_lists(spark):
    """Calls were gathered into lists by variant and taken apart again."""
    for name in ("missing_by_sample", "shape_sample_counts"):
        assert "collect_list" not in plan_of(QUERIES[name](spark, SF))[0]


def test_counts_read_twice_are_made_once(spark):
    for name in ("host_join_window_topk", "host_set_operations"):
        assert "l_partkey" not in plan_of(QUERIES[name](spark, SF))[0]


def test_window_reads_the_calls_once(spark, pair):
    """The dataset was made for both sides of all block pairs."""
    assert plan_of(QUERIES["ld_window"](spark, SF))[0].count("collect_list") == 1
    same(*(gs.ld(d, window_kb=1.5, r2_threshold=0.01, inter_chr=True) for d in pair))


def test_shared_carriers_tell_what_products_tell(monkeypatch, pair):
    """Where samples carry much in common, tiles are multiplied."""
    few = gs.ld(pair[1], window_kb=2, r2_threshold=0).orderBy("ID_A", "ID_B").collect()
    tile = [ld_module._Tile(b) for b in pair[1].table.toArrow().combine_chunks().to_batches()][0]
    i, j = np.nonzero(np.triu(np.ones((tile.size, tile.size), dtype=bool), 1))
    got = ld_module._shared_stats(tile, tile, i, j, N)
    want = [m[i, j] for m in ld_module.pair_stats(*ld_module._carried(tile.rows, tile.rows, N))]
    assert all(np.allclose(g, w, equal_nan=True) for g, w in zip(got, want, strict=True)) and few
    monkeypatch.setattr(ld_module, "_SHARED", 0)
    assert ld_module._shared_stats(tile, tile, i, j, N) is None
    run = ld_module._measured(N, None, lambda x, y: x.vidx[:, None] < y.vidx[None, :], 0)
    rows = pair[1].table.select("vidx", "CHROM", "POS", "ID", "carriers").toArrow()
    assert run(rows, rows).num_rows == np.isfinite(want[0]).sum()


def test_dosage_sums_without_lists(spark):
    """A dosage for every call was listed: the square of the tables."""
    data = dataset(spark, SF, dosages=True)
    text = plan_of(QUERIES["freq_dosage"](spark, SF))[0]
    assert "MapInArrow" not in text and "collect_list" not in text
    listed = gs.Genotypes(data.table, data.samples, data.n)
    same(gs.freq(data, dosage=True), gs.freq(listed, dosage=True))
    same(gs.freq(data, dosage=True, region="c2:300-900"), gs.freq(listed, dosage=True, region="c2:300-900"))


@pytest.mark.parametrize("least", [0.02, 0.15])
def test_pairs_across_chromosomes_by_their_carriers(pair, monkeypatch, least):
    """All pairs of blocks met; now frequent variants do, and the others where they share a carrier."""
    rare = gs.Genotypes(pair[1].table, pair[1].samples, 4000)  # so many samples that few variants are frequent
    found = ld_module._across(rare, 1000, least)
    assert found is None or found[1].count() < rare.table.count()
    ways = {}
    for few in (True, False):
        if not few:
            monkeypatch.setattr(ld_module, "_across", lambda *a: None)
        ways[few] = gs.ld(rare, window_kb=1, r2_threshold=least, inter_chr=True)
    same(ways[True], ways[False])


def test_few_samples_share_little(spark):
    """60 variants over 400 samples, three carriers each: pairs are told by carriers alone."""
    rng = np.random.default_rng(9)
    sites = [(i, f"c{i // 15}", 100 * i, f"v{i}", "A", "G") for i in range(60)]
    rows = []
    for x in sites:
        at = np.sort(rng.choice(400, 3, replace=False)) if x[0] % 4 else np.array([1, 2, 3 + x[0] // 20])
        call = rng.choice([1, 2, 3], 3, p=[0.6, 0.3, 0.1])
        rows.append((*x, *(int((call == k).sum()) for k in (1, 2, 3)), 3, [int(4 * i + g) for i, g in zip(at, call, strict=True)]))
    data = gs.Genotypes(spark.createDataFrame(rows, SITES + ", n_het int, n_hom_alt int, n_missing int, n_other int, carriers array<long>"), None, 400)
    pairs, frequent = ld_module._across(data, 1000, 0.1)
    assert frequent.count() == 0 and pairs.count() > 20
    dense = gs.Genotypes(data.wide, None, 400)
    same(*(gs.ld(d, window_kb=1, r2_threshold=0.1, inter_chr=True) for d in (data, dense)))


@pytest.mark.parametrize("mode", ["columns", "struct", "list"])
def test_columns_unpack_the_chosen_samples(pair, mode):
    """Every call of 2^24 samples was unpacked, and every name came to the driver, for three of them."""
    for options in ({}, {"include_genotypes": ["het", "missing"]}):
        same(*(gs.shape(d, "read_pfile", samples=[30, 2, 17], genotypes=mode, **options) for d in pair))
    same(*(gs.shape(d, "read_pfile", samples=["s30", "s2"], genotypes=mode) for d in pair))
    same(*(gs.shape(d, "read_pfile", samples=[30, 2], genotypes=mode, phased=True) for d in pair))
    many = gs.Genotypes(pair[1].table, pair[1].samples, 1 << 24)
    same(*(gs.shape(d, "read_pfile", samples=[30, 2, 17], genotypes=mode) for d in (pair[0], many)))


def test_kept_calls_are_counted_without_lists(spark, pair):
    """All calls of a variant were unpacked to count the ones a category filter keeps."""
    text = plan_of(QUERIES["shape_category_filter"](spark, SF))[0]
    assert "MapInArrow" not in text and "collect_list" not in text
    for d in pair:
        lists = gs.shape(d, "read_pfile", include_genotypes=["hom_alt"]).select("ID", F.size(F.filter("genotypes", lambda g: g.isNotNull())).alias("kept"))
        counts = gs.shape(d, "read_pfile", include_genotypes=["hom_alt"], genotypes="counts").select("ID", F.col("genotypes.hom_alt").cast("int").alias("kept"))
        same(lists, counts)


@pytest.mark.parametrize("samples", [None, SOME])
def test_sample_texts(spark, pair, samples):
    """Every call was a row that went to its sample."""
    text = plan_of(QUERIES["shape_sample_lists"](spark, SF))[0]
    assert "MapInArrow" not in text and "posexplode" not in text.lower()
    for options in ({}, {"include_genotypes": ["het", "missing"]}, {"include_genotypes": ["hom_ref"]}, {"region": "X"}, {"region": "X:1-2"}):
        texts = [gs.shape(d, "read_pfile", orient="sample", genotypes="text", samples=samples, **options) for d in pair]
        same(*texts)
        lists = gs.shape(pair[0], "read_pfile", orient="sample", samples=samples, **options)
        same(texts[1], lists.withColumn("genotypes", F.array_join(F.transform("genotypes", lambda g: F.coalesce(g.cast("string"), F.lit("."))), "")))


def test_places_in_order(spark):
    from genospan.operators.matrix import ranked

    ids = [0, 5, 65535, 65536, 65537, 200000, 1 << 40]
    got = {r.vidx: r.at for r in ranked(spark.createDataFrame([(i,) for i in reversed(ids)], "vidx long"), "at").collect()}
    assert got == {v: i for i, v in enumerate(ids)}


def test_text_of_the_asked_chromosomes(spark):
    """A query of one chromosome had the VCF of all of them written."""
    where = F.col("CHROM").isin("c1", "c2")
    path = text_fileset(spark, "/root/testdata/sf0.01", (".vcf",), where) + ".vcf"
    assert {r.CHROM for r in gs.vcf(spark, path, warn=False).table.select("CHROM").distinct().collect()} == {"c1", "c2"}
    whole = gs.vcf(spark, text_fileset(spark, "/root/testdata/sf0.001", (".vcf",)) + ".vcf", region="c2", warn=False)
    part = gs.vcf(spark, text_fileset(spark, "/root/testdata/sf0.001", (".vcf",), where) + ".vcf", region="c2", warn=False)
    same(whole.table.drop("vidx"), part.table.drop("vidx"))
