"""Readers, saved matrices and packed calls."""

import math

import numpy as np
import pytest

import genospan as gs
from genospan.functions import packing
from genospan.functions.numerics import hwe_exact, least_squares, linear_block
from genospan.queries import QUERIES

HEAD = "##fileformat=VCFv4.3\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb\tc\n"


def vcf_of(path, rows):
    path.write_text(HEAD + "".join("\t".join([c, str(p), i, "A", alt, ".", ".", ".", fmt, *calls.split(" ")]) + "\n" for c, p, i, alt, fmt, calls in rows))
    return str(path)


def test_packed_calls():
    rng = np.random.default_rng(0)
    for n in (1, 4, 13, 101):
        g = rng.integers(-1, 3, (37, n)).astype(np.int8)
        raw = packing.pack(g)
        codes = packing.unpack(raw, n)
        assert (np.where(g < 0, packing.MISSING, g) == codes).all()
        places = np.sort(rng.permutation(n)[: max(1, n // 3)])
        assert (packing.unpack(raw, n, places) == codes[:, places]).all()
        got = packing.counts(raw, [packing.select_mask(n, None), packing.select_mask(n, places)])
        for k, own in enumerate((codes, codes[:, places])):
            assert (got[k] == np.stack([(own == v).sum(axis=1) for v in (1, 2, 3)], axis=1)).all()
        total = np.zeros((3, n), dtype=np.int64)
        packing.sample_tally(codes, total)
        assert (total == np.stack([(codes == v).sum(axis=0) for v in (1, 2, 3)])).all()
        offsets, values = packing.carriers_of(codes)
        assert all(values[offsets[r] : offsets[r + 1]].tolist() == [4 * i + int(x) for i, x in enumerate(codes[r]) if x] for r in range(37))


def test_vcf_keeps_gt_beside_ds(spark, tmp_path):
    rows = [
        ("1", 1, "first", "G", "GT", "0/1 1/1 0/0"),
        ("1", 2, "both", "G", "GT:DS", "0/1:0.8 1/1:. 0/0:0.0"),
        ("1", 3, "many", "G,T", "GT", "0/1 1/2 0/0"),
        ("1", 4, "late", "G", "GT:GQ:DS", "./.:3:1.5 0|1:9:1.02 1/1:2"),
        ("1", 5, "dosage", "G", "DS", "1.98 0.5 0.02"),
    ]
    path = vcf_of(tmp_path / "mixed.vcf", rows)
    with pytest.warns(UserWarning, match="skipped 1 multiallelic"):
        data = gs.vcf(spark, path)
    got = {r.ID: (r.gt, r.ds) for r in data.table.collect()}
    assert got["first"] == ([1, 2, 0], None)
    assert got["both"][0] == [1, 2, 0] and got["both"][1][1:] == [None, 0.0] and abs(got["both"][1][0] - 0.8) < 1e-4
    assert got["late"][0] == [None, 1, 2] and got["late"][1][2] is None
    assert got["dosage"][0] == [None, None, None] and "many" not in got
    doses = {r.ID: r.genotypes for r in gs.shape(data, "read_pfile", dosages=True).collect()}
    assert doses["first"] == [1.0, 2.0, 0.0] and doses["both"][1] == 2.0 and doses["late"][0] == 1.5
    hard = {r.ID: r.gt for r in gs.vcf(spark, path, ds_calls=True, warn=False).table.collect()}
    assert hard["both"] == [None, 2, 0] and hard["late"] == [None, 1, 2] and hard["dosage"] == [2, None, 0]
    assert "ds" not in gs.vcf(spark, vcf_of(tmp_path / "plain.vcf", rows[:1])).table.columns


def test_chromosomes_must_be_contiguous_and_counts_must_agree(spark, tmp_path):
    vcf_of(tmp_path / "torn.vcf", [("1", 1, "a", "G", "GT", "0/1 1/1 0/0"), ("2", 2, "b", "G", "GT", "0/1 1/1 0/0"), ("1", 3, "c", "G", "GT", "0/1 1/1 0/0")])
    with pytest.raises(ValueError, match="chromosome '1' appears in non-contiguous runs"):
        gs.load(spark, "freq", str(tmp_path / "torn"))
    vcf_of(tmp_path / "two.vcf", [("1", 1, "a", "G", "GT", "0/1 1/1 0/0"), ("1", 2, "b", "G", "GT", "0/1 1/1 0/0")])
    (tmp_path / "one.pvar").write_text("#CHROM\tPOS\tID\tREF\tALT\n1\t5\tz\tA\tG\n")
    (tmp_path / "named.pvar").write_text("#CHROM\tPOS\tID\tREF\tALT\n1\t5\tz\tA\tG\n1\t6\ty\tA\tG\n")
    with pytest.raises(ValueError, match="variant count mismatch"):
        gs.load(spark, "freq", str(tmp_path / "two"), pvar=str(tmp_path / "one.pvar"))
    assert [r.ID for r in gs.freq(gs.load(spark, "freq", str(tmp_path / "two"), pvar=str(tmp_path / "named.pvar"))).orderBy("POS").collect()] == ["z", "y"]


def test_search_path_finds_filesets(spark, tmp_path):
    vcf_of(tmp_path / "found.vcf", [("1", 1, "a", "G", "GT", "0/1 1/1 0/0")])
    (tmp_path / "found.psam").write_text("#IID\tSEX\na\t1\nb\t2\nc\t1\n")
    with pytest.raises(ValueError, match="cannot find"):
        gs.load(spark, "freq", "found")
    gs.set_setting(spark, "search_path", f"/nowhere,{tmp_path}")
    try:
        data = gs.load(spark, "freq", "found")
        assert data.sexes() == [1, 2, 1] and gs.freq(data).first().ALT_FREQ == 0.5
        assert gs.read_samples(spark, "found.psam").count() == 3
    finally:
        gs.set_setting(spark, "search_path", "")


def test_saved_matrix_answers_like_its_source(spark, tmp_path):
    rng = np.random.default_rng(5)
    n, m = 50, 120
    g = rng.choice([0, 0, 0, 0, 0, 1, 2, -1], (m, n))
    g[::3] = np.where(rng.random((m // 3, n)) < 0.02, 1, 0)  # rare: saved as carriers
    rows = [(i, ["1", "X", "MT"][i // 40], i * 10, f"v{i}", "A", "G", [None if x < 0 else int(x) for x in r]) for i, r in enumerate(g)]
    table = spark.createDataFrame(rows, "vidx long, CHROM string, POS int, ID string, REF string, ALT string, gt array<tinyint>")
    people = spark.createDataFrame([(i, f"s{i}", 1 + i % 2) for i in range(n)], "sidx int, IID string, SEX int")
    plain = gs.Genotypes(table, people, n)
    plain.write(str(tmp_path / "saved"))
    saved = gs.load(spark, "test", str(tmp_path / "saved"))
    assert saved.n == n and saved.calls == "packed"
    rounded = lambda df: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)
    same = lambda f: rounded(f(plain)) == rounded(f(saved))
    some = [f"s{i}" for i in range(3, 40, 4)]
    assert same(lambda d: gs.freq(d, counts=True, build="none")) and same(lambda d: gs.freq(d, counts=True, samples=some))
    assert same(lambda d: gs.hardy(d, build="none", midp=True)) and same(lambda d: gs.missing(d, samples=some)) and same(lambda d: gs.missing(d, "sample"))
    assert same(lambda d: gs.shape(d, "t", genotypes="stats")) and same(lambda d: gs.shape(d, "t", region="X:500-700", include_genotypes=["hom_alt"]))
    assert same(lambda d: gs.ld(d, r2_threshold=0.02, samples=some)) and same(lambda d: gs.ld(d, r2_threshold=0.1, inter_chr=True))
    assert same(lambda d: gs.score(d, [{"id": f"v{i}", "allele": "AG"[i % 2], "weight": i / 7} for i in range(m)], samples=some))
    counts = lambda d, **k: {r.IID: tuple(r.genotypes) for r in gs.shape(d, "t", orient="sample", genotypes="counts", **k).collect()}
    want = {f"s{i}": ((g[:, i] == 0).sum(), (g[:, i] == 1).sum(), (g[:, i] == 2).sum(), (g[:, i] < 0).sum()) for i in range(n)}
    gs.set_setting(spark, "sample_counts_sparse", True)
    try:
        assert counts(saved) == want and counts(saved, samples=some) == {k: want[k] for k in some}
    finally:
        gs.set_setting(spark, "sample_counts_sparse", False)
    assert counts(saved) == want and counts(plain, samples=some) == {k: want[k] for k in some}


def test_exact_test_far_from_the_mode():
    def whole(ref, het, alt):
        n = ref + het + alt
        rare = 2 * min(ref, alt) + het
        logs = {h: h * math.log(2) - math.lgamma((rare - h) / 2 + 1) - math.lgamma(h + 1) - math.lgamma((2 * n - rare - h) / 2 + 1) for h in range(rare % 2, rare + 1, 2)}
        top = max(logs.values())
        p = {h: math.exp(x - top) for h, x in logs.items()}
        return sum(x for x in p.values() if x <= p[het] * (1 + 1e-8)) / sum(p.values())

    for c in ((9800, 40, 80), (5000, 0, 5000), (9999, 1, 0), (4000, 5000, 1000), (0, 10, 0), (9900, 2, 98)):
        assert math.isclose(hwe_exact(*c), whole(*c), rel_tol=1e-6, abs_tol=1e-300)


def test_blocks_of_regressions_equal_single_ones():
    rng = np.random.default_rng(2)
    n = 200
    y = rng.normal(size=n) * 3 + 1000
    y[::17] = np.nan
    extra = np.column_stack([rng.normal(50, 10, n), rng.integers(0, 2, n)])
    g = rng.integers(0, 3, (40, n)).astype(float)
    g[rng.random(g.shape) < 0.1] = np.nan
    g[0], g[1] = 1.0, extra[:, 1]
    got = linear_block(y, extra)(g)
    assert got[0] is None and got[1] is None and all(got[2:])
    for row, x in zip(got[2:], g[2:], strict=True):
        use = ~(np.isnan(x) | np.isnan(y))
        error, beta, se, t, p = least_squares(np.column_stack([np.ones(use.sum()), x[use], extra[use]]), y[use])
        assert error is None and row[1] == use.sum() and np.allclose([row[0], *row[2:6]], [x[use].mean() / 2, beta, se, t, p], rtol=1e-7, atol=1e-12)


def test_vcf_cells_by_their_texts(spark, tmp_path):
    """Lists, texts and sums of calls come from the distinct cells of a line, whatever their width."""
    rows = [
        ("1", 1, "a", "G", "GT", "0/1 1/1 0/0 0/0"), ("1", 2, "b", "G", "GT:DS", "0/1:1.25 ./.:0.5 0/0:0.0625 1|0:."), ("1", 3, "c", "G", "GT", "0 1 . 0/1"),
        ("1", 4, "d", "G", "DS", "0.1 1.96 3 nan"), ("1", 5, "e", "G", "DP", "1 2 3 4"), ("1", 6, "f", "G", "GT:GQ", "0/0 0/1:9 1/1:30 0/1:x"), ("1", 7, "g", "G,T", "GT", "0/1 0/2 0/0 0/0"),
    ]
    path = vcf_of(tmp_path / "cells.vcf", rows)
    lines = open(path).read().replace("FORMAT\ta\tb\tc", "FORMAT\ta\tb\tc\td")
    open(path, "w").write(lines)
    data = gs.vcf(spark, path, min_gq=20, warn=False)
    got = {r.ID: r for r in data.table.collect()}
    assert got["a"].gt == [1, 2, 0, 0] and got["a"].ds is None and got["b"].gt == [1, None, 0, 1] and got["b"].ds == [1.25, 0.5, 0.0625, None]
    assert got["b"].phase == [False, False, False, True] and got["c"].gt == [0, 2, None, 1] and got["e"].gt == [None] * 4
    assert got["d"].gt == [None] * 4 and got["d"].ds == [round(0.1 * 16384) / 16384, round(1.96 * 16384) / 16384, None, None]
    assert got["f"].gt == [0, None, 2, 1] and "g" not in got
    texts = {r.id: r.genotypes for r in gs.read_vcf(spark, path, genotypes="text", min_gq=20).collect()}
    assert texts == {k: "".join("." if g is None else str(g) for g in r.gt) for k, r in got.items()}
    listed = gs.freq(gs.Genotypes(data.table, data.samples, data.n), dosage=True).collect()
    assert sorted(map(str, gs.freq(data, dosage=True).collect())) == sorted(map(str, listed))


def test_vcf_texts_and_sums_need_no_lists(spark):
    """Every cell was split and taken apart on its own, and listed, to give a character or a sum."""
    for name in ("read_vcf_calls", "vcf_dosage_freq"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "carriers" in plan and "gt#" not in plan


def test_many_cells_of_a_line_cost_little():
    """300,000 samples: words of a line that differ from its first are looked at."""
    from genospan.sources.vcflines import _cells

    n = 300_000
    cells = ["0/0"] * n
    cells[7], cells[n - 1], cells[100] = "0|1", "1/1", "./."
    for extra in ("", "\tx"):  # the second line has a field too many and goes the general way
        index, texts = _cells(("\t".join(cells) + extra).encode(), n)
        assert [texts[index[i]] for i in (0, 7, 100, n - 1)] == ["0/0", "0|1", "./.", "1/1"] and len(index) == n and len(texts) == 4
    assert _cells("0/1\t0\t1".encode(), 4) is None
    assert [_cells(b"0\t1\t0/1/1\t.", 4)[1][i] for i in range(4)] == ["0", "1", "0/1/1", "."]
