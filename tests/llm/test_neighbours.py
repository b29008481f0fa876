import itertools

import numpy as np

from genospan.llm import neighbours


def test_hilbert_curve_visits_every_cell_by_unit_steps():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        keys = neighbours.hilbert_keys(cells, bits)
        order = np.argsort(keys)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[order].astype(int), axis=0)).sum(axis=1) == 1).all()


def exact(rows, every, k):
    good = [(i, np.array(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 12]
    ids, m = np.array([i for i, _ in good]), np.stack([v for _, v in good])
    out = {}
    for i, v in good:
        if i % every == 0:
            d = np.sqrt(((m - v) ** 2).sum(axis=1))
            order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def test_search_against_brute_force(spark):
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((20, 12)) * 3
    m = centres[rng.integers(0, 20, 3000)] + rng.standard_normal((3000, 12)) * 0.5
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(m)]
    rows += [(10_000 + i, rows[5][1]) for i in range(0, 60)]  # copies, some of them queries
    rows += [(20_000, None), (20_010, [0.0] * 12), (20_020, [float("nan")] * 12), (20_030, [None] + [1.0] * 11), (20_040, [1.0, 2.0]), (None, rows[3][1]), (20_050, [float("inf")] * 12), (20_060, [])]
    frame = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<double>, score double")
    want = exact(rows, 10, 10)
    got = {}
    for r in neighbours.search(frame, every=10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert got.keys() == want.keys()
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11)) and q not in [f[1] for f in found]
        assert [(f[2], f[1]) for f in found] == sorted((f[2], f[1]) for f in found)
        hits += len({f[1] for f in found} & {w[0] for w in want[q]})
    assert hits / sum(map(len, want.values())) >= 0.93
    assert [f[1] for f in got[10_010]] == [5, *range(10_000, 10_009)]
    few = frame.where("vec_id in (0, 1, 2)")
    assert [(r.query_id, r.rank) for r in neighbours.search(few, every=10).orderBy("rank").collect()] == [(0, 1), (0, 2)]
    assert neighbours.search(frame.where("false")).count() == 0
