import random

import numpy as np
import xxhash

from genospan.llm import simhash
from genospan.llm.graph import connected_components


def brute_fp(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_roots(fps):
    roots = {f: f for f in fps}

    def find(f):
        while roots[f] != f:
            f = roots[f]
        return f

    fps = list(roots)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                roots[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_components_match_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(60)]
    for t in list(texts[:30]):
        w = t.split()
        if w:
            w[rng.randrange(len(w))] = "X"
        texts += [" ".join(w), t, t.upper()]
    texts += [None, "", " \n\t ", "a", "A", "café \x1c b", "x" * 50_000, "the " * 9_000]
    docs = spark.createDataFrame([(i * 7 % 1009, t, "zz") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    rows = simhash.simhash_components(docs).collect()
    assert len(rows) == len(texts)
    fps = {i * 7 % 1009: brute_fp(t) for i, t in enumerate(texts)}
    roots = brute_roots(fps.values())
    least = {}
    for d, f in fps.items():
        least[roots[f]] = min(d, least.get(roots[f], d))
    for r in rows:
        assert r.fingerprint == f"{fps[r.doc_id]:016x}"
        assert r.component_id == least[roots[fps[r.doc_id]]]


def test_links_span_components_of_dense_balls(spark):
    rng = random.Random(1)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        fps.add(centre)
        for _ in range(40):
            f = centre
            for _ in range(rng.randint(1, 6)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    base = rng.getrandbits(64)
    fps |= {base, base ^ 0b10101, base ^ (7 << 60), base ^ (7 << 60) ^ (7 << 43)}  # three flips in one block
    frame = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    links = simhash.near_links(frame)
    roots = brute_roots(fps)
    got = {r.node: r.root for r in connected_components(links).collect()}
    to_u = lambda v: v & (1 << 64) - 1
    mine = {f: f for f in fps} | {to_u(k): to_u(v) for k, v in got.items()}
    pairs = lambda m: {frozenset(x for x in m if m[x] == r) for r in set(m.values())}
    assert pairs(mine) == pairs(roots)


def test_large_one_block_group_uses_lookups():
    rng = np.random.default_rng(0)
    x = np.unique(rng.integers(0, 1 << 21, 1300).astype(np.int64))[:1200]
    i, j = simhash._triples(np.zeros(len(x), np.int64), x, 21)
    want = {(a, b) for a, b in zip(*np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) == 3, 1)), strict=True)}
    assert {(min(a, b), max(a, b)) for a, b in zip(i, j, strict=True)} == want


def test_filter_keeps_one_of_each_class(spark):
    docs = spark.createDataFrame(
        [(3, "one two three four", "s"), (1, "One two three FOUR", "s"), (2, "other words here now", None), (1, "One two three FOUR", "s"), (4, None, None), (9, "", None)],
        "doc_id long, text string, source string",
    )
    assert sorted(r.doc_id for r in simhash.drop_near_copies(docs).collect()) == [1, 2, 4]
    assert simhash.simhash_components(docs.where("false")).count() == 0
