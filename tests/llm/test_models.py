import random

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from genospan.llm import langid, minhash, nearcopies, tokencount

BPE = public_tokenizers.path("byte_bpe_50k.json")


def greedy(word, starts, continues):
    at = n = 0
    while at < len(word):
        known = starts if at == 0 else continues
        size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in known), 0)
        if not size:
            return 1
        at, n = at + size, n + 1
    return n


pieces = st.sets(st.text("abc", min_size=1, max_size=5).map(str.encode), max_size=12)


@settings(max_examples=400, deadline=None)
@given(pieces, pieces, st.lists(st.text("abcd", max_size=14).map(str.encode), max_size=6))
def test_automaton_equals_greedy(starts, continues, words):
    automaton = tokencount.LongestMatch(sorted(starts), sorted(continues))
    for w in words:
        assert automaton.count(w) == greedy(w, starts, continues)


def test_counts_over_the_real_vocabulary(spark):
    starts, continues = tokencount.byte_vocabulary(BPE)
    a, b = set(starts), set(continues)
    texts = ["", None, " \n", "naïve Größe, über-long " * 30, "日本語 x", "z" * 5000, "unaffable's 1234567"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    for r in tokencount.count_tokens(docs, BPE).collect():
        words = (texts[r.doc_id] or "").encode().split()
        assert (r.n_words, r.n_tokens) == (len(words), sum(greedy(b" " + w, a, b) for w in words))
    assert tokencount.count_tokens(docs.where("false"), BPE).count() == 0


def test_bundles_equal_definition():
    p = langid.Profiler(64)
    texts = ["Ab c", "", "éa\x00b", "12 !", "zz" * 200, "İx"]
    got = p.bundle(texts)
    for t, v in zip(texts, got, strict=True):
        want = np.zeros(64)
        s = [0, *(int(p.alphabet[ord(c)]) for c in t.lower()), 0]
        for i in range(1, len(s) - 1):
            if s[i]:
                want += np.prod([p.place[k][s[i - 1 + k]].astype(int) for k in range(3)], axis=0)
        assert (v == want).all()


def test_languages_of_held_out_rows(spark):
    rng = random.Random(3)
    stock = {"xx": ["the", "and", "thing", "other"], "yy": ["der", "und", "schön", "über"], "zz": ["мир", "дом", "люди"]}
    rows = [(i, " ".join(rng.choices(stock[k], k=12)), k, 1.0) for i, k in enumerate(rng.choices(list(stock), k=150))]
    rows += [(1000, None, "xx", 0.0), (1001, " 12 ...", "yy", 0.0), (1002, "the and " * 20_000, None, 0.0), (None, "und", "yy", 0.0), (5, rows[5][1], "zz", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    right = [got[d].lang_pred == k for d, _, k, _ in rows[:150]]
    assert sum(right) >= 148
    assert got[1000].lang_pred == got[1001].lang_pred == "und" and got[1000].score == 0
    assert got[1002].lang_pred == "xx" and all(0 <= r.score <= 1 for r in got.values())
    assert sorted(r.doc_id or -1 for r in langid.keep_identified(docs).collect()) == sorted(d or -1 for d, *_ in rows if d not in (1000, 1001))
    assert langid.identify(docs.where("false")).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, {}).collect()} == {"und"}


def test_signatures_estimate_jaccard_and_edits_follow_id_order(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    rows = [(i * 37 % 1009, " ".join(rng.choices(words, k=rng.randint(0, 90))), 1) for i in range(80)]
    rows += [(2000, None, 1), (-4, "é" * 7, 1), (3000, "tail " * 30_000, 1), (2001, "", 1), (None, "no id", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, next int")
    order = sorted(((d, t or "") for d, t, _ in rows if d is not None), key=lambda x: -x[0]) + [(None, "no id")]
    got = minhash.edited_fingerprints(docs).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.n_chars): r for r in got}
    sig = {}
    for (d, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        r = by[d, len(t)]
        new = minhash.edited(t, nxt)
        import hashlib

        assert r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        a, b, c = (set(minhash.shingles(x.encode()).tolist()) for x in (t, new, nxt))
        jac = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        assert abs(r.near_edited - jac(a, b)) < 0.2 and abs(r.near_next - jac(a, c)) < 0.2
        assert sig.setdefault(t, r.fingerprint) == r.fingerprint
    assert minhash.edited_fingerprints(docs.where("false")).count() == 0
    one = minhash.edited_fingerprints(docs.where("doc_id = -4")).collect()[0]
    assert one.near_edited == one.near_next == 1.0


def test_near_classes_match_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for g in range(12):
        base = rng.choices(words, k=150)
        for _ in range(5):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = "edit"
            rows.append(" ".join(w))
    rows += [None, "", " ", "a b", "A B"]
    docs = spark.createDataFrame([(500 - i, t, 1) for i, t in enumerate(rows)], "doc_id long, text string, node int")
    sets = [set(minhash.shingles((t or "").encode()).tolist()) for t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both >= 0.8 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    want = {}
    for i in range(len(rows)):
        want[find(i)] = min(500 - i, want.get(find(i), 999))
    for r in nearcopies.near_classes(docs).collect():
        assert r.class_id == want[find(500 - r.doc_id)]
    assert nearcopies.near_classes(docs.where("false")).count() == 0


def test_rare_shingles_meet_all_similar_sets(spark):
    rng = np.random.default_rng(6)
    shared = rng.integers(-(1 << 60), 1 << 60, 300)
    sets = []
    for i in range(60):  # texts that share most of one passage and differ in the rest
        own = rng.integers(-(1 << 60), 1 << 60, int(rng.integers(5, 120)))
        kin = sets[i - 1][-60:] if i % 3 == 2 else own[:0]
        sets.append(np.unique(np.concatenate([rng.choice(shared, int(rng.integers(200, 300)), replace=False), own, kin])))
    rows = [(i, i, bytearray(np.sort(s.view(np.uint64)).tobytes())) for i, s in enumerate(sets)]
    frame = spark.createDataFrame(rows, "node long, root long, own binary")
    got = {(r.x, r.y) for r in nearcopies._by_rare_shingles(frame, 0.8).collect()}
    near = {(i, j) for i in range(60) for j in range(i + 1, 60) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}
    assert near and near <= got and len(got) < 60 * 59 // 2


def test_a_group_of_far_copies_is_not_paired_out(spark):
    rng = np.random.default_rng(12)
    draw = lambda k: rng.integers(-(1 << 60), 1 << 60, k)
    base, sets = draw(150), []
    for i in range(240):  # edits take five neighbouring shingles of the base and put in five of their own
        x = sets[-1].copy() if i % 6 == 5 else base.copy()
        for at in rng.integers(0, 145, 1 if i % 6 == 5 else int(rng.integers(0, 9))):
            x[at : at + 5] = draw(5)
        sets.append(x)
    sets = [np.unique(x) for x in sets]
    signed = spark.createDataFrame([(i, bytearray(minhash.signature(x.view(np.uint64)).tobytes())) for i, x in enumerate(sets)], "node long, sig binary")
    buckets = nearcopies._shared(nearcopies._bands(signed, 42)).localCheckpoint()
    frame = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(sets)], "node long, own binary")
    none = spark.createDataFrame([], "node long, root long")
    got = [tuple(sorted((r.x, r.y))) for r in nearcopies._across(buckets, frame, none, 0.8).collect()]

    def similar(i, j):
        both = len(np.intersect1d(sets[i], sets[j]))
        return both >= 0.8 * (len(sets[i]) + len(sets[j]) - both)

    def classes(pairs):
        root = list(range(240))
        for i, j in pairs:
            a, b = root[i], root[j]
            root = [a if r == b else r for r in root]
        return {frozenset(k for k in range(240) if root[k] == r) for r in root}

    want = classes((i, j) for i in range(240) for j in range(i) if similar(i, j))
    assert classes(p for p in got if similar(*p)) == want and 20 < len(want) < 230
    assert len(got) < 240 * 239 // 4  # several times all pairs where shingles of the group count


def test_long_texts_keep_apart():
    rng = np.random.default_rng(8)
    one, other = (b" ".join(b"%d" % i for i in rng.integers(0, 1 << 30, 200_000)) for _ in range(2))
    a, b = (minhash.signature(minhash.shingles(x)) for x in (one, other))
    assert minhash.likeness(a, b) < 0.03
    half = minhash.signature(minhash.shingles(one + b" " + other))
    assert abs(minhash.likeness(a, half) - 0.5) < 0.15
    assert (minhash.signature(minhash.shingles(b"")) == 0xFFFF).all()


def test_languages_of_one_document_are_learned_from_a_large_table(spark):
    from pyspark.sql import functions as F

    many = spark.range(80_000).select(F.col("id").alias("doc_id"), F.lit("the and other").alias("text"), F.lit("xx").alias("lang"))
    few = spark.createDataFrame([(100_000 + i, "der und über", f"q{i}") for i in range(12)], "doc_id long, text string, lang string")
    assert set(langid.learn(many.union(few))) == {"xx", *(f"q{i}" for i in range(12))}
