import hashlib
import random

import pytest

from genospan.llm import repeats


def brute(rows):
    """rows: (doc_id, text) in order; digests by the definition."""
    seen = set()
    out = {}
    for doc, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            s = raw[i : i + 100]
            if s in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(s)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[doc] = len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    alphabet = "abcdefgh é\n"
    passages = ["".join(rng.choices(alphabet, k=rng.randint(60, 400))) for _ in range(8)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.15 and rows:
            text = rng.choice(rows)[1]
        elif kind < 0.3 and rows:
            t = list(rng.choice(rows)[1] or "x")
            for _ in range(3):
                t[rng.randrange(len(t))] = "Z"
            text = "".join(t)
        else:
            text = ""
            for _ in range(rng.randint(0, 6)):
                text += rng.choice(passages) if rng.random() < 0.4 else "".join(rng.choices(alphabet, k=rng.randint(0, 200)))
        rows.append((i * 3, text))
    rows += [(5000, "a" * 350), (5001, "ab" * 300), (5002, "a" * 120), (5003, None), (5004, ""), (5005, "é" * 49), (5006, "é" * 70)]
    rows += [(6000, "".join(rng.choices(alphabet, k=99))), (6001, "".join(rng.choices(alphabet, k=300_000)))]
    rows += [(6002, rows[-1][1][1000:250_000])]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_digests_match_brute_force(spark, seed):
    rows = corpus(seed, 150)
    mixed = rows[:]
    random.Random(0).shuffle(mixed)
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in mixed], "doc_id long, text string, lo int, a string").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = {r.doc_id: tuple(r)[1:] for r in repeats.repeat_digests(docs).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(rows)


def test_shared_ids_nulls_and_empty_tables(spark):
    base = "".join(random.Random(8).choices("abcdefgh ", k=400))
    rows = [(None, base), (3, base[:200]), (3, base[:200]), (3, "other " * 3), (3, base), (4, base[50:180] + "!" * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = repeats.repeat_digests(docs).collect()
    assert len(got) == 6
    assert sorted(r.n_removed for r in got if r.doc_id == 3) == [0, 200, 200, 400]
    assert [r.n_removed for r in got if r.doc_id is None] == [0]
    assert [r.n_removed for r in got if r.doc_id == 4] == [130]
    assert repeats.repeat_digests(docs.where("false")).count() == 0
    assert {r.text for r in repeats.cut_repeats(docs).where("doc_id = 4").collect()} == {"!" * 40}


def test_rows_that_repeat_a_text_are_cut_alike(spark):
    base = "".join(random.Random(9).choices("abcdefgh ", k=500))
    near = base[:250] + "#" + base[250:]
    rows = [(1, base, "a"), (2, near, "b"), (2, near, "c"), (2, "short", "d"), (3, near[:300], "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {(r.doc_id, r.lang): r.text for r in repeats.cut_repeats(docs).collect()}
    assert got == {(1, "a"): base, (2, "b"): "#", (2, "c"): "#", (2, "d"): "short"}
