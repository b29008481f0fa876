import random

import duckdb
import pytest

from genospan.llm import mixing
from genospan.llm.mixing_sql import mix_sql

COLUMNS = "doc_id long, text string, source string, _words string, p_id long, r int"


def rows_of(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = "hot" if rng.random() < 0.6 else rng.choice(["a", "b", None, "é", ""])
        size = rng.choice([0, 1, 1, 5, 5, 5, 40, 300])
        text = None if rng.random() < 0.05 else " ".join(rng.choices(["w", "ww", "x\ty"], k=size))
        rows.append((i, text, source, "mine", 7, 3))
    rows += [rows[3]] * 4 + [(None, "a b c", "a", None, None, None)] * 2 + [(9000, " \n", None, "", 0, 0)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_agrees_with_sql_and_its_own_rules(spark, seed):
    rows = rows_of(seed, 400)
    docs = spark.createDataFrame(rows, COLUMNS)
    got = [tuple(r) for r in mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken").collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [r[:3] for r in rows])
    want = con.execute(mix_sql()).fetchall()
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    again = [tuple(r) for r in mixing.mix(docs.repartition(7)).select("doc_id", "size", "source_size", "target", "taken").collect()]
    assert sorted(again, key=key) == sorted(got, key=key)
    total = sum(r[1] for r in got)
    assert all(0 <= r[4] <= 2 * r[1] for r in got)
    by_source = {}
    for r in mixing.mix(docs).collect():
        t = by_source.setdefault(r.source, [r.target, r.source_size, 0])
        t[2] += r.taken
    assert abs(sum(t[0] for t in by_source.values()) - 1.5 * total) < 1e-6
    for target, size, taken in by_source.values():
        assert target <= 2 * size + 1e-9 and abs(taken - target) <= 64


def test_copies_keep_every_column_and_edge_cases(spark):
    rows = rows_of(3, 200)
    docs = spark.createDataFrame(rows, COLUMNS)
    plan = {}
    for r in mixing.mix(docs).collect():
        plan.setdefault((r.doc_id, r.source, r.size), []).append((2 * r.taken + r.size) // (2 * r.size) if r.size else 1)
    out = [tuple(r) for r in mixing.apply_mix(docs).collect()]
    assert mixing.apply_mix(docs).columns == docs.columns and set(out) <= set(rows)
    for row in set(rows):
        key = (row[0], row[2], len((row[1] or "").split()))
        assert abs(out.count(row) - rows.count(row) * sum(plan[key]) / len(plan[key])) <= 0.5 * rows.count(row)
    assert mixing.mix(docs.where("false")).count() == 0 and mixing.apply_mix(docs.where("false")).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.size, r.taken) for r in mixing.mix(blank).collect()) == [(1, 0, 0), (2, 0, 0)]
    assert mixing.apply_mix(blank).count() == 2
