import hashlib
import random

import numpy as np
import public_tokenizers
import sentencepiece

import corpus_pipeline
from genospan.llm import simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of():
    rng = random.Random(11)
    stock = {"en": [f"the{c}" for c in "abcdefghijklmnopqrst"], "de": [f"für{c}" for c in "abcdefghijklmnopqrst"]}
    passage = " ".join(rng.choices(stock["en"], k=40))
    rows = []
    for i in range(120):
        lang = rng.choice(["en", "de"])
        text = " ".join(rng.choices(stock[lang], k=rng.randint(5, 60)))
        if i % 10 == 3:
            text += " " + passage
        rows.append((i, text, lang, f"s{i % 4}", len(text)))
    rows += [(200, rows[7][1], "en", "s1", len(rows[7][1])), (201, None, "en", None, None), (202, "", "en", "s1", 0), (203, "123 ...", None, "s0", 7), (204, rows[9][1] + " extra", "de", None, 9), (205, passage, "en", "s2", len(passage)), (206, " ".join(passage.split()[3:28]), "en", "s2", 9), (7, rows[7][1], "en", "s1", 1)]
    return rows


def classes_of(texts):
    """Smallest id of each class of documents linked by a five-word Jaccard similarity of 0.8 or more."""
    sets = {d: set(simhash.shingles((t or "").encode()).tolist()) for d, t in texts.items()}
    root = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
        if all(root[root[d]] == root[d] for d in root):
            break
    return sorted(set(root.values()))


def test_stages_one_by_one(spark):
    docs = spark.createDataFrame(rows_of(), "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    named = stages["language_id"](spark, docs, "")
    assert named.columns == COLUMNS
    assert {r.doc_id for r in named.collect()} == {r[0] for r in rows_of()} - {201, 202, 203}
    alone = stages["simhash_near_dedup"](spark, named, "")
    kept = alone.collect()
    heads = classes_of({r.doc_id: r.text for r in named.collect()})
    assert alone.columns == COLUMNS and sorted(r.doc_id for r in kept) == heads and 200 not in heads
    cut = stages["suffix_array_dedup"](spark, alone, "")
    assert cut.columns == COLUMNS
    got = {r.doc_id: r for r in cut.collect()}
    seen, want = set(), {}
    for r in sorted(kept):
        raw, gone = r.text.encode(), set()
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone.update(range(i, i + 100))
            seen.add(raw[i : i + 100])
        left = bytes(b for i, b in enumerate(raw) if i not in gone).decode(errors="ignore")
        if not gone or left.split():
            want[r.doc_id] = left
    assert {k: r.text for k, r in got.items()} == want and len(want) < len(kept)
    assert all(r.n_chars == len(r.text) for r in got.values())
    mixed = stages["mix_sources"](spark, cut, "").collect()
    assert {r.doc_id for r in mixed} <= set(got) and all(r == got[r.doc_id] for r in mixed)
    plan = {r.doc_id: r for r in corpus_pipeline.mixing.mix(cut).collect()}
    for d in got:
        assert sum(r.doc_id == d for r in mixed) == (2 * plan[d].taken + plan[d].size) // (2 * plan[d].size)


def test_run_on_a_folder(spark, tmp_path):
    docs = spark.createDataFrame(rows_of(), "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert got and {r.doc_id for r in got} <= {r[0] for r in rows_of()}
    texts = {r[0]: r[1] for r in rows_of()}
    whole = [r for r in got if r.n_source_bytes == len((texts[r.doc_id] or "").encode())]
    assert whole
    for r in whole:
        ids = sp.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    docs.where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_near_dedup_takes_five_words_and_jaccard(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(900)]
    rows = []
    for g in range(20):
        base = rng.choices(words, k=300)
        rows.append(" ".join(base))
        for n in (1, 4, 6, 9):  # Jaccard of about 0.97, 0.87, 0.82, 0.74
            w = list(base)
            for at in rng.sample(range(10, 290), n):
                w[at] = "edit"
            rows.append(" ".join(w))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    got = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, "").collect()
    assert sorted(r.doc_id for r in got) == classes_of(dict(enumerate(rows)))
