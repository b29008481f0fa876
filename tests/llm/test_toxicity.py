import random
import zlib

import numpy as np

from genospan.llm import toxicity


def test_label_model_finds_accuracies_and_discounts_copies():
    rng = np.random.default_rng(0)
    y = rng.random(6000) < 0.2
    accuracy = [0.95, 0.8, 0.65]
    v = np.stack([np.where(rng.random(6000) < a, y, ~y) for a in accuracy], axis=1) * 2 - 1
    v = np.concatenate([v, v[:, 2:3], v[:, 2:3], np.zeros((6000, 1), int)], axis=1).astype(np.int8)  # the weak voter three times
    model = toxicity.LabelModel().fit(v)
    post = model.posterior(v)
    assert ((post > 0.5) == y).mean() > 0.93
    assert model.weight[2] < 0.5 < model.weight[0]
    assert model.correlation[2, 3] > 0.9 > model.correlation[0, 1]


def docs_of(spark, n=900):
    rng = random.Random(6)
    plain = [f"w{c}{i}".translate(str.maketrans("0123456789", "abcdefghij")) for c in "xyz" for i in range(200)]
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(plain, k=rng.randint(3, 80))
        bad = rng.random() < 0.2
        if bad:
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "scum", "grubbelig", "grubbelung"]))
        rows.append((i, " ".join(words), 0.5))
        if i % 2 == 0:
            labels.append((i, 1 if bad else 0))
    rows += [(5000, None, 0.1), (5001, "", 0.1), (5002, "idiot " * 20_000 + "scum loser", 0.1), (None, "you pathetic idiot, you moron", 0.1), (4, rows[4][1], 0.1)]
    return spark.createDataFrame(rows, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int"), rows


def test_held_out_rows(spark):
    docs, labels, rows = docs_of(spark)
    got = toxicity.detect(docs, labels).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    truth = {d: any(w in t for w in ("idiot", "scum", "grubbel")) for d, t, _ in rows[:900]}
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 3 == 1]
    assert all(by[d].held_out == (d in set(held)) for d in truth)
    assert np.mean([by[d].predicted == truth[d] for d in held]) > 0.9
    assert not any(by[d].predicted for d in held if not truth[d])
    assert min(by[d].score for d in held if truth[d]) > max(by[d].score for d in held if not truth[d])
    assert by[5000].score == by[5001].score < 0.5 and by[5002].predicted == 1 and by[None].predicted == 1
    assert all(0 <= r.score <= 1 for r in got)
    assert toxicity.detect(docs.where("false"), labels).count() == 0
    alone = {r.doc_id: r.score for r in toxicity.detect(docs, labels.where("false")).collect()}
    assert alone[5002] > alone[5001]


def test_lexicon_grows_at_any_rate_and_by_significance(spark):
    def grown(toxic, clean, bad, rare, most):
        rows = [(1, f"plain {'frequent' if i < bad[0] else ''} {f'z{chr(97 + i // 4)}' if i < 4 * rare else ''}") for i in range(toxic)]
        rows += [(0, f"plain {'frequent' if i < bad[1] else ''}") for i in range(clean)]
        return toxicity.grow(spark.createDataFrame(rows, "toxic int, text string"), most)

    for toxic, clean in ((200, 300), (300, 200), (420, 80)):
        assert "frequent" in grown(toxic, clean, (90, 2), 0, 300)
    assert grown(200, 1800, (60, 20), 25, 1) == ["frequent"]
    assert grown(250, 250, (60, 60), 0, 300) == []
