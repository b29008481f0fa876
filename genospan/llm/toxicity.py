"""Toxicity by weak supervision.

Many voters look at a document: one a lexicon word, and patterns over the text
and its words. Each votes toxic, clean or abstains. A generative label model is
fitted to the votes of a bounded sample by expectation maximisation: it
estimates every voter's accuracy given the hidden label, and from the votes
that remain correlated once the label is known it estimates dependencies, by
which the weight of voters that repeat each other is divided. Documents get
posterior labels, and a linear classifier over word features learns from them;
the classifier is what scores every document.

Labels known for the learning fold, where given, are one more voter, and the
lexicon grows by words whose document counts among those labelled rows tie them
to the label beyond chance (binomial tail, Bonferroni over all words tested).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, learn_fold, sampled, stash

#: Most documents that the models are fitted on, chosen by a seeded hash of doc_id.
SAMPLE = 20_000
#: Most words that the lexicon grows by.
GROWN = 300
#: Least odds of toxic of a word that the lexicon grows by, relative to those of all rows.
LIFT = 3
SEED = 42
THRESHOLD = 0.7

# Common abusive words by language.
LEXICON = {
    "en": "idiot idiots moron morons imbecile stupid dumb dumbass fool loser losers pathetic worthless useless scum trash garbage filth vermin clown clowns disgusting revolting freak creep coward liar crap damn hell bastard bitch asshole shit fuck fucking whore slut retard retarded ugly despise",
    "de": "idiot idioten trottel depp dumm dummkopf versager erbärmlich wertlos nutzlos abschaum müll dreck ungeziefer clown ekelhaft widerlich scheiße arschloch schlampe hure feigling lügner hässlich hasse",
    "fr": "idiot idiote imbécile crétin stupide débile perdant pathétique minable inutile ordure déchet racaille vermine clown dégoûtant répugnant merde connard salope pute lâche menteur laid déteste",
    "es": "idiota imbécil estúpido estúpida tonto perdedor patético inútil escoria basura alimaña payaso asqueroso repugnante mierda cabrón puta zorra cobarde mentiroso feo odio",
}
WORDS = tuple(sorted({w for words in LEXICON.values() for w in words.split()}))
_LEET = str.maketrans("013457@$", "oieastas")
_WORD = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"\b\w*[a-zA-Z][013457@$]+[a-zA-Z]\w*")
_SECOND = re.compile(r"\b(?:you|your|du|dein|tu|tes|ton|tú)\b(?:\W+\w+){0,3}?\W+(?:" + "|".join(WORDS) + r")\b")
_SHOUT = re.compile(r"\b[A-Z]{4,}\b(?:\W+[A-Z]{4,}\b){2}")
_BANG = re.compile(r"[!?]{3,}")
#: Pattern voters: votes toxic where true, abstains else; the last two vote clean.
PATTERNS = ("two_words", "three_words", "repeated_word", "dense", "second_person", "masked_spelling", "shouting", "exclaiming", "no_word_short", "no_word_long")
_ROUNDS = 60


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


#: Lengths of word beginnings that may stand in the lexicon; they are written with a star.
BEGINNINGS = (4, 5, 6)


def units(words: list[str]) -> set[str]:
    """Distinct words and beginnings of words of a document."""
    distinct = set(words)
    return distinct.union(*({f"{w[:k]}*" for w in distinct if len(w) > k} for k in BEGINNINGS))


def votes(text: str, words: list[str], index: dict[str, int]) -> np.ndarray:
    """One vote a voter but the label: 1 toxic, -1 clean, 0 abstains. ``index`` numbers the lexicon."""
    found = [w for w in words if w in index]
    out = np.zeros(len(index) + len(PATTERNS), dtype=np.int8)
    for w in units(words):
        if w in index:
            out[index[w]] = 1
    distinct = len(set(found))
    masked = any(m.lower().translate(_LEET) in index for m in _MASKED.findall(text))
    out[len(index) :] = (
        distinct >= 2,
        distinct >= 3,
        len(found) > distinct,
        bool(words) and len(found) > 0.01 * len(words),
        bool(found) and bool(_SECOND.search(text.lower())),
        masked,
        bool(_SHOUT.search(text)),
        bool(_BANG.search(text)),
        -1 if not found and not masked and len(words) <= 100 else 0,
        -1 if not found and not masked and len(words) > 100 else 0,
    )
    return out


def grow(labelled: DataFrame, most: int = GROWN) -> list[str]:
    """Words tied to the label among ``labelled`` (toxic, text): likelier in toxic rows than chance explains.

    A word must have ``LIFT`` times the odds of toxic that all rows have, which
    it can at any rate of toxic rows. Words are counted per document on the
    executors, partial counts first, and tested there, every one of them; only
    the most significant come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
                counts[1 if toxic else 0].update({w for w in units(_words(text or "")) if len(w) <= 40})
        words = sorted(counts[0].keys() | counts[1].keys())
        for at in range(0, len(words), 50_000):
            some = words[at : at + 50_000]
            yield pa.record_batch([pa.array(some, pa.string()), pa.array([counts[0][w] for w in some], pa.int64()), pa.array([counts[1][w] for w in some], pa.int64())], names=["word", "clean", "toxic"])

    sizes = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    total = sum(sizes.values())
    if not sizes.get(1) or total == sizes[1]:
        return []
    base = sizes[1] / total
    counted = labelled.select("toxic", "text").mapInArrow(run, "word string, clean long, toxic long")
    counted = counted.groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("toxic") >= 4)
    counted = stash(counted, "toxicity-counted")
    tested = max(1, counted.count())
    rich = counted.where(F.col("toxic") * (total - sizes[1]) > LIFT * F.col("clean") * sizes[1])

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tails = [_log_tail(k, k + c, base) for k, c in zip(batch.column("toxic").to_pylist(), batch.column("clean").to_pylist(), strict=True)]
            yield pa.record_batch([*batch.columns, pa.array(tails, pa.float64())], names=["word", "clean", "toxic", "tail"])

    tied = rich.select("word", "clean", "toxic").mapInArrow(test, "word string, clean long, toxic long, tail double")
    tied = stash(tied.where(F.col("tail") < math.log(0.05 / tested)), "toxicity-tied")
    # A beginning that is the beginning of one word only goes.
    starts = F.explode(F.array(*[F.concat(F.substring("word", 1, k), F.lit("*")) for k in BEGINNINGS]))
    whole = tied.where(~F.col("word").endswith("*")).select(starts.alias("word"), "toxic", "clean").distinct()
    best = tied.join(whole, ["word", "toxic", "clean"], "left_anti").orderBy("tail", "word").limit(most)
    return sorted(r["word"] for r in best.select("word").collect())


def _log_tail(k: int, n: int, p: float) -> float:
    """Logarithm of the chance of ``k`` or more of ``n`` at rate ``p``, where ``k`` is above the mean."""
    term = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log(1 - p)
    total = ratio = 1.0
    for i in range(k, n):
        ratio *= (n - i) / (i + 1) * p / (1 - p)
        total += ratio
        if ratio < 1e-17 * total:
            break
    return term + math.log(total)


class LabelModel:
    """Accuracies and dependencies of the voters, by expectation maximisation over their votes."""

    def __init__(self, prior: float = 0.1):
        self.prior = prior

    def fit(self, v: np.ndarray, rounds: int = _ROUNDS) -> LabelModel:
        n, m = v.shape
        # P(vote | label) with the votes -1, 0, 1 on the last axis; voters start as better than chance.
        self.p = np.zeros((2, m, 3))
        rate = np.stack([(v == k).mean(axis=0) for k in (-1, 0, 1)], axis=1) if n else np.full((m, 3), 1 / 3)
        for y, bias in ((0, (2.0, 1.0, 0.25)), (1, (0.25, 1.0, 4.0))):
            w = (rate + 1e-6) * np.array(bias)
            self.p[y] = w / w.sum(axis=1, keepdims=True)
        self.weight = np.ones(m)
        known = v[:, -1] != 0
        for r in range(rounds if n else 0):
            if r == 0:
                # Voters that nearly repeat each other count once from the start, whatever the label.
                self._dependencies(v, np.full(n, 0.5), 0.6)
            post = self.posterior(v)
            if r == 0 and known.sum() >= 50:
                # Start from what labelled rows say of each voter, softened; the rest follows the voters.
                post = np.where(known, np.where(v[:, -1] > 0, 0.8, 0.02), post * 0.1)
            if r == rounds // 2:
                self._dependencies(v, post, 0.2)
                post = self.posterior(v)
            self.prior = float(np.clip(post.mean(), 1e-4, 0.5))
            for y, q in ((0, 1 - post), (1, post)):
                base = rate * 2.0  # prior counts hold rare voters near their overall rate
                got = np.stack([q @ (v == k) for k in (-1, 0, 1)], axis=1) + base
                self.p[y] = got / got.sum(axis=1, keepdims=True)
        return self

    def _dependencies(self, v: np.ndarray, post: np.ndarray, least: float) -> None:
        """Correlation of each pair of voters within the classes; a voter's weight is at most one over its correlated mass."""
        x = v.astype(np.float64)
        both = np.zeros((v.shape[1], v.shape[1]))
        for q in (1 - post, post):
            mean = q @ x / max(q.sum(), 1e-9)
            centred = x - mean
            both += (centred * q[:, None]).T @ centred
        size = np.sqrt(np.maximum(np.diag(both), 1e-12))
        self.correlation = np.abs(both / np.outer(size, size))
        np.fill_diagonal(self.correlation, 1.0)
        strong = np.where(self.correlation > least, self.correlation, 0.0)
        self.weight = np.minimum(self.weight, 1.0 / np.maximum(strong.sum(axis=1), 1.0))

    def posterior(self, v: np.ndarray) -> np.ndarray:
        ratio = np.log(np.maximum(self.p[1], 1e-9)) - np.log(np.maximum(self.p[0], 1e-9))
        at = v.astype(np.int64) + 1
        score = np.log(self.prior / (1 - self.prior)) + (np.take_along_axis(ratio[None], at[:, :, None], axis=2)[..., 0] * self.weight).sum(axis=1) if len(v) else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


class Classifier:
    """Logistic regression on the presence of lexicon words, fitted to soft labels."""

    def __init__(self, index: dict[str, int] | None = None):
        self.index = index or {}
        self.w = np.zeros(len(self.index))
        self.b = -2.0

    def fit(self, x: np.ndarray, target: np.ndarray) -> Classifier:
        """``x``: presence of each word (rows by words). Ridge-penalised Newton steps on the words that occur."""
        if not len(x):
            return self
        used = np.flatnonzero(x.any(axis=0))
        own = np.concatenate([x[:, used], np.ones((len(x), 1))], axis=1).astype(np.float64)
        base = float(np.clip(target.mean(), 1e-3, 0.999))
        w = np.zeros(own.shape[1])
        w[-1] = math.log(base / (1 - base))
        ridge = np.full(len(w), 0.03)
        ridge[-1] = 0.0
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(own @ w, -30, 30)))
            step = np.linalg.solve((own * (p * (1 - p))[:, None]).T @ own + np.diag(ridge + 1e-9), own.T @ (p - target) + ridge * w)
            w -= np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-6:
                break
        self.w[used], self.b = w[:-1], float(w[-1])
        return self


def learn(docs: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE, seed: int = SEED) -> Classifier:
    """Fit the label model and the classifier on a sample of ``docs`` (at most about ``sample``, the labelled first).

    Texts stay on the executors; the driver gets votes and feature numbers of
    the sampled documents, which the bound holds to a few MB.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    if labels is not None:
        known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        ids = ids.join(known, "doc_id", "left")
    else:
        ids = ids.withColumn("toxic", F.lit(None).cast("int"))
    sizes = {r["known"]: r["count"] for r in ids.groupBy(F.col("toxic").isNotNull().alias("known")).count().collect()}
    most = {True: min(1.0, 0.5 * sample / max(sizes.get(True, 0), 1))}
    left = sample - most[True] * sizes.get(True, 0)
    most[False] = min(1.0, left / max(sizes.get(False, 0), 1))
    ids = ids.where(F.when(F.col("toxic").isNotNull(), sampled(most[True], seed, "doc_id")).otherwise(sampled(most[False], seed, "doc_id")))
    # Ids and labels only are shuffled; the sampled ids, which ``sample`` bounds, go to the texts.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids.limit(2 * sample)), "doc_id")
    # Of rows that share an id one is learned from, so that the bound holds whatever repeats.
    rows = rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = stash(rows.select("doc_id", "toxic", "text"), "toxicity-sample")
    words = sorted({*WORDS, *grow(rows.where("toxic is not null"))})
    index = {w: i for i, w in enumerate(words)}

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [votes(t or "", _words(t or ""), index).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), batch.column("toxic"), pa.array(out, pa.binary())], names=["doc_id", "toxic", "votes"])

    got = rows.mapInArrow(look, "doc_id long, toxic int, votes binary").toArrow().sort_by([("doc_id", "ascending"), ("votes", "ascending")])
    model = Classifier(index)
    if not got.num_rows:
        return model
    label = np.array([0 if t is None else 1 if t else -1 for t in got.column("toxic").to_pylist()], dtype=np.int8)
    v = np.stack([np.frombuffer(x, np.int8) for x in got.column("votes").to_pylist()])
    every = np.concatenate([v, label[:, None]], axis=1)
    return model.fit(v[:, : len(index)] > 0, LabelModel().fit(every).posterior(every))


def score(docs: DataFrame, classifier: Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text, an empty or null one included; only doc_id and text are read."""
    weights = {w: float(classifier.w[i]) for w, i in classifier.index.items() if classifier.w[i]}
    bias = classifier.b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = weights.keys()
        for batch in batches:
            raw = [bias + math.fsum(weights[w] for w in known & units(_words(t or ""))) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(np.array(raw, dtype=np.float64), -30, 30))))], names=["doc_id", "score"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def detect(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Scores of ``docs`` with models from its learning fold.

    Repeated rows score alike, a null doc_id is scored but never learned from,
    a null text is the empty one, no label at all leaves the voters to
    themselves, and an empty table gives no rows.
    """
    fold = learn_fold()
    return score(docs, learn(docs.where(fold), labels.where(fold), sample))
