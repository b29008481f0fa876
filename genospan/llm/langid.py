"""Language identification with hyperdimensional profiles.

Every letter has a random +1/-1 vector. A letter with its two neighbours is
bound into one vector, the elementwise product of the three after permuting
(rotating) them by place; a document is the bundle (sum) of its trigram
vectors, a language the bundle of its training documents at unit length, and a
document goes to the language whose prototype has the largest cosine.

Bundles of a block of documents are one matrix product: trigram counts times
trigram vectors, and a worker keeps the vectors of trigrams it has met.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, learn_fold

DIMENSIONS = 512
SYMBOLS = 128
SEED = 42
UNKNOWN = "und"
_SCALE = 1e9
_KEPT = 32_768
_BLOCK = 128


def _alphabet() -> np.ndarray:
    """Symbol of every code point: 0 no letter, 1 to 26 the basic letters, others hashed above them."""
    table = np.zeros(0x110000, dtype=np.uint8)
    letters = np.array([c for c in range(0x32000) if chr(c).isalpha()], dtype=np.int64)
    table[letters] = 27 + (letters * 2654435761 >> 7) % (SYMBOLS - 27)
    table[97:123] = np.arange(1, 27)
    return table


class Profiler:
    """Turns blocks of texts into bundled vectors."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        letters = rng.choice(np.array([-1, 1], dtype=np.int8), size=(SYMBOLS, dimensions))
        self.place = [np.roll(letters, k, axis=1) for k in (2, 1, 0)]
        self.alphabet = _alphabet()
        self.row = np.full(SYMBOLS**3, -1, dtype=np.int32)
        self.vectors = np.empty((_KEPT, dimensions), dtype=np.float32)
        self.used = 0
        self.dimensions = dimensions

    def trigrams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text number, trigram) for every letter of every text, taken as the middle of its trigram."""
        joined = "".join(f"\0{t.lower()}\0" for t in texts)
        ends = np.cumsum([len(t.lower()) + 2 for t in texts]) if len(joined) != sum(map(len, texts)) + 2 * len(texts) else np.cumsum([len(t) + 2 for t in texts])
        symbol = self.alphabet[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        middle = np.flatnonzero(symbol)
        s = symbol.astype(np.int32)
        return np.searchsorted(ends, middle, side="right"), (s[middle - 1] * SYMBOLS + s[middle]) * SYMBOLS + s[middle + 1]

    def _rows(self, trigrams: np.ndarray) -> np.ndarray:
        if self.used + int((self.row[trigrams] < 0).sum()) > _KEPT:
            self.row.fill(-1)
            self.used = 0
        fresh = trigrams[self.row[trigrams] < 0]
        if len(fresh) > _KEPT:
            raise ValueError("a block has too many trigrams")
        a, b, c = fresh // SYMBOLS**2, fresh // SYMBOLS % SYMBOLS, fresh % SYMBOLS
        self.vectors[self.used : self.used + len(fresh)] = self.place[0][a] * self.place[1][b] * self.place[2][c]
        self.row[fresh] = np.arange(self.used, self.used + len(fresh))
        self.used += len(fresh)
        return self.row[trigrams]

    def bundle(self, texts: list[str]) -> np.ndarray:
        """One vector a text; a text without a letter has the zero vector."""
        out = np.zeros((len(texts), self.dimensions), dtype=np.float64)
        text, trigram = self.trigrams(texts)
        seen = np.zeros(SYMBOLS**3, dtype=bool)
        seen[trigram] = True
        known = np.flatnonzero(seen)
        local = np.zeros(SYMBOLS**3, dtype=np.int32)
        for at in range(0, len(known), _KEPT):
            some = known[at : at + _KEPT]
            local[some] = np.arange(len(some))
            mine = slice(None) if len(some) == len(known) else np.flatnonzero((trigram >= some[0]) & (trigram <= some[-1]))
            counts = np.bincount(text[mine] * len(some) + local[trigram[mine]], minlength=len(texts) * len(some))
            out += counts.reshape(len(texts), len(some)).astype(np.float32) @ self.vectors[self._rows(some)]
        return out


_PROFILERS: dict[tuple[int, int], Profiler] = {}


def profiler(dimensions: int, seed: int) -> Profiler:
    if (dimensions, seed) not in _PROFILERS:
        _PROFILERS[dimensions, seed] = Profiler(dimensions, seed)
    return _PROFILERS[dimensions, seed]


def _blocks(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most _BLOCK rows and about ``most`` characters."""
    sizes = [len(t or "") for t in batch.column("text").to_pylist()]
    at = total = 0
    for i, n in enumerate(sizes):
        if i > at and (i - at == _BLOCK or total + n > most):
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield batch.slice(at)


def _unit(v: np.ndarray) -> np.ndarray:
    length = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return np.divide(v, length, out=np.zeros_like(v), where=length > 0)


def learn(docs: DataFrame, dimensions: int = DIMENSIONS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Unit prototype of every language of ``docs`` (text, lang), from all of its documents.

    Sums are of rounded integers, so their order doesn't matter. What comes to
    the driver is one vector a language.
    """
    known = docs.where("lang is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, sums = profiler(dimensions, seed), {}
        for batch in batches:
            for part in _blocks(batch):
                vectors = np.rint(_unit(p.bundle(part.column("text").to_pylist())) * _SCALE).astype(np.int64)
                for lang, v in zip(part.column("lang").to_pylist(), vectors, strict=True):
                    sums[lang] = sums.get(lang, 0) + v
        if sums:
            yield pa.record_batch([pa.array(list(sums)), pa.array(list(sums.values()), pa.list_(pa.int64()))], names=["lang", "v"])

    parts = known.select("text", "lang").mapInArrow(run, "lang string, v array<long>")
    sums = parts.select("lang", F.posexplode("v").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    rows = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("v")).orderBy("lang").collect()
    found = {r.lang: np.array([e.x for e in r.v], dtype=np.float64) for r in rows}
    return {k: v / np.linalg.norm(v) for k, v in found.items() if np.linalg.norm(v) > 0}


def _judge(prototypes: dict[str, np.ndarray], dimensions: int, seed: int):
    """A function from texts to their languages and scores."""
    langs = sorted(prototypes)
    matrix = np.stack([prototypes[k] for k in langs]).T if langs else np.zeros((dimensions, 0))

    def judge(texts: list[str]) -> tuple[list[str], np.ndarray]:
        vectors = profiler(dimensions, seed).bundle(texts)
        some = (vectors != 0).any(axis=1) & bool(langs)
        cosine = np.round(_unit(vectors) @ matrix, 9) if langs else np.zeros((len(texts), 1))
        best = cosine.argmax(axis=1)
        score = np.where(some, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0.0)
        return [langs[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)], score

    return judge


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """(doc_id, lang_pred, score): the language of largest cosine and that cosine, held to 0..1.

    A null text, one without a letter, and any text when nothing was learned
    get ``und`` and 0. Ties go to the language first by code point. Only
    doc_id and text are read.
    """
    judge = _judge(prototypes, dimensions, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _blocks(batch):
                names, score = judge([t or "" for t in part.column("text").to_pylist()])
                yield pa.record_batch([part.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) with prototypes from the learning fold of ``docs`` itself."""
    found = predict(docs, learn(docs.where(learn_fold())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.05) -> DataFrame:
    """Documents whose language is identified: those without a letter, or below a cosine of ``least``, go.

    Rows pass through whole, so nothing is shuffled.
    """
    prototypes = learn(docs.where(learn_fold()))
    judge = _judge(prototypes, DIMENSIONS, SEED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _blocks(batch):
                names, score = judge([t or "" for t in part.column("text").to_pylist()])
                yield part.filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(names, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
