"""Greedy word-piece counts by a linear longest-match automaton.

The vocabulary's two tries (pieces that start a word, pieces that continue
one) have failure links: where no longer match exists, the automaton pops the
pieces that are settled and goes on in the state of what is left, without
going back in the text. Each link holds how many pieces it pops, so counting
never builds a piece; every byte is read once.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of

_LONG_WORD = 64


class LongestMatch:
    """Counts the pieces of a word under greedy longest-match-first.

    ``starts`` and ``continues`` are the byte strings that may begin a word and
    follow in one. A word that greedy matching cannot cover counts one unknown
    piece.
    """

    def __init__(self, starts: list[bytes], continues: list[bytes]):
        self.edge: list[dict[int, int]] = [{}, {}]
        piece = [False, False]
        for root, words in ((0, starts), (1, continues)):
            for word in words:
                node = root
                for b in word:
                    nxt = self.edge[node].get(b)
                    if nxt is None:
                        nxt = len(self.edge)
                        self.edge[node][b] = nxt
                        self.edge.append({})
                        piece.append(False)
                    node = nxt
                if word:
                    piece[node] = True
        #: State after popping, or -1 where greedy matching is stuck; and pieces popped on the way.
        self.fail = [-1] * len(self.edge)
        self.pops = [0] * len(self.edge)
        queue: deque[int] = deque([0, 1])
        while queue:
            node = queue.popleft()
            for b, child in self.edge[node].items():
                if piece[child]:
                    self.fail[child], self.pops[child] = 1, 1
                elif node > 1:
                    state, popped = self.fail[node], self.pops[node]
                    while state >= 0 and b not in self.edge[state]:
                        popped += self.pops[state]
                        state = self.fail[state]
                    if state >= 0:
                        self.fail[child], self.pops[child] = self.edge[state][b], popped
                queue.append(child)

    def count(self, word: bytes) -> int:
        if not word:
            return 0
        edge, fail, pops = self.edge, self.fail, self.pops
        state = total = 0
        for b in word:
            nxt = edge[state].get(b)
            while nxt is None:
                total += pops[state]
                state = fail[state]
                if state < 0:
                    return 1
                nxt = edge[state].get(b)
            state = nxt
        while state != 1:  # what is left at the end is popped in the same way
            total += pops[state]
            state = fail[state]
            if state < 0:
                return 1
        return total


def byte_vocabulary(path: str) -> tuple[list[bytes], list[bytes]]:
    """Pieces of a byte-level vocabulary file: those with the blank mark start a word, the others continue it."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    spelled = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    starts, continues = [], []
    for piece in vocab:
        if all(c in spelled for c in piece):
            raw = bytes(spelled[c] for c in piece)
            (starts if raw.startswith(b" ") else continues).append(raw)
    return starts, continues


class _Counts(dict):
    """Counts of words met; at the bound it starts anew."""

    def __init__(self, automaton: LongestMatch, memory: int):
        self.automaton, self.memory = automaton, memory

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(b" " + word)
        if len(word) <= _LONG_WORD:
            if len(self) >= self.memory:
                self.clear()
            self[word] = n
        return n


_COUNTS: dict[str, _Counts] = {}


def counts_of(path: str, memory: int = 600_000) -> _Counts:
    if path not in _COUNTS:
        _COUNTS[path] = _Counts(LongestMatch(*byte_vocabulary(path)), memory)
    return _COUNTS[path]


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_words, n_tokens): word pieces of each whole text, words being runs of visible bytes.

    A null or blank text has none. Rows are independent; an empty table gives
    no rows; only doc_id and text are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counts_of(vocabulary)
        for batch in batches:
            words = tokens = ()
            found = [(len(w), sum(map(counts.__getitem__, w))) for w in (t.split() for t in texts_of(batch.column("text")))]
            words, tokens = (np.array(x, dtype=np.int64) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2
            yield pa.record_batch([batch.column("doc_id"), pa.array(words), pa.array(tokens)], names=["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")
