"""Exact repeated passages by a sparse suffix array with bucket-pointer refinement.

Every byte that lies in a ``length``-byte string which also starts earlier in
the corpus is found. Suffixes are sampled by content: of the q-grams inside a
window of ``length`` bytes the one with the smallest hash is the window's
anchor, so equal windows have equal anchors at equal offsets, and one anchor
serves a run of neighbouring windows.

1. Initial buckets: anchors by their q-gram. A bucket with one anchor holds no
   repeat and is done.
2. Refinement: a bucket is sorted by the bucket identifiers of the q-grams at
   the later (and, for the windows that begin before the anchor, earlier)
   offsets that its windows cover. Anchors with the same identifiers have the
   same windows, so all but the first are repeats, and the first stands for
   them from here on.
3. The same again, a level down: in buckets that still hold different
   contexts, each representative's windows are named by the q-gram identifiers
   at their own offsets and sorted by name; all but the first of a name are
   repeats.

Identifiers are 64-bit hashes, compared two at a time. Before each shuffle a
batch keeps only its own first of each identifier and knows the others to be
repeats, so a passage that very many documents share sends one row a batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parallelism, stash

LENGTH = 100
GRAM = 40
_CHUNK = 1 << 18
_POSITION = np.uint64((1 << 20) - 1)
#: Stands for a null doc_id, which comes before all others.
NO_ID = -(1 << 63)
_RNG = np.random.default_rng(20)
_BYTES = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = _RNG.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _ODD[0]
    return (h ^ (h >> np.uint64(29))) * _ODD[1]


def gram_ids(data: np.ndarray) -> np.ndarray:
    """Identifier of the q-gram at every place: names of 1, 2, 4, ... bytes are paired into longer ones."""
    level = {1: _BYTES[data]}
    size = 1
    while size * 2 <= GRAM:
        level[size * 2] = level[size][:-size] * _ODD[2 + size.bit_length()] + level[size][size:]
        size *= 2
    rest = GRAM - size
    whole = level[size]
    return _mix(whole[: len(data) - GRAM + 1] * _ODD[10] + level[rest][size:] if rest else whole)


def window_ids(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Identifier of the window at each place, from those of the q-grams at its offsets 0, q and length - q."""
    return _mix(grams[at] * _ODD[11] + grams[at + GRAM] * _ODD[12] + grams[at + LENGTH - GRAM] * _ODD[13])


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of windows with one anchor: (document, place, windows, q-gram identifier, context identifier)."""
    span = LENGTH - GRAM + 1
    for base in range(0, max(0, len(data) - LENGTH + 1), _CHUNK):
        piece = data[base : base + _CHUNK + LENGTH - 1]
        grams = gram_ids(piece)
        least = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
        size = 1
        while size * 2 <= span:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        windows = len(piece) - LENGTH + 1
        anchor = (np.minimum(least[:windows], least[span - size : span - size + windows]) & _POSITION).astype(np.int64)
        new = np.empty(windows, dtype=bool)
        new[0] = True
        np.not_equal(anchor[1:], anchor[:-1], out=new[1:])
        for edge in (starts, ends - LENGTH + 1):
            inside = edge[(edge >= base) & (edge < base + windows)] - base
            new[inside] = True
        first = np.flatnonzero(new)
        n = np.diff(np.r_[first, windows])
        doc = np.searchsorted(starts, first + base, side="right") - 1
        good = first + base <= ends[doc] - LENGTH
        first, n, doc = first[good], n[good], doc[good]
        a = anchor[first]
        context = _mix(window_ids(grams, first) * _ODD[14] + window_ids(grams, first + n - 1) * _ODD[15] + ((a - first) << 8 | n).astype(np.uint64))
        yield doc, first + base - starts[doc], n, grams[a], context


def _spans(doc: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans (document, place, bytes) that runs of windows cover, joined where they touch."""
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], (lo + n)[order] + LENGTH - 1
    if not len(doc):
        return doc, lo, hi
    # A run never ends before one that starts earlier in its document, up to the bytes of one window.
    key = np.cumsum(np.r_[False, doc[1:] != doc[:-1]])
    top = np.maximum.accumulate(hi + key * (1 << 40)) - key * (1 << 40)
    new = np.r_[True, (doc[1:] != doc[:-1]) | (lo[1:] > top[:-1])]
    at = np.flatnonzero(new)
    return doc[at], lo[at], np.r_[top[at[1:] - 1], top[-1]] - lo[at]


def _rows(a: np.ndarray, b: np.ndarray, doc: np.ndarray, lo: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch(
        [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(doc), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32))],
        names=["a", "b", "doc", "lo", "n"],
    )


_ROW = "a long, b long, doc long, lo int, n int"


def _first_of_each(a: np.ndarray, b: np.ndarray, doc: np.ndarray, lo: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, doc, lo, n) with the first of each (a, b) only; the others become spans, rows with n below 0."""
    key = a ^ (b * _ODD[9])
    order = np.sort(key)
    again = np.unique(order[1:][order[1:] == order[:-1]])
    later = np.zeros(len(key), dtype=bool)
    if len(again):
        at = np.minimum(np.searchsorted(again, key), len(again) - 1)
        some = np.flatnonzero(again[at] == key)
        some = some[np.lexsort((lo[some], doc[some], b[some], a[some]))]
        same = (a[some][1:] == a[some][:-1]) & (b[some][1:] == b[some][:-1])
        later[some[1:][same]] = True
    d, s, size = _spans(doc[later], lo[later].astype(np.int64), n[later].astype(np.int64))
    if len(d):
        yield _rows(_mix(d.view(np.uint64) ^ s.view(np.uint64)), s.view(np.uint64), d, s, -size)
    keep = ~later
    if keep.any():
        yield _rows(a[keep], b[keep], doc[keep], lo[keep], n[keep])


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start of each text, end of each text, doc) of a batch, without copying."""
    text = batch.column("text").cast(pa.large_binary())
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)[: offsets[-1]] if len(text) else np.empty(0, np.uint8)
    return data, offsets[:-1], offsets[1:], batch.column("doc").to_numpy(zero_copy_only=False)


def _initial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        data, starts, ends, ids = _texts(batch)
        base = batch.column("base").to_numpy(zero_copy_only=False)
        parts = list(anchors(data, starts, ends))
        if parts:
            doc, lo, n, gram, context = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield from _first_of_each(gram, context, ids[doc], lo + base[doc], n)


def _refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (gram, context, doc, lo): repeats as spans (n below 0), and the first of each context of a mixed bucket."""
    last_gram = last_context = None
    single = None  # the only context so far of the last bucket
    for batch in batches:
        a, b, doc, lo, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        span = n < 0
        if span.any():
            yield _rows(a[span], b[span], doc[span], lo[span], n[span])
            a, b, doc, lo, n = (x[~span] for x in (a, b, doc, lo, n))
        if not len(a):
            continue
        new_gram = np.r_[last_gram is None or a[0] != last_gram, a[1:] != a[:-1]]
        new = new_gram | np.r_[last_context is None or b[0] != last_context, b[1:] != b[:-1]]
        d, s, size = _spans(doc[~new], lo[~new].astype(np.int64), n[~new].astype(np.int64))
        if len(d):
            yield _rows(d.view(np.uint64), s.view(np.uint64), d, s, -size)
        first = np.flatnonzero(new)
        bucket = np.cumsum(new_gram)[first]  # 0: goes on with the last batch's bucket
        count = np.bincount(bucket, minlength=int(new_gram.sum()) + 1)
        if count[0] and single is not None:
            yield _rows(*(x for x in single))
            single = None
        mixed = (count > 1) | (np.arange(len(count)) == 0)
        if len(count) > 1:
            single = None
            if count[-1] == 1:
                at = first[bucket == len(count) - 1]
                single = tuple(x[at] for x in (a, b, doc, lo, n))
        send = first[mixed[bucket]]
        if len(send):
            yield _rows(a[send], b[send], doc[send], lo[send], n[send])
        last_gram, last_context = a[-1], b[-1]


def _name_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of the representatives (runs) of each text: (window identifier, bucket, doc, place, 1)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, starts, ends, ids = _texts(batch)
        base = batch.column("base").to_numpy(zero_copy_only=False)
        runs = batch.column("runs")
        owner = np.repeat(np.arange(len(runs)), np.diff(runs.offsets.to_numpy()))
        flat = runs.flatten()
        every = [flat.field(i).to_numpy(zero_copy_only=False) for i in range(3)]
        # Runs of another text with this doc_id came along.
        own = (every[1] >= base[owner]) & (every[1] < base[owner] + (ends - starts)[owner])
        owner, every = owner[own], [x[own] for x in every]
        for at in range(0, len(owner), 20_000):
            doc = owner[at : at + 20_000]
            gram, lo, n = (x[at : at + 20_000] for x in every)
            n = n.astype(np.int64)
            size = n + LENGTH - 1
            begin = np.cumsum(size) - size
            within = np.arange(size.sum()) - np.repeat(begin, size)
            grams = gram_ids(data[np.repeat(starts[doc] + lo - base[doc], size) + within])
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            names = window_ids(grams, np.repeat(begin, n) + step)
            yield from _first_of_each(names, np.repeat(gram, n).view(np.uint64), np.repeat(ids[doc], n), np.repeat(lo, n) + step, np.ones(len(step), np.int64))


def _repeated_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (name, bucket, doc, lo): spans of all but the first of each name."""
    last = None
    held: list[tuple[np.ndarray, ...]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            doc, lo, n = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            d, s, size = _spans(doc, lo, n)
            yield pa.record_batch([pa.array(d), pa.array(s.astype(np.int32)), pa.array(size.astype(np.int32))], names=["doc", "lo", "bytes"])

    for batch in batches:
        a, b, doc, lo, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        span = n < 0
        if span.any():
            yield pa.record_batch([pa.array(doc[span]), pa.array(lo[span]), pa.array(-n[span])], names=["doc", "lo", "bytes"])
            a, b, doc, lo, n = (x[~span] for x in (a, b, doc, lo, n))
        if not len(a):
            continue
        same = np.r_[last is not None and (a[0], b[0]) == last, (a[1:] == a[:-1]) & (b[1:] == b[:-1])]
        held.append((doc[same], lo[same].astype(np.int64), n[same].astype(np.int64)))
        last = a[-1], b[-1]
        if sum(len(h[0]) for h in held) > 500_000:
            yield from flush()
    yield from flush()


def _placed(docs: DataFrame, riding: list[str]) -> tuple[DataFrame, DataFrame]:
    """(doc, base, copies, text) of every row to answer for, and of one row a distinct (doc_id, text).

    Rows that share a doc_id are one document, their texts in order of hash;
    ``base`` is where a text starts in it. Matches never cross texts.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"), *riding)
    shared = rows.groupBy("doc").count().where("count > 1").limit(1).count()
    if not shared:
        alone = rows.select("doc", F.lit(0).alias("base"), F.lit(1).alias("copies"), "text", *riding)
        return alone, alone
    distinct = rows.groupBy("doc", "text").agg(F.count("*").cast("int").alias("copies"))
    before = Window.partitionBy("doc").orderBy(F.xxhash64("text"), "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = stash(distinct.select("doc", F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0)).cast("int").alias("base"), "copies", "text"), "repeats-texts")
    if not riding:
        return placed, placed
    # Columns differ between rows of one text: each row comes back, cut like the text it repeats.
    return rows.join(placed.select("doc", "text", "base"), ["doc", "text"]).select("doc", "base", F.lit(1).alias("copies"), "text", *riding), placed


def _merged(found: list[dict] | None, base: int, size: int) -> list[tuple[int, int]]:
    """Maximal spans of one text, in its own bytes."""
    merged: list[list[int]] = []
    for a, b in sorted((max(f["lo"] - base, 0), min(f["lo"] - base + f["bytes"], size)) for f in found or ()):
        if a >= b:
            continue  # of another text with this doc_id
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [(a, b) for a, b in merged]


def _kept(finish: Callable[[bytes, list[tuple[int, int]]], tuple], names: list[str], kinds: list[pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bases, copies = (batch.column(c).to_pylist() for c in ("doc", "base", "copies"))
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            spans = batch.column("spans").to_pylist()
            out: list[tuple] = []
            for doc, base, times, raw, found in zip(ids, bases, copies, texts, spans, strict=True):
                out += [(None if doc == NO_ID else doc, *finish(raw, _merged(found, base, len(raw))))] * times
            if out:
                yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out, strict=True), [pa.int64(), *kinds], strict=True)], names=["doc_id", *names])

    return run


def _cut(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    if not spans:
        return raw
    edges = [0, *(x for s in spans for x in s), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _spanned(docs: DataFrame, riding: list[str] | None = None) -> DataFrame:
    """(doc, base, copies, text, spans) of every distinct text; a text moves once, to its doc's partition."""
    spark = docs.sparkSession
    n = parallelism(spark)
    riding = riding or []
    texts, once = _placed(docs, riding)
    initial = once.select("doc", "base", "text").mapInArrow(_initial, _ROW)
    sorted_ = initial.repartition(n, "a").sortWithinPartitions("a", "b", "doc", "lo")
    refined = stash(sorted_.mapInArrow(_refine, _ROW), "repeats-refined")
    home = texts.repartition(n, "doc")  # the same exchange serves both joins below
    runs = refined.where("n > 0").groupBy("doc").agg(F.collect_list(F.struct("a", "lo", "n")).alias("runs"))
    whole = home if once is texts else once.repartition(n, "doc")
    # All columns go along: with the same columns on both sides Spark reuses the exchange of the texts.
    named = whole.join(runs.hint("shuffle_hash"), "doc").mapInArrow(_name_windows, _ROW)
    windows = named.repartition(n, "a").sortWithinPartitions("a", "b", "doc", "lo").mapInArrow(_repeated_windows, "doc long, lo int, bytes int")
    known = refined.where("n < 0").select("doc", "lo", (-F.col("n")).alias("bytes"))
    # Written, so that the windows' shuffle is gone before the texts move again.
    spans = stash(known.union(windows).groupBy("doc").agg(F.collect_list(F.struct("lo", "bytes")).alias("spans")), "repeats-spans")
    return home.join(spans.hint("shuffle_hash"), "doc", "left")


def repeat_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document.

    A null text is empty; texts shorter than the length lose nothing; a null
    doc_id comes before all others; rows that share a doc_id are one document
    (texts ordered by hash), and rows that repeat doc_id and text are that one
    text and get the same result; an empty table gives no rows. Only doc_id
    and text are read.
    """

    def finish(raw: bytes, spans: list[tuple[int, int]]) -> tuple:
        return len(raw), sum(b - a for a, b in spans), len(spans), hashlib.sha256(_cut(raw, spans)).hexdigest()

    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return _spanned(docs).mapInArrow(_kept(finish, names, [pa.int64(), pa.int64(), pa.int64(), pa.string()]), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with every repeated byte cut from ``text``, and ``n_chars`` following where there is such a column.

    Bytes of a character that is cut apart go too; a text that the cut leaves
    without a word goes with its row, one that had none stays. Other columns
    ride along with the text, so the documents are shuffled once.
    """
    riding = [c for c in docs.columns if c != "text"]
    columns = {f"c{i}": c for i, c in enumerate(riding)}
    packed = docs.select(F.col("doc_id"), "text", F.struct(*[F.col(c).alias(k) for k, c in columns.items()]).alias("row"))
    kind = packed.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, at = [], []
            bases = batch.column("base").to_pylist()
            for i, (raw, found) in enumerate(zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True)):
                spans = _merged(found, bases[i], len(raw))
                kept = _cut(raw, spans).decode(errors="ignore")
                if not spans or kept.split():
                    out.append(kept)
                    at.append(i)
            yield pa.record_batch([batch.column("row").take(pa.array(at, pa.int64())), pa.array(out, pa.string())], names=["row", "kept"])

    spanned = _spanned(packed, ["row"]).mapInArrow(run, f"row {kind}, kept string")
    new = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return spanned.select(*[new[c].alias(c) if c in new else F.col(f"row.c{riding.index(c)}").alias(c) for c in docs.columns])
