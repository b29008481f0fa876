"""Token-id files: one independent zstandard frame a document, a trailing seek table, checksums.

A shard file holds the documents of one doc_id range in ascending order:

* one zstandard frame a document: its token ids as little-endian unsigned
  32-bit integers, compressed by itself, with the content checksum;
* a skippable frame (magic 0x184D2A50) with the doc_ids as little-endian
  64-bit integers, then one byte each that is 1 where the id is null;
* the seek table, a skippable frame as in the public zstandard seekable
  format: per frame the compressed size, the decompressed size and the low 32
  bits of the XXH64 of the decompressed bytes; then the number of frames, a
  descriptor byte 0x80 and the magic 0x8F92EAB1.

Any zstandard tool reads the whole file; a reader that wants some documents
reads the tail, then only the byte ranges of their frames.
"""

from __future__ import annotations

import bisect
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LONG_KEY, Recall, parallelism, scratch

# Fixed values of the public seekable format.
_ID_MAGIC, _SEEK_MAGIC, _END_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("check", "<u4")])
#: A blank that is followed by a visible character: byte-level pretokens never reach across it.
_CUT = re.compile(r" (?=[^\s\x00-\x20\x7f-\xa0 ᠎ -‏ -  -⁯　﻿])")
#: Without these only blank, \\t, \\n, \\v, \\f and \\r are white space.
_RARE = re.compile(r"[\x00-\x08\x0e-\x1f\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]")
_BLANKS = ("  ", " \n", " \t", " \v", " \f", " \r")
#: Units whose pretokens these classes give; others go through the library's own pretokeniser.
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
_PLAIN = re.compile(f"[!-~¡-©«¬®¯°±´¶·¸»¿×÷{_LETTER}]{{1,64}}")
_LETTERS = re.compile(f"[{_LETTER}]{{1,64}}")
_INNER = 200_000
_PRETOKENS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\\s0-9{_LETTER}]+")


class UnitEncoder:
    """Encodes whole texts with the tokenizers library, a word unit at a time, remembering units.

    A byte-level pretokeniser starts a pretoken at every blank that precedes
    a visible character, and merges never cross pretokens, so the ids of a
    text are those of its units in turn. ``memory`` bounds the units held.
    With ``added``, the vocabulary's added tokens are matched in texts as the
    library does by itself; without, their strings are ordinary text.
    """

    def __init__(self, tokenizer_path: str, memory: int = 1_400_000, added: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.encode_special_tokens = not added
        #: Texts with one of these go through the library whole.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if added else []
        self.known = Recall(memory)
        #: Pretokens that follow another inside a unit.
        self.inner: dict[str, bytes] = {}
        #: Every id as its four bytes.
        size = max(self.tokenizer.get_vocab().values(), default=-1) + 1
        raw = np.arange(size, dtype="<u4").tobytes()
        self.four = [raw[i : i + 4] for i in range(0, 4 * size, 4)]
        # The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on.
        shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        hidden = iter(range(256, 512))
        self.spell = {b: chr(b if b in shown else next(hidden)) for b in range(256)}

    def _learn(self, units: list[str]) -> dict[str, bytes]:
        """Ids of new units (without their blank): pretokens through the model, odd units through the whole tokenizer."""
        tokenize, blank, young, old, inner = self.tokenizer.model.tokenize, self.spell[32], self.known.young, self.known.old, self.inner
        if len(inner) > _INNER:
            inner.clear()
        out: dict[str, bytes] = {}
        odd = []

        four, joined, spelled = self.four, b"".join, self._spelled

        def word(u: str) -> bytes:
            return joined([four[t.id] for t in tokenize(blank + u if u.isascii() else spelled(f" {u}"))])

        for unit in units:
            if unit.isascii() and unit.isalpha() and len(unit) <= LONG_KEY:
                if unit not in out:
                    out[unit] = joined([four[t.id] for t in tokenize(blank + unit)])
            elif _LETTERS.fullmatch(unit):
                if unit not in out:
                    out[unit] = word(unit)
            elif _PLAIN.fullmatch(unit):
                first, *rest = _PRETOKENS.findall(f" {unit}")
                key = first[1:]
                ids = out.get(key) or young.get(key) or old.get(key)
                if ids is None:
                    ids = out[key] = word(key)
                for r in rest:
                    got = inner.get(r)
                    if got is None:
                        got = inner[r] = joined([four[t.id] for t in tokenize(r if r.isascii() and r[0] != " " else spelled(r))])
                    ids += got
                out[unit] = ids
            else:
                odd.append(unit)
        if odd:
            out.update(zip(odd, self._plain([f" {u}" for u in odd]), strict=True))
        return out

    def _spelled(self, pretoken: str) -> str:
        return pretoken.encode().decode("latin-1").translate(self.spell)

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of every text."""
        whole = [i for i, text in enumerate(texts) if any(x in text for x in self.added)]
        if whole:
            out = dict(zip(whole, self._plain([texts[i] for i in whole]), strict=True))
            others = [i for i in range(len(texts)) if i not in out]
            out.update(zip(others, self._by_units([texts[i] for i in others]), strict=True))
            return [out[i] for i in range(len(texts))]
        return self._by_units(texts)

    def _by_units(self, texts: list[str]) -> list[bytes]:
        split = []
        for text in texts:
            if _RARE.search(text) or any(x in text for x in _BLANKS):
                split.append(_CUT.split(text))
            else:
                split.append(text.split(" "))
        rest = [units[1:] for units in split]
        known = self.known.holding(rest, self._learn)
        first = self._plain([units[0] for units in split])
        out = [f + b"".join(map(known.__getitem__, units)) for f, units in zip(first, rest, strict=True)]
        return out


_ENCODERS: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """One encoder a worker process and path."""
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitEncoder(path, added=True)
    return _ENCODERS[path]


def pack(ids: bytes, compressor: zstandard.ZstdCompressor) -> tuple[bytes, int]:
    return compressor.compress(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF


class ShardWriter:
    """Appends frames to one file; ``close`` writes the ids and the seek table."""

    def __init__(self, uri: str):
        self.fs, path = pafs.FileSystem.from_uri(uri)
        self.fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(path, compression=None)
        self.ids: list[int | None] = []
        self.entries: list[tuple[int, int, int]] = []

    def add(self, doc_id: int | None, frame: bytes, plain: int, check: int) -> None:
        self.out.write(frame)
        self.ids.append(doc_id)
        self.entries.append((len(frame), plain, check))

    def close(self) -> None:
        ids = np.array([i or 0 for i in self.ids], dtype="<i8").tobytes() + bytes(i is None for i in self.ids)
        self.out.write(struct.pack("<II", _ID_MAGIC, len(ids)) + ids)
        table = np.array(self.entries, dtype=_ENTRY).tobytes() + struct.pack("<IBI", len(self.entries), 0x80, _END_MAGIC)
        self.out.write(struct.pack("<II", _SEEK_MAGIC, len(table)) + table)
        self.out.close()


class ShardReader:
    """Random access to the documents of one shard file."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != _END_MAGIC:
            raise ValueError(f"{uri}: no seek table")
        at = size - 9 - 12 * n
        self.entries = np.frombuffer(self.file.read_at(12 * n, at), dtype=_ENTRY)
        raw = self.file.read_at(9 * n, at - 8 - 9 * n)
        self.null = np.frombuffer(raw, dtype=np.uint8, offset=8 * n).astype(bool)
        self.ids = np.frombuffer(raw, dtype="<i8", count=n)
        self.starts = np.concatenate([[0], np.cumsum(self.entries["packed"], dtype=np.int64)])
        self.unpack = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.entries)

    def _open(self, k: int, frame: bytes) -> bytes:
        plain = self.unpack.decompress(frame, max_output_size=int(self.entries["plain"][k]))
        if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.entries["check"][k]:
            raise ValueError(f"frame {k}: checksum differs")
        return plain

    def read(self, k: int) -> bytes:
        """Ids of the k-th document, touching only its frame."""
        return self._open(k, self.file.read_at(int(self.entries["packed"][k]), int(self.starts[k])))

    def find(self, doc_id: int) -> list[int]:
        """Places of a doc_id; non-null ids ascend after the null ones."""
        first = int(self.null.sum())
        ids = self.ids[first:]
        return [first + k for k in range(int(np.searchsorted(ids, doc_id)), int(np.searchsorted(ids, doc_id, "right")))]

    def scan(self, span: int = 8 << 20) -> Iterator[tuple[int | None, bytes]]:
        """All documents in order, reading about ``span`` bytes at a time."""
        k = 0
        while k < len(self):
            to = max(k + 1, int(np.searchsorted(self.starts, self.starts[k] + span, "right")) - 1)
            block = self.file.read_at(int(self.starts[to] - self.starts[k]), int(self.starts[k]))
            for j in range(k, to):
                at = int(self.starts[j] - self.starts[k])
                yield (None if self.null[j] else int(self.ids[j])), self._open(j, block[at : at + int(self.entries["packed"][j])])
            k = to


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 0, shards: int | None = None) -> list[dict]:
    """Encode every text, append ``end_id``, write shard files of ascending doc_id; returns the manifest.

    The manifest has one entry a shard: path, documents, tokens and start (ids
    in all shards before it). Frames are made before the shuffle, so only
    compressed ids move. A retried task writes a file of another name, and
    the manifest names the file of the attempt that succeeded.
    """
    spark = docs.sparkSession
    n = shards or parallelism(spark)
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bounds = [int(b) for b in keys.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n)] if n > 1 else []

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer, end = encoder(tokenizer_path), zstandard.ZstdCompressor(level=1, write_checksum=True), struct.pack("<I", end_id)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = part.column(0).to_pylist()
                plain = [x + end for x in enc.encode([t or "" for t in part.column(1).to_pylist()])]
                frames = [pack(x, packer) for x in plain]
                yield pa.record_batch(
                    [
                        pa.array([0 if i is None else bisect.bisect_left(bounds, i) for i in ids], pa.int32()),
                        part.column(0),
                        pa.array([f for f, _ in frames], pa.binary()),
                        pa.array([len(x) for x in plain], pa.int64()),
                        pa.array([c for _, c in frames], pa.int64()),
                    ],
                    names=["shard", "doc_id", "frame", "plain", "sum"],
                )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, path, done = None, None, "", []
        for batch in batches:
            for shard, doc_id, frame, plain, check in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != now:
                    if out:
                        out.close()
                    now, path = shard, f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.zst"
                    out = ShardWriter(path)
                    done.append([shard, path, 0, 0])
                out.add(doc_id, frame, plain, check)
                done[-1][2] += 1
                done[-1][3] += plain // 4
        if out:
            out.close()
        if done:
            yield pa.record_batch([pa.array(x) for x in zip(*done, strict=True)], names=["shard", "path", "documents", "tokens"])

    frames = keys.mapInArrow(encode, "shard int, doc_id long, frame binary, plain long, sum long")
    placed = frames.repartitionById(n, F.col("shard")).sortWithinPartitions("shard", "doc_id", "plain", "sum")
    manifest = [r.asDict() for r in placed.mapInArrow(write, "shard long, path string, documents long, tokens long").collect()]
    start = 0
    for entry in sorted(manifest, key=lambda e: e["shard"]):
        entry["start"] = start
        start += entry["tokens"]
    return manifest


def read_tokens(spark: SparkSession, manifest: list[dict], digest: Callable[[bytes], object] | None = None, kind: str = "binary") -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files; ``digest`` of the id bytes instead of ids, as SQL type ``kind``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                rows: list[tuple] = []
                weight = 0
                for doc_id, ids in ShardReader(path).scan():
                    rows.append((doc_id, start, len(ids) // 4, digest(ids) if digest else ids))
                    start += len(ids) // 4
                    weight += len(ids)
                    if len(rows) == 4096 or weight > 16 << 20:
                        yield _batch(rows)
                        rows, weight = [], 0
                if rows:
                    yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        d, s, n, x = zip(*rows, strict=True)
        return pa.record_batch([pa.array(d, pa.int64()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(x)], names=["doc_id", "start", "n_tokens", "ids"])

    files = spark.createDataFrame([(e["path"], e["start"]) for e in manifest], "path string, start long")
    return files.repartition(max(1, len(manifest))).mapInArrow(read, f"doc_id long, start long, n_tokens long, ids {kind}")


def token_digests(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Write all documents, read the files back: (doc_id, start, n_tokens, ids_crc32).

    A null or empty text is its end id alone, null doc_ids come first, rows
    that repeat a doc_id stand in order of length, an empty table gives no
    rows and no files. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    manifest = write_tokens(docs, tokenizer_path, scratch(spark, "token-shards"), end_id)
    return read_tokens(spark, manifest, zlib.crc32, "long").withColumnRenamed("ids", "ids_crc32")
