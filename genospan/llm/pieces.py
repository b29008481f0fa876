"""SentencePiece encoding and decoding that keeps original byte offsets.

Normalisation walks the text with the model's compiled character map: at each
place the longest prefix the map knows is replaced, else one character is
copied, and every normalised byte remembers the source byte it came from.
Pieces are spans of the normalised text, so each projects to a span of source
bytes. Ids come from the sentencepiece library.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recall

SPACE = "▁"
_RUN = re.compile(" +[^ ]*")


class CharacterMap:
    """The compiled map: a double-array trie over UTF-8 prefixes that points into replacement strings."""

    def __init__(self, blob: bytes):
        self.units, self.strings = np.zeros(0, "<u4"), b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = np.frombuffer(blob, "<u4", count=size // 4, offset=4)
            self.strings = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """(source bytes used, replacement) of the longest prefix at ``at``, if the map has one."""
        if not len(self.units):
            return None
        unit = int(self.units[0])
        node = self._offset(unit)
        best = None
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(self.units):
                break
            unit = int(self.units[node])
            if unit & 0x800000FF != text[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                value = int(self.units[node]) & 0x7FFFFFFF
                best = i + 1 - at, self.strings[value : self.strings.index(b"\0", value)]
        return best

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 0x200) >> 6)


def normalise(text: bytes, cmap: CharacterMap, dummy_prefix: bool = True, squeeze: bool = False, escape: bool = True) -> tuple[bytes, np.ndarray]:
    """(normalised bytes, source offset of each of them and of the end)."""
    space = SPACE.encode() if escape else b" "
    out, origin = bytearray(), []
    at = 0
    parts = []
    while at < len(text):
        hit = cmap.longest(text, at)
        if hit is None:
            lead = text[at]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            hit = width, text[at : at + width]
        parts.append((at, hit[1]))
        at += hit[0]
    end = len(text)
    if squeeze:
        while parts and parts[0][1] == b" ":
            parts.pop(0)
        while parts and parts[-1][1] == b" ":
            end = parts.pop()[0]
    if dummy_prefix and parts:
        out += space
        origin += [parts[0][0]] * len(space)
    blank = squeeze
    for start, piece in parts:
        if squeeze and blank:
            piece = piece.lstrip(b" ")
        copied = text.startswith(piece, start)  # then bytes map one to one
        for i, b in enumerate(piece):
            got = space if b == 0x20 else bytes([b])
            out += got
            origin += [start + (i if copied else 0)] * len(got)
        if piece:
            blank = piece.endswith(b" ")
    return bytes(out), np.array([*origin, end], dtype=np.int64)


class PieceEncoder:
    """Encodes and decodes whole texts with one model; units between blanks are remembered.

    No piece of such a model holds a blank mark after another character (it is
    checked at load; a model that has one is encoded text by text), so merges
    never cross from one unit, a run of blanks with the word after it, to the
    next, and ids, spans and decoded bytes of a text are those of its units.
    """

    def __init__(self, model_path: str, memory: int = 300_000):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as model

        with open(model_path, "rb") as f:
            blob = f.read()
        proto = model.ModelProto()
        proto.ParseFromString(blob)
        spec = proto.normalizer_spec
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=blob)
        self.cmap = CharacterMap(spec.precompiled_charsmap)
        self.options = dict(dummy_prefix=spec.add_dummy_prefix, squeeze=spec.remove_extra_whitespaces, escape=spec.escape_whitespaces)
        self.pieces = [p.piece for p in proto.pieces]
        special = {p.piece for p in proto.pieces if p.type in (3, 4)}
        self.by_units = (
            not spec.precompiled_charsmap
            and spec.add_dummy_prefix
            and not spec.remove_extra_whitespaces
            and proto.trainer_spec.model_type == 2
            and proto.trainer_spec.byte_fallback
            and not proto.trainer_spec.treat_whitespace_as_suffix
            and not any(p.type == 4 for p in proto.pieces)
            and not any(SPACE in p.lstrip(SPACE) for p in self.pieces if p not in special)
        )
        self.blank = self.sp.piece_to_id(SPACE)
        self.bos, self.eos = self.sp.bos_id(), self.sp.eos_id()
        #: Normalised bytes of each piece; a byte piece is one byte.
        self.widths = np.array([1 if p.type == 6 else len(p.piece.encode()) for p in proto.pieces], dtype=np.int64)
        self.known = Recall(memory)

    def _learn(self, units: list[str]) -> dict[str, tuple[bytes, bytes, bytes]]:
        """unit without its first blank -> (ids, source bytes of each piece after a real blank, decoded bytes)."""
        ids = [x if u else [self.blank] for u, x in zip(units, self.sp.encode(units, num_threads=1), strict=True)]
        decoded = self.sp.decode(ids, num_threads=1)
        widths = self.widths.tolist()
        out = {}
        for unit, own, text in zip(units, ids, decoded, strict=True):
            spans = [widths[i] for i in own]
            if " " in unit:
                norm, origin = normalise(b" " + unit.encode(), self.cmap, False, False, True)
                spans = np.diff(origin[np.minimum(np.cumsum(spans), len(norm))], prepend=0).tolist()
            else:
                spans[0] -= 2  # the three bytes of the blank mark stand for one
            out[unit] = array("I", own).tobytes(), array("i", spans).tobytes(), text.encode()
        return out

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, bytes]]:
        """Per text: ids with begin and end ids, source end offset of every piece between them, decoded bytes.

        Piece i covers source bytes [end of piece i-1, its own end).
        """
        if not self.by_units:
            return [self._whole(t) for t in texts]
        split = []
        for text in texts:
            text = text.replace(SPACE, " ") if SPACE in text else text
            if not text:
                units = []
            elif "  " in text or text[0] == " ":
                units = [u[1:] for u in _RUN.findall(f" {text}")]
            else:
                units = text.split(" ")
            split.append(units)
        known = self.known.holding(split, self._learn)
        out = []
        bos, eos = struct.pack("<I", self.bos), struct.pack("<I", self.eos)
        for text, units in zip(texts, split, strict=True):
            got = [known[u] for u in units]
            ids = np.frombuffer(b"".join([bos, *[g[0] for g in got], eos]), "<u4")
            spans = np.frombuffer(b"".join([g[1] for g in got]), "<i4").astype(np.int64)
            ends = np.cumsum(spans) - 1  # the dummy blank has no source byte
            if SPACE in text:
                ends = self._project(text, ids)
            out.append((ids, ends, b" ".join([g[2] for g in got])))
        return out

    def _project(self, text: str, ids: np.ndarray) -> np.ndarray:
        norm, origin = normalise(text.encode(), self.cmap, **self.options)
        ends = np.cumsum(self.widths[ids[1:-1]])
        return origin[np.minimum(ends, len(norm))]

    def _whole(self, text: str) -> tuple[np.ndarray, np.ndarray, bytes]:
        ids = self.sp.encode(text, add_bos=True, add_eos=True)
        proto = np.array(ids, "<u4")
        return proto, self._project(text, proto), self.sp.decode(ids).encode()


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def encode_documents(docs: DataFrame, model_path: str, digests: bool = False) -> DataFrame:
    """(doc_id, ids, ends, decoded), or with ``digests`` (doc_id, n_tokens, ids_sha256, decoded_sha256, n_source_bytes).

    ids hold the begin and end ids; ``ends`` are the source byte offsets where
    the pieces between them end, so piece i covers the bytes from the end of
    piece i-1 to its own. A null text is the empty one: begin and end ids, no
    pieces, an empty decoded text. Rows are independent; an empty table gives
    no rows; only doc_id and text are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                got = enc.encode([t or "" for t in part.column(1).to_pylist()])
                if digests:
                    cols = [
                        pa.array([len(g[0]) for g in got], pa.int64()),
                        pa.array([hashlib.sha256(g[0].tobytes()).hexdigest() for g in got]),
                        pa.array([hashlib.sha256(g[2]).hexdigest() for g in got]),
                        pa.array([int(g[1][-1]) if len(g[1]) else 0 for g in got], pa.int64()),
                    ]
                    names = ["n_tokens", "ids_sha256", "decoded_sha256", "n_source_bytes"]
                else:
                    cols = [
                        pa.array([g[0].astype(np.int32) for g in got], pa.list_(pa.int32())),
                        pa.array([g[1].astype(np.int64) for g in got], pa.list_(pa.int64())),
                        pa.array([g[2].decode() for g in got]),
                    ]
                    names = ["ids", "ends", "decoded"]
                yield pa.record_batch([part.column(0), *cols], names=["doc_id", *names])

    columns = "n_tokens long, ids_sha256 string, decoded_sha256 string, n_source_bytes long" if digests else "ids array<int>, ends array<long>, decoded string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {columns}")
