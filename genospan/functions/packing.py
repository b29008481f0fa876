"""Packed calls: two bits a call (the ALT count, or 3 for a missing one), four calls a byte, counted without unpacking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

MISSING = 3
_LOW = 0x55  # the lower bit of every call of a byte
#: The four calls of every byte, as one little-endian word.
_FOUR = ((np.arange(256, dtype=np.uint32)[:, None] >> np.array([0, 2, 4, 6], np.uint32)) & 3).astype(np.uint8).view("<u4").ravel()


def width(n: int) -> int:
    return (n + 3) // 4


def pack(calls: np.ndarray) -> np.ndarray:
    """(rows, n) calls, below 0 or 3 where missing, as (rows, width) bytes."""
    rows, n = calls.shape
    padded = np.zeros((rows, 4 * width(n)), dtype=np.uint8)
    padded[:, :n] = calls.view(np.uint8) & 3
    four = padded.reshape(rows, -1, 4)
    return four[:, :, 0] | four[:, :, 1] << 2 | four[:, :, 2] << 4 | four[:, :, 3] << 6


def unpack(raw: np.ndarray, n: int, places: np.ndarray | None = None) -> np.ndarray:
    """Calls of all samples, or of those at ``places`` (only their bytes are looked at)."""
    if places is None:
        return _FOUR[raw].view(np.uint8)[:, :n]
    return raw[:, places // 4] >> (2 * (places % 4)).astype(np.uint8) & 3


def bytes_of(column: pa.Array) -> np.ndarray:
    """(rows, width) bytes of a binary column whose values have one length."""
    rows = len(column)
    if not rows:
        return np.empty((0, 0), dtype=np.uint8)
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    ends = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + rows + 1]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]].reshape(rows, -1)


def codes_of(column: pa.Array, n: int) -> np.ndarray:
    """(rows, n) calls of a list column; missing ones are 3."""
    flat = column.flatten().cast(pa.int8()).fill_null(MISSING)
    return flat.to_numpy(zero_copy_only=False).view(np.uint8).reshape(len(column), n)


def owners_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, sample, call) of every carrier of a carriers column."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), sizes), flat >> 2, (flat & 3).astype(np.uint8)


def spread(column: pa.Array, n: int) -> np.ndarray:
    """(rows, n) calls of a carriers column that names every call that isn't hom-ref."""
    row, at, call = owners_of(column)
    codes = np.zeros((len(column), n), dtype=np.uint8)
    codes[row, at] = call
    return codes


def packed_of(batch: pa.RecordBatch, n: int) -> np.ndarray:
    """Packed calls of a batch, whichever of ``packed``, ``gt`` and ``carriers`` it has."""
    names = batch.schema.names
    if "packed" in names:
        return bytes_of(batch.column("packed"))
    return pack(codes_of(batch.column("gt"), n) if "gt" in names else spread(batch.column("carriers"), n))


def chosen(batch: pa.RecordBatch, n: int, places: np.ndarray | None = None) -> np.ndarray:
    """Calls of the chosen samples of a batch, one byte each."""
    if "packed" in batch.schema.names:
        return unpack(bytes_of(batch.column("packed")), n, places)
    codes = codes_of(batch.column("gt"), n) if "gt" in batch.schema.names else spread(batch.column("carriers"), n)
    return codes if places is None else codes[:, places]


def select_mask(n: int, places: np.ndarray | None) -> np.ndarray:
    """Bytes with the lower bit of every chosen sample set, padded to whole words."""
    mask = np.zeros((1, n), dtype=np.uint8)
    mask[:, slice(None) if places is None else places] = 1
    return _words(pack(mask))


def _words(raw: np.ndarray) -> np.ndarray:
    short = -raw.shape[1] % 8
    return (np.pad(raw, ((0, 0), (0, short))) if short else np.ascontiguousarray(raw)).view(np.uint64)


def counts(raw: np.ndarray, masks: list[np.ndarray]) -> np.ndarray:
    """(masks, rows, 3) het, hom-alt and missing calls of packed rows within each mask."""
    out = np.empty((len(masks), len(raw), 3), dtype=np.int64)
    step = max(1, (1 << 22) // max(raw.shape[1], 1))
    low = np.uint64(0x0101010101010101 * _LOW)
    for at in range(0, len(raw), step):
        x = _words(raw[at : at + step])
        lo, hi = x & low, x >> np.uint64(1) & low
        kinds = lo & ~hi, hi & ~lo, lo & hi
        for m, mask in enumerate(masks):
            for k, bits in enumerate(kinds):
                out[m, at : at + step, k] = np.bitwise_count(bits & mask).sum(axis=1, dtype=np.int64)
    return out


def sample_tally(codes: np.ndarray, total: np.ndarray) -> None:
    """Add to ``total`` (3, samples) how often each sample is het, hom-alt and missing."""
    for at in range(0, len(codes), 255):  # so many fit a byte
        part = codes[at : at + 255]
        for k in range(3):
            total[k] += np.add.reduce((part == k + 1).view(np.uint8), axis=0, dtype=np.uint8)


def carriers_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row offsets, 4 * sample + call) of all calls that aren't hom-ref."""
    row, at = np.nonzero(codes)
    return np.searchsorted(row, np.arange(len(codes) + 1)).astype(np.int32), (at * 4 + codes[row, at]).astype(np.int64)
