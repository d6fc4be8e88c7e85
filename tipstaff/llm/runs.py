"""Vectorised word runs: text columns to words without a Python loop over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LETTERS = "abcdefghijklmnopqrstuvwxyz"
LETTERS_DIGITS = LETTERS + "0123456789"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def class_table(chars: str) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[ord(c) for c in chars]] = True
    return table


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array, each value followed by one zero byte, and the end of each value."""
    joined = pc.binary_join_element_wise(pc.fill_null(texts, ""), pa.scalar(""), pa.scalar("\0"))
    joined = joined.cast(pa.large_string())
    if isinstance(joined, pa.ChunkedArray):
        joined = joined.combine_chunks()
    _, offsets, data = joined.buffers()
    first = joined.offset
    ends = np.frombuffer(offsets, dtype=np.int64)[first : first + len(joined) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]]
    return raw, ends[1:] - ends[0]


def words(texts: pa.Array, chars: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unbroken runs of chars in the lower-cased texts: row of each run, its start, its end, and all bytes."""
    raw, ends = text_bytes(pc.utf8_lower(texts))
    inside = class_table(chars)[raw]
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    row = np.searchsorted(ends, start, side="right")
    return row, start, stop, raw


def word_strings(start: np.ndarray, stop: np.ndarray, raw: np.ndarray) -> pa.Array:
    """The runs as one Arrow string array, built from the bytes themselves."""
    keep = np.zeros(len(raw) + 1, dtype=np.int8)
    np.add.at(keep, start, 1)
    np.add.at(keep, stop, -1)
    data = raw[np.cumsum(keep[:-1]).astype(bool)]
    offsets = np.concatenate(([0], np.cumsum(stop - start))).astype(np.int64)
    array = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))
    return array.cast(pa.string())


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums of hashes and remainders of hashes are well spread."""
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX
    x = x ^ (x >> np.uint64(29))
    x = x * _BASE
    return x ^ (x >> np.uint64(32))


def word_hashes(start: np.ndarray, stop: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every run, equal on every machine and in every batch."""
    if not len(start):
        return np.zeros(0, np.uint64)
    spread_bytes = mix(np.arange(256, dtype=np.uint64) + np.uint64(1))
    # A run's hash is the sum of byte hash times a power of an odd number that counts from the run's start.
    lengths = stop - start
    index = np.repeat(start - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
    place = np.arange(lengths.sum()) - np.repeat(np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    powers = np.ones(int(lengths.max()), dtype=np.uint64)
    np.multiply.accumulate(np.full(len(powers), _BASE, dtype=np.uint64), out=powers)
    values = spread_bytes[raw[index]] * powers[place]
    sums = np.add.reduceat(values, np.concatenate(([0], np.cumsum(lengths)[:-1])))
    return mix(sums + lengths.astype(np.uint64))
