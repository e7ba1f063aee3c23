"""Stable 64-bit hashes of words, made in numpy for whole text columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: Longer words are hashed one by one.
LONG = 256
_STEP = np.uint64(0x9E3779B97F4A7C15)
_TAIL = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads them."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of two neighbours that depends on their order."""
    with np.errstate(over="ignore"):
        return mix(left * _STEP + mix(right))


def chunks(column: pa.Array, most: int = 1 << 21):
    """Parts of a text column of about ``most`` bytes, one text at least."""
    at, size = 0, column.cast(pa.large_binary())
    offsets = np.frombuffer(size.buffers()[1], np.int64)[size.offset : size.offset + len(size) + 1] if len(size) else np.zeros(1, np.int64)
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, column.slice(at, end - at)
        at = end


def hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of a text column in order, and the words of each text.

    Words are runs without ASCII white space, A-Z lower-cased; null counts as
    empty. Equal words have equal hashes in every process.
    """
    return located(column)[:2]


def located(column: pa.Array, alone: bytes = b"") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`hashed`, with the byte of its text where each word begins, and its bytes.

    A character of ``alone`` (ASCII) is a word by itself.
    """
    rows = len(column)
    data = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + rows + 1] if rows else np.zeros(1, np.int64)
    first, n = int(offsets[0]), int(offsets[-1] - offsets[0])
    none = np.zeros(0, np.int64)
    if not n:
        return none.view(np.uint64), np.zeros(rows, np.int64), none, none
    low = data.buffers()[2].slice(first, n).to_pybytes().lower()
    raw = np.frombuffer(low + bytes(8), np.uint8)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = (raw[:n] != 32) & (raw[:n] - np.uint8(9) > 4)
    cut = np.zeros(n + 1, bool)
    cut[offsets[:-1] - first] = True
    if alone:
        single = np.isin(raw[:n], np.frombuffer(alone, np.uint8), kind="table")
        cut[:n] |= single
        cut[1:] |= single
    own = inside[1:-1]
    begin = np.flatnonzero(own & (cut[:n] | ~inside[:-2]))
    size = np.flatnonzero(own & (cut[1:] | ~inside[2:])) + 1 - begin
    every = np.lib.stride_tricks.as_strided(raw[:8].view("<u8"), (n + 1,), (1,))
    out = np.full(len(begin), _STEP)
    live, at, left = np.arange(len(begin)), begin, size
    short = size <= LONG
    if not short.all():
        live, at, left = live[short], at[short], left[short]
    with np.errstate(over="ignore"):
        while len(live):
            out[live] = mix((out[live] ^ (every[at] & _TAIL[np.minimum(left, 8)])) * _STEP + left.astype(np.uint64))
            more = left > 8
            live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(~short).tolist():
        out[i] = xxhash.xxh64_intdigest(low[begin[i] : begin[i] + size[i]])
    many = np.diff(np.searchsorted(begin, offsets - first))
    return out, many, begin - np.repeat(offsets[:-1] - first, many), size
