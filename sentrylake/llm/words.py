"""Words of texts, a batch at a time: their places in the batch's bytes and their hashes, without an object a word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BLOCK = 8192  # words hashed at a time, so that the steps stay in the cache
_LONG = 256  # bytes from which a word is hashed on its own


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    x = x ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(33))) * _MIX1
    x = (x ^ (x >> np.uint64(33))) * _MIX2
    return x ^ (x >> np.uint64(33))


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], eight bytes a step; spans of up to eight bytes of one length never clash."""
    out = np.empty(len(starts), dtype=np.uint64)
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))  # the eight bytes from each place on
    for low in range(0, len(starts), _BLOCK):
        at, lengths = starts[low : low + _BLOCK], (ends[low : low + _BLOCK] - starts[low : low + _BLOCK])
        spare = np.maximum(8 - lengths, 0).astype(np.uint64) << np.uint64(3)
        block = mixed((eight[at] << spare) ^ (lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        rows = np.flatnonzero((lengths > 8) & (lengths <= _LONG))
        done = 8
        while len(rows):
            left = lengths[rows] - done
            spare = np.maximum(8 - left, 0).astype(np.uint64) << np.uint64(3)
            block[rows] = mixed(block[rows] ^ (eight[at[rows] + done] << spare))
            rows = rows[left > 8]
            done += 8
        for k in np.flatnonzero(lengths > _LONG).tolist():
            block[k] = xxhash.xxh3_64_intdigest(data[at[k] : at[k] + lengths[k]].tobytes())
        out[low : low + _BLOCK] = block
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, changed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """`hashes` with those at `changed` made anew for data[start:end]."""
    out = hashes.copy()
    out[changed] = _hashes(data, starts[changed], ends[changed])
    return out


@dataclass
class Words:
    """Of a batch of texts: word k stands at data[starts[k]:ends[k]] and hashes to hashes[k]; text i has words first[i] to before first[i + 1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray
    offsets: np.ndarray  # where each text begins in data

    def single_blanks(self) -> np.ndarray:
        """The batch's bytes with every blank character a space."""
        out = self.data.copy()
        out[(out >= 0x09) & (out <= 0x0D)] = 0x20
        return out


def batch_words(column: pa.Array) -> Words:
    """Words of a string column: runs without blank, tab or line ends (\\x20, \\x09-\\x0D), unchanged. Null has none."""
    column = column.fill_null("") if column.null_count else column
    _, places, held = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(places, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(held, dtype=np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, dtype=np.uint8)
    offsets = offsets - offsets[0]
    solid = (data != 0x20) & ((data - np.uint8(0x09)) > 4)
    begins, stops = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    stops[:-1] &= ~solid[1:]
    full = np.diff(offsets) > 0
    heads, tails = offsets[:-1][full], offsets[1:][full] - 1
    begins[heads], stops[tails] = solid[heads], solid[tails]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets), _hashes(data, starts, ends), offsets)


def gram_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` neighbouring words, over the ends of texts too."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        total = total * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    return mixed(total)


def slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """data[start:end] of each pair, as a binary column."""
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    whole = data.tobytes()
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join([whole[a:b] for a, b in zip(starts.tolist(), ends.tolist())]))])
