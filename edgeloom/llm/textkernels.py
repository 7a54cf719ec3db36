"""Numpy kernels over UTF-8 text inside Arrow batches: words, word hashes, window hashes.

A kernel works on one batch within one task. Every document of a batch stays whole; no word ever
spans two documents. Bytes from 0x80 on belong to words under every rule used here, so working on
UTF-8 bytes gives the same words as working on code points.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_P = U64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 20
#: Bytes from which on a range is hashed for itself.
_LONG = 256
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def _lut(is_word) -> np.ndarray:
    return np.array([is_word(b) for b in range(256)], bool)


#: Words are runs of anything but white space (0x09-0x0D and 0x20).
SPACE_SEPARATED = _lut(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Words are runs of digits, a-z and non-ASCII, once A-Z have been lower-cased.
ALPHANUMERIC = _lut(lambda b: b >= 0x80 or chr(b).isalnum())
#: Maps A-Z to a-z and leaves all other bytes.
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # combine_chunks may leave several
        column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


@dataclass
class Words:
    """Words of a batch: byte ranges, and for document i the words doc[i]..doc[i + 1]."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray

    @property
    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.doc) - 1), np.diff(self.doc))


def find_words(data: np.ndarray, offs: np.ndarray, word_bytes: np.ndarray) -> Words:
    """Maximal runs of word bytes inside each document."""
    n = len(data)
    if n == 0:
        zero = np.zeros(0, np.int64)
        return Words(zero, zero, np.zeros(len(offs), np.int64))
    inside = word_bytes[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offs[(offs > 0) & (offs < n)]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    start = np.flatnonzero(first)
    return Words(start, np.flatnonzero(last) + 1, np.searchsorted(start, offs))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (SplitMix64), so that every output bit depends on every input bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte range, equal for equal bytes in any batch; seeds give independent ones.

    Blocks of 8 bytes are mixed in one after the other, so no repetition or exchange within a word
    cancels out, as it would in a polynomial modulo 2**64. Ranges over ``_LONG`` bytes take BLAKE2.
    """
    out, size = np.empty(len(start), U64), end - start
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + _CHUNK, side="right")))
        base = int(start[i])
        padded = np.zeros(int(end[j - 1]) - base + 8, np.uint8)
        padded[:-8] = data[base : int(end[j - 1])]
        blocks = np.ndarray((len(padded) - 7,), "<u8", padded.data, strides=(1,))
        left, at = size[i:j].copy(), start[i:j] - base
        h = mix(left.astype(U64) + U64(0xA0761D6478BD642F * (2 * seed + 1) & 0xFFFFFFFFFFFFFFFF))
        on = np.flatnonzero(left <= _LONG)
        while len(on):
            rest = left[on]
            h[on] = mix(h[on] * _P + (blocks[at[on]] & _LOW[np.minimum(rest, 8)]))
            on = on[rest > 8]
            left[on] -= 8
            at[on] += 8
        for k in np.flatnonzero(size[i:j] > _LONG).tolist():
            digest = hashlib.blake2b(data[start[i + k] : end[i + k]].tobytes(), digest_size=8, key=bytes([seed + 1])).digest()
            h[k] = U64(int.from_bytes(digest, "little"))
        out[i:j] = h
        i = j
    return out


def window_hashes(words: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """Hash of each run of size consecutive entries; entry i covers words i .. i + size - 1."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    factor, total = U64(1), np.zeros(n, U64)
    step = int(mix(np.array([seed], U64))[0]) | 1
    for k in range(size):
        factor = U64((int(factor) * step) & 0xFFFFFFFFFFFFFFFF)
        total += words[k : k + n] * factor
    return mix(total)


def windows_inside(doc: np.ndarray, size: int) -> np.ndarray:
    """Mask over window starts: whether the window lies within one document."""
    n = int(doc[-1]) - size + 1
    if n <= 0:
        return np.zeros(0, bool)
    starts, keep = doc[:-1][np.diff(doc) > 0], np.ones(int(doc[-1]), bool)
    ends = doc[1:][np.diff(doc) > 0]
    delta = np.zeros(int(doc[-1]) + 1, np.int32)
    np.add.at(delta, np.maximum(ends - size + 1, starts), 1)
    np.add.at(delta, ends, -1)
    keep &= np.cumsum(delta[:-1]) == 0
    return keep[:n]


def covered(marks: np.ndarray, size: int, n: int) -> np.ndarray:
    """Mask over n words: covered by a window of that size starting at one of the marked words."""
    delta = np.zeros(n + 1, np.int32)
    delta[: len(marks)] += marks
    ends = np.flatnonzero(marks) + size
    np.add.at(delta, np.minimum(ends, n), -1)
    return np.cumsum(delta[:-1]) > 0


def join_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """The words joined by one space each."""
    if len(start) == 0:
        return b""
    size = end - start
    at = np.concatenate(([0], np.cumsum(size + 1)))
    out = np.full(int(at[-1]), 0x20, np.uint8)
    step = np.ones(int(at[-1]), np.int64)
    # source positions: each word's bytes followed by one position that the space overwrites
    step[0] = start[0]
    step[at[1:-1]] = start[1:] - end[:-1]
    source = np.cumsum(step)
    is_space = np.zeros(int(at[-1]), bool)
    is_space[at[1:] - 1] = True
    out[~is_space] = data[source[~is_space]]
    return out[:-1].tobytes()


def slices(rows: int, offs: np.ndarray, limit: int = 4 << 20):
    """Row ranges of at most limit bytes each (one row at least), to bound a kernel's temporaries."""
    i = 0
    while i < rows:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, min(j, rows)
        i = min(j, rows)
