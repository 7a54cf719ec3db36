"""Packing of token ids into sequences of a fixed length: best-fit decreasing within bounded chunks.

A task encodes its documents and takes them in chunks of some million ids. Of a chunk, overlong
documents are first cut into full windows; what is left, whole documents and remainders, goes by
falling length into the open window with the tightest fit, which a segment tree indexed by remaining
capacity finds. Windows that stay open by more than a tolerance are closed by cutting the pieces of
the emptiest of them into the others, and the last one into lengths that need no padding.

No row is shuffled and no key matters, so neither a hot source nor one very long document changes what a
task holds: one chunk and the document at its end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm import textkernels as K
from edgeloom.llm.common import small_batches
from edgeloom.llm.token_files import Encoder

WINDOW, END_ID = 2048, 1
#: Ids of a chunk: about 2 000 windows, so that a long and a short piece meet.
CHUNK_IDS = 1 << 22
#: A window may stay open by so many ids.
TOLERANCE = 16


class Capacities:
    """A segment tree over remaining capacities 0..most: how many open windows have each, and which."""

    def __init__(self, most: int):
        self.size = 1 << (most + 1).bit_length()
        self.count = [0] * (2 * self.size)
        self.windows: list[list[int]] = [[] for _ in range(most + 1)]

    def _add(self, capacity: int, n: int) -> None:
        at = capacity + self.size
        while at:
            self.count[at] += n
            at >>= 1

    def push(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        self._add(capacity, 1)

    def pop(self, capacity: int) -> int:
        self._add(capacity, -1)
        return self.windows[capacity].pop()

    def tightest(self, need: int) -> int | None:
        """The smallest capacity of an open window that is need or more; None without one."""
        at = need + self.size
        if self.count[at]:
            return need
        while at > 1:  # up until a right sibling has windows, then down to its smallest
            if not at & 1 and self.count[at + 1]:
                at += 1
                break
            at >>= 1
        else:
            return None
        while at < self.size:
            at = 2 * at if self.count[2 * at] else 2 * at + 1
        return at - self.size


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(window of each piece, ids in each window): pieces of 1..window ids, by falling length, each into the tightest open window.

    Pieces of one length that go into the same window one after the other are placed at once: until it is too
    small for them, it stays the tightest one.
    """
    order = np.argsort(-lengths, kind="stable")
    out, tree, left = np.zeros(len(lengths), np.int64), Capacities(window), []
    sizes, starts = np.unique(-lengths[order], return_index=True)
    stops = np.append(starts[1:], len(order))[: len(starts)]
    for size, a, b in zip((-sizes).tolist(), starts.tolist(), stops.tolist(), strict=True):
        while a < b:
            capacity = tree.tightest(size)
            if capacity is None:
                capacity, w = window, len(left)
                left.append(window)
            else:
                w = tree.pop(capacity)
            k = min(b - a, capacity // size)
            out[order[a : a + k]] = w
            a, left[w] = a + k, capacity - k * size
            if left[w]:
                tree.push(left[w], w)
    return out, window - np.array(left, np.int64)


def _is_power(n: int) -> bool:
    return n & (n - 1) == 0


def close_windows(pieces: list[list[tuple[int, int, int]]], window: int, tolerance: int) -> list[list[tuple[int, int, int]]]:
    """Open windows' pieces (row, start, length) dealt anew so that none needs more than tolerance of padding.

    The fullest window is filled from the emptiest, whose last piece is cut where it must be; the
    last window left is cut into powers of two.
    """
    used = lambda w: sum(p[2] for p in w)
    open_ = sorted((w for w in pieces if w), key=used)
    done, k = [], 0
    while open_:
        w = open_.pop()
        need = window - used(w)
        while need > tolerance and k < len(open_):
            donor = open_[k]
            row, start, length = donor.pop()
            if length > need:
                donor.append((row, start, length - need))
                start, length = start + length - need, need
            w.append((row, start, length))
            need -= length
            if not donor:
                k += 1
        if need <= tolerance or _is_power(window - need):
            done.append(w)
            if k >= len(open_):
                break
            continue
        while w:  # nothing is left to fill it with
            take = 1 << used(w).bit_length() - 1
            part = []
            while take:
                row, start, length = w.pop(0)
                if length > take:
                    w.insert(0, (row, start + take, length - take))
                    length = take
                part.append((row, start, length))
                take -= length
            done.append(part)
        break
    return done


def pack_lengths(lengths: np.ndarray, window: int = WINDOW, tolerance: int = TOLERANCE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length, sequence) of the pieces of documents of these lengths, by sequence, full windows of overlong ones first."""
    full = lengths // window
    row = np.repeat(np.arange(len(lengths)), full)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(full) - full, full)
    rest = np.flatnonzero(lengths % window)
    where, used = best_fit((lengths % window)[rest], window)
    parts = [(row, nth * window, np.full(len(row), window), np.arange(len(row)))]
    loose = (window - used > tolerance) & (used & (used - 1) != 0)
    kept = ~loose[where] if len(where) else np.zeros(0, bool)
    number = len(row) + np.cumsum(~loose) - 1
    parts.append((rest[kept], (full * window)[rest[kept]], (lengths % window)[rest[kept]], number[where[kept]]))
    held: dict[int, list] = {}
    for i in np.flatnonzero(~kept).tolist():
        held.setdefault(int(where[i]), []).append((int(rest[i]), int(full[rest[i]] * window), int(lengths[rest[i]] % window)))
    next_ = len(row) + int((~loose).sum())
    closed = [(*p, next_ + k) for k, w in enumerate(close_windows(list(held.values()), window, tolerance)) for p in w]
    parts.append(tuple(np.array([p[c] for p in closed], np.int64) for c in range(4)))
    row, start, length, sequence = (np.concatenate([p[c] for p in parts]).astype(np.int64) for c in range(4))
    order = np.lexsort((start, row, sequence))
    return row[order], start[order], length[order], sequence[order]


_encoders: dict[str, Encoder] = {}


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, window: int = WINDOW, end_id: int = END_ID, chunk_ids: int = CHUNK_IDS, tolerance: int = TOLERANCE) -> DataFrame:
    """(id, start, length, doc_tokens, sequence_id, offset, padded_length, ids): the pieces of all documents, in sequences of at most window ids.

    A document's ids are those of its text and the end id; start counts its ids before the piece, offset
    the sequence's, ids are little-endian unsigned 32-bit integers. padded_length is what the sequence
    takes: its own length at a power of two, else the window. sequence_id is the chunk's number shifted
    over the place in it; sequences do not reach across chunks, and which documents share a chunk
    follows from how the table is read. One chunk is in memory at a time, with the whole of the
    document that ends it.

    A null or empty text is the end id alone; rows that repeat an id, or have none, are documents of
    their own; an empty table gives no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession, 500)

    def run(batches):
        if tokenizer not in _encoders:
            _encoders[tokenizer] = Encoder(tokenizer)
        encoder, task, chunks = _encoders[tokenizer], TaskContext.get().partitionId(), 0
        names, sizes, held, n = [], [], [], 0

        def chunk():
            lengths, ids = np.concatenate(sizes), np.concatenate(held)
            doc = pa.concat_arrays(names)
            before = np.cumsum(lengths) - lengths
            row, start, length, sequence = pack_lengths(lengths, window, tolerance)
            used = np.bincount(sequence, weights=length).astype(np.int64)
            first = np.searchsorted(sequence, sequence)
            offset = np.cumsum(length) - length
            offset = offset - offset[first]
            padded = np.where(used & (used - 1) == 0, used, window)
            at, size = before[row] + start, length
            for lo in range(0, len(row), 4096):
                hi = min(lo + 4096, len(row))
                blobs = [ids[a : a + k].tobytes() for a, k in zip(at[lo:hi].tolist(), size[lo:hi].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        doc.take(pa.array(row[lo:hi])), pa.array(start[lo:hi]), pa.array(length[lo:hi]), pa.array(lengths[row[lo:hi]]),
                        pa.array(((task << 20 | chunks) << 24) + sequence[lo:hi]), pa.array(offset[lo:hi]), pa.array(padded[sequence[lo:hi]]), pa.array(blobs, pa.binary()),
                    ],
                    names=["doc", "start", "length", "doc_tokens", "sequence_id", "offset", "padded_length", "ids"],
                )

        for batch in batches:
            data, offs = K.text_bytes(batch.column(1))
            for lo, hi in K.slices(batch.num_rows, offs, 1 << 19):
                ids, each = encoder.encode(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                out = np.full(len(ids) + len(each), end_id, np.uint32)
                out[np.arange(len(ids)) + np.repeat(np.arange(len(each)), each)] = ids
                names.append(batch.column(0).slice(lo, hi - lo))
                sizes.append(each + 1)
                held.append(out)
                n += len(out)
                if n >= chunk_ids:
                    yield from chunk()
                    names, sizes, held, n, chunks = [], [], [], 0, chunks + 1
        if n:
            yield from chunk()

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    schema = "doc long, start long, length long, doc_tokens long, sequence_id long, offset long, padded_length long, ids binary"
    return rows.mapInArrow(run, schema).withColumnRenamed("doc", id_col)
