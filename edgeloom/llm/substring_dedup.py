"""Substring dedup: a merged count-min sketch finds the windows that may repeat, a second pass groups only those.

Documents are dealt once into groups of about ``group_bytes`` by id and text. Each group sends the
distinct hashes of its windows, packed, as its partial sketch; the sketch is cut into shards by hash
so that no task holds more than one shard and a bigger corpus means more shards, not bigger ones.
Merging a shard adds the partial sketches into count-min tables, which can only overestimate, and
answers each group with one bit per window: estimated in two documents or more, or not. Windows with
that bit go to the exact grouping by 96 bits, 64 of one word hash and 32 of an independent one, each
group sending one row per window with its smallest document, so a passage that a third of all
documents share costs one entry a group. The answer is again one bit per window: whether this group
holds the first document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm import textkernels as K
from edgeloom.llm.common import partitions_for, small_batches

WINDOW = 13
GROUP_BYTES = 8 << 20
SHARD_BYTES = 12 << 20
_LAST = np.iinfo(np.int64).max


def _zip(a: np.ndarray) -> bytes:
    return np.uint32(a.nbytes).tobytes() + pa.compress(a.tobytes(), codec="zstd", asbytes=True)


def _unzip(b: bytes, dtype) -> np.ndarray:
    n = int(np.frombuffer(b[:4], np.uint32)[0])
    return np.frombuffer(pa.decompress(b[4:], decompressed_size=n, codec="zstd", asbytes=True), dtype) if n else np.zeros(0, dtype)


def _zip_sorted(a: np.ndarray) -> bytes:
    """Sorted uint32 as steps, low bytes apart from high ones, which compress well."""
    steps = np.diff(a, prepend=np.uint32(0)).astype(np.uint32)
    return _zip(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).ravel())


def _unzip_sorted(b: bytes) -> np.ndarray:
    planes = _unzip(b, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.uint32)


class _Group:
    """The windows of one group of documents; the same documents always give the same order."""

    def __init__(self, table: pa.Table, size: int, shards: int):
        ids = table.column("doc").combine_chunks()
        ids = np.asarray(ids.fill_null(_LAST) if ids.null_count else ids).astype(np.int64)
        order = np.argsort(ids, kind="stable")
        self.rows = table.take(pa.array(order))
        self.ids = ids[order]
        self.data, self.offs = K.text_bytes(self.rows.column("text"))
        self.words = K.find_words(self.data, self.offs, K.SPACE_SEPARATED)
        hashes = K.word_hashes(self.data, self.words.start, self.words.end)
        self.at = np.flatnonzero(K.windows_inside(self.words.doc, size))
        one = K.window_hashes(hashes, size)[self.at]
        two = K.window_hashes(K.word_hashes(self.data, self.words.start, self.words.end, seed=1), size, seed=2)[self.at]
        doc = self.ids[self.words.doc_of_word[self.at]]
        by = np.argsort(one)
        new = np.ones(len(by), bool)
        new[1:] = (one[by][1:] != one[by][:-1]) | (two[by][1:] != two[by][:-1])
        start = np.flatnonzero(new)
        #: entry of each window, and of each entry: hashes, smallest document, whether more than one has it;
        #: cuts has the entries of each shard that has any, never more shards than there are windows
        self.entry = np.empty(len(by), np.int64)
        self.entry[by] = np.cumsum(new) - 1
        self.one, self.two = one[by][start], two[by][start].astype(np.uint32)
        docs = doc[by]
        self.first = np.minimum.reduceat(docs, start) if len(start) else docs[:0]
        self.many = (np.maximum.reduceat(docs, start) if len(start) else docs[:0]) != self.first
        self.doc = doc
        shard, self.low = _place(self.one, shards)
        key, at = np.unique(shard, return_index=True)
        ends = np.append(at, len(start))[1:]
        self.cuts = {s: (a, b) for s, a, b in zip(key.tolist(), at.tolist(), ends.tolist(), strict=True)}


def _place(one: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, cell) of window hashes: equal ranges of the hash, and the 32 bits that follow; both rise with it."""
    if shards < 2:
        return np.zeros(len(one), np.int64), (one >> K.U64(32)).astype(np.uint32)
    width = (1 << 64) // shards + 1
    shard = one // K.U64(width)
    return shard.astype(np.int64), ((one - shard * K.U64(width)) >> K.U64(max(0, width.bit_length() - 32))).astype(np.uint32)


def _sketch(table: pa.Table, size: int, shards: int) -> pa.Table:
    """A group's partial sketch, by shard."""
    g, key = _Group(table, size, shards), table.column("g")[0].as_py()
    rows = [(s, key, _zip_sorted(g.low[a:b]), np.packbits(g.many[a:b]).tobytes()) for s, (a, b) in g.cuts.items()]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ((), (), (), ()), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["shard", "g", "cells", "many"])


def _estimate(table: pa.Table) -> pa.Table:
    """Merge the partial sketches of one shard; answer each group which cells reach two in every row."""
    cells = [_unzip_sorted(b) for b in table.column("cells").to_pylist()]
    many = [np.unpackbits(np.frombuffer(b, np.uint8), count=len(c)) for b, c in zip(table.column("many").to_pylist(), cells, strict=True)]
    bits = min(26, max(16, int(4 * sum(map(len, cells))).bit_length()))
    repeated = [np.ones(len(c), bool) for c in cells]
    for factor in (0x9E3779B1, 0x85EBCA77):
        at = [((c * np.uint32(factor)) >> np.uint32(32 - bits)).astype(np.int64) for c in cells]
        counts = np.zeros(1 << bits, np.uint32)
        for a, m in zip(at, many, strict=True):
            np.add.at(counts, a, 1 + m.astype(np.uint32))
        repeated = [r & (counts[a] > 1) for r, a in zip(repeated, at, strict=True)]
    flags = pa.array([_zip(np.packbits(r)) for r in repeated], pa.binary())
    return pa.table([table.column("g"), table.column("shard"), pa.array([0] * len(cells), pa.int32()), flags], names=["g", "shard", "kind", "flags"])


def _selected(g: _Group, flags: dict[int, bytes]) -> np.ndarray:
    out = np.zeros(len(g.one), bool)
    for s, b in flags.items():
        a, e = g.cuts[s]
        out[a:e] = np.unpackbits(_unzip(b, np.uint8), count=e - a)
    return out


def _repeated(table: pa.Table, answers: pa.Table, size: int, shards: int) -> pa.Table:
    """A group's windows that are estimated repeated, by shard, with the group's smallest document."""
    rows = []
    if table.num_rows:
        g, key = _Group(table, size, shards), table.column("g")[0].as_py()
        chosen = _selected(g, dict(zip(answers.column("shard").to_pylist(), answers.column("flags").to_pylist(), strict=True)))
        for s, (a, b) in g.cuts.items():
            if len(k := a + np.flatnonzero(chosen[a:b])):
                rows.append((s, key, g.one[k].tobytes(), g.two[k].tobytes(), _zip(g.first[k])))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ((),) * 5, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["shard", "g", "one", "two", "first"])


def _group_exactly(table: pa.Table) -> pa.Table:
    """Of one shard's windows, the first document; answers each group whether it holds that document."""
    one = [np.frombuffer(b, K.U64) for b in table.column("one").to_pylist()]
    sizes = np.array([len(x) for x in one])
    one, two = np.concatenate(one), np.frombuffer(b"".join(table.column("two").to_pylist()), np.uint32)
    first = np.concatenate([_unzip(b, np.int64) for b in table.column("first").to_pylist()])
    by = np.lexsort((two, one))  # equal windows of several groups must stand together
    new = np.ones(len(by), bool)
    new[1:] = (one[by][1:] != one[by][:-1]) | (two[by][1:] != two[by][:-1])
    least = np.minimum.reduceat(first[by], np.flatnonzero(new))
    own = np.empty(len(by), bool)
    own[by] = first[by] == least[np.cumsum(new) - 1]
    flags = [_zip(np.packbits(x)) for x in np.split(own, np.cumsum(sizes)[:-1])]
    return pa.table([table.column("g"), table.column("shard"), pa.array([1] * len(flags), pa.int32()), pa.array(flags, pa.binary())], names=["g", "shard", "kind", "flags"])


def _remove(table: pa.Table, answers: pa.Table, size: int, shards: int) -> pa.Table:
    """(doc, n_words, n_removed, kept) of a group's documents."""
    names = ["doc", "n_words", "n_removed", "kept"]
    if not table.num_rows:
        return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string())], names=names)
    g = _Group(table, size, shards)
    kinds: tuple[dict, dict] = ({}, {})
    for s, kind, b in zip(*(answers.column(c).to_pylist() for c in ("shard", "kind", "flags")), strict=True):
        kinds[kind][s] = b
    chosen = _selected(g, kinds[0])
    own = np.ones(len(g.one), bool)
    for s, b in kinds[1].items():
        a, e = g.cuts[s]
        k = a + np.flatnonzero(chosen[a:e])
        own[k] = np.unpackbits(_unzip(b, np.uint8), count=len(k))
    gone = chosen[g.entry] & (~own[g.entry] | (g.doc > g.first[g.entry]))
    n = len(g.words.start)
    marks = np.zeros(n, bool)
    marks[g.at[gone]] = True
    gone = K.covered(marks, size, n) if n else marks
    kept, removed = [], np.add.reduceat(np.append(gone, False).astype(np.int64), np.minimum(g.words.doc[:-1], n)) * (np.diff(g.words.doc) > 0)
    for a, b in zip(g.words.doc[:-1].tolist(), g.words.doc[1:].tolist(), strict=True):
        keep = a + np.flatnonzero(~gone[a:b])
        kept.append(K.join_words(g.data, g.words.start[keep], g.words.end[keep]))
    return pa.table([g.rows.column("doc"), pa.array(np.diff(g.words.doc), pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=names)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = WINDOW, group_bytes: int = GROUP_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per document row: (id, n_words, n_removed, kept_text).

    A word goes if a window of ``window`` words covers it whose word sequence also starts in a
    document with a smaller id; windows are judged on the input. kept_text has the words that stay,
    joined by one space. Null, empty and blank texts have no words and an empty kept_text. Rows that
    repeat an id are one document and do not remove each other's windows; a null id counts as larger
    than all others. Texts of fewer words than a window stay whole.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups, shards = partitions_for(spark, total, group_bytes), partitions_for(spark, total, shard_bytes)
    # by id and text, so that rows that repeat one id (or have none) are spread; which group a row is in changes no result
    dealt = rows.withColumn("g", F.pmod(F.xxhash64("doc", "text"), F.lit(groups)).cast("int")).groupBy("g")
    sketches = dealt.applyInArrow(lambda t: _sketch(t, window, shards), "shard int, g int, cells binary, many binary")
    answer = "g int, shard int, kind int, flags binary"
    repeated = sketches.groupBy("shard").applyInArrow(_estimate, answer)
    windows = dealt.cogroup(repeated.groupBy("g")).applyInArrow(lambda t, a: _repeated(t, a, window, shards), "shard int, g int, one binary, two binary, first binary")
    first = windows.groupBy("shard").applyInArrow(_group_exactly, answer)
    out = dealt.cogroup(repeated.union(first).groupBy("g")).applyInArrow(lambda t, a: _remove(t, a, window, shards), "doc long, n_words long, n_removed long, kept string")
    return out.select(F.col("doc").alias(id_col), "n_words", "n_removed", F.col("kept").alias("kept_text"))
