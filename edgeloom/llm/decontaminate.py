"""Benchmark decontamination: Wu-Manber search for all benchmark windows at once, over words.

Patterns are runs of ``window`` consecutive item words (an item of fewer words is one pattern), in
classes of equal length m. A class has a shift table over hashed blocks of two words: how far the
window's end may move on before any pattern could end there. Many cursors, one for each stretch of
a document, step through a batch together; where the shift is 0, the suffix block's bucket (told
apart further by the prefix block) gives the patterns to test, and comparing the words confirms them.

A window that many items or places share is one pattern, with a row for each further item.

Documents are never shuffled. Items are cut into pieces that overlap by a window less a word, equal
pieces of an item are taken once, and pieces are dealt by hash to chunks of about ``chunk_bytes`` that
executors compile. A chunk is its text, kept once, and flat arrays over it, some four times its text in
all. One map over the documents goes through the chunks of ``PASS_BYTES`` in one worker; a benchmark of
more than that takes further maps, each ended by a checkpoint, after which its broadcasts are destroyed.
So neither a worker nor the driver holds more of a benchmark of any size, nor of an item of any length.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm import textkernels as K
from edgeloom.llm.common import cut, small_batches

WINDOW = 10
CHUNK_BYTES = 2 << 20
PASS_BYTES = 32 << 20
#: Windows that a piece of an item holds at most.
PIECE_WINDOWS = 1 << 13
_STRETCH = 256
_PLAIN = bytes(int(K.LOWER[b]) if K.ALPHANUMERIC[K.LOWER[b]] else 0x20 for b in range(256))


def _block(words: np.ndarray, at: np.ndarray, size: int, salt: int) -> np.ndarray:
    """Hash of the block of so many words that ends at each position."""
    total = words[at] * K.U64(2 * salt + 1)
    for k in range(1, size):
        total = total + words[at - k] * K.U64(0x9E3779B97F4A7C15 + 2 * (k + salt))
    return K.mix(total)


def _bucket(words: np.ndarray, ends: np.ndarray, m: int, block: int, suffix: np.ndarray) -> np.ndarray:
    """32 bits of the suffix and the prefix block of the m words that end at each position."""
    return (K.mix(suffix ^ _block(words, ends - m + block, block, 5)) >> K.U64(32)).astype(np.uint32)


@dataclass
class PatternClass:
    """The patterns of one length: the shift table and, in bucket order, where each begins in the text.

    A pattern's item is the one that it begins in; ``again`` lists patterns that further items have.
    """

    length: int
    block: int
    shift: np.ndarray
    bucket: np.ndarray
    start: np.ndarray
    again: np.ndarray
    again_item: np.ndarray


@dataclass
class Patterns:
    """Items' words, one space apart, items one line each; ``begin`` says where each item does."""

    text: bytes
    begin: np.ndarray
    ids: pa.Array
    classes: list[PatternClass] = field(default_factory=list)

    def holds(self, start: int, words: bytes) -> bool:
        """Whether exactly these words stand there in one item; that a word begins there is known."""
        end = start + len(words)
        return self.text.startswith(words, start) and self.text[end : end + 1] in (b"", b" ", b"\n")

    def item(self, c: PatternClass, k: int) -> set[str]:
        own = [int(np.searchsorted(self.begin, c.start[k], side="right")) - 1]
        own += c.again_item[np.searchsorted(c.again, k, side="left") : np.searchsorted(c.again, k, side="right")].tolist()
        return {self.ids[i].as_py() for i in own}


def compile_patterns(items: list[tuple[str, str]], window: int = WINDOW) -> Patterns:
    """Tables for the windows of (id, text) items; items without words give none."""
    plain = [(i, b" ".join(text.encode().translate(_PLAIN).split())) for i, text in items]
    plain = [(i, words) for i, words in plain if words]
    text = b"\n".join(words for _, words in plain)
    offs = np.concatenate(([0], np.cumsum([len(words) + 1 for _, words in plain]))).astype(np.int64)
    offs[-1] = len(text)
    place = np.uint32 if len(text) < 1 << 32 else np.int64
    out = Patterns(text, offs[:-1].astype(place), pa.array([i for i, _ in plain], pa.string()))
    data = np.frombuffer(text, np.uint8)
    words = K.find_words(data, offs, K.ALPHANUMERIC)
    hashes = K.word_hashes(data, words.start, words.end)
    sizes = np.diff(words.doc)
    lengths = np.minimum(sizes, window)
    for m in np.unique(lengths[lengths > 0]).tolist():
        which = np.flatnonzero(lengths == m)
        counts = sizes[which] - m + 1
        item = np.repeat(which, counts)
        first = words.doc[item] + np.arange(len(item)) - np.repeat(np.cumsum(counts) - counts, counts)
        block, last = min(2, m), first + m - 1
        whole, suffix = _block(hashes, last, m, 9), _block(hashes, last, block, 0)
        bucket = _bucket(hashes, last, m, block, suffix)
        order = np.lexsort((first, whole, bucket))
        begin, end = words.start[first], words.end[last]
        own, again, again_item = np.ones(len(order), bool), [], []
        same = np.flatnonzero(whole[order[1:]] == whole[order[:-1]]) + 1
        pattern, previous = order[0], 0
        for at in same.tolist():
            if own[at - 1]:
                pattern = order[at - 1]
                previous = item[pattern]
            k = order[at]
            if text[begin[k] : end[k]] == text[begin[pattern] : end[pattern]]:
                own[at] = False
                if item[k] != previous:
                    previous = item[k]
                    again.append(at)
                    again_item.append(previous)
        kept, number = order[own], np.cumsum(own) - 1
        bits = max(12, int(4 * len(kept)).bit_length())
        shift = np.full(1 << bits, m - block + 1, np.uint8 if m < 250 else np.int32)
        for j in range(block, m + 1):
            np.minimum.at(shift, (_block(hashes, first[kept] + j - 1, block, 0) >> K.U64(64 - bits)).astype(np.int64), m - j)
        further = number[np.array(again, np.int64)].astype(np.uint32), np.array(again_item, np.uint32)
        out.classes.append(PatternClass(m, block, shift, bucket[kept], words.start[first[kept]].astype(place), *further))
    return out


@dataclass
class Batch:
    """Words of some documents, found and hashed once for all patterns."""

    words: K.Words
    hashes: np.ndarray
    raw: bytes


def read_words(data: np.ndarray, offs: np.ndarray) -> Batch:
    lower = K.LOWER[data]
    words = K.find_words(lower, offs, K.ALPHANUMERIC)
    return Batch(words, K.word_hashes(lower, words.start, words.end), data.tobytes())


def search(patterns: Patterns, batch: Batch) -> tuple[np.ndarray, dict[int, set[str]]]:
    """(hit mask over words, the items found by document) for a batch."""
    words, hashes = batch.words, batch.hashes
    doc_of, hit, found = words.doc_of_word, np.zeros(len(words.start), bool), {}
    for c in patterns.classes:
        seen = set()
        m, top = c.length, K.U64(64 - (len(c.shift).bit_length() - 1))
        counts = np.maximum(np.diff(words.doc) - m + 1, 0)
        pieces = -(-counts // _STRETCH)
        which = np.repeat(np.arange(len(counts)), pieces)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = words.doc[which] + m - 1 + nth * _STRETCH
        stop = np.minimum(at + _STRETCH, words.doc[which + 1])
        ends, keys = [], []
        while len(at):
            block = _block(hashes, at, c.block, 0)
            step = c.shift[(block >> top).astype(np.int64)]
            zero = step == 0
            if zero.any():
                here = at[zero]
                key = _bucket(hashes, here, m, c.block, block[zero])
                known = c.bucket[np.minimum(np.searchsorted(c.bucket, key), len(c.bucket) - 1)] == key
                ends.append(here[known])
                keys.append(key[known])
            at = at + np.maximum(step, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        if not ends:
            continue
        end, key = np.concatenate(ends), np.concatenate(keys)
        lo, hi = np.searchsorted(c.bucket, key, "left"), np.searchsorted(c.bucket, key, "right")
        for e, a, b in zip(end.tolist(), lo.tolist(), hi.tolist(), strict=True):
            text = b" ".join(batch.raw[words.start[e - m + 1] : words.end[e]].translate(_PLAIN).split())
            for k in range(a, b):
                if patterns.holds(int(c.start[k]), text):
                    hit[e - m + 1 : e + 1] = True
                    seen.add((int(doc_of[e]), k))
        for doc, k in seen:
            found.setdefault(doc, set()).update(patterns.item(c, k))
    return hit, found


def _pieces(window: int):
    """A map from (item, text) to pieces of the items' words that hold each of its windows once."""

    def run(batches):
        for batch in batches:
            ids, texts = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = text.encode().translate(_PLAIN).split()
                for at in range(0, max(len(words) - window + 1, min(len(words), 1)), PIECE_WINDOWS):
                    ids.append(item)
                    texts.append(b" ".join(words[at : at + PIECE_WINDOWS + window - 1]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["item", "text"])

    return run


def _compiled(window: int):
    """A map from the pieces of a chunk to the chunk, compiled."""

    def run(table: pa.Table) -> pa.Table:
        items = sorted(zip(table.column("item").to_pylist(), table.column("text").to_pylist(), strict=True))
        return pa.table({"patterns": pa.array([pickle.dumps(compile_patterns(items, window), 5)], pa.binary())})

    return run


def _passes(benchmark: DataFrame, item_col: str, text_col: str, chunk_bytes: int, window: int) -> Iterator[list[Broadcast]]:
    """Lists of broadcast patterns of some ``PASS_BYTES`` each; the driver holds one task's chunks at a time."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    pieces = items.mapInArrow(_pieces(window), "item string, text string").distinct()
    total = pieces.agg(F.sum(F.octet_length("text") + F.octet_length("item"))).first()[0] or 0
    n, at_once, chunks = max(1, -(-total // chunk_bytes)), max(1, PASS_BYTES // chunk_bytes), []
    dealt = pieces.withColumn("chunk", F.pmod(F.xxhash64("item", "text"), F.lit(n))).repartition(n, "chunk")
    for row in dealt.groupBy("chunk").applyInArrow(_compiled(window), "patterns binary").toLocalIterator():
        chunks.append(spark.sparkContext.broadcast(pickle.loads(row.patterns)))
        if len(chunks) == at_once:
            yield chunks
            chunks = []
    if chunks:
        yield chunks


def _map_passes(rows: DataFrame, passes: Iterator[list[Broadcast]], marker, schema) -> DataFrame:
    """rows through one map for each pass; a pass ends in a checkpoint if another follows."""
    before: list[Broadcast] = []
    for chunks in passes:
        if before:
            rows = cut(rows)
            for old in before:
                old.destroy()
        rows = rows.mapInArrow(marker(chunks), schema)
        before = chunks
    return rows


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """One row per document row: (id, n_words, spans, items).

    spans lists the hit words as merged ranges (first, last), items the ids (as strings, sorted,
    distinct) of benchmark items with an occurring window. Null and empty texts have no words and no
    hits, and so have documents shorter than every window; null and empty items match nothing; an
    item with a null id counts under the id ''. Repeated rows are answered each for itself, repeated
    items once. An empty benchmark hits nothing. The benchmark is compiled when this is called; one
    of more than ``PASS_BYTES`` also marks the documents then, by all of it but the last pass.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.lit(None).cast("binary").alias("bits"), F.lit(None).cast("array<string>").alias("items"))
    kind = docs.schema[id_col].dataType.simpleString()
    passes = _passes(benchmark, item_col, item_text_col, chunk_bytes, window)
    rows = _map_passes(rows, passes, _marker, f"id {kind}, text string, bits binary, items array<string>")
    return rows.mapInArrow(_spans, f"id {kind}, n_words long, spans array<struct<first: long, last: long>>, items array<string>").withColumnRenamed("id", id_col)


def _marker(chunks):
    """A map over (id, text, bits, items) that adds the hits of the patterns of these chunks."""

    def run(batches):
        for batch in batches:
            data, offs = K.text_bytes(batch.column(1))
            bits, items = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for lo, hi in K.slices(batch.num_rows, offs):
                texts = read_words(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                words = texts.words
                for patterns in chunks:
                    hit, found = search(patterns.value, texts)
                    for d in np.unique(np.searchsorted(words.doc, np.flatnonzero(hit), side="right") - 1).tolist():
                        mask = np.packbits(hit[words.doc[d] : words.doc[d + 1]])
                        old = bits[lo + d]
                        bits[lo + d] = (mask if old is None else mask | np.frombuffer(old, np.uint8)).tobytes()
                    for d, own in found.items():
                        items[lo + d] = sorted(own.union(items[lo + d] or ()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.binary()), pa.array(items, pa.list_(pa.string()))], names=["id", "text", "bits", "items"])

    return run


def _spans(batches):
    """(id, text, bits, items) to (id, n_words, spans, items)."""
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    for batch in batches:
        data, offs = K.text_bytes(batch.column(1))
        words = K.find_words(K.LOWER[data], offs, K.ALPHANUMERIC)
        sizes, spans = np.diff(words.doc), []
        for n, bits in zip(sizes.tolist(), batch.column(2).to_pylist(), strict=True):
            if bits is None:
                spans.append([])
                continue
            step = np.diff(np.concatenate(([0], np.unpackbits(np.frombuffer(bits, np.uint8), count=n), [0])).astype(np.int8))
            spans.append([{"first": a, "last": b - 1} for a, b in zip(np.flatnonzero(step > 0).tolist(), np.flatnonzero(step < 0).tolist(), strict=True)])
        items = pa.array([x or [] for x in batch.column(3).to_pylist()], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kind), items], names=["id", "n_words", "spans", "items"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", *, item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, in which no benchmark window occurs.

    Null and empty texts stay, long ones are searched whole, and rows that repeat an id are judged
    each for itself. An empty benchmark, or one of null and empty items, drops nothing; an empty table
    stays empty. Only the text column is looked at, whatever the others are named.
    """
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def marker(chunks):
        def run(batches):
            for batch in batches:
                data, offs = K.text_bytes(batch.column(at).cast(pa.string()))
                clean = np.ones(batch.num_rows, bool)
                for lo, hi in K.slices(batch.num_rows, offs):
                    texts = read_words(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                    for patterns in chunks:
                        clean[[lo + d for d in search(patterns.value, texts)[1]]] = False
                yield batch.filter(pa.array(clean))

        return run

    return _map_passes(docs, _passes(benchmark, item_col, item_text_col, chunk_bytes, window), marker, docs.schema)
