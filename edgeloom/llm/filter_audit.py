"""Audit of filters: what each removes at each step of each order, and what it shares with the others.

A document's failures are five bits. Which filter removes it in an order is the first of its failures
in that order, so a table of 32 masks by 120 orders, built once, answers all orders at the price of one
look-up; np.bincount adds the removals up by order, step and label, and the partial arrays of all
batches are summed.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from edgeloom.llm import textkernels as K
from edgeloom.llm.common import cut, small_batches

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT, SIGNS = 200, 50, 3, "#$%&*|"

_UPPER = np.array([0x41 <= b <= 0x5A for b in range(256)])
_SIGN = np.array([chr(b) in SIGNS for b in range(256)])
_FIRST_BYTE = np.array([b & 0xC0 != 0x80 for b in range(256)])
_COUNTS = ("total", "removed", "good_lost", "toxic_lost", "fails", "unique_fails")
#: Parts that a task adds up before it hands its arrays on.
HELD_PARTS = 256


def first_failure_table() -> np.ndarray:
    """(32, 120): the step, from 0, at which each mask fails first in each order; STEPS if it never does."""
    bit = np.array([[1 << FILTERS.index(f) for f in order] for order in ORDERS])
    fails = (np.arange(1 << STEPS)[:, None, None] & bit[None]) != 0
    return np.where(fails.any(axis=2), fails.argmax(axis=2), STEPS)


def _per_document(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[offs])


def text_failures(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The bits of A to D of each text: its own words, capitals and signs.

    Different words are told apart by 64-bit hashes; a count so near the limit that one collision would
    decide is taken again from the words themselves.
    """
    words = K.find_words(data, offs, K.SPACE_SEPARATED)
    n = np.diff(words.doc)
    doc = words.doc_of_word
    key = K.mix(K.word_hashes(data, words.start, words.end) + K.mix(doc.astype(K.U64) + K.U64(1)))
    order = np.argsort(key, kind="stable")
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    distinct = np.bincount(doc[order][new], minlength=len(n))
    for i in np.flatnonzero((100 * distinct < MIN_DISTINCT_PERCENT * n) & (100 * (distinct + 1) >= MIN_DISTINCT_PERCENT * n)).tolist():
        distinct[i] = len({data[a:b].tobytes() for a, b in zip(words.start[words.doc[i] : words.doc[i + 1]], words.end[words.doc[i] : words.doc[i + 1]], strict=True)})
    upper, points = _per_document(_UPPER[data], offs), _per_document(_FIRST_BYTE[data], offs)
    fails = [n < MIN_WORDS, 100 * distinct < MIN_DISTINCT_PERCENT * n, 100 * upper > MAX_UPPER_PERCENT * points, _per_document(_SIGN[data], offs) > 0]
    return sum(f.astype(np.int64) << k for k, f in enumerate(fails))


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc, part, mask): the failed filters of each row of docs, bit 0 for A to bit 4 for E.

    E compares a 128-bit digest of the whole text with those of the whole table: a row fails if a
    smaller id has the same text. Rows without an id fail for nobody and never fail E; rows that share
    id and text do not fail for each other. A null text is empty, a null part is the empty string.
    The least id of each text that repeats is joined to narrow rows, where adaptive execution can split
    the rows of a text that many documents have.
    """
    small_batches(docs.sparkSession, 500)

    def run(batches):
        for batch in batches:
            data, offs = K.text_bytes(batch.column(2))
            for lo, hi in K.slices(batch.num_rows, offs):
                mask = text_failures(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                digests = b"".join(hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(offs[lo:hi].tolist(), offs[lo + 1 : hi + 1].tolist(), strict=True))
                pair = np.frombuffer(digests, "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(mask), pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["doc", "part", "mask", "h1", "h2"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).cast("string").alias("text"))
    rows = cut(rows.mapInArrow(run, "doc long, part string, mask long, h1 long, h2 long"))
    repeated = cut(rows.groupBy("h1", "h2").agg(F.min("doc").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n"))
    found = rows.join(repeated, ["h1", "h2"], "left")
    last = 1 << FILTERS.index("E")
    return found.select("doc", "part", (F.col("mask") + F.when(F.col("doc") > F.col("least"), last).otherwise(0)).alias("mask"))


def audit(failed: DataFrame) -> DataFrame:
    """Counts of each part, order and step from failed(part, mask, good, toxic).

    (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley),
    longs but for the step: kept is what passes this step and those before, removed what this step takes out,
    redundant what fails its filter but went before, unique_fails what fails no other filter, shapley
    the removals of its filter summed over all orders. Zeros are rows too. A task adds up arrays of a
    fixed size a part and hands them on every HELD_PARTS parts, so it never holds more than these; no
    rows give no counts.
    """

    def run(batches):
        table, held = first_failure_table(), {}
        cell = np.arange(len(ORDERS)) * (STEPS + 1)
        shape = (len(ORDERS), STEPS + 1)
        own = np.array([[1 << FILTERS.index(f) for f in order] for order in ORDERS])
        every = np.arange(1 << STEPS)

        def flush():
            n = len(ORDERS) * STEPS
            parts, cells, counts = [], [], []
            for part, (removed, masks) in held.items():
                fails = ((every[:, None, None] & own[None] != 0) * masks[:, None, None]).sum(axis=0)
                parts += [part] * n
                cells.append(np.arange(n))
                counts.append(np.stack([np.full(n, masks.sum()), *(r[:, :STEPS].ravel() for r in removed), fails.ravel(), masks[own].ravel()]))
            held.clear()
            columns = np.concatenate(counts, axis=1)
            return pa.RecordBatch.from_arrays([pa.array(parts, pa.string()), pa.array(np.concatenate(cells)), *(pa.array(c) for c in columns)], names=["part", "cell", *_COUNTS])

        for batch in batches:
            mask = batch.column(1).to_numpy()
            labels = [np.ones(len(mask), bool), *(batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))]
            encoded = batch.column(0).dictionary_encode()
            which = encoded.indices.to_numpy()
            for k, part in enumerate(encoded.dictionary.to_pylist()):
                removed, masks = held.setdefault(part, (np.zeros((3, *shape), np.int64), np.zeros(1 << STEPS, np.int64)))
                masks += np.bincount(mask[which == k], minlength=1 << STEPS)
                for of_label, label in zip(removed, labels, strict=True):
                    at = table[mask[(which == k) & label]] + cell
                    of_label += np.bincount(at.ravel(), minlength=len(ORDERS) * (STEPS + 1)).reshape(shape)
                if len(held) >= HELD_PARTS:
                    yield flush()
        if held:
            yield flush()

    rows = failed.select("part", F.col("mask").cast("long").alias("mask"), "good", "toxic")
    summed = rows.mapInArrow(run, "part string, cell long, " + ", ".join(f"{c} long" for c in _COUNTS)).groupBy("part", "cell").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    order = F.array(*[F.lit(o) for o in ORDERS])[F.floor(F.col("cell") / STEPS).cast("int")]
    step = (F.col("cell") % STEPS + 1).cast("int")
    named = summed.select("part", order.alias("filter_order"), step.alias("step"), *_COUNTS).withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    gone = F.sum("removed").over(W.partitionBy("part", "filter_order").orderBy("step"))
    return named.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - gone).alias("kept"),
        "removed",
        (F.col("fails") - F.col("removed")).alias("redundant"),
        "unique_fails",
        "good_lost",
        "toxic_lost",
        F.sum("removed").over(W.partitionBy("part", "filter")).alias("shapley"),
    )


def audit_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """audit() of docs, with the labels(id, quality, toxic) of some of them.

    A document is good or toxic if any of its label rows says so (1); null ids and null labels say
    nothing. Other columns of either table are ignored; an empty table of documents gives no rows.
    """
    flags = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    known = failures(docs, id_col, text_col, part_col).join(cut(flags.where("good OR toxic")), "doc", "left")
    return audit(known.select("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")))
