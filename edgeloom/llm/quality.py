"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j). The pairwise sum is taken in
linear time as 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]. Features of a text: its words
hashed into ``2**HASH_BITS`` slots with L2-normalised counts; statistics of its bytes, words and
lines, each as one of ``BINS`` quantile bins; metadata columns, binned alike, null having its own bin.

The machine is fitted on the driver from a bounded sample of labelled rows, at most ``sample`` of
each class, chosen by hash of the id. Scoring is one map over the documents with the model (a table
of fixed size) broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from edgeloom.llm import textkernels as K
from edgeloom.llm.common import small_batches

HASH_BITS, BINS, FACTORS, SAMPLE, EPOCHS = 14, 12, 8, 6000, 12
#: Text that is worked on at a time; the temporaries take some 80 bytes a byte.
SLICE_BYTES = 1 << 20

_UPPER, _LETTER, _DIGIT = (np.array([a <= b < a + n for b in range(256)]) for a, n in ((0x41, 26), (0x61, 26), (0x30, 10)))
_SIGN = np.array([0x21 <= b < 0x7F and not chr(b).isalnum() and chr(b) not in ".,'-" for b in range(256)])
_LINE = np.array([b != 0x0A for b in range(256)])


def _per(cuts: np.ndarray, values: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.float64)))
    return total[cuts[1:]] - total[cuts[:-1]]


def _ratio(a, b):
    return a / np.maximum(b, 1)


def statistics(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, K.Words, np.ndarray]:
    """(documents x statistics, words, word hashes) of a batch of texts."""
    words = K.find_words(data, offs, K.SPACE_SEPARATED)
    hashes = K.word_hashes(K.LOWER[data], words.start, words.end)
    n, size, cuts, letters = len(words.start), np.diff(offs), words.doc, _LETTER[data] | _UPPER[data] | (data >= 0x80)
    length = (words.end - words.start).astype(float)
    same = np.zeros(n, bool)
    same[1:] = hashes[1:] == hashes[:-1]
    same[cuts[:-1][cuts[:-1] < n]] = False
    sign = _SIGN[data[words.end - 1]] if n else np.zeros(0, bool)
    upper = _UPPER[data[words.start]] & _UPPER[data[np.minimum(words.start + 1, words.end - 1)]] if n else np.zeros(0, bool)
    lines = K.find_words(data, offs, _LINE)
    in_line = np.searchsorted(words.start, np.append(lines.start, len(data)))
    line_hash = K.word_hashes(data, lines.start, lines.end)
    doc_of_line = lines.doc_of_word
    again = np.ones(len(line_hash), bool)
    if len(line_hash):
        order = np.lexsort((line_hash, doc_of_line))
        new = np.ones(len(order), bool)
        new[1:] = (line_hash[order][1:] != line_hash[order][:-1]) | (doc_of_line[order][1:] != doc_of_line[order][:-1])
        again[order] = ~new
    in_words = np.diff(in_line)
    columns = [
        np.log1p(np.diff(cuts)),
        np.log1p(size),
        _ratio(_per(cuts, length), np.diff(cuts)),
        _ratio(_per(offs, _UPPER[data]), _per(offs, letters)),
        _ratio(_per(offs, letters), size),
        _ratio(_per(offs, _DIGIT[data]), size),
        _ratio(_per(offs, _SIGN[data]), size),
        _ratio(_per(cuts, same), np.diff(cuts)),
        _ratio(_per(cuts, sign), np.diff(cuts)),
        _ratio(_per(cuts, upper), np.diff(cuts)),
        _ratio(_per(lines.doc, again), np.diff(lines.doc)),
        np.log1p(_ratio(np.diff(cuts), np.diff(lines.doc))),
        _ratio(_per(offs, (data == 0x2E) | (data == 0x3F)), np.diff(cuts)),
    ]
    for flag in (same, sign, upper):  # of the worst line with five words or more
        share = np.where(in_words >= 5, _ratio(_per(in_line, flag), in_words), 0.0)
        worst = np.zeros(len(size))
        np.maximum.at(worst, doc_of_line, share)
        columns.append(worst)
    return np.column_stack(columns), words, hashes


def _hashed(words: K.Words, hashes: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, slot, value): hashed word counts of L2 norm 1, by document."""
    slots = (hashes >> K.U64(64 - HASH_BITS)).astype(np.int64)
    keys, counts = np.unique((words.doc_of_word << HASH_BITS) | slots, return_counts=True)
    doc, value = keys >> HASH_BITS, counts.astype(np.float64)
    norm = np.sqrt(np.bincount(doc, value**2, n_docs))
    return doc, keys & ((1 << HASH_BITS) - 1), value / norm[doc]


@dataclass
class Machine:
    """Bin edges of each statistic and the weights of all slots."""

    edges: list[np.ndarray]
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def score(self, data: np.ndarray, offs: np.ndarray, meta: np.ndarray) -> np.ndarray:
        stats, words, hashes = statistics(data, offs)
        doc, slot, value = _with_bins(_hashed(words, hashes, len(stats)), np.column_stack([stats, meta]), self.edges)
        n = len(stats)
        z = self.bias + np.bincount(doc, self.linear[slot] * value, n)
        for f in range(self.factors.shape[1]):
            x = self.factors[slot, f] * value
            z += 0.5 * (np.bincount(doc, x, n) ** 2 - np.bincount(doc, x * x, n))
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _with_bins(hashed, stats: np.ndarray, edges: list[np.ndarray]):
    doc, slot, value = hashed
    n, k = stats.shape
    bins = np.column_stack([np.where(np.isnan(stats[:, j]), BINS, np.searchsorted(edges[j], stats[:, j], side="right")) for j in range(k)])
    bins = bins + (1 << HASH_BITS) + np.arange(k) * (BINS + 1)
    return (
        np.concatenate([doc, np.repeat(np.arange(n), k)]),
        np.concatenate([slot, bins.ravel()]),
        np.concatenate([value, np.full(n * k, 1 / np.sqrt(k))]),
    )


def _fit(stats: np.ndarray, hashed, labels: np.ndarray, prior: float, epochs: int, factors: int) -> Machine:
    """Adam on the log loss, each class weighted to its share of all labelled rows. hashed is by document."""
    edges = [np.unique(np.nanquantile(s, np.linspace(0, 1, BINS + 1)[1:-1])) if not np.isnan(s).all() else np.zeros(0) for s in stats.T]
    doc, own, worth = hashed
    n, k = stats.shape
    counts = np.bincount(doc, minlength=n)
    cuts = np.concatenate(([0], np.cumsum(counts + k)))
    slot, value = np.empty(cuts[-1], np.int32), np.empty(cuts[-1], np.float32)
    at = np.arange(len(doc)) + np.repeat(k * np.arange(n), counts)
    slot[at], value[at] = own, worth
    at = (cuts[1:, None] - k + np.arange(k)).ravel()
    slot[at], value[at] = _with_bins((doc[:0], own[:0], worth[:0]), stats, edges)[1:]
    del doc, own, worth, at, hashed
    rng = np.random.default_rng(7)
    size = (1 << HASH_BITS) + stats.shape[1] * (BINS + 1)
    theta = np.zeros((size, factors + 1))
    theta[:, 1:] = rng.normal(0, 0.05, (size, factors))
    bias, m, v, step = 0.0, np.zeros_like(theta), np.zeros_like(theta), 0
    weight = np.where(labels == 1, prior / max(labels.mean(), 1e-9), (1 - prior) / max(1 - labels.mean(), 1e-9))
    for _ in range(epochs):
        shuffled = rng.permutation(len(labels))
        for a in range(0, len(labels), 128):
            rows = shuffled[a : a + 128]
            lens = cuts[rows + 1] - cuts[rows]
            at = np.arange(lens.sum()) + np.repeat(cuts[rows] - np.concatenate(([0], np.cumsum(lens)[:-1])), lens)
            s, x, d = slot[at], value[at].astype(float), np.repeat(np.arange(len(rows)), lens)
            xv = theta[s, 1:] * x[:, None]
            sums = np.column_stack([np.bincount(d, xv[:, f], len(rows)) for f in range(factors)])
            squares = np.bincount(d, (xv**2).sum(axis=1), len(rows))
            z = bias + np.bincount(d, theta[s, 0] * x, len(rows)) + 0.5 * ((sums**2).sum(axis=1) - squares)
            error = weight[rows] * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels[rows]) / len(rows)
            bias -= 0.5 * error.sum()
            grad = np.empty((len(s), factors + 1))
            grad[:, 0] = error[d] * x
            grad[:, 1:] = (error[d] * x)[:, None] * (sums[d] - xv)
            total = 1e-6 * theta
            for f in range(factors + 1):
                total[:, f] += np.bincount(s, grad[:, f], size)
            step += 1
            m += 0.1 * (total - m)
            v += 0.001 * (total**2 - v)
            theta -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Machine(edges, bias, theta[:, 0].copy(), theta[:, 1:].copy())


def _meta(batch_columns) -> np.ndarray:
    columns = [np.log1p(np.maximum(c.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False), 0)) for c in batch_columns]
    return np.column_stack(columns) if columns else np.zeros((0, 0))


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that no label is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = ("n_chars",), *, label_col: str = "quality", sample: int = SAMPLE, epochs: int = EPOCHS, factors: int = FACTORS) -> Machine:
    """Fit on at most ``sample`` labelled rows of each class from outside the held-out fold.

    Labels other than 0 and 1, and null ids, are left out; repeated labels count once, and of rows
    that repeat an id one is taken. Without any usable row the machine scores 0.5 for every text.
    """
    small_batches(docs.sparkSession)
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label")).distinct()
    shares = {r["__label"]: r["count"] for r in usable.groupBy("__label").count().collect()}
    chosen = [usable.where(F.col("__label") == k).orderBy(F.xxhash64("__id"), "__id").limit(sample) for k in (0, 1)]
    rows = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).cast("string").alias("__text"), *[F.col(c).alias(f"__meta{i}") for i, c in enumerate(meta_cols)])
    rows = rows.join(F.broadcast(chosen[0].union(chosen[1])), F.col("__doc") == F.col("__id")).select("__id", "__label", "__text", *[f"__meta{i}" for i in range(len(meta_cols))])
    kind = rows.schema["__id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for lo, hi in K.slices(batch.num_rows, K.text_bytes(batch.column(2))[1], SLICE_BYTES):
                part = batch.slice(lo, hi - lo)
                data, offs = K.text_bytes(part.column(2))
                stats, words, hashes = statistics(data, offs)
                doc, slot, value = _hashed(words, hashes, len(stats))
                cuts = np.searchsorted(doc, np.arange(len(stats) + 1))
                full = np.column_stack([stats, _meta(part.columns[3:])]) if meta_cols else stats
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([x.tobytes() for x in full], pa.binary()),
                        pa.array([slot[a:b].astype(np.int32).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                        pa.array([value[a:b].astype(np.float32).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                    ],
                    names=["id", "label", "stats", "slots", "counts"],
                )

    features = rows.mapInArrow(run, f"id {kind}, label int, stats binary, slots binary, counts binary")
    got = features.groupBy("id", "label").agg(F.min(F.struct("stats", "slots", "counts")).alias("f")).select("label", "f.*").collect()  # at most 2 * sample rows
    if not got:
        size = 1 << HASH_BITS
        return Machine([], 0.0, np.zeros(size), np.zeros((size, 0)))
    got.sort(key=lambda r: (r.label, r.stats, r.slots))
    stats, label = np.array([np.frombuffer(r.stats) for r in got]), np.array([r.label for r in got])
    sizes = [len(r.slots) // 4 for r in got]
    hashed = np.repeat(np.arange(len(got), dtype=np.int32), sizes), np.frombuffer(b"".join(r.slots for r in got), np.int32), np.frombuffer(b"".join(r.counts for r in got), np.float32)
    del got
    prior = shares.get(1, 0) / sum(shares.values())
    return _fit(stats, hashed, label, prior, epochs, factors)


def scorer(docs: DataFrame, machine: Machine, text_col: str = "text", meta_cols: tuple[str, ...] = ("n_chars",)) -> Column:
    """A column with the score, 0 to 1, of each whole text; null and empty texts are scored too."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.arrow_udf(DoubleType())
    def score(text: pa.Array, *meta: pa.Array) -> pa.Array:
        data, offs = K.text_bytes(text)
        columns, out = _meta(meta), [np.zeros(0)]
        if not len(shared.value.edges):
            return pa.array(np.full(len(text), 0.5))
        for lo, hi in K.slices(len(text), offs, SLICE_BYTES):
            part = columns[lo:hi] if meta else np.zeros((hi - lo, 0))
            out.append(shared.value.score(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], part))
        return pa.array(np.concatenate(out))

    return score(F.col(text_col).cast("string"), *[F.col(c).cast("double") for c in meta_cols])


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = ("n_chars",), **options) -> DataFrame:
    """One row per document row: (id, held_out, score, predicted); predicted is 1 from a score of 0.5 on.

    Null and empty texts are scored from their statistics and metadata, null metadata as a bin of its
    own, long texts whole. Rows that repeat an id are scored each for itself; a null id is not held
    out. Without documents there are no rows, without usable labels every score is 0.5. Columns of
    docs beside the named ones, labels among them, are never looked at, whatever their names.
    """
    machine = fit(docs, labels, id_col, text_col, meta_cols, **options)
    scored = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), scorer(docs, machine, text_col, meta_cols).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def keep_accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = ("n_chars",), **options) -> DataFrame:
    """The rows of docs, with their columns, that the classifier predicts to be of quality 1.

    Nulls, empty and long texts, repeated rows, empty tables and other columns as in classify;
    without usable labels every row stays.
    """
    machine = fit(docs, labels, id_col, text_col, meta_cols, **options)
    return docs.where(scorer(docs, machine, text_col, meta_cols) >= 0.5)
