"""Embedding near-dedup: binary codes from iterative quantisation, multi-index Hamming tables, exact rerank.

Fitting (on a bounded sample) takes the mean, the principal axes and a rotation that brings the
rotated axes close to signs, so that the bits of a code are balanced. Any rotation gives the same
links; a good one gives even buckets. Coordinates are rounded to steps of ``STEP`` once, when a vector
is entered, and carried as integers, so that every later decision about a pair is the same anywhere.

A code is cut into m substrings, each the key of one table. Two unit vectors with cosine of at least
c lie within r = sqrt(2 - 2c) of each other, so in one of the m substrings the squared distance is at
most r^2 / m, and their midpoint lies within half of that from both. Each vector is therefore entered
under every substring code that it can reach by flipping bits whose squared coordinates sum to at
most r^2 / (4 m): both vectors of a pair then meet in the bucket of their midpoint, with certainty. A
pair that meets more often counts only in the bucket of its midpoint in the first such table. Buckets
are compared a block against a block, with the original vectors in double precision; a block pair
returns counts and a spanning forest, never its pairs. Equal vectors are one entry with a count.

m follows from the rows: fewer tables have longer keys, so smaller buckets, but more entries a vector.
The sample tells how many entries and meetings each m costs, and the rows weigh the two, so that the
share of all pairs that is compared falls as rows are added. Where vectors lie so close together (a
strong common direction) that every m would compare ``MOST_PAIRS`` of all pairs of a label or more,
they are all compared, block against block: that is the upper bound.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from math import floor, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import components, cut

COSINE, BITS, SAMPLE, BLOCK = 0.98, 64, 20_000, 256
#: Numbers of tables to choose from; 0, comparing all vectors of a label, is taken if none of them serves.
TABLES = (2, 3, 4, 5, 6, 8, 11, 16)
MOST_PAIRS = 0.5
STEP = 2.0**-13
#: What entering a vector once costs, in comparisons of two vectors; entries of a vector in a table to count to.
ENTRY_COST, MOST_ENTRIES = 300, 2000


@dataclass
class Codes:
    """Mean and rotated axes; a vector x of another length than theirs takes its own first axes."""

    mean: np.ndarray
    axes: np.ndarray
    bits: int
    tables: int

    def project(self, units: np.ndarray) -> np.ndarray:
        """Coordinates (tables x width) of unit vectors, padded to full substrings."""
        if units.shape[1] == len(self.mean):
            z = (units - self.mean) @ self.axes
        else:
            z = units[:, : self.bits]
        if not self.tables:
            return np.zeros((len(z), 0, 0))
        width = -(-z.shape[1] // self.tables)
        out = np.full((len(z), width * self.tables), 1.0)
        out[:, : z.shape[1]] = z
        return out.reshape(len(z), self.tables, width)

    def steps(self, units: np.ndarray) -> np.ndarray:
        """The coordinates as whole numbers of steps."""
        return np.rint(self.project(units) / STEP).astype(np.int16)

    def bound(self, cosine: float) -> int:
        """The most that the squared steps between two linked vectors sum to in one of the tables."""
        apart = sqrt(2 - 2 * cosine) + STEP * sqrt(max(1, self.bits)) + 1e-6
        return floor(apart**2 / max(1, self.tables) / STEP**2)

    @staticmethod
    def keys(z: np.ndarray) -> np.ndarray:
        return ((z > 0) * (np.int64(1) << np.arange(z.shape[-1], dtype=np.int64))).sum(axis=-1)


def fit_codes(sample: np.ndarray, bits: int = BITS, tables: int = 8, rounds: int = 50) -> Codes:
    """Iterative quantisation on the rows of sample (unit vectors)."""
    mean = sample.mean(axis=0)
    centred = sample - mean
    _, _, axes = np.linalg.svd(centred.T @ centred)
    axes = axes.T[:, : min(bits, sample.shape[1])]
    v = centred @ axes
    rotation, _ = np.linalg.qr(np.random.default_rng(11).normal(size=(v.shape[1], v.shape[1])))
    for _ in range(rounds):
        left, _, right = np.linalg.svd(np.where(v @ rotation > 0, 1.0, -1.0).T @ v)
        rotation = (left @ right).T
    return Codes(mean, axes @ rotation, axes.shape[1], tables)


def _reached(costs: np.ndarray, key: int, bound: int, most: int | None = None) -> list[int]:
    """The codes that flips of summed cost up to bound reach from key (no more than most, if given)."""
    order = np.argsort(costs, kind="stable")
    cost = costs[order].tolist()
    flip = [1 << int(i) for i in order]
    out, open_ = [], [(key, 0, 0)]
    while open_ and (most is None or len(out) < most):
        code, spent, k = open_.pop()
        out.append(code)
        for j in range(k, len(cost)):
            if spent + cost[j] > bound:
                break
            open_.append((code ^ flip[j], spent + cost[j], j + 1))
    return out


def entries(codes: Codes, z: np.ndarray, cosine: float, most: int | None = None):
    """(row, table, code) for each bucket that the rows of z (steps) are entered in, row by row."""
    if not codes.tables:
        yield from ((k, -1, 0) for k in range(len(z)))
        return
    keys, quarter = codes.keys(z), codes.bound(cosine) // 4
    squares = z.astype(np.int64) ** 2
    for k in range(len(z)):
        for t in range(z.shape[1]):
            yield from ((k, t, c) for c in _reached(squares[k, t], int(keys[k, t]), quarter, most))


def choose_tables(sample: np.ndarray, codes: Codes, cosine: float, rows: int, pairs: float, tables=TABLES) -> Codes:
    """codes with the number of tables that costs least for so many rows and pairs of rows of one label."""
    best = None
    few = sample[:: max(1, len(sample) // 300)]
    for m in tables:
        if not m <= codes.bits <= 60 * m:
            continue
        tried = Codes(codes.mean, codes.axes, codes.bits, m)
        made = np.zeros(m)
        for _, t, _ in entries(tried, tried.steps(few), cosine, MOST_ENTRIES):
            made[t] += 1 / len(few)
        keys, n = tried.keys(tried.steps(sample)), len(sample)
        counts = [np.unique(keys[:, t], return_counts=True)[1].astype(float) for t in range(m)]
        meet = sum(e * e * max((c * (c - 1)).sum() / max(1, n * (n - 1)), 2.0 ** -(codes.bits // m)) for e, c in zip(made, counts, strict=True))
        cost = ENTRY_COST * rows * made.sum() + (1 + ENTRY_COST / BLOCK) * pairs * meet
        if made.max() < MOST_ENTRIES / 4 and meet < MOST_PAIRS and (best is None or cost < best[0]):
            best = (cost, tried)
    return best[1] if best else Codes(codes.mean, codes.axes, codes.bits, 0)


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _doubles(blob) -> np.ndarray:
    """A vector's entries in double precision; its first byte tells how wide they are stored."""
    return np.frombuffer(blob, f"<f{blob[0]}", offset=1).astype(np.float64)


def _scaled(x: np.ndarray) -> np.ndarray:
    """x, or where squares of its entries would leave the range of doubles, x times a power of two: the same direction."""
    power = int(np.frexp(np.abs(x).max())[1])
    return x if -400 < power < 400 else np.ldexp(x, -power)


def _clean(docs: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, key, vector): key null where the vector or label cannot link.

    Single-precision columns are carried in single precision, which loses nothing and halves the rows.
    """
    width = 4 if docs.schema[vector_col].dataType.simpleString() == "array<float>" else 8

    def run(batches):
        for batch in batches:
            keys, vectors = [], []
            for label, v in zip(batch.column(1), batch.column(2), strict=True):
                x = None
                if label.is_valid and v.is_valid and v.values.null_count == 0:
                    x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                    x = _scaled(x) if len(x) and np.isfinite(x).all() and np.any(x) else None
                keys.append(None if x is None else hashlib.blake2b(x.tobytes(), digest_size=16).digest())
                vectors.append(None if x is None else bytes([width]) + x.astype(f"<f{width}").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(vectors, pa.binary())], names=["id", "label", "key", "vector"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "id long, label string, key binary, vector binary")


def _fit(classes: DataFrame, cosine: float, sample: int, bits: int, tables: int | None) -> Codes | None:
    dims = classes.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    if dims is None:
        return None
    fraction = min(1.0, sample / dims.n)
    rows = classes.where((F.col("size") == dims["size"]) & (F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < fraction * 1_000_000)).select("vector").collect()
    if not rows:
        return Codes(np.zeros(0), np.zeros((0, 0)), bits, 0 if tables is None else tables)
    units = _units(np.array([_doubles(v) for v in sorted(bytes(r.vector) for r in rows)]))
    codes = fit_codes(units, bits, tables or 0)
    if tables is not None:
        return codes
    labels = classes.groupBy("label", "size").agg(F.count("*").cast("double").alias("n"))
    total = labels.agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("n")).alias("pairs")).first()
    return choose_tables(units, codes, cosine, total.rows, total.pairs)


def _link(cells: DataFrame, codes, cosine: float) -> DataFrame:
    """(id, n, low): links counted in a block pair, and the smallest vector it is connected to there."""

    def run(batches):
        bound = codes.value.bound(cosine)
        for batch in batches:
            ids, counts, lows = [], [], []
            for row in range(batch.num_rows):
                table, code, i, j = (batch.column(c)[row].as_py() for c in range(4))
                m = batch.column(4)[row].values
                doc, many, block = (np.asarray(m.field(f)) for f in (0, 1, 2))
                x = np.array([_doubles(v) for v in m.field(3).to_pylist()])
                one, two = np.flatnonzero(block == i), np.flatnonzero(block == j)
                near = x[one] @ x[two].T / (np.linalg.norm(x[one], axis=1)[:, None] * np.linalg.norm(x[two], axis=1)) >= cosine
                if i == j:
                    near &= np.arange(len(one))[:, None] < np.arange(len(two))
                p, q = np.nonzero(near)
                if not len(p):
                    continue
                p, q = one[p], two[q]
                if table >= 0:
                    z = np.frombuffer(b"".join(m.field(4).to_pylist()), "<i2").reshape(len(doc), codes.value.tables, -1).astype(np.int32)
                    mine = np.zeros(len(p), bool)
                    for a in range(0, len(p), 16384):
                        zp, zq = z[p[a : a + 16384]], z[q[a : a + 16384]]
                        inside = ((zp - zq).astype(np.int64) ** 2).sum(axis=2) <= bound
                        mine[a : a + 16384] = (np.argmax(inside, axis=1) == table) & (codes.value.keys(zp[:, table] + zq[:, table]) == code)
                    p, q = p[mine], q[mine]
                if not len(p):
                    continue
                n = np.bincount(p, many[q], len(doc)) + np.bincount(q, many[p], len(doc))
                label, old = doc.copy(), None
                while old is None or (label != old).any():
                    old = label.copy()
                    np.minimum.at(label, p, old[q])
                    np.minimum.at(label, q, old[p])
                got = np.flatnonzero(n)
                ids.append(doc[got])
                counts.append(n[got].astype(np.int64))
                lows.append(label[got])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in (ids, counts, lows)], names=["id", "n", "low"])

    return cells.mapInArrow(run, "id long, n long, low long")


def near_duplicate_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    *,
    cosine: float = COSINE,
    bits: int = BITS,
    tables: int | None = None,
    sample: int = SAMPLE,
) -> DataFrame:
    """One row per vector: (id, n_links, component_id, kept).

    Vectors link when their labels are equal and not null, their lengths are equal and their cosine
    is at least ``cosine``. Null, empty and zero vectors and those with null or non-finite entries
    link with nothing, neither do rows with a null id; these are kept. n_links counts other rows, so
    a copy counts as often as it is repeated; component_id is the smallest id reachable over links.
    An empty table gives no rows; long vectors are compared whole; other columns are ignored. The
    rotation is fitted, and the number of tables chosen unless it is given, on about ``sample``
    distinct vectors, chosen by hash; neither changes the result.
    """
    spark = vectors.sparkSession
    rows = cut(_clean(vectors, id_col, vector_col, label_col))
    valid = rows.where("key IS NOT NULL AND id IS NOT NULL")
    classes = cut(valid.groupBy("label", "key").agg(F.min("id").alias("id"), F.count("*").alias("many"), F.first("vector").alias("vector")).withColumn("size", F.octet_length("vector")))
    fitted = _fit(classes, cosine, sample, bits, tables)
    if fitted is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    codes = spark.sparkContext.broadcast(fitted)

    def enter(batches):
        def put(batch, z, out):
            at, table, code = (np.array(c, np.int64) for c in zip(*out, strict=True))
            taken = batch.take(pa.array(at))
            own = pa.array([z[k] for k in at.tolist()], pa.binary())
            return pa.RecordBatch.from_arrays([*taken.columns, own, pa.array(table, pa.int32()), pa.array(code)], names=[*batch.schema.names, "z", "tab", "code"])

        for batch in batches:
            for size in np.unique(np.asarray(batch.column(4))).tolist():
                some = np.flatnonzero(np.asarray(batch.column(4)) == size)
                steps = codes.value.steps(_units(np.array([_doubles(batch.column(3)[k].as_py()) for k in some.tolist()])))
                z, out = {k: x.astype("<i2").tobytes() for k, x in zip(some.tolist(), steps, strict=True)}, []
                for r, t, c in entries(codes.value, steps, cosine):
                    out.append((int(some[r]), t, c))
                    if len(out) == 4096:
                        yield put(batch, z, out)
                        out = []
                if out:
                    yield put(batch, z, out)

    bucket = ["label", "size", "tab", "code"]
    light = classes.select("label", "id", "many", "vector", "size").mapInArrow(enter, "label string, id long, many long, vector binary, size int, z binary, tab int, code long")
    entered = cut(light)
    counts = entered.groupBy(*bucket).agg(F.count("*").alias("members")).where("members > 1")
    blocks = entered.join(counts, bucket).withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = blocks.groupBy(*bucket, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).agg(F.collect_list(F.struct("id", "many", "block", "vector", "z")).alias("members"))
    found = cut(_link(cells.select("tab", "code", "i", "j", "members"), codes, cosine))
    codes.destroy()

    links = found.groupBy("id").agg(F.sum("n").alias("n"))
    merged = components(found.select(F.col("id").alias("a"), F.col("low").alias("b")))
    members = valid.select("id", "label", "key").join(classes.select("label", "key", F.col("id").alias("first"), "many"), ["label", "key"])
    own = members.join(links.select(F.col("id").alias("first"), "n"), "first", "left").join(merged, F.col("first") == F.col("node"), "left")
    own = own.select("id", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "first").alias("component_id"))
    rest = rows.where("key IS NULL OR id IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return own.union(rest).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
