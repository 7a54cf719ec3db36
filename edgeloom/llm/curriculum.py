"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time 0..1 (piecewise linear, drawn in turn from
``SCHEDULES`` in source order). Its integral, scaled to the source's target, is the source's
cumulative token demand. A source's documents stand in a fixed hashed order, repeated ``repeats``
times; the running count of their words is cut at the target, and inverting the demand at a
document's midpoint gives its training position. Sorting by position by range gives the order.

Running counts need no task that sees a whole source: documents fall into hash buckets, buckets have
totals, and only totals (sources x buckets rows) are summed over a source. The order comes from the
hash alone, so the number of buckets changes nothing in the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from edgeloom.llm import textkernels as K
from edgeloom.llm.common import small_batches

WEIGHTS = (5, 2, 1)
SHARE, REPEATS = 1.5, 2
#: (time, weight) knots: even, rising, falling.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.2), (0.5, 1.0), (1.0, 1.8)), ((0.0, 1.8), (0.5, 1.0), (1.0, 0.2)))
DOCS_PER_BUCKET = 20_000


@F.arrow_udf(LongType())
def word_count(text: pa.Array) -> pa.Array:
    """Number of words between white space; 0 for null."""
    data, offs = K.text_bytes(text)
    return pa.array(np.diff(K.find_words(data, offs, K.SPACE_SEPARATED).doc).astype(np.int64))


def targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """totals(source, source_size) with rank, weight and target.

    share of all words is dealt by weight; a target stops at repeats times its source, the excess
    going to the others by weight. That is one common level l with sum(min(cap, l * weight)) = all,
    found from the sources in order of cap / weight. One row a source passes the global windows.
    """
    n = len(weights)
    ranked = totals.select("source", "source_size", (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1).alias("rank"))
    ranked = ranked.select("*", F.array(*[F.lit(float(w)) for w in weights])[(F.col("rank") % n).cast("int")].alias("weight"), (F.col("source_size") * F.lit(float(repeats))).alias("cap"))
    by = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    level = (
        F.lit(share) * F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    ) / F.sum("weight").over(by.rowsBetween(W.currentRow, W.unboundedFollowing))
    ranked = ranked.select("*", level.alias("level"))
    found = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct((F.col("cap") / F.col("weight")).alias("r"), "rank", "level"))).over(W.partitionBy())["level"]
    return ranked.select("source", "source_size", "rank", "weight", F.coalesce(F.least("cap", found * F.col("weight")), "cap").alias("target"))


def demand_inverse(share: Column, rank: Column, schedules=SCHEDULES) -> Column:
    """The time by which a source of that rank has met the share of its whole demand."""
    out = F.lit(None).cast("double")
    for k, knots in enumerate(schedules):
        t, w = (np.array(x, float) for x in zip(*knots, strict=True))
        cumulative = np.concatenate(([0.0], np.cumsum(np.diff(t) * (w[1:] + w[:-1]) / 2)))
        inverse = F.lit(float(t[-1]))
        for a in reversed(range(len(t) - 1)):
            rest = share * F.lit(float(cumulative[-1])) - F.lit(float(cumulative[a]))
            slope = float((w[a + 1] - w[a]) / (t[a + 1] - t[a]))
            root = F.sqrt(F.greatest(F.lit(0.0), F.lit(float(w[a] ** 2)) + F.lit(2 * slope) * rest))
            within = F.lit(float(t[a])) + F.lit(2.0) * rest / (F.lit(float(w[a])) + root)
            inverse = F.when(share * F.lit(float(cumulative[-1])) < F.lit(float(cumulative[a + 1])), within).otherwise(inverse)
        out = F.when(rank % len(schedules) == k, inverse).otherwise(out)
    return out


def _planned(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, share, repeats, schedules, carry: list[Column], ties: list[str] | None = None) -> DataFrame:
    """(carry..., size, source_size, target, positions): one position for each time that a document is taken.

    ties are columns that order rows of one id and size, by a hash of all and then as they are.
    """
    small_batches(docs.sparkSession)
    n_docs = docs.count()
    buckets = 1 << max(6, int(n_docs // DOCS_PER_BUCKET).bit_length())
    tie = F.xxhash64(*ties) if ties else None
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = docs.select(
        F.struct(*carry).alias("carry"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("name"),
        F.col(source_col).isNull().alias("unnamed"),
        word_count(F.col(text_col).cast("string")).alias("size"),
        key.alias("key"),
        *([tie.alias("tie")] if ties else []),
    ).withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(1 << 32)).cast("int"))
    at = ["name", "unnamed", "bucket"]
    totals = rows.groupBy(*at).agg(F.sum("size").alias("bucket_size"))
    sources = totals.groupBy("name", "unnamed").agg(F.sum("bucket_size").alias("source_size"))
    goals = targets(sources.select(F.when(~F.col("unnamed"), F.col("name")).alias("source"), "source_size"), weights, share, repeats)
    goals = goals.select(F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("unnamed"), "source_size", "rank", "target")
    before = F.sum("bucket_size").over(W.partitionBy("name", "unnamed").orderBy("bucket")) - F.col("bucket_size")
    offsets = totals.select(*at, before.alias("before")).join(goals, ["name", "unnamed"])
    order = ["key", "size", *(["tie", *[F.col("carry")[c] for c in ties]] if ties else [])]
    inside = W.partitionBy(*at).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    placed = rows.join(offsets, at).withColumn("middle", start + F.col("size") / 2)
    times = [F.col("middle") + F.lit(k) * F.col("source_size") for k in range(repeats)]
    taken = [F.when((F.col("size") > 0) & (x <= F.col("target")), demand_inverse(x / F.nullif(F.col("target"), F.lit(0.0)), F.col("rank"), schedules)) for x in times]
    return placed.select("carry", "size", "source_size", "target", *(["tie"] if ties else []), F.array_compact(F.array(*taken)).alias("positions"))


def mixing_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, schedules=SCHEDULES) -> DataFrame:
    """One row per document row: (id, size, source_size, target, positions), sorted by first position by range.

    positions has one entry in 0..1 for each time that the mix takes the document, so the words
    taken are size(positions) * size. A source's words come within half a document of its target.
    Documents without words (null, empty, blank) are never taken, and come last with those not
    needed. A null source is a source of its own, last in order. Rows that repeat an id count each,
    in order of size; a null id is hashed as an empty string.
    """
    out = _planned(docs, id_col, text_col, source_col, weights, share, repeats, schedules, [F.col(id_col).alias("id")])
    plan = out.select(F.col("carry.id").alias(id_col), "size", "source_size", "target", "positions")
    first = F.coalesce(F.get("positions", F.lit(0)), F.lit(2.0))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return plan.repartitionByRange(n, first, F.col(id_col)).sortWithinPartitions(first, F.col(id_col))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, schedules=SCHEDULES) -> DataFrame:
    """The training order itself: the rows of docs, each as often as it is taken, range-sorted by position.

    Null, empty and blank texts are never taken, long ones whole or not at all; a null source, null
    ids and rows that repeat an id as in mixing_plan, but that rows of one id (or none) and size stand in the order
    of a hash of the whole row: however the table is dealt out, the same rows are taken. Ties in
    position stand in order of id. An empty table stays empty. All columns are carried, whatever their names;
    columns of maps, which have no order, do not order rows.
    """
    ties = [c for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    out = _planned(docs, id_col, text_col, source_col, weights, share, repeats, schedules, [F.col(c) for c in docs.columns], ties)
    rows = out.select("carry", "tie", F.explode("positions").alias("position"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "position").sortWithinPartitions("position", F.col("carry")[id_col], "tie")
    return ordered.select("carry.*")
