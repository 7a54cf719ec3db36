"""Deterministic orders of results, and positions in them without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from edgeloom.operators.components import cut

#: What each kind of result is ordered by: text bytewise, cycles by their nodes (a prefix first), components by their smallest node.
ORDERS = {
    "edges": ("source", "target"),
    "projected_edges": ("source_label", "target_label"),
    "evidence": ("source", "target", "external"),
    "nodes": ("label",),
    "paths": ("path",),
    "cycles": ("nodes",),
    "components": ("component", "label"),
    "sections": ("section_kind", "title", "label"),
    "violations": ("sort_key", "heading", "details"),
}


def ordered(rows: DataFrame, kind: str) -> DataFrame:
    """rows sorted as results of that kind are; nulls come first."""
    return rows.orderBy(*ORDERS[kind])


def numbered(rows: DataFrame, *keys: str, name: str = "position") -> DataFrame:
    """rows with their position, from 0, in the order of keys.

    Rows are range-partitioned and sorted; a position is the rows of all partitions before, of which
    there is one count a partition, and the place within. Ties are ordered by all other columns, so
    rows that repeat get neighbouring positions.
    """
    rest = [c for c, t in rows.dtypes if c not in keys and not t.startswith("map")]
    dealt = cut(rows.repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *rest).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    counts = dealt.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"))  # one row a partition
    found = dealt.withColumn("__part", part).join(F.broadcast(before), "__part")
    return found.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at", "__part", "__before")
