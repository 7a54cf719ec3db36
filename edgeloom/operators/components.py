"""Reliable checkpoints in the shared folder, and connected components."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.errors import InvalidOptions


#: Rows of a table of two longs up to which it is broadcast (some 8 MB).
SMALL = 1 << 18


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only where that is unset, and in local mode, one is made here.

    On a cluster a folder of the driver's own machine would be invisible to executors, so there an
    unset folder is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise InvalidOptions("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", at)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(df: DataFrame) -> DataFrame:
    """cut for loops: what is estimated of df goes too, and it has no more partitions than a shuffle.

    A checkpoint keeps the estimated size of its plan, a join's being the product of its sides', so that in a
    loop the estimate has twice the digits after each round; and unions and broadcast joins double the partitions.
    """
    return kept(df.coalesce(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def kept(df: DataFrame) -> DataFrame:
    """settled with the partitions of df, for edges: a task that makes several of many partitions holds the sorts of all."""
    spark = df.sparkSession
    rows = cut(df)._jdf
    return type(df)(spark._jsparkSession.createDataFrame(rows.toJavaRDD(), rows.schema()), spark)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of links(a, b): rows (node, component), component the smallest node.

    Nodes without links are not listed. Alternates large-star and small-star steps on edges that
    point from a larger to a smaller node, each one partial aggregation and one equi-join, until an
    order-free checksum no longer changes. Every round is checkpointed, so lineage stays short and
    no link table reaches the driver. The minima that a step joins are broadcast while the edges are
    counted to be few; beyond that they are checkpointed first, so that a star's many edges meet them
    in a plain sort-merge join, which adaptive execution splits. Links with a null end and self-links
    count for nothing.
    """
    a_, b_ = F.col(a), F.col(b)
    edges = cut(links.where(a_ != b_).select(F.greatest(a_, b_).alias("v"), F.least(a_, b_).alias("u")).distinct())
    checksum = F.count("*").alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)")).alias("h")
    state = edges.agg(*checksum).first()

    def least(pairs):
        low = pairs.groupBy(F.col("v").alias("k")).agg(F.min("u").alias("m"))
        return F.broadcast(low) if state.n <= SMALL else cut(low)

    while state.n:
        low = least(edges)
        large = cut(edges.join(low, F.col("u") == F.col("k"), "left").select("v", F.coalesce("m", "u").alias("u")).distinct())
        low = least(large)
        rest = large.join(low, F.col("v") == F.col("k")).select("v", "u", "m")
        # (v, u) becomes (v, m), and (u, m) where u is not m itself: one pass, no second look at the minima
        both = F.explode(F.array(F.struct(F.col("v"), F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u"))))
        edges = cut(rest.select(both.alias("e")).select("e.v", "e.u").where("v != u").distinct())
        before, state = state, edges.agg(*checksum).first()
        if before == state:
            break
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).union(
        edges.select(F.col("u").alias("node"), F.col("u").alias("component"))
    ).distinct()
