"""Spark helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from edgeloom.operators.components import components as components
from edgeloom.operators.components import cut as cut
from edgeloom.operators.components import shared_folder as shared_folder


def unique_name(stem: str) -> str:
    return f"{stem}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bound what one Arrow batch of documents may hold, by rows and where Spark can by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def partitions_for(spark: SparkSession, n_bytes: float, per_partition: float) -> int:
    """Enough partitions for so many bytes each, never fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(n_bytes // per_partition) + 1)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that Spark uses for it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
