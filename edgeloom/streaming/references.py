"""An extension: edges kept up to date from a stream of references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def streaming_edges(references: DataFrame) -> DataFrame:
    """Edges of a stream of references(source, target, external, kind, class, availability).

    The state is one row per edge; write it in update mode to get each edge that changed.
    """
    return references.groupBy("source", "target").agg(
        F.count("*").alias("references"),
        F.bool_or("external").alias("external"),
        F.bit_or("kind").alias("kinds"),
        F.bit_or("class").alias("classes"),
        F.bit_or("availability").alias("availabilities"),
    )


def watch(references: DataFrame, check, sink, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Run check on the edges that each batch changed; sink gets (violations, batch id).

    check sees these edges alone, so it has to judge row by row, such as a layer policy, a name or an
    external target. Rules that look at other edges too (subjects, cycles, coupling) need the whole
    table: write streaming_edges out and check that.
    """
    return streaming_edges(references).writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(lambda edges, k: sink(check(edges), k)).start()
