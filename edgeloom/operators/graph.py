"""Normalization of references into edges, and projections of edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.functions.patterns import normalize_path

EVIDENCE = ("source", "target", "external", "kinds", "classes", "availabilities")


def normalize(references: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One edge per (source, target) of references(source, target, external, kind, class, availability, location).

    Paths are normalized, masks united, locations sorted and distinct (null ones left out). files(path)
    adds a self-edge each, so that isolated nodes stay. A pair that is both internal and external
    fails the job. One hash aggregation; an empty table gives no edges.
    """
    rows = references.select(normalize_path(F.col("source")).alias("source"), normalize_path(F.col("target")).alias("target"), "external", "kind", "class", "availability", "location")
    if files is not None:
        path = normalize_path(F.col("path"))
        self_edge = [F.lit(False), F.lit(0), F.lit(1), F.lit(1), F.lit(None).cast(references.schema["location"].dataType)]
        rows = rows.unionByName(files.select(path.alias("source"), path.alias("target"), *[c.alias(n) for c, n in zip(self_edge, ("external", "kind", "class", "availability", "location"), strict=True)]))
    merged = rows.groupBy("source", "target").agg(
        F.bool_and("external").alias("every"),
        F.bool_or("external").alias("external"),
        F.bit_or("kind").alias("kinds"),
        F.bit_or("class").alias("classes"),
        F.bit_or("availability").alias("availabilities"),
        F.array_sort(F.collect_set("location")).alias("locations"),
    )
    conflict = F.concat(F.lit("both internal and external: "), "source", F.lit(" -> "), "target")
    checked = F.when(F.col("every") == F.col("external"), F.col("external")).otherwise(F.raise_error(conflict).cast("boolean"))
    return merged.select("source", "target", checked.alias("external"), "kinds", "classes", "availabilities", "locations")


def locations(references: DataFrame) -> DataFrame:
    """(source, target, location): where references stand, each place once, as rows and not as an array of the pair.

    For pairs with more places than a row should hold; normalize without its locations goes with it, since Spark
    leaves out columns that nobody reads. References without a place have no row.
    """
    ends = [normalize_path(F.col(c)).alias(c) for c in ("source", "target")]
    return references.where("location IS NOT NULL").select(*ends, "location").distinct()


def find(edges: DataFrame, source: str, target: str) -> DataFrame:
    return edges.where((F.col("source") == source) & (F.col("target") == target))


def per_edge(edges: DataFrame) -> DataFrame:
    return edges.where("source != target")


def per_internal_edge(edges: DataFrame) -> DataFrame:
    return edges.where("NOT external AND source != target")


def per_external_edge(edges: DataFrame) -> DataFrame:
    return edges.where("external AND source != target")


def _labelled(edges: DataFrame, source_label: Column | str, target_label: Column | str) -> DataFrame:
    source_label, target_label = (F.col(x) if isinstance(x, str) else x for x in (source_label, target_label))
    empty = F.raise_error(F.lit("a label is empty")).cast("string")
    source_label, target_label = (F.when(x == "", empty).otherwise(x) for x in (source_label, target_label))
    return edges.select(source_label.alias("source_label"), target_label.alias("target_label"), *EVIDENCE).dropna(subset=["source_label", "target_label"])


def evidence(edges: DataFrame, source_label: Column | str = "source", target_label: Column | str = "target") -> DataFrame:
    """(source_label, target_label, source, target, external, ...): the edges behind each label pair, as rows.

    Labels are columns: an expression, or a pandas UDF for a caller's own function. A null label
    drops the edge, an empty one fails the job. Rows of a pair are never gathered in one place.
    """
    return _labelled(edges, source_label, target_label)


def project_edges(edges: DataFrame, source_label: Column | str = "source", target_label: Column | str = "target") -> DataFrame:
    """One row per label pair: n_evidence, whether any is external, united masks. evidence() has the edges behind it."""
    return aggregate_edges(edges, source_label, target_label).withColumnRenamed("count", "n_evidence")


def aggregate_edges(edges: DataFrame, source_label: Column | str = "source", target_label: Column | str = "target") -> DataFrame:
    """Edge count, externality and united masks of each label pair; a null label drops the edge, an empty one fails the job."""
    return _labelled(edges, source_label, target_label).groupBy("source_label", "target_label").agg(
        F.count("*").alias("count"),
        F.bool_or("external").alias("external"),
        F.bit_or("kinds").alias("kinds"),
        F.bit_or("classes").alias("classes"),
        F.bit_or("availabilities").alias("availabilities"),
    )


def nodes(edges: DataFrame, include_external: bool = False) -> DataFrame:
    """(label): all sources and internal targets, external ones on request."""
    targets = edges if include_external else edges.where("NOT external")
    return edges.select(F.col("source").alias("label")).union(targets.select(F.col("target").alias("label"))).distinct()


def project_nodes(edges: DataFrame, include_external: bool = False) -> DataFrame:
    """(label, n_incoming, n_outgoing, n_outgoing_external) of each node; self-edges are no evidence."""
    plain = per_edge(edges)
    ends = plain.select(F.col("source").alias("label"), F.lit(0).alias("i"), F.lit(1).alias("o"), F.col("external").cast("int").alias("x"))
    ends = ends.union((plain if include_external else plain.where("NOT external")).select(F.col("target").alias("label"), F.lit(1), F.lit(0), F.lit(0)))
    ends = ends.union(edges.where("source = target").select(F.col("source").alias("label"), F.lit(0), F.lit(0), F.lit(0)))
    return ends.groupBy("label").agg(F.sum("i").alias("n_incoming"), F.sum("o").alias("n_outgoing"), F.sum("x").alias("n_outgoing_external"))
