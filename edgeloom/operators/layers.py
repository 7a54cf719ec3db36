"""Ordered layers and the policies between them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.errors import InvalidLayer
from edgeloom.functions.patterns import Filter, any_of
from edgeloom.operators.graph import nodes, per_internal_edge
from edgeloom.operators.selection import first_match


@dataclass(frozen=True)
class Layer:
    name: str
    filters: tuple[Filter, ...]


@dataclass(frozen=True)
class Policy:
    """Layers that source may only (allow) or may not (block) depend on."""

    source: str
    targets: tuple[str, ...]
    allow: bool = True


def validate(layers: list[Layer], policies: list[Policy]) -> None:
    names = [layer.name for layer in layers]
    if any(not n.strip() for n in names) or len(set(names)) != len(names):
        raise InvalidLayer("layer names must be given and differ")
    if any(not layer.filters for layer in layers):
        raise InvalidLayer("a layer needs a selector")
    if len({(p.source, p.allow) for p in policies}) != len(policies):
        raise InvalidLayer("a layer has one policy of a kind")
    for p in policies:
        if {p.source, *p.targets} - set(names) or len(set(p.targets)) != len(p.targets):
            raise InvalidLayer(f"unknown or repeated layer in the policy of {p.source!r}")
        if not p.allow and not p.targets:
            raise InvalidLayer("an empty blocklist forbids nothing")


def layer_of(layers: list[Layer], path: Column) -> Column:
    """The first layer, in order, that selects the path; null for none, and without layers."""
    out = F.lit(None).cast("string")
    for layer in reversed(layers):
        out = F.when(any_of(layer.filters, path), layer.name).otherwise(out)
    return out


def assign(edges: DataFrame, layers: list[Layer]) -> DataFrame:
    """(label, layer) of each internal node."""
    return nodes(edges).withColumn("layer", layer_of(layers, F.col("label")))


def assign_many(edges: DataFrame, layers: list[Layer]) -> DataFrame:
    """The rows of assign, for layers of so many patterns that a path should meet only those that can match."""
    flat = [(layer.name, f) for layer in layers for f in layer.filters]
    names = edges.sparkSession.createDataFrame([(k, name) for k, (name, _) in enumerate(flat)], "number int, layer string")
    owned = nodes(edges)
    found = first_match(owned, [f for _, f in flat], "label").join(names, "number").select(F.col("path").alias("label"), "layer")
    return owned.join(found, "label", "left")


def forbidden(policies: list[Policy], strict: bool, source_layer: Column, target_layer: Column) -> Column:
    """The policy that an internal edge between these layers breaks; null if it may stand."""
    found = F.lit(None).cast("string")
    for p in sorted(policies, key=lambda p: not p.allow):
        within = target_layer.isin(*p.targets) if p.targets else F.lit(False)
        bad = (source_layer == p.source) & (target_layer != p.source) & (~within if p.allow else within)
        found = F.when(bad, "may_only_depend_on_layers" if p.allow else "may_not_depend_on_layers").otherwise(found)
    return F.when(source_layer.isNull() | target_layer.isNull(), "unassigned_endpoint").otherwise(found) if strict else found


def check_layers(edges: DataFrame, layers: list[Layer], policies: list[Policy], strict: bool = False) -> DataFrame:
    """(source, target, source_layer, target_layer, policy) of internal edges that a policy forbids.

    Edges within a layer pass, a blocklist is asked before an allowlist, and an empty allowlist seals
    its layer. strict adds edges with an end in no layer. Each end's layer is found once, before any
    use of it, so a filter on the policy does not repeat the patterns; edges are never shuffled.
    """
    validate(layers, policies)
    ends = per_internal_edge(edges).select("source", "target", F.array(layer_of(layers, F.col("source")), layer_of(layers, F.col("target"))).alias("ends"))
    # exploding a single row keeps the optimizer from copying the patterns into each use of a layer
    placed = ends.select("source", "target", F.explode(F.array("ends")).alias("ends")).select("source", "target", F.col("ends")[0].alias("source_layer"), F.col("ends")[1].alias("target_layer"))
    return placed.withColumn("policy", forbidden(policies, strict, F.col("source_layer"), F.col("target_layer"))).where("policy IS NOT NULL")


def unused_sources(edges: DataFrame, layers: list[Layer], policies: list[Policy]) -> DataFrame:
    """(layer) of each policy whose source layer owns no node; these add to the other violations."""
    validate(layers, policies)
    owned = assign(edges, layers).where("layer IS NOT NULL").select("layer").distinct()
    names = sorted({p.source for p in policies})
    return edges.sparkSession.createDataFrame([(n,) for n in names], "layer string").join(owned, "layer", "left_anti")
