"""Whole checks: a rule's violations as text, in words, with the empty guard in every one.

Each takes the edges and gives (kind, sort_key, heading, details); no rows means that the rule holds.
A rule whose subjects are none has the one violation of the empty guard, unless allow_empty is set.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.errors import InvalidOptions
from edgeloom.functions.patterns import Filter, all_of
from edgeloom.operators import layers, metrics, rules, slices, violations
from edgeloom.operators.graph import per_internal_edge
from edgeloom.operators.ordering import ordered
from edgeloom.operators.traversal import LIMIT


def _quoted(selectors) -> str:
    return violations.sentence(selectors, subject="files").removesuffix(" should ")


def have_field(edges: DataFrame, pattern: Filter, selectors=(), should: bool = True, allow_empty: bool = False) -> DataFrame:
    rule = violations.sentence(selectors, should, f'match {pattern.target} "{pattern.source}"')
    found = violations.as_text(rules.have_field(edges, pattern, selectors, should), "matching", rule, "path", {"File": "path"})
    return violations.checked(found, rules.subjects(edges, selectors), "files.match", rule, allow_empty, selectors)


def depend_on_files(edges: DataFrame, subject_selectors=(), object_selectors=(), should: bool = True, allow_empty: bool = False) -> DataFrame:
    rule = violations.sentence(subject_selectors, should, f"{'only ' if should else ''}depend on {_quoted(object_selectors)}")
    found = rules.depend_on_files(edges, subject_selectors, object_selectors, should)
    text = violations.as_text(found, "file_dependency", rule, "source", {"File": "source", "Dependencies": "targets"})
    return violations.checked(text, rules.subjects(edges, subject_selectors), "files.depend_on_files", rule, allow_empty, subject_selectors)


def depend_on_external(edges: DataFrame, filters, subject_selectors=(), categories=rules.DEFAULT_CATEGORIES, should: bool = True, allow_empty: bool = False) -> DataFrame:
    names = " or ".join(f'"{f.source}"' for f in filters)
    rule = violations.sentence(subject_selectors, should, f"{'only ' if should else ''}depend on external modules {names}")
    found = rules.depend_on_external(edges, filters, subject_selectors, categories, should)
    text = violations.as_text(found, "external_dependency", rule, "source", {"File": "source", "Dependencies": "targets"})
    return violations.checked(text, rules.subjects(edges, subject_selectors), "files.depend_on_external", rule, allow_empty, subject_selectors)


def have_no_cycles(edges: DataFrame, selectors=(), limit: int = LIMIT, allow_empty: bool = False) -> DataFrame:
    rule = violations.sentence(selectors, True, "have no cycles")
    found = rules.have_no_cycles(edges, selectors, limit)
    text = violations.as_text(found, "cycle", rule, F.substring_index("path", " -> ", 1), {"Cycle": "path"})
    return violations.checked(text, rules.subjects(edges, selectors), "files.have_no_cycles", rule, allow_empty, selectors)


def adhere_to(files: DataFrame, predicate: Column, description: str, selectors=(), should: bool = True, allow_empty: bool = False) -> DataFrame:
    rule = violations.sentence(selectors, should, f"adhere to {description}")
    found = violations.as_text(rules.adhere_to(files, predicate, description, selectors, should), "custom_file", rule, "path", {"File": "path", "Expected": "description"})
    return violations.checked(found, files.where(all_of(selectors, F.col("path"))), "files.adhere_to", rule, allow_empty, selectors)


def _layer_scopes(stack: list[layers.Layer]) -> Column:
    out = F.lit(None).cast("string")
    for one in stack:
        out = F.when(F.col("layer") == one.name, violations.scope([one.filters])).otherwise(out)
    return out


def adhere_to_layers(edges: DataFrame, stack: list[layers.Layer], policies: list[layers.Policy], strict: bool = False, allow_empty: bool = False) -> DataFrame:
    """The forbidden edges, and the guard for each policy whose source layer owns no file."""
    rule = "layers " + ", ".join(layer.name for layer in stack) + " should hold their policies"
    none = F.lit("<unassigned>")
    found = layers.check_layers(edges, stack, policies, strict)
    details = {"Dependency": F.concat("source", F.lit(" -> "), "target"), "Source layer": F.coalesce("source_layer", none), "Target layer": F.coalesce("target_layer", none), "Policy": F.col("policy")}
    text = violations.as_text(found, "layer_dependency", rule, "source", details)
    if allow_empty:
        return text
    unused = violations.as_text(layers.unused_sources(edges, stack, policies), "empty_test", rule, "layer", {"Rule id": F.concat(F.lit("layers."), "layer"), "Reason": F.lit(violations.NOTHING), "Selectors": _layer_scopes(stack)})
    return text.unionByName(unused)


def contain_dependency(edges: DataFrame, label, source: str, target: str, should: bool = True, allow_empty: bool = False) -> DataFrame:
    rule = violations.sentence((), should, f'contain dependency "{source}" -> "{target}"', "slices")
    found = slices.contain_dependency(edges, label, source, target, should)
    text = violations.as_text(found, "slice_dependency", rule, "source_label", {"Dependency": F.concat("source_label", F.lit(" -> "), "target_label"), "Edges": "count"})
    return violations.checked(text, slices.slice_labels(edges, label), "slices.contain_dependency", rule, allow_empty)


def adhere_to_diagram(edges: DataFrame, label, diagram: str, allow_empty: bool = False, **options) -> DataFrame:
    rule = "slices should adhere to the diagram"
    found = slices.adhere_to_diagram(edges, label, diagram, **options)
    text = violations.as_text(found, "slice_dependency", rule, "source_label", {"Dependency": F.concat("source_label", F.lit(" -> "), "target_label"), "Reason": "rule"})
    return violations.checked(text, slices.slice_labels(per_internal_edge(edges), label), "slices.adhere_to_diagram", rule, allow_empty)


def threshold(measured: DataFrame, metric: str, comparison: str, value: int | float, allow_empty: bool = False) -> DataFrame:
    rule = f"{metric} should be {comparison.replace('_', ' ')} {value}"
    text = violations.as_text(metrics.threshold(measured, metric, comparison, value), "metric", rule, "label", {"Subject": "label", "Expected": F.lit(f"{comparison.replace('_', ' ')} {value}"), "Actual": "measured"})
    return violations.checked(text, measured, f"metrics.{metric}", rule, allow_empty)


def satisfy(measured: DataFrame, predicate: Column, description: str, kind: str = "metric_predicate", allow_empty: bool = False) -> DataFrame:
    rule = f"metrics should satisfy {description}"
    text = violations.as_text(metrics.satisfy(measured, predicate), kind, rule, "label", {"Subject": "label", "Expected": F.lit(description)})
    return violations.checked(text, measured, "metrics.satisfy", rule, allow_empty)


def all_checks(*checks: DataFrame) -> DataFrame:
    """The violations of several checks together, in order; a rule's own error fails the job of all."""
    if not checks:
        raise InvalidOptions("no check is given")
    return ordered(reduce(DataFrame.unionByName, checks), "violations")

