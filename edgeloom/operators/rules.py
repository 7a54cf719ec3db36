"""File rules: each check is a lazy DataFrame of violations; no rows means that the rule holds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.functions.patterns import Filter, all_of, any_of, normalize_path
from edgeloom.model import AVAILABILITIES, CATEGORIES, CLASSES, KINDS, bit
from edgeloom.operators.components import kept
from edgeloom.operators.graph import per_external_edge, per_internal_edge
from edgeloom.operators.traversal import LIMIT, cycles

DEFAULT_CATEGORIES = ("package_module", "unresolved_module", "unavailable_module")


def subjects(edges: DataFrame, selectors=(), files: DataFrame | None = None) -> DataFrame:
    """(path) of internal self-edges that all selector calls match.

    files(path), where it is at hand, is the same rows without a look at the references: every file
    has a self-edge, and no other node.
    """
    if files is not None:
        path = normalize_path(F.col("path"))
        return files.where(all_of(selectors, path)).select(path.alias("path")).distinct()
    return edges.where((~F.col("external")) & (F.col("source") == F.col("target")) & all_of(selectors, F.col("source"))).select(F.col("source").alias("path"))


def objects(edges: DataFrame, selectors=()) -> DataFrame:
    """(path) of internal targets, with or without a self-edge."""
    return edges.where((~F.col("external")) & all_of(selectors, F.col("target"))).select(F.col("target").alias("path")).distinct()


def empty_guard(selected: DataFrame, rule_id: str, negated: bool = False, allow_empty: bool = False) -> DataFrame:
    """One row (rule_id, is_negated) if nothing is selected, unless that is allowed."""
    none = selected.agg(F.count("*").alias("n")).where("n = 0" if not allow_empty else "false")
    return none.select(F.lit(rule_id).alias("rule_id"), F.lit(negated).alias("is_negated"))


def have_field(edges: DataFrame, pattern: Filter, selectors=(), should: bool = True, files: DataFrame | None = None) -> DataFrame:
    """(path) of subjects whose field does not match (should) or does (should not)."""
    holds = pattern.matches(F.col("path"))
    return subjects(edges, selectors, files).where(~holds if should else holds)


def _grouped(edges: DataFrame) -> DataFrame:
    return edges.groupBy("source").agg(F.count("*").alias("n_edges"), F.array_join(F.array_sort(F.collect_set("target")), "|").alias("targets"))


def file_dependencies(edges: DataFrame, subject_selectors=(), object_selectors=(), should: bool = True, files: DataFrame | None = None) -> DataFrame:
    """The edges that depend_on_files gathers by source, as rows: for sources with more targets than a row should hold."""
    of_subjects = per_internal_edge(edges).join(subjects(edges, subject_selectors, files).select(F.col("path").alias("source")), "source", "left_semi")
    allowed = objects(edges, object_selectors).select(F.col("path").alias("target"))
    return of_subjects.join(allowed, "target", "left_anti" if should else "left_semi")


def depend_on_files(edges: DataFrame, subject_selectors=(), object_selectors=(), should: bool = True, files: DataFrame | None = None) -> DataFrame:
    """(source, n_edges, targets): direct internal edges outside the objects (should) or into them (should not)."""
    return _grouped(file_dependencies(edges, subject_selectors, object_selectors, should, files))


def category(edge_kinds: Column, edge_classes: Column, availabilities: Column) -> Column:
    """Mask of the external categories that a raw edge falls into."""
    has = lambda mask, value: mask.bitwiseAND(value) != 0
    in_category = lambda name: F.lit(bit(CATEGORIES, name))
    none = F.lit(0)
    compiler = F.when(has(edge_classes, bit(CLASSES, "compiler")), in_category("compiler_module")).otherwise(none)
    header = F.when(has(edge_classes, bit(CLASSES, "c_header")), in_category("c_header")).otherwise(none)
    resource = F.when(has(edge_classes, bit(CLASSES, "resource")), in_category("resource")).otherwise(none)
    named = has(edge_kinds, bit(KINDS, "named_module")) & has(edge_classes, bit(CLASSES, "external"))
    package = F.when(named & has(availabilities, bit(AVAILABILITIES, "resolved")), in_category("package_module")).otherwise(none)
    unresolved = F.when(named & has(availabilities, bit(AVAILABILITIES, "unresolved")), in_category("unresolved_module")).otherwise(none)
    away = F.when(named & has(availabilities, bit(AVAILABILITIES, "missing", "outside_project")), in_category("unavailable_module")).otherwise(none)
    return compiler.bitwiseOR(header).bitwiseOR(resource).bitwiseOR(package).bitwiseOR(unresolved).bitwiseOR(away)


def external_candidates(edges: DataFrame, subject_selectors=(), categories=DEFAULT_CATEGORIES, files: DataFrame | None = None) -> DataFrame:
    """External edges of the subjects within the enabled categories, with their category mask."""
    of_subjects = per_external_edge(edges).join(subjects(edges, subject_selectors, files).select(F.col("path").alias("source")), "source", "left_semi")
    found = of_subjects.withColumn("category", category(F.col("kinds"), F.col("classes"), F.col("availabilities")))
    return found.where(F.col("category").bitwiseAND(bit(CATEGORIES, *categories)) != 0)


def external_dependencies(edges: DataFrame, filters, subject_selectors=(), categories=DEFAULT_CATEGORIES, should: bool = True, files: DataFrame | None = None) -> DataFrame:
    """The edges that depend_on_external gathers by source, as rows."""
    holds = any_of(filters, F.col("target"))
    return external_candidates(edges, subject_selectors, categories, files).where(~holds if should else holds)


def depend_on_external(edges: DataFrame, filters, subject_selectors=(), categories=DEFAULT_CATEGORIES, should: bool = True, files: DataFrame | None = None) -> DataFrame:
    """(source, n_edges, targets): external edges outside the filters (should) or within (should not)."""
    return _grouped(external_dependencies(edges, filters, subject_selectors, categories, should, files))


def have_no_cycles(edges: DataFrame, selectors=(), limit: int = LIMIT) -> DataFrame:
    """(length, path) of each elementary cycle among the selected files, edges between them only.

    A strong component with more than limit cycles, of whatever size, has one short cycle as a witness instead.
    """
    ends = all_of(selectors, F.col("source")) & all_of(selectors, F.col("target"))
    rows = kept(edges.where(~F.col("external") & ends).select("source", "target", "external"))  # normalized once; what no selector matches is no subject
    chosen = subjects(rows)
    inside = per_internal_edge(rows).join(chosen.select(F.col("path").alias("source")), "source", "left_semi").join(chosen.select(F.col("path").alias("target")), "target", "left_semi")
    return cycles(inside, limit, beyond="witness")


def adhere_to(files: DataFrame, predicate: Column | Callable[[DataFrame], Column], description: str, selectors=(), should: bool = True) -> DataFrame:
    """files(path, ...) that a predicate column (built in, or a pandas UDF's) rejects; its errors fail the job.

    Mark a UDF nondeterministic and materialize the result if it must see each file only once.
    """
    holds = predicate(files) if callable(predicate) else predicate
    chosen = files.where(all_of(selectors, F.col("path")))
    return chosen.where(~holds if should else holds).withColumn("description", F.lit(description))


def all_violations(checks: dict[str, DataFrame]) -> DataFrame:
    """(rule, violation as JSON) of several checks together."""
    out = None
    for name, rows in checks.items():
        part = rows.select(F.lit(name).alias("rule"), F.to_json(F.struct(*rows.columns)).alias("violation"))
        out = part if out is None else out.union(part)
    if out is None:
        raise ValueError("no check is given")
    return out
