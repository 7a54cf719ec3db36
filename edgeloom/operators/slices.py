"""Slices of the graph, required and forbidden slice edges, and diagrams."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.errors import InvalidDiagram, InvalidPattern
from edgeloom.functions.patterns import check_regex, glob_regex, stem


def by_pattern(path: Column, pattern: str) -> Column:
    """The segment at the pattern's one (**), the rest of the pattern being a prefix; null without it."""
    if pattern.count("(**)") != 1:
        raise InvalidPattern(f"one (**) is needed: {pattern!r}")
    before, after = pattern.split("(**)")
    inner = lambda g: glob_regex(g).removeprefix("(?sd)^").removesuffix(r"\z") if g else ""
    return F.nullif(F.regexp_extract(path, f"(?sd)^{inner(before)}([^/]+){inner(after)}.*\\z", 1), F.lit(""))


def by_regex(path: Column, source: str) -> Column:
    """The first group of a partial match; null if there is none or it is empty."""
    if re.compile(source).groups < 1:
        raise InvalidPattern(f"a group is needed: {source!r}")
    return F.nullif(F.regexp_extract(path, check_regex(source), 1), F.lit(""))


def by_suffix(path: Column, suffixes: dict[str, str]) -> Column:
    """The slice whose suffix ends the file's stem; the longest wins, then the first declared."""
    if not suffixes or "" in suffixes:
        raise InvalidPattern("suffixes must be given and not empty")
    out = F.lit(None).cast("string")
    order = sorted(enumerate(suffixes.items()), key=lambda x: (-len(x[1][0]), x[0]))
    for _, (suffix, name) in reversed(order):
        out = F.when(F.endswith(stem(path), F.lit(suffix)), name).otherwise(out)
    return out


def slice_edges(edges: DataFrame, label, keep: Column | None = None) -> DataFrame:
    """(source_label, target_label, count, external) under label(column).

    An end without a slice drops the edge; an external target keeps its name; only internal edges
    within a slice go. keep filters internal paths (a column over source and target) first.
    """
    rows = edges if keep is None else edges.where(keep)
    mapped = rows.select(label(F.col("source")).alias("source_label"), F.when(F.col("external"), F.col("target")).otherwise(label(F.col("target"))).alias("target_label"), "external")
    mapped = mapped.where("source_label IS NOT NULL AND target_label IS NOT NULL AND (external OR source_label != target_label)")
    return mapped.groupBy("source_label", "target_label").agg(F.count("*").alias("count"), F.bool_and("external").alias("external"))


def slice_labels(edges: DataFrame, label) -> DataFrame:
    """(label) of all internal ends."""
    ends = edges.select(label(F.col("source")).alias("label")).union(edges.where("NOT external").select(label(F.col("target")).alias("label")))
    return ends.where("label IS NOT NULL").distinct()


def contain_dependency(edges: DataFrame, label, source: str, target: str, should: bool = True) -> DataFrame:
    """One row (source_label, target_label, count): the missing edge with count 0, or the forbidden one."""
    found = slice_edges(edges, label).where((F.col("source_label") == source) & (F.col("target_label") == target))
    total = found.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("count"))
    return total.where("count = 0" if should else "count > 0").select(F.lit(source).alias("source_label"), F.lit(target).alias("target_label"), "count")


_COMPONENT = re.compile(r"component\s+\[([^\]]+)\](?:\s+as\s+(\w+))?$|component\s+(\w+)$|\[([^\]]+)\](?:\s+as\s+(\w+))?$")
_ARROW = re.compile(r"(\[[^\]]+\]|\w+)\s*-+>\s*(\[[^\]]+\]|\w+)(?:\s*:.*)?$")


def parse_diagram(text: str) -> tuple[list[str], list[tuple[str, str]]]:
    """(components, edges) of a component diagram, both sorted and distinct."""
    names: dict[str, str] = {}
    arrows, inside, closed = [], False, False
    for number, raw in enumerate(text.splitlines(), 1):
        line = raw.strip()
        if not line or line.startswith(("'", "//")):
            continue
        if line == "@startuml":
            inside = True
        elif line == "@enduml":
            closed = True
        elif not inside or closed:
            raise InvalidDiagram(f"line {number} stands outside of the diagram")
        elif m := _COMPONENT.match(line):
            name = m[1] or m[3] or m[4]
            names[name] = name
            if alias := m[2] or m[5]:
                names[alias] = name
        elif m := _ARROW.match(line):
            arrows.append((number, m[1], m[2]))
        else:
            raise InvalidDiagram(f"line {number} is not understood: {line!r}")
    if not (inside and closed):
        raise InvalidDiagram("@startuml and @enduml are needed")
    edges = set()
    for number, a, b in arrows:
        ends = []
        for end in (a, b):
            name = end.strip("[]")
            if name not in names and not end.startswith("["):
                raise InvalidDiagram(f"line {number} names an unknown component {name!r}")
            ends.append(names.setdefault(name, name))
        edges.add(tuple(ends))
    return sorted(set(names.values())), sorted(edges)


def render_diagram(components: list[str], edges: list[tuple[str, str]]) -> str:
    lines = [f"component [{c}]" for c in components] + [f"[{a}] --> [{b}]" for a, b in edges]
    return "\n".join(["@startuml", *lines, "@enduml", ""])


def adhere_to_diagram(edges: DataFrame, label, diagram: str, ignore_orphan: bool = False, ignore_external: bool = False) -> DataFrame:
    """(source_label, target_label, rule): edges beyond the diagram (unexpected) and absent ones (missing).

    One full outer join of the slice edges with the diagram's. ignore_external leaves out purely
    external edges, on the diagram's side those to names that are no slice; ignore_orphan leaves out
    edges with an end that the diagram does not know.
    """
    components, wanted = parse_diagram(diagram)
    spark = edges.sparkSession
    expected = spark.createDataFrame([(a, b, True) for a, b in wanted], "source_label string, target_label string, expected boolean")
    labels = slice_labels(edges, label).select(F.col("label").alias("target_label"), F.lit(True).alias("internal"))
    actual = slice_edges(edges, label).select("source_label", "target_label", "external", F.lit(True).alias("actual"))
    both = actual.join(expected, ["source_label", "target_label"], "full").join(labels, "target_label", "left")
    known = F.col("source_label").isin(*components) & F.col("target_label").isin(*components) if components else F.lit(False)
    unexpected = F.col("expected").isNull()
    if ignore_external:
        unexpected = unexpected & ~F.col("external")
    if ignore_orphan:
        unexpected = unexpected & known
    absent = F.col("actual").isNull()
    if ignore_external:
        absent = (absent | F.col("external")) & F.col("internal").isNotNull()
    rule = F.when(F.col("actual").isNotNull() & unexpected, "unexpected").when(F.col("expected").isNotNull() & absent, "missing")
    return both.select("source_label", "target_label", rule.alias("rule")).where("rule IS NOT NULL")


def diagram_of(edges: DataFrame, label) -> str:
    """The diagram of the internal slice edges; slices are few."""
    found = slice_edges(edges, label).where("NOT external").select("source_label", "target_label").collect()
    names = slice_labels(edges, label).collect()
    return render_diagram(sorted(r.label for r in names), sorted((r.source_label, r.target_label) for r in found))

