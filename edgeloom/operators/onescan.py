"""Row-wise checks in one scan of the edges: violations and empty guards of all rules from one aggregation.

Each edge gives the violations that it is by itself and, for all rules together, one mask of the rules whose
subjects it shows. Masks are or-ed before the shuffle, so what is shuffled is violations, and a guard that no
edge met becomes its violation where the masks end up. The edges have to be normalized: every file has its
self-edge, which is what makes a rule about dependencies one about rows. Rules that need other files' edges
(cycles, diagrams, metrics) stay in ``checks``.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.errors import InvalidOptions
from edgeloom.functions.patterns import Filter, all_of, any_of
from edgeloom.model import CATEGORIES, bit
from edgeloom.operators import layers as L
from edgeloom.operators import rules, violations
from edgeloom.operators.ordering import ordered

#: Guards of one mask.
_BITS = 62
_NUMBERS = itertools.count()


@dataclass(frozen=True)
class Guard:
    """A violation that stands unless some edge is seen for which the column holds."""

    seen: Column
    kind: str
    sort_key: str
    details: str


@dataclass(frozen=True)
class RowRule:
    """Which edges are violations, the key that they are counted by, and their lines of text.

    text takes the number of edges of a key and their distinct items, sorted and joined by |; without it
    each edge is a violation of its own with the lines in detail. shared columns are found once an edge;
    their names have to differ from all other rules'.
    """

    kind: str
    rule: str
    found: Column
    key: Column
    detail: Column | None = None
    item: Column | None = None
    text: Callable[[Column, Column, Column], Column] | None = None
    guards: tuple[Guard, ...] = ()
    shared: dict[str, Column] = field(default_factory=dict)


def _names(*stems: str) -> list[str]:
    """Column names that no other rule has."""
    n = next(_NUMBERS)
    return [f"{stem}_{n}" for stem in stems]


def _internal() -> Column:
    return (~F.col("external")) & (F.col("source") != F.col("target"))


def _lines(**named) -> Column:
    return F.concat_ws("\n", *[F.concat(F.lit(name.replace("_", " ") + ": "), value.cast("string")) for name, value in named.items()])


def _subjects(selectors, rule_id: str, rule: str, allow_empty: bool) -> tuple[Guard, ...]:
    if allow_empty:
        return ()
    seen = (~F.col("external")) & (F.col("source") == F.col("target")) & all_of(selectors, F.col("source"))
    return (Guard(seen, "empty_test", rule_id, violations.empty_details(rule_id, rule, selectors)),)


def have_field(pattern: Filter, selectors=(), should: bool = True, allow_empty: bool = False) -> RowRule:
    rule = violations.sentence(selectors, should, f'match {pattern.target} "{pattern.source}"')
    holds = pattern.matches(F.col("source"))
    found = (~F.col("external")) & (F.col("source") == F.col("target")) & all_of(selectors, F.col("source")) & (~holds if should else holds)
    return RowRule("matching", rule, found, F.col("source"), _lines(File=F.col("source")), guards=_subjects(selectors, "files.match", rule, allow_empty))


def _by_source(kind: str, rule: str, found: Column, guards: tuple[Guard, ...]) -> RowRule:
    return RowRule(kind, rule, found, F.col("source"), item=F.col("target"), text=lambda key, n, items: _lines(File=key, Dependencies=items), guards=guards)


def depend_on_files(subject_selectors=(), object_selectors=(), should: bool = True, allow_empty: bool = False) -> RowRule:
    objects = violations.sentence(object_selectors, subject="files").removesuffix(" should ")
    rule = violations.sentence(subject_selectors, should, f"{'only ' if should else ''}depend on {objects}")
    within = all_of(object_selectors, F.col("target"))
    found = _internal() & all_of(subject_selectors, F.col("source")) & (~within if should else within)
    return _by_source("file_dependency", rule, found, _subjects(subject_selectors, "files.depend_on_files", rule, allow_empty))


def depend_on_external(filters, subject_selectors=(), categories=rules.DEFAULT_CATEGORIES, should: bool = True, allow_empty: bool = False) -> RowRule:
    names = " or ".join(f'"{f.source}"' for f in filters)
    rule = violations.sentence(subject_selectors, should, f"{'only ' if should else ''}depend on external modules {names}")
    within = any_of(filters, F.col("target"))
    enabled = rules.category(F.col("kinds"), F.col("classes"), F.col("availabilities")).bitwiseAND(bit(CATEGORIES, *categories)) != 0
    found = F.col("external") & (F.col("source") != F.col("target")) & all_of(subject_selectors, F.col("source")) & enabled & (~within if should else within)
    return _by_source("external_dependency", rule, found, _subjects(subject_selectors, "files.depend_on_external", rule, allow_empty))


def adhere_to_layers(stack: list[L.Layer], policies: list[L.Policy], strict: bool = False, allow_empty: bool = False) -> RowRule:
    L.validate(stack, policies)
    rule = "layers " + ", ".join(layer.name for layer in stack) + " should hold their policies"
    names, none = _names("source_layer", "target_layer"), F.lit("<unassigned>")
    a, b = map(F.col, names)
    policy = L.forbidden(policies, strict, a, b)
    detail = _lines(Dependency=F.concat("source", F.lit(" -> "), "target"), Source_layer=F.coalesce(a, none), Target_layer=F.coalesce(b, none), Policy=policy)
    stack_filters = {layer.name: layer.filters for layer in stack}
    guards = tuple(
        Guard((a == name) | (~F.col("external") & (b == name)), "empty_test", name, violations.empty_details(f"layers.{name}", rule, [stack_filters[name]]))
        for name in sorted({p.source for p in policies})
    )
    shared = dict(zip(names, [L.layer_of(stack, F.col("source")), L.layer_of(stack, F.col("target"))], strict=True))
    return RowRule("layer_dependency", rule, _internal() & policy.isNotNull(), F.col("source"), detail, guards=() if allow_empty else guards, shared=shared)


def contain_dependency(label, source: str, target: str, should: bool = True, allow_empty: bool = False) -> RowRule:
    rule = violations.sentence((), should, f'contain dependency "{source}" -> "{target}"', "slices")
    names, outside = _names("source_label", "target_label"), F.col("external")
    a, b = map(F.col, names)
    there = (a == source) & (b == target) & (outside | (a != b))
    guards = [] if allow_empty else [Guard(a.isNotNull() | (~outside & b.isNotNull()), "empty_test", "slices.contain_dependency", violations.empty_details("slices.contain_dependency", rule))]
    if should:
        guards.append(Guard(there, "slice_dependency", source, f"Rule: {rule}\nDependency: {source} -> {target}\nEdges: 0"))
    shared = dict(zip(names, [label(F.col("source")), F.when(outside, F.col("target")).otherwise(label(F.col("target")))], strict=True))
    text = lambda key, n, items: _lines(Dependency=F.lit(f"{source} -> {target}"), Edges=n)
    return RowRule("slice_dependency", rule, F.lit(False) if should else there, F.lit(source), text=text, guards=tuple(guards), shared=shared)


def check(edges: DataFrame, *row_rules: RowRule) -> DataFrame:
    """(kind, sort_key, heading, details) of all rules, in order, as ``checks.all_checks`` gives them.

    An empty table meets no guard, so each rule that has one is violated. Repeated rules answer each for
    itself. A source with more targets than a row should hold is one for ``rules.file_dependencies``.
    """
    if not row_rules:
        raise InvalidOptions("no check is given")
    guards = [g for r in row_rules for g in r.guards]
    masks = [guards[i : i + _BITS] for i in range(0, len(guards), _BITS)]
    shared = [c.alias(n) for r in row_rules for n, c in r.shared.items()]
    rows = edges
    if shared:  # exploding a single row keeps the optimizer from copying these into each use
        rows = edges.select("*", F.explode(F.array(F.struct(*shared))).alias("_shared")).select(*edges.columns, "_shared.*")
    text, number = F.lit(None).cast("string"), F.lit(None).cast("long")

    def entry(rule: int, mask: Column, key: Column, detail: Column | None, item: Column | None) -> Column:
        parts = {"rule": F.lit(rule), "mask": mask, "key": key, "detail": text if detail is None else detail, "item": text if item is None else item}
        return F.struct(*[c.alias(n) for n, c in parts.items()])

    def bits(some: list[Guard]) -> Column:
        out = F.lit(0).cast("long")
        for k, g in enumerate(some):
            out = out.bitwiseOR(F.when(g.seen, F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
        return out

    entries = [F.when(r.found, entry(k, number, r.key, r.detail, r.item)) for k, r in enumerate(row_rules)]
    entries += [entry(-1 - k, bits(some), text, None, None) for k, some in enumerate(masks)]
    met = rows.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).select("e.*")
    if masks:  # a mask of nothing, so that there is one to look at where there is no edge
        none = edges.sparkSession.range(1).select(F.explode(F.array(*[entry(-1 - k, F.lit(0).cast("long"), text, None, None) for k in range(len(masks))])).alias("e"))
        met = met.union(none.select("e.*"))
    items = F.array_join(F.array_sort(F.collect_set("item")), "|")
    found = met.groupBy("rule", "key", "detail").agg(F.count("*").alias("n"), F.bit_or("mask").alias("mask"), items.alias("items"))

    def violation(kind: str, key: Column, details: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.alias("sort_key"), F.lit(violations.HEADINGS[kind]).alias("heading"), details.alias("details"))

    answers = F.lit(None)
    for k, r in enumerate(row_rules):
        if r.text:
            of_rule = F.array(violation(r.kind, F.col("key"), F.concat_ws("\n", F.lit(f"Rule: {r.rule}"), r.text(F.col("key"), F.col("n"), F.col("items")))))
        else:
            of_rule = F.array_repeat(violation(r.kind, F.col("key"), F.concat_ws("\n", F.lit(f"Rule: {r.rule}"), F.col("detail"))), F.col("n").cast("int"))
        answers = F.when(F.col("rule") == k, of_rule).otherwise(answers)
    for k, some in enumerate(masks):
        unmet = [F.when(F.col("mask").bitwiseAND(F.lit(1 << i).cast("long")) == 0, violation(g.kind, F.lit(g.sort_key), F.lit(g.details))) for i, g in enumerate(some)]
        answers = F.when(F.col("rule") == -1 - k, F.array_compact(F.array(*unmet))).otherwise(answers)
    return ordered(found.select(F.explode(answers).alias("v")).select("v.*"), "violations")
