"""Many patterns at once: paths meet, in a join on literal beginnings or ends, only the patterns that can match.

A pattern is filed under its literal beginning or, if that is longer, its literal end. There are at most
``LEVELS`` lengths of such keys, so a path has at most that many of each kind, however many patterns there
are. A pattern that is nothing but its ends needs no regex; others are held against the few paths that meet
them. Only patterns without a literal end (``*x*``, most regexes) are still tried on every path.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.errors import InvalidPattern
from edgeloom.functions.patterns import FILENAME, FOLDER, NAME, PATH, Filter
from edgeloom.operators.components import SMALL

LEVELS = 24
_SCHEMA = "pattern int, target string, side string, key string, starts string, ends string, shortest int, regex string, exact boolean"


def _levels(lengths: set[int]) -> list[int]:
    """At most LEVELS of the lengths, evenly among them, the smallest one included."""
    known = sorted(lengths)
    return sorted({known[k * len(known) // LEVELS] for k in range(LEVELS)}) if known else []


def _filed(filters: list[Filter]) -> tuple[list[tuple], list[tuple[int, Filter]], dict[tuple[str, str], list[int]]]:
    """(rows of the pattern table, (number, filter) of those without a key, key lengths by target and side)."""
    rows, loose, lengths = [], [], {}
    for n, f in enumerate(filters):
        start, end, whole = f.literal_ends
        if not start and not end:
            loose.append((n, f))
            continue
        side, key = ("start", start) if len(start) >= len(end) else ("end", end)
        lengths.setdefault((f.target, side), set()).add(len(key))
        between = f.is_glob and "**" in f.source
        shortest = len(start) + len(end) if between else max(len(start), len(end))
        rows.append((n, f.target, side, key, start, end, shortest, None if whole else f.regex, whole and not between))
    levels = {at: _levels(known) for at, known in lengths.items()}
    cut = []
    for n, target, side, key, *rest in rows:
        size = max(x for x in levels[target, side] if x <= len(key))
        cut.append((n, target, side, key[:size] if side == "start" else key[-size:], *rest))
    return cut, loose, levels


def _table(frame: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    table = frame.sparkSession.createDataFrame(rows, schema)
    return F.broadcast(table) if len(rows) <= SMALL else table


def _hits(distinct: DataFrame, patterns: list[Filter]) -> DataFrame:
    """(path, pattern) for each path and each pattern, by position, that matches it by itself."""
    rows, loose, levels = _filed(patterns)
    hits = distinct.sparkSession.createDataFrame([], "path string, pattern int")
    if rows:
        value = {t: Filter("x", t).field_of(F.col("path")) for t in (FILENAME, PATH, FOLDER)}
        keys = [_keys(value[target], target, side, sizes) for (target, side), sizes in sorted(levels.items())]
        met = distinct.select("path", F.explode(F.flatten(F.array(*keys))).alias("k")).select("path", "k.*").where("key IS NOT NULL")
        met = met.join(_table(distinct, rows, _SCHEMA), ["target", "side", "key"])
        fits = F.startswith("value", F.col("starts")) & F.endswith("value", F.col("ends")) & (F.length("value") >= F.col("shortest"))
        fits &= F.when(F.col("regex").isNull(), ~F.col("exact") | (F.length("value") == F.col("shortest"))).otherwise(F.rlike(F.col("value"), F.col("regex")))
        hits = hits.union(met.where(fits).select("path", "pattern"))
    if loose:
        tried = [F.when(f.positive(F.col("path")), F.lit(n)) for n, f in loose]
        hits = hits.union(distinct.select("path", F.explode(F.array_compact(F.array(*tried))).alias("pattern")))
    return hits


def matching(paths: DataFrame, filters: list[Filter], column: str = "path") -> DataFrame:
    """(path, number) for each distinct path of the column and each filter, by position, that selects it.

    The same as each filter's own ``matches``: null paths match nothing, no filters select nothing, a
    repeated filter answers under each of its numbers. A pattern that many filters or exclusions share is
    tried once a path; exclusions are looked up among all that a path matches. The filters are a parameter
    that the driver holds; their table is broadcast up to ``SMALL`` rows and joined by a shuffle beyond.
    """
    patterns: dict[Filter, int] = {}
    number = lambda f: patterns.setdefault(replace(f, exclusions=()), len(patterns))
    owners = [(number(f), n, [number(e) for e in f.exclusions if e.target != NAME]) for n, f in enumerate(filters)]
    if any(f.target == NAME for f in patterns):
        raise InvalidPattern("this candidate has no declaration name")
    distinct = paths.select(F.col(column).cast("string").alias("path")).where("path IS NOT NULL").distinct()
    hits, owned = _hits(distinct, list(patterns)), _table(paths, owners, "pattern int, number int, excludes array<int>")
    if not any(excludes for _, _, excludes in owners):
        return hits.join(owned, "pattern").select("path", "number")
    by_path = hits.groupBy("path").agg(F.collect_set("pattern").alias("found"))
    met = by_path.select("path", "found", F.explode("found").alias("pattern")).join(owned, "pattern")
    return met.where(~F.arrays_overlap("found", "excludes")).select("path", "number")


def _keys(value: Column, target: str, side: str, sizes: list[int]) -> Column:
    """The beginnings or ends of so many characters that a field has, each with the field."""

    def key(n: int) -> Column:
        part = F.left(value, F.lit(n)) if side == "start" else F.right(value, F.lit(n))
        at = F.when(F.length(value) >= n, part)
        return F.struct(F.lit(target).alias("target"), F.lit(side).alias("side"), at.alias("key"), value.alias("value"))

    return F.array(*[key(n) for n in sizes])


def select(frame: DataFrame, filters: list[Filter], column: str = "path") -> DataFrame:
    """The rows whose path any of the filters selects, as ``where(any_of(...))`` gives them."""
    chosen = matching(frame, filters, column).select(F.col("path").alias("_selected")).distinct()
    return frame.join(chosen, F.col(column) == F.col("_selected"), "left_semi")


def first_match(paths: DataFrame, filters: list[Filter], column: str = "path") -> DataFrame:
    """(path, number) of the first filter that selects each distinct path; paths that none selects are left out."""
    return matching(paths, filters, column).groupBy("path").agg(F.min("number").alias("number"))
