"""Violations of all rules as one table of text: headings, details, rule sentences, the empty guard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.errors import InvalidOptions
from edgeloom.functions.patterns import FILENAME, FOLDER, NAME, PATH, Filter

# The heading of each kind of violation.
HEADINGS = {
    "custom_file": "Custom file predicate violation",
    "custom_metric": "Custom metric violation",
    "cycle": "Circular dependency detected",
    "empty_test": "Empty test violation",
    "external_dependency": "External dependency violation",
    "file_dependency": "File dependency violation",
    "layer_dependency": "Layer dependency violation",
    "matching": "File pattern violation",
    "metric": "Metric threshold violation",
    "metric_predicate": "Metric predicate violation",
    "slice_dependency": "Slice dependency violation",
}
#: Why an empty guard stands.
NOTHING = "no files matched the rule scope"
_PHRASES = {FILENAME: "with name", PATH: "in path", FOLDER: "in folder", NAME: "with declaration name"}


def _selector(alternatives: tuple[Filter, ...]) -> str:
    quoted = [("" if f.is_glob else "regex ") + '"' + f.source.replace("\\", "\\\\").replace('"', '\\"') + '"' for f in alternatives]
    out = f", {_PHRASES[alternatives[0].target]} " + (f"({' or '.join(quoted)})" if len(quoted) > 1 else quoted[0])
    for f in alternatives:
        out += "".join(_selector((e,)).replace(", ", ", except ", 1) for e in f.exclusions)
    return out


def sentence(selectors=(), should: bool = True, predicate: str = "", subject: str = "project files") -> str:
    """A rule in words: its subjects, its mood and what it demands."""
    return subject + "".join(_selector(tuple(s)) for s in selectors if s) + (" should " if should else " should not ") + predicate


# What a filter's target is called among the selectors of an empty check.
_TARGETS = {FILENAME: "filename", PATH: "path", FOLDER: "folder", NAME: "declaration name"}


def scope(selectors=()) -> str:
    """The selectors of a rule one by one: alternatives of a call, calls that all hold, and exclusions behind what they take from."""

    def one(f: Filter) -> str:
        quoted = f.source.replace("\\", "\\\\").replace('"', '\\"')
        return f'{_TARGETS[f.target]} {"glob" if f.is_glob else "regex"} "{quoted}" ({"exact" if f.exact else "partial"})'

    calls = []
    for alternatives in (s for s in selectors if s):
        out = one(alternatives[0])
        for k, f in enumerate(alternatives):
            if k:  # after an exclusion, the next alternative is written like a new call
                out += (" AND " if alternatives[k - 1].exclusions else " OR ") + one(f)
            out += "".join(f" EXCEPT {one(e)}" for e in f.exclusions)
        calls.append(out)
    return " AND ".join(calls) or "unfiltered project scope"


def as_text(rows: DataFrame, kind: str, rule: str, sort_key: Column | str, details: dict[str, Column | str]) -> DataFrame:
    """(kind, sort_key, heading, details) of each violation row: the rule's sentence, then a line for each detail that is not null."""
    if kind not in HEADINGS:
        raise InvalidOptions(f"unknown kind of violation {kind!r}")
    if not rule.strip():
        raise InvalidOptions("a rule needs a sentence")
    column = lambda c: F.col(c) if isinstance(c, str) else c
    lines = [F.lit(f"Rule: {rule}"), *[F.when(column(c).isNotNull(), F.concat(F.lit(f"{name}: "), column(c).cast("string"))) for name, c in details.items()]]
    return rows.select(F.lit(kind).alias("kind"), column(sort_key).cast("string").alias("sort_key"), F.lit(HEADINGS[kind]).alias("heading"), F.concat_ws("\n", *lines).alias("details"))


def empty_details(rule_id: str, rule: str, selectors=()) -> str:
    """The lines of an empty guard, for where they are known without a row."""
    return f"Rule: {rule}\nRule id: {rule_id}\nReason: {NOTHING}\nSelectors: {scope(selectors)}"


def empty_test(selected: DataFrame, rule_id: str, rule: str, selectors=()) -> DataFrame:
    """One violation, as text, if selected has no row; else none."""
    none = selected.agg(F.count("*").alias("n")).where("n = 0")
    return as_text(none, "empty_test", rule, F.lit(rule_id), {"Rule id": F.lit(rule_id), "Reason": F.lit(NOTHING), "Selectors": F.lit(scope(selectors))})


def checked(violations: DataFrame, selected: DataFrame, rule_id: str, rule: str, allow_empty: bool = False, selectors=()) -> DataFrame:
    """The violations (as text) of a rule, and the empty guard's, which names the selectors, unless a rule without subjects is allowed."""
    return violations if allow_empty else violations.unionByName(empty_test(selected, rule_id, rule, selectors))


def result(violations: DataFrame) -> DataFrame:
    """(passed, n_violations) of all rows together."""
    return violations.agg((F.count("*") == 0).alias("passed"), F.count("*").alias("n_violations"))
