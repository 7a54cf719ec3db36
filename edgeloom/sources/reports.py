"""Reports as DataFrames of lines: written by Spark's text writer, or joined where a report is small.

Every function takes the nodes(id, label) and edges(source_label, target_label, count, external,
kinds, classes, availabilities) of a snapshot and returns (part, label, line): lines in order of part,
then label. Formats, colours and escapes are fixed values of the report formats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.model import AVAILABILITIES, CLASSES, KINDS, bit, names_of

_BLUE = "#2563eb"
_QUOTED = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f"))
_MERMAID = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"), ("\r\n", "<br/>"), ("\r", "<br/>"), ("\n", "<br/>"))


def _escaped(c: Column, table) -> Column:
    for old, new in table:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), _escaped(c, _QUOTED), F.lit('"'))


def csv_field(c: Column) -> Column:
    return F.when(F.rlike(c, F.lit('[",\r\n]')), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def _lines(part: int, rows: DataFrame, label: Column, line: Column) -> DataFrame:
    return rows.select(F.lit(part).alias("part"), label.alias("label"), line.alias("line"))


def _fixed(rows: DataFrame, part: int, line: str) -> DataFrame:
    return rows.sparkSession.createDataFrame([(part, "", line)], "part int, label string, line string")


def _one_line(text: str) -> str:
    return " ".join(text.replace("\r\n", "\n").replace("\r", "\n").split("\n"))


def _style(edges: DataFrame) -> tuple[Column, Column, Column, Column, Column]:
    resource = F.col("classes").bitwiseAND(bit(CLASSES, "resource")) != 0
    pair = F.concat("source_label", F.lit("\x00"), "target_label")
    return F.col("source_label"), F.col("target_label"), F.col("external"), resource, pair


def dot(nodes: DataFrame, edges: DataFrame, title: str) -> DataFrame:
    source, target, external, resource, pair = _style(edges)
    kinds = names_of(KINDS, F.col("kinds"), ", ")
    marks = F.array_compact(
        F.array(
            F.when(F.col("count") > 1, F.concat(F.lit('label="'), F.col("count").cast("string"), F.lit('"'))),
            F.when(external, F.lit("style=dashed")),
            F.when(resource, F.lit(f'color="{_BLUE}"')),
            F.when(kinds != "", F.concat(F.lit('tooltip="'), kinds, F.lit('"'))),
        )
    )
    tail = F.when(F.size(marks) > 0, F.concat(F.lit(" ["), F.array_join(marks, ", "), F.lit("]"))).otherwise("")
    head = nodes.sparkSession.range(1).select(F.concat(F.lit("digraph dependencies {\n  rankdir=LR;\n  label="), quoted(F.lit(title)), F.lit(";\n  labelloc=t;")).alias("line"))
    out = _lines(0, head, F.lit(""), F.col("line")).union(_lines(1, nodes, F.col("label"), F.concat(F.lit("  "), quoted(F.col("label")), F.lit(";"))))
    out = out.union(_lines(2, edges, pair, F.concat(F.lit("  "), quoted(source), F.lit(" -> "), quoted(target), tail, F.lit(";"))))
    return out.union(_fixed(nodes, 3, "}"))


def d2(nodes: DataFrame, edges: DataFrame, title: str) -> DataFrame:
    source, target, external, resource, pair = _style(edges)
    styles = F.array_compact(F.array(F.when(external, F.lit("style.stroke-dash: 4")), F.when(resource, F.lit(f'style.stroke: "{_BLUE}"'))))
    count = F.when(F.col("count") > 1, F.concat(F.lit(': "'), F.col("count").cast("string"), F.lit('"'))).otherwise("")
    tail = F.when(F.size(styles) > 0, F.concat(F.lit(" { "), F.array_join(styles, "; "), F.lit(" }"))).otherwise("")
    out = _fixed(nodes, 0, f"# {_one_line(title)}").union(_lines(1, nodes, F.col("label"), quoted(F.col("label"))))
    return out.union(_lines(2, edges, pair, F.concat(quoted(source), F.lit(" -> "), quoted(target), count, tail)))


def mermaid(nodes: DataFrame, edges: DataFrame, title: str) -> DataFrame:
    """An edge whose end is no node fails the job."""
    _, _, external, _, pair = _style(edges)
    ids = lambda name: nodes.select(F.col("label").alias(f"{name}_label"), F.col("id").alias(name))
    rows = edges.join(ids("source"), "source_label", "left").join(ids("target"), "target_label", "left")
    count = F.when(F.col("count") > 1, F.concat(F.lit("|"), F.col("count").cast("string"), F.lit("|"))).otherwise("")
    line = F.concat(F.lit("  "), F.col("source"), F.when(external, " -.->").otherwise(" -->"), count, F.lit(" "), F.col("target"))
    line = F.coalesce(line, F.raise_error(F.lit("an edge ends at no node")).cast("string"))
    out = _fixed(nodes, 0, f"%% {_one_line(title)}\nflowchart LR")
    out = out.union(_lines(1, nodes, F.lpad(F.substring("id", 2, 20), 20, "0"), F.concat(F.lit("  "), F.col("id"), F.lit('["'), _escaped(F.col("label"), _MERMAID), F.lit('"]'))))
    return out.union(_lines(2, rows, pair, line))


def csv(nodes: DataFrame, edges: DataFrame, title: str = "") -> DataFrame:
    _, _, external, _, pair = _style(edges)
    sets = [F.concat(F.lit(',"'), names_of(m, F.col(c)), F.lit('"')) for m, c in ((KINDS, "kinds"), (CLASSES, "classes"), (AVAILABILITIES, "availabilities"))]
    line = F.concat(csv_field(F.col("source_label")), F.lit(","), csv_field(F.col("target_label")), F.lit(","), F.col("count").cast("string"), F.lit(","), external.cast("string"), *sets)
    return _fixed(nodes, 0, "source,target,count,external,import_kinds,target_classes,target_availabilities").union(_lines(1, edges, pair, line))


def json_lines(nodes: DataFrame, edges: DataFrame, title: str = "") -> DataFrame:
    """One JSON object a line: nodes, then edges with their sets as lists."""
    _, _, _, _, pair = _style(edges)
    sets = [F.filter(F.split(names_of(m, F.col(c)), r"\|"), lambda x: x != "").alias(c) for m, c in ((KINDS, "kinds"), (CLASSES, "classes"), (AVAILABILITIES, "availabilities"))]
    edge = F.to_json(F.struct(F.col("source_label").alias("source"), F.col("target_label").alias("target"), "count", "external", *sets))
    return _lines(0, nodes, F.col("label"), F.to_json(F.struct("id", "label"))).union(_lines(1, edges, pair, edge))


def _json_set(members: tuple[str, ...], mask: Column) -> Column:
    names = F.filter(F.split(names_of(members, mask), r"\|"), lambda x: x != "")
    joined = F.array_join(F.transform(names, lambda x: F.concat(F.lit('        "'), x, F.lit('"'))), ",\n")
    return F.when(F.size(names) == 0, "[]").otherwise(F.concat(F.lit("[\n"), joined, F.lit("\n      ]")))


def _json_object(rows: DataFrame, fields: dict[str, Column], last: Column) -> Column:
    inside = F.concat_ws(",\n", *[F.concat(F.lit(f'      "{name}": '), value) for name, value in fields.items()])
    return F.concat(F.lit("    {\n"), inside, F.lit("\n    }"), F.when(last, "").otherwise(","))


def json_document(nodes: DataFrame, edges: DataFrame, summary: DataFrame, title: str = "") -> DataFrame:
    """The whole report as one JSON document with an indent of 2; summary is the snapshot's, one row."""
    text = lambda c: F.col(c).cast("string")
    counts = summary.select([F.col(c) for c in ("node_count", "edge_count", "raw_edge_count", "external_edge_count")])
    opens = lambda n: F.when(F.col(n) == 0, "[],").otherwise("[")
    closes = lambda n: F.when(F.col(n) == 0, "").otherwise("  ],\n")
    head = F.concat(F.lit('{\n  "title": '), quoted(F.lit(title)), F.lit(',\n  "nodes": '), opens("node_count"))
    middle = F.concat(closes("node_count"), F.lit('  "edges": '), opens("edge_count"))
    tail = F.concat_ws(",\n", *[F.concat(F.lit(f'    "{c}": '), text(c)) for c in counts.columns])
    tail = F.concat(closes("edge_count"), F.lit('  "summary": {\n'), tail, F.lit("\n  }\n}"))
    # the last of each list has no comma: the greatest label, found by an aggregate of one row
    last_node = nodes.agg(F.max("label").alias("last"))
    last_edge = edges.agg(F.max(F.struct("source_label", "target_label")).alias("last"))
    node = _json_object(nodes, {"id": quoted(F.col("id")), "label": quoted(F.col("label"))}, F.col("label") == F.col("last"))
    sets = {"import_kinds": (KINDS, "kinds"), "target_classes": (CLASSES, "classes"), "target_availabilities": (AVAILABILITIES, "availabilities")}
    fields = {"source": quoted(F.col("source_label")), "target": quoted(F.col("target_label")), "count": text("count"), "external": text("external")} | {k: _json_set(m, F.col(c)) for k, (m, c) in sets.items()}
    pair = F.concat("source_label", F.lit("\x00"), "target_label")
    edge = _json_object(edges, fields, F.struct("source_label", "target_label") == F.col("last"))
    out = _lines(0, counts, F.lit(""), head).union(_lines(1, nodes.join(F.broadcast(last_node)), F.col("label"), node))
    out = out.union(_lines(2, counts, F.lit(""), middle)).union(_lines(3, edges.join(F.broadcast(last_edge)), pair, edge))
    return out.union(_lines(4, counts, F.lit(""), tail))


def write(lines: DataFrame, path: str) -> None:
    """Text files in order: lines are range-partitioned, so no task sees a whole report; joined by name they are it."""
    lines.repartitionByRange("part", "label").sortWithinPartitions("part", "label").select("line").write.mode("overwrite").text(path)
