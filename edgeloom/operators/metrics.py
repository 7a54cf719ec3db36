"""Coupling metrics, thresholds and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.errors import InvalidOptions
from edgeloom.functions.patterns import all_of, extension, folder, stem
from edgeloom.operators.components import kept
from edgeloom.operators.components import settled as cut

COMPARISONS = {
    "below": lambda a, b: a < b,
    "above": lambda a, b: a > b,
    "equal": lambda a, b: a == b,
    "below_or_equal": lambda a, b: a <= b,
    "above_or_equal": lambda a, b: a >= b,
}


def coupling(edges: DataFrame, selectors=()) -> DataFrame:
    """(label, afferent, efferent, instability, coupling_factor) of each file.

    Only edges between files with a self-edge count. Instability is Ce / (Ca + Ce), 0 for isolated
    files. The coupling factor is (Ca + Ce) / (2 (n - 1)), n being all files, chosen or not; 0 for one
    file. Each edge adds one row to either end, so this is a single partial aggregation. Edges are read when this is called.
    """
    rows = kept(edges.where("NOT external").select("source", "target"))  # normalized once for the files and both ends
    files = rows.where("source = target").select(F.col("source").alias("label"))
    inside = rows.where("source != target")
    inside = inside.join(files.select(F.col("label").alias("source")), "source", "left_semi").join(files.select(F.col("label").alias("target")), "target", "left_semi")
    zero, one = F.lit(0), F.lit(1)
    ends = files.select("label", zero.alias("a"), zero.alias("e"))
    ends = ends.union(inside.select("target", one, zero)).union(inside.select("source", zero, one))
    n = files.agg((F.count("*") - 1).alias("others"))  # one row
    found = ends.groupBy("label").agg(F.sum("a").alias("afferent"), F.sum("e").alias("efferent")).where(all_of(selectors, F.col("label")))
    total = F.col("afferent") + F.col("efferent")
    factor = F.when(F.col("others") > 0, total / (2.0 * F.col("others"))).otherwise(0.0)
    return found.join(F.broadcast(n)).select("label", "afferent", "efferent", F.when(total == 0, 0.0).otherwise(F.col("efferent") / F.nullif(total, F.lit(0))).alias("instability"), factor.alias("coupling_factor"))


def validated(labels: DataFrame, projected: DataFrame) -> DataFrame:
    """projected(source_label, target_label, external) whose internal edges end at labels(label), else the job fails.

    Labels are neither empty nor repeated, and no internal edge dangles.
    """
    counts = labels.groupBy("label").agg(F.count("*").alias("n"))
    bad = F.raise_error(F.concat(F.lit("empty or repeated label "), "label")).cast("long")
    known = counts.select("label", F.when((F.col("label") == "") | (F.col("n") > 1), bad).otherwise(F.col("n")).alias("n"))
    rows = projected
    for end in ("source", "target"):
        rows = rows.join(known.select(F.col("label").alias(f"{end}_label"), F.col("n").alias(f"__{end}")), f"{end}_label", "left")
    dangling = F.raise_error(F.concat(F.lit("an edge ends at no label: "), "source_label", F.lit(" -> "), "target_label")).cast("boolean")
    fits = F.col("external") | (F.col("source_label") == F.col("target_label")) | (F.col("__source").isNotNull() & F.col("__target").isNotNull())
    return rows.where(F.when(fits, True).otherwise(dangling)).drop("__source", "__target")


def projected_coupling(edges: DataFrame, label) -> DataFrame:
    """(label, source_file_count, afferent, efferent, instability, coupling_factor) of each projected subject.

    label(column) gives an end's subject, null for none. Subjects are the labels of files; edges count
    once for each pair of different subjects, if any of them is internal. Edges are read when this is called.
    """
    rows = edges.select("source", "target", "external", label(F.col("source")).alias("source_label"), F.when(F.col("external"), F.col("target")).otherwise(label(F.col("target"))).alias("target_label")).dropna(subset=["source_label", "target_label"])
    own = (~F.col("external")) & (F.col("source") == F.col("target"))
    merged = rows.withColumn("file", F.when(own, F.col("source"))).groupBy("source_label", "target_label", "file").agg(F.bool_and("external").alias("external"))
    pairs = cut(merged.groupBy("source_label", "target_label").agg(F.bool_and("external").alias("external"), F.count("file").alias("files")))  # one look at the edges
    subjects = pairs.groupBy(F.col("source_label").alias("label")).agg(F.sum("files").alias("source_file_count")).where("source_file_count > 0")
    pairs = pairs.drop("files")
    inside = validated(subjects, pairs).where("NOT external AND source_label != target_label")
    ends = subjects.select("label", F.lit(0).alias("a"), F.lit(0).alias("e"))
    ends = ends.union(inside.select("target_label", F.lit(1), F.lit(0))).union(inside.select("source_label", F.lit(0), F.lit(1)))
    found = ends.groupBy("label").agg(F.sum("a").alias("afferent"), F.sum("e").alias("efferent")).join(subjects, "label")
    n = subjects.agg((F.count("*") - 1).alias("others"))  # one row
    total = F.col("afferent") + F.col("efferent")
    factor = F.when(F.col("others") > 0, total / (2.0 * F.col("others"))).otherwise(0.0)
    rate = F.when(total == 0, 0.0).otherwise(F.col("efferent") / F.nullif(total, F.lit(0)))
    return found.join(F.broadcast(n)).select("label", "source_file_count", "afferent", "efferent", rate.alias("instability"), factor.alias("coupling_factor"))


def comprehensive(line_summary: DataFrame, dependency_summary: DataFrame | None = None) -> DataFrame:
    """All sections of a metrics report together; the dependency section only at the level of files."""
    out = report_sections(line_summary, "count", "Counts")
    return out if dependency_summary is None else out.unionByName(report_sections(dependency_summary, "dependency", "Coupling"))


def coupling_summary(metrics: DataFrame) -> DataFrame:
    """Totals and means over the chosen files; all 0 for none."""
    return metrics.agg(
        F.count("*").alias("subjects"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c}") for c in ("afferent", "efferent")],
        *[F.coalesce(F.sum(c) / F.count("*"), F.lit(0.0)).alias(f"mean_{c}") for c in ("instability", "coupling_factor")],
    )


def threshold(metrics: DataFrame, metric: str, comparison: str, value: int | float) -> DataFrame:
    """(label, measured) of subjects whose metric does not compare to value as wanted.

    Whole metrics are compared with whole thresholds only, and fractional ones with fractional ones.
    """
    whole = metrics.schema[metric].dataType.simpleString() in ("int", "bigint", "smallint", "tinyint")
    if isinstance(value, bool) or whole != isinstance(value, int):
        raise InvalidOptions(f"{metric} cannot be compared with {value!r}")
    if comparison not in COMPARISONS:
        raise InvalidOptions(f"unknown comparison {comparison!r}")
    return metrics.where(~COMPARISONS[comparison](F.col(metric), F.lit(value))).select("label", F.col(metric).alias("measured"))


def satisfy(metrics: DataFrame, predicate: Column) -> DataFrame:
    """Subjects that a caller's predicate column (or pandas UDF) rejects."""
    return metrics.where(~predicate)


def custom_metric(metrics: DataFrame, name: str, value: Column) -> DataFrame:
    """metrics with a caller's metric, built in or a pandas UDF."""
    return metrics.withColumn(name, value)


def line_counts(files: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, bytes, source_lines, non_blank_lines) of each text; a last line without an end counts.

    Blank lines hold white space only; null counts as empty, which has no lines.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.regexp_count(text, F.lit("\n")) + F.when(F.endswith(text, F.lit("\n")) | (text == ""), 0).otherwise(1)
    non_blank = F.regexp_count(text, F.lit("(?m)^[^\n]*[^ \t\r\n\\x0B\\f][^\n]*"))
    return files.select(F.col(id_col), F.octet_length(text).cast("long").alias("bytes"), lines.cast("long").alias("source_lines"), non_blank.cast("long").alias("non_blank_lines"))


def file_view(files: DataFrame, path_col: str = "path", text_col: str = "content") -> DataFrame:
    """(path, stem, extension, directory, bytes, source_lines, non_blank_lines): all that is known of a file, in one pass."""
    path = F.col(path_col)
    counts = line_counts(files, path_col, text_col)
    names = [stem(path).alias("stem"), extension(path).alias("extension"), F.when(F.instr(path, "/") > 0, folder(path)).otherwise("").alias("directory")]
    return counts.select(path.alias("path"), *names, "bytes", "source_lines", "non_blank_lines")


def import_summary(references: DataFrame, kinds: list[str]) -> DataFrame:
    """(source, total, one count per kind) in one aggregation."""
    return references.groupBy("source").agg(F.count("*").alias("total"), *[F.count_if(F.col("kind_name") == k).alias(k) for k in kinds])


def report_sections(summary: DataFrame, kind: str, title: str) -> DataFrame:
    """A one-row summary as (section_kind, title, label, value) rows."""
    long = summary.unpivot([], [F.col(c).cast("double").alias(c) for c in summary.columns], "label", "value")
    return long.select(F.lit(kind).alias("section_kind"), F.lit(title).alias("title"), "label", "value")
