"""Queries over the order graph, one per operator family, with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.functions.patterns import FILENAME, FOLDER, all_of, collapse_folder, collapse_pattern, glob, normalize_path, regex
from edgeloom.model import CATEGORIES, CLASSES, KINDS, names_of
from edgeloom.operators import checks, graph, layers, metrics, onescan, ordering, rules, selection, slices, traversal, violations
from edgeloom.operators.components import kept, settled
from edgeloom.sources import projects, tables, workspaces

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_BASE = """
files AS (
  SELECT c_custkey, r_name || '/' || n_name || '/' || c_mktsegment || '/' || c_name AS path
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
internal AS (
  SELECT f.path AS source, t.path AS target, false AS external,
    CASE a.o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 4 WHEN '4-NOT SPECIFIED' THEN 64 WHEN '5-LOW' THEN 32 ELSE 0 END AS kind,
    1 AS class, 1 AS availability, a.o_orderkey AS pos, a.o_orderkey % 1000 AS line, a.o_orderkey AS okey
  FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1
  JOIN files f ON f.c_custkey = a.o_custkey JOIN files t ON t.c_custkey = b.o_custkey),
outer_ AS (
  SELECT f.path AS source, p_brand AS target, true AS external,
    CASE p_type WHEN 'ECONOMY' THEN 4 WHEN 'LARGE' THEN 4 WHEN 'MEDIUM' THEN 4 WHEN 'PROMO' THEN 8 WHEN 'SMALL' THEN 64 WHEN 'STANDARD' THEN 128 ELSE 0 END AS kind,
    CASE p_type WHEN 'ECONOMY' THEN 2 WHEN 'LARGE' THEN 2 WHEN 'MEDIUM' THEN 2 WHEN 'PROMO' THEN 4 WHEN 'SMALL' THEN 8 WHEN 'STANDARD' THEN 16 ELSE 0 END AS class,
    CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'MEDIUM' THEN 4 WHEN 'PROMO' THEN 1 WHEN 'SMALL' THEN 4 WHEN 'STANDARD' THEN 2 ELSE 0 END AS availability,
    l_orderkey AS pos, l_linenumber AS line, NULL AS okey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN files f ON f.c_custkey = o_custkey),
refs AS (
  SELECT * FROM internal UNION ALL SELECT * FROM outer_
  UNION ALL SELECT path, path, false, 0, 1, 1, NULL, NULL, NULL FROM files),
edges AS (
  SELECT source, target, bool_or(external) AS external, CAST(bit_or(kind) AS INTEGER) AS kinds, CAST(bit_or(class) AS INTEGER) AS classes,
    CAST(bit_or(availability) AS INTEGER) AS availabilities, count(DISTINCT (pos, line)) FILTER (pos IS NOT NULL) AS n_locations,
    min(pos) AS first_at, max(pos) AS last_at
  FROM refs GROUP BY source, target)"""


def query(sql: str | None = None, extra: str = ""):
    def register(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = f"WITH RECURSIVE {_BASE}{extra}\n{sql}"
        return f

    return register


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.edges(spark, sf_dir)


ASIA, EUROPE = glob("ASIA/**"), glob("EUROPE/**")
MACHINERY = glob("*/*/MACHINERY", FOLDER)
SIX = glob("Customer#*6", FILENAME)


@query("SELECT source, target, external, kinds, classes, availabilities FROM edges")
def normalize_edges(spark, sf_dir):
    return _edges(spark, sf_dir).drop("locations")


@query("SELECT source, target, n_locations, first_at, last_at FROM edges WHERE n_locations > 0")
def edge_locations(spark, sf_dir):
    return tables.location_counts(spark, sf_dir)


@query("SELECT source, target, kinds FROM edges WHERE NOT external AND source <> target")
def project_internal(spark, sf_dir):
    return graph.per_internal_edge(_edges(spark, sf_dir)).select("source", "target", "kinds")


@query("SELECT source, target, classes FROM edges WHERE external AND source <> target")
def project_external(spark, sf_dir):
    return graph.per_external_edge(_edges(spark, sf_dir)).select("source", "target", "classes")


_REGION = "CASE WHEN {0} LIKE '%/%' THEN split_part({0}, '/', 1) ELSE {0} END"


@query(f"""SELECT {_REGION.format('source')} AS source_label, {_REGION.format('target')} AS target_label, count(*) AS n_evidence,
  CAST(bit_or(kinds) AS INTEGER) AS kinds FROM edges GROUP BY 1, 2""")
def project_edges(spark, sf_dir):
    region = lambda c: F.split_part(F.col(c), F.lit("/"), F.lit(1))
    return graph.project_edges(_edges(spark, sf_dir), region("source"), region("target")).select("source_label", "target_label", "n_evidence", "kinds")


@query("""SELECT CAST(row_number() OVER (ORDER BY source, target) - 1 AS BIGINT) AS position, source_label, target_label, source, target, kinds FROM (
  SELECT split_part(source, '/', 1) AS source_label, split_part(target, '/', 1) AS target_label, source, target, kinds FROM edges WHERE NOT external AND source LIKE 'ASIA/%' AND target LIKE 'ASIA/%')""")
def edge_evidence(spark, sf_dir):
    region = lambda c: slices.by_regex(F.col(c), "^(ASIA)/")
    found = graph.evidence(_edges(spark, sf_dir).where("NOT external"), region("source"), region("target"))
    return ordering.numbered(found.select("source_label", "target_label", "source", "target", "kinds"), "source", "target")


@query("""SELECT label, sum(i)::BIGINT AS n_incoming, sum(o)::BIGINT AS n_outgoing, sum(x)::BIGINT AS n_outgoing_external FROM (
  SELECT source AS label, 0 AS i, 1 AS o, external::INT AS x FROM edges WHERE source <> target
  UNION ALL SELECT target, 1, 0, 0 FROM edges WHERE source <> target
  UNION ALL SELECT source, 0, 0, 0 FROM edges WHERE source = target) GROUP BY label""")
def project_nodes(spark, sf_dir):
    return graph.project_nodes(_edges(spark, sf_dir), include_external=True)


@query("SELECT source AS path FROM edges WHERE NOT external AND source = target AND NOT regexp_matches(source, '6$')")
def have_name(spark, sf_dir):
    return rules.have_field(_edges(spark, sf_dir), SIX, files=tables.files(spark, sf_dir))


@query("SELECT source AS path FROM edges WHERE NOT external AND source = target AND source LIKE 'ASIA/%' AND source LIKE '%/MACHINERY/%'")
def be_in_folder(spark, sf_dir):
    return rules.have_field(_edges(spark, sf_dir), MACHINERY, [[ASIA]], should=False, files=tables.files(spark, sf_dir))


@query("SELECT source AS path FROM edges WHERE NOT external AND source = target AND NOT regexp_matches(source, 'NATION_1[0-4]/')")
def be_in_path(spark, sf_dir):
    return rules.have_field(_edges(spark, sf_dir), regex("NATION_1[0-4]/"), files=tables.files(spark, sf_dir))


_GROUPED = "SELECT source, count(*) AS n_edges, string_agg(DISTINCT target, '|' ORDER BY target) AS targets FROM edges WHERE {} GROUP BY source"


@query(_GROUPED.format("NOT external AND source <> target AND source LIKE 'ASIA/%' AND NOT (target LIKE 'ASIA/%' OR target LIKE 'EUROPE/%')"))
def depend_on_files_allow(spark, sf_dir):
    return rules.depend_on_files(_edges(spark, sf_dir), [[ASIA]], [[ASIA, EUROPE]], files=tables.files(spark, sf_dir))


@query(_GROUPED.format("NOT external AND source <> target AND source LIKE 'ASIA/%' AND target LIKE 'EUROPE/%'"))
def depend_on_files_block(spark, sf_dir):
    return rules.depend_on_files(_edges(spark, sf_dir), [[ASIA]], [[EUROPE]], should=False, files=tables.files(spark, sf_dir))


_PACKAGE = "external AND (kinds & 4) <> 0 AND (classes & 2) <> 0"


@query(_GROUPED.format(f"{_PACKAGE} AND source LIKE 'ASIA/%' AND NOT regexp_matches(target, '^Brand#1[^/]*$')"))
def external_allow(spark, sf_dir):
    return rules.depend_on_external(_edges(spark, sf_dir), [glob("Brand#1*")], [[ASIA]], files=tables.files(spark, sf_dir))


@query(_GROUPED.format("external AND (classes & 28) <> 0 AND source LIKE 'ASIA/%' AND target IN ('Brand#3', 'Brand#7')"))
def external_block(spark, sf_dir):
    wider = ("compiler_module", "c_header", "resource")
    return rules.depend_on_external(_edges(spark, sf_dir), [glob("Brand#[37]")], [[ASIA]], wider, should=False, files=tables.files(spark, sf_dir))


@query("""SELECT c AS category, count(*) AS n_edges FROM (
  SELECT unnest(list_filter([CASE WHEN named AND a & 1 <> 0 THEN 'package_module' END, CASE WHEN named AND a & 2 <> 0 THEN 'unresolved_module' END,
    CASE WHEN named AND a & 12 <> 0 THEN 'unavailable_module' END, CASE WHEN k & 4 <> 0 THEN 'compiler_module' END,
    CASE WHEN k & 16 <> 0 THEN 'c_header' END, CASE WHEN k & 8 <> 0 THEN 'resource' END], lambda x: x IS NOT NULL)) AS c
  FROM (SELECT classes AS k, availabilities AS a, kinds & 4 <> 0 AND classes & 2 <> 0 AS named FROM edges WHERE external)) GROUP BY c""")
def external_categories(spark, sf_dir):
    found = rules.external_candidates(_edges(spark, sf_dir), categories=CATEGORIES)
    return found.select(F.explode(F.split(names_of(CATEGORIES, F.col("category")), r"\|")).alias("category")).groupBy("category").agg(F.count("*").alias("n_edges"))


@query("""SELECT 'files.have_name' AS rule_id, false AS is_negated WHERE NOT EXISTS (SELECT 1 FROM edges WHERE source = target AND source LIKE 'ATLANTIS/%')""")
def empty_guard(spark, sf_dir):
    return rules.empty_guard(rules.subjects(_edges(spark, sf_dir), [[glob("ATLANTIS/**")]]), "files.have_name")


@query("""SELECT source AS path FROM edges WHERE NOT external AND source = target AND (source LIKE 'ASIA/%' OR source LIKE 'EUROPE/%')
  AND regexp_matches(source, '[05]$') AND NOT source LIKE '%/FURNITURE/%'""")
def selector_algebra(spark, sf_dir):
    selectors = [[ASIA, EUROPE], [regex("[05]$", FILENAME).excluding(glob("**/FURNITURE", FOLDER))]]
    return rules.subjects(_edges(spark, sf_dir), selectors)


LAYERS = [
    layers.Layer("top", (glob("AFRICA/**"), glob("AMERICA/**"))),
    layers.Layer("middle", (glob("A*/**"), EUROPE)),
    layers.Layer("base", (regex("MACHINERY"),)),
]
_LAYER = "CASE WHEN {0} LIKE 'AFRICA/%' OR {0} LIKE 'AMERICA/%' THEN 'top' WHEN {0} LIKE 'A%/%' OR {0} LIKE 'EUROPE/%' THEN 'middle' WHEN {0} LIKE '%MACHINERY%' THEN 'base' END"
_PLACED = f""", placed AS (SELECT source, target, {_LAYER.format('source')} AS source_layer, {_LAYER.format('target')} AS target_layer
  FROM edges WHERE NOT external AND source <> target)"""


@query(f"SELECT label, {_LAYER.format('label')} AS layer FROM (SELECT source AS label FROM edges UNION SELECT target FROM edges WHERE NOT external)")
def layer_assign(spark, sf_dir):
    return layers.assign(_edges(spark, sf_dir), LAYERS)


@query("SELECT *, 'may_only_depend_on_layers' AS policy FROM placed WHERE source_layer = 'top' AND target_layer IN ('base')", _PLACED)
def layer_allow(spark, sf_dir):
    return layers.check_layers(_edges(spark, sf_dir), LAYERS, [layers.Policy("top", ("middle",))])


@query("SELECT *, 'may_not_depend_on_layers' AS policy FROM placed WHERE source_layer = 'base' AND target_layer IN ('top', 'middle')", _PLACED)
def layer_block(spark, sf_dir):
    return layers.check_layers(_edges(spark, sf_dir), LAYERS, [layers.Policy("base", ("top", "middle"), allow=False)])


@query("""SELECT *, CASE WHEN source_layer IS NULL OR target_layer IS NULL THEN 'unassigned_endpoint' ELSE 'may_only_depend_on_layers' END AS policy
  FROM placed WHERE source_layer IS NULL OR target_layer IS NULL OR (source_layer = 'middle' AND target_layer <> 'middle')""", _PLACED)
def layer_strict(spark, sf_dir):
    return layers.check_layers(_edges(spark, sf_dir), LAYERS, [layers.Policy("middle", ())], strict=True)


@query("SELECT 'lost' AS layer")
def layer_guard(spark, sf_dir):
    lost = layers.Layer("lost", (glob("ATLANTIS/**"),))
    return layers.unused_sources(_edges(spark, sf_dir), [*LAYERS, lost], [layers.Policy("lost", ("base",)), layers.Policy("base", ("top",))])


def _slices(rx_source: str, rx_target: str) -> str:
    return f"""SELECT source_label, target_label, count(*) AS count, bool_and(external) AS external FROM (
  SELECT {rx_source} AS source_label, CASE WHEN external THEN target ELSE {rx_target} END AS target_label, external FROM edges)
  WHERE source_label IS NOT NULL AND target_label IS NOT NULL AND (external OR source_label <> target_label) GROUP BY 1, 2"""


def _by_nation(c):
    return slices.by_pattern(c, "A*/(**)")


@query(_slices(*[f"nullif(regexp_extract({c}, '^A[^/]*/([^/]+)', 1), '')" for c in ("source", "target")]))
def slice_pattern(spark, sf_dir):
    return slices.slice_edges(_edges(spark, sf_dir), _by_nation)


@query(_slices(*[f"nullif(regexp_extract({c}, '/([A-Z]+)/Customer', 1), '')" for c in ("source", "target")]))
def slice_regex(spark, sf_dir):
    return slices.slice_edges(_edges(spark, sf_dir), lambda c: slices.by_regex(c, "/([A-Z]+)/Customer"))


_SUFFIX = "CASE WHEN {0} LIKE '%/%' AND {0} LIKE '%00' THEN 'hundreds' WHEN {0} LIKE '%/%' AND {0} LIKE '%0' THEN 'tens' WHEN {0} LIKE '%/%' AND {0} LIKE '%5' THEN 'fives' END"


@query(_slices(_SUFFIX.format("source"), _SUFFIX.format("target")))
def slice_suffix(spark, sf_dir):
    return slices.slice_edges(_edges(spark, sf_dir), lambda c: slices.by_suffix(c, {"0": "tens", "00": "hundreds", "5": "fives"}))


@query("SELECT DISTINCT regexp_extract(source, '^A[^/]*/([^/]+)', 1) AS label FROM edges WHERE source LIKE 'A%/%'")
def slice_labels(spark, sf_dir):
    return slices.slice_labels(_edges(spark, sf_dir), _by_nation)


@query("""SELECT 'NATION_0' AS source_label, 'NATION_12' AS target_label, count(*) AS count FROM edges
  WHERE NOT external AND source LIKE 'AFRICA/NATION_0/%' AND target LIKE 'ASIA/NATION_12/%' HAVING count(*) > 0""")
def slice_contains(spark, sf_dir):
    return slices.contain_dependency(_edges(spark, sf_dir), _by_nation, "NATION_0", "NATION_12", should=False)


DIAGRAM = """@startuml
component [AFRICA]
component [AMERICA] as am
component [ASIA]
component [ATLANTIS]
[AFRICA] --> am
am --> [ASIA]
[ASIA] --> [AFRICA]
[ATLANTIS] --> [ASIA]
@enduml
"""
_REGIONS = """, actual AS (SELECT DISTINCT split_part(source, '/', 1) AS a, split_part(target, '/', 1) AS b FROM edges WHERE NOT external AND source <> target),
expected(a, b) AS (VALUES ('AFRICA', 'AMERICA'), ('AMERICA', 'ASIA'), ('ASIA', 'AFRICA'), ('ATLANTIS', 'ASIA'))"""


@query("""SELECT a AS source_label, b AS target_label, 'unexpected' AS rule FROM (SELECT a, b FROM actual WHERE a <> b EXCEPT SELECT * FROM expected)
  WHERE a IN ('AFRICA', 'AMERICA', 'ASIA', 'ATLANTIS') AND b IN ('AFRICA', 'AMERICA', 'ASIA', 'ATLANTIS')
  UNION ALL SELECT a, b, 'missing' FROM (SELECT * FROM expected EXCEPT SELECT a, b FROM actual)""", _REGIONS)
def diagram_adherence(spark, sf_dir):
    inside = graph.per_internal_edge(_edges(spark, sf_dir))
    return slices.adhere_to_diagram(inside, lambda c: slices.by_regex(c, "^([^/]+)/"), DIAGRAM, ignore_orphan=True)


_STEPS = """, steps AS (SELECT source AS a, target AS b FROM edges WHERE NOT external AND source <> target)"""
_FOCUS = """, walk AS (
  SELECT source AS label, 0 AS d FROM edges WHERE source = target AND source LIKE 'ASIA/%00'
  UNION SELECT s.b, d + 1 FROM walk JOIN (SELECT a, b FROM steps UNION SELECT b, a FROM steps) s ON s.a = walk.label WHERE d < 2)"""
HUNDREDS = glob("ASIA/**/*00")


@query("SELECT label, min(d) AS distance FROM walk GROUP BY label", _STEPS + _FOCUS)
def focus_depth(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    seeds = graph.nodes(edges).where(HUNDREDS.matches(F.col("label")))
    return traversal.reach(edges.where("NOT external"), seeds, "both", 2)


@query("SELECT label FROM walk", _STEPS + """, walk AS (
  SELECT source AS label FROM edges WHERE source = target AND source LIKE '%/NATION_4/%' UNION SELECT b FROM walk JOIN steps ON a = label)""")
def reachable_from(spark, sf_dir):
    return traversal.select_nodes(_edges(spark, sf_dir), traversal.Options((traversal.Query("reachable", (glob("*/NATION_4/**"),)),)))


@query("SELECT label FROM walk", _STEPS + """, walk AS (
  SELECT source AS label FROM edges WHERE source = target AND source LIKE '%/NATION_4/%' UNION SELECT a FROM walk JOIN steps ON b = label)""")
def dependents_of(spark, sf_dir):
    return traversal.select_nodes(_edges(spark, sf_dir), traversal.Options((traversal.Query("dependents", (glob("*/NATION_4/**"),)),)))


@query("SELECT DISTINCT label FROM walk UNION SELECT source FROM edges WHERE source LIKE 'EUROPE/%7' UNION SELECT b FROM steps WHERE a LIKE 'EUROPE/%7' UNION SELECT a FROM steps WHERE b LIKE 'EUROPE/%7'", _STEPS + _FOCUS)
def query_union(spark, sf_dir):
    two = (traversal.Query("focus", (HUNDREDS,), 2), traversal.Query("focus", (glob("EUROPE/**/*7"),), 1))
    return traversal.select_nodes(_edges(spark, sf_dir), traversal.Options(two))


@query("SELECT DISTINCT label, CASE WHEN label LIKE '%/%' THEN split_part(label, '/', 1) || '/' || split_part(label, '/', 2) ELSE label END AS collapsed FROM (SELECT source AS label FROM edges UNION SELECT target FROM edges)")
def collapse_by_folder(spark, sf_dir):
    return graph.nodes(_edges(spark, sf_dir), True).withColumn("collapsed", collapse_folder(F.col("label"), 2))


@query("SELECT DISTINCT label, regexp_replace(label, '([A-Z ]+)/NATION_([0-9])[0-9]*', '\\2$\\1', 'g') AS collapsed FROM (SELECT source AS label FROM edges UNION SELECT target FROM edges)")
def collapse_by_pattern(spark, sf_dir):
    return graph.nodes(_edges(spark, sf_dir), True).withColumn("collapsed", collapse_pattern(F.col("label"), "([A-Z ]+)/NATION_([0-9])[0-9]*", "$2$$$1"))


def _snapshot(spark, sf_dir):
    return traversal.snapshot(_edges(spark, sf_dir), traversal.Options(external=True, collapse=collapse_folder(F.col("label"), 1)))


_COLLAPSED = f", c AS (SELECT {_REGION.format('source')} AS a, {_REGION.format('target')} AS b, * FROM edges WHERE source <> target)"


@query(f"SELECT 'n' || (row_number() OVER (ORDER BY label) - 1) AS id, label FROM (SELECT DISTINCT {_REGION.format('l')} AS label FROM (SELECT source AS l FROM edges UNION SELECT target FROM edges))")
def snapshot_nodes(spark, sf_dir):
    return _snapshot(spark, sf_dir)[0]


@query("SELECT a AS source_label, b AS target_label, count(*) AS count, bool_or(external) AS external, CAST(bit_or(kinds) AS INTEGER) AS kinds, CAST(bit_or(classes) AS INTEGER) AS classes, CAST(bit_or(availabilities) AS INTEGER) AS availabilities FROM c WHERE a <> b GROUP BY a, b", _COLLAPSED)
def snapshot_edges(spark, sf_dir):
    return _snapshot(spark, sf_dir)[1]


@query("SELECT (SELECT count(*) FROM (SELECT a FROM c UNION SELECT b FROM c)) AS node_count, (SELECT count(*) FROM (SELECT DISTINCT a, b FROM c WHERE a <> b)) AS edge_count, count(*) AS raw_edge_count, count(*) FILTER (external) AS external_edge_count FROM c", _COLLAPSED)
def snapshot_summary(spark, sf_dir):
    return _snapshot(spark, sf_dir)[2]


_COUPLING = """, ends AS (
  SELECT source AS label, 0 AS a, 0 AS e FROM edges WHERE source = target
  UNION ALL SELECT target, 1, 0 FROM edges WHERE NOT external AND source <> target
  UNION ALL SELECT source, 0, 1 FROM edges WHERE NOT external AND source <> target),
coupled AS (
  SELECT label, sum(a)::BIGINT AS afferent, sum(e)::BIGINT AS efferent,
    CASE WHEN sum(a) + sum(e) = 0 THEN 0.0 ELSE sum(e)::DOUBLE / (sum(a) + sum(e)) END AS instability,
    (sum(a) + sum(e))::DOUBLE / (2.0 * ((SELECT count(*) FROM files) - 1))::DOUBLE AS coupling_factor
  FROM ends GROUP BY label)"""


@query("SELECT * FROM coupled WHERE label LIKE 'ASIA/%'", _COUPLING)
def coupling(spark, sf_dir):
    return metrics.coupling(_edges(spark, sf_dir), [[ASIA]])


@query("SELECT count(*) AS subjects, sum(afferent)::BIGINT AS total_afferent, sum(efferent)::BIGINT AS total_efferent, round(sum(instability) / count(*), 9) AS mean_instability, round(sum(coupling_factor) / count(*), 9) AS mean_coupling_factor FROM coupled", _COUPLING)
def coupling_summary(spark, sf_dir):
    found = metrics.coupling_summary(metrics.coupling(_edges(spark, sf_dir)))
    return found.withColumns({c: F.round(c, 9) for c in ("mean_instability", "mean_coupling_factor")})


@query("SELECT label, efferent AS measured FROM coupled WHERE NOT efferent <= 10", _COUPLING)
def metric_threshold(spark, sf_dir):
    return metrics.threshold(metrics.coupling(_edges(spark, sf_dir)), "efferent", "below_or_equal", 10)


@query("SELECT label, afferent * 10 + efferent AS weighted FROM coupled WHERE NOT (afferent * 10 + efferent < 100)", _COUPLING)
def custom_metric(spark, sf_dir):
    weighted = metrics.custom_metric(metrics.coupling(_edges(spark, sf_dir)), "weighted", F.col("afferent") * 10 + F.col("efferent"))
    return metrics.satisfy(weighted, F.col("weighted") < 100).select("label", "weighted")


@query("SELECT source, count(*) AS total, " + ", ".join(f"count(*) FILTER (kind = {v}) AS {k}" for k, v in (("zig_file", 1), ("zon_file", 2), ("named_module", 4), ("embedded_file", 64), ("root_module", 32))) + " FROM internal GROUP BY source")
def import_summary(spark, sf_dir):
    rows = tables.internal_references(spark, sf_dir).withColumn("kind_name", names_of(KINDS, F.col("kind")))
    return metrics.import_summary(rows, ["zig_file", "zon_file", "named_module", "embedded_file", "root_module"])


def _all_paths(pairs: str) -> str:
    """Elementary paths from their smallest node on, over pairs(a, b), and the cycles they close."""
    return f""", pairs AS ({pairs}),
paths AS (SELECT [a] AS p FROM (SELECT DISTINCT a FROM pairs)
  UNION ALL SELECT list_append(p, b) FROM paths JOIN pairs ON a = p[len(p)] WHERE b > p[1] AND NOT list_contains(p, b)),
loops AS (SELECT p FROM paths JOIN pairs ON pairs.a = p[len(p)] AND pairs.b = p[1] WHERE len(p) > 1)"""


_LOOPS = "SELECT CAST(len(p) AS BIGINT) AS length, array_to_string(list_append(p, p[1]), ' -> ') AS path FROM loops"
_REGION_PAIRS = "SELECT DISTINCT split_part(source, '/', 1) AS a, split_part(target, '/', 1) AS b FROM edges WHERE NOT external AND split_part(source, '/', 1) <> split_part(target, '/', 1)"


def _regions(spark, sf_dir):
    """The whole internal graph, projected on regions."""
    return slices.slice_edges(graph.per_internal_edge(_edges(spark, sf_dir)), lambda c: slices.by_regex(c, "^([^/]+)/"))


def _as_edges(projected):
    return projected.select(F.col("source_label").alias("source"), F.col("target_label").alias("target"))


@query(_LOOPS, _all_paths(_REGION_PAIRS))
def cycles_bounded(spark, sf_dir):
    """Cycles between regions: every reference is read, and the projection bounds their number."""
    return traversal.cycles(_as_edges(_regions(spark, sf_dir)))


@query("""SELECT cycle, step, source_label, target_label, count FROM (
  SELECT cycle, unnest(range(0, len(p)))::INTEGER AS step, p[step + 1] AS source_label, p[(step + 1) % len(p) + 1] AS target_label
  FROM (SELECT row_number() OVER (ORDER BY p) - 1 AS cycle, p FROM loops))
  JOIN (SELECT split_part(source, '/', 1) AS source_label, split_part(target, '/', 1) AS target_label, count(*) AS count FROM edges WHERE NOT external GROUP BY 1, 2) USING (source_label, target_label)""", _all_paths(_REGION_PAIRS))
def cycle_edges(spark, sf_dir):
    projected = settled(_regions(spark, sf_dir))  # read for the cycles and for their edges
    found = traversal.elementary_cycles(_as_edges(projected))
    return traversal.cycle_edges(found, projected).select("cycle", "step", "source_label", "target_label", "count")


_TWO = "(split_part({0}, '/', 2) = 'NATION_3' OR split_part({0}, '/', 2) = 'NATION_10')"


@query(_LOOPS, _all_paths(f"SELECT source AS a, target AS b FROM edges WHERE NOT external AND source <> target AND {_TWO.format('source')} AND {_TWO.format('target')}"))
def have_no_cycles(spark, sf_dir):
    return rules.have_no_cycles(_edges(spark, sf_dir), [[glob("*/NATION_3/**"), glob("*/NATION_10/**")]])


@query("""SELECT x.label, y.label AS component FROM (SELECT p.f, min(p.t) AS t FROM walk p JOIN walk q ON q.f = p.t AND q.t = p.f GROUP BY p.f)
  JOIN ids x ON x.i = f JOIN ids y ON y.i = t""", _STEPS + """,
ids AS (SELECT label, row_number() OVER (ORDER BY label) AS i FROM (SELECT a AS label FROM steps UNION SELECT b FROM steps)),
hops AS (SELECT x.i AS a, y.i AS b FROM steps JOIN ids x ON x.label = a JOIN ids y ON y.label = b),
walk AS (SELECT a AS f, b AS t FROM hops UNION SELECT f, b FROM walk JOIN hops ON a = t)""")
def scc_membership(spark, sf_dir):
    return traversal.strong_components(graph.per_internal_edge(_edges(spark, sf_dir)))


@query("""SELECT doc_id, strlen(coalesce(text, '')) AS bytes,
  len(string_split(coalesce(text, ''), chr(10))) - CASE WHEN coalesce(text, '') = '' OR text LIKE '%' || chr(10) THEN 1 ELSE 0 END AS source_lines,
  len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^ \\t\\r\\x0B\\f]'))) AS non_blank_lines FROM documents""")
def line_counts(spark, sf_dir):
    return metrics.line_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")


@query("""SELECT 'dependency' AS section_kind, 'Coupling' AS title, label, value FROM (
  SELECT count(*)::DOUBLE AS subjects, sum(afferent)::DOUBLE AS total_afferent, sum(efferent)::DOUBLE AS total_efferent,
    round(sum(instability) / count(*), 9) AS mean_instability, round(sum(coupling_factor) / count(*), 9) AS mean_coupling_factor FROM coupled)
  UNPIVOT (value FOR label IN (subjects, total_afferent, total_efferent, mean_instability, mean_coupling_factor))""", _COUPLING)
def report_sections(spark, sf_dir):
    return metrics.report_sections(coupling_summary(spark, sf_dir), "dependency", "Coupling")


@query("SELECT rule, count(*) AS violations FROM (SELECT 'names' AS rule FROM edges WHERE source = target AND NOT regexp_matches(source, '6$') UNION ALL SELECT 'folders' FROM edges WHERE source = target AND source LIKE 'ASIA/%' AND source LIKE '%/MACHINERY/%') GROUP BY rule")
def all_violations(spark, sf_dir):
    found = rules.all_violations({"names": have_name(spark, sf_dir), "folders": be_in_folder(spark, sf_dir)})
    return found.groupBy("rule").agg(F.count("*").alias("violations"))


@query("SELECT path, 'short names' AS description FROM files WHERE NOT length(path) < 42 AND path LIKE 'ASIA/%'")
def adhere_to(spark, sf_dir):
    found = rules.adhere_to(tables.files(spark, sf_dir), F.length("path") < 42, "short names", [[ASIA]])
    return found.select("path", "description")


@query("SELECT source, target, kinds FROM edges WHERE source = 'Nowhere' OR (source, target) = (SELECT (source, target) FROM edges WHERE external ORDER BY source, target LIMIT 1)")
def find_edge(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    at = edges.where("external").agg(F.min(F.struct("source", "target")).alias("at")).first()["at"]
    both = graph.find(edges, at["source"], at["target"]).union(graph.find(edges, "Nowhere", at["target"]))
    return both.select("source", "target", "kinds")


@query(", ".join(["SELECT source"] + [f"CASE WHEN bit_or(classes) & {1 << k} <> 0 THEN true ELSE false END AS {n}" for k, n in enumerate(CLASSES)]) + " FROM edges GROUP BY source")
def class_flags(spark, sf_dir):
    found = _edges(spark, sf_dir).groupBy("source").agg(F.bit_or("classes").alias("m"))
    return found.select("source", *[(F.col("m").bitwiseAND(1 << k) != 0).alias(n) for k, n in enumerate(CLASSES)])


@query("SELECT count(*) AS n FROM edges WHERE source = target AND NOT external AND source LIKE '%/BUILDING/%' AND source LIKE '%1'")
def count_selected(spark, sf_dir):
    chosen = rules.subjects(_edges(spark, sf_dir), [[glob("**/BUILDING/*1")]])
    return chosen.where(all_of([], F.col("path"))).agg(F.count("*").alias("n"))


# Scans: each customer's file as source text


@query("""SELECT source || '.zig' AS source, CASE WHEN kind = 64 AND okey % 2 = 1 THEN 'shared' ELSE '../../../' || target || '.zig' END AS target,
  CASE WHEN kind = 64 AND okey % 2 = 1 THEN 'named_module' WHEN kind = 64 THEN 'embedded_file' ELSE 'zig_file' END AS kind, kind = 4 AS in_test, count(*) AS n
  FROM internal WHERE kind IN (1, 4, 64) GROUP BY ALL""")
def scan_references(spark, sf_dir):
    rows = tables.source_files(spark, sf_dir)
    found = projects.drop_ignored(projects.references(rows), projects.directives(rows))
    return found.groupBy("source", "target", "kind", "in_test").agg(F.count("*").alias("n"))


@query("SELECT source || '.zig' AS path, count(*) AS n, count(*) FILTER (okey % 2 = 0) AS n_trailing FROM internal WHERE kind = 2 GROUP BY source")
def ignore_comments(spark, sf_dir):
    return projects.directives(tables.source_files(spark, sf_dir)).groupBy("path").agg(F.count("*").alias("n"), F.count_if("trailing").alias("n_trailing"))


@query("""SELECT source || '.zig' AS source, target || '.zig' AS target, false AS external, CAST(bit_or(kind) AS INTEGER) AS kinds, 1 AS classes, 1 AS availabilities, count(okey) AS n_locations FROM (
  SELECT source, target, kind, okey FROM internal WHERE kind = 1 UNION ALL SELECT path, path, 0, NULL FROM files)
  GROUP BY source, target
  UNION ALL SELECT source || '.zig', 'shared', true, 4, 2, 2, count(*) FROM internal WHERE kind = 64 AND okey % 2 = 1 GROUP BY source""")
def scan_graph(spark, sf_dir):
    found = projects.graph_of(tables.source_files(spark, sf_dir), include_resources=False, include_tests=False)
    return found.select("source", "target", "external", "kinds", "classes", "availabilities", F.size("locations").cast("long").alias("n_locations"))


_IN = "CASE WHEN {0} LIKE 'ASIA/%' THEN 'asia::' || substr({0}, 6) ELSE 'main::' || {0} END || '.zig'"


@query(f"""SELECT source, target, bool_or(external) AS external, CAST(bit_or(kind) AS INTEGER) AS kinds, CAST(bit_or(class) AS INTEGER) AS classes, CAST(bit_or(availability) AS INTEGER) AS availabilities FROM (
  SELECT {_IN.format('source')} AS source, CASE WHEN named AND sa THEN 'shared' WHEN named THEN (SELECT min({_IN.format('path')}) FROM files WHERE path LIKE 'ASIA/%')
      WHEN sa THEN '../../../' || target || '.zig' WHEN ta THEN 'main::' || target || '.zig' ELSE {_IN.format('target')} END AS target,
    CASE WHEN named THEN sa ELSE sa OR ta END AS external, CASE WHEN named THEN 4 WHEN kind = 64 THEN 64 ELSE 1 END AS kind,
    CASE WHEN named AND NOT sa THEN 1 WHEN named THEN 2 WHEN kind = 64 THEN 8 WHEN sa OR ta THEN 2 ELSE 1 END AS class, CASE WHEN named THEN 1 WHEN sa THEN 8 WHEN ta THEN 4 ELSE 1 END AS availability
  FROM (SELECT *, source LIKE 'ASIA/%' AS sa, target LIKE 'ASIA/%' AS ta, kind = 64 AND okey % 2 = 1 AS named FROM internal WHERE kind IN (1, 4, 64))
  UNION ALL SELECT {_IN.format('path')}, {_IN.format('path')}, false, 0, 1, 1 FROM files) GROUP BY source, target""")
def workspace_edges(spark, sf_dir):
    first = tables.files(spark, sf_dir).where(F.startswith("path", F.lit("ASIA/"))).agg(F.min(F.concat("path", F.lit(".zig")))).first()[0]
    packages = (workspaces.Package("main", "."), workspaces.Package("asia", "ASIA"))
    units = (
        workspaces.Unit("app", (workspaces.Module("shared", first.removeprefix("ASIA/"), "asia"),), "main"),
        workspaces.Unit("lib", (workspaces.Module("shared", "elsewhere", origin="package"),), "asia"),
    )
    return workspaces.graph_of(tables.source_files(spark, sf_dir), packages, units).drop("locations")


IGNORED = "# not ours\n\n/ASIA/NATION_8*\n  *7\nFURNITURE\nEUROPE/**/BUILDING/\n"


@query("""SELECT path FROM files WHERE NOT (path LIKE 'ASIA/NATION_8%' OR regexp_matches(path, '(^|/)[^/]*7(/|$)') OR path LIKE '%/FURNITURE/%' OR regexp_matches(path, '^EUROPE/(.*/)?BUILDING/'))""")
def ignore_file(spark, sf_dir):
    return projects.exclude(tables.files(spark, sf_dir).select("path"), projects.parse_ignore_file(IGNORED))


@query("SELECT path FROM files WHERE split_part(path, '/', 2) NOT IN (SELECT n_name FROM nation WHERE n_nationkey % 5 = 0)")
def nested_projects(spark, sf_dir):
    known = tables.files(spark, sf_dir).select("path")
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    nations = read("nation").where("n_nationkey % 5 = 0").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return projects.within_boundary(known, known.union(nations.select(F.concat_ws("/", "r_name", "n_name", F.lit("build.zig")))))


@query("""SELECT source, target, CASE WHEN NOT external THEN 1 WHEN k = 0 THEN 2 ELSE k END AS classes, CASE WHEN NOT external OR kinds & 24 <> 0 THEN 1 ELSE 2 END AS availabilities FROM (
  SELECT *, CASE WHEN kinds & 56 <> 0 THEN 4 ELSE 0 END + CASE WHEN kinds & 64 <> 0 THEN 8 ELSE 0 END + CASE WHEN kinds & 128 <> 0 THEN 16 ELSE 0 END + CASE WHEN kinds & 7 <> 0 THEN 2 ELSE 0 END AS k FROM edges)""")
def default_metadata(spark, sf_dir):
    classes, availabilities = projects.default_metadata(F.col("external"), F.col("kinds"))
    return _edges(spark, sf_dir).select("source", "target", classes.alias("classes"), availabilities.alias("availabilities"))


# Projections, metrics and reports beside those above

_NATION = "CASE WHEN {0} LIKE '%/%' THEN split_part({0}, '/', 2) END"


@query(f"""SELECT label, n AS source_file_count, afferent, efferent, CASE WHEN afferent + efferent = 0 THEN 0.0 ELSE efferent::DOUBLE / (afferent + efferent) END AS instability,
  (afferent + efferent)::DOUBLE / (2.0 * ((SELECT count(DISTINCT {_NATION.format('path')}) FROM files) - 1))::DOUBLE AS coupling_factor FROM (
  SELECT l AS label, count(*) AS n, (SELECT count(*) FROM np WHERE b = l) AS afferent, (SELECT count(*) FROM np WHERE a = l) AS efferent FROM (SELECT {_NATION.format('path')} AS l FROM files) GROUP BY l)""", f""",
np AS (SELECT DISTINCT {_NATION.format('source')} AS a, {_NATION.format('target')} AS b FROM edges WHERE NOT external AND {_NATION.format('source')} <> {_NATION.format('target')})""")
def projected_coupling(spark, sf_dir):
    return metrics.projected_coupling(_edges(spark, sf_dir), lambda c: slices.by_regex(c, "^[^/]+/([^/]+)/"))


@query(f"""SELECT l AS label, n * 1000 + (SELECT count(*) FROM np WHERE a = l) AS weighted FROM (SELECT {_NATION.format('path')} AS l, count(*) AS n FROM files GROUP BY l) WHERE l LIKE 'NATION_1%'""", f""",
np AS (SELECT DISTINCT {_NATION.format('source')} AS a, {_NATION.format('target')} AS b FROM edges WHERE NOT external AND {_NATION.format('source')} <> {_NATION.format('target')})""")
def projected_custom_metric(spark, sf_dir):
    """A metric of the caller's over projected subjects, as a pandas UDF, and the subjects that a predicate rejects."""

    @F.pandas_udf("long")
    def weigh(files: pd.Series, efferent: pd.Series) -> pd.Series:
        return files * 1000 + efferent

    found = metrics.projected_coupling(_edges(spark, sf_dir), lambda c: slices.by_regex(c, "^[^/]+/([^/]+)/"))
    weighted = metrics.custom_metric(found, "weighted", weigh("source_file_count", "efferent"))
    return metrics.satisfy(weighted, ~F.startswith("label", F.lit("NATION_1"))).select("label", "weighted")


@query("SELECT source AS source_label, target AS target_label, count(*) AS count, bool_and(external) AS external FROM edges WHERE source LIKE 'ASIA/%' AND NOT source LIKE '%/FURNITURE/%' AND (external OR (source <> target AND target LIKE 'ASIA/%' AND NOT target LIKE '%/FURNITURE/%')) GROUP BY source, target")
def slice_identity_except(spark, sf_dir):
    furniture = glob("**/FURNITURE/**")
    chosen = lambda c: F.when(ASIA.matches(c), normalize_path(c))
    return slices.slice_edges(_edges(spark, sf_dir), chosen, ~furniture.matches(F.col("source")) & (F.col("external") | ~furniture.matches(F.col("target"))))


_COUNTS = "SELECT sum(CAST(bytes AS DOUBLE)) AS bytes, sum(lines)::DOUBLE AS source_lines FROM (SELECT strlen(coalesce(text, '')) AS bytes, len(string_split(coalesce(text, ''), chr(10))) - CASE WHEN coalesce(text, '') = '' OR text LIKE '%' || chr(10) THEN 1 ELSE 0 END AS lines FROM documents)"


@query(f"""SELECT CAST(row_number() OVER (ORDER BY section_kind, title, label) - 1 AS BIGINT) AS position, * FROM (
  SELECT 'count' AS section_kind, 'Counts' AS title, label, value FROM ({_COUNTS}) UNPIVOT (value FOR label IN (bytes, source_lines))
  UNION ALL SELECT 'dependency', 'Coupling', label, value FROM (
  SELECT count(*)::DOUBLE AS subjects, sum(afferent)::DOUBLE AS total_afferent, sum(efferent)::DOUBLE AS total_efferent,
    round(sum(instability) / count(*), 9) AS mean_instability, round(sum(coupling_factor) / count(*), 9) AS mean_coupling_factor FROM coupled)
  UNPIVOT (value FOR label IN (subjects, total_afferent, total_efferent, mean_instability, mean_coupling_factor)))""", _COUPLING)
def comprehensive_report(spark, sf_dir):
    counts = line_counts(spark, sf_dir).agg(F.sum("bytes").alias("bytes"), F.sum("source_lines").alias("source_lines"))
    return ordering.numbered(metrics.comprehensive(counts, coupling_summary(spark, sf_dir)), *ordering.ORDERS["sections"])


_SENTENCE = 'project files, in path "{}" should have name "Customer#*6"'


@query(f"""SELECT CAST(row_number() OVER (ORDER BY sort_key, heading, details) - 1 AS BIGINT) AS position, * FROM (
  SELECT 'matching' AS kind, path AS sort_key, 'File pattern violation' AS heading, 'Rule: {_SENTENCE.format("ASIA/**")}' || chr(10) || 'File: ' || path AS details
  FROM files WHERE path LIKE 'ASIA/%' AND NOT regexp_matches(path, '6$')
  UNION ALL SELECT 'empty_test', 'names', 'Empty test violation', 'Rule: {_SENTENCE.format("ATLANTIS/**")}' || chr(10) || 'Rule id: names' || chr(10) || 'Reason: no files matched the rule scope' || chr(10) || 'Selectors: path glob "ATLANTIS/**" (exact)')""")
def violation_text(spark, sf_dir):
    """Two checks as text, in order: one with violations, one that the empty guard finds to select nothing."""
    edges, out = _edges(spark, sf_dir), []
    for selectors in ([[ASIA]], [[glob("ATLANTIS/**")]]):
        rule = violations.sentence(selectors, predicate='have name "Customer#*6"')
        found = violations.as_text(rules.have_field(edges, SIX, selectors), "matching", rule, "path", {"File": "path"})
        out.append(violations.checked(found, rules.subjects(edges, selectors), "names", rule, selectors=selectors))
    return ordering.numbered(out[0].unionByName(out[1]), *ordering.ORDERS["violations"])


@query("""SELECT CAST(dense_rank() OVER (ORDER BY component) - 1 AS BIGINT) AS position, component, count(*) AS n FROM (SELECT 0 AS x, min(a) AS component FROM pairs) JOIN (SELECT DISTINCT a FROM pairs) ON x = 0 GROUP BY component""", f", pairs AS ({_REGION_PAIRS})")
def component_order(spark, sf_dir):
    found = traversal.strong_components(_as_edges(_regions(spark, sf_dir))).groupBy("component").agg(F.count("*").alias("n"))
    return ordering.numbered(found, "component")


@query("""SELECT lang || '/' || coalesce(source, '') || '/' || doc_id || '.txt' AS path, CAST(doc_id AS VARCHAR) AS stem, '.txt' AS extension, lang || '/' || coalesce(source, '') AS directory, strlen(coalesce(text, '')) AS bytes,
  len(string_split(coalesce(text, ''), chr(10))) - CASE WHEN coalesce(text, '') = '' OR text LIKE '%' || chr(10) THEN 1 ELSE 0 END AS source_lines,
  len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^ \\t\\r\\x0B\\f]'))) AS non_blank_lines FROM documents""")
def file_view(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat("lang", F.lit("/"), F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return metrics.file_view(rows.select(path.alias("path"), F.col("text").alias("content")))


@query("""SELECT kind, heading, count(*) AS n, min(details) AS first_details FROM (
  SELECT 'matching' AS kind, 'File pattern violation' AS heading, 'Rule: project files, in path "ASIA/**" should match filename "Customer#*6"' || chr(10) || 'File: ' || path AS details FROM files WHERE path LIKE 'ASIA/%' AND NOT regexp_matches(path, '6$')
  UNION ALL SELECT 'empty_test', 'Empty test violation', 'Rule: project files, in path "ATLANTIS/**" should only depend on files, in path "ASIA/**"' || chr(10) || 'Rule id: files.depend_on_files' || chr(10) || 'Reason: no files matched the rule scope' || chr(10) || 'Selectors: path glob "ATLANTIS/**" (exact)'
  UNION ALL SELECT 'layer_dependency', 'Layer dependency violation', 'Rule: layers top, middle, base should hold their policies' || chr(10) || 'Dependency: ' || source || ' -> ' || target || chr(10) || 'Source layer: ' || source_layer || chr(10) || 'Target layer: ' || target_layer || chr(10) || 'Policy: may_only_depend_on_layers'
    FROM placed WHERE source_layer = 'top' AND target_layer = 'base'
  UNION ALL SELECT 'metric', 'Metric threshold violation', 'Rule: efferent should be below or equal 10' || chr(10) || 'Subject: ' || label || chr(10) || 'Expected: below or equal 10' || chr(10) || 'Actual: ' || efferent FROM coupled WHERE efferent > 10
  UNION ALL SELECT 'slice_dependency', 'Slice dependency violation', 'Rule: slices should not contain dependency "ASIA" -> "EUROPE"' || chr(10) || 'Dependency: ASIA -> EUROPE' || chr(10) || 'Edges: ' || count(*) FROM edges WHERE NOT external AND source LIKE 'ASIA/%' AND target LIKE 'EUROPE/%' HAVING count(*) > 0)
  GROUP BY kind, heading""", _PLACED + _COUPLING)
def checked_rules(spark, sf_dir):
    """Five checks together, one of which selects nothing: as many violations of each kind, and the first."""
    edges = kept(_edges(spark, sf_dir).select(*graph.EVIDENCE))  # normalized once for all rules
    found = checks.all_checks(
        checks.have_field(edges, SIX, [[ASIA]]),
        checks.depend_on_files(edges, [[glob("ATLANTIS/**")]], [[ASIA]]),
        checks.adhere_to_layers(edges, LAYERS, [layers.Policy("top", ("middle",))]),
        checks.threshold(metrics.coupling(edges), "efferent", "below_or_equal", 10),
        checks.contain_dependency(edges, lambda c: slices.by_regex(c, "^([^/]+)/"), "ASIA", "EUROPE", should=False),
    )
    return found.groupBy("kind", "heading").agg(F.count("*").alias("n"), F.min("details").alias("first_details"))


REGIONS, SEGMENTS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"), ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query("""SELECT path, CAST((right(path, 1) IN ('2', '4', '6', '8') AND path NOT LIKE '%7_') AS INTEGER) + CAST(right(path, 1) = substr(path, -2, 1) AS INTEGER) + CAST(path LIKE '%00%' AND path LIKE 'EUROPE/%' AS INTEGER) AS n_filters,
  CASE WHEN right(path, 1) IN ('2', '4', '6', '8') AND path NOT LIKE '%7_' THEN regexp_replace(path, '#.*', '#*') || right(path, 1)
    WHEN right(path, 1) = substr(path, -2, 1) THEN '**/*' || right(path, 2) ELSE '^EUROPE/.*00' END AS first_filter
  FROM files WHERE (right(path, 1) IN ('2', '4', '6', '8') AND path NOT LIKE '%7_') OR right(path, 1) = substr(path, -2, 1) OR (path LIKE '%00%' AND path LIKE 'EUROPE/%')""")
def many_patterns(spark, sf_dir):
    """2 511 filters on every file, most of them with an exclusion: how many select a file, and the first that does."""
    lists = [f"{r}/NATION_{n}/{s}/Customer#*{d}" for r in REGIONS for n in range(25) for s in SEGMENTS for d in (2, 4, 6, 8)]
    filters = [glob(g).excluding(glob("*7?", FILENAME)) for g in lists] + [glob(f"**/*{d}{d}") for d in range(10)] + [regex("^EUROPE/.*00")]
    found = selection.matching(tables.files(spark, sf_dir), filters).groupBy("path").agg(F.count("*").cast("int").alias("n_filters"), F.min("number").alias("number"))
    names = spark.createDataFrame([(k, f.source) for k, f in enumerate(filters)], "number int, first_filter string")
    return found.join(names, "number").drop("number")


@query("""SELECT * FROM (
  SELECT 'matching' AS kind, path AS sort_key, 'File pattern violation' AS heading, 'Rule: project files, in path "ASIA/**" should match filename "Customer#*6"' || chr(10) || 'File: ' || path AS details FROM files WHERE path LIKE 'ASIA/%' AND NOT regexp_matches(path, '6$')
  UNION ALL SELECT 'file_dependency', source, 'File dependency violation', 'Rule: project files, with name "Customer#*6" should only depend on files, in path "ASIA/**"' || chr(10) || 'File: ' || source || chr(10) || 'Dependencies: ' || string_agg(target, '|' ORDER BY target)
    FROM edges WHERE NOT external AND source <> target AND source LIKE '%6' AND target NOT LIKE 'ASIA/%' GROUP BY source
  UNION ALL SELECT 'empty_test', 'files.depend_on_files', 'Empty test violation', 'Rule: project files, in path "ATLANTIS/**" should only depend on files, in path "ASIA/**"' || chr(10) || 'Rule id: files.depend_on_files' || chr(10) || 'Reason: no files matched the rule scope' || chr(10) || 'Selectors: path glob "ATLANTIS/**" (exact)'
  UNION ALL SELECT 'external_dependency', source, 'External dependency violation', 'Rule: project files, in path "EUROPE/**" should not depend on external modules "*1"' || chr(10) || 'File: ' || source || chr(10) || 'Dependencies: ' || string_agg(target, '|' ORDER BY target)
    FROM edges WHERE external AND source <> target AND source LIKE 'EUROPE/%' AND regexp_matches(target, '^[^/]*1$') AND kinds & 4 <> 0 AND classes & 2 <> 0 AND availabilities <> 0 GROUP BY source
  UNION ALL SELECT 'layer_dependency', source, 'Layer dependency violation', 'Rule: layers top, middle, base should hold their policies' || chr(10) || 'Dependency: ' || source || ' -> ' || target || chr(10) || 'Source layer: ' || source_layer || chr(10) || 'Target layer: ' || target_layer || chr(10) || 'Policy: may_only_depend_on_layers'
    FROM placed WHERE source_layer = 'top' AND target_layer = 'base'
  UNION ALL SELECT 'slice_dependency', 'ASIA', 'Slice dependency violation', 'Rule: slices should not contain dependency "ASIA" -> "EUROPE"' || chr(10) || 'Dependency: ASIA -> EUROPE' || chr(10) || 'Edges: ' || count(*) FROM edges WHERE NOT external AND source LIKE 'ASIA/%' AND target LIKE 'EUROPE/%' HAVING count(*) > 0)""", _PLACED)
def one_scan_checks(spark, sf_dir):
    """Six row-wise rules, one of which selects nothing, from one scan of the edges: all violations."""
    return onescan.check(
        _edges(spark, sf_dir),
        onescan.have_field(SIX, [[ASIA]]),
        onescan.depend_on_files([[SIX]], [[ASIA]]),
        onescan.depend_on_files([[glob("ATLANTIS/**")]], [[ASIA]]),
        onescan.depend_on_external([glob("*1")], [[EUROPE]], should=False),
        onescan.adhere_to_layers(LAYERS, [layers.Policy("top", ("middle",))]),
        onescan.contain_dependency(lambda c: slices.by_regex(c, "^([^/]+)/"), "ASIA", "EUROPE", should=False),
    )
