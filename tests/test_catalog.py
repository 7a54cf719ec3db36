import glob
import os

import duckdb
import pytest

from edgeloom.plans import catalog

SF = "/root/testdata/sf0.001"
SOME = [
    "normalize_edges", "edge_locations", "project_edges", "have_name", "depend_on_files_allow", "external_block", "external_categories", "layer_strict",
    "slice_pattern", "diagram_adherence", "focus_depth", "snapshot_edges", "coupling_summary", "line_counts",
    "reachable_from", "dependents_of", "scc_membership", "cycles_bounded", "cycle_edges", "have_no_cycles", "edge_evidence", "projected_coupling",
    "scan_references", "ignore_comments", "scan_graph", "workspace_edges", "ignore_file", "nested_projects", "default_metadata",
    "slice_identity_except", "comprehensive_report", "violation_text", "component_order", "adhere_to", "find_edge", "snapshot_nodes", "projected_custom_metric",
    "file_view", "checked_rules", "many_patterns", "one_scan_checks",
]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS FROM '{path}'")
    return con


def test_every_query_has_sql():
    assert set(catalog.Q) == set(catalog.SQL)


@pytest.mark.parametrize("name", SOME)
def test_same_rows_as_sql(spark, db, name):
    found = catalog.Q[name](spark, SF)
    wanted = db.sql(catalog.SQL[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    columns = sorted(found.columns)
    rows = lambda all_: sorted([tuple(str(round(x, 9) if isinstance(x, float) else x) for x in r) for r in all_])
    assert rows(tuple(r[c] for c in columns) for r in found.collect()) == rows(db.sql(f"SELECT {', '.join(columns)} FROM ({catalog.SQL[name]})").fetchall())


def _walk(start, follow):
    known, open_ = set(start), list(start)
    while open_:
        for x in follow.get(open_.pop(), set()) - known:
            known.add(x)
            open_.append(x)
    return known


def test_closures_and_components_of_the_whole_graph(spark, db):
    steps = db.sql(f"{catalog.SQL['normalize_edges'].rsplit('SELECT source, target, external', 1)[0]} SELECT source, target FROM edges WHERE NOT external").fetchall()
    ahead, back = {}, {}
    for a, b in steps:
        ahead.setdefault(a, set()).add(b)
        back.setdefault(b, set()).add(a)
    seeds = {a for a, b in steps if a == b and "/NATION_4/" in a}
    labels = lambda name: sorted(r.label for r in catalog.Q[name](spark, SF).collect())
    assert labels("reachable_from") == sorted(_walk(seeds, ahead))
    assert labels("dependents_of") == sorted(_walk(seeds, back))
    both = {x: _walk({x}, ahead) & _walk({x}, back) for x in ahead}
    want = {x: min(c) for x, c in both.items() if len(c) > 1}
    assert {r.label: r.component for r in catalog.Q["scc_membership"](spark, SF).collect()} == want
