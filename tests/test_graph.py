import itertools
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from edgeloom.errors import InvalidDiagram, InvalidLayer, InvalidOptions
from edgeloom.functions.patterns import collapse_folder, exact_file, glob, regex
from edgeloom.operators import checks, graph, layers, metrics, ordering, rules, slices, traversal, violations
from edgeloom.operators.components import components

REFERENCES = "source string, target string, external boolean, kind int, class int, availability int, location struct<byte_offset: bigint, line: bigint, column: bigint>"


def edges_of(spark, pairs, external=(), files=()):
    rows = [(a, b, False, 1, 1, 1, (i, i, 1)) for i, (a, b) in enumerate(pairs)] + [(a, b, True, 4, 2, 1, None) for a, b in external]
    listed = spark.createDataFrame([(f,) for f in files], "path string")
    return graph.normalize(spark.createDataFrame(rows, REFERENCES), listed)


def pairs(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_normalize_merges_parallel_references(spark):
    rows = [("a\\x", "b", False, 1, 1, 1, (5, 1, 1)), ("a/x", "b", False, 4, 2, 2, (2, 1, 1)), ("a/x", "b", False, 4, 2, 2, (2, 1, 1)), ("a/x", "b", False, 4, 2, 2, None)]
    found = graph.normalize(spark.createDataFrame(rows, REFERENCES)).collect()
    assert [(r.source, r.kinds, r.classes, r.availabilities, [x.byte_offset for x in r.locations]) for r in found] == [("a/x", 5, 3, 3, [2, 5])]
    at = graph.locations(spark.createDataFrame(rows, REFERENCES)).collect()
    assert sorted((r.source, r.target, r.location.byte_offset) for r in at) == [("a/x", "b", 2), ("a/x", "b", 5)]


def test_conflicting_externality_fails(spark):
    rows = [("a", "b", False, 1, 1, 1, None), ("a", "b", True, 1, 1, 1, None)]
    with pytest.raises(PySparkException):
        graph.normalize(spark.createDataFrame(rows, REFERENCES)).collect()


def test_empty_graph(spark):
    none = graph.normalize(spark.createDataFrame([], REFERENCES))
    assert layers.assign(none, []).count() == 0
    assert none.count() == graph.project_nodes(none).count() == graph.project_edges(none).count() == traversal.cycles(none).count() == 0
    assert traversal.strong_components(none).count() == 0
    assert metrics.coupling_summary(metrics.coupling(none)).first().subjects == 0
    assert rules.empty_guard(rules.subjects(none), "r").count() == 1
    assert rules.empty_guard(rules.subjects(none), "r", allow_empty=True).count() == 0


def test_isolated_nodes_stay_and_externals_are_opt_in(spark):
    edges = edges_of(spark, [("a", "b")], [("a", "std")], ["isolated", "a", "b"])
    assert pairs(graph.nodes(edges), "label") == [("a",), ("b",), ("isolated",)]
    assert pairs(graph.nodes(edges, True), "label")[-1] == ("std",)
    assert ("a", 0, 2, 1) in pairs(graph.project_nodes(edges), "label", "n_incoming", "n_outgoing", "n_outgoing_external")


def test_rules(spark):
    edges = edges_of(spark, [("app/a", "core/b"), ("app/a", "ui/c"), ("core/b", "core/d")], [("app/a", "std")], ["app/a", "core/b", "core/d", "ui/c"])
    app, core = [[glob("app/*")]], [[glob("core/*")]]
    assert pairs(rules.depend_on_files(edges, app, core), "source", "targets") == [("app/a", "ui/c")]
    assert pairs(rules.depend_on_files(edges, app, core, should=False), "source", "targets") == [("app/a", "core/b")]
    assert rules.depend_on_files(edges, [[glob("ui/*")]], core).count() == 0
    assert pairs(rules.depend_on_external(edges, [glob("other")], app), "source", "targets") == [("app/a", "std")]
    assert pairs(rules.file_dependencies(edges, app, core), "source", "target") == [("app/a", "ui/c")]
    assert pairs(rules.external_dependencies(edges, [glob("other")], app), "source", "target") == [("app/a", "std")]
    assert pairs(rules.have_field(edges, glob("core/*"), should=False), "path") == [("core/b",), ("core/d",)]


def random_graph(seed, n=14, per_node=2):
    """(nodes, pairs) of a random graph with two halves, some nodes of which stay alone."""
    r = random.Random(seed)
    names = [f"{'red' if k % 2 else 'blue'}/{k:02}" for k in range(n)]
    return names, sorted({(a, b) for a in names[: n - 2] for b in r.sample(names[: n - 2], per_node) if a != b})


def walk(pairs_, seeds, both=False, back=False, depth=99):
    steps = [(b, a) for a, b in pairs_] if back else list(pairs_)
    steps += [(b, a) for a, b in pairs_] if both else []
    known = set(seeds)
    for _ in range(depth):
        known |= {b for a, b in steps if a in known}
    return known


@pytest.mark.parametrize("seed", [1, 2])
def test_selection(spark, seed):
    names, pairs_ = random_graph(seed)
    edges = edges_of(spark, pairs_, [(names[0], "outside")], names)
    chosen = lambda *q: {r.label for r in traversal.select_nodes(edges, traversal.Options(tuple(q))).collect()}
    some, other = names[3], names[-1]
    for depth in (0, 1, 2):
        assert chosen(traversal.Query("focus", (glob(some),), depth)) == walk(pairs_, {some}, both=True, depth=depth)
    ahead, behind = walk(pairs_, {some}), walk(pairs_, {some}, back=True)
    assert chosen(traversal.Query("reachable", (glob(some),))) == ahead
    assert chosen(traversal.Query("dependents", (glob(some),)), traversal.Query("focus", (glob(other),), 3)) == behind | {other}
    assert chosen() == set(names)
    with pytest.raises(InvalidOptions):
        chosen(traversal.Query("focus", (glob("x"),), -1))


def test_snapshot(spark):
    names, pairs_ = random_graph(3)
    edges = edges_of(spark, pairs_, [(names[0], "outside")], names)
    nodes, merged, summary = traversal.snapshot(edges, traversal.Options(external=True, collapse=collapse_folder(F.col("label"), 1)))
    assert pairs(nodes, "id", "label") == [("n0", "blue"), ("n1", "outside"), ("n2", "red")]
    halves = [(a.split("/")[0], b.split("/")[0]) for a, b in pairs_]
    want = {(a, b, halves.count((a, b)), False) for a, b in halves if a != b} | {("blue", "outside", 1, True)}
    assert set(pairs(merged, "source_label", "target_label", "count", "external")) == want
    assert tuple(summary.first()) == (3, len(want), len(pairs_) + 1, 1)
    alone = traversal.snapshot(edges, traversal.Options((traversal.Query("focus", (glob(names[-1]),), 1),)))
    assert [alone[0].count(), alone[1].count()] == [1, 0]


def loops(pairs_):
    """All elementary cycles, by trying every sequence of nodes from its smallest on."""
    nodes, out = sorted({x for p in pairs_ for x in p}), set()
    for n in range(2, len(nodes) + 1):
        for path in itertools.permutations(nodes, n):
            if path[0] == min(path) and all(p in pairs_ for p in zip(path, path[1:] + path[:1], strict=True)):
                out.add(path)
    return out


@pytest.mark.parametrize("seed", [4, 5])
def test_cycles_and_components(spark, seed):
    r = random.Random(seed)
    pairs_ = {(a, b) for a in "abcdefg" for b in r.sample("abcdefg", 2) if a != b} | {("x", "y"), ("y", "x"), ("y", "a"), ("z", "z")}
    edges = edges_of(spark, sorted(pairs_))
    want = loops(pairs_)
    found = traversal.elementary_cycles(edges)
    assert {tuple(x.nodes) for x in found.collect()} == want
    assert {x.path for x in traversal.cycles(edges).collect()} == {" -> ".join([*p, p[0]]) for p in want}
    rows = traversal.cycle_edges(found, edges.select(F.col("source").alias("source_label"), F.col("target").alias("target_label"), "kinds")).collect()
    again = {}
    for x in sorted(rows, key=lambda x: (x.cycle, x.step)):
        again.setdefault(x.cycle, []).append((x.source_label, x.target_label))
    assert [tuple(a for a, _ in again[k]) for k in sorted(again)] == sorted(want)
    assert all(p in pairs_ for steps in again.values() for p in steps)
    reach = {x: walk(pairs_, {b for a, b in pairs_ if a == x}) for x in "abcdefgxyz"}
    strong = {x: min(y for y in reach if y == x or (y in reach[x] and x in reach[y])) for x in reach if any(x in reach[y] and y in reach[x] for y in reach if y != x)}
    assert dict(pairs(traversal.strong_components(edges), "label", "component")) == strong
    with pytest.raises(InvalidOptions):
        traversal.cycles(edges, limit=1)
    with pytest.raises(PySparkException):
        traversal.cycle_edges(found, edges.limit(0).select(F.col("source").alias("source_label"), F.col("target").alias("target_label"))).collect()


def test_components_of_links(spark, monkeypatch):
    from edgeloom.operators import components as module

    r = random.Random(8)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(900, 900 + k) for k in range(1, 90)] + [(k, k + 1) for k in range(500, 560)] + [(5, 5), (None, 7)]
    frame = spark.createDataFrame(links, "a long, b long")
    least = {}
    for a, b in links:
        if a is not None and a != b:
            least[a] = least[b] = None
    least = {x: x for x in least}
    for _ in range(400):
        for a, b in links:
            if a in least and b in least and a != b:
                least[a] = least[b] = min(least[a], least[b])
    assert dict(pairs(components(frame), "node", "component")) == least
    monkeypatch.setattr(module, "SMALL", 10)
    assert dict(pairs(components(frame), "node", "component")) == least
    assert components(frame.limit(0)).count() == 0


def test_selected_cycles(spark):
    edges = edges_of(spark, [("in/p", "out/q"), ("out/q", "in/p"), ("in/p", "in/r"), ("in/r", "in/p")], files=["in/p", "in/r", "out/q"])
    assert pairs(rules.have_no_cycles(edges, [[glob("in/*")]]), "path") == [("in/p -> in/r -> in/p",)]


def test_positions_and_orders(spark):
    r = random.Random(9)
    rows = [(r.choice("pqr"), r.randrange(50)) for _ in range(200)]
    found = ordering.numbered(spark.createDataFrame(rows, "label string, x int").repartition(7), "label").collect()
    assert [(x.label, x.x) for x in sorted(found, key=lambda x: x.position)] == sorted(rows) and sorted(x.position for x in found) == list(range(200))
    assert ordering.numbered(spark.createDataFrame([], "label string"), "label").count() == 0
    assert [x.label for x in ordering.ordered(spark.createDataFrame([("é",), ("z",), ("Z",), (None,)], "label string"), "nodes").collect()] == [None, "Z", "z", "é"]


def test_violations_as_text(spark):
    edges = edges_of(spark, [("app/a", "core/b")], files=["app/a", "core/b"])
    rule = violations.sentence([[glob("app/*"), glob("x").excluding(regex("y+"))]], should=False, predicate="be in folder \"app\"")
    assert rule == 'project files, in path ("app/*" or "x"), except in path regex "y+" should not be in folder "app"'
    found = violations.as_text(rules.have_field(edges, glob("app/*"), should=False), "matching", rule, "path", {"File": "path", "Note": F.lit(None).cast("string")})
    assert [tuple(x) for x in found.collect()] == [("matching", "app/a", "File pattern violation", f"Rule: {rule}\nFile: app/a")]
    assert violations.scope([[glob("a/*"), glob("b").excluding(regex("y+"))], [], [exact_file("z.zig")]]) == 'path glob "a/*" (exact) OR path glob "b" (exact) EXCEPT path regex "y+" (partial) AND path regex "z\\\\.zig" (exact)'
    guard = violations.empty_test(rules.subjects(edges, [[glob("gone/*")]]), "id", rule, [[glob("gone/*")]]).first().details
    assert guard.split("\n")[1:] == ["Rule id: id", "Reason: no files matched the rule scope", 'Selectors: path glob "gone/*" (exact)']
    assert violations.scope() == "unfiltered project scope"
    none = rules.subjects(edges, [[glob("gone/*")]])
    assert tuple(violations.result(violations.checked(found.limit(0), none, "id", rule)).first()) == (False, 1)
    assert tuple(violations.result(violations.checked(found.limit(0), none, "id", rule, allow_empty=True)).first()) == (True, 0)
    assert violations.checked(found, rules.subjects(edges), "id", rule).count() == 1
    with pytest.raises(InvalidOptions):
        violations.as_text(found, "other", rule, "sort_key", {})
    with pytest.raises(InvalidOptions):
        violations.as_text(found, "cycle", " ", "sort_key", {})


def test_cycles_limit_holds_for_strong_components_only(spark):
    acyclic = [(f"{a}", f"{b}") for a in range(4) for b in range(4, 9)]
    edges = edges_of(spark, [*acyclic, ("8", "x"), ("x", "y"), ("y", "x"), ("y", "z")])
    assert pairs(traversal.cycles(edges, limit=2), "path") == [("x -> y -> x",)]
    assert traversal.cycles(edges_of(spark, acyclic), limit=2).count() == 0


def test_every_check_has_the_guard(spark):
    edges = edges_of(spark, [("ui/a", "db/b"), ("db/b", "ui/a")], [("ui/a", "curses")], files=["ui/a", "db/b"])
    gone, label = [[glob("gone/*")]], lambda c: slices.by_regex(c, "^([a-z]+)/")
    stack = [layers.Layer("ui", (glob("ui/*"),)), layers.Layer("lost", (glob("lost/*"),))]
    empty = edges.limit(0)
    guarded = [
        lambda **k: checks.have_field(edges, glob("x"), gone, **k),
        lambda **k: checks.depend_on_files(edges, gone, [[glob("ui/*")]], **k),
        lambda **k: checks.depend_on_external(edges, [glob("x")], gone, **k),
        lambda **k: checks.have_no_cycles(edges, gone, **k),
        lambda **k: checks.adhere_to(edges.select(F.col("source").alias("path")), F.lit(False), "x", gone, **k),
        lambda **k: checks.adhere_to_layers(edges, stack, [layers.Policy("lost", ("ui",))], **k),
        lambda **k: checks.contain_dependency(empty, label, "ui", "db", should=False, **k),
        lambda **k: checks.adhere_to_diagram(empty, label, "@startuml\n@enduml", **k),
        lambda **k: checks.threshold(metrics.coupling(empty), "efferent", "below", 2, **k),
        lambda **k: checks.satisfy(metrics.coupling(empty), F.lit(True), "x", **k),
    ]
    for check in guarded:
        assert [r.kind for r in check().collect()] == ["empty_test"] and check(allow_empty=True).count() == 0
    found = checks.all_checks(
        checks.have_field(edges, glob("ui/*")),
        checks.depend_on_files(edges, [[glob("ui/*")]], [[glob("ui/*")]]),
        checks.depend_on_external(edges, [glob("curses")], should=False),
        checks.have_no_cycles(edges),
        checks.contain_dependency(edges, label, "db", "none"),
        checks.adhere_to_diagram(edges, label, "@startuml\n[ui] --> [db]\n@enduml", ignore_external=True),
        checks.threshold(metrics.coupling(edges), "efferent", "below", 1),
        checks.satisfy(metrics.coupling(edges), F.col("label") == "ui/a", "being a"),
    ).collect()
    assert sorted(r.kind for r in found) == ["cycle", "external_dependency", "file_dependency", "matching", "metric", "metric", "metric_predicate", "slice_dependency", "slice_dependency"]
    assert [(r.sort_key, r.heading, r.details) for r in found] == sorted((r.sort_key, r.heading, r.details) for r in found)
    with pytest.raises(InvalidOptions):
        checks.all_checks()


def test_layers(spark):
    edges = edges_of(spark, [("ui/a", "app/b"), ("app/b", "db/c"), ("db/c", "ui/a"), ("ui/a", "loose")], files=["ui/a"])
    stack = [layers.Layer(n, (glob(f"{n}/*"),)) for n in ("ui", "app", "db")]
    seen = lambda *p, **k: pairs(layers.check_layers(edges, stack, list(p), **k), "source", "target", "policy")
    assert seen(layers.Policy("db", ())) == [("db/c", "ui/a", "may_only_depend_on_layers")]
    assert seen(layers.Policy("app", ("db",), allow=False)) == [("app/b", "db/c", "may_not_depend_on_layers")]
    assert seen(strict=True) == [("ui/a", "loose", "unassigned_endpoint")]
    for bad in ([layers.Policy("app", (), allow=False)], [layers.Policy("none", ())], [layers.Policy("ui", ()), layers.Policy("ui", ("db",))]):
        with pytest.raises(InvalidLayer):
            layers.check_layers(edges, stack, bad)


def test_slices_and_diagrams(spark):
    edges = edges_of(spark, [("ui/menu", "data/store"), ("ui/form", "data/cache"), ("ui/menu", "ui/form"), ("start", "ui/menu")], [("ui/menu", "curses")])
    label = lambda c: slices.by_pattern(c, "(**)/")
    assert pairs(slices.slice_edges(edges, label), "source_label", "target_label", "count") == [("ui", "curses", 1), ("ui", "data", 2)]
    assert pairs(slices.slice_edges(edges, label, ~F.endswith("source", F.lit("form"))), "source_label", "target_label", "count") == [("ui", "curses", 1), ("ui", "data", 1)]
    assert pairs(slices.slice_labels(edges, label), "label") == [("data",), ("ui",)]
    assert slices.contain_dependency(edges, label, "ui", "data").count() == 0
    assert slices.contain_dependency(edges, label, "data", "ui").count() == 1
    text = slices.diagram_of(edges, label)
    assert slices.parse_diagram(text) == (["data", "ui"], [("ui", "data")])
    inside = graph.per_internal_edge(edges)
    assert slices.adhere_to_diagram(inside, label, text).count() == 0
    assert pairs(slices.adhere_to_diagram(edges, label, "@startuml\n[data] --> [ui]\n@enduml"), "source_label", "target_label", "rule") == [("data", "ui", "missing"), ("ui", "curses", "unexpected"), ("ui", "data", "unexpected")]
    assert slices.adhere_to_diagram(edges, label, text, ignore_external=True).count() == 0
    for bad in ("", "@startuml\n", "@startuml\np --> q\n@enduml", "@startuml\n???\n@enduml"):
        with pytest.raises(InvalidDiagram):
            slices.parse_diagram(bad)


def test_coupling(spark):
    names, pairs_ = random_graph(6)
    edges = edges_of(spark, pairs_, [(names[0], "outside")], names)
    found = {r.label: tuple(r)[1:] for r in metrics.coupling(edges).collect()}
    for x in names:
        ca, ce = sum(b == x for _, b in pairs_), sum(a == x for a, _ in pairs_)
        assert found[x] == (ca, ce, ce / (ca + ce) if ca + ce else 0.0, (ca + ce) / (2 * (len(names) - 1)))
    assert {r.label for r in metrics.threshold(metrics.coupling(edges), "efferent", "below", 2).collect()} == {x for x in names if found[x][1] >= 2}
    for bad in (("efferent", "below", 2.0), ("instability", "below", 1), ("efferent", "near", 2)):
        with pytest.raises(InvalidOptions):
            metrics.threshold(metrics.coupling(edges), *bad)


def test_projected_coupling(spark):
    names, pairs_ = random_graph(7)
    edges = edges_of(spark, pairs_, [(names[0], "outside")], names)
    found = {r.label: tuple(r)[1:] for r in metrics.projected_coupling(edges, lambda c: slices.by_regex(c, "^(red|blue)/")).collect()}
    assert found == {h: (7, 1, 1, 0.5, 1.0) for h in ("red", "blue")}
    label = lambda c: F.when(F.startswith(c, F.lit("red")), "red").otherwise("loose")
    part = edges.where("source != target OR source LIKE 'red%'")
    with pytest.raises(PySparkException):  # an internal edge ends at a label without a file
        metrics.projected_coupling(part, label).collect()


def test_projected_labels(spark):
    edges = edges_of(spark, [("ui/a", "data/b"), ("ui/c", "data/b"), ("ui/a", "ui/c")])
    top = lambda c: F.regexp_extract(F.col(c), "^([^/]+)", 1)
    assert pairs(graph.project_edges(edges, top("source"), top("target")), "source_label", "target_label", "n_evidence") == [("ui", "data", 2), ("ui", "ui", 1)]
    assert len(pairs(graph.evidence(edges, top("source"), F.when(top("target") == "data", "data")), "source")) == 2
    with pytest.raises(PySparkException):
        graph.project_edges(edges, F.lit(""), F.lit("x")).collect()


def test_line_counts(spark):
    rows = spark.createDataFrame([(1, "a\n\n b\n"), (2, ""), (3, None), (4, "x\r\n \t\ny")], "id int, t string")
    assert pairs(metrics.line_counts(rows, "id", "t"), "id", "source_lines", "non_blank_lines") == [(1, 3, 2), (2, 0, 0), (3, 0, 0), (4, 3, 2)]
