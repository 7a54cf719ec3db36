import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from edgeloom.errors import InvalidOptions, InvalidPattern
from edgeloom.sources import projects, reports, workspaces
from edgeloom.streaming import references

TREE = {
    "src/main.zig": r"""const std = @import("std");
// @import("comment.zig")
const a = @import("api/a.zig"); const u = "http://x"; const b = @import("../up.zig");
const c = @import("../../far.zig"); // edgeloom: ignore other.zig
// edgeloom: ignore
const gone = @import("api/a.zig");
const also = @import("api/a.zig"); const kept = @import("../up.zig"); // edgeloom: ignore api/a.zig, x
const text =
    \\@import("in_text.zig")
;
const quoted = "@import(\"in_quotes.zig\")"; const char = '"';
test "é" { _ = @import("api/a.zig"); const é = @import("api/a.zig"); }
const after = @import("\x75p.zig");
/// edgeloom: ignore
const doc = @import("std");
""",
    "src/api/a.zig": '@embedFile("../data.bin") @import("data") @import("pkg") @import("root") @import("gone.zig") @cInclude("no.h") @cImport({ @cInclude("yes.h"); })',
    "src/data.bin": "x",
    "src/broken.zig": 'fn f() { @import("std");',
    "src/empty.zig": "",
    "up.zig": "\n",
    "build.zig.zon": "\n",
    "vendor/x.zig": '@import("std")',
    "tool/build.zig": "",
    "tool/src/t.zig": '@import("std")',
    "gen/made.zig": "",
    "gen/deep/made.zig": "",
    "notes.txt": "",
    ".archignore": "# made files\n\n  gen/**  \n",
}


@pytest.fixture
def root(tmp_path):
    for name, text in TREE.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    return f"file://{tmp_path}"


def test_listing(spark, root):
    paths = lambda **k: sorted(r.path for r in projects.files(spark, root, **k).collect())
    own = ["build.zig.zon", "src/api/a.zig", "src/broken.zig", "src/empty.zig", "src/main.zig", "up.zig"]
    assert paths() == own
    assert paths(exclusions=("api", "/u*.zig")) == [p for p in own if p not in ("src/api/a.zig", "up.zig")]
    assert paths(boundary=False) == sorted([*own, "tool/build.zig", "tool/src/t.zig"])
    assert paths(ignore_file=False) == sorted([*own, "gen/made.zig", "gen/deep/made.zig"])
    assert "vendor/x.zig" in paths(default=False)
    info = {r.path: tuple(r)[1:] for r in projects.file_info(projects.files(spark, root)).collect()}
    assert info["src/api/a.zig"][:3] == ("a", ".zig", "src/api") and info["up.zig"][2] == "" and info["src/empty.zig"][3] == 0


def test_boundaries_of_many_paths(spark):
    r = random.Random(4)
    names = ["a", "a!", "a-b", "b", "build", "é"]
    paths = sorted({"/".join([r.choice(names) for _ in range(r.choice((1, 2, 3, 5)))] + [r.choice(("x.zig", "y.zig", "build.zig") if r.random() < 0.05 else ("x.zig", "y.zig"))]) for _ in range(500)} | {"build.zig", "x.zig"})
    marked = {p.rpartition("/")[0] + "/" for p in paths if p.endswith("/build.zig")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.createDataFrame([(p, 1) for p in paths + paths[:3]], "path string, key int").repartition(3)
        kept = [x.path for x in projects.within_boundary(rows).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(kept) == sorted(p for p in paths + paths[:3] if not any(p.startswith(m) for m in marked)) and 50 < len(kept) < len(paths)
    assert projects.within_boundary(rows.limit(0)).count() == 0


def test_nearest_packages(spark):
    packages = workspaces.validate_packages((workspaces.Package("root", "."), workspaces.Package("ab", "a/b"), workspaces.Package("a", "a"), workspaces.Package("abc", "a/b-c")))
    rows = spark.createDataFrame([(p,) for p in ("x", "a/x", "a/b/x/y", "a/b-c/x", "a/bc", "b/a/x", "a")], "path string")
    got = {x.path: (x.package, x.inner) for x in workspaces.assign(rows, packages).collect()}
    assert got == {"x": ("root", "x"), "a/x": ("a", "x"), "a/b/x/y": ("ab", "x/y"), "a/b-c/x": ("abc", "x"), "a/bc": ("a", "bc"), "b/a/x": ("root", "b/a/x"), "a": ("root", "a")}
    assert {x.path for x in workspaces.assign(rows, packages[:1]).collect()} == {"a/x", "a/b/x/y", "a/b-c/x", "a/bc"}


@pytest.mark.parametrize("descent", [64, 1])
def test_folders_that_are_left_out_are_not_opened(spark, root, tmp_path, monkeypatch, descent):
    monkeypatch.setattr(projects, "DESCENT", descent)
    opened = lambda **k: {r.path for r in projects.tree(spark, root, **k).where("opened").collect()}
    assert opened() == {"src", "src/api", "vendor", "tool", "tool/src", "gen", "gen/deep"}
    assert opened(default=True, boundary=True, exclusions=("gen",)) == {"src", "src/api", "tool"}
    seen = projects.tree(spark, root, default=True, boundary=True, exclusions=("/src/a*",)).collect()
    assert {r.path for r in seen if r.is_folder and not r.opened} == {"vendor", "tool/src", "src/api"}
    assert not [r for r in seen if r.path.startswith(("vendor/", "tool/src/", "src/api/"))]
    (tmp_path / "src" / "_made.zig").write_text("")
    assert "src/_made.zig" in {r.path for r in projects.files(spark, root).collect()}
    (tmp_path / "src" / "vendored.zig").write_text('@import("../vendor/x.zig") @import("../vendor/none.zig") @import("../tool/src/t.zig")')
    got = {r.target: (r.external, r.availabilities) for r in projects.project_graph(spark, root).where("source = 'src/vendored.zig' AND source != target").collect()}
    assert got == {"vendor/x.zig": (False, 1), "vendor/none.zig": (True, 4), "tool/src/t.zig": (False, 1)}


def test_links_are_passed_over(spark, root, tmp_path):
    (tmp_path / "src" / "linked.zig").symlink_to(tmp_path / "up.zig")
    (tmp_path / "also").symlink_to(tmp_path / "src")
    assert not [r.path for r in projects.files(spark, root).collect() if "linked" in r.path or r.path.startswith("also")]
    assert projects.listing(spark, root).where("path LIKE 'also/%'").count() == 0


@pytest.mark.parametrize(
    ("pattern", "gone"),
    [
        ("made.zig", {"gen/made.zig", "gen/deep/made.zig"}),
        ("deep", {"gen/deep/made.zig"}),
        ("/gen", {"gen/made.zig", "gen/deep/made.zig", "gen/keep"}),
        ("gen/*/", {"gen/deep/made.zig"}),
        ("gen\\made.zig", {"gen/made.zig"}),
        ("**/deep/**", {"gen/deep/made.zig"}),
        ("ge", set()),
    ],
)
def test_exclusions(spark, pattern, gone):
    paths = ["gen/made.zig", "gen/deep/made.zig", "gen/keep", "general"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {p for p in paths} - {r.path for r in projects.exclude(rows, [pattern]).collect()} == gone


def test_ignore_files():
    assert projects.parse_ignore_file(" # x\r\n\t a/b \r\n\n*.gen") == ("a/b", "*.gen")
    for bad in ("!keep", "/", "a/../b", "./a", "//x", "a[z-b]"):
        with pytest.raises(InvalidPattern):
            projects.parse_ignore_file(bad)


def test_references(spark, root):
    rows = projects.files(spark, root)
    content = TREE["src/main.zig"].encode()
    refs = projects.references(rows).collect()
    mine = [r for r in refs if r.source == "src/main.zig"]
    for r in mine:
        assert content[r.location.byte_offset :].startswith(b"@import(")
        line = content[: r.location.byte_offset].split(b"\n")
        assert (r.location.line, r.location.column) == (len(line), len(line[-1]) + 1)
    assert len({r.location.byte_offset for r in mine}) == len(mine) == 11
    assert [r.in_test for r in mine].count(True) == 2 and {r.target for r in mine} == {"std", "api/a.zig", "../up.zig", "../../far.zig", "up.zig"}
    assert {r.target for r in refs if r.source == "src/api/a.zig"} == {"../data.bin", "data", "pkg", "root", "gone.zig", "yes.h"}
    assert not [r for r in refs if r.source in ("src/broken.zig", "src/empty.zig")]
    with pytest.raises(PySparkException):
        projects.references(rows, strict=True).collect()
    kept = projects.drop_ignored(projects.references(rows), projects.directives(rows))
    assert sorted((r.location.line, r.target) for r in kept.where("source = 'src/main.zig'").collect()) == [(1, "std"), (3, "../up.zig"), (3, "api/a.zig"), (4, "../../far.zig"), (7, "../up.zig"), (12, "api/a.zig"), (12, "api/a.zig"), (13, "up.zig"), (15, "std")]
    assert projects.option_filters(kept, include_resources=False, include_c=False, include_tests=False).count() == kept.count() - 4
    bad = spark.createDataFrame([("x.zig", b"// edgeloom ignore")], "path string, content binary")
    with pytest.raises(PySparkException):
        projects.directives(bad).collect()
    nothing = spark.createDataFrame([("x.zig", None), ("y.zig", b"")], "path string, content binary")
    assert projects.references(nothing).count() == projects.directives(nothing).count() == 0


def test_one_pass_gives_the_same_references(spark, root):
    rows = projects.files(spark, root)
    columns = ("source", "target", "kind", "location", "last_line", "in_test")
    plain = projects.drop_ignored(projects.references(rows), projects.directives(rows)).select(*columns)
    assert sorted(map(str, projects.kept_references(projects.scan(rows)).select(*columns).collect())) == sorted(map(str, plain.collect()))
    with pytest.raises(PySparkException):
        projects.scan(rows, strict=True).collect()
    assert projects.scan(rows.limit(0)).count() == 0


def test_a_rescan_tokenizes_new_contents_only(spark, root, tmp_path):
    first = projects.files(spark, root)
    table = projects.cut(projects.content_table(first))
    again = lambda: projects.files(spark, root)
    assert projects.new_contents(again(), table).count() == 0
    edges = lambda t=None: sorted(map(str, projects.project_graph(spark, root, table=t).collect()))
    assert edges(table) == edges()
    (tmp_path / "src" / "api" / "a.zig").rename(tmp_path / "src" / "api" / "moved.zig")
    assert projects.new_contents(again(), table).count() == 0 and edges(table) == edges()
    (tmp_path / "up.zig").write_text('@import("src/main.zig")')
    (tmp_path / "copy.zig").write_text('@import("src/main.zig")')
    (tmp_path / "src" / "empty.zig").unlink()
    assert [bytes(r.content) for r in projects.new_contents(again(), table).collect()] == [b'@import("src/main.zig")']
    assert edges(table) == edges()


def test_project_graph(spark, root):
    aliases = spark.createDataFrame([("data", "up.zig"), ("pkg", None)], "alias string, path string")
    edges = projects.project_graph(spark, root, aliases)
    got = {(r.source, r.target): (r.external, r.classes, r.availabilities) for r in edges.collect()}
    assert got[("src/main.zig", "src/api/a.zig")] == (False, 1, 1) and got[("src/main.zig", "up.zig")] == (False, 1, 1)
    assert got[("src/main.zig", "../../far.zig")] == (True, 2, 8) and got[("src/api/a.zig", "src/api/gone.zig")] == (True, 2, 4)
    assert got[("src/api/a.zig", "src/data.bin")] == (False, 8, 1) and got[("src/api/a.zig", "up.zig")] == (False, 1, 1)
    assert got[("src/api/a.zig", "pkg")] == (True, 2, 1) and got[("src/api/a.zig", "root")] == (True, 4, 2)
    assert got[("src/api/a.zig", "yes.h")] == (True, 16, 2) and got[("src/main.zig", "src/up.zig")] == (True, 2, 4)
    assert {a for a, b in got if a == b} == {"src/api/a.zig", "src/broken.zig", "src/empty.zig", "src/main.zig", "up.zig"}
    units = spark.createDataFrame([("one", "src/main.zig"), ("two", "elsewhere.zig")], "unit string, root string")
    of_unit = aliases.selectExpr("'two' AS unit", "alias", "path")
    found = {(r.source, r.target): r.availabilities for r in projects.project_graph(spark, root, of_unit, units).collect()}
    assert found[("src/api/a.zig", "pkg")] == found[("src/api/a.zig", "data")] == 2  # of two units, neither is a's
    found = {(r.source, r.target): r.availabilities for r in projects.project_graph(spark, root, of_unit, units.where("unit = 'two'")).collect()}
    assert found[("src/api/a.zig", "pkg")] == found[("src/api/a.zig", "up.zig")] == 1


def test_modules(spark):
    rows = [("named_module", None, None, None, None), ("named_module", True, "package", None, None), ("named_module", True, "project", "a", True), ("named_module", True, "project", "a", False), ("named_module", True, "project", None, None), ("standard_library", False, None, None, None), ("root_module", False, None, None, None)]
    frame = spark.createDataFrame(rows, "kind string, declared boolean, origin string, mapped string, listed boolean")
    status = projects.module_status(F.col("kind"), F.coalesce("declared", F.lit(False)), F.col("origin"), F.col("mapped"), F.coalesce("listed", F.lit(False)))
    found = frame.withColumn("status", status)
    assert [r.status for r in found.collect()] == ["unresolved", "resolved_package", "resolved_project", "missing", "outside_project", "compiler_provided", "unresolved"]
    got = found.select(*[c.alias(n) for c, n in zip(projects.classify_module(F.col("kind"), F.col("status")), "cae", strict=True)])
    assert [tuple(r) for r in got.collect()] == [("external", "unresolved", True), ("external", "resolved", True), ("internal", "resolved", False), ("external", "missing", True), ("external", "outside_project", True), ("compiler", "resolved", True), ("compiler", "unresolved", True)]


WORKSPACE = {
    "build.zig.zon": "", "src/all.zig": '@import("core")', "core/build.zig.zon": "", "core/src/base.zig": '@import("more.zig")', "core/src/more.zig": '@import("../../app/src/run.zig")', "core/out/x.zig": "", "core/.archignore": "out/",
    "app/build.zig.zon": "", "app/src/run.zig": '@import("core") @import("std")', "app/src/old.zig": "",
}


def test_workspaces(spark, tmp_path):
    for name, text in WORKSPACE.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    assert [p.id for p in workspaces.discover(projects.listing(spark, f"file://{tmp_path}"))] == ["app", "core", "root"]
    units = (workspaces.Unit("app", (workspaces.Module("core", "src/base.zig", "core"),), "app", "src/run.zig"), workspaces.Unit("other", (), "app"), workspaces.Unit("all", (workspaces.Module("core", "src/none.zig"),), "root"))
    found = workspaces.workspace_graph(spark, f"file://{tmp_path}", units=units, exclusions=("app::src/old.zig",))
    got = {(r.source, r.target): (r.external, r.availabilities) for r in found.collect()}
    own = ["app::src/run.zig", "core::src/base.zig", "core::src/more.zig", "root::src/all.zig"]
    assert got == {(x, x): (False, 1) for x in own} | {
        ("app::src/run.zig", "core::src/base.zig"): (False, 1),
        ("app::src/run.zig", "std"): (True, 1),
        ("core::src/base.zig", "core::src/more.zig"): (False, 1),
        ("core::src/more.zig", "../../app/src/run.zig"): (True, 8),
        ("root::src/all.zig", "core"): (True, 4),
    }
    two = workspaces.workspace_graph(spark, f"file://{tmp_path}", (workspaces.Package("c", "core/"),))
    assert {r.source for r in two.collect()} == {"c::src/base.zig", "c::src/more.zig"}


def test_workspace_options_are_checked():
    P, U, M = workspaces.Package, workspaces.Unit, workspaces.Module
    for bad in ((), (P("", "a"),), (P("a::b", "a"),), (P("a", "x"), P("a", "y")), (P("a", "x"), P("b", "x/"))):
        with pytest.raises(InvalidOptions):
            workspaces.validate_packages(bad)
    for bad in ((U(""),), (U("a"), U("a")), (U("a", (M("std", "x"),)),), (U("a", (M("m", "x"), M("m", "y"))),), (U("a", (M("m", ""),)),), (U("a", (M("m", "x", "p", "package"),)),), (U("a", package=""),)):
        with pytest.raises(InvalidOptions):
            workspaces.validate_units(bad)


def test_reports(spark, tmp_path):
    nodes = spark.createDataFrame([("n0", 'a"b'), ("n1", "c")], "id string, label string")
    edges = spark.createDataFrame([('a"b', "c", 2, True, 1 | 64, 8, 1)], "source_label string, target_label string, count long, external boolean, kinds int, classes int, availabilities int")
    text = lambda lines: "\n".join(r.line for r in lines.orderBy("part", "label").collect())
    assert text(reports.dot(nodes, edges, "t")) == 'digraph dependencies {\n  rankdir=LR;\n  label="t";\n  labelloc=t;\n  "a\\"b";\n  "c";\n  "a\\"b" -> "c" [label="2", style=dashed, color="#2563eb", tooltip="zig_file, embedded_file"];\n}'
    assert text(reports.d2(nodes, edges, "t\nu")) == '# t u\n"a\\"b"\n"c"\n"a\\"b" -> "c": "2" { style.stroke-dash: 4; style.stroke: "#2563eb" }'
    assert text(reports.mermaid(nodes, edges, "t")) == '%% t\nflowchart LR\n  n0["a&quot;b"]\n  n1["c"]\n  n0 -.->|2| n1'
    assert text(reports.csv(nodes, edges)).split("\n")[1] == '"a""b",c,2,true,"zig_file|embedded_file","resource","resolved"'
    assert '"kinds":["zig_file","embedded_file"]' in text(reports.json_lines(nodes, edges))
    document = "\n".join(r.line for r in reports.json_document(nodes, edges, spark.createDataFrame([(2, 1, 2, 2)], "node_count long, edge_count long, raw_edge_count long, external_edge_count long"), 't"').orderBy("part", "label").collect())
    edge = {"source": 'a"b', "target": "c", "count": 2, "external": True, "import_kinds": ["zig_file", "embedded_file"], "target_classes": ["resource"], "target_availabilities": ["resolved"]}
    whole = {"title": 't"', "nodes": [{"id": "n0", "label": 'a"b'}, {"id": "n1", "label": "c"}], "edges": [edge], "summary": {"node_count": 2, "edge_count": 1, "raw_edge_count": 2, "external_edge_count": 2}}
    assert document == json.dumps(whole, indent=2)
    none = spark.createDataFrame([(0, 0, 0, 0)], "node_count long, edge_count long, raw_edge_count long, external_edge_count long")
    assert json.loads("\n".join(r.line for r in reports.json_document(nodes.limit(0), edges.limit(0), none).orderBy("part", "label").collect()))["edges"] == []
    with pytest.raises(PySparkException):
        reports.mermaid(nodes.where("id = 'n0'"), edges, "t").collect()
    reports.write(reports.csv(nodes, edges), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 2


def test_streaming_edges(spark, tmp_path):
    schema = "source string, target string, external boolean, kind int, class int, availability int"
    seen = []
    for k in range(2):
        spark.createDataFrame([("a", "b", False, 1 << k, 1, 1)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = references.watch(stream, lambda e: e.where(F.col("kinds") == 3), lambda v, k: seen.extend(v.collect()), str(tmp_path / "at"))
    query.processAllAvailable()
    query.stop()
    assert [(r.source, r.target, r.references) for r in seen] == [("a", "b", 2)]
