import random

import pytest

from edgeloom.errors import InvalidOptions
from edgeloom.functions.patterns import FILENAME, FOLDER, glob, regex
from edgeloom.operators import checks, layers, onescan, slices
from edgeloom.operators.components import cut
from pyspark.sql import functions as F

SCHEMA = "source string, target string, external boolean, kinds int, classes int, availabilities int, key string, n long"
STACK = [layers.Layer("ui", (glob("ui/**"),)), layers.Layer("db", (glob("db/**"), regex("sql"))), layers.Layer("lost", (glob("lost/*"),))]


def _label(c):
    return slices.by_regex(c, "^([^/]+)/")


def _edges(r):
    files = [f"{r.choice(['ui', 'db', 'core'])}/{r.choice(['a', 'b'])}/{k}{r.choice(['.zig', 'sql'])}" for k in range(25)] + ["main"]
    rows = {(f, f, False) for f in files}
    rows |= {(r.choice(files), r.choice(files), False) for _ in range(120)}
    rows |= {(r.choice(files), r.choice(["std", "curses", "zlib"]), True) for _ in range(40)}
    return [(*row, r.choice([4, 8, 64]), r.choice([2, 4, 8]), r.choice([1, 2, 4]), "k", 1) for row in sorted(rows)]


#: name of a check, its arguments, and those by name.
CASES = [
    ("have_field", (glob("*.zig", FILENAME),), {}),
    ("have_field", (glob("ui/*", FOLDER), [[glob("db/**"), glob("ui/**").excluding(glob("*1*", FILENAME))]]), {"should": False}),
    ("have_field", (glob("x"), [[glob("none/**")]]), {}),
    ("have_field", (glob("x"), [[glob("none/**")]]), {"allow_empty": True}),
    ("depend_on_files", ([[glob("ui/**")]], [[glob("ui/**"), glob("main")]]), {}),
    ("depend_on_files", ([], [[glob("db/**")], [regex("sql")]]), {"should": False}),
    ("depend_on_files", ([[glob("none")]], []), {}),
    ("depend_on_external", ([glob("std")], [[glob("ui/**")]]), {}),
    ("depend_on_external", ([glob("z*")],), {"should": False, "categories": ("package_module", "compiler_module")}),
    ("depend_on_external", ([glob("z*")], [[glob("none")]]), {}),
    ("adhere_to_layers", (STACK, [layers.Policy("ui", ("db",)), layers.Policy("db", ("ui",), allow=False), layers.Policy("lost", ())]), {}),
    ("adhere_to_layers", (STACK, [layers.Policy("lost", ())]), {"strict": True, "allow_empty": True}),
    ("contain_dependency", (_label, "ui", "db"), {"should": False}),
    ("contain_dependency", (_label, "db", "none"), {}),
    ("contain_dependency", (_label, "ui", "db"), {}),
    ("contain_dependency", (_label, "core", "zlib"), {"should": False}),
]


def _rows(frame):
    return [(x.sort_key, x.heading, x.details, x.kind) for x in frame.collect()]


@pytest.mark.parametrize("n_edges", [None, 0, 1])
def test_the_same_as_the_checks_one_by_one(spark, monkeypatch, n_edges):
    monkeypatch.setattr(onescan, "_BITS", 5)
    edges = cut(spark.createDataFrame(_edges(random.Random(4))[:n_edges], SCHEMA))
    if n_edges == 1:
        edges = cut(edges.select("source", F.col("source").alias("target"), *edges.columns[2:]))
    want = _rows(checks.all_checks(*[getattr(checks, name)(edges, *args, **named) for name, args, named in CASES]))
    found = onescan.check(edges, *[getattr(onescan, name)(*args, **named) for name, args, named in CASES])
    assert found._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 1  # before it has run, when the plan is shown once
    assert _rows(found) == want and want


def test_repeated_rules_and_none(spark):
    edges = spark.createDataFrame(_edges(random.Random(1)), SCHEMA)
    rule = onescan.have_field(glob("*.zig", FILENAME))
    once = _rows(onescan.check(edges, rule))
    assert _rows(onescan.check(edges, rule, rule)) == sorted(once * 2)
    with pytest.raises(InvalidOptions):
        onescan.check(edges)
