import random

import pytest

from edgeloom.errors import InvalidPattern
from edgeloom.functions.patterns import FILENAME, FOLDER, NAME, any_of, exact_file, glob, regex
from edgeloom.operators import layers, selection
from pyspark.sql import functions as F


def _paths(r, n):
    word = lambda: "".join(r.choice("xyé.") for _ in range(r.randint(1, 3)))
    return ["/".join(word() for _ in range(r.randint(1, 4))) for _ in range(n)]


def _filters(r, n):
    out = []
    for _ in range(n):
        tokens = [r.choice(["x", "y", "é", ".", "/", "*", "**", "**/", "?", "[xy]", "[!x]"]) for _ in range(r.randint(1, 7))]
        kind = r.randrange(6)
        if kind < 4:
            out.append(glob("".join(tokens), [None, FILENAME, FOLDER, None][kind] or "path"))
        elif kind == 4:
            out.append(regex(r.choice(["^x", "y$", "^x/y$", "x.*y", "^x?y", r"\.x$", "^(x|y)/", "xy"]), exact=r.random() < 0.4))
        else:
            out.append(exact_file(r.choice(["x/y", "x", "y.x/x"])))
    return out


@pytest.mark.parametrize("levels", [1, 24])
def test_the_same_as_each_filter(spark, monkeypatch, levels):
    monkeypatch.setattr(selection, "LEVELS", levels)
    r = random.Random(levels)
    paths = [*_paths(r, 300), "", "x", None, "x/y", "x/y"]
    filters = _filters(r, 40)
    filters = [f.excluding(*r.sample(filters, r.choice([0, 0, 1, 2]))) for f in filters]
    filters.append(filters[0])
    frame = spark.createDataFrame([(p, k, k) for k, p in enumerate(paths)], "path string, number int, key int")
    one = frame.select("path", *[f.matches(F.col("path")).alias(f"m{k}") for k, f in enumerate(filters)]).collect()
    want = {(row.path, k) for row in one for k in range(len(filters)) if row[f"m{k}"]}
    found = [tuple(x) for x in selection.matching(frame, filters).collect()]
    assert len(found) == len(set(found)) and set(found) == want and want
    keys = lambda rows: sorted(x.key for x in rows.collect())
    assert keys(selection.select(frame, filters[:12])) == keys(frame.where(any_of(filters[:12], F.col("path"))))
    first = {}
    for path, k in want:
        first[path] = min(k, first.get(path, k))
    assert dict(map(tuple, selection.first_match(frame, filters).collect())) == first


def test_two_thousand_globs_are_no_two_thousand_regexes(spark):
    frame = spark.range(20_000).select(F.concat(F.lit("src/team"), (F.col("id") % 3000).cast("string"), F.lit("/a/f"), F.col("id").cast("string"), F.lit(".zig")).alias("path"))
    found = selection.matching(frame, [glob(f"src/team{k}/**") for k in range(1000)] + [glob(f"src/team{k}/*/f*.zig") for k in range(1000)])
    assert found._jdf.queryExecution().toString().upper().count("RLIKE") < 20
    assert found.count() == 2 * sum(k % 3000 < 1000 for k in range(20_000))


def test_layers_of_many_patterns(spark):
    edges = spark.createDataFrame([(p, p, False) for p in ("a/x", "a/y", "b/x", "c")], "source string, target string, external boolean")
    stack = [layers.Layer("one", (glob("a/x"), glob("b/*"))), layers.Layer("two", (glob("a/*"), glob("b/x")))]
    both = [sorted(map(str, f(edges, stack).collect())) for f in (layers.assign, layers.assign_many)]
    assert both[0] == both[1] and len(both[0]) == 4
    assert layers.assign_many(edges, []).where("layer IS NULL").count() == 4


def test_no_filters_no_paths_and_names(spark):
    none = spark.createDataFrame([], "path string")
    assert selection.matching(none, [glob("x")]).count() == 0
    assert selection.matching(spark.createDataFrame([("x",)], "path string"), []).count() == 0
    with pytest.raises(InvalidPattern):
        selection.matching(none, [glob("x", NAME)])
