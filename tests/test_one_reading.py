import pytest
from pyspark import TaskContext

from edgeloom.functions.patterns import glob
from edgeloom.operators import metrics, rules, slices, traversal
from edgeloom.plans import catalog

EDGE = "source string, target string, external boolean, kinds int, classes int, availabilities int"
PAIRS = [("a/x", "a/x"), ("a/y", "a/y"), ("b/x", "b/x"), ("c/z", "c/z"), ("a/x", "a/y"), ("a/y", "a/x"), ("a/x", "b/x"), ("b/x", "a/y"), ("b/x", "std")]
by_folder = lambda c: slices.by_regex(c, "^([^/]+)/")
RUNS = {
    "reachable": lambda e: traversal.select_nodes(e, traversal.Options((traversal.Query("reachable", (glob("a/**"),)),))),
    "cycles": lambda e: traversal.cycles(e.where("NOT external")),
    "have_no_cycles": lambda e: rules.have_no_cycles(e, [[glob("a/**"), glob("b/**")]]),
    "coupling": lambda e: metrics.coupling(e),
    "projected_coupling": lambda e: metrics.projected_coupling(e, by_folder),
}


@pytest.mark.parametrize("name", RUNS)
def test_edges_are_made_once(spark, name):
    """Failed before: each use of the edges made them anew."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    edges = spark.createDataFrame([(a, b, b == "std", 1, 1, 1) for a, b in PAIRS], EDGE).coalesce(1)
    found = sorted(map(str, RUNS[name](edges.mapInArrow(count, EDGE)).collect()))
    assert found == sorted(map(str, RUNS[name](edges).collect()))
    assert seen.value == len(PAIRS)


def test_checked_rules_read_the_tables_once(spark):
    """Failed before: the plan of the answer read them once a rule and more."""
    assert "parquet" not in catalog.checked_rules(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_edges_keep_their_parts(spark):
    """Failed before: a task of the checkpoint made several parts of the edges, and held the sorts of all."""
    late = spark.sparkContext.accumulator(0)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def note(batches):
        late.add(int(TaskContext.get().partitionId() >= parts))
        yield from batches

    edges = spark.createDataFrame([(a, b, b == "std", 1, 1, 1) for a, b in PAIRS], EDGE).repartition(3 * parts)
    summary = traversal.snapshot(edges.mapInArrow(note, EDGE), traversal.Options(external=True))[2]
    assert late.value == 2 * parts
    assert summary.first().raw_edge_count == 5
