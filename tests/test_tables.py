import re

import duckdb
import pytest

from edgeloom.operators import graph
from edgeloom.sources import tables

SF = "/root/testdata/sf0.001"


def copy_with(tmp_path, **changed):
    """The small tables, some of them selected anew."""
    for t in ("region", "nation", "customer", "part", "orders", "lineitem"):
        duckdb.sql(f"COPY ({changed.get(t, 'FROM here').replace('here', repr(f'{SF}/{t}.parquet'))}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    return str(tmp_path)


def plain(df):
    return sorted((tuple(map(str, r)) for r in df.collect()))


@pytest.mark.parametrize(
    "customer",
    [
        "FROM here",
        "SELECT * REPLACE ('Customer' AS c_name) FROM here",  # customers who share a path
        "FROM here WHERE c_custkey % 3 > 0 UNION ALL SELECT * REPLACE ('a//b' || chr(92) || 'c' AS c_name, NULL AS c_custkey) FROM here WHERE c_custkey % 3 = 0",
        "FROM here UNION ALL SELECT * REPLACE ('Again' AS c_name) FROM here WHERE c_custkey % 5 = 0",  # a key with two paths
    ],
)
def test_edges_by_number_are_those_by_name(spark, tmp_path, customer):
    at = copy_with(tmp_path, customer=customer)
    rows = tables.references(spark, at)
    assert plain(tables.edges(spark, at)) == plain(graph.normalize(rows, tables.files(spark, at)))
    places = {}
    for r in graph.locations(rows).collect():
        places.setdefault((r.source, r.target), []).append(r.location.byte_offset)
    assert plain(tables.location_counts(spark, at)) == sorted((*k, str(len(v)), str(min(v)), str(max(v))) for k, v in places.items())


def test_a_brand_named_like_a_file_meets_its_references(spark, tmp_path):
    name = "SELECT r_name || '/' || n_name || '/' || c_mktsegment || '/' || c_name FROM '{0}/customer.parquet' JOIN '{0}/nation.parquet' ON c_nationkey = n_nationkey JOIN '{0}/region.parquet' ON n_regionkey = r_regionkey WHERE c_custkey = 7".format(SF)
    at = copy_with(tmp_path, part=f"SELECT * REPLACE (CASE WHEN p_partkey % 40 = 3 THEN ({name}) ELSE p_brand END AS p_brand) FROM here")
    with pytest.raises(Exception, match="both internal and external"):
        tables.edges(spark, at).collect()


def test_references_are_merged_without_their_paths(spark):
    """Failed before: aggregations of references grouped by source and target, both of them paths."""
    plan = tables.edges(spark, SF).select("source", "target", "kinds")._jdf.queryExecution().optimizedPlan().toString()
    merges = [x.split("Aggregate [", 1)[1].split("]", 1)[0] for x in plan.splitlines() if "Aggregate [" in x]
    assert merges and not any("source" in keys or "path" in keys for keys in merges)


def test_parts_of_references_grow_with_the_tables(spark, monkeypatch):
    """Failed before: only the last join of references did, the others and the merge had as many parts as any shuffle."""
    monkeypatch.setattr(tables, "ROWS", 100)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = tables.edges(spark, SF).drop("locations")
        parts = re.findall(r"Exchange hashpartitioning\(.*, (\d+)\)", edges._jdf.queryExecution().executedPlan().toString())
        assert len(parts) > 6 and min(map(int, parts)) > int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert plain(edges) == plain(graph.normalize(tables.references(spark, SF), tables.files(spark, SF)).drop("locations"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
