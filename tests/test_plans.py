"""Plan-shape guards for scale: no cartesian products, pushed-down filters,
map-side top-k, and every broadcast side bounded."""

import contextlib
import io

import pytest

import __spark_entry__ as E
from civicflow.plans import catalog
from fixture_tables import SMALL

# the library's own queries; those of the llm subpackage are tested in tests/llm
QUERIES = {n: f for n, f in E.queries().items() if n in catalog.QUERIES}


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("m02")))
def test_no_cartesian_or_nested_loop(spark, name):
    p = plan(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p


def test_date_filter_pushed_to_scan(spark):
    p = plan(QUERIES["p04_raw_date_filter"](spark, SMALL))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts," in p


def test_event_names_top_k_is_map_side(spark):
    p = plan(QUERIES["a09_events_by_date"](spark, SMALL))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_scan_prunes_columns(spark):
    p = plan(QUERIES["a11_category_counts"](spark, SMALL))
    assert "ReadSchema: struct<event_type:string>" in p


REDUCERS = ("HashAggregate", "ObjectHashAggregate", "SortAggregate", "TakeOrderedAndProject")
BOUNDED_SOURCES = ("Range", "LocalTableScan")


def _tree(plan_text: str):
    """(depth, operator) per line of the physical plan tree."""
    lines = plan_text.split("== Physical Plan ==")[1].strip("\n").splitlines()
    nodes = []
    for i, line in enumerate(lines):
        idx = line.find("+- ")
        if idx >= 0:
            depth, body = idx // 3 + 1, line[idx + 3:]
        elif i == 0:
            depth, body = 0, line.strip()
        else:
            continue
        op = body.split("(")[0].split(" ")[0].strip("*").strip()
        nodes.append((depth, op, body))
    return nodes


def _paths_reach_raw_scan(nodes, start, reducers=REDUCERS):
    """True if some path below ``nodes[start]`` reaches a file scan with no reducer on the way."""
    depth0 = nodes[start][0]
    stack = []          # reducer seen on the path to each open depth
    for d, op, body in nodes[start + 1:]:
        if d <= depth0:
            break
        while stack and stack[-1][0] >= d:
            stack.pop()
        reduced = (stack[-1][1] if stack else False) or op in reducers
        stack.append((d, reduced))
        if "Scan" in op and op not in BOUNDED_SOURCES and not any(b in body for b in BOUNDED_SOURCES):
            if not reduced:
                return True
    return False


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("m02")))
def test_single_partition_exchanges_only_see_reduced_rows(spark, name):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        QUERIES[name](spark, SMALL).explain("extended")
    nodes = _tree(buf.getvalue())
    for i, (_, op, body) in enumerate(nodes):
        if op == "Exchange" and "SinglePartition" in body:
            assert not _paths_reach_raw_scan(nodes, i), f"raw rows reach a single task: {body[:80]}"


def test_single_partition_checker_catches_raw_rows(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    from civicflow.sources.tables import read_table
    bad = read_table(spark, SMALL, "events").withColumn("rn", F.row_number().over(Window.orderBy("ts")))
    good = read_table(spark, SMALL, "events").groupBy("event_type").count().withColumn(
        "rn", F.row_number().over(Window.orderBy("count")))
    for df, expect in ((bad, True), (good, False)):
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain("extended")
        nodes = _tree(buf.getvalue())
        hits = [_paths_reach_raw_scan(nodes, i) for i, (_, op, body) in enumerate(nodes)
                if op == "Exchange" and "SinglePartition" in body]
        assert any(hits) is expect


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("m02")))
def test_windows_only_see_reduced_rows(spark, name):
    """A window sorts each partition key in one task, so a hot key must reach it
    already reduced (aggregate, top-k, or a map-side WindowGroupLimit)."""
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        QUERIES[name](spark, SMALL).explain("extended")
    nodes = _tree(buf.getvalue())
    for i, (_, op, body) in enumerate(nodes):
        if op == "Window":
            assert not _paths_reach_raw_scan(nodes, i, REDUCERS + ("WindowGroupLimit",)), \
                f"window over raw rows: {body[:100]}"


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("m02")))
def test_no_final_aggregate_in_one_task(spark, name):
    """``coalesce(1)`` above an aggregate would merge all partial rows in one task."""
    assert "Coalesce 1" not in plan(QUERIES[name](spark, SMALL)).replace("Coalesce (", "Coalesce 1 (")


def test_medians_read_the_first_histogram_without_a_join(spark):
    """With broadcasting off, rows are exchanged by digits, never by the group key alone."""
    from civicflow.operators.selection import exact_median
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(1000).selectExpr("id % 3 AS g", "id AS v")
        text = plan(exact_median(df, ["g"], "v"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastExchange" not in text and "hashpartitioning(_g0" in text
    joins = text.count("SortMergeJoin (") // 2
    assert joins <= 6
