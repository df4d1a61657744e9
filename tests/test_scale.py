"""Steps whose cost must not grow faster than the tables."""

import re

from conftest import SF
from pyspark.sql import functions as F

from textloom.functions import paths as px
from textloom.operators import analysis, caps, graph
from textloom.plans import catalog
from textloom.plans.derived import derived


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_orders_are_worked_out_once_a_row(spark):
    for name in ("triage_order", "path_rank_topk"):
        order = re.search(r"TakeOrderedAndProject\(limit=\d+, orderBy=\[(.*?)\], output", plan(catalog.QUERIES[name](spark, SF))).group(1)
        assert "(" not in order, (name, order)


def test_directories_by_pattern(spark):
    paths = ["vendor/a.c", "vendor", "vendor/", "/vendor//x", "a/vendor/b/c", "a/vendor", "avendor/x", "vendorx/y", "VENDOR/x", "a/deps/\nb", "", "//deps//", None]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    low = F.lower("p")
    by_parts = F.arrays_overlap(px.directories(low), F.array(*map(F.lit, px.VENDORED)))
    assert df.where(~by_parts.eqNullSafe(px.is_vendored(F.col("p")))).collect() == []
    assert df.where(px.is_vendored(F.col("p"))).count() == 5


def test_call_sites_neither_sort_tokens_nor_depend_on_the_sessions_partitions(spark):
    lines = spark.range(450_000).selectExpr("id AS l_orderkey", "id AS l_suppkey", "1 AS l_linenumber")
    assert caps.tasks(lines, 200_000) == 3
    shown = plan(catalog.QUERIES["call_sites"](spark, SF))
    assert "Window" not in shown and "MapInArrow" in shown


def test_rendered_files_are_dealt_to_tasks_by_their_number(spark):
    part = spark.range(9_000).selectExpr("id AS p_partkey", "'n' AS p_name", "'b' AS p_brand", "'t' AS p_type", "1 AS p_size").coalesce(1)
    for name in ("python_files", "signal_files", "rust_files", "code_files", "repo_files"):
        assert derived(lambda _: part, name).rdd.getNumPartitions() == 5


def test_comments_are_stripped_once_a_file(spark):
    for name in ("io_signals", "side_effect_sentences", "file_summaries"):
        optimized = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert optimized.count("zip_with(") + optimized.count("zipwith(") == 1


def test_a_hop_sends_the_frontier_not_the_edges(spark):
    edges = spark.range(2_000).selectExpr("id AS node", "id div 2 AS next")
    few = graph.cut(spark.range(5).withColumnRenamed("id", "node"))
    hop = edges.join(graph.sided(few, 5), "node")
    assert "BuildRight" in plan(hop)
    assert "SortMergeJoin" in plan(edges.join(graph.sided(few, graph.SMALL + 1), "node"))
    for seeds, want in (([3], [0, 1, 3]), (range(graph.SMALL + 1), range(graph.SMALL + 1))):
        ids = spark.createDataFrame([(i,) for i in seeds], "node long")
        assert [r.node for r in graph.closure(ids, edges, "node", "next").orderBy("node").collect()] == list(want)


def test_first_of_each_component_without_ranking_all(spark):
    rows = [(i, f"{'ab'[i % 2]}/f{i % 7}.c" if i % 5 else None, i % 3, ("high", "low", "critical", None)[i % 4]) for i in range(200)]
    found = spark.createDataFrame(rows, "id long, file string, line long, severity string")
    got = analysis.triaged(found, 6)
    assert "Window" not in plan(got)
    rank = {"critical": 0, "high": 1, "low": 3, None: 9}
    by: dict = {}
    for i, file, line, severity in rows:
        by.setdefault(file and file[0], []).append((rank[severity], file or "", line, i))
    want = {r[3] for group in by.values() for r in sorted(group)[:6]}
    assert {r.id for r in got.where("triaged").collect()} == want and got.count() == 200
