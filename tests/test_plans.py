"""What the planner makes of the queries: pruned scans, pushed filters, few shuffles, no products of large tables."""

import re

import pytest

from waymill.operators.replay import replay_buffer
from waymill.plans.registry import QUERIES
from waymill.sources.tables import table


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_replay_needs_one_shuffle(spark, data):
    text = plan(replay_buffer(table(spark, data, "sampled_train")))
    assert len(re.findall(r"^\(\d+\) Exchange", text, re.M)) == 1
    assert len(re.findall(r"^\(\d+\) Sort\b", text, re.M)) == 1


@pytest.mark.parametrize(
    ("name", "columns"),
    [("selected_edges", {"map_id", "include"}), ("route_dedupe", {"route_id", "step_id", "geometry"}), ("bounds", {"map_id", "geometry"}), ("replay_stats", {"feature_vec"}), ("role_filter", {"coordinates", "point_id"})],
)
def test_scans_are_pruned(spark, data, name, columns):
    found = re.findall(r"ReadSchema: struct<(.*?)>\n", plan(QUERIES[name](spark, data)))
    assert found
    for schema in found:
        assert {c.split(":")[0] for c in re.findall(r"(\w+:[\w<]+)", schema) if not c.startswith("element")} <= columns


def test_filters_reach_the_scan(spark, data):
    assert "EqualTo(include,1)" in plan(QUERIES["selected_edges"](spark, data))
    assert re.search(r"PushedFilters: .*In\(coordinates", plan(QUERIES["role_filter"](spark, data)))


@pytest.mark.parametrize("name", ["viewport_join", "feature_vec", "route_dedupe", "episode_rewards", "split_members", "valid_actions", "parallel_edge_min"])
def test_no_products(spark, data, name):
    text = plan(QUERIES[name](spark, data))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_walk_has_no_python_and_no_arrays_that_grow(spark, data):
    text = plan(QUERIES["feature_vec"](spark, data))
    assert "Python" not in text and "Pandas" not in text and "Arrow" not in text and "collect_list" not in text


def test_route_keys_gather_no_lists(spark, data):
    text = plan(QUERIES["route_dedupe"](spark, data))
    assert "collect_list" not in text and "partial_sum" in text
