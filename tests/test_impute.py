import datetime as dt
import math
import random

import pytest

from waymill.operators.impute import CURB, WIDTH, chained_imputation, filled_cells

SCHEMA = "edge_id bigint, map_id string, street_id bigint, path_type string, crossing string, length double, obstacle_free_width_float double, curb_height_max double, surveyed_at timestamp, loaded_at timestamp"
DAY = dt.datetime(2024, 5, 1)


def row(edge, street=1, kind="walk", width=None, curb=None, length=50.0, crossing="No", at=DAY, loaded=DAY, map_id="m"):
    return (edge, map_id, street, kind, crossing, length, width, curb, at, loaded)


def by_edge(df):
    return {r["edge_id"]: r for r in df.collect()}


def test_sources_masks_and_ranges(spark):
    rows = [
        row(1, width=2.0, curb=0.1), row(2, width=-1.0, curb=float("nan")), row(3, street=2, width=float("inf"), curb=None), row(4, street=None, width=99.0, curb=0.7),
        row(5, width=0.2, curb=0.6), row(6, width=20.0, curb=0.0), row(7, kind=None, width=1.0), row(8, kind=None),
    ]
    got = by_edge(chained_imputation(spark.createDataFrame(rows, SCHEMA)))
    assert [got[k]["curb_height_max_source"] for k in range(1, 9)] == ["measured", "group", "time", "time", "measured", "measured", "time", "time"]
    assert got[2]["curb_height_max_filled"] and not got[1]["curb_height_max_filled"]
    assert got[1]["curb_height_max"] == 0.1 and got[5]["obstacle_free_width_float"] == 0.2 and got[6]["obstacle_free_width_float"] == 20.0
    for r in got.values():
        assert CURB.low <= r["curb_height_max"] <= CURB.high and WIDTH.low <= r["obstacle_free_width_float"] <= WIDTH.high


def test_latest_measurement_wins_and_repeats_change_nothing(spark):
    rows = [row(1, curb=0.1, width=1.0), row(1, curb=0.2, width=None, loaded=DAY + dt.timedelta(1)), row(1, curb=float("nan"), loaded=DAY + dt.timedelta(2)), row(2), row(3, curb=0.3, width=2.0)]
    once = by_edge(chained_imputation(spark.createDataFrame(rows, SCHEMA)))
    again = by_edge(chained_imputation(spark.createDataFrame(rows[::-1] * 3, SCHEMA)))
    assert once[1]["curb_height_max"] == 0.2 and once[1]["obstacle_free_width_float"] == 1.0
    assert len(again) == 3
    for k in once:
        assert once[k]["curb_height_max"] == pytest.approx(again[k]["curb_height_max"])


def test_empty_all_missing_and_null_columns(spark):
    assert chained_imputation(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, *[None] * 9), (1, *[None] * 9), (2, *[None] * 9)]
    got = by_edge(chained_imputation(spark.createDataFrame(rows, SCHEMA)))
    assert sorted(got) == [1, 2]
    assert got[1]["curb_height_max"] is None and got[1]["curb_height_max_source"] is None and not got[1]["curb_height_max_filled"]


def test_clashing_extra_columns(spark):
    df = spark.createDataFrame([row(1, curb=0.1), row(2)], SCHEMA).selectExpr("*", "1 AS _v0", "2 AS _source0", "'x' AS value", "3 AS _month", "4 AS n")
    assert by_edge(chained_imputation(df))[2]["curb_height_max_source"] == "group"


def test_fills_follow_the_other_field_and_keep_spread(spark):
    rng = random.Random(5)
    rows, truth = [], {}
    for edge in range(3000):
        street = edge // 10
        width = min(20, max(0.2, 2 + (street % 7) * 0.4 + rng.gauss(0, 0.3)))
        curb = min(0.6, max(0.0, 0.08 * width + rng.gauss(0, 0.01)))
        gone = rng.random() < 0.3
        truth[edge] = (width, curb, gone)
        rows.append(row(edge, street=street, width=width, curb=None if gone else curb))
    got = by_edge(chained_imputation(spark.createDataFrame(rows, SCHEMA)))
    errors = [got[e]["curb_height_max"] - c for e, (_, c, gone) in truth.items() if gone]
    deviation = math.sqrt(sum(x * x for x in errors) / len(errors))
    assert 0.01 < deviation < 0.02  # near the noise (sqrt 2 times it: its own and the draw), far below the spread of curbs (0.07)
    filled = [got[e]["curb_height_max"] for e, (_, _, gone) in truth.items() if gone]
    kept = [c for _, c, gone in truth.values() if not gone]
    spread = lambda x: math.sqrt(sum((v - sum(x) / len(x)) ** 2 for v in x) / len(x))
    assert spread(filled) == pytest.approx(spread(kept), rel=0.15)


def test_long_form(spark):
    cells = filled_cells(chained_imputation(spark.createDataFrame([row(1, curb=0.1, width=1.0), row(2)], SCHEMA)))
    assert {(r["edge_id"], r["field_name"], r["source"]) for r in cells.collect()} == {(2, "curb_height_max", "group"), (2, "obstacle_free_width_float", "group")}


def test_fills_dont_pile_up_at_the_limits(spark):
    rng = random.Random(3)
    rows = [(k, k % 40, "walk", 10.0, min(0.6, max(0.0, rng.gauss(0.02, 0.05))) if k % 2 else None, 2.0) for k in range(800)]
    df = spark.createDataFrame(rows, "edge_id bigint, street_id bigint, path_type string, length double, curb_height_max double, obstacle_free_width_float double")
    df = df.selectExpr("*", "'No' AS crossing", "TIMESTAMP'2024-01-01' AS surveyed_at", "TIMESTAMP'2024-01-01' AS loaded_at")
    values = [r["curb_height_max"] for r in chained_imputation(df).where("curb_height_max_filled").collect()]
    assert len(values) == 400 and sum(v in (0.0, 0.6) for v in values) < 4 and all(0 <= v <= 0.6 for v in values)
