import random

import pytest

from waymill.operators import features, routes
from tests.test_nearby import distance

STEP = "route_id string, step_id int, geometry string, length double, obstacle_free_width_float double, curb_height_max double, crossing string, path_type string, map_id string"
END = "point_id bigint, route_id string, coordinates string, geometry string"


def step(route, k, line, length=1.0, crossing="No"):
    return (route, k, line, length, None, float("nan"), crossing, "walk", "m")


def steps(spark, rows):
    return spark.createDataFrame(rows, STEP)


def ends(spark, rows):
    return spark.createDataFrame(rows, END)


def test_dedupe_is_by_multiset_and_order_free(spark):
    a, b = "LINESTRING (0 0, 1 0)", "LINESTRING (1 0, 2 0)"
    df = steps(spark, [step("r1", 0, a), step("r1", 1, b), step("r2", 0, b), step("r2", 1, a), step("r3", 0, a), step("r3", 1, a), step("r3", 2, b), step("r4", 0, None), (None, 0, a, *[None] * 6)])
    assert routes.distinct_route_count(df).first()[0] == 2
    assert {tuple(r) for r in routes.kept_routes(df).collect()} == {("r1", "r1"), ("r2", "r1"), ("r3", "r3")}
    kept = routes.without_duplicates(df)
    assert kept.count() == 5 and routes.without_duplicates(kept).count() == 5
    assert routes.distinct_route_count(df, approximate=True).first()[0] == 2
    assert routes.distinct_route_count(df.limit(0)).first()[0] == 0


@pytest.mark.parametrize(("n", "ratios", "want"), [(10, (0.8, 0.1, 0.1), (8, 1, 1)), (7, (0.7, 0.15, 0.15), (4, 1, 2)), (1000, (0.7, 0.2, 0.1), (700, 200, 100)), (0, (0.8, 0.1, 0.1), (0, 0, 0))])
def test_split_counts(spark, n, ratios, want):
    ids = spark.range(n).selectExpr("concat('r', id) AS id", "id * 104729 + id % 3 AS number")
    got = {r["split"]: r["count"] for r in routes.split_members(ids, train=ratios[0], validation=ratios[1], test=ratios[2]).groupBy("split").count().collect()}
    assert tuple(got.get(k, 0) for k in ("train", "val", "test")) == want


def test_split_ratio_check(spark):
    with pytest.raises(ValueError, match="ratios"):
        routes.split_members(spark.range(1).selectExpr("'a' AS id", "id AS number"), train=0.8, validation=0.3, test=0.1)


def test_viewport_against_distances(spark):
    lines = {1: [(0, 0), (200, 0)], 2: [(71, 71), (200, 300)], 3: [(-300, 10), (300, 60)], 4: [(70, 70), (70, 400)], 5: [(-71, -300), (-71, 300)], 6: [(5, 5), (5, 5)]}
    edges = spark.createDataFrame([(i, "LINESTRING (" + ", ".join(f"{x} {y}" for x, y in c) + ")") for i, c in lines.items()] + [(9, None)], "edge_id bigint, geometry string")
    at = spark.createDataFrame([("r", 0.0, 0.0), ("s", 1000.0, 1000.0)], "route_id string, x double, y double")
    for cell in (16.0, 256.0):
        assert {tuple(r) for r in routes.viewport_edges(at, edges, cell=cell).collect()} == {("r", i) for i in (1, 3, 4, 6)}
    assert distance(0, 0, *lines[2]) > 70


def vectors(spark, rows, points):
    return {(r["route_id"], r["step_id"]): r["feature_vec"] for r in features.feature_vectors(steps(spark, rows), ends(spark, points)).collect()}


def test_walk_forward_reversed_and_layout(spark):
    rows = [step("r", 5, "LINESTRING (2 0, 1 0)", crossing="Yes"), step("r", 2, "LINESTRING (0 0, 1 0)", length=None), step("r", 2, "linestring (0 0, 1 0)", length=None), step("r", 9, None), step("q", 0, "LINESTRING (0 0, 1 0)")]
    points = [(1, "r", "origin_node", "POINT (0 0)"), (2, "r", "destination_node", "POINT (2 0)"), (3, "r", "origin_node", "POINT (9 9)"), (4, "q", "origin_node", "POINT (0 0)"), (5, "q", "destination_node", None)]
    got = vectors(spark, rows, points)
    assert got == {
        ("r", 0): [0, 0, 1, 0, 0, 1, 0, 0, 0, 0, 0, 2, 0, 1, 0],
        ("r", 1): [2, 0, 1, 0, 1, 1, 1, 0, 0, 0, 0, 2, 0, 2, 0],
    }
    rejects = {tuple(r) for r in features.routes_without_ends(steps(spark, [*rows, step("z", 0, None)]), ends(spark, points)).collect()}
    assert rejects == {("q", "no end points"), ("z", "no geometry")}


def test_walk_tolerance_is_relative_to_the_current_place(spark):
    points = lambda r: [(1, r, "origin_node", "POINT (121000 487000)"), (2, r, "destination_node", "POINT (0 0)")]
    near = vectors(spark, [step("a", 0, "LINESTRING (121001.2 487000, 5 5)")], points("a"))
    far = vectors(spark, [step("a", 0, "LINESTRING (121001.3 487000, 5 5)")], points("a"))
    assert near["a", 0][13:] == [5, 5] and far["a", 0][13:] == [121001.3, 487000]


def folded(rows, x, y):
    """The walk, step by step."""
    out = []
    for ax, ay, bx, by in rows:
        near = abs(ax - x) <= 1e-8 + 1e-5 * abs(x) and abs(ay - y) <= 1e-8 + 1e-5 * abs(y)
        x, y = (bx, by) if near else (ax, ay)
        out.append((x, y))
    return out


def test_long_and_short_routes_against_the_fold(spark):
    rng = random.Random(1)
    routes_ = {f"r{n}": [tuple(float(rng.randrange(3)) for _ in range(4)) for _ in range(n)] for n in (1, 2, 3, 17, 5000)}
    rows = [step(r, k, "LINESTRING ({} {}, {} {})".format(*e)) for r, all_ in routes_.items() for k, e in enumerate(all_)]
    points = [(10 * i + j, r, role, f"POINT ({j} 1)") for i, r in enumerate(routes_) for j, role in enumerate(("origin_node", "destination_node"))]
    got = {}
    for r in features.walked(features.route_steps(steps(spark, rows)), features.trip_ends(ends(spark, points))).orderBy("route_id", "k").collect():
        got.setdefault(r["route_id"], []).append((r["w"]["cx"], r["w"]["cy"]))
    assert got == {r: folded(all_, 0.0, 1.0) for r, all_ in routes_.items()}


def test_equal_lines_in_other_spellings_are_duplicates(spark):
    rows = [step("a", 0, "LINESTRING (0 0, 1 0)"), step("a", 1, "LINESTRING (1 0, 2 0)"), step("b", 0, "srid=28992;linestring z(1.00 0 5,2 0.0 5)"), step("b", 1, "LineString(0 0,1e0 0)"), step("b", 1, "LINESTRING (0 0, 1 0)")]
    rows += [step("c", 0, "LINESTRING (0 0, 1 0)"), step("c", 1, "LINESTRING (1 0, 2 0)"), step("c", 2, "LINESTRING (1 0, 2 0)"), step("d", 0, None)]
    kept = {r["route_id"]: r["kept_route"] for r in routes.kept_routes(steps(spark, rows)).collect()}
    assert kept == {"a": "a", "b": "a", "c": "c"}


def test_valid_actions_near_and_far_ends(spark):
    seq = lambda *ends_: [float(x) for x in (*ends_, *[0] * 11)]
    rows = [("r", 0, seq(0, 0, 1, 0)), ("r", 1, seq(1, 0, 2, 0)), ("r", 2, seq(2, 0, 3, 0)), ("one", 0, seq(1, 0, 2, 0)), ("pad", 0, seq(0, 0, 0, 0))]
    ways = spark.createDataFrame([(float(k), 0.0, [k * 10, k * 10 + 1]) for k in range(4)], "x double, y double, neighbours array<bigint>")
    df = spark.createDataFrame(rows, "route_id string, step_id int, feature_vec array<double>")
    got = {(r["route_id"], r["step_id"]): r["actions"] for r in features.valid_actions(df, ways).collect()}
    assert got == {("r", 0): [0, 1], ("r", 1): [20, 21], ("r", 2): [30, 31], ("one", 0): [10, 11], ("pad", 0): []}
