import numpy as np
import pytest
from pyspark.sql import functions as F

from waymill.functions.wkt import line_coords, line_text, point_xy, polygon_rings
from waymill.operators import graph, network

MAP = "edge_id bigint, map_id string, street_id bigint, geometry string, length double, obstacle_free_width_float double, curb_height_max double, crossing string, path_type string, bikepath_id string, include int, surveyed_at timestamp, loaded_at timestamp"
USER = "profile_id string, max_curb_height double, min_sidewalk_width double, crossing_weight_factor double, walk_bike_preference string, walk_bike_preference_weight_factor double"


def edge(i, line="LINESTRING (0 0, 1 0)", length=1.0, width=None, curb=None, crossing="No", kind="walk", bike=None, include=1, map_id="m"):
    return (i, map_id, 1, line, length, width, curb, crossing, kind, bike, include, None, None)


def frame(spark, rows):
    return spark.createDataFrame(rows, MAP)


def weights(spark, rows, user, recover=False):
    got = network.weighted(frame(spark, rows), spark.createDataFrame([user], USER), recover=recover).collect()
    return {r["edge_id"]: r for r in got}


def test_weight_compounds_and_normalises_over_excluded_edges(spark):
    rows = [edge(1, length=10.0), edge(2, length=20.0, crossing="Yes", kind="bike"), edge(3, length=40.0, kind="bike", curb=1.0)]
    got = weights(spark, rows, ("u", 0.5, 1.0, 2.0, "walk", 0.5))
    assert [got[k]["my_weight"] for k in (1, 2, 3)] == [0.125, 1.0, 1.0]
    assert [got[k]["include"] for k in (1, 2, 3)] == [1, 1, 0]


@pytest.mark.parametrize(
    ("curb", "width", "include", "recover", "want"),
    [(None, None, 1, False, 1), (float("nan"), float("nan"), 1, False, 1), (0.6, None, 1, False, 0), (None, 0.5, 1, False, 0), (0.1, 2.0, 0, False, 0), (0.1, 0.5, 0, True, 0), (0.1, None, 0, True, 1), (None, None, 0, True, 0), (None, 1.0, 0, True, 1), (None, None, None, False, None)],
)
def test_inclusion(spark, curb, width, include, recover, want):
    assert weights(spark, [edge(1, curb=curb, width=width, include=include)], ("u", 0.5, 1.0, 2.0, None, None), recover)[1]["include"] == want


def test_unknown_lengths_and_zero_weights(spark):
    got = weights(spark, [edge(1, length=None), edge(2, length=float("nan")), edge(3, length=4.0)], ("u", 0.5, 1.0, 2.0, "car", 0.1))
    assert [got[k]["my_weight"] for k in (1, 2, 3)] == [None, None, 1.0]
    assert weights(spark, [edge(1, length=0.0)], ("u", 0.5, 1.0, 2.0, "bike", 0.1))[1]["my_weight"] is None


def test_arcs_neighbours_and_parallel_edges(spark):
    rows = [edge(1), edge(2, bike="b"), edge(3, length=0.5), edge(4, "LINESTRING (0 0, 0 0)"), edge(5, "LINESTRING EMPTY"), edge(6, None)]
    edges = network.network_edges(frame(spark, rows))
    arcs = network.directed_arcs(edges)
    assert edges.count() == 4 and arcs.count() == 3 + 4
    assert network.without_self_loops(arcs).count() == 5
    a, b = 0, 100 << 32
    assert {r["src"]: r["neighbours"] for r in network.neighbours(arcs).collect()} == {a: [a, b], b: [a]}
    assert network.out_degrees(arcs).agg(F.max("degree")).first()[0] == 2
    best = {(r["src"], r["dst"]): r["edge_id"] for r in network.cheapest_arcs(arcs, "length").collect()}
    assert best[a, b] == 3 and best[b, a] == 3
    assert {r["edge_id"] for r in network.cheapest_arcs(arcs.withColumn("w", F.lit(None).cast("double")), "w").where("src <> dst").collect()} == {1}


def test_feature_graph_last_wins(spark):
    rows = [edge(1, length=1.0), edge(2, length=None, crossing="Yes"), edge(3, "LINESTRING (1 0, 0 0)", kind="bike", curb=float("nan"))]
    edges = network.network_edges(frame(spark, rows))
    graph = network.feature_graph(edges).collect()
    assert [(r["edge_id"], r["feature"]) for r in graph] == [(3, [1.0, 0.0, 0.0, 0.0, 0.0])]
    assert {r["edge_id"] for r in network.edge_index(edges).collect()} == {2, 3}
    layout = network.dynamic_feature(edges.withColumn("feature", network.static_feature()), F.lit(7), F.lit(8)).orderBy("edge_id").first()["feature_vec"]
    assert layout == [0.0, 0.0, 100.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 100.0, 0.0, 7.0, 8.0]


def test_repeated_deliveries_and_extra_columns(spark):
    rows = [edge(1, length=2.0), edge(1, length=2.0), edge(1, "LINESTRING(0 0,5 5)", length=1.0)]
    once = network.network_edges(frame(spark, rows).selectExpr("*", "1 AS src", "2 AS x1", "3 AS k0", "4 AS _c")).collect()
    assert len(once) == 1
    assert once == network.network_edges(frame(spark, rows[::-1])).collect()


def test_bounds_counts_equality_and_empty_tables(spark):
    m = frame(spark, [edge(1, "LINESTRING (0 0, 1 2)"), edge(2, "LINESTRING (1 2, 3 -1)"), edge(3, None)])
    assert tuple(network.bounds(m).first()) == (0, -100, 300, 200)
    assert tuple(network.vertex_statistics(m).first()) == (3, 3)
    assert network.same_map(m, m).first()["equal"] and not network.same_map(m, m.where("edge_id = 1")).first()["equal"]
    none = frame(spark, [])
    assert network.network_edges(none).count() == 0 and network.neighbours(network.directed_arcs(network.network_edges(none))).count() == 0
    assert network.weighted(none, spark.createDataFrame([("u", 0.5, 1.0, 2.0, None, None)], USER)).count() == 0


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"g {kind}").select(column(F.col("g")).alias("r")).first()["r"]


@pytest.mark.parametrize("text", ["LINESTRING (1 2, 3 4)", "linestring  ( 1  2 ,  3  4 ) ", "LINESTRING(1 2,3 4)", "SRID=28992;LINESTRING (1 2, 3 4)", "LineString Z (1 2 9, 3 4 9)", "LINESTRING (1.0e0 +2, 3 4.)", "\tLINESTRING (\t1 2,\n3 4)"])
def test_line_spellings(spark, text):
    assert [(v.x, v.y) for v in one(spark, line_coords, text)] == [(1.0, 2.0), (3.0, 4.0)]


@pytest.mark.parametrize("text", [None, "", "LINESTRING EMPTY", "LINESTRING (1 2)", "LINESTRING (1 2, 3)", "LINESTRING (1 2, a b)", "LINESTRING (1 2, 3 4", "POINT (1 2)", "LINESTRING (1 2, nan 4)", "LINESTRING (1 2, inf 4)"])
def test_unreadable_lines(spark, text):
    assert one(spark, line_coords, text) is None


def test_long_line_roundtrip(spark):
    text = "LINESTRING (" + ", ".join(f"{k} {k}.5" for k in range(50_000)) + ")"
    coords = one(spark, line_coords, text)
    assert len(coords) == 50_000 and coords[-1].y == 49_999.5
    assert one(spark, lambda c: line_coords(line_text(line_coords(c))), text) == coords


def test_points_and_polygons(spark):
    assert tuple(one(spark, point_xy, " point (1 2) ")) == (1.0, 2.0)
    assert one(spark, point_xy, "POINT (1)") is None and one(spark, point_xy, "POINT (nan nan)") is None
    assert [len(r) for r in one(spark, polygon_rings, "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((2 2, 3 2, 3 3, 2 2), (2 2, 2.5 2, 2.5 2.5, 2 2)))")] == [4, 4, 4]
    assert one(spark, polygon_rings, "POLYGON EMPTY") is None and one(spark, polygon_rings, None) is None


def test_projection_and_middle(spark):
    p = spark.range(1).select(network.to_rd(F.lit(52.15517440), F.lit(5.38720621)).alias("a"), network.to_rd(F.lit(52.37453), F.lit(4.88353)).alias("b")).first()
    assert (p.a.x, p.a.y) == (155000.0, 463000.0)
    assert p.b.x == pytest.approx(120_700, abs=400) and p.b.y == pytest.approx(487_500, abs=400)
    c = one(spark, lambda g: network.centroid(line_coords(g)), "LINESTRING (0 0, 10 0, 10 2)")
    assert (c.x, c.y) == (pytest.approx((10 * 5 + 2 * 10) / 12), pytest.approx(2 / 12))
    c = one(spark, lambda g: network.centroid(line_coords(g)), "LINESTRING (3 4, 3 4)")
    assert (c.x, c.y) == (3.0, 4.0)


def test_map_equality_by_map(spark):
    rows = [edge(1, "LINESTRING (0 0, 1 0)", map_id="a"), edge(2, "LINESTRING (0 0, 1 0)", map_id="b"), edge(3, None, map_id="b"), edge(4, None, map_id="c")]
    other = [edge(1, "linestring(0.0 0,1 0)", map_id="a"), edge(2, "LINESTRING (0 0, 1 0)", map_id="b"), edge(2, "LINESTRING (0 0, 1 0)", map_id="b")]
    got = {r["map_id"]: r["equal"] for r in network.same_map(frame(spark, rows), frame(spark, other), "map_id").collect()}
    assert got == {"a": True, "b": False, "c": True}


@pytest.mark.parametrize(("x", "y"), [(5, -3), (-5, 3), (-1, -1), (0, 0), (6_000_000, 30_000_000), (-(2**30), -(2**30))])
def test_nodes_of_either_sign(spark, x, y):
    node = network.packed(F.lit(x), F.lit(y))
    assert tuple(spark.range(1).select(*network.unpacked(node)).first()) == (x, y)
    key = spark.range(1).select(node.alias("n")).first()["n"]
    assert [int(v[0]) for v in network.unpacked_nodes(np.array([key]))] == [x, y]


def test_dynamic_feature_takes_the_place_from_the_state(spark):
    e = network.network_edges(frame(spark, [edge(1, "LINESTRING (0 0, 1 2)", length=3.0)])).withColumn("feature", network.static_feature())
    states = spark.createDataFrame([(1, [7.0, 8.0, 9.0]), (1, [5.0]), (2, [1.0, 2.0])], "edge_id bigint, state array<double>")
    got = {tuple(r["state"]): r["feature_vec"] for r in network.dynamic_features(states, e).collect()}
    assert got[7.0, 8.0, 9.0] == [0, 0, 100, 200, 3, 0, 0, 0, 1, 0, 0, 100, 200, 8, 9] and got[5.0,][13:] == [None, 5] and got[1.0, 2.0] is None


def test_rounded_nodes_merge_and_loops_go(spark):
    e = network.network_edges(frame(spark, [edge(1, "LINESTRING (0.2 0, 0.4 0)"), edge(2, "LINESTRING (0.3 0, 5 0)")]))
    moved = graph.relabelled(e)
    assert [r["edge_id"] for r in network.without_self_loops(network.directed_arcs(moved)).where("NOT reverse").collect()] == [2]
    assert {r["src"] for r in moved.collect()} == {0}
