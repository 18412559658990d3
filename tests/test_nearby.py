import math
import random

import numpy as np
import pytest

from waymill.functions.kdtree import LocalTree, SplitTree, chord, unit_vectors
from waymill.operators.nearby import clipped, line_segments, nearby, nearby_of_tables, readable_points, region_rings, ring_edges, sweep_regions

POINTS = "point_id bigint, route_id string, geometry string"
LINES = "edge_id bigint, geometry string"
AREAS = "area_id bigint, geometry string"


def tables(spark, points, lines, areas):
    return spark.createDataFrame(points, POINTS), spark.createDataFrame(lines, LINES), spark.createDataFrame(areas, AREAS)


def inside(x, y, rings):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if min(y1, y2) <= y < max(y1, y2) and x1 + (y - y1) * (x2 - x1) / (y2 - y1) < x:
                odd = not odd
    return odd


def distance(px, py, a, b):
    (x1, y1), (x2, y2) = a, b
    long = (x2 - x1) ** 2 + (y2 - y1) ** 2
    t = 0 if not long else max(0, min(1, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / long))
    return math.hypot(px - x1 - t * (x2 - x1), py - y1 - t * (y2 - y1))


def text(line):
    return ", ".join(f"{x} {y}" for x, y in line)


def test_against_brute_force(spark):
    rng = random.Random(3)
    place = lambda: (round(10_000 + rng.uniform(0, 400), 2), round(300_000 + rng.uniform(0, 400), 2))
    points = [(k, f"r{rng.randrange(120)}", *place()) for k in range(500)]
    points += [(1000 + k, f"s{k}", 10_200.0, 300_200.0) for k in range(40)]  # one hot place
    points += [(2000, "t", 10_206.0, 300_208.0), (2001, "t", 10_206.0, 300_208.0)]  # exactly 10 m from it
    lines = [(k, [place() for _ in range(rng.randint(2, 5))]) for k in range(60)]
    rings = []
    for k in range(8):
        cx, cy = place()
        outer = [(cx + 120 * math.cos(a), cy + 80 * math.sin(a)) for a in np.linspace(0, 2 * math.pi, 9)[:-1].tolist()]
        hole = [(cx + 20 * math.cos(a), cy + 20 * math.sin(a)) for a in np.linspace(0, 2 * math.pi, 6)[:-1].tolist()]
        rings.append((k, [outer, hole]))
    rows = tables(
        spark,
        [(i, r, f"POINT ({x} {y})") for i, r, x, y in points] * 2,
        [(i, f"LINESTRING ({text(line)})") for i, line in lines] + [(i, f"linestring z ({', '.join(f'{x} {y} 0' for x, y in line[::-1])})") for i, line in lines],
        [(i, "MULTIPOLYGON ((" + ", ".join(f"({text(r + r[:1])})" for r in parts) + "))") for i, parts in rings],
    )
    want = set()
    for a, ra, xa, ya in points:
        want |= {("point", a, b) for b, rb, xb, yb in points if a < b and ra != rb and (xa - xb) ** 2 + (ya - yb) ** 2 <= 100 + 1e-6}
        want |= {("line", a, e) for e, line in lines if any(distance(xa, ya, p, q) <= 6 for p, q in zip(line, line[1:]))}
        want |= {("area", a, i) for i, parts in rings if inside(xa, ya, parts)}
    for leaf_rows in (8192, 20):
        found = nearby(readable_points(rows[0], "point_id", "route_id"), line_segments(rows[1], "edge_id"), region_rings(rows[2], "area_id"), leaf_rows=leaf_rows, piece=30.0).collect()
        got = [tuple(r) for r in found]
        assert len(got) == len(set(got))
        assert set(got) == want


def test_unreadable_null_and_clashing(spark):
    points = [(1, "a", "POINT (0 0)"), (2, "b", "SRID=28992;point z ( 3  4 0 )"), (3, "c", None), (4, "c", ""), (5, "c", "POINT EMPTY"), (6, "c", "POINT (1)"), (7, "c", "POINT (nan nan)"), (None, "c", "POINT (0 0)"), (8, None, "POINT (0 0)"), (9, "a", "POINT (1e0 0)")]
    lines = [(1, "LINESTRING EMPTY"), (2, None), (3, "LINESTRING (0 1)"), (4, "LINESTRING (-5 1, 5 1)"), (5, "LINESTRING (0 x, 1 1)"), (6, "LINESTRING (2 2, 2 2)")]
    areas = [(1, None), (2, "POLYGON EMPTY"), (3, "POLYGON ((-1 -1, 2 -1, 2 2, -1 2, -1 -1))")]
    a, b, c = tables(spark, points, lines, areas)
    a = a.selectExpr("*", "1 AS id", "'x' AS owner", "2 AS x", "'k' AS kind")
    got = {tuple(r) for r in nearby_of_tables(a, b, c).collect()}
    assert {x for x in got if x[0] == "point"} == {("point", 1, 2), ("point", 2, 9)}
    assert {x for x in got if x[0] == "line"} == {("line", p, e) for p in (1, 2, 8, 9) for e in (4, 6)}
    assert {x for x in got if x[0] == "area"} == {("area", p, 3) for p in (1, 8, 9)}


def test_empty_tables(spark):
    a, b, c = tables(spark, [], [], [])
    assert nearby_of_tables(a, b, c).collect() == []
    a, _, _ = tables(spark, [(1, "a", "POINT (0 0)"), (2, "b", "POINT (0 0)")], [], [])
    assert [tuple(r) for r in nearby_of_tables(a, b, c).collect()] == [("point", 1, 2)]


def test_long_lines_are_cut(spark):
    a, b, c = tables(spark, [(1, "a", "POINT (50000 3)"), (2, "b", "POINT (99999 7)")], [(1, "LINESTRING (0 0, 100000 0)")], [])
    assert [tuple(r) for r in nearby_of_tables(a, b, c).collect()] == [("line", 1, 1)]


@pytest.mark.parametrize("depth", [0, 3, 6])
def test_split_tree_halo_covers_every_pair(depth):
    rng = np.random.default_rng(2)
    x, y = rng.uniform(0, 1000, 800), rng.uniform(0, 1000, 800)
    v = unit_vectors(x, y)
    tree = SplitTree(v[:200], depth)
    home = tree.home(v)
    rows, leaf = tree.reached(v, float(chord(40.0)))
    held = set(zip(rows.tolist(), leaf.tolist()))
    d = np.hypot(x[:, None] - x, y[:, None] - y)
    assert all((int(j), int(home[i])) in held for i, j in zip(*np.nonzero(d <= 40)))


def test_local_tree_is_exact_and_handles_ties():
    rng = np.random.default_rng(4)
    x, y = np.concatenate([rng.uniform(0, 300, 700), np.full(200, 5.0)]), np.concatenate([rng.uniform(0, 300, 700), np.full(200, 5.0)])
    v = unit_vectors(x, y)
    got = set()
    for q, t in LocalTree(v).within(v, float(chord(15.0)), budget=500):
        got |= set(zip(q.tolist(), t.tolist()))
    near = np.hypot(x[:, None] - x, y[:, None] - y) <= 15
    assert set(zip(*map(np.ndarray.tolist, np.nonzero(near)))) <= got
    assert len(got) <= near.sum() * 1.01 + 10
    assert list(LocalTree(np.zeros((0, 3))).within(v, 1.0)) == []


def test_sweep_by_small_budget():
    rng = np.random.default_rng(1)
    px, py = rng.uniform(0, 10, 200), rng.uniform(0, 10, 200)
    square = np.array([[2, 2, 8, 2], [8, 2, 8, 8], [8, 8, 2, 8], [2, 8, 2, 2]], float)
    edges = np.concatenate([square, square + 1])
    region = np.repeat([7, 9], 4)
    want = {(k, 7) for k in range(200) if 2 < px[k] < 8 and 2 < py[k] < 8} | {(k, 9) for k in range(200) if 3 < px[k] < 9 and 3 < py[k] < 9}
    for budget in (1, 10**6):
        p, r = sweep_regions(px, py, region, *edges.T, budget=budget)
        assert set(zip(p.tolist(), r.tolist())) == want


def ragged(rng, corners, x, y, size):
    """A closed line about a centre, with corners at random distances: seldom convex."""
    turn = np.sort(rng.uniform(0, 2 * np.pi, corners))
    away = rng.uniform(0.2, 1.0, corners) * size
    return [{"x": float(round(a, 1)), "y": float(round(b, 1))} for a, b in zip(x + away * np.cos(turn), y + away * np.sin(turn))]


@pytest.mark.parametrize("seed", range(8))
def test_clipped_edges_decide_alike(seed):
    rng = np.random.default_rng(seed)
    edges = ring_edges([ragged(rng, 60, 0, 0, 100), ragged(rng, 12, 5, 5, 15), ragged(rng, 9, 200, 3, 40)])
    for _ in range(40):
        box = np.sort(rng.uniform(-120, 240, (2, 2)).round(1), axis=0).ravel()
        px, py = (np.append(rng.uniform(box[k], box[k + 2], 60).round(1), [box[k], box[k + 2]]) for k in (0, 1))
        px, py = np.clip(px, box[0], box[2]), np.clip(py, box[1], box[3])
        whole, part = clipped(edges, np.array([-1e9, -1e9, 1e9, 1e9])), clipped(edges, box)
        found = [set(sweep_regions(px, py, np.zeros(len(e), np.int64), *e.T)[0].tolist()) for e in (whole, part)]
        assert found[0] == found[1]
        inner = np.concatenate([box[:2] * 0.6 + box[2:] * 0.4, box[:2] * 0.4 + box[2:] * 0.6])  # clipped twice, as down a tree
        assert {tuple(e) for e in clipped(part, inner)[:, 1::2]} == {tuple(e) for e in clipped(edges, inner)[:, 1::2]}


def test_a_box_inside_a_region_gets_one_edge_and_one_outside_none():
    rng = np.random.default_rng(1)
    edges = ring_edges([ragged(rng, 2000, 0, 0, 1000)])
    assert len(clipped(edges, np.array([-5.0, -5.0, 5.0, 5.0]))) == 1
    assert len(clipped(edges, np.array([1500.0, -5.0, 1600.0, 5.0]))) == 0 and len(clipped(edges, np.array([-1600.0, -5.0, -1500.0, 5.0]))) == 0
    assert len(ring_edges([[], [{"x": 0.0, "y": 0.0}] * 2])) == 0


def test_regions_over_many_leaves(spark):
    rng = np.random.default_rng(6)
    text = lambda ring: "(" + ", ".join(f"{c['x']} {c['y']}" for c in [*ring, ring[0]]) + ")"
    rings = {k: [ragged(rng, 40, *rng.uniform(0, 1000, 2), 400), ragged(rng, 7, *rng.uniform(0, 1000, 2), 60)] for k in range(6)}
    areas = spark.createDataFrame([(k, f"POLYGON ({', '.join(map(text, r))})") for k, r in rings.items()], "area_id bigint, geometry string")
    xy = rng.uniform(0, 1000, (600, 2)).round(1)
    points = spark.createDataFrame([(k, f"r{k}", float(a), float(b)) for k, (a, b) in enumerate(xy)], "id bigint, owner string, x double, y double")
    none = spark.createDataFrame([], "id bigint, x1 double, y1 double, x2 double, y2 double")
    want = set()
    for k, r in rings.items():
        e = ring_edges(r)
        want |= {(int(p), k) for p in sweep_regions(xy[:, 0], xy[:, 1], np.zeros(len(e), np.int64), *e.T)[0]}
    for leaf_rows in (8192, 15):
        got = nearby(points, none, region_rings(areas, "area_id"), near_point=1.0, leaf_rows=leaf_rows).where("kind = 'area'").collect()
        assert sorted((r["left_id"], r["right_id"]) for r in got) == sorted(want)
