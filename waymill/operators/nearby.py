"""Points near points, near lines, and inside regions, by one spatial shuffle.

All geometry becomes rows of one shape: a leaf of the split tree, a kind, an id and the ends of a segment. Each
distinct location has one home leaf; locations and line pieces are copied to every leaf their reach touches, and of a
region's edges each leaf gets those that decide for its places. One grouped pass per leaf then answers all three questions with a local k-d tree (chord radius) and a
sweep over region edges. Points that share a location are folded into it before the shuffle and unfolded by a
join afterwards, so a location that holds a third of all points is one row in its leaf.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymill.functions.kdtree import LocalTree, SplitTree, chord, unit_vectors
from waymill.functions.wkt import line_coords, point_xy, polygon_rings
from waymill.operators.spread import fitted_tree, home_leaves
from waymill.session import checkpointed

HOME, HALO, PIECE, REGION = 0, 1, 2, 3
#: Square metres by which a squared distance may exceed its limit and still count as equal to it.
TIE = 1e-6


def readable_points(df: DataFrame, key: str, owner: str, geometry: str = "geometry") -> DataFrame:
    """(id, owner, x, y): one row per key with a readable point; the smallest, if copies disagree."""
    placed = df.select(F.col(key).alias("id"), F.col(owner).alias("owner"), point_xy(F.col(geometry)).alias("xy"))
    placed = placed.where(F.col("id").isNotNull() & F.col("xy").isNotNull())
    return placed.groupBy("id").agg(F.min(F.struct("owner", "xy.x", "xy.y")).alias("p")).select("id", "p.owner", "p.x", "p.y")


def line_segments(df: DataFrame, key: str, geometry: str = "geometry") -> DataFrame:
    """(id, x1, y1, x2, y2) of every segment of every readable line; repeated rows may repeat segments."""
    coords = df.select(F.col(key).alias("id"), line_coords(F.col(geometry)).alias("c")).where(F.col("id").isNotNull() & F.col("c").isNotNull())
    pairs = F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.struct(F.element_at("c", i).alias("a"), F.element_at("c", i + 1).alias("b")))
    return coords.select("id", F.explode(pairs).alias("s")).select("id", F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"))


def line_pieces(segments: DataFrame, longest: float) -> DataFrame:
    """Segments with the middle (mx, my) of each piece of at most ``longest`` metres they are cut into."""
    parts = F.greatest(F.lit(1), F.ceil(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) / longest)).cast("int")
    cut = segments.withColumn("n", parts).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    at = (F.col("k") - 0.5) / F.col("n")
    return cut.select("id", "x1", "y1", "x2", "y2", (F.col("x1") + (F.col("x2") - F.col("x1")) * at).alias("mx"), (F.col("y1") + (F.col("y2") - F.col("y1")) * at).alias("my"))


def region_rings(df: DataFrame, key: str, geometry: str = "geometry") -> DataFrame:
    """(id, rings) of each readable region; the smallest, if copies disagree."""
    rings = df.select(F.col(key).alias("id"), polygon_rings(F.col(geometry)).alias("rings")).where(F.col("id").isNotNull() & F.col("rings").isNotNull())
    return rings.groupBy("id").agg(F.min("rings").alias("rings"))


def ring_edges(rings: list) -> np.ndarray:
    """(n, 4) edges x1, y1, x2, y2 of rings of at least three corners; an open ring is closed."""
    edges = []
    for ring in rings:
        corners = np.array([(c["x"], c["y"]) for c in ring], float).reshape(-1, 2)
        if len(corners) and (corners[0] != corners[-1]).any():
            corners = np.concatenate([corners, corners[:1]])
        if len(corners) >= 4:
            edges.append(np.concatenate([corners[:-1], corners[1:]], axis=1))
    return np.concatenate(edges) if edges else np.zeros((0, 4))


#: Metres an edge must be beyond a box to count as beside it.
BESIDE = 1e-3


def clipped(edges: np.ndarray, box: np.ndarray) -> np.ndarray:
    """Edges that give each point of a box (x, y from, x, y to) the same even-odd count of edges to its left.

    Edges above, below and right of the box have no part in it. Those left of it count by y alone, and where one ends in a
    vertex at which the next begins, the count doesn't change: of their ends those that come an even number of times
    cancel, and between the others stand upright edges left of the box. A closed line left of the box thus leaves
    nothing, and a box inside a region gets one edge.
    """
    x1, y1, x2, y2 = edges.T
    low, high, top = np.minimum(y1, y2), np.maximum(y1, y2), np.nextafter(box[3], np.inf)
    met = (low <= box[3]) & (high > box[1]) & (np.minimum(x1, x2) <= box[2] + BESIDE)
    left = met & (np.maximum(x1, x2) < box[0] - BESIDE)
    ends, times = np.unique(np.concatenate([np.maximum(low[left], box[1]), np.minimum(high[left], top)]), return_counts=True)
    ends = ends[times % 2 == 1].reshape(-1, 2)
    beside = np.full(len(ends), box[0] - 1.0)
    return np.concatenate([edges[met & ~left], np.stack([beside, ends[:, 0], beside, ends[:, 1]], axis=1)])


def leaf_boxes(places: DataFrame, tree: SplitTree) -> np.ndarray:
    """(leaves, 4) boxes (x, y from, x, y to) of the places in each leaf; those of a leaf without places are empty."""
    rows = home_leaves(places, tree, 1.0).groupBy("leaf").agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).toPandas().to_numpy(float)
    boxes = np.tile([np.inf, np.inf, -np.inf, -np.inf], (tree.leaves, 1))
    boxes[rows[:, 0].astype(int)] = rows[:, 1:]
    return boxes


def _regions_placed(regions: DataFrame, tree: SplitTree, boxes: np.ndarray) -> DataFrame:
    """Each region's edges, clipped down the split tree: a leaf gets those that matter to its places."""
    nodes = np.zeros((len(tree.axis), 4))
    box_of = lambda kid: boxes[~kid] if kid < 0 else nodes[kid]
    order, stack = [], [0] if len(nodes) else []
    while stack:
        order.append(node := stack.pop())
        stack += [kid for kid in tree.kids[node].tolist() if kid >= 0]
    for node in reversed(order):  # kids before their parents
        a, b = (box_of(kid) for kid in tree.kids[node])
        nodes[node] = [*np.minimum(a[:2], b[:2]), *np.maximum(a[2:], b[2:])]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for region, rings in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                pending = [(0 if len(nodes) else ~0, ring_edges(rings.as_py()))]
                while pending:
                    node, edges = pending.pop()
                    edges = clipped(edges, box_of(node))
                    if len(edges) and node >= 0:
                        pending += [(kid, edges) for kid in tree.kids[node].tolist()]
                    elif len(edges):
                        same = lambda value, kind: pa.array(np.full(len(edges), value), kind)  # noqa: E731, B023
                        ends = [pa.array(c) for c in np.ascontiguousarray(edges.T)]
                        yield pa.RecordBatch.from_arrays([same(~node, pa.int32()), same(REGION, pa.int8()), same(region, pa.int64()), *ends, same(0.0, pa.float64()), same(0.0, pa.float64())], names=["leaf", "kind", "id", "x1", "y1", "x2", "y2", "mx", "my"])

    return regions.select(F.col("id").cast("bigint").alias("id"), "rings").mapInArrow(place, SHAPE)


SHAPE = "leaf int, kind tinyint, id bigint, x1 double, y1 double, x2 double, y2 double, mx double, my double"
FOUND = "kind string, left_id bigint, right_id bigint"


def _placed(df: DataFrame, tree: SplitTree, kind: int) -> DataFrame:
    """Rows with columns id, x1, y1, x2, y2, mx, my, reach, each copied to the leaves its ball touches. Of the kind
    HALO, the copy in the own leaf becomes HOME."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda name: batch.column(name).to_numpy(zero_copy_only=False)  # noqa: E731, B023
            vectors = unit_vectors(get("mx"), get("my"))
            rows, leaf = tree.reached(vectors, chord(get("reach")))
            marks = np.full(len(rows), kind, np.int8)
            if kind == HALO:
                marks[tree.home(vectors)[rows] == leaf] = HOME
            for begin in range(0, len(rows), 50_000):
                cut = slice(begin, begin + 50_000)
                take = pa.array(rows[cut])
                columns = [pa.array(leaf[cut].astype(np.int32)), pa.array(marks[cut]), *[batch.column(c).take(take) for c in ("id", "x1", "y1", "x2", "y2", "mx", "my")]]
                yield pa.RecordBatch.from_arrays(columns, names=["leaf", "kind", "id", "x1", "y1", "x2", "y2", "mx", "my"])

    return df.select("id", "x1", "y1", "x2", "y2", "mx", "my", "reach").mapInArrow(place, SHAPE)


def _segment_distance2(px, py, x1, y1, x2, y2):
    dx, dy = x2 - x1, y2 - y1
    long = dx * dx + dy * dy
    at = np.clip(np.where(long > 0, ((px - x1) * dx + (py - y1) * dy) / np.where(long > 0, long, 1), 0), 0, 1)
    return (px - x1 - at * dx) ** 2 + (py - y1 - at * dy) ** 2


def sweep_regions(px: np.ndarray, py: np.ndarray, region: np.ndarray, x1, y1, x2, y2, budget: int = 2_000_000):
    """(point row, region) of every point with an odd number of its region's edges to the left on its line. Edges
    are swept over the points in the order of y: each meets only the points of its own y interval."""
    order = np.argsort(py, kind="stable")
    ys = py[order]
    low, high = np.minimum(y1, y2), np.maximum(y1, y2)
    first, last = np.searchsorted(ys, low, "left"), np.searchsorted(ys, high, "left")  # low <= y < high
    names, code = np.unique(region, return_inverse=True)
    sorter = np.argsort(code, kind="stable")
    found_points, found_regions = [], []
    sizes = np.maximum(0, last - first)
    at = 0
    bounds = np.searchsorted(code[sorter], np.arange(len(names) + 1))
    while at < len(names):
        to = at + 1
        while to < len(names) and sizes[sorter[bounds[at] : bounds[to + 1]]].sum() <= budget:
            to += 1
        edges = sorter[bounds[at] : bounds[to]]
        s = sizes[edges]
        edge = np.repeat(edges, s)
        point = np.repeat(first[edges] - np.concatenate([[0], np.cumsum(s)[:-1]]) if len(s) else s, s) + np.arange(s.sum())
        x, y = px[order[point]], ys[point]
        cross = x1[edge] + (y - y1[edge]) * (x2[edge] - x1[edge]) / (y2[edge] - y1[edge])
        hit = cross < x
        keys, counts = np.unique(code[edge[hit]].astype(np.int64) * (len(px) + 1) + point[hit], return_counts=True)
        keys = keys[counts % 2 == 1]
        found_points.append(order[keys % (len(px) + 1)]), found_regions.append(names[keys // (len(px) + 1)])
        at = to
    if not found_points:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_points), np.concatenate(found_regions)


def _leaf_search(near_point: float, near_line: float, piece: float):
    def search(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        kind = rows["kind"].to_numpy()
        columns = {c: rows[c].to_numpy() for c in ("id", "x1", "y1", "x2", "y2", "mx", "my")}
        pick = lambda mask: {c: v[mask] for c, v in columns.items()}
        home, around = pick(kind == HOME), pick(kind <= HALO)
        out: list[tuple[str, np.ndarray, np.ndarray]] = []
        if not len(home["id"]):
            return pd.DataFrame({"kind": pd.Series([], dtype=str), "left_id": np.zeros(0, np.int64), "right_id": np.zeros(0, np.int64)})
        at_home = unit_vectors(home["mx"], home["my"])
        for q, t in LocalTree(unit_vectors(around["mx"], around["my"])).within(at_home, float(chord(near_point))):
            close = (home["mx"][q] - around["mx"][t]) ** 2 + (home["my"][q] - around["my"][t]) ** 2 <= near_point**2 + TIE
            close &= home["id"][q] <= around["id"][t]  # each pair once, a location with itself too
            out.append(("point", home["id"][q[close]], around["id"][t[close]]))
        pieces = pick(kind == PIECE)
        for q, t in LocalTree(unit_vectors(pieces["mx"], pieces["my"])).within(at_home, float(chord(near_line + piece / 2))):
            close = _segment_distance2(home["mx"][q], home["my"][q], *[pieces[c][t] for c in ("x1", "y1", "x2", "y2")]) <= near_line**2 + TIE
            out.append(("line", home["id"][q[close]], pieces["id"][t[close]]))
        areas = pick(kind == REGION)
        if len(areas["id"]):
            point, region = sweep_regions(home["mx"], home["my"], areas["id"], *[areas[c] for c in ("x1", "y1", "x2", "y2")])
            out.append(("area", home["id"][point], region))
        found = pd.DataFrame({"kind": np.concatenate([np.full(len(a), k, object) for k, a, _ in out]) if out else pd.Series([], dtype=str), "left_id": np.concatenate([a for _, a, _ in out]), "right_id": np.concatenate([b for _, _, b in out])})
        return found.drop_duplicates()  # several pieces of a line may be near; a location has one home, so no repeat is elsewhere

    return search


def found_near_places(places: DataFrame, lines: DataFrame, regions: DataFrame, *, near_point: float = 10.0, near_line: float = 6.0, piece: float = 50.0, leaf_rows: int = 8192) -> DataFrame:
    """(kind, left_id, right_id) of distinct ``places`` (id, x, y), each once: ``point`` pairs of places at most ``near_point``
    apart, each with itself too; ``line`` (place, line) at most ``near_line`` apart; ``area`` (place, region around it)."""
    tree = fitted_tree(places.select("x", "y"), leaf_rows)
    dot = places.select("id", F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("x").alias("mx"), F.col("y").alias("my"), F.lit(near_point).alias("reach"))
    cut = line_pieces(lines, piece).withColumn("reach", F.lit(near_line + piece / 2))
    rows = _placed(dot, tree, HALO).unionByName(_placed(cut, tree, PIECE)).unionByName(_regions_placed(regions, tree, leaf_boxes(places, tree)))
    return checkpointed(rows.groupBy("leaf").applyInPandas(_leaf_search(near_point, near_line, piece), FOUND))


def _members(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(places, members): distinct locations (id: their smallest point, x, y), and each point's (place, member, owner)."""
    located = checkpointed(points)
    places = checkpointed(located.groupBy("x", "y").agg(F.min("id").alias("id")))
    return places, checkpointed(located.join(places.select(F.col("id").alias("place"), "x", "y"), ["x", "y"]).select("place", F.col("id").alias("member"), "owner"))


def nearby(points: DataFrame, lines: DataFrame, regions: DataFrame, **limits: float) -> DataFrame:
    """(kind, left_id, right_id), each row once: ``point`` pairs of points of different owners at most ``near_point``
    apart, smaller id first; ``line`` (point, line) at most ``near_line`` apart; ``area`` (point, region around it).

    ``points`` (id, owner, x, y) one row per id, see ``readable_points``; ``lines`` (id, x1, y1, x2, y2) segments;
    ``regions`` (id, rings) as from ``region_rings``. Points without an owner have no point pairs. Unreadable geometry is
    left out by the readers. Any of the tables may be empty. ``limits``: those of ``found_near_places``.
    """
    places, member = _members(points)
    found = found_near_places(places, lines, regions, **limits)
    pairs = found.where("kind = 'point'").select(F.col("left_id").alias("p"), F.col("right_id").alias("q"))
    left, right = member.select(F.col("place").alias("p"), F.col("member").alias("a"), F.col("owner").alias("oa")), member.select(F.col("place").alias("q"), F.col("member").alias("b"), F.col("owner").alias("ob"))
    met = pairs.join(left, "p").join(right, "q").where((F.col("oa") != F.col("ob")) & ((F.col("p") != F.col("q")) | (F.col("a") < F.col("b"))))
    met = met.select(F.lit("point").alias("kind"), F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id"))
    rest = found.where("kind <> 'point'").withColumnRenamed("left_id", "place").join(member, "place").select("kind", F.col("member").alias("left_id"), "right_id")
    return met.unionByName(rest)


def nearby_classes(points: DataFrame, lines: DataFrame, regions: DataFrame, **limits: float) -> DataFrame:
    """(point_id, place_id, n_places, n_lines, n_areas), one row per point: its location, named by the smallest point there,
    and how many other locations, lines and regions are near or around it. Unlike ``nearby`` it lists no pairs, so points
    that share a location with many cost a row each."""
    places, member = _members(points)
    found = found_near_places(places, lines, regions, **limits)
    ends = found.where("kind <> 'point' OR left_id <> right_id").select("kind", F.explode(F.when(F.col("kind") == "point", F.array("left_id", "right_id")).otherwise(F.array("left_id"))).alias("place"))
    count = lambda kind, name: F.count(F.when(F.col("kind") == kind, 1)).alias(name)
    counts = ends.groupBy("place").agg(count("point", "n_places"), count("line", "n_lines"), count("area", "n_areas"))
    rows = member.select("place", "member").join(counts, "place", "left")
    return rows.select(F.col("member").alias("point_id"), F.col("place").alias("place_id"), *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("n_places", "n_lines", "n_areas")])


def _of_tables(start_end: DataFrame, network_map: DataFrame, map_areas: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    return readable_points(start_end, "point_id", "route_id"), line_segments(network_map, "edge_id"), region_rings(map_areas, "area_id")


def nearby_of_tables(start_end: DataFrame, network_map: DataFrame, map_areas: DataFrame, **limits: float) -> DataFrame:
    """``nearby`` over the text geometry of the three tables."""
    return nearby(*_of_tables(start_end, network_map, map_areas), **limits)


def classes_of_tables(start_end: DataFrame, network_map: DataFrame, map_areas: DataFrame, **limits: float) -> DataFrame:
    """``nearby_classes`` over the text geometry of the three tables."""
    return nearby_classes(*_of_tables(start_end, network_map, map_areas), **limits)
