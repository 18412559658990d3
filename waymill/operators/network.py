"""The street network: accessibility, weights, graph tables and edge features.

Nodes are whole centimetres (x, y) packed into one integer, so equal places are equal keys. Missing numbers are null:
NaN is turned into null at the door, because NaN compares as larger than everything in Spark.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymill.functions.wkt import centimetres, line_coords
from waymill.session import few

#: The numeric columns of an edge.
NUMBERS = ("length", "obstacle_free_width_float", "curb_height_max")


def number(column: Column | str) -> Column:
    """As double, NaN and unreadable content null."""
    column = F.col(column) if isinstance(column, str) else column
    return F.nanvl(column.try_cast("double"), F.lit(None).cast("double"))


def packed(x: Column, y: Column) -> Column:
    """Node key of whole centimetres; exact while x and y stay within 21,000 km of 0 on either side."""
    return F.shiftleft(x.cast("bigint"), 32) + y.cast("bigint")


def unpacked(node: Column) -> tuple[Column, Column]:
    """(x, y) of a node key; the low word has a sign."""
    low = node.bitwiseAND(F.lit((1 << 32) - 1))
    y = F.when(low >= 1 << 31, low - F.lit(1 << 32)).otherwise(low)
    return F.shiftright(node - y, 32), y


def unpacked_nodes(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``unpacked`` of an array of node keys."""
    y = nodes.astype(np.int64).astype(np.uint64).astype(np.uint32).view(np.int32).astype(np.int64)
    return (nodes - y) >> 32, y


def network_edges(network_map: DataFrame) -> DataFrame:
    """One row per edge with a readable line: the earliest delivered row (ties by content), its numbers cleaned, its end
    points in centimetres (x1, y1, x2, y2), node keys (src, dst) and number of vertices.

    A minimum over one struct per edge: partial in the map stage, so an edge delivered millions of times is no hot task.
    """
    order = ["loaded_at", "surveyed_at", "geometry", *NUMBERS, "crossing", "include"]
    keys = [x for c in order for x in (F.col(c).isNull(), F.col(c))]
    rest = ["map_id", "street_id", "path_type", "bikepath_id"]
    coords = network_map.withColumn("_c", line_coords(F.col("geometry"))).where(F.col("_c").isNotNull() & F.col("edge_id").isNotNull())
    ends = [F.element_at("_c", 1), F.element_at("_c", -1)]
    payload = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], *rest, *[centimetres(p[a]).alias(f"{a}{i + 1}") for i, p in enumerate(ends) for a in ("x", "y")], F.size("_c").cast("bigint").alias("n_vertices"))
    top = coords.groupBy("edge_id").agg(F.min(payload).alias("p"))
    value = {c: F.col(f"p.k{2 * i + 1}") for i, c in enumerate(order)}
    return top.select(
        "edge_id",
        *[F.col(f"p.{c}").alias(c) for c in rest],
        value["geometry"].alias("geometry"),
        *[number(value[c]).alias(c) for c in NUMBERS],
        value["crossing"].alias("crossing"),
        value["include"].alias("include"),
        *[F.col(f"p.{c}").alias(c) for c in ("x1", "y1", "x2", "y2", "n_vertices")],
        packed(F.col("p.x1"), F.col("p.y1")).alias("src"),
        packed(F.col("p.x2"), F.col("p.y2")).alias("dst"),
    )


def included(recover: bool = False) -> Column:
    """The include flag for a user model: 0 for a curb above or a width below its limits; unknown values keep the old
    flag. With ``recover``, a fitting curb or width restores 1 first, and exclusions win."""
    curb, width = number("curb_height_max"), number("obstacle_free_width_float")
    bad = (curb > F.col("max_curb_height")) | (width < F.col("min_sidewalk_width"))
    flag = F.when(bad, F.lit(0))
    if recover:
        flag = flag.when((curb <= F.col("max_curb_height")) | (width >= F.col("min_sidewalk_width")), F.lit(1))
    return flag.otherwise(F.col("include"))


def raw_weight() -> Column:
    """Length, times the crossing factor on crossings, times the preference factor on the preferred kind of path."""
    length = number("length")
    crossed = F.when(F.col("crossing") == "Yes", length * F.col("crossing_weight_factor")).otherwise(length)
    preferred = F.col("walk_bike_preference").isin("walk", "bike") & (F.col("path_type") == F.col("walk_bike_preference"))
    return F.when(preferred, crossed * F.col("walk_bike_preference_weight_factor")).otherwise(crossed)


def weighted(edges: DataFrame, profiles: DataFrame, *, recover: bool = False, within: tuple[str, ...] = ()) -> DataFrame:
    """Edges for every profile with include, my_weight and oneway.

    my_weight is the raw weight over the largest absolute weight of the profile (and of ``within``, say a map) over all
    its edges, excluded ones too; null where the length is unknown or all weights are 0. The profile table is broadcast
    while it is short (``session.few``); the maxima are one row per profile (and ``within``).
    """
    own = profiles.withColumns({c: number(c) for c in ("max_curb_height", "min_sidewalk_width", "crossing_weight_factor", "walk_bike_preference_weight_factor")})
    crossed = edges.crossJoin(few(own)).withColumn("raw_weight", raw_weight())
    keys = ["profile_id", *within]
    most = crossed.groupBy(*keys).agg(F.max(F.abs("raw_weight")).alias("most"))
    flagged = crossed.join(most, keys, "left").withColumn("include", included(recover))
    return flagged.withColumn("my_weight", F.col("raw_weight") / F.nullif(F.col("most"), F.lit(0.0))).withColumn("oneway", F.col("bikepath_id").isNotNull()).drop("most")


def selected(edges: DataFrame) -> DataFrame:
    """Edges that are included."""
    return edges.where(F.col("include") == 1)


def without_self_loops(arcs: DataFrame) -> DataFrame:
    return arcs.where(F.col("src") != F.col("dst"))


def directed_arcs(edges: DataFrame) -> DataFrame:
    """A forward arc per edge and a reverse arc unless the edge is one-way (has a bike path id). Both keep the edge's
    attributes and its unreversed line."""
    ends = F.explode(F.when(F.col("bikepath_id").isNull(), F.array(F.struct("src", "dst", F.lit(False).alias("reverse")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("reverse")))).otherwise(F.array(F.struct("src", "dst", F.lit(False).alias("reverse")))))
    rest = [c for c in edges.columns if c not in ("src", "dst", "oneway", "reverse")]
    return edges.select(*rest, F.col("bikepath_id").isNotNull().alias("oneway"), ends.alias("a")).select(*rest, "oneway", "a.src", "a.dst", "a.reverse")


def neighbours(arcs: DataFrame) -> DataFrame:
    """(src, neighbours): distinct successors in order, so that an action number always means the same node."""
    return arcs.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("neighbours"))


def out_degrees(arcs: DataFrame) -> DataFrame:
    """(src, degree): number of distinct successors, itself included if it has a loop."""
    return arcs.groupBy("src").agg(F.countDistinct("dst").alias("degree"))


def cheapest_arcs(arcs: DataFrame, weight: str = "my_weight", *, by: Sequence[str] = ()) -> DataFrame:
    """Of the parallel arcs between two nodes (of each ``by``) the one of least weight (a missing weight counts 1; ties:
    least edge id)."""
    cost = F.coalesce(F.col(weight), F.lit(1.0))
    return arcs.groupBy(*by, "src", "dst").agg(F.min(F.struct(cost.alias("w"), "edge_id")).alias("m")).select(*by, "src", "dst", F.col("m.edge_id").alias("edge_id"), F.col("m.w").alias("weight"))


def bounds(edges: DataFrame, *keys: str) -> DataFrame:
    """Smallest and largest coordinate over all vertices, in centimetres."""
    c = line_coords(F.col("geometry"))
    x, y = F.transform(c, lambda p: p.x), F.transform(c, lambda p: p.y)
    agg = {"min_x": F.min(F.array_min(x)), "min_y": F.min(F.array_min(y)), "max_x": F.max(F.array_max(x)), "max_y": F.max(F.array_max(y))}
    return edges.groupBy(*keys).agg(*[centimetres(v).alias(k) for k, v in agg.items()])


def vertex_statistics(network_map: DataFrame, *keys: str) -> DataFrame:
    """Lines, and distinct vertices over all lines."""
    vertices = network_map.select(*keys, F.explode_outer(line_coords(F.col("geometry"))).alias("v"))
    points = vertices.groupBy(*keys).agg(F.countDistinct(centimetres(F.col("v.x")), centimetres(F.col("v.y"))).alias("n_vertices"))
    lines = network_map.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_lines"))
    return lines.join(points, list(keys)) if keys else lines.crossJoin(points)


def static_feature() -> Column:
    """[length, width, curb, crossing, walk]; unknown counts 0."""
    zero = F.lit(0.0)
    flag = lambda c, v: F.coalesce((F.col(c) == v).cast("double"), zero)
    return F.array(*[F.coalesce(number(c), zero) for c in NUMBERS], flag("crossing", "Yes"), flag("path_type", "walk"))


def feature_graph(edges: DataFrame) -> DataFrame:
    """Simple undirected graph: of the edges of one node pair, in either direction, the last (largest id) stays."""
    pair = [F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")]
    rows = edges.select(*pair, "edge_id", "src", "dst", static_feature().alias("feature"))
    return rows.groupBy("a", "b").agg(F.max_by(F.struct("edge_id", "src", "dst", "feature"), "edge_id").alias("e")).select("a", "b", "e.edge_id", "e.src", "e.dst", "e.feature")


def edge_index(edges: DataFrame) -> DataFrame:
    """(src, dst, edge_id): of each directed pair of ends the last edge."""
    return edges.groupBy("src", "dst").agg(F.max("edge_id").alias("edge_id"))


def dynamic_feature(graph: DataFrame, current_x: Column, current_y: Column) -> DataFrame:
    """The second vector layout: ends, static feature, ends again, current place; from ``feature_graph`` rows with
    columns x1, y1, x2, y2, feature."""
    ends = [F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")]
    return graph.withColumn("feature_vec", F.concat(F.array(*ends), F.col("feature"), F.array(*ends, current_x.cast("double"), current_y.cast("double"))))


def dynamic_features(states: DataFrame, graph: DataFrame) -> DataFrame:
    """``states`` (…, state array<double>, edge_id) with ``feature_vec``: the second layout of the edge, whose current place
    are the last two slots of the state. An edge that ``graph`` lacks gives null, a state of fewer slots a null place."""
    edges = graph.select("edge_id", "x1", "y1", "x2", "y2", "feature")
    place = lambda k: F.try_element_at("state", F.lit(k))
    rows = dynamic_feature(states.join(edges, "edge_id", "left"), place(-2), place(-1))
    return rows.drop("x1", "y1", "x2", "y2", "feature").withColumn("feature_vec", F.when(F.size("feature_vec") > 0, F.col("feature_vec")))


def rounded(value: Column, digits: int = 5) -> Column:
    """Half-up rounding of the shortest decimal form."""
    return F.round(value, digits)


def same_map(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """(keys, equal): whether both tables hold the same readable lines equally often, of each value of ``keys``. Lines are
    counted per key and side by partial aggregation; an unreadable line is none."""
    lines = lambda df, n: df.select(*keys, line_coords(F.col("geometry")).alias("c"), F.lit(n).alias("n"))
    counted = lines(left, 1).unionAll(lines(right, -1)).groupBy(*keys, "c").agg(F.sum("n").alias("n"))
    return counted.groupBy(*keys).agg(F.coalesce(F.bool_and(F.col("c").isNull() | (F.col("n") == 0)), F.lit(True)).alias("equal"))


def centroid(coords: Column) -> Column:
    """Length-weighted middle of a line; of a line without length its first vertex."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(coords) - 1), lambda i: F.struct(F.element_at(coords, i).alias("a"), F.element_at(coords, i + 1).alias("b")))
    start = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(s: Column, p: Column) -> Column:
        d = F.hypot(p.b.x - p.a.x, p.b.y - p.a.y)
        return F.struct((s.w + d).alias("w"), (s.x + d * (p.a.x + p.b.x) / 2).alias("x"), (s.y + d * (p.a.y + p.b.y) / 2).alias("y"))

    total = F.aggregate(pairs, start, add)
    first = F.element_at(coords, 1)
    return F.when(total.w > 0, F.struct((total.x / total.w).alias("x"), (total.y / total.w).alias("y"))).otherwise(F.struct(first.x.alias("x"), first.y.alias("y")))


def to_rd(latitude: Column, longitude: Column) -> Column:
    """WGS 84 degrees to Dutch national grid metres, by the published approximation polynomials (about 0.25 m)."""
    f, g = (latitude - 52.15517440) * 0.36, (longitude - 5.38720621) * 0.36
    #: Coefficients (power of f, power of g, value) of the published polynomials.
    east = [(0, 1, 190094.945), (1, 1, -11832.228), (2, 1, -114.221), (0, 3, -32.391), (1, 0, -0.705), (3, 1, -2.340), (1, 3, -0.608), (0, 2, -0.008), (2, 3, 0.148)]
    north = [(1, 0, 309056.544), (0, 2, 3638.893), (2, 0, 73.077), (1, 2, -157.984), (3, 0, 59.788), (0, 1, 0.433), (2, 2, -6.439), (1, 1, -0.032), (0, 4, 0.092), (1, 4, -0.054)]
    poly = lambda terms, base: sum((v * F.pow(f, F.lit(p)) * F.pow(g, F.lit(q)) for p, q, v in terms), F.lit(base))
    return F.struct(poly(east, 155000.0).alias("x"), poly(north, 463000.0).alias("y"))
