"""Queries over the street network and its graph, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymill.functions.wkt import centimetres, line_coords, line_text, point_xy
from waymill.operators import graph, network, routes
from waymill.plans.sql import EDGES, LINES
from waymill.sources.tables import table


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return network.network_edges(table(spark, d, "network_map"))


def _micro(c: Column) -> Column:
    """Whole millionths, rounded half up: doubles that engines can compare exactly."""
    return F.floor(c * 1e6 + 0.5).cast("bigint")


def as_text(values: Column) -> Column:
    """An array of doubles as whole millionths in one text; ``inf`` where infinite."""
    return F.array_join(F.transform(values, lambda x: F.when(F.abs(x) == float("inf"), "inf").otherwise(_micro(x).cast("string"))), " ")


def network_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).select("edge_id", "map_id", "x1", "y1", "x2", "y2", "n_vertices", _micro(F.col("length")).alias("length_micro"))


def weight_profiles(spark: SparkSession, d: str) -> DataFrame:
    """All edges for all user models, weights over the largest of each map."""
    w = network.weighted(table(spark, d, "network_map"), table(spark, d, "user_model"), within=("map_id",))
    return w.select("edge_id", "profile_id", "include", _micro(F.col("my_weight")).alias("weight_micro"), "oneway")


def weight_recovery(spark: SparkSession, d: str) -> DataFrame:
    w = network.weighted(table(spark, d, "network_map"), table(spark, d, "user_model"), recover=True)
    return w.select("edge_id", "profile_id", "include")


def selected_edges(spark: SparkSession, d: str) -> DataFrame:
    return network.selected(table(spark, d, "network_map")).groupBy("map_id").agg(F.count(F.lit(1)).alias("n"))


def arcs_directed(spark: SparkSession, d: str) -> DataFrame:
    return network.directed_arcs(_edges(spark, d)).select("edge_id", "src", "dst", "oneway", "reverse")


def arcs_without_loops(spark: SparkSession, d: str) -> DataFrame:
    return network.without_self_loops(network.directed_arcs(_edges(spark, d))).agg(F.count(F.lit(1)).alias("n"))


def neighbours(spark: SparkSession, d: str) -> DataFrame:
    n = network.neighbours(network.directed_arcs(_edges(spark, d)))
    return n.select("src", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), " ").alias("neighbours"))


def out_degree_max(spark: SparkSession, d: str) -> DataFrame:
    return network.out_degrees(network.directed_arcs(_edges(spark, d))).agg(F.max("degree").alias("max_degree"))


def parallel_edge_min(spark: SparkSession, d: str) -> DataFrame:
    arcs = network.directed_arcs(_edges(spark, d)).withColumn("w", F.col("length") / 1000)
    return network.cheapest_arcs(arcs, "w", by=["map_id"]).select("map_id", "src", "dst", "edge_id", _micro(F.col("weight")).alias("weight_micro"))


def feature_graph(spark: SparkSession, d: str) -> DataFrame:
    g = network.feature_graph(_edges(spark, d))
    return g.select("a", "b", "edge_id", as_text(F.col("feature")).alias("feature"))


def edge_index(spark: SparkSession, d: str) -> DataFrame:
    return network.edge_index(_edges(spark, d))


def feature_layout2(spark: SparkSession, d: str) -> DataFrame:
    """Second vector layout of each stored step's edge; the current place is that of the last state: the training route's
    step before, by the last two slots of its vector."""
    e = _edges(spark, d).withColumn("feature", network.static_feature())
    clean = F.transform("feature_vec", lambda x: F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)))
    states = table(spark, d, "sampled_train").where(F.col("feature_vec").isNotNull()).groupBy("route_id", "step_id").agg(F.min(clean).alias("state"))
    taken = table(spark, d, "route_edges").groupBy("route_id", "step_id").agg(F.min("edge_id").alias("edge_id"))
    asked = taken.join(states.withColumn("step_id", F.col("step_id") + 1), ["route_id", "step_id"])
    f = network.dynamic_features(asked, e)
    return f.select("route_id", "step_id", "edge_id", as_text(F.col("feature_vec")).alias("feature_vec"))


def bounds(spark: SparkSession, d: str) -> DataFrame:
    return network.bounds(table(spark, d, "network_map"), "map_id")


def vertex_counts(spark: SparkSession, d: str) -> DataFrame:
    return network.vertex_statistics(table(spark, d, "network_map"), "map_id")


def total_length(spark: SparkSession, d: str) -> DataFrame:
    milli = F.floor(F.col("length") * 1000 + 0.5).cast("bigint")
    return _edges(spark, d).groupBy("map_id").agg(F.sum(milli).alias("length_milli"))


def max_abs_length(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "network_map").agg(_micro(F.max(F.abs(network.number("length")))).alias("max_micro"))


def rounded_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Edges between nodes rounded to whole metres: ends rewritten, nodes merged; self-loops that arise are marked."""
    e = graph.relabelled(_edges(spark, d))
    return e.select("edge_id", "x1", "y1", "x2", "y2", (F.col("src") == F.col("dst")).alias("is_loop"))


def rounding(spark: SparkSession, d: str) -> DataFrame:
    """The first vertex of each edge in kilometres, rounded to 5 digits."""
    return _edges(spark, d).select("edge_id", *[F.floor(network.rounded(F.col(f"{a}1") / 100_000, 5) * 1e5 + 0.5).cast("bigint").alias(a) for a in ("x", "y")])


def map_equality(spark: SparkSession, d: str) -> DataFrame:
    """Of each map, whether its readable lines are those of its edges: they aren't where an edge was delivered twice."""
    return network.same_map(table(spark, d, "network_map"), _edges(spark, d), "map_id")


def wkt_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Readable lines written again, and whether the text reads as the same line."""
    c = line_coords(F.col("geometry"))
    text = line_text(c)
    return table(spark, d, "network_map").where(c.isNotNull()).select("edge_id", F.size(c).cast("bigint").alias("n"), text.alias("wkt"), (line_coords(text) == c).alias("same"))


def centroids(spark: SparkSession, d: str) -> DataFrame:
    """Middle of each edge's line, in whole millimetres."""
    c = network.centroid(line_coords(F.col("geometry")))
    return _edges(spark, d).select("edge_id", c.alias("c")).select("edge_id", *[F.floor(F.col("c")[a] * 1000 + 0.5).cast("bigint").alias(a) for a in ("x", "y")])


def grid_places(spark: SparkSession, d: str) -> DataFrame:
    """National grid metres of points a thousandth of a degree apart, numbered by the keys of customers."""
    k = F.col("c_custkey")
    rd = network.to_rd(F.lit(51.5) + (k % 1000) / 1000, F.lit(4.5) + F.floor(k / 1000) % 1000 / 1000)
    return table(spark, d, "customer").select(k.alias("id"), rd.alias("p")).select("id", *[F.floor(F.col("p")[a] * 100 + 0.5).cast("bigint").alias(f"{a}_cm") for a in ("x", "y")])


def _links(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).select("map_id", F.col("src").alias("u"), F.col("dst").alias("v"))


def components(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(_links(spark, d), by=["map_id"])


def component_sizes(spark: SparkSession, d: str) -> DataFrame:
    return graph.component_sizes(graph.components(_links(spark, d), by=["map_id"]), "map_id")


def selected_network(spark: SparkSession, d: str) -> DataFrame:
    """Included edges in the two largest components of each map."""
    return graph.selected_network(_edges(spark, d)).select("edge_id")


def two_networks(spark: SparkSession, d: str) -> DataFrame:
    """The arcs of the full and of the selected network."""
    arcs = lambda df, name: df.select(F.lit(name).alias("network"), "map_id", "edge_id", "src", "dst", "reverse")
    full, chosen = graph.two_networks(_edges(spark, d))
    return arcs(full, "full").unionAll(arcs(chosen, "selected"))


def _ends(spark: SparkSession, d: str) -> DataFrame:
    p = point_xy(F.col("geometry"))
    return table(spark, d, "start_end").select("point_id", "route_id", "map_id", "coordinates", p.alias("p")).where(F.col("p").isNotNull()).dropDuplicates(["point_id"])


def nearest_node(spark: SparkSession, d: str) -> DataFrame:
    """Each readable origin and destination with the nearest network node of its map."""
    ends = _ends(spark, d).where(F.col("coordinates").isin("origin", "destination"))
    points = ends.select("map_id", F.col("point_id").alias("id"), centimetres(F.col("p.x")).alias("x"), centimetres(F.col("p.y")).alias("y"))
    e = _edges(spark, d)
    nodes = e.select("map_id", F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("dst").alias("node"), F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("n")).select("map_id", "n.*")
    return graph.nearest_nodes(points, nodes, by=["map_id"]).select(F.col("id").alias("point_id"), "node_x", "node_y", F.col("d2").cast("bigint").alias("d2"))


def viewport_join(spark: SparkSession, d: str) -> DataFrame:
    """Network edges around the origin and destination of each route."""
    ends = _ends(spark, d).where(F.col("coordinates").isin("origin", "destination")).select("route_id", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    return routes.viewport_edges(ends, _edges(spark, d))


def hash_od_points(spark: SparkSession, d: str) -> DataFrame:
    return graph.random_od_points(network.bounds(table(spark, d, "network_map")), 50_000)


def _profiled(spark: SparkSession, d: str) -> DataFrame:
    """The edges of every user model with its include flags and weights."""
    return network.weighted(_edges(spark, d), table(spark, d, "user_model"), within=("map_id",))


def _trips(spark: SparkSession, d: str) -> DataFrame:
    """The ends of each stored trip on its map, with the profile of its route; the standard user model where no route is
    stored."""
    ends = _ends(spark, d).where(F.col("coordinates").isin("origin", "destination"))
    own = table(spark, d, "route_edges").groupBy("route_id").agg(F.min("profile_id").alias("profile_id"))
    return ends.join(own, "route_id", "left").select(
        F.coalesce("profile_id", F.lit("um_std")).alias("profile_id"), "map_id", F.col("route_id").alias("id"), F.col("coordinates").alias("role"), centimetres(F.col("p.x")).alias("x"), centimetres(F.col("p.y")).alias("y")
    )


def generated_routes(spark: SparkSession, d: str) -> DataFrame:
    """Least-cost route edges between the ends of all stored trips, each for the user model of its route."""
    r = graph.generate_routes(_profiled(spark, d), _trips(spark, d), by=("profile_id",))[0]
    return r.select("id", "step_id", "edge_id", "src", "dst", _micro(F.col("weight")).alias("weight_micro"))


def route_costs(spark: SparkSession, d: str) -> DataFrame:
    """Cost, number of steps and straight length of each trip's path."""
    paths, _, _ = graph.generate_paths(_profiled(spark, d), _trips(spark, d), by=("profile_id",))
    lines = graph.path_line(paths).select("id", F.floor(F.col("length") * 100 + 0.5).cast("bigint").alias("length_cm"))
    return paths.select("id", "cost", "hops").join(lines, "id")


def celled_routes(spark: SparkSession, d: str) -> DataFrame:
    """The paths of ``route_costs``, searched over maps cut into cells of some 256 nodes."""
    edges, trips = _profiled(spark, d), _trips(spark, d)
    paths, _, _ = graph.generate_paths(edges, trips, by=("profile_id",), cell_nodes=256)
    return paths.select("id", "cost", "hops", F.array_join(F.transform("path", lambda n: n.cast("string")), " ").alias("path"))


def route_errors(spark: SparkSession, d: str) -> DataFrame:
    """Trips that give no route for the user model of their route, with the reason."""
    return graph.generate_routes(_profiled(spark, d), _trips(spark, d), by=("profile_id",))[1]


QUERIES = {
    f.__name__: f
    for f in (
        network_edges, weight_profiles, weight_recovery, selected_edges, arcs_directed, arcs_without_loops, neighbours, out_degree_max, parallel_edge_min, feature_graph, edge_index,
        feature_layout2, bounds, vertex_counts, total_length, max_abs_length, rounded_nodes, rounding, map_equality, wkt_roundtrip, centroids, grid_places, components, component_sizes,
        selected_network, two_networks, nearest_node, viewport_join, hash_od_points, generated_routes, route_costs, celled_routes, route_errors,
    )
}

_ARCS = EDGES + """,
    arcs AS (
        SELECT *, FALSE AS reverse, bikepath_id IS NOT NULL AS oneway, x1 * 4294967296 + y1 AS src, x2 * 4294967296 + y2 AS dst FROM edges
        UNION ALL
        SELECT *, TRUE, FALSE, x2 * 4294967296 + y2, x1 * 4294967296 + y1 FROM edges WHERE bikepath_id IS NULL)"""

_LABELS = """,
    pairs AS ({pairs}),
    both_ways AS (SELECT g, u, v FROM pairs UNION SELECT g, v, u FROM pairs UNION SELECT g, u, u FROM pairs UNION SELECT g, v, v FROM pairs),
    label(g, node, component) USING KEY (g, node) AS (
        SELECT g, u, min(v) FROM both_ways GROUP BY g, u
        UNION
        SELECT b.g, b.u, min(l.component) FROM label l JOIN both_ways b ON b.g = l.g AND b.v = l.node JOIN recurring.label r ON r.g = b.g AND r.node = b.u
        WHERE l.component < r.component GROUP BY b.g, b.u)"""

#: The two largest components of each map among included edges.
_CHOSEN = """,
    ranked AS (SELECT g, component, row_number() OVER (PARTITION BY g ORDER BY count(*) DESC, component) AS k FROM label GROUP BY g, component),
    kept AS (SELECT l.g, l.node FROM label l JOIN ranked r ON r.g = l.g AND r.component = l.component WHERE r.k <= 2)"""

_WEIGHTS = """
    WITH n AS (
        SELECT *, CASE WHEN isnan(length) THEN NULL ELSE length END AS len, CASE WHEN isnan(curb_height_max) THEN NULL ELSE curb_height_max END AS curb,
               CASE WHEN isnan(obstacle_free_width_float) THEN NULL ELSE obstacle_free_width_float END AS width FROM network_map),
    w AS (
        SELECT edge_id, map_id, profile_id, bikepath_id IS NOT NULL AS oneway, curb > max_curb_height AS high, width < min_sidewalk_width AS narrow, curb <= max_curb_height AS low,
               width >= min_sidewalk_width AS wide, include,
               len * CASE WHEN crossing = 'Yes' THEN crossing_weight_factor ELSE 1 END
                   * CASE WHEN walk_bike_preference IN ('walk', 'bike') AND path_type = walk_bike_preference THEN walk_bike_preference_weight_factor ELSE 1 END AS raw
        FROM n CROSS JOIN user_model)"""

_POINTS = """
    raw AS (
        SELECT DISTINCT ON (point_id) point_id, route_id, map_id, coordinates,
               string_split_regex(trim(regexp_extract(geometry, '(?i)^\\s*(SRID=\\d+;)?\\s*POINT\\s*Z?\\s*\\(([-+0-9.eE\\s]+)\\)\\s*$', 2)), '\\s+') AS w
        FROM start_end WHERE coordinates IN ('origin', 'destination')),
    pt AS (
        SELECT point_id, route_id, map_id, coordinates, TRY_CAST(w[1] AS DOUBLE) AS x, TRY_CAST(w[2] AS DOUBLE) AS y FROM raw
        WHERE TRY_CAST(w[1] AS DOUBLE) IS NOT NULL AND TRY_CAST(w[2] AS DOUBLE) IS NOT NULL)"""

_INCLUDED = (
    "WITH RECURSIVE "
    + EDGES.replace("WITH ", "", 1)
    + _LABELS.format(pairs="SELECT map_id AS g, x1 * 4294967296 + y1 AS u, x2 * 4294967296 + y2 AS v FROM edges WHERE include = 1")
    + _CHOSEN
)

#: Trips over the selected network of each profile and map (g): best labels by relaxation, packed as cost, hops and previous
#: node in one number, and the steps of each trip's path, traced back.
_PATHS = (
    "WITH RECURSIVE "
    + EDGES.replace("WITH ", "", 1)
    + """,
    profiled AS (
        SELECT edge_id, map_id, profile_id, profile_id || ' ' || map_id AS g, bikepath_id, x1, y1, x2, y2, CASE WHEN curb > max_curb_height OR width < min_sidewalk_width THEN 0 ELSE include END AS flag,
               length * CASE WHEN crossing = 'Yes' THEN crossing_weight_factor ELSE 1 END
                      * CASE WHEN walk_bike_preference IN ('walk', 'bike') AND path_type = walk_bike_preference THEN walk_bike_preference_weight_factor ELSE 1 END AS raw
        FROM edges CROSS JOIN user_model),
    scaled AS (SELECT *, raw / nullif(max(abs(raw)) OVER (PARTITION BY g), 0) AS my_weight FROM profiled),
    usable AS (SELECT *, x1 * 4294967296 + y1 AS src, x2 * 4294967296 + y2 AS dst FROM scaled WHERE flag = 1)"""
    + _LABELS.format(pairs="SELECT g, src AS u, dst AS v FROM usable")
    + _CHOSEN
    + """,
    chosen AS (SELECT u.* FROM usable u JOIN kept k ON k.g = u.g AND k.node = u.src),
    arc AS (SELECT g, profile_id, map_id, edge_id, src, dst, my_weight FROM chosen UNION ALL SELECT g, profile_id, map_id, edge_id, dst, src, my_weight FROM chosen WHERE bikepath_id IS NULL),
    best AS (
        SELECT g, src, dst, edge_id, w AS weight, CAST(greatest(0, round(w * 1e6)) AS BIGINT) AS cost FROM (
            SELECT *, coalesce(my_weight, 1.0) AS w, row_number() OVER (PARTITION BY g, src, dst ORDER BY coalesce(my_weight, 1.0), edge_id) AS rn FROM arc) WHERE rn = 1),
    node AS (SELECT g, src AS node, src // 4294967296 AS nx, src % 4294967296 AS ny FROM arc UNION SELECT g, dst, dst // 4294967296, dst % 4294967296 FROM arc),
    """
    + _POINTS
    + """,
    own AS (SELECT route_id, min(profile_id) AS profile_id FROM route_edges GROUP BY route_id),
    asked AS (
        SELECT route_id AS id, coordinates AS role, coalesce(profile_id, 'um_std') || ' ' || map_id AS g, CAST(floor(x * 100 + 0.5) AS BIGINT) AS x, CAST(floor(y * 100 + 0.5) AS BIGINT) AS y
        FROM pt LEFT JOIN own USING (route_id)),
    snapped AS (
        SELECT a.id, a.role, a.g, arg_min(node, ((x - nx) * (x - nx) + (y - ny) * (y - ny), nx, ny)) AS node FROM asked a LEFT JOIN node USING (g) GROUP BY a.id, a.role, a.g),
    trip AS (SELECT id, g, max(node) FILTER (role = 'origin') AS origin, max(node) FILTER (role = 'destination') AS destination FROM snapped GROUP BY id, g),
    dist(g, origin, node, d) USING KEY (g, origin, node) AS (
        SELECT DISTINCT g, origin, origin, CAST(0 AS HUGEINT) FROM trip WHERE origin <> destination
        UNION
        SELECT n.g, n.origin, n.node, n.d FROM (
            SELECT l.g, l.origin, a.dst AS node, min((l.d // 4611686018427387904 + a.cost * 4096 + 1) * 4611686018427387904 + a.src) AS d
            FROM dist l JOIN best a ON a.g = l.g AND a.src = l.node GROUP BY l.g, l.origin, a.dst) n
        LEFT JOIN recurring.dist r ON r.g = n.g AND r.origin = n.origin AND r.node = n.node WHERE r.d IS NULL OR n.d < r.d),
    back(id, g, origin, node) AS (
        SELECT id, t.g, t.origin, destination FROM trip t JOIN dist x ON x.g = t.g AND x.origin = t.origin AND x.node = t.destination WHERE t.origin <> t.destination
        UNION ALL
        SELECT b.id, b.g, b.origin, CAST(x.d % 4611686018427387904 AS BIGINT) FROM back b JOIN dist x ON x.g = b.g AND x.origin = b.origin AND x.node = b.node WHERE b.node <> b.origin),
    step AS (
        SELECT b.id, b.g, CAST(x.d // 4611686018427387904 % 4096 - 1 AS INTEGER) AS step_id, CAST(x.d % 4611686018427387904 AS BIGINT) AS src, b.node AS dst
        FROM back b JOIN dist x ON x.g = b.g AND x.origin = b.origin AND x.node = b.node WHERE b.node <> b.origin)"""
)

ORACLE = {
    "network_edges": EDGES + " SELECT edge_id, map_id, x1, y1, x2, y2, n_vertices, CAST(floor(length * 1e6 + 0.5) AS BIGINT) AS length_micro FROM edges",
    "weight_profiles": _WEIGHTS
    + """, m AS (SELECT profile_id, map_id, max(abs(raw)) AS most FROM w GROUP BY 1, 2)
        SELECT edge_id, profile_id, CAST(CASE WHEN high OR narrow THEN 0 ELSE include END AS INTEGER) AS include,
               CAST(floor(raw / nullif(most, 0) * 1e6 + 0.5) AS BIGINT) AS weight_micro, oneway FROM w JOIN m USING (profile_id, map_id)""",
    "weight_recovery": _WEIGHTS
    + " SELECT edge_id, profile_id, CAST(CASE WHEN high OR narrow THEN 0 WHEN low OR wide THEN 1 ELSE include END AS INTEGER) AS include FROM w",
    "selected_edges": "SELECT map_id, count(*) AS n FROM network_map WHERE include = 1 GROUP BY map_id",
    "arcs_directed": _ARCS + " SELECT edge_id, src, dst, oneway, reverse FROM arcs",
    "arcs_without_loops": _ARCS + " SELECT count(*) AS n FROM arcs WHERE src <> dst",
    "neighbours": _ARCS + " SELECT src, array_to_string(list_sort(list(DISTINCT dst)), ' ') AS neighbours FROM arcs GROUP BY src",
    "out_degree_max": _ARCS + " SELECT max(n) AS max_degree FROM (SELECT src, count(DISTINCT dst) AS n FROM arcs GROUP BY src)",
    "parallel_edge_min": _ARCS
    + """, r AS (SELECT *, coalesce(length / 1000, 1.0) AS w, row_number() OVER (PARTITION BY map_id, src, dst ORDER BY coalesce(length / 1000, 1.0), edge_id) AS rn FROM arcs)
        SELECT map_id, src, dst, edge_id, CAST(floor(w * 1e6 + 0.5) AS BIGINT) AS weight_micro FROM r WHERE rn = 1""",
    "feature_graph": EDGES
    + """, f AS (SELECT *, x1 * 4294967296 + y1 AS src, x2 * 4294967296 + y2 AS dst FROM edges),
        g AS (SELECT *, least(src, dst) AS a, greatest(src, dst) AS b, row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY edge_id DESC) AS rn FROM f)
        SELECT a, b, edge_id, array_to_string(list_transform([coalesce(length, 0), coalesce(width, 0), coalesce(curb, 0), CASE WHEN crossing = 'Yes' THEN 1.0 ELSE 0 END,
               CASE WHEN path_type = 'walk' THEN 1.0 ELSE 0 END], lambda x: CASE WHEN isinf(x) THEN 'inf' ELSE CAST(CAST(floor(x * 1e6 + 0.5) AS BIGINT) AS VARCHAR) END), ' ') AS feature FROM g WHERE rn = 1""",
    "edge_index": EDGES + " SELECT x1 * 4294967296 + y1 AS src, x2 * 4294967296 + y2 AS dst, max(edge_id) AS edge_id FROM edges GROUP BY 1, 2",
    "feature_layout2": EDGES
    + """, state AS (
            SELECT route_id, step_id + 1 AS step_id, min(list_transform(feature_vec, lambda x: CASE WHEN x IS NULL OR isnan(x) THEN 0 ELSE x END)) AS s FROM sampled_train
            WHERE feature_vec IS NOT NULL GROUP BY ALL),
        taken AS (SELECT route_id, step_id, min(edge_id) AS edge_id FROM route_edges GROUP BY ALL)
        SELECT t.route_id, t.step_id, t.edge_id, CASE WHEN e.edge_id IS NOT NULL THEN array_to_string(list_transform(
               [x1, y1, x2, y2, coalesce(length, 0), coalesce(width, 0), coalesce(curb, 0), CASE WHEN crossing = 'Yes' THEN 1.0 ELSE 0 END,
               CASE WHEN path_type = 'walk' THEN 1.0 ELSE 0 END, x1, y1, x2, y2, s[-2], s[-1]], lambda x: CASE WHEN isinf(x) THEN 'inf' ELSE CAST(CAST(floor(x * 1e6 + 0.5) AS BIGINT) AS VARCHAR) END), ' ') END AS feature_vec
        FROM taken t JOIN state USING (route_id, step_id) LEFT JOIN edges e USING (edge_id)""",
    "bounds": LINES
    + """, v AS (SELECT map_id, unnest(c) AS p FROM lines)
        SELECT map_id, CAST(floor(min(CAST(p[1] AS DOUBLE)) * 100 + 0.5) AS BIGINT) AS min_x, CAST(floor(min(CAST(p[2] AS DOUBLE)) * 100 + 0.5) AS BIGINT) AS min_y,
               CAST(floor(max(CAST(p[1] AS DOUBLE)) * 100 + 0.5) AS BIGINT) AS max_x, CAST(floor(max(CAST(p[2] AS DOUBLE)) * 100 + 0.5) AS BIGINT) AS max_y FROM v GROUP BY map_id""",
    "vertex_counts": LINES
    + """, v AS (SELECT map_id, unnest(c) AS p FROM lines),
        n AS (SELECT map_id, count(DISTINCT (CAST(floor(CAST(p[1] AS DOUBLE) * 100 + 0.5) AS BIGINT), CAST(floor(CAST(p[2] AS DOUBLE) * 100 + 0.5) AS BIGINT))) AS n_vertices FROM v GROUP BY map_id)
        SELECT map_id, n_lines, n_vertices FROM (SELECT map_id, count(*) AS n_lines FROM network_map GROUP BY map_id) JOIN n USING (map_id)""",
    "total_length": EDGES + " SELECT map_id, CAST(sum(CAST(floor(length * 1000 + 0.5) AS BIGINT)) AS BIGINT) AS length_milli FROM edges GROUP BY map_id",
    "max_abs_length": "SELECT CAST(floor(max(abs(length)) * 1e6 + 0.5) AS BIGINT) AS max_micro FROM network_map WHERE NOT isnan(length)",
    "rounded_nodes": EDGES
    + """, m AS (SELECT edge_id, CAST((x1 + 50) // 100 * 100 AS BIGINT) AS x1, CAST((y1 + 50) // 100 * 100 AS BIGINT) AS y1, CAST((x2 + 50) // 100 * 100 AS BIGINT) AS x2,
               CAST((y2 + 50) // 100 * 100 AS BIGINT) AS y2 FROM edges)
        SELECT *, x1 = x2 AND y1 = y2 AS is_loop FROM m""",
    "rounding": EDGES + " SELECT edge_id, CAST(x1 AS BIGINT) AS x, CAST(y1 AS BIGINT) AS y FROM edges",
    "map_equality": EDGES
    + """, n AS (
            SELECT map_id, list_transform(c, lambda p: (CAST(p[1] AS DOUBLE), CAST(p[2] AS DOUBLE))) AS c, 1 AS n FROM lines
            UNION ALL SELECT map_id, list_transform(c, lambda p: (CAST(p[1] AS DOUBLE), CAST(p[2] AS DOUBLE))), -1 FROM edges),
        s AS (SELECT map_id, c, sum(n) AS n FROM n GROUP BY map_id, c)
        SELECT m.map_id, count(s.n) FILTER (s.n <> 0) = 0 AS equal FROM (SELECT DISTINCT map_id FROM network_map) m LEFT JOIN s USING (map_id) GROUP BY m.map_id""",
    "wkt_roundtrip": LINES
    + """ SELECT edge_id, len(c) AS n, 'LINESTRING (' || array_to_string(list_transform(c, lambda p: CAST(CAST(p[1] AS DOUBLE) AS VARCHAR) || ' ' || CAST(CAST(p[2] AS DOUBLE) AS VARCHAR)), ', ') || ')' AS wkt,
          list_transform(c, lambda p: CAST(CAST(CAST(p[1] AS DOUBLE) AS VARCHAR) AS DOUBLE)) = list_transform(c, lambda p: CAST(p[1] AS DOUBLE)) AS same FROM lines""",
    "centroids": EDGES
    + """, v AS (SELECT edge_id, c, unnest(range(1, len(c))) AS k FROM edges),
        s AS (SELECT edge_id, CAST(c[1][1] AS DOUBLE) AS fx, CAST(c[1][2] AS DOUBLE) AS fy, CAST(c[k][1] AS DOUBLE) AS ax, CAST(c[k][2] AS DOUBLE) AS ay, CAST(c[k + 1][1] AS DOUBLE) AS bx, CAST(c[k + 1][2] AS DOUBLE) AS b_y FROM v),
        w AS (SELECT *, sqrt((bx - ax) ** 2 + (b_y - ay) ** 2) AS d FROM s)
        SELECT edge_id, CAST(floor(CASE WHEN sum(d) > 0 THEN sum(d * (ax + bx) / 2) / sum(d) ELSE min(fx) END * 1000 + 0.5) AS BIGINT) AS x,
               CAST(floor(CASE WHEN sum(d) > 0 THEN sum(d * (ay + b_y) / 2) / sum(d) ELSE min(fy) END * 1000 + 0.5) AS BIGINT) AS y FROM w GROUP BY edge_id""",
    "grid_places": """
        WITH p AS (SELECT c_custkey AS id, (51.5 + (c_custkey % 1000) / 1000 - 52.15517440) * CAST(0.36 AS DOUBLE) AS f, (4.5 + floor(c_custkey / 1000) % 1000 / 1000 - 5.38720621) * CAST(0.36 AS DOUBLE) AS g FROM customer)
        SELECT id, CAST(floor((155000.0 + 190094.945 * g - 11832.228 * f * g - 114.221 * f ** 2 * g - 32.391 * g ** 3 - 0.705 * f - 2.340 * f ** 3 * g - 0.608 * f * g ** 3 - 0.008 * g ** 2 + 0.148 * f ** 2 * g ** 3) * 100 + 0.5) AS BIGINT) AS x_cm,
               CAST(floor((463000.0 + 309056.544 * f + 3638.893 * g ** 2 + 73.077 * f ** 2 - 157.984 * f * g ** 2 + 59.788 * f ** 3 + 0.433 * g - 6.439 * f ** 2 * g ** 2 - 0.032 * f * g + 0.092 * g ** 4 - 0.054 * f * g ** 4) * 100 + 0.5) AS BIGINT) AS y_cm FROM p""",
    "components": "WITH RECURSIVE " + EDGES.replace("WITH ", "", 1)
    + _LABELS.format(pairs="SELECT map_id AS g, x1 * 4294967296 + y1 AS u, x2 * 4294967296 + y2 AS v FROM edges")
    + " SELECT g AS map_id, node, component FROM label",
    "component_sizes": "WITH RECURSIVE " + EDGES.replace("WITH ", "", 1)
    + _LABELS.format(pairs="SELECT map_id AS g, x1 * 4294967296 + y1 AS u, x2 * 4294967296 + y2 AS v FROM edges")
    + " SELECT g AS map_id, component, count(*) AS size, row_number() OVER (PARTITION BY g ORDER BY count(*) DESC, component) AS rank FROM label GROUP BY g, component",
    "selected_network": _INCLUDED + " SELECT edge_id FROM edges e JOIN kept ON g = e.map_id AND node = x1 * 4294967296 + y1 WHERE include = 1",
    "two_networks": _INCLUDED
    + """, both_networks AS (
            SELECT 'full' AS network, * FROM edges
            UNION ALL SELECT 'selected', e.* FROM edges e JOIN kept ON g = e.map_id AND node = x1 * 4294967296 + y1 WHERE include = 1)
        SELECT network, map_id, edge_id, x1 * 4294967296 + y1 AS src, x2 * 4294967296 + y2 AS dst, FALSE AS reverse FROM both_networks
        UNION ALL SELECT network, map_id, edge_id, x2 * 4294967296 + y2, x1 * 4294967296 + y1, TRUE FROM both_networks WHERE bikepath_id IS NULL""",
    "nearest_node": EDGES
    + ", " + _POINTS
    + """, node AS (SELECT map_id, x1 AS nx, y1 AS ny FROM edges UNION SELECT map_id, x2, y2 FROM edges),
        q AS (SELECT point_id, map_id, CAST(floor(x * 100 + 0.5) AS BIGINT) AS x, CAST(floor(y * 100 + 0.5) AS BIGINT) AS y FROM pt),
        r AS (
            SELECT point_id, nx, ny, (x - nx) * (x - nx) + (y - ny) * (y - ny) AS d2,
                   row_number() OVER (PARTITION BY point_id ORDER BY (x - nx) * (x - nx) + (y - ny) * (y - ny), nx, ny) AS k FROM q JOIN node USING (map_id))
        SELECT point_id, nx AS node_x, ny AS node_y, d2 FROM r WHERE k = 1""",
    "viewport_join": EDGES
    + ", " + _POINTS
    + """, vertex AS (SELECT edge_id, c, unnest(range(1, len(c))) AS k FROM edges),
        seg AS (SELECT edge_id, CAST(c[k][1] AS DOUBLE) AS x1, CAST(c[k][2] AS DOUBLE) AS y1, CAST(c[k + 1][1] AS DOUBLE) AS x2, CAST(c[k + 1][2] AS DOUBLE) AS y2 FROM vertex),
        cand AS (
            SELECT route_id, edge_id, x1 - x AS ax, y1 - y AS ay, x2 - x AS bx, y2 - y AS b_y FROM pt JOIN seg
            ON greatest(x1, x2) >= x - 70 AND least(x1, x2) <= x + 70 AND greatest(y1, y2) >= y - 70 AND least(y1, y2) <= y + 70),
        sided AS (
            SELECT *, (bx - ax) * (70 - ay) - (b_y - ay) * (70 - ax) AS s1, (bx - ax) * (70 - ay) - (b_y - ay) * (-70 - ax) AS s2,
                   (bx - ax) * (-70 - ay) - (b_y - ay) * (70 - ax) AS s3, (bx - ax) * (-70 - ay) - (b_y - ay) * (-70 - ax) AS s4 FROM cand)
        SELECT DISTINCT route_id, edge_id FROM sided WHERE least(s1, s2, s3, s4) <= 0 AND greatest(s1, s2, s3, s4) >= 0""",
    "hash_od_points": LINES
    + """, v AS (SELECT unnest(c) AS p FROM lines),
        b AS (SELECT CAST(floor(min(CAST(p[1] AS DOUBLE)) * 100 + 0.5) AS BIGINT) AS ax, CAST(floor(min(CAST(p[2] AS DOUBLE)) * 100 + 0.5) AS BIGINT) AS ay,
               CAST(floor(max(CAST(p[1] AS DOUBLE)) * 100 + 0.5) AS BIGINT) AS bx, CAST(floor(max(CAST(p[2] AS DOUBLE)) * 100 + 0.5) AS BIGINT) AS b_y FROM v),
        r AS (SELECT range AS id, CAST('0x' || substr(md5('1:' || range || ':x'), 1, 13) AS BIGINT) / 4503599627370496.0 AS ux, CAST('0x' || substr(md5('1:' || range || ':y'), 1, 13) AS BIGINT) / 4503599627370496.0 AS uy FROM range(100000))
        SELECT id // 2 AS route_id, CASE WHEN id % 2 = 0 THEN 'origin' ELSE 'destination' END AS role,
               CAST(floor(ax + CAST(ux AS DOUBLE) * (bx - ax)) AS BIGINT) AS x, CAST(floor(ay + CAST(uy AS DOUBLE) * (b_y - ay)) AS BIGINT) AS y FROM r, b""",
    "generated_routes": _PATHS
    + """ SELECT id, step_id, a.edge_id, t.src, t.dst, CAST(floor(a.weight * 1e6 + 0.5) AS BIGINT) AS weight_micro
        FROM step t JOIN best a ON a.g = t.g AND a.src = t.src AND a.dst = t.dst""",
    "route_costs": _PATHS
    + """, l AS (SELECT id, CAST(floor(sum(sqrt((CAST(dst // 4294967296 - src // 4294967296 AS DOUBLE) / 100) ** 2 + (CAST(dst % 4294967296 - src % 4294967296 AS DOUBLE) / 100) ** 2)) * 100 + 0.5) AS BIGINT) AS length_cm FROM step GROUP BY id)
        SELECT id, CAST(d // 4611686018427387904 // 4096 AS BIGINT) AS cost, CAST(d // 4611686018427387904 % 4096 AS BIGINT) AS hops, length_cm
        FROM trip JOIN dist ON dist.g = trip.g AND dist.origin = trip.origin AND dist.node = trip.destination JOIN l USING (id) WHERE trip.origin <> trip.destination""",
    "celled_routes": _PATHS
    + """, p AS (SELECT id, any_value(g) AS g, array_to_string([CAST(min(src) FILTER (step_id = 0) AS VARCHAR)] || list(CAST(dst AS VARCHAR) ORDER BY step_id), ' ') AS path FROM step GROUP BY id)
        SELECT id, CAST(d // 4611686018427387904 // 4096 AS BIGINT) AS cost, CAST(d // 4611686018427387904 % 4096 AS BIGINT) AS hops, path
        FROM trip JOIN dist ON dist.g = trip.g AND dist.origin = trip.origin AND dist.node = trip.destination JOIN p USING (id) WHERE trip.origin <> trip.destination""",
    "route_errors": _PATHS
    + """ SELECT id, CASE WHEN origin = destination THEN 'same node' WHEN origin IS NULL OR destination IS NULL THEN 'no node' ELSE 'no path' END AS reason
        FROM trip WHERE id NOT IN (SELECT id FROM step)""",
}
