import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymill.operators import graph, network
from waymill.operators.spread import fitted_tree, home_leaves, salted
from tests.test_network import edge, frame


def pack(x, y):
    return (x << 32) + y


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_union_find(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 460)] + [(500, 500)] + [(600, k) for k in range(601, 700)]
    parent = {x: x for p in pairs for x in p}
    for a, b in pairs:
        parent[find(parent, a)] = find(parent, b)
    names = {}
    for x in parent:
        names.setdefault(find(parent, x), []).append(x)
    want = {x: min(group) for group in names.values() for x in group}
    df = spark.createDataFrame([*pairs, *pairs[:50], (None, 1), (2, None)], "u bigint, v bigint")
    got = [tuple(r) for r in graph.components(df).collect()]
    want.setdefault(1, 1), want.setdefault(2, 2)
    assert len(got) == len(want) and dict(got) == want


def test_component_edges(spark):
    empty = spark.createDataFrame([], "u bigint, v bigint")
    assert graph.components(empty).collect() == []
    lone = graph.components(empty, spark.createDataFrame([(7,)], "node bigint")).collect()
    assert [tuple(r) for r in lone] == [(7, 7)]


def test_two_largest_components_stay(spark):
    line = lambda i, x, n, **k: [edge(i + j, f"LINESTRING ({x + j} 0, {x + j + 1} 0)", **k) for j in range(n)]
    rows = line(1, 0, 4) + line(10, 100, 3) + line(20, 200, 2) + [edge(30, "LINESTRING (4 0, 5 0)", include=0)]
    kept = graph.selected_network(network.network_edges(frame(spark, rows)))
    assert {r["edge_id"] for r in kept.collect()} == {1, 2, 3, 4, 10, 11, 12}


def test_nearest_node_against_brute_force(spark):
    rng = random.Random(4)
    nodes = [(k, rng.randrange(100_000), rng.randrange(100_000)) for k in range(700)] + [(9000, 5000, 5000), (9001, 5000, 5000)]
    points = [(k, rng.randrange(-20_000, 120_000), rng.randrange(-20_000, 120_000)) for k in range(300)] + [(900, 5000, 5000)]
    want = {i: min((float((x - a) ** 2 + (y - b) ** 2), a, b) for _, a, b in nodes) for i, x, y in points}
    p, n = spark.createDataFrame(points, "id bigint, x bigint, y bigint"), spark.createDataFrame(nodes, "node bigint, x bigint, y bigint")
    for leaf in (2048, 16):
        got = {r["id"]: (r["d2"], r["node_x"], r["node_y"]) for r in graph.nearest_nodes(p, n, leaf_rows=leaf).collect()}
        assert got == want
    assert graph.nearest_nodes(p, n.limit(0)).collect() == []
    assert graph.nearest_nodes(p.limit(0), n).collect() == []


def bellman(arcs, origin):
    best = {origin: 0}
    for _ in range(len(arcs)):
        changed = False
        for a, b, w in arcs:
            if a in best and best[a] + w < best.get(b, 1 << 60):
                best[b], changed = best[a] + w, True
        if not changed:
            return best


def test_shortest_paths_against_bellman_ford(spark):
    rng = random.Random(9)
    arcs = [(rng.randrange(60), rng.randrange(60), k, rng.choice([None, 0.25, 0.5, 1.5])) for k in range(150)]
    cost = [(a, b, round((1.0 if w is None else w) * 1e6)) for a, b, _, w in arcs]
    pairs = [(f"p{k}", "m", rng.randrange(60), rng.randrange(62)) for k in range(80)] + [("same", "m", 3, 3), ("null", "m", None, 3), ("other", "x", 1, 2)]
    a = spark.createDataFrame([(*x, "m") for x in arcs], "src bigint, dst bigint, edge_id bigint, my_weight double, map_id string")
    p = spark.createDataFrame(pairs, "id string, map_id string, origin bigint, destination bigint")
    trees = {o: bellman(cost, o) for o in range(60)}
    results = []
    for cell in (1000, 4):  # one cell, many cells
        paths, errors = graph.shortest_paths(a, p, cell_nodes=cell, origins_per_task=8)
        got = {r["id"]: r for r in paths.collect()}
        failed = {r["id"]: r["reason"] for r in errors.collect()}
        for i, _, o, d in pairs:
            if o is None:
                assert failed[i] == "no node"
            elif o == d:
                assert failed[i] == "same node"
            elif i == "other" or d not in trees[o]:
                assert failed[i] == "no path"
            else:
                r = got[i]
                assert (r["cost"], r["path"][0], r["path"][-1], len(r["path"])) == (trees[o][d], o, d, r["hops"] + 1)
                assert sum(min(w for x, y, w in cost if (x, y) == s) for s in zip(r["path"], r["path"][1:])) == r["cost"]
        results.append({k: tuple(r) for k, r in got.items()})
        steps = graph.path_edges(paths, a)
        assert steps.count() == sum(r["hops"] for r in got.values())
    assert results[0] == results[1]


def test_cells_give_the_same_paths_on_a_grid(spark):
    rng = random.Random(5)
    node = lambda x, y: pack(x * 1000 - 4000, y * 1000 - 5000)
    arcs = [(node(x, y), node(x + dx, y + dy), rng.randrange(1, 4) / 4) for x in range(9) for y in range(9) for dx, dy in ((1, 0), (0, 1), (-1, 0), (0, -1)) if rng.random() < 0.9]
    a = spark.createDataFrame([(u, v, k, w, "m") for k, (u, v, w) in enumerate(arcs)], "src bigint, dst bigint, edge_id bigint, my_weight double, map_id string")
    p = spark.createDataFrame([(f"p{k}", "m", node(rng.randrange(9), rng.randrange(9)), node(rng.randrange(9), rng.randrange(9))) for k in range(40)], "id string, map_id string, origin bigint, destination bigint")
    whole, some = graph.shortest_paths(a, p), graph.shortest_paths(a, p, cell_nodes=12, origins_per_task=3)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(whole[0]) == rows(some[0]) and rows(whole[1]) == rows(some[1]) and len(rows(whole[0])) > 20


def test_overlapping_maps_stay_apart(spark):
    # two maps over the same places, south of the origin; only "b" has the link, only "a" the far part
    rows = [edge(1, "LINESTRING (0 -10, 5 -10)", map_id="a", length=5.0), edge(2, "LINESTRING (7 -10, 9 -3)", map_id="a", length=5.0), edge(3, "LINESTRING (0 -10, 5 -10)", map_id="b", length=5.0), edge(4, "LINESTRING (5 -10, 7 -10)", map_id="b", length=2.0)]
    edges = network.network_edges(frame(spark, rows)).withColumn("my_weight", F.col("length") / 10)
    links = edges.select("map_id", F.col("src").alias("u"), F.col("dst").alias("v"))
    assert [r["size"] for r in graph.component_sizes(graph.components(links, by=["map_id"]), "map_id").orderBy("map_id", "rank").collect()] == [2, 2, 3]
    od = spark.createDataFrame([(m, f"t{m}", role, x, y) for m in "ab" for role, x, y in (("origin", 0, -1000), ("destination", 690, -1010))], "map_id string, id string, role string, x bigint, y bigint")
    routes, errors = graph.generate_routes(edges, od)
    assert [(r["id"], r["edge_id"]) for r in routes.orderBy("id", "step_id").collect()] == [("tb", 3), ("tb", 4)]
    assert [tuple(r) for r in errors.collect()] == [("ta", "no path")]
    one = spark.createDataFrame([("a", 1, 500, -1001), ("b", 2, 900, -310)], "map_id string, id bigint, x bigint, y bigint")
    nodes = edges.select("map_id", F.explode(F.array("src", "dst")).alias("node"))
    x, y = network.unpacked(F.col("node"))
    got = {r["id"]: (r["node_x"], r["node_y"]) for r in graph.nearest_nodes(one, nodes.select("map_id", "node", x.alias("x"), y.alias("y")), by=["map_id"]).collect()}
    assert got == {1: (500, -1000), 2: (700, -1000)}


def test_points_of_a_crowded_leaf_are_spread(spark):
    points = spark.range(5000).select("id", F.lit(3).cast("bigint").alias("x"), (F.col("id") % 7).alias("y"))
    nodes = spark.createDataFrame([(1, 0, 0), (2, 50, 50)], "node bigint, x bigint, y bigint")
    found = graph.nearest_nodes(points, nodes, points_per_task=100)
    assert found.count() == 5000 and {r["node"] for r in found.select("node").distinct().collect()} == {1}
    left, right = salted(points.withColumn("leaf", F.lit(0)), nodes.withColumn("leaf", F.lit(0)), ["leaf"], "id", 100)
    assert left.groupBy("task").count().agg(F.max("count")).first()[0] < 200 and right.count() == 100


def test_skewed_places_split_until_no_leaf_is_full(spark):
    rng = np.random.default_rng(2)
    xy = np.unique(np.concatenate([rng.normal(size=(3000, 2)).round(3), rng.uniform(0, 1e6, size=(100, 2)).round()]), axis=0)
    places = spark.createDataFrame([(float(a), float(b)) for a, b in xy], "x double, y double").localCheckpoint()
    tree = fitted_tree(places, 50, per_leaf=2)
    counts = [r["count"] for r in home_leaves(places, tree, 1.0).groupBy("leaf").count().collect()]
    assert sum(counts) == len(xy) and max(counts) <= 100 and len(counts) > 30


def test_points_have_no_period(spark):
    box = spark.createDataFrame([(-10**9, -10**9, 10**9, 10**9)], "min_x bigint, min_y bigint, max_x bigint, max_y bigint")
    assert graph.random_od_points(box, 500_000).select("x", "y").distinct().count() == 1_000_000


def test_random_points_and_generated_routes(spark):
    rows = [edge(10 * y + x, f"LINESTRING ({x}0 {y}0, {x + 1}0 {y}0)", length=10.0) for y in range(4) for x in range(4)] + [edge(100 + 10 * y + x, f"LINESTRING ({x}0 {y}0, {x}0 {y + 1}0)", length=10.0) for y in range(3) for x in range(5)]
    m = frame(spark, rows)
    od = graph.random_od_points(network.bounds(m), 20, seed=5)
    assert od.count() == 40 and od.collect() == graph.random_od_points(network.bounds(m), 20, seed=5).collect()
    assert od.where("x < 0 OR x > 4000 OR y < 0 OR y > 3000").count() == 0
    edges = network.network_edges(m).withColumn("my_weight", F.col("length") / 10)
    routes, errors = graph.generate_routes(edges, od.withColumnRenamed("route_id", "id").withColumn("map_id", F.lit("m")))
    done, failed = {r["id"] for r in routes.collect()}, {r["id"]: r["reason"] for r in errors.collect()}
    assert len(done) + len(failed) == 20 and set(failed.values()) <= {"same node"}
    for trip in done:
        steps = routes.where(F.col("id") == trip).orderBy("step_id").collect()
        assert all(a["dst"] == b["src"] for a, b in zip(steps, steps[1:]))


def test_many_profiles_at_once_equal_one_after_the_other(spark, data):
    from waymill.plans import network_queries as q

    edges, trips = q._profiled(spark, data).localCheckpoint(), q._trips(spark, data).localCheckpoint()
    profiles = [r[0] for r in trips.groupBy("profile_id").count().orderBy(F.desc("count"), "profile_id").limit(4).collect()]
    assert "um_std" in profiles and len(profiles) == 4
    routes, errors = q.generated_routes(spark, data).localCheckpoint(), q.route_errors(spark, data).localCheckpoint()
    assert {r[0] for r in routes.select("id").union(errors.select("id")).collect()} == {r[0] for r in trips.select("id").collect()}
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    for profile in profiles:
        own = trips.where(F.col("profile_id") == profile)
        alone = graph.generate_routes(edges.where(F.col("profile_id") == profile), own)
        ids = own.select("id").distinct()
        for got, want in zip((routes, errors), alone, strict=True):
            keys = [c for c in got.columns if c in want.columns]
            assert rows(got.join(ids, "id", "left_semi").select(*keys)) == rows(want.select(*keys))


def test_profiles_have_their_own_network_and_weights(spark):
    # a short way and a way round; "b" may not take the short one, "c" weighs it more; in cells too
    short, leg1, leg2 = [(1, 0, 10), (2, 0, 20), (3, 20, 10)]
    edges = []
    for name, include, cost in (("a", 1, 0.1), ("b", 0, 0.1), ("c", 1, 0.9)):
        for (i, u, v), flag, w in ((short, include, cost), (leg1, 1, 0.3), (leg2, 1, 0.3)):
            edges.append((name, "m", i, pack(u, u), pack(v, v), None, flag, w))
    e = spark.createDataFrame(edges, "profile_id string, map_id string, edge_id bigint, src bigint, dst bigint, bikepath_id string, include int, my_weight double")
    od = spark.createDataFrame([(p, "m", f"t{p}", role, at, at) for p in "abcx" for role, at in (("origin", 1), ("destination", 11))], "profile_id string, map_id string, id string, role string, x bigint, y bigint")
    routes, errors = graph.generate_routes(e, od, by=["profile_id"])
    got = {}
    for r in routes.orderBy("id", "step_id").collect():
        got.setdefault(r["id"], []).append(r["edge_id"])
    assert got == {"ta": [1], "tb": [2, 3], "tc": [2, 3]}
    assert [tuple(r) for r in errors.collect()] == [("tx", "no node")]
    pairs = spark.createDataFrame([(p, f"t{p}", "m", pack(0, 0), pack(10, 10)) for p in "abc"], "profile_id string, id string, map_id string, origin bigint, destination bigint")
    arcs = network.directed_arcs(network.selected(e))
    for cell in (1000, 1):
        paths, _ = graph.shortest_paths(arcs, pairs, by=["profile_id"], cell_nodes=cell)
        assert {r["id"]: (r["cost"], r["hops"]) for r in paths.collect()} == {"ta": (100_000, 1), "tb": (600_000, 2), "tc": (600_000, 2)}


def test_rounds_that_end_too_early_are_an_error(spark):
    chain = [(k, k + 1) for k in range(200)]
    random.Random(3).shuffle(chain)
    df = spark.createDataFrame(chain, "u bigint, v bigint").repartition(4)
    with pytest.raises(RuntimeError, match="after 1 rounds"):
        graph.joined_stars(df, most_rounds=1)
    assert {(r["u"], r["v"]) for r in graph.joined_stars(df).collect()} == {(k, 0) for k in range(1, 201)}
    assert {r["component"] for r in graph.components(df).collect()} == {0}


def test_trees_of_many_tasks_are_joined(spark):
    rng = random.Random(6)
    chain = [(k, k + 1) for k in range(3000) if k % 500] + [(rng.randrange(3000), rng.randrange(3000)) for _ in range(3)]
    rng.shuffle(chain)
    df = spark.createDataFrame([(m, a, b) for m in ("a", "b") for a, b in (chain if m == "a" else chain[::2])], "m string, u bigint, v bigint")
    parent = {(m, x): (m, x) for m in "ab" for x in range(3001)}
    for m, links in (("a", chain), ("b", chain[::2])):
        for a, b in links:
            a, b = find(parent, (m, a)), find(parent, (m, b))
            parent[max(a, b)] = min(a, b)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:  # one task for each of 16 ranges
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false"), spark.conf.set("spark.sql.shuffle.partitions", "16")
        got = {(r["m"], r["node"]): r["component"] for r in graph.components(df, by=["m"]).collect()}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert got == {n: find(parent, n)[1] for n in got} and len(got) > 5000
