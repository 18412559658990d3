"""Queries over stored routes, features, replay data, episodes, rankings and sequence arrays, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymill.functions.wkt import line_coords, point_xy
from waymill.operators import episodes, features, network, ranking, replay, routes, tensor
from waymill.plans.network_queries import ORACLE as NETWORK_ORACLE
from waymill.plans.network_queries import as_text
from waymill.plans.sql import EDGES
from waymill.sources.files import invalid_routes, valid_routes
from waymill.sources.tables import table


def _milli(c: Column) -> Column:
    """Whole thousandths, rounded half up."""
    return F.floor(c * 1e3 + 0.5).cast("bigint")


# stored routes


def route_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return routes.kept_routes(table(spark, d, "route_edges"))


def route_frequency(spark: SparkSession, d: str) -> DataFrame:
    return routes.route_frequencies(table(spark, d, "route_edges")).groupBy("n_routes").agg(F.count(F.lit(1)).alias("n_keys"))


def deduped_rows(spark: SparkSession, d: str) -> DataFrame:
    return routes.without_duplicates(table(spark, d, "route_edges")).agg(F.count(F.lit(1)).alias("n"))


def distinct_routes(spark: SparkSession, d: str) -> DataFrame:
    return routes.distinct_route_count(table(spark, d, "route_edges"))


def invalid_route_list(spark: SparkSession, d: str) -> DataFrame:
    return invalid_routes(table(spark, d, "route_edges"))


def route_validity(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each route, those with a readable line, and whether the route is valid: has at least one."""
    r = table(spark, d, "route_edges")
    readable = F.count(F.when(line_coords(F.col("geometry")).isNotNull(), 1))
    counts = r.groupBy("route_id").agg(F.count(F.lit(1)).alias("n_rows"), readable.alias("n_readable"))
    valid = valid_routes(r).select("route_id").distinct().withColumn("valid", F.lit(True))
    return counts.join(valid, "route_id", "left").select("route_id", "n_rows", "n_readable", F.coalesce("valid", F.lit(False)).alias("valid"))


def first_two_routes(spark: SparkSession, d: str) -> DataFrame:
    """The network around the ends of the first two routes that have a readable line."""
    first = routes.first_successes(table(spark, d, "route_edges"), 2)
    p = point_xy(F.col("geometry"))
    ends = table(spark, d, "start_end").where(F.col("coordinates").isin("origin", "destination")).select("route_id", "point_id", p.alias("p")).where(F.col("p").isNotNull()).dropDuplicates(["point_id"])
    around = ends.join(first, "route_id", "left_semi").select("route_id", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    return routes.viewport_edges(around, network.network_edges(table(spark, d, "network_map")))


def _split(spark: SparkSession, d: str) -> DataFrame:
    matched = routes.matched_routes(table(spark, d, "route_edges"), table(spark, d, "start_end"))
    return routes.split_members(matched, train=0.8, validation=0.1, test=0.1)


def split_members(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d).withColumnRenamed("id", "route_id")


def split_counts(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def trip_ends(spark: SparkSession, d: str) -> DataFrame:
    e = features.trip_ends(table(spark, d, "start_end"))
    return e.select("route_id", *[_milli(F.col(c)).alias(c) for c in ("ox", "oy", "dx", "dy")])


def role_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "start_end").where(F.col("coordinates").isin("origin", "destination")).groupBy("coordinates").agg(F.countDistinct("point_id").alias("n"))


def first_last_steps(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "route_edges").select("route_id", "step_id", "edge_id").distinct()
    return routes.first_and_last(r, "route_id", "step_id", "edge_id")


def route_lengths(spark: SparkSession, d: str) -> DataFrame:
    steps = features.route_steps(table(spark, d, "route_edges")).where(F.col("length") < float("inf"))
    return steps.groupBy("route_id").agg(F.sum(_milli(F.col("length"))).alias("length_milli"), F.count(F.lit(1)).alias("n_steps"))


# features


def step_columns(spark: SparkSession, d: str) -> DataFrame:
    """Encoded and filled columns of each step."""
    s = features.route_steps(table(spark, d, "route_edges"))
    return s.select("route_id", "step_id", as_text(F.array("x1", "y1", "x2", "y2", "crossing", "path_type", "length", "width", "curb")).alias("columns"))


def feature_vec(spark: SparkSession, d: str) -> DataFrame:
    f = features.feature_vectors(table(spark, d, "route_edges"), table(spark, d, "start_end"))
    return f.select("route_id", "step_id", as_text(F.col("feature_vec")).alias("feature_vec"))


def feature_rejects(spark: SparkSession, d: str) -> DataFrame:
    return features.routes_without_ends(table(spark, d, "route_edges"), table(spark, d, "start_end"))


def _sampled(spark: SparkSession, d: str) -> DataFrame:
    """Steps of the training routes, repeats folded, null slots 0."""
    clean = F.transform("feature_vec", lambda x: F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)))
    return table(spark, d, "sampled_train").where(F.col("feature_vec").isNotNull()).select("route_id", "step_id", clean.alias("feature_vec")).distinct()


def valid_actions(spark: SparkSession, d: str) -> DataFrame:
    """Successors open at each step of the training routes."""
    ways = network.neighbours(network.directed_arcs(network.network_edges(table(spark, d, "network_map"))))
    x, y = network.unpacked(F.col("src"))
    actions = features.valid_actions(_sampled(spark, d), ways.select((x / 100).alias("x"), (y / 100).alias("y"), "neighbours"))
    return actions.select("route_id", "step_id", F.array_join(F.transform("actions", lambda x: x.cast("string")), " ").alias("actions"))


# replay data


def replay_buffer(spark: SparkSession, d: str) -> DataFrame:
    """Replay data of the training routes; arrays as digests of whole thousandths."""
    b = replay.replay_buffer(table(spark, d, "sampled_train"))
    digest = lambda c: F.md5(F.array_join(F.transform(F.flatten(c), lambda x: F.when(F.abs(x) == float("inf"), "inf").otherwise(_milli(x).cast("string"))), " "))
    return b.select("route_id", "step_id", digest("state").alias("state"), "len_state", digest(F.array("action")).alias("action"), digest("next_state").alias("next_state"), "len_next_state", "is_done")


def replay_len_done(spark: SparkSession, d: str) -> DataFrame:
    b = replay.replay_buffer(table(spark, d, "sampled_train"), length=3)
    return b.select("route_id", "step_id", "len_state", "len_next_state", "is_done")


def replay_stats(spark: SparkSession, d: str) -> DataFrame:
    return replay.data_statistics(table(spark, d, "sampled_train"))


def gather_last(spark: SparkSession, d: str) -> DataFrame:
    """All slots of the last valid state of each next state."""
    b = replay.replay_buffer(table(spark, d, "sampled_train"))
    return b.select("route_id", "step_id", as_text(tensor.gather_last(F.col("next_state"), F.col("len_next_state"))).alias("last"))


def head_rows(spark: SparkSession, d: str) -> DataFrame:
    """The first 19 training steps by route and step."""
    return routes.head(table(spark, d, "sampled_train").select("route_id", "step_id", F.size("feature_vec").alias("n_slots")), 19, "route_id", "step_id", "n_slots")


# episodes: the places reached along stored routes, towards the destination node


def _moves(spark: SparkSession, d: str) -> DataFrame:
    f = features.feature_vectors(table(spark, d, "route_edges"), table(spark, d, "start_end"))
    at = lambda i: F.col("feature_vec")[i]
    return f.select(F.col("route_id").alias("episode_id"), (F.col("step_id") + 1).alias("step"), at(13).alias("x"), at(14).alias("y"), at(9).alias("sx"), at(10).alias("sy"), at(11).alias("tx"), at(12).alias("ty"))


def episode_rewards(spark: SparkSession, d: str) -> DataFrame:
    r = episodes.step_rewards(_moves(spark, d))
    return r.select("episode_id", "step", _milli(F.col("reward")).alias("reward_milli"), "done", "truncated", "outcome")


def episode_summary(spark: SparkSession, d: str) -> DataFrame:
    r = episodes.step_rewards(_moves(spark, d))
    return episodes.episode_summary(r).select("episode_id", "n_steps", F.round("total_reward", 2).alias("total_reward"), "outcome")


def episode_timeouts(spark: SparkSession, d: str) -> DataFrame:
    """Rewards with at most 5 steps and a penalty of 50 for a repeated edge: the strict reading."""
    r = episodes.step_rewards(_moves(spark, d), episodes.Rewards(edge_revisit=50.0, max_steps=5))
    return r.select("episode_id", "step", _milli(F.col("reward")).alias("reward_milli"), "done", "truncated", "outcome")


def observation(spark: SparkSession, d: str) -> DataFrame:
    o = episodes.observations(_moves(spark, d))
    return o.select("episode_id", "step", F.array_join(F.transform("observation", lambda x: _milli(x).cast("string")), " ").alias("observation"))


def rollouts(spark: SparkSession, d: str) -> DataFrame:
    """Episodes from each map node with successors, played by a fixed action list until goal, dead end or 15 steps."""
    arcs = network.directed_arcs(network.network_edges(table(spark, d, "network_map")))
    starts = arcs.groupBy("map_id", "src").agg(F.max("dst").alias("target"))
    actions = F.transform(F.sequence(F.lit(1), F.lit(20)), lambda k: (F.pmod(k * 7 + F.col("src"), F.lit(6)) - 1).cast("int"))
    games = starts.select(F.concat_ws(" ", "map_id", "src").alias("episode_id"), "map_id", F.col("src").alias("start"), "target", actions.alias("actions"))
    r = episodes.rollout(games, arcs, rewards=episodes.Rewards(max_steps=15))
    cm = lambda c: F.floor(F.col(c) * 100 + 0.5).cast("bigint").alias(c)
    return r.select("episode_id", "step", cm("x"), cm("y"), _milli(F.col("reward")).alias("reward_milli"), "done", "truncated", "outcome")


def visited_lines(spark: SparkSession, d: str) -> DataFrame:
    return episodes.visited_line(_moves(spark, d).select("episode_id", "step", "x", "y"))


# rankings: embeddings whose id is divisible by 50 against all


def _top(spark: SparkSession, d: str, k: int) -> DataFrame:
    e = table(spark, d, "embeddings")
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return ranking.top_products(queries, e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector")), k)


def topk_per_query(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d, 10).select("query_id", "item_id", "score", F.col("rank").cast("bigint").alias("rank"))


def hit_ndcg(spark: SparkSession, d: str) -> DataFrame:
    """Hits of the first other item of each query's label; rewards by parity."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    # the least id of a label, and the least but one for the query that is itself the least
    least = e.groupBy("label").agg(F.min("vec_id").alias("a"))
    second = e.join(least, "label").where(F.col("vec_id") != F.col("a")).groupBy("label").agg(F.min("vec_id").alias("b"))
    item = F.when(F.col("a") == F.col("query_id"), F.col("b")).otherwise(F.col("a"))
    truth = q.join(least, "label").join(second, "label", "left").select("query_id", item.alias("item_id"), F.when(F.col("query_id") % 100 == 0, 0.2).otherwise(1.0).alias("reward"))
    h = ranking.hits(_top(spark, d, 50), truth.where(F.col("item_id").isNotNull()), [5, 10, 20, 50], 0.2)
    return h.select(F.col("k").cast("bigint").alias("k"), *[F.floor(F.col(c) * 1e6 + 0.5).cast("bigint").alias(c) for c in ("total_reward", "hit_click", "ndcg_click", "hit_purchase", "ndcg_purchase")])


# sequence arrays


def _vector(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def layer_norm(spark: SparkSession, d: str) -> DataFrame:
    """Normalised vectors, plain and with gamma = 1 + i/64 and beta = i/100 of the slot i."""
    slot = F.sequence(F.lit(0), F.size("v") - 1)
    scaled = tensor.layer_norm(F.col("v"), gamma=F.transform(slot, lambda i: 1 + i / 64), beta=F.transform(slot, lambda i: i / 100))
    both = F.arrays_zip(tensor.layer_norm(F.col("v")).alias("x"), scaled.alias("y"))
    return _vector(spark, d).select("vec_id", F.posexplode(both).alias("i", "p")).select("vec_id", F.col("i").cast("bigint").alias("i"), *[F.floor(F.col("p")[c] * 1e5 + 0.5).cast("bigint").alias(n) for c, n in (("x", "x"), ("y", "scaled"))])


def masked_softmax(spark: SparkSession, d: str) -> DataFrame:
    s = tensor.masked_softmax(F.col("v"), F.transform("v", lambda x: x > 0))
    return _vector(spark, d).select("vec_id", F.posexplode(s).alias("i", "x")).select("vec_id", F.col("i").cast("bigint").alias("i"), F.floor(F.col("x") * 1e7 + 0.5).cast("bigint").alias("x"))


def _sequence(v: Column) -> Column:
    """64 numbers as 16 steps of 4 channels."""
    return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda t: F.slice(v, (t * 4 + 1).cast("int"), 4))


def causal_conv(spark: SparkSession, d: str) -> DataFrame:
    """Two taps, dilation 2, two output channels: sums of channels, and the first channel's change."""
    taps = [[[1.0, -1.0], [1.0, 0.0], [1.0, 0.0], [1.0, 0.0]], [[1.0, 1.0], [1.0, 0.0], [1.0, 0.0], [1.0, 0.0]]]
    out = _vector(spark, d).select("vec_id", F.posexplode(tensor.causal_conv(_sequence(F.col("v")), taps, 2)).alias("t", "y"))
    return out.select("vec_id", F.col("t").cast("bigint").alias("t"), *[F.floor(F.col("y")[o] * 1e5 + 0.5).cast("bigint").alias(f"y{o}") for o in (0, 1)])


def positional_encoding(spark: SparkSession, d: str) -> DataFrame:
    return tensor.positional_encoding(spark, 15, 10).select("pos", "i", F.floor(F.col("value") * 1e6 + 0.5).cast("bigint").alias("value"))


def embedding_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of event users' ids, all 64 slots; id 0 and unknown ids are zeros."""
    ids = table(spark, d, "events").select("event_id", F.col("user_id").alias("id"))
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    whole = F.transform("vector", lambda x: F.floor(x * 1e4 + 0.5).cast("bigint").cast("string"))
    return tensor.embedding_lookup(ids, vectors, 64).select("event_id", F.md5(F.array_join(whole, " ")).alias("vector"))


def _weights(name: str) -> list[np.ndarray]:
    """Given weights of a layer, three decimals each."""
    rng = np.random.default_rng(11)
    shapes = {"attention": [(4, 4)] * 3 + [(4,)] * 3, "feedforward": [(4, 8), (8, 4), (8,), (4,)], "residual": [(3, 4, 4)] * 2}
    return [np.round(rng.normal(size=shape) / 2, 3) for shape in shapes[name]]


def _layer(name: str):
    w = _weights(name)
    if name == "attention":
        return lambda x: tensor.attend(x, x, tensor.Attention(*w), 2, True)
    return (lambda x: tensor.feed_forward(x, *w)) if name == "feedforward" else (lambda x: tensor.residual_block(x, *w, 1))


def _applied(name: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = _vector(spark, d).select("vec_id", _sequence(F.col("v")).alias("s"))
        out = tensor.map_sequences(rows, "s", "y", _layer(name)).select("vec_id", F.posexplode("y").alias("t", "y"))
        return out.select("vec_id", F.col("t").cast("bigint").alias("t"), *[F.floor(F.col("y")[o] * 1e4 + 0.5).cast("bigint").alias(f"y{o}") for o in range(4)])

    query.__doc__ = f"The {name} layer with given weights over 16 steps of 4 channels, in whole ten-thousandths."
    return query


QUERIES = {
    f.__name__: f
    for f in (
        route_dedupe, route_frequency, deduped_rows, distinct_routes, invalid_route_list, route_validity, first_two_routes, split_members, split_counts, trip_ends, role_filter, first_last_steps, route_lengths, step_columns,
        feature_vec, feature_rejects, valid_actions, replay_buffer, replay_len_done, replay_stats, gather_last, head_rows, episode_rewards, episode_timeouts, episode_summary, observation, rollouts, visited_lines,
        topk_per_query, hit_ndcg, layer_norm, masked_softmax, causal_conv, positional_encoding, embedding_lookup,
    )
} | {"multihead_attention": _applied("attention"), "feedforward": _applied("feedforward"), "residual_block": _applied("residual")}

#: The line of each step by its vertices' numbers, and of each route the text of its sorted lines.
_KEYS = r"""
    WITH step AS (
        SELECT route_id, step_id, min(list_transform(string_split(regexp_extract(geometry, '(?i)LINESTRING\s*Z?\s*\(([^()]*)\)', 1), ','),
               lambda p: (CAST(string_split_regex(trim(p), '\s+')[1] AS DOUBLE), CAST(string_split_regex(trim(p), '\s+')[2] AS DOUBLE)))) AS c
        FROM route_edges WHERE regexp_matches(geometry, '(?i)LINESTRING\s*Z?\s*\([^()]*\)') GROUP BY route_id, step_id),
    keyed AS (SELECT route_id, list(c ORDER BY c) AS key FROM step GROUP BY route_id),
    kept AS (SELECT route_id, min(route_id) OVER (PARTITION BY key) AS kept_route FROM keyed)"""

_SPLIT = """
    WITH ids AS (
        SELECT DISTINCT route_id FROM route_edges WHERE route_id IN (SELECT route_id FROM start_end)),
    placed AS (SELECT *, row_number() OVER (ORDER BY substr(md5('1:' || route_id), 1, 4), route_id) AS k, count(*) OVER () AS n FROM ids),
    split AS (
        SELECT route_id, CASE WHEN k <= floor(n * CAST(0.8 AS DOUBLE)) THEN 'train' WHEN k <= floor(n * CAST(0.8 AS DOUBLE)) + floor(n * CAST(0.1 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split
        FROM placed)"""

_STEPS = r"""
    WITH RECURSIVE raw AS (
        SELECT route_id, step_id, list_transform(string_split(regexp_extract(geometry, '(?i)LINESTRING\s*Z?\s*\(([^()]*)\)', 1), ','), lambda p: string_split_regex(trim(p), '\s+')) AS c,
               CASE WHEN crossing = 'Yes' THEN 1.0 ELSE 0 END AS crossing, CASE WHEN path_type = 'walk' THEN 1.0 ELSE 0 END AS path_type,
               CASE WHEN length IS NULL OR isnan(length) THEN 0 ELSE length END AS length,
               CASE WHEN obstacle_free_width_float IS NULL OR isnan(obstacle_free_width_float) THEN 0 ELSE obstacle_free_width_float END AS width,
               CASE WHEN curb_height_max IS NULL OR isnan(curb_height_max) THEN 0 ELSE curb_height_max END AS curb
        FROM route_edges WHERE regexp_matches(geometry, '(?i)LINESTRING\s*Z?\s*\([^()]*\)')),
    ended AS (
        SELECT route_id, step_id, CAST(c[1][1] AS DOUBLE) AS x1, CAST(c[1][2] AS DOUBLE) AS y1, CAST(c[-1][1] AS DOUBLE) AS x2, CAST(c[-1][2] AS DOUBLE) AS y2,
               CAST(crossing AS DOUBLE) AS crossing, CAST(path_type AS DOUBLE) AS path_type, length, width, curb FROM raw),
    step AS (
        SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY route_id, step_id ORDER BY x1, y1, x2, y2, crossing, path_type, length, width, curb) AS rn FROM ended) WHERE rn = 1),
    placed AS (
        SELECT route_id, coordinates, point_id, string_split_regex(trim(regexp_extract(geometry, '(?i)^\s*(SRID=\d+;)?\s*POINT\s*Z?\s*\(([-+0-9.eE\s]+)\)\s*$', 2)), '\s+') AS w FROM start_end),
    point AS (
        SELECT route_id, coordinates, TRY_CAST(w[1] AS DOUBLE) AS x, TRY_CAST(w[2] AS DOUBLE) AS y, row_number() OVER (PARTITION BY route_id, coordinates ORDER BY point_id) AS rn
        FROM placed WHERE TRY_CAST(w[1] AS DOUBLE) IS NOT NULL AND TRY_CAST(w[2] AS DOUBLE) IS NOT NULL),
    trip AS (
        SELECT o.route_id, o.x AS ox, o.y AS oy, d.x AS dx, d.y AS dy FROM point o JOIN point d USING (route_id)
        WHERE o.coordinates = 'origin_node' AND d.coordinates = 'destination_node' AND o.rn = 1 AND d.rn = 1)"""

_WALK = _STEPS + """,
    numbered AS (SELECT s.*, t.* EXCLUDE route_id, row_number() OVER (PARTITION BY s.route_id ORDER BY step_id) - 1 AS k FROM step s JOIN trip t ON t.route_id = s.route_id),
    walk AS (
        SELECT *, CASE WHEN abs(x1 - ox) <= 1e-8 + 1e-5 * abs(ox) AND abs(y1 - oy) <= 1e-8 + 1e-5 * abs(oy) THEN x2 ELSE x1 END AS cx,
               CASE WHEN abs(x1 - ox) <= 1e-8 + 1e-5 * abs(ox) AND abs(y1 - oy) <= 1e-8 + 1e-5 * abs(oy) THEN y2 ELSE y1 END AS cy FROM numbered WHERE k = 0
        UNION ALL
        SELECT n.*, CASE WHEN abs(n.x1 - w.cx) <= 1e-8 + 1e-5 * abs(w.cx) AND abs(n.y1 - w.cy) <= 1e-8 + 1e-5 * abs(w.cy) THEN n.x2 ELSE n.x1 END,
               CASE WHEN abs(n.x1 - w.cx) <= 1e-8 + 1e-5 * abs(w.cx) AND abs(n.y1 - w.cy) <= 1e-8 + 1e-5 * abs(w.cy) THEN n.y2 ELSE n.y1 END
        FROM walk w JOIN numbered n ON n.route_id = w.route_id AND n.k = w.k + 1)"""

_TEXT = "lambda x: CASE WHEN isinf(x) THEN 'inf' ELSE CAST(CAST(floor(x * 1e6 + 0.5) AS BIGINT) AS VARCHAR) END"

def _rewarded(most: int, edge: int) -> str:
    return _WALK + f""",
    m AS (
        SELECT route_id AS episode_id, CAST(k + 1 AS BIGINT) AS step, cx AS x, cy AS y, ox AS sx, oy AS sy, dx AS tx, dy AS ty, sqrt((dx - cx) ** 2 + (dy - cy) ** 2) AS d,
               sqrt((dx - ox) ** 2 + (dy - oy) ** 2) AS d0 FROM walk),
    p AS (
        SELECT *, coalesce(lag(d) OVER (PARTITION BY episode_id ORDER BY step), d0) AS before, row_number() OVER (PARTITION BY episode_id, x, y ORDER BY step) AS visit,
               coalesce(lag(x) OVER (PARTITION BY episode_id ORDER BY step), sx) AS px, coalesce(lag(y) OVER (PARTITION BY episode_id ORDER BY step), sy) AS py, x = tx AND y = ty AS goal FROM m),
    r AS (SELECT *, row_number() OVER (PARTITION BY episode_id, px, py, x, y ORDER BY step) AS passage FROM p),
    e AS (
        SELECT *, (before - d) * 10 - 0.1 - CASE WHEN visit > 1 THEN 100 ELSE 0 END - CASE WHEN passage > 1 THEN {edge} ELSE 0 END + CASE WHEN goal THEN 1000 WHEN step >= {most} THEN -0.1 * d ELSE 0 END AS reward,
               coalesce(max(CASE WHEN goal OR step >= {most} THEN 1 ELSE 0 END) OVER (PARTITION BY episode_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM r),
    rewards AS (
        SELECT episode_id, CAST(step AS INTEGER) AS step, reward, goal OR step >= {most} AS done, NOT goal AND step >= {most} AS truncated,
               CASE WHEN goal THEN 'success' WHEN step >= {most} THEN 'timeout' END AS outcome FROM e WHERE ended = 0)"""  # fmt: skip


_REWARDS = _rewarded(200, 0)
_MILLI_REWARDS = " SELECT episode_id, step, CAST(floor(reward * 1e3 + 0.5) AS BIGINT) AS reward_milli, done, truncated, outcome FROM rewards"

_ROLLOUTS = "WITH RECURSIVE " + EDGES.replace("WITH ", "", 1) + """,
    arcs AS (
        SELECT map_id, x1 * 4294967296 + y1 AS src, x2 * 4294967296 + y2 AS dst FROM edges
        UNION ALL SELECT map_id, x2 * 4294967296 + y2, x1 * 4294967296 + y1 FROM edges WHERE bikepath_id IS NULL),
    way AS (SELECT map_id, src AS node, list_sort(list(DISTINCT dst)) AS ways FROM arcs WHERE src <> dst GROUP BY map_id, src),
    game AS (SELECT map_id, src AS start, max(dst) AS target FROM arcs GROUP BY map_id, src),
    play AS (
        SELECT map_id, start, target, 0 AS step, start AS node, FALSE AS dead FROM game
        UNION ALL
        SELECT p.map_id, p.start, p.target, p.step + 1,
               CASE WHEN w.ways IS NULL THEN p.node ELSE w.ways[CAST(greatest(0, least(len(w.ways) - 1, ((p.step + 1) * 7 + p.start) % 6 - 1)) AS BIGINT) + 1] END, w.ways IS NULL
        FROM play p LEFT JOIN way w ON w.map_id = p.map_id AND w.node = p.node WHERE NOT p.dead AND p.step < 15 AND (p.step = 0 OR p.node <> p.target)),
    stand AS (
        SELECT *, map_id || ' ' || start AS episode_id, CAST(node // 4294967296 AS BIGINT) AS x, CAST(node % 4294967296 AS BIGINT) AS y,
               sqrt(((target // 4294967296 - node // 4294967296) / CAST(100 AS DOUBLE)) ** 2 + ((target % 4294967296 - node % 4294967296) / CAST(100 AS DOUBLE)) ** 2) AS d FROM play),
    scored AS (
        SELECT *, lag(d) OVER (PARTITION BY episode_id ORDER BY step) AS before, count(*) FILTER (step > 0) OVER (PARTITION BY episode_id, node ORDER BY step) AS visit FROM stand)
    SELECT episode_id, CAST(step AS INTEGER) AS step, x, y,
           CAST(floor(CASE WHEN dead THEN -50 ELSE (before - d) * 10 - 0.1 - CASE WHEN visit > 1 THEN 100 ELSE 0 END + CASE WHEN node = target THEN 1000 WHEN step >= 15 THEN -0.1 * d ELSE 0 END END * 1e3 + 0.5) AS BIGINT) AS reward_milli,
           dead OR node = target OR step >= 15 AS done, dead OR (node <> target AND step >= 15) AS truncated,
           CASE WHEN dead THEN 'failure' WHEN node = target THEN 'success' WHEN step >= 15 THEN 'timeout' END AS outcome
    FROM scored WHERE step > 0"""  # fmt: skip

_SAMPLED = """
    WITH s AS (
        SELECT DISTINCT route_id, step_id, list_transform(feature_vec, lambda x: CASE WHEN x IS NULL OR isnan(x) THEN 0 ELSE x END) AS v FROM sampled_train WHERE feature_vec IS NOT NULL)"""


def _history(length: int) -> str:
    frame = lambda a, b: f"coalesce(list(v) OVER (PARTITION BY route_id ORDER BY step_id, v ROWS BETWEEN {a} AND {b}), [])"
    return _SAMPLED + f""",
    h AS (
        SELECT route_id, step_id, v, {frame(f"{length} PRECEDING", "1 PRECEDING")} AS b, {frame(f"{length - 1} PRECEDING", "CURRENT ROW")} AS u,
               lead(step_id) OVER (PARTITION BY route_id ORDER BY step_id, v) IS NULL AS is_done FROM s)"""  # fmt: skip


def _digest(items: str, length: int = 10) -> str:
    flat = f"list_concat(flatten({items}), list_transform(range(({length} - len({items})) * len(v)), lambda x: CAST(0 AS DOUBLE)))"
    return f"md5(array_to_string(list_transform({flat}, lambda x: CASE WHEN isinf(x) THEN 'inf' ELSE CAST(CAST(floor(x * 1e3 + 0.5) AS BIGINT) AS VARCHAR) END), ' '))"


def _shown(items: str, length: int) -> str:
    return f"CAST(greatest(least(len({items}), {length}), 1) AS INTEGER)"


_TOP = """
    WITH score AS (
        SELECT q.vec_id AS query_id, i.vec_id AS item_id,
               CAST(floor(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[])) * 1e6 + 0.5) AS BIGINT) AS score
        FROM embeddings q JOIN embeddings i ON q.vec_id % 50 = 0 AND q.vec_id <> i.vec_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM score)"""

_CELLS = """
    WITH cell AS (SELECT vec_id, unnest(range(16)) AS t, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    x AS (SELECT vec_id, t, v[4 * t + 1] AS x0, v[4 * t + 2] AS x1, v[4 * t + 3] AS x2, v[4 * t + 4] AS x3 FROM cell)"""


def _dense(matrix: np.ndarray, bias: np.ndarray | None, names: Sequence[str], out: str, relu: bool, extra: str = "") -> str:
    """``out``0, ``out``1, … of one dense layer as SQL columns."""
    columns = []
    for o in range(matrix.shape[1]):
        total = " + ".join([*([f"CAST({bias[o]} AS DOUBLE)"] if bias is not None else []), *[f"{n} * CAST({matrix[c, o]} AS DOUBLE)" for c, n in enumerate(names)]])
        columns.append((f"greatest(0, {total})" if relu else total) + (f" + {extra}{o}" if extra else "") + f" AS {out}{o}")
    return ", ".join(columns)


def _out(name: str) -> str:
    return ", ".join(f"CAST(floor({name}{o} * 1e4 + 0.5) AS BIGINT) AS y{o}" for o in range(4))


def _feedforward_sql() -> str:
    first, second, first_bias, second_bias = _weights("feedforward")
    inputs = [f"x{c}" for c in range(4)]
    return _CELLS + f""",
        h AS (SELECT *, {_dense(first, first_bias, inputs, "h", True)} FROM x),
        o AS (SELECT vec_id, t, {_dense(second, second_bias, [f"h{c}" for c in range(8)], "o", False, "x")} FROM h)
        SELECT vec_id, t, {_out("o")} FROM o"""  # fmt: skip


def _attention_sql() -> str:
    q, k, v, *biases = _weights("attention")
    inputs = [f"x{c}" for c in range(4)]
    heads = ", ".join(f"CASE WHEN b.empty OR b.t > a.t THEN -4294967295.0 ELSE (a.q{2 * h} * b.k{2 * h} + a.q{2 * h + 1} * b.k{2 * h + 1}) / sqrt(2.0) END AS s{h}" for h in (0, 1))
    masses = ", ".join(f"exp(s{h} - max(s{h}) OVER (PARTITION BY vec_id, t)) AS p{h}" for h in (0, 1))
    sums = ", ".join(f"CASE WHEN any_value(void) THEN 0 ELSE sum(p{o // 2} * v{o}) / sum(p{o // 2}) END + any_value(x{o}) AS o{o}" for o in range(4))
    return _CELLS + f""",
        w AS (SELECT *, x0 + x1 + x2 + x3 = 0 AS empty, {_dense(q, biases[0], inputs, "q", True)}, {_dense(k, biases[1], inputs, "k", True)}, {_dense(v, biases[2], inputs, "v", True)} FROM x),
        s AS (SELECT a.vec_id, a.t, a.empty AS void, a.x0, a.x1, a.x2, a.x3, b.v0, b.v1, b.v2, b.v3, {heads} FROM w a JOIN w b USING (vec_id)),
        p AS (SELECT *, {masses} FROM s),
        o AS (SELECT vec_id, t, {sums} FROM p GROUP BY vec_id, t)
        SELECT vec_id, t, {_out("o")} FROM o"""  # fmt: skip


def _residual_sql() -> str:
    steps, source, name = "", "x", "x"
    for turn, (taps, gap) in enumerate(zip(_weights("residual"), (1, 2), strict=True)):
        lagged = [f"coalesce(lag({name}{c}, {(2 - k) * gap}) OVER w, 0) AS l{k}_{c}" for k in range(3) for c in range(4)]
        flat = np.concatenate(list(taps), axis=0)
        steps += f""",
        lag{turn} AS (SELECT *, {", ".join(lagged)} FROM {source} WINDOW w AS (PARTITION BY vec_id ORDER BY t)),
        conv{turn} AS (SELECT vec_id, t, x0, x1, x2, x3, {_dense(flat, None, [f"l{k}_{c}" for k in range(3) for c in range(4)], "c", False)} FROM lag{turn}),
        mean{turn} AS (SELECT *, (c0 + c1 + c2 + c3) / 4 AS m FROM conv{turn}),
        var{turn} AS (SELECT *, sqrt(((c0 - m) ** 2 + (c1 - m) ** 2 + (c2 - m) ** 2 + (c3 - m) ** 2) / 4 + 1e-8) AS sd FROM mean{turn}),
        n{turn} AS (SELECT vec_id, t, x0, x1, x2, x3, {", ".join(f"greatest(0, (c{o} - m) / sd) AS z{o}" for o in range(4))} FROM var{turn})"""
        source, name = f"n{turn}", "z"
    return _CELLS + steps + f""",
        o AS (SELECT vec_id, t, {", ".join(f"z{o} + x{o} AS o{o}" for o in range(4))} FROM n1)
        SELECT vec_id, t, {_out("o")} FROM o"""  # fmt: skip


ORACLE = {
    "route_dedupe": _KEYS + " SELECT * FROM kept",
    "route_frequency": _KEYS + " SELECT n_routes, count(*) AS n_keys FROM (SELECT key, count(*) AS n_routes FROM keyed GROUP BY key) GROUP BY n_routes",
    "deduped_rows": _KEYS + " SELECT count(*) AS n FROM route_edges WHERE route_id IN (SELECT route_id FROM kept WHERE route_id = kept_route)",
    "distinct_routes": _KEYS + " SELECT count(DISTINCT key) AS n_routes FROM keyed",
    "invalid_route_list": r"SELECT DISTINCT route_id FROM route_edges WHERE route_id NOT IN (SELECT route_id FROM route_edges WHERE regexp_matches(geometry, '(?i)LINESTRING\s*Z?\s*\([^()]*\)'))",
    "route_validity": r"""SELECT route_id, count(*) AS n_rows, count(*) FILTER (regexp_matches(geometry, '(?i)LINESTRING\s*Z?\s*\([^()]*\)')) AS n_readable, n_readable > 0 AS valid FROM route_edges GROUP BY route_id""",
    "first_two_routes": NETWORK_ORACLE["viewport_join"]
    + r""" AND route_id IN (SELECT DISTINCT route_id FROM route_edges WHERE regexp_matches(geometry, '(?i)LINESTRING\s*Z?\s*\([^()]*\)') ORDER BY route_id LIMIT 2)""",
    "split_members": _SPLIT + " SELECT route_id, split FROM split",
    "split_counts": _SPLIT + " SELECT split, count(*) AS n FROM split GROUP BY split",
    "trip_ends": _STEPS
    + """ SELECT route_id, CAST(floor(ox * 1e3 + 0.5) AS BIGINT) AS ox, CAST(floor(oy * 1e3 + 0.5) AS BIGINT) AS oy, CAST(floor(dx * 1e3 + 0.5) AS BIGINT) AS dx,
          CAST(floor(dy * 1e3 + 0.5) AS BIGINT) AS dy FROM trip""",
    "role_filter": "SELECT coordinates, count(DISTINCT point_id) AS n FROM start_end WHERE coordinates IN ('origin', 'destination') GROUP BY coordinates",
    "first_last_steps": """SELECT route_id, arg_min(edge_id, step_id) AS first_edge_id, arg_max(edge_id, step_id) AS last_edge_id FROM route_edges GROUP BY route_id""",
    "route_lengths": _STEPS + " SELECT route_id, CAST(sum(CAST(floor(length * 1e3 + 0.5) AS BIGINT)) AS BIGINT) AS length_milli, count(*) AS n_steps FROM step WHERE NOT isinf(length) GROUP BY route_id",
    "step_columns": _STEPS + f" SELECT route_id, step_id, array_to_string(list_transform([x1, y1, x2, y2, crossing, path_type, length, width, curb], {_TEXT}), ' ') AS columns FROM step",
    "feature_vec": _WALK
    + f" SELECT route_id, CAST(k AS INTEGER) AS step_id, array_to_string(list_transform([x1, y1, x2, y2, crossing, path_type, length, width, curb, ox, oy, dx, dy, cx, cy], {_TEXT}), ' ') AS feature_vec FROM walk",
    "feature_rejects": _STEPS
    + """, every AS (SELECT DISTINCT route_id FROM route_edges)
        SELECT route_id, CASE WHEN route_id NOT IN (SELECT route_id FROM step) THEN 'no geometry' ELSE 'no end points' END AS reason FROM every
        WHERE route_id NOT IN (SELECT route_id FROM step) OR route_id NOT IN (SELECT route_id FROM trip)""",
    "valid_actions": EDGES
    + """, arcs AS (
            SELECT x1, y1, x2 * 4294967296 + y2 AS dst FROM edges UNION ALL SELECT x2, y2, x1 * 4294967296 + y1 FROM edges WHERE bikepath_id IS NULL),
        way AS (SELECT x1 AS x, y1 AS y, array_to_string(list_sort(list(DISTINCT dst)), ' ') AS actions FROM arcs GROUP BY 1, 2),"""
    + _SAMPLED.replace("WITH", "", 1)
    + """, e AS (
            SELECT route_id, step_id, v, (round(v[1], 5), round(v[2], 5)) AS a, (round(v[3], 5), round(v[4], 5)) AS b FROM s),
        t AS (
            SELECT *, lag(a) OVER w AS pa, lag(b) OVER w AS pb, lead(a) OVER w AS na, lead(b) OVER w AS nb FROM e WINDOW w AS (PARTITION BY route_id ORDER BY step_id)),
        n AS (
            SELECT route_id, step_id, CASE WHEN len(list_filter(v, lambda x: x <> 0)) = 0 THEN NULL WHEN pa IS NULL AND na IS NULL THEN a
                   WHEN pa IS NULL THEN CASE WHEN a = na OR a = nb THEN b ELSE a END WHEN a = pa OR a = pb THEN b ELSE a END AS n FROM t)
        SELECT route_id, step_id, coalesce(actions, '') AS actions FROM n LEFT JOIN way ON round(way.x / 100, 5) = n.n[1] AND round(way.y / 100, 5) = n.n[2]""",
    "replay_buffer": _history(10)
    + f""" SELECT route_id, step_id, {_digest("b")} AS state, {_shown("b", 10)} AS len_state, {_digest("[v]", 1)} AS action, {_digest("u")} AS next_state,
           {_shown("u", 10)} AS len_next_state, is_done FROM h""",
    "replay_len_done": _history(3) + f' SELECT route_id, step_id, {_shown("b", 3)} AS len_state, {_shown("u", 3)} AS len_next_state, is_done FROM h',
    "replay_stats": "SELECT CAST(10 AS INTEGER) AS state_size, CAST(max(len(feature_vec)) AS INTEGER) AS feature_dim FROM sampled_train",
    "gather_last": _SAMPLED + f" SELECT route_id, step_id, array_to_string(list_transform(v, {_TEXT}), ' ') AS last FROM s",
    "head_rows": "SELECT route_id, step_id, CAST(len(feature_vec) AS INTEGER) AS n_slots FROM sampled_train ORDER BY route_id, step_id, n_slots NULLS FIRST LIMIT 19",
    "episode_rewards": _REWARDS + _MILLI_REWARDS,
    "episode_timeouts": _rewarded(5, 50) + _MILLI_REWARDS,
    "rollouts": _ROLLOUTS,
    "visited_lines": _WALK + " SELECT route_id AS episode_id, 'LINESTRING (' || string_agg(cx || ' ' || cy, ', ' ORDER BY k) || ')' AS wkt FROM walk GROUP BY route_id",
    "episode_summary": _REWARDS + " SELECT episode_id, count(*) AS n_steps, round(sum(reward), 2) AS total_reward, arg_max(outcome, step) AS outcome FROM rewards GROUP BY episode_id",
    "observation": _WALK
    + """ SELECT route_id AS episode_id, CAST(k + 1 AS INTEGER) AS step, array_to_string(list_transform([cx, cy, dx - cx, dy - cy, least(1, (k + 1) / 200)],
          lambda x: CAST(CAST(floor(x * 1e3 + 0.5) AS BIGINT) AS VARCHAR)), ' ') AS observation FROM walk""",
    "topk_per_query": _TOP + " SELECT query_id, item_id, score, rank FROM ranked WHERE rank <= 10",
    "hit_ndcg": _TOP
    + """, truth AS (
            SELECT q.vec_id AS query_id, min(i.vec_id) AS item_id, CASE WHEN q.vec_id % 100 = 0 THEN 0.2 ELSE 1.0 END AS reward
            FROM embeddings q JOIN embeddings i ON q.label = i.label AND q.vec_id <> i.vec_id WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id),
        h AS (SELECT CAST(k AS BIGINT) AS k, reward, CASE WHEN rank <= k THEN 1.0 ELSE 0 END AS hit, 1 / log2(rank + 1) AS gain FROM truth JOIN ranked USING (query_id, item_id), (VALUES (5), (10), (20), (50)) AS v(k))
        SELECT k, CAST(floor(sum(hit * reward) * 1e6 + 0.5) AS BIGINT) AS total_reward, CAST(floor(sum(CASE WHEN reward = 0.2 THEN hit ELSE 0 END) * 1e6 + 0.5) AS BIGINT) AS hit_click,
               CAST(floor(sum(CASE WHEN reward = 0.2 THEN hit * gain ELSE 0 END) * 1e6 + 0.5) AS BIGINT) AS ndcg_click,
               CAST(floor(sum(CASE WHEN reward = 0.2 THEN 0 ELSE hit END) * 1e6 + 0.5) AS BIGINT) AS hit_purchase,
               CAST(floor(sum(CASE WHEN reward = 0.2 THEN 0 ELSE hit * gain END) * 1e6 + 0.5) AS BIGINT) AS ndcg_purchase FROM h GROUP BY k""",
    "layer_norm": """
        WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        n AS (SELECT vec_id, v, list_sum(v) / len(v) AS m FROM e),
        s AS (SELECT vec_id, v, m, list_sum(list_transform(v, lambda x: (x - m) * (x - m))) / len(v) AS q FROM n),
        u AS (SELECT vec_id, m, q, unnest(v) AS x, unnest(range(len(v))) AS i FROM s)
        SELECT vec_id, i, CAST(floor((x - m) / sqrt(q + 1e-8) * 1e5 + 0.5) AS BIGINT) AS x,
               CAST(floor(((x - m) / sqrt(q + 1e-8) * (1 + i / 64) + i / 100) * 1e5 + 0.5) AS BIGINT) AS scaled FROM u""",
    "masked_softmax": """
        WITH u AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS i FROM embeddings),
        k AS (SELECT vec_id, i, CASE WHEN x > 0 THEN x ELSE -4294967295.0 END AS x FROM u),
        p AS (SELECT vec_id, i, exp(x - max(x) OVER (PARTITION BY vec_id)) AS p FROM k)
        SELECT vec_id, i, CAST(floor(p / sum(p) OVER (PARTITION BY vec_id) * 1e7 + 0.5) AS BIGINT) AS x FROM p""",
    "causal_conv": """
        WITH u AS (SELECT vec_id, unnest(range(16)) AS t, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        s AS (SELECT vec_id, t, v[4 * t + 1] AS a, v[4 * t + 1] + v[4 * t + 2] + v[4 * t + 3] + v[4 * t + 4] AS total FROM u)
        SELECT n.vec_id, n.t, CAST(floor((coalesce(b.total, 0) + n.total) * 1e5 + 0.5) AS BIGINT) AS y0, CAST(floor((n.a - coalesce(b.a, 0)) * 1e5 + 0.5) AS BIGINT) AS y1
        FROM s n LEFT JOIN s b ON b.vec_id = n.vec_id AND b.t = n.t - 2""",
    "positional_encoding": """
        WITH c AS (SELECT range AS id, range // 15 AS pos, range % 15 AS i FROM range(150))
        SELECT pos, i, CAST(floor(CASE WHEN id % 2 = 0 THEN sin(pos / pow(10000.0, 2.0 * i / 15)) ELSE cos(pos / pow(10000.0, 2.0 * i / 15)) END * 1e6 + 0.5) AS BIGINT) AS value FROM c""",
    "embedding_lookup": """
        SELECT event_id, md5(array_to_string(list_transform(range(1, 65), lambda i: CAST(CAST(floor(CASE WHEN user_id = 0 OR e.embedding IS NULL THEN 0
               ELSE CAST(e.embedding[i] AS DOUBLE) * 8 END * 1e4 + 0.5) AS BIGINT) AS VARCHAR)), ' ')) AS vector
        FROM events LEFT JOIN embeddings e ON e.vec_id = events.user_id""",
    "feedforward": _feedforward_sql(),
    "multihead_attention": _attention_sql(),
    "residual_block": _residual_sql(),
}
