import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymill.operators import episodes, ranking, replay, tensor

SEQUENCE = "route_id string, step_id int, feature_vec array<double>"


def test_padding_lengths_and_done(spark):
    rows = [("a", k, [float(k + 1)]) for k in range(5)] + [("b", 0, [9.0]), ("b", 0, [9.0]), ("c", 0, None), (None, 0, [1.0])]
    got = replay.replay_buffer(spark.createDataFrame(rows, SEQUENCE), length=3).orderBy("route_id", "step_id").collect()
    flat = lambda s: [x[0] for x in s]
    a = [r for r in got if r["route_id"] == "a"]
    assert [flat(r["state"]) for r in a] == [[0, 0, 0], [1, 0, 0], [1, 2, 0], [1, 2, 3], [2, 3, 4]]
    assert [flat(r["next_state"]) for r in a] == [[1, 0, 0], [1, 2, 0], [1, 2, 3], [2, 3, 4], [3, 4, 5]]
    assert [r["len_state"] for r in a] == [1, 1, 2, 3, 3] and [r["len_next_state"] for r in a] == [1, 2, 3, 3, 3]
    assert [r["is_done"] for r in a] == [False] * 4 + [True]
    assert [(r["route_id"], r["is_done"], r["len_state"]) for r in got if r["route_id"] != "a"] == [("b", True, 1)]


def test_null_slots_and_statistics(spark):
    df = spark.createDataFrame([("a", 0, [None, float("nan"), 1.0])], SEQUENCE)
    assert replay.replay_buffer(df).first()["action"] == [0.0, 0.0, 1.0]
    assert tuple(replay.data_statistics(df).first()) == (10, 3)
    assert tuple(replay.data_statistics(df.limit(0)).first()) == (10, None)
    assert replay.replay_buffer(df.limit(0)).collect() == []


MOVES = "episode_id string, step int, x double, y double, sx double, sy double, tx double, ty double"


def test_rewards_of_each_kind(spark):
    rows = [("e", 1, 5.0, 0.0), ("e", 2, 6.0, 0.0), ("e", 3, 5.0, 0.0), ("e", 4, 10.0, 0.0), ("e", 5, 11.0, 0.0)]
    got = episodes.step_rewards(spark.createDataFrame([(*r, 0.0, 0.0, 10.0, 0.0) for r in rows], MOVES)).orderBy("step").collect()
    assert [r["reward"] for r in got] == pytest.approx([49.9, 9.9, -110.1, 1049.9])
    assert [r["outcome"] for r in got] == [None, None, None, "success"]
    late = episodes.step_rewards(spark.createDataFrame([("e", 1, 40.0, 0.0, 0.0, 0.0, 10.0, 0.0)], MOVES), episodes.Rewards(max_steps=1)).first()
    assert late["reward"] == pytest.approx(-200 - 0.1 - 3) and late["truncated"] and late["outcome"] == "timeout"
    assert episodes.observations(spark.createDataFrame([("e", 50, 1.0, 2.0, 0.0, 0.0, 4.0, 6.0)], MOVES)).first()["observation"] == [1.0, 2.0, 3.0, 4.0, 0.25]
    assert episodes.observations(spark.createDataFrame([("e", 50, 1.0, 2.0, 0.0, 0.0, 4.0, 6.0)], MOVES), 0).first()["observation"][-1] == 0.0


def test_rollout_matches_step_rewards(spark):
    pack = lambda x, y: ((x * 100) << 32) + y * 100
    arcs = [("m", pack(x, y), pack(a, b)) for x in range(4) for y in range(4) for a, b in ((x + 1, y), (x, y + 1), (x - 1, y)) if 0 <= a < 4 and b < 4] + [("m", pack(0, 0), pack(0, 0))]
    games = [("a", "m", pack(0, 0), pack(3, 3), [9, 9, 9, 9, 9, 9]), ("b", "m", pack(0, 0), pack(3, 0), [-1, 0, 5, 5, 5, 0]), ("c", "m", pack(3, 3), pack(0, 0), [0] * 8), ("d", "m", 77, pack(0, 0), [0])]
    a = spark.createDataFrame(arcs, "map_id string, src bigint, dst bigint")
    g = spark.createDataFrame(games, "episode_id string, map_id string, start bigint, target bigint, actions array<int>")
    got = episodes.rollout(g, a)
    rows = {}
    for r in got.orderBy("step").collect():
        rows.setdefault(r["episode_id"], []).append(r)
    assert rows["d"][0]["reward"] == -50 and rows["d"][0]["outcome"] == "failure"
    assert rows["a"][-1]["outcome"] == "success" and (rows["a"][-1]["x"], rows["a"][-1]["y"]) == (3.0, 3.0)
    played = got.where("outcome IS NULL OR outcome <> 'failure'").join(g.select("episode_id", (F.shiftright("start", 32) / 100).alias("sx"), ((F.col("start") - F.shiftleft(F.shiftright("start", 32), 32)) / 100).alias("sy"), (F.shiftright("target", 32) / 100).alias("tx"), ((F.col("target") - F.shiftleft(F.shiftright("target", 32), 32)) / 100).alias("ty")), "episode_id")
    again = {(r["episode_id"], r["step"]): r["reward"] for r in episodes.step_rewards(played.drop("reward", "done", "truncated", "outcome")).collect()}
    assert all(again[r["episode_id"], r["step"]] == pytest.approx(r["reward"]) for e in "abc" for r in rows[e] if r["outcome"] != "failure")


def test_hits(spark):
    scores = spark.createDataFrame([(1, 10, 0.5), (1, 11, 0.9), (1, 12, 0.5), (2, 10, 1.0)], "query_id bigint, item_id bigint, score double")
    truth = spark.createDataFrame([(1, 10, 0.2), (2, 99, 1.0)], "query_id bigint, item_id bigint, reward double")
    got = {r["k"]: r for r in ranking.hits(ranking.top_items(scores, 3), truth, [1, 3], 0.2).collect()}
    assert got[1]["hit_click"] == 0 and got[3]["hit_click"] == 1 and got[3]["ndcg_click"] == pytest.approx(1 / math.log2(3)) and got[3]["total_reward"] == 0.2 and got[3]["hit_purchase"] == 0


def array(spark, column, value, kind="array<double>"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("r")).first()["r"]


def test_arrays(spark):
    v = [1.0, 2.0, 4.0, -3.0]
    assert array(spark, tensor.layer_norm(F.col("v")), v) == pytest.approx(tensor.normalised(np.array(v)).tolist())
    p = np.exp([1.0, 2.0, 4.0])
    assert array(spark, tensor.masked_softmax(F.col("v"), F.transform("v", lambda x: x > 0)), v) == pytest.approx([*(p / p.sum()), 0.0])
    assert array(spark, tensor.masked_softmax(F.col("v"), F.transform("v", lambda x: x > 9)), v) == pytest.approx([0.25] * 4)
    code = {(r["pos"], r["i"]): r["value"] for r in tensor.positional_encoding(spark, 15, 2).collect()}
    assert code[0, 0] == 0.0 and code[1, 0] == pytest.approx(math.cos(1)) and code[0, 1] == 1.0
    assert array(spark, tensor.gather_last(F.col("v"), F.lit(2)), [[1.0], [5.0]], "array<array<double>>") == [5.0]
    assert array(spark, tensor.relu(F.col("v")), [[-1.0, 2.0]], "array<array<double>>") == [[0.0, 2.0]]


def test_convolutions_agree(spark):
    rng = np.random.default_rng(1)
    x, taps = rng.normal(size=(1, 7, 3)), rng.normal(size=(2, 3, 2))
    got = array(spark, tensor.causal_conv(F.col("v"), taps.tolist(), 2), x[0].tolist(), "array<array<double>>")
    assert np.allclose(got, tensor.convolve(x, taps, 2)[0])
    assert np.allclose(got[1], x[0, 1] @ taps[1])  # before the start: zeros
    assert array(spark, tensor.causal_conv(F.col("v"), taps.tolist()), [], "array<array<double>>") == []


def test_layers():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2, 5, 4))
    x[1, 3:] = 0
    w = tensor.Attention(*[rng.normal(size=(4, 4)) for _ in range(3)], *[rng.normal(size=4) for _ in range(3)])
    y = tensor.attend(x, x, w, 2, True)
    later = x.copy()
    later[0, 4] += 1
    assert np.allclose(tensor.attend(later, later, w, 2, True)[0, :4], y[0, :4]) and np.allclose(y[1, 3:], 0)
    one = tensor.attend(x[:, :1], x[:, :1], w, 1, False)
    assert np.allclose(one, np.maximum(0, x[:, :1] @ w.value + w.value_bias) + x[:, :1])
    assert np.allclose(tensor.feed_forward(x, np.zeros((4, 8)), np.zeros((8, 4)), np.zeros(8), np.zeros(4)), x)
    taps = rng.normal(size=(3, 4, 4))
    assert tensor.residual_block(x, taps, taps, 1).shape == x.shape
    assert np.allclose(tensor.convolve(x, taps, 5, causal=False), tensor.convolve(x, taps, 1, causal=False))


def test_map_sequences_and_embeddings(spark):
    df = spark.createDataFrame([(1, [[1.0, 2.0]]), (2, [[3.0, 4.0]])], "id bigint, s array<array<double>>")
    assert [r["y"] for r in tensor.map_sequences(df, "s", "y", lambda x: x * 2).orderBy("id").collect()] == [[[2.0, 4.0]], [[6.0, 8.0]]]
    table = spark.createDataFrame([(0, [1.0, 1.0]), (5, [1.0, 2.0])], "id bigint, vector array<double>")
    ids = spark.createDataFrame([(0,), (5,), (6,)], "id bigint")
    got = {r["id"]: r["vector"] for r in tensor.embedding_lookup(ids, table, 4).collect()}
    assert got[0] == [0.0] * 4 and got[5] == [2.0, 4.0] and got[6] == [0.0] * 4
    assert {r["id"]: r["vector"] for r in tensor.embedding_lookup(ids, table, 2, zero_pad=False, scale=False).collect()}[0] == [1.0, 1.0]


def test_sequences_of_unequal_length(spark):
    df = spark.createDataFrame([(1, [[1.0], [2.0]]), (2, [[3.0]]), (3, []), (4, None)], "id bigint, s array<array<double>>").coalesce(1)
    assert {r["id"]: r["y"] for r in tensor.map_sequences(df, "s", "y", lambda x: x * 2).collect()} == {1: [[2.0], [4.0]], 2: [[6.0]], 3: [], 4: None}
    empty = df.where("id > 9")
    assert tensor.map_sequences(empty, "s", "y", lambda x: x).collect() == []


def test_top_products_against_brute_force(spark):
    rng = np.random.default_rng(4)
    vectors = rng.integers(-3, 4, size=(300, 5)).astype(float)
    items = spark.createDataFrame([*[(k, v.tolist()) for k, v in enumerate(vectors)], (900, None)], "item_id bigint, vector array<double>")
    queries = items.where("item_id % 50 = 0").withColumnRenamed("item_id", "query_id")
    got = {(r["query_id"], r["rank"]): (r["item_id"], r["score"]) for r in ranking.top_products(queries, items, 4, block=2, chunk=40).collect()}
    for q in range(0, 300, 50):
        best = sorted((-float(vectors[q] @ vectors[i]), i) for i in range(300) if i != q)[:4]
        assert [got[q, n + 1] for n in range(4)] == [(i, round(-s * 1e6)) for s, i in best]
    assert len(got) == 24 and ranking.top_products(queries.limit(0), items, 3).collect() == []
