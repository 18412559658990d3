import random

import numpy as np
import pytest

from waymill.llm import cdc

EVAL = "split_name string, route_id string, step_id int, feature_vec array<double>, map_id string"
TRAIN = "route_id string, step_id int, feature_vec array<double>, map_id string"


def clean(v):
    return [0.0 if x is None or x != x else x for x in v]


def brute(ours, theirs, num=3, den=5):
    group = lambda rows, n: {k: {r[n]: clean(r[n + 1]) for r in rows if r[n + 1] is not None and r[:n] == k} for k in {r[:n] for r in rows if r[n + 1] is not None}}
    e, t, out = group(ours, 2), group(theirs, 1), set()
    for k, steps in e.items():
        for name, others in t.items():
            hit = sum(any(all(abs(a - b) <= 0.5 + 1e-9 for a, b in zip(v, w)) for w in others.values()) for v in steps.values())
            if hit * den >= len(steps) * num:
                out.add((*k, *name))
    return out


def routes(seed):
    rng = random.Random(seed)
    vector = lambda: [round(rng.uniform(0, 300), 1) if rng.random() < 0.5 else 32.0 + 64 * rng.randrange(4) for _ in range(15)]
    pool = [vector() for _ in range(30)]
    shift = lambda v: [None if rng.random() < 0.01 else float("nan") if rng.random() < 0.01 else x + rng.choice([-0.5, 0.5, 0.0, 0.5, -0.3, 0.51 if rng.random() < 0.1 else 0]) for x in v]
    theirs = [(f"t{k}", s, rng.choice(pool) if rng.random() < 0.9 else None) for k in range(25) for s in range(rng.randint(1, 8))]
    ours = [(rng.choice(["val", "test"]) if False else "val", f"e{k}", s, shift(rng.choice(pool)) if rng.random() < 0.95 else None) for k in range(25) for s in range(rng.randint(1, 8))]
    ours += [("test", "t0", s, v) for name, s, v in theirs if name == "t0"]
    return ours, theirs


@pytest.mark.parametrize(("seed", "mask_bits"), [(1, 1), (2, 0), (3, 3)])
def test_all_overlaps_are_found(spark, seed, mask_bits):
    ours, theirs = routes(seed)
    e = spark.createDataFrame([(*r, "m") for r in ours] * 2, EVAL).selectExpr("*", "1 AS rec", "2 AS vec", "3 AS v", "4 AS digest", "5 AS chunk", "6 AS place")
    t = spark.createDataFrame([(*r, "m") for r in theirs] * 2, TRAIN)
    rows = cdc.near_overlap(e, t, record=["split_name", "route_id"], source=["route_id"], mask_bits=mask_bits).select("split_name", "route_id", "train_route_id").collect()
    got = [tuple(r) for r in rows]
    assert len(got) == len(set(got))
    assert set(got) == brute(ours, theirs)


def test_nulls_and_empty_tables(spark):
    e, t = spark.createDataFrame([], EVAL), spark.createDataFrame([], TRAIN)
    keys = {"record": ["split_name", "route_id"], "source": ["route_id"]}
    assert cdc.near_overlap(e, t, **keys).collect() == [] and cdc.exact_overlap(e, t, **keys).collect() == []
    e = spark.createDataFrame([("val", None, 0, [1.0] * 15, "m"), (None, "a", 0, [1.0] * 15, "m"), ("val", "b", None, [1.0] * 15, "m"), ("val", "c", 0, None, "m"), ("val", "d", 0, [1.0], "m"), ("val", "f", 0, [float("inf")] * 15, "m")], EVAL)
    t = spark.createDataFrame([("x", 0, [1.2] + [None] * 14, "m"), (None, 0, [1.0] * 15, "m")], TRAIN)
    assert [tuple(r)[:3] for r in cdc.near_overlap(e, t, **keys).collect()] == [("val", "d", "x")]


def test_cuts_find_their_way_back_after_an_insertion():
    rng = np.random.default_rng(1)
    symbols = rng.integers(0, 2**60, 400).astype(np.uint64)
    longer = np.concatenate([symbols[:100], rng.integers(0, 2**60, 3).astype(np.uint64), symbols[100:]])
    pieces = lambda s: {tuple(s[cdc.cut_chunks(s, 3) == k].tolist()) for k in range(int(cdc.cut_chunks(s, 3)[-1]) + 1)}
    a, b = pieces(symbols), pieces(longer)
    assert len(a) > 20 and len(a - b) <= 3
    assert cdc.cut_chunks(symbols, 0).tolist() == list(range(400))
    assert cdc.cut_chunks(symbols[:0], 3).tolist() == []


def test_fractions_of_shared_chunks(spark):
    rng = random.Random(2)
    base = [[rng.uniform(0, 1000) for _ in range(15)] for _ in range(120)]
    train = [("t", k, v, "m") for k, v in enumerate(base)]
    e = [("val", "same", k, v, "m") for k, v in enumerate(base)] + [("val", "cut", k, v, "m") for k, v in enumerate(base[:30] + [[0.0] * 15] + base[31:])] + [("val", "new", k, [x + 7 for x in v], "m") for k, v in enumerate(base)]
    got = {r["route_id"]: r for r in cdc.exact_overlap(spark.createDataFrame(e, EVAL), spark.createDataFrame(train, TRAIN), record=["split_name", "route_id"], source=["route_id"], mask_bits=2).collect()}
    assert got["same"]["fraction"] == 1.0 and got["new"]["fraction"] == 0.0 and 0.7 < got["cut"]["fraction"] < 1.0
    assert got["cut"]["steps"] == 120


def test_all_vectors_of_a_step_are_alternatives(spark):
    low, high, other = [1.0] * 15, [500.0] * 15, [900.0] * 15
    e = [("val", "one", 0, high), ("val", "many", 0, low), ("val", "many", 0, high), ("val", "many", 0, other), ("val", "half", 0, low), ("val", "half", 0, high), ("val", "half", 1, [50.0] * 15)]
    t = [("both", 0, low), ("both", 0, high), ("high", 0, high), ("last", 7, other), ("none", 0, [70.0] * 15)]
    frames = spark.createDataFrame([(*r, "m") for r in e], EVAL), spark.createDataFrame([(*r, "m") for r in t], TRAIN)
    got = {tuple(r) for r in cdc.near_overlap(*frames, record=["split_name", "route_id"], source=["route_id"]).select("route_id", "train_route_id", "matched", "steps").collect()}
    assert got == {("one", "both", 1, 1), ("one", "high", 1, 1), ("many", "both", 1, 1), ("many", "high", 1, 1), ("many", "last", 1, 1)}


def test_streams_laid_end_to_end_are_cut_alike():
    rng = np.random.default_rng(3)
    streams = [rng.integers(0, 2**60, n).astype(np.uint64) for n in (1, 40, 2, 100, 7)]
    starts = np.concatenate([np.arange(len(x)) == 0 for x in streams])
    whole, at = cdc.cut_chunks(np.concatenate(streams), 2, starts=starts, longest=9), 0
    for x in streams:
        own = whole[at : at + len(x)]
        assert (own - own[0]).tolist() == cdc.cut_chunks(x, 2, longest=9).tolist() and np.bincount(own - own[0]).max() <= 9
        at += len(x)
    assert (np.diff(whole) >= 0).all() and whole[-1] == len(set(whole.tolist())) - 1


def test_long_records_share_stretches(spark):
    rng = random.Random(5)
    vector = lambda: [float(rng.randrange(10_000)) for _ in range(15)]
    base, step = [vector() for _ in range(200)], vector()
    theirs = [("t", k, v) for k, v in enumerate(base)] + [("same", k, step) for k in range(90)]
    ours = [("val", "part", k, [x + 0.4 for x in v]) for k, v in enumerate(base[50:130] + [vector() for _ in range(50)])] + [("val", "less", k, v) for k, v in enumerate(base[:77] + [vector() for _ in range(53)])]
    ours += [("val", "same", k, step if k % 5 else vector()) for k in range(100)]
    e, t = spark.createDataFrame([(*r, "m") for r in ours], EVAL), spark.createDataFrame([(*r, "m") for r in theirs], TRAIN)
    got = {tuple(r) for r in cdc.near_overlap(e, t, record=["split_name", "route_id"], source=["route_id"]).select("route_id", "train_route_id", "matched", "steps").collect()}
    assert got == {("part", "t", 80, 130), ("same", "same", 80, 100)}


def test_chunks_of_equal_stretches_are_equal(spark):
    rows = [(r, s, [float(k)] * 15, "m") for r, first in (("a", 0), ("b", 3)) for s, k in enumerate(range(first, 60))]
    df = cdc.chunked_steps(spark.createDataFrame(rows, TRAIN), ["route_id"], mask_bits=2)
    chunks = {}
    for r in df.where("place = 0").collect():
        chunks.setdefault(r["route_id"], {})[r["chunk"]] = (r["v"][0], r["length"])
    both = chunks["a"].keys() & chunks["b"].keys()
    assert len(both) > 5 and all(chunks["a"][c] == chunks["b"][c] for c in both) and sum(chunks["a"][c][1] for c in both) >= 45
