import random

import numpy as np
import pytest

from waymill.llm import bitslice

SETS = "record string, elements array<bigint>"


def brute(sets, num=7, den=10):
    names = sorted(sets)
    return {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])}


def random_sets(seed, n=160, universe=120):
    rng = random.Random(seed)
    sets = {}
    for k in range(n):
        if k % 3 and sets:
            base = set(rng.choice(list(sets.values())))
            for _ in range(rng.randint(0, 4)):
                base ^= {rng.randrange(universe)}
        else:
            base = {rng.randrange(universe) for _ in range(rng.randint(1, 40))}
        sets[f"r{k:03}"] = frozenset(base)
    return sets


@pytest.mark.parametrize(("seed", "most", "num", "den"), [(1, 2048, 7, 10), (2, 8, 7, 10), (3, 8, 4, 5), (4, 3, 1, 2), (5, 2048, 1, 1)])
def test_all_pairs_are_found(spark, seed, most, num, den):
    sets = random_sets(seed)
    df = spark.createDataFrame([(k, list(v)) for k, v in sets.items()] + [(None, [1]), ("none", None), ("empty", [])], SETS)
    members, links = bitslice.near_duplicates(df, most=most, num=num, den=den, lanes=64)
    rows = [tuple(r) for r in bitslice.similar_pairs(members, links).collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == brute(sets, num, den)
    classes = {r["record"]: r["class"] for r in members.collect()}
    assert classes == {k: min(n for n in sets if sets[n] == v) for k, v in sets.items() if v}


def test_hot_group_of_copies_is_one_class(spark):
    rows = [(f"c{k:05}", [1, 2, 3]) for k in range(3000)] + [("x", [1, 2, 3, 4])]
    members, links = bitslice.near_duplicates(spark.createDataFrame(rows, SETS))
    assert [tuple(r) for r in links.collect()] == [("c00000", "x", 3, 3, 4)]
    assert members.count() == 3001


def test_empty(spark):
    members, links = bitslice.near_duplicates(spark.createDataFrame([], SETS))
    assert members.collect() == [] and links.collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_radius_filter_loses_none_and_counts_exactly(seed):
    rng = np.random.default_rng(seed)
    n = 90
    base = rng.integers(0, 2**63, (n, bitslice.WORDS), dtype=np.uint64)
    for k in range(1, n):
        if rng.random() < 0.8:
            base[k] = base[k - 1]
            for _ in range(rng.integers(0, 12)):
                base[k, rng.integers(bitslice.WORDS)] ^= np.uint64(1) << np.uint64(rng.integers(64))
    block = np.sort(rng.integers(0, 4, n))
    size = rng.integers(10, 200, n)
    order = np.lexsort((size, block))
    block, size, base = block[order], size[order], base[order]
    side = np.where(block == 1, rng.integers(1, 3, n), 0)
    got = set()
    for i, j in bitslice.within_radius(base, block, size, side, 7, 10):
        got |= set(zip(i.tolist(), j.tolist()))
    want = set()
    for i in range(n):
        for j in range(i + 1, n):
            away = sum(int(x).bit_count() for x in base[i] ^ base[j])
            if block[i] == block[j] and (side[i] == 0 or side[i] != side[j]) and size[i] * 10 >= size[j] * 7 and away <= 3 * (size[i] + size[j]) // 17:
                want.add((i, j))
    assert got == want


def test_sketch_distance_bounds_the_difference():
    rng = random.Random(1)
    sets = [set(rng.sample(range(10**9), rng.randint(1, 400))) for _ in range(40)]
    flat = np.array([x for s in sets for x in s], np.int64)
    owner = np.repeat(np.arange(40), [len(s) for s in sets])
    sketch = bitslice.sketches(flat, owner, 40)
    for i in range(40):
        for j in range(40):
            assert sum(int(x).bit_count() for x in sketch[i] ^ sketch[j]) <= len(sets[i] ^ sets[j])


def test_route_vertices(spark):
    rows = [("a", "LINESTRING (1 2, 3 4.004)"), ("a", "linestring(3 4,1.001 2)"), ("b", None), ("b", "LINESTRING EMPTY"), (None, "LINESTRING (1 2, 3 4)")]
    df = spark.createDataFrame(rows, "route_id string, geometry string").selectExpr("*", "1 AS record", "2 AS elements", "3 AS v")
    got = {r["record"]: sorted(r["elements"]) for r in bitslice.route_vertices(df).collect()}
    assert got == {"a": [(100 << 32) + 200, (300 << 32) + 400]}


def test_folded_sketch_is_the_narrower_one():
    rng = np.random.default_rng(2)
    flat, owner = rng.integers(0, 2**60, 900), np.sort(rng.integers(0, 5, 900))
    for width in (1, 3):
        assert (bitslice.folded(bitslice.sketches(flat, owner, 5, width)) == bitslice.sketches(flat, owner, 5, width - 1)).all()


def test_large_and_small_sets_together(spark):
    rng = random.Random(8)
    sets = {}
    for k in range(60):
        n = rng.choice([3, 150, 175, 180, 185, 200, 350, 365, 1500])
        near = [s for s in sets.values() if 0.6 * n < len(s) < 1.6 * n]
        base = set(rng.choice(near)) if near and rng.random() < 0.7 else {rng.randrange(10**9) for _ in range(n)}
        for _ in range(rng.randint(0, max(1, n // 8))):
            base ^= {rng.choice(sorted(base)) if base and rng.random() < 0.7 else rng.randrange(10**9)}
        sets[f"r{k:02}"] = frozenset(base or {1})
    assert len(set(bitslice.doublings(np.array([len(s) for s in sets.values()])).tolist())) >= 4
    members, links = bitslice.near_duplicates(spark.createDataFrame([(k, list(v)) for k, v in sets.items()], SETS))
    found = {tuple(r) for r in bitslice.similar_pairs(members, links).collect()}
    assert found == brute(sets) and len(found) > 10


def test_wide_sketches_keep_large_unlike_sets_apart():
    rng = np.random.default_rng(5)
    n, size = 40, 1500
    width = int(bitslice.doublings(np.array([size]))[0])
    sketch = bitslice.sketches(rng.integers(0, 2**60, n * size), np.repeat(np.arange(n), size), n, width)
    same = np.zeros(n, np.int64)
    assert not list(bitslice.within_radius(sketch, same, np.full(n, size), same, 7, 10))
