"""Components, nearest nodes, shortest paths and route generation. A graph is a map's (and, with ``by``, a profile's): its
key is part of every grouping and join, so maps that overlap or share a node stay apart."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymill.functions.kdtree import SplitTree, chord, unit_vectors
from waymill.operators.network import cheapest_arcs, directed_arcs, packed, selected, unpacked, unpacked_nodes
from waymill.operators.spread import fitted_tree, salted
from waymill.session import Rounds, checkpointed, few, written


def _forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each node's tree, for links between nodes 0 to n - 1: roots are hung below smaller ones and
    ways to the root are halved until no link joins two trees."""
    top = np.arange(n)
    while True:
        a, b = top[u], top[v]
        apart = a != b
        if not apart.any():
            return top
        u, v = u[apart], v[apart]
        np.minimum.at(top, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while ((up := top[top]) != top).any():
            top = up


def local_forest(links: DataFrame, *, by: Sequence[str] = (), most_links: int = 1_000_000) -> DataFrame:
    """Links (``by``, u, v) with the same components and fewer hops: each task joins the links it sees into trees and gives
    every node's link to its tree's smallest node. A task holds at most about ``most_links`` links at a time."""
    schema = T.StructType([*[T.StructField(c, links.schema[c].dataType) for c in by], T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        group, row_of = np.zeros(table.num_rows, np.int64), np.arange(table.num_rows)
        for c in by:
            code = table.column(c).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            group = np.unique(group * (int(code.max(initial=0)) + 1) + code, return_inverse=True)[1].reshape(-1)
        u, v = table.column("u").to_numpy(), table.column("v").to_numpy()
        names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        nodes, number = np.unique(np.concatenate([group, group]) * len(names) + at.reshape(-1), return_inverse=True)
        number = number.reshape(-1)
        some = np.zeros(len(nodes), np.int64)
        some[number] = np.concatenate([row_of, row_of])  # a row of the node's group
        top = _forest(number[: len(u)], number[len(u) :], len(nodes))
        low = np.flatnonzero(top != np.arange(len(nodes)))
        keys = [table.column(c).combine_chunks().take(pa.array(some[low])) for c in by]
        return pa.RecordBatch.from_arrays([*keys, pa.array(names[nodes[low] % len(names)]), pa.array(names[nodes[top[low]] % len(names)])], names=[*by, "u", "v"])

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= most_links:
                yield stars(held)
                held, rows = [], 0
        if held:
            yield stars(held)

    return links.select(*by, F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v")).mapInArrow(contract, schema)


def joined_stars(links: DataFrame, *, by: Sequence[str] = (), most_rounds: int | None = None) -> DataFrame:
    """Links (``by``, u, v) to links of every node to the smallest node of its component, which itself has none.

    Alternating large and small stars: every round hangs nodes below the smallest node in sight, so even long chains
    take a number of rounds logarithmic in their length. Links stay in tables of the shared folder; a round's count and
    hash, by which the end is known, are observed while its table is written. Rounds go on until two give the same links;
    with ``most_rounds``, an error is raised if they don't by then.
    """
    mark = (F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*by, "u", "v").cast("decimal(38,0)")).alias("h"))
    rounds = Rounds(links.sparkSession, "components")
    links, seen = rounds.observed(links.distinct(), *mark)
    done = 0
    while seen["n"]:
        if most_rounds is not None and done == most_rounds:
            raise RuntimeError(f"components: links still changed after {most_rounds} rounds; labels would be split")
        done += 1
        both = links.unionAll(links.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(*by, "u").agg(F.least(F.col("u"), F.min("v")).alias("_m"))
        large = both.where(F.col("v") > F.col("u")).join(low, [*by, "u"]).select(*by, F.col("v").alias("u"), F.col("_m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        down = large.select(*by, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy(*by, "u").agg(F.min("v").alias("_m"))
        small = down.join(least, [*by, "u"]).select(*by, F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("_m").alias("v")), F.struct(F.col("u"), F.col("_m").alias("v")))).alias("p")).select(*by, "p.u", "p.v")
        links, now = rounds.observed(small.where(F.col("u") != F.col("v")).distinct(), *mark)
        if now == seen:
            break
        seen = now
    return links


def components(pairs: DataFrame, nodes: DataFrame | None = None, *, by: Sequence[str] = (), most_rounds: int | None = None) -> DataFrame:
    """(``by``, node, component): the component of each node of undirected ``pairs`` (``by``, u, v: integers), named by its
    smallest node. Each value of ``by`` (not null), say a map, is a graph of its own. ``nodes`` (``by``, node) adds nodes
    without links.

    Links are laid out by ranges of nodes, so that near nodes (by place, if the key is a place) meet in a task, which joins
    its links into trees. Only roots of trees that share a node are then joined by ``joined_stars``, in rounds over as many
    links as trees meet, not over all nodes.
    """
    known = pairs.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))).select(*by, "u", "v")
    every = pairs.select(*by, F.explode(F.array("u", "v")).alias("node")).where(F.col("node").isNotNull())
    every = (every if nodes is None else every.unionAll(nodes.select(*by, "node"))).distinct()
    trees = written(local_forest(known.repartitionByRange(*by, "u"), by=by).distinct(), "trees")
    first = trees.groupBy(*by, "u").agg(F.min("v").alias("_m"))
    # a node with several roots joins them; a root that hangs below another one elsewhere joins it
    met = trees.join(first, [*by, "u"]).where(F.col("v") != F.col("_m")).select(*by, F.col("v").alias("u"), F.col("_m").alias("v"))
    hung = first.join(trees.select(*by, F.col("v").alias("u")).distinct(), [*by, "u"]).select(*by, "u", F.col("_m").alias("v"))
    top = joined_stars(met.unionAll(hung), by=by, most_rounds=most_rounds).groupBy(*by, F.col("u").alias("root")).agg(F.min("v").alias("component"))
    rooted = every.join(first.withColumnRenamed("u", "node"), [*by, "node"], "left").select(*by, "node", F.coalesce("_m", "node").alias("root"))
    return rooted.join(top, [*by, "root"], "left").select(*by, "node", F.coalesce("component", "root").alias("component"))


def component_sizes(labelled: DataFrame, *keys: str) -> DataFrame:
    """(keys, component, size, rank): node counts, the largest first; ties by component name."""
    sizes = labelled.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("size"))
    order = Window.partitionBy(*keys).orderBy(F.desc("size"), "component")
    return sizes.withColumn("rank", F.row_number().over(order).cast("bigint"))


def selected_network(edges: DataFrame, *, within: str = "map_id", keep: int = 2, by: Sequence[str] = ()) -> DataFrame:
    """Included edges of the ``keep`` largest components of each map (and of each ``by``)."""
    chosen, keys = selected(edges), [*by, within]
    labelled = components(chosen.select(*keys, F.col("src").alias("u"), F.col("dst").alias("v")), by=keys)
    large = component_sizes(labelled, *keys).where(F.col("rank") <= keep)
    return chosen.join(labelled.withColumnRenamed("node", "src"), [*keys, "src"]).join(large.select(*keys, "component"), [*keys, "component"], "left_semi")


def two_networks(edges: DataFrame, *, within: str = "map_id") -> tuple[DataFrame, DataFrame]:
    """Directed arcs of the full network and of the selected one."""
    return directed_arcs(edges), directed_arcs(selected_network(edges, within=within))


def nearest_nodes(points: DataFrame, nodes: DataFrame, *, by: Sequence[str] = (), leaf_rows: int = 2048, points_per_task: int = 16_384) -> DataFrame:
    """(id, node, node_x, node_y, d2): of each point (id, x, y) the nearest of ``nodes`` (node, x, y), whole centimetres;
    ties go to the smallest (x, y). Points have none if there are no nodes. With ``by``, columns of both tables such as a
    map, only nodes of the point's own values count; ids are distinct over all of them.

    Two passes over a split tree fitted on the nodes: the nearest in a point's own leaf bounds the distance (in a leaf
    without nodes of its ``by``: one node of them), and the leaves within that bound are searched in the second pass. The
    points of a crowded leaf are spread over tasks, each with the leaf's few nodes.
    """
    nodes = checkpointed(nodes.select(*by, "node", "x", "y").distinct())
    tree = fitted_tree(checkpointed(nodes.select("x", "y").distinct()) if by else nodes.select("x", "y"), leaf_rows, unit=0.01)

    def spread(reach: str | None):
        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = unit_vectors(batch.column("x").to_numpy() / 100, batch.column("y").to_numpy() / 100)
                if reach is None:
                    rows, leaf = np.arange(len(v)), tree.home(v)
                else:
                    rows, leaf = tree.reached(v, chord(np.sqrt(batch.column(reach).to_numpy(zero_copy_only=False)) / 100 + 1e-6))
                taken = pa.array(rows)
                yield pa.RecordBatch.from_arrays([*[c.take(taken) for c in batch.columns], pa.array(leaf.astype(np.int32))], names=[*batch.schema.names, "leaf"])

        return place

    def closest(_key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values(["x", "y"])
        nx, ny, out = right["x"].to_numpy(), right["y"].to_numpy(), []
        step = max(1, 4_000_000 // max(1, len(right)))
        for begin in range(0, len(left) if len(right) else 0, step):
            part = left.iloc[begin : begin + step]
            dx, dy = part["x"].to_numpy()[:, None] - nx, part["y"].to_numpy()[:, None] - ny
            d2 = dx.astype(float) ** 2 + dy.astype(float) ** 2
            best = d2.argmin(axis=1)
            out.append(pd.DataFrame({"id": part["id"].to_numpy(), "node": right["node"].to_numpy()[best], "node_x": nx[best], "node_y": ny[best], "d2": d2[np.arange(len(part)), best]}))
        return pd.concat(out) if out else pd.DataFrame({"id": left["id"].iloc[:0], **{c: np.zeros(0, np.int64) for c in ("node", "node_x", "node_y")}, "d2": np.zeros(0)})

    kind = points.schema["id"].dataType.simpleString()
    found = f"id {kind}, node bigint, node_x bigint, node_y bigint, d2 double"
    own_keys = "".join(f"`{c}` {points.schema[c].dataType.simpleString()}, " for c in by)
    dots = points.select(*by, "id", F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y"))
    placed = nodes.mapInArrow(spread(None), own_keys + "node bigint, x bigint, y bigint, leaf int")

    def searched(asked: DataFrame) -> DataFrame:
        left, right = salted(asked, placed, [*by, "leaf"], "id", points_per_task)
        return left.groupBy(*by, "leaf", "task").cogroup(right.groupBy(*by, "leaf", "task")).applyInPandas(closest, found)

    own = searched(dots.mapInArrow(spread(None), own_keys + f"id {kind}, x bigint, y bigint, leaf int"))
    some = nodes.groupBy(*by).agg(F.min(F.struct("x", "y")).alias("some")).where(F.col("some").isNotNull())
    some = dots.join(some, list(by)) if by else dots.crossJoin(F.broadcast(some))  # without by: one row
    away = F.pow((F.col("x") - F.col("some.x")).cast("double"), F.lit(2.0)) + F.pow((F.col("y") - F.col("some.y")).cast("double"), F.lit(2.0))
    bound = some.join(own.select("id", F.col("d2").alias("near")), "id", "left").select(*by, "id", "x", "y", F.coalesce("near", away).alias("d2"))
    near = searched(bound.mapInArrow(spread("d2"), own_keys + f"id {kind}, x bigint, y bigint, d2 double, leaf int"))
    best = near.groupBy("id").agg(F.min(F.struct("d2", "node_x", "node_y", "node")).alias("m"))
    return best.select("id", "m.node", "m.node_x", "m.node_y", "m.d2")


#: Fixed value: stands for "no previous node"; below every packed node.
NONE = -(1 << 62)


class Cell:
    """The arcs of one cell of a graph as arrays; nodes beyond its border are targets only."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> None:
        order = np.argsort(src, kind="stable")
        self.src, self.dst, self.weight = src[order], dst[order], weight[order]
        nodes, first = np.unique(self.src, return_index=True)
        ends = np.append(first, len(self.src))[1:]
        self.at = {n: k for n, k in zip(nodes.tolist(), zip(first.tolist(), ends.tolist(), strict=True), strict=True)}
        self.targets, self.weights = self.dst.tolist(), self.weight.tolist()

    def settle(self, seeds: list[tuple[int, int, int, int]], inside, wanted: set[int] | None = None) -> dict[int, tuple[int, int, int]]:
        """(cost, hops, previous) by node of all nodes reached from ``seeds`` (cost, hops, previous, node) without leaving the
        cell, or up to the last ``wanted`` one. Ties: fewer hops, then the smaller previous node."""
        done: dict[int, tuple[int, int, int]] = {}
        heap = sorted(seeds)
        left = None if wanted is None else set(wanted)
        while heap and (left is None or left):
            cost, hops, previous, node = heapq.heappop(heap)
            if node in done:
                continue
            done[node] = (cost, hops, previous)
            if left is not None:
                left.discard(node)
            first, end = self.at.get(node, (0, 0))
            for k in range(first, end):
                to = self.targets[k]
                if to not in done and inside(to):
                    heapq.heappush(heap, (cost + self.weights[k], hops + 1, node, to))
        return done


def _area(by: Sequence[str], within: str) -> Column:
    """One key for a map, or for a map and ``by``; null where one of them is."""
    if not by:
        return F.col(within)
    whole = F.to_json(F.struct(*by, within))
    for c in (*by, within):
        whole = F.when(F.col(c).isNotNull(), whole)
    return whole


def _celled(df: DataFrame, tree: SplitTree, **columns: str) -> DataFrame:
    """``df`` with the tree's leaf of packed nodes: new column = column of nodes. A null node has none."""
    schema = T.StructType([*df.schema.fields, *[T.StructField(c, T.IntegerType()) for c in columns]])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = []
            for node in columns.values():
                known = batch.column(node).is_valid().to_numpy(zero_copy_only=False)
                x, y = unpacked_nodes(batch.column(node).fill_null(0).to_numpy(zero_copy_only=False))
                leaves.append(pa.array(tree.home(unit_vectors(x / 100, y / 100)).astype(np.int32), mask=~known))
            yield pa.RecordBatch.from_arrays([*batch.columns, *leaves], names=[*batch.schema.names, *columns])

    return df.mapInArrow(place, schema)


def shortest_paths(arcs: DataFrame, pairs: DataFrame, *, within: str = "map_id", by: Sequence[str] = (), weight: str = "my_weight", scale: float = 1e6, cell_nodes: int = 65_536, origins_per_task: int = 512) -> tuple[DataFrame, DataFrame]:
    """Least-cost paths: (paths, errors) for ``pairs`` (id string, ``within``, origin, destination) over ``arcs``.

    ``paths`` (id, cost, hops, path): cost is the sum of weights in whole ``1/scale`` (a missing weight counts 1). Of equal
    costs the path of fewer hops, of these the one of the smaller previous node counts. Pairs with equal ends and pairs
    without a way go to ``errors`` (id, reason). Arcs of negative weight count 0. With ``by``, columns of both tables, a
    pair takes only arcs of its own values.

    A split tree parts maps into cells of about ``cell_nodes`` nodes, which a task can hold. From each distinct origin the
    cells are searched by a heap, from its own on; what leaves a cell is an entry of the next one, and a cell is searched
    again while its entries become better. Only entries are kept, and none that costs more than the ways to all of the
    origin's destinations found so far. At the end paths are traced back cell by cell, searching each once more from its
    final entries. A map of one cell is thus searched once; larger ones need about as many rounds as cells on their way.
    Origins of a cell are spread over tasks of ``origins_per_task``, for whose searches its arcs are copied once.
    """
    spark = arcs.sparkSession
    best = cheapest_arcs(arcs.select(*by, within, "src", "dst", "edge_id", F.col(weight).alias("w")), "w", by=[*by, within])
    best = written(best.select(_area(by, within).alias("area"), "src", "dst", F.greatest(F.lit(0), F.round(F.coalesce("weight", F.lit(1.0)) * scale)).cast("bigint").alias("w")), "best")
    x, y = unpacked(F.col("n"))
    places = best.select(F.explode(F.array("src", "dst")).alias("n")).distinct().select(x.alias("x"), y.alias("y"))
    tree = fitted_tree(checkpointed(places), cell_nodes, unit=0.01)
    ways = written(_celled(best, tree, cell="src", dst_cell="dst"), "ways")
    asked = checkpointed(_celled(pairs.select(F.col("id").cast("string").alias("id"), _area(by, within).alias("area"), "origin", "destination"), tree, cell="origin", last_cell="destination"))
    open_ = asked.where(F.col("area").isNotNull() & (F.col("origin") != F.col("destination")))
    watched = open_.select("area", "origin", F.col("last_cell").alias("cell"), F.col("destination").alias("node")).distinct()
    label = F.struct("cost", "hops", "previous")
    blank = [F.lit(-1).cast("bigint").alias(c) for c in ("cost", "hops", "previous")]  # not null: pandas would make doubles of them
    rows = "area string, origin bigint, cell int, node bigint, cost bigint, hops bigint, previous bigint"

    def task_pairs(asking: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows of searches and the arcs of their cells, by tasks."""
        each = asking.select("area", "cell", "origin").distinct()
        spread, copies = salted(each, ways, ["area", "cell"], "origin", origins_per_task)
        return asking.join(spread, ["area", "cell", "origin"]), copies

    def propagate(key, links: pd.DataFrame, seeds: pd.DataFrame) -> pd.DataFrame:
        own = int(key[1])
        cell, to_cell = Cell(links["src"].to_numpy(), links["dst"].to_numpy(), links["w"].to_numpy()), dict(zip(links["dst"].tolist(), links["dst_cell"].tolist(), strict=True))
        out_of = links[links["dst_cell"] != own]
        exits = list(zip(out_of["src"].tolist(), out_of["dst"].tolist(), out_of["w"].tolist(), out_of["dst_cell"].tolist(), strict=True))
        out = []
        for origin, group in seeds.groupby("origin"):
            known = group[group["cost"] >= 0]
            reached = cell.settle(list(zip(*[known[c].tolist() for c in ("cost", "hops", "previous", "node")], strict=True)), lambda n: to_cell.get(n, own) == own)
            for src, dst, w, there in exits:
                if src in reached:
                    out.append((key[0], origin, there, dst, reached[src][0] + w, reached[src][1] + 1, src, False))
            for node in group["node"][group["cost"] < 0].tolist():
                if node in reached:
                    out.append((key[0], origin, own, node, *reached[node], True))
        return pd.DataFrame(out, columns=["area", "origin", "cell", "node", "cost", "hops", "previous", "final"]).astype({"area": object})

    seeds = open_.select("area", "origin", "cell", F.col("origin").alias("node"), F.lit(0).cast("bigint").alias("cost"), F.lit(0).cast("bigint").alias("hops"), F.lit(NONE).cast("bigint").alias("previous")).distinct()
    entries = checkpointed(seeds)
    if not ways.where(F.col("cell") != F.col("dst_cell")).isEmpty():
        rounds, goals = Rounds(spark, "entries"), Rounds(spark, "goals")
        pending, costs = entries.select("area", "origin", "cell"), spark.createDataFrame([], "area string, origin bigint, node bigint, cost bigint")
        while True:
            asking = entries.unionByName(watched.select("area", "origin", "cell", "node", *blank)).join(pending.distinct(), ["area", "origin", "cell"], "left_semi")
            left, copies = task_pairs(asking)
            found = checkpointed(copies.groupBy("area", "cell", "task").cogroup(left.groupBy("area", "cell", "task")).applyInPandas(propagate, rows + ", final boolean"))
            costs = goals.keep(costs.unionByName(found.where("final").select("area", "origin", "node", "cost")).groupBy("area", "origin", "node").agg(F.min("cost").alias("cost")))
            # beyond the dearest of an origin's destinations, once all are found, no entry matters
            limit = watched.join(costs, ["area", "origin", "node"], "left").groupBy("area", "origin").agg(F.when(F.count("cost") == F.count(F.lit(1)), F.max("cost")).alias("most"))
            new = found.where(~F.col("final")).groupBy("area", "origin", "cell", "node").agg(F.min(label).alias("n"))
            new = new.join(limit, ["area", "origin"], "left").where(F.col("most").isNull() | (F.col("n.cost") <= F.col("most"))).drop("most")
            merged = entries.select("area", "origin", "cell", "node", label.alias("d")).join(new, ["area", "origin", "cell", "node"], "full")
            better = F.coalesce(F.col("n").isNotNull() & (F.col("d").isNull() | (F.col("n") < F.col("d"))), F.lit(False))
            table, state = rounds.observed(merged.select("area", "origin", "cell", "node", F.least("d", "n").alias("l"), better.alias("better")).select("area", "origin", "cell", "node", "l.*", "better"), F.count(F.when(F.col("better"), 1)).alias("n"))
            entries, pending = table.drop("better"), table.where("better").select("area", "origin", "cell")
            if not state["n"]:
                break

    def trace(key, links: pd.DataFrame, seeds: pd.DataFrame) -> pd.DataFrame:
        own = int(key[1])
        cell, to_cell = Cell(links["src"].to_numpy(), links["dst"].to_numpy(), links["w"].to_numpy()), dict(zip(links["dst"].tolist(), links["dst_cell"].tolist(), strict=True))
        out = []
        for origin, group in seeds.groupby("origin"):
            known, trips = group[group["id"].isna()], group[group["id"].notna()]
            entered = {n: tuple(rest) for *rest, n in zip(*[known[c].tolist() for c in ("cost", "hops", "previous", "node")], strict=True)}
            reached = cell.settle([(*rest, n) for n, rest in entered.items()], lambda n: to_cell.get(n, own) == own, set(trips["node"].tolist()))
            for trip, node in zip(trips["id"].tolist(), trips["node"].tolist(), strict=True):
                if node in reached:
                    path, at = [node], node
                    while reached[at] != entered.get(at):
                        at = reached[at][2]
                        path.append(at)
                    out.append((trip, key[0], origin, *reached[node][:2], path[::-1], reached[at][2]))
        return pd.DataFrame(out, columns=["id", "area", "origin", "cost", "hops", "path", "node"]).astype({"id": object, "area": object})

    piece = "id string, area string, origin bigint, cost bigint, hops bigint, path array<bigint>, node bigint"
    asking = open_.select("area", "origin", F.col("last_cell").alias("cell"), F.col("destination").alias("node"), "id")
    pieces: DataFrame | None = None
    part = 0
    while True:
        known = entries.join(asking.select("area", "origin", "cell").distinct(), ["area", "origin", "cell"], "left_semi")
        left, copies = task_pairs(known.withColumn("id", F.lit(None).cast("string")).unionByName(asking.select("area", "origin", "cell", "node", "id", *blank)))
        found = checkpointed(copies.groupBy("area", "cell", "task").cogroup(left.groupBy("area", "cell", "task")).applyInPandas(trace, piece))
        own = found.select("id", "cost", "hops", F.lit(part).alias("part"), "path", (F.col("node") == NONE).alias("whole"))
        pieces = own if pieces is None else pieces.unionByName(own)
        following = found.where(F.col("node") != NONE)
        if following.isEmpty():
            break
        asking = checkpointed(_celled(following.select("area", "origin", "node", "id"), tree, cell="node"))
        part += 1
    if part:
        by_trip = pieces.groupBy("id").agg(F.max("cost").alias("cost"), F.max("hops").alias("hops"), F.array_sort(F.collect_list(F.struct((-F.col("part")).alias("k"), "path"))).alias("p"), F.bool_or("whole").alias("whole"))
        pieces = checkpointed(by_trip.select("id", "cost", "hops", F.flatten(F.col("p.path")).alias("path"), "whole"))
    paths = pieces.where("whole").select("id", "cost", "hops", "path")
    failed = asked.join(paths.select("id"), "id", "left_anti")
    errors = failed.select("id", F.when(F.col("origin") == F.col("destination"), "same node").when(F.col("origin").isNull() | F.col("destination").isNull(), "no node").otherwise("no path").alias("reason"))
    return paths, errors


def path_edges(paths: DataFrame, arcs: DataFrame, *, by: Sequence[str] = (), weight: str = "my_weight") -> DataFrame:
    """(id, step_id, edge_id, src, dst, weight): the cheapest arc between consecutive nodes of each path (of its ``by``, say
    profile and map)."""
    steps = paths.where(F.size("path") >= 2).select(*by, "id", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.element_at("path", i).alias("src"), F.element_at("path", i + 1).alias("dst")))).alias("step_id", "s"))
    best = cheapest_arcs(arcs.select(*by, "src", "dst", "edge_id", F.col(weight).alias("w")), "w", by=by)
    return steps.select(*by, "id", "step_id", "s.src", "s.dst").join(best, [*by, "src", "dst"]).select("id", "step_id", "edge_id", "src", "dst", "weight")


def path_line(paths: DataFrame) -> DataFrame:
    """(id, length, wkt): the metres of each path's straight steps, and its line."""
    x, y = (lambda n: unpacked(n)[0] / 100), (lambda n: unpacked(n)[1] / 100)
    step = lambda i: F.hypot(x(F.element_at("path", i + 1)) - x(F.element_at("path", i)), y(F.element_at("path", i + 1)) - y(F.element_at("path", i)))
    length = F.aggregate(F.transform(F.sequence(F.lit(1), F.size("path") - 1), step), F.lit(0.0), lambda s, d: s + d)
    text = F.array_join(F.transform("path", lambda n: F.concat_ws(" ", x(n).cast("string"), y(n).cast("string"))), ", ")
    return paths.where(F.size("path") >= 2).select("id", length.alias("length"), F.concat(F.lit("LINESTRING ("), text, F.lit(")")).alias("wkt"))


def random_od_points(box: DataFrame, n: int, *, seed: int = 1) -> DataFrame:
    """(route_id, role, x, y): ``n`` origins and destinations spread over the box (min_x, min_y, max_x, max_y; whole
    centimetres, one row). A coordinate comes from the first 52 bits of the MD5 of seed, point and axis, so points have no
    period, and other engines can repeat them."""

    def unit(axis: str) -> Column:
        return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"), F.lit(axis))), 1, 13), 16, 10).cast("bigint").cast("double") / float(1 << 52)

    points = box.sparkSession.range(2 * n).crossJoin(F.broadcast(box))  # one row
    at = lambda u, a, b: F.floor(F.col(a) + u * (F.col(b) - F.col(a))).cast("bigint")
    role = F.when(F.col("id") % 2 == 0, "origin").otherwise("destination")
    return points.select(F.floor(F.col("id") / 2).cast("bigint").alias("route_id"), role.alias("role"), at(unit("x"), "min_x", "max_x").alias("x"), at(unit("y"), "min_y", "max_y").alias("y"))


def generate_paths(edges: DataFrame, od: DataFrame, *, within: str = "map_id", by: Sequence[str] = (), **search: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(paths, errors, arcs) for ``od`` (id, ``within``, role, x, y; whole centimetres) over weighted ``edges``: selected
    network, nearest nodes, least-cost paths. ``paths`` has ``by`` and ``within`` too. A trip stays on its own map and, with
    ``by``, columns of both tables such as profile_id, on the edges of its own values. ``search``: cell_nodes, origins_per_task."""
    keys = [*by, within]
    asked = few(od.select(*keys).distinct())  # edges of profiles and maps without a trip aren't needed
    edges = selected(edges).select(*keys, "edge_id", "src", "dst", "bikepath_id", "include", "my_weight").join(asked, keys, "left_semi")
    arcs = written(directed_arcs(selected_network(written(edges, "edges"), within=within, by=by)).drop("oneway", "include", "bikepath_id"), "arcs")
    x, y = unpacked(F.col("node"))
    nodes = arcs.select(*keys, F.explode(F.array("src", "dst")).alias("node")).distinct().select(*keys, "node", x.alias("x"), y.alias("y"))
    keyed = checkpointed(od.select(*keys, F.concat_ws(" ", F.col("id").cast("string"), "role").alias("id"), F.col("id").cast("string").alias("trip"), "role", "x", "y"))
    snapped = keyed.join(nearest_nodes(keyed, nodes, by=keys), "id", "left")
    end = lambda role: F.max(F.when(F.col("role") == role, F.col("node"))).alias(role)
    trips = checkpointed(snapped.groupBy(*keys, F.col("trip").alias("id")).agg(end("origin"), end("destination")))
    paths, errors = shortest_paths(arcs, trips, within=within, by=by, **search)
    return paths.join(trips.select(*keys, "id"), "id"), errors, arcs


def generate_routes(edges: DataFrame, od: DataFrame, *, within: str = "map_id", by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Batch route generation: (route edges, errors), the edges of ``generate_paths`` in travel order."""
    paths, errors, arcs = generate_paths(edges, od, within=within, by=by)
    return path_edges(paths, arcs, by=[*by, within]), errors


def relabelled(edges: DataFrame, digits: int = 0) -> DataFrame:
    """Edges between nodes whose metres are rounded to ``digits``: ends and node keys are rewritten, nodes that fall together
    become one, and edges between them self-loops, which ``without_self_loops`` removes."""
    near = lambda c: F.floor(F.round(F.col(c) / 100, digits) * 100 + 0.5).cast("bigint")
    moved = edges.withColumns({c: near(c) for c in ("x1", "y1", "x2", "y2")})
    return moved.withColumns({"src": packed(F.col("x1"), F.col("y1")), "dst": packed(F.col("x2"), F.col("y2"))})
