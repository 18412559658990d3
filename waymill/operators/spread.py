"""Spreading rows over tasks: split trees fitted to a table of places, and salts for crowded keys."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymill.functions.kdtree import MOST_LEAVES, PER_LEAF, SplitTree, unit_vectors


def _sampled(places: DataFrame, share: float, seed: int) -> DataFrame:
    """Places by hash, about ``share`` of them; the choice doesn't depend on the order of rows."""
    if share >= 1:
        return places
    return places.where(F.pmod(F.xxhash64("x", "y", F.lit(seed)), F.lit(1 << 40)) < int(share * (1 << 40)))


def home_leaves(places: DataFrame, tree: SplitTree, unit: float) -> DataFrame:
    """(x, y, leaf)."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            leaf = tree.home(unit_vectors(x.to_numpy(zero_copy_only=False) * unit, y.to_numpy(zero_copy_only=False) * unit))
            yield pa.RecordBatch.from_arrays([x, y, pa.array(leaf.astype(np.int32))], names=["x", "y", "leaf"])

    kind = lambda c: places.schema[c].dataType.simpleString()
    return places.select("x", "y").mapInArrow(place, f"x {kind('x')}, y {kind('y')}, leaf int")


def fitted_tree(places: DataFrame, leaf_rows: int, *, unit: float = 1.0, per_leaf: int = PER_LEAF, passes: int = 8) -> SplitTree:
    """A split tree whose leaves hold about ``leaf_rows`` of the distinct ``places`` (x, y; ``unit`` metres each).

    The sample grows with the number of leaves (``per_leaf`` for each); then places are counted per leaf, and leaves of
    more than twice ``leaf_rows`` are parted again by a sample of their own, until none is left. What comes to the driver
    is ``per_leaf`` rows a leaf and one count a leaf, with at most ``MOST_LEAVES`` leaves. Every place is placed by the
    tree, in the sample or not. ``places`` is read several times: pass a checkpointed table.
    """
    n = places.count()
    depth = lambda rows: int(np.clip(np.ceil(np.log2(max(1.0, rows / leaf_rows))), 0, np.log2(MOST_LEAVES)))
    vectors = lambda frame: unit_vectors(frame["x"].to_numpy(float) * unit, frame["y"].to_numpy(float) * unit)
    if not depth(n):
        return SplitTree(np.zeros((0, 3)), 0)
    tree = SplitTree(vectors(_sampled(places, per_leaf * 2 ** depth(n) / n, 0).toPandas()), depth(n))
    for turn in range(1, passes + 1):
        homes = home_leaves(places, tree, unit)
        full = {r[0]: r[1] for r in homes.groupBy("leaf").count().where(F.col("count") > 2 * leaf_rows).collect()}
        if not full or tree.leaves >= MOST_LEAVES:
            break
        named = places.sparkSession.createDataFrame([(k,) for k in full], "leaf int")  # at most MOST_LEAVES
        crowded = homes.join(named, "leaf", "left_semi")
        drawn = _sampled(crowded, 4 * per_leaf / leaf_rows, turn).toPandas()
        before = tree.leaves
        tree.split({k: vectors(part) for k, part in drawn.groupby("leaf")}, {k: depth(c) for k, c in full.items()})
        if tree.leaves == before:
            break
    return tree


def salted(left: DataFrame, right: DataFrame, keys: Sequence[str], spread_by: str, rows_per_task: int) -> tuple[DataFrame, DataFrame]:
    """Both tables with a ``task``: rows of ``left`` of one key are spread by ``spread_by`` over as many tasks as hold about
    ``rows_per_task`` each, and rows of ``right`` are in each task of their key. Right rows without left ones are left out."""
    tasks = left.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / rows_per_task).cast("int").alias("tasks"))
    spread = left.join(tasks, list(keys)).withColumn("task", F.pmod(F.xxhash64(spread_by), F.col("tasks")).cast("int")).drop("tasks")
    copies = right.join(tasks, list(keys)).withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).drop("tasks")
    return spread, copies
