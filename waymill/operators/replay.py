"""Replay data for sequential recommendation: padded histories before and after each action."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def padded(items: Column, length: int, pad: Column) -> Column:
    """The last ``length`` items; fewer are filled up at the end with ``pad``."""
    return F.when(F.size(items) >= length, F.slice(items, F.greatest(F.size(items) - length + 1, F.lit(1)), length)).otherwise(F.concat(items, F.array_repeat(pad, F.greatest(F.lit(0), length - F.size(items)))))


def shown_length(items: Column, length: int) -> Column:
    """Items shown, at least 1 (an empty history counts 1) and at most ``length``."""
    return F.greatest(F.least(F.size(items), F.lit(length)), F.lit(1))


def replay_buffer(steps: DataFrame, *, length: int = 10) -> DataFrame:
    """(route_id, step_id, state, len_state, action, next_state, len_next_state, is_done) for steps (route_id, step_id,
    feature_vec).

    state: the vectors of the last ``length`` steps before, oldest first, filled up at the end with zeros; next_state the
    same with the current one; is_done on a route's last step. Exactly repeated steps count once; a step without a
    vector is none, a null slot is 0. One shuffle by route serves the removal of repeats and all windows, which share
    one sort; the frame holds ``length`` rows, so a long route needs no more memory than a short one.
    """
    clean = F.transform("feature_vec", lambda x: F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)))
    known = steps.where(F.col("feature_vec").isNotNull() & F.col("route_id").isNotNull()).select("route_id", "step_id", clean.alias("action")).repartition("route_id").distinct()
    order = Window.partitionBy("route_id").orderBy("step_id", "action")
    before, until = F.collect_list("action").over(order.rowsBetween(-length, -1)), F.collect_list("action").over(order.rowsBetween(1 - length, 0))
    framed = known.select("route_id", "step_id", "action", before.alias("b"), until.alias("u"), F.lead("step_id").over(order).isNull().alias("is_done"))
    zeros = F.transform("action", lambda x: F.lit(0.0))
    return framed.select(
        "route_id",
        "step_id",
        padded(F.col("b"), length, zeros).alias("state"),
        shown_length(F.col("b"), length).alias("len_state"),
        "action",
        padded(F.col("u"), length, zeros).alias("next_state"),
        shown_length(F.col("u"), length).alias("len_next_state"),
        "is_done",
    )


def data_statistics(steps: DataFrame, *, length: int = 10) -> DataFrame:
    """One row: state_size, feature_dim (null for an empty input)."""
    return steps.where(F.col("feature_vec").isNotNull()).agg(F.max(F.size("feature_vec")).alias("feature_dim")).select(F.lit(length).alias("state_size"), "feature_dim")
