"""Feature vectors of route steps, and the actions open at each step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymill.functions.wkt import line_coords, point_xy
from waymill.operators.network import number

#: Tolerances of closeness of two places on one axis.
RELATIVE, ABSOLUTE = 1e-5, 1e-8


def route_steps(route_edges: DataFrame) -> DataFrame:
    """(route_id, step_id, x1, y1, x2, y2, crossing, path_type, length, width, curb): one row per step with a readable
    line; of repeated rows the smallest. Numbers are 0 where unknown, flags 1 for a crossing and for a walking path."""
    c = line_coords(F.col("geometry"))
    zero = F.lit(0.0)
    flag = lambda name, v: F.coalesce((F.col(name) == v).cast("double"), zero)
    a, b = F.element_at("c", 1), F.element_at("c", -1)
    row = F.struct(
        a.x.alias("x1"), a.y.alias("y1"), b.x.alias("x2"), b.y.alias("y2"), flag("crossing", "Yes").alias("crossing"), flag("path_type", "walk").alias("path_type"),
        F.coalesce(number("length"), zero).alias("length"), F.coalesce(number("obstacle_free_width_float"), zero).alias("width"), F.coalesce(number("curb_height_max"), zero).alias("curb"),
    )
    read = route_edges.withColumn("c", c).where(F.col("c").isNotNull() & F.col("route_id").isNotNull() & F.col("step_id").isNotNull())
    # partial by step, so a step delivered millions of times is no hot task
    return read.groupBy("route_id", "step_id").agg(F.min(row).alias("r")).select("route_id", "step_id", "r.*")


def trip_ends(start_end: DataFrame) -> DataFrame:
    """(route_id, ox, oy, dx, dy): origin and destination node of each route that has both readable; the first row of a
    role by point_id counts."""
    placed = start_end.select("route_id", "coordinates", "point_id", point_xy(F.col("geometry")).alias("p")).where(F.col("p").isNotNull())
    role = lambda name: F.min_by(F.when(F.col("coordinates") == name, F.col("p")), F.when(F.col("coordinates") == name, F.struct("point_id", "p")))
    both = placed.groupBy("route_id").agg(role("origin_node").alias("o"), role("destination_node").alias("d")).where(F.col("o").isNotNull() & F.col("d").isNotNull())
    return both.select("route_id", F.col("o.x").alias("ox"), F.col("o.y").alias("oy"), F.col("d.x").alias("dx"), F.col("d.y").alias("dy"))


def close(a: Column, b: Column) -> Column:
    """|a - b| within the absolute tolerance plus the relative one of b."""
    return F.abs(a - b) <= ABSOLUTE + RELATIVE * F.abs(b)


STEP = ("step_id", "x1", "y1", "x2", "y2", "crossing", "path_type", "length", "width", "curb")


def walked(steps: DataFrame, ends: DataFrame) -> DataFrame:
    """(route_id, k, ox, oy, dx, dy, w): the steps of each route in order with their number k from 0, the trip's ends, and
    the step's columns w with the place reached after it (w.cx, w.cy).

    From the origin node on: a step that starts close to the current place leads to its end, any other to its start.
    The place depends on all steps before, but the place after a step is one of its two ends, so a step is a map of two
    states to two: it keeps them, swaps them, or leads to the same end from both. The state is thus that of the last step
    of the third kind, swapped as often as swaps came after it: running sums over one sort of each route, of any length.
    """
    order = Window.partitionBy("route_id").orderBy("step_id")
    near = lambda x, y: close(F.col("x1"), x) & close(F.col("y1"), y)
    before = lambda c: F.lag(c).over(order)
    rows = steps.join(ends, "route_id").withColumn("k", (F.row_number().over(order) - 1).cast("int"))
    rows = rows.withColumns({"from_start": F.when(F.col("k") == 0, near(F.col("ox"), F.col("oy"))).otherwise(near(before("x1"), before("y1"))), "from_end": F.when(F.col("k") == 0, near(F.col("ox"), F.col("oy"))).otherwise(near(before("x2"), before("y2")))})
    # whether the step's end is reached: from the start, and from the end, of the step before
    swaps = F.sum((F.col("from_start") & ~F.col("from_end")).cast("int")).over(order)
    rows = rows.withColumn("swaps", swaps)
    fixed = F.last(F.when(F.col("from_start") == F.col("from_end"), F.struct(F.col("from_start").alias("end"), "swaps")), ignorenulls=True).over(order)
    rows = rows.withColumn("fixed", fixed)
    at_end = F.col("fixed.end") != ((F.col("swaps") - F.col("fixed.swaps")) % 2 == 1)
    place = {f"c{a}": F.when(at_end, F.col(f"{a}2")).otherwise(F.col(f"{a}1")) for a in ("x", "y")}
    return rows.select("route_id", "ox", "oy", "dx", "dy", "k", F.struct(*STEP, *[v.alias(n) for n, v in place.items()]).alias("w"))


def feature_vectors(route_edges: DataFrame, start_end: DataFrame) -> DataFrame:
    """(route_id, step_id, feature_vec): 15 slots: ends of the line, crossing, path type, length, width, curb, origin
    node, destination node, place reached. ``step_id`` is numbered anew from 0. Routes without both end points are
    left out; ``routes_without_ends`` lists them."""
    full = walked(route_steps(route_edges), trip_ends(start_end))
    w = lambda *names: [F.col(f"w.{c}") for c in names]
    vector = F.array(*w("x1", "y1", "x2", "y2", "crossing", "path_type", "length", "width", "curb"), "ox", "oy", "dx", "dy", *w("cx", "cy"))
    return full.select("route_id", F.col("k").alias("step_id"), vector.alias("feature_vec"))


def routes_without_ends(route_edges: DataFrame, start_end: DataFrame) -> DataFrame:
    """(route_id, reason): routes that give no features."""
    every = route_edges.where(F.col("route_id").isNotNull()).select("route_id").distinct()
    shown = route_steps(route_edges).select("route_id").distinct().withColumn("shown", F.lit(True))
    ended = trip_ends(start_end).select("route_id").withColumn("ended", F.lit(True))
    rows = every.join(shown, "route_id", "left").join(ended, "route_id", "left")
    return rows.where(F.col("shown").isNull() | F.col("ended").isNull()).select("route_id", F.when(F.col("shown").isNull(), "no geometry").otherwise("no end points").alias("reason"))


def current_nodes(steps: DataFrame) -> DataFrame:
    """Rows (route_id, step_id, feature_vec) with the node an agent stands on, (nx, ny) rounded to 5 digits; null for a
    padding step (all zeros).

    A lone step: its start. The first step: its end if its start is one of the next step's ends, else its start. Any
    other: its end if its start is one of the previous step's ends, else its start. (So the first and the later steps
    treat near and far ends differently; that is the defined behaviour.)
    """
    order = Window.partitionBy("route_id").orderBy("step_id")
    at = lambda i: F.round(F.element_at("feature_vec", i), 5)
    placed = steps.select("route_id", "step_id", "feature_vec", F.struct(at(1).alias("x"), at(2).alias("y")).alias("a"), F.struct(at(3).alias("x"), at(4).alias("y")).alias("b"))
    shifted = placed.withColumns({f"{n}_{e}": f(e).over(order) for n, f in (("next", F.lead), ("previous", F.lag)) for e in ("a", "b")})
    first = F.col("previous_a").isNull()
    touches = lambda n: (F.col("a") == F.col(f"{n}_a")) | (F.col("a") == F.col(f"{n}_b"))
    node = F.when(first & F.col("next_a").isNull(), F.col("a")).when(F.when(first, touches("next")).otherwise(touches("previous")), F.col("b")).otherwise(F.col("a"))
    shown = F.exists("feature_vec", lambda x: x != 0)
    return shifted.select("route_id", "step_id", F.when(shown, node).alias("n")).select("route_id", "step_id", F.col("n.x").alias("nx"), F.col("n.y").alias("ny"))


def valid_actions(steps: DataFrame, adjacency: DataFrame) -> DataFrame:
    """(route_id, step_id, actions): successors of each step's current node; empty for padding and unknown nodes.
    ``adjacency`` (x, y, neighbours) in metres rounded to 5 digits."""
    at = current_nodes(steps)
    ways = adjacency.select(F.round("x", 5).alias("nx"), F.round("y", 5).alias("ny"), "neighbours")
    empty = F.array().cast(adjacency.schema["neighbours"].dataType)
    return at.join(ways, ["nx", "ny"], "left").select("route_id", "step_id", F.coalesce("neighbours", empty).alias("actions"))
