"""Stored routes: duplicates, splits, and the network around their ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymill.functions.wkt import line_coords


def route_keys(route_edges: DataFrame) -> DataFrame:
    """(route_id, key): digest of the multiset of the lines of a route's steps, whatever their order.

    A line counts by its vertices: spelling, blanks, SRID and z don't matter, and a step that was delivered again counts
    once (of different lines the smallest). Routes without a readable line have no key and are left out; unreadable
    lines of other routes are skipped. The digest is the number of steps and two sums of 64-bit hashes, so steps are
    summed in the map stage and no route's lines meet in one place.
    """
    lines = route_edges.where(F.col("route_id").isNotNull()).select("route_id", "step_id", line_coords(F.col("geometry")).alias("c")).where(F.col("c").isNotNull())
    steps = lines.groupBy("route_id", "step_id").agg(F.min("c").alias("c"))
    total = lambda seed: F.sum(F.xxhash64("c", F.lit(seed)).cast("decimal(38,0)")).cast("string")
    return steps.groupBy("route_id").agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), total(1), total(2)).alias("key"))


def route_frequencies(route_edges: DataFrame) -> DataFrame:
    """(key, n_routes, first_route): equal routes by key."""
    return route_keys(route_edges).groupBy("key").agg(F.count(F.lit(1)).alias("n_routes"), F.min("route_id").alias("first_route"))


def kept_routes(route_edges: DataFrame) -> DataFrame:
    """(route_id, kept_route): each route with the smallest route equal to it; a route is kept if both are the same."""
    keys = route_keys(route_edges)
    first = keys.groupBy("key").agg(F.min("route_id").alias("kept_route"))
    return keys.join(first, "key").select("route_id", "kept_route")


def without_duplicates(route_edges: DataFrame) -> DataFrame:
    """Rows of kept routes only; the input isn't touched."""
    kept = kept_routes(route_edges).where(F.col("route_id") == F.col("kept_route")).select("route_id")
    return route_edges.join(kept, "route_id", "left_semi")


def distinct_route_count(route_edges: DataFrame, *, approximate: bool = False) -> DataFrame:
    """One row, ``n_routes``: the number of distinct keys."""
    count = F.approx_count_distinct("key") if approximate else F.countDistinct("key")
    return route_keys(route_edges).agg(count.alias("n_routes"))


def split_hash(identity: Column, seed: int) -> Column:
    """One of 65,536 values by MD5 of seed and id: any engine can repeat it, and equal or missing numbers in ids don't
    gather in one value."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), identity.cast("string"))), 1, 4), 16, 10).cast("int")


def split_members(ids: DataFrame, *, train: float = 0.7, validation: float = 0.15, test: float = 0.15, seed: int = 1) -> DataFrame:
    """(id, split) for distinct ``ids`` (id): the first floor(n*train) by hash are train, the next
    floor(n*validation) val, the rest test. The ratios must sum to 1 within 1e-9.

    Positions come from a count per hash value and range, not from one global sort: the hash has 65,536 values, whose
    running counts are small, and only the rows of one value are numbered together.
    """
    if abs(train + validation + test - 1) > 1e-9:
        raise ValueError("ratios must sum to 1")
    hashed = ids.select("id", split_hash(F.col("id"), seed).alias("h"))
    counts = hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy()))
    placed = hashed.join(before, "h").withColumn("k", F.col("before") + F.row_number().over(Window.partitionBy("h").orderBy("id")))
    a, b = F.floor(F.col("total") * F.lit(float(train))), F.floor(F.col("total") * F.lit(float(validation)))
    return placed.select("id", F.when(F.col("k") <= a, "train").when(F.col("k") <= a + b, "val").otherwise("test").alias("split"))


def matched_routes(route_edges: DataFrame, start_end: DataFrame) -> DataFrame:
    """(id): routes that have both edges and end points."""
    ours = route_edges.select(F.col("route_id").alias("id")).distinct()
    return ours.join(start_end.select(F.col("route_id").alias("id")), "id", "left_semi")


def first_successes(route_edges: DataFrame, n: int = 2) -> DataFrame:
    """(route_id): the first ``n`` routes, by id, that have a readable line. A limit over partial tops: nothing is sorted
    as a whole."""
    good = route_edges.where(line_coords(F.col("geometry")).isNotNull() & F.col("route_id").isNotNull())
    return good.select("route_id").distinct().orderBy("route_id").limit(n)


def clipped(x1: Column, y1: Column, x2: Column, y2: Column, box_x: Column, box_y: Column, radius: Column) -> Column:
    """Whether a segment meets the square of half width ``radius`` about a place: the parameter intervals in which it is
    between the sides overlap in [0, 1]."""
    dx, dy = x2 - x1, y2 - y1

    def interval(start: Column, step: Column, centre: Column) -> tuple[Column, Column]:
        a, b = (centre - radius - start) / F.nullif(step, F.lit(0.0)), (centre + radius - start) / F.nullif(step, F.lit(0.0))
        inside = F.abs(start - centre) <= radius
        return F.when(step == 0, F.when(inside, F.lit(0.0)).otherwise(F.lit(2.0))).otherwise(F.least(a, b)), F.when(step == 0, F.lit(1.0)).otherwise(F.greatest(a, b))

    (low_x, high_x), (low_y, high_y) = interval(x1, dx, box_x), interval(y1, dy, box_y)
    return F.greatest(low_x, low_y, F.lit(0.0)) <= F.least(high_x, high_y, F.lit(1.0))


def viewport_edges(ends: DataFrame, edges: DataFrame, *, radius: float = 70.0, cell: float = 256.0) -> DataFrame:
    """(route_id, edge_id), distinct: edges whose line meets a square of half width ``radius`` about an end of a route.

    ``ends`` (route_id, x, y), ``edges`` (edge_id, geometry). A square and a segment meet in a grid cell that both
    touch, so the join is on cells; the exact clip follows.
    """
    at = lambda v: F.floor(v / cell).cast("bigint")
    boxes = ends.withColumn("cx", F.explode(F.sequence(at(F.col("x") - radius), at(F.col("x") + radius)))).withColumn("cy", F.explode(F.sequence(at(F.col("y") - radius), at(F.col("y") + radius))))
    c = line_coords(F.col("geometry"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.struct(F.element_at("c", i).alias("a"), F.element_at("c", i + 1).alias("b")))
    segments = edges.select("edge_id", c.alias("c")).where(F.col("c").isNotNull()).select("edge_id", F.explode(pairs).alias("s"))
    segments = segments.select("edge_id", F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"))
    segments = segments.withColumn("cx", F.explode(F.sequence(at(F.least("x1", "x2")), at(F.greatest("x1", "x2"))))).withColumn("cy", F.explode(F.sequence(at(F.least("y1", "y2")), at(F.greatest("y1", "y2")))))
    met = boxes.join(segments, ["cx", "cy"]).where(clipped(*[F.col(n) for n in ("x1", "y1", "x2", "y2", "x", "y")], F.lit(radius)))
    return met.select("route_id", "edge_id").distinct()


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows by ``order``: each task sends its own first ``n``, nothing is sorted as a whole."""
    return df.orderBy(*order).limit(n)


def first_and_last(df: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """(key, first_*, last_*): values of the first and last row of each key by ``order``."""
    return df.groupBy(key).agg(*[f(c, order).alias(f"{n}_{c}") for n, f in (("first", F.min_by), ("last", F.max_by)) for c in values])
