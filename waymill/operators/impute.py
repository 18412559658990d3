"""Chained-equation imputation: each incomplete numeric field is regressed on the others, round after round.

The fits are distributed: one aggregation per field and round sums the cross products of the design columns over
all rows with a measurement (partial sums in the map stage, one row to the driver, whatever the data's size), and
the driver solves a system whose order is the number of design columns. The filled values then change as column
expressions. Every fill keeps a residual draw, so the spread of a field isn't flattened.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymill.session import written


@dataclass(frozen=True)
class Field:
    """A numeric field and the closed range in which its content counts as measured."""

    name: str
    low: float
    high: float


#: The measured ranges of the network's fields.
CURB = Field("curb_height_max", 0.0, 0.6)
WIDTH = Field("obstacle_free_width_float", 0.2, 20.0)


def measured(field: Field) -> Column:
    """The value where it is a measurement, else null (null, NaN, infinite and out-of-range content alike)."""
    value = F.col(field.name).cast("double")
    return F.when(~F.isnan(value) & value.between(field.low, field.high), value)


def _normal(*keys: Column) -> Column:
    """A standard normal draw fixed by its keys: the same cell gets the same draw in every round and run."""
    unit = lambda salt: (F.pmod(F.xxhash64(F.lit(salt), *keys), F.lit(1 << 40)).cast("double") + 0.5) / float(1 << 40)
    return F.sqrt(-2.0 * F.log(unit(1))) * F.cos(2.0 * math.pi * unit(2))


def _solve(design: list[Column], target: Column, rows: DataFrame, ridge: float) -> tuple[list[float], float]:
    """Least squares by normal equations: coefficients and residual deviation. No rows: zeros."""
    size = len(design)
    sums = [F.sum(design[i] * design[j]).alias(f"g{i}_{j}") for i in range(size) for j in range(i, size)]
    sums += [F.sum(design[i] * target).alias(f"t{i}") for i in range(size)]
    sums += [F.sum(target * target).alias("tt"), F.count(target).alias("n")]
    got = rows.where(target.isNotNull()).agg(*sums).first()
    if not got["n"]:
        return [0.0] * size, 0.0
    gram = np.zeros((size, size))
    for i in range(size):
        for j in range(i, size):
            gram[i, j] = gram[j, i] = got[f"g{i}_{j}"]
    right = np.array([got[f"t{i}"] for i in range(size)])
    scale = np.maximum(np.diag(gram), 1e-12)
    beta = np.linalg.solve(gram + np.diag(ridge * scale + 1e-12), right)
    error = max(0.0, got["tt"] - 2 * beta @ right + beta @ gram @ beta)
    return [float(b) for b in beta], math.sqrt(error / max(1, got["n"] - size))


def latest_measured(df: DataFrame, key: str, fields: list[Field], attributes: list[str], order: str) -> DataFrame:
    """One row per key: of each field the measurement of the latest row that has one, of each attribute the latest
    non-null content. Ties in ``order`` go to the larger value, so the order of the input rows doesn't matter."""
    latest = lambda value, name: F.max_by(value, F.when(value.isNotNull(), F.struct(F.coalesce(F.col(order), F.to_timestamp(F.lit("0001-01-01"))), value))).alias(name)
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(*[latest(measured(f), f.name) for f in fields], *[latest(F.col(a), a) for a in attributes])
    )


def chained_imputation(
    df: DataFrame,
    *,
    key: str = "edge_id",
    fields: tuple[Field, ...] = (CURB, WIDTH),
    group: tuple[str, ...] = ("street_id", "path_type"),
    time: str = "surveyed_at",
    order: str = "loaded_at",
    numeric: tuple[str, ...] = ("length",),
    flags: tuple[tuple[str, str], ...] = (("crossing", "Yes"), ("path_type", "walk")),
    rounds: int = 3,
    ridge: float = 1e-6,
) -> DataFrame:
    """One row per key with every field filled.

    Columns: the key, the group columns, and for each field ``<field>`` (never null while any row of the table has
    a measurement of it), ``<field>_filled`` (the mask) and ``<field>_source``: ``measured``; ``group`` (another
    key of the same group has a measurement; such fills start from the group's mean); ``time`` (none has; they
    start from the mean of the month of ``time``, or of the whole table where that month has none).

    Null groups hold no neighbours. An empty table gives no rows; a field without a single measurement stays null,
    with source null and mask false. Rows with a null key are no records and are left out. Extra columns are
    ignored, whatever their names. Repeated rows and the order of rows don't change the result.
    """
    attributes = list(dict.fromkeys([*group, time, *numeric, *(name for name, _ in flags)]))
    keyed = latest_measured(df, key, list(fields), attributes, order)
    keyed = written(keyed.withColumn("_month", F.date_format(F.col(time), "yyyy-MM")), "keyed")  # read four times

    # statistics of groups and months: partial sums before the shuffle, so a hot group is no hot task
    stats = lambda prefix: [x for i, f in enumerate(fields) for x in (F.avg(f.name).alias(f"{prefix}m{i}"), F.count(f.name).alias(f"{prefix}n{i}"))]
    groups = keyed.where(F.greatest(*[F.col(f.name).isNotNull() for f in fields])).groupBy(*group).agg(*stats("_g"))
    for name in group:
        groups = groups.where(F.col(name).isNotNull())
    months = keyed.groupBy("_month").agg(*stats("_t"))
    overall = keyed.agg(*[F.avg(f.name).alias(f"_a{i}") for i, f in enumerate(fields)])
    # months are bounded by the calendar, `overall` is one row
    base = keyed.join(groups, list(group), "left").join(F.broadcast(months), "_month", "left").crossJoin(F.broadcast(overall))

    columns: list[Column] = [F.col(key), *[F.col(g) for g in group]]
    for i, f in enumerate(fields):
        in_group, in_time = F.coalesce(F.col(f"_gn{i}"), F.lit(0)) > 0, F.coalesce(F.col(f"_tn{i}"), F.lit(0)) > 0
        start = F.when(in_group, F.col(f"_gm{i}")).when(in_time, F.col(f"_tm{i}")).otherwise(F.col(f"_a{i}"))
        # a measured cell's own value is taken out of its group's mean, so that fits see what a missing cell sees
        others = F.when(F.col(f.name).isNotNull() & (F.col(f"_gn{i}") > 1), (F.col(f"_gm{i}") * F.col(f"_gn{i}") - F.col(f.name)) / (F.col(f"_gn{i}") - 1)).when(
            F.col(f.name).isNotNull(), F.coalesce(F.when(in_time, F.col(f"_tm{i}")), F.col(f"_a{i}"))
        )
        columns += [
            F.col(f.name).alias(f"_y{i}"),
            F.coalesce(others, start).alias(f"_h{i}"),
            F.coalesce(F.col(f.name), start).alias(f"_v{i}"),
            F.when(F.col(f.name).isNotNull(), "measured").when(F.col(f"_a{i}").isNull(), F.lit(None)).when(in_group, "group").otherwise("time").alias(f"_source{i}"),
            _normal(F.col(key), F.lit(f.name)).alias(f"_e{i}"),
        ]
    month = 2 * math.pi * (F.month(F.col(time)) - 1) / 12
    exogenous = [F.lit(1.0), F.coalesce(F.sin(month), F.lit(0.0)), F.coalesce(F.cos(month), F.lit(0.0))]
    for name in numeric:
        value = F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))
        exogenous += [F.coalesce(F.log1p(F.when(value >= 0, value)), F.lit(0.0)), value.isNull().cast("double")]
    exogenous += [F.coalesce((F.col(name) == level).cast("double"), F.lit(0.0)) for name, level in flags]
    state = written(base.select(*columns, *[x.alias(f"_x{k}") for k, x in enumerate(exogenous)]), "impute")

    # the chain: every round refits each field on the current state of the others; the state is an expression over
    # the written columns, so a round costs one scan and one aggregation per field
    current = {i: F.col(f"_v{i}") for i in range(len(fields))}
    for _ in range(rounds):
        for i, f in enumerate(fields):
            rest = [F.coalesce(current[j], F.lit(0.0)) for j in range(len(fields)) if j != i]
            design = [*[F.col(f"_x{k}") for k in range(len(exogenous))], F.coalesce(F.col(f"_h{i}"), F.lit(0.0)), *rest]
            beta, spread = _solve(design, F.col(f"_y{i}"), state, ridge)
            guess = sum((b * x for b, x in zip(beta, design, strict=True)), F.lit(0.0)) + spread * F.col(f"_e{i}")
            # a draw beyond a limit is turned back at it, so that draws don't pile up at the limits
            turned = F.when(guess < f.low, 2 * f.low - guess).when(guess > f.high, 2 * f.high - guess).otherwise(guess)
            bounded = F.greatest(F.lit(f.low), F.least(F.lit(f.high), turned))
            current[i] = F.coalesce(F.col(f"_y{i}"), F.when(F.col(f"_source{i}").isNotNull(), bounded))
            name = f"_v{i}"
            state = state.withColumn(name, current[i])
            current[i] = F.col(name)
    out = [F.col(key), *[F.col(g) for g in group]]
    for i, f in enumerate(fields):
        out += [F.col(f"_v{i}").alias(f.name), (F.col(f"_y{i}").isNull() & F.col(f"_source{i}").isNotNull()).alias(f"{f.name}_filled"), F.col(f"_source{i}").alias(f"{f.name}_source")]
    return state.select(*out)


def filled_cells(filled: DataFrame, key: str = "edge_id", fields: tuple[Field, ...] = (CURB, WIDTH)) -> DataFrame:
    """Long form of the filled cells: key, field_name, value, source."""
    cells = F.explode(F.array(*[F.struct(F.lit(f.name).alias("field_name"), F.col(f.name).alias("value"), F.col(f"{f.name}_filled").alias("filled"), F.col(f"{f.name}_source").alias("source")) for f in fields])).alias("c")
    return filled.select(F.col(key), cells).where("c.filled").select(key, "c.field_name", "c.value", "c.source")
