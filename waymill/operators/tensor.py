"""Array operators of sequence models. Sequences are array<array<double>> columns (time by channel); weights are given."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymill.functions.expressions import let


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def layer_norm(values: Column, epsilon: float = 1e-8, *, gamma: Column | None = None, beta: Column | None = None) -> Column:
    """(v - mean) / sqrt(population variance + epsilon) over an array, times ``gamma`` plus ``beta`` (arrays of its length;
    1 and 0 if not given)."""
    n = F.size(values)
    centred = let(total(values) / n, lambda m: F.transform(values, lambda x: x - m))

    def scaled(c: Column) -> Column:
        return let(F.sqrt(total(F.transform(c, lambda x: x * x)) / n + epsilon), lambda s: F.transform(c, lambda x: x / s))

    out = let(centred, scaled)
    out = out if gamma is None else F.zip_with(out, gamma, lambda x, g: x * g)
    return out if beta is None else F.zip_with(out, beta, lambda x, b: x + b)


def gather_last(sequence: Column, length: Column) -> Column:
    """The last valid state of a padded sequence; null beyond its end."""
    return F.try_element_at(sequence, length.cast("int"))


def positional_encoding(spark: SparkSession, dim: int, length: int) -> DataFrame:
    """(pos, i, value): angle pos / 10000^(2i/dim); sine where the flat index pos*dim+i is even, cosine where odd."""
    cells = spark.range(dim * length).select(F.floor(F.col("id") / dim).alias("pos"), (F.col("id") % dim).alias("i"), "id")
    angle = F.col("pos") / F.pow(F.lit(10000.0), 2.0 * F.col("i") / dim)
    return cells.select("pos", "i", F.when(F.col("id") % 2 == 0, F.sin(angle)).otherwise(F.cos(angle)).alias("value"))


def embedding_lookup(ids: DataFrame, table: DataFrame, dim: int, *, zero_pad: bool = True, scale: bool = True) -> DataFrame:
    """``ids`` (…, id) with the ``vector`` of the table (id, vector): id 0 and unknown ids give zeros (0 only with
    ``zero_pad``), all times sqrt(dim) with ``scale``."""
    factor = float(dim) ** 0.5 if scale else 1.0
    zeros = F.array_repeat(F.lit(0.0), dim)
    found = ids.join(table, "id", "left")
    vector = F.transform("vector", lambda x: x.cast("double") * factor)
    return found.withColumn("vector", F.when((F.col("id") == 0) if zero_pad else F.lit(False), zeros).otherwise(F.coalesce(vector, zeros)))


def masked_softmax(scores: Column, mask: Column) -> Column:
    """Softmax over the entries whose mask is true, 0 elsewhere; all masked: equal weights."""
    kept = F.zip_with(scores, mask, lambda s, m: F.when(m, s).otherwise(F.lit(-4294967295.0)))
    powers = let(kept, lambda k: let(F.array_max(k), lambda top: F.transform(k, lambda x: F.exp(x - top))))
    return let(powers, lambda p: let(total(p), lambda t: F.transform(p, lambda x: x / t)))


def causal_conv(sequence: Column, taps: list[list[list[float]]], dilation: int = 1, *, bias: list[float] | None = None) -> Column:
    """Dilated causal convolution: taps[k][c][o]; output t sees inputs t, t - d, … with zeros before the start. The last
    tap meets the current input."""
    width, channels = len(taps), len(taps[0][0])
    steps = F.sequence(F.lit(1), F.size(sequence))

    def output(t: Column) -> Column:
        terms = []
        for k, tap in enumerate(taps):
            back = (width - 1 - k) * dilation
            row = F.when(t - back >= 1, F.element_at(sequence, F.greatest(t - back, F.lit(1)).cast("int")))
            terms.append((row, tap))
        cells = []
        for o in range(channels):
            cell = F.lit(0.0 if bias is None else float(bias[o]))
            for row, tap in terms:
                column = F.array(*[F.lit(float(tap[c][o])) for c in range(len(tap))])
                cell = cell + F.coalesce(F.aggregate(F.zip_with(row, column, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x), F.lit(0.0))
            cells.append(cell)
        return F.array(*cells)

    return F.when(F.size(sequence) > 0, F.transform(steps, output)).otherwise(sequence)


def relu(sequence: Column) -> Column:
    return F.transform(sequence, lambda row: F.transform(row, lambda x: F.greatest(x, F.lit(0.0))))


class Attention(NamedTuple):
    """Weights of one attention layer: matrices (c, units) and biases."""

    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    query_bias: np.ndarray
    key_bias: np.ndarray
    value_bias: np.ndarray


def attend(queries: np.ndarray, keys: np.ndarray, weights: Attention, heads: int, causal: bool) -> np.ndarray:
    """Multi-head attention of (n, t, c) arrays: ReLU projections, scaled products, masks of empty keys and of later
    steps, softmax, mask of empty queries, values, and the queries added. No normalisation at the end."""
    project = lambda x, w, b: np.maximum(0, x @ w + b)
    q, k, v = project(queries, weights.query, weights.query_bias), project(keys, weights.key, weights.key_bias), project(keys, weights.value, weights.value_bias)
    cut = lambda x: np.concatenate(np.split(x, heads, axis=2), axis=0)
    scores = cut(q) @ cut(k).transpose(0, 2, 1) / np.sqrt(q.shape[2] // heads)
    low = -(2.0**32) + 1
    scores = np.where(np.tile(np.sign(np.abs(keys.sum(axis=2))), (heads, 1))[:, None, :] == 0, low, scores)
    if causal:
        scores = np.where(np.tril(np.ones(scores.shape[1:])) == 0, low, scores)
    scores = np.exp(scores - scores.max(axis=2, keepdims=True))
    scores /= scores.sum(axis=2, keepdims=True)
    scores *= np.tile(np.sign(np.abs(queries.sum(axis=2))), (heads, 1))[:, :, None]
    return np.concatenate(np.split(scores @ cut(v), heads, axis=0), axis=2) + queries


def feed_forward(x: np.ndarray, first: np.ndarray, second: np.ndarray, first_bias: np.ndarray, second_bias: np.ndarray) -> np.ndarray:
    """Two dense layers over the last axis, ReLU after the first, input added."""
    return np.maximum(0, x @ first + first_bias) @ second + second_bias + x


def normalised(x: np.ndarray, epsilon: float = 1e-8) -> np.ndarray:
    return (x - x.mean(axis=-1, keepdims=True)) / np.sqrt(x.var(axis=-1, keepdims=True) + epsilon)


def convolve(x: np.ndarray, taps: np.ndarray, dilation: int = 1, *, causal: bool = True) -> np.ndarray:
    """(n, t, c) by taps (k, c, o). Not causal: centred, and the dilation is ignored."""
    width, length = len(taps), x.shape[1]
    step, before = (dilation, (width - 1) * dilation) if causal else (1, (width - 1) // 2)
    after = 0 if causal else width - 1 - before
    laid = np.pad(x, ((0, 0), (before, after), (0, 0)))
    return sum(laid[:, k * step : k * step + length] @ taps[k] for k in range(width))


def residual_block(x: np.ndarray, first: np.ndarray, second: np.ndarray, dilation: int, *, causal: bool = True) -> np.ndarray:
    """Convolution, normalisation, ReLU; again with twice the dilation; input added."""
    y = np.maximum(0, normalised(convolve(x, first, dilation, causal=causal)))
    return np.maximum(0, normalised(convolve(y, second, 2 * dilation, causal=causal))) + x


def map_sequences(df: DataFrame, column: str, out: str, layer) -> DataFrame:
    """Apply ``layer`` ((n, t, c) array to (n, t', c') array) to a column of sequences, batch by batch; those of equal
    length in a batch go together. A null sequence gives null, one without steps no steps."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.ArrayType(T.DoubleType())))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lengths = np.array([-1 if s is None else len(s) for s in batch[column]], int)
            results: list = [None if n < 0 else [] for n in lengths]
            for n in np.unique(lengths[lengths > 0]):
                rows = np.flatnonzero(lengths == n)
                stacked = np.stack([np.stack([np.asarray(r, float) for r in batch[column].iloc[k]]) for k in rows])
                for k, y in zip(rows.tolist(), layer(stacked), strict=True):
                    results[k] = y.tolist()
            yield batch.assign(**{out: results})

    return df.mapInPandas(run, schema)
