"""Ranked recommendations: top lists and their hit rates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_items(scores: DataFrame, k: int) -> DataFrame:
    """(query_id, item_id, score, rank): the k best items of each query, ties to the smaller item. The limit is pushed
    below the shuffle, so a query's scores never meet in one task."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_products(queries: DataFrame, items: DataFrame, k: int, *, scale: float = 1e6, block: int = 4096, chunk: int = 16_384) -> DataFrame:
    """(query_id, item_id, score, rank): of each query of a stated set the k items of the largest inner product, in whole
    ``1/scale``, ties to the smaller item; an item of the query's own id doesn't count. Ids are integers; a null vector is
    none.

    Blocks of about ``block`` queries meet chunks of about ``chunk`` items, one task each, by a matrix product that is taken
    slice by slice. A task keeps the k best of each query, so it sends k rows a query, not one a pair; ``top_items``
    merges them. Items are shuffled once per block: one row for ``block`` products.
    """
    vector = F.transform("vector", lambda x: x.cast("double")).alias("vector")

    def parted(df: DataFrame, name: str, rows: int, part: str) -> tuple[DataFrame, int]:
        known = df.where(F.col("vector").isNotNull()).select(F.col(name).cast("bigint").alias(name), vector)
        parts = max(1, -(-known.count() // rows))
        return known.withColumn(part, F.pmod(F.xxhash64(name), F.lit(parts)).cast("int")), parts

    asked, n_blocks = parted(queries, "query_id", block, "block")
    held, n_chunks = parted(items, "item_id", chunk, "chunk")
    asked = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))))
    held = held.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def multiply(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, item = left.column("query_id").to_numpy(), right.column("item_id").to_numpy()
        best, who = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), np.int64)
        if len(ids) and len(item):
            vectors, against = matrix(left.column("vector")), matrix(right.column("vector"))
            for begin in range(0, len(item), 1024):
                part = item[begin : begin + 1024]
                score = np.floor(vectors @ against[begin : begin + 1024].T * scale + 0.5)
                score[ids[:, None] == part[None, :]] = -np.inf
                best, who = np.concatenate([best, score], axis=1), np.concatenate([who, np.broadcast_to(part, score.shape)], axis=1)
                order = np.lexsort((who, -best), axis=1)[:, :k]
                best, who = np.take_along_axis(best, order, 1), np.take_along_axis(who, order, 1)
        query, place = np.nonzero(best > -np.inf)
        return pa.table({"query_id": ids[query], "item_id": who[query, place], "score": best[query, place].astype(np.int64)})

    tops = asked.groupBy("block", "chunk").cogroup(held.groupBy("block", "chunk")).applyInArrow(multiply, "query_id bigint, item_id bigint, score bigint")
    return top_items(tops, k)


def hits(top: DataFrame, truth: DataFrame, ks: Sequence[int], click_reward: float) -> DataFrame:
    """(k, total_reward, hit_click, ndcg_click, hit_purchase, ndcg_purchase): sums over ``truth`` (query_id, item_id,
    reward) found among the first k of ``top`` (ranked at least to the largest k). A reward equal to ``click_reward``
    is a click, any other a purchase; a hit at rank r adds 1/log2(r + 1)."""
    found = truth.join(top.select("query_id", "item_id", "rank"), ["query_id", "item_id"])
    at = found.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).withColumn("hit", F.col("rank") <= F.col("k"))
    click, gain = F.col("reward") == click_reward, 1 / F.log2(F.col("rank") + 1)
    add = lambda condition, value: F.sum(F.when(F.col("hit") & condition, value).otherwise(0.0))
    rows = at.groupBy("k").agg(
        add(F.lit(True), F.col("reward")).alias("total_reward"), add(click, F.lit(1.0)).alias("hit_click"), add(click, gain).alias("ndcg_click"),
        add(~click, F.lit(1.0)).alias("hit_purchase"), add(~click, gain).alias("ndcg_purchase"),
    )
    every = truth.sparkSession.createDataFrame([(int(k),) for k in ks], "k int")
    return every.join(rows, "k", "left").na.fill(0.0)
