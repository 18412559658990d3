"""Path-planning episodes: rewards, observations and roll-outs."""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymill.operators.spread import salted


@dataclass(frozen=True)
class Rewards:
    """Constants of the reward; the defaults are the defined ones."""

    distance: float = 10.0
    step: float = 0.1
    revisit: float = 100.0
    edge_revisit: float = 0.0  # 50 in the strict reading; as defined, a repeated edge costs nothing
    goal: float = 1000.0
    dead_end: float = -50.0
    late: float = 0.1
    max_steps: int = 200


def step_rewards(moves: DataFrame, rewards: Rewards = Rewards()) -> DataFrame:  # noqa: B008
    """(episode_id, step, x, y, reward, done, truncated, outcome) for moves (episode_id, step from 1, x, y after the
    move, sx, sy start, tx, ty target).

    A move earns the distance it comes nearer, less the step's cost, less the penalty if the node was moved to before
    (the start doesn't count), plus the goal's reward, or less a share of the distance left when steps run out. Moves
    after the end of an episode are left out.
    """
    order = Window.partitionBy("episode_id").orderBy("step")
    left = F.hypot(F.col("tx") - F.col("x"), F.col("ty") - F.col("y"))
    rows = moves.withColumn("d", left)
    rows = rows.withColumn("before", F.coalesce(F.lag("d").over(order), F.hypot(F.col("tx") - F.col("sx"), F.col("ty") - F.col("sy"))))
    rows = rows.withColumn("px", F.coalesce(F.lag("x").over(order), F.col("sx"))).withColumn("py", F.coalesce(F.lag("y").over(order), F.col("sy")))
    rows = rows.withColumn("visit", F.row_number().over(Window.partitionBy("episode_id", "x", "y").orderBy("step")))
    rows = rows.withColumn("passage", F.row_number().over(Window.partitionBy("episode_id", "px", "py", "x", "y").orderBy("step")))
    goal, late = (F.col("x") == F.col("tx")) & (F.col("y") == F.col("ty")), F.col("step") >= rewards.max_steps
    zero = F.lit(0.0)
    reward = (F.col("before") - F.col("d")) * rewards.distance - rewards.step
    reward = reward - F.when(F.col("visit") > 1, F.lit(rewards.revisit)).otherwise(zero) - F.when(F.col("passage") > 1, F.lit(rewards.edge_revisit)).otherwise(zero)
    reward = reward + F.when(goal, F.lit(rewards.goal)).when(late, -rewards.late * F.col("d")).otherwise(zero)
    rows = rows.withColumn("reward", reward).withColumn("done", goal | late).withColumn("truncated", ~goal & late)
    rows = rows.withColumn("ended", F.coalesce(F.max(F.col("done").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    outcome = F.when(goal, "success").when(late, "timeout")
    return rows.where(F.col("ended") == 0).select("episode_id", "step", "x", "y", "reward", "done", "truncated", outcome.alias("outcome"))


def episode_summary(steps: DataFrame) -> DataFrame:
    """(episode_id, n_steps, total_reward, outcome); outcome is null for an episode that never ended."""
    return steps.groupBy("episode_id").agg(F.count(F.lit(1)).alias("n_steps"), F.sum("reward").alias("total_reward"), F.max_by("outcome", "step").alias("outcome"))


def observations(moves: DataFrame, max_steps: int = 200) -> DataFrame:
    """(episode_id, step, observation): [x, y, way to the target in x and y, share of steps used]."""
    progress = F.lit(0.0) if not max_steps else F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("step") / float(max_steps)))
    return moves.select("episode_id", "step", F.array("x", "y", F.col("tx") - F.col("x"), F.col("ty") - F.col("y"), progress).alias("observation"))


ROLLOUT = "episode_id string, step int, x double, y double, reward double, done boolean, truncated boolean, outcome string"


def rollout(episodes: DataFrame, arcs: DataFrame, *, within: str = "map_id", rewards: Rewards = Rewards(), episodes_per_task: int = 4096) -> DataFrame:  # noqa: B008
    """(episode_id, step, x, y, reward, done, truncated, outcome) of episodes (episode_id, ``within``, start, target,
    actions array<int>) on a map's arcs (``within``, src, dst; packed nodes in centimetres).

    An action is clipped to the successors of the current node other than itself, in their order; without any the episode
    fails. Each next state depends on the one before, so an episode is played in one place; the episodes of a map are
    spread over tasks of ``episodes_per_task``, and each copy of the map's arcs serves that many.
    """
    ways = arcs.select(F.col(within).alias("area"), "src", "dst").distinct()
    games = episodes.select(F.col("episode_id").cast("string").alias("episode_id"), F.col(within).alias("area"), "start", "target", "actions")
    games, ways = salted(games, ways, ["area"], "episode_id", episodes_per_task)

    def place(node: int) -> tuple[float, float]:
        y = ((node & 0xFFFFFFFF) ^ 0x80000000) - 0x80000000
        return ((node - y) >> 32) / 100, y / 100

    def play(_key, links: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        successors: dict[int, list[int]] = {}
        for src, dst in sorted(zip(links["src"].tolist(), links["dst"].tolist(), strict=True)):
            if src != dst:
                successors.setdefault(src, []).append(dst)
        rows = []
        for episode, start, target, actions in zip(group["episode_id"], group["start"].tolist(), group["target"].tolist(), group["actions"], strict=True):
            node, visits, passages = start, {}, {}
            tx, ty = place(target)
            for step, action in enumerate(actions, 1):
                options = successors.get(node, [])
                x, y = place(node)
                if not options:
                    rows.append((episode, step, x, y, rewards.dead_end, True, True, "failure"))
                    break
                before = math.hypot(tx - x, ty - y)
                following = options[min(max(int(action), 0), len(options) - 1)]
                passages[node, following] = passages.get((node, following), 0) + 1
                again = passages[node, following] > 1
                node = following
                visits[node] = visits.get(node, 0) + 1
                x, y = place(node)
                left = math.hypot(tx - x, ty - y)
                reward = (before - left) * rewards.distance - rewards.step - (rewards.revisit if visits[node] > 1 else 0) - (rewards.edge_revisit if again else 0)
                goal, late = node == target, step >= rewards.max_steps
                reward += rewards.goal if goal else -rewards.late * left if late else 0
                rows.append((episode, step, x, y, reward, goal or late, late and not goal, "success" if goal else "timeout" if late else None))
                if goal or late:
                    break
        return pd.DataFrame(rows, columns=["episode_id", "step", "x", "y", "reward", "done", "truncated", "outcome"])

    return ways.groupBy("area", "task").cogroup(games.groupBy("area", "task")).applyInPandas(play, ROLLOUT)


def visited_line(steps: DataFrame) -> DataFrame:
    """(episode_id, wkt): the visited places in order as one line."""
    places = F.transform(F.array_sort(F.collect_list(F.struct("step", "x", "y"))), lambda p: F.concat_ws(" ", p.x.cast("string"), p.y.cast("string")))
    return steps.groupBy("episode_id").agg(F.concat(F.lit("LINESTRING ("), F.array_join(places, ", "), F.lit(")")).alias("wkt"))
