"""Filling fixed-capacity containers: vector best fit under token, item-count and attention-cost capacities.

Items are cut only if they exceed the token capacity. They are dealt into shards that each hold a like
share of every size (so each packs as well as the whole would), and a shard is packed largest first: of all
open containers with room under every capacity, the one whose residual vector fits the item best (by the
norm of what would remain, or by weighted dot product) takes it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items that one packing task handles; a shard's rows are four integers each.
SHARD_ITEMS = 20_000
#: Items a container may hold, of those that fill it on average; attention cost, of one that fills it.
ITEMS, COST = 5.0, 0.9


def cut_to_capacity(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(item, part, part_start, part_size): whole items, and parts of those over ``capacity``.

    Parts are ``capacity`` long but for the last. Items of null, zero or negative size take no room and
    are left out.
    """
    n = F.col(size).cast("long")
    parts = F.ceil(n / capacity).cast("int")
    return (
        items.where(n > 0)
        .select(F.col(key).alias("item"), n.alias("n"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        .select("item", "part", (F.col("part") * F.lit(capacity).cast("long")).alias("part_start"), F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("part") * F.lit(capacity).cast("long")).alias("part_size"))
    )


def best_fit(sizes: list[int], capacity: int, max_items: int, max_cost: float, weights: tuple[float, float, float] = (1.0, 0.05, 0.05), rule: str = "norm") -> list[int]:
    """Container number of each size; ``sizes`` in descending order.

    A container holds at most ``capacity`` tokens, ``max_items`` items and ``max_cost`` attention cost (the
    sum of squared sizes); one item alone may cost more, for it has to go somewhere. Every open container that
    has room under all three is weighed for every item: by the weighted norm of the residual vector it would
    be left with (``norm``), or by the weighted product of its residual vector and the item's demands (``dot``,
    the greatest wins); of equal ones the tightest in tokens, then the oldest.
    """
    top = np.array([capacity, max_items, max_cost], np.float64)
    w = np.array(weights, np.float64)
    left, number = np.empty((max(1, len(sizes)), 3)), np.empty(max(1, len(sizes)), np.int64)
    opened = made = 0
    least = sizes[-1] if sizes else 0
    placed = []
    for n in sizes:
        need = np.array([n, 1.0, float(n) * n]) / top
        room = left[:opened]
        fits = np.flatnonzero((room >= need - 1e-12).all(axis=1))
        if len(fits):
            rest = room[fits]
            score = ((rest - need) ** 2) @ w if rule == "norm" else -(rest * need) @ w
            ties = fits[score <= score.min() + 1e-12]
            at = ties[np.lexsort((number[ties], left[ties, 0]))[0]]
        else:
            at, opened = opened, opened + 1
            left[at], number[at], made = 1.0, made, made + 1
        left[at] -= need
        placed.append(int(number[at]))
        # A container that not even the smallest item fits in is closed; the last one takes its place.
        if (left[at] < np.array([least / capacity, 1 / max_items, float(least) * least / max_cost]) - 1e-12).any():
            opened -= 1
            left[at], number[at] = left[opened], number[opened]
    return placed


def pack(parts: DataFrame, capacity: int, max_items: int | None = None, max_cost: float | None = None, rule: str = "norm", shards: int = 1) -> DataFrame:
    """(item, part, part_start, part_size, container) with a container number unique over all shards.

    Without ``max_items`` or ``max_cost`` that capacity is as large as the tokens allow. ``shards`` must be at
    least the number of parts over ``SHARD_ITEMS``. No parts give no containers.
    """
    most, dearest = max_items or capacity, max_cost or float(capacity) * capacity
    dealt = parts.withColumn("shard", F.pmod(F.xxhash64("item", "part"), F.lit(shards)).cast("int"))
    kind = dict(parts.dtypes)["item"]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["part_size", "item", "part"], ascending=[False, True, True], kind="stable")
        placed = best_fit(rows["part_size"].tolist(), capacity, most, dearest, rule=rule)
        rows["container"] = [f"{key[0]:06d}-{b:08d}" for b in placed]
        return rows[["item", "part", "part_start", "part_size", "container"]]

    return dealt.groupBy("shard").applyInPandas(run, f"item {kind}, part int, part_start long, part_size long, container string")


def limits_for(capacity: int, parts: int, tokens: int) -> tuple[int, float]:
    """(items, attention cost) that a container of ``capacity`` may hold, for so many parts and tokens: ITEMS times
    the parts that fill it on average, and COST of what one part that fills it costs."""
    return max(1, math.ceil(ITEMS * capacity * max(1, parts) / max(1, tokens))), COST * float(capacity) * capacity


def shards_for(count: int) -> int:
    """Shards so that each holds about ``SHARD_ITEMS`` parts."""
    return max(1, math.ceil(count / SHARD_ITEMS))


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """Containers, tokens, fill, and the most items and the most attention cost (of the capacity squared) in one."""
    size = F.col("part_size").cast("double")
    per = packed.groupBy("container").agg(F.sum("part_size").alias("tokens"), F.count("*").alias("items"), F.sum(size * size).alias("cost"))
    return per.agg(
        F.count("*").alias("containers"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.max("items").alias("most_items"), F.max(F.when(F.col("items") > 1, F.col("cost") / float(capacity * capacity))).alias("most_shared_cost"),
        F.coalesce(F.try_divide(F.sum("tokens").cast("double"), F.count("*") * F.lit(capacity)), F.lit(0.0)).alias("fill"),
    )
