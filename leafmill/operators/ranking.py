"""Orders, quotas, deduplication and pages of results."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F


def tier_order(mode: str = "all", ordinal: str = "ord") -> list[Column]:
    """O1 for 'exact' and 'all_words', O2 for 'all' and 'semantic', O3 'l2', O4 'legacy', O5 'score_first'; ties by ordinal."""
    orders = {
        "exact": [F.asc("category_priority"), F.desc("priority"), F.asc("distance")],
        "all_words": [F.asc("category_priority"), F.desc("priority"), F.asc("distance")],
        "all": [F.asc("category_priority"), F.desc("priority"), F.desc("distance")],
        "semantic": [F.asc("category_priority"), F.desc("priority"), F.desc("distance")],
        "l2": [F.asc("category_priority"), F.desc("priority"), F.asc("distance")],
        "legacy": [F.asc("priority"), F.asc("distance")],
        "score_first": [F.desc("distance"), F.asc("priority")],
    }
    return [*orders[mode], F.asc(ordinal)]


def top_k(results: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """Sorted and cut in one operator."""
    if k < 1:
        raise ValueError("top_k must be at least 1")
    return results.orderBy(*order).limit(k)


def quota_fill(tiers: list[DataFrame], k: int, order: list[Column]) -> DataFrame:
    """Each tier in its order takes what the tiers before it left."""
    parts = [t.withColumn("__tier", F.lit(i)) for i, t in enumerate(tiers)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.orderBy("__tier", *order).limit(k).drop("__tier")


def quota_stop(tier: DataFrame, k: int, taken: int, order: list[Column]) -> DataFrame:
    """What is left of the quota, but at least one row."""
    return tier.orderBy(*order).limit(max(k - taken, 1))


def keep_first(results: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """A12, SO3: the first row of every key."""
    place = Window.partitionBy(key).orderBy(*order)
    return results.withColumn("__place", F.row_number().over(place)).filter("__place = 1").drop("__place")


def page(results: DataFrame, number: int, size: int, order: list[Column]) -> DataFrame:
    """A page of ordered results, counted from 1."""
    if number < 1 or size < 1:
        raise ValueError("page number and size must be at least 1")
    return results.orderBy(*order).offset((number - 1) * size).limit(size)


def page_count(n: int, size: int) -> int:
    """O10."""
    return math.ceil(n / size)


def pager_window(current: int, total: int, width: int = 5) -> list[int]:
    """Page numbers around the current one, moved at the edges."""
    if total <= width:
        return list(range(1, total + 1))
    start = min(max(1, current - width // 2), total - width + 1)
    return list(range(start, start + width))
