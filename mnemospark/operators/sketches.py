"""Daily sketches of activity, kept and merged for any range of days instead of counting its events again.

A sketch of distinct values (HyperLogLog) or of quantiles (KLL) has a size of its own, whatever it has seen, and two of
them merge into that of both. So a day is read once, and a year is the merge of 365 small rows a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: log2 of the buckets of a distinct count: its relative standard error is 1.04 / 2 ** (LOG_BUCKETS / 2), 1.6 %.
LOG_BUCKETS = 12
#: Size of a quantile sketch: a rank is off by 1.33 % at most, 99 times of 100.
QUANTILE_K = 200


def daily_sketches(events: DataFrame, keys: Sequence[str], distinct: str, value: str, at: str = "occurred_at") -> DataFrame:
    """(day, keys, events, total, distinct_sketch, quantile_sketch) of events: how many, the sum of ``value``, and sketches of the
    different values of ``distinct`` and of the spread of ``value``. Tasks sketch before they shuffle; nulls are in no sketch."""
    seen = F.col(distinct).cast("string")
    number = F.col(value).cast("double")
    return events.groupBy(F.to_date(at).alias("day"), *keys).agg(
        F.count("*").alias("events"),
        F.coalesce(F.sum(value), F.lit(0)).alias("total"),
        F.hll_sketch_agg(seen, F.lit(LOG_BUCKETS)).alias("distinct_sketch"),
        F.kll_sketch_agg_double(number, F.lit(QUANTILE_K)).alias("quantile_sketch"),
    )


def over_range(daily: DataFrame, keys: Sequence[str], low: Column | None = None, high: Column | None = None, quantiles: Sequence[float] = (0.5, 0.95)) -> DataFrame:
    """(keys, events, total, distinct, quantiles) over the days from ``low`` to before ``high`` (null or absent: open), by merging daily sketches."""
    held = daily
    if low is not None:
        held = held.where(F.col("day") >= low)
    if high is not None:
        held = held.where(F.col("day") < high)
    merged = held.groupBy(*keys).agg(F.sum("events").alias("events"), F.sum("total").alias("total"), F.hll_union_agg("distinct_sketch").alias("__d"), F.kll_merge_agg_double("quantile_sketch").alias("__q"))
    at = [F.when(F.kll_sketch_get_n_double("__q") > 0, F.kll_sketch_get_quantile_double("__q", F.lit(float(q)))) for q in quantiles]
    return merged.select(*keys, "events", "total", F.hll_sketch_estimate("__d").alias("distinct"), F.array(*at).alias("quantiles"))


def daily_members(events: DataFrame, keys: Sequence[str], distinct: str, at: str = "occurred_at") -> DataFrame:
    """(day, keys, value): each value of ``distinct`` once a day, nulls left out, where its number over a range must be exact."""
    return events.where(F.col(distinct).isNotNull()).select(F.to_date(at).alias("day"), *keys, F.col(distinct).alias("value")).distinct()


def members_over_range(daily: DataFrame, keys: Sequence[str], low: Column | None = None, high: Column | None = None) -> DataFrame:
    """(keys, distinct): how many values the days from ``low`` to before ``high`` (null or absent: open) have, exactly."""
    held = daily
    if low is not None:
        held = held.where(F.col("day") >= low)
    if high is not None:
        held = held.where(F.col("day") < high)
    return held.select(*keys, "value").distinct().groupBy(*keys).agg(F.count("*").alias("distinct"))
