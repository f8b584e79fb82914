"""Whole questions that are asked of sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cardinality as card
from ..operators import membership as mem
from ..operators import quantile as quant


def users_and_values(events: DataFrame) -> DataFrame:
    """Distinct users and the median and 99th percentile of value per event type."""
    users = card.hll_estimate(card.hll(events, "user_id", ["event_type"]), ["event_type"]).select("event_type", F.round("estimate", 6).alias("users"))
    values = quant.ddsketch_quantiles(quant.ddsketch(events, "value", ["event_type"]), [0.5, 0.99], ["event_type"])
    wide = values.groupBy("event_type").agg(*(F.round(F.max(F.when(F.col("rank") == r, F.col("value"))), 6).alias(n) for r, n in ((0.5, "p50"), (0.99, "p99"))))
    return users.join(wide, "event_type")


def bloom_semijoin(left: DataFrame, left_key: str, right: DataFrame, right_key: str, capacity: int) -> DataFrame:
    """left's rows with a partner in right: a Bloom filter of right thins left's keys before the exact join."""
    state = mem.bloom(right, right_key, capacity=capacity)
    maybe = mem.bloom_member(state, left, left_key, capacity=capacity).where("member").select(left_key)
    return left.join(maybe, left_key, "left_semi").join(right.select(F.col(right_key).alias("_r")), F.col(left_key) == F.col("_r"), "left_semi")


def seen_before(items: DataFrame, col: str, seen: DataFrame, capacity: int) -> DataFrame:
    """(col, member): which items a Bloom filter of seen reports; a false positive is a new item reported as seen."""
    return mem.bloom_member(mem.bloom(seen, col, capacity=capacity), items, col, capacity=capacity)
