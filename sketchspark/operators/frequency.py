"""Frequencies and heavy hitters: Count-Min, SpaceSaving (frequent items) and Misra-Gries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..compat import agreed, stamp
from ..errors import check
from ..functions.hashing import GOLDEN, MASK, hash64
from .cardinality import union_all

# --- Count-Min --------------------------------------------------------------------------------


def _cell(h: Column, row: Column, depth: int, width: int, independent: bool) -> Column:
    """Column of the cell in a row: (h + row * golden) mod 2^64 mod width, or of a hash of its own.

    The sum is taken in two halves of 32 bits, so plain longs hold every step."""
    if independent:
        return F.pmod(F.xxhash64(h, row), F.lit(width)).cast("int")
    half, steps = F.lit(MASK >> 32), [GOLDEN * r & MASK for r in range(depth)]
    low = h.bitwiseAND(half) + F.get(F.array(*(F.lit(x & MASK >> 32) for x in steps)), row)
    high = (F.shiftrightunsigned(h, 32) + F.get(F.array(*(F.lit(x >> 32) for x in steps)), row) + F.shiftrightunsigned(low, 32)).bitwiseAND(half)
    return ((high % width * F.lit((1 << 32) % width) + low.bitwiseAND(half)) % width).cast("int")


def _cells(df: DataFrame, col: str, by: Sequence[str], width: int, depth: int, strategy: str, independent: bool, extra: Sequence[Column] = ()) -> DataFrame:
    hashed = df.select(*by, *extra, hash64(col, strategy).alias("_h"))
    rows = hashed.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))))
    return rows.withColumn("slot", _cell(F.col("_h"), F.col("row"), depth, width, independent)).drop("_h")


def cms(df: DataFrame, col: str, by: Sequence[str] = (), width: int = 2048, depth: int = 5, weight: str | None = None, counter_bits: int = 32, strategy: str = "md5_64", independent: bool = False) -> DataFrame:
    """(by..., row, slot, count): counters that aren't zero, saturating.

    One partial aggregation on the counters: a task sends width * depth rows a group at most."""
    check(0 < width < 1 << 31 and depth > 0 and counter_bits in (32, 64), "width and depth must be positive, counter_bits 32 or 64")
    most = (1 << 32) - 1 if counter_bits == 32 else (1 << 63) - 1
    weighted = df.where(F.col(col).isNotNull()).withColumn("_w", F.col(weight).cast("long") if weight else F.lit(1).cast("long"))
    cells = _cells(weighted, col, by, width, depth, strategy, independent, [F.col("_w")])
    out = cells.groupBy(*by, "row", "slot").agg(F.least(F.sum("_w"), F.lit(most)).cast("long").alias("count"))
    return stamp(out, family="cms", width=width, depth=depth, hash=strategy, independent=independent)


def cms_merge(states: Sequence[DataFrame], by: Sequence[str] = (), counter_bits: int = 32) -> DataFrame:
    most = (1 << 32) - 1 if counter_bits == 32 else (1 << 63) - 1
    built = agreed(states, family="cms")
    return stamp(union_all(states).groupBy(*by, "row", "slot").agg(F.least(F.sum("count"), F.lit(most)).cast("long").alias("count")), **built)


def cms_estimate(state: DataFrame, probes: DataFrame, col: str, by: Sequence[str] = (), width: int = 2048, depth: int = 5, strategy: str = "md5_64", independent: bool = False) -> DataFrame:
    """(by..., col, estimate) for each distinct probe: the least of its counters; state has width * depth rows a group at most."""
    agreed([state], family="cms", width=width, depth=depth, hash=strategy, independent=independent)
    items = probes.select(*by, col).distinct()
    cells = _cells(items, col, by, width, depth, strategy, independent, [F.col(col)])
    return cells.join(state, [*by, "row", "slot"], "left").groupBy(*by, col).agg(F.min(F.coalesce("count", F.lit(0))).alias("estimate"))


# --- SpaceSaving ------------------------------------------------------------------------------


def space_saving(counts: list[tuple[bytes, int]], k: int) -> list[tuple[bytes, int, int]]:
    """(item, count, error) after pre-counted items, in the order of their bytes."""
    held: dict[bytes, list[int]] = {}
    for item, w in sorted(counts):
        if item in held:
            held[item][0] += w
        elif len(held) < k:
            held[item] = [w, 0]
        else:
            victim = min(held, key=lambda i: (held[i][0], i))
            least = held.pop(victim)[0]
            held[item] = [least + w, least]
    return [(i, c, e) for i, (c, e) in sorted(held.items())]


def frequent_items(df: DataFrame, col: str, by: Sequence[str] = (), k: int = 10, exact_limit: int = 1 << 16) -> DataFrame:
    """(by..., item, count, error).

    Items are counted exactly first, with map-side combining.  Each group's ``exact_limit``
    largest counts and the rest by hash parts are folded to k counters in parallel, and the
    parts are merged, so a group's distinct items never meet in one task."""
    check(k >= 1, "k must be positive")
    counted = df.where(F.col(col).isNotNull()).groupBy(*by, F.col(col).cast("string").alias("item")).agg(F.count("*").alias("count"))
    sizes = counted.groupBy(*by).agg(F.ceil(F.count("*") / exact_limit).cast("int").alias("_parts"))
    dealt = (counted.join(sizes, list(by)) if by else counted.crossJoin(F.broadcast(sizes))).withColumn("_part", F.pmod(F.xxhash64("item"), F.col("_parts")).cast("int"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = space_saving([(i.encode(), int(c)) for i, c in zip(pdf["item"], pdf["count"], strict=True)], k)
        out = pd.DataFrame([(i.decode(), c, e) for i, c, e in rows], columns=["item", "count", "error"])
        for b in reversed(by):
            out.insert(0, b, [pdf[b].iloc[0]] * len(out))
        return out

    schema = ", ".join([*(f"`{b}` {df.schema[b].dataType.simpleString()}" for b in by), "item string, count long, error long"])
    parts = dealt.groupBy(*by, "_part").applyInPandas(fold, schema)
    return frequent_merge([parts], by, k)


def frequent_merge(states: Sequence[DataFrame], by: Sequence[str] = (), k: int = 10) -> DataFrame:
    """Counts and errors add up; the k largest stay (ties by item).  States of another k raise."""
    built = agreed(states, family="frequent_items", k=k)
    total = union_all(states).groupBy(*by, "item").agg(F.sum("count").alias("count"), F.sum("error").alias("error"))
    return stamp(top_k(total, by, k), **built)


def top_k(state: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("count"), F.asc("item"))
    return state.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")


def frequent_bounds(state: DataFrame) -> DataFrame:
    """state with lower and upper bounds of each count."""
    return state.withColumn("lower", F.greatest(F.col("count") - F.col("error"), F.lit(0))).withColumn("upper", F.col("count"))


def frequent_estimate(state: DataFrame, probes: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., col, tracked, estimate, error, lower, upper) of each distinct probe; an item that isn't tracked has nulls."""
    asked = probes.select(*by, F.col(col).cast("string").alias("item")).where("item is not null").distinct()
    found = frequent_bounds(state).select(*by, "item", F.col("count").alias("estimate"), "error", "lower", "upper", F.lit(True).alias("tracked"))
    return asked.join(found, [*by, "item"], "left").select(*by, F.col("item").alias(col), F.coalesce("tracked", F.lit(False)).alias("tracked"), "estimate", "error", "lower", "upper")


def counted(state: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, entries): the sum of the counters and their number, for SpaceSaving and Misra-Gries states."""
    return state.groupBy(*by).agg(F.sum("count").alias("n"), F.count("*").alias("entries"))


def frequent_above(state: DataFrame, threshold: int) -> DataFrame:
    return frequent_bounds(state).where(F.col("lower") >= threshold)


# --- Misra-Gries ------------------------------------------------------------------------------


def misra_gries_fold(items: Iterator[str], k: int) -> dict[str, int]:
    """Counters after the items in the given order."""
    held: dict[str, int] = {}
    for item in items:
        if item in held:
            held[item] += 1
        elif len(held) < k:
            held[item] = 1
        else:
            held = {i: c - 1 for i, c in held.items() if c > 1}
    return held


def misra_gries(df: DataFrame, col: str, by: Sequence[str] = (), k: int = 10) -> DataFrame:
    """(by..., item, count): lower bounds that miss at most n / (k + 1).

    Exact counts are one mergeable summary; the merge rule reduces it to k counters: the
    (k+1)-th largest count is subtracted.  So the state doesn't depend on any order."""
    check(k >= 1, "k must be positive")
    counted = df.where(F.col(col).isNotNull()).groupBy(*by, F.col(col).cast("string").alias("item")).agg(F.count("*").alias("count"))
    return misra_gries_merge([counted], by, k)


def misra_gries_estimate(state: DataFrame, probes: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., col, estimate) of each distinct probe: its counter, or 0."""
    asked = probes.select(*by, F.col(col).cast("string").alias("item")).where("item is not null").distinct()
    return asked.join(state, [*by, "item"], "left").select(*by, F.col("item").alias(col), F.coalesce("count", F.lit(0)).cast("long").alias("estimate"))


def misra_gries_frequent(state: DataFrame, threshold: int) -> DataFrame:
    """Items whose counter, a lower bound, reaches the threshold."""
    return state.where(F.col("count") >= threshold)


def misra_gries_merge(states: Sequence[DataFrame], by: Sequence[str] = (), k: int = 10) -> DataFrame:
    """Counts add up; beyond k, the (k+1)-th largest is subtracted from all and the positive ones stay.  States of another k raise."""
    built = agreed(states, family="misra_gries", k=k)
    total = union_all(states).groupBy(*by, "item").agg(F.sum("count").alias("count"))
    order = Window.partitionBy(*by).orderBy(F.desc("count"), F.asc("item"))
    few = total.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1)
    cut = F.coalesce(F.max(F.when(F.col("_n") == k + 1, F.col("count"))).over(Window.partitionBy(*by)), F.lit(0))
    return stamp(few.withColumn("count", F.col("count") - cut).where("count > 0").drop("_n"), **built)
