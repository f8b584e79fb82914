"""Distinct counting with relational state: HLL, ULL and Theta.

A sketch is rows (keys..., slot, value).  Building is one partial aggregation per slot, so a
task sends 2^p rows a group at most; merging is the same aggregation over a union, hence
associative, commutative and independent of partitioning.  Nulls are skipped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..compat import agreed, stamp
from ..errors import check
from ..functions.hashing import hash64, unsigned, unsigned_order


def union_all(states: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, states)


def _rank(h: Column, p: int) -> Column:
    rest = h.bitwiseAND(F.lit((1 << (64 - p)) - 1))
    return F.when(rest == 0, 64 - p + 1).otherwise(64 - p - F.length(F.bin(rest)) + 1)


def _bucket(h: Column, p: int) -> Column:
    return F.shiftrightunsigned(h, 64 - p).cast("int")


def _registers(df: DataFrame, col: str, by: Sequence[str], p: int, strategy: str, seed: int, value: str) -> DataFrame:
    hashed = df.where(F.col(col).isNotNull()).select(*by, hash64(col, strategy, seed).alias("_h"))
    slots = hashed.select(*by, _bucket(F.col("_h"), p).alias("bucket"), _rank(F.col("_h"), p).cast("int").alias("rank"))
    return slots.groupBy(*by, "bucket").agg(F.max("rank").alias("rank")).select(*by, "bucket", F.expr(value).cast("int").alias("value"))


# --- HLL ------------------------------------------------------------------------------------


def hll(df: DataFrame, col: str, by: Sequence[str] = (), p: int = 14, strategy: str = "md5_64", seed: int = 0) -> DataFrame:
    """(by..., bucket, value): the registers that aren't zero."""
    check(4 <= p <= 16, "p must be 4 to 16")
    return stamp(_registers(df, col, by, p, strategy, seed, "rank"), family="hll", p=p, hash=strategy, seed=seed)


def merge_registers(states: Sequence[DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """Register-wise maximum; also rolls one state up to fewer keys.  States of other p, hash or seed raise."""
    built = agreed(states)
    return stamp(union_all(states).groupBy(*by, "bucket").agg(F.max("value").alias("value")), **built)


def hll_alpha(m: int) -> float:
    return {16: 0.673, 32: 0.697, 64: 0.709}.get(m, 0.7213 / (1 + 1.079 / m))


def hll_estimate(state: DataFrame, by: Sequence[str] = (), p: int = 14) -> DataFrame:
    """(by..., estimate, n_registers)"""
    agreed([state], family="hll", p=p)
    m = 1 << p
    sums = state.groupBy(*by).agg(F.sum(F.pow(F.lit(2.0), -F.col("value"))).alias("_s"), F.count("*").alias("n_registers"))
    zeros = F.lit(m) - F.col("n_registers")
    raw = F.lit(hll_alpha(m) * m * m) / (F.coalesce("_s", F.lit(0.0)) + zeros)
    low = (raw <= 2.5 * m) & (zeros > 0)
    high = raw > float(1 << 56) / 30
    out = F.when(low, F.lit(float(m)) * F.log(F.lit(float(m)) / zeros)).when(high, -float(1 << 64) * F.log(1 - raw / float(1 << 64))).otherwise(raw)
    return sums.select(*by, out.alias("estimate"), "n_registers")


# --- ULL ------------------------------------------------------------------------------------


def ull(df: DataFrame, col: str, by: Sequence[str] = (), p: int = 14, strategy: str = "md5_64", seed: int = 0) -> DataFrame:
    """(by..., bucket, value): 2 rank - 1, or 2 rank where all bits after the bucket are zero."""
    check(4 <= p <= 26, "p must be 4 to 26")
    return stamp(_registers(df, col, by, p, strategy, seed, f"CASE WHEN rank = {64 - p + 1} THEN 2 * rank ELSE 2 * rank - 1 END"), family="ull", p=p, hash=strategy, seed=seed)


def sigma(x: float) -> float:
    if x <= 0:
        return 0.0
    if x >= 1:
        return math.inf
    z, y = x, 1.0
    while True:
        x *= x
        new = z + x * y
        y += y
        if new == z:
            return z
        z = new


def tau(x: float) -> float:
    if x <= 0 or x >= 1:
        return 0.0
    z, y = 1 - x, 1.0
    while True:
        x = math.sqrt(x)
        y *= 0.5
        new = z - (1 - x) ** 2 * y
        if new == z:
            return z / 3
        z = new


def ull_from_histogram(counts: dict[int, int], p: int) -> float:
    """The estimate from how many registers hold each value; registers that aren't counted are zero.

    A value 2 rank - 1 or 2 rank stands for a probability of 2^-rank, so the sum goes over ranks."""
    m, top = 1 << p, 64 - p + 1
    zeros = m - sum(counts.values())
    if zeros == m:
        return 0.0
    ranks = [0] * (top + 1)
    for value, n in counts.items():
        ranks[(value + 1) // 2] += n
    z = m * tau(1 - ranks[top] / m)
    for k in range(top - 1, 0, -1):
        z = (z + ranks[k]) * 0.5
    z += m * sigma(zeros / m)
    return m * m / (2 * math.log(2) * z) if z else 0.0


def ull_estimate(state: DataFrame, by: Sequence[str] = (), p: int = 14) -> DataFrame:
    """(by..., estimate): a histogram of at most 2 (65 - p) values a group, then a scalar iteration."""

    agreed([state], family="ull", p=p)

    @F.udf("double")
    def finish(pairs: list) -> float:
        return float(ull_from_histogram({r["value"]: r["n"] for r in pairs}, p))

    counts = state.groupBy(*by, "value").agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg(F.collect_list(F.struct("value", "n")).alias("_h")).select(*by, finish("_h").alias("estimate"))


# --- Theta ----------------------------------------------------------------------------------

FULL = -1  # 2^64 - 1 as a BIGINT


def theta(df: DataFrame, col: str, by: Sequence[str] = (), k: int = 4096, strategy: str = "md5_64", seed: int = 0) -> DataFrame:
    """(by..., hash, theta): the k smallest distinct hashes and the (k+1)-th as threshold, both unsigned bits."""
    check(16 <= k <= 1 << 26 and k & (k - 1) == 0, "k must be a power of two, 16 to 2^26")
    hashed = df.where(F.col(col).isNotNull()).select(*by, hash64(col, strategy, seed).alias("hash"))
    # every task sends its k + 1 smallest hashes a group, and after the exchange every partition keeps as many
    fold = _smallest(list(by), k + 1)
    few = hashed.mapInArrow(fold, hashed.schema).distinct().mapInArrow(fold, hashed.schema)
    return stamp(_trim(few.withColumn("theta", F.lit(FULL).cast("long")), by, k), family="theta", k=k, hash=strategy, seed=seed)


def _smallest(by: list[str], n: int, flush: int = 1 << 20):
    """The n smallest distinct hashes (unsigned) of each group of a task; hash is the last column."""

    def trim(rows: pa.Table) -> pa.Table:
        low = rows.column("hash").to_numpy() ^ np.int64(-(1 << 63))
        if not by:
            found = np.unique(low)[:n] ^ np.int64(-(1 << 63))
            return pa.table({"hash": found}, schema=rows.schema)
        group = rows.select(by).to_pandas().groupby(by, dropna=False, sort=False).ngroup().to_numpy()
        order = np.lexsort((low, group))
        group, low = group[order], low[order]
        new = np.r_[True, (group[1:] != group[:-1]) | (low[1:] != low[:-1])][: len(order)]
        order, group = order[new], group[new]
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]][: len(group)])
        place = np.arange(len(group)) - np.repeat(first, np.diff(np.r_[first, len(group)]))
        return rows.take(pa.array(order[place < n]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            count += batch.num_rows
            if count >= flush:
                held = [trim(pa.concat_tables(held))]
                # groups that alone fill the buffer go on as they are: there are more of them than a buffer holds
                if held[0].num_rows > flush // 2:
                    yield from held[0].to_batches()
                    held = []
                count = sum(t.num_rows for t in held)
        if held:
            yield from trim(pa.concat_tables(held)).to_batches()

    return run


def _trim(entries: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(unsigned_order(F.col("hash")))
    few = entries.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1)
    cut = few.groupBy(*by).agg(F.max(F.when(F.col("_n") == k + 1, F.struct(F.lit(1).alias("o"), F.col("hash").alias("h")))).alias("_c"), F.min(unsigned_order(F.col("theta"))).alias("_t"))
    cut = cut.select(*[F.col(b).alias(f"_k{i}") for i, b in enumerate(by)], F.coalesce("_c.h", unsigned_order(F.col("_t"))).alias("_theta"))
    kept = few.where(F.col("_n") <= k).drop("_n", "theta")
    return kept.join(F.broadcast(cut) if not by else cut, _same_keys(by)).select(*by, "hash", F.col("_theta").alias("theta"))


def theta_merge(states: Sequence[DataFrame], by: Sequence[str] = (), k: int = 4096) -> DataFrame:
    """Union: least theta, the hashes below it, trimmed to k.  States of another k, hash or seed raise."""
    built = agreed(states, family="theta", k=k)
    both = union_all(states)
    least = both.groupBy(*by).agg(F.min(unsigned_order(F.col("theta"))).alias("_t"))
    least = least.select(*[F.col(b).alias(f"_k{i}") for i, b in enumerate(by)], "_t")
    below = both.join(least if by else F.broadcast(least), _same_keys(by)).where(unsigned_order(F.col("hash")) < F.col("_t"))
    entries = below.groupBy(*by, "hash").agg(unsigned_order(F.min("_t")).alias("theta"))
    return stamp(_trim(entries, by, k), **built)


def theta_difference(a: DataFrame, b: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A without B: the hashes of a below both thetas that b hasn't; theta is the lesser one."""
    built = agreed([a, b], family="theta")
    theirs = b.groupBy(*by).agg(F.min(unsigned_order(F.col("theta"))).alias("_t")).select(*[F.col(x).alias(f"_k{i}") for i, x in enumerate(by)], "_t")
    least = F.least(unsigned_order(F.col("theta")), F.coalesce("_t", F.lit((1 << 63) - 1)))
    cut = a.join(theirs if by else F.broadcast(theirs), _same_keys(by), "left").withColumn("theta", unsigned_order(least))
    held = b.select(*[F.col(x).alias(f"_k{i}") for i, x in enumerate(by)], F.col("hash").alias("_h"))
    left = cut.drop("_t", *(f"_k{i}" for i in range(len(by)))).where(unsigned_order(F.col("hash")) < unsigned_order(F.col("theta")))
    return stamp(left.join(held, _same_keys(by) & (F.col("hash") == F.col("_h")), "left_anti").select(*by, "hash", "theta"), **built)


def _same_keys(by: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_k{i}")) for i, b in enumerate(by)], F.lit(True))


def theta_compact(state: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., theta, hashes): entries below theta in unsigned order."""
    below = state.where(unsigned_order(F.col("hash")) < unsigned_order(F.col("theta")))
    return below.groupBy(*by, "theta").agg(F.transform(F.array_sort(F.collect_list(unsigned_order(F.col("hash")))), unsigned_order).alias("hashes"))


def theta_estimate(state: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., estimate, n_entries)"""
    sums = state.groupBy(*by).agg(F.count("*").alias("n_entries"), F.max("theta").alias("_t"))
    out = F.when(F.col("_t") == FULL, F.col("n_entries").cast("double")).otherwise(F.col("n_entries") * F.lit(float(1 << 64)) / unsigned(F.col("_t")).cast("double"))
    return sums.select(*by, out.alias("estimate"), "n_entries")


def theta_overlap(state: DataFrame, by: str, k: int = 4096) -> DataFrame:
    """(a, b, union, intersection, jaccard) of each pair of groups, by inclusion and exclusion.

    Groups are cohorts, few by nature: the pairs are of groups, the work is on k entries each."""
    one = theta_estimate(state, [by]).select(F.col(by).alias("g"), F.col("estimate").alias("e"))
    names = one.select("g")
    pairs = names.select(F.col("g").alias("a")).join(names.select(F.col("g").alias("b")), F.col("a") < F.col("b"))
    both = pairs.join(state, (F.col(by) == F.col("a")) | (F.col(by) == F.col("b"))).select("a", "b", "hash", "theta")
    joint = theta_estimate(theta_merge([both], ["a", "b"], k), ["a", "b"]).select("a", "b", F.col("estimate").alias("union_estimate"))
    out = joint.join(one.select(F.col("g").alias("a"), F.col("e").alias("ea")), "a").join(one.select(F.col("g").alias("b"), F.col("e").alias("eb")), "b")
    inter = F.greatest(F.lit(0.0), F.col("ea") + F.col("eb") - F.col("union_estimate"))
    return out.select("a", "b", "union_estimate", inter.alias("intersection_estimate"), (inter / F.col("union_estimate")).alias("jaccard"))
