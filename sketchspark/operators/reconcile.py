"""Set reconciliation: invertible Bloom lookup tables as rows of cells."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..compat import agreed, stamp
from ..errors import check
from ..functions.hashing import GOLDEN, MASK, hash64, signed, splitmix64, splitmix64_np
from .cardinality import union_all


def check_hash(key: int) -> int:
    return splitmix64(key * 0x517CC1B727220A95 & MASK) >> 32


def positions(key: int, cells: int, hashes: int, seed: int = 0) -> list[int]:
    """Distinct cells of a key."""
    out: list[int] = []
    for i in range(hashes):
        h = splitmix64(key + (seed + i) * GOLDEN & MASK)
        at, attempt = h % cells, 1
        while at in out and attempt <= cells:
            h = splitmix64(h + attempt & MASK)
            at, attempt = h % cells, attempt + 1
        if at in out:
            at = next(p for p in range(cells) if p not in out)
        out.append(at)
    return out


def _places(cells: int, hashes: int, seed: int) -> Callable[[str], Column]:
    """The cells of key hashes, a batch at once; keys whose cells clash one by one."""

    @F.pandas_udf("array<int>")
    def places(h: pd.Series) -> pd.Series:
        keys = h.to_numpy().view(np.uint64)
        base = np.stack([splitmix64_np(keys + np.uint64((seed + i) * GOLDEN & MASK)) % np.uint64(cells) for i in range(hashes)], 1).astype(np.int64)
        ordered = np.sort(base, 1)
        clash = (ordered[:, 1:] == ordered[:, :-1]).any(1)
        out = base.tolist()
        for i in np.flatnonzero(clash):
            out[i] = positions(int(keys[i]), cells, hashes, seed)
        return pd.Series(out)

    return places


def iblt(df: DataFrame, key: str, value: str | None = None, cells: int = 1000, hashes: int = 3, seed: int = 0, strategy: str = "md5_64", sign: int = 1, shards: int = 1) -> DataFrame:
    """(cell, count, key_sum, value_sum, check_sum): sums of signs, xors of key and value hashes and of checks.

    ``shards`` tables of ``cells`` cells each, one after another, to which keys are dealt by their hash."""
    check(1 <= cells <= 1 << 24 and 1 <= hashes <= 10, "cells must be 1 to 2^24, hashes 1 to 10")
    check(1 <= shards and shards * cells < 1 << 31, "there are less than 2^31 cells in all shards")

    @F.pandas_udf("long")
    def checks(h: pd.Series) -> pd.Series:
        return pd.Series((splitmix64_np(h.to_numpy().view(np.uint64) * np.uint64(0x517CC1B727220A95)) >> np.uint64(32)).astype(np.int64))

    rows = df.where(F.col(key).isNotNull()).select(hash64(key, strategy).alias("k"), (hash64(value, strategy) if value else F.lit(0).cast("long")).alias("v"))
    spread = rows.select("k", "v", checks("k").alias("c"), F.explode(_places(cells, hashes, seed)("k")).alias("cell"))
    if shards > 1:
        spread = spread.withColumn("cell", (F.pmod(F.xxhash64("k"), F.lit(shards)) * cells + F.col("cell")).cast("int"))
    table = spread.groupBy("cell").agg((F.count("*") * sign).alias("count"), F.bit_xor("k").alias("key_sum"), F.bit_xor("v").alias("value_sum"), F.bit_xor("c").alias("check_sum"))
    return stamp(table, family="iblt", cells=cells, hashes=hashes, seed=seed, hash=strategy, shards=shards)


def iblt_member(state: DataFrame, probes: DataFrame, col: str, cells: int = 1000, hashes: int = 3, seed: int = 0, strategy: str = "md5_64") -> DataFrame:
    """(col, member) of each distinct probe: none of its cells is empty."""
    asked = probes.select(col).where(F.col(col).isNotNull()).distinct().select(col, hash64(col, strategy).alias("_h"))
    spread = asked.select(col, F.explode(_places(cells, hashes, seed)("_h")).alias("cell"))
    return spread.join(state.select("cell", "count"), "cell", "left").groupBy(col).agg(F.min(F.coalesce("count", F.lit(0)) != 0).alias("member"))


def iblt_merge(states: Sequence[DataFrame]) -> DataFrame:
    """Cells add up.  Tables of another size, seed or hash raise."""
    built = agreed(states, family="iblt")
    return stamp(union_all(states).groupBy("cell").agg(F.sum("count").alias("count"), *(F.bit_xor(c).alias(c) for c in ("key_sum", "value_sum", "check_sum"))), **built)


def iblt_subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return iblt_merge([a, b.withColumn("count", -F.col("count"))])


def iblt_difference(a: DataFrame, b: DataFrame, key: str, value: str | None = None, cells: int = 1000, hashes: int = 3, seed: int = 0, strategy: str = "md5_64") -> DataFrame:
    """(side, key_hash, value_hash) of the keys that only one of a and b has, side 1 or -1, however many they are.

    The difference starts as one table.  Empty cells tell how many keys it holds; while they are too many
    to decode, it is built again in as many shards as hold them at a load of 0.6 keys a cell.  Keys that
    can't be decoded at any load (more than one of a key on a side) leave a row with side 0 in their shard."""
    shards = 1
    while True:
        table = iblt_subtract(*(iblt(x, key, value, cells, hashes, seed, strategy, shards=shards) for x in (a, b))).persist()
        size = cells * shards
        used = table.where("count <> 0 OR key_sum <> 0 OR value_sum <> 0 OR check_sum <> 0").count()
        keys = -math.log(max(size - used, 0.5) / size) * size / hashes
        most = keys > 0.6 * size
        listed = iblt_list(table, cells, hashes, seed, shards)
        if not most and (keys < 0.15 * size and shards > 1 or listed.where("side = 0").isEmpty()):
            return listed
        following = max(2 * shards, math.ceil(keys / (0.6 * cells)))
        if following * cells >= 1 << 31:
            return listed
        table.unpersist()
        shards = following


def iblt_list(state: DataFrame, cells: int = 1000, hashes: int = 3, seed: int = 0, shards: int = 1) -> DataFrame:
    """(side, key_hash, value_hash) of all entries, side 1 or -1; one row with side 0 for a shard that can't be decoded.

    A shard has a fixed number of cells, 2^24 at most, so peeling it is one bounded task."""

    agreed([state], family="iblt", cells=cells, hashes=hashes, seed=seed, shards=shards)

    def peel(pdf: pd.DataFrame) -> pd.DataFrame:
        table = {int(c) % cells: [int(n), int(k) & MASK, int(v) & MASK, int(x)] for c, n, k, v, x in pdf[["cell", "count", "key_sum", "value_sum", "check_sum"]].itertuples(index=False)}
        ready, out = list(table), []
        while ready:
            at = ready.pop()
            n, k, v, x = table[at]
            if n not in (1, -1) or check_hash(k) != x:
                continue
            out.append((n, signed(k), signed(v)))
            for p in positions(k, cells, hashes, seed):
                cell = table.setdefault(p, [0, 0, 0, 0])
                cell[0] -= n
                cell[1] ^= k
                cell[2] ^= v
                cell[3] ^= x
                ready.append(p)
        if any(any(c) for c in table.values()):
            out = [(0, None, None)]
        return pd.DataFrame(out, columns=["side", "key_hash", "value_hash"]).astype({"side": "int32", "key_hash": "Int64", "value_hash": "Int64"})

    return state.groupBy(F.floor(F.col("cell") / cells).alias("_shard")).applyInPandas(peel, "side int, key_hash long, value_hash long")
