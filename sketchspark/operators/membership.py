"""Membership filters as rows of positions or fingerprints, Xor filters as bytes, and chains.

Probing is a sort-merge join, so many items are asked at once: Spark's estimate of a state's size
knows nothing of the positions an item is spread over, and would broadcast large states by way of
the driver.  Nulls are neither put nor members.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..compat import agreed, stamp
from ..errors import InvalidChainComposition, UnsupportedOperation, check
from ..functions.hashing import hash64, splitmix64_np
from .cardinality import union_all


def _hashes(df: DataFrame, col: str, strategy: str) -> DataFrame:
    return df.where(F.col(col).isNotNull()).select(F.col(col), hash64(col, strategy).alias("_h"))


# --- Bloom ------------------------------------------------------------------------------------


def bloom_size(capacity: int = 10_000, fpr: float = 0.01) -> tuple[int, int]:
    """(bits, hashes)"""
    check(capacity > 0 and 0 < fpr < 1, "capacity must be positive, fpr between 0 and 1")
    bits = math.ceil(-capacity * math.log(fpr) / math.log(2) ** 2)
    return bits, max(1, min(round(bits / capacity * math.log(2)), 30))


def _bloom_positions(h: Column, bits: int, k: int) -> Column:
    high, low = F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF))
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.pmod(high + i * low, F.lit(bits)))


def bloom(df: DataFrame, col: str, capacity: int = 10_000, fpr: float = 0.01, strategy: str = "md5_64") -> DataFrame:
    """(pos): the bits that are set."""
    bits, k = bloom_size(capacity, fpr)
    # one exchange, of positions: repeated keys and bits are folded in each task
    set_ = _hashes(df, col, strategy).select(F.explode(_bloom_positions(F.col("_h"), bits, k)).alias("pos")).distinct()
    return stamp(set_, family="bloom", bits=bits, hashes=k, hash=strategy)


def bloom_member(state: DataFrame, probes: DataFrame, col: str, capacity: int = 10_000, fpr: float = 0.01, strategy: str = "md5_64") -> DataFrame:
    """(col, member) of each distinct probe: all its bits are set."""
    bits, k = bloom_size(capacity, fpr)
    agreed([state], family="bloom", bits=bits, hashes=k, hash=strategy)
    asked = _hashes(probes.select(col).distinct(), col, strategy).select(col, F.explode(F.array_distinct(_bloom_positions(F.col("_h"), bits, k))).alias("pos"))
    return asked.join(state.withColumn("_set", F.lit(1)).hint("merge"), "pos", "left").groupBy(col).agg((F.count("_set") == F.count("*")).alias("member"))


def bloom_merge(states: Sequence[DataFrame]) -> DataFrame:
    """The union of bits.  States of another size or hash raise."""
    return stamp(union_all(states).distinct(), **agreed(states, family="bloom"))


# --- Quotient filters -------------------------------------------------------------------------


def _quotient(h: Column, q: int, r: int) -> list[Column]:
    check(1 <= q <= 28 and 1 <= r <= 32 and q + r <= 64, "q must be 1 to 28, r 1 to 32")
    return [F.shiftrightunsigned(h, 64 - q).alias("q"), F.shiftrightunsigned(h, 64 - q - r).bitwiseAND(F.lit((1 << r) - 1)).alias("r")]


def quotient(df: DataFrame, col: str, q: int = 16, r: int = 8, strategy: str = "md5_64") -> DataFrame:
    """(q, r): a set of fingerprints."""
    return stamp(_hashes(df, col, strategy).select(*_quotient(F.col("_h"), q, r)).distinct(), family="quotient", q=q, r=r, hash=strategy)


def quotient_member(state: DataFrame, probes: DataFrame, col: str, q: int = 16, r: int = 8, strategy: str = "md5_64") -> DataFrame:
    agreed([state], family="quotient", q=q, r=r, hash=strategy)
    asked = _hashes(probes.select(col).distinct(), col, strategy).select(col, *_quotient(F.col("_h"), q, r))
    return asked.join(state.select("q", "r").withColumn("_in", F.lit(True)).hint("merge"), ["q", "r"], "left").select(col, F.coalesce("_in", F.lit(False)).alias("member"))


def quotient_delete(state: DataFrame, items: DataFrame, col: str, q: int = 16, r: int = 8, strategy: str = "md5_64") -> DataFrame:
    built = agreed([state], family="quotient", q=q, r=r, hash=strategy)
    return stamp(state.join(quotient(items, col, q, r, strategy), ["q", "r"], "left_anti"), **built)


def quotient_merge(states: Sequence[DataFrame]) -> DataFrame:
    """The union of fingerprints.  States of other q, r or hash raise."""
    return stamp(union_all(states).distinct(), **agreed(states, family="quotient"))


def cqf(df: DataFrame, col: str, q: int = 16, r: int = 8, strategy: str = "md5_64") -> DataFrame:
    """(q, r, count): a multiset of fingerprints."""
    items = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("_n"))
    return stamp(items.select(*_quotient(hash64(col, strategy), q, r), "_n").groupBy("q", "r").agg(F.sum("_n").alias("count")), family="cqf", q=q, r=r, hash=strategy)


def cqf_count(state: DataFrame, probes: DataFrame, col: str, q: int = 16, r: int = 8, strategy: str = "md5_64") -> DataFrame:
    """(col, estimate): never under the true count."""
    agreed([state], family="cqf", q=q, r=r, hash=strategy)
    asked = _hashes(probes.select(col).distinct(), col, strategy).select(col, *_quotient(F.col("_h"), q, r))
    return asked.join(state.hint("merge"), ["q", "r"], "left").select(col, F.coalesce("count", F.lit(0)).alias("estimate"))


def cqf_delete(state: DataFrame, items: DataFrame, col: str, q: int = 16, r: int = 8, strategy: str = "md5_64") -> DataFrame:
    """One less for each row of items; what isn't there stays away."""
    less = cqf(items, col, q, r, strategy).withColumnRenamed("count", "_less")
    left = F.col("count") - F.coalesce("_less", F.lit(0))
    return state.join(less, ["q", "r"], "left").select("q", "r", left.alias("count")).where("count > 0")


def cqf_merge(states: Sequence[DataFrame]) -> DataFrame:
    """Counts add up.  States of other q, r or hash raise."""
    return stamp(union_all(states).groupBy("q", "r").agg(F.sum("count").alias("count")), **agreed(states, family="cqf"))


# --- Cuckoo -----------------------------------------------------------------------------------


def cuckoo_buckets(capacity: int = 10_000, slots: int = 4) -> int:
    return 1 << max(0, math.ceil(math.log2(capacity / 0.955 / slots)))


def cuckoo_mix(fp: int) -> int:
    """What a fingerprint's two buckets differ by, before the mask."""
    mixed = fp * 0x5BD1E995 & 0xFFFFFFFF
    return (mixed ^ mixed >> 13) * 0x5BD1E995 & 0xFFFFFFFF


def _cuckoo(h: Column, buckets: int, bits: int) -> list[Column]:
    """(pair, fp): evictions move a fingerprint between its two buckets only, so the pair names its place."""
    fp = F.shiftrightunsigned(h, 32).bitwiseAND(F.lit((1 << bits) - 1))
    fp = F.when(fp == 0, F.lit(1)).otherwise(fp).cast("long")
    low = lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF))
    mixed = low(fp * 0x5BD1E995)
    mixed = low(mixed.bitwiseXOR(F.shiftright(mixed, 13)) * F.lit(0x5BD1E995))
    one = h.bitwiseAND(F.lit(buckets - 1))
    two = one.bitwiseXOR(mixed).bitwiseAND(F.lit(buckets - 1))
    return [F.least(one, two).alias("pair"), fp.alias("fp")]


def cuckoo(df: DataFrame, col: str, capacity: int = 10_000, bits: int = 8, slots: int = 4, strategy: str = "md5_64") -> DataFrame:
    """(pair, fp, count): the multiset of fingerprints by bucket pair; rows, so it never fills up."""
    check(bits in (8, 12, 16) and slots in (2, 4), "bits must be 8, 12 or 16, slots 2 or 4")
    buckets = cuckoo_buckets(capacity, slots)
    return _hashes(df, col, strategy).select(*_cuckoo(F.col("_h"), buckets, bits)).groupBy("pair", "fp").agg(F.count("*").alias("count"))


def cuckoo_member(state: DataFrame, probes: DataFrame, col: str, capacity: int = 10_000, bits: int = 8, slots: int = 4, strategy: str = "md5_64") -> DataFrame:
    asked = _hashes(probes.select(col).distinct(), col, strategy).select(col, *_cuckoo(F.col("_h"), cuckoo_buckets(capacity, slots), bits))
    return asked.join(state.hint("merge"), ["pair", "fp"], "left").select(col, F.col("count").isNotNull().alias("member"))


def cuckoo_delete(state: DataFrame, items: DataFrame, col: str, capacity: int = 10_000, bits: int = 8, slots: int = 4, strategy: str = "md5_64") -> DataFrame:
    """One copy less for each row of items."""
    less = cuckoo(items, col, capacity, bits, slots, strategy).withColumnRenamed("count", "_less")
    left = F.col("count") - F.coalesce("_less", F.lit(0))
    return state.join(less, ["pair", "fp"], "left").select("pair", "fp", left.alias("count")).where("count > 0")


# --- Xor --------------------------------------------------------------------------------------


class XorFilter:
    """Static: three slots a key, whose xor is the key's fingerprint."""

    def __init__(self, keys: np.ndarray, bits: int = 8):
        check(bits in (8, 16), "bits must be 8 or 16")
        self.bits, keys = bits, np.unique(keys.astype(np.uint64))
        self.segment = max((math.ceil(1.23 * len(keys)) + 32 + 2) // 3, 1)
        for self.seed in range(100):
            if (order := self._peel(keys)) is not None:
                break
        else:
            raise ValueError("no seed gives an acyclic assignment")
        self.table = np.zeros(3 * self.segment, np.uint16 if bits == 16 else np.uint8)
        place, fp = self.positions(keys), self.fingerprints(keys)
        for key, slot in reversed(order):
            a, b, c = place[key]
            self.table[slot] = fp[key] ^ self.table[a] ^ self.table[b] ^ self.table[c] ^ self.table[slot]

    def fingerprints(self, keys: np.ndarray) -> np.ndarray:
        fp = keys & np.uint64((1 << self.bits) - 1)
        return np.where(fp == 0, 1, fp).astype(np.uint16 if self.bits == 16 else np.uint8)

    def positions(self, keys: np.ndarray) -> np.ndarray:
        h = splitmix64_np(keys + np.uint64(self.seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        out = np.empty((len(keys), 3), np.int64)
        low, size = np.uint64(0xFFFFFFFF), np.uint64(self.segment)
        for i, turn in enumerate((0, 21, 42)):
            x = h << np.uint64(turn) | h >> np.uint64(64 - turn) if turn else h
            out[:, i] = ((x >> np.uint64(32)) * size + ((x & low) * size >> np.uint64(32)) >> np.uint64(32)).astype(np.int64) + i * self.segment
        return out

    def _peel(self, keys: np.ndarray) -> list[tuple[int, int]] | None:
        place = self.positions(keys)
        count = np.bincount(place.ravel(), minlength=3 * self.segment)
        names = np.zeros(3 * self.segment, np.int64)
        np.bitwise_xor.at(names, place.ravel(), np.repeat(np.arange(len(keys)), 3))
        stack, order = np.flatnonzero(count == 1).tolist(), []
        while stack:
            slot = stack.pop()
            if count[slot] != 1:
                continue
            key = int(names[slot])
            order.append((key, slot))
            for s in place[key]:
                count[s] -= 1
                names[s] ^= key
                if count[s] == 1:
                    stack.append(int(s))
        return order if len(order) == len(keys) else None

    def member(self, keys: np.ndarray) -> np.ndarray:
        a, b, c = self.positions(keys.astype(np.uint64)).T
        return (self.table[a] ^ self.table[b] ^ self.table[c]) == self.fingerprints(keys.astype(np.uint64))


def xor_build(df: DataFrame, col: str, bits: int = 8, shards: int = 16, strategy: str = "md5_64") -> DataFrame:
    """(shard, n, seed, segment, table): one filter for each of the shards that the hash's top bits name."""
    keys = _hashes(df, col, strategy).select("_h", F.pmod(F.shiftrightunsigned("_h", 44), F.lit(shards)).cast("int").alias("shard")).distinct()

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        f = XorFilter(pdf["_h"].to_numpy().view(np.uint64), bits)
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "n": [len(pdf)], "seed": [f.seed], "segment": [f.segment], "table": [f.table.tobytes()]})

    return keys.groupBy("shard").applyInPandas(build, "shard int, n long, seed int, segment int, table binary")


def xor_member(state: DataFrame, probes: DataFrame, col: str, bits: int = 8, shards: int = 16, strategy: str = "md5_64") -> DataFrame:
    asked = _hashes(probes.select(col).distinct(), col, strategy).withColumn("shard", F.pmod(F.shiftrightunsigned("_h", 44), F.lit(shards)).cast("int"))

    def probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if right.empty:
            return left[[col]].assign(member=False)
        f = XorFilter.__new__(XorFilter)
        f.bits, f.seed, f.segment = bits, int(right["seed"].iloc[0]), int(right["segment"].iloc[0])
        f.table = np.frombuffer(right["table"].iloc[0], np.uint16 if bits == 16 else np.uint8)
        return left[[col]].assign(member=f.member(left["_h"].to_numpy().view(np.uint64)))

    return asked.groupBy("shard").cogroup(state.groupBy("shard")).applyInPandas(probe, f"`{col}` {probes.schema[col].dataType.simpleString()}, member boolean")


# --- chains -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Stage:
    """A filter of a chain: its state and how to put, probe and delete."""

    kind: str
    state: DataFrame
    member: Callable[[DataFrame, DataFrame, str], DataFrame]
    put: Callable[[DataFrame, DataFrame, str], DataFrame] | None = None
    delete: Callable[[DataFrame, DataFrame, str], DataFrame] | None = None


def _weight(s: Stage) -> Column:
    return F.col({"cqf": "count", "cuckoo": "count", "xor": "n"}[s.kind]) if s.kind in ("cqf", "cuckoo", "xor") else F.lit(1)


@dataclass(frozen=True)
class FilterChain:
    """An item is a member if every stage says so; static stages are skipped by put.

    Adjuncts (reconciliation tables) travel with the chain and aren't asked."""

    stages: tuple[Stage, ...] = field(default=())
    adjuncts: tuple[DataFrame, ...] = field(default=())

    def add(self, stage: Stage) -> FilterChain:
        if self.stages and self.stages[-1].kind == "xor":
            raise InvalidChainComposition("nothing follows a static filter")
        return FilterChain((*self.stages, stage), self.adjuncts)

    def adjoin(self, table: DataFrame) -> FilterChain:
        return FilterChain(self.stages, (*self.adjuncts, table))

    def count(self) -> int:
        """The stages' counts together, each of what the family counts: set bits, fingerprints or occurrences."""
        return sum(int(s.state.agg(F.sum(_weight(s))).first()[0] or 0) for s in self.stages)

    def member(self, probes: DataFrame, col: str) -> DataFrame:
        asked = probes.select(col).where(F.col(col).isNotNull()).distinct().withColumn("member", F.lit(True))
        for stage in self.stages:
            said = stage.member(stage.state, probes, col).withColumnRenamed("member", "_m")
            asked = asked.join(said.hint("merge"), col).select(col, (F.col("member") & F.col("_m")).alias("member"))
        return asked

    def put(self, items: DataFrame, col: str) -> FilterChain:
        return FilterChain(tuple(Stage(s.kind, s.put(s.state, items, col), s.member, s.put, s.delete) if s.put else s for s in self.stages), self.adjuncts)

    def delete(self, items: DataFrame, col: str) -> FilterChain:
        if any(s.delete is None for s in self.stages):
            raise UnsupportedOperation("a stage can't delete")
        return FilterChain(tuple(Stage(s.kind, s.delete(s.state, items, col), s.member, s.put, s.delete) for s in self.stages), self.adjuncts)


def stage(kind: str, df: DataFrame, col: str, **o) -> Stage:
    """A stage of kind bloom, quotient, cqf, cuckoo or xor that holds df's items."""
    if kind == "bloom":
        return Stage(kind, bloom(df, col, **o), lambda s, p, c: bloom_member(s, p, c, **o), lambda s, i, c: bloom_merge([s, bloom(i, c, **o)]))
    if kind == "quotient":
        return Stage(kind, quotient(df, col, **o), lambda s, p, c: quotient_member(s, p, c, **o), lambda s, i, c: quotient_merge([s, quotient(i, c, **o)]), lambda s, i, c: quotient_delete(s, i, c, **o))
    if kind == "cqf":
        return Stage(kind, cqf(df, col, **o), lambda s, p, c: cqf_count(s, p, c, **o).select(c, (F.col("estimate") > 0).alias("member")), lambda s, i, c: cqf_merge([s, cqf(i, c, **o)]), lambda s, i, c: cqf_delete(s, i, c, **o))
    if kind == "cuckoo":
        more = lambda s, i, c: union_all([s, cuckoo(i, c, **o)]).groupBy("pair", "fp").agg(F.sum("count").alias("count"))
        return Stage(kind, cuckoo(df, col, **o), lambda s, p, c: cuckoo_member(s, p, c, **o), more, lambda s, i, c: cuckoo_delete(s, i, c, **o))
    if kind == "xor":
        return Stage(kind, xor_build(df, col, **o), lambda s, p, c: xor_member(s, p, c, **o))
    raise InvalidChainComposition(f"no filter {kind}")
