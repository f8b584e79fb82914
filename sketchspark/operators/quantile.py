"""Quantiles: DDSketch as rows; KLL and REQ as compact states, built in Arrow batches and merged.

KLL and REQ states depend on order.  A task folds its rows to one state a group, states are
merged in the order of their bytes, and what is promised is the rank error, not the bytes.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..compat import agreed, stamp
from ..errors import DeserializationError, IncompatibleSketches, UnsupportedOperation, check
from .cardinality import union_all

# --- DDSketch ---------------------------------------------------------------------------------


def gamma(alpha: float) -> float:
    check(0 < alpha < 1, "alpha must be between 0 and 1")
    return (1 + alpha) / (1 - alpha)


def ddsketch(df: DataFrame, col: str, by: Sequence[str] = (), alpha: float = 0.01) -> DataFrame:
    """(by..., bin, count, low, high): bin null holds zeros; low and high are the exact extremes seen in the bin.

    Negative, NaN and infinite values raise."""
    v = F.col(col).cast("double")
    good = F.when(F.isnan(v) | (v < 0) | (v == float("inf")), F.raise_error(F.lit("DDSketch takes finite values of 0 or more"))).otherwise(v)
    rows = df.where(v.isNotNull()).select(*by, good.alias("_v"))
    bin_ = F.when(F.col("_v") > 0, F.floor(F.log("_v") / F.lit(math.log(gamma(alpha))))).cast("int")
    return stamp(rows.groupBy(*by, bin_.alias("bin")).agg(F.count("*").alias("count"), F.min("_v").alias("low"), F.max("_v").alias("high")), family="ddsketch", alpha=alpha)


def ddsketch_merge(states: Sequence[DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """Counts of bins add up.  States of another alpha raise."""
    built = agreed(states, family="ddsketch")
    return stamp(union_all(states).groupBy(*by, "bin").agg(F.sum("count").alias("count"), F.min("low").alias("low"), F.max("high").alias("high")), **built)


def ddsketch_quantiles(state: DataFrame, ranks: Sequence[float], by: Sequence[str] = (), alpha: float = 0.01) -> DataFrame:
    """(by..., rank, value): the first bin whose cumulative count reaches rank * n; 0 and 1 are the extremes."""
    agreed([state], family="ddsketch", alpha=alpha)
    g = gamma(alpha)
    whole = Window.partitionBy(*by)
    walk = whole.orderBy(F.col("bin").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    seen = state.select(*by, "bin", F.sum("count").over(walk).alias("_c"), F.sum("count").over(whole).alias("_n"), F.min("low").over(whole).alias("_lo"), F.max("high").over(whole).alias("_hi"))
    asked = seen.withColumn("rank", F.explode(F.array(*map(F.lit, map(float, ranks)))))
    hit = asked.where(F.col("_c") >= F.col("rank") * F.col("_n"))
    first = hit.groupBy(*by, "rank").agg(F.min(F.struct("_c", "bin", "_lo", "_hi")).alias("r"))
    value = F.when(F.col("r.bin").isNull(), 0.0).otherwise(2 * F.pow(F.lit(g), F.col("r.bin") + 1) / (g + 1))
    return first.select(*by, "rank", F.when(F.col("rank") <= 0, F.col("r._lo")).when(F.col("rank") >= 1, F.col("r._hi")).otherwise(value).alias("value"))


def ddsketch_rank(state: DataFrame, value: float, by: Sequence[str] = (), alpha: float = 0.01) -> DataFrame:
    """(by..., rank): the share of values in value's bin or below."""
    agreed([state], family="ddsketch", alpha=alpha)
    at = math.floor(math.log(value) / math.log(gamma(alpha))) if value > 0 else None
    below = F.lit(False) if value < 0 else F.col("bin").isNull() if at is None else F.col("bin").isNull() | (F.col("bin") <= at)
    return state.groupBy(*by).agg((F.sum(F.when(below, F.col("count")).otherwise(0)) / F.sum("count")).alias("rank"))


def ddsketch_cdf(*_: object, **__: object) -> DataFrame:
    raise UnsupportedOperation("DDSketch has no cdf or pmf: its bins are relative to values, not ranks")


ddsketch_pmf = ddsketch_cdf


# --- KLL and REQ ------------------------------------------------------------------------------


class CompactorSketch:
    """Levels of values, level i with weight 2^i; a full level sorts itself and promotes every other value.

    kind "kll" clears the level; "req_high" and "req_low" compact only the half away from the
    accurate end.  A level's parity bit alternates which half goes up."""

    def __init__(self, k: int = 200, kind: str = "kll"):
        check(kind in ("kll", "req_high", "req_low"), f"unknown kind {kind}")
        check(8 <= k <= 65535 if kind == "kll" else k >= 2, "k is out of range")
        self.k, self.kind, self.n = k, kind, 0
        self.low = self.high = math.nan
        self.levels: list[list[float]] = [[], []]
        self.parity = [0, 0]

    def capacity(self, level: int) -> int:
        """KLL's lower levels shrink; those of REQ, which compact a part only, hold three sections of 2 k values each."""
        if self.kind != "kll":
            return 6 * self.k
        return max(2, math.floor(self.k * (2 / 3) ** (len(self.levels) - 1 - level)) + 1)

    def update(self, values: Sequence[float]) -> None:
        """Add values one after another; a level takes what fits before it compacts."""
        values = list(map(float, values))
        if not values:
            return
        self.low = min(values) if math.isnan(self.low) else min(self.low, *values)
        self.high = max(values) if math.isnan(self.high) else max(self.high, *values)
        self.n += len(values)
        at = 0
        while at < len(values):
            room = max(1, self.capacity(0) - len(self.levels[0]))
            self.levels[0][:0] = values[at : at + room][::-1]
            at += room
            self._compact(0)
            self._grow()

    def _compact(self, level: int) -> None:
        while level < len(self.levels) - 1 and len(self.levels[level]) >= self.capacity(level):
            # an even number goes up, so that the weights still add up to n; of an odd one KLL keeps what came first
            found = self.levels[level]
            odd = found[-1:] if self.kind == "kll" and len(found) % 2 else []
            found = sorted(found[: len(found) - len(odd)])
            half = max(2, len(found) // 2 & ~1)
            stay, part = (odd, found) if self.kind == "kll" else (found[half:], found[:half]) if self.kind == "req_high" else (found[: len(found) - half], found[len(found) - half :])
            self.levels[level] = stay
            self.levels[level + 1] = part[self.parity[level] :: 2] + self.levels[level + 1]
            self.parity[level] ^= 1
            level += 1

    def _sweep(self) -> None:
        for level in range(len(self.levels) - 1):
            self._compact(level)

    def _grow(self) -> None:
        while len(self.levels[-1]) >= self.capacity(len(self.levels) - 1):
            self.levels.append([])
            self.parity.append(0)
            self._sweep()

    def merge(self, other: CompactorSketch) -> CompactorSketch:
        if (self.k, self.kind) != (other.k, other.kind):
            raise IncompatibleSketches(f"{self.kind} k={self.k} and {other.kind} k={other.k}")
        out = CompactorSketch(self.k, self.kind)
        out.n = self.n + other.n
        out.low = other.low if math.isnan(self.low) else self.low if math.isnan(other.low) else min(self.low, other.low)
        out.high = other.high if math.isnan(self.high) else self.high if math.isnan(other.high) else max(self.high, other.high)
        depth = max(len(self.levels), len(other.levels))
        pad = lambda x, empty: x + [empty() for _ in range(depth - len(x))]
        out.levels = [a + b for a, b in zip(pad(self.levels, list), pad(other.levels, list), strict=True)]
        out.parity = [a ^ b for a, b in zip(pad(self.parity, int), pad(other.parity, int), strict=True)]
        out._sweep()
        out._grow()
        return out

    def view(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted values and cumulative weights."""
        values = np.array([v for level in self.levels for v in level])
        weight = np.repeat(1 << np.arange(len(self.levels)), [len(level) for level in self.levels])
        order = np.argsort(values, kind="stable")
        return values[order], np.cumsum(weight[order])

    def quantile(self, rank: float) -> float | None:
        check(0 <= rank <= 1, "a rank is between 0 and 1")
        if not self.n:
            return None
        if rank in (0, 1):
            return self.low if rank == 0 else self.high
        values, total = self.view()
        return float(values[min(int(np.searchsorted(total, rank * total[-1], "right")), len(values) - 1)])

    def rank(self, value: float) -> float | None:
        if not self.n:
            return None
        values, total = self.view()
        at = int(np.searchsorted(values, value, "right"))
        return float(total[at - 1] / total[-1]) if at else 0.0

    def cdf(self, splits: Sequence[float]) -> list[float] | None:
        return [self.rank(s) for s in splits] if self.n else None

    def pmf(self, splits: Sequence[float]) -> list[float] | None:
        if not self.n:
            return None
        edges = [0.0, *self.cdf(splits), 1.0]
        return [b - a for a, b in zip(edges, edges[1:], strict=False)]

    #: The state's layout, little-endian.
    def to_bytes(self) -> bytes:
        depth = len(self.levels)
        bits = sum(p << i for i, p in enumerate(self.parity)).to_bytes((depth + 7) // 8, "little")
        low, high = (b"\0\0\0\0\0\0\xf8\x7f" if math.isnan(x) else struct.pack("<d", x) for x in (self.low, self.high))
        head = struct.pack("<BI", 1, self.k) if self.kind == "kll" else struct.pack("<4sBBHI", b"REQ1", 1, self.kind == "req_high", 0, self.k)
        sizes = struct.pack(f"<{depth}I", *map(len, self.levels))
        return head + struct.pack("<Q", self.n) + low + high + struct.pack("<B", depth) + bits + sizes + b"".join(struct.pack(f"<{len(x)}d", *x) for x in self.levels)

    @classmethod
    def from_bytes(cls, raw: bytes) -> CompactorSketch:
        try:
            if raw[:4] == b"REQ1":
                _, _, high, _, k = struct.unpack_from("<4sBBHI", raw)
                out, at = cls(k, "req_high" if high & 1 else "req_low"), 12
            else:
                _, k = struct.unpack_from("<BI", raw)
                out, at = cls(k), 5
            out.n, out.low, out.high, depth = struct.unpack_from("<QddB", raw, at)
            at += 25
            bits = int.from_bytes(raw[at : at + (depth + 7) // 8], "little")
            at += (depth + 7) // 8
            sizes = struct.unpack_from(f"<{depth}I", raw, at)
            at += 4 * depth
            out.parity, out.levels = [bits >> i & 1 for i in range(depth)], []
            for size in sizes:
                out.levels.append(list(struct.unpack_from(f"<{size}d", raw, at)))
                at += 8 * size
        except struct.error as e:
            raise DeserializationError(f"quantile state: {e}") from e
        return out


def compactor(df: DataFrame, col: str, by: Sequence[str] = (), k: int = 200, kind: str = "kll") -> DataFrame:
    """(by..., state): one state a group, from a partial state of each task."""
    keys = ", ".join(f"`{b}` {df.schema[b].dataType.simpleString()}" for b in by)
    schema = f"{keys}{', ' if by else ''}state binary"
    rows = df.where(F.col(col).isNotNull()).select(*by, F.col(col).cast("double").alias("_v"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, CompactorSketch] = {}
        for batch in batches:
            table = batch.to_pandas()
            for key, part in table.groupby(list(by), dropna=False, sort=False) if by else [((), table)]:
                key = tuple(None if pd.isna(x) else x for x in key)
                held.setdefault(key, CompactorSketch(k, kind)).update(part["_v"].tolist())
        if held:
            kinds = rows_schema
            columns = [pa.array([key[i] for key in held], kinds.field(b).type) for i, b in enumerate(by)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([s.to_bytes() for s in held.values()], pa.binary())], [*by, "state"])

    from pyspark.sql.pandas.types import to_arrow_schema

    rows_schema = to_arrow_schema(rows.schema)
    return compactor_merge([rows.mapInArrow(fold, schema)], by)


def compactor_merge(states: Sequence[DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """Merge states a group, in two rounds, so a group's states of many tasks never meet at once."""
    both = union_all(states)
    keys = ", ".join(f"`{b}` {both.schema[b].dataType.simpleString()}" for b in by)
    schema = f"{keys}{', ' if by else ''}state binary"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out = None
        for raw in sorted(map(bytes, pdf["state"])):
            one = CompactorSketch.from_bytes(raw)
            out = one if out is None else out.merge(one)
        return pd.DataFrame({**{b: [pdf[b].iloc[0]] for b in by}, "state": [out.to_bytes()]})

    some = both.withColumn("_part", F.pmod(F.xxhash64("state"), F.lit(64)))
    return some.groupBy(*by, "_part").applyInPandas(fold, schema).groupBy(*by).applyInPandas(fold, schema)


def compactor_query(state: DataFrame, by: Sequence[str] = (), quantiles: Sequence[float] = (), ranks: Sequence[float] = (), splits: Sequence[float] = ()) -> DataFrame:
    """(by..., n, low, high, quantiles, ranks, cdf, pmf) as arrays in the asked order."""

    @F.udf("n long, low double, high double, quantiles array<double>, ranks array<double>, cdf array<double>, pmf array<double>")
    def ask(raw: bytes) -> tuple:
        s = CompactorSketch.from_bytes(bytes(raw))
        return s.n, s.low, s.high, [s.quantile(q) for q in quantiles], [s.rank(r) for r in ranks], s.cdf(splits), s.pmf(splits)

    return state.select(*by, ask("state").alias("_a")).select(*by, "_a.*")


def quantiles(df: DataFrame, col: str, ranks: Sequence[float], by: Sequence[str] = (), kind: str = "kll", **options) -> DataFrame:
    """(by..., rank, value) by any family: kll, req (high ranks), req_low or ddsketch."""
    if kind == "ddsketch":
        return ddsketch_quantiles(ddsketch(df, col, by, **options), ranks, by, **options)
    name = {"kll": "kll", "req": "req_high", "req_low": "req_low"}.get(kind)
    if name is None:
        raise UnsupportedOperation(f"no quantile family {kind}")
    state = compactor(df, col, by, **({"k": 12} if name != "kll" else {}) | options, kind=name)
    pairs = F.arrays_zip(F.array(*map(F.lit, map(float, ranks))).alias("rank"), F.col("quantiles").alias("value"))
    return compactor_query(state, by, quantiles=list(ranks)).select(*by, F.explode(pairs).alias("r")).select(*by, "r.rank", "r.value")


FACADE = {"kll": "kll", "req": "req_high", "req_low": "req_low"}


def sketch(df: DataFrame, col: str, by: Sequence[str] = (), kind: str = "kll", **options) -> DataFrame:
    """The state of any family of the facade; `merge`, `rank`, `cdf` and `pmf` take it with the same kind."""
    if kind == "ddsketch":
        return ddsketch(df, col, by, **options)
    if kind not in FACADE:
        raise UnsupportedOperation(f"no quantile family {kind}")
    return compactor(df, col, by, **({"k": 12} if kind != "kll" else {}) | options, kind=FACADE[kind])


def merge(states: Sequence[DataFrame], by: Sequence[str] = (), kind: str = "kll") -> DataFrame:
    return ddsketch_merge(states, by) if kind == "ddsketch" else compactor_merge(states, by)


def rank(state: DataFrame, value: float, by: Sequence[str] = (), kind: str = "kll", **options) -> DataFrame:
    """(by..., rank): the share of values up to value."""
    if kind == "ddsketch":
        return ddsketch_rank(state, value, by, **options)
    return compactor_query(state, by, ranks=[value]).select(*by, F.col("ranks")[0].alias("rank"))


def cdf(state: DataFrame, splits: Sequence[float], by: Sequence[str] = (), kind: str = "kll") -> DataFrame:
    """(by..., cdf): shares up to each split."""
    if kind == "ddsketch":
        return ddsketch_cdf()
    return compactor_query(state, by, splits=splits).select(*by, "cdf")


def pmf(state: DataFrame, splits: Sequence[float], by: Sequence[str] = (), kind: str = "kll") -> DataFrame:
    """(by..., pmf): shares between the splits."""
    if kind == "ddsketch":
        return ddsketch_pmf()
    return compactor_query(state, by, splits=splits).select(*by, "pmf")
