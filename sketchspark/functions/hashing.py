"""64-bit hashes of a column, as a BIGINT of the same bits.

md5_64 and xxhash64 are Catalyst expressions; md5_64 is also what DuckDB can compute.  xxh3
and murmur3 run in Arrow batches.  Strategies never mix: merges compare their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import IncompatibleSketches, InvalidOption

MASK = (1 << 64) - 1
GOLDEN = 0x9E3779B97F4A7C15
#: Names and wire bytes of hash strategies in frames.
WIRE = {"phash2": 0, "xxh3": 1, "murmur3": 2, "custom": 255}


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def splitmix64(x: int) -> int:
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def _rotl(x: int, r: int) -> int:
    return (x << r | x >> 64 - r) & MASK


def _fmix(k: int) -> int:
    k = (k ^ k >> 33) * 0xFF51AFD7ED558CCD & MASK
    k = (k ^ k >> 33) * 0xC4CEB9FE1A85EC53 & MASK
    return k ^ k >> 33


def murmur3_128(data: bytes, seed: int = 0) -> tuple[int, int]:
    """MurmurHash3 x64 128."""
    c1, c2 = 0x87C37B91114253D5, 0x4CF5AD432745937F
    h1 = h2 = seed & 0xFFFFFFFF
    whole = len(data) // 16 * 16
    for i in range(0, whole, 16):
        k1, k2 = int.from_bytes(data[i : i + 8], "little"), int.from_bytes(data[i + 8 : i + 16], "little")
        h1 ^= _rotl(k1 * c1 & MASK, 31) * c2 & MASK
        h1 = ((_rotl(h1, 27) + h2) * 5 + 0x52DCE729) & MASK
        h2 ^= _rotl(k2 * c2 & MASK, 33) * c1 & MASK
        h2 = ((_rotl(h2, 31) + h1) * 5 + 0x38495AB5) & MASK
    tail = data[whole:]
    h2 ^= _rotl(int.from_bytes(tail[8:], "little") * c2 & MASK, 33) * c1 & MASK
    h1 ^= _rotl(int.from_bytes(tail[:8], "little") * c1 & MASK, 31) * c2 & MASK
    h1, h2 = h1 ^ len(data), h2 ^ len(data)
    h1 = (h1 + h2) & MASK
    h2 = (h2 + h1) & MASK
    h1, h2 = _fmix(h1), _fmix(h2)
    h1 = (h1 + h2) & MASK
    return h1, (h2 + h1) & MASK


def _batched(name: str, seed: int) -> Callable[[Column], Column]:
    def one(x: object) -> int | None:
        import xxhash

        if x is None:
            return None
        raw = bytes(x) if isinstance(x, (bytes, bytearray)) else str(x).encode()
        return signed(xxhash.xxh3_64_intdigest(raw, seed) if name == "xxh3" else murmur3_128(raw, seed)[0])

    @F.pandas_udf("long")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(one, na_action="ignore").astype("Int64")

    return apply


def hash64(col: Column | str, strategy: str = "md5_64", seed: int = 0) -> Column:
    """The hash of a column's text (of a binary column's bytes); null stays null."""
    col = F.col(col) if isinstance(col, str) else col
    if strategy == "md5_64":
        text = col.cast("string") if seed == 0 else F.concat(F.lit(f"{seed}:"), col.cast("string"))
        return F.conv(F.substring(F.md5(text.cast("binary")), 1, 16), 16, -10).cast("long")
    if strategy == "xxhash64":
        return F.when(col.isNotNull(), F.xxhash64(col, F.lit(seed)))
    if strategy in ("xxh3", "murmur3"):
        return _batched(strategy, seed)(col.cast("string"))
    raise InvalidOption(f"unknown hash strategy {strategy}")


def unsigned(h: Column) -> Column:
    """The bits of a BIGINT as an exact non-negative decimal."""
    d = h.cast("decimal(38,0)")
    return F.when(h < 0, d + F.lit(str(1 << 64)).cast("decimal(38,0)")).otherwise(d)


def unsigned_order(h: Column) -> Column:
    """A BIGINT that sorts as h's bits do unsigned."""
    return h.bitwiseXOR(F.lit(-(1 << 63)))


def same_hash(a: str, b: str) -> None:
    if a != b:
        raise IncompatibleSketches(f"hash {a} and {b}")


def splitmix64_np(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
