"""State bytes of each family, and frames of state rows as a BINARY column.

``to_frames`` packs a group's state rows into one checksummed frame and ``from_frames`` gives the
rows back.  A frame's rows are bounded by its parameters (registers, cells, slots, k entries), so
packing one is one bounded task; a filter of more fingerprints takes several frames.

Fixed values: magics, versions, field orders and widths below, all little-endian.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import codec
from .errors import DeserializationError, InvalidChainComposition, InvalidOption, check
from .functions.hashing import MASK, murmur3_128, signed
from .operators.cardinality import theta_compact
from .operators.membership import bloom_size, cuckoo_buckets, cuckoo_mix
from .operators.quantile import CompactorSketch, gamma

#: The byte of a hash strategy in the parameters of HLL, ULL, CMS and Theta.
PARAM_HASH = {"phash2": 0, "xxh3": 1, "custom": 2, "murmur3": 3}

Options = dict[str, object]


@dataclass(frozen=True)
class Layout:
    """How a family's rows become state bytes; ``columns`` is the schema of its state rows."""

    columns: str
    pack: Callable[[pd.DataFrame, Options], bytes]
    unpack: Callable[[bytes, Options], dict[str, Sequence]]
    params: Callable[[Options], bytes]
    options: Callable[[bytes], Options]


def _fields(fmt: str, raw: bytes) -> tuple:
    if len(raw) != struct.calcsize(fmt):
        raise DeserializationError(f"parameters of {len(raw)} bytes")
    return struct.unpack(fmt, raw)


def _head(fmt: str, raw: bytes, magic: bytes | None, version: int = 1) -> tuple[tuple, bytes]:
    """The fields after magic and version, and the body."""
    size = struct.calcsize(fmt)
    if len(raw) < size:
        raise DeserializationError("the state is cut off")
    found = struct.unpack_from(fmt, raw)
    if magic is not None:
        if found[0] != magic:
            raise DeserializationError(f"the state isn't {magic!r}")
        found = found[1:]
    if found[0] != version:
        raise DeserializationError(f"state version {found[0]}")
    return found[1:], raw[size:]


def _sized(body: bytes, size: int) -> bytes:
    if len(body) != size:
        raise DeserializationError(f"a body of {len(body)} bytes where {size} belong")
    return body


def _ints(s: pd.Series) -> list[int]:
    return [int(x) for x in s]


# --- registers and counters -------------------------------------------------------------------


def _dense(rows: pd.DataFrame, p: int) -> bytes:
    body = np.zeros(1 << p, np.uint8)
    body[rows["bucket"].to_numpy(np.int64)] = rows["value"].to_numpy(np.uint8)
    return body.tobytes()


def _nonzero(body: bytes) -> dict[str, Sequence]:
    values = np.frombuffer(body, np.uint8)
    at = np.flatnonzero(values)
    return {"bucket": at, "value": values[at]}


def _hll_unpack(raw: bytes, o: Options) -> dict[str, Sequence]:
    (p, _), body = _head("<BBH", raw, None)
    return _nonzero(_sized(body, 1 << p))


def _ull_unpack(raw: bytes, o: Options) -> dict[str, Sequence]:
    (p, _), body = _head("<4sBBH", raw, b"ULL1")
    return _nonzero(_sized(body, 1 << p))


def _cms_pack(rows: pd.DataFrame, o: Options) -> bytes:
    table = np.zeros((o["depth"], o["width"]), f"<u{o['counter_bits'] // 8}")
    table[rows["row"].to_numpy(np.int64), rows["slot"].to_numpy(np.int64)] = rows["count"].to_numpy(np.int64).astype(table.dtype)
    return struct.pack("<BIHBB", 1, o["width"], o["depth"], o["counter_bits"], 0) + table.tobytes()


def _cms_unpack(raw: bytes, o: Options) -> dict[str, Sequence]:
    (width, depth, bits, _), body = _head("<BIHBB", raw, None)
    table = np.frombuffer(_sized(body, width * depth * bits // 8), f"<u{bits // 8}").reshape(depth, width)
    row, slot = np.nonzero(table)
    return {"row": row, "slot": slot, "count": table[row, slot]}


def _theta_pack(rows: pd.DataFrame, o: Options) -> bytes:
    thetas = {x & MASK for x in _ints(rows["theta"])} or {MASK}
    theta = min(thetas)
    return codec.theta_state([h for h in (x & MASK for x in _ints(rows["hash"])) if h < theta or theta == MASK], theta, o["k"])


def _theta_unpack(raw: bytes, o: Options) -> dict[str, Sequence]:
    (_, theta, n), body = _head("<BIQI", raw, None)
    hashes = np.frombuffer(_sized(body, 8 * n), "<u8").view(np.int64)
    return {"hash": hashes, "theta": np.full(n, signed(theta))}


# --- quantiles ----------------------------------------------------------------------------------

#: Fixed value: no value yet.
_NAN = b"\0\0\0\0\0\0\xf8\x7f"


def _ddsketch_pack(rows: pd.DataFrame, o: Options) -> bytes:
    g = gamma(o["alpha"])
    log_gamma = math.log(g)
    least = 5e-324
    indexable = max(least, math.exp(log_gamma * (math.floor(math.log(least) / log_gamma) + 1)))
    zero = rows["bin"].isna()
    bins = sorted(zip(_ints(rows.loc[~zero, "bin"]), _ints(rows.loc[~zero, "count"]), strict=True))
    check(all(c < 1 << 32 for _, c in bins), "a bin's count doesn't fit 32 bits")
    lows, highs = rows["low"].dropna(), rows["high"].dropna()
    ends = [struct.pack("<d", float(f(x))) if len(x) else _NAN for f, x in ((min, lows), (max, highs))]
    zeros = sum(_ints(rows.loc[zero, "count"]))
    head = struct.pack("<4sBBH4dQQ", b"DDS1", 1, 0, 0, o["alpha"], g, log_gamma, indexable, zeros + sum(c for _, c in bins), zeros)
    return head + ends[0] + ends[1] + struct.pack("<IiII", len(bins), 0, 0, 0) + b"".join(struct.pack("<iI", *b) for b in bins)


def _ddsketch_unpack(raw: bytes, o: Options) -> dict[str, Sequence]:
    """Only the extremes of the whole are stored: the first row gets the low one and the last the high one."""
    (_, _, _, _, _, _, n, zeros, low, high, size, _, _, _), body = _head("<4sBBH4dQQddIiII", raw, b"DDS1")
    bins = [*([(None, zeros)] if zeros else []), *struct.iter_unpack("<iI", _sized(body, 8 * size))]
    if sum(c for _, c in bins) != n:
        raise DeserializationError("the bins don't add up")
    last = len(bins) - 1
    return {"bin": [b for b, _ in bins], "count": [c for _, c in bins], "low": [low if i == 0 else None for i in range(len(bins))], "high": [high if i == last else None for i in range(len(bins))]}


def _compact_state(rows: pd.DataFrame, o: Options) -> bytes:
    check(len(rows) == 1, "merge the states of a group first")
    return bytes(rows["state"].iloc[0])


def _compact_rows(raw: bytes, o: Options) -> dict[str, Sequence]:
    again = CompactorSketch.from_bytes(raw).to_bytes()
    if again != raw:
        raise DeserializationError("a damaged quantile state")
    return {"state": [raw]}


# --- heavy hitters --------------------------------------------------------------------------------


def _total(rows: pd.DataFrame, o: Options) -> int:
    return int(o["n"]) if o.get("n") is not None else sum(_ints(rows["count"]))


def _frequent_pack(rows: pd.DataFrame, o: Options) -> bytes:
    entries = [(str(i).encode(), c, e) for i, c, e in zip(rows["item"], _ints(rows["count"]), _ints(rows["error"]), strict=True)]
    return codec.frequent_state(entries, o["k"], _total(rows, o))


def _entries(body: bytes, n: int, fmt: str) -> list[tuple]:
    out, at = [], 0
    for _ in range(n):
        if at + 4 > len(body):
            raise DeserializationError("the entries are cut off")
        (size,) = struct.unpack_from("<I", body, at)
        at += 4 + size
        if at + struct.calcsize(fmt) > len(body):
            raise DeserializationError("the entries are cut off")
        out.append((body[at - size : at].decode("utf-8", "replace"), *struct.unpack_from(fmt, body, at)))
        at += struct.calcsize(fmt)
    _sized(body, at)
    return out


def _frequent_unpack(raw: bytes, o: Options) -> dict[str, Sequence]:
    (_, _, _, o["n"], size, _), body = _head("<4sBBHIQIQ", raw, b"FI1\0")
    found = _entries(body, size, "<QQ")
    return {"item": [x[0] for x in found], "count": [x[1] for x in found], "error": [x[2] for x in found]}


def _misra_pack(rows: pd.DataFrame, o: Options) -> bytes:
    entries = sorted((str(i).encode(), c) for i, c in zip(rows["item"], _ints(rows["count"]), strict=True))
    return struct.pack("<4sBBIQI", b"MG01", 1, 0, o["k"], _total(rows, o), len(entries)) + b"".join(struct.pack("<I", len(i)) + i + struct.pack("<Q", c) for i, c in entries)


def _misra_unpack(raw: bytes, o: Options) -> dict[str, Sequence]:
    (_, _, o["n"], size), body = _head("<4sBBIQI", raw, b"MG01")
    found = _entries(body, size, "<Q")
    return {"item": [x[0] for x in found], "count": [x[1] for x in found]}


# --- membership -----------------------------------------------------------------------------------


def _bloom_pack(rows: pd.DataFrame, o: Options) -> bytes:
    bits, k = bloom_size(o["capacity"], o["fpr"])
    body = np.zeros((bits + 7) // 8 * 8, np.uint8)
    body[rows["pos"].to_numpy(np.int64)] = 1
    return struct.pack("<4sBBHIIdIIQ", b"BLM1", 1, 0, k, bits, o["seed"], o["fpr"], o["capacity"], len(body) // 8, 0) + np.packbits(body, bitorder="little").tobytes()


def _bloom_unpack(raw: bytes, o: Options) -> dict[str, Sequence]:
    (_, _, bits, _, _, _, size, _), body = _head("<4sBBHIIdIIQ", raw, b"BLM1")
    flags = np.unpackbits(np.frombuffer(_sized(body, size), np.uint8), bitorder="little")
    if size != (bits + 7) // 8 or flags[bits:].any():
        raise DeserializationError("the bit set has another size")
    return {"pos": np.flatnonzero(flags)}


def slots(q: np.ndarray, r: np.ndarray, q_bits: int, r_bits: int) -> bytes:
    """A quotient filter's slots from fingerprints sorted by (q, r).

    Entry i lies at max(q_i, place of the one before + 1), which is a running maximum of q_i - i.
    What runs over the end begins the table again and moves the first entries on."""
    size, n = 1 << q_bits, len(q)
    check(n <= size, f"{n} fingerprints don't fit {size} slots")
    order, begin, place = np.arange(n), 0, np.zeros(0, np.int64)
    while n:
        place = np.maximum(np.maximum.accumulate(q - order), begin) + order
        over = max(0, int(place[-1]) + 1 - size)
        if over == begin:
            break
        begin = over
    width = (3 + r_bits + 7) // 8
    table = np.zeros(size, np.uint64)
    follows = np.zeros(n, bool)
    follows[1:] = q[1:] == q[:-1]
    meta = (follows * 2 + (place % size != q) * 4).astype(np.uint64)
    table[place % size] = meta | r.astype(np.uint64) << np.uint64(3)
    table[np.unique(q)] |= np.uint64(1)
    return table.astype("<u8").view(np.uint8).reshape(size, 8)[:, :width].tobytes()


def fingerprints(body: bytes, q_bits: int, r_bits: int) -> list[tuple[int, int]]:
    """The (q, r) that slots hold, in the order of their places."""
    size, width = 1 << q_bits, (3 + r_bits + 7) // 8
    wide = np.zeros((size, 8), np.uint8)
    wide[:, :width] = np.frombuffer(_sized(body, size * width), np.uint8).reshape(size, width)
    table = wide.view("<u8").ravel()
    meta, rest = (table & np.uint64(7)).astype(int).tolist(), (table >> np.uint64(3)).tolist()
    if not any(meta):
        return []
    start = next((i for i in range(size) if not meta[i] & 4), None)
    if start is None:
        raise DeserializationError("no cluster has a beginning")
    out, waiting, q = [], [], None
    for i in range(start, start + size):
        at = i % size
        if meta[at] & 1:
            waiting.append(at)
        if not meta[at] & 6:  # a run at its own place
            if meta[at] & 1:
                q = waiting.pop(0)
                out.append((q, rest[at]))
        elif meta[at] & 2:
            if q is None:
                raise DeserializationError("a run has no beginning")
            out.append((q, rest[at]))
        else:
            if not waiting:
                raise DeserializationError("a run has no quotient")
            q = waiting.pop(0)
            out.append((q, rest[at]))
    return out


def _sorted_qr(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.astype({"q": np.int64, "r": np.int64}).sort_values(["q", "r"])


def _quotient_pack(rows: pd.DataFrame, o: Options) -> bytes:
    rows = _sorted_qr(rows)
    body = slots(rows["q"].to_numpy(), rows["r"].to_numpy(), o["q"], o["r"])
    return struct.pack("<4sBBBBIII12x", b"QOT1", 1, o["q"], o["r"], 0, 1 << o["q"], len(rows), o["seed"]) + body


def _quotient_unpack(raw: bytes, o: Options) -> dict[str, Sequence]:
    (q, r, _, _, n, _), body = _head("<4sBBBBIII12x", raw, b"QOT1")
    found = fingerprints(body, q, r)
    if len(found) != n:
        raise DeserializationError("another number of fingerprints")
    return {"q": [a for a, _ in found], "r": [b for _, b in found]}


def _cqf_pack(rows: pd.DataFrame, o: Options) -> bytes:
    """Counts are unary: a fingerprint of count n takes n slots."""
    rows = _sorted_qr(rows)
    counts = rows["count"].to_numpy(np.int64)
    check(int(counts.sum()) <= 1 << o["q"], f"{int(counts.sum())} occurrences don't fit {1 << o['q']} slots")
    body = slots(np.repeat(rows["q"].to_numpy(), counts), np.repeat(rows["r"].to_numpy(), counts), o["q"], o["r"])
    return struct.pack("<4sBBBBIIQI12x", b"CQF1", 1, o["q"], o["r"], 0, 1 << o["q"], len(rows), int(counts.sum()), o["seed"]) + body


def _cqf_unpack(raw: bytes, o: Options) -> dict[str, Sequence]:
    (q, r, _, _, n, total, _), body = _head("<4sBBBBIIQI12x", raw, b"CQF1")
    held: dict[tuple[int, int], int] = {}
    for one in fingerprints(body, q, r):
        held[one] = held.get(one, 0) + 1
    if (len(held), sum(held.values())) != (n, total):
        raise DeserializationError("another number of fingerprints")
    return {"q": [a for a, _ in held], "r": [b for _, b in held], "count": list(held.values())}


def _cuckoo_pack(rows: pd.DataFrame, o: Options) -> bytes:
    """Each fingerprint goes to one of its two buckets; a full pair moves others on, up to ``kicks`` times."""
    buckets, slots_, kicks = cuckoo_buckets(o["capacity"], o["slots"]), o["slots"], o["kicks"]
    table: list[list[int]] = [[] for _ in range(buckets)]
    n = 0
    for pair, fp, count in sorted(zip(_ints(rows["pair"]), _ints(rows["fp"]), _ints(rows["count"]), strict=True)):
        for _ in range(count):
            n += 1
            first, second = pair, (pair ^ cuckoo_mix(fp)) & (buckets - 1)
            room = min((first, second), key=lambda b: len(table[b]))
            held, at = fp, room
            for kick in range(kicks + 1):
                if len(table[at]) < slots_:
                    table[at].append(held)
                    break
                turn = (held + kick) % slots_
                table[at][turn], held = held, table[at][turn]
                at = (at ^ cuckoo_mix(held)) & (buckets - 1)
            else:
                check(False, f"the filter of {buckets} buckets is full")
    body = np.zeros((buckets, slots_), f"<u{(o['bits'] + 7) // 8}")
    for b, held_ in enumerate(table):
        body[b, : len(held_)] = held_
    return struct.pack("<4sBBBBIIIIQ", b"CKO1", 1, o["bits"], slots_, 0, buckets, n, o["seed"], kicks, 0) + body.tobytes()


def _cuckoo_unpack(raw: bytes, o: Options) -> dict[str, Sequence]:
    (bits, slots_, _, buckets, n, _, _, _), body = _head("<4sBBBBIIIIQ", raw, b"CKO1")
    width = (bits + 7) // 8
    table = np.frombuffer(_sized(body, buckets * slots_ * width), f"<u{width}").reshape(buckets, slots_)
    held: dict[tuple[int, int], int] = {}
    for b, s in zip(*(x.tolist() for x in np.nonzero(table)), strict=True):
        fp = int(table[b, s])
        place = (min(b, (b ^ cuckoo_mix(fp)) & (buckets - 1)), fp)
        held[place] = held.get(place, 0) + 1
    if sum(held.values()) != n:
        raise DeserializationError("another number of fingerprints")
    return {"pair": [a for a, _ in held], "fp": [b for _, b in held], "count": list(held.values())}


def _xor_pack(rows: pd.DataFrame, o: Options) -> bytes:
    check(len(rows) == 1, "a frame holds one shard: add shard to the keys")
    one = rows.iloc[0]
    segment, wide = int(one["segment"]), o["bits"] == 16
    return struct.pack("<4sBBBBIIIIQ", b"XOR1", 1, o["bits"], wide, 0, int(one["n"]), segment, int(one["seed"]), 3 * segment, 0) + bytes(one["table"])


def _xor_unpack(raw: bytes, o: Options) -> dict[str, Sequence]:
    (bits, _, _, n, segment, seed, size, _), body = _head("<4sBBBBIIIIQ", raw, b"XOR1")
    if size != 3 * segment:
        raise DeserializationError("segments don't fill the table")
    return {"n": [n], "seed": [seed], "segment": [segment], "table": [_sized(body, size * bits // 8)]}


_CELL = np.dtype([("count", "<i4"), ("key_sum", "<u8"), ("value_sum", "<u8"), ("check_sum", "<u4")])


def _iblt_pack(rows: pd.DataFrame, o: Options) -> bytes:
    table = np.zeros(o["cells"], _CELL)
    at = rows["cell"].to_numpy(np.int64)
    for c in ("count", "check_sum"):
        table[c][at] = rows[c].to_numpy(np.int64)
    for c in ("key_sum", "value_sum"):
        table[c][at] = rows[c].to_numpy(np.int64).view(np.uint64)
    items = max(0, int(table["count"].sum(dtype=np.int64)) // o["hashes"])
    return struct.pack("<4sBBHIIII", b"IBL1", 1, o["hashes"], 0, o["cells"], items, o["seed"], 0) + table.tobytes()


def _iblt_unpack(raw: bytes, o: Options) -> dict[str, Sequence]:
    (_, _, cells, _, _, _), body = _head("<4sBBHIIII", raw, b"IBL1")
    table = np.frombuffer(_sized(body, cells * _CELL.itemsize), _CELL)
    at = np.flatnonzero(table != np.zeros((), _CELL))
    found = table[at]
    return {"cell": at, "count": found["count"], "key_sum": found["key_sum"].astype("<u8").view(np.int64), "value_sum": found["value_sum"].astype("<u8").view(np.int64), "check_sum": found["check_sum"].astype(np.int64)}


# --- the table of families ------------------------------------------------------------------------


def _simple(fmt: str, *names: str) -> tuple[Callable[[Options], bytes], Callable[[bytes], Options]]:
    """Parameters that are options in this order; names with _ are zero fillers."""

    def write(o: Options) -> bytes:
        return struct.pack(fmt, *(0 if n == "_" else PARAM_HASH.get(str(o["strategy"]), 2) if n == "hash" else o[n] for n in names))

    def read(raw: bytes) -> Options:
        return {n: v for n, v in zip(names, _fields(fmt, raw), strict=True) if n not in ("_", "hash")}

    return write, read


def _cms_options(raw: bytes) -> Options:
    """Seven bytes without a hash, or eight."""
    return dict(zip(("width", "depth", "counter_bits"), _fields("<IHB" if len(raw) == 7 else "<IHBB", raw), strict=False))


def _bloom_params(o: Options) -> bytes:
    return struct.pack("<IHI", *bloom_size(o["capacity"], o["fpr"]), o["seed"])


LAYOUTS = {
    "hll": Layout("bucket int, value int", lambda rows, o: struct.pack("<BBH", 1, o["p"], 0) + _dense(rows, o["p"]), _hll_unpack, *_simple("<BB", "p", "hash")),
    "ull": Layout("bucket int, value int", lambda rows, o: struct.pack("<4sBBH", b"ULL1", 1, o["p"], 0) + _dense(rows, o["p"]), _ull_unpack, *_simple("<BB", "p", "hash")),
    "cms": Layout("row int, slot int, count long", _cms_pack, _cms_unpack, _simple("<IHBB", "width", "depth", "counter_bits", "hash")[0], _cms_options),
    "theta": Layout("hash long, theta long", _theta_pack, _theta_unpack, *_simple("<IB", "k", "hash")),
    "kll": Layout("state binary", _compact_state, _compact_rows, *_simple("<I", "k")),
    "req": Layout("state binary", _compact_state, _compact_rows, *_simple("<IB", "k", "high")),
    "ddsketch": Layout("bin int, count long, low double, high double", _ddsketch_pack, _ddsketch_unpack, *_simple("<d", "alpha")),
    "frequent_items": Layout("item string, count long, error long", _frequent_pack, _frequent_unpack, *_simple("<IB", "k", "_")),
    "misra_gries": Layout("item string, count long", _misra_pack, _misra_unpack, *_simple("<IB", "k", "_")),
    "bloom": Layout("pos long", _bloom_pack, _bloom_unpack, _bloom_params, _simple("<IHI", "bit_count", "hashes", "seed")[1]),
    "quotient": Layout("q long, r long", _quotient_pack, _quotient_unpack, *_simple("<BBIB", "q", "r", "seed", "_")),
    "cqf": Layout("q long, r long, count long", _cqf_pack, _cqf_unpack, *_simple("<BBI", "q", "r", "seed")),
    "cuckoo": Layout("pair long, fp long, count long", _cuckoo_pack, _cuckoo_unpack, lambda o: struct.pack("<IBBI", cuckoo_buckets(o["capacity"], o["slots"]), o["bits"], o["slots"], o["seed"]), _simple("<IBBI", "buckets", "bits", "slots", "seed")[1]),
    "xor": Layout("n long, seed int, segment int, table binary", _xor_pack, _xor_unpack, lambda o: struct.pack("<BBI", o["bits"], o["bits"] == 16, o["seed"]), _simple("<BBI", "bits", "_", "seed")[1]),
    "iblt": Layout("cell int, count long, key_sum long, value_sum long, check_sum long", _iblt_pack, _iblt_unpack, *_simple("<BBII", "hashes", "_", "seed", "cells")),
}

#: What isn't given to to_frames.
DEFAULTS: dict[str, Options] = {
    "hll": {"p": 14},
    "ull": {"p": 14},
    "cms": {"width": 2048, "depth": 5, "counter_bits": 32},
    "theta": {"k": 4096},
    "kll": {"k": 200},
    "req": {"k": 12, "high": 1},
    "ddsketch": {"alpha": 0.01},
    "frequent_items": {"k": 10},
    "misra_gries": {"k": 10},
    "bloom": {"capacity": 10_000, "fpr": 0.01},
    "quotient": {"q": 16, "r": 8},
    "cqf": {"q": 16, "r": 8},
    "cuckoo": {"capacity": 10_000, "bits": 8, "slots": 4, "kicks": 500},
    "xor": {"bits": 8},
    "iblt": {"cells": 1000, "hashes": 3},
}


#: Families that hash nothing; their frames carry wire byte 0.
HASHLESS = {"kll", "req", "ddsketch", "frequent_items", "misra_gries"}


def _given(family: str, strategy: str, seed: int, options: Options) -> Options:
    check(family in LAYOUTS, f"no family {family}")
    unknown = set(options) - set(DEFAULTS[family]) - {"n"}
    check(not unknown, f"{family} has no {sorted(unknown)}")
    return DEFAULTS[family] | {"strategy": strategy, "seed": seed} | options


def to_frame(family: str, rows: pd.DataFrame, strategy: str = "md5_64", seed: int = 0, **options) -> bytes:
    """One group's state rows as a frame."""
    o = _given(family, strategy, seed, options)
    if family == "xor" and len(rows) == 1:
        o["seed"] = int(rows["seed"].iloc[0])  # the one that building ended with
    layout = LAYOUTS[family]
    wire = "phash2" if family in HASHLESS else strategy if strategy in codec.WIRE else "custom"
    return codec.encode(codec.Frame(family, layout.params(o), layout.pack(rows, o), wire, seed))


def from_frame(raw: bytes) -> tuple[str, Options, pd.DataFrame]:
    """(family, options with strategy and seed, state rows) of a frame of version 1 or 2."""
    frame = codec.decode(raw)
    layout = LAYOUTS[frame.family]
    options = {"strategy": frame.strategy, "seed": frame.seed} | layout.options(frame.params)
    try:
        return frame.family, options, pd.DataFrame(layout.unpack(frame.state, options))
    except (struct.error, ValueError, IndexError) as e:
        raise e if isinstance(e, DeserializationError) else DeserializationError(f"{frame.family} state: {e}") from e


def to_frames(state: DataFrame, family: str, by: Sequence[str] = (), strategy: str = "md5_64", seed: int = 0, **options) -> DataFrame:
    """(by..., frame): one row a group of the state rows; a group without rows has none.

    Filters of fingerprints that don't fit the slots of one frame take several: their rows together are the state.

    Hashes without a wire byte are written as custom.  For frequent_items and misra_gries, n is the
    stream's length where it isn't the counts' sum.  xor takes its shard among ``by``."""
    _given(family, strategy, seed, options)
    keys = [f"`{b}` {state.schema[b].dataType.simpleString()}" for b in by]
    wanted = [c.split()[0] for c in LAYOUTS[family].columns.split(", ")]

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"frame": _fitting(family, pdf[wanted], strategy, seed, options)})
        for b in reversed(by):
            out.insert(0, b, [pdf[b].iloc[0]] * len(out))
        return out

    rows, parts = state.select(*by, *wanted), []
    if family in SLOTS:
        rows, parts = _dealt(rows, by, wanted, SLOTS[family](DEFAULTS[family] | options)), ["_part"]
    return rows.groupBy(*by, *parts).applyInPandas(pack, ", ".join([*keys, "frame binary"]))


#: Slots of a frame of the families whose rows may be more than one frame holds.
SLOTS: dict[str, Callable[[Options], int]] = {
    "quotient": lambda o: 1 << o["q"],
    "cqf": lambda o: 1 << o["q"],
    "cuckoo": lambda o: cuckoo_buckets(o["capacity"], o["slots"]) * o["slots"],
}


def _dealt(rows: DataFrame, by: Sequence[str], wanted: Sequence[str], room: int) -> DataFrame:
    """Rows with _part: 0 in groups that fit one frame, else as many parts as fill four fifths of a frame each."""
    used = F.sum("count") if "count" in wanted else F.count("*")
    sizes = rows.groupBy(*by).agg(used.alias("_used")).select(*(F.col(b).alias(f"_by{i}") for i, b in enumerate(by)), "_used")
    same = reduce(Column.__and__, (F.col(b).eqNullSafe(F.col(f"_by{i}")) for i, b in enumerate(by)), F.lit(True))
    parts = F.when(F.col("_used") <= room, 1).otherwise(F.ceil(F.col("_used") / (0.8 * room)))
    both = rows.join(sizes if by else F.broadcast(sizes), same)
    return both.select(*by, *wanted, F.pmod(F.xxhash64(*wanted[:2]), parts).alias("_part"))


def _fitting(family: str, rows: pd.DataFrame, strategy: str, seed: int, options: Options) -> list[bytes]:
    """The rows' frame, or those of halves while they don't fit; a single row is halved by its count."""
    try:
        return [to_frame(family, rows, strategy, seed, **options)]
    except InvalidOption:
        single = len(rows) == 1
        if family not in SLOTS or single and (family == "quotient" or int(rows["count"].iloc[0]) < 2):
            raise
        half = rows["count"] // 2 if single else None
        halves = [rows.assign(count=half), rows.assign(count=rows["count"] - half)] if single else [rows.iloc[::2], rows.iloc[1::2]]
        return [frame for h in halves for frame in _fitting(family, h, strategy, seed, options)]


def from_frames(frames: DataFrame, family: str, by: Sequence[str] = (), col: str = "frame") -> DataFrame:
    """(by..., state rows) of frames; null frames hold nothing, another family or a damaged frame raises."""
    check(family in LAYOUTS, f"no family {family}")
    keys = [f"`{b}` {frames.schema[b].dataType.simpleString()}" for b in by]
    wanted = [c.split()[0] for c in LAYOUTS[family].columns.split(", ")]

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(len(batch)):
                found, _, rows = from_frame(bytes(batch["_frame"].iloc[i]))
                if found != family:
                    raise DeserializationError(f"a frame of {found}, not {family}")
                if family == "ddsketch":
                    rows["bin"] = rows["bin"].astype("Int64")
                for at, b in enumerate(by):
                    rows.insert(at, b, [batch[b].iloc[i]] * len(rows))
                yield rows[[*by, *wanted]]

    read = frames.where(F.col(col).isNotNull()).select(*by, F.col(col).alias("_frame"))
    rows = read.mapInPandas(unpack, ", ".join([*keys, LAYOUTS[family].columns]))
    if family in ("cqf", "cuckoo"):  # a fingerprint's occurrences may lie in several frames
        rows = rows.groupBy(*by, *wanted[:2]).agg(F.sum("count").alias("count"))
    return rows


# --- chains ---------------------------------------------------------------------------------------


def pack_chain(stages: Sequence[bytes], adjuncts: Sequence[bytes] = ()) -> bytes:
    """Frames of a chain's stages and of its adjuncts, in order."""
    if len(stages) > 255 or len(adjuncts) > 255:
        raise InvalidChainComposition("a chain has 255 stages at most")
    return struct.pack("<4sBBBB", b"FCN1", 1, len(stages), len(adjuncts), 0) + b"".join(struct.pack("<I", len(f)) + f for f in (*stages, *adjuncts))


def unpack_chain(raw: bytes) -> tuple[list[bytes], list[bytes]]:
    """(stages, adjuncts)"""
    (stages, adjuncts, _), body = _head("<4sBBBB", raw, b"FCN1")
    found, at = [], 0
    for _ in range(stages + adjuncts):
        if at + 4 > len(body):
            raise DeserializationError("the chain is cut off")
        size = int.from_bytes(body[at : at + 4], "little")
        at += 4 + size
        if at > len(body):
            raise DeserializationError("the chain is cut off")
        found.append(body[at - size : at])
    _sized(body, at)
    return found[:stages], found[stages:]


# --- the compact Theta format -----------------------------------------------------------------------

#: Serial version, family, flags, the usual seed, and the least and greatest log2 of k.
COMPACT_VERSION, COMPACT_FAMILY = 3, 3
READ_ONLY, EMPTY, COMPACT, ORDERED, SINGLE = 2, 4, 8, 16, 32
COMPACT_SEED, LOG_K = 9001, (4, 26)


def seed_hash(seed: int = COMPACT_SEED) -> int:
    """Low 16 bits of Murmur3 over the seed as eight bytes."""
    return murmur3_128(struct.pack("<Q", seed))[0] & 0xFFFF


def theta_to_compact(hashes: Sequence[int], theta: int, k: int, seed: int = COMPACT_SEED) -> bytes:
    """Unsigned hashes below theta; one, two or three longs go before them: none or a single one, exact, estimating."""
    n, exact = len(hashes), theta == MASK
    longs, kind = (1, EMPTY) if n == 0 else (1, ORDERED | SINGLE) if n == 1 and exact else (2 if exact else 3, ORDERED)
    head = struct.pack("<BBBBBBH", longs, COMPACT_VERSION, COMPACT_FAMILY, k.bit_length() - 1, 0, COMPACT | READ_ONLY | kind, seed_hash(seed))
    if longs > 1:
        head += struct.pack("<II", n, 0)
    if longs > 2:
        head += struct.pack("<Q", theta)
    return head + np.sort(np.asarray(hashes, np.uint64)).astype("<u8").tobytes()


def theta_from_compact(raw: bytes, seed: int | None = COMPACT_SEED) -> tuple[int, int, list[int]]:
    """(k, theta, hashes); seed None takes any seed's sketch."""
    if len(raw) < 8:
        raise DeserializationError("the sketch is cut off")
    longs, version, family, log_k, _, flags, found = struct.unpack_from("<BBBBBBH", raw)
    if (version, family) != (COMPACT_VERSION, COMPACT_FAMILY) or not LOG_K[0] <= log_k <= LOG_K[1]:
        raise DeserializationError(f"serial version {version}, family {family}, log2 of k {log_k}")
    if not flags & COMPACT or flags & 1:
        raise DeserializationError("only compact little-endian sketches are read")
    if seed is not None and found != seed_hash(seed):
        raise DeserializationError(f"hashed with another seed than {seed}")
    if flags & EMPTY:
        return 1 << log_k, MASK, []
    if flags & SINGLE:
        n, theta, at = 1, MASK, 8
    elif longs in (2, 3) and len(raw) >= 8 * longs:
        n, theta, at = struct.unpack_from("<I", raw, 8)[0], struct.unpack_from("<Q", raw, 16)[0] if longs == 3 else MASK, 8 * longs
    else:
        raise DeserializationError(f"{longs} longs before the entries")
    if len(raw) < at + 8 * n:
        raise DeserializationError("the entries are cut off")
    return 1 << log_k, theta, np.frombuffer(raw, "<u8", n, at).tolist()


def theta_to_compacts(state: DataFrame, by: Sequence[str] = (), k: int = 4096, seed: int = COMPACT_SEED) -> DataFrame:
    """(by..., compact): one sketch a group."""

    @F.udf("binary")
    def pack(hashes: list, theta: int) -> bytes:
        return theta_to_compact([h & MASK for h in hashes], theta & MASK, k, seed)

    return theta_compact(state, by).select(*by, pack("hashes", "theta").alias("compact"))


def theta_from_compacts(sketches: DataFrame, by: Sequence[str] = (), col: str = "compact", seed: int | None = COMPACT_SEED) -> DataFrame:
    """(by..., hash, theta) of each sketch."""

    @F.udf("theta long, hashes array<long>")
    def unpack(raw: bytes) -> tuple:
        _, theta, hashes = theta_from_compact(bytes(raw), seed)
        return signed(theta), [signed(h) for h in hashes]

    read = sketches.where(F.col(col).isNotNull()).select(*by, unpack(col).alias("_c"))
    return read.select(*by, F.explode("_c.hashes").alias("hash"), F.col("_c.theta").alias("theta"))
