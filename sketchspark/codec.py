"""Binary frames: header, metadata, payload and CRC-32C; and states packed from rows.

Fixed values: magic "EXSK", version 2, family numbers, little-endian fields as below.

    magic 4, version u8 = 2, family u8, family version u8, flags u8, metadata size u16 + 14,
    metadata (block version, hash, seed u64, family, family version, backend, flags, extension u16),
    payload size u32, payload (params size u32, params, state), crc32c u32
"""

from __future__ import annotations

import struct
from dataclasses import dataclass
from functools import cache

from .errors import DeserializationError, NotImplementedForFormat
from .functions.hashing import WIRE

FAMILIES = {"hll": 1, "cms": 2, "theta": 3, "kll": 4, "ddsketch": 5, "frequent_items": 6, "bloom": 7, "cuckoo": 8, "quotient": 9, "cqf": 10, "xor": 11, "iblt": 12, "req": 13, "misra_gries": 14, "ull": 15}


@cache
def _crc_table() -> tuple[int, ...]:
    out = []
    for b in range(256):
        for _ in range(8):
            b = b >> 1 ^ (0x82F63B78 if b & 1 else 0)
        out.append(b)
    return tuple(out)


def crc32c(data: bytes, crc: int = 0) -> int:
    """Castagnoli; crc32c(b"123456789") is 0xE3069283."""
    table, crc = _crc_table(), crc ^ 0xFFFFFFFF
    for b in data:
        crc = crc >> 8 ^ table[(crc ^ b) & 255]
    return crc ^ 0xFFFFFFFF


@dataclass(frozen=True)
class Frame:
    family: str
    params: bytes
    state: bytes
    strategy: str = "phash2"
    seed: int = 0
    extension: bytes = b""


def encode(frame: Frame) -> bytes:
    number = FAMILIES[frame.family]
    meta = struct.pack("<BBQBBBBH", 1, WIRE.get(frame.strategy, 255), frame.seed, number, 1, 0, 0, len(frame.extension)) + frame.extension
    payload = struct.pack("<I", len(frame.params)) + frame.params + frame.state
    raw = struct.pack("<4sBBBBH", b"EXSK", 2, number, 1, 0, 14 + len(meta)) + meta + struct.pack("<I", len(payload)) + payload
    return raw + struct.pack("<I", crc32c(raw))


def decode(raw: bytes) -> Frame:
    """Check and take apart; versions 1 and 2."""
    if len(raw) < 6 or raw[:4] != b"EXSK":
        raise DeserializationError("no frame")
    names = {n: f for f, n in FAMILIES.items()}
    if raw[4] == 1:
        if len(raw) < 14 or raw[5] not in names:
            raise DeserializationError("a damaged frame of version 1")
        (n,) = struct.unpack_from("<I", raw, 7) if len(raw) >= 11 else (0,)
        return _version1(raw, names[raw[5]], n)
    if raw[4] != 2:
        raise DeserializationError(f"version {raw[4]}")
    if len(raw) < 38:
        raise DeserializationError("the frame is cut off")
    if struct.unpack("<I", raw[-4:])[0] != crc32c(raw[:-4]):
        raise DeserializationError("the checksum doesn't match")
    family, _, flags, size = struct.unpack_from("<BBBH", raw, 5)
    if family not in names or flags:
        raise DeserializationError(f"family {family}, flags {flags}")
    block, wire, seed, inner, _, _, _, extra = struct.unpack_from("<BBQBBBBH", raw, 10)
    if block != 1 or inner != family or size != 30 + extra:
        raise DeserializationError("the metadata contradict the header")
    extension = raw[26 : 26 + extra]
    at = 26 + extra
    (length,) = struct.unpack_from("<I", raw, at)
    payload = raw[at + 4 : -4]
    if len(payload) != length or length < 4:
        raise DeserializationError("the payload's size doesn't match")
    (n,) = struct.unpack_from("<I", payload)
    if 4 + n > length:
        raise DeserializationError("the parameters' size doesn't match")
    strategy = {v: k for k, v in WIRE.items()}.get(wire)
    if strategy is None:
        raise DeserializationError(f"hash {wire}")
    return Frame(names[family], payload[4 : 4 + n], payload[4 + n :], strategy, seed, extension)


def _version1(raw: bytes, family: str, n: int) -> Frame:
    if 11 + n + 4 > len(raw):
        raise DeserializationError("a frame of version 1 is cut off")
    (m,) = struct.unpack_from("<I", raw, 11 + n)
    if 15 + n + m != len(raw):
        raise DeserializationError("a frame of version 1 has another size")
    return Frame(family, raw[11 : 11 + n], raw[15 + n :])


def hll_state(registers: dict[int, int], p: int) -> bytes:
    body = bytearray(1 << p)
    for bucket, value in registers.items():
        body[bucket] = value
    return struct.pack("<BBH", 1, p, 0) + bytes(body)


def ull_state(registers: dict[int, int], p: int) -> bytes:
    body = bytearray(1 << p)
    for bucket, value in registers.items():
        body[bucket] = value
    return struct.pack("<4sBBH", b"ULL1", 1, p, 0) + bytes(body)


def theta_state(hashes: list[int], theta: int, k: int) -> bytes:
    return struct.pack("<BIQI", 1, k, theta, len(hashes)) + struct.pack(f"<{len(hashes)}Q", *sorted(hashes))


def frequent_state(rows: list[tuple[bytes, int, int]], k: int, n: int) -> bytes:
    body = b"".join(struct.pack("<I", len(i)) + i + struct.pack("<QQ", c, e) for i, c, e in sorted(rows))
    return struct.pack("<4sBBHIQIQ", b"FI1\0", 1, 0, 0, k, n, len(rows), 0) + body


def serialize_foreign(family: str) -> bytes:
    raise NotImplementedForFormat(f"{family} has no foreign format here; Spark's own hll_*, theta_* and kll_* functions write it")
