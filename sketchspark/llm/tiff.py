"""TIFF columns: write and read baseline images with strips or tiles.

`pages` walks the chain of image directories of each file (II or MM byte order), decodes
uncompressed, PackBits, LZW and deflate strips or tiles, undoes the horizontal predictor,
and gives one row per page.  `encode_payload` stores bytes losslessly as 8-bit grey pages
of 64 columns; a payload over ``page_rows`` rows goes on in further pages.

Defined results: a null file has no pages; a file that is damaged, truncated, cyclic or
uses a feature outside of the above gives one row with page -1 and the reason in ``error``;
the pages before the damage are given as well.  Repeated rows are read again each.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_view

#: Fixed values of the format: tags, compressions, field types' sizes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 322, 323, 324, 325
NONE, LZW, ADOBE_DEFLATE, PACKBITS, DEFLATE = 1, 5, 8, 32773, 32946
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8}
COLUMNS = 64
MAX_PAGES = 1 << 16


class TiffError(ValueError):
    """The file isn't a TIFF that this module reads."""


# --- compressions -----------------------------------------------------------------------------


def packbits_decode(raw: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(raw) and len(out) < size:
        n = raw[i]
        i += 1
        if n < 128:
            out += raw[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += raw[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


def packbits_encode(data: bytes) -> bytes:
    values = np.frombuffer(data, np.uint8)
    if not len(values):
        return b""
    start = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    out, literal = bytearray(), bytearray()

    def flush() -> None:
        for i in range(0, len(literal), 128):
            part = literal[i : i + 128]
            out.append(len(part) - 1)
            out.extend(part)
        literal.clear()

    for a, n in zip(start.tolist(), np.diff(np.r_[start, len(values)]).tolist(), strict=True):
        if n < 3:
            literal.extend(data[a : a + n])
            continue
        flush()
        while n:
            k = min(n, 128)
            out.extend((257 - k, data[a]) if k > 1 else (0, data[a]))
            n -= k
    flush()
    return bytes(out)


def lzw_decode(raw: bytes, size: int) -> bytes:
    """TIFF's LZW: codes from the high bit on, 256 clears, 257 ends, widths change one code early."""
    out, table = bytearray(), []
    bits = held = at = 0
    width, last = 9, None
    while len(out) < size:
        while bits < width:
            if at >= len(raw):
                return bytes(out)
            held = (held << 8 | raw[at]) & 0xFFFFFF
            at += 1
            bits += 8
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [], 9, None
            continue
        if code < 256:
            entry = bytes((code,))
        elif code - 258 < len(table):
            entry = table[code - 258]
        elif last is not None and code - 258 == len(table):
            entry = last + last[:1]
        else:
            raise TiffError("bad LZW code")
        out += entry
        if last is not None and len(table) < 4096 - 258:
            table.append(last + entry[:1])
        last = entry
        width = 9 if len(table) + 258 < 511 else 10 if len(table) + 258 < 1023 else 11 if len(table) + 258 < 2047 else 12
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    out = bytearray()
    held = bits = 0

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    table: dict[bytes, int] = {}
    width, prefix, sent = 9, b"", 258
    put(256, 9)
    for value in data:
        one = prefix + bytes((value,))
        if len(one) == 1 or one in table:
            prefix = one
            continue
        put(prefix[0] if len(prefix) == 1 else table[prefix], width)
        table[one] = sent
        sent += 1
        prefix = one[-1:]
        width = 9 if sent < 512 else 10 if sent < 1024 else 11 if sent < 2048 else 12
        if sent >= 4094:
            put(prefix[0], width)
            put(256, width)
            table, width, prefix, sent = {}, 9, b"", 258
    if prefix:
        put(prefix[0] if len(prefix) == 1 else table[prefix], width)
        sent += 1
        width = 9 if sent < 512 else 10 if sent < 1024 else 11 if sent < 2048 else 12
    put(257, width)
    if bits:
        put(0, 8 - bits)
    return bytes(out)


def decompress(raw: bytes, compression: int, size: int) -> bytes:
    try:
        if compression == NONE:
            out = raw
        elif compression == PACKBITS:
            out = packbits_decode(raw, size)
        elif compression == LZW:
            out = lzw_decode(raw, size)
        elif compression in (ADOBE_DEFLATE, DEFLATE):
            out = zlib.decompressobj().decompress(raw, size)
        else:
            raise TiffError(f"compression {compression}")
    except zlib.error as e:
        raise TiffError(f"deflate: {e}") from e
    if len(out) < size:
        raise TiffError("a strip or tile is short")
    return out[:size]


def compress(data: bytes, compression: int) -> bytes:
    if compression == NONE:
        return data
    if compression == PACKBITS:
        return packbits_encode(data)
    if compression == LZW:
        return lzw_encode(data)
    return zlib.compress(data, 1)


# --- directories ------------------------------------------------------------------------------


def _numbers(raw: memoryview, order: str, kind: int, count: int, field: bytes | memoryview) -> list[int]:
    size = TYPE_SIZE[kind] * count
    if size > 4:
        (at,) = struct.unpack(order + "I", field)
        field = raw[at : at + size]
    if len(field) < size:
        raise TiffError("a field lies outside of the file")
    return list(struct.unpack(order + str(count) + {1: "B", 3: "H", 4: "I"}[kind], field[:size]))


def directories(raw: memoryview) -> Iterator[tuple[str, dict[int, list[int]]]]:
    """(byte order, numeric fields) of one image directory after another."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(raw[:2]))
    if order is None or len(raw) < 8 or struct.unpack(order + "H", raw[2:4])[0] != 42:
        raise TiffError("no TIFF header")
    (at,) = struct.unpack(order + "I", raw[4:8])
    seen: set[int] = set()
    while at:
        if at in seen or len(seen) >= MAX_PAGES:
            raise TiffError("the directories form a cycle")
        seen.add(at)
        if at + 2 > len(raw):
            raise TiffError("a directory lies outside of the file")
        (n,) = struct.unpack(order + "H", raw[at : at + 2])
        if at + 6 + 12 * n > len(raw):
            raise TiffError("a directory is cut off")
        fields = {}
        for i in range(n):
            tag, kind, count = struct.unpack(order + "HHI", raw[at + 2 + 12 * i : at + 10 + 12 * i])
            if kind in (1, 3, 4):
                fields[tag] = _numbers(raw, order, kind, count, raw[at + 10 + 12 * i : at + 14 + 12 * i])
        yield order, fields
        (at,) = struct.unpack(order + "I", raw[at + 2 + 12 * n : at + 6 + 12 * n])


def decode_page(raw: memoryview, order: str, fields: dict[int, list[int]]) -> np.ndarray:
    """Samples as an array of height, width, samples."""
    one = lambda tag, default: fields.get(tag, [default])[0]
    width, height, samples = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
    bits, compression, predictor = fields.get(BITS, [1]), one(COMPRESSION, 1), one(PREDICTOR, 1)
    if width < 1 or height < 1 or samples < 1 or width * height * samples > 1 << 31:
        raise TiffError("bad image size")
    if len(set(bits)) > 1 or bits[0] not in (8, 16) or one(PLANAR, 1) != 1 or predictor not in (1, 2):
        raise TiffError("an unsupported sample layout")
    kind = np.dtype(f"{order}u{bits[0] // 8}")
    tiled = TILE_OFFSETS in fields
    across, down = (one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    offsets, sizes = (fields.get(t, []) for t in ((TILE_OFFSETS, TILE_BYTES) if tiled else (STRIP_OFFSETS, STRIP_BYTES)))
    if across < 1 or down < 1 or len(offsets) != len(sizes) or len(offsets) < -(-width // across) * -(-height // down):
        raise TiffError("strips or tiles are missing")
    out = np.zeros((height, width, samples), kind.newbyteorder("="))
    part = 0
    for y in range(0, height, down):
        rows = down if tiled else min(down, height - y)
        for x in range(0, width, across):
            at, n = offsets[part], sizes[part]
            part += 1
            if at + n > len(raw):
                raise TiffError("a strip or tile lies outside of the file")
            block = np.frombuffer(decompress(bytes(raw[at : at + n]), compression, rows * across * samples * kind.itemsize), kind).reshape(rows, across, samples)
            if predictor == 2:
                block = np.cumsum(block, axis=1, dtype=out.dtype)
            out[y : y + rows, x : x + across] = block[: height - y, : width - x]
    return out


def decode(raw: bytes | memoryview) -> Iterator[np.ndarray]:
    raw = memoryview(raw)
    for order, fields in directories(raw):
        yield decode_page(raw, order, fields)


def encode(images: list[np.ndarray], compression: int = ADOBE_DEFLATE, predictor: int = 1, tile: tuple[int, int] | None = None, rows_per_strip: int | None = None, order: str = "<") -> bytes:
    """A file of 8- or 16-bit images of (height, width[, samples]); tile is (width, height)."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for image in images:
        image = image[:, :, None] if image.ndim == 2 else image
        height, width, samples = image.shape
        across, down = tile or (width, rows_per_strip or height)
        places, sizes = [], []
        for y in range(0, height, down):
            for x in range(0, width, across):
                block = image[y : y + down, x : x + across]
                if tile:
                    block = np.pad(block, ((0, down - block.shape[0]), (0, across - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.concatenate([block[:, :1], block[:, 1:] - block[:, :-1]], axis=1)
                packed = compress(np.ascontiguousarray(block).astype(image.dtype.newbyteorder(order)).tobytes(), compression)
                places.append(len(out))
                sizes.append(len(packed))
                out += packed
        fields = [(WIDTH, [width]), (HEIGHT, [height]), (BITS, [8 * image.dtype.itemsize] * samples), (COMPRESSION, [compression]), (PHOTOMETRIC, [2 if samples == 3 else 1])]
        fields += [(SAMPLES, [samples])] if tile else [(STRIP_OFFSETS, places), (SAMPLES, [samples]), (ROWS_PER_STRIP, [down]), (STRIP_BYTES, sizes)]
        fields += [(PLANAR, [1]), (PREDICTOR, [predictor])] + ([(TILE_WIDTH, [across]), (TILE_HEIGHT, [down]), (TILE_OFFSETS, places), (TILE_BYTES, sizes)] if tile else [])
        entries = []
        for tag, values in fields:
            kind = 4 if tag in (WIDTH, HEIGHT, STRIP_OFFSETS, ROWS_PER_STRIP, STRIP_BYTES, TILE_OFFSETS, TILE_BYTES) else 3
            body = struct.pack(order + str(len(values)) + ("I" if kind == 4 else "H"), *values)
            if len(body) > 4:
                out += b"\0" * (len(out) % 2)
                body, at = struct.pack(order + "I", len(out)), body
                out += at
            entries.append(struct.pack(order + "HHI", tag, kind, len(values)) + body.ljust(4, b"\0"))
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def encode_payload(payload: bytes, page_rows: int = 1 << 13) -> bytes:
    """Bytes, a positive multiple of 64, as grey pages; deflate without a predictor, as text doesn't vary smoothly."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, COLUMNS)
    return encode([rows[i : i + page_rows] for i in range(0, len(rows), page_rows)], ADOBE_DEFLATE)


# --- DataFrames -------------------------------------------------------------------------------


def _encode_stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = byte_view(batch.column(1))
        view, ids, sizes, out, held = memoryview(data), batch.column(0), np.diff(offsets), [], 0
        first = 0
        for d in range(batch.num_rows):
            raw = bytes(view[offsets[d] : offsets[d + 1]])
            out.append(encode_payload(raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")))
            held += len(out[-1])
            if held > 4 << 20 or d == batch.num_rows - 1:
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(out)), pa.array(sizes[first : d + 1]), pa.array(out, pa.binary())], ["id", "n_bytes", "media"])
                first, out, held = d + 1, [], 0


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8 bytes, zero-padded to a positive multiple of 64, as a TIFF file."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return docs.mapInArrow(_encode_stage, "id long, n_bytes long, media binary").withColumnRenamed("id", id_col)


PAGE = {"page": pa.int32(), "width": pa.int32(), "height": pa.int32(), "samples": pa.int32(), "bits": pa.int32(), "mean": pa.float64(), "pixels": pa.binary(), "error": pa.string()}


def read_pages(media: bytes | None) -> Iterator[tuple]:
    """A row of PAGE for each page."""
    if media is None:
        return
    n = 0
    try:
        for n, image in enumerate(decode(media), 1):
            yield n - 1, image.shape[1], image.shape[0], image.shape[2], 8 * image.dtype.itemsize, float(image.mean()), image.astype(image.dtype.newbyteorder("<"), copy=False).tobytes(), None
        if not n:
            raise TiffError("no image directory")
    except (TiffError, struct.error, KeyError) as e:
        yield -1, None, None, None, None, None, None, str(e) or type(e).__name__


def _pages_stage(kept: list[str], media_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who, rows, held = [], [], 0
            for d, media in enumerate(batch.column(media_col)):
                for row in read_pages(media.as_py()):
                    who.append(d)
                    rows.append(row)
                    held += len(row[6] or b"")
                    if held > 4 << 20:
                        yield page_batch(batch, kept, who, rows)
                        who, rows, held = [], [], 0
            if rows:
                yield page_batch(batch, kept, who, rows)

    return run


def page_batch(batch: pa.RecordBatch, kept: list[str], who: list[int], rows: list[tuple]) -> pa.RecordBatch:
    own = batch.select(kept).take(pa.array(who))
    return pa.RecordBatch.from_arrays([*own.columns, *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PAGE.values(), strict=True))], [*kept, *PAGE])


def pages(df: DataFrame, media_col: str = "media") -> DataFrame:
    """One row per page of each file: df's other columns, then page, width, height, samples, bits, mean, pixels, error."""
    clash = [c for c in df.columns if c in PAGE and c != media_col]
    for c in clash:
        df = df.withColumnRenamed(c, f"_{c}")
    kept = [c for c in df.columns if c != media_col]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != media_col)
    return df.mapInArrow(_pages_stage(kept, media_col), f"{kinds}{', ' if kinds else ''}page int, width int, height int, samples int, bits int, mean double, pixels binary, error string")
