"""Token-id shards with Elias-Fano document boundaries.

A shard file holds the concatenated ids of documents in ascending id order:

    "EFTK" u8 version=1, u8 id width (2 or 4 bytes), u8 low bits l, u8 0,
    u64 documents n, u64 ids u, u64 words of the high-bits vector, u64 select samples,
    i64[n] document ids, u8[n] whether the id is null,
    u64[...] low bits of the n boundaries, l bits each,
    u64[words] high bits in unary, u64[samples] the place of every 256th set bit,
    ids, little-endian.

Boundary i is the end of document i.  Elias-Fano keeps its low l = log2(u / n) bits as
they are and the rest as a unary-coded bit vector: about 2 + log2(u / n) bits a document
instead of 64.  `select` finds one boundary from the sample before it.

Documents are range-partitioned and sorted by id, so a partition is one shard and shard
order is id order.  Tasks write through Arrow's file systems under a name of their own
attempt; the file that counts is the one in the manifest, so a task that runs again does no
harm.  A shard's base offset is a running sum over the manifest, one row per shard.

Defined results: null or empty text is its end id alone; a null id sorts first; equal ids
are in the order of their texts.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, ROLLING, U64, Workspace, byte_chunks, byte_view, mix64, word_spans
from .token_prefix import _safe_cuts

HEADER = struct.Struct("<4sBBBBQQQQ")
SAMPLE = 256
CACHE_WORDS = 1 << 20
TOGETHER = 512


# --- Elias-Fano -------------------------------------------------------------------------------


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Values of width bits each, one after another in 64-bit words."""
    bits = ((values[:, None] >> np.arange(width, dtype=U64)) & U64(1)).astype(np.uint8).ravel() if width else np.zeros(0, np.uint8)
    raw = np.packbits(bits, bitorder="little")
    return np.r_[raw, np.zeros(-len(raw) % 8, np.uint8)].view(U64)


def encode_boundaries(ends: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(l, low, high, samples) of a non-decreasing sequence."""
    n = len(ends)
    if not n:
        return 0, *[np.zeros(0, U64)] * 3
    ends = ends.astype(U64)
    low_bits = max(0, int(int(ends[-1]) // n).bit_length() - 1)
    place = (ends >> U64(low_bits)) + np.arange(n, dtype=U64)
    bits = np.zeros(-(-(int(place[-1]) + 1) // 64) * 64, np.uint8)
    bits[place.astype(np.int64)] = 1
    return low_bits, pack_bits(ends & U64((1 << low_bits) - 1), low_bits), np.packbits(bits, bitorder="little").view(U64), place[::SAMPLE]


class Boundaries:
    """Reads the sequence back."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        bit = i * self.low_bits
        word, shift = bit >> 6, (bit & 63).astype(U64)
        after = np.minimum(word + 1, len(self.low) - 1)
        spill = np.where(shift > 0, self.low[after] << (U64(64) - np.maximum(shift, U64(1))), U64(0))
        return (((self.low[word] >> shift) | spill) & U64((1 << self.low_bits) - 1)).astype(np.int64)

    def select(self, i: int) -> int:
        """Element i: from the sample before it, word by word to its set bit."""
        place, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        word = place >> 6
        bits = int(self.high[word]) >> (place & 63) << (place & 63)
        while (ones := bits.bit_count()) <= left:
            left -= ones
            word += 1
            bits = int(self.high[word])
        for _ in range(left):
            bits &= bits - 1
        found = (word << 6) + (bits & -bits).bit_length() - 1
        return (found - i) << self.low_bits | int(self._low(np.array([i]))[0])

    def all(self) -> np.ndarray:
        place = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))[: self.n]
        i = np.arange(self.n)
        return ((place - i) << self.low_bits) | self._low(i)


def pack_shard(doc_ids: np.ndarray, null: np.ndarray, lengths: np.ndarray, ids: np.ndarray, width: int) -> bytes:
    low_bits, low, high, samples = encode_boundaries(np.cumsum(lengths))
    head = HEADER.pack(b"EFTK", 1, width, low_bits, 0, len(doc_ids), len(ids), len(high), len(samples))
    return b"".join((head, doc_ids.astype("<i8").tobytes(), null.astype(np.uint8).tobytes(), low.astype("<u8").tobytes(), high.astype("<u8").tobytes(), samples.astype("<u8").tobytes(), ids.astype(f"<u{width}").tobytes()))


def unpack_shard(raw: bytes) -> tuple[np.ndarray, np.ndarray, Boundaries, np.ndarray]:
    """(document ids, nulls, boundaries, ids)."""
    magic, version, width, low_bits, _, n, u, words, samples = HEADER.unpack_from(raw)
    if (magic, version) != (b"EFTK", 1):
        raise ValueError("not a shard of token ids")
    at, out = HEADER.size, []
    for kind, count in (("<i8", n), ("u1", n), ("<u8", -(-n * low_bits // 64)), ("<u8", words), ("<u8", samples), (f"<u{width}", u)):
        out.append(np.frombuffer(raw, kind, count, at))
        at += out[-1].nbytes
    return out[0], out[1], Boundaries(n, low_bits, *out[2:5]), out[5]


# --- encoding ---------------------------------------------------------------------------------


class WordEncoder:
    """Ids of texts from a lower-casing tokenizer that never joins words across ASCII blanks.

    Distinct words go to the library once.  Words are looked up in lower case, and cut between a
    letter and an ASCII mark, where the tokenizer cuts as well; neither is done where a special
    token's string is about.  Words of letters only are encoded together, and told apart again by
    the library's word numbers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self._empty()

    def _empty(self) -> None:
        self.keys, self.slot = np.zeros(0, U64), np.zeros(0, np.int64)
        self.pool, self.starts = np.zeros(0, f"u{self.width}"), np.zeros(1, np.int64)

    def _library(self, words: list[str], letters: np.ndarray) -> list[list[int]]:
        found: list[list[int]] = [[]] * len(words)
        rest = np.flatnonzero(~letters).tolist()
        easy = np.flatnonzero(letters)
        groups = [easy[i : i + TOGETHER] for i in range(0, len(easy), TOGETHER)]
        for group, e in zip(groups, self.tokenizer.encode_batch([" ".join(words[i] for i in g) for g in groups], add_special_tokens=False), strict=True):
            number = np.array(e.word_ids)
            cut = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
            if len(cut) != len(group):
                rest += group.tolist()
                continue
            ids = e.ids
            for i, a, b in zip(group.tolist(), cut.tolist(), [*cut[1:].tolist(), len(ids)], strict=True):
                found[i] = ids[a:b]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False), strict=True):
            found[i] = e.ids
        return found

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of texts that lie one after another in data, each with its end id."""
        begin, end = word_spans(data, offsets[:-1])
        lower = LOWER[data]
        plain = np.zeros(len(data), bool)
        if not any(x in lower.tobytes() for x in self.specials):
            data = lower
            _, plain, mark = _safe_cuts(data, True)
            edge = np.flatnonzero(plain[:-1] & mark[1:] & (data[1:] != 0x27)) + 1 if len(data) else begin
            begin, end = np.sort(np.r_[begin, edge]), np.sort(np.r_[end, edge])
        keys = mix64(ROLLING.slices(ROLLING.sums(data), begin, end) + (end - begin).astype(U64))
        distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) > CACHE_WORDS:
            self._empty()
        at = np.minimum(np.searchsorted(self.keys, distinct), max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[at] != distinct if len(self.keys) else np.ones(len(distinct), bool))
        if len(new):
            view = memoryview(data)
            words = [str(view[begin[i] : end[i]], "utf-8") for i in first[new]]
            letters = np.add.reduceat(plain, begin, dtype=np.int64)[first[new]] == (end - begin)[first[new]]
            found = self._library(words, letters)
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self.pool = np.r_[self.pool, np.fromiter((t for ids in found for t in ids), self.pool.dtype, int(sizes.sum()))]
            slot = len(self.starts) - 1 + np.arange(len(sizes))
            self.starts = np.r_[self.starts, self.starts[-1] + np.cumsum(sizes)]
            named = np.r_[self.keys, distinct[new]]
            order = np.argsort(named)
            self.keys, self.slot = named[order], np.r_[self.slot, slot][order]
            at = np.searchsorted(self.keys, distinct)
        slot = self.slot[at][back] if len(distinct) else np.zeros(0, np.int64)
        size = self.starts[slot + 1] - self.starts[slot]
        total = np.r_[0, np.cumsum(size)]
        bounds = total[np.searchsorted(begin, offsets)]
        lengths = np.diff(bounds) + 1
        ids = np.full(int(lengths.sum()), end_id, self.pool.dtype)
        text = np.ones(len(ids), bool)
        text[np.cumsum(lengths) - 1] = False
        ids[text] = self.pool[np.repeat(self.starts[slot] - total[:-1], size) + np.arange(total[-1])]
        return ids, lengths


@cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _write_stage(path: str, base: str, end_id: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(base)
        store.create_dir(root, recursive=True)
        encode, part, serial = encoder(path), TaskContext.get().partitionId(), 0
        docs, null, lengths, ids, held = [], [], [], [], 0

        def write() -> pa.RecordBatch:
            name = f"{part:08d}-{serial:06d}-{uuid.uuid4().hex[:8]}.eftk"
            size = np.concatenate(lengths)
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(pack_shard(np.concatenate(docs), np.concatenate(null), size, np.concatenate(ids), encode.width))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "serial": pa.array([serial], pa.int32()), "name": [name], "n_ids": pa.array([int(size.sum())], pa.int64())})

        for batch in batches:
            data, offsets = byte_view(batch.column(1))
            for i, j in byte_chunks(offsets):
                found, size = encode.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], end_id)
                column = batch.column(0).slice(i, j - i)
                docs.append(np.asarray(column.fill_null(0)))
                null.append(np.asarray(column.is_null()))
                lengths.append(size)
                ids.append(found)
                held += len(found)
                if held >= limit:
                    yield write()
                    serial += 1
                    docs, null, lengths, ids, held = [], [], [], [], 0
        if docs:
            yield write()

    return run, "part int, serial int, name string, n_ids long"


def _read_stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for base, raw in zip(batch.column("base").to_pylist(), batch.column("content"), strict=True):
            docs, null, boundaries, ids = unpack_shard(raw.as_buffer())
            ends = boundaries.all()
            starts = np.r_[0, ends[:-1]][: len(ends)]
            for i in range(0, len(docs), 500):
                a, b = starts[i : i + 500], ends[i : i + 500]
                raw_ids = [ids[x:y].astype("<u4").tobytes() for x, y in zip(a, b, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs[i : i + 500], mask=null[i : i + 500] > 0), pa.array(base + a), pa.array(b - a), pa.array(raw_ids, pa.binary())], ["id", "start", "n_tokens", "ids"])


def write_shards(df: DataFrame, path: str, base: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = 1 << 21) -> DataFrame:
    """Write the shards under base; the manifest (part, serial, name, n_ids) says which files count."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    run, schema = _write_stage(path, base, end_id, shard_ids)
    return docs.repartitionByRange("id").sortWithinPartitions("id", "text").mapInArrow(run, schema)


def read_shards(manifest: DataFrame, base: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids): ids are 32-bit little-endian, start counts the ids of all documents before."""
    before = F.sum("n_ids").over(Window.orderBy("part", "serial").rowsBetween(Window.unboundedPreceding, -1))
    placed = manifest.select("name", F.coalesce(before, F.lit(0)).alias("base"))
    files = manifest.sparkSession.read.format("binaryFile").load(base).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return files.join(placed, "name").select("base", "content").mapInArrow(_read_stage, "id long, start long, n_tokens long, ids binary").withColumnRenamed("id", id_col)


def token_shards(df: DataFrame, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write shards into the shared folder and return their documents as read back."""
    ws = Workspace(df.sparkSession, "token-shards")
    base = ws.folder("shards")
    manifest = ws.save(write_shards(df, path, base, end_id, id_col, text_col), "manifest")
    return read_shards(manifest, base, id_col)
