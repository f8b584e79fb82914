"""Fuzzy line deduplication.

1. Lines are normalised: lower case, digits to 0, ASCII marks to blanks, blanks collapsed.
   Lines of which nothing is left stay; all others take part, however short.
2. Equal normalised lines are one line from here on, whatever their number.  A line gets a
   64-bit SimHash over its words and word pairs.
3. Blocks by the pigeonhole principle: a line is cut into blocks where its content says so
   (before a word whose hash is the least of five, in lines of 100 words on of more; in lines of few words, before a byte whose
   trigram is the least within a radius).  A few edits spoil a few blocks and leave the cuts
   elsewhere, so similar lines share a block.  Blocks of less than three words or 20 bytes are
   lengthened, as "of the" would meet all with all.  Lines of 5 to 14 characters
   sign what is left of them without any one or, from 10 on, two letters instead.
4. Lines join on their blocks.  Of the lines of one value, those that follow one another in the
   order of their lengths, each fitting the one before, are a cluster.  It is named by its set of
   lines, so copies that share many blocks meet once.  Pairs are compared in memory and never become rows.
   Values that hold more than a 2^15th of all blocks are found by partial aggregation
   beforehand and dealt to cells (i, j) of tiles, so no task holds one of them whole.
5. In a cluster pairs are verified: 1 - edit distance / longer length >= ``similarity`` on the
   normalised lines, those with a SimHash within ``distance`` bits first; pairs that other links
   connect already are left out.  What is looked at beforehand bounds the edit distance from below and
   so loses no pair: lengths, counts of classes of letters, of long lines how many letter pairs and triples differ, and
   the edits with 32 classes of letters, found for many pairs at once.  A cluster above ``tile`` lines or bytes is verified in cells of tiles as well.
6. In each connected group the first occurrence, by (id, line number), stays.

Blocks of the SimHash's own bits can't do step 3: pairs at similarity 0.8 differ in up to 25
of 128 bits, for which the pigeonhole needs 26 blocks of 4 bits, and any two lines share one.

Defined results: null text stays null, empty text empty; lines end at \n only; the kept
lines keep their bytes and are joined by \n; equal ids with different texts are separate
documents, ordered by a hash of the text; a repeated row is the same document again and
keeps the same lines; a null id sorts first.  Columns of any other name pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import ROLLING, U64, Workspace, bucket_count, by_bucket, byte_chunks, byte_view, components, mix64, packed, packed_schema, spare_names, unpacked

WORDS, LONG = 13, 20  # lines of fewer words than the second are cut by bytes, of the first or more by words
#: Words on either side of a cut that are compared, in lines of so many words; lines near a border are cut by both.
RADII = ((2, WORDS, 128), (4, 100, 512), (8, 400, 2048), (16, 1600, 8192), (32, 6400, 1 << 60))
LEAST = 20  # bytes of a block of words
FLUSH = 1 << 20
PAIRS, EXACT = 1 << 17, 1 << 14  # that are looked at together, and whose edits are found together

#: Bytes of normalised lines: A-Z to a-z, digits to 0, other ASCII but a-z to a blank.
NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x30 if 0x30 <= b <= 0x39 else 0x20 for b in range(256))


def normalise(line: bytes) -> bytes:
    return b" ".join(line.translate(NORMAL).split())


@cache
def _lanes() -> np.ndarray:
    """For each byte, its eight bits in the eight bytes of a word."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(bits).view(U64).ravel()


class Split:
    """Words of normalised lines that are joined by line ends."""

    def __init__(self, lines: list[bytes]):
        self.data = np.frombuffer(b"\n".join(lines), np.uint8)
        size = np.fromiter(map(len, lines), np.int64, len(lines))
        self.end = np.cumsum(size + 1) - 1
        self.start = self.end - size
        gap = (self.data == 0x20) | (self.data == 0x0A)
        self.word_start = np.r_[0, np.flatnonzero(gap) + 1]
        self.word_end = np.r_[np.flatnonzero(gap), len(self.data)]
        self.first = np.searchsorted(self.word_start, self.start)
        self.words = np.diff(np.r_[self.first, len(self.word_start)])
        self.owner = np.repeat(np.arange(len(lines)), self.words)
        self.sums = ROLLING.sums(self.data)
        self.word = mix64(ROLLING.slices(self.sums, self.word_start, self.word_end) + (self.word_end - self.word_start).astype(U64))
        letters = np.r_[0, np.cumsum((self.data & 0xC0) != 0x80)]
        self.chars = letters[self.end] - letters[self.start]


def simhashes(split: Split, lines: np.ndarray) -> np.ndarray:
    """64-bit SimHashes of the given lines; each has one word at least."""
    if not len(lines):
        return np.zeros(0, U64)
    count = split.words[lines]
    line = np.repeat(np.arange(len(lines)), count)
    word = split.word[np.repeat(split.first[lines], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
    pair = np.flatnonzero(line[1:] == line[:-1])
    feature = np.r_[word, mix64(word[pair] * U64(3) + word[pair + 1])]
    owner = np.r_[line, line[pair]]
    order = np.argsort(owner, kind="stable")
    feature, owner = feature[order], owner[order]
    place = np.arange(len(owner)) - np.searchsorted(owner, owner)  # lanes of a byte hold sums up to 255
    cut = np.flatnonzero(place % 255 == 0)
    size = np.diff(np.r_[cut, len(owner)])
    first = np.flatnonzero(np.r_[True, owner[cut][1:] != owner[cut][:-1]])
    total = np.add.reduceat(size, first)
    out = np.zeros(len(lines), U64)
    raw = feature.view(np.uint8).reshape(-1, 8)
    for byte in range(8):
        lanes = np.add.reduceat(_lanes()[raw[:, byte]], cut).view(np.uint8).reshape(-1, 8)
        votes = np.add.reduceat(lanes.astype(np.int64), first)
        bits = np.packbits(2 * votes > total[:, None], axis=1, bitorder="little")[:, 0]
        out |= bits.astype(U64) << U64(8 * byte)
    return out


def letter_counts(split: Split, lines: np.ndarray) -> np.ndarray:
    """Sixteen counts of up to 15 of the given lines' letters, by the low bits of their first bytes."""
    size = (split.end - split.start)[lines]
    at = np.repeat(split.start[lines], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    kind = np.repeat(np.arange(len(lines)) * 16, size) + (split.data[at] & 15)
    counts = np.minimum(np.bincount(kind[(split.data[at] & 0xC0) != 0x80], minlength=16 * len(lines)), 15).reshape(-1, 16)
    return (counts.astype(U64) << (np.arange(16, dtype=U64) * U64(4))).sum(1, dtype=U64)


def signs(split: Split) -> tuple[np.ndarray, np.ndarray]:
    """(sim, size): SimHash and letters of long lines, letter counts and negative letters of short ones."""
    short = split.words < LONG
    sim = np.empty(len(short), U64)
    sim[short], sim[~short] = letter_counts(split, np.flatnonzero(short)), simhashes(split, np.flatnonzero(~short))
    return sim, np.where(short, -split.chars, split.chars).astype(np.int32)


def _least_within(key: np.ndarray, radius: int) -> np.ndarray:
    """The least key within the radius of each place, by windows that double."""
    width, reach = 2 * radius + 1, 1
    low = np.r_[np.full(radius, np.iinfo(U64).max, U64), key, np.full(radius, np.iinfo(U64).max, U64)]
    while reach * 2 <= width:
        low = np.minimum(low[: len(low) - reach], low[reach:])
        reach *= 2
    return np.minimum(low[: len(key)], low[width - reach : width - reach + len(key)])


def _cut(lines: np.ndarray, at: np.ndarray, count: np.ndarray, key: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, unit) where a block begins; the units of line i are key[at[i] : at[i] + count[i]]."""
    count = count[lines]
    begin = np.cumsum(count + radius) - count  # of each line's units, with filling between lines
    unit = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    spread = np.full(int(begin[-1] + count[-1]), np.iinfo(U64).max, U64)
    place = np.repeat(begin, count) + unit
    unit += np.repeat(at[lines], count)
    spread[place] = key[unit]
    least = (_least_within(spread, radius)[place] == spread[place]) | (unit == np.repeat(at[lines], count))
    return np.repeat(lines, count)[least], unit[least]


def shortened(text: str) -> set[str]:
    """The text without up to as many letters as edit similarity 0.8 lets differ below 15: one, from 10 on two."""
    out = {text, *(text[:k] + text[k + 1 :] for k in range(len(text)))}
    return out if len(text) < 10 else out | {x[:k] + x[k + 1 :] for x in out for k in range(len(x)) if len(x) < len(text)}


def blocks(split: Split) -> tuple[np.ndarray, np.ndarray]:
    """(line, value): the distinct blocks of each line, in the order of lines."""
    out_line, out_value = [], []

    def add(line: np.ndarray, begin: np.ndarray, end: np.ndarray, salt: int) -> None:
        value = ROLLING.slices(split.sums, begin, end)
        out_line.append(line)
        out_value.append(mix64(value + (end - begin).astype(U64) * U64(0x2545F4914F6CDD1D) + mix64(np.full(1, salt, U64))))

    def by_words(lines: np.ndarray, radius: int) -> None:
        """Blocks of words; one that is too short to be rare is lengthened, at the line's end to the front."""
        line, unit = _cut(lines, split.first, split.words, split.word, radius)
        last = np.r_[line[1:] != line[:-1], True]
        stop = split.first[line] + split.words[line]
        begin = np.minimum(unit, np.minimum(stop - radius - 1, np.searchsorted(split.word_start, split.end[line] - LEAST, "right") - 1))
        begin = np.maximum(begin, split.first[line])
        enough = np.maximum(begin + radius, np.searchsorted(split.word_end, split.word_start[begin] + LEAST)) + 1
        end = np.minimum(np.maximum(np.where(last, stop, np.r_[unit[1:], 0]), enough), stop)
        add(line, split.word_start[begin], split.word_end[end - 1], radius)

    def by_radius(lines: np.ndarray, at: np.ndarray, count: np.ndarray, key: np.ndarray, begin: np.ndarray, least: int, each: int, salt: int, ends) -> None:
        """Cut lines by the radius of their number of units, and by the next one if they are near its border.

        A value is of two neighbouring blocks, as one alone is too short to be rare."""
        power = np.floor(np.log2(np.maximum(count[lines] / each, 1))).astype(np.int64)
        power = np.maximum(power, least)
        near = count[lines] > 0.85 * each * 2.0 ** (power + 1)
        every, level = np.r_[lines, lines[near]], np.r_[power, power[near] + 1]
        for p in np.unique(level):
            line, unit = _cut(every[level == p], at, count, key, 1 << int(p))
            last = np.r_[line[1:] != line[:-1], True]
            end = ends(line, np.r_[unit[1:], 0], last)
            pair = np.flatnonzero(~last | np.r_[True, last[:-1]])  # all but a last block that isn't the only one
            line, unit, end = line[pair], unit[pair], end[np.where(last[pair], pair, pair + 1)]
            add(line, begin[unit], end, salt + int(p))

    long_ = np.flatnonzero(split.words >= WORDS)
    for radius, least, most in RADII:
        lines = long_[(split.words[long_] >= least) & (split.words[long_] < most)]
        if len(lines):
            by_words(lines, radius)
    size = split.end - split.start
    short = np.flatnonzero((split.words < LONG) & (split.chars >= 12))
    if len(short):
        data = split.data.astype(U64)
        trigram = data << U64(16)
        trigram[:-1] |= data[1:] << U64(8)
        trigram[:-2] |= data[2:]
        by_radius(short, split.start, size, mix64(trigram + U64(1)), np.arange(len(data)), 1, 12, 1000, lambda line, after, last: np.where(last, split.end[line], after))
    few = np.flatnonzero((split.chars >= 5) & (split.chars < 15))
    if len(few):
        line, value = [], []
        for i in few.tolist():
            text = split.data[split.start[i] : split.end[i]].tobytes().decode("utf-8", "replace")
            for x in shortened(text):
                line.append(i)
                value.append(xxhash.xxh3_64_intdigest(x.encode("utf-8", "replace"), 7))
        out_line.append(np.array(line))
        out_value.append(np.array(value, U64))
    if not out_line:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    line, value = np.concatenate(out_line), np.concatenate(out_value)
    order = np.lexsort((value, line))
    line, value = line[order], value[order]
    once = np.r_[True, (line[1:] != line[:-1]) | (value[1:] != value[:-1])]
    return line[once], value[once]


def _binary(values: np.ndarray, count: np.ndarray) -> pa.Array:
    """One binary value of count[i] numbers each."""
    offsets = (np.r_[0, np.cumsum(count)] * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _lines_stage():
    """One row per line that takes part: (id, th, n, h1, h2, sim, size, blocks); size is negative below 20 words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column(0), batch.column(1)
            data, offsets = byte_view(batch.column(2))
            view = memoryview(data)
            for i, j in byte_chunks(offsets):
                doc, number, normal = [], [], []
                for d in range(i, j):
                    for n, line in enumerate(bytes(view[offsets[d] : offsets[d + 1]]).translate(_KEEP_ENDS).split(b"\n")):
                        flat = b" ".join(line.split())
                        if flat:
                            doc.append(d)
                            number.append(n)
                            normal.append(flat)
                if normal:
                    split = Split(normal)
                    owner, value = blocks(split)
                    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, normal)), np.int64).reshape(-1, 2)
                    sim, size = signs(split)
                    columns = [pa.array(np.ascontiguousarray(c)) for c in (both[:, 0], both[:, 1], sim.view(np.int64), size)]
                    at = pa.array(doc)
                    yield pa.RecordBatch.from_arrays([ids.take(at), hashes.take(at), pa.array(number, pa.int32()), *columns, _binary(value, np.bincount(owner, minlength=len(normal)))], ["id", "th", "n", "h1", "h2", "sim", "size", "blocks"])

    return run, "id long, th long, n int, h1 long, h2 long, sim long, size int, blocks binary"


#: The same table, but line ends stay.
_KEEP_ENDS = NORMAL[:0x0A] + b"\n" + NORMAL[0x0B:]


def _texts_stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The normalised text of asked lines."""
    for batch in batches:
        h1, key, out, sim, size, names = [], [], [], [], [], []
        for asked, text in zip(batch.column("asked").to_pylist(), batch.column("_text"), strict=True):
            lines = (text.as_py() or "").encode().split(b"\n")
            for a in asked:
                h1.append(a["h1"])
                key.append(a["key"])
                out.append(normalise(lines[a["n"]]).decode("utf-8", "replace"))
                sim.append(a["sim"])
                size.append(a["size"])
                names.append(a["names"])
        yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(key, pa.string()), pa.array(out, pa.string()), pa.array(sim, pa.int64()), pa.array(size, pa.int32()), pa.array(names, pa.list_(pa.int64()))], ["h1", "key", "line", "sim", "size", "names"])


def _cut_stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        count, gone, kept = [], [], []
        for drop, text in zip(batch.column("dropped").to_pylist(), batch.column("_text"), strict=True):
            text = text.as_py()
            lines = text.split("\n") if text is not None else []
            out = set(drop or ())
            count.append(len(lines))
            gone.append(len(out))
            kept.append(text if not out else "\n".join(x for n, x in enumerate(lines) if n not in out))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), pa.array(count, pa.int64()), pa.array(gone, pa.int64())], ["row", "kept", "n_lines", "n_removed"])


# --- candidates -------------------------------------------------------------------------------

ENTRY = {"value": "u8", "line": "i8", "size": "i4"}


def _entries(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[np.ndarray]]:
    """(value, line, size) of each line's blocks, about limit at a time."""
    held, count = [], 0
    for batch in batches:
        raw, offsets = byte_view(batch.column(2))
        lines = np.diff(offsets) // 8
        value = raw[offsets[0] : offsets[-1]].view(U64) if len(raw) else np.zeros(0, U64)
        held.append([value, *(np.repeat(np.asarray(batch.column(c)), lines) for c in range(2))])
        count += len(value)
        if count >= limit:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held, count = [], 0
    if count:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _often_stage(least: int):
    """(value, n) of values that come often in a part of the input, and (null, blocks in all)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for value, *_ in _entries(batches, FLUSH):
            found, n = np.unique(value, return_counts=True)
            often = n >= least
            yield pa.RecordBatch.from_arrays([pa.array([None, *found[often].view(np.int64).tolist()], pa.int64()), pa.array([len(value), *n[often].tolist()], pa.int64())], ["value", "n"])

    return run, "value long, n long"


def _block_stage(buckets: int, hot: np.ndarray, tiles: np.ndarray):
    """Lines under each of their blocks, as packed arrays; hot values are dealt to cells of tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for value, line, size in _entries(batches, FLUSH):
            columns = [value, line, size]
            if len(hot):
                at = np.minimum(np.searchsorted(hot, value), len(hot) - 1)
                is_hot = hot[at] == value
                cells = [[c[~is_hot] for c in columns]]
                at, rows = at[is_hot], [c[is_hot] for c in columns]
                side = (mix64(rows[1].view(U64)) % tiles[at].astype(U64)).astype(np.int64)
                for other in range(int(tiles[at].max(initial=0))):
                    here = other < tiles[at]
                    low, high = np.minimum(side, other)[here], np.maximum(side, other)[here]
                    cell = mix64(rows[0][here] + mix64(low.astype(U64) << U64(32) | high.astype(U64)))
                    cells.append([cell, *(c[here] for c in rows[1:])])
                columns = [np.concatenate(c) for c in zip(*cells, strict=True)]
            yield packed((mix64(columns[0]) % U64(buckets)).astype(np.int32), dict(zip(ENTRY, columns, strict=True)))

    return run, packed_schema(list(ENTRY))


def _near(sim_a: np.ndarray, sim_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, similarity: float, distance: int = 64) -> np.ndarray:
    """Which of two lists of lines may be similar, by length and letter counts; of long ones, those with a SimHash within distance bits."""
    a, b = np.abs(size_a), np.abs(size_b)
    good = np.minimum(a, b) >= similarity * np.maximum(a, b) - 1e-9
    long_ = np.flatnonzero(good & (size_a > 0) & (size_b > 0)) if distance < 64 else []
    good[long_] = np.bitwise_count(sim_a[long_] ^ sim_b[long_]) <= distance
    short = np.flatnonzero(good & (size_a < 0) & (size_b < 0))
    x, y, most = sim_a[short], sim_b[short], np.maximum(a[short], b[short]) * (1 - similarity) + 1e-9
    more, less = np.zeros(len(short), np.int16), np.zeros(len(short), np.int16)
    for k in range(0, 64, 4):
        apart = ((x >> U64(k)) & U64(15)).astype(np.int16) - ((y >> U64(k)) & U64(15)).astype(np.int16)
        more += np.maximum(apart, 0)
        less += np.maximum(-apart, 0)
    good[short] = np.maximum(more, less) <= most
    return good


def _cluster_stage(similarity: float):
    """(cluster, line, chars): the lines of a block value that have a partner there of fitting length.

    A cluster's name is a hash of its set of lines: should two sets have the same, they are one cluster, and no link is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in unpacked(batches, ENTRY):
            chars = np.abs(x["size"])
            order = np.lexsort((chars, x["value"]))
            value, line, chars = x["value"][order], x["line"][order], chars[order]
            # where a length doesn't fit the one before, none of those before fits any of those after
            cut = np.r_[True, (value[1:] != value[:-1]) | (chars[:-1] < similarity * chars[1:] - 1e-9)]
            start = np.flatnonzero(cut)
            size = np.diff(np.r_[start, len(cut)])
            name = np.add.reduceat(mix64(mix64(line.view(U64) + U64(1)) + U64(0x9E3779B97F4A7C15)), start)
            met = np.repeat(size, size) > 1
            if met.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(name, size)[met].view(np.int64)), pa.array(line[met]), pa.array(chars[met])], ["cluster", "line", "chars"])

    return run, "cluster long, line long, chars int"


def clusters(ws: Workspace, lines: DataFrame, similarity: float = 0.8, hot_from: int = 1 << 15) -> DataFrame:
    """(cluster, line, chars) for distinct lines (h1, size, blocks): similar lines are in one cluster at least."""
    asked = lines.select("h1", "size", "blocks")
    run, schema = _often_stage(16)
    often = asked.mapInArrow(run, schema).groupBy("value").agg(F.sum("n").alias("n"))
    often = ws.save(often, "often")
    total = (often.where("value is null").first() or [None, 0])[1]
    # values with a share of 2^-15 at least: 2^15 of them at most, whatever the input
    hot = sorted((r[0] % (1 << 64), r[1]) for r in often.where((F.col("value").isNotNull()) & (F.col("n") >= max(hot_from, total >> 15))).collect())
    run, schema = _block_stage(bucket_count(lines.sparkSession, total * 20), np.array([v for v, _ in hot], U64), np.array([-(-2 * n // hot_from) for _, n in hot], np.int64))
    cluster, clustered = _cluster_stage(similarity)
    return by_bucket(asked.mapInArrow(run, schema)).mapInArrow(cluster, clustered).dropDuplicates(["cluster", "line"])


def _common(most: int, same) -> int:
    """The greatest n up to most for which same(n) holds; it holds for all below, too."""
    low, high = 0, most + 1
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if same(middle) else (low, middle)
    return low


def _replaced(a: str, b: str, ahead: int = 6) -> int:
    """Edits that surely do: words are matched greedily, and what lies between is replaced."""
    x, y, total, i, j = a.split(" "), b.split(" "), 0, 0, 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            i, j = i + 1, j + 1
            continue
        for gap in range(1, 2 * ahead):
            found = next(((p, gap - p) for p in range(max(0, gap - ahead), min(gap, ahead) + 1) if i + p < len(x) and j + gap - p < len(y) and x[i + p] == y[j + gap - p]), None)
            if found:
                break
        else:
            break
        total += max(sum(map(len, x[i : i + found[0]])) + found[0], sum(map(len, y[j : j + found[1]])) + found[1])
        i, j = i + found[0], j + found[1]
    return total + max(sum(map(len, x[i:])) + len(x) - i, sum(map(len, y[j:])) + len(y) - j)


def _grams_apart(a: str, b: str, most: int, bits: int = 12) -> bool:
    """Whether the counts of letters, letter pairs or triples tell that more than `most` edits are needed: one edit changes n groups of n letters at most."""
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b))
    for n in (1, 2, 3):
        of_a, of_b = (np.bincount(sum(t[k : len(t) - n + 1 + k] * np.uint32(p) for k, p in zip(range(n), (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))) >> np.uint32(32 - bits), minlength=1 << bits) for t in (x, y))
        apart = of_a - of_b
        if max(apart[apart > 0].sum(), -apart[apart < 0].sum()) > n * most:
            return True
    return False


def within_edits(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most `most`: Myers' bit vectors on what is left between the common ends.

    Only rows in a band around the diagonal are kept, as a way that leaves the diagonals 0 to len(b) - len(a) comes back;
    what lies outside counts as reached by insertions or deletions alone.  It ends once no way through a column is short enough."""
    if abs(len(a) - len(b)) > most:
        return False
    i = _common(min(len(a), len(b)), lambda n: a[:n] == b[:n])
    a, b = a[i:], b[i:]
    j = _common(min(len(a), len(b)), lambda n: a[len(a) - n :] == b[len(b) - n :])
    a, b = a[: len(a) - j], b[: len(b) - j]
    if not a or not b or max(len(a), len(b)) <= most:
        return max(len(a), len(b)) <= most
    if _replaced(a, b) <= most:
        return True
    if len(a) >= 1000 and _grams_apart(a, b, most):
        return False
    if len(a) > len(b):
        a, b = b, a
    m, n = len(a), len(b)
    left, right, step = (most - n + m) // 2, (most + n - m) // 2, 64 + most // 8
    place: dict[str, int] = {}  # of the letters of a[low:high]
    low = high = up = down = top = 0  # top is the value above row low, at the column reached
    for at in range(0, n, step):
        stop = min(at + step, n)
        gone, low = max(0, at - right) - low, max(0, at - right)
        over = (1 << gone) - 1
        top += (up & over).bit_count() - (down & over).bit_count()
        up, down = up >> gone, down >> gone
        for c in place:
            place[c] >>= gone
        was, high = high, min(m, stop + left)
        for k, c in enumerate(a[was:high], was - low):
            place[c] = place.get(c, 0) | 1 << k
        every = (1 << high - low) - 1
        up |= every ^ ((1 << was - low) - 1)
        for c in b[at:stop]:
            match = place.get(c, 0)
            diagonal = (((match & up) + up) ^ up) | match | down
            plus, minus = (down | ~(diagonal | up)) << 1 | 1, (up & diagonal) << 1
            up, down = (minus | ~(diagonal | plus)) & every, plus & diagonal & every
        top += stop - at
        if top + abs(m - low - n + stop) > most:
            size = -(-(high - low) // 8)
            steps = [np.unpackbits(np.frombuffer(x.to_bytes(size, "little"), np.uint8), count=high - low, bitorder="little").view(np.int8) for x in (up, down)]
            value = top + np.cumsum(steps[0] - steps[1], dtype=np.int32)
            if (value + np.abs((m - low - n + stop) - np.arange(1, high - low + 1))).min() > most:
                return False
    return top + up.bit_count() - down.bit_count() <= most


def _profiles(texts: list[str], classes: int = 64) -> np.ndarray:
    """Counts of letter pairs by class: an edit takes away two of them at most and adds two at most."""
    letter = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
    same = np.flatnonzero(owner[1:] == owner[:-1])
    kind = (letter[same] * np.uint32(0x9E3779B1) + letter[same + 1] * np.uint32(0x85EBCA77)) >> np.uint32(26)
    return np.bincount(owner[same] * classes + kind, minlength=classes * len(texts)).reshape(-1, classes).astype(np.int32)


def _apart_by(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many counts of one are missing in the other, or the other way round, whichever is more."""
    apart = x - y
    return np.maximum(np.maximum(apart, 0).sum(1), np.maximum(-apart, 0).sum(1))


def _apart(letters: np.ndarray, x: np.ndarray, m: np.ndarray, y: np.ndarray, n: np.ndarray, most: np.ndarray, few: int) -> np.ndarray:
    """Which pairs are more than `most` edits apart, by Myers' bit vectors in a band around the diagonal; n - m is 0 to most.

    Text i of the first is letters[x[i] : x[i] + m[i]].  A way that leaves the diagonals 0 to n - m comes back, so
    half of the edits that n - m leaves bound how far.  64 letters of it are a block; a pair goes once no way
    through a block's last row is short enough, and `few` pairs that are left stay undecided."""
    out, live, last = np.zeros(len(x), bool), np.arange(len(x)), int(n.max())
    left, right = int((most - n + m).max()) // 2, int((most + n - m).max()) // 2
    text = np.zeros((0, len(x)), np.uint8)  # letters low to high of the second
    low = high = 0
    more = less = score = None  # steps along the last row of the block above, and its values
    for p in range(0, int(m.max()), 64):
        rows = np.minimum(m - p, 64)
        at = x[:, None] + (p + np.arange(64))
        piece = np.where(np.arange(64) < rows[:, None], letters.take(at, mode="clip"), np.uint8(32))
        place = np.zeros((len(x), 33), U64)
        for c in range(32):
            place[:, c] = np.packbits(piece == c, axis=1, bitorder="little").view(U64)[:, 0]
        place, base, top = place.ravel(), np.arange(len(x)) * 33, (rows - 1).astype(U64)
        was_low, was_high, low, high = low, high, max(p - left, 0), min(p + 64 + right, last)
        begin = np.full(len(x), p) if low == 0 else score[low - 1 - was_low].astype(np.int64)
        column = np.arange(was_high, high)[:, None]
        text = np.concatenate([text[low - was_low :], np.where(column < n, letters.take(y + column, mode="clip"), np.uint8(32))])  # the last class is of no letter
        into, outof = np.ones((high - low, len(x)), U64), np.zeros((high - low, len(x)), U64)  # beyond the band, steps of one
        if p:
            into[: was_high - low], outof[: was_high - low] = more[low - was_low :], less[low - was_low :]
        up, down = np.full(len(x), ~U64(0)), np.zeros(len(x), U64)
        rise, fall = np.empty((high - low, len(x)), U64), np.empty((high - low, len(x)), U64)
        eq, xv, xh, step = (np.empty(len(x), U64) for _ in range(4))
        for index, plus_in, minus_in, plus, minus in zip(base + text, into, outof, rise, fall, strict=True):
            place.take(index, out=eq, mode="clip")
            np.bitwise_or(eq, down, out=xv)
            np.bitwise_or(eq, minus_in, out=eq)
            np.bitwise_and(eq, up, out=xh)
            np.add(xh, up, out=xh)
            np.bitwise_xor(xh, up, out=xh)
            np.bitwise_or(xh, eq, out=xh)
            np.bitwise_or(xh, up, out=plus)
            np.invert(plus, out=plus)
            np.bitwise_or(plus, down, out=plus)
            np.bitwise_and(up, xh, out=minus)
            np.left_shift(plus, 1, out=step)
            np.bitwise_or(step, plus_in, out=step)
            np.bitwise_or(xv, step, out=up)
            np.bitwise_and(step, xv, out=down)
            np.invert(up, out=up)
            np.left_shift(minus, 1, out=step)
            np.bitwise_or(step, minus_in, out=step)
            np.bitwise_or(up, step, out=up)
        rise, fall = ((t >> top & U64(1)).astype(np.uint8) for t in (rise, fall))
        score = np.cumsum(rise.view(np.int8) - fall.view(np.int8), axis=0, dtype=np.int32)
        score += (begin + rows).astype(np.int32)
        more, less = rise, fall
        ends, every = m <= p + 64, np.arange(len(x))
        inside = (n > low) & (n <= high)
        total = np.where(inside, score[np.clip(n - 1 - low, 0, high - low - 1), every], most + 1)
        ahead = ((m - p - 64) - n).astype(np.int32) + np.arange(low + 1, high + 1, dtype=np.int32)[:, None]
        least = np.where(ends, total, (score + np.abs(ahead)).min(axis=0))
        far = least > most
        out[live[far]] = True
        stay = np.flatnonzero(~far & ~ends)
        if len(stay) < few:
            break
        if len(stay) < len(x):
            live, x, m, y, n, most = live[stay], x[stay], m[stay], y[stay], n[stay], most[stay]
            text, more, less, score = (t[:, stay] for t in (text, more, less, score))
    return out


def _beyond(letters: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, few: int = 32) -> np.ndarray:
    """Which pairs of texts are surely more than `most` edits apart; text i is letters[at[i] : at[i + 1]], of 32 classes.

    Letters of a class count as equal, so the edits found are no more than the edit distance."""
    size = np.diff(at)
    a, b = np.where(size[a] <= size[b], a, b), np.where(size[a] <= size[b], b, a)
    longest, out = size[b], size[b] - size[a] > most
    order = np.argsort(longest, kind="stable")
    order = order[~out[order]]
    # pairs of about the same length go together; where they are few, their edits are found as fast
    cut = np.flatnonzero(np.diff(np.floor(0.5 * np.log2(np.maximum(longest[order], 256))))) + 1
    for rows in np.split(order, cut):
        least = few * max(1, int(longest[rows[-1]]) >> 9) if len(rows) else few  # one by one, a long pair's band costs little more than a short one's
        each = min(1 << 11, (1 << 22) // int(longest[rows[-1]])) if len(rows) else 0
        if min(len(rows), each) < least:
            continue
        rows = rows[np.argsort((size[b] - size[a])[rows] / most[rows].clip(1), kind="stable")]
        for k in range(0, len(rows), each):
            part = rows[k : k + each]
            out[part] |= _apart(letters, at[a[part]], size[a[part]], at[b[part]], size[b[part]], most[part], least)
    return out


def _spanning(cells: np.ndarray, called: list[int], texts: list[str], sim: np.ndarray, size: np.ndarray, names: list[list[int]], similarity: float, distance: int) -> Iterator[tuple[int, int]]:
    """Verified links that span the groups of similar lines of each cell; a cell's lines follow one another.

    A pair that meets in several clusters is left to the one of the least name; called holds the names of the cells' clusters."""
    names = [set(x) for x in names]
    least, called = np.fromiter(map(min, names), np.int64, len(names)), np.asarray(called, np.int64)[cells]
    root, long_ = np.arange(len(texts)), np.flatnonzero(np.abs(size) >= 1000)
    profile = _profiles([texts[i] for i in long_])
    at = np.r_[0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))]
    letters = (np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32) & np.uint32(31)).astype(np.uint8)
    bag = np.bincount(np.repeat(np.arange(len(texts)) * 32, np.diff(at)) + letters, minlength=32 * len(texts)).reshape(-1, 32).astype(np.int32)

    def close(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
        """(a, b, edits they may have) of pairs that may be similar, near ones first."""
        good = np.flatnonzero(_near(sim[a], sim[b], size[a], size[b], similarity))
        a, b = a[good], b[good]
        most = np.floor(np.maximum(np.abs(size[a]), np.abs(size[b])) * (1 - similarity) + 1e-9).astype(np.int64)
        good = np.ones(len(a), bool)
        for i in range(0, len(a), 1 << 15):
            part = slice(i, i + (1 << 15))
            good[i : i + (1 << 15)] = _apart_by(bag[a[part]], bag[b[part]]) <= most[part]
        a, b, most = a[good], b[good], most[good]
        of, good = np.flatnonzero((np.abs(size[a]) >= 1000) & (np.abs(size[b]) >= 1000)), np.ones(len(a), bool)
        for i in range(0, len(of), 1 << 15):
            part = of[i : i + (1 << 15)]
            good[part] = _apart_by(profile[np.searchsorted(long_, a[part])], profile[np.searchsorted(long_, b[part])]) <= 2 * most[part]
        a, b, most = a[good], b[good], most[good]
        near = _near(sim[a], sim[b], size[a], size[b], similarity, distance)
        order = np.r_[np.flatnonzero(near), np.flatnonzero(~near)]
        return a[order], b[order], most[order]

    def here(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the cell's cluster has the least name of those that both lines are in."""
        mine = (least[a] == called[a]) | (least[b] == called[a])
        open_ = np.flatnonzero(~mine & (least[a] != least[b]))
        mine[open_] = [min(names[i].intersection(names[j])) == name for i, j, name in zip(a[open_].tolist(), b[open_].tolist(), called[a[open_]].tolist(), strict=True)]
        return mine

    def link(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
        a, b, most = close(a, b)
        mine = here(a, b)
        a, b, most = a[mine], b[mine], most[mine]
        for k in range(0, len(a), EXACT):
            part = np.arange(k, min(k + EXACT, len(a)))
            part = part[root[a[part]] != root[b[part]]]
            part = part[~_beyond(letters, at, a[part], b[part], most[part])]
            for i, j, edits in zip(a[part].tolist(), b[part].tolist(), most[part].tolist(), strict=True):
                if root[i] != root[j] and within_edits(texts[i], texts[j], edits):
                    low, high = edge[int(cells[i])]
                    members = root[low:high]
                    members[members == root[j]] = root[i]
                    yield i, j

    first = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
    count = np.diff(np.r_[first, len(cells)])
    edge = {int(cells[f]): (int(f), int(f + n)) for f, n in zip(first, count, strict=True)}
    # neighbours of all cells together, then those two apart; where few lines have one so far off, several distances at a time
    stop, step, begin = np.repeat(first + count, count), 1, np.arange(len(texts))
    while len(begin := begin[begin + step < stop[begin]]):
        steps = max(1, min(PAIRS // len(begin), step))
        a, b = np.repeat(begin, steps), (begin[:, None] + np.arange(step, step + steps)).ravel()
        apart = np.flatnonzero(b < stop[a])
        apart = apart[root[a[apart]] != root[b[apart]]]
        yield from link(a[apart], b[apart])
        step += steps


def _verify_stage(similarity: float, distance: int, lines: int = 1 << 15, chars: int = 16 << 20):
    """Links (a, b) that span the groups of similar lines of each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []  # key, line, sim, size, names
        cells: list[int] = []
        own: list[int] = []
        now, held = None, 0

        def solved() -> pa.RecordBatch:
            found = []
            if len(rows) > 1:
                keys, texts, sim, size, names = zip(*rows, strict=True)
                found = [(keys[i], keys[j]) for i, j in _spanning(np.array(cells), own, texts, np.array(sim, np.int64).view(U64), np.array(size), names, similarity, distance)]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for *name, key, line, sim, size, names in zip(*(batch.column(c).to_pylist() for c in ("cluster", "i", "j", "key", "line", "sim", "size", "names")), strict=True):
                if name != now:
                    if len(rows) >= lines or held >= chars:
                        yield solved()
                        rows, cells, own, held = [], [], [], 0
                    now = name
                    own.append(name[0])
                elif key == rows[-1][0]:
                    continue  # rows are sorted by key
                cells.append(len(own) - 1)
                rows.append([key, line, sim, size, names])
                held += len(line)
        yield solved()

    return run, "a string, b string"


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, distance: int = 20, tile: int = 4096, tile_chars: int = 16 << 20, hot_from: int = 1 << 15) -> DataFrame:
    """df with text_col deduplicated, and n_lines and n_removed (names that df has already get leading underscores)."""
    ws = Workspace(df.sparkSession, "line-dedup")
    text = F.col(text_col).cast("string")
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("_text"))
    run, schema = _lines_stage()
    lines = ws.save(docs.select("id", "th", F.coalesce("_text", F.lit("")).alias("t")).mapInArrow(run, schema), "lines")
    place = F.struct("id", "th", "n")
    key = F.concat_ws(":", "h1", "h2")
    first = [F.first(c).alias(c) for c in ("sim", "size", "blocks")]
    distinct = ws.save(lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("copies"), *first).withColumn("key", key), "distinct")
    lines = ws.save(lines.select("id", "th", "n", "h1", "h2"), "places")
    ws.drop("lines")
    met = ws.save(clusters(ws, distinct, similarity, hot_from), "met")
    distinct = ws.save(distinct.drop("blocks"), "named")
    ws.drop("distinct", "often")
    names = met.groupBy(F.col("line").alias("h1")).agg(F.collect_set("cluster").alias("names"))
    asked = distinct.join(names, "h1").select("first.*", "h1", "key", "sim", "size", "names")
    wanted = asked.groupBy("id", "th").agg(F.collect_list(F.struct("h1", "key", "n", "sim", "size", "names")).alias("asked"))
    mine = lambda x, y: x["id"].eqNullSafe(y["id"]) & (x["th"] == y["th"])
    once = wanted.join(docs, mine(wanted, docs)).select("asked", "_text")
    texts = ws.save(once.mapInArrow(_texts_stage, "h1 long, key string, line string, sim long, size int, names array<long>").dropDuplicates(["key"]), "texts")
    # cells of a cluster: one, unless it is beyond a tile
    members = met.join(texts, met["line"] == texts["h1"]).select("cluster", "key", texts["line"], "sim", "size", "names")
    weight = met.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / tile), F.ceil(F.sum("chars") / tile_chars)).cast("int").alias("tiles"))
    cells = members.join(weight.where("tiles > 1"), "cluster", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    cells = cells.withColumn("side", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    cells = cells.select("cluster", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "key", "line", "sim", "size", "names")
    run, schema = _verify_stage(similarity, distance)
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), met.count() // tile)  # stated, as Spark would merge them by bytes
    links = cells.repartition(tasks, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "key").mapInArrow(run, schema)
    links = ws.save(links, "links")
    ws.drop("met", "texts")
    labels = components(ws, links)
    # copies of a line and lines of a group: all but the first occurrence go
    group = F.coalesce("label", "key")
    grouped = distinct.join(labels, F.col("key") == F.col("node"), "left").select("h1", "h2", "first", "copies", group.alias("group"))
    heads = grouped.groupBy("group").agg(F.min("first").alias("head"), F.sum("copies").alias("members")).where("members > 1")
    groups = ws.save(grouped.join(heads, "group").select("h1", "h2", "head"), "groups")
    same = F.col("head.id").eqNullSafe(F.col("id")) & (F.col("head.th") == F.col("th")) & (F.col("head.n") == F.col("n"))
    dropped = ws.save(lines.join(groups, ["h1", "h2"]).where(~same).groupBy("id", "th").agg(F.collect_set("n").alias("dropped")), "dropped")
    ws.drop("places", "named", "groups")
    others = [c for c in df.columns if c != text_col]
    full = df.select(F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in others)).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("_text"))
    joined = full.join(dropped, mine(full, dropped), "left").select("row", "dropped", "_text")
    out = joined.mapInArrow(_cut_stage, StructType([full.schema["row"], *StructType.fromDDL("kept string, n_lines long, n_removed long")]))
    named = spare_names(df.columns, "n_lines", "n_removed")
    return out.select(*((F.col("kept") if c == text_col else F.col("row").getField(c)).alias(named.get(c, c)) for c in df.columns), "n_lines", "n_removed")
