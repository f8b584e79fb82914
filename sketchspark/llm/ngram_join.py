"""N-gram Jaccard join by PartEnum signatures.

A document is the set of its distinct w-word shingles (64-bit hashes of lower-cased
words).  Two sets link when ``100 * |A & B| >= percent * |A | B|``.

PartEnum: sets are dealt to size bands; inside a band two linked sets differ in at
most k shingles.  The hash domain is cut into n1 ranges, and each non-empty range of a
set gives one signature.  At most k ranges can differ, so with n1 = k + 1 + slack two
linked sets share a signature unless *both* have more than ``slack`` empty ranges; such
sets also sign their empty ranges.  For small sets the domain has k + 2 ranges and every
subset of 2 of them is signed.  A set within reach of the next band signs there too.
The same count gives how many signatures a link needs at least; sets that share fewer
with all others together are dropped, so a common passage joins no clusters.

Execution: signatures move once, as packed arrays (`common.packed`).  Sets that share a
signature form candidate clusters (connected components of set - signature pivot edges).
A cluster is cut into tiles; a tile pair's intersections come from blocked matrix
products, so pairs are compared in memory and never become rows: a tile pair returns a
spanning forest of its links and the number of links of each set.  Equal sets are one
class throughout, so exact copies cost nothing beyond their own row.

Defined results: null, empty or blank text has 0 shingles, is its own component and has
no links; a text with fewer than w words is one shingle; repeated rows are copies of each
other; a null id keeps its row, never lowers a component's id, and a component of null ids
only has a null id.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, ROLLING, U64, Workspace, bucket_count, by_bucket, byte_chunks, byte_view, components, mix64, packed, packed_schema, text_bytes, unpacked, word_spans

RATIO = 1.4
FLUSH = 1 << 20
TILE_SETS, TILE_ITEMS = 1024, 1 << 20


# --- sets -------------------------------------------------------------------------------------


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingles' hashes, sorted."""
    lower, n = LOWER[data], len(offsets) - 1
    begin, end = word_spans(lower, offsets[:-1])
    sums = ROLLING.sums(lower)
    words = mix64(ROLLING.slices(sums, begin, end) + (end - begin).astype(U64))
    first = np.searchsorted(begin, offsets)
    grams = np.zeros(max(0, len(words) - width + 1), U64)
    for j in range(width):
        grams += mix64(words[j : j + len(grams)] + U64(j + 1)) * U64(2 * j + 3)
    grams = mix64(grams)
    for d in range(n):
        a, b = int(first[d]), int(first[d + 1])
        if b - a >= width:
            found = np.sort(grams[a : b - width + 1])
            keep = np.empty(len(found), bool)
            keep[0] = True
            np.not_equal(found[1:], found[:-1], out=keep[1:])
            yield found[keep]
        elif b > a:
            yield np.array([xxhash.xxh3_64_intdigest(words[a:b].tobytes(), b - a)], U64)
        else:
            yield np.zeros(0, U64)


def digest(found: np.ndarray) -> tuple[int, int]:
    """128 bits of a set as two signed longs."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.int64).tolist())


# --- signatures -------------------------------------------------------------------------------


def furthest(a: int, b: int, percent: int) -> int:
    """Greatest symmetric difference of linked sets of sizes a and b."""
    overlap = -(-percent * (a + b) // (100 + percent))
    return a + b - 2 * overlap


def furthest_of(a: int, b: int, percent: int) -> int:
    """Greatest symmetric difference of linked sets of sizes a and up to b: it grows with every second size only."""
    return max(0, furthest(a, b, percent), furthest(a, b - 1, percent))


@cache
def bands(percent: int, largest_power: int) -> list[tuple[int, int, int, int, int]]:
    """(lowest, highest, k, ranges, slack) of each size band; slack -1 marks the small scheme."""
    out, low = [], 1
    for _ in range(largest_power):
        high = max(low, math.ceil(low * max(RATIO, 110 / percent)) - 1)
        k = furthest_of(high, high, percent)
        least = max(1, math.ceil(low * percent / 100))
        slack = 0
        while True:
            ranges = k + 1 + slack
            empty = ranges * math.exp(-least / ranges)
            need = math.ceil(empty + 4 * math.sqrt(empty) + 4)
            if need <= slack or ranges > least:
                break
            slack += 1
        if k <= 3 or (need > slack and k <= 16):
            out.append((low, high, k, k + 2, -1))
        else:
            out.append((low, high, k, ranges, slack))
        low = high + 1
    return out


@cache
def band_index(size: int, percent: int) -> tuple[int, list[tuple[int, int, int, int, int]]]:
    power = 16
    while bands(percent, power)[-2][0] <= size:
        power *= 2
    lows = [x[0] for x in bands(percent, power)]
    return int(np.searchsorted(lows, size, "right")) - 1, bands(percent, power)


@cache
def _pairs(ranges: int) -> np.ndarray:
    return np.array(list(combinations(range(ranges), 2)), np.int64)


def signatures(found: np.ndarray, percent: int) -> list[tuple[int, int, np.ndarray]]:
    """(band, need, signatures) in a set's own band, and in the next where a linked set may lie.

    need: as many signatures at least does a set share with any set that it links with, as
    at most ``furthest_of`` ranges can differ."""
    size = len(found)
    at, table = band_index(size, percent)
    out = []
    here = [at] if size * 100 < table[at + 1][0] * percent else [at, at + 1]
    mixed = mix64(found + U64(0x5851F42D4C957F2D))
    for i in here:
        _, high, k, ranges, slack = table[i]
        if k == 0:
            continue  # only equal sets link, and those are one class already
        part = ((found >> U64(32)) * U64(ranges)) >> U64(32)
        cut = np.searchsorted(part, np.arange(ranges + 1, dtype=U64))
        full = np.flatnonzero(cut[1:] > cut[:-1])
        sums = np.zeros(ranges, U64)
        sums[full] = np.add.reduceat(mixed, cut[full])
        alike = ranges - furthest_of(size, min(high, size * 100 // percent), percent)
        if slack < 0:
            two = _pairs(ranges)
            keys = sums[two[:, 0]] * U64(3) + sums[two[:, 1]] * U64(5)
            named = np.arange(len(two), dtype=U64)
            need = alike * (alike - 1) // 2
        else:
            named = full.astype(U64) if ranges - len(full) <= slack else np.arange(ranges, dtype=U64)
            keys = sums[named.astype(np.int64)]
            need = alike - (ranges - len(full))
        out.append((i, max(1, need), mix64(keys + mix64(named + U64(i * 0x100000001 + 1)))))
    return out


def _sign(width: int, percent: int, buckets: int):
    names = ["sig", "sid", "band", "need"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0

        def flush() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            out = packed((columns[0] % U64(buckets)).astype(np.int32), dict(zip(names, columns, strict=True)))
            n = out.num_rows
            return pa.RecordBatch.from_arrays([*[pa.nulls(n, pa.int64())] * 5, *out.columns], ["id", "th", "hi", "lo", "n_shingles", "bucket", *names])

        for batch in batches:
            ids, hashes = batch.column(0), batch.column(1)
            data, offsets = byte_view(batch.column(2))
            for i, j in byte_chunks(offsets):
                rows = []
                for found in shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width):
                    if not len(found):
                        rows.append((None, None, 0))
                        continue
                    hi, lo = digest(found)
                    rows.append((hi, lo, len(found)))
                    for band, need, s in signatures(found, percent):
                        n = len(s)
                        held.append((s, np.full(n, hi, np.int64), np.full(n, band, np.uint8), np.full(n, need, np.int32)))
                        count += n
                hi, lo, size = zip(*rows, strict=True)
                n = len(rows)
                yield pa.RecordBatch.from_arrays([ids.slice(i, n), hashes.slice(i, n), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(size, pa.int64()), pa.nulls(n, pa.int32()), *[pa.nulls(n, pa.binary())] * len(names)], ["id", "th", "hi", "lo", "n_shingles", "bucket", *names])
                if count >= FLUSH:
                    yield flush()
                    held.clear()
                    count = 0
        if held:
            yield flush()

    return run, f"id long, th long, hi long, lo long, n_shingles long, {packed_schema(names)}"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The signatures that different sets share, once for each set."""
    for x in unpacked(batches, {"sig": "u8", "sid": "i8", "band": "u1", "need": "i4"}):
        order = np.argsort(x["sig"])
        sig = x["sig"][order]
        start = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        count = np.diff(np.r_[start, len(sig)])
        order = order[np.repeat(count > 1, count)]
        order = order[np.lexsort((x["sid"][order], x["sig"][order]))]
        sig, sid = x["sig"][order], x["sid"][order]
        once = np.r_[True, (sig[1:] != sig[:-1]) | (sid[1:] != sid[:-1])][: len(sig)]
        order, sig, sid = order[once], sig[once], sid[once]
        same = sig[1:] == sig[:-1]
        shared = np.r_[same, False][: len(sig)] | np.r_[False, same][: len(sig)]
        order = order[shared]
        if len(order):
            yield pa.RecordBatch.from_arrays([pa.array(x["sig"][order].view(np.int64)), pa.array(x["sid"][order]), pa.array(x["band"][order].astype(np.int32)), pa.array(x["need"][order])], ["sig", "sid", "band", "need"])


# --- verification -----------------------------------------------------------------------------


def _fetch(width: int):
    """Shingle arrays of the classes' representatives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_view(batch.column("_text"))
            hi, lo = batch.column("hi").to_pylist(), batch.column("lo").to_pylist()
            for i, j in byte_chunks(offsets):
                keep, sets = [], []
                for d, found in enumerate(shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width), i):
                    if len(found) and digest(found) == (hi[d], lo[d]):
                        keep.append(d)
                        sets.append(found.tobytes())
                if keep:
                    at = pa.array(keep)
                    yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in ("hi", "lo", "copies", "label")] + [pa.array(sets, pa.binary())], ["hi", "lo", "copies", "label", "items"])

    return run, "hi long, lo long, copies long, label long, items binary"


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """All pairwise intersection sizes, by blocked products over items that two sets share."""
    m = len(sets)
    who = np.repeat(np.arange(m), [len(s) for s in sets])
    items = np.concatenate(sets)
    order = np.argsort(items, kind="stable")
    items, who = items[order], who[order]
    start = np.flatnonzero(np.r_[True, items[1:] != items[:-1]])
    count = np.diff(np.r_[start, len(items)])
    out = np.zeros(m * m, np.float32)
    for c in range(2, 9):  # rarely shared items: their few pairs are counted one by one
        at = start[count == c]
        if len(at):
            members = who[at[:, None] + np.arange(c)]
            for x, y in combinations(range(c), 2):
                out += np.bincount(members[:, x] * m + members[:, y], minlength=m * m).astype(np.float32)
    out = out.reshape(m, m)
    out += out.T
    wide = np.flatnonzero(count > 8)
    for block in range(0, len(wide), 4096):
        cols = wide[block : block + 4096]
        matrix = np.zeros((m, len(cols)), np.float32)
        sizes = count[cols]
        flat = np.repeat(start[cols], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        matrix[who[flat], np.repeat(np.arange(len(cols)), sizes)] = 1
        out += matrix @ matrix.T
    return out.astype(np.int64)


def forest(adjacent: np.ndarray) -> np.ndarray:
    """The root (least index) of each node's component."""
    m = len(adjacent)
    root = np.full(m, -1)
    for start in range(m):
        if root[start] < 0:
            root[start], frontier = start, np.array([start])
            while len(frontier):
                frontier = np.flatnonzero(adjacent[frontier].any(0) & (root < 0))
                root[frontier] = start
    return root


def _verify(percent: int):
    def tile(keys, sets, copies, side, within):
        size = np.array([len(s) for s in sets])
        inter = intersections(sets)
        linked = 100 * inter >= percent * (size[:, None] + size[None, :] - inter)
        np.fill_diagonal(linked, False)
        if not within:
            linked &= side[:, None] != side[None, :]
        return forest(linked), linked @ copies

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: dict[tuple[int, int], tuple] = {}
        now, out = None, []

        def close():
            if now is not None and len(group) > 1:
                keys = list(group)
                sets, copies, side = zip(*group.values(), strict=True)
                root, degree = tile(keys, sets, np.array(copies), np.array(side), now[1] == now[2])
                out.extend((*keys[k], *keys[root[k]], int(degree[k])) for k in np.flatnonzero(degree))

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("label", "i", "j", "side", "hi", "lo", "copies", "items")), strict=True):
                if row[:3] != now:
                    close()
                    group, now = {}, row[:3]
                group[row[4], row[5]] = (np.frombuffer(row[7], U64), row[6], row[3])
            if len(out) > 10_000:
                yield _links(out)
                out = []
        close()
        if out:
            yield _links(out)

    return run, "hi long, lo long, root_hi long, root_lo long, n_links long"


def _links(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["hi", "lo", "root_hi", "root_lo", "n_links"])


# --- the operator -----------------------------------------------------------------------------


def ngram_jaccard_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, n_links): one row per input row; n_links counts linked rows, copies included."""
    ws = Workspace(df.sparkSession, "ngram-join")
    text = F.col(text_col).cast("string")
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("_text"))
    run, schema = _sign(width, percent, bucket_count(df.sparkSession, 2 * text_bytes(docs, "_text")))
    signed = ws.save(docs.mapInArrow(run, schema), "signed")
    shared = ws.save(by_bucket(signed.where("bucket is not null").select("bucket", "sig", "sid", "band", "need")).mapInArrow(_meet, "sig long, sid long, band int, need int"), "shared")
    for turn in "12":  # a set that shares fewer signatures than any link needs goes, and so do signatures left with one set
        enough = shared.groupBy("sid", "band").agg(F.count("*").alias("n"), F.max("need").alias("least")).where("n >= least").select("sid", "band")
        left = shared.join(enough, ["sid", "band"])
        pivots = left.groupBy("sig").agg(F.min("sid").alias("pivot"), F.max("sid").alias("last")).where("pivot < last").select("sig", "pivot")
        shared = ws.save(left.join(pivots, "sig").select("sig", "sid", "band", "need", "pivot"), f"shared{turn}").drop("pivot") if turn == "1" else left.join(pivots, "sig")
    edges = ws.save(shared.where("sid <> pivot").select(F.col("sid").alias("a"), F.col("pivot").alias("b")).distinct(), "edges")
    ws.drop("shared", "shared1")
    rows = ws.save(signed.where("bucket is null").select("id", "th", "hi", "lo", "n_shingles"), "rows")
    ws.drop("signed")
    labels = components(ws, edges)
    classes = ws.save(rows.where("n_shingles > 0").groupBy("hi", "lo").agg(F.min("id").alias("id"), F.min(F.struct("id", "th")).alias("first"), F.count("*").alias("copies")), "classes")
    # one row of each class gives its text: rows are told apart by (id, text), equal rows by nothing but their number
    wanted = classes.join(labels, F.col("hi") == F.col("node")).select("first.*", "hi", "lo", "copies", "label")
    run, schema = _fetch(width)
    texts = docs.select(F.col("id").alias("_id"), F.col("th").alias("_th"), "_text")
    found = wanted.join(texts, F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))).mapInArrow(run, schema)
    sets = ws.save(found.dropDuplicates(["hi", "lo"]), "sets")
    weight = sets.groupBy("label").agg(F.count("*").alias("m"), F.sum(F.length("items") / 8).alias("items")).where("m > 1").select("label", F.greatest(F.lit(1), F.ceil(F.col("m") / TILE_SETS), F.ceil(F.col("items") / TILE_ITEMS)).cast("int").alias("tiles"))
    side = F.pmod(F.xxhash64("hi", "lo"), F.col("tiles")).cast("int")
    tiles = sets.join(weight, "label").withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other"))
    run, schema = _verify(percent)
    links = ws.save(tiles.select("label", "i", "j", "side", "hi", "lo", "copies", "items").repartition("label", "i", "j").sortWithinPartitions("label", "i", "j").mapInArrow(run, schema), "links")
    ws.drop("sets", "edges")
    key = lambda hi, lo: F.concat_ws(":", hi, lo)
    joined = components(ws, links.select(key("hi", "lo").alias("a"), key("root_hi", "root_lo").alias("b")), "link")
    named = classes.drop("first").withColumn("key", key("hi", "lo"))
    degree = links.groupBy("hi", "lo").agg(F.sum("n_links").alias("n_links"))
    group = F.coalesce("label", "key")
    placed = named.join(joined, named["key"] == joined["node"], "left").select("hi", "lo", "id", "copies", group.alias("group"))
    least = placed.groupBy("group").agg(F.min("id").alias("component_id"))
    known = ws.save(placed.join(least, "group").join(degree, ["hi", "lo"], "left").select("hi", "lo", "component_id", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "known")
    return rows.join(known, ["hi", "lo"], "left").select(
        F.col("id").alias(id_col), "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
