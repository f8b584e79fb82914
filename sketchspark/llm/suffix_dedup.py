"""Repeated-substring removal with a sparse suffix array, sorted deep-shallow.

A byte goes if some ``length``-byte string that covers it starts anywhere else in the
corpus.  A suffix for every byte would be many times the corpus, so the array is sparse:

1. Anchors.  Each window of ``length`` bytes picks the k-gram with the least hash in it
   (the leftmost on ties).  Equal windows pick the same offset, so windows are equal only
   if their anchors' k-grams are.  About 2 / (length - k) of all positions are anchors;
   the windows lo..hi that pick one anchor span its region text[lo : hi + length].
2. Anchors move once, as packed arrays by k-gram hash.  Equal regions (128 bits of hash)
   repeat whole.  A region that is alone, but whose k-gram is not, is open.  Before they move,
   the copies of a region in one part of the input are known to repeat: one of them goes to
   the k-gram's bucket, the others elsewhere, so a passage with any number of copies sends
   one anchor from each part to one bucket.
3. Open regions and one of each equal region of the same k-gram are suffix sorted: the
   contexts right of the k-gram and, reversed, left of it are ordered deep-shallow -
   multikey quicksort on bytes to a shallow depth, then a blind trie for each group that
   still shares its prefix.  With the two arrays' common-prefix lengths, the window at
   offset o is repeated iff another region is in the same class of both orders at depths
   length - k - o and o.
4. A k-gram with more than ``crowd`` distinct regions is not brought into one task: its
   windows are dealt to ranges of offsets, and regions meet only if they agree in all that
   the windows of a range have in common.  Should more than ``hash_from`` regions agree
   there, their windows are hashed (128 bits) and counted by partial aggregation instead.
   The results are the same in all three ways.

Defined results: null text is empty; text shorter than ``length`` keeps everything; a
repeated row repeats all its windows; rows are told apart by (id, text), so equal or null
ids are fine; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROLLING, U64, Workspace, bucket_count, by_bucket, byte_chunks, byte_view, mix64, packed, packed_schema, text_bytes, unpacked

SHALLOW = 16
FLUSH = 1 << 18
PLACE_BITS = 22  # positions inside a chunk of at most 4 MB
STEP = 1 << 21  # a longer text is cut into chunks that overlap by a window


# --- anchors ----------------------------------------------------------------------------------


def sliding_argmin(keys: np.ndarray, width: int) -> np.ndarray:
    """Position of the least key (leftmost on ties) in every window, by block-wise running minima."""
    n = len(keys)
    mask = U64((1 << PLACE_BITS) - 1)
    keys = (keys & ~mask) | np.arange(n, dtype=U64)
    full = np.full(-(-n // width) * width, np.iinfo(U64).max, U64)
    full[:n] = keys
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[: n - width + 1], ahead[width - 1 : n]) & mask).astype(np.int64)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(gram, region, at, lo, hi) of all anchors of texts that lie one after another in data."""
    if len(data) < length:
        return tuple(np.zeros(0, t) for t in (U64, U64, np.int64, np.int64, np.int64))
    grams = mix64(ROLLING.windows(ROLLING.sums(data), k))
    at = sliding_argmin(grams, length - k + 1)
    step = np.zeros(len(data) + 1, np.int32)
    np.add.at(step, offsets[:-1], 1)
    np.add.at(step, np.maximum(offsets[:-1], offsets[1:] - length + 1), -1)
    window = np.flatnonzero(np.cumsum(step[:-1])[: len(at)] > 0)
    at = at[window]
    start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]][: len(at)])
    lo, hi, at = window[start], window[np.r_[start[1:], len(window)] - 1] if len(start) else window[start], at[start]
    view, digest = memoryview(data), xxhash.xxh3_64_intdigest
    region = np.fromiter((digest(view[a:b]) for a, b in zip(lo.tolist(), (hi + length).tolist(), strict=True)), U64, len(lo))
    return grams[at], region, at, lo, hi


KINDS = {"gram": "u8", "region": "u8", "id": "i8", "null_id": "u1", "text": "i8", "at": "i4", "lo": "i4", "hi": "i4", "mark": "u1"}
ONE_OF_MANY, KNOWN = 1, 2  # marks: stands for copies in its part of the input, is one of those


def _anchor_stage(length: int, k: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def flush() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            gram, region = columns[:2]
            order = np.lexsort((region, gram))
            new = np.r_[True, (gram[order][1:] != gram[order][:-1]) | (region[order][1:] != region[order][:-1])]
            many = ~new | np.r_[~new[1:], False]
            mark = np.zeros(len(gram), np.uint8)
            mark[order[many]] = np.where(new[many], ONE_OF_MANY, KNOWN)
            where = np.where(mark == KNOWN, mix64(columns[4].view(U64) + columns[5].astype(U64)), gram) % U64(buckets)
            return packed(where.astype(np.int32), dict(zip(KINDS, [*columns, mark], strict=True)))

        for batch in batches:
            ids = batch.column(0)
            null_id = np.asarray(ids.is_null()).astype(np.uint8)
            ids = np.asarray(ids.fill_null(0))
            hashes = np.asarray(batch.column(2))
            data, offsets = byte_view(batch.column(1))
            for i, j in byte_chunks(offsets):
                begin, end = int(offsets[i]), int(offsets[j])
                for cut in range(begin, max(begin + 1, end - length + 1), STEP):
                    stop = min(end, cut + STEP + length - 1)
                    own = np.clip(offsets[i : j + 1], cut, stop) - cut
                    gram, region, at, lo, hi = anchors(data[cut:stop], own, length, k)
                    if not len(gram):
                        continue
                    doc = i + np.searchsorted(own, lo, "right") - 1
                    base = offsets[doc] - cut
                    held.append((gram, region, ids[doc], null_id[doc], hashes[doc], *[(x - base).astype(np.int32) for x in (at, lo, hi)]))
                    count += len(gram)
            if count >= FLUSH:
                yield flush()
                held, count = [], 0
        if held:
            yield flush()

    return run, packed_schema(list(KINDS))


def _match_stage(length: int, crowd: int):
    """Repeated spans of regions that repeat whole; open regions with what they are to be compared with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in unpacked(batches, KINDS):
            known = x["mark"] == KNOWN
            done = np.flatnonzero(known)
            order = np.flatnonzero(~known)
            order = order[np.lexsort((x["region"][order], x["gram"][order]))]
            gram, region = x["gram"][order], x["region"][order]
            new_gram = np.r_[True, gram[1:] != gram[:-1]][: len(order)]
            new = (new_gram | np.r_[True, region[1:] != region[:-1]])[: len(order)] if len(order) else new_gram
            first = np.flatnonzero(new)
            rows_of = np.diff(np.r_[first, len(order)])
            copies = np.add.reduceat(1 + (x["mark"][order] == ONE_OF_MANY), first) if len(first) else rows_of
            whole = np.repeat(copies > 1, rows_of)
            group = np.cumsum(new_gram)[first] - 1  # of distinct regions
            members, alone = np.bincount(group), np.bincount(group, copies == 1) > 0
            asked = (members > 1) & alone
            for rows, kind in ((np.r_[done, order[whole]], 0), (order[first[asked[group]]], 1)):
                if len(rows):
                    n = len(rows)
                    many = members[group[asked[group]]] > crowd if kind else np.zeros(n, bool)
                    single = copies[asked[group]] == 1 if kind else np.zeros(n, bool)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, kind, np.int32)), pa.array(x["id"][rows], mask=x["null_id"][rows] > 0), pa.array(x["text"][rows]), pa.array(x["gram"][rows].view(np.int64)), *[pa.array(x[c][rows]) for c in ("at", "lo", "hi")], pa.array(single), pa.array(many)],
                        ["kind", "id", "th", "gram", "at", "lo", "hi", "open", "crowded"],
                    )

    return run, "kind int, id long, th long, gram long, at int, lo int, hi int, open boolean, crowded boolean"


# --- deep-shallow sorting -----------------------------------------------------------------------


def shared_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    return n if a == b else n - 1 - ((int.from_bytes(a) ^ int.from_bytes(b)).bit_length() - 1) // 8


class BlindTrie:
    """Orders strings that share a prefix: branch nodes hold only a depth and the bytes that tell children apart."""

    END = -1  # sorts before every byte

    def __init__(self, texts: list[bytes]):
        self.texts, self.root = texts, None

    def _byte(self, i: int, depth: int) -> int:
        t = self.texts[i]
        return t[depth] if depth < len(t) else self.END

    def insert(self, i: int) -> None:
        if self.root is None:
            self.root = [i]
            return
        node = self.root  # blind descent: compare branch bytes only
        while isinstance(node, tuple):
            depth, children = node
            node = children.get(self._byte(i, depth)) or next(iter(children.values()))
        other = node[0]
        if self.texts[i] == self.texts[other]:
            node.append(i)
            return
        split = shared_prefix(self.texts[i], self.texts[other])
        above, key, node = None, None, self.root  # second descent, to the depth where they part
        while isinstance(node, tuple) and node[0] < split:
            above, key = node, self._byte(i, node[0])
            node = node[1][key]
        if isinstance(node, tuple) and node[0] == split:
            node[1][self._byte(i, split)] = [i]
            return
        branch = (split, {self._byte(other, split): node, self._byte(i, split): [i]})
        if above is None:
            self.root = branch
        else:
            above[1][key] = branch

    def ordered(self) -> list[int]:
        out, stack = [], [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
            else:
                out.extend(node)
        return out


def deep_shallow_sort(texts: list[bytes], which: list[int], shallow: int = SHALLOW) -> list[int]:
    """The members of which in the order of their texts."""
    out: list[int] = []
    stack = [(which, 0)]
    while stack:
        part, depth = stack.pop()
        if len(part) < 2:
            out.extend(part)
        elif depth >= shallow:
            trie = BlindTrie(texts)
            for i in part:
                trie.insert(i)
            out.extend(trie.ordered())
        else:  # multikey quicksort: three ways by the bytes at this depth
            keys = [texts[i][depth] if depth < len(texts[i]) else -1 for i in part]
            pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
            low = [i for i, c in zip(part, keys, strict=True) if c < pivot]
            same = [i for i, c in zip(part, keys, strict=True) if c == pivot]
            high = [i for i, c in zip(part, keys, strict=True) if c > pivot]
            stack.append((high, depth))
            stack.append((same, shallow if pivot < 0 else depth + 1))
            stack.append((low, depth))
    return out


def _sorted_classes(groups: list[list[int]], texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each text, common prefix of each rank with the one before; -1 at a group's start)."""
    order: list[int] = []
    common: list[int] = []
    for members in groups:
        run = deep_shallow_sort(texts, members)
        common.append(-1)
        common.extend(shared_prefix(texts[a], texts[b]) for a, b in zip(run, run[1:], strict=False))
        order.extend(run)
    rank = np.empty(len(texts), np.int64)
    rank[order] = np.arange(len(order))
    return rank, np.array(common)


def repeated_windows(gram: list[int], left: list[bytes], right: list[bytes], k: int, length: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """flags[i, o]: the window that starts o bytes before region i's k-gram, first <= o <= last, is in another region."""
    groups: dict[int, list[int]] = {}
    for i, g in enumerate(gram):
        groups.setdefault(g, []).append(i)
    members = list(groups.values())
    rank_r, common_r = _sorted_classes(members, right)
    rank_l, common_l = _sorted_classes(members, left)
    flags = np.zeros((len(gram), length - k + 1), bool)
    for o in range(int(first.min()), int(last.max()) + 1):
        here = np.flatnonzero((first <= o) & (o <= last))
        if len(here) < 2:
            continue
        key = np.cumsum(common_r < length - k - o)[rank_r[here]] * (len(gram) + 1) + np.cumsum(common_l < o)[rank_l[here]]
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        flags[here[order[np.flatnonzero(same)]], o] = True
        flags[here[order[np.flatnonzero(same) + 1]], o] = True
    return flags


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.r_[0, flags.astype(np.int8), 0])
    return np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)


def _region_stage(length: int):
    """The text of asked regions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gram", "open", "crowded", "id", "th", "at", "lo", "hi", "region"]
        for batch in batches:
            data, offsets = byte_view(batch.column("_text"))
            view, out = memoryview(data), []
            for d, (id_, th, asked) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("id", "th", "asked")), strict=True)):
                base = int(offsets[d])
                out.extend((r["gram"], r["open"], r["crowded"], id_, th, r["at"], r["lo"], r["hi"], bytes(view[base + r["lo"] : base + r["hi"] + length])) for r in asked)
                if len(out) > 4000 or d == batch.num_rows - 1:
                    if out:
                        kinds = [pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                    out = []

    return run, "gram long, open boolean, crowded boolean, id long, th long, at int, lo int, hi int, region binary"


SPAN = "id long, th long, lo int, hi int"


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    ids, th, lo, hi = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(th, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], ["id", "th", "lo", "hi"])


def _sort_stage(length: int, k: int, limit: int = 20_000):
    """Repeated window starts lo..hi of open regions, a batch of whole groups at a time."""

    def solve(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if len(rows) < 2:
            return
        gram, opened, ids, th, at, lo, hi, region = zip(*rows, strict=True)
        at_, lo_, hi_ = np.array(at), np.array(lo), np.array(hi)
        left = [r[: a - b][::-1] for r, a, b in zip(region, at, lo, strict=True)]
        right = [r[a - b + k :] for r, a, b in zip(region, at, lo, strict=True)]
        flags = repeated_windows(list(gram), left, right, k, length, at_ - hi_, at_ - lo_)
        out = []
        for i in np.flatnonzero(np.array(opened) & flags.any(1)):
            for a, b in zip(*_runs(flags[i]), strict=True):
                out.append((ids[i], th[i], at[i] - int(b) + 1, at[i] - int(a)))
        if out:
            yield _spans(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("gram", "open", "id", "th", "at", "lo", "hi", "region")), strict=True):
                if len(held) >= limit and held[-1][0] != row[0]:
                    yield from solve(held)
                    held = []
                held.append(row)
        yield from solve(held)

    return run, SPAN


def _split_stage(length: int, k: int, ranges: int = 8):
    """Regions of a crowded k-gram by ranges of window offsets; the new gram is a hash of what a range's windows share."""
    step = -(-(length - k + 1) // ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for gram, opened, id_, th, at, lo, hi, region in zip(*(batch.column(c).to_pylist() for c in ("gram", "open", "id", "th", "at", "lo", "hi", "region")), strict=True):
                for a in range(0, length - k + 1, step):
                    low, high = at - min(a + step - 1, at - lo), at - max(a, at - hi)
                    if low <= high:
                        shared = region[at - a - lo : at - a - step + 1 + length - lo]
                        out.append((xxhash.xxh3_64_intdigest(shared, gram % (1 << 64) ^ a) - (1 << 63), opened, id_, th, at, low, high, region[low - lo : high - lo + length]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["gram", "open", "id", "th", "at", "lo", "hi", "region"])

    return run, "gram long, open boolean, id long, th long, at int, lo int, hi int, region binary"


def _window_stage(length: int):
    """Every window of a crowded region, as a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for opened, id_, th, lo, hi, region in zip(*(batch.column(c).to_pylist() for c in ("open", "id", "th", "lo", "hi", "region")), strict=True):
                n = hi - lo + 1
                keys = [xxhash.xxh3_128_digest(region[s : s + length]) for s in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([opened] * n), pa.array([id_] * n, pa.int64()), pa.array([th] * n, pa.int64()), pa.array(np.arange(lo, hi + 1, dtype=np.int32))], ["key", "open", "id", "th", "lo"])

    return run, "key binary, open boolean, id long, th long, lo int"


# --- the result ---------------------------------------------------------------------------------


def _cut_stage(length: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_view(batch.column("_text"))
            out = []
            for d, spans in enumerate(batch.column("spans").to_pylist()):
                text = data[offsets[d] : offsets[d + 1]]
                begin = end = np.zeros(0, np.int64)
                kept = text
                if spans:
                    step = np.zeros(len(text) + 1, np.int32)
                    np.add.at(step, [s["lo"] for s in spans], 1)
                    np.add.at(step, [s["hi"] + length for s in spans], -1)
                    gone = np.cumsum(step[:-1]) > 0
                    begin, end = _runs(gone)
                    kept = text[~gone]
                row = (len(text), int((end - begin).sum()), len(begin), hashlib.sha256(kept).hexdigest())
                out.append((*row, [{"start": int(a), "end": int(b)} for a, b in zip(begin, end, strict=True)], kept.tobytes()) if with_text else row)
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "kept"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
            columns = list(zip(*out, strict=True)) if out else [[]] * (6 if with_text else 4)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=False)]], ["id", *names[: len(columns)]])

    return run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", removed array<struct<start: long, end: long>>, kept binary" if with_text else "")


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, gram: int | None = None, crowd: int = 256, hash_from: int = 20_000, with_text: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, removed, kept]): one row per input row.

    gram: bytes of an anchor's k-gram, about a third of length by default."""
    k = gram or max(1, length * 8 // 25)
    ws = Workspace(df.sparkSession, "suffix-dedup")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(F.col(id_col).cast("long").alias("id"), text.alias("_text")).withColumn("_th", F.xxhash64("_text"))
    run, schema = _anchor_stage(length, k, bucket_count(df.sparkSession, text_bytes(docs, "_text") // 2))
    match, matched = _match_stage(length, crowd)
    found = ws.save(by_bucket(docs.mapInArrow(run, schema)).mapInArrow(match, matched), "found")
    whole = found.where("kind = 0").select("id", "th", "lo", "hi")
    asked = found.where("kind = 1").groupBy("id", "th").agg(F.collect_list(F.struct("gram", "open", "crowded", "at", "lo", "hi")).alias("asked"))
    texts = docs.withColumnRenamed("id", "_id")
    mine = F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))
    run, schema = _region_stage(length)
    regions = ws.save(texts.join(asked, mine).select("id", "th", "asked", "_text").mapInArrow(run, schema), "regions")
    run, schema = _split_stage(length, k)
    parts = ws.save(regions.where("crowded").mapInArrow(run, schema), "parts")
    agree = parts.groupBy("gram").count().where(F.col("count") > hash_from).select("gram")
    run, schema = _sort_stage(length, k)
    alike = regions.where("not crowded").select(*parts.columns).unionAll(parts.join(agree, "gram", "left_anti").select(*parts.columns))
    sorted_ = alike.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, schema)
    run, schema = _window_stage(length)
    windows = parts.join(agree, "gram").mapInArrow(run, schema)
    twice = windows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    counted = windows.where("open").join(twice, "key").select("id", "th", "lo", F.col("lo").alias("hi"))
    spans = ws.save(whole.unionByName(sorted_).unionByName(counted).groupBy("id", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "spans")
    ws.drop("found", "regions", "parts")
    run, schema = _cut_stage(length, with_text)
    out = texts.join(spans, mine, "left").select(F.col("_id").alias("id"), "_text", "spans").mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)
