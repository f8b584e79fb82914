"""Conflict-constrained best-fit packing of documents into sequences.

Two documents conflict if they share a source or a duplicate cluster (the same text after
normalisation).  Documents go, longest first, into the open bin with the least residual
that holds them and carries neither their source nor their cluster: the search starts at
the successor of the length in the residual order and goes on until a bin's two bitmaps
have no bit of the document.  Without one, a bin is opened.  A document longer than a bin
fills bins of its own with whole pieces, and its last piece is packed.

Documents are dealt to shards by a hash of the row and its place in the measured table, about
``shard_docs`` in each, and a shard is packed by one task; a hot source and repeated rows are
spread like all else, and every shard's work is bounded.  A bin never mixes shards, so its constraint is checked in full.

Length is the number of words unless ``length_col`` is given.

Defined results: null or empty text (length 0) gets one row with a null bin; a null source
conflicts with nothing; repeated rows are separate documents of one cluster; items of equal
length go by id, cluster and source; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, byte_chunks, byte_view, word_spans
from .line_dedup import normalise


def best_fit(lengths: list[int], sources: list[int], clusters: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin of each item, residual of each bin); items are taken in the given order; -1 is no source or cluster.

    The search for equal items starts where the last of them ended: bins that took or refused one
    refuse all that follow, as bitmaps only gain bits and residuals only shrink."""
    order: list[int] = []  # residual << 32 | bin
    residual: list[int] = []
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    out = []
    last: tuple[int, int, int] | None = None
    floor = 0
    for length, source, cluster in zip(lengths, sources, clusters, strict=True):
        s, c = (1 << source if source >= 0 else 0), (1 << cluster if cluster >= 0 else 0)
        floor = floor if (length, source, cluster) == last and (s or c) else length << 32
        last = (length, source, cluster)
        at = bisect_left(order, floor)
        while at < len(order):
            bin_ = order[at] & 0xFFFFFFFF
            if not (source_bits[bin_] & s or cluster_bits[bin_] & c):
                floor = order[at]
                del order[at]
                break
            at += 1
        else:
            floor = (capacity + 1) << 32
            bin_ = len(residual)
            residual.append(capacity)
            source_bits.append(0)
            cluster_bits.append(0)
        residual[bin_] -= length
        source_bits[bin_] |= s
        cluster_bits[bin_] |= c
        if residual[bin_]:
            insort(order, residual[bin_] << 32 | bin_)
        out.append(bin_)
    return out, residual


def _measure_stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, source, cluster, length) of each document."""
    for batch in batches:
        data, offsets = byte_view(batch.column(2))
        view = memoryview(data)
        length, cluster = [], []
        for i, j in byte_chunks(offsets, 4 << 20):
            own = offsets[i : j + 1] - offsets[i]
            begin, _ = word_spans(data[offsets[i] : offsets[j]], own[:-1])
            length.append(np.diff(np.searchsorted(begin, own)))
            cluster += [xxhash.xxh3_64_intdigest(normalise(bytes(view[a:b]))) for a, b in zip(offsets[i:j], offsets[i + 1 : j + 1], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(cluster, np.uint64).view(np.int64)), pa.array(np.concatenate(length) if length else np.zeros(0, np.int64))], ["id", "source", "cluster", "length"])


def _pack_stage(capacity: int):
    names = ["id", "piece", "start", "n_words", "bin_id", "place", "residual"]

    def pack(shard: int, rows: list[tuple]) -> pa.RecordBatch:
        rows.sort(key=lambda r: (-(r[3] % capacity), -r[3], r[0] is None, r[0] or 0, r[2], r[1] is None, r[1] or ""))
        named = {s: i for i, s in enumerate(sorted({r[1] for r in rows if r[1] is not None}))}
        often = {c: i for i, c in enumerate(c for c, n in Counter(r[2] for r in rows).items() if n > 1)}
        short = [r for r in rows if r[3] % capacity]
        bins, residual = best_fit([r[3] % capacity for r in short], [named.get(r[1], -1) for r in short], [often.get(r[2], -1) for r in short], capacity)
        out, used, full = [], Counter(), len(residual)
        for r, b in zip(short, bins, strict=True):
            whole = r[3] // capacity
            out.append((r[0], whole, whole * capacity, r[3] % capacity, shard << 32 | b, used[b], residual[b]))
            used[b] += 1
        for r in rows:
            for piece in range(r[3] // capacity):
                out.append((r[0], piece, piece * capacity, capacity, shard << 32 | full, 0, 0))
                full += 1
            if not r[3]:
                out.append((r[0], 0, 0, 0, None, None, None))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None
        for batch in batches:
            for shard, *row in zip(*(batch.column(c).to_pylist() for c in ("shard", "id", "source", "cluster", "length")), strict=True):
                if now is not None and shard != now:
                    yield pack(now, held)
                    held = []
                now = shard
                held.append(tuple(row))
        if held:
            yield pack(now, held)

    return run, ", ".join(f"{n} long" for n in names)


def best_fit_pack(df: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str | None = None, shard_docs: int = 8192) -> DataFrame:
    """(id, piece, start, n_words, bin_id, place, residual): one row per packed piece; start counts the document's words before it."""
    ws = Workspace(df.sparkSession, "packing")
    columns = [F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")]
    measured = df.select(*columns).mapInArrow(_measure_stage, "id long, source string, cluster long, length long")
    if length_col:
        measured = df.select(columns[0], columns[1], F.xxhash64(columns[2]).alias("cluster"), F.coalesce(F.col(length_col).cast("long"), F.lit(0)).alias("length"))
    rows = ws.save(measured, "rows")
    shards = max(1, -(-rows.count() // shard_docs))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id", "cluster", "length", F.monotonically_increasing_id()), F.lit(shards)).cast("long"))
    run, schema = _pack_stage(capacity)
    return dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, schema).withColumnRenamed("id", id_col)
