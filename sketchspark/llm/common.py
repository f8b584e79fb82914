"""Plumbing that the training-data operators share.

* ``Workspace``: intermediate tables in the cluster's shared checkpoint folder.
  They cut lineage, survive a lost executor, and let earlier shuffles go.
* ``components``: connected components by alternating large-star and small-star
  steps; every step is a partial aggregation and a join, so no task holds a hub.
* ``byte_chunks`` and ``RollingHash``: vectorised passes over UTF-8 buffers.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Spark drops the shuffle files of a finished write at once, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; in local mode, one of our own if it is unset."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="sketchspark-"))
    return sc.getCheckpointDir()


class Workspace:
    """Written tables of one run of one operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._close)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df, drop the shuffle files behind it, and read it back."""
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        return self.spark.read.parquet(self.path(name))

    def folder(self, name: str) -> str:
        """A new folder for files of a format of one's own."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(p)
        return self.path(name)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.path(name))

    def _delete(self, where: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def _close(self) -> None:
        try:
            if not self.spark.sparkContext._jsc.sc().isStopped():
                self._delete(self.base)
        except Exception:  # noqa: BLE001  the JVM may be gone at exit; the folder is then the cluster's to clean
            return


def components(ws: Workspace, edges: DataFrame, tag: str = "cc") -> DataFrame:
    """(node, label) for every node of edges (a, b); label is the smallest node of its component."""
    stats = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    kind = edges.schema["a"].dataType
    old, turn = "", 0
    e = ws.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{tag}0")
    last = stats(e)
    while last[0]:
        # large star: each node links its larger neighbours to the least node it knows
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: each node links its smaller neighbours and itself to the least of them
        lows = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lows, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(lows.select("a", F.col("m").alias("b"))).distinct()
        turn += 1
        e = ws.save(small, f"{tag}{turn}")
        ws.drop(f"{tag}{turn - 1}")
        now = stats(e)
        if now == last:
            break
        last = now
    labels = e.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()).select(F.col("node").cast(kind), F.col("label").cast(kind))


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a string or binary array without copying; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    n = len(column)
    if offs is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def byte_chunks(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs (i, j) of whole texts of about limit bytes; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, in place on a fresh array."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class RollingHash:
    """64-bit polynomial hashes of any slices of a buffer from one running sum."""

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self) -> None:
        self.letters = mix64(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
        self.up = self.down = np.ones(1, U64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            inverse = pow(self.BASE, -1, 1 << 64)
            for name, base in (("up", self.BASE), ("down", inverse)):
                steps = np.full(n, base, U64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=U64))

    def sums(self, data: np.ndarray) -> np.ndarray:
        self.grow(len(data) + 1)
        out = np.zeros(len(data) + 1, U64)
        np.cumsum(self.letters[data] * self.up[: len(data)], out=out[1:])
        return out

    def slices(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (sums[ends] - sums[starts]) * self.down[starts]

    def windows(self, sums: np.ndarray, k: int) -> np.ndarray:
        return (sums[k:] - sums[:-k]) * self.down[: len(sums) - k]


ROLLING = RollingHash()

#: The separators of the word rule [^\x20\x09-\x0D]+.
SEPARATORS = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20)
IS_WORD = np.ones(256, bool)
IS_WORD[list(SEPARATORS)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def word_spans(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words in data; a word never crosses a text's start."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = IS_WORD[data]
    opens = word.copy()
    opens[1:] &= ~word[:-1]
    cuts = starts[starts < n]
    opens[cuts] = word[cuts]
    begin = np.flatnonzero(opens)
    closes = word.copy()
    closes[:-1] &= ~word[1:]
    before = cuts[cuts > 0] - 1
    closes[before] |= word[before]
    return begin, np.flatnonzero(closes) + 1


# --- shuffling columns of numbers as packed arrays --------------------------------------------


def text_bytes(df: DataFrame, column: str) -> int:
    """Bytes of a column, counted."""
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def bucket_count(spark: SparkSession, total: int, bytes_each: int = 32 << 20) -> int:
    """Buckets for `packed`, from the counted bytes of all arrays: one bucket stays in a task's memory at any size."""
    return int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-total // bytes_each), 1 << 30)))


def spare_names(columns: list[str], *own: str) -> dict[str, str]:
    """New names, with leading underscores, of those columns that have a name of the operator's own."""
    out: dict[str, str] = {}
    for c in columns:
        if c in own:
            new = f"_{c}"
            while new in columns or new in own or new in out.values():
                new = f"_{new}"
            out[c] = new
    return out


def packed_schema(names: list[str]) -> str:
    return "bucket int, " + ", ".join(f"{n} binary" for n in names)


def packed(bucket: np.ndarray, arrays: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row per bucket that holds the rows of all arrays as compressed bytes."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    order = np.argsort(bucket, kind="stable")
    sorted_to = bucket[order]
    cuts = np.flatnonzero(np.r_[True, sorted_to[1:] != sorted_to[:-1]]) if len(order) else np.zeros(0, np.int64)
    ends = np.r_[cuts[1:], len(order)]
    out = {"bucket": pa.array(sorted_to[cuts].astype(np.int32), pa.int32())}
    for name, values in arrays.items():
        values = values[order]
        out[name] = pa.array([squeeze(values[a:b].tobytes()) for a, b in zip(cuts, ends, strict=True)], pa.binary())
    return pa.RecordBatch.from_pydict(out)


def unpacked(batches: Iterator[pa.RecordBatch], kinds: dict[str, str]) -> Iterator[dict[str, np.ndarray]]:
    """The arrays of one bucket after another, from rows that are sorted by bucket."""
    import zstandard

    grow = zstandard.ZstdDecompressor().decompress
    held: dict[str, list[np.ndarray]] = {n: [] for n in kinds}
    now = None
    for batch in batches:
        buckets = batch.column("bucket").to_pylist()
        columns = {n: batch.column(n) for n in kinds}
        for row, bucket in enumerate(buckets):
            if now is not None and bucket != now:
                yield {n: np.concatenate(v) for n, v in held.items()}
                held = {n: [] for n in kinds}
            now = bucket
            for n, kind in kinds.items():
                held[n].append(np.frombuffer(grow(columns[n][row].as_py()), kind))
    if now is not None:
        yield {n: np.concatenate(v) for n, v in held.items()}


def by_bucket(df: DataFrame) -> DataFrame:
    return df.repartition("bucket").sortWithinPartitions("bucket")
