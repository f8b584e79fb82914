"""Sketches over event-time windows: the same state rows, in batch and in streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.hashing import hash64
from ..operators.cardinality import _bucket, _rank


def windowed_hll(df: DataFrame, col: str, ts: str, width: str = "1 hour", p: int = 12, watermark: str | None = None, strategy: str = "md5_64") -> DataFrame:
    """(window_start, bucket, value): registers of each tumbling window; state is 2^p rows a window at most.

    In a stream, rows later than the watermark are dropped and closed windows are emitted."""
    rows = df.withWatermark(ts, watermark) if watermark else df
    hashed = rows.where(F.col(col).isNotNull()).select(F.col(ts), hash64(col, strategy).alias("_h"))
    slots = hashed.select(F.col(ts), _bucket(F.col("_h"), p).alias("bucket"), _rank(F.col("_h"), p).cast("int").alias("value"))
    out = slots.groupBy(F.window(ts, width), "bucket").agg(F.max("value").alias("value"))
    return out.select(F.col("window.start").alias("window_start"), "bucket", "value")


def windowed_counts(df: DataFrame, col: str, ts: str, width: str = "1 hour", slide: str | None = None, watermark: str | None = None) -> DataFrame:
    """(window_start, item, count): exact counts a window, from which frequent items are cut."""
    rows = df.withWatermark(ts, watermark) if watermark else df
    out = rows.groupBy(F.window(ts, width, slide) if slide else F.window(ts, width), F.col(col).alias("item")).agg(F.count("*").alias("count"))
    return out.select(F.col("window.start").alias("window_start"), "item", "count")


def write_state(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append closed windows' state to Parquet, where batch jobs merge it further."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).start()
