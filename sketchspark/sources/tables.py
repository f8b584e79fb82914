"""Reading inputs and keeping sketch state as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def write_state(state: DataFrame, path: str, mode: str = "append") -> None:
    """State rows merge by the same aggregation that built them, so appending a part is merging it."""
    state.write.mode(mode).parquet(path)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
