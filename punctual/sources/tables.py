"""Columnar tables, metric tables and write-once partitions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession

from punctual.operators.project import require_columns


def read_table_pruned(spark: SparkSession, path: str, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns that the table has, in the wanted order."""
    df = spark.read.parquet(path)
    have = set(df.columns)
    return df.select(*[c for c in wanted if c in have])


def write_table(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    sort_by: Sequence[str] = (),
    mode: str = "overwrite",
) -> str:
    """Parquet sink.  Partition columns cluster the rows first, so a partition gets few files;
    ``rebalance`` splits partitions that are too large, hence a hot month is no hot task."""
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    if sort_by:
        df = df.sortWithinPartitions(*partition_by, *sort_by)
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)
    return path


def write_metrics(df: DataFrame, path: str) -> str:
    """Small metric table as one CSV file with a header."""
    df.repartition(1).write.mode("overwrite").option("header", True).csv(path)
    return path


def read_metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def cached_partition(
    spark: SparkSession,
    path: str,
    build: Callable[[], DataFrame],
    keep: Column | None = None,
    overwrite: bool = False,
) -> DataFrame:
    """A part that is built and written once, then read.

    The stored part is unfiltered and ``keep`` applies to the read, so the same part serves
    any filter.
    """
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    there = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)
    if overwrite or not there:
        build().write.mode("overwrite").parquet(path)
    part = spark.read.parquet(path)
    return part if keep is None else part.where(keep)


__all__ = [
    "read_table_pruned", "write_table", "write_metrics", "read_metrics", "cached_partition", "require_columns",
]
