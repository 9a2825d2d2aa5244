"""Landed postings as a partitioned Parquet dataset, read back with pruning.

Layout: ``source=<board>/posted_date=<yyyy-MM-dd>/``; unknown dates land in
the default (NULL) partition, which every window read keeps. A read for a
run asks only for enabled boards and dates inside the window, so partition
pruning skips everything else and the exact timestamp test is pushed to the
Parquet reader.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timestamps import window_cutoff


def write_landed(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Rows of a (board, day) are dealt to one task, and to as many as their
    bytes need (``spark.sql.adaptive.advisoryPartitionSizeInBytes`` each) where
    they are many: adaptive execution splits and merges the rebalanced
    partitions by size, so small days are one file and large ones are not
    written by one task."""
    dated = df.withColumn("posted_date", F.to_date("posted_at"))
    (dated.hint("rebalance", "source", "posted_date")
          .write.mode(mode).partitionBy("source", "posted_date").parquet(path))


def read_landed(spark: SparkSession, path: str, boards: list[str], run_ts: str, hours: float) -> DataFrame:
    cutoff = window_cutoff(run_ts, hours)
    cutoff_day = _dt.date(cutoff.year, cutoff.month, cutoff.day).isoformat()
    df = spark.read.parquet(path)
    keep = (F.col("source").isin(boards)
            & (F.col("posted_date").isNull() | (F.col("posted_date") >= F.to_date(F.lit(cutoff_day))))
            & (F.col("posted_at").isNull() | (F.col("posted_at") >= F.to_timestamp(F.lit(cutoff.isoformat(sep=" "))))))
    return df.filter(keep)
