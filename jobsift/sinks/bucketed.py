"""The tracker as hash-partitioned Parquet: ``<root>/buckets-<n>/bucket=<b>/``.

A posting's bucket is a hash of its URL. A batch touches the buckets of its own
URLs only: those are read, merged and written by Spark's dynamic partition
overwrite, and all others keep their files, so a batch costs what its buckets
hold, however large the tracker is. Readers probe by (bucket, url): the bucket
is a partition column, so a probe with few URLs prunes all other buckets at run
time and streams the rest without a shuffle.

A batch is applied once, whatever stops it: its applications are written to
``<root>/_staged/<stream>/<batch>`` first and read from there when it is
replayed; the merged buckets follow; then the buckets are overwritten from that
copy, which may be repeated as long as the batch is not marked done. One writer
at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import delete_folder
from . import tracker

#: Buckets of a new tracker. A bucket is one task's work: ``rebucket`` when
#: buckets outgrow that (a million rows or so each).
BUCKETS = 64
SCHEMA = T.StructType([*tracker.TRACKED_SCHEMA.fields, T.StructField("bucket", T.IntegerType())])


def bucket_of(url: str | Column, n: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(n)).cast("int").alias("bucket")


def _path(spark: SparkSession, path: str):
    hp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hp, hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    hp, fs = _path(spark, path)
    return fs.exists(hp)


def _names(spark: SparkSession, path: str) -> list[str]:
    hp, fs = _path(spark, path)
    return [st.getPath().getName() for st in fs.listStatus(hp)] if fs.exists(hp) else []


def _mark_done(spark: SparkSession, folder: str) -> None:
    hp, fs = _path(spark, f"{folder}/done")
    fs.create(hp, True).close()


def bucket_count(spark: SparkSession, root: str) -> int | None:
    """Buckets of the tracker: those of its finest complete layout."""
    counts = sorted((int(n.split("-")[1]) for n in _names(spark, root) if n.startswith("buckets-")), reverse=True)
    return next((n for n in counts if _exists(spark, f"{root}/buckets-{n}/_SUCCESS")), None)


def create(spark: SparkSession, root: str, buckets: int = BUCKETS, rows: DataFrame | None = None) -> None:
    """A tracker with ``rows`` (one per URL; none by default)."""
    rows = tracker.empty_tracked(spark) if rows is None else rows.select(*tracker.TRACKED_SCHEMA.names)
    dealt = rows.withColumn("bucket", bucket_of("url", buckets)).repartition("bucket")
    dealt.write.partitionBy("bucket").parquet(f"{root}/buckets-{buckets}")


def rebucket(spark: SparkSession, root: str, buckets: int) -> None:
    """Deals the rows to more buckets. The finer layout counts once it is
    complete; readers of the coarser one must have ended before it goes."""
    old = bucket_count(spark, root)
    if old is None or buckets <= old:
        raise ValueError(f"the tracker has {old} buckets; {buckets} are not more")
    if _exists(spark, f"{root}/buckets-{buckets}"):  # left by a stopped call
        delete_folder(spark, f"{root}/buckets-{buckets}")
    create(spark, root, buckets, read(spark, root))
    delete_folder(spark, f"{root}/buckets-{old}")


def read(spark: SparkSession, root: str, buckets: list[int] | None = None) -> DataFrame:
    """The tracker (its columns and ``bucket``), or some of its buckets: those
    folders alone are listed. The number of buckets is in the column's metadata."""
    n = bucket_count(spark, root)
    base = f"{root}/buckets-{n}"
    paths = [base] if buckets is None else [p for b in buckets if _exists(spark, p := f"{base}/bucket={b}")]
    if n is None or not paths:
        df = spark.createDataFrame([], SCHEMA)
    else:
        df = spark.read.schema(SCHEMA).option("basePath", base).parquet(*paths)
    return df.withMetadata("bucket", {"buckets": n or BUCKETS})


def apply(spark: SparkSession, root: str, stream: str, batch: int, applications: Callable[[], DataFrame], run_ts: str,
          buckets: int = BUCKETS) -> None:
    """Merges a batch's applications into the tracker, once. ``applications``
    is not called where the batch was staged before."""
    folder = f"{root}/_staged/{stream}/{batch:012d}"
    if _exists(spark, f"{folder}/done"):
        return
    if bucket_count(spark, root) is None:
        create(spark, root, buckets)
    n = bucket_count(spark, root)
    if not _exists(spark, f"{folder}/merged/_SUCCESS"):
        if not _exists(spark, f"{folder}/applications/_SUCCESS"):
            apps = applications()
            if {"role_ord", "rank"} <= set(apps.columns):
                apps = tracker.last_write_per_url(apps, ["role_ord", "rank"])
            tracker.as_tracked(apps, run_ts).write.mode("overwrite").parquet(f"{folder}/applications")
        new = spark.read.schema(tracker.TRACKED_SCHEMA).parquet(f"{folder}/applications")
        touched = sorted(r["bucket"] for r in new.select(bucket_of("url", n)).distinct().collect())  # n at most
        merged = tracker.merge(read(spark, root, touched), new).withColumn("bucket", bucket_of("url", n))
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/merged")
    staged = spark.read.schema(SCHEMA).parquet(f"{folder}/merged")
    (staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket")
           .parquet(f"{root}/buckets-{n}"))
    _mark_done(spark, folder)
    for name in _names(spark, f"{root}/_staged/{stream}"):  # a stream replays its last batch at most
        if int(name) < batch:
            delete_folder(spark, f"{root}/_staged/{stream}/{name}")
