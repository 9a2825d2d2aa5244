"""Tracked-postings relation: schema, upsert by URL, statistics. Its storage is
in ``bucketed``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

TRACKED_SCHEMA = T.StructType([
    T.StructField("job_id", T.StringType()),
    T.StructField("title", T.StringType(), False),
    T.StructField("company", T.StringType(), False),
    T.StructField("location", T.StringType()),
    T.StructField("url", T.StringType(), False),
    T.StructField("source", T.StringType()),
    T.StructField("posted_at", T.TimestampType()),
    T.StructField("match_score", T.IntegerType()),
    T.StructField("match_reasons", T.ArrayType(T.StringType())),
    T.StructField("gap_reasons", T.ArrayType(T.StringType())),
    T.StructField("cover_letter", T.StringType()),
    T.StructField("status", T.StringType(), False),
    T.StructField("notes", T.StringType()),
    T.StructField("created_at", T.TimestampType(), False),
])

KEEP_ON_CONFLICT = ["job_id", "title", "company", "location", "source", "posted_at", "created_at"]
REPLACE_ON_CONFLICT = ["match_score", "match_reasons", "gap_reasons", "cover_letter", "status", "notes"]


def empty_tracked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], TRACKED_SCHEMA)


def as_tracked(apps: DataFrame, run_ts: str) -> DataFrame:
    """Applications -> tracker rows (created_at = the run instant)."""
    cols = []
    for f in TRACKED_SCHEMA.fields:
        if f.name == "created_at":
            cols.append(F.to_timestamp(F.lit(run_ts)).alias("created_at"))
        elif f.name in apps.columns:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        elif f.name in ("match_reasons", "gap_reasons"):
            cols.append(F.array().cast("array<string>").alias(f.name))
        elif f.name == "cover_letter":
            cols.append(F.lit("").alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return apps.select(*cols)


def upsert(tracked: DataFrame, apps: DataFrame, run_ts: str) -> DataFrame:
    """Insert new URLs; on an existing URL replace only score, reasons, letter,
    status and notes, keeping everything else (title, posted_at, created_at...).

    Several writes to one URL in a run collapse first (the last write, in
    role then rank order, wins). The collapsed applications are written once,
    so the scoring behind them runs once and Spark knows their size: a few
    (roles x max_jobs in a run) are broadcast and the tracked table is streamed
    without a shuffle; letters have no fixed width, so no broadcast is forced.
    """
    if "role_ord" in apps.columns and "rank" in apps.columns:
        apps = last_write_per_url(apps, ["role_ord", "rank"])
    return merge(tracked, materialize(as_tracked(apps, run_ts), "applications"))


def merge(tracked: DataFrame, new: DataFrame) -> DataFrame:
    """``upsert`` of written tracker rows, one per URL."""
    nb = new.select("url", *[F.col(c).alias(f"_n_{c}") for c in REPLACE_ON_CONFLICT]).withColumn("_hit", F.lit(True))
    updated = tracked.join(nb, on="url", how="left").select(
        *[(F.when(F.col("_hit"), F.col(f"_n_{f.name}")).otherwise(F.col(f.name)) if f.name in REPLACE_ON_CONFLICT
           else F.col(f.name)).alias(f.name) for f in TRACKED_SCHEMA.fields])
    existing = tracked.select("url").join(nb.select("url"), on="url", how="left_semi")
    inserts = new.join(existing, on="url", how="left_anti")
    return updated.unionByName(inserts)


def last_write_per_url(apps: DataFrame, order_cols: list[str]) -> DataFrame:
    """Several writes to one URL in a run: the last one (in ``order_cols``) wins."""
    latest = apps.groupBy("url").agg(F.max(F.struct(*order_cols)).alias("_w"))
    keyed = latest.select("url", *[F.col(f"_w.{c}").alias(c) for c in order_cols])
    return apps.join(keyed, on=["url"] + order_cols, how="left_semi")


def status_stats(tracked: DataFrame) -> DataFrame:
    """Count of tracked postings per status (partial + final hash aggregate)."""
    return tracked.groupBy("status").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
