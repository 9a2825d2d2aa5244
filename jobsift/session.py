"""Spark session defaults and the shared checkpoint location."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # HTML pages and descriptions are wide rows: keep Arrow batches small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def scale_conf(input_bytes: int, partition_bytes: int = 256 << 20) -> dict:
    """Settings sized for a cluster run over ``input_bytes`` of landed data.

    Scan splits and post-shuffle partitions both target ``partition_bytes``
    so a task's input fits executor memory; AQE coalesces small partitions
    and splits skewed ones; broadcasts are left to AQE's runtime size check
    except where a configuration bound is proven (``bounded_broadcast``).
    """
    shuffle_parts = max(200, int(input_bytes // partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(shuffle_parts),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes // 2),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(partition_bytes),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    }


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "jobsift", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, named by ``spark.checkpoint.dir``.

    A checkpoint directory that is set already is kept; else the setting of the
    context or session is used; where there is none, a folder in the warehouse:
    on one machine (tests, a laptop), or if the warehouse is a shared store. On
    a cluster a local warehouse is no folder that others see, so that is refused.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if not shared_by_all(warehouse, sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = f"{warehouse}/_checkpoints"
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def shared_by_all(path: str, master: str) -> bool:
    """Whether all tasks see a folder: it is in a store, or there is one machine."""
    in_store = "://" in path and not path.startswith("file:")
    return in_store or master == "local" or master.startswith("local[")


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder that this library wrote and no plan reads any more."""
    hp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hp, True)


def utc(spark: SparkSession) -> None:
    """Timestamps are compared as UTC instants throughout."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def materialize(df, tag: str):
    """Write ``df`` once as Parquet under the shared checkpoint folder and read
    it back: the lineage is cut with a single job (a reliable checkpoint
    would compute the plan twice), and a lost executor re-reads the files."""
    import os
    import uuid
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), "materialized", f"{tag}-{uuid.uuid4().hex}")
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_materialized(spark) -> None:
    """Remove what ``materialize`` wrote, once a run's results are stored and
    none of its DataFrames is read again."""
    delete_folder(spark, f"{checkpoint_dir(spark)}/materialized")
