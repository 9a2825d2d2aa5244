"""Resume texts per role (plain-text resumes; PDF decoding is not built)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import SearchConfig


def read_resumes(spark: SparkSession, cfg: SearchConfig) -> DataFrame:
    """One whole-file text per role with a resume path: (role_id, resume_text)."""
    wanted = [(r.role_id, r.resume_path) for r in cfg.roles if r.resume_path]
    if not wanted:
        return spark.createDataFrame([], "role_id int, resume_text string")
    # Roles may share a file, and files of different folders a name: each file
    # is read once and paired with its roles by its full path.
    sc = spark.sparkContext
    qualify = lambda p: str(_qualified(sc, p))
    files = spark.read.text(sorted({p for _, p in wanted}), wholetext=True).withColumn(
        "path", F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/"))
    pairs = F.array(*[F.struct(F.lit(rid).alias("role_id"), F.lit(re.sub("^file:/+", "file:/", qualify(p))).alias("path"))
                      for rid, p in wanted])
    return (files.select("value", "path", F.explode(pairs).alias("w")).filter(F.col("path") == F.col("w.path"))
                 .select(F.col("w.role_id").cast("int").alias("role_id"), F.col("value").alias("resume_text")))


def _qualified(sc, path: str):
    """The path with its file system, as Spark reports it for a file read."""
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(p).toUri()


def resumes_from_table(items: DataFrame, cfg: SearchConfig, key: str = "item_id", text: str = "text") -> DataFrame:
    """Resume texts held in a table keyed like the roles (item per role)."""
    ids = [r.role_id for r in cfg.roles]
    return items.filter(F.col(key).isin(ids)).select(F.col(key).cast("int").alias("role_id"),
                                                     F.col(text).alias("resume_text"))
