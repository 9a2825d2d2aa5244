"""Helpers shared by the corpus operators: shared-folder tables, Arrow
batching and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shared_by_all

#: Rows in one Arrow batch. A text may be megabytes long, so a batch is kept
#: to few rows; it bounds the memory of a Python worker.
BATCH_ROWS = 256
#: Bytes \x09-\x0D and \x20 separate words; everything else is word matter.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session (see BATCH_ROWS)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it; where the session has none, a folder in
    the warehouse is set, on one machine (tests, a laptop) or if the warehouse
    is a store. A cluster with a local warehouse and no named folder is refused.
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


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back. It cuts the
    lineage in one job and outlives any executor."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)  # smaller than the default, and its buffers are freed at once
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._llm_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by ``written`` that no plan reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._llm_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterable, rows: int = 64) -> Iterator:
    """Pieces of few rows of each Arrow batch, so that Python copies of long
    texts stay few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: A key of more than 1 / HOT of all rows is joined apart from the others.
HOT = 1000


def joined(rows: DataFrame, one: DataFrame, key: str, weight: str) -> DataFrame:
    """``rows`` joined with the written table ``one``, which has a row for each
    key; ``weight`` is the number of rows with it. Keys over 1 / HOT of all rows,
    HOT of them at most, are broadcast with a row of fixed width each; in the
    shuffle of the others no key weighs more than that."""
    total = one.agg(F.sum(weight)).first()[0] or 0
    often = F.col(weight) * HOT > total
    hot, rest = F.broadcast(one.where(often).drop(weight)), one.where(~often).drop(weight)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(rest, key))


def connected_components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b): the smallest node
    reachable.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each
    is one aggregation and one join on the node, so links, components and
    hubs are never gathered in one place. Each round is written to the shared
    folder; rounds grow with the logarithm of the longest chain.
    """
    def stars(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
                pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            both = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        hung = both.join(least, "u")
        if large:
            out = hung.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = hung.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(
                least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def state(pairs: DataFrame):
        return pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    current = written(edges.where("a <> b").select("a", "b").distinct(), tag)
    seen = state(current)
    while seen[0]:
        following = written(stars(stars(current, large=True), large=False), tag)
        now = state(following)
        discard(current)
        current = following
        if now == seen:
            break
        seen = now
    # at the end every edge leads from a node to the root of its component
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
