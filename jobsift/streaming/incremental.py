"""Incremental runs with Structured Streaming.

New landed files arrive in a folder; each micro-batch is one run: skip URLs
already tracked, gather/score/select, and merge the results into the buckets of
the tracker that they fall in. A batch that is replayed after a stop at any
point is applied once, and batch 0 of a new stream is not taken for that of an
old one (see ``sinks.bucketed``).
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..params import SearchConfig
from ..plans import run as R
from ..sinks import bucketed


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Structured Streaming gave the stream of a checkpoint folder."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/metadata")
    file = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(path)
    text = jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")
    file.close()
    return json.loads(text)["id"]


def run_batch(batch: DataFrame, batch_id: int, state_root: str, responses: DataFrame, cfg: SearchConfig,
              stream: str = "batch") -> None:
    """One run over a batch; the tracker takes the rows merged by URL."""
    spark = batch.sparkSession
    bucketed.apply(spark, state_root, stream, batch_id,
                   lambda: R.full_run(batch, bucketed.read(spark, state_root), responses, cfg), cfg.run.run_ts)


def incremental_run(spark: SparkSession, landing_dir: str, schema: T.StructType, state_root: str,
                    checkpoint: str, responses: DataFrame, cfg: SearchConfig,
                    files_per_batch: int | None = None) -> DataFrame:
    """Process every new file in ``landing_dir`` (availableNow; all of them in
    one batch, or ``files_per_batch``) and return the tracker."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    q = (reader.parquet(landing_dir).writeStream
               .foreachBatch(lambda df, bid: run_batch(df, bid, state_root, responses, cfg, stream_id(spark, checkpoint)))
               .option("checkpointLocation", checkpoint)
               .trigger(availableNow=True)
               .start())
    q.awaitTermination()
    return bucketed.read(spark, state_root).drop("bucket")


def first_sightings(spark: SparkSession, source_dir: str, file_glob: str, schema: T.StructType, key: list[str],
                    ts: str, delay: str, out_dir: str, checkpoint: str) -> DataFrame:
    """Streaming de-duplication of a continuous feed: the first row per key
    within the watermark delay, appended to a Parquet sink."""
    stream = (spark.readStream.schema(schema).option("pathGlobFilter", file_glob).parquet(source_dir)
                   .withColumn(ts, F.col(ts).cast("timestamp")))
    deduped = stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(key)
    q = (deduped.writeStream.format("parquet").option("path", out_dir)
                .option("checkpointLocation", checkpoint).outputMode("append")
                .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(deduped.schema).parquet(out_dir)
