"""Life spans of postings in a feed of sightings, with state that expires.

A posting (a key) is open from its first sighting on; a sighting within the gap
after the last one belongs to the same life, a later one is a re-posting and
opens the next life. Arbitrary stateful processing keeps one small record a key:
when the life began, the last sighting and their number. A life closes two gaps
after the last sighting, and its record is dropped (a row that is not late then
is more than a gap after that sighting), so the state holds open postings only,
however long the feed runs. Records live in RocksDB under the checkpoint folder.

Keys are dealt to BUCKETS by their hash, and a bucket's records are one value
with one event-time timer, at its earliest end: a trigger asks the state store
a few times for each bucket, not for each key.

Sightings are cut to slots as wide as the gap: within a slot no two of them are
further apart than the gap, so its first, last and number say all. Each input
partition hands on one row for each key and slot, so a key that holds a third of
a batch meets its task as a few rows. A row is late, and dropped, if its slot has
ended at the watermark (latest slot end seen before, less the delay). The gap is
in whole milliseconds.
"""

from __future__ import annotations

import datetime as dt
import pickle
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Keys and slots that a task holds before it hands them on.
HELD = 100_000
#: Groups of keys with a state of their own. A stream's state keeps their number.
BUCKETS = 1024
OPENED, CLOSED = "opened", "closed"
#: The next timer, and the pickled open lives: key -> (start, last, n).
STATE = "timer long, lives binary"
_NAN = float("nan")
RESULT = [T.StructField("event", T.StringType()), T.StructField("first_ts", T.TimestampType()),
          T.StructField("last_ts", T.TimestampType()), T.StructField("sightings", T.LongType())]


def _instant(micros: int) -> dt.datetime:
    return dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(microseconds=micros)


class Lives(StatefulProcessor):
    """Rows (keys, low, high, n) of a bucket's keys in a batch -> lives opened and closed."""

    def __init__(self, keys: list[str], gap: int):
        self.keys, self.gap = keys, gap  # microseconds
        self.row = T.Row(*keys, *[f.name for f in RESULT])

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("lives", STATE)

    def _row(self, key, event: str, start: int, last: int, n: int) -> T.Row:
        return self.row(*key, event, _instant(start), _instant(last), n)

    def _timer(self, last: int) -> int:
        """Milliseconds at which nothing that still counts can join the life."""
        return -(-(last + 2 * self.gap) // 1000)

    @staticmethod
    def _key(values) -> tuple:
        return tuple(_NAN if v != v else v for v in values)  # one NaN, that equals itself as in a grouping

    def _load(self) -> tuple[int | None, dict]:
        found = self.state.get()
        return (found[0], {self._key(k): v for k, v in pickle.loads(found[1]).items()}) if found else (None, {})

    def _store(self, before: int | None, lives: dict) -> None:
        timer = min((self._timer(last) for _, last, _ in lives.values()), default=None)
        if timer != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if timer is not None:
                self.handle.registerTimer(timer)
        if lives:
            self.state.update((timer, pickle.dumps(lives)))
        else:
            self.state.clear()

    def handleInputRows(self, key, rows, timerValues):
        timer, lives = self._load()
        seen = defaultdict(list)
        for r in rows:
            seen[self._key(r[k] for k in self.keys)].append((r["low"], r["high"], r["n"]))
        for k, spans in seen.items():
            start, last, n = lives.get(k, (None, None, 0))
            for low, high, more in sorted(spans):
                if last is not None and low > last + self.gap:
                    yield self._row(k, CLOSED, start, last, n)
                    start, last, n = None, None, 0
                if start is None:
                    start, last = low, high
                    yield self._row(k, OPENED, start, start, 0)
                last, n = max(last, high), n + more
            lives[k] = (start, last, n)
        self._store(timer, lives)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        _, lives = self._load()
        now = timerValues.getCurrentWatermarkInMs()
        for k, (start, last, n) in [*lives.items()]:
            if self._timer(last) < now:
                yield self._row(k, CLOSED, start, last, n)
                del lives[k]
        self._store(None, lives)  # the expired timer goes by itself


def _slots(feed: DataFrame, keys: list[str], ts: str, gap: int) -> DataFrame:
    """(keys, slot end, low, high, n) of each partition's rows."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    narrow = feed.select(*keys, micros.alias("at")).where("at is not null")
    kinds = [narrow.schema[k] for k in keys]
    schema = T.StructType([*kinds, T.StructField("slot", T.LongType()), T.StructField("low", T.LongType()),
                           T.StructField("high", T.LongType()), T.StructField("n", T.LongType())])

    out = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in schema])

    def merged(parts):
        found = pa.concat_tables(parts).group_by([*keys, "slot"], use_threads=False).aggregate(
            [("low", "min"), ("high", "max"), ("n", "sum")])
        return found.select([*keys, "slot", "low_min", "high_max", "n_sum"]).rename_columns(out.names).cast(out)

    def partial(batches):
        parts, rows = [], 0
        for batch in batches:
            at = batch.column("at")
            slot = pa.array(at.to_numpy(zero_copy_only=False) // gap, pa.int64())
            one = pa.array(np.ones(len(at), np.int64))
            parts.append(pa.Table.from_arrays([*[batch.column(k) for k in keys], slot, at, at, one], schema=out))
            rows += len(at)
            if rows > HELD:
                parts = [merged(parts)]
                rows = parts[0].num_rows
                if 2 * rows > HELD:  # few of them meet
                    yield from parts[0].to_batches()
                    parts, rows = [], 0
        if parts:
            yield from merged(parts).to_batches()

    return narrow.mapInArrow(partial, schema).withColumn(
        "slot_end", F.timestamp_micros((F.col("slot") + 1) * F.lit(gap))).drop("slot")


def life_spans(feed: DataFrame, keys: list[str], ts: str, gap: dt.timedelta, delay: dt.timedelta) -> DataFrame:
    """(keys, event, first_ts, last_ts, sightings): a row when a life opens and
    one when it closes, of a streaming ``feed``. ``keys`` are not null; rows
    without a time are not counted."""
    spark = feed.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    micros = gap // dt.timedelta(microseconds=1)
    slots = _slots(feed, keys, ts, micros).withWatermark("slot_end", f"{int(delay.total_seconds())} seconds")
    schema = T.StructType([*(slots.schema[k] for k in keys), *RESULT])
    dealt = slots.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)))
    return dealt.groupBy("_bucket").transformWithState(Lives(keys, micros), schema, "append", "eventTime")


def record(spark: SparkSession, source_dir: str, schema: T.StructType, keys: list[str], ts: str, gap: dt.timedelta,
           delay: dt.timedelta, out_dir: str, checkpoint: str, files_per_batch: int | None = None,
           partitions: int | None = None) -> DataFrame:
    """Process every new file of a feed and return all lives recorded so far.
    A new stream's state is dealt to ``partitions`` (the session's shuffle
    partitions by default), which stay its number."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    spans = life_spans(reader.parquet(source_dir), keys, ts, gap, delay)
    writer = (spans.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint)
                   .outputMode("append").trigger(availableNow=True))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions or before)
    try:
        query = writer.start()  # takes the settings of this moment
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    query.awaitTermination()
    return spark.read.schema(spans.schema).parquet(out_dir)
