"""Lives of postings against a plain fold, over several triggers and restarts."""

import datetime as dt
import random
from collections import defaultdict

from jobsift.streaming import lifespans

HOUR = 3_600_000_000
EPOCH = dt.datetime(1970, 1, 1)


def lives(lots, gap, delay):
    """(key, event, first, last, n) by one pass over the rows in order of arrival, then time."""
    out, held, mark, seen = [], {}, None, None
    for lot in lots:
        kept = [(us, k) for us, k in lot if us is not None and (mark is None or (us // gap + 1) * gap > mark)]
        for us, k in sorted(kept, key=lambda r: r[0]):
            if k in held and us > held[k][1] + gap:
                out.append((k, "closed", *held.pop(k)))
            if k not in held:
                held[k] = (us, us, 0)
                out.append((k, "opened", us, us, 0))
            first, last, n = held[k]
            held[k] = (first, max(last, us), n + 1)
        seen = max([seen or 0, *((us // gap + 1) * gap for us, _ in lot if us is not None)])
        mark = seen - delay
        out += [(k, "closed", *held.pop(k)) for k in list(held) if held[k][1] + 2 * gap < mark]
    return sorted(out), held


def run(spark, folder, lots, gap, delay, parts=1):
    for lot in lots:  # each call is a new start of the stream from its checkpoint
        rows = [(k, None if us is None else EPOCH + dt.timedelta(microseconds=us)) for us, k in lot]
        df = spark.createDataFrame(rows, "key string, ts timestamp_ntz")
        df.repartition(parts).write.mode("append").parquet(f"{folder}/feed")
        out = lifespans.record(spark, f"{folder}/feed", df.schema, ["key"], "ts", dt.timedelta(microseconds=gap),
                               dt.timedelta(microseconds=delay), f"{folder}/out", f"{folder}/stream", partitions=2)
    us = lambda t: round((t - EPOCH).total_seconds() * 1e6)
    return sorted((r.key, r.event, us(r.first_ts), us(r.last_ts), r.sightings) for r in out.collect())


def test_lives_expire_reopen_and_drop_late_rows(spark, tmp_path):
    at = lambda *hours: [round(h * HOUR) for h in hours]
    day = 19_700 * 24 * HOUR
    lots = [[(day + a, k) for a, k in zip(at(0, 0.5, 0.2), "aab", strict=True)], [(day + at(5)[0], "a")],
            [(day + a, k) for a, k in zip(at(5.5, 0.7, 9.5), "acb", strict=True)] + [(None, "a")]]
    got = run(spark, str(tmp_path), lots, HOUR, HOUR)
    assert got == lives(lots, HOUR, HOUR)[0]
    assert [(e, (f - day) / HOUR, n) for k, e, f, _, n in got if k == "a"] == [
        ("closed", 0, 2), ("closed", 5, 2), ("opened", 0, 0), ("opened", 5, 0)]
    assert not [r for r in got if r[0] == "c"]  # behind the watermark


def test_lives_equal_a_fold_whatever_the_partitions(spark, tmp_path):
    rng = random.Random(3)
    day = 19_700 * 24 * HOUR
    rows = sorted((day + rng.randrange(60 * HOUR), "hot" if rng.random() < 0.4 else f"k{rng.randrange(12)}") for _ in range(900))
    lots = defaultdict(list)
    for i, row in enumerate(rows):
        lots[min(3, i // 300 + (rng.random() < 0.1))].append(row)
    lots = [lots[i] for i in range(4)]
    want, still = lives(lots, 2 * HOUR, 3 * HOUR)
    assert len(want) > 100 and still
    assert run(spark, str(tmp_path), lots, 2 * HOUR, 3 * HOUR, parts=5) == want


def test_a_slot_of_a_partition_is_one_row(spark):
    rows = [("hot", EPOCH + dt.timedelta(microseconds=i)) for i in range(5000)]
    slots = lifespans._slots(spark.createDataFrame(rows, "key string, ts timestamp_ntz").repartition(3), ["key"], "ts", HOUR).collect()
    assert len(slots) == 3 and sum(r.n for r in slots) == 5000
    assert (min(r.low for r in slots), max(r.high for r in slots)) == (0, 4999)
