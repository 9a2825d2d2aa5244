"""Hash-partitioned tracker: only touched buckets change, batches apply once."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from jobsift.operators import dedup
from jobsift.sinks import bucketed, tracker

RUN_TS = "2024-01-31 00:00:00"


def rows(spark, ids, score=50):
    return spark.createDataFrame([(f"t{i}", "Acme", f"u{i}", score, "pending") for i in ids],
                                 "title string, company string, url string, match_score int, status string")


def tracked(spark, ids, score=50, run_ts="2024-01-01 00:00:00"):
    return tracker.as_tracked(rows(spark, ids, score), run_ts)


def files(root):
    """{bucket: {file: (inode, modification time, size)}}"""
    out = {}
    for f in glob.glob(f"{root}/buckets-*/bucket=*/*.parquet"):
        st = os.stat(f)
        out.setdefault(os.path.basename(os.path.dirname(f)), {})[os.path.basename(f)] = (st.st_ino, st.st_mtime_ns, st.st_size)
    return out


def content(df):
    return sorted((r.url, r.title, r.match_score, r.status, str(r.created_at)) for r in df.collect())


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    root = str(tmp_path)
    bucketed.create(spark, root, 16, tracked(spark, range(200)))
    before = files(root)
    assert len(before) == 16
    new = rows(spark, [3, 7, 1000], 90)
    touched = {f"bucket={r.bucket}" for r in new.select(bucketed.bucket_of("url", 16)).collect()}
    bucketed.apply(spark, root, "s", 0, lambda: new, RUN_TS)
    after = files(root)
    assert {b for b in after if after[b] != before.get(b)} == touched
    assert content(bucketed.read(spark, root)) == content(tracker.upsert(tracked(spark, range(200)), new, RUN_TS))


def test_a_batch_costs_the_same_at_ten_times_the_tracker(spark, tmp_path):
    cost = []
    for name, n, buckets in (("small", 400, 8), ("large", 4000, 80)):
        root = str(tmp_path / name)
        bucketed.create(spark, root, buckets, tracked(spark, range(n)))
        before = files(root)
        bucketed.apply(spark, root, "s", 0, lambda: rows(spark, [5], 90), RUN_TS)
        after = files(root)
        changed = [b for b in after if after[b] != before[b]]
        url = spark.range(1).select(bucketed.bucket_of(F.lit("u5"), buckets)).first().bucket
        read = bucketed.read(spark, root, [url]).inputFiles()
        cost.append((len(changed), len(read), sum(s[2] for b in changed for s in after[b].values())))
    (a_n, a_files, a_bytes), (b_n, b_files, b_bytes) = cost
    assert (a_n, a_files) == (b_n, b_files) == (1, 1) and b_bytes < 1.5 * a_bytes


def test_a_batch_is_applied_once_wherever_it_stopped(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    bucketed.create(spark, root, 8, tracked(spark, range(50)))
    want = content(tracker.upsert(tracked(spark, range(50)), rows(spark, [1, 2, 60], 80), RUN_TS))
    calls = []

    def applications(score=80):
        calls.append(score)
        return rows(spark, [1, 2, 60], score)

    with monkeypatch.context() as m:  # stops after the applications are staged
        m.setattr(tracker, "merge", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError):
            bucketed.apply(spark, root, "s", 3, applications, RUN_TS)
    assert content(bucketed.read(spark, root)) == content(tracked(spark, range(50)))
    with monkeypatch.context() as m:  # stops before the batch is marked done
        m.setattr(bucketed, "_mark_done", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError):
            bucketed.apply(spark, root, "s", 3, lambda: applications(10), RUN_TS)
    assert content(bucketed.read(spark, root)) == want
    for _ in range(2):
        bucketed.apply(spark, root, "s", 3, lambda: applications(10), RUN_TS)
        assert content(bucketed.read(spark, root)) == want
    assert calls == [80]
    bucketed.apply(spark, root, "other", 3, lambda: applications(95), RUN_TS)  # another stream's batch 3
    bucketed.apply(spark, root, "s", 4, lambda: applications(20), RUN_TS)
    assert calls == [80, 95, 20] and os.listdir(f"{root}/_staged/s") == [f"{4:012d}"]
    assert {r.match_score for r in bucketed.read(spark, root).where("url in ('u1', 'u60')").collect()} == {20}


def test_a_bucket_lost_in_the_overwrite_comes_back(spark, tmp_path):
    root = str(tmp_path)
    bucketed.apply(spark, root, "s", 0, lambda: rows(spark, range(30)), RUN_TS, buckets=4)
    want = content(bucketed.read(spark, root))
    os.remove(f"{root}/_staged/s/{0:012d}/done")
    for f in glob.glob(f"{root}/buckets-4/bucket=1/*"):
        os.remove(f)
    bucketed.apply(spark, root, "s", 0, lambda: rows(spark, []), RUN_TS)
    assert content(bucketed.read(spark, root)) == want


def test_rebucket_keeps_the_rows(spark, tmp_path):
    root = str(tmp_path)
    assert bucketed.read(spark, root).count() == 0
    bucketed.create(spark, root, 4, tracked(spark, range(100)))
    want = content(bucketed.read(spark, root))
    os.makedirs(f"{root}/buckets-8/bucket=0")  # left by a call that was stopped: not complete, so not read
    assert bucketed.bucket_count(spark, root) == 4
    bucketed.rebucket(spark, root, 8)
    assert bucketed.bucket_count(spark, root) == 8 and content(bucketed.read(spark, root)) == want
    assert all(b.bucket == c.bucket for b, c in zip(bucketed.read(spark, root).collect(), bucketed.read(spark, root).select(
        bucketed.bucket_of("url", 8)).collect(), strict=True))
    with pytest.raises(ValueError, match="not more"):
        bucketed.rebucket(spark, root, 8)


def test_probes_prune_buckets_and_stream_the_rest(spark, tmp_path):
    root = str(tmp_path)
    bucketed.create(spark, root, 32, tracked(spark, range(300)))
    spark.createDataFrame([(i, f"u{i}") for i in (1, 2, 999)], "seq int, url string").write.parquet(f"{root}/new")
    new = spark.read.parquet(f"{root}/new")
    left = dedup.anti_tracked_bounded(new, bucketed.read(spark, root))
    assert [r.seq for r in left.collect()] == [999]
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "SortMergeJoin" not in plan
