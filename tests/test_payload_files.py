"""Payload files: pushed filters, unopened files, splits."""

import datetime as dt
import gzip

import pytest
from pyspark.sql import functions as F

from jobsift.sources import payload_files


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("payloads")
    rows = [(1, board, c, i, "acme" if i % 2 else None, dt.date(2024, 1, d), f'{{"n": {i}, "t": "é{board}"}}')
            for board in ("remotive", "greenhouse") for d in (1, 2, 3) for c in (0, 1) for i in range(5)]
    payload_files.write(spark.createDataFrame(rows, "role_id int, source string, search_cell int, payload_id long, token string, day date, body string"),
                        str(root), "json")
    # opening any of these fails: they are no gzip files
    for folder in ("remotive/2024-01-01", "broken/2024-01-03"):
        (root / folder).mkdir(parents=True, exist_ok=True)
        (root / folder / "1-0-99.json.gz").write_bytes(b"not gzip")
    (root / "greenhouse" / "2024-01-02" / "1-0-77.json.gz").write_bytes(gzip.compress(b'{"n": 77}'))
    (root / "greenhouse" / "2024-01-02" / "README").write_text("no payload")
    (root / "greenhouse" / "notes").mkdir()
    return str(root)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_are_pushed_and_other_files_stay_closed(spark, root):
    df = payload_files.read(spark, root, ["remotive"], dt.date(2024, 1, 2))
    rows = df.collect()
    assert len(rows) == 20 and {(r.source, r.day.day) for r in rows} == {("remotive", 2), ("remotive", 3)}
    assert {(r.payload_id, r.token) for r in rows} == {(i, "acme" if i % 2 else None) for i in range(5)}
    assert all(r.body == f'{{"n": {r.payload_id}, "t": "éremotive"}}' for r in rows)
    assert "Filter (" not in plan(df) and "PushedFilters" not in plan(df)  # the source took both tests
    with pytest.raises(Exception, match="BadGzipFile|gzip"):
        payload_files.read(spark, root, ["remotive"]).collect()


def test_other_tests_stay_with_spark(spark, root):
    df = payload_files.read(spark, root, ["greenhouse"]).filter("day = DATE'2024-01-02' AND payload_id > 3 AND source > 'a'")
    assert sorted(r.payload_id for r in df.collect()) == [4, 4, 77] and "payload_id" in plan(df) and "Filter" in plan(df)
    either = payload_files.read(spark, root, ["greenhouse"], dt.date(2024, 1, 3)).filter("payload_id = 1 OR source = 'x'")
    assert either.count() == 2
    assert payload_files.read(spark, root, ["nowhere"]).count() == 0
    assert payload_files.read(spark, root + "/missing", ["remotive"]).count() == 0


def test_partitions_and_splits_cover_each_file_once(spark, root):
    one = payload_files.read(spark, root, ["greenhouse"])
    four = payload_files.read(spark, root, ["greenhouse"], splits=4)
    assert one.withColumn("p", F.spark_partition_id()).select("p").distinct().count() == 3
    assert four.withColumn("p", F.spark_partition_id()).select("p").distinct().count() > 6
    assert sorted(map(str, one.collect())) == sorted(map(str, four.collect())) and one.count() == 31


def test_the_run_reads_the_payloads_that_were_fetched(spark):
    from conftest import SF_SMALL
    from jobsift.plans import q_runs
    from jobsift.sources import fixture_pages
    from jobsift.sources.fixtures import postings
    p = postings(spark, SF_SMALL)
    want = fixture_pages.json_payloads(p).drop("token").unionByName(fixture_pages.rss_feeds(p))
    key = ["role_id", "source", "search_cell", "payload_id", "body"]
    got = q_runs.fetched_payloads(spark, SF_SMALL)
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, want.select(key).collect()))
