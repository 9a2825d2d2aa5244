"""Feed files read in pieces give the rows of whole feeds."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from jobsift.sources import fixture_pages as FP
from jobsift.sources import json_boards
from jobsift.sources.fixtures import postings

COLS = ["job_id", "entry_title", "title", "company", "location", "url", "description", "posted_at", "mapped_work_type"]


def test_one_feed_of_100000_items_is_read_by_many_tasks(spark, tmp_path):
    item = F.format_string("<item>\n<title>Acme: Job %d at Acme</title><link>l%d</link><guid>g%d</guid>"
                           "<description>&lt;p&gt;Text %d&lt;/p&gt;</description></item>", "id", "id", "id", "id")
    whole = spark.range(0, 100_000, 1, 8).select("id", item.alias("value"))
    head = spark.createDataFrame([(-1, "<?xml version='1.0'?><rss><channel ><title>All jobs</title><link>x</link>"),
                                  (1 << 60, "</channel></rss>")], "id long, value string")
    whole.unionByName(head).repartition(1).sortWithinPartitions("id").select("value").write.text(str(tmp_path / "feed"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2m")
        rows = json_boards.feed_file_postings(spark, str(tmp_path / "feed")).withColumn("task", F.spark_partition_id())
        got = rows.agg(F.count("*").alias("n"), F.count_distinct("job_id").alias("ids"), F.count_distinct("task").alias("tasks"),
                       F.count_if((F.col("feed_title") == "All jobs") & (F.col("description") == F.concat(F.lit(" Text "), F.substring("job_id", 2, 9), F.lit(" ")))).alias("right")).first()
        assert (got.n, got.ids, got.right) == (100_000, 100_000, 100_000) and got.tasks > 4
        order = [r.job_id for r in rows.orderBy("block", "place").limit(5).select("job_id").collect()]
        assert order == [f"g{i}" for i in range(5)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_pieces_and_whole_feeds_give_the_same_rows(spark, tmp_path):
    p = postings(spark, SF_SMALL)
    FP.write_feed_file(p, str(tmp_path / "feed"))
    whole = json_boards.rss_postings(FP.rss_feeds(p)).select(*COLS)
    pieces = json_boards.feed_file_postings(spark, str(tmp_path / "feed")).select(*COLS)
    assert whole.count() > 10 and sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, pieces.collect()), key=str)


def test_odd_feed_files(spark, tmp_path):
    for name, text in {"none": "<rss><channel><title>Empty</title></channel></rss>", "blank": "", "cut": "<rss><channel><title>Cut</title>"
                       "<item><title>A</title><guid>1</guid></item><item><title>B</title><gu", "line": "<rss><channel><title>T</title>"
                       + "".join(f"<item><title>A: {i}</title><guid>{i}</guid></item>" for i in range(3)) + "</channel></rss>"}.items():
        (tmp_path / f"{name}.xml").write_text(text, encoding="utf-8")
    got = json_boards.feed_file_postings(spark, str(tmp_path)).filter("job_id <> ''")
    assert sorted((r.feed_title, r.job_id) for r in got.collect()) == [("Cut", "1"), ("T", "0"), ("T", "1"), ("T", "2")]
