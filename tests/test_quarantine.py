"""Unreadable input is filed with its reason; kept and filed are all there is."""

import glob
import json
import logging
import os

from pyspark.sql import functions as F

from conftest import SF_SMALL
from jobsift.sources import fixture_pages as FP
from jobsift.sources import html_cards, json_boards, landed, quarantine
from jobsift.sources.fixtures import postings

RUN_TS = "2024-01-31 00:00:00"
PAYLOAD = "role_id int, source string, search_cell int, payload_id long, token string, body string"
PAGE = "page_id long, source string, role_id int, search_cell int, body string"


def test_payload_reasons(spark):
    job = {"id": 1, "title": "Eng", "url": "u"}
    bodies = [
        ("remotive", json.dumps({"jobs": [job, job]}), None, 2), ("remotive", '{"jobs": [{"id": 1', "malformed", 0),
        ("remotive", None, "no body", 0), ("remotive", "{}", "no item list", 0), ("remotive", '{"jobs": []}', None, 0),
        ("remotive", "", "no item list", 0), ("arbeitnow", json.dumps({"data": [{"slug": "a", "remote": "often"}]}), "field of another type", 1),
        ("greenhouse", json.dumps({"jobs": [{"id": 7, "location": {"name": "X"}}]}), None, 1),
        ("greenhouse", "<html>blocked</html>", "malformed", 0), ("monster", "{}", "unknown board", 0), (None, "{}", "unknown board", 0)]
    payloads = spark.createDataFrame([(1, s, 0, i, "t", b) for i, (s, b, _, _) in enumerate(bodies)], PAYLOAD)
    rss = "<rss><channel><item><title>A</title></item></channel></rss>"
    feeds = spark.createDataFrame([(1, "weworkremotely", 0, 100, "", rss), (1, "weworkremotely", 0, 101, "", rss[:30])], PAYLOAD)
    got = {r.payload_id: (r.reason, r.n_items) for r in json_boards.payload_report(payloads, feeds).collect()}
    want = {i: (reason, n) for i, (_, _, reason, n) in enumerate(bodies)} | {100: (None, 1), 101: ("malformed", 0)}
    assert got[5][1] == 0 and got[5][0] is not None
    assert {k: v for k, v in got.items() if k != 5} == {k: v for k, v in want.items() if k != 5}
    filed = {r.page: r for r in quarantine.rejected_payloads(payloads, feeds).collect()}
    assert set(filed) == {k for k, (reason, _) in got.items() if reason} and filed[1].body == '{"jobs": [{"id": 1'


def test_page_reasons(spark):
    script = '<html><script type="application/ld+json">{}</script></html>'
    good = {"@type": "JobPosting", "title": "T", "url": "u"}
    pages = [(1, "wellfound", 1, 0, None), (2, "wellfound", 1, 0, script.format('{"@type": "JobPosting"')),
             (3, "wellfound", 1, 0, script.format('"a text"')),
             (4, "wellfound", 1, 0, script.format(json.dumps([good, good, "withdrawn", good])) ),
             (5, "wellfound", 1, 0, script.format(json.dumps(good))), (6, "linkedin", 1, 0, "<p>nothing</p>")]
    items = html_cards.parsed_pages(spark.createDataFrame(pages, PAGE))
    filed = sorted((r.page, r.part, r.item_ord if r.item_ord is not None else -1, r.reason)
                   for r in quarantine.rejected_items(items, RUN_TS, 1e6).collect())
    assert filed == [(1, 0, -1, "page: no body"), (2, 1, -1, "malformed"), (3, 1, -1, "no items"), (4, 1, 2, "unreadable item"),
                     (4, 1, 3, "after an unreadable item")]
    assert sorted(r.page_id for r in html_cards.postings_of(items, RUN_TS, 1e6).collect()) == [4, 4, 5]


def test_an_unreadable_card_is_filed(spark, monkeypatch):
    page = html_cards.Page('<li><a href="/jobs/view/1">a</a><h3 class="title">A</h3><h4 class="company">C</h4></li>'
                           '<li><a href="/jobs/view/2">b</a><h3 class="title">B</h3><h4 class="company">C</h4></li>')
    real = html_cards._card

    def card(page, mark, rule):
        row = real(page, mark, rule)
        if row and row["title"] == "A":
            raise ValueError("broken")
        return row
    monkeypatch.setattr(html_cards, "_card", card)
    found = list(html_cards.cards_of(page, html_cards.CARDS["linkedin"]))
    assert [f.get("error") for f in found] == ["ValueError: broken", None]
    rows = [(1, "linkedin", 1, 0, i, None, f.get("error"), *[None] * len(html_cards.RAW_FIELDS)) for i, f in enumerate(found)]
    items = spark.createDataFrame(rows, html_cards.RAW_SCHEMA)
    assert [(r.part, r.item_ord, r.reason) for r in quarantine.rejected_items(items, RUN_TS, 1.0).collect()] == [(0, 0, "ValueError: broken")]


def test_kept_and_filed_are_all(spark, tmp_path, caplog):
    p = postings(spark, SF_SMALL)
    items = html_cards.parsed_pages(FP.jsonld_pages(p).unionByName(FP.card_pages(p).filter("source = 'linkedin'")))
    kept = html_cards.postings_of(items, RUN_TS, 1e6).count()
    payloads = FP.damaged(FP.json_payloads(p), F.col("payload_id") + F.when(F.col("source") == "remotive", 3).otherwise(0))
    filed = quarantine.rejected_items(items, RUN_TS, 1e6).unionByName(quarantine.rejected_payloads(payloads))
    with caplog.at_level(logging.WARNING):
        n = quarantine.store(filed, str(tmp_path / "quarantine"))
    stored = spark.read.parquet(str(tmp_path / "quarantine"))
    assert stored.count() == n > 0 and f"{n} inputs could not be read" in caplog.text
    pages = p.filter("source IN ('wellfound', 'linkedin')").count()
    assert kept + stored.filter("kind = 'page'").count() == pages
    report = json_boards.payload_report(payloads)
    assert report.filter("reason IS NULL").count() + stored.filter("kind = 'payload'").count() == payloads.count()
    assert [r.source for r in stored.filter("kind = 'payload'").collect()] == ["remotive"]


def test_landing_files_follow_bytes_not_writers(spark, tmp_path):
    p = postings(spark, SF_SMALL)
    landed.write_landed(p, str(tmp_path / "small"))
    days = p.select("source", F.to_date("posted_at")).distinct().count()
    assert len(glob.glob(f"{tmp_path}/small/*/*/*.parquet")) == days
    own = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.shuffle.partitions": "4"}
    old = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        one_day = spark.range(0, 20000, 1, 8).select(F.lit("linkedin").alias("source"), F.lit("2024-01-01").cast("timestamp").alias("posted_at"),
                                                     F.sha2(F.col("id").cast("string"), 512).alias("description"))
        landed.write_landed(one_day, str(tmp_path / "large"))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    files = glob.glob(f"{tmp_path}/large/*/*/*.parquet")
    assert len(files) > 4 and max(map(os.path.getsize, files)) < 2_000_000
    assert spark.read.parquet(f"{tmp_path}/large").count() == 20000
