"""Input that could not be read: one relation over all adapters, and counts.

An unreadable payload, feed, page, card or script never stops a run; it is left
out of the postings, filed here with its place and the reason, and counted.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from . import html_cards, json_boards

log = logging.getLogger(__name__)

COLUMNS = ["kind", "source", "role_id", "search_cell", "page", "part", "item_ord", "reason", "body"]


def rejected_payloads(payloads: DataFrame, feeds: DataFrame | None = None) -> DataFrame:
    """Payloads and feeds that gave no items, or lost fields of some; with their
    bodies, so that they can be read again."""
    return json_boards.payload_report(payloads, feeds).filter("reason IS NOT NULL").select(
        F.lit("payload").alias("kind"), "source", "role_id", "search_cell", F.col("payload_id").cast("long").alias("page"),
        F.lit(0).alias("part"), F.lit(None).cast("int").alias("item_ord"), "reason", "body")


def rejected_items(items: DataFrame, run_ts: str, posted_within_hours: float) -> DataFrame:
    """Pages, cards, scripts and script items that could not be read, of the
    parsed pages (``html_cards.parsed_pages``)."""
    return html_cards.page_report(items, run_ts, posted_within_hours).select(
        F.lit("page").alias("kind"), "source", "role_id", "search_cell", F.col("page_id").alias("page"), "part", "item_ord", "reason",
        F.lit(None).cast("string").alias("body"))


def store(rejected: DataFrame, path: str) -> int:
    """Appends to the quarantine dataset, by board, and warns of what was filed:
    rows are counted while they are written. Returns their number."""
    seen = Observation()
    counted = rejected.select(*COLUMNS).observe(
        seen, F.count("*").alias("n"), F.count_if(F.col("kind") == "payload").alias("payloads"),
        F.count_if(F.col("reason").contains("malformed")).alias("malformed"))
    counted.write.mode("append").partitionBy("source").parquet(path)
    found = seen.get
    if found["n"]:
        log.warning("%d inputs could not be read (%d payloads; %d malformed): %s", found["n"], found["payloads"], found["malformed"], path)
    return found["n"]
