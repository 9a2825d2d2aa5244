"""JSON API payloads and RSS feeds -> typed postings.

Payloads are landed as ``(role_id, source, search_cell, token, body)`` rows;
``from_json`` / ``from_xml`` with explicit schemas parse them JVM-side and
``explode`` yields one row per job in payload order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import classify as C
from ..functions import text as X
from ..functions import timestamps as TS
from ..session import materialize

S = T.StringType()

REMOTE_LIST_SCHEMA = T.StructType([T.StructField("jobs", T.ArrayType(T.StructType([
    T.StructField("id", S), T.StructField("title", S), T.StructField("company_name", S),
    T.StructField("url", S), T.StructField("description", S), T.StructField("publication_date", S)])))])

EU_BOARD_SCHEMA = T.StructType([T.StructField("data", T.ArrayType(T.StructType([
    T.StructField("slug", S), T.StructField("title", S), T.StructField("company_name", S),
    T.StructField("location", S), T.StructField("url", S), T.StructField("description", S),
    T.StructField("remote", T.BooleanType()), T.StructField("created_at", T.LongType())])))])

COMPANY_BOARD_SCHEMA = T.StructType([T.StructField("jobs", T.ArrayType(T.StructType([
    T.StructField("id", S), T.StructField("title", S), T.StructField("absolute_url", S),
    T.StructField("content", S), T.StructField("first_published", S), T.StructField("updated_at", S),
    T.StructField("company_name", S), T.StructField("location", T.StructType([T.StructField("name", S)]))])))])

RSS_SCHEMA = T.StructType([T.StructField("channel", T.StructType([T.StructField("item", T.ArrayType(T.StructType([
    T.StructField("title", S), T.StructField("link", S), T.StructField("guid", S), T.StructField("description", S),
    T.StructField("author", S), T.StructField("region", S), T.StructField("pubDate", S),
    T.StructField("updated", S)])))]))])

KEYS = ["role_id", "source", "search_cell", "payload_id"]


#: Boards by the shape of their payloads, and the path of the items in it.
JSON_SHAPES = {"remotive": (REMOTE_LIST_SCHEMA, "jobs"), "arbeitnow": (EU_BOARD_SCHEMA, "data"),
               "greenhouse": (COMPANY_BOARD_SCHEMA, "jobs")}
CORRUPT = "_unread"


def _d(c: str):
    return F.coalesce(F.col(c), F.lit(""))


def _with_reason(payloads: DataFrame, parsed, path: str) -> DataFrame:
    """Payloads with the reason why one gives no items, or not all of them."""
    items = F.col(f"_p.{path}")
    reason = (F.when(F.col("body").isNull(), "no body")
               .when(items.isNull() & F.col(f"_p.{CORRUPT}").isNotNull(), "malformed")
               .when(items.isNull(), "no item list")
               .when(F.col(f"_p.{CORRUPT}").isNotNull(), "field of another type"))
    return payloads.withColumn("_p", parsed).select(
        "source", "role_id", "search_cell", "payload_id", reason.alias("reason"),
        F.coalesce(F.size(items), F.lit(0)).alias("n_items"), "body")


def payload_report(payloads: DataFrame, feeds: DataFrame | None = None) -> DataFrame:
    """(source, role_id, search_cell, payload_id, reason, n_items, body): every
    payload and feed with the number of its items, and why it gives none or not
    all of their fields (reason NULL: all read). Payloads of unknown boards
    give "unknown board"."""
    def marked(schema: T.StructType) -> T.StructType:
        return T.StructType([*schema.fields, T.StructField(CORRUPT, S)])
    option = {"columnNameOfCorruptRecord": CORRUPT, "mode": "PERMISSIVE"}
    out = payloads.filter(~F.coalesce(F.col("source").isin(list(JSON_SHAPES)), F.lit(False))).select(
        "source", "role_id", "search_cell", "payload_id", F.lit("unknown board").alias("reason"), F.lit(0).alias("n_items"), "body")
    for board, (schema, path) in JSON_SHAPES.items():
        out = out.unionByName(_with_reason(payloads.filter(F.col("source") == board), F.from_json("body", marked(schema), option), path))
    if feeds is not None:
        out = out.unionByName(_with_reason(feeds, F.from_xml("body", marked(RSS_SCHEMA), option), "channel.item"))
    return out


def _explode(payloads: DataFrame, parsed, path: str) -> DataFrame:
    return (payloads.withColumn("_p", parsed)
                    .select(*KEYS, *([c for c in ["token"] if c in payloads.columns]),
                            F.posexplode(F.col(f"_p.{path}")).alias("item_ord", "j")))


def remote_list_postings(payloads: DataFrame) -> DataFrame:
    """``{"jobs": [...]}`` remote-only list: location 'Remote', work type remote."""
    j = _explode(payloads, F.from_json("body", REMOTE_LIST_SCHEMA), "jobs")
    return j.select(*KEYS, "item_ord",
                    _d("j.id").alias("job_id"), _d("j.title").alias("title"), _d("j.company_name").alias("company"),
                    F.lit("Remote").alias("location"), _d("j.url").alias("url"),
                    _d("j.description").alias("description"),
                    TS.parse_iso(F.nullif(F.regexp_replace(_d("j.publication_date"), "Z", "+00:00"), F.lit("")))
                    .alias("posted_at"),
                    F.lit("remote").alias("mapped_work_type"))


def eu_board_postings(payloads: DataFrame) -> DataFrame:
    """``{"data": [...]}`` board: epoch creation time, boolean remote flag."""
    j = _explode(payloads, F.from_json("body", EU_BOARD_SCHEMA), "data")
    return j.select(*KEYS, "item_ord",
                    _d("j.slug").alias("job_id"), _d("j.title").alias("title"), _d("j.company_name").alias("company"),
                    _d("j.location").alias("location"), _d("j.url").alias("url"),
                    _d("j.description").alias("description"),
                    TS.parse_epoch_seconds("j.created_at").alias("posted_at"),
                    C.remote_flag_work_type("j.remote").alias("mapped_work_type"))


def company_board_postings(payloads: DataFrame) -> DataFrame:
    """Company board API (one payload per board token): nested location name,
    first-published else updated time, company falls back to the token. The
    description is the HTML content decoded to text (see ``html_text``)."""
    j = _explode(payloads, F.from_json("body", COMPANY_BOARD_SCHEMA), "jobs")
    loc = _d("j.location.name")
    return j.select(*KEYS, "item_ord",
                    _d("j.id").alias("job_id"), _d("j.title").alias("title"),
                    F.coalesce(F.nullif(F.col("j.company_name"), F.lit("")), F.col("token")).alias("company"),
                    loc.alias("location"), _d("j.absolute_url").alias("url"),
                    _d("j.content").alias("content_html"),
                    TS.parse_iso(F.coalesce(F.nullif(F.col("j.first_published"), F.lit("")),
                                            F.nullif(F.col("j.updated_at"), F.lit("")))).alias("posted_at"),
                    C.work_type_from_location(loc).alias("mapped_work_type"))


def _feed_columns() -> list:
    """Posting columns of a parsed feed item ``j``."""
    full_title = _d("j.title")
    return [_d("j.guid").alias("job_id"), full_title.alias("entry_title"),
            X.feed_title(full_title).alias("title"),
            X.feed_company(F.col("j.author"), full_title).alias("company"),
            F.concat(F.lit("Remote ("), F.coalesce(F.col("j.region"), F.lit("Worldwide")), F.lit(")"))
            .alias("location"),
            _d("j.link").alias("url"), X.strip_tags(_d("j.description")).alias("description"),
            TS.feed_date("j.pubDate", "j.updated").alias("posted_at"),
            F.lit("remote").alias("mapped_work_type")]


def rss_postings(feeds: DataFrame) -> DataFrame:
    """RSS feed items: title before ':', company = author else text after the
    last ' at ', location 'Remote (region)' (default region Worldwide),
    tag-stripped summary, published else updated date, guid as id."""
    j = _explode(feeds, F.from_xml("body", RSS_SCHEMA), "channel.item")
    return j.select(*KEYS, "item_ord", *_feed_columns())


FEED_ITEM = RSS_SCHEMA["channel"].dataType["item"].dataType.elementType
ITEM_END = "</item>"


def feed_file_items(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, block, place, head, item) of the feed files at ``paths``: one row
    for each item, whatever the size of a file.

    Files are read in pieces that end with an item, so many tasks share one
    feed and no feed is ever held whole. ``block`` (where the task's part of the
    file begins) and ``place`` order the items of a file; ``head`` is the text
    before the first item, NULL elsewhere.
    """
    pieces = spark.read.option("lineSep", ITEM_END).text(paths).select(
        F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/").alias("path"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value")
    begin = F.regexp_instr("value", F.lit(r"<item[\s>]"))
    first = F.col("value").rlike(r"<channel[\s>]")
    return pieces.select(
        "path", "block", "place", F.when(first, F.when(begin > 0, F.substring("value", F.lit(1), begin - 1)).otherwise(F.col("value"))).alias("head"),
        F.when(begin > 0, F.concat(F.substring("value", begin, F.length("value")), F.lit(ITEM_END))).alias("item"))


def feed_file_postings(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``rss_postings`` of feed files: (path, feed_title, block, place) and the
    posting columns. The titles of the feeds are written first, so that Spark
    knows how small they are when it joins them back, and items stay where they
    were read."""
    pieces = feed_file_items(spark, paths)
    titles = materialize(pieces.filter("head IS NOT NULL").groupBy("path").agg(
        F.min(F.regexp_extract("head", r"(?s)<title>(.*?)</title>", 1)).alias("feed_title")), "feed-titles")
    items = pieces.filter("item IS NOT NULL").select("path", "block", "place", F.from_xml("item", FEED_ITEM).alias("j"))
    return items.join(titles, "path", "left").select("path", "feed_title", "block", "place", *_feed_columns())


LANDED_COLS = ["role_id", "source", "search_cell", "seq", "job_id", "url", "company", "title", "description",
               "location", "posted_at", "mapped_work_type", "relevance_title"]


def landed_from_payloads(payloads: DataFrame, feeds: DataFrame | None, cfg) -> DataFrame:
    """API payloads (and RSS feeds) in the landed shape used by the run.

    ``seq`` is payload order then item order; company-board descriptions are
    decoded from HTML; cells, their location and the board order are attached.
    """
    from ..functions.html import html_text_column
    from ..operators.cells import attach_cells
    from .html_cards import arrival
    src = F.col("source")
    parts = [remote_list_postings(payloads.filter(src == "remotive")),
             eu_board_postings(payloads.filter(src == "arbeitnow")),
             company_board_postings(payloads.filter(src == "greenhouse"))
             .withColumn("description", html_text_column()(F.col("content_html")))]
    if feeds is not None:
        parts.append(rss_postings(feeds))
    # The feed board tests relevance on the whole entry title, the others on the title.
    frames = [p.withColumns({"seq": arrival("payload_id", F.lit(0), "item_ord"),
                             "relevance_title": F.col("entry_title") if "entry_title" in p.columns
                             else F.col("title")})
              .select(*LANDED_COLS) for p in parts]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    ords = cfg.board_ord()
    board_ord = None
    for name, o in ords.items():
        board_ord = (F.when(src == name, F.lit(o)) if board_ord is None else board_ord.when(src == name, F.lit(o)))
    return attach_cells(out, cfg).withColumns({"board_ord": board_ord.cast("int"),
                                               "employment_type": F.lit(None).cast("string"),
                                               "salary": F.lit(None).cast("string")})
