"""Queries for the sources (A2-A5, A7, A8) and HTML text (B8)."""

from __future__ import annotations

import dataclasses
import re
import uuid

from pyspark.sql import functions as F

from ..functions.html import html_text_column
from ..functions.timestamps import format_ts, window_cutoff
from ..session import checkpoint_dir
from ..sources import fixture_pages as FP
from ..params import Role
from ..sources import html_cards, json_boards, landed, quarantine, resumes
from ..sources.fixtures import FIXTURE_CONFIG as CFG
from ..sources.fixtures import postings, table
from . import oracle_sql as O
from .catalog import register

RUN = CFG.run
TS_FMT = "'%Y-%m-%d %H:%M:%S.%f'"
CUTOFF = window_cutoff(RUN.run_ts, RUN.posted_within_hours).isoformat(sep=" ")
PG = FP.PAGE_ITEMS * 9


# ---- A2: JSON board payloads ----------------------------------------------------------
def _json(spark, d):
    payloads = FP.json_payloads(postings(spark, d))
    cols = ["source", "job_id", "title", "company", "url", "location", "posted_at", "work_type", "description"]
    rem = json_boards.remote_list_postings(payloads.filter(F.col("source") == "remotive")) \
        .withColumnRenamed("mapped_work_type", "work_type")
    eu = json_boards.eu_board_postings(payloads.filter(F.col("source") == "arbeitnow")) \
        .withColumnRenamed("mapped_work_type", "work_type")
    co = json_boards.company_board_postings(payloads.filter(F.col("source") == "greenhouse")) \
        .withColumnRenamed("mapped_work_type", "work_type").withColumn("description", html_text_column()(F.col("content_html")))
    out = rem.select(*cols).unionByName(eu.select(*cols)).unionByName(co.select(*cols))
    return out.withColumn("posted_at", format_ts("posted_at"))


register("json_board_postings", f"""
WITH {O.postings_cte()}
SELECT source,
  CASE source WHEN 'arbeitnow' THEN 'job-' || CAST(seq AS VARCHAR) ELSE CAST(seq AS VARCHAR) END AS job_id,
  title,
  CASE WHEN source = 'greenhouse' AND seq % 4 = 0
       THEN CASE WHEN (seq // {PG}) % 2 = 0 THEN 'stripe' ELSE 'airbnb' END ELSE company END AS company,
  url,
  CASE source WHEN 'remotive' THEN 'Remote' ELSE location END AS location,
  strftime(posted_at, {TS_FMT}) AS posted_at,
  CASE source WHEN 'remotive' THEN 'remote' WHEN 'arbeitnow' THEN CASE WHEN seq % 2 = 0 THEN 'remote' END
       ELSE {O.WT_LOC_SQL} END AS work_type,
  CASE WHEN source = 'greenhouse' THEN {O.stripped_sql('description')} ELSE description END AS description
FROM p WHERE source IN ('remotive', 'arbeitnow', 'greenhouse')
""")(_json)


# ---- A3: RSS feed -------------------------------------------------------------------------
def _rss(spark, d):
    feeds = FP.rss_feeds(postings(spark, d))
    out = json_boards.rss_postings(feeds)
    return out.select("job_id", "title", "company", "location", "url", format_ts("posted_at").alias("posted_at"),
                      "description", F.col("mapped_work_type").alias("work_type"))


register("rss_postings", f"""
WITH {O.postings_cte()}
SELECT url AS job_id, trim(split_part(company || ': ' || title || ' at ' || company, ':', 1)) AS title,
  company,
  CASE WHEN seq % 2 = 0 THEN 'Remote (Worldwide)' ELSE 'Remote (Anywhere in the World)' END AS location,
  url, strftime(posted_at, {TS_FMT}) AS posted_at,
  ' ' || {O.escaped_sql("regexp_replace(description, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\r]', '', 'g')")} || ' '
    AS description,
  'remote' AS work_type
FROM p WHERE source = 'weworkremotely'
""")(_rss)


# ---- A3 at size: one feed file, read by many tasks ------------------------------------------
def _large_feed(spark, d):
    path = f"{checkpoint_dir(spark)}/feed-{uuid.uuid4().hex}"
    FP.write_feed_file(postings(spark, d), path)
    out = json_boards.feed_file_postings(spark, path)
    return out.select("feed_title", "job_id", "title", "company", "location", "url", format_ts("posted_at").alias("posted_at"),
                      "description", F.col("mapped_work_type").alias("work_type"))


_RSS_COLS = f"""url AS job_id, trim(split_part(company || ': ' || title || ' at ' || company, ':', 1)) AS title,
  company,
  CASE WHEN seq % 2 = 0 THEN 'Remote (Worldwide)' ELSE 'Remote (Anywhere in the World)' END AS location,
  url, strftime(posted_at, {TS_FMT}) AS posted_at,
  ' ' || {O.escaped_sql("regexp_replace(description, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\r]', '', 'g')")} || ' '
    AS description,
  'remote' AS work_type"""

register("large_feed_postings", f"""
WITH {O.postings_cte()}
SELECT 'Programming jobs' AS feed_title, {_RSS_COLS} FROM p WHERE source = 'weworkremotely'
""")(_large_feed)


# ---- A4: HTML cards --------------------------------------------------------------------------
CARD_COLS = ["source", "url", "job_id", "title", "company", "posted_at", "location", "mapped_work_type",
             "employment_type", "salary", "description"]


def _cards(spark, d):
    pages = FP.card_pages(postings(spark, d))
    out = html_cards.card_postings(pages, RUN.run_ts)
    return out.select(*[format_ts(c).alias(c) if c == "posted_at" else F.col(c) for c in CARD_COLS])


def _cards_sql() -> str:
    label = "(['Remote', 'Hybrid', 'On-site'])[seq % 3 + 1]"
    yc_text = f"lower(company || ' ' || title || ' at ' || company || ' ' || location || ' ' || {label} || ' ' || " \
              f"{O.q(FP.TEAM_BLURB)})"
    yc_wt = (f"CASE WHEN contains({yc_text}, 'remote') THEN 'remote' WHEN contains({yc_text}, 'hybrid') THEN 'hybrid' "
             f"WHEN contains({yc_text}, 'in-person') OR contains({yc_text}, 'on-site') OR contains({yc_text}, 'onsite') "
             f"THEN 'onsite' END")
    yc_label = (f"CASE {yc_wt} WHEN 'remote' THEN 'Remote' WHEN 'hybrid' THEN 'Hybrid' WHEN 'onsite' THEN 'Onsite' "
                f"ELSE 'Unknown' END")
    emp_label = "lower((['Contract to Hire', 'Permanent / Full Time', 'Temporary', 'Part Time'])[seq % 4 + 1])"
    worksite = "lower((['Remote', 'Hybrid', 'Onsite'])[seq % 3 + 1])"
    ago = (f"CASE WHEN posted_at IS NULL THEN '' ELSE ' ' || CAST(date_diff('hour', posted_at, TIMESTAMP '{RUN.run_ts}') "
           f"AS VARCHAR) || ' hours ago' END")
    sal = ("'$' || format('{:,.2f}', CAST(base_score * 1000 AS DOUBLE)) || "
           "CASE WHEN seq % 2 = 0 AND base_score <> 0 THEN '–$' || format('{:,.2f}', CAST(base_score * 1200 AS DOUBLE)) "
           "ELSE '' END || ' USD / year'")
    return f"""
WITH {O.postings_cte()}
SELECT source,
  CASE source WHEN 'linkedin' THEN 'https://www.linkedin.com/jobs/view/' || CAST(seq AS VARCHAR)
    WHEN 'wellfound' THEN 'https://wellfound.com/jobs/' || CAST(seq AS VARCHAR) || '-opening'
    WHEN 'builtin' THEN 'https://builtin.com/' || CASE WHEN seq % 2 = 0 THEN 'jobs/' ELSE 'job/opening/' END || CAST(seq AS VARCHAR)
    WHEN 'roberthalf' THEN 'https://www.roberthalf.com/us/en/job/' || CAST(seq AS VARCHAR)
    ELSE 'https://www.workatastartup.com/jobs/' || CAST(seq AS VARCHAR) END AS url,
  CASE source WHEN 'builtin' THEN CASE WHEN seq % 2 = 0 THEN CAST(seq AS VARCHAR) END WHEN 'roberthalf' THEN 'JOB-' || CAST(seq AS VARCHAR)
    ELSE CAST(seq AS VARCHAR) END AS job_id,
  title,
  CASE source WHEN 'roberthalf' THEN 'Robert Half' ELSE company END AS company,
  strftime(posted_at, {TS_FMT}) AS posted_at,
  CASE source WHEN 'roberthalf' THEN NULLIF(location, '')
    WHEN 'workatastartup' THEN COALESCE(NULLIF(location, ''), {yc_label}) END AS location,
  CASE source WHEN 'roberthalf' THEN {worksite} WHEN 'workatastartup' THEN {yc_wt} END AS mapped_work_type,
  CASE source WHEN 'roberthalf' THEN {O.employment_map_sql(emp_label)} END AS employment_type,
  CASE source WHEN 'roberthalf' THEN {sal} END AS salary,
  CASE source WHEN 'linkedin' THEN title || ' ' || title || ' ' || company || {ago}
    WHEN 'wellfound' THEN title || ' ' || company || {ago}
    WHEN 'workatastartup' THEN substr(company || ' ' || title || ' at ' || company ||
      CASE WHEN location = '' THEN '' ELSE ' ' || location END || ' ' || {label} || ' ' || {O.q(FP.TEAM_BLURB)} ||
      CASE WHEN seq % 3 = 0 THEN ' Apply' ELSE '' END, 1, 2000)
    ELSE {O.stripped_sql('description')} END AS description
FROM p WHERE source IN ({", ".join(O.q(b) for b in FP.CARD_BOARDS)})
"""


register("html_card_postings", _cards_sql())(_cards)


# ---- A5: JSON-LD fallback ---------------------------------------------------------------------
#: A window in which most of the fixture's postings lie.
JSONLD_HOURS = 480.0
JSONLD_CUTOFF = window_cutoff(RUN.run_ts, JSONLD_HOURS).isoformat(sep=" ")


def _jsonld(spark, d):
    """Pages with cards and pages with structured data alone, in one input."""
    pages = FP.jsonld_pages(postings(spark, d))
    out = html_cards.card_or_jsonld(pages, RUN.run_ts, JSONLD_HOURS)
    return out.select("url", "job_id", "title", "company", "location", format_ts("posted_at").alias("posted_at"), "description")


_SCRIPTS = f"""
w AS (SELECT *, seq // {PG} AS pg FROM p WHERE source = 'wellfound'),
fb AS (SELECT pg, min(seq) AS first_bad FROM w WHERE pg % {FP.BAD_PAGE_EVERY} = 1 AND seq % {FP.BAD_ITEM_EVERY} = 0 GROUP BY pg)"""

register("jsonld_postings", f"""
WITH {O.postings_cte()}, {_SCRIPTS}
SELECT 'https://wellfound.com/jobs/' || CAST(seq AS VARCHAR) AS url, NULL AS job_id, title, company, location,
       strftime(posted_at, {TS_FMT}) AS posted_at, description
FROM w LEFT JOIN fb USING (pg)
WHERE pg % {FP.CARD_PAGE_EVERY} <> 0 AND (first_bad IS NULL OR seq < first_bad)
  AND (posted_at IS NULL OR posted_at >= TIMESTAMP '{JSONLD_CUTOFF}')
UNION ALL
SELECT 'https://wellfound.com/jobs/' || CAST(seq AS VARCHAR) || '-opening', CAST(seq AS VARCHAR), title, company, NULL,
       strftime(posted_at, {TS_FMT}), title || ' ' || company || CASE WHEN posted_at IS NULL THEN '' ELSE
         ' ' || CAST(date_diff('hour', posted_at, TIMESTAMP '{RUN.run_ts}') AS VARCHAR) || ' hours ago' END
FROM w WHERE pg % {FP.CARD_PAGE_EVERY} = 0
""")(_jsonld)


# ---- A2-A5: what could not be read, and what could ------------------------------------------------
def _read_report(spark, d):
    """For each board: payloads or script items in all, those read and those
    quarantined, with the reason."""
    p = postings(spark, d)
    number = F.col("payload_id")
    report = json_boards.payload_report(FP.damaged(FP.json_payloads(p), number), FP.damaged(FP.rss_feeds(p), number))
    items = html_cards.parsed_pages(FP.jsonld_pages(p))
    filed = quarantine.rejected_items(items, RUN.run_ts, JSONLD_HOURS)
    counted = report.groupBy("source", F.coalesce("reason", F.lit("read")).alias("reason")).agg(
        F.count("*").alias("n"), F.sum("n_items").alias("n_items"))
    scripts = filed.groupBy("source", "reason").agg(F.count("*").alias("n")).withColumn("n_items", F.col("n"))
    kept = html_cards.postings_of(items, RUN.run_ts, 24.0 * 365 * 100).groupBy("source").agg(F.count("*").alias("n")).select(
        "source", F.lit("read").alias("reason"), "n", F.col("n").alias("n_items"))
    return counted.unionByName(scripts).unionByName(kept)


register("read_report", f"""
WITH {O.postings_cte()}, {_SCRIPTS},
pages AS (
  SELECT source, seq // {PG} AS pg, count(*) AS items FROM p
  WHERE source IN ('remotive', 'arbeitnow', 'greenhouse', 'weworkremotely') GROUP BY ALL),
judged AS (
  SELECT source, CASE pg % {FP.CUT_EVERY} WHEN 3 THEN 'malformed' WHEN 2 THEN 'no body' ELSE 'read' END AS reason,
         CASE WHEN pg % {FP.CUT_EVERY} IN (2, 3) THEN 0 ELSE items END AS items FROM pages),
scripts AS (
  SELECT CASE WHEN pg % {FP.CARD_PAGE_EVERY} = 0 OR first_bad IS NULL OR seq < first_bad THEN 'read'
              WHEN seq % {FP.BAD_ITEM_EVERY} = 0 THEN 'unreadable item' ELSE 'after an unreadable item' END AS reason
  FROM w LEFT JOIN fb USING (pg))
SELECT source, reason, count(*) AS n, CAST(sum(items) AS BIGINT) AS n_items FROM judged GROUP BY ALL
UNION ALL
SELECT 'wellfound', reason, count(*), count(*) FROM scripts GROUP BY ALL
""")(_read_report)


# ---- A7: resume texts ---------------------------------------------------------------------------
#: The third role uses the first one's file.
RESUME_OF = {1: 1, 2: 2, 3: 1}


def _resume_text(spark, d):
    """Resumes are written as text files, one for each role that has its own,
    and read back by the roles' paths."""
    root = f"{checkpoint_dir(spark)}/resumes-{uuid.uuid4().hex}"
    own = resumes.resumes_from_table(table(spark, d, "benchmark"), CFG)
    own.repartition(1).write.partitionBy("role_id").text(root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path").collect()  # one a role
    paths = {int(re.search(r"role_id=(\d+)", f["path"])[1]): f["path"] for f in files}
    cfg = dataclasses.replace(CFG, roles=tuple(Role(r, f"Role {r}", resume_path=paths[f]) for r, f in RESUME_OF.items() if f in paths))
    return resumes.read_resumes(spark, cfg).select(
        "role_id", F.length("resume_text").cast("bigint").alias("resume_chars"), F.md5("resume_text").alias("resume_md5"))


register("resume_text", f"""
WITH {O.roles_cte()}, of(role_id, item_id) AS (VALUES {", ".join(map(str, RESUME_OF.items()))})
SELECT of.role_id, length(b.text) + 1 AS resume_chars, md5(b.text || chr(10)) AS resume_md5
FROM of JOIN roles r ON r.role_id = of.item_id JOIN benchmark b ON b.item_id = r.role_id
""")(_resume_text)


# ---- A8: partitioned landing + pruned read ----------------------------------------------------------
def _pruned(spark, d):
    # a folder of its own for each call: an answer never comes from an older input
    path = f"{checkpoint_dir(spark)}/landed-postings-{uuid.uuid4().hex}"
    landed.write_landed(postings(spark, d), path)
    boards = [b.name for b in CFG.enabled_boards]
    out = landed.read_landed(spark, path, boards, RUN.run_ts, RUN.posted_within_hours)
    return out.select("seq", "source", "url", "title", "company", "description", format_ts("posted_at").alias("posted_at"))


register("pruned_scan", f"""
WITH {O.postings_cte()}
SELECT seq, source, url, title, company, description, strftime(posted_at, {TS_FMT}) AS posted_at FROM p
WHERE source IN ({", ".join(O.q(b.name) for b in CFG.enabled_boards)})
  AND (posted_at IS NULL OR posted_at >= TIMESTAMP '{CUTOFF}')
""")(_pruned)


# ---- B8: entity-decoded, tag-free text -------------------------------------------------------------
# The pages' own text (rows only: an HTML parser has no SQL twin), and the
# documents' texts wrapped and encoded as a board sends them, whose text is known.
register("html_text")(lambda spark, d: table(spark, d, "pages").select(
    "page_id", html_text_column()(F.col("html")).alias("text")))


def _known_text(spark, d):
    body = FP.esc(F.concat(F.lit("<div><style>p{}</style><p>"), FP.esc("text"), F.lit("</p><br><ul><li>Apply &amp; go</ul>")))
    return table(spark, d, "documents").select("doc_id", html_text_column()(body).alias("text"))


register("html_text_known", f"""
SELECT doc_id, trim({O.stripped_sql('text')} || ' Apply & go') AS text FROM documents
""")(_known_text)
