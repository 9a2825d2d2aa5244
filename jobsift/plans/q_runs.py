"""The end-to-end run (H1) and its stages as queries."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from ..functions.timestamps import format_ts, window_cutoff
from ..operators import dedup
from ..operators.cells import n_cells
from ..params import GLOBAL_SEARCH_BOARDS
from ..sources.fixtures import FIXTURE_CONFIG as CFG
from ..session import checkpoint_dir
from ..sources import fixture_pages, html_cards, json_boards, landed, payload_files
from ..sources.fixtures import landed_postings, postings, tracked_seed
from . import oracle_sql as O
from . import run as R
from .catalog import register

RUN = CFG.run
TS_FMT = "'%Y-%m-%d %H:%M:%S.%f'"
CAP = RUN.max_jobs_per_location
GLOBAL_CAP = CAP * len(CFG.locations)
CUTOFF_SQL = f"TIMESTAMP '{window_cutoff(RUN.run_ts, RUN.posted_within_hours).isoformat(sep=' ')}'"
TOPK_ORDER = "match_score DESC, posted_at DESC NULLS LAST, board_ord, search_cell, seq"
GLOBALS = ", ".join(O.q(b) for b in GLOBAL_SEARCH_BOARDS)


def responses(spark, d):
    """Model answers landed per (role, board, url): the fixture's answer column."""
    return landed_postings(spark, d, CFG).select("role_id", "source", "url", F.col("llm_raw").alias("raw"))


def inputs(spark, d):
    return landed_postings(spark, d, CFG), tracked_seed(spark, d), responses(spark, d)


def gathered_sql(landed: str = "true") -> str:
    """CTEs up to ``gathered`` (board rules, caps, cross-board dedup) of the
    landed rows that fulfil a condition."""
    rel = O.relevance_sql("role_terms")
    rel_eng = O.relevance_sql(O.eng_terms_sql("role_terms"))
    simple = ("(COALESCE(mapped_work_type = 'remote', false) OR contains(lower(location), lower(city)) "
              "OR contains(lower(location), ', ' || lower(state)))")
    return f"""{O.landed_ctes()},
mw AS (
  SELECT *, CASE WHEN source IN ('greenhouse', 'roberthalf') THEN {O.WT_LOC_SQL} END AS mapped_work_type FROM landed
  WHERE {landed}
),
ruled AS (
  SELECT *, CASE WHEN source IN ('arbeitnow', 'workatastartup') THEN mapped_work_type
                 ELSE COALESCE(mapped_work_type, work_type) END AS job_work_type FROM mw
  WHERE (source = 'linkedin' OR posted_at IS NULL OR posted_at >= {CUTOFF_SQL})
    AND (source NOT IN ('weworkremotely', 'arbeitnow', 'greenhouse', 'builtin') OR {rel})
    AND (source <> 'workatastartup' OR {rel_eng})
    AND (source <> 'greenhouse' OR {O.loc_parts_sql()})
    AND (source <> 'roberthalf' OR ((mapped_work_type IS NULL OR mapped_work_type = work_type) AND {simple}))
),
regular AS (SELECT * FROM ruled WHERE source NOT IN ({GLOBALS})),
{O.cap_per_cell_sql('regular', CAP, n_cells(CFG, 'linkedin'))},
gk AS (SELECT *, {O.DKEY} AS gdkey FROM ruled WHERE source IN ({GLOBALS})),
gf AS (SELECT *, row_number() OVER (PARTITION BY role_id, source, gdkey ORDER BY search_cell, seq) AS grn FROM gk),
gp AS (SELECT *, row_number() OVER (PARTITION BY role_id, source ORDER BY search_cell, seq) AS gpos FROM gf WHERE grn = 1),
kept AS (SELECT role_id, source, seq FROM capped UNION ALL SELECT role_id, source, seq FROM gp WHERE gpos <= {GLOBAL_CAP}),
capped_rows AS (SELECT r.* FROM ruled r JOIN kept k ON r.role_id = k.role_id AND r.source = k.source AND r.seq = k.seq),
xb AS (SELECT *, rank() OVER (PARTITION BY role_id, url ORDER BY board_ord) AS xrk FROM capped_rows),
gathered AS (SELECT * EXCLUDE (xrk) FROM xb WHERE xrk = 1)"""


ANSWERS_SQL = "answers AS (SELECT role_id, source, url, min(llm_raw) AS llm_raw FROM landed GROUP BY role_id, source, url)"


def chosen_sql(tracked: str | None = None, answers: str = ANSWERS_SQL, landed: str = "true") -> str:
    return f"""{gathered_sql(landed)},
{tracked or O.tracked_cte()},
{answers},
cand AS (
  SELECT g.* EXCLUDE (llm_raw), a.llm_raw FROM gathered g JOIN answers a USING (role_id, source, url)
  WHERE {O.salary_ok_sql(RUN)} AND {O.company_ok_sql(RUN)} AND {O.employment_ok_sql(RUN)}
    AND NOT EXISTS (SELECT 1 FROM tracked t WHERE t.url = g.url)
),
{O.parse_response_ctes('cand', 'llm_raw')},
base AS (SELECT * EXCLUDE (pr_j), COALESCE(parsed_score, 0) AS base_parsed FROM parsed),
{O.scored_cte('base', 'base_parsed')},
ranked AS (SELECT *, row_number() OVER (PARTITION BY role_id ORDER BY {TOPK_ORDER}) AS rank FROM scored),
chosen AS (
  SELECT *, CASE WHEN match_score < {RUN.min_match_score} THEN 'skipped' ELSE 'pending' END AS status,
    CASE WHEN match_score < {RUN.min_match_score}
         THEN 'score ' || match_score || ' < threshold {RUN.min_match_score}' ELSE 'ready for manual review' END AS notes
  FROM ranked WHERE rank <= {RUN.max_jobs}
)"""


# ---- gather stage -------------------------------------------------------------------
register("gathered_jobs", f"""
WITH {gathered_sql()}
SELECT role_id, seq, source, board_ord, search_cell, job_work_type FROM gathered
""")(lambda spark, d: R.gather(landed_postings(spark, d, CFG), CFG)
     .select("role_id", "seq", "source", "board_ord", "search_cell", "job_work_type"))


# ---- D9: every gathered posting with its model answer ---------------------------------
register("score_attach", f"""
WITH {gathered_sql()},
answers AS (SELECT role_id, source, url, min(llm_raw) AS raw FROM landed GROUP BY role_id, source, url)
SELECT g.role_id, g.source, g.seq, g.url, a.raw FROM gathered g LEFT JOIN answers a USING (role_id, source, url)
""")(lambda spark, d: R.attach_responses(R.gather(landed_postings(spark, d, CFG), CFG), responses(spark, d),
                                         dedup.gather_bound(CFG)).select("role_id", "source", "seq", "url", "raw"))


# ---- per-role results -----------------------------------------------------------------
register("role_results", f"""
WITH {chosen_sql()}
SELECT role_id, rank, seq, url, match_score, status, notes FROM chosen
""")(lambda spark, d: R.role_results(*inputs(spark, d), CFG)
     .select("role_id", "rank", "seq", "url", "match_score", "status", "notes"))


# ---- H1: the whole run, merged by URL ----------------------------------------------------
FULL_COLS = ["url", "role_id", "seq", "title", "company", "source", "posted_at", "job_work_type",
             "match_score", "status", "notes"]


def _full(spark, d):
    out = R.full_run(*inputs(spark, d), CFG)
    return out.select(*[format_ts(c).alias(c) if c == "posted_at" else F.col(c) for c in FULL_COLS])


def merged_sql(tracked: str | None = None, answers: str = ANSWERS_SQL, landed: str = "true") -> str:
    return f"""{chosen_sql(tracked, answers, landed)},
mm AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY match_score DESC, role_ord, rank) AS mr FROM chosen),
merged AS (SELECT * EXCLUDE (mr) FROM mm WHERE mr = 1)"""


register("full_run", f"""
WITH {merged_sql()}
SELECT url, role_id, seq, title, company, source, strftime(posted_at, {TS_FMT}) AS posted_at, job_work_type,
       match_score, status, notes
FROM merged
""")(_full)


# ---- H1 from raw payloads: adapters, partitioned landing, pruned read, run -----------------
def fetched_payloads(spark, d):
    """API payloads and feeds as a fetcher leaves them, one file each by board
    and day, read back for the run's boards and the days of its window."""
    p = postings(spark, d)
    root = f"{checkpoint_dir(spark)}/fetched-{uuid.uuid4().hex}"
    last = dt.date.fromisoformat(RUN.run_ts[:10])
    fetched = F.date_sub(F.lit(last), F.pmod("payload_id", F.lit(FETCH_DAYS)).cast("int")).alias("day")
    api, feeds = fixture_pages.json_payloads(p), fixture_pages.rss_feeds(p).withColumn("token", F.lit(None).cast("string"))
    payload_files.write(api.select("*", fetched), root, "json")
    payload_files.write(feeds.select("*", fetched), root, "xml")
    return payload_files.read(spark, root, [b.name for b in CFG.enabled_boards], last - dt.timedelta(hours=RUN.posted_within_hours)).drop("day")


#: The fixture's payloads were fetched over this many days.
FETCH_DAYS = 5


def payload_landed(spark, d):
    """All boards' payloads parsed, landed by board and day, and read back for
    the run's boards and window only."""
    cards = html_cards.landed_from_pages(fixture_pages.card_pages(postings(spark, d)), CFG)
    payloads = fetched_payloads(spark, d)
    is_feed = F.col("source") == "weworkremotely"
    feeds = json_boards.landed_from_payloads(payloads.filter(~is_feed), payloads.filter(is_feed), CFG)
    path = f"{checkpoint_dir(spark)}/payload-landing-{uuid.uuid4().hex}"
    landed.write_landed(cards.unionByName(feeds, allowMissingColumns=True), path)
    return landed.read_landed(spark, path, [b.name for b in CFG.enabled_boards], RUN.run_ts, RUN.posted_within_hours)


def _full_payloads(spark, d):
    rows = payload_landed(spark, d)
    answers = rows.select("role_id", "source", "url", F.format_string(
        '{"match_score": %d}', F.pmod(F.length("description"), F.lit(101)).cast("int")).alias("raw"))
    out = R.full_run(rows, tracked_seed(spark, d), answers, CFG)
    return out.select("url", "role_id", "title", "company", "source", format_ts("posted_at").alias("posted_at"),
                      "job_work_type", "match_score", "status", "notes")


register("full_run_payloads")(_full_payloads)
