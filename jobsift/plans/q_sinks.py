"""Queries for state and sinks (G2-G6)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.timestamps import format_ts
from ..operators import dedup, select
from ..session import checkpoint_dir, materialize
from ..sinks import export, tracker
from ..sources.fixtures import FIXTURE_CONFIG as CFG
from ..sources.fixtures import landed_postings, tracked_seed
from . import oracle_sql as O
from . import run as R
from .catalog import register
from .q_runs import gathered_sql, inputs, merged_sql
from .q_scoring import _scored

RUN = CFG.run
TS_FMT = "'%Y-%m-%d %H:%M:%S.%f'"


# ---- G2: upsert by URL --------------------------------------------------------------
def upsert_apps(spark, d):
    """Every scored row with its status, merged to one row per URL; it
    overlaps the tracked seed, so both the update and the insert path run."""
    return select.merge_roles(select.status_notes(_scored(spark, d), RUN.min_match_score))


def _upserted(spark, d):
    seed = materialize(tracked_seed(spark, d), "tracked-seed")
    return tracker.upsert(seed, upsert_apps(spark, d), RUN.run_ts)


def upserted_sql() -> str:
    return f"""{O.landed_ctes()}, {O.scored_cte('landed', 'base_score')}, {O.tracked_cte()},
st AS (
  SELECT *, CASE WHEN match_score < {RUN.min_match_score} THEN 'skipped' ELSE 'pending' END AS status,
    CASE WHEN match_score < {RUN.min_match_score}
         THEN 'score ' || match_score || ' < threshold {RUN.min_match_score}' ELSE 'ready for manual review' END AS notes
  FROM scored
),
am AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY match_score DESC, role_ord, posted_at DESC NULLS LAST,
                                    board_ord, search_cell, seq) AS mr FROM st),
apps AS (SELECT * FROM am WHERE mr = 1),
upd AS (
  SELECT t.job_id, t.url, t.title, t.company, t.location, t.source, t.posted_at,
    CASE WHEN a.url IS NOT NULL THEN a.match_score ELSE t.match_score END AS match_score,
    CASE WHEN a.url IS NOT NULL THEN a.status ELSE t.status END AS status,
    CASE WHEN a.url IS NOT NULL THEN a.notes ELSE t.notes END AS notes,
    CASE WHEN a.url IS NOT NULL THEN '' ELSE array_to_string(t.match_reasons, '|') END AS match_reasons,
    CASE WHEN a.url IS NOT NULL THEN '' ELSE array_to_string(t.gap_reasons, '|') END AS gap_reasons,
    CASE WHEN a.url IS NOT NULL THEN '' ELSE t.cover_letter END AS cover_letter,
    t.created_at
  FROM tracked t LEFT JOIN apps a ON a.url = t.url
),
ins AS (
  SELECT a.job_id, a.url, a.title, a.company, a.location, a.source, a.posted_at, a.match_score, a.status, a.notes,
         '' AS match_reasons, '' AS gap_reasons, '' AS cover_letter, TIMESTAMP '{RUN.run_ts}' AS created_at
  FROM apps a WHERE NOT EXISTS (SELECT 1 FROM tracked t WHERE t.url = a.url)
),
upserted AS (SELECT * FROM upd UNION ALL SELECT * FROM ins)"""


register("upsert_tracked", f"""
WITH {upserted_sql()}
SELECT job_id, url, title, company, location, source, strftime(posted_at, {TS_FMT}) AS posted_at, match_score, status,
       notes, match_reasons, gap_reasons, cover_letter, strftime(created_at, {TS_FMT}) AS created_at
FROM upserted
""")(lambda spark, d: _upserted(spark, d).select(
    "job_id", "url", "title", "company", "location", "source", format_ts("posted_at").alias("posted_at"), "match_score",
    "status", "notes", F.array_join("match_reasons", "|").alias("match_reasons"),
    F.array_join("gap_reasons", "|").alias("gap_reasons"), "cover_letter", format_ts("created_at").alias("created_at")))


# ---- G3: statistics ---------------------------------------------------------------------
register("status_stats", f"""
WITH {upserted_sql()}
SELECT status, CAST(count(*) AS BIGINT) AS n FROM upserted GROUP BY status
""")(lambda spark, d: tracker.status_stats(_upserted(spark, d)))


# ---- F5: ready count ----------------------------------------------------------------------
register("ready_count", f"""
WITH {merged_sql()}
SELECT CAST(count(*) AS BIGINT) AS ready FROM merged WHERE status = 'pending'
""")(lambda spark, d: select.ready_count(R.full_run(*inputs(spark, d), CFG)))


# ---- G4: CSV rows -------------------------------------------------------------------------
ISO_SQL = ("COALESCE(strftime(posted_at, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime(posted_at, '%f') <> '000000' "
           "THEN '.' || strftime(posted_at, '%f') ELSE '' END || '+00:00', '')")

def _csv(spark, d):
    """The export written as CSV and read back."""
    path = f"{checkpoint_dir(spark)}/export-{uuid.uuid4().hex}"
    export.write_csv(R.full_run(*inputs(spark, d), CFG), path)
    return export.read_csv(spark, path)


register("csv_export", f"""
WITH {merged_sql()}
SELECT title, company, location, source, url, {ISO_SQL} AS posted_at, COALESCE(job_work_type, '') AS work_type,
       CAST(match_score AS INTEGER) AS match_score, status, notes
FROM merged
""")(_csv)


# ---- G5: reports ------------------------------------------------------------------------------
def _jobs_report(spark, d):
    gathered = R.gather(landed_postings(spark, d, CFG), CFG)
    return export.jobs_report(gathered, RUN.run_ts, dedup.newest_first_cols(), bounded=True)


register("jobs_report", f"""
WITH {gathered_sql()},
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY role_id ORDER BY posted_at DESC NULLS LAST, board_ord,
                                         search_cell, seq) AS BIGINT) AS pos FROM gathered)
SELECT role_id, pos, title, company, location, source,
  CASE WHEN posted_at IS NULL THEN 'unknown' ELSE
    format('{{:.1f}}h ago', (epoch_us(TIMESTAMP '{RUN.run_ts}') - epoch_us(posted_at)) / 1000000.0 / 3600.0) END
    AS posted
FROM n
""")(_jobs_report)

register("results_report", f"""
WITH {merged_sql()}
SELECT row_number() OVER (ORDER BY match_score DESC, url) AS position, company, title,
       CAST(match_score AS INTEGER) AS match_score, status, substr(notes, 1, 60) AS notes FROM merged
""")(lambda spark, d: export.results_report(R.full_run(*inputs(spark, d), CFG)))


# ---- G6: letters and their paths ---------------------------------------------------
def _letters(spark, d):
    landed = landed_postings(spark, d, CFG)
    letters = landed.select("role_id", "source", "url", F.concat(
        F.lit("Dear "), "company", F.lit(",\n\n"), "description").alias("letter"))
    return export.letter_rows(R.full_run(*inputs(spark, d), CFG, letters))


register("letter_paths", f"""
WITH {merged_sql()},
lpath AS (
  SELECT m.url, m.company, m.source,
    'applications/cover_' || regexp_replace(m.company, '[^\\p{{L}}\\p{{N}}]', '_', 'g') || '_' || m.source || '.txt' AS path,
    (SELECT min('Dear ' || l.company || ',' || chr(10) || chr(10) || l.description) FROM landed l
     WHERE l.role_id = m.role_id AND l.source = m.source AND l.url = m.url) AS cover_letter
  FROM merged m WHERE status = 'pending'
)
SELECT path, url, company, source, count(*) OVER (PARTITION BY path) > 1 AS collision, cover_letter FROM lpath
""")(_letters)
