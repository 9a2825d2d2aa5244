"""Queries for scoring (E) and selection (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring, select
from ..operators.cells import pair_roles
from ..sources.fixtures import FIXTURE_CONFIG as CFG
from ..sources.fixtures import landed_postings, postings
from . import oracle_sql as O
from .catalog import register

RUN = CFG.run


def _scored(spark, sf_dir):
    return scoring.adjust_scores(landed_postings(spark, sf_dir, CFG, features=True), base="base_score")


# ---- E5 ---------------------------------------------------------------------
register("seniority_level", f"""
WITH {O.postings_cte()}
SELECT seq, title, {O.seniority_level_sql('title')} AS job_level FROM p
""")(lambda spark, d: postings(spark, d).select("seq", "title", scoring.seniority_level("title").alias("job_level")))


# ---- E6 ---------------------------------------------------------------------
def _seniority_adjust(spark, d):
    df = pair_roles(postings(spark, d).select("seq", "title"), CFG)
    lvl = scoring.seniority_level("title")
    return df.select("role_id", "seq", scoring.seniority_adjust(scoring.level_index(lvl), "lvl_lo", "lvl_hi")
                     .alias("seniority_adj"))


register("seniority_adjust", f"""
WITH {O.postings_cte()}, {O.roles_cte()}
SELECT r.role_id, p.seq,
  {O.seniority_adj_sql(O.level_index_sql(O.seniority_level_sql('p.title')), 'r.lvl_lo', 'r.lvl_hi')} AS seniority_adj
FROM p CROSS JOIN roles r
""")(_seniority_adjust)


# ---- E7 ---------------------------------------------------------------------
register("required_years", f"""
WITH {O.postings_cte()}
SELECT seq, {O.required_years_sql('description')} AS required_years FROM p
""")(lambda spark, d: scoring.posting_features(postings(spark, d).select("seq", "title", "description"))
     .select("seq", "required_years"))


# ---- E8 ---------------------------------------------------------------------
def _experience_adjust(spark, d):
    # the texts are scanned once per posting, before the role fan-out
    known = scoring.posting_features(postings(spark, d).select("seq", "title", "description")).select(
        "seq", "required_years")
    return pair_roles(known, CFG).select(
        "role_id", "seq", scoring.experience_adjust("required_years", "years", "sigma").alias("experience_adj"))


register("experience_adjust", f"""
WITH {O.postings_cte()}, {O.roles_cte()}
SELECT r.role_id, p.seq, {O.experience_adj_sql(O.required_years_sql('p.description'), 'r.years', 'r.sigma')}
  AS experience_adj
FROM p CROSS JOIN roles r
""")(_experience_adjust)


# ---- E9 ---------------------------------------------------------------------
def _final_score(spark, d):
    return _scored(spark, d).select("role_id", "seq", "job_level", "seniority_adj", "required_years",
                                    "experience_adj", "match_score")


register("final_score", f"""
WITH {O.landed_ctes()}, {O.scored_cte('landed', 'base_score')}
SELECT role_id, seq, job_level, seniority_adj, required_years, experience_adj, match_score FROM scored
""")(_final_score)


# ---- E2 ---------------------------------------------------------------------
def _parse_response(spark, d):
    df = scoring.parse_response(postings(spark, d).select("seq", F.col("llm_raw").alias("raw")), "raw")
    return df.select("seq", "match_score", F.array_join("match_reasons", "|").alias("match_reasons"),
                     F.size("gap_reasons").cast("int").alias("n_gap_reasons"))


register("parse_response", f"""
WITH {O.postings_cte()},
b AS (
  SELECT seq, trim(llm_raw, ' ' || chr(10) || chr(13) || chr(9) || chr(12) || chr(11)) AS t FROM p
), c AS (
  SELECT seq, CASE WHEN starts_with(t, '```') THEN split_part(t, '```', 2) ELSE t END AS body0 FROM b
), d AS (
  SELECT seq, CASE WHEN starts_with(body0, 'json') THEN substr(body0, 5) ELSE body0 END AS body FROM c
), e AS (
  SELECT seq, CASE WHEN json_valid(body) THEN body::JSON END AS j FROM d
), f AS (
  SELECT seq, j, json_type(j) = 'OBJECT' AS is_obj, json_exists(j, '$.match_score') AS present,
         json_type(j, '$.match_score') AS st, json_extract(j, '$.match_score') AS sv
  FROM e
), g AS (
  SELECT seq, j,
    CASE WHEN j IS NULL OR NOT is_obj THEN NULL
         WHEN NOT present THEN 0
         WHEN st IN ('BIGINT', 'UBIGINT') THEN TRY_CAST(sv::VARCHAR AS INTEGER)
         WHEN st = 'DOUBLE' THEN TRY_CAST(trunc(sv::DOUBLE) AS INTEGER)
         WHEN st = 'BOOLEAN' THEN CASE WHEN sv::VARCHAR = 'true' THEN 1 ELSE 0 END
         WHEN st = 'VARCHAR' THEN TRY_CAST(json_extract_string(j, '$.match_score') AS INTEGER)
    END AS score
  FROM f
)
SELECT seq, COALESCE(score, 0) AS match_score,
  CASE WHEN score IS NOT NULL THEN COALESCE(array_to_string(
      TRY_CAST(json_extract(j, '$.match_reasons') AS VARCHAR[]), '|'), '') ELSE '' END AS match_reasons,
  CAST(CASE WHEN score IS NOT NULL THEN COALESCE(len(TRY_CAST(json_extract(j, '$.gap_reasons') AS VARCHAR[])), 0)
       ELSE 0 END AS INTEGER) AS n_gap_reasons
FROM g
""")(_parse_response)


# ---- F1 ---------------------------------------------------------------------
def _topk(spark, d):
    top = select.topk_per_role(_scored(spark, d), RUN.max_jobs)
    return top.select("role_id", "rank", "seq", "url", "match_score")


TOPK_ORDER = "match_score DESC, posted_at DESC NULLS LAST, board_ord, search_cell, seq"

register("topk_per_role", f"""
WITH {O.landed_ctes()}, {O.scored_cte('landed', 'base_score')},
ranked AS (SELECT *, row_number() OVER (PARTITION BY role_id ORDER BY {TOPK_ORDER}) AS rank FROM scored)
SELECT role_id, rank, seq, url, match_score FROM ranked WHERE rank <= {RUN.max_jobs}
""")(_topk)


# ---- F2: every scored row ---------------------------------------------------
def _status(spark, d):
    return select.status_notes(_scored(spark, d), RUN.min_match_score).select(
        "role_id", "seq", "match_score", "status", "notes")


register("status_notes", f"""
WITH {O.landed_ctes()}, {O.scored_cte('landed', 'base_score')}
SELECT role_id, seq, match_score,
  CASE WHEN match_score < {RUN.min_match_score} THEN 'skipped' ELSE 'pending' END AS status,
  CASE WHEN match_score < {RUN.min_match_score}
       THEN 'score ' || match_score || ' < threshold {RUN.min_match_score}' ELSE 'ready for manual review' END AS notes
FROM scored
""")(_status)


# ---- F3 ---------------------------------------------------------------------
def _merge(spark, d):
    top = select.topk_per_role(_scored(spark, d), RUN.max_jobs)
    return select.merge_roles(top).select("url", "role_id", "seq", "match_score")


register("merge_roles", f"""
WITH {O.landed_ctes()}, {O.scored_cte('landed', 'base_score')},
ranked AS (SELECT *, row_number() OVER (PARTITION BY role_id ORDER BY {TOPK_ORDER}) AS rank FROM scored),
top AS (SELECT * FROM ranked WHERE rank <= {RUN.max_jobs}),
m AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY match_score DESC, role_ord, rank) AS mr FROM top)
SELECT url, role_id, seq, match_score FROM m WHERE mr = 1
""")(_merge)
