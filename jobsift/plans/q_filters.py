"""Queries for the filters (C1-C9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.classify import salary_low, work_type_from_location
from ..functions.timestamps import format_ts, window_cutoff
from ..operators import filters
from ..sources.fixtures import FIXTURE_CONFIG as CFG
from ..sources.fixtures import landed_postings, postings
from . import oracle_sql as O
from .catalog import register

RUN = CFG.run
CUTOFF = window_cutoff(RUN.run_ts, RUN.posted_within_hours).isoformat(sep=" ")
TS_FMT = "'%Y-%m-%d %H:%M:%S.%f'"

# ---- C1 ---------------------------------------------------------------------
register("window_filter", f"""
WITH {O.postings_cte()}
SELECT seq, source, strftime(posted_at, {TS_FMT}) AS posted_at FROM p
WHERE posted_at IS NULL OR posted_at >= TIMESTAMP '{CUTOFF}' OR source = 'linkedin'
""")(lambda spark, d: filters.window_filter(postings(spark, d).select("seq", "source", "posted_at"), RUN)
     .select("seq", "source", format_ts("posted_at").alias("posted_at")))


# ---- C2 / C3 ------------------------------------------------------------------
def _relevance(with_eng):
    def run(spark, d):
        df = landed_postings(spark, d, CFG).select("role_id", "seq", "title")
        return filters.title_relevance(df, CFG, with_eng=with_eng).select("role_id", "seq", "title")
    return run


def _relevance_sql(with_eng):
    terms = O.eng_terms_sql("role_terms") if with_eng else "role_terms"
    return f"""
WITH {O.landed_ctes()}
SELECT role_id, seq, title FROM landed
WHERE len(list_filter({terms}, lambda t: contains(lower(title), t))) > 0
"""


register("title_relevance", _relevance_sql(False))(_relevance(False))
register("title_relevance_eng", _relevance_sql(True))(_relevance(True))


# ---- C4 -----------------------------------------------------------------------
def _loc_parts(spark, d):
    df = landed_postings(spark, d, CFG).filter(F.col("city").isNotNull())
    return filters.location_parts_filter(df).select("role_id", "seq", "search_cell", "location")


register("location_match_parts", f"""
WITH {O.landed_ctes()},
lp2 AS (
  SELECT *, list_transform(string_split(lower(location), ','),
                           lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS parts
  FROM landed WHERE city IS NOT NULL
)
SELECT role_id, seq, search_cell, location FROM lp2
WHERE CASE WHEN work_type = 'remote' THEN contains(lower(location), 'remote')
      ELSE len(list_filter(parts, lambda x: NOT contains(x, 'remote')
                 AND (contains(x, lower(city)) OR ends_with(x, lower(state))))) > 0
           OR contains(lower(location), ', ' || lower(state)) END
""")(_loc_parts)


# ---- C5 -----------------------------------------------------------------------
def _loc_simple(spark, d):
    df = (landed_postings(spark, d, CFG).filter(F.col("city").isNotNull())
          .withColumn("mapped_work_type", work_type_from_location("location")))
    return filters.location_simple_filter(df).select("role_id", "seq", "search_cell", "location")


WT_LOC_SQL = ("CASE WHEN contains(lower(location), 'remote') AND contains(lower(location), 'hybrid') THEN 'hybrid' "
              "WHEN contains(lower(location), 'remote') THEN 'remote' "
              "WHEN contains(lower(location), 'hybrid') THEN 'hybrid' END")

register("location_match_simple", f"""
WITH {O.landed_ctes()},
x AS (SELECT *, {WT_LOC_SQL} AS mapped_work_type FROM landed WHERE city IS NOT NULL)
SELECT role_id, seq, search_cell, location FROM x
WHERE COALESCE(mapped_work_type = 'remote', false)
   OR contains(lower(location), lower(city)) OR contains(lower(location), ', ' || lower(state))
""")(_loc_simple)


# ---- C6 -----------------------------------------------------------------------
def _wt_match(spark, d):
    df = landed_postings(spark, d, CFG).withColumn("mapped_work_type", work_type_from_location("location"))
    return filters.work_type_match(df).select("role_id", "seq", "work_type", "mapped_work_type")


register("work_type_match", f"""
WITH {O.landed_ctes()},
x AS (SELECT *, {WT_LOC_SQL} AS mapped_work_type FROM landed)
SELECT role_id, seq, work_type, mapped_work_type FROM x
WHERE mapped_work_type IS NULL OR mapped_work_type = work_type
""")(_wt_match)


# ---- C7 -----------------------------------------------------------------------
SAL = RUN.salary
LOW_SQL = ("(CASE WHEN contains(lower(salary), 'hour') AND fig < 1000 THEN fig * 2080 ELSE fig END)")


def _salary(spark, d):
    df = postings(spark, d).select("seq", "salary")
    return filters.salary_filter(df, RUN).select("seq", "salary", salary_low("salary").alias("salary_low"))


register("salary_filter", f"""
WITH {O.postings_cte()},
x AS (
  SELECT seq, salary,
    TRY_CAST(replace(regexp_extract_all(salary, '\\$?([\\d,]+)', 1)[1], ',', '') AS BIGINT) AS fig
  FROM p
), y AS (SELECT seq, salary, {LOW_SQL} AS salary_low FROM x)
SELECT seq, salary, salary_low FROM y
WHERE CASE WHEN salary IS NULL OR salary = '' OR salary_low IS NULL THEN {str(SAL.include_unlisted).upper()}
           ELSE NOT (salary_low < {SAL.min or 0}) END
""")(_salary)


# ---- C8 -----------------------------------------------------------------------
register("company_blacklist", f"""
WITH {O.postings_cte()}
SELECT seq, company FROM p
WHERE len(list_filter({O.lst(RUN.blacklist_terms)}, lambda t: contains(lower(company), t))) = 0
""")(lambda spark, d: filters.company_blacklist(postings(spark, d).select("seq", "company"), RUN))


# ---- C9 -----------------------------------------------------------------------
register("employment_filter", f"""
WITH {O.postings_cte()}
SELECT seq, employment_type FROM p
WHERE employment_type IS NULL OR employment_type IN ({", ".join(O.q(e) for e in RUN.employment_types)})
""")(lambda spark, d: filters.employment_filter(postings(spark, d).select("seq", "employment_type"), RUN))
