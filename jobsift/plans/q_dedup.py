"""Queries for search cells, board union, joins, dedup and caps (A1, A6, D1-D8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timestamps import format_ts
from ..operators import dedup
from ..operators.cells import n_cells, pair_roles
from ..params import BOARD_NAMES, GLOBAL_SEARCH_BOARDS
from ..session import materialize
from ..sources.fixtures import FIXTURE_CONFIG as CFG
from ..sources.fixtures import landed_postings, postings, tracked_seed
from . import oracle_sql as O
from .catalog import register

RUN = CFG.run
TS_FMT = "'%Y-%m-%d %H:%M:%S.%f'"
CAP = RUN.max_jobs_per_location
N_CELLS = n_cells(CFG, "linkedin")
GLOBAL_CAP = CAP * len(CFG.locations)

# ---- A1 -----------------------------------------------------------------------
register("search_cells", f"""
WITH {O.landed_ctes()}
SELECT role_id, seq, source, board_ord, search_cell, work_type, city, state, location_blind FROM landed
""")(lambda spark, d: landed_postings(spark, d, CFG).select(
    "role_id", "seq", "source", "board_ord", "search_cell", "work_type", "city", "state", "location_blind"))


# ---- A6 -----------------------------------------------------------------------
FEED_BOARDS = ["remotive", "weworkremotely", "arbeitnow"]
API_BOARDS = ["greenhouse"]
UNION_COLS = ["seq", "source", "url", "title"]


def _union(spark, d):
    """Card, feed and company-board relations, each with columns of its own,
    from one written scan: cards state pay, feeds a text for relevance, the
    company boards a location."""
    p = materialize(postings(spark, d).select(*UNION_COLS, "salary", "employment_type", "location"), "board-rows")
    src = F.col("source")
    cards = p.filter(~src.isin(FEED_BOARDS + API_BOARDS)).select(*UNION_COLS, "salary", "employment_type")
    feeds = p.filter(src.isin(FEED_BOARDS)).select("title", "url", F.concat_ws(": ", src, "title").alias("relevance_title"), "seq", "source")
    api = p.filter(src.isin(API_BOARDS)).select(*UNION_COLS, "location")
    return dedup.union_boards([cards, feeds, api], CFG).select(*UNION_COLS, "board_ord", "salary", "employment_type", "relevance_title", "location")


_ords = CFG.board_ord()
_feeds, _api = (", ".join(O.q(b) for b in boards) for boards in (FEED_BOARDS, API_BOARDS))
register("union_boards", f"""
WITH {O.postings_cte()}
SELECT seq, source, url, title, CASE source {" ".join(f"WHEN {O.q(n)} THEN {o}" for n, o in _ords.items())} END AS board_ord,
  CASE WHEN source NOT IN ({_feeds}, {_api}) THEN salary END AS salary,
  CASE WHEN source NOT IN ({_feeds}, {_api}) THEN employment_type END AS employment_type,
  CASE WHEN source IN ({_feeds}) THEN source || ': ' || title END AS relevance_title,
  CASE WHEN source IN ({_api}) THEN location END AS location
FROM p
""")(_union)


# ---- D1 -----------------------------------------------------------------------
register("anti_tracked", f"""
WITH {O.postings_cte()}, {O.tracked_cte()}
SELECT seq, url FROM p WHERE NOT EXISTS (SELECT 1 FROM tracked t WHERE t.url = p.url)
""")(lambda spark, d: dedup.anti_tracked(postings(spark, d).select("seq", "url"), tracked_seed(spark, d)))


# ---- D2 -----------------------------------------------------------------------
register("dedup_board", f"""
WITH {O.landed_ctes()},
k AS (SELECT *, {O.DKEY} AS dedup_key FROM landed),
r AS (SELECT *, row_number() OVER (PARTITION BY role_id, source, dedup_key ORDER BY search_cell, seq) AS rn FROM k)
SELECT role_id, source, seq, search_cell, dedup_key FROM r WHERE rn = 1
""")(lambda spark, d: dedup.dedup_board(landed_postings(spark, d, CFG))
     .select("role_id", "source", "seq", "search_cell", "dedup_key"))


# ---- D3 -----------------------------------------------------------------------
register("cap_per_cell", f"""
WITH {O.landed_ctes()},
regular AS (SELECT * FROM landed WHERE source NOT IN ({", ".join(O.q(b) for b in GLOBAL_SEARCH_BOARDS)})),
{O.cap_per_cell_sql('regular', CAP, N_CELLS)}
SELECT c.role_id, c.source, c.seq, l.search_cell FROM capped c
JOIN regular l ON l.role_id = c.role_id AND l.source = c.source AND l.seq = c.seq
""")(lambda spark, d: dedup.cap_per_cell(
    landed_postings(spark, d, CFG).filter(~F.col("source").isin(GLOBAL_SEARCH_BOARDS)), CFG)
     .select("role_id", "source", "seq", "search_cell"))


# ---- D4 -----------------------------------------------------------------------
register("cap_global", f"""
WITH {O.landed_ctes()},
g AS (SELECT *, {O.DKEY} AS dkey FROM landed WHERE source IN ({", ".join(O.q(b) for b in GLOBAL_SEARCH_BOARDS)})),
f AS (SELECT *, row_number() OVER (PARTITION BY role_id, source, dkey ORDER BY search_cell, seq) AS rn FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY role_id, source ORDER BY search_cell, seq) AS pos FROM f WHERE rn = 1)
SELECT role_id, source, seq, search_cell FROM r WHERE pos <= {GLOBAL_CAP}
""")(lambda spark, d: dedup.cap_global(
    landed_postings(spark, d, CFG).filter(F.col("source").isin(GLOBAL_SEARCH_BOARDS)), CFG)
     .select("role_id", "source", "seq", "search_cell"))


# ---- D6 -----------------------------------------------------------------------
register("dedup_cross_board", f"""
WITH {O.landed_ctes()},
r AS (SELECT *, rank() OVER (PARTITION BY role_id, url ORDER BY board_ord) AS rk FROM landed)
SELECT role_id, seq, url, board_ord FROM r WHERE rk = 1
""")(lambda spark, d: dedup.dedup_cross_board(landed_postings(spark, d, CFG))
     .select("role_id", "seq", "url", "board_ord"))


# ---- D7 -----------------------------------------------------------------------
register("newest_first", f"""
WITH {O.landed_ctes()}
SELECT role_id, seq, strftime(posted_at, {TS_FMT}) AS posted_at, board_ord, search_cell FROM landed
ORDER BY role_id, posted_at DESC NULLS LAST, board_ord, search_cell, seq
""")(lambda spark, d: landed_postings(spark, d, CFG)
     .orderBy(F.col("role_id"), *dedup.newest_first_cols())
     .select("role_id", "seq", format_ts("posted_at").alias("posted_at"), "board_ord", "search_cell"))


# ---- D8 -----------------------------------------------------------------------
register("role_pairs", f"""
WITH {O.postings_cte()}, {O.roles_cte()}
SELECT r.role_id, r.role_title, p.seq FROM p CROSS JOIN roles r
""")(lambda spark, d: pair_roles(postings(spark, d).select("seq"), CFG).select("role_id", "role_title", "seq"))

