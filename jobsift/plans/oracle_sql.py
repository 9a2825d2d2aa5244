"""DuckDB reference SQL for each registered query.

Written independently of the Spark code path, over the same driver tables.
Configuration values are rendered from the same ``SearchConfig`` so both
sides see the same roles, locations and parameters.
"""

from __future__ import annotations

from ..params import SearchConfig
from ..sources.fixtures import FIXTURE_CONFIG, POSTINGS_SQL


# Written out here, apart from the values the Spark side uses, so that a wrong
# value on either side shows.
SENIORITY_ORDER = ["junior", "mid", "senior", "staff", "principal"]
SENIORITY_PATTERNS = [
    (r"\b(junior|jr\.?|entry.?level|associate)\b", "junior"), (r"\b(mid|intermediate|mid.?level)\b", "mid"),
    (r"\b(senior|sr\.?)\b", "senior"), (r"\bstaff\b", "staff"),
    (r"\b(principal|distinguished|fellow|director|vp)\b", "principal")]
YEARS_RANGE_PATTERN = r"(\d+)\s*(?:to|-)\s*(\d+)\s*years?"
YEARS_PLUS_PATTERN = r"(\d+)\+\s*years?"
YEARS_EXPERIENCE_PATTERN = r"(\d+)\s*years?\s+(?:of\s+)?(?:[\w-]+\s+){0,2}(?:experience|exp)"
ENG_KEYWORDS = [
    "software", "engineer", "developer", "backend", "frontend", "full stack", "fullstack", "swe",
    "sde", "platform", "infrastructure", "devops", "ml", "machine learning", "data",
]
EMPLOYMENT_TYPE_MAP = [
    ("permanent / full time", "full-time"), ("full time", "full-time"), ("contract to hire", "contract"),
    ("contract", "contract"), ("temporary to hire", "temporary"), ("temporary", "temporary"),
    ("part time", "part-time"), ("part-time", "part-time"),
]
STATE_NAMES = [
    ("AL", "Alabama"), ("AK", "Alaska"), ("AZ", "Arizona"), ("AR", "Arkansas"),
    ("CA", "California"), ("CO", "Colorado"), ("CT", "Connecticut"), ("DE", "Delaware"),
    ("FL", "Florida"), ("GA", "Georgia"), ("HI", "Hawaii"), ("ID", "Idaho"),
    ("IL", "Illinois"), ("IN", "Indiana"), ("IA", "Iowa"), ("KS", "Kansas"),
    ("KY", "Kentucky"), ("LA", "Louisiana"), ("ME", "Maine"), ("MD", "Maryland"),
    ("MA", "Massachusetts"), ("MI", "Michigan"), ("MN", "Minnesota"), ("MS", "Mississippi"),
    ("MO", "Missouri"), ("MT", "Montana"), ("NE", "Nebraska"), ("NV", "Nevada"),
    ("NH", "New Hampshire"), ("NJ", "New Jersey"), ("NM", "New Mexico"), ("NY", "New York"),
    ("NC", "North Carolina"), ("ND", "North Dakota"), ("OH", "Ohio"), ("OK", "Oklahoma"),
    ("OR", "Oregon"), ("PA", "Pennsylvania"), ("RI", "Rhode Island"), ("SC", "South Carolina"),
    ("SD", "South Dakota"), ("TN", "Tennessee"), ("TX", "Texas"), ("UT", "Utah"),
    ("VT", "Vermont"), ("VA", "Virginia"), ("WA", "Washington"), ("WV", "West Virginia"),
    ("WI", "Wisconsin"), ("WY", "Wyoming"), ("DC", "District of Columbia"),
]


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(items) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]::VARCHAR[]"


def num(x) -> str:
    return "NULL" if x is None else repr(x)


def stripped_sql(c: str) -> str:
    """Text without white space at its ends (as Python's strip)."""
    return f"regexp_replace({c}, '^[\\s\\x1c-\\x1f\\x85\\p{{Z}}]+|[\\s\\x1c-\\x1f\\x85\\p{{Z}}]+$', '', 'g')"


def escaped_sql(c: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = f"replace({c}, {q(a)}, {q(b)})"
    return c


def roles_cte(cfg: SearchConfig = FIXTURE_CONFIG) -> str:
    rows = []
    for i, r in enumerate(cfg.roles):
        lo, hi = r.level_bounds
        rows.append(f"({r.role_id}, {i}, {q(r.title)}, {lst(r.terms)}, {num(lo)}, {num(hi)}, "
                    f"CAST({float(r.years_experience)!r} AS DOUBLE), CAST({float(r.experience_std_dev)!r} AS DOUBLE))")
    return ("roles(role_id, role_ord, role_title, role_terms, lvl_lo, lvl_hi, years, sigma) AS (VALUES "
            + ", ".join(rows) + ")")


def postings_cte() -> str:
    return f"p AS ({POSTINGS_SQL})"


def cells_cte(cfg: SearchConfig = FIXTURE_CONFIG) -> str:
    from ..operators.cells import cell_rows
    rows = []
    for (rid, src, bord, cell, wt, city, state, blind) in cell_rows(cfg):
        rows.append(f"({rid}, {q(src)}, {bord}, {cell}, {q(wt)}, {q(city) if city else 'NULL'}, "
                    f"{q(state) if state else 'NULL'}, {str(blind).upper()})")
    return ("cells(role_id, source, board_ord, search_cell, work_type, city, state, location_blind) AS (VALUES "
            + ", ".join(rows) + ")")


def landed_ctes(cfg: SearchConfig = FIXTURE_CONFIG) -> str:
    """p, roles, cells and the landed view (p x roles spread over cells)."""
    ords = cfg.board_ord()
    bo = "CASE source " + " ".join(f"WHEN {q(n)} THEN {o}" for n, o in ords.items()) + " END"
    n_loc, n_wt = len(cfg.locations), len(cfg.work_types)
    return f"""{postings_cte()},
{roles_cte(cfg)},
{cells_cte(cfg)},
lp AS (
  SELECT p.*, {bo} AS board_ord,
         CAST((seq // 9) % (CASE WHEN source = 'workatastartup' THEN {n_wt} ELSE {n_wt * n_loc} END) AS INTEGER)
           AS search_cell
  FROM p WHERE source IN ({", ".join(q(n) for n in ords)})
),
landed AS (
  SELECT lp.*, r.role_id, r.role_ord, r.role_title, r.role_terms, r.lvl_lo, r.lvl_hi, r.years, r.sigma,
         c.work_type, c.city, c.state, c.location_blind
  FROM lp CROSS JOIN roles r
  JOIN cells c ON c.role_id = r.role_id AND c.source = lp.source AND c.search_cell = lp.search_cell
)"""


# ---- scoring expressions (DuckDB dialect) ----------------------------------

def seniority_level_sql(title: str) -> str:
    whens = " ".join(f"WHEN regexp_matches(lower({title}), {q(p)}) THEN {q(l)}" for p, l in SENIORITY_PATTERNS)
    return f"(CASE {whens} END)"


def level_index_sql(level: str) -> str:
    return f"(list_position({lst(SENIORITY_ORDER)}, {level}) - 1)"


def seniority_adj_sql(idx: str, lo: str, hi: str) -> str:
    return (f"CAST(CASE WHEN {idx} IS NULL OR {lo} IS NULL OR {hi} IS NULL THEN 0 "
            f"WHEN {idx} BETWEEN {lo} AND {hi} THEN 8 "
            f"ELSE -least(least(abs({idx} - {lo}), abs({idx} - {hi})) * 10, 20) END AS INTEGER)")


def required_years_sql(desc: str) -> str:
    d = f"lower(COALESCE({desc}, ''))"
    return (f"list_max(list_transform(list_concat(regexp_extract_all({d}, {q(YEARS_RANGE_PATTERN)}, 2), "
            f"regexp_extract_all({d}, {q(YEARS_PLUS_PATTERN)}, 1), "
            f"regexp_extract_all({d}, {q(YEARS_EXPERIENCE_PATTERN)}, 1)), lambda x: TRY_CAST(x AS DOUBLE)))")


def experience_adj_sql(req: str, years: str, sigma: str) -> str:
    z = f"(({req} - {years}) / NULLIF({sigma}, 0))"
    return f"CAST(COALESCE(round_even((exp(-0.5 * {z} * {z}) - 1.0) * 20.0, 0), 0) AS INTEGER)"


def final_score_sql(base: str, adj: str) -> str:
    return f"CAST(greatest(0, least(100, {base} + {adj})) AS INTEGER)"


def scored_cte(source: str, base: str) -> str:
    """Adds job_level .. match_score to rows of ``source`` (needs role columns)."""
    return f"""s0 AS (
  SELECT *, {seniority_level_sql('title')} AS job_level, {required_years_sql('description')} AS required_years
  FROM {source}
), s1 AS (
  SELECT *, {seniority_adj_sql(level_index_sql('job_level'), 'lvl_lo', 'lvl_hi')} AS seniority_adj,
         {experience_adj_sql('required_years', 'years', 'sigma')} AS experience_adj
  FROM s0
), scored AS (
  SELECT *, {final_score_sql(base, 'seniority_adj + experience_adj')} AS match_score FROM s1
)"""


def eng_terms_sql(terms: str) -> str:
    return f"list_concat({terms}, {lst(ENG_KEYWORDS)})"


def employment_map_sql(raw: str) -> str:
    whens = " ".join(f"WHEN contains(lower({raw}), {q(k)}) THEN {q(v)}" for k, v in EMPLOYMENT_TYPE_MAP)
    return f"(CASE {whens} END)"


def state_names_cte() -> str:
    return "state_names(code, name) AS (VALUES " + ", ".join(f"({q(c)}, {q(n)})" for c, n in STATE_NAMES) + ")"


def tracked_cte() -> str:
    """Tracker seed: labels joined to p, one row per url (latest document)."""
    return """tracked AS (
  SELECT job_id, title, company, location, url, source, posted_at, CAST(base_score AS INTEGER) AS match_score,
         ['seed']::VARCHAR[] AS match_reasons, []::VARCHAR[] AS gap_reasons, '' AS cover_letter,
         CASE WHEN toxic = 1 THEN 'skipped' ELSE 'pending' END AS status, 'seeded' AS notes,
         TIMESTAMP '2024-01-01 00:00:00' AS created_at
  FROM (SELECT p.*, l.toxic, row_number() OVER (PARTITION BY p.url ORDER BY p.seq DESC) AS r
        FROM p JOIN labels l ON p.seq = l.doc_id) WHERE r = 1
)"""


DKEY = "COALESCE(NULLIF(job_id, ''), company || '::' || title || '::' || url)"


def cap_per_cell_sql(source: str, cap: int, n_cells: int) -> str:
    """Exact per-cell cap, unrolled over the cells (each cell sees the keys
    kept by earlier cells). Produces CTEs f, k0..k{n-1}, capped."""
    parts = [f"""f AS (
  SELECT role_id, source, search_cell, {DKEY} AS dkey, min(seq) AS seq FROM {source}
  GROUP BY role_id, source, search_cell, {DKEY}
)"""]
    for c in range(n_cells):
        prior = " UNION ALL ".join(f"SELECT role_id, source, dkey FROM k{i}" for i in range(c)) or \
            "SELECT NULL::INTEGER AS role_id, NULL::VARCHAR AS source, NULL::VARCHAR AS dkey WHERE false"
        parts.append(f"""k{c} AS (
  SELECT role_id, source, dkey, seq FROM (
    SELECT f.*, row_number() OVER (PARTITION BY role_id, source ORDER BY seq) AS rn FROM f
    WHERE search_cell = {c} AND NOT EXISTS (
      SELECT 1 FROM ({prior}) pr WHERE pr.role_id = f.role_id AND pr.source = f.source AND pr.dkey = f.dkey)
  ) WHERE rn <= {cap}
)""")
    parts.append("capped AS (" + " UNION ALL ".join(f"SELECT role_id, source, seq FROM k{c}"
                                                    for c in range(n_cells)) + ")")
    return ",\n".join(parts)


def parse_response_ctes(src: str, raw: str, out: str = "parsed") -> str:
    """Model answer -> score (0 on failure) and reasons; keeps all columns of ``src``."""
    ws = "' ' || chr(10) || chr(13) || chr(9) || chr(12) || chr(11)"
    return f"""pr_b AS (SELECT *, trim({raw}, {ws}) AS pr_t FROM {src}),
pr_c AS (SELECT *, CASE WHEN starts_with(pr_t, '```') THEN split_part(pr_t, '```', 2) ELSE pr_t END AS pr_b0 FROM pr_b),
pr_d AS (SELECT *, CASE WHEN starts_with(pr_b0, 'json') THEN substr(pr_b0, 5) ELSE pr_b0 END AS pr_body FROM pr_c),
pr_e AS (SELECT *, CASE WHEN json_valid(pr_body) THEN pr_body::JSON END AS pr_j FROM pr_d),
pr_f AS (
  SELECT *, json_type(pr_j) = 'OBJECT' AS pr_obj, json_exists(pr_j, '$.match_score') AS pr_present,
         json_type(pr_j, '$.match_score') AS pr_st, json_extract(pr_j, '$.match_score') AS pr_sv
  FROM pr_e
),
{out} AS (
  SELECT * EXCLUDE (pr_t, pr_b0, pr_body, pr_obj, pr_present, pr_st, pr_sv),
    CASE WHEN pr_j IS NULL OR NOT pr_obj THEN NULL
         WHEN NOT pr_present THEN 0
         WHEN pr_st IN ('BIGINT', 'UBIGINT') THEN TRY_CAST(pr_sv::VARCHAR AS INTEGER)
         WHEN pr_st = 'DOUBLE' THEN TRY_CAST(trunc(pr_sv::DOUBLE) AS INTEGER)
         WHEN pr_st = 'BOOLEAN' THEN CASE WHEN pr_sv::VARCHAR = 'true' THEN 1 ELSE 0 END
         WHEN pr_st = 'VARCHAR' THEN TRY_CAST(json_extract_string(pr_j, '$.match_score') AS INTEGER)
    END AS parsed_score
  FROM pr_f
)"""


WT_LOC_SQL = ("CASE WHEN contains(lower(location), 'remote') AND contains(lower(location), 'hybrid') THEN 'hybrid' "
              "WHEN contains(lower(location), 'remote') THEN 'remote' "
              "WHEN contains(lower(location), 'hybrid') THEN 'hybrid' END")


def relevance_sql(terms: str) -> str:
    return f"(len(list_filter({terms}, lambda t: contains(lower(title), t))) > 0)"


def loc_parts_sql() -> str:
    return """(CASE WHEN work_type = 'remote' THEN contains(lower(location), 'remote')
      ELSE len(list_filter(list_transform(string_split(lower(location), ','),
                 lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: NOT contains(x, 'remote')
                 AND (contains(x, lower(city)) OR ends_with(x, lower(state))))) > 0
           OR contains(lower(location), ', ' || lower(state)) END)"""


def salary_ok_sql(run) -> str:
    sal = run.salary
    if sal.min is None and sal.max is None:
        return "true"
    fig = "TRY_CAST(replace(regexp_extract_all(salary, '\\$?([\\d,]+)', 1)[1], ',', '') AS BIGINT)"
    low = f"(CASE WHEN contains(lower(salary), 'hour') AND {fig} < 1000 THEN {fig} * 2080 ELSE {fig} END)"
    conds = ["true"]
    if sal.skip_if_below_min and sal.min:
        conds.append(f"NOT ({low} < {sal.min})")
    if sal.max:
        conds.append(f"NOT ({low} > {sal.max})")
    return (f"(CASE WHEN salary IS NULL OR salary = '' OR {low} IS NULL THEN {str(sal.include_unlisted).upper()} "
            f"ELSE {' AND '.join(conds)} END)")


def company_ok_sql(run) -> str:
    terms = run.blacklist_terms
    if not terms:
        return "true"
    return f"(len(list_filter({lst(terms)}, lambda t: contains(lower(company), t))) = 0)"


def employment_ok_sql(run) -> str:
    if not run.employment_types:
        return "true"
    return f"(employment_type IS NULL OR employment_type IN ({', '.join(q(e) for e in run.employment_types)}))"
