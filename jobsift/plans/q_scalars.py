"""Queries for the scalar functions (B1-B18).

Inputs are derived from the driver tables: event timestamps rendered in the
formats the boards publish, and posting columns of the fixture view.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as X
from ..functions import timestamps as T
from ..params import UNIT_SECONDS
from ..sources.fixtures import FIXTURE_CONFIG as CFG
from ..sources.fixtures import landed_postings, postings, table
from . import oracle_sql as O
from .catalog import register

RUN = CFG.run
TS_FMT = "'%Y-%m-%d %H:%M:%S.%f'"


def events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


# ---- B1: ISO-8601 -------------------------------------------------------------
def iso_text_spark():
    k = F.col("event_id") % 6
    return (F.when(k == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
             .when(k == 1, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
             .when(k == 2, F.date_format("ts", "yyyy-MM-dd"))
             .when(k == 3, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
             .when(k == 4, F.date_format("ts", "yyyyMMdd"))
             .otherwise(F.lit("posted recently")))


ISO_TEXT_SQL = """CASE event_id % 6
  WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z'
  WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+02:00'
  WHEN 2 THEN strftime(ts, '%Y-%m-%d')
  WHEN 3 THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%f')
  WHEN 4 THEN strftime(ts, '%Y%m%d')
  ELSE 'posted recently' END"""


def iso_parse_sql(s: str) -> str:
    return (f"(CASE WHEN NOT regexp_matches({s}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN NULL "
            f"WHEN regexp_matches({s}, '(Z|[+-]\\d{{2}}:?\\d{{2}})$') "
            f"THEN TRY_CAST({s} AS TIMESTAMPTZ) AT TIME ZONE 'UTC' ELSE TRY_CAST({s} AS TIMESTAMP) END)")


register("ts_iso", f"""
WITH e AS (SELECT event_id, {ISO_TEXT_SQL} AS s FROM events)
SELECT event_id, s, strftime({iso_parse_sql('s')}, {TS_FMT}) AS posted_at FROM e
""")(lambda spark, d: events(spark, d).select("event_id", iso_text_spark().alias("s"))
     .select("event_id", "s", T.format_ts(T.parse_iso("s")).alias("posted_at")))


# ---- B2: epoch seconds ----------------------------------------------------------
register("ts_epoch", f"""
WITH e AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0 ELSE CAST(floor(epoch(ts)) AS BIGINT) END AS secs
           FROM events)
SELECT event_id, secs,
  strftime(CASE WHEN secs <> 0 THEN make_timestamp(secs * 1000000) END, {TS_FMT}) AS posted_at FROM e
""")(lambda spark, d: events(spark, d)
     .select("event_id", F.when(F.col("event_id") % 7 == 0, F.lit(0).cast("bigint"))
             .otherwise(F.unix_seconds("ts")).alias("secs"))
     .select("event_id", "secs", T.format_ts(T.parse_epoch_seconds("secs")).alias("posted_at")))


# ---- B3: feed dates ---------------------------------------------------------------
def _rfc(spark, d):
    e = events(spark, d)
    base = F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss")
    k = F.col("event_id") % 5
    pub = (F.when(k == 0, F.concat(base, F.lit(" +0000"))).when(k == 1, F.concat(base, F.lit(" +0200")))
            .when(k == 2, F.concat(base, F.lit(" -0530"))).when(k == 3, F.lit(None).cast("string"))
            .otherwise(F.lit("yesterday")))
    upd = F.concat(base, F.lit(" +0100"))
    return (e.select("event_id", pub.alias("published"), upd.alias("updated"))
             .select("event_id", "published", "updated",
                     T.format_ts(T.feed_date("published", "updated")).alias("posted_at")))


def rfc_parse_sql(s: str) -> str:
    body = f"regexp_replace({s}, '^\\s*[A-Za-z]{{3}},\\s*', '')"
    return f"(try_strptime({body}, '%d %b %Y %H:%M:%S %z') AT TIME ZONE 'UTC')"


register("ts_rfc822", f"""
WITH e AS (
  SELECT event_id, strftime(ts, '%a, %d %b %Y %H:%M:%S') AS base, event_id % 5 AS k FROM events
), f AS (
  SELECT event_id,
    CASE k WHEN 0 THEN base || ' +0000' WHEN 1 THEN base || ' +0200' WHEN 2 THEN base || ' -0530'
           WHEN 3 THEN NULL ELSE 'yesterday' END AS published,
    base || ' +0100' AS updated
  FROM e
)
SELECT event_id, published, updated,
  strftime(COALESCE({rfc_parse_sql('published')}, {rfc_parse_sql('updated')}), {TS_FMT}) AS posted_at FROM f
""")(_rfc)


# ---- B4: relative ages ----------------------------------------------------------------
DIALECTS = ["linkedin", "wellfound", "builtin", "workatastartup"]


def _rel_text_spark():
    n = (F.col("event_id") % 50).cast("string")
    units = ["minute", "hour", "day", "week", "month", "year"]
    unit = F.element_at(F.array(*[F.lit(u) for u in units]), (F.col("event_id") % 6 + 1).cast("int"))
    plural = F.when(F.col("event_id") % 50 == 1, F.lit("")).otherwise(F.lit("s"))
    ago = F.when(F.col("event_id") % 4 == 0, F.lit("")).otherwise(F.lit(" ago"))
    lead = F.when(F.col("event_id") % 3 == 0, F.lit("Posted ")).otherwise(F.lit(""))
    return F.concat(lead, n, F.lit(" "), F.upper(F.substring(unit, 1, 1)), F.substring(unit, 2, 10), plural, ago)


REL_TEXT_SQL = """(CASE WHEN event_id % 3 = 0 THEN 'Posted ' ELSE '' END) || CAST(event_id % 50 AS VARCHAR) || ' '
  || upper(substr(u, 1, 1)) || substr(u, 2, 10) || (CASE WHEN event_id % 50 = 1 THEN '' ELSE 's' END)
  || (CASE WHEN event_id % 4 = 0 THEN '' ELSE ' ago' END)"""


def _rel(spark, d):
    e = events(spark, d).select(
        "event_id", _rel_text_spark().alias("text"),
        F.element_at(F.array(*[F.lit(x) for x in DIALECTS]), (F.col("event_id") % 4 + 1).cast("int")).alias("board"))
    return e.select("event_id", "board", "text",
                    T.format_ts(T.parse_relative_by_source("text", "board", RUN.run_ts)).alias("posted_at"))


def rel_parse_sql(text: str, board: str) -> str:
    branches = []
    for dialect in DIALECTS:
        pat = T.relative_pattern(dialect)
        t = f"lower({text})" if dialect != "builtin" else f"trim(lower({text}))"
        n = f"TRY_CAST(regexp_extract({t}, {O.q(pat)}, 1) AS BIGINT)"
        u = f"regexp_extract({t}, {O.q(pat)}, 2)"
        secs = "CASE " + " ".join(f"WHEN {u} = {O.q(k)} THEN {v}" for k, v in UNIT_SECONDS.items()) + " END"
        branches.append(f"WHEN {board} = {O.q(dialect)} THEN CASE WHEN {u} <> '' THEN "
                        f"make_timestamp(epoch_us(TIMESTAMP '{RUN.run_ts}') - {n} * {secs} * 1000000) END")
    return "(CASE " + " ".join(branches) + " END)"


register("ts_relative", f"""
WITH e AS (
  SELECT event_id, ['minute','hour','day','week','month','year'][event_id % 6 + 1] AS u,
         ['linkedin','wellfound','builtin','workatastartup'][event_id % 4 + 1] AS board FROM events
), f AS (SELECT event_id, board, {REL_TEXT_SQL} AS text FROM e)
SELECT event_id, board, text, strftime({rel_parse_sql('text', 'board')}, {TS_FMT}) AS posted_at FROM f
""")(_rel)


# ---- B5: precedence (time@datetime, time text, card text) -------------------------------
def _prec(spark, d):
    e = events(spark, d)
    k = F.col("event_id") % 4
    attr = (F.when(k == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.lit("soon"))
             .otherwise(F.lit("")))
    ttext = F.when(k == 2, F.lit("")).otherwise(F.concat((F.col("event_id") % 30).cast("string"), F.lit(" hours ago")))
    card = F.concat(F.lit("Engineer Acme Chicago "), (F.col("event_id") % 9).cast("string"), F.lit(" days ago"))
    return (e.select("event_id", attr.alias("dt_attr"), ttext.alias("time_text"), card.alias("card_text"))
             .select("event_id", "dt_attr", "time_text",
                     T.format_ts(T.posted_at_card("dt_attr", "time_text", "card_text", RUN.run_ts)).alias("posted_at")))


def _prec_sql():
    pat = T.relative_pattern("linkedin")
    src = "lower(COALESCE(NULLIF(time_text, ''), card_text))"
    n = f"TRY_CAST(regexp_extract({src}, {O.q(pat)}, 1) AS BIGINT)"
    u = f"regexp_extract({src}, {O.q(pat)}, 2)"
    secs = "CASE " + " ".join(f"WHEN {u} = {O.q(k)} THEN {v}" for k, v in UNIT_SECONDS.items()) + " END"
    rel = f"CASE WHEN {u} <> '' THEN make_timestamp(epoch_us(TIMESTAMP '{RUN.run_ts}') - {n} * {secs} * 1000000) END"
    return f"""
WITH e AS (
  SELECT event_id,
    CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' WHEN 1 THEN 'soon' ELSE '' END AS dt_attr,
    CASE WHEN event_id % 4 = 2 THEN '' ELSE CAST(event_id % 30 AS VARCHAR) || ' hours ago' END AS time_text,
    'Engineer Acme Chicago ' || CAST(event_id % 9 AS VARCHAR) || ' days ago' AS card_text
  FROM events
)
SELECT event_id, dt_attr, time_text,
  strftime(COALESCE({iso_parse_sql("NULLIF(dt_attr, '')")}, {rel}), {TS_FMT}) AS posted_at FROM e
"""


register("ts_precedence", _prec_sql())(_prec)


# ---- B6 + B17: age and its label -----------------------------------------------------------
register("age_hours", f"""
WITH {O.postings_cte()},
a AS (SELECT seq, (epoch_us(TIMESTAMP '{RUN.run_ts}') - epoch_us(posted_at)) / 1000000.0 / 3600.0 AS age_hours FROM p)
SELECT seq, age_hours, CASE WHEN age_hours IS NULL THEN 'unknown' ELSE format('{{:.1f}}h ago', age_hours) END AS age
FROM a
""")(lambda spark, d: postings(spark, d).select("seq", T.age_hours("posted_at", RUN.run_ts).alias("age_hours"))
     .withColumn("age", X.age_label("age_hours")))


# ---- B7 ----------------------------------------------------------------------------------------
register("strip_tags", """
SELECT page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS text FROM pages
""")(lambda spark, d: table(spark, d, "pages").select("page_id", X.strip_tags("html").alias("text")))


# ---- B9: job ids and canonical URLs ----------------------------------------------------------
def _href_spark():
    s = F.col("seq").cast("string")
    k = F.col("seq") % 5
    return (F.when(k == 0, F.concat(F.lit("/jobs/view/"), s, F.lit("/?refId=abc")))
             .when(k == 1, F.concat(F.lit("https://www.linkedin.com/jobs/view/"), s)).when(k == 2, F.lit("/jobs/search"))
             .when(k == 3, F.concat(F.lit("/jobs/"), s, F.lit("-staff-engineer/")))
             .otherwise(F.concat(F.lit("/company/acme/jobs/"), s)))


HREF_SQL = """CASE seq % 5 WHEN 0 THEN '/jobs/view/' || CAST(seq AS VARCHAR) || '/?refId=abc'
  WHEN 1 THEN 'https://www.linkedin.com/jobs/view/' || CAST(seq AS VARCHAR) WHEN 2 THEN '/jobs/search'
  WHEN 3 THEN '/jobs/' || CAST(seq AS VARCHAR) || '-staff-engineer/'
  ELSE '/company/acme/jobs/' || CAST(seq AS VARCHAR) END"""
ID_BOARDS = ["linkedin", "wellfound", "builtin", "workatastartup"]


def _job_id_url(spark, d):
    df = postings(spark, d).select("seq", _href_spark().alias("href"))
    cols = []
    for b in ID_BOARDS:
        cols += [X.job_id_from_href("href", b).alias(f"{b}_id"), X.canonical_url("href", b).alias(f"{b}_url")]
    return df.select("seq", "href", *cols)


def _job_id_url_sql():
    cols = []
    for b in ID_BOARDS:
        pat = X.JOB_ID_PATTERNS[b]
        jid = f"NULLIF(regexp_extract(href, {O.q(pat)}, 1), '')"
        cols.append(f"{jid} AS {b}_id")
        from ..params import BOARD_BASE_URLS
        if b == "linkedin":
            cols.append(f"CASE WHEN {jid} IS NOT NULL THEN 'https://www.linkedin.com/jobs/view/' || {jid} "
                        f"ELSE href END AS {b}_url")
        else:
            cols.append(f"CASE WHEN starts_with(href, 'http') THEN href ELSE {O.q(BOARD_BASE_URLS[b])} || href END "
                        f"AS {b}_url")
    return f"WITH {O.postings_cte()}, h AS (SELECT seq, {HREF_SQL} AS href FROM p)\nSELECT seq, href, " + \
        ", ".join(cols) + " FROM h"


register("job_id_url", _job_id_url_sql())(_job_id_url)


# ---- B10: title / company splits ----------------------------------------------------------------
def _split(spark, d):
    p = postings(spark, d)
    k = F.col("seq") % 3
    link = (F.when(k == 0, F.concat("title", F.lit(" at "), "company"))
             .when(k == 1, F.col("title"))
             .otherwise(F.concat("title", F.lit(" at Night at "), "company")))
    feed = (F.when(k == 0, F.concat("company", F.lit(": "), "title", F.lit(" at "), "company"))
             .when(k == 1, F.col("title")).otherwise(F.concat("company", F.lit(": "), "title")))
    author = F.when(F.col("seq") % 4 == 0, F.col("company")).otherwise(F.lit(""))
    df = p.select("seq", link.alias("link_text"), feed.alias("feed_text"), author.alias("author"))
    t, c = X.split_last_at("link_text")
    return df.select("seq", t.alias("card_title"), c.alias("card_company"),
                     X.feed_title("feed_text").alias("feed_title"),
                     X.feed_company("author", "feed_text").alias("feed_company"))


register("title_company_split", f"""
WITH {O.postings_cte()},
x AS (
  SELECT seq,
    CASE seq % 3 WHEN 0 THEN title || ' at ' || company WHEN 1 THEN title ELSE title || ' at Night at ' || company END
      AS link_text,
    CASE seq % 3 WHEN 0 THEN company || ': ' || title || ' at ' || company WHEN 1 THEN title
      ELSE company || ': ' || title END AS feed_text,
    CASE WHEN seq % 4 = 0 THEN company ELSE '' END AS author
  FROM p
), y AS (
  SELECT *, length(link_text) - strpos(reverse(link_text), reverse(' at ')) - 2 AS at_pos FROM x
)
SELECT seq,
  CASE WHEN contains(link_text, ' at ') THEN trim(substr(link_text, 1, at_pos - 1)) ELSE link_text END AS card_title,
  CASE WHEN contains(link_text, ' at ') THEN trim(substr(link_text, at_pos + 4)) ELSE '' END AS card_company,
  trim(split_part(feed_text, ':', 1)) AS feed_title,
  CASE WHEN author <> '' THEN author
       WHEN contains(feed_text, ' at ') THEN trim(string_split(feed_text, ' at ')[-1]) ELSE '' END AS feed_company
FROM y
""")(_split)


# ---- B11: work type from multi-part locations ------------------------------------------------------
register("work_type_location", f"""
WITH {O.landed_ctes()},
x AS (SELECT role_id, seq, location, work_type,
  CASE WHEN contains(lower(location), 'remote') AND contains(lower(location), 'hybrid') THEN 'hybrid'
       WHEN contains(lower(location), 'remote') THEN 'remote'
       WHEN contains(lower(location), 'hybrid') THEN 'hybrid' END AS mapped FROM landed)
SELECT role_id, seq, location, mapped AS mapped_work_type, COALESCE(mapped, work_type) AS job_work_type FROM x
""")(lambda spark, d: landed_postings(spark, d, CFG)
     .withColumn("mapped_work_type", C.work_type_from_location("location"))
     .select("role_id", "seq", "location", "mapped_work_type",
             F.coalesce("mapped_work_type", "work_type").alias("job_work_type")))


# ---- B12: work type and label from card text ----------------------------------------------------------
def _wt_text(spark, d):
    p = postings(spark, d)
    k = F.col("seq") % 6
    text = (F.when(k == 0, F.concat("title", F.lit(" Remote (US)"))).when(k == 1, F.concat("title", F.lit(" Hybrid")))
             .when(k == 2, F.concat("title", F.lit(" In-person SF"))).when(k == 3, F.concat("title", F.lit(" On-site")))
             .when(k == 4, F.col("title")).otherwise(F.concat("title", F.lit(" onsite or remote"))))
    explicit = F.when(F.col("seq") % 4 == 0, F.col("location")).otherwise(F.lit(None).cast("string"))
    df = p.select("seq", text.alias("card_text"), explicit.alias("loc_el"))
    return df.select("seq", C.work_type_from_text("card_text").alias("work_type"),
                     C.location_label_from_text("card_text", "loc_el").alias("location"))


register("work_type_text", f"""
WITH {O.postings_cte()},
x AS (
  SELECT seq,
    lower(CASE seq % 6 WHEN 0 THEN title || ' Remote (US)' WHEN 1 THEN title || ' Hybrid'
      WHEN 2 THEN title || ' In-person SF' WHEN 3 THEN title || ' On-site' WHEN 4 THEN title
      ELSE title || ' onsite or remote' END) AS t,
    CASE WHEN seq % 4 = 0 THEN location END AS loc_el
  FROM p
), y AS (
  SELECT seq, loc_el, CASE WHEN contains(t, 'remote') THEN 'remote' WHEN contains(t, 'hybrid') THEN 'hybrid'
    WHEN contains(t, 'in-person') OR contains(t, 'on-site') OR contains(t, 'onsite') THEN 'onsite' END AS work_type
  FROM x
)
SELECT seq, work_type, COALESCE(NULLIF(loc_el, ''), CASE work_type WHEN 'remote' THEN 'Remote'
  WHEN 'hybrid' THEN 'Hybrid' WHEN 'onsite' THEN 'Onsite' ELSE 'Unknown' END) AS location
FROM y
""")(_wt_text)


# ---- B13: code maps ------------------------------------------------------------------------------------
WORKSITES = ["Remote", "HYBRID", "onsite", "On-site", ""]


def _wt_map(spark, d):
    df = landed_postings(spark, d, CFG)
    raw = F.element_at(F.array(*[F.lit(w) for w in WORKSITES]), (F.col("seq") % 5 + 1).cast("int"))
    flag = (F.col("seq") % 2 == 0)
    return (df.select("role_id", "seq", "work_type", raw.alias("worksite"), flag.alias("remote_flag"))
              .select("role_id", "seq", "worksite",
                      F.coalesce(C.worksite_work_type("worksite"), "work_type").alias("staffing_work_type"),
                      C.remote_flag_work_type("remote_flag").alias("flag_work_type")))


register("work_type_map", f"""
WITH {O.landed_ctes()},
x AS (SELECT role_id, seq, work_type, ({O.lst(WORKSITES)})[seq % 5 + 1] AS worksite, seq % 2 = 0 AS remote_flag
      FROM landed)
SELECT role_id, seq, worksite,
  COALESCE(CASE lower(worksite) WHEN 'remote' THEN 'remote' WHEN 'hybrid' THEN 'hybrid' WHEN 'onsite' THEN 'onsite' END,
           work_type) AS staffing_work_type,
  CASE WHEN remote_flag THEN 'remote' END AS flag_work_type
FROM x
""")(_wt_map)


# ---- B14: employment type ---------------------------------------------------------------------------------
TYPE_LABELS = ["Permanent / Full Time", "Contract to Hire", "Contract", "Temporary to Hire", "Part Time",
               "full-time", "Temporary", "Part-time", "Internship"]


def _emp_map(spark, d):
    raw = F.element_at(F.array(*[F.lit(t) for t in TYPE_LABELS]), (F.col("seq") % len(TYPE_LABELS) + 1).cast("int"))
    df = postings(spark, d).select("seq", F.concat(raw, F.lit(" role")).alias("type_raw"))
    return df.select("seq", "type_raw", C.employment_type_from_text("type_raw").alias("employment_type"))


register("employment_type_map", f"""
WITH {O.postings_cte()},
x AS (SELECT seq, ({O.lst(TYPE_LABELS)})[seq % {len(TYPE_LABELS)} + 1] || ' role' AS type_raw FROM p)
SELECT seq, type_raw, {O.employment_map_sql('type_raw')} AS employment_type FROM x
""")(_emp_map)


# ---- B15: salary text ------------------------------------------------------------------------------------
def _sal_fmt(spark, d):
    docs = table(spark, d, "documents")
    k = F.col("doc_id") % 6
    lo = F.when(k == 5, F.lit("")).when(k == 4, F.lit("n/a")).otherwise((F.col("n_chars") * 10).cast("string"))
    hi = (F.when(k == 0, F.lit("")).when(k == 1, F.lit("0")).when(k == 2, F.concat((F.col("n_chars") * 12).cast("string"),
                                                                                    F.lit(".5")))
           .otherwise((F.col("n_chars") * 13).cast("string")))
    cur = F.when(F.col("doc_id") % 2 == 0, F.lit("")).otherwise(F.lit("EUR"))
    per = F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.lit("year"))
    df = docs.select(F.col("doc_id").alias("seq"), lo.alias("sal_min"), hi.alias("sal_max"),
                     cur.alias("currency"), per.alias("period"))
    return df.select("seq", "sal_min", "sal_max",
                     C.format_salary("sal_min", "sal_max", "currency", "period").alias("salary"))


register("salary_format", """
WITH x AS (
  SELECT doc_id AS seq,
    CASE doc_id % 6 WHEN 5 THEN '' WHEN 4 THEN 'n/a' ELSE CAST(n_chars * 10 AS VARCHAR) END AS sal_min,
    CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN '0' WHEN 2 THEN CAST(n_chars * 12 AS VARCHAR) || '.5'
      ELSE CAST(n_chars * 13 AS VARCHAR) END AS sal_max,
    CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'EUR' END AS currency,
    CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'year' END AS period
  FROM documents
), y AS (
  SELECT *, TRY_CAST(NULLIF(sal_min, '') AS DOUBLE) AS lo, TRY_CAST(NULLIF(sal_max, '') AS DOUBLE) AS hi FROM x
)
SELECT seq, sal_min, sal_max,
  CASE WHEN lo IS NOT NULL AND NOT (NULLIF(sal_max, '') IS NOT NULL AND hi IS NULL) THEN
    trim((CASE WHEN hi IS NOT NULL AND hi <> 0 THEN '$' || format('{:,.2f}', lo) || '–$' || format('{:,.2f}', hi)
               ELSE '$' || format('{:,.2f}', lo) END)
         || ' ' || COALESCE(NULLIF(currency, ''), 'USD') || ' / ' || period) END AS salary
FROM y
""")(_sal_fmt)


# ---- B16: state code -> name ---------------------------------------------------------------------------------
def _state(spark, d):
    p = postings(spark, d).select("seq", "location")
    code = F.regexp_extract("location", r",\s*([A-Za-z]+)$", 1)
    return p.select("seq", "location", code.alias("state"), C.state_name(code).alias("state_name"))


register("state_lookup", f"""
WITH {O.postings_cte()}, {O.state_names_cte()},
x AS (SELECT seq, location, regexp_extract(location, ',\\s*([A-Za-z]+)$', 1) AS state FROM p)
SELECT x.seq, x.location, x.state, COALESCE(s.name, x.state) AS state_name
FROM x LEFT JOIN state_names s ON s.code = upper(x.state)
""")(_state)


# ---- B18 ------------------------------------------------------------------------------------------------------
register("safe_name", f"""
WITH {O.postings_cte()}
SELECT seq, company, regexp_replace(company, '[^\\p{{L}}\\p{{N}}]', '_', 'g') AS safe_company FROM p
""")(lambda spark, d: postings(spark, d).select("seq", "company", X.safe_name("company").alias("safe_company")))
