"""Queries for scoring inputs (E1, E3, E4) and the incremental forms (H2, H3)."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from ..functions.timestamps import format_ts
from ..operators import dedup, filters, lexical, scoring
from ..params import DESCRIPTION_ANALYSIS_CHARS, DESCRIPTION_LETTER_CHARS
from ..session import checkpoint_dir, materialize
from ..sources import resumes
from ..sources.fixtures import FIXTURE_CONFIG as CFG
from ..sources.fixtures import landed_postings, postings, table, tracked_seed
from ..streaming import incremental, lifespans
from . import oracle_sql as O
from . import run as R
from .catalog import register
from .q_runs import merged_sql, responses

RUN = CFG.run


def _resumes(spark, d):
    return resumes.resumes_from_table(table(spark, d, "benchmark"), CFG)


# ---- E1: prompts ------------------------------------------------------------------------
def _prompts(spark, d):
    """Prompts of the rows that need a score: after the cheap filters, and
    without those whose URL is tracked. Resumes (one per role, of any length)
    join as Spark sees fit."""
    cand = dedup.anti_tracked(filters.prefilter(landed_postings(spark, d, CFG), RUN), tracked_seed(spark, d))
    df = cand.select("role_id", "seq", "title", "company", "description").join(
        scoring.with_summary_prompt(_resumes(spark, d)), on="role_id", how="left")
    out = scoring.render_prompts(df, CFG.contact_name, CFG.contact_email)
    return out.select("role_id", "seq", F.length("analysis_prompt").cast("bigint").alias("analysis_chars"),
                      F.md5("analysis_prompt").alias("analysis_md5"), F.md5("letter_prompt").alias("letter_md5"),
                      F.md5("summary_prompt").alias("summary_md5"))


def _render_sql(template: str, **cols: str) -> str:
    import re
    pieces = []
    for p in re.split(r"(\{[a-z_]+\})", template):
        if p.startswith("{") and p.endswith("}") and p[1:-1] in cols:
            pieces.append(f"COALESCE({cols[p[1:-1]]}, '')")
        elif p:
            pieces.append(O.q(p))
    return "(" + " || ".join(pieces) + ")"


_A = _render_sql(scoring.ANALYSIS_TEMPLATE, resume="b.text", title="l.title", company="l.company",
                 description=f"substr(l.description, 1, {DESCRIPTION_ANALYSIS_CHARS})")
_L = _render_sql(scoring.LETTER_TEMPLATE, resume="b.text", title="l.title", company="l.company",
                 description=f"substr(l.description, 1, {DESCRIPTION_LETTER_CHARS})",
                 name=O.q(CFG.contact_name), email=O.q(CFG.contact_email))
_S = _render_sql(scoring.SUMMARY_TEMPLATE, resume="b.text")

register("render_prompts", f"""
WITH {O.landed_ctes()}, {O.tracked_cte()}
SELECT l.role_id, l.seq, length({_A}) AS analysis_chars, md5({_A}) AS analysis_md5, md5({_L}) AS letter_md5,
       md5({_S}) AS summary_md5
FROM landed l LEFT JOIN benchmark b ON b.item_id = l.role_id
WHERE {O.salary_ok_sql(RUN)} AND {O.company_ok_sql(RUN)} AND {O.employment_ok_sql(RUN)}
  AND NOT EXISTS (SELECT 1 FROM tracked t WHERE t.url = l.url)
""")(_prompts)


# ---- E3: batch scorer hook, placed after every cheap filter -------------------------------
def score_hook_plan(spark, d):
    gathered = R.gather(landed_postings(spark, d, CFG), CFG)
    bound = dedup.gather_bound(CFG)
    cand = dedup.anti_tracked_bounded(filters.prefilter(gathered, RUN), tracked_seed(spark, d))
    answered = lexical.score_with(cand, lexical.keyword_scorer,
                                  ["role_id", "seq", "url", "title", "description", "role_terms"])
    return scoring.parse_response(answered, "raw")


def _score_hook_sql() -> str:
    from .q_runs import gathered_sql
    hits = "list_filter(role_terms, lambda t: t <> '' AND contains(lower(COALESCE(description, '')), t))"
    return f"""
WITH {gathered_sql()},
{O.tracked_cte()},
cand AS (
  SELECT * FROM gathered g
  WHERE {O.salary_ok_sql(RUN)} AND {O.company_ok_sql(RUN)} AND {O.employment_ok_sql(RUN)}
    AND NOT EXISTS (SELECT 1 FROM tracked t WHERE t.url = g.url)
)
SELECT role_id, seq, url,
  CAST(round_even(100.0 * len({hits}) / greatest(len(role_terms), 1), 0) AS INTEGER) AS match_score,
  array_to_string({hits}, '|') AS match_reasons
FROM cand
"""


register("score_hook", _score_hook_sql())(lambda spark, d: score_hook_plan(spark, d).select(
    "role_id", "seq", "url", "match_score", F.array_join("match_reasons", "|").alias("match_reasons")))


# ---- E4: lexical resume match ------------------------------------------------------------------
def _lexical_sql() -> str:
    tok = O.q(lexical.TOKEN)
    return f"""
WITH {O.landed_ctes()},
docs AS (SELECT seq, lower(description) AS d FROM p),
n AS (SELECT count(*) AS n FROM docs),
ptok AS (SELECT seq, unnest(regexp_extract_all(d, {tok})) AS term FROM docs),
dfreq AS (SELECT term, count(DISTINCT seq) AS df FROM ptok GROUP BY term),
res AS (SELECT r.role_id, lower(b.text) AS d FROM roles r JOIN benchmark b ON b.item_id = r.role_id),
rtok AS (SELECT role_id, unnest(regexp_extract_all(d, {tok})) AS term FROM res),
terms AS (SELECT term FROM ptok UNION SELECT term FROM rtok),
idf AS (SELECT term, ln((n.n + 1.0) / (COALESCE(df, 0) + 1)) AS idf
        FROM terms LEFT JOIN dfreq USING (term) CROSS JOIN n),
ptf AS (SELECT seq, term, count(*) AS tf FROM ptok GROUP BY seq, term),
pw AS (SELECT seq, term, tf * idf AS w FROM ptf JOIN idf USING (term)),
rtf AS (SELECT role_id, term, count(*) AS tf FROM rtok GROUP BY role_id, term),
rw AS (SELECT role_id, term, tf * idf AS w FROM rtf JOIN idf USING (term)),
pn AS (SELECT seq, sqrt(sum(w * w)) AS pn FROM pw GROUP BY seq),
rn AS (SELECT role_id, sqrt(sum(w * w)) AS rn FROM rw GROUP BY role_id),
dots AS (SELECT rw.role_id, pw.seq, sum(pw.w * rw.w) AS dot FROM pw JOIN rw USING (term) GROUP BY rw.role_id, pw.seq),
cosines AS (SELECT dots.role_id, dots.seq, dots.dot / NULLIF(pn.pn * rn.rn, 0) AS c
            FROM dots JOIN pn USING (seq) JOIN rn USING (role_id))
SELECT l.role_id, l.seq, CAST(round_even(COALESCE(cosines.c, 0.0) * 100, 0) AS INTEGER) AS lexical_score
FROM landed l LEFT JOIN cosines USING (role_id, seq)
"""


register("lexical_match", _lexical_sql())(lambda spark, d: lexical.lexical_match(
    landed_postings(spark, d, CFG), postings(spark, d).select("seq", "description"), _resumes(spark, d)))


# ---- H2: incremental run over landed batches ------------------------------------------------------
N_ARRIVALS = 4


def _incremental(spark, d):
    """Landed rows arrive in four lots, in seq order; each lot is one batch,
    whose run skips the URLs that earlier batches tracked."""
    root = f"{checkpoint_dir(spark)}/incremental-{uuid.uuid4().hex}"
    landed = landed_postings(spark, d, CFG)
    answers = materialize(R.one_answer(responses(spark, d)), "answers")
    width = (landed.agg(F.max("seq")).first()[0] or 0) // N_ARRIVALS + 1
    for lot in range(N_ARRIVALS):
        landed.filter(F.expr(f"seq div {width}") == lot).write.mode("append").parquet(f"{root}/landing")
        snap = incremental.incremental_run(spark, f"{root}/landing", landed.schema, f"{root}/tracker",
                                           f"{root}/stream", answers, CFG)
    return snap.select("url", "title", "match_score", "status", "notes", format_ts("created_at").alias("created_at"))


def _incremental_sql() -> str:
    parts, names = [], []
    for lot in range(N_ARRIVALS):
        seen = " UNION ALL ".join(f"SELECT url FROM {n}" for n in names) or "SELECT NULL::VARCHAR AS url WHERE false"
        run = merged_sql(tracked=f"tracked AS ({seen})", answers=f"answers AS (SELECT * FROM all_answers)",
                         landed=f"seq // (SELECT max(seq) // {N_ARRIVALS} + 1 FROM all_landed) = {lot}")
        names.append(f"lot{lot}")
        parts.append(f"lot{lot} AS MATERIALIZED (WITH {run} SELECT url, title, match_score, status, notes FROM merged)")
    return f"""
WITH all_landed AS MATERIALIZED (WITH {O.landed_ctes()} SELECT * FROM landed),
all_answers AS MATERIALIZED (
  SELECT role_id, source, url, min(llm_raw) AS llm_raw FROM all_landed GROUP BY role_id, source, url),
{", ".join(parts)}
SELECT url, title, match_score, status, notes, strftime(TIMESTAMP '{RUN.run_ts}', '%Y-%m-%d %H:%M:%S.%f') AS created_at
FROM ({" UNION ALL ".join(f"SELECT * FROM {n}" for n in names)})
"""


register("incremental_run", _incremental_sql())(_incremental)


# ---- H3: watermark de-duplication of a sighting feed --------------------------------------------------
FEED_LOTS = 3


def _stream_dedup(spark, d):
    """Events arrive in three lots, in time order; each lot is one trigger of
    one stream. Within the delay (longer than this feed) a key is reported
    once, with the lot that first had it; expiry and lateness have a pytest."""
    root = f"{checkpoint_dir(spark)}/sightings-{uuid.uuid4().hex}"
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    width = (events.agg(F.max("event_id")).first()[0] or 0) // FEED_LOTS + 1
    feed = events.withColumn("lot", F.expr(f"event_id div {width}"))
    for lot in range(FEED_LOTS):
        feed.filter(F.col("lot") == lot).write.mode("append").parquet(f"{root}/feed")
        out = incremental.first_sightings(spark, f"{root}/feed", "*.parquet", feed.schema, ["user_id", "event_type"],
                                          "ts", "400 days", f"{root}/out", f"{root}/stream")
    return out.select("user_id", "event_type", "lot")


register("stream_dedup", f"""
SELECT user_id, event_type, min(event_id // (SELECT max(event_id) // {FEED_LOTS} + 1 FROM events)) AS lot
FROM events GROUP BY user_id, event_type
""")(_stream_dedup)


# ---- H3: lives of postings, with state that expires ------------------------------------------------------
GAP, DELAY = dt.timedelta(days=2), dt.timedelta(days=1)
LIVES_PARTITIONS = 8  # of the state: open keys are few


def _lives(spark, d):
    """Events arrive in three lots, one trigger each; every 50th comes a lot
    late, most of those behind the watermark. Gap and delay are shorter than a
    lot, so keys expire and open again within the feed."""
    root = f"{checkpoint_dir(spark)}/lives-{uuid.uuid4().hex}"
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    width = (events.agg(F.max("event_id")).first()[0] or 0) // FEED_LOTS + 1
    feed = events.withColumn("lot", F.expr(f"event_id div {width} + CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END")).drop("event_id")
    for lot in range(FEED_LOTS + 1):
        feed.filter(F.col("lot") == lot).drop("lot").write.mode("append").parquet(f"{root}/feed")
        out = lifespans.record(spark, f"{root}/feed", feed.drop("lot").schema, ["user_id", "event_type"], "ts", GAP, DELAY,
                               f"{root}/out", f"{root}/stream", partitions=LIVES_PARTITIONS)
    return out.select("user_id", "event_type", "event", format_ts("first_ts").alias("first_ts"),
                      format_ts("last_ts").alias("last_ts"), "sightings")


_GAP, _DELAY = (int(x.total_seconds() * 1_000_000) for x in (GAP, DELAY))
_FMT = "'%Y-%m-%d %H:%M:%S.%f'"

register("posting_lives", f"""
WITH feed AS (
  SELECT user_id, event_type, epoch_us(ts) AS us, (epoch_us(ts) // {_GAP} + 1) * {_GAP} AS slot_end,
         event_id // (SELECT max(event_id) // {FEED_LOTS} + 1 FROM events) + CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END AS lot
  FROM events),
ends AS (SELECT lot, max(slot_end) AS e FROM feed GROUP BY lot),
marks AS (SELECT lot, max(e) OVER (ORDER BY lot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {_DELAY} AS wm FROM ends),
kept AS (SELECT feed.* FROM feed JOIN marks USING (lot) WHERE wm IS NULL OR slot_end > wm),
gaps AS (
  SELECT *, max(us) OVER (PARTITION BY user_id, event_type ORDER BY lot, us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
  FROM kept),
numbered AS (
  SELECT *, sum(CASE WHEN prev IS NULL OR us > prev + {_GAP} THEN 1 ELSE 0 END) OVER (
    PARTITION BY user_id, event_type ORDER BY lot, us ROWS UNBOUNDED PRECEDING) AS life FROM gaps),
lives AS (
  SELECT user_id, event_type, life, arg_min(us, (lot, us)) AS first_us, max(us) AS last_us, count(*) AS n,
         life < max(life) OVER (PARTITION BY user_id, event_type) AS followed
  FROM numbered GROUP BY user_id, event_type, life)
SELECT user_id, event_type, 'opened' AS event, strftime(make_timestamp(first_us), {_FMT}) AS first_ts,
       strftime(make_timestamp(first_us), {_FMT}) AS last_ts, 0 AS sightings FROM lives
UNION ALL
SELECT user_id, event_type, 'closed', strftime(make_timestamp(first_us), {_FMT}), strftime(make_timestamp(last_us), {_FMT}), n
FROM lives WHERE followed OR last_us + 2 * {_GAP} < (SELECT max(e) - {_DELAY} FROM ends)
""")(_lives)
