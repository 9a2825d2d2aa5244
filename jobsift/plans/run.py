"""End-to-end ranking run: landed postings -> gathered -> scored -> selected.

    gather : board rules (window, relevance, location, work type)
             -> per-board dedup + caps -> cross-board URL dedup
    score  : prefilters -> precomputed model answers (probed with bounded
             keys) -> skip tracked URLs -> parse -> seniority / experience
    select : top-k per role -> threshold status -> merge roles by URL

Each stage is a DataFrame -> DataFrame function. Cheap filters sit below the
scoring step by construction; a live scorer (``lexical.score_with``) is
placed after the tracked anti join, so it only sees rows that need a score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classify import location_match_parts, location_match_simple, work_type_from_location
from ..operators import dedup, filters, scoring, select
from ..operators.cells import attach_roles, role_terms_col
from ..operators.joins import bounded_broadcast
from ..session import materialize as materialize_df
from ..params import NO_FALLBACK_WORK_TYPE_BOARDS, SearchConfig
from ..sinks.export import with_letters

# Which board applies which local rule (the others filter server-side or not at all).
RELEVANCE_BOARDS = ["weworkremotely", "arbeitnow", "greenhouse", "builtin"]
RELEVANCE_ENG_BOARDS = ["workatastartup"]
PARTS_LOCATION_BOARDS = ["greenhouse"]
SIMPLE_LOCATION_BOARDS = ["roberthalf"]
MAPPED_WORK_TYPE_BOARDS = ["greenhouse", "roberthalf"]


def board_rules(df: DataFrame, cfg: SearchConfig) -> DataFrame:
    """Apply each board's local filters as one predicate (one pass, no shuffle)."""
    src = F.col("source")
    # Adapters may carry the text a board tests relevance on (the feed board
    # uses its whole entry title); otherwise the title.
    rel_col = "relevance_title" if "relevance_title" in df.columns else "title"
    rel = filters.title_matches(rel_col, role_terms_col(cfg))
    rel_eng = filters.title_matches(rel_col, role_terms_col(cfg, with_eng=True))
    mapped = F.col("mapped_work_type")
    parts_ok = location_match_parts("location", "city", "state", "work_type")
    simple_ok = (F.coalesce(mapped == "remote", F.lit(False))
                 | location_match_simple("location", "city", "state"))
    wt_ok = mapped.isNull() | (mapped == F.col("work_type"))
    keep = ((src == "linkedin") | filters.in_window("posted_at", cfg.run)) \
        & (~src.isin(RELEVANCE_BOARDS) | rel) \
        & (~src.isin(RELEVANCE_ENG_BOARDS) | rel_eng) \
        & (~src.isin(PARTS_LOCATION_BOARDS) | parts_ok) \
        & (~src.isin(SIMPLE_LOCATION_BOARDS) | (wt_ok & simple_ok))
    return df.filter(keep)


def with_mapped_work_type(df: DataFrame) -> DataFrame:
    """The posting's own work type (``mapped_work_type``, as read by the
    adapter; derived from the location text when absent) and the job's work
    type: the posting's, else the requested one of the search cell, except
    for boards that report only what the posting says."""
    if "mapped_work_type" not in df.columns:
        df = df.withColumn("mapped_work_type", F.when(F.col("source").isin(MAPPED_WORK_TYPE_BOARDS),
                                                      work_type_from_location("location")))
    mapped = F.col("mapped_work_type")
    only = F.col("source").isin(NO_FALLBACK_WORK_TYPE_BOARDS)
    if "posting_work_type_only" in df.columns:
        only = only | F.coalesce(F.col("posting_work_type_only"), F.lit(False))
    return df.withColumn("job_work_type", F.when(only, mapped).otherwise(F.coalesce(mapped, F.col("work_type"))))


def gather(landed: DataFrame, cfg: SearchConfig, materialize: bool = True) -> DataFrame:
    """Landed rows -> the per-role job list of the gather stage.

    Caps and the cross-board dedup run on narrow keys; what survives is
    bounded by configuration (roles x boards x cells x cap): the cross-board
    rank runs on those keys in one pass, the full rows are fetched with one
    broadcast semi join, and the result is written once to the shared
    checkpoint folder (cutting the lineage; a lost executor re-reads it).
    """
    ruled = board_rules(with_mapped_work_type(landed), cfg)
    bound = dedup.gather_bound(cfg)
    # The URL and board order ride along with the kept keys, so the rows are
    # read twice in all: once for the keys, once to fetch the survivors.
    capped = dedup.capped_keys(ruled, cfg, carry=("url", "board_ord"))
    survivors = dedup.dedup_cross_board_bounded(capped).select("role_id", "source", "seq")
    # Joining on the board too lets dynamic partition pruning skip board
    # partitions of a source-partitioned landing dataset that keep nothing.
    gathered = ruled.join(bounded_broadcast(survivors, bound), on=["role_id", "source", "seq"], how="left_semi")
    # The gathered rows are bounded too; every later stage probes them more
    # than once, so they are materialised once instead of re-derived.
    return materialize_df(gathered, "gathered") if materialize else gathered


ANSWER_KEY = ["role_id", "source", "url"]


def one_answer(responses: DataFrame) -> DataFrame:
    """One model answer per (role, board, url): the latest if answers carry
    ``scored_at``, else the first in text order."""
    best = F.max_by("raw", "scored_at") if "scored_at" in responses.columns else F.min("raw")
    return responses.groupBy(*ANSWER_KEY).agg(best.alias("raw"))


def attach_responses(df: DataFrame, responses: DataFrame, row_bound: int | None = None) -> DataFrame:
    """Model answers per (role, board, url); a posting without one parses as 0.

    The rows of ``df`` stay as many as they are: answers are reduced to one
    per key first. With a bounded, written left side, the answers table is
    probed with its keys before that. Neither URLs nor answers have a width
    that is known beforehand, so Spark chooses the joins from actual sizes
    (the keys of a written side are small enough to be broadcast).
    """
    answers = responses
    if row_bound is not None:
        answers = answers.join(df.select(*ANSWER_KEY).distinct(), on=ANSWER_KEY, how="left_semi")
    return df.join(one_answer(answers), on=ANSWER_KEY, how="left")


def score(gathered: DataFrame, tracked: DataFrame, responses: DataFrame, cfg: SearchConfig,
          row_bound: int | None = None) -> DataFrame:
    # Precomputed answers are probed with the (materialised) prefiltered keys
    # and tracked URLs removed afterwards: the same rows as the other order,
    # without deriving the tracked probe twice. A live scorer (score_with)
    # runs only after the tracked anti join.
    if "lvl_lo" not in gathered.columns:
        gathered = attach_roles(gathered, cfg)
    pre = attach_responses(filters.prefilter(gathered, cfg.run), responses, row_bound)
    cand = (dedup.anti_tracked_bounded(pre, tracked) if row_bound is not None
            else dedup.anti_tracked(pre, tracked))
    parsed = scoring.parse_response(cand, "raw")
    return scoring.adjust_scores(parsed, base="match_score", out="match_score")


def choose(scored: DataFrame, cfg: SearchConfig) -> DataFrame:
    top = select.topk_per_role(scored, cfg.run.max_jobs)
    return select.status_notes(top, cfg.run.min_match_score)


def role_results(landed: DataFrame, tracked: DataFrame, responses: DataFrame, cfg: SearchConfig) -> DataFrame:
    """Per-role applications before the URL merge."""
    gathered = gather(landed, cfg)
    return choose(score(gathered, tracked, responses, cfg, row_bound=dedup.gather_bound(cfg)), cfg)


def full_run(landed: DataFrame, tracked: DataFrame, responses: DataFrame, cfg: SearchConfig,
             letters: DataFrame | None = None) -> DataFrame:
    """Merged applications, one per URL (highest score wins); these are what
    the tracker takes. With ``letters`` (role_id, source, url, letter), and
    unless ``cover_letter`` is off, pending ones carry their letter's text."""
    merged = select.merge_roles(role_results(landed, tracked, responses, cfg))
    return with_letters(merged, letters) if letters is not None and cfg.run.cover_letter else merged
