"""Posting-shaped views derived from the driver tables, and the test configuration.

The ``postings`` view is the same text in Spark SQL and DuckDB; Spark builds
it with ``selectExpr`` over the ``documents`` scan, so column pruning and
filters still reach Parquet (a query that never reads ``description`` never
reads ``documents.text``).
"""

from __future__ import annotations

import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import BOARD_NAMES, Board, Location, Role, RunParams, SalaryParams, SearchConfig

# Column expressions of the derived postings view (valid in Spark and DuckDB).
POSTINGS_COLUMNS = [
    "doc_id AS seq",
    "CASE doc_id % 9 WHEN 0 THEN 'linkedin' WHEN 1 THEN 'wellfound' WHEN 2 THEN 'builtin' "
    "WHEN 3 THEN 'remotive' WHEN 4 THEN 'weworkremotely' WHEN 5 THEN 'arbeitnow' "
    "WHEN 6 THEN 'workatastartup' WHEN 7 THEN 'roberthalf' ELSE 'greenhouse' END AS source",
    "CASE WHEN doc_id % 11 = 0 THEN '' ELSE CAST(doc_id - (CASE WHEN doc_id % 40 = 19 THEN 9 ELSE 0 END) "
    "AS VARCHAR(20)) END AS job_id",
    "concat('https://jobs.example/', CAST(doc_id - (CASE WHEN doc_id % 20 = 19 THEN 9 "
    "WHEN doc_id % 20 = 9 THEN 4 ELSE 0 END) AS VARCHAR(20))) AS url",
    "concat(CASE doc_id % 3 WHEN 0 THEN 'Acme ' WHEN 1 THEN 'Globex & Sons ' ELSE 'Staffing Co ' END, "
    "source) AS company",
    "concat(CASE doc_id % 7 WHEN 0 THEN 'Junior ' WHEN 1 THEN 'Mid-level ' WHEN 2 THEN 'Sr. ' "
    "WHEN 3 THEN 'Staff ' WHEN 4 THEN 'Principal ' WHEN 5 THEN 'Senior Staff ' ELSE '' END, "
    "CASE doc_id % 4 WHEN 0 THEN 'Software Engineer' WHEN 1 THEN 'Data Engineer' "
    "WHEN 2 THEN 'Backend Developer' ELSE 'Account Manager' END) AS title",
    "concat(text, CASE doc_id % 5 WHEN 0 THEN ' 3-5 years of experience.' WHEN 1 THEN ' 7+ years overall.' "
    "WHEN 2 THEN ' 2 years of hands-on Python experience.' WHEN 3 THEN ' 4 to 10 years; 1 year exp.' "
    "ELSE '' END) AS description",
    "CASE WHEN doc_id % 13 = 0 THEN NULL ELSE TIMESTAMP '2024-01-31 00:00:00' - "
    "((doc_id * 37) % 720) * INTERVAL '1' HOUR END AS posted_at",
    "CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '$45.50–$60.00 USD / Hour' WHEN 2 THEN '$120,000 - $150,000' "
    "WHEN 3 THEN 'competitive' WHEN 4 THEN '$95,000.00 USD / year' ELSE '$18 per hour' END AS salary",
    "CASE doc_id % 4 WHEN 0 THEN 'full-time' WHEN 1 THEN 'contract' WHEN 2 THEN NULL ELSE 'part-time' END "
    "AS employment_type",
    "CASE doc_id % 8 WHEN 0 THEN 'US-Remote, US-Chicago' WHEN 1 THEN 'Chicago, IL' WHEN 2 THEN "
    "'Hybrid - New York, NY' WHEN 3 THEN 'Sao Paulo, Brazil' WHEN 4 THEN 'Remote' WHEN 5 THEN "
    "'Springfield, IL' WHEN 6 THEN 'Philadelphia, PA' ELSE '' END AS location",
    "CASE doc_id % 10 WHEN 8 THEN 'not json' WHEN 7 THEN '{\"match_score\": null}' WHEN 6 THEN "
    "concat('{\"match_score\": \"', CAST(n_chars % 101 AS VARCHAR(20)), '\"}') ELSE "
    "concat('{\"match_score\": ', CAST(n_chars % 101 AS VARCHAR(20)), ', \"match_reasons\": [\"a\"]}') END "
    "AS llm_raw",
    "n_chars % 101 AS base_score",
]

POSTINGS_SQL = "SELECT " + ",\n ".join(POSTINGS_COLUMNS) + "\nFROM documents"


# Plans by session; a session's plans go with it.
_VIEWS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def _memo(spark: SparkSession, *key):
    """Lazy views are plans: build (and analyse) each once per session."""
    def deco(build):
        plans = _VIEWS.setdefault(spark, {})
        if key not in plans:
            plans[key] = build()
        return plans[key]
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _memo(spark, "table", sf_dir, name)(lambda: spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived ``postings`` view (one row per document)."""
    return _memo(spark, "postings", sf_dir)(
        lambda: table(spark, sf_dir, "documents").selectExpr(*POSTINGS_COLUMNS))


# ---------------------------------------------------------------------------
# Test configuration (the same values appear as inline VALUES in the oracles).
# ---------------------------------------------------------------------------

FIXTURE_CONFIG = SearchConfig(
    roles=(
        Role(1, "Software Engineer", ("mid", "senior"), ("Python", "backend"), 3.0, 2.0),
        Role(2, "Data Engineer", ("mid",), ("Python", "Spark"), 2.0, 2.0),
    ),
    boards=tuple(Board(n, True, ("stripe", "airbnb") if n == "greenhouse" else ()) for n in BOARD_NAMES)
    + (Board("monster", True), Board("dice", False)),
    locations=(Location("Chicago", "IL"), Location("New York", "NY")),
    work_types=("hybrid", "remote"),
    run=RunParams(
        max_jobs=10,
        max_jobs_per_location=25,
        posted_within_hours=240.0,
        min_match_score=65,
        employment_types=("full-time", "contract"),
        salary=SalaryParams(min=90000, max=None, skip_if_below_min=True, include_unlisted=True),
        company_blacklist=("Staffing Co src1", ""),
        run_ts="2024-01-31 00:00:00",
    ),
    contact_name="Ada Lovelace",
    contact_email="ada@example.com",
)


def landed_postings(spark: SparkSession, sf_dir: str, cfg: SearchConfig = FIXTURE_CONFIG,
                    features: bool = False) -> DataFrame:
    """Postings in the landed shape: every role's search returned the pool,
    spread over that board's search cells by arrival order.

    Adds role_id, board_ord, search_cell and the requested work type of the
    cell; rows of boards that are not enabled drop out. ``features`` adds the
    posting-level scoring features once per posting.
    """
    from ..operators.cells import assign_cells, attach_cells
    from ..operators.scoring import posting_features

    def build():
        p = postings(spark, sf_dir)
        if features:
            # Role-independent scoring features before the role fan-out.
            p = posting_features(p)
        return attach_cells(assign_cells(p, cfg), cfg)
    return _memo(spark, "landed", sf_dir, features, cfg)(build)


TRACKED_CREATED_AT = "2024-01-01 00:00:00"


def tracked_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracker snapshot seeded from ``labels`` joined to the postings view.

    One row per URL (the label of the latest document wins), with the tracker
    columns: reasons as arrays, status from the toxicity label.
    """
    return _memo(spark, "tracked", sf_dir)(lambda: _tracked_seed(spark, sf_dir))


def _tracked_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    p = postings(spark, sf_dir).select("seq", "job_id", "title", "company", "location", "url", "source",
                                       "posted_at", "base_score")
    j = p.join(labels, p.seq == labels.doc_id, "inner")
    latest = j.groupBy("url").agg(F.max("seq").alias("seq"))
    return (j.join(latest, on=["url", "seq"], how="left_semi")
             .select("job_id", "title", "company", "location", "url", "source", "posted_at",
                     F.col("base_score").cast("int").alias("match_score"),
                     F.array(F.lit("seed")).alias("match_reasons"),
                     F.array().cast("array<string>").alias("gap_reasons"),
                     F.lit("").alias("cover_letter"),
                     F.when(F.col("toxic") == 1, F.lit("skipped")).otherwise(F.lit("pending")).alias("status"),
                     F.lit("seeded").alias("notes"),
                     F.to_timestamp(F.lit(TRACKED_CREATED_AT)).alias("created_at")))
