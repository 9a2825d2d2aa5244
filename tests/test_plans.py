"""Plan shape: pruning, pushdown, partial top-k, no cartesian products, and
the scoring hook placed above every filter and the tracked anti-join."""

from conftest import SF_SMALL

import __spark_entry__ as E
from jobsift.operators import dedup
from jobsift.plans import run as R
from jobsift.sources.fixtures import FIXTURE_CONFIG, landed_postings


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pruning_reaches_through_the_run(spark):
    """Landed once by board and day; the run's keys read only its boards and days."""
    from jobsift.plans.q_runs import payload_landed
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    p = plan(dedup.capped_keys(R.board_rules(R.with_mapped_work_type(payload_landed(spark, SF_SMALL)), FIXTURE_CONFIG),
                               FIXTURE_CONFIG, carry=("url", "board_ord")))
    assert p.count("PartitionFilters: []") == 0 and "posted_date" in p.split("PartitionFilters: [")[1].split("]")[0]
    assert "description" not in p


def test_upsert_reads_tracker_twice_and_scores_once(spark):
    p = plan(E.queries()["upsert_tracked"](spark, SF_SMALL))
    # tracker rows and tracker URLs, and the written applications; no document is read again
    assert "documents.parquet" not in p and p.count("regexp_extract_all") == 0


def test_landed_scan_prunes_partitions_and_pushes_the_window(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    p = plan(E.queries()["pruned_scan"](spark, SF_SMALL))
    part = p.split("PartitionFilters: [")[1].split("]")[0]
    assert "source" in part and "posted_date" in part
    pushed = p.split("PushedFilters: [")[1].split("]")[0]
    assert "posted_at" in pushed


def test_topk_is_a_partial_window_group_limit(spark):
    p = plan(E.queries()["topk_per_role"](spark, SF_SMALL))
    assert "WindowGroupLimit" in p


def test_cap_candidates_are_partial_limited(spark):
    landed = landed_postings(spark, SF_SMALL, FIXTURE_CONFIG)
    p = plan(dedup.capped_keys(landed, FIXTURE_CONFIG))
    assert p.count("WindowGroupLimit") >= 2
    # the key computation never reads the document text
    assert "text:string" not in p


def test_no_cartesian_products_in_the_run(spark):
    for key in ["full_run", "gathered_jobs", "final_score", "upsert_tracked", "render_prompts"]:
        p = plan(E.queries()[key](spark, SF_SMALL))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, key


def test_scoring_hook_sits_above_filters_and_tracked_join(spark):
    from jobsift.plans.q_models import score_hook_plan
    p = plan(score_hook_plan(spark, SF_SMALL))
    hook = p.index("MapInPandas")
    below = p[hook:]
    assert "LeftAnti" in below and "Filter" in below


def test_tracked_probe_does_not_shuffle_tracked(spark):
    gathered = R.gather(landed_postings(spark, SF_SMALL, FIXTURE_CONFIG), FIXTURE_CONFIG)
    from jobsift.sources.fixtures import tracked_seed
    p = plan(dedup.anti_tracked_bounded(gathered, tracked_seed(spark, SF_SMALL)))
    assert "BroadcastHashJoin" in p and "LeftSemi" in p and "LeftAnti" in p


def test_a_local_folder_is_shared_on_one_machine_only():
    from jobsift.session import shared_by_all
    assert shared_by_all("/warehouse", "local") and shared_by_all("file:/warehouse", "local[4]")
    assert shared_by_all("s3a://bucket/warehouse", "yarn") and not shared_by_all("file:/warehouse", "yarn")
    assert not shared_by_all("/warehouse", "spark://host:7077") and not shared_by_all("file:///w", "local-cluster[2,1,1024]")
