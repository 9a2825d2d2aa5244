"""Raw payloads -> landed rows -> full run -> tracker upsert -> CSV rows."""

import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from jobsift.params import Board, Location, Role, RunParams, SalaryParams, SearchConfig
from jobsift.plans import run
from jobsift.session import materialize
from jobsift.sinks import bucketed, export
from jobsift.sources import fixture_pages as FP
from jobsift.sources import html_cards, json_boards
from jobsift.sources.fixtures import postings

CFG = SearchConfig(
    roles=(Role(1, "Software Engineer", ("mid", "senior"), ("python", "backend")),),
    boards=tuple(Board(b) for b in ["linkedin", "wellfound", "builtin", "remotive", "weworkremotely",
                                    "arbeitnow", "workatastartup", "roberthalf", "greenhouse"]),
    locations=(Location("Chicago", "IL"),), work_types=("hybrid",),
    run=RunParams(max_jobs=5, posted_within_hours=24 * 30, min_match_score=60,
                  employment_types=("full-time", "contract"), salary=SalaryParams(min=50000),
                  run_ts="2024-01-31 00:00:00"))


def test_payloads_to_tracker(spark):
    p = postings(spark, SF_SMALL)
    card_landed = html_cards.landed_from_pages(FP.card_pages(p), CFG)
    json_landed = json_boards.landed_from_payloads(FP.json_payloads(p), FP.rss_feeds(p), CFG)
    cols = sorted(set(card_landed.columns) & set(json_landed.columns))
    # Parse once and land the typed rows (as a landing job would); the run reads them.
    landed = materialize(card_landed.select(*cols).unionByName(json_landed.select(*cols)), "e2e-landed")
    assert landed.select("role_id", "source", "seq").distinct().count() == landed.count()
    answers = landed.select("role_id", "source", "url", F.format_string(
        '{"match_score": %d}', F.pmod(F.xxhash64("url"), F.lit(97)).cast("int")).alias("raw"))
    gathered = run.gather(landed, CFG)
    assert run.attach_responses(gathered, answers, 1000).count() == gathered.count()
    root = tempfile.mkdtemp(prefix="jobsift-e2e-")
    current = bucketed.read(spark, root)
    results = run.full_run(landed, current, answers, CFG)
    rows = results.collect()
    assert 0 < len(rows) <= CFG.run.max_jobs
    assert len({r.url for r in rows}) == len(rows)
    assert all(r.status in ("pending", "skipped") for r in rows)
    assert {r.source for r in rows} <= {b.name for b in CFG.boards}
    bucketed.apply(spark, root, "runs", 0, lambda: results, CFG.run.run_ts)
    snap = bucketed.read(spark, root)
    assert snap.count() == len(rows)
    # a second run skips every tracked URL
    again = run.full_run(landed, snap, answers, CFG)
    assert not ({r.url for r in again.collect()} & {r.url for r in rows})
    csv_rows = export.csv_rows(results).collect()
    assert len(csv_rows) == len(rows) and all(r.posted_at == "" or r.posted_at.endswith("+00:00") for r in csv_rows)
