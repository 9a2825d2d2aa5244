"""Dedup, caps, merges, upserts, sources and streaming on small inputs."""

import json
import tempfile

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jobsift.operators import dedup, select
from jobsift.params import Board, Location, Role, RunParams, SearchConfig
from jobsift.sinks import tracker
from jobsift.sources import html_cards, json_boards

RUN_TS = "2024-01-31 00:00:00"
LANDED_SCHEMA = ("role_id int, source string, search_cell int, seq long, job_id string, company string, "
                 "title string, url string, board_ord int")


def cfg_with(cap: int, n_loc: int = 2, n_wt: int = 2) -> SearchConfig:
    return SearchConfig(roles=(Role(1, "Engineer"),), boards=(Board("linkedin"),),
                        locations=tuple(Location(f"City{i}", "ST") for i in range(n_loc)),
                        work_types=("hybrid", "remote")[:n_wt], run=RunParams(max_jobs_per_location=cap))


def python_fold(rows, cap):
    """The sequential gather loop: cells in order, rows in arrival order."""
    seen, kept = set(), []
    cells = sorted({r[2] for r in rows})
    for c in cells:
        n = 0
        for r in sorted((r for r in rows if r[2] == c), key=lambda r: r[3]):
            if n >= cap:
                break
            key = r[4] or f"{r[5]}::{r[6]}::{r[7]}"
            if key not in seen:
                seen.add(key)
                kept.append(r[3])
                n += 1
    return sorted(kept)


def test_two_windows_are_not_the_cap():
    # [a, b] then [b, c] with cap 1: the loop keeps a then b (b was not reached in cell 0).
    rows = [(1, "linkedin", 0, 1, "a", "", "", "", 0), (1, "linkedin", 0, 2, "b", "", "", "", 0),
            (1, "linkedin", 1, 3, "b", "", "", "", 0), (1, "linkedin", 1, 4, "c", "", "", "", 0)]
    assert python_fold(rows, 1) == [1, 3]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from(["a", "b", "c", "d", "e", ""])), min_size=1, max_size=40),
       st.integers(1, 3))
def test_cap_per_cell_equals_sequential_fold(spark, cells_keys, cap):
    rows = [(1, "linkedin", c, i, k, "Acme", "Eng", f"u{i % 5}", 0) for i, (c, k) in enumerate(cells_keys)]
    df = spark.createDataFrame(rows, LANDED_SCHEMA)
    got = sorted(r.seq for r in dedup.cap_per_cell(df, cfg_with(cap)).collect())
    assert got == python_fold(rows, cap)


def test_cap_global_and_dedup_board(spark):
    rows = [(1, "workatastartup", 0, 1, "x", "A", "T", "u1", 6), (1, "workatastartup", 1, 2, "x", "A", "T", "u1", 6),
            (1, "workatastartup", 0, 3, "y", "A", "T", "u2", 6), (1, "workatastartup", 1, 4, "z", "A", "T", "u3", 6)]
    df = spark.createDataFrame(rows, LANDED_SCHEMA)
    assert sorted(r.seq for r in dedup.dedup_board(df).collect()) == [1, 3, 4]
    cfg = cfg_with(1, n_loc=2)
    # (cell, seq) order: 1 (x), 3 (y), then 4 (z); cap = 1 x 2 locations.
    assert sorted(r.seq for r in dedup.cap_global(df, cfg).collect()) == [1, 3]


def test_cross_board_rank_keeps_all_rows_of_first_board(spark):
    rows = [(1, "a", 0, 1, "1", "", "", "u", 2), (1, "a", 0, 2, "2", "", "", "u", 2),
            (1, "b", 0, 3, "3", "", "", "u", 1), (1, "b", 0, 4, "4", "", "", "v", 1)]
    df = spark.createDataFrame(rows, LANDED_SCHEMA)
    assert sorted(r.seq for r in dedup.dedup_cross_board(df).collect()) == [3, 4]
    # idempotent
    once = dedup.dedup_cross_board(df)
    assert sorted(r.seq for r in dedup.dedup_cross_board(once).collect()) == [3, 4]


def test_merge_roles_highest_score_then_first_role(spark):
    df = spark.createDataFrame([("u1", 1, 0, 70, 1), ("u1", 2, 1, 90, 1), ("u2", 1, 0, 60, 2), ("u2", 2, 1, 60, 1)],
                               "url string, role_id int, role_ord int, match_score int, rank int")
    got = sorted((r.url, r.role_id) for r in select.merge_roles(df).collect())
    assert got == [("u1", 2), ("u2", 1)]


def test_topk_uses_newest_first_ties(spark):
    df = spark.createDataFrame(
        [(1, 1, 50, "2024-01-02", 0, 0), (1, 2, 50, "2024-01-03", 1, 0), (1, 3, 50, None, 0, 0), (1, 4, 60, None, 0, 0)],
        "role_id int, seq long, match_score int, d string, board_ord int, search_cell int") \
        .withColumn("posted_at", F.to_timestamp("d"))
    got = [r.seq for r in select.topk_per_role(df, 3).orderBy("rank").collect()]
    assert got == [4, 2, 1]


def test_upsert_keeps_identity_columns_and_is_idempotent(spark):
    base = tracker.as_tracked(spark.createDataFrame(
        [("1", "Old title", "Acme", "Chicago, IL", "u1", "linkedin", 40, "skipped", "n")],
        "job_id string, title string, company string, location string, url string, source string, "
        "match_score int, status string, notes string"), "2024-01-01 00:00:00")
    apps = spark.createDataFrame([("New title", "Acme", "u1", "linkedin", 80, "pending", "ready for manual review"),
                                  ("Other", "Beta", "u2", "builtin", 70, "pending", "ready for manual review")],
                                 "title string, company string, url string, source string, match_score int, "
                                 "status string, notes string")
    once = tracker.upsert(base, apps, RUN_TS)
    rows = {r.url: r for r in once.collect()}
    assert rows["u1"].title == "Old title" and rows["u1"].match_score == 80 and rows["u1"].status == "pending"
    assert str(rows["u1"].created_at) == "2024-01-01 00:00:00" and str(rows["u2"].created_at) == "2024-01-31 00:00:00"
    twice = tracker.upsert(once, apps, RUN_TS)
    assert sorted(map(tuple, twice.drop("match_reasons", "gap_reasons").collect()), key=repr) == \
        sorted(map(tuple, once.drop("match_reasons", "gap_reasons").collect()), key=repr)
    stats = {r.status: r.n for r in tracker.status_stats(twice).collect()}
    assert stats == {"pending": 2}


PAGE_LIST = """<ul><li><div><a href="https://www.linkedin.com/jobs/view/123/?trk=x">x</a>
<h3 class="base-search-card__title"> Senior Engineer </h3><h4 class="base-search-card__subtitle">Acme &amp; Co</h4>
<time datetime="2024-01-30">1 day ago</time></div></li><li><p>no link</p></li></ul>"""
PAGE_CITY = """<div><div><a data-id="company-title">Acme</a></div><div><h2><a data-id="job-card-title"
href="/job/engineer/987">Data Engineer</a></h2>
<span class="fs-xs fw-bold bg-gray-01 font-Montserrat text-gray-03 rounded-1 py-xs px-sm">3 Hours Ago</span><div class="summary">Build things</div></div></div>"""
PAGE_STAFF = """<rhcl-job-card job-id="J1"><a slot="headline" href="https://rh/job/1">Analyst</a><ul slot="job-info">
<li data-subslot="location">Chicago, IL</li><li data-subslot="worksite">Remote</li>
<li data-subslot="type">Contract to Hire</li><li data-subslot="copy">&lt;b&gt;Great&lt;/b&gt; role</li>
<li data-subslot="date">2024-01-30T00:00:00Z</li><li data-subslot="salary-min">45</li>
<li data-subslot="salary-max">60</li><li data-subslot="salary-period">hour</li></ul></rhcl-job-card>"""
PAGE_STARTUP = """<div class="row"><a href="/company/acme">Acme Labs</a><a href="/jobs/55">Backend Engineer at Acme</a>
<a href="/jobs/55">dup</a><span class="where">San Francisco</span><span>Hybrid</span>
<span class="posted">2 weeks ago</span><p>We build developer tools for teams of every size and shape.</p></div>"""


def test_card_rules_golden(spark):
    pages = spark.createDataFrame(
        [(1, "linkedin", 1, 0, PAGE_LIST), (2, "builtin", 1, 0, PAGE_CITY), (3, "roberthalf", 1, 0, PAGE_STAFF),
         (4, "workatastartup", 1, 0, PAGE_STARTUP)],
        "page_id long, source string, role_id int, search_cell int, body string")
    got = {r.source: r for r in html_cards.card_postings(pages, RUN_TS).collect()}
    li = got["linkedin"]
    assert (li.title, li.company, li.url, li.job_id, str(li.posted_at)) == \
        ("Senior Engineer", "Acme & Co", "https://www.linkedin.com/jobs/view/123", "123", "2024-01-30 00:00:00")
    bi = got["builtin"]
    assert (bi.title, bi.company, bi.url, bi.job_id, str(bi.posted_at), bi.description) == \
        ("Data Engineer", "Acme", "https://builtin.com/job/engineer/987", None, "2024-01-30 21:00:00", "Build things")
    rh = got["roberthalf"]
    assert (rh.mapped_work_type, rh.employment_type, rh.salary, rh.description, rh.location) == \
        ("remote", "contract", "$45.00–$60.00 USD / hour", "Great role", "Chicago, IL")
    yc = got["workatastartup"]
    assert (yc.title, yc.company, yc.location, yc.mapped_work_type, str(yc.posted_at)) == \
        ("Backend Engineer", "Acme Labs", "San Francisco", "hybrid", "2024-01-17 00:00:00")
    assert len([r for r in html_cards.card_postings(pages, RUN_TS).collect() if r.source == "workatastartup"]) == 1


def test_jsonld_bad_item_ends_its_script(spark):
    good = {"@type": "JobPosting", "title": "A", "hiringOrganization": {"name": "X"}, "url": "u1"}
    later = {"@type": "JobPosting", "title": "B", "url": "u2"}
    other = {"@type": "JobPosting", "title": "C", "url": "u3", "datePosted": "2024-01-30T00:00:00Z"}
    body = ('<script type="application/ld+json">' + json.dumps([good, "bad", later]) + "</script>"
            '<script type="application/ld+json">' + json.dumps({"@type": "ItemList", "itemListElement": [
                {"item": other}, {"@type": "Thing"}]}) + "</script>")
    pages = spark.createDataFrame([(1, "wellfound", 1, 0, body)],
                                  "page_id long, source string, role_id int, search_cell int, body string")
    got = sorted(r.title for r in html_cards.jsonld_postings(pages, RUN_TS, 240.0).collect())
    assert got == ["A", "C"]
    from jobsift.plans.run import with_mapped_work_type
    cfg = SearchConfig(roles=(Role(1, "E"),), boards=(Board("wellfound"),), locations=(Location("Austin", "TX"),),
                       work_types=("hybrid",), run=RunParams(run_ts=RUN_TS, posted_within_hours=240.0))
    landed = with_mapped_work_type(html_cards.landed_from_pages(pages, cfg)).collect()
    assert {(r.title, r.location, r.job_work_type) for r in landed} == {("A", "Austin, TX", None),
                                                                       ("C", "Austin, TX", None)}


PAGE_SCHEMA = "page_id long, source string, role_id int, search_cell int, body string"


def test_structured_data_counts_only_without_a_card_element(spark):
    posting = '<script type="application/ld+json">{"@type": "JobPosting", "title": "A", "url": "u"}</script>'
    pages = spark.createDataFrame(
        [(1, "wellfound", 1, 0, posting), (2, "wellfound", 1, 0, '<div data-test="job-x">unreadable</div>' + posting)],
        PAGE_SCHEMA)
    assert [r.seq.page for r in html_cards.card_or_jsonld(pages, RUN_TS, 240.0).collect()] == [1]


def test_a_page_of_any_depth_and_an_unreadable_card_leave_the_others(spark, monkeypatch):
    deep = "<li>" * 100_000 + PAGE_LIST
    pages = spark.createDataFrame([(1, "linkedin", 1, 0, deep), (2, "linkedin", 1, 0, PAGE_LIST),
                                   (3, "linkedin", 1, 0, None)], PAGE_SCHEMA)
    assert {r.seq.page for r in html_cards.card_postings(pages, RUN_TS).limit(50).collect()} <= {1, 2}
    assert [r.title for r in html_cards.card_postings(pages.filter("page_id = 2"), RUN_TS).collect()] == ["Senior Engineer"]
    from jobsift.functions.html import Page
    read_card, first = html_cards._card, []

    def failing(page, mark, rule):
        if not first:
            first.append(mark)
            raise ValueError("unreadable")
        return read_card(page, mark, rule)
    monkeypatch.setattr(html_cards, "_card", failing)
    page = Page('<li><a href="/jobs/view/1">x</a></li><li><a href="/jobs/view/2">y</a></li>')
    got = list(html_cards.cards_of(page, html_cards.CARDS["linkedin"]))
    assert got[0] == {"error": "ValueError: unreadable"} and got[1]["href"] == "/jobs/view/2"


def test_answers_do_not_multiply_rows(spark):
    from jobsift.plans import run
    jobs = spark.createDataFrame([(1, "linkedin", 7, "u1"), (1, "builtin", 7, "u2"), (2, "linkedin", 7, "u1")],
                                 "role_id int, source string, seq long, url string")
    answers = spark.createDataFrame([(1, "linkedin", "u1", "b", 2), (1, "linkedin", "u1", "a", 1), (1, "builtin", "u2", "c", 1),
                                     (9, "x", "y", "z", 1)],
                                    "role_id int, source string, url string, raw string, scored_at int")
    got = sorted((r.role_id, r.source, r.raw) for r in run.attach_responses(jobs, answers, 10).collect())
    assert got == [(1, "builtin", "c"), (1, "linkedin", "b"), (2, "linkedin", None)]


def test_cap_fold_equals_the_loop(spark):
    import random
    rng = random.Random(5)
    rows = [(1, "linkedin", c, c * 1000 + i, f"k{rng.randrange(40)}") for c in range(12) for i in range(30)]
    df = spark.createDataFrame(rows, "role_id int, source string, search_cell int, seq long, dedup_key string")
    seen, kept = set(), []
    for cell in range(12):
        n = 0
        for _, _, c, seq, key in rows:
            if c == cell and n < 5 and key not in seen:
                seen.add(key)
                kept.append(seq)
                n += 1
    cand = dedup._cap_candidates(df, 5, 12)
    assert sorted(r.seq for r in dedup.fold_cells(cand, 5).collect()) == kept


def test_json_and_rss_adapters(spark):
    body = json.dumps({"jobs": [{"id": 7, "title": "Eng", "company_name": "Co", "url": "u",
                                 "publication_date": "2024-01-30T12:00:00Z"}, {"title": "No id"}]})
    payloads = spark.createDataFrame([(1, "remotive", 0, 0, body)],
                                     "role_id int, source string, search_cell int, payload_id long, body string")
    got = [(r.job_id, r.title, r.location, str(r.posted_at)) for r in
           json_boards.remote_list_postings(payloads).orderBy("item_ord").collect()]
    assert got == [("7", "Eng", "Remote", "2024-01-30 12:00:00"), ("", "No id", "Remote", "None")]
    rss = ("<rss><channel><item><title>Acme: Backend Engineer at Acme</title><link>l1</link><guid>g1</guid>"
           "<description>&lt;p&gt;Hi&lt;/p&gt;</description><pubDate>Tue, 30 Jan 2024 10:00:00 +0000</pubDate>"
           "</item></channel></rss>")
    feeds = spark.createDataFrame([(1, "weworkremotely", 0, 0, rss)],
                                  "role_id int, source string, search_cell int, payload_id long, body string")
    r = json_boards.rss_postings(feeds).collect()[0]
    assert (r.title, r.company, r.location, r.description, str(r.posted_at)) == \
        ("Acme", "Acme", "Remote (Worldwide)", " Hi ", "2024-01-30 10:00:00")


def test_incremental_replay_is_idempotent(spark):
    from jobsift.sources.fixtures import FIXTURE_CONFIG, landed_postings
    from jobsift.sinks import bucketed
    from jobsift.streaming import incremental
    root = tempfile.mkdtemp(prefix="jobsift-inc-")
    landed = landed_postings(spark, "/root/testdata/sf0.001", FIXTURE_CONFIG)
    responses = landed.select("role_id", "source", "url", F.col("llm_raw").alias("raw"))
    batch = landed.filter(F.col("seq") < 120)
    incremental.run_batch(batch, 0, root, responses, FIXTURE_CONFIG, "one")
    first = sorted(map(tuple, bucketed.read(spark, root).select("url", "match_score").collect()))
    assert first
    # a replayed batch has no effect
    incremental.run_batch(batch, 0, root, responses, FIXTURE_CONFIG, "one")
    again = sorted(map(tuple, bucketed.read(spark, root).select("url", "match_score").collect()))
    assert again == first
    # batch 0 of another stream is another batch
    incremental.run_batch(landed.filter(F.col("seq") >= 120), 0, root, responses, FIXTURE_CONFIG, "two")
    after = bucketed.read(spark, root)
    assert after.count() > len(first) and after.select("url").distinct().count() == after.count()


def test_pages_to_landed_shape(spark):
    from jobsift.sources.html_cards import landed_from_pages
    cfg = SearchConfig(roles=(Role(1, "Engineer"),), boards=(Board("linkedin"), Board("roberthalf")),
                       locations=(Location("Chicago", "IL"), Location("Austin", "TX")),
                       work_types=("hybrid", "remote"), run=RunParams(run_ts=RUN_TS, posted_within_hours=48.0))
    pages = spark.createDataFrame([(1, "linkedin", 1, 1, PAGE_LIST), (2, "roberthalf", 1, 2, PAGE_STAFF)],
                                  "page_id long, source string, role_id int, search_cell int, body string")
    from jobsift.plans.run import with_mapped_work_type
    got = {r.source: r for r in with_mapped_work_type(landed_from_pages(pages, cfg)).collect()}
    assert (got["linkedin"].location, got["linkedin"].work_type, got["linkedin"].board_ord) == \
        ("Austin, TX", "hybrid", 0)
    assert (got["roberthalf"].location, got["roberthalf"].job_work_type, got["roberthalf"].board_ord) == \
        ("Chicago, IL", "remote", 1)


def test_board_dedup_and_role_merge_are_idempotent(spark):
    rows = [(1, "linkedin", c, i, k, "Acme", "Eng", f"u{i % 4}", 0)
            for i, (c, k) in enumerate([(0, "a"), (0, "a"), (1, "b"), (1, "a"), (0, ""), (1, "")])]
    df = spark.createDataFrame(rows, LANDED_SCHEMA)
    once = dedup.dedup_board(df)
    twice = dedup.dedup_board(once.drop("dedup_key"))
    assert sorted(r.seq for r in once.collect()) == sorted(r.seq for r in twice.collect())
    apps = spark.createDataFrame([("u1", 1, 0, 70, 1), ("u1", 2, 1, 90, 1), ("u2", 2, 1, 60, 2)],
                                 "url string, role_id int, role_ord int, match_score int, rank int")
    m1 = select.merge_roles(apps)
    m2 = select.merge_roles(m1)
    assert sorted(map(tuple, m1.collect())) == sorted(map(tuple, m2.collect()))


def test_feed_relevance_uses_whole_entry_title(spark):
    from jobsift.plans.run import board_rules, with_mapped_work_type
    cfg = SearchConfig(roles=(Role(1, "Backend Engineer"),), boards=(Board("weworkremotely"),),
                       locations=(Location("Chicago", "IL"),), work_types=("remote",),
                       run=RunParams(run_ts=RUN_TS, posted_within_hours=48.0))
    rss = ("<rss><channel><item><title>Acme: Backend Engineer</title><link>l1</link><guid>g1</guid>"
           "<pubDate>Tue, 30 Jan 2024 10:00:00 +0000</pubDate></item></channel></rss>")
    feeds = spark.createDataFrame([(1, "weworkremotely", 0, 0, rss)],
                                  "role_id int, source string, search_cell int, payload_id long, body string")
    payloads = spark.createDataFrame([], "role_id int, source string, search_cell int, payload_id long, "
                                         "token string, body string")
    landed = json_boards.landed_from_payloads(payloads, feeds, cfg)
    from jobsift.operators.cells import attach_roles
    kept = board_rules(with_mapped_work_type(attach_roles(landed, cfg)), cfg).collect()
    # kept: "backend engineer" is in the whole entry title; no author and no " at " leaves company empty
    assert [(r.title, r.company) for r in kept] == [("Acme", "")]
