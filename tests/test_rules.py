"""Edge cases of the scalar, filter and scoring rules on small literal rows."""

from pyspark.sql import functions as F

from jobsift.functions import classify as C
from jobsift.functions import text as X
from jobsift.functions import timestamps as TS
from jobsift.operators import filters, scoring
from jobsift.params import RunParams, SalaryParams

RUN_TS = "2024-01-31 00:00:00"


def one_col(spark, values, name="v", dtype="string"):
    return spark.createDataFrame([(v,) for v in values], f"{name} {dtype}")


def test_parse_response_edges(spark):
    raws = ['{"match_score": 85.7}', '{"match_score": "85.7"}', '{"match_score": "42"}', '{"match_score": null}',
            '{"match_score": true}', '{"match_score": [1]}', '[1, 2]', 'not json', '```json\n{"match_score": 70,'
            ' "match_reasons": ["x", "y"]}\n```', '  \n{"other": 1}\n', '{"match_score": "x", "match_reasons": ["a"]}',
            None]
    df = scoring.parse_response(one_col(spark, raws, "raw"), "raw").collect()
    got = [(r.match_score, list(r.match_reasons)) for r in df]
    assert got == [(85, []), (0, []), (42, []), (0, []), (1, []), (0, []), (0, []), (0, []),
                   (70, ["x", "y"]), (0, []), (0, []), (0, [])]


def test_seniority_level_first_pattern_wins(spark):
    titles = ["Senior Staff Engineer", "Jr. Developer", "Entry-level Analyst", "Mid-Level Engineer",
              "Staff Engineer", "VP Engineering", "Engineer", "Sr Data Engineer", "Associate PM"]
    got = [r.l for r in one_col(spark, titles).select(scoring.seniority_level("v").alias("l")).collect()]
    assert got == ["senior", "junior", "junior", "mid", "staff", "principal", None, "senior", "junior"]


def test_seniority_adjust(spark):
    df = spark.createDataFrame([(0, 1, 2), (1, 1, 2), (3, 1, 2), (4, 1, 1), (None, 1, 2), (2, None, None)],
                               "i int, lo int, hi int")
    got = [r.a for r in df.select(scoring.seniority_adjust("i", "lo", "hi").alias("a")).collect()]
    assert got == [-10, 8, -10, -20, 0, 0]


def test_required_years_max_of_all_phrasings(spark):
    texts = ["3-5 years of experience", "7+ years overall; 2 years python experience", "4 to 10 years",
             "1 year exp.", "no requirement", "3 years café experience", "10 years of hands-on python exp"]
    got = [r.y for r in one_col(spark, texts).select(scoring.required_years("v").alias("y")).collect()]
    assert got == [5.0, 7.0, 10.0, 1.0, None, 3.0, 10.0]


def test_experience_adjust_rounds_half_to_even_and_guards_sigma(spark):
    df = spark.createDataFrame([(5.0, 3.0, 2.0), (3.0, 3.0, 2.0), (None, 3.0, 2.0), (9.0, 3.0, 0.0),
                                (30.0, 3.0, 2.0)], "r double, t double, s double")
    got = [r.a for r in df.select(scoring.experience_adjust("r", "t", "s").alias("a")).collect()]
    assert got == [-8, 0, 0, 0, -20]


def test_final_score_clamps(spark):
    df = spark.createDataFrame([(95, 8), (3, -20), (50, 0)], "b int, a int")
    assert [r.s for r in df.select(scoring.final_score("b", "a").alias("s")).collect()] == [100, 0, 50]


def test_salary_rules(spark):
    run = RunParams(salary=SalaryParams(min=90000, max=150000, include_unlisted=False))
    sal = ["$45.50–$60.00 USD / Hour", "$120,000 - $150,000", "competitive", "$95,000.00 USD / year",
           "$18 per hour", None, "", ", and more", "$200k"]
    df = one_col(spark, sal, "salary")
    got = [(r.salary, r.low, r.ok) for r in
           df.select("salary", C.salary_low("salary").alias("low"), filters.salary_ok("salary", run).alias("ok"))
           .collect()]
    assert got == [(sal[0], 93600, True), (sal[1], 120000, True), (sal[2], None, False), (sal[3], 95000, True),
                   (sal[4], 37440, False), (None, None, False), ("", None, False), (sal[7], None, False),
                   (sal[8], 200, False)]


def test_salary_no_bounds_keeps_everything(spark):
    df = one_col(spark, [None, "junk"], "salary")
    assert df.filter(filters.salary_ok("salary", RunParams())).count() == 2


def test_blank_blacklist_entries_are_ignored(spark):
    run = RunParams(company_blacklist=("", "  ", "Staffing"))
    df = one_col(spark, ["Acme", "Big Staffing Agency", "staffing co"], "company")
    assert [r.company for r in filters.company_blacklist(df, run).collect()] == ["Acme"]


def test_employment_filter_keeps_unknown(spark):
    run = RunParams(employment_types=("full-time",))
    df = one_col(spark, ["full-time", "contract", None], "employment_type")
    assert [r.employment_type for r in filters.employment_filter(df, run).collect()] == ["full-time", None]


def test_location_parts_rules(spark):
    rows = [("US-Remote, US-Chicago", "Chicago", "IL", "hybrid"), ("Sao Paulo, Brazil", "Chicago", "IL", "hybrid"),
            ("Remote", "Chicago", "IL", "hybrid"), ("Remote - US", "Chicago", "IL", "remote"),
            ("Springfield, IL", "Chicago", "IL", "onsite"), ("Philadelphia, PA", "Chicago", "IL", "onsite")]
    df = spark.createDataFrame(rows, "loc string, city string, state string, wt string")
    got = [r.ok for r in df.select(C.location_match_parts("loc", "city", "state", "wt").alias("ok")).collect()]
    # 'brazil' ends with 'il': the state test is a suffix test.
    assert got == [True, True, False, True, True, False]


def test_location_simple_and_work_type_maps(spark):
    df = spark.createDataFrame([("Philadelphia, PA", "Chicago", "IL"), ("Chicago, IL", "Chicago", "IL")],
                               "loc string, city string, state string")
    assert [r.ok for r in df.select(C.location_match_simple("loc", "city", "state").alias("ok")).collect()] \
        == [False, True]
    wt = one_col(spark, ["US-Remote, Hybrid", "Remote", "hybrid", "Chicago"]).select(
        C.work_type_from_location("v").alias("w")).collect()
    assert [r.w for r in wt] == ["hybrid", "remote", "hybrid", None]
    txt = one_col(spark, ["Fully REMOTE", "hybrid role", "In-person only", "desk"]).select(
        C.work_type_from_text("v").alias("w")).collect()
    assert [r.w for r in txt] == ["remote", "hybrid", "onsite", None]


def test_employment_type_first_key_wins(spark):
    vals = ["contract to hire", "permanent / full time", "temporary to hire", "part-time", "full-time", "intern"]
    got = [r.e for r in one_col(spark, vals).select(C.employment_type_from_text("v").alias("e")).collect()]
    assert got == ["contract", "full-time", "temporary", "part-time", None, None]


def test_salary_format(spark):
    df = spark.createDataFrame([("85000", "120000", "", "year"), ("25", "0", "EUR", "hour"), ("", "1", "", ""),
                                ("1000.5", "abc", "", "")], "lo string, hi string, cur string, per string")
    got = [r.s for r in df.select(C.format_salary("lo", "hi", "cur", "per").alias("s")).collect()]
    assert got == ["$85,000.00–$120,000.00 USD / year", "$25.00 EUR / hour", None, None]


def test_state_lookup_passes_unknown_through(spark):
    got = [r.n for r in one_col(spark, ["il", "NY", "ZZ"]).select(C.state_name("v").alias("n")).collect()]
    assert got == ["Illinois", "New York", "ZZ"]


def test_iso_and_relative_dates(spark):
    vals = ["2024-01-30T10:00:00Z", "2024-01-30T12:00:00+02:00", "2024-01-30", "20240130", "2024", "garbage", None]
    got = [r.t for r in one_col(spark, vals).select(TS.format_ts(TS.parse_iso("v")).alias("t")).collect()]
    assert got == ["2024-01-30 10:00:00.000000", "2024-01-30 10:00:00.000000", "2024-01-30 00:00:00.000000",
                   None, None, None, None]
    rel = spark.createDataFrame([("3 hours ago", "linkedin"), ("3 hours", "linkedin"), ("3 hours", "wellfound"),
                                 ("2 weeks ago", "builtin"), ("1 month", "workatastartup")], "t string, b string")
    got = [r.x for r in rel.select(TS.format_ts(TS.parse_relative_by_source("t", "b", RUN_TS)).alias("x")).collect()]
    assert got == ["2024-01-30 21:00:00.000000", None, "2024-01-30 21:00:00.000000", None,
                   "2024-01-01 00:00:00.000000"]


def test_feed_dates_and_epoch(spark):
    df = spark.createDataFrame([("Wed, 31 Jan 2024 10:00:00 +0200", None), (None, "Tue, 30 Jan 2024 01:02:03 GMT"),
                                ("bad", "worse")], "p string, u string")
    got = [r.t for r in df.select(TS.format_ts(TS.feed_date("p", "u")).alias("t")).collect()]
    assert got == ["2024-01-31 08:00:00.000000", "2024-01-30 01:02:03.000000", None]
    ep = spark.createDataFrame([(0,), (1706659200,), (None,)], "e long")
    got = [r.t for r in ep.select(TS.format_ts(TS.parse_epoch_seconds("e")).alias("t")).collect()]
    assert got == [None, "2024-01-31 00:00:00.000000", None]


def test_title_company_splits(spark):
    df = one_col(spark, ["Engineer at Night at Acme", "Engineer", "Acme: Backend Engineer at Acme"])
    t, c = X.split_last_at("v")
    got = [(r.t, r.c, r.ft, r.fc) for r in df.select(
        t.alias("t"), c.alias("c"), X.feed_title("v").alias("ft"), X.feed_company(F.lit(""), "v").alias("fc"))
        .collect()]
    assert got == [("Engineer at Night", "Acme", "Engineer at Night at Acme", "Acme"),
                   ("Engineer", "", "Engineer", ""), ("Acme: Backend Engineer", "Acme", "Acme", "Acme")]


def test_safe_name_and_strip_tags(spark):
    df = one_col(spark, ["Café & Co.²", "<p>Hi<br/>there</p>"])
    got = [(r.s, r.t) for r in df.select(X.safe_name("v").alias("s"), X.strip_tags("v").alias("t")).collect()]
    # "²" is a digit to str.isalnum, so it is kept.
    assert got[0][0] == "Café___Co_²" and got[1][1] == " Hi there "


def test_window_filter_keeps_unknown_and_future(spark):
    run = RunParams(posted_within_hours=24.0, run_ts=RUN_TS)
    df = spark.createDataFrame([("a", "2024-01-30 01:00:00"), ("b", "2024-01-29 23:00:00"), ("c", None),
                                ("d", "2024-02-05 00:00:00")], "id string, t string") \
        .withColumn("posted_at", F.to_timestamp("t"))
    assert sorted(r.id for r in filters.window_filter(df, run).collect()) == ["a", "c", "d"]
