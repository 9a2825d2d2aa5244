"""Term and place joins against the literal tests they replace."""

import random
import string

import pytest
from pyspark.sql import functions as F

from jobsift.functions.classify import location_match_parts, location_match_simple
from jobsift.operators import places, term_index


def words(rng, n):
    return ["".join(rng.choice("abcde") for _ in range(rng.randrange(1, 7))) for _ in range(n)]


def test_matches_are_those_of_contains_with_2000_roles(spark):
    rng = random.Random(1)
    titles = [(i, " ".join(words(rng, rng.randrange(1, 6))).title()) for i in range(300)] + [
        (300, None), (301, ""), (302, "ab"), (303, "É über ab🙂c"), (304, "a\nbc de")]
    roles = [(r, t) for r in range(2000) for t in {*words(rng, 3)}] + [(2000, ""), (2001, "🙂c"), (2002, "É Ü"), (2003, None), (0, "Ab"), (0, "ab")]
    df = spark.createDataFrame(titles, "seq int, title string")
    terms = spark.createDataFrame(roles, "owner int, term string")
    found = term_index.matches(df, ["seq"], "title", terms)
    want = {(s, r) for s, t in titles if t is not None for r, term in roles if term is not None and term.lower() in t.lower()}
    got = [(r.seq, r.owner) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_lines_give_the_rows_of_whole_texts(spark):
    rng = random.Random(2)
    texts = [(i, "\n".join(" ".join(words(rng, 4)) for _ in range(rng.randrange(0, 5)))) for i in range(80)]
    df = spark.createDataFrame(texts, "seq int, body string")
    terms = spark.createDataFrame([(i, w) for i, w in enumerate(words(rng, 50))], "owner int, term string")
    whole = sorted(term_index.matches(df, ["seq"], "body", terms).collect())
    assert whole and sorted(term_index.matches(df, ["seq"], "body", terms, lines=True).collect()) == whole
    with pytest.raises(ValueError, match="line ends"):
        term_index.matches(df, ["seq"], "body", spark.createDataFrame([(1, "a\nb")], "owner int, term string"), lines=True)
    assert term_index.matches(df, ["seq"], "body", terms.limit(0)).collect() == []


def test_large_term_tables_meet_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(term_index, "bounded_broadcast", lambda df, *a: df)
    df = spark.createDataFrame([(1, "Data Engineer"), (2, "Cook")], "seq int, title string")
    terms = spark.createDataFrame([(7, "engine"), (8, "cook"), (8, "oo")], "owner int, term string")
    assert sorted(map(tuple, term_index.matches(df, ["seq"], "title", terms).collect())) == [(1, 7), (2, 8)]


def test_blacklist_of_many_entries(spark):
    rng = random.Random(3)
    companies = [(i, " ".join(words(rng, 2)).upper()) for i in range(200)] + [(200, None), (201, "")]
    entries = ["".join(rng.choice(string.ascii_lowercase[:6]) for _ in range(4)) for _ in range(2000)] + ["", "  "]
    df = spark.createDataFrame(companies, "seq int, company string")
    got = {r.seq for r in term_index.without_matches(df, ["seq"], "company", spark.createDataFrame([(e,) for e in entries], "term string")).collect()}
    assert got == {i for i, c in companies if c is None or not any(e.strip() and e in c.lower() for e in entries)}


LOCS = ["US-Remote, US-Chicago", "Chicago, IL", "Hybrid - New York, NY", "Sao Paulo, Brazil", "Remote", "Springfield,  il ", "", None,
        "Remote, IL", ",", ", ", "x, ca, remote ny", "Paris , France", "é, ÎL"]


def test_places_are_those_of_the_literal_tests_with_5000_places(spark):
    rng = random.Random(4)
    some = [("Chicago", "IL"), ("York", "NY"), ("Paris", ""), ("", "ca"), ("springfield", "il"), ("Sao", "brazil"), (None, "IL"), ("Chicago", None)]
    towns = [(i, *some[i]) if i < len(some) else (i, "".join(rng.choice("abcdefgh") for _ in range(4)), rng.choice(["IL", "NY", "ca", "TX", "France"]))
             for i in range(5000)]
    locs = [(i, loc) for i, loc in enumerate(LOCS)]
    df = spark.createDataFrame(locs, "seq int, location string")
    table = spark.createDataFrame(towns, "place_id int, city string, state string")
    pairs = df.crossJoin(table).withColumn("work_type", F.lit("hybrid"))
    for rule, test in ((places.places_by_parts, location_match_parts("location", "city", "state", "work_type")),
                       (places.places_by_text, location_match_simple("location", "city", "state"))):
        found = rule(df, ["seq"], "location", table)
        want = {(r.seq, r.place_id) for r in pairs.filter(test).collect()}
        got = [(r.seq, r.place_id) for r in found.collect()]
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert len(got) == len(set(got)) and set(got) == want and "NestedLoop" not in plan and "Cartesian" not in plan
