"""Defined results on repeated rows, very long values and clashing columns."""

import pytest
from pyspark.sql import functions as F

from jobsift.llm import queries, rule_ledger, simhash, url_graph

LONG = "x" * 300_000


def test_url_rules_on_repeated_rows_and_very_long_values(spark):
    rows = [(1, "http://a.net/es/1", "<a href='http://b.org/'>b</a>", "h", "r"), (1, "http://a.net/es/1", "<a href='http://b.org/'>b</a>", "h", "r"),
            (2, f"http://b.org/{LONG}", f"<p>{LONG}</p>", "h", "r"), (3, f"http://{LONG}.net/fr/", None, "h", "r"), (4, None, LONG, "h", "r"),
            (None, "http://a.net/other", "", None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, rule string")
    got = sorted(((r.id or 0, r.host, r.path, r.rule, r.verdict) for r in url_graph.judge(df, queries.URL_RULES).collect()), key=str)
    assert got == sorted([
        (1, "a.net", "/es/1", "net/es/", "block"), (1, "a.net", "/es/1", "net/es/", "block"), (2, "b.org", f"/{LONG}", None, "allow"),
        (3, f"{LONG}.net", "/fr/", "net/fr/", "block"), (4, "", "", None, "allow"), (0, "a.net", "/other", None, "block")], key=str)


def test_ledger_with_clashing_columns_and_repeated_rows(spark):
    rows = [(1, "one two three " * 20, 7, "f", "k"), (1, "one two three " * 20, 7, "f", "k"), (2, None, 1, None, None), (3, LONG, 1, "f", "k")]
    plain = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    clash = spark.createDataFrame(rows, "doc_id long, text string, n_words long, failed string, id string")
    got = sorted(map(tuple, rule_ledger.ledger(clash).collect()))
    assert got == sorted(map(tuple, rule_ledger.ledger(plain).collect())) and len(got) == 4
    assert [r[0] for r in got] == [1, 1, 2, 3]


def test_ids_that_are_no_integers_fail_in_near_duplicates(spark):
    df = spark.createDataFrame([("a", "text")], "doc_id string, text string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        simhash.near_duplicates(df).collect()
    digits = df.withColumn("doc_id", F.lit("7"))
    assert [r.component for r in simhash.near_duplicates(digits).collect()] == [7]
