"""Operators do the whole job where an earlier version stopped short of it."""

import itertools
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from jobsift.llm import line_dedup, mixing, queries, rule_ledger, url_graph
from jobsift.llm.common import joined


# --- 3: URL filter

def test_scores_settle_on_cycles_and_long_paths(spark):
    d = url_graph.DAMPING
    path = [("distrust", f"p{i}", f"p{i + 1}", 1.0) for i in range(40)]
    edges = spark.createDataFrame([("trust", "a", "b", 1.0), ("trust", "b", "a", 1.0), *path],
                                  "kind string, start string, end string, weight double")
    seeds = spark.createDataFrame([("trust", "a", 1.0), ("distrust", "p0", 1.0)], "kind string, host string, seed double")
    got = {(r.kind, r.host): r.score for r in url_graph.propagate(seeds, edges).collect()}
    want = {("trust", "a"): 1 / (1 + d), ("trust", "b"): d / (1 + d)}
    want |= {("distrust", f"p{i}"): (1 - d) * d ** i for i in range(41)}
    assert got.keys() == want.keys()
    assert sum(abs(got[k] - want[k]) for k in want) < 1e-5 * sum(want.values())


# --- 7: line de-duplication

def test_copies_of_a_text_do_not_share_one_task(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "LISTED", -1)  # lists too long to be broadcast
    own = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in own}
    rows = [(i, "a", t, {"k": "v"}) for i, t in enumerate(["copied", None] * 200)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, more map<string,string>")
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        tasks = line_dedup.clean(df).withColumn("task", F.spark_partition_id()).groupBy("text").agg(
            F.count_distinct("task").alias("n"), F.count("*").alias("rows")).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(tasks) == 2 and all(r.n > 1 and r.rows == 200 for r in tasks)


def test_long_and_short_lists_meet_the_texts_alike(spark, monkeypatch):
    rows = [(i, h, f"own {i}\nshared {h}\nrare {i % 90}\n{i}") for i, h in enumerate(["a", "a", None, "b"] * 60)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    short = sorted(map(tuple, line_dedup.clean(df).drop("source").collect()))
    assert "BroadcastHashJoin" in line_dedup.clean(df)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(line_dedup, "LISTED", -1)
    assert sorted(map(tuple, line_dedup.clean(df).drop("source").collect())) == short
    assert all("shared" not in t[2] and "own" in t[2] for t in short)


def test_unicode_line_ends_are_part_of_a_line(spark):
    ends = ["\u2028", " \u2028", "\x85", "\u2029", "\x1c", "\xa0"]
    rows = [(i, "a", f"foo{ends[i % 6]}\nbar \t\x0b\n{i}") for i in range(24)] + [(24 + i, "a", f"foo\nown {i}") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: r.text for r in line_dedup.cleaned(df).collect()}
    assert all(got[i] == f"foo{ends[i % 6]}\n{i}" for i in range(24)) and all(got[24 + i] == f"own {i}" for i in range(9))


# --- 8: mixing

def test_a_source_misses_its_target_by_half_its_longest_document_at_most(spark):
    rows = [(i, s, "w " * (3000 if i % 50 == 0 else 1 + i % 7)) for i, s in enumerate("abcd" * 100)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got, longest, goal = defaultdict(int), defaultdict(int), {}
    for r in mixing.mix(df, ["source"]).collect():
        got[r.source] += r.taken
        longest[r.source], goal[r.source] = max(longest[r.source], r.size), r.target
    assert all(abs(got[s] - goal[s]) <= longest[s] / 2 for s in goal)


def test_columns_named_as_results_are_refused_or_carried(spark):
    df = spark.createDataFrame([(1, "a", "x y", 7, "t"), (None, "a", "z", 8, "t"), (None, "a", "w w", 9, "t")],
                               "doc_id long, source string, text string, size int, target string")
    with pytest.raises(ValueError, match="size"):
        mixing.mix(df, ["doc_id", "size"])
    out = mixing.mixed(df)
    assert out.columns == df.columns and {r["size"] for r in out.collect()} <= {7, 8, 9}


def test_rows_without_ids_draw_from_their_texts(spark):
    df = spark.createDataFrame([(None, f"text {i}") for i in range(50)], "doc_id long, text string")
    assert df.select(mixing.uniform(F.col("doc_id"), F.col("text"))).distinct().count() == 50


# --- 4: near duplicates

def test_hot_keys_are_joined_apart(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("long").alias("k"), "id")
    one = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    got = joined(rows, one, "k", "n")
    assert got.count() == 5000 and got.columns == ["k", "id", "least"]
    assert {r.least for r in got.where("k = 7").collect()} == {0} and got.where("k <> 7 AND least <> id").count() == 0


# --- 9: rules

def test_a_clean_text_is_kept_whatever_its_length(spark, tmp_path):
    words = list(map("".join, itertools.product("abcdefghij", repeat=6)))
    spark.createDataFrame([(1, " ".join([*words, "end"]))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    row = queries.QUERIES["op9_rule_ledger"](spark, str(tmp_path)).first()
    assert row.n_words == 1000001 and row.failed == rule_ledger.BIT["too_long"]
    assert row.kept and not row.base_failed
