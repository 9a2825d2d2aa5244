"""Watermark de-duplication and the lexical stand-in scorer."""

import os
import tempfile

from jobsift.operators import lexical
from jobsift.streaming import incremental


def test_first_sightings_keep_one_row_per_key(spark):
    d = tempfile.mkdtemp(prefix="jobsift-feed-")
    rows = [(1, "2024-01-01 00:00:00", 7, "view"), (2, "2024-01-01 00:10:00", 7, "view"),
            (3, "2024-01-01 00:20:00", 8, "view"), (4, "2024-01-01 00:30:00", 7, "click")]
    df = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string") \
        .selectExpr("event_id", "CAST(t AS TIMESTAMP_NTZ) AS ts", "user_id", "event_type")
    df.coalesce(1).write.parquet(os.path.join(d, "feed"))
    src = os.path.join(d, "feed")
    out = incremental.first_sightings(spark, src, "*.parquet", df.schema, ["user_id", "event_type"], "ts", "1 hour",
                                      os.path.join(d, "out"), os.path.join(d, "ckpt"))
    got = sorted((r.user_id, r.event_type, r.event_id) for r in out.collect())
    assert got == [(7, "click", 4), (7, "view", 1), (8, "view", 3)]


def test_lexical_scores_are_bounded_and_identity_is_full(spark):
    posts = spark.createDataFrame([(1, "python spark data pipelines"), (2, "gardening and cooking"),
                                   (3, "python backend services")], "seq long, description string")
    resumes = spark.createDataFrame([(1, "python spark data pipelines"), (2, "cooking")],
                                    "role_id int, resume_text string")
    landed = posts.selectExpr("explode(array(1, 2)) AS role_id", "seq", "description").filter("NOT (role_id = 2 AND seq = 1)")
    got = {(r.role_id, r.seq): r.lexical_score for r in lexical.lexical_match(landed, posts, resumes).collect()}
    hashed = {(r.role_id, r.seq): r.lexical_score for r in lexical.lexical_match_hashed(landed, posts, resumes).collect()}
    assert got == hashed  # so few terms share no hash value
    assert len(got) == 5 and all(0 <= v <= 100 for v in got.values())
    assert got[(1, 1)] == 100 and got[(1, 2)] == 0 and got[(2, 2)] > 0 and got[(1, 3)] > 0


def test_terms_are_counted_within_a_row(spark):
    rows = [(1, "B a b, a! B 12 é"), (2, None), (3, ""), (4, "x"), (5, "x x x")]
    df = spark.createDataFrame(rows, "seq long, description string")
    got = sorted(map(tuple, lexical.term_counts(df, "seq", "description").collect()))
    assert got == [(1, "12", 1), (1, "a", 2), (1, "b", 3), (1, "é", 1), (4, "x", 1), (5, "x", 3)]


def test_rare_and_common_terms_weigh_alike_by_either_join(spark, monkeypatch):
    posts = spark.createDataFrame([(i, f"common word{i % 7} own{i}") for i in range(60)] + [(99, None)], "seq long, description string")
    resumes = spark.createDataFrame([(1, "common word3 own5 absent"), (2, ""), (3, None)], "role_id int, resume_text string")
    landed = posts.selectExpr("explode(array(1, 2, 3)) AS role_id", "seq")
    scores = []
    for common in (0, 20, 10 ** 6):  # all by shuffle, the one common term by broadcast, all by broadcast
        monkeypatch.setattr(lexical, "COMMON", common)
        scores.append(sorted(map(tuple, lexical.lexical_match(landed, posts, resumes).collect())))
    assert scores[0] == scores[1] == scores[2] and len(scores[0]) == 183
    by = {(r, s): x for r, s, x in scores[0]}
    assert by[1, 5] > by[1, 3] > by[1, 0] >= 0 and all(by[r, s] == 0 for r, s in by if r > 1 or s == 99)


def test_a_failing_row_does_not_take_its_batch_along(spark):
    import pandas as pd

    def make():
        def score(pdf):
            if (pdf["seq"] == 2).any():
                raise ValueError("no answer")
            return pd.Series(["ok"] * len(pdf), index=pdf.index)
        return score
    got = {r.seq: (r.raw, r.error) for r in lexical.score_with(spark.range(1, 5).withColumnRenamed("id", "seq"), make, ["seq"]).collect()}
    assert got == {1: ("ok", None), 2: (None, "ValueError: no answer"), 3: ("ok", None), 4: ("ok", None)}


def test_sightings_expire_and_late_rows_are_dropped(spark):
    d = tempfile.mkdtemp(prefix="jobsift-feed-")
    lots = [[(1, "2024-01-01 00:00:00", 7)], [(2, "2024-01-01 05:00:00", 8)],
            [(3, "2024-01-01 05:30:00", 7), (4, "2024-01-01 05:30:00", 8), (5, "2024-01-01 00:30:00", 9)]]
    for lot in lots:
        df = spark.createDataFrame(lot, "event_id long, t string, user_id long").selectExpr(
            "event_id", "CAST(t AS TIMESTAMP_NTZ) AS ts", "user_id")
        df.coalesce(1).write.mode("append").parquet(os.path.join(d, "feed"))
        out = incremental.first_sightings(spark, os.path.join(d, "feed"), "*.parquet", df.schema, ["user_id"], "ts", "1 hour",
                                          os.path.join(d, "out"), os.path.join(d, "ckpt"))
    # 3: user 7's first sighting has expired; 4: user 8's has not; 5 is older than the watermark
    assert sorted(r.event_id for r in out.collect()) == [1, 2, 3]
