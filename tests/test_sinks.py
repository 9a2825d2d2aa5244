"""File sinks and sources: CSV export, letter dataset, resume files."""

import csv
import glob
import os
import tempfile

from pyspark.sql import functions as F

from jobsift.params import Role, SearchConfig
from jobsift.sinks import export
from jobsift.sources import resumes

RUN_TS = "2024-01-31 00:00:00"


def results(spark):
    return spark.createDataFrame(
        [("Eng", "Acme, Inc", "Chicago, IL", "linkedin", "u1", "2024-01-30 10:00:00", "hybrid", 80, "pending",
          "ready for manual review"),
         ("Dev", "Beta", "", "builtin", "u2", None, None, 40, "skipped", "score 40 < threshold 65")],
        "title string, company string, location string, source string, url string, t string, "
        "job_work_type string, match_score int, status string, notes string") \
        .withColumn("posted_at", F.to_timestamp("t")).drop("t")


def test_csv_export_writes_ten_columns(spark):
    out = os.path.join(tempfile.mkdtemp(prefix="jobsift-csv-"), "jobs")
    export.write_csv(results(spark), out)
    files = glob.glob(os.path.join(out, "part-*.csv"))
    assert len(files) == 1
    with open(files[0], newline="", encoding="utf-8") as f:
        rows = list(csv.DictReader(f))
    assert list(rows[0].keys()) == export.CSV_FIELDS
    assert rows[0]["posted_at"] == "2024-01-30T10:00:00+00:00" and rows[0]["company"] == "Acme, Inc"
    assert rows[1]["posted_at"] == "" and rows[1]["work_type"] == ""
    assert [r["url"] for r in rows] == ["u1", "u2"]
    export.write_csv(results(spark), "")  # empty path disables the export


def test_letter_paths_flag_collisions(spark):
    df = results(spark).unionByName(results(spark).withColumn("url", F.concat("url", F.lit("x"))))
    got = {r.url: (r.path, r.collision) for r in export.letter_paths(df).collect()}
    assert got["u1"] == ("applications/cover_Acme__Inc_linkedin.txt", True)
    assert "u2" not in got
    root = tempfile.mkdtemp(prefix="jobsift-letters-")
    export.write_letters(export.letter_paths(df), os.path.join(root, "letters"))
    assert spark.read.parquet(os.path.join(root, "letters")).count() == 2


def test_resumes_read_whole_files(spark):
    d = tempfile.mkdtemp(prefix="jobsift-resume-")
    paths = []
    for i, text in enumerate(["Line one\nLine two\n", "Other resume"]):
        p = os.path.join(d, f"r{i}.txt")
        with open(p, "w", encoding="utf-8") as f:
            f.write(text)
        paths.append(p)
    cfg = SearchConfig(roles=(Role(1, "A", resume_path=paths[0]), Role(2, "B", resume_path=paths[1])),
                       boards=(), locations=())
    got = {r.role_id: r.resume_text for r in resumes.read_resumes(spark, cfg).collect()}
    assert got == {1: "Line one\nLine two\n", 2: "Other resume"}


def test_roles_share_a_resume_and_files_share_a_name(spark):
    d = tempfile.mkdtemp(prefix="jobsift-resume-")
    for sub, text in (("a", "one"), ("b", "two")):
        os.makedirs(os.path.join(d, sub))
        with open(os.path.join(d, sub, "cv.txt"), "w", encoding="utf-8") as f:
            f.write(text)
    a, b = os.path.join(d, "a", "cv.txt"), os.path.join(d, "b", "cv.txt")
    cfg = SearchConfig(roles=(Role(1, "A", resume_path=a), Role(2, "B", resume_path=a), Role(3, "C", resume_path=b)),
                       boards=(), locations=())
    assert {r.role_id: r.resume_text for r in resumes.read_resumes(spark, cfg).collect()} == {1: "one", 2: "one", 3: "two"}


def test_report_and_csv_are_ordered_by_score_with_stable_ties(spark):
    df = results(spark).unionByName(results(spark).withColumn("url", F.concat(F.lit("a"), F.col("url"))))
    assert [(r.position, r.match_score) for r in export.results_report(df).orderBy("position").collect()] == [
        (1, 80), (2, 80), (3, 40), (4, 40)]
    out = os.path.join(tempfile.mkdtemp(prefix="jobsift-csv-"), "jobs")
    export.write_csv(df, out)
    assert [r.url for r in export.read_csv(spark, out).collect()] == ["au1", "u1", "au2", "u2"]


def test_letters_are_joined_to_pending_results(spark):
    df = results(spark).withColumn("role_id", F.lit(1))
    letters = spark.createDataFrame([(1, "linkedin", "u1", "Dear"), (1, "builtin", "u2", "No")],
                                    "role_id int, source string, url string, letter string")
    got = {r.url: r.cover_letter for r in export.with_letters(df, letters).collect()}
    assert got == {"u1": "Dear", "u2": ""}
    assert [r.cover_letter for r in export.letter_rows(export.with_letters(df, letters)).collect()] == ["Dear"]


def test_results_report_truncates_notes(spark):
    df = results(spark).withColumn("notes", F.lit("x" * 100))
    assert {len(r.notes) for r in export.results_report(df).collect()} == {60}


def test_distributed_numbering_matches_window(spark):
    from pyspark.sql import Window
    df = spark.range(0, 5000).selectExpr("CAST(id % 3 AS INT) AS role_id", "id AS seq", "(id * 7919) % 1000 AS k")
    order = [F.col("k").desc(), F.col("seq")]
    got = {(r.role_id, r.seq): r.pos for r in export.number_rows(df, "role_id", order).collect()}
    want = {(r.role_id, r.seq): r.pos for r in df.withColumn(
        "pos", F.row_number().over(Window.partitionBy("role_id").orderBy(*order))).collect()}
    assert got == want
