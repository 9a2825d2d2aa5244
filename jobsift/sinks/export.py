"""CSV export, report tables and the cover-letter sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import age_label, safe_name, truncate
from ..functions.timestamps import age_hours
from ..operators.joins import bounded_broadcast
from ..params import CSV_FIELDS, NOTES_DISPLAY_CHARS
from ..session import materialize


def iso_timestamp_text(c) -> Column:
    """Instant -> 'YYYY-MM-DDTHH:MM:SS[.ffffff]+00:00'; NULL -> ''."""
    ts = F.col(c) if isinstance(c, str) else c
    frac = F.when(F.date_format(ts, "SSSSSS") != "000000", F.concat(F.lit("."), F.date_format(ts, "SSSSSS"))) \
        .otherwise(F.lit(""))
    text = F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), frac, F.lit("+00:00"))
    return F.coalesce(text, F.lit(""))


def ranked_results(results: DataFrame) -> DataFrame:
    """Results with their ``position``: highest score first, ties by URL. The
    result set is bounded by roles x max_jobs, so one window orders it."""
    order = Window.orderBy(F.col("match_score").desc(), "url")
    return results.withColumn("position", F.row_number().over(order).cast("bigint"))


def csv_rows(results: DataFrame, work_type: str = "job_work_type") -> DataFrame:
    """The ten CSV columns; unknown dates and work types become empty text."""
    keep = ["position"] if "position" in results.columns else []
    return results.select(
        *keep, "title", "company", "location", "source", "url",
        iso_timestamp_text("posted_at").alias("posted_at"),
        F.coalesce(F.col(work_type), F.lit("")).alias("work_type"),
        F.col("match_score").cast("int").alias("match_score"), "status", "notes")


CSV_OPTIONS = {"header": True, "emptyValue": "", "escape": '"', "multiLine": True}


def write_csv(results: DataFrame, path: str, work_type: str = "job_work_type") -> None:
    """Write the export as CSV with a header; an empty path disables it.

    Rows are ordered by score (highest first). The result set is bounded by
    roles x max_jobs, so a single output file is written.
    """
    if not path:
        return
    rows = csv_rows(ranked_results(results), work_type).orderBy("position").drop("position")
    rows.coalesce(1).write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The export as it was written (a CSV field without text is empty text)."""
    schema = ", ".join(f"{c} {'int' if c == 'match_score' else 'string'}" for c in CSV_FIELDS)
    return spark.read.schema(schema).options(**CSV_OPTIONS).csv(path).na.fill("")


def number_rows(df: DataFrame, partition_col: str, order_cols: list[Column], out: str = "pos") -> DataFrame:
    """1-based position of each row inside ``partition_col`` under ``order_cols``.

    Distributed and JVM-only: a range-partitioned sort, per-partition row
    counts turned into start offsets (one row per partition, so the broadcast
    is bounded by the partition count), then the offset of each group's first
    row. No group is gathered into one task. The sorted rows are written once:
    range bounds are sampled anew by each evaluation, so both uses must read
    the same one.
    """
    spark = df.sparkSession
    sorted_df = materialize(df.orderBy(F.col(partition_col), *order_cols).withColumn(
        "_mid", F.monotonically_increasing_id()), "sorted-rows")
    ids = (sorted_df.withColumn("_pid", F.shiftright("_mid", 33))
                    .withColumn("_off", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))))
    per_part = ids.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_part.select("_pid", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_base"))
    # One row per sort output partition: bounded by the shuffle partition count.
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    gidx = ids.join(bounded_broadcast(starts, n_parts), on="_pid").withColumn("_g", F.col("_base") + F.col("_off"))
    first = gidx.groupBy(partition_col).agg(F.min("_g").alias("_first"))
    return (gidx.join(first, on=partition_col)
                .withColumn(out, (F.col("_g") - F.col("_first") + 1).cast("bigint"))
                .drop("_mid", "_pid", "_off", "_base", "_g", "_first"))


def jobs_report(gathered: DataFrame, run_ts: str, order_cols: list[Column], bounded: bool = False) -> DataFrame:
    """Numbered jobs per role in newest-first order with their age label.

    ``bounded`` declares the input bounded by configuration (the gathered
    rows: roles x boards x cells x cap), where a per-role window is a bounded
    group; otherwise the distributed numbering is used.
    """
    base = gathered.select("role_id", "title", "company", "location", "source", "posted_at", "board_ord",
                           "search_cell", "seq")
    if bounded:
        w = Window.partitionBy("role_id").orderBy(*order_cols)
        numbered = base.withColumn("pos", F.row_number().over(w).cast("bigint"))
    else:
        numbered = number_rows(base, "role_id", order_cols)
    return numbered.select("role_id", "pos", "title", "company", "location", "source",
                           age_label(age_hours("posted_at", run_ts)).alias("posted"))


def results_report(results: DataFrame) -> DataFrame:
    """Position (highest score first), company, title, score, status and the
    first 60 characters of the notes."""
    return ranked_results(results).select("position", "company", "title", F.col("match_score").cast("int").alias("match_score"), "status",
                          truncate("notes", NOTES_DISPLAY_CHARS).alias("notes"))


def letter_paths(results: DataFrame, out_dir: str = "applications") -> DataFrame:
    """Cover-letter path per qualifying (pending) result:
    ``cover_{company with non-alphanumerics as _}_{source}.txt``.

    Several results can map to one path; those are flagged, not overwritten.
    """
    pending = results.filter(F.col("status") == "pending")
    path = F.concat(F.lit(out_dir.rstrip("/") + "/cover_"), safe_name("company"), F.lit("_"), F.col("source"),
                    F.lit(".txt"))
    with_path = pending.select("url", "company", "source", path.alias("path"))
    counts = with_path.groupBy("path").agg(F.count(F.lit(1)).alias("_n"))
    return (with_path.join(counts, on="path")
                     .withColumn("collision", F.col("_n") > 1).drop("_n"))


def with_letters(results: DataFrame, letters: DataFrame) -> DataFrame:
    """Results with the text of their letter in ``cover_letter`` (empty where
    none was written, and for results that are not pending).

    ``letters`` (role_id, source, url, letter) may be large: it is probed with
    the keys of the pending results first."""
    keys = ["role_id", "source", "url"]
    pending = results.filter(F.col("status") == "pending").select(*keys).distinct()
    text = letters.join(pending, on=keys, how="left_semi").groupBy(*keys).agg(F.min("letter").alias("cover_letter"))
    return results.drop("cover_letter").join(text, on=keys, how="left").withColumn(
        "cover_letter", F.coalesce("cover_letter", F.lit("")))


def letter_rows(results: DataFrame, out_dir: str = "applications") -> DataFrame:
    """Path, URL and text of each letter: (path, url, company, source,
    collision, cover_letter)."""
    return letter_paths(results, out_dir).join(results.select("url", "cover_letter"), on="url")


def write_letters(letters: DataFrame, root: str) -> None:
    """Letters as a Parquet dataset keyed by URL with the target path as a
    column (never one file per row from the driver)."""
    letters.write.mode("overwrite").parquet(root)
