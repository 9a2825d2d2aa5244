"""Top-k per role, threshold status, and the merge of roles by URL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .dedup import newest_first_cols


def topk_per_role(df: DataFrame, k: int, score: str = "match_score") -> DataFrame:
    """Best ``k`` rows per role by score; ties keep the newest-first order.

    ``row_number() <= k`` with a literal k is planned as a partial
    WindowGroupLimit, so each task forwards at most k rows per role.
    """
    w = Window.partitionBy("role_id").orderBy(F.col(score).desc(), *newest_first_cols())
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k) \
             .withColumn("rank", F.col("rank").cast("bigint"))


def status_notes(df: DataFrame, min_score: int, score: str = "match_score") -> DataFrame:
    """Below the threshold -> skipped with the reason; otherwise pending."""
    below = F.col(score) < F.lit(min_score)
    return (df.withColumn("status", F.when(below, F.lit("skipped")).otherwise(F.lit("pending")))
              .withColumn("notes", F.when(below, F.format_string(f"score %d < threshold {min_score}", F.col(score)))
                          .otherwise(F.lit("ready for manual review"))))


def merge_roles(df: DataFrame, score: str = "match_score") -> DataFrame:
    """One row per URL: the highest score; on a tie the earlier role, then the
    earlier row of that role's ranking (its rank, if ranked, else the order
    that ranks are given in)."""
    order = [F.col("rank").asc()] if "rank" in df.columns else newest_first_cols()
    w = Window.partitionBy("url").orderBy(F.col(score).desc(), F.col("role_ord").asc(), *order)
    return df.withColumn("_m", F.row_number().over(w)).filter(F.col("_m") == 1).drop("_m")


def ready_count(df: DataFrame) -> DataFrame:
    return df.filter(F.col("status") == "pending").agg(F.count(F.lit(1)).cast("bigint").alias("ready"))
