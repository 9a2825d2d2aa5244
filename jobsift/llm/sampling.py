"""Bounded samples of labelled rows, to fit a classifier on the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import discard, written


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (null id: fold 0)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds, F.lit(0)).cast("int")


def thinned(rows: DataFrame, by: Column, bound: int) -> DataFrame:
    """``rows`` if they are at most ``bound``, else those whose hash falls in
    the share that leaves about ``bound``: the same rows on every run."""
    share = bound / max(1, rows.count())
    if share >= 1:
        return rows
    return rows.where(F.pmod(F.xxhash64(by, F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)))


def picked(ids: DataFrame, marks: DataFrame, bound: int) -> DataFrame:
    """(id, mark): of each mark about ``bound`` of the ids that have it, the
    same on every run. ``ids`` and ``marks`` are narrow; no text is read."""
    known = written(ids.select("id").join(marks.select("id", "mark"), "id").distinct(), "sample-ids")
    counts = {r["mark"]: r["n"] for r in known.groupBy("mark").agg(F.count("*").alias("n")).collect()}  # of the marks asked for
    part = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30))
    keep = F.lit(False)
    for mark, n in counts.items():
        keep = keep | ((F.col("mark") == mark) & (part < int(min(1.0, bound / n) * (1 << 30))))
    out = known.where(keep)
    out._llm_path = known._llm_path  # for discard
    return out


def collected(found: DataFrame, bytes_bound: int) -> pa.Table:
    """The rows (id, found, ...) of a bounded sample, fewer of them where their
    ``found`` would hold over ``bytes_bound`` bytes in all. They are computed
    once, in the shared folder."""
    kept = written(found, "sample-found")
    total = kept.agg(F.sum(F.octet_length("found"))).first()[0] or 0
    rows = kept
    if total > bytes_bound:
        part = F.pmod(F.xxhash64("id", F.lit("bytes")), F.lit(1 << 30))
        rows = kept.where((part < int(bytes_bound / total * (1 << 30))) & (F.octet_length("found") <= bytes_bound))
    table = rows.drop("id").toArrow()
    discard(kept)
    return table
