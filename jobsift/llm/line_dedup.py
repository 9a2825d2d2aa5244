"""Line de-duplication by site-relative frequency.

Pages are grouped by host. For every line the number of the host's pages that
contain it is divided by the host's page total; a line whose share exceeds
RATIO (and that stands on at least MIN_PAGES pages, as the share says nothing
on a host of two pages) is boilerplate of that host and dropped from all its
pages. Lines are compared without white space at their ends, blank lines are
never counted or dropped, and a line counts once for a page.

Identical pages of a host count as one page: a page that was copied a
thousand times is a matter for near-duplicate removal and must not make its
own text boilerplate.

Only DataFrame functions are used. Counting moves hashes of lines and pages,
never texts, and sums them before the shuffle, so neither a hot host nor a
common line lands in one task. The lists of boilerplate are written before they
meet the texts, so their size is known: up to LISTED lines in all they are
broadcast and no text is shuffled; beyond that they meet in a join salted by
SALTS, drawn from whole rows, so copies of a text part by their ids. Two
different lines of one host share a 64-bit hash with a chance that is negligible
beside the number of its boilerplate lines.

Cases: a null text stays null and has no line; a page of only boilerplate
keeps an empty text; a null host is a site of its own; repeated rows stay,
each cleaned; an empty table gives an empty result; other columns are carried
unchanged and cannot clash, as internal columns have the prefix ``_llm_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import written

RATIO = 0.01
MIN_PAGES = 5
SALTS = 64
#: Boilerplate lines of all hosts, 8 bytes each and a host's name, that are broadcast at most.
LISTED = 1 << 20
SPACE = " \t\n\v\f\r"


def _key(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE))


def _hash(line: Column) -> Column:
    """Hash of a line's text; null for a blank line."""
    return F.when(_key(line) != "", F.xxhash64(_key(line)))


def _site(host: Column) -> Column:
    return F.when(host.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), host.cast("string")))


def _salt(pages: DataFrame) -> Column:
    """A number below SALTS from all columns of a row that can be hashed."""
    known = [F.col(f"`{f.name}`") for f in pages.schema.fields
             if not any(kind in f.dataType.simpleString() for kind in ("map<", "variant"))]
    return F.pmod(F.xxhash64(*known, F.lit("salt")), F.lit(SALTS)).cast("int")


def boilerplate(pages: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO,
                min_pages: int = MIN_PAGES) -> DataFrame:
    """(_llm_site, _llm_lines): hashes of each host's boilerplate lines. There
    are at most (lines of a page) / ratio of them for a host."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # the same text gives the same lines, so any row stands for its copies
    distinct = pages.select(
        _site(F.col(host_col)).alias("_llm_site"), F.xxhash64(text, F.length(text)).alias("_llm_page"),
        F.array_distinct(F.array_compact(F.transform(F.split(text, "\n"), _hash))).alias("_llm_lines")).groupBy(
        "_llm_site", "_llm_page").agg(F.first("_llm_lines").alias("_llm_lines"))
    # the page total of a host travels as the count of a line that no page has
    counts = distinct.select("_llm_site", F.explode(F.array_append("_llm_lines", F.lit(None).cast("long"))).alias(
        "_llm_line")).groupBy("_llm_site", "_llm_line").agg(F.count("*").alias("_llm_n"))
    often = counts.where((F.col("_llm_line").isNull()) | (F.col("_llm_n") >= min_pages))
    total = often.where("_llm_line is null").select("_llm_site", F.col("_llm_n").alias("_llm_total"))
    return often.where("_llm_line is not null").join(total, "_llm_site").where(
        F.col("_llm_n") > ratio * F.col("_llm_total")).groupBy("_llm_site").agg(
        F.collect_set("_llm_line").alias("_llm_drop"))


def clean(pages: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO,
          min_pages: int = MIN_PAGES) -> DataFrame:
    """``pages`` with ``_llm_clean`` (the text without boilerplate lines),
    ``_llm_n_lines`` (its lines that are not blank) and ``_llm_n_dropped``."""
    found = written(boilerplate(pages, host_col, text_col, ratio, min_pages), "line-lists")
    size = found.agg(F.sum(F.size("_llm_drop")).alias("lines"), F.sum(F.octet_length("_llm_site")).alias("names")).first()
    rows = pages.withColumn("_llm_site", _site(F.col(host_col)))
    if 8 * (size["lines"] or 0) + (size["names"] or 0) <= 8 * LISTED:
        joined = rows.join(F.broadcast(found), "_llm_site", "left")
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_llm_salt")
        joined = rows.withColumn("_llm_salt", _salt(pages)).join(
            found.select("_llm_site", "_llm_drop", salts), ["_llm_site", "_llm_salt"], "left").drop("_llm_salt")
    # each line once with its hash
    joined = joined.withColumn("_llm_lines", F.transform(
        F.split(text_col, "\n"), lambda x: F.struct(x.alias("line"), _hash(x).alias("hash"))))
    hashes = F.transform("_llm_lines", lambda x: x["hash"])
    none = F.array().cast("array<bigint>")
    joined = joined.withColumn("_llm_drop", F.coalesce(F.array_intersect(
        F.array_compact(hashes), F.coalesce("_llm_drop", none)), none))
    # only a page that has such lines is taken apart
    gone = lambda x: F.coalesce(F.array_contains("_llm_drop", x["hash"]), F.lit(False))
    stays = F.transform(F.filter("_llm_lines", lambda x: ~gone(x)), lambda x: x["line"])
    text = F.when(F.size("_llm_drop") == 0, F.col(text_col)).otherwise(F.array_join(stays, "\n"))
    count = lambda test: F.coalesce(F.size(F.filter("_llm_lines", test)), F.lit(0))
    n_lines = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(count(lambda x: x["hash"].isNotNull()))
    n_dropped = F.when(F.col(text_col).isNull() | (F.size("_llm_drop") == 0), F.lit(0)).otherwise(count(gone))
    return joined.withColumns({"_llm_clean": text, "_llm_n_lines": n_lines, "_llm_n_dropped": n_dropped}).drop(
        "_llm_site", "_llm_lines", "_llm_drop")


def cleaned(pages: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO,
            min_pages: int = MIN_PAGES) -> DataFrame:
    """``pages`` with the cleaned text in place, same columns."""
    return clean(pages, host_col, text_col, ratio, min_pages).withColumn(text_col, F.col("_llm_clean")).select(
        *[F.col(f"`{c}`") for c in pages.columns])
