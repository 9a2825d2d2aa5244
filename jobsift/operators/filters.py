"""Posting filters. Each returns a DataFrame; predicates are plain column
expressions so Catalyst can push them below joins and into the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import location_match_parts, location_match_simple, salary_low
from ..functions.timestamps import window_cutoff
from ..params import RunParams, SearchConfig
from .cells import role_terms_col


def in_window(posted_at: str, run: RunParams) -> Column:
    """Unknown dates pass; otherwise age <= posted_within_hours (future dates pass)."""
    cutoff = window_cutoff(run.run_ts, run.posted_within_hours).isoformat(sep=" ")
    # A session-zone literal: constant-folded, so it reaches the scan as a pushed filter.
    return F.col(posted_at).isNull() | (F.col(posted_at) >= F.to_timestamp(F.lit(cutoff)))


def window_filter(df: DataFrame, run: RunParams, posted_at: str = "posted_at",
                  server_side_boards: tuple[str, ...] = ("linkedin",)) -> DataFrame:
    """Time window, not applied to boards that filter server-side."""
    keep = in_window(posted_at, run)
    if server_side_boards and "source" in df.columns:
        keep = keep | F.col("source").isin(list(server_side_boards))
    return df.filter(keep)


def title_matches(title: str, terms: Column) -> Column:
    low = F.lower(F.col(title))
    return F.exists(terms, lambda t: low.contains(t))


def title_relevance(df: DataFrame, cfg: SearchConfig, title: str = "title", with_eng: bool = False) -> DataFrame:
    """Role title or any role keyword is a substring of the lower-cased title;
    ``with_eng`` also accepts general engineering words."""
    return df.filter(title_matches(title, role_terms_col(cfg, with_eng=with_eng)))


def location_parts_filter(df: DataFrame, loc: str = "location") -> DataFrame:
    """Multi-part location test against the row's search cell (city, state, work_type)."""
    return df.filter(location_match_parts(loc, "city", "state", "work_type"))


def location_simple_filter(df: DataFrame, loc: str = "location", mapped_wt: str = "mapped_work_type") -> DataFrame:
    """City or ', st' test; remote postings bypass it."""
    remote = F.coalesce(F.col(mapped_wt) == "remote", F.lit(False))
    return df.filter(remote | location_match_simple(loc, "city", "state"))


def work_type_match(df: DataFrame, mapped_wt: str = "mapped_work_type", requested: str = "work_type") -> DataFrame:
    """A known work type different from the requested one drops the row."""
    return df.filter(F.col(mapped_wt).isNull() | (F.col(mapped_wt) == F.col(requested)))


def salary_ok(salary: str, run: RunParams) -> Column:
    sal = run.salary
    if sal.min is None and sal.max is None:
        return F.lit(True)
    s = F.col(salary)
    low = salary_low(s)
    unlisted = s.isNull() | (s == "") | low.isNull()
    ok = F.lit(True)
    if sal.skip_if_below_min and sal.min:
        ok = ok & ~(low < F.lit(sal.min))
    if sal.max:
        ok = ok & ~(low > F.lit(sal.max))
    return F.when(unlisted, F.lit(bool(sal.include_unlisted))).otherwise(ok)


def salary_filter(df: DataFrame, run: RunParams, salary: str = "salary") -> DataFrame:
    return df.filter(salary_ok(salary, run))


def company_ok(company: str, run: RunParams) -> Column:
    terms = run.blacklist_terms
    if not terms:
        return F.lit(True)
    low = F.lower(F.col(company))
    return ~F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: low.contains(t))


def company_blacklist(df: DataFrame, run: RunParams, company: str = "company") -> DataFrame:
    return df.filter(company_ok(company, run))


def employment_ok(emp: str, run: RunParams) -> Column:
    if not run.employment_types:
        return F.lit(True)
    return F.col(emp).isNull() | F.col(emp).isin(list(run.employment_types))


def employment_filter(df: DataFrame, run: RunParams, emp: str = "employment_type") -> DataFrame:
    return df.filter(employment_ok(emp, run))


def prefilter(df: DataFrame, run: RunParams) -> DataFrame:
    """Cheap filters placed before any scoring: salary, company, employment type."""
    return df.filter(salary_ok("salary", run) & company_ok("company", run) & employment_ok("employment_type", run))


def required_fields(df: DataFrame, *cols: str) -> DataFrame:
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull() & (F.col(c) != "")
    return df.filter(cond)
