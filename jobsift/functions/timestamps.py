"""Timestamp parsing and age columns (all JVM-side expressions).

Timestamps are UTC instants (session zone UTC); naive inputs are read as UTC.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import RELATIVE_DIALECTS, UNIT_SECONDS

ISO_GUARD = r"^\d{4}-\d{2}-\d{2}"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def run_ts_lit(run_ts: str) -> Column:
    return F.to_timestamp(F.lit(run_ts))


def parse_iso(c) -> Column:
    """ISO-8601 text -> timestamp; 'Z' and offsets allowed; anything else NULL.

    Spark's string cast accepts a bare year and rejects basic-format dates,
    so a calendar-date guard keeps the accepted set to real ISO dates.
    """
    s = _col(c)
    return F.when(s.rlike(ISO_GUARD), s.try_cast("timestamp"))


def parse_epoch_seconds(c) -> Column:
    """Epoch seconds -> timestamp; 0 or missing -> NULL."""
    s = _col(c).cast("bigint")
    return F.timestamp_seconds(F.nullif(s, F.lit(0)))


def parse_rfc822(c) -> Column:
    """Feed dates such as 'Wed, 31 Jan 2024 10:00:00 +0000' (or a zone name)."""
    s = F.trim(F.regexp_replace(_col(c), r"^\s*[A-Za-z]{3},\s*", ""))
    return F.coalesce(
        F.try_to_timestamp(s, F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(s, F.lit("d MMM yyyy HH:mm:ss z")),
        F.try_to_timestamp(s, F.lit("d MMM yyyy HH:mm Z")),
    )


def feed_date(published, updated) -> Column:
    """Published date, else updated date."""
    return F.coalesce(parse_rfc822(published), parse_rfc822(updated))


def relative_pattern(dialect: str) -> str:
    units, needs_ago = RELATIVE_DIALECTS[dialect]
    unit_alt = "|".join(units)
    return rf"(\d+)\s*({unit_alt})s?\s+ago" if needs_ago else rf"(\d+)\s*({unit_alt})"


def parse_relative(c, dialect: str, run_ts: str) -> Column:
    """'n unit ago' text -> run_ts minus n units; no match -> NULL."""
    text = F.lower(_col(c))
    if dialect == "builtin":
        text = F.trim(text)
    pat = relative_pattern(dialect)
    n = F.regexp_extract(text, pat, 1).try_cast("bigint")
    unit = F.regexp_extract(text, pat, 2)
    secs = None
    for u in RELATIVE_DIALECTS[dialect][0]:
        secs = (F.when(unit == u, F.lit(UNIT_SECONDS[u])) if secs is None
                else secs.when(unit == u, F.lit(UNIT_SECONDS[u])))
    delta = n * secs
    return F.when(F.length(unit) > 0,
                  F.timestamp_micros(F.unix_micros(run_ts_lit(run_ts)) - delta * F.lit(1_000_000)))


def parse_relative_by_source(c, source_col, run_ts: str) -> Column:
    """Relative dialect chosen per row from the board name."""
    expr = None
    for dialect in RELATIVE_DIALECTS:
        branch = parse_relative(c, dialect, run_ts)
        expr = (F.when(_col(source_col) == dialect, branch) if expr is None
                else expr.when(_col(source_col) == dialect, branch))
    return expr


def posted_at_card(datetime_attr, time_text, card_text, run_ts: str) -> Column:
    """List-board precedence: time@datetime, else time text, else the whole card text."""
    rel_src = F.coalesce(F.nullif(_col(time_text), F.lit("")), _col(card_text))
    return F.coalesce(parse_iso(F.nullif(_col(datetime_attr), F.lit(""))),
                      parse_relative(rel_src, "linkedin", run_ts))


def posted_at_startup(has_time, datetime_attr, time_text, date_text, run_ts: str) -> Column:
    """Startup-board precedence: a time element (attribute or text, ISO then
    relative), else a date-like element's relative text."""
    iso_src = F.coalesce(F.nullif(_col(datetime_attr), F.lit("")), _col(time_text))
    with_time = F.coalesce(parse_iso(iso_src), parse_relative(time_text, "workatastartup", run_ts))
    return F.when(_col(has_time), with_time).otherwise(
        parse_relative(date_text, "workatastartup", run_ts))


def age_hours(posted_at, run_ts: str) -> Column:
    """(run_ts - posted_at) in hours as a double; NULL when unknown."""
    micros = F.unix_micros(run_ts_lit(run_ts)) - F.unix_micros(_col(posted_at))
    return micros / F.lit(1_000_000.0) / F.lit(3600.0)


def window_cutoff(run_ts: str, hours: float) -> _dt.datetime:
    """Oldest instant still inside the posting window (driver-side constant,
    so the comparison reaches the Parquet scan as a pushed filter)."""
    base = _dt.datetime.fromisoformat(run_ts)
    return base - _dt.timedelta(hours=hours)


def format_ts(c) -> Column:
    return F.date_format(_col(c), "yyyy-MM-dd HH:mm:ss.SSSSSS")
