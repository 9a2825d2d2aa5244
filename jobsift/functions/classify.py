"""Work type, employment type, salary and location columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import EMPLOYMENT_TYPE_MAP, HOURS_PER_YEAR, STATE_NAMES, WORKSITE_MAP


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _parts(loc) -> Column:
    """Lower-cased, comma-separated location parts with surrounding blanks removed."""
    return F.transform(F.split(F.lower(_col(loc)), ","),
                       lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))


def work_type_from_location(loc) -> Column:
    """Multi-part location -> work type: remote+hybrid -> hybrid, remote, hybrid, else NULL.

    'remote' never spans a comma, so any-part containment equals whole-text containment.
    """
    low = F.lower(_col(loc))
    has_remote, has_hybrid = low.contains("remote"), low.contains("hybrid")
    return (F.when(has_remote & has_hybrid, F.lit("hybrid"))
            .when(has_remote, F.lit("remote"))
            .when(has_hybrid, F.lit("hybrid")))


def work_type_from_text(text) -> Column:
    """Card text -> work type: remote > hybrid > in-person/on-site/onsite > NULL."""
    t = F.lower(_col(text))
    return (F.when(t.contains("remote"), F.lit("remote"))
            .when(t.contains("hybrid"), F.lit("hybrid"))
            .when(t.contains("in-person") | t.contains("on-site") | t.contains("onsite"), F.lit("onsite")))


def location_label_from_text(text, explicit_location) -> Column:
    """Card location label (Remote/Hybrid/Onsite/Unknown) unless an explicit
    location element carries text."""
    wt = work_type_from_text(text)
    label = (F.when(wt == "remote", F.lit("Remote")).when(wt == "hybrid", F.lit("Hybrid"))
             .when(wt == "onsite", F.lit("Onsite")).otherwise(F.lit("Unknown")))
    return F.coalesce(F.nullif(_col(explicit_location), F.lit("")), label)


def worksite_work_type(raw) -> Column:
    """Staffing-board worksite label (exact, lower-cased) -> work type or NULL."""
    r = F.lower(_col(raw))
    expr = None
    for key, val in WORKSITE_MAP:
        expr = F.when(r == key, F.lit(val)) if expr is None else expr.when(r == key, F.lit(val))
    return expr


def remote_flag_work_type(flag) -> Column:
    """Boolean remote flag -> 'remote' or NULL."""
    return F.when(F.coalesce(_col(flag).cast("boolean"), F.lit(False)), F.lit("remote"))


def employment_type_from_text(raw) -> Column:
    """First map key contained in the lower-cased text wins (ordered)."""
    r = F.lower(_col(raw))
    expr = None
    for key, val in EMPLOYMENT_TYPE_MAP:
        expr = F.when(r.contains(key), F.lit(val)) if expr is None else expr.when(r.contains(key), F.lit(val))
    return expr


def format_salary(sal_min, sal_max, currency, period) -> Column:
    """'$lo–$hi CUR / period' with thousands separators and two decimals.

    No minimum or a non-numeric figure -> NULL; a zero or absent maximum is omitted.
    """
    lo = F.nullif(_col(sal_min), F.lit("")).try_cast("double")
    hi = F.nullif(_col(sal_max), F.lit("")).try_cast("double")
    hi_bad = F.nullif(_col(sal_max), F.lit("")).isNotNull() & hi.isNull()
    cur = F.coalesce(F.nullif(_col(currency), F.lit("")), F.lit("USD"))
    per = F.coalesce(_col(period), F.lit(""))
    lo_s = F.concat(F.lit("$"), F.format_number(lo, 2))
    rng = F.when(hi.isNotNull() & (hi != 0), F.concat(lo_s, F.lit("–$"), F.format_number(hi, 2))).otherwise(lo_s)
    text = F.trim(F.concat(rng, F.lit(" "), cur, F.lit(" / "), per))
    return F.when(lo.isNotNull() & ~hi_bad, text)


def salary_low(salary) -> Column:
    """Annualised first figure of a salary text (hourly x 2080 when under 1000).

    The first `$?[digits,]` run is read with separators removed; a run with no
    digit reads as unlisted instead of failing.
    """
    s = _col(salary)
    first = F.get(F.regexp_extract_all(s, F.lit(r"\$?([\d,]+)"), F.lit(1)), 0)
    n = F.regexp_replace(first, ",", "").try_cast("bigint")
    hourly = F.lower(s).contains("hour") & (n < 1000)
    return F.when(hourly, n * HOURS_PER_YEAR).otherwise(n)


def state_name(code) -> Column:
    """State code (any case) -> state name; unknown codes pass through."""
    m = F.create_map(*[x for k, v in STATE_NAMES for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, F.upper(_col(code))), _col(code))


def location_match_parts(loc, city, state, desired_work_type) -> Column:
    """Multi-part location test against one search location.

    Remote requests need a part with 'remote'. Otherwise some non-remote part
    contains the city or ends with the state code, or ', st' appears anywhere.
    """
    low = F.lower(_col(loc))
    c, s = F.lower(_col(city)), F.lower(_col(state))
    part_ok = F.exists(_parts(loc), lambda p: ~p.contains("remote") & (p.contains(c) | p.endswith(s)))
    other = part_ok | low.contains(F.concat(F.lit(", "), s))
    return F.when(_col(desired_work_type) == "remote", low.contains("remote")).otherwise(other)


def location_match_simple(loc, city, state) -> Column:
    """City in the text, or ', st' in the text."""
    low = F.lower(_col(loc))
    return low.contains(F.lower(_col(city))) | low.contains(F.concat(F.lit(", "), F.lower(_col(state))))
