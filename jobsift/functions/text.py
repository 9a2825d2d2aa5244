"""Text columns: tags, ids, URLs, title/company splits, display strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import BOARD_BASE_URLS, JOB_ID_PATTERNS


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_tags(c) -> Column:
    """Every `<...>` tag becomes one space (feed summaries)."""
    return F.regexp_replace(_col(c), r"<[^>]+>", " ")


def job_id_from_href(href, board: str) -> Column:
    """Board id from a link; NULL when the link carries none."""
    return F.nullif(F.regexp_extract(_col(href), JOB_ID_PATTERNS[board], 1), F.lit(""))


def absolute_url(href, board: str) -> Column:
    h = _col(href)
    return F.when(h.startswith("http"), h).otherwise(F.concat(F.lit(BOARD_BASE_URLS[board]), h))


def canonical_url(href, board: str) -> Column:
    """Link -> posting URL. The list board rebuilds the URL from the id."""
    if board == "linkedin":
        jid = job_id_from_href(href, board)
        return F.when(jid.isNotNull(),
                      F.concat(F.lit("https://www.linkedin.com/jobs/view/"), jid)).otherwise(_col(href))
    return absolute_url(href, board)


def split_last_at(text) -> tuple[Column, Column]:
    """'Title at Company' split at the last ' at '; no ' at ' -> (text, '')."""
    t = _col(text)
    m = r"(?s)^(.*) at (.*)$"  # greedy head: the last ' at ' separates
    has = t.contains(" at ")
    title = F.when(has, F.trim(F.regexp_extract(t, m, 1))).otherwise(t)
    company = F.when(has, F.trim(F.regexp_extract(t, m, 2))).otherwise(F.lit(""))
    return title, company


def feed_title(text) -> Column:
    """Feed title: the part before the first ':'."""
    return F.trim(F.split_part(_col(text), F.lit(":"), F.lit(1)))


def feed_company(author, text) -> Column:
    """Feed company: author, else the part after the last ' at '."""
    t = _col(text)
    after = F.when(t.contains(" at "), F.trim(F.element_at(F.split(t, " at "), -1))).otherwise(F.lit(""))
    a = _col(author)
    return F.when(a.isNotNull() & (a != ""), a).otherwise(after)


def truncate(c, n: int) -> Column:
    return F.substring(_col(c), 1, n)


def safe_name(c) -> Column:
    """Every character that is not a letter or digit becomes '_'."""
    return F.regexp_replace(_col(c), r"[^\p{L}\p{N}]", "_")


def age_label(age) -> Column:
    a = _col(age)
    return F.when(a.isNull(), F.lit("unknown")).otherwise(F.format_string("%.1fh ago", a))


def location_label(city, state) -> Column:
    return F.concat(_col(city), F.lit(", "), _col(state))


def blank_to_null(c) -> Column:
    return F.nullif(_col(c), F.lit(""))
