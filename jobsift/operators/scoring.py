"""Score columns: response parsing, seniority and experience adjustments.

All rules are column expressions over (posting, role) pairs; the role's
level bounds, target years and sigma are columns carried by ``pair_roles``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import (
    DESCRIPTION_ANALYSIS_CHARS, DESCRIPTION_LETTER_CHARS, EXPERIENCE_MAX_PENALTY,
    SENIORITY_IN_RANGE_BONUS, SENIORITY_MAX_PENALTY, SENIORITY_ORDER, SENIORITY_PATTERNS,
    SENIORITY_STEP_PENALTY, YEARS_EXPERIENCE_PATTERN, YEARS_PLUS_PATTERN, YEARS_RANGE_PATTERN,
)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- E2: model response -> score and reasons -------------------------------

def response_body(raw) -> Column:
    """Trim whitespace, take the text inside a leading code fence, drop a 'json' tag."""
    t = F.trim(_col(raw), F.lit(" \n\r\t\f\u000b"))
    fenced = F.split_part(t, F.lit("```"), F.lit(2))
    body = F.when(t.startswith("```"), fenced).otherwise(t)
    return F.when(body.startswith("json"), F.substring(body, 5, 1 << 30)).otherwise(body)


def parse_response(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds match_score (int, 0 on any failure) and match_reasons / gap_reasons
    (empty on any failure, also when the score itself is unusable)."""
    v = F.try_parse_json(response_body(raw))
    present = F.try_variant_get(v, "$.match_score", "variant").isNotNull()
    score = F.try_variant_get(v, "$.match_score", "int")
    ok = v.isNotNull() & F.when(present, score.isNotNull()).otherwise(F.lit(True)) & \
        (F.schema_of_variant(v).startswith("OBJECT"))
    empty = F.array().cast("array<string>")

    def reasons(path: str) -> Column:
        return F.when(ok, F.coalesce(F.try_variant_get(v, path, "array<string>"), empty)).otherwise(empty)

    return (df.withColumn("match_score", F.when(ok, F.coalesce(score, F.lit(0))).otherwise(F.lit(0)))
              .withColumn("match_reasons", reasons("$.match_reasons"))
              .withColumn("gap_reasons", reasons("$.gap_reasons")))


# ---- E5-E9: rule adjustments ------------------------------------------------

def seniority_level(title) -> Column:
    """Level name of a title: the first of five ordered patterns that matches."""
    low = F.lower(_col(title))
    expr = None
    for pat, level in SENIORITY_PATTERNS:
        expr = F.when(low.rlike(pat), F.lit(level)) if expr is None else expr.when(low.rlike(pat), F.lit(level))
    return expr


def level_index(level) -> Column:
    """0-based position in junior..principal, NULL when unknown."""
    pos = F.array_position(F.array(*[F.lit(x) for x in SENIORITY_ORDER]), _col(level))
    return F.when(pos > 0, (pos - 1).cast("int"))


def seniority_adjust(level_idx, lvl_lo, lvl_hi) -> Column:
    """+8 inside the role's level range, -10 per level outside (at most -20);
    0 when the title or the role has no known level."""
    i, lo, hi = _col(level_idx), _col(lvl_lo), _col(lvl_hi)
    dist = F.least(F.abs(i - lo), F.abs(i - hi))
    # least() skips NULLs, so unknown levels are tested first.
    return (F.when(i.isNull() | lo.isNull() | hi.isNull(), F.lit(0))
             .when((i >= lo) & (i <= hi), F.lit(SENIORITY_IN_RANGE_BONUS))
             .otherwise(-F.least(dist * SENIORITY_STEP_PENALTY, F.lit(SENIORITY_MAX_PENALTY)))).cast("int")


def required_years(description) -> Column:
    """Largest year figure over the three phrasings (ranges use the upper end);
    NULL when none. Whole description, lower-cased; Unicode classes as in the
    original tool's regex engine."""
    return required_years_lc(F.lower(F.coalesce(_col(description), F.lit(""))))


def required_years_lc(lowered) -> Column:
    """``required_years`` over text that is already lower-cased."""
    d = _col(lowered)
    ranges = F.regexp_extract_all(d, F.lit("(?U)" + YEARS_RANGE_PATTERN), F.lit(2))
    plus = F.regexp_extract_all(d, F.lit("(?U)" + YEARS_PLUS_PATTERN), F.lit(1))
    exp = F.regexp_extract_all(d, F.lit("(?U)" + YEARS_EXPERIENCE_PATTERN), F.lit(1))
    vals = F.transform(F.concat(ranges, plus, exp), lambda x: x.try_cast("double"))
    # Every phrasing contains "year": texts without it skip the three scans.
    return F.when(d.contains("year"), F.array_max(vals))


def experience_adjust(required, years, sigma) -> Column:
    """round((exp(-0.5 * ((r - t) / s)^2) - 1) * 20), half to even; 0 when no
    requirement is stated or sigma is 0."""
    z = F.try_divide(_col(required) - _col(years), _col(sigma))
    g = F.exp(F.lit(-0.5) * z * z)
    adj = F.bround((g - F.lit(1.0)) * F.lit(float(EXPERIENCE_MAX_PENALTY)), 0)
    return F.coalesce(adj, F.lit(0.0)).cast("int")


def final_score(base, adjustment) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), _col(base) + _col(adjustment))).cast("int")


def posting_features(df: DataFrame, title: str = "title", description: str = "description") -> DataFrame:
    """Role-independent features, computed once per posting (before any role
    fan-out): title level and required years. The lower-cased description is
    its own projection so the three scans share it."""
    lowered = df.withColumn("_desc_lc", F.lower(F.coalesce(F.col(description), F.lit(""))))
    return (lowered.withColumns({"job_level": seniority_level(title),
                                 "required_years": required_years_lc("_desc_lc")})
                   .drop("_desc_lc"))


def adjust_scores(df: DataFrame, base: str = "match_score", out: str = "match_score") -> DataFrame:
    """Adds seniority_adj, experience_adj and the clamped final score (and the
    posting features when absent). Expects role columns lvl_lo, lvl_hi, years, sigma."""
    if "required_years" not in df.columns or "job_level" not in df.columns:
        df = posting_features(df)
    adj = df.withColumns({
        "seniority_adj": seniority_adjust(level_index("job_level"), "lvl_lo", "lvl_hi"),
        "experience_adj": experience_adjust("required_years", "years", "sigma"),
    })
    return adj.withColumn(out, final_score(base, F.col("seniority_adj") + F.col("experience_adj")))


# ---- E1: prompts -------------------------------------------------------------

ANALYSIS_TEMPLATE = (
    "Compare the candidate resume with the job posting and rate the fit.\n\n"
    "RESUME:\n{resume}\n\nPOSTING:\nTitle: {title}\nCompany: {company}\nDescription:\n{description}\n\n"
    "Answer with JSON only: match_score (integer 0-100), match_reasons (up to 4 strings), "
    "gap_reasons (up to 3 strings), recommendation (apply or skip), summary (one sentence)."
)
LETTER_TEMPLATE = (
    "Write a three-paragraph cover letter for this posting.\n\n"
    "RESUME:\n{resume}\n\nPOSTING:\nTitle: {title}\nCompany: {company}\nDescription:\n{description}\n\n"
    "CANDIDATE:\nName: {name}\nEmail: {email}\n\nReturn only the letter text."
)
SUMMARY_TEMPLATE = "Summarise this resume in under 200 words.\n\nRESUME:\n{resume}\n"


def render(template: str, **cols: Column) -> Column:
    """Fill ``{name}`` slots of a template with columns (JVM-side concat)."""
    import re
    parts = re.split(r"(\{[a-z_]+\})", template)
    pieces = []
    for p in parts:
        if p.startswith("{") and p.endswith("}") and p[1:-1] in cols:
            pieces.append(F.coalesce(cols[p[1:-1]], F.lit("")))
        elif p:
            pieces.append(F.lit(p))
    return F.concat(*pieces)


def with_summary_prompt(resumes: DataFrame) -> DataFrame:
    """Resumes with their ``summary_prompt``: once per role, not per posting."""
    return resumes.withColumn("summary_prompt", render(SUMMARY_TEMPLATE, resume=F.col("resume_text")))


def render_prompts(df: DataFrame, contact_name: str = "", contact_email: str = "") -> DataFrame:
    """Analysis and letter prompts per (posting, role) that is still to be
    scored; descriptions cut to the context guards (4000 / 3000 characters)."""
    return (df.withColumn("analysis_prompt", render(
                ANALYSIS_TEMPLATE, resume=F.col("resume_text"), title=F.col("title"), company=F.col("company"),
                description=F.substring("description", 1, DESCRIPTION_ANALYSIS_CHARS)))
              .withColumn("letter_prompt", render(
                LETTER_TEMPLATE, resume=F.col("resume_text"), title=F.col("title"), company=F.col("company"),
                description=F.substring("description", 1, DESCRIPTION_LETTER_CHARS),
                name=F.lit(contact_name), email=F.lit(contact_email))))
