"""Spark rule expressions against plain-Python restatements of the rules
(Python's `re` is the regex engine the rules were written for)."""

import json
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from jobsift.operators import scoring
from jobsift.params import (SENIORITY_PATTERNS, YEARS_EXPERIENCE_PATTERN, YEARS_PLUS_PATTERN,
                            YEARS_RANGE_PATTERN)

TOKENS = ["3", "10", "07", "5", "year", "years", "Years", "to", "-", "+", "of", "experience", "exp", "EXP",
          "python", "hands-on", "café", "naïve", "équipe", " ", "  ", "\t", " ", "\n", ".", ",", "(", "senior",
          "sr.", "jr", "mid-level", "staff", "vp", "associate", "entry level", "principal", "ésenior", "_"]


def py_required_years(desc):
    d = (desc or "").lower()
    vals = [float(hi) for _, hi in re.findall(YEARS_RANGE_PATTERN, d)]
    vals += [float(n) for n in re.findall(YEARS_PLUS_PATTERN, d)]
    vals += [float(n) for n in re.findall(YEARS_EXPERIENCE_PATTERN, d)]
    return max(vals) if vals else None


def py_level(title):
    t = title.lower()
    for pat, level in SENIORITY_PATTERNS:
        if re.search(pat, t):
            return level
    return None


texts = st.lists(st.lists(st.sampled_from(TOKENS), min_size=0, max_size=25).map(lambda ts: "".join(
    t if t in (" ", "  ", "\t", " ", "\n", "-", "+", ".", ",", "(") else f" {t}" for t in ts)),
    min_size=1, max_size=40)


@settings(max_examples=6, deadline=None)
@given(texts)
def test_required_years_matches_python(spark, batch):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(batch)], "i int, t string")
    got = {r.i: r.y for r in df.select("i", scoring.required_years("t").alias("y")).collect()}
    assert got == {i: py_required_years(t) for i, t in enumerate(batch)}


@settings(max_examples=6, deadline=None)
@given(texts)
def test_seniority_level_matches_python_on_ascii_boundaries(spark, batch):
    # Word boundaries next to non-ASCII letters differ between regex engines;
    # titles are compared where a boundary cannot touch a non-ASCII letter.
    batch = [t for t in batch if not re.search(r"[^\x00-\x7f]", t)] or ["senior engineer"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(batch)], "i int, t string")
    got = {r.i: r.l for r in df.select("i", scoring.seniority_level("t").alias("l")).collect()}
    assert got == {i: py_level(t) for i, t in enumerate(batch)}


SCORES = [85, 85.7, "85", "85.7", " 42 ", None, True, False, [1], {"a": 1}, -3, 1e3]


def py_parse(raw):
    try:
        r = raw.strip()
        if r.startswith("```"):
            r = r.split("```")[1]
            if r.startswith("json"):
                r = r[4:]
        data = json.loads(r)
        return int(data.get("match_score", 0)), list(data.get("match_reasons", []))
    except Exception:  # noqa: BLE001
        return 0, []


answers = st.builds(
    lambda score, has, reasons, fence: (("```json\n" if fence else "") + json.dumps(
        ({"match_score": score} if has else {}) | {"match_reasons": reasons}) + ("\n```" if fence else "")),
    st.sampled_from(SCORES), st.booleans(), st.lists(st.sampled_from(["a", "b", "c"]), max_size=3), st.booleans())


@settings(max_examples=6, deadline=None)
@given(st.lists(answers, min_size=1, max_size=30))
def test_parse_response_matches_python(spark, batch):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(batch)], "i int, raw string")
    got = {r.i: (r.match_score, list(r.match_reasons)) for r in scoring.parse_response(df, "raw").collect()}
    assert got == {i: py_parse(t) for i, t in enumerate(batch)}
