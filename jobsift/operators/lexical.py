"""Scoring hook and a lexical resume match.

``score_with`` is where a real model scorer plugs in: a batch function over
pandas frames run by ``mapInPandas`` after all cheap filters, with
per-partition initialisation; a row that fails scores zero and says why.

``lexical_match`` is a stand-in scorer: TF-IDF weights over whole descriptions
and resumes, and the cosine of each landed (posting, role) pair. It is not the
same number a language model would produce.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

TOKEN = r"[\p{L}\p{N}]+"
#: Document frequencies are counted for this many hash values of terms, so
#: their number is fixed whatever the corpus.
BUCKETS = 1 << 16


def score_with(df: DataFrame, make_scorer: Callable[[], Callable[[pd.DataFrame], pd.Series]],
               cols: list[str]) -> DataFrame:
    """Append ``raw`` (the scorer's answer text) and ``error`` to every row.

    ``make_scorer`` is called once per partition (model load, client setup);
    the returned function maps a pandas frame of ``cols`` to answer strings.
    If a batch fails, its rows are scored one by one; a row that fails has a
    NULL answer, which parses to score 0, and the message in ``error``.
    """
    out_schema = T.StructType(df.select(*cols).schema.fields + [T.StructField("raw", T.StringType()),
                                                                T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for pdf in batches:
            errors: list[str | None] = [None] * len(pdf)
            try:
                raw = list(scorer(pdf))
            except Exception:  # noqa: BLE001 - find the rows that fail
                raw = []
                for i in range(len(pdf)):
                    try:
                        raw.append(scorer(pdf.iloc[i:i + 1]).iloc[0])
                    except Exception as e:  # noqa: BLE001 - a failed call scores 0
                        raw.append(None)
                        errors[i] = f"{type(e).__name__}: {e}"[:500]
            raw = [None if pd.isna(x) else x for x in raw]
            yield pdf.assign(raw=pd.Series(raw, index=pdf.index, dtype=object),
                             error=pd.Series(errors, index=pdf.index, dtype=object))

    return df.select(*cols).mapInPandas(run, out_schema)


def keyword_scorer():
    """Demo scorer: share of the role's terms found in the description."""
    import json

    def score(pdf: pd.DataFrame) -> pd.Series:
        out = []
        for desc, terms in zip(pdf["description"], pdf["role_terms"]):
            text = (desc or "").lower()
            hits = [t for t in (terms if terms is not None else []) if t and t in text]
            n = len(terms) if terms is not None and len(terms) else 1
            out.append(json.dumps({"match_score": round(100 * len(hits) / n), "match_reasons": hits}))
        return pd.Series(out, index=pdf.index)
    return score


def _bucket(term: str) -> int:
    return int(hashlib.md5(term.encode()).hexdigest()[:4], 16)


def document_frequencies(postings: DataFrame, text: str) -> tuple[int, dict[int, int]]:
    """Number of postings, and of postings with a term of each hash value: one
    partial aggregation of at most BUCKETS + 1 rows for each task."""
    terms = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(TOKEN), F.lit(0)))
    hashed = F.array_distinct(F.transform(terms, lambda t: F.conv(F.substring(F.md5(t.cast("binary")), 1, 4), 16, 10).cast("int")))
    counts = postings.select(F.explode(F.array_append(hashed, F.lit(-1))).alias("b")).groupBy("b").agg(
        F.count(F.lit(1)).alias("n")).toArrow()
    found = dict(zip(counts.column("b").to_pylist(), counts.column("n").to_pylist()))
    return found.pop(-1, 0), found


def term_counts(corpus: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf): a posting's terms and how often it has them. Counted
    within a row, so nothing is shuffled."""
    tokens = F.array_sort(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(TOKEN), F.lit(0)))
    # in sorted tokens a term ends where the next differs; the distance between ends is its count
    ends = F.filter(F.sequence(F.lit(1), F.size("_t")), lambda i: (i == F.size("_t")) | (F.get("_t", i) != F.get("_t", i - 1)))
    runs = F.transform("_e", lambda e, at: F.struct(F.get("_t", e - 1).alias("term"), (
        e - F.coalesce(F.get("_e", at - 1), F.lit(0))).cast("long").alias("tf")))
    return (corpus.select(key, tokens.alias("_t")).filter(F.size("_t") > 0).withColumn("_e", ends)
                  .select(key, F.explode(runs).alias("_r")).select(key, "_r.term", "_r.tf"))


#: Terms that stand for more than one in this many (posting, term) pairs take
#: their idf from a broadcast; they are that many at most.
COMMON = 100_000


def lexical_match(landed: DataFrame, corpus: DataFrame, resumes: DataFrame, key: str = "seq",
                  text: str = "description") -> DataFrame:
    """(role_id, key, lexical_score 0..100) of every landed (posting, role)
    row: the cosine of TF-IDF vectors (0 without a shared term), with
    idf(t) = ln((N + 1) / (df(t) + 1)) and df(t) counted exactly over ``corpus``
    (one row a key).

    A posting's terms are counted within its row and written once, narrow.
    Frequencies are summed before their shuffle. Common terms (COMMON) take
    their idf from a broadcast, so the shuffle by term that gives the others
    theirs has no large group and few of the pairs. Resume vectors (one per
    role, bounded by configuration) meet the pairs by term, and sums by posting
    are made in the tasks first.
    """
    n = corpus.count()
    pairs = materialize(term_counts(corpus.select(key, text), key, text), "term-counts")
    frequency = materialize(pairs.groupBy("term").agg(F.count("*").alias("df")), "term-frequencies")
    total = frequency.agg(F.sum("df")).first()[0] or 0
    idf = F.log(F.lit(float(n + 1)) / (F.coalesce("df", F.lit(0)) + 1))
    known = frequency.select("term", idf.alias("idf"), (F.col("df") * COMMON > total).alias("common"))
    common = F.broadcast(known.filter("common").select("term", "idf"))
    weighed = pairs.join(common, "term").unionByName(
        pairs.join(common.select("term"), "term", "left_anti").join(known.filter("NOT common").select("term", "idf"), "term"))
    weighed = weighed.select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    own = term_counts(resumes.select("role_id", "resume_text"), "role_id", "resume_text").join(
        frequency, "term", "left").select("role_id", "term", (F.col("tf") * idf).alias("rw"))
    own = materialize(own, "resume-terms")
    norms = weighed.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    lengths = own.groupBy("role_id").agg(F.sqrt(F.sum(F.col("rw") * F.col("rw"))).alias("length"))
    dots = weighed.join(own, "term").groupBy("role_id", key).agg(F.sum(F.col("w") * F.col("rw")).alias("dot"))
    cosine = F.try_divide(F.col("dot"), F.col("size") * F.col("length"))
    scores = dots.join(norms, key).join(lengths, "role_id").select(
        "role_id", key, F.bround(F.lit(100) * F.coalesce(cosine, F.lit(0.0))).cast("int").alias("_s"))
    return landed.select("role_id", key).join(scores, ["role_id", key], "left").select(
        "role_id", key, F.coalesce("_s", F.lit(0)).alias("lexical_score"))


def lexical_match_hashed(landed: DataFrame, corpus: DataFrame, resumes: DataFrame, key: str = "seq",
                         text: str = "description") -> DataFrame:
    """``lexical_match`` without a shuffle, for one pass over landed rows where
    approximate scores do: df(t) is the number of postings that hold any term of
    t's hash value (BUCKETS), not t alone, so rare terms weigh less once the
    vocabulary is larger than that.

    The fixed-size frequencies and the resumes (one per role, bounded by
    configuration) go to the tasks; each row is then scored where it is, with
    no shuffle. Rows of one posting follow each other after the role fan-out,
    so its terms are counted once.
    """
    n_docs, found = document_frequencies(corpus, text)
    roles = {r["role_id"]: r["resume_text"] for r in resumes.select("role_id", "resume_text").collect()}
    shared = landed.sparkSession.sparkContext.broadcast((n_docs, found, roles))

    def run(batches):
        n, frequency, texts = shared.value
        pattern = regex.compile(TOKEN)

        @lru_cache(maxsize=1 << 17)
        def idf(term: str) -> float:
            return math.log((n + 1) / (frequency.get(_bucket(term), 0) + 1))

        def vector(t: str | None) -> dict[str, float]:
            return {w: c * idf(w) for w, c in Counter(pattern.findall((t or "").lower())).items()}

        def norm(v: dict[str, float]) -> float:
            return math.sqrt(math.fsum(x * x for x in v.values()))
        role_vectors = {r: (v, norm(v)) for r, v in ((r, vector(t)) for r, t in texts.items())}
        last, mine, size = object(), {}, 0.0
        for batch in batches:
            scores = []
            for role, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if t != last:
                    last, mine = t, vector(t)
                    size = norm(mine)
                other, length = role_vectors.get(role, ({}, 0.0))
                dot = math.fsum(x * mine[w] for w, x in other.items() if w in mine)
                scores.append(round(100 * dot / (size * length)) if size * length else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.int32())], ["role_id", key, "lexical_score"])

    rows = landed.select("role_id", key, text)
    return rows.mapInArrow(run, T.StructType([rows.schema["role_id"], rows.schema[key],
                                              T.StructField("lexical_score", T.IntegerType())]))
