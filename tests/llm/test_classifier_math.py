"""Risk and gradient of the toxicity classifier, and the forward pass of the
quality network, against naive restatements; and what both are fitted on."""

import math

import numpy as np
import pytest

from jobsift.llm import quality_cnn as Q
from jobsift.llm import sampling
from jobsift.llm import toxicity as X


# --- 1: the non-negative risk

def naive_risk(w, positive, unlabelled, prior):
    logit = lambda row: sum(a * b for a, b in zip(row, w)) + w[-1]
    s = lambda row: 1 / (1 + math.exp(-logit(row)))
    mean = lambda values: sum(values) / len(values)
    as_toxic = mean([-math.log(s(r)) for r in positive])
    rest = mean([-math.log(1 - s(r)) for r in unlabelled]) - prior * mean([-math.log(1 - s(r)) for r in positive])
    return prior * as_toxic + max(0.0, rest), rest


@pytest.mark.parametrize("seed", range(6))
def test_risk_and_gradient_are_those_of_the_formula(seed):
    rng = np.random.default_rng(seed)
    p, u, w = (rng.random((9, 5)) < 0.5).astype(float), (rng.random((30, 5)) < 0.3).astype(float), rng.normal(size=6)
    prior = 0.3 if seed % 2 else 0.9
    if not seed % 2:
        u, w = u * 0, np.abs(w) + 1  # positives explain more than the unlabelled text costs: the corrected part is cut off at 0
    value, grad = X.risk(w, p, u, prior)
    want, rest = naive_risk(w, p, u, prior)
    assert abs(value - want) < 1e-9 and (seed % 2 == 1 or rest < 0)
    for j in range(6):
        step = np.zeros(6)
        step[j] = 1e-6
        slope = (naive_risk(w + step, p, u, prior)[0] - naive_risk(w - step, p, u, prior)[0]) / 2e-6
        assert abs(grad[j] - slope) < 1e-5


def test_the_unlabelled_set_holds_all_text(spark, monkeypatch):
    """Confirmed rows are part of it, so that its share of them is the prior."""
    seen = {}
    monkeypatch.setattr(X, "fit_nnpu", lambda p, u, prior: seen.update(p=len(p), u=len(u), prior=prior))
    docs = spark.createDataFrame([(i, f"word{i} text") for i in range(40)] + [(3, "again"), (99, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 6)) for i in range(20)] + [(2, 0), (1000, 1), (None, 1)], "doc_id long, toxic int")
    from pyspark.sql import functions as F
    X.train(docs, labels, F.lit(True))
    assert seen == {"p": 7, "u": 42, "prior": pytest.approx(8 / 22)}
    X.train(docs, labels, F.col("id") < 10)
    assert seen["p"] == 7 and seen["u"] == 11 and seen["prior"] == pytest.approx(0.6)


def test_even_odds_score_the_threshold():
    model = X.Model(np.array([5], np.int32), np.array([1.0]), 0.0)
    assert model.scorer()("") == pytest.approx(X.THRESHOLD)


# --- 6: the network

def naive_score(net, text):
    data = (text or "").encode("utf-8", "replace")
    values, start = [], 0
    while True:  # chunks every STEP bytes until one reaches the end
        chunk = data[start: start + Q.CHUNK]
        padded = chunk + bytes(Q.CHUNK - len(chunk))
        pooled = [max(sum(float(net.filters[k][padded[at + k]][f]) for k in range(Q.WIDTH)) for at in range(Q.CHUNK - Q.WIDTH + 1))
                  for f in range(Q.FILTERS)]
        pooled.append(sum(b != 0 for b in padded) / Q.CHUNK)
        hidden = [max(0.0, sum(pooled[i] * float(net.w1[i][h]) for i in range(len(pooled))) + float(net.b1[h])) for h in range(Q.HIDDEN)]
        values.append(sum(h * float(w) for h, w in zip(hidden, net.w2)))
        if start + Q.CHUNK >= len(data):
            break
        start += Q.STEP
    a, b, c, d = (float(x) for x in net.combine)
    z = a * max(values) + b * min(values) + c * sum(values) / len(values) + d
    return 1 / (1 + math.exp(-z))


def test_scores_are_those_of_naive_convolution_and_pooling():
    rng = np.random.default_rng(3)
    some = lambda n: Q.chunks("".join(chr(rng.integers(32, 1200)) for _ in range(n)))
    net = Q.fit_network([some(n) for n in (40, 900, 2000)], [some(n) for n in (10, 500, 1500)])
    texts = [None, "", "a", "x" * Q.CHUNK, "y" * (Q.CHUNK + 1), "Ünï 🙂 " * 150, "line\n" * 300]
    assert np.allclose(net.score_many(texts), [naive_score(net, t) for t in texts], atol=1e-5)


def test_all_chunks_of_a_long_text_are_learnt_from(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(Q, "fit_network", lambda good, bad: seen.update(good=sorted(map(len, good)), bad=sorted(map(len, bad))))
    docs = spark.createDataFrame([(1, "x" * 50_000), (2, "short"), (3, "y" * 1000), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 0), (9, 1), (2, None)], "doc_id long, quality int")
    from pyspark.sql import functions as F
    Q.train(docs, labels, F.lit(True))
    assert seen == {"good": [1, len(Q.chunks("x" * 50_000))], "bad": [1, len(Q.chunks("y" * 1000))]}


def test_samples_are_bounded_in_rows_and_bytes(spark):
    ids = spark.range(2000)
    marks = ids.selectExpr("id", "cast(id % 2 as int) as mark").where("id < 1500")
    got = sampling.picked(ids, marks, 100)
    counts = {r["mark"]: r["count"] for r in got.groupBy("mark").count().collect()}
    assert all(60 < n < 140 for n in counts.values()) and got.select("id").distinct().count() == got.count()
    assert sorted(got.collect()) == sorted(sampling.picked(ids, marks, 100).collect())
    found = ids.selectExpr("id", "cast(repeat('x', 100) as binary) as found")
    assert sampling.collected(found, 1 << 20).num_rows == 2000
    assert 300 < sampling.collected(found, 50_000).num_rows < 700
