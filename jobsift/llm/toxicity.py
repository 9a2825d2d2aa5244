"""Toxicity by non-negative positive-unlabelled learning.

Linear numpy classifiers over words and word beginnings are trained from
confirmed toxic examples and unlabelled text alone. With class prior p, the
risk of calling text clean is that over the unlabelled text less the part the
positives among it cause, and is kept from falling below zero (Kiryo et al.,
2017):

    risk = p E_P[l(+)] + max(0, E_U[l(-)] - p E_P[l(-)])

A few classifiers, each with its own order of examples, are averaged in the
logit. The score, in [0, 1], is that of the logit shifted so that even odds of
being toxic score THRESHOLD.

The unlabelled text is a sample of all text there is, confirmed rows among it,
so that its share of positives is the class prior: that of the labelled rows.

Fitting reads a bounded sample (MAX_POSITIVE confirmed and MAX_UNLABELLED rows
of all, about; fewer where their features hold over MAX_BYTES); scoring reads
every whole text. A word counts once per
document (and a beginning twice at most), so a long text is not judged by its
length.

Cases: null and empty texts have no feature and the score of the bias alone;
without any positive example, or without text, every score is 0; repeated
rows are scored alike; an empty table gives an empty result; contradicting
labels of one id count as toxic. Only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from .common import discard, slices, small_batches
from .sampling import collected, picked

#: Bounds of the fitting sample, in rows, and in bytes of their features.
MAX_POSITIVE = 3000
MAX_UNLABELLED = 6000
MAX_BYTES = 64 << 20
#: Hashed feature space, and how many features a classifier keeps.
SPACE = 1 << 22
KEPT = 1024
#: How far, in standard errors, a kept feature is commoner among positives.
CLEAR = 6.0
CLASSIFIERS = 3
#: Steps of gradient descent, about, over batches of both kinds of examples.
STEPS = 300
#: First step width, falling to zero, and weight decay.
RATE = 0.05
RIDGE = 3e-4
THRESHOLD = 0.7
EVEN = float(np.log(THRESHOLD / (1 - THRESHOLD)))
#: Lengths of the word beginnings that are features besides the word.
BEGINNINGS = (4, 5)
#: Words whose features a task remembers.
REMEMBERED = 1 << 18
RUN = regex.compile(r"\w+")


def piece_features(piece: str) -> list[int]:
    """Hashed features of one white-space separated piece, in lower case."""
    out = []
    for word in RUN.findall(piece):
        out.append(xxhash.xxh32_intdigest(word.encode(), 0) % SPACE)
        out += [xxhash.xxh32_intdigest(word[:n].encode(), n) % SPACE for n in BEGINNINGS if len(word) >= n]
    return out


def featurizer(wanted=None):
    """text -> the set of its features (those in ``wanted``, if given); what
    pieces have is remembered. A feature that two different pieces have is also
    there SPACE higher: one odd word with a beginning says less than several."""
    known: dict[str, tuple[int, ...]] = {}

    def find(text: str | None) -> set[int]:
        found: set[int] = set()
        for piece in set((text or "").lower().split()):
            own = known.get(piece)
            if own is None:
                own = tuple(f for f in piece_features(piece) if wanted is None or f in wanted or f + SPACE in wanted)
                if len(piece) < 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = own
            for f in own:
                found.add(f + SPACE if f in found else f)
        return found if wanted is None else {f for f in found if f in wanted}

    return find


@dataclass(frozen=True)
class Model:
    """Kept features and their weight in the averaged logit."""

    kept: np.ndarray
    weights: np.ndarray
    bias: float

    def scorer(self):
        """text -> score."""
        weight_of = dict(zip(self.kept.tolist(), self.weights.tolist(), strict=True))
        find = featurizer(weight_of)

        def score(text: str | None) -> float:
            # sorted, so that equal texts get equal scores in any order of words
            logit = self.bias + EVEN + sum(weight_of[f] for f in sorted(find(text)))
            return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))

        return score


def _choose(positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> np.ndarray:
    """The features that most set positives apart from unlabelled text, of
    those that more than two positives have."""
    every = lambda rows: np.concatenate([*rows, np.zeros(0, np.int32)])
    features, counts = np.unique(every(positive), return_counts=True)
    features, counts = features[counts > 2], counts[counts > 2]
    if not len(features):
        return features.astype(np.int64)
    other = every(unlabelled)
    at = np.minimum(np.searchsorted(features, other), len(features) - 1)
    u = np.bincount(at[features[at] == other], minlength=len(features)) / max(1, len(unlabelled))
    n = len(positive)
    clear = (counts / n - u) * np.sqrt(n / np.maximum(u, 1 / n))
    best = np.argsort(-clear, kind="stable")[:KEPT]
    return np.sort(features[best[clear[best] > CLEAR]]).astype(np.int64)


def risk(w: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk of the logistic loss, l(+) = -log s and l(-) =
    -log(1 - s), and its gradient; the last weight is the bias."""
    sp = 1 / (1 + np.exp(-(positive @ w[:-1] + w[-1])))
    su = 1 / (1 + np.exp(-(unlabelled @ w[:-1] + w[-1])))
    loss = lambda s: -np.log(np.maximum(s, 1e-9)).mean()
    as_clean = loss(1 - su) - prior * loss(1 - sp)
    gp, gu = prior * (sp - 1) / len(sp), np.zeros(len(su))
    if as_clean >= 0:
        gp, gu = gp - prior * sp / len(sp), su / len(su)
    return prior * loss(sp) + max(0.0, as_clean), np.concatenate([gp @ positive + gu @ unlabelled, [gp.sum() + gu.sum()]])


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, seed: int = 7) -> Model:
    """Average of CLASSIFIERS linear classifiers under the non-negative risk."""
    kept = _choose(positive, unlabelled)
    if not positive or not unlabelled or not len(kept):
        return Model(np.zeros(0, np.int32), np.zeros(0), -1e9)
    prior = min(max(prior, 1e-4), 0.95)

    def matrix(rows):
        out = np.zeros((len(rows), len(kept)), np.float32)
        for i, r in enumerate(rows):
            at = np.searchsorted(kept, r)
            ok = kept[np.minimum(at, len(kept) - 1)] == r
            out[i, at[ok]] = 1
        return out
    xp, xu = matrix(positive), matrix(unlabelled)
    total_w, total_b = np.zeros(len(kept)), 0.0
    for k in range(CLASSIFIERS):
        rng = np.random.default_rng(seed + k)
        w = np.zeros(len(kept) + 1)
        m, v, step = np.zeros_like(w), np.zeros_like(w), 0
        w[-1] = -2.0
        batches = max(1, min(len(xp), len(xu)) // 128)
        rounds = -(-STEPS // batches)
        for r in range(rounds):
            pi = np.array_split(rng.permutation(len(xp)), batches)
            ui = np.array_split(rng.permutation(len(xu)), batches)
            for a, b in zip(pi, ui, strict=True):
                _, grad = risk(w, xp[a], xu[b], prior)
                grad[:-1] += RIDGE * w[:-1]
                step += 1
                m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
                w -= RATE * (1 - r / rounds) * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-6)
        total_w, total_b = total_w + w[:-1], total_b + w[-1]
    return Model(kept, total_w / CLASSIFIERS, float(total_b / CLASSIFIERS))


def train(docs: DataFrame, labels: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", prior: float | None = None) -> Model:
    """Fit on rows where ``learn`` (a condition on the id) holds. Confirmed
    rows have label 1; all rows, labelled or not, are unlabelled text. Ids and
    labels meet first, without texts; then one pass reads the sample's texts.
    ``prior``: share of toxic text; if None, that among the labelled rows."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(learn)
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("mark")).where(learn).where(
        "mark is not null").groupBy("id").agg(F.max("mark").alias("mark"))
    if prior is None:
        prior = marks.agg(F.avg((F.col("mark") == 1).cast("double"))).first()[0] or 0.0
    confirmed = picked(rows, marks.where("mark = 1"), MAX_POSITIVE)

    def run(batches):
        find = featurizer()
        for part in slices(batches):
            packed = [np.array(sorted(find(t)), np.int32).tobytes() for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary()), *part.columns[2:]],
                                             ["id", "found", "toxic", "other"])

    share = int(min(1.0, MAX_UNLABELLED / max(1, rows.count())) * (1 << 30))
    other = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) < share
    some = rows.join(F.broadcast(confirmed.withColumnRenamed("mark", "toxic")), "id", "left").select(  # MAX_POSITIVE ids, about
        "id", "text", F.col("toxic").isNotNull().alias("toxic"), other.alias("other")).where("toxic or other")
    kind = StructType([some.schema["id"]]).add("found", "binary").add("toxic", "boolean").add("other", "boolean")
    table = collected(some.mapInArrow(run, kind), MAX_BYTES)
    discard(confirmed)
    found, toxic, unlabelled = (table.column(c).to_pylist() for c in ("found", "toxic", "other"))
    del table

    def those(flags: list[bool]) -> list[np.ndarray]:  # sorted: the order of tasks doesn't matter
        return [np.frombuffer(x, np.int32) for x in sorted(f for f, flag in zip(found, flags, strict=True) if flag)]
    return fit_nnpu(those(toxic), those(unlabelled), prior)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row's whole text."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most KEPT weights

    def run(batches):
        judge = shared.value.scorer()
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([judge(t) for t in part.column(1).to_pylist()], pa.float64())], ["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, StructType([rows.schema["id"]]).add("score", "double"))


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``threshold``."""
    small_batches(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        judge = shared.value.scorer()
        for part in slices(batches):
            yield part.filter(pa.array([judge(t) < threshold for t in part.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
