"""Quality classifier: a byte-level convolutional network in numpy.

The UTF-8 bytes of a document are cut into overlapping chunks that cover all
of it. FILTERS filters of WIDTH bytes are slid over each chunk (a filter has
one learned weight for each byte value at each place, so sliding it is a sum
of table look-ups), max-pooled over the chunk, and put, with the share of the
chunk that is text, through a small hidden layer to one value for each chunk. The document's logit combines the largest,
the smallest and the mean of these values with learned weights; its sigmoid is
the score.

All weights are learned with Adam from all chunks of a bounded sample of rows
(MAX_EACH of each label, about; fewer where their chunks hold over MAX_BYTES);
scoring reads every byte.

Cases: null and empty texts are one chunk of padding; without labels of both
kinds every score is 0.5; repeated rows score alike; very long texts are
scored a block of chunks at a time; an empty table gives an empty result. Of
several labels for one id the smallest counts. Only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from .common import discard, slices, small_batches
from .sampling import collected, picked

#: Bounds of the fitting sample.
MAX_EACH = 2500
MAX_BYTES = 8 << 20
CHUNK = 320
STEP = 256
WIDTH = 5
FILTERS = 16
HIDDEN = 16
EPOCHS = 8
#: Share of the fitting rows of which a short cut is another example.
CUTS = 0.3
THRESHOLD = 0.7
#: Chunks scored at once.
BLOCK = 256


def chunks(text: str | None) -> np.ndarray:
    """(n, CHUNK) bytes of the whole text; the last chunk is padded by zeros."""
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    n = max(1, -(-(len(data) - (CHUNK - STEP)) // STEP))
    padded = np.zeros((n - 1) * STEP + CHUNK, np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STEP]


@dataclass(frozen=True)
class Network:
    """filters (WIDTH, 256, FILTERS), the hidden layer, and how chunk values combine."""

    filters: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    combine: np.ndarray  # weights of largest, smallest, mean, and the bias

    def slide(self, block: np.ndarray) -> np.ndarray:
        """(chunks, places, FILTERS) responses."""
        places = CHUNK - WIDTH + 1
        out = np.take(self.filters[0], block[:, :places], axis=0)
        for k in range(1, WIDTH):
            out += np.take(self.filters[k], block[:, k: k + places], axis=0)
        return out

    def pool(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each filter's largest response in each chunk, and it."""
        response = self.slide(block)
        place = response.argmax(axis=1)
        return place, np.take_along_axis(response, place[:, None, :], axis=1)[:, 0, :]

    def values(self, block: np.ndarray) -> np.ndarray:
        """One value for each chunk."""
        pooled = with_fill(self.slide(block).max(axis=1), block)
        # sums in a fixed order, so that equal chunks get equal values wherever they stand in a block
        hidden = np.maximum((pooled[:, :, None] * self.w1[None]).sum(axis=1) + self.b1, 0)
        return (hidden * self.w2).sum(axis=1)

    def score_many(self, texts: list[str | None]) -> list[float]:
        """Scores; the chunks of short texts share a block."""
        parts = [chunks(t) for t in texts]
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        values = np.concatenate([self.values(np.concatenate(group)) for group in _blocks(parts)]) if parts else []
        out = []
        bounds = np.searchsorted(owner, np.arange(len(parts) + 1))
        for a, b in zip(bounds, bounds[1:], strict=False):
            v = values[a:b]
            z = np.dot(self.combine, [v.max(), v.min(), v.mean(), 1.0])
            out.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
        return out


def with_fill(pooled: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Pooled responses and the share of each chunk that is text: a short text
    has weaker maxima without being worse."""
    return np.concatenate([pooled, (block != 0).mean(axis=1, dtype=np.float32)[:, None]], axis=1)


def _blocks(parts):
    group, n = [], 0
    for p in parts:
        for at in range(0, len(p), BLOCK):
            piece = p[at: at + BLOCK]
            group.append(piece)
            n += len(piece)
            if n >= BLOCK:
                yield group
                group, n = [], 0
    if group:
        yield group


def fit_network(good: list[np.ndarray], bad: list[np.ndarray], seed: int = 11) -> Network:
    """Learn from the chunks of texts of label 1 and of label 0; both labels
    weigh the same."""
    rng = np.random.default_rng(seed)
    f = rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
    w1 = rng.normal(0, 0.4, (FILTERS + 1, HIDDEN)).astype(np.float32)
    net = Network(f, w1, np.zeros(HIDDEN, np.float32), rng.normal(0, 0.4, HIDDEN).astype(np.float32),
                  np.array([0.3, 0.3, 0.4, 0.0], np.float32))
    if not good or not bad:
        return Network(f, w1, net.b1, net.w2, np.zeros(4, np.float32))
    docs = []
    for label, texts in ((1, good), (0, bad)):
        docs += [(c, label, 0.5 / len(texts)) for c in texts]
        for c in texts:  # short texts are few: cuts of others stand in for them
            if rng.random() < CUTS:
                short = np.zeros((1, CHUNK), np.uint8)
                n = rng.integers(8, 200)
                short[0, :n] = c[rng.integers(len(c)), :n]
                docs.append((short, label, 0.5 / len(texts)))
    params = [net.filters, net.w1, net.b1, net.w2, net.combine]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step, scale = 0, len(docs)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(docs))
        rate = 0.02 * (1 - epoch / EPOCHS) + 0.002
        for at in range(0, len(order), 32):
            group = [docs[i] for i in order[at: at + 32]]
            block = np.concatenate([c for c, _, _ in group])
            ends = np.cumsum([len(c) for c, _, _ in group])
            place, pooled = zip(*[net.pool(block[i: i + BLOCK]) for i in range(0, len(block), BLOCK)], strict=True)
            place, pooled = np.concatenate(place), with_fill(np.concatenate(pooled), block)
            hidden = np.maximum(pooled @ net.w1 + net.b1, 0)
            value = hidden @ net.w2
            dv, dc = np.zeros_like(value), np.zeros(4)
            for (c, y, weight), e in zip(group, ends, strict=True):
                a = e - len(c)
                v = value[a:e]
                summary = np.array([v.max(), v.min(), v.mean(), 1.0])
                s = 1 / (1 + np.exp(-np.clip(net.combine @ summary, -30, 30)))
                g = (s - y) * weight * scale / len(group)
                dc += g * summary
                dv[a:e] += g * net.combine[2] / len(c)
                dv[a + v.argmax()] += g * net.combine[0]
                dv[a + v.argmin()] += g * net.combine[1]
            dh = np.outer(dv, net.w2) * (hidden > 0)
            dp = (dh @ net.w1.T)[:, :FILTERS]
            df = np.zeros_like(net.filters)
            for k in range(WIDTH):
                np.add.at(df[k], (np.take_along_axis(block, place + k, axis=1), np.arange(FILTERS)[None, :]), dp)
            grads = [df + 1e-5 * net.filters, pooled.T @ dh + 1e-4 * net.w1, dh.sum(0), hidden.T @ dv + 1e-4 * net.w2, dc]
            step += 1
            for p, g, (m, v) in zip(params, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= (rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-6)).astype(p.dtype)
    return net


def train(docs: DataFrame, labels: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality") -> Network:
    """Fit on the labelled rows where ``learn`` (a condition on the id) holds.
    Ids and labels meet first, without texts; then one pass reads the sample's."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(learn)
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("mark")).where(learn).where(
        "mark in (0, 1)").groupBy("id").agg(F.min("mark").alias("mark"))

    sample = picked(rows, marks, MAX_EACH)

    def run(batches):
        for part in slices(batches):
            found = [chunks(t).tobytes() for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary()), part.column(2)], ["id", "found", "mark"])

    some = rows.join(F.broadcast(sample), "id").select("id", "text", F.col("mark").cast("int"))  # 2 x MAX_EACH ids, about
    kind = StructType([some.schema["id"]]).add("found", "binary").add("mark", "integer")
    table = collected(some.mapInArrow(run, kind), MAX_BYTES)
    discard(sample)
    found, mark = table.column("found").to_pylist(), table.column("mark").to_pylist()

    def those(label: int) -> list[np.ndarray]:  # sorted: the order of tasks doesn't matter
        return [np.frombuffer(x, np.uint8).reshape(-1, CHUNK) for x in sorted(f for f, m in zip(found, mark, strict=True) if m == label)]
    return fit_network(those(1), those(0))


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row's whole text."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size

    def run(batches):
        for part in slices(batches):
            found = shared.value.score_many(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.float64())], ["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, StructType([rows.schema["id"]]).add("score", "double"))
