"""Approximate nearest neighbours by largest inner product: a forest of
random-projection trees.

TREES trees are fitted on a bounded sample (SAMPLE rows, about): a node splits
its vectors at the median of their projections on the difference of two of
them, down to LEAF vectors. Every row is then routed down every tree, so the
index holds all rows. A query searches all trees through one shared priority
queue: the node whose splits it misses by the least is opened next, whichever
tree it is in, until the opened leaves hold a share of as many vectors as there
are (a vector stands in each tree, so they overlap). That share is measured: the
smallest of SHARES at which PROBES vectors of the sample find TARGET of their
nearest others in it. The rows of the opened leaves are the candidates, ranked
exactly by inner product in double precision on the original vectors.

A run of neighbouring leaves is a plot. Rows and queries meet by plot; a plot
with many rows or queries is cut into blocks by hash, and each pair of blocks
hands on only its K best for each query, so no group grows with the data.
Before that, of equal vectors only the K + 1 smallest ids are kept: no more of
them can be among the K nearest of any query.

Cases: vectors that are null, empty, zero, of another length than most, or
hold null or non-finite components take no part, neither as queries nor as
candidates; the rows of one id count once (as query with its smallest vector,
as candidate with its best score) and never for their own query; ties go to
the smaller id; fewer than K candidates are all returned once the sample fits
one leaf; an empty table gives an empty result. Only the id and vector
columns are read.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import written

SAMPLE = 16384
TREES = 4
LEAF = 128
SHARES = (0.05, 0.1, 0.2, 0.4, 0.6, 0.8, 1.0, 1.3, 1.6, 2.0, 3.0, float(TREES))
PROBES = 256
TARGET = 0.94
K = 20
#: Queries that a task searches for, about.
SEARCHED = 256
#: Leaves of a plot, and the rows and queries of a block, about.
PLOT = 16
ROWS = 4096
QUERIES = 1024


@dataclass(frozen=True)
class Forest:
    """Nodes of all trees: a split (direction, threshold, children) or a leaf."""

    directions: np.ndarray  # (splits, dimension)
    thresholds: np.ndarray
    children: np.ndarray  # (splits, 2): a split's number, or -1 - leaf
    roots: tuple[int, ...]
    shares: np.ndarray  # of each leaf, in its tree's sample

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """(rows, TREES): the leaf of each vector in each tree."""
        out = np.empty((len(vectors), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            todo = [(root, np.arange(len(vectors)))]
            while todo:
                node, rows = todo.pop()
                if node < 0:
                    out[rows, t] = -1 - node
                elif len(rows):
                    right = (vectors[rows] * self.directions[node]).sum(axis=1) > self.thresholds[node]
                    todo += [(self.children[node, 0], rows[~right]), (self.children[node, 1], rows[right])]
        return out

    def search(self, vector: np.ndarray, share: float) -> list[int]:
        """Leaves to open, through a priority queue that all trees share."""
        margins = (self.directions @ vector - self.thresholds).tolist() if len(self.thresholds) else []
        queue, opened, held, goal = [(0.0, r) for r in self.roots], [], 0.0, share
        heapq.heapify(queue)
        while queue and held < goal:
            miss, node = heapq.heappop(queue)
            if node < 0:
                opened.append(-1 - node)
                held += self.shares[-1 - node]
                continue
            m, (left, right) = margins[node], self.children[node]
            heapq.heappush(queue, (max(miss, m), int(left)))
            heapq.heappush(queue, (max(miss, -m), int(right)))
        return opened


def fit(sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 3) -> Forest:
    rng = np.random.default_rng(seed)
    directions, thresholds, children, roots, shares = [], [], [], [], []

    def grow(rows: np.ndarray) -> int:
        if len(rows) > leaf:
            a, b = rng.choice(len(rows), 2, replace=False)
            w = sample[rows[a]] - sample[rows[b]]
            length = np.linalg.norm(w)
            if length == 0:
                w = rng.normal(size=sample.shape[1])
                length = np.linalg.norm(w)
            w = w / length
            p = sample[rows] @ w
            cut = float(np.median(p))
            right = p > cut
            if right.any() and not right.all():
                me = len(thresholds)
                directions.append(w)
                thresholds.append(cut)
                children.append([0, 0])
                children[me] = [grow(rows[~right]), grow(rows[right])]
                return me
        shares.append(len(rows) / max(1, len(sample)))
        return -len(shares)

    for _ in range(trees):
        roots.append(grow(np.arange(len(sample))))
        shares += [0.0] * (-len(shares) % PLOT)  # no plot spans two trees
    dim = sample.shape[1]
    return Forest(np.array(directions).reshape(-1, dim), np.array(thresholds), np.array(children, np.int64).reshape(-1, 2),
                  tuple(roots), np.array(shares))


def share_for(forest: Forest, sample: np.ndarray, k: int, target: float = TARGET, probes: int = PROBES, seed: int = 4) -> float:
    """The smallest of SHARES at which vectors of the sample find ``target`` of
    their ``k`` nearest others in it."""
    picked = np.random.default_rng(seed).permutation(len(sample))[:probes]
    leaf_of = forest.leaves(sample)  # (rows, trees)
    k = min(k, len(sample) - 1)
    if k < 1:
        return SHARES[-1]
    hits = np.zeros(len(SHARES))
    for i in picked:
        near = sample @ sample[i]
        near[i] = -np.inf
        best = leaf_of[np.argpartition(-near, k - 1)[:k]]
        order = forest.search(sample[i], SHARES[-1])  # all shares open leaves in the same order
        held = np.cumsum(forest.shares[order])
        when = np.full(len(forest.shares), np.inf)
        when[order] = held - forest.shares[order]  # what is open before a leaf is
        first = when[best].min(axis=1)
        hits += [(first < share).sum() for share in SHARES]
    reached = hits / (len(picked) * k) >= target
    return SHARES[int(reached.argmax())] if reached.any() else SHARES[-1]


def valid(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v): rows whose vector takes part."""
    v = F.col("v")
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(
        sound & F.exists(v, lambda x: x != 0) & F.col("id").isNotNull())
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (most["d"] if most else 0))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column as a matrix of doubles."""
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return np.asarray(flat, np.float64).reshape(len(column), -1)


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K,
            share: float | None = None) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest found for each row that
    ``is_query`` (a condition on ``id``) picks, among all other rows. ``share``
    is measured if not given."""
    spark = vectors.sparkSession
    rows = valid(vectors, id_col, vector_col).distinct()
    few = Window.partitionBy("v").orderBy("id")
    rows = written(rows.withColumn("n", F.row_number().over(few)).where(F.col("n") <= k + 1).drop("n"), "ann-rows")
    queries = valid(vectors, id_col, vector_col).where(is_query).groupBy("id").agg(F.min("v").alias("v"))
    total = rows.count()
    part = min(1.0, SAMPLE / max(1, total))
    sample = rows.where(F.pmod(F.xxhash64("id", F.lit("ann")), F.lit(1 << 30)) < int(part * (1 << 30))).select("id", "v").toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    order = np.argsort(np.asarray(sample.column("id")), kind="stable")
    fitted = _matrix(sample.column("v"))[order]
    forest = spark.sparkContext.broadcast(fit(fitted))  # bounded by SAMPLE
    if share is None:
        share = share_for(forest.value, fitted, k)

    def route(batches):
        for batch in batches:
            leaves = forest.value.leaves(_matrix(batch.column(1))) if batch.num_rows else np.zeros((0, 1), np.int64)
            held = pa.array(leaves.tolist(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, held], ["id", "v", "leaves"])

    def open_leaves(batches):
        for batch in batches:
            ids, plots, opened, at = [], [], [], []
            for i, vector in enumerate(_matrix(batch.column(1)) if batch.num_rows else ()):
                found = np.array(forest.value.search(vector, share), np.int64)
                for plot in np.unique(found // PLOT):
                    at.append(i)
                    plots.append(int(plot))
                    opened.append(found[found // PLOT == plot].tolist())
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(plots, pa.int64()),
                 pa.array(opened, pa.list_(pa.int64()))], ["id", "v", "plot", "leaves"])

    kind = rows.schema["v"].dataType.simpleString()
    routed = written(rows.mapInArrow(route, f"id long, v {kind}, leaves array<long>"), "ann-routed").select(
        "id", "v", F.explode("leaves").alias("leaf")).withColumn("plot", F.floor(F.col("leaf") / PLOT))
    tasks = max(1, -(-queries.count() // SEARCHED))
    asked = written(queries.select("id", "v").repartition(tasks, "id").mapInArrow(
        open_leaves, f"id long, v {kind}, plot long, leaves array<long>"), "ann-queries")

    # into how many blocks each plot's rows and queries are cut; plots are as many as the sample has leaves / PLOT
    plots = {r["plot"]: [r["n"], 0] for r in routed.groupBy("plot").agg(F.count("*").alias("n")).collect()}
    for r in asked.groupBy("plot").agg(F.count("*").alias("n")).collect():
        plots.setdefault(r["plot"], [0, 0])[1] = r["n"]
    cuts = F.create_map(*[F.lit(x) for p, (n, q) in sorted(plots.items())
                          for x in (p, max(1, -(-n // ROWS)) << 32 | max(1, -(-q // QUERIES)))])
    cut = F.element_at(cuts, F.col("plot"))

    def blocks(df: DataFrame, own: Column, other: Column, names: tuple[str, str]) -> DataFrame:
        mine = F.pmod(F.xxhash64("id", F.lit("block")), own).cast("int")
        return df.withColumn(names[0], mine).withColumn(names[1], F.explode(F.sequence(F.lit(0), (other - 1).cast("int"))))

    n_rows, n_queries = F.shiftright(cut, 32), cut.bitwiseAND(F.lit((1 << 32) - 1))
    left = blocks(asked, n_queries, n_rows, ("qb", "rb"))
    right = blocks(routed, n_rows, n_queries, ("rb", "qb"))

    def best(asking: pa.Table, held: pa.Table) -> pa.Table:
        out = ([], [], [])
        if asking.num_rows and held.num_rows:
            qv, rv = _matrix(asking.column("v")), _matrix(held.column("v"))
            qid, rid, leaf = (np.asarray(c) for c in (asking.column("id"), held.column("id"), held.column("leaf")))
            opened = np.asarray(asking.column("leaves").combine_chunks().flatten())
            owner = np.repeat(np.arange(len(qid)), np.asarray(asking.column("leaves").combine_chunks().value_lengths()))
            first = int(leaf.min()) // PLOT * PLOT
            is_open = np.zeros((len(qid), PLOT), bool)
            is_open[owner, opened - first] = True
            for at in range(0, len(qid), 128):
                near = qv[at: at + 128] @ rv.T
                near[~is_open[at: at + 128][:, leaf - first]] = -np.inf
                near[qid[at: at + 128][:, None] == rid[None, :]] = -np.inf
                floor = -np.partition(-near, min(k, near.shape[1]) - 1, axis=1)[:, min(k, near.shape[1]) - 1]
                # all that may tie with the k-th, ranked by a sum in fixed order
                qi, ri = np.nonzero((near >= floor[:, None] - 1e-9 * (1 + np.abs(floor[:, None]))) & np.isfinite(near))
                exact = (qv[at + qi] * rv[ri]).sum(axis=1)
                order = np.lexsort((rid[ri], -exact, qi))
                qi, ri, exact = qi[order], ri[order], exact[order]
                place = np.arange(len(qi)) - np.searchsorted(qi, qi)
                keep = place < k
                for box, x in zip(out, (qid[at + qi[keep]], rid[ri[keep]], exact[keep]), strict=True):
                    box.append(x)
        cat = lambda box, kind: pa.array(np.concatenate([*box, np.zeros(0, kind)]).astype(kind))
        return pa.table({"query_id": cat(out[0], np.int64), "id": cat(out[1], np.int64), "score": cat(out[2], np.float64)})

    keys = ["plot", "rb", "qb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, "query_id long, id long, score double")
    found = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select(
        "query_id", "rank", "id", "score")
