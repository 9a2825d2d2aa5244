"""Product codes of vectors: Lloyd's rounds by dual-tree search, in integers.

Every component x becomes floor(SCALE * x). A vector is cut into PARTS
consecutive parts and each part position has a codebook of ENTRIES entries,
which starts as that part of the vectors with the smallest ids. A round assigns
every part to its nearest entry (squared distance, ties to the lower index) and
moves each entry to the floor of its parts' mean; entries without parts stay.

Rows stay where they are. A task takes CHUNK rows at a time and builds, for each
part position, a tree over the parts (halved along the widest side; a node holds
its box, count and sum) and a tree over the entries. Both are walked down
together: a pair of nodes goes when the least distance between its boxes exceeds
the greatest distance from the same parts to some other node's entries, and a
single entry also when another is nearer over the whole box. A node of parts
that is left with one entry is assigned whole, by its cached count and sum; the
parts of leaves that are left with several are compared with those entries
alone, in integers. A task hands on one count and sum for each entry, so a round
shuffles PARTS x ENTRIES rows a task and no vectors, and since all sums are of
integers its result does not depend on how rows are dealt out.

Cases: vectors that are null, empty, or hold null or non-finite components are
dropped, as are those of another length than most; zero vectors stay. A length
that PARTS does not divide is cut as evenly as it goes. With fewer than ENTRIES
vectors the codebook is as small; of equal starting entries the later ones stay
unused. Ids may repeat or be null (null: after all others among the starting
entries) and are not read otherwise. An empty table gives an empty result.
A component over LIMIT after scaling raises ValueError: its distances would not
fit a long. Only the id, vector and label columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import discard, written
from .vectors import finite, lists, matrix, usual_length

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Rows whose trees a task holds at a time, and the parts of a leaf, about.
CHUNK = 16384
LEAF = 16
LIMIT = 1 << 27
#: A label on more than this share of all rows is joined apart from the others.
HOT = 1000

FAR = np.int64(1) << 60


@dataclass(frozen=True)
class Tree:
    """Points halved level by level: node i of a level holds the points
    order[starts[i]:starts[i + 1]], and its children are 2i and 2i + 1."""

    order: np.ndarray
    points: np.ndarray  # in that order
    starts: list[np.ndarray]
    low: list[np.ndarray]
    high: list[np.ndarray]

    @property
    def depth(self) -> int:
        return len(self.starts) - 1


def tree(points: np.ndarray, leaf: int) -> Tree:
    """Nodes of the last level hold ``leaf`` points at most; they may be empty
    where there are fewer points than nodes, and have an inverted box then."""
    n = len(points)
    depth = max(0, int(np.ceil(np.log2(max(1, n) / leaf))))
    starts = [np.arange((1 << level) + 1) * n >> level for level in range(depth + 1)]
    order = np.arange(n)
    for level in range(depth):
        here, sizes = points[order], np.diff(starts[level])
        filled = np.flatnonzero(sizes)
        at = starts[level][filled]
        wide = np.zeros(len(sizes), np.int64)
        wide[filled] = (np.maximum.reduceat(here, at) - np.minimum.reduceat(here, at)).argmax(axis=1)
        node = np.repeat(np.arange(len(sizes)), sizes)
        order = order[np.lexsort((here[np.arange(n), wide[node]], node))]
    here, filled = points[order], np.flatnonzero(np.diff(starts[-1]))
    low = np.full((1 << depth, points.shape[1]), FAR)
    high = np.full((1 << depth, points.shape[1]), -FAR)
    low[filled] = np.minimum.reduceat(here, starts[-1][filled])
    high[filled] = np.maximum.reduceat(here, starts[-1][filled])
    lows, highs = [low], [high]
    for _ in range(depth):
        lows.append(np.minimum(lows[-1][::2], lows[-1][1::2]))
        highs.append(np.maximum(highs[-1][::2], highs[-1][1::2]))
    return Tree(order, here, starts, lows[::-1], highs[::-1])


def _bounds(parts: Tree, p: np.ndarray, at: int, entries: Tree, e: np.ndarray, down: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest squared distance of node pairs."""
    lo, hi, el, eh = parts.low[at][p], parts.high[at][p], entries.low[down][e], entries.high[down][e]
    gap = np.maximum(np.maximum(el - hi, lo - eh), 0)
    far = np.maximum(eh - lo, hi - el)
    return (gap * gap).sum(axis=1), (far * far).sum(axis=1)


def _excess(low: np.ndarray, high: np.ndarray, rival: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """The greatest excess, over the points of a box, of the squared distance to
    ``rival`` over that to ``entry``: below 0, no point of it is as near to
    ``entry``."""
    side = entry - rival
    corner = np.where(side > 0, high, low)
    return (rival * rival - entry * entry + 2 * side * corner).sum(axis=1)


@dataclass(frozen=True)
class Assigned:
    """Entry of each part, and the count and sum of each entry's parts.
    ``whole`` is the number of parts that were assigned with their node."""

    entry: np.ndarray
    counts: np.ndarray
    sums: np.ndarray
    whole: int


def assign(parts: Tree, codebook: np.ndarray) -> Assigned:
    """The nearest entry of every part, ties to the lower index."""
    n, k = len(parts.order), len(codebook)
    entries = tree(codebook, 1)
    totals = np.vstack([np.zeros((1, codebook.shape[1]), np.int64), parts.points.cumsum(axis=0)])
    found = np.zeros(n, np.int64)  # by place in the tree
    counts, sums = np.zeros(k, np.int64), np.zeros(codebook.shape, np.int64)
    p, e, at, down, whole = np.zeros(1, np.int64), np.zeros(1, np.int64), 0, 0, 0
    while True:
        least, most = _bounds(parts, p, at, entries, e, down)
        first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        limit = np.minimum.reduceat(most, first)
        sizes = np.diff(np.r_[first, len(p)])
        keep = least <= np.repeat(limit, sizes)
        if down == entries.depth:  # single entries: also against the one with that greatest distance, over the whole box
            rival = np.minimum.reduceat(np.where(most == np.repeat(limit, sizes), np.arange(len(p)), len(p)), first)
            one = codebook[entries.order[entries.starts[-1][e]]]
            keep &= _excess(parts.low[at][p], parts.high[at][p], np.repeat(one[rival], sizes, axis=0), one) >= 0
        p, e = p[keep], e[keep]
        if down == entries.depth:
            first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
            sole = np.repeat(np.diff(np.r_[first, len(p)]) == 1, np.diff(np.r_[first, len(p)]))
            if sole.any():
                node, entry = p[sole], entries.order[entries.starts[-1][e[sole]]]
                a, b = parts.starts[at][node], parts.starts[at][node + 1]
                np.add.at(counts, entry, b - a)
                np.add.at(sums, entry, totals[b] - totals[a])
                places = np.repeat(a - np.r_[0, (b - a).cumsum()[:-1]], b - a) + np.arange((b - a).sum())
                found[places] = np.repeat(entry, b - a)
                whole += len(places)
                p, e = p[~sole], e[~sole]
            if at == parts.depth or not len(p):
                break
        if at < parts.depth:
            p, e, at = np.r_[2 * p, 2 * p + 1], np.r_[e, e], at + 1
        if down < entries.depth:
            p, e, down = np.r_[p, p], np.r_[2 * e, 2 * e + 1], down + 1
            filled = np.diff(entries.starts[down])[e] > 0
            p, e = p[filled], e[filled]
        turn = np.argsort(p, kind="stable")
        p, e = p[turn], e[turn]
    if len(p):  # leaves with several entries left: exact distances to those alone
        a, b = parts.starts[at][p], parts.starts[at][p + 1]
        place = np.repeat(a - np.r_[0, (b - a).cumsum()[:-1]], b - a) + np.arange((b - a).sum())
        entry = np.repeat(entries.order[entries.starts[-1][e]], b - a)
        gap = parts.points[place] - codebook[entry]
        distance = (gap * gap).sum(axis=1)
        nearest = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(nearest, place, distance)
        tied = distance == nearest[place]
        best = np.full(n, k)
        np.minimum.at(best, place[tied], entry[tied])
        loose = np.flatnonzero(best < k)
        found[loose] = best[loose]
        np.add.at(counts, best[loose], 1)
        np.add.at(sums, best[loose], parts.points[loose])
    out = np.empty(n, np.int64)
    out[parts.order] = found
    return Assigned(out, counts, sums, whole)


def cuts(length: int, parts: int) -> list[slice]:
    ends = [i * length // parts for i in range(parts + 1)]
    return [slice(a, b) for a, b in zip(ends, ends[1:], strict=False)]


def chunks(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The batches of a task, joined to tables of ``rows`` rows at most."""
    held, n = [], 0
    for batch in batches:
        while n + batch.num_rows >= rows:
            held.append(batch.slice(0, rows - n))
            yield pa.Table.from_batches(held)
            batch, held, n = batch.slice(held[-1].num_rows), [], 0
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def moved(kept: DataFrame, codebooks: list[np.ndarray], length: int, chunk: int) -> list[np.ndarray]:
    """The codebooks after one round over ``kept`` (x)."""
    spans, width = cuts(length, len(codebooks)), max(1, -(-length // len(codebooks)))
    shared = kept.sparkSession.sparkContext.broadcast(codebooks)  # parts x entries x width numbers

    def sums(batches):
        books = shared.value
        counts = [np.zeros(len(b), np.int64) for b in books]
        totals = [np.zeros(b.shape, np.int64) for b in books]
        for table in chunks(batches, chunk):
            x = matrix(table.column("x"), np.int64)
            for i, span in enumerate(spans):
                if span.stop > span.start:
                    got = assign(tree(x[:, span], LEAF), books[i])
                    counts[i] += got.counts
                    totals[i] += got.sums
        for i, span in enumerate(spans):
            used = np.flatnonzero(counts[i])
            padded = np.zeros((len(used), width), np.int64)
            padded[:, :span.stop - span.start] = totals[i][used]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), i, np.int32)), pa.array(used.astype(np.int32)), pa.array(counts[i][used]),
                 lists(padded, pa.int64())], ["part", "entry", "n", "s"])

    found = kept.select("x").mapInArrow(sums, "part int, entry int, n long, s array<long>").groupBy("part", "entry").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[j]) for j in range(width)]).alias("s")).collect()
    out = [b.copy() for b in codebooks]
    for r in found:  # parts x entries rows at most
        out[r["part"]][r["entry"]] = [s // r["n"] for s in r["s"][:out[r["part"]].shape[1]]]
    return out


def digest(codebooks: list[np.ndarray]) -> str:
    """SHA-256 of all entries' decimal components by part, entry and place."""
    return hashlib.sha256(",".join(str(c) for b in codebooks for e in b.tolist() for c in e).encode()).hexdigest()


def encode(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
           parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, chunk: int = CHUNK) -> tuple[DataFrame, list[np.ndarray]]:
    """(id, label, code, error, label_error) of every kept row, and the final
    codebooks. ``code`` is an array of entry numbers, ``error`` the squared
    distance to them, ``label_error`` its sum over the rows of one label."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")).where(finite(F.col("v")))
    length = usual_length(rows, "v")
    fields = [rows.schema["id"], rows.schema["label"]]
    if not length:
        return spark.createDataFrame([], T.StructType([*fields, T.StructField("code", T.ArrayType(T.IntegerType())), T.StructField(
            "error", T.LongType()), T.StructField("label_error", T.LongType())])), [np.zeros((0, 0), np.int64)] * parts
    scaled = F.transform("v", lambda c: F.lit(float(SCALE)) * c.cast("double"))
    over = F.exists(scaled, lambda c: F.abs(c) > float(LIMIT))
    rows = rows.where(F.size("v") == length)
    kept = written(rows.select("id", "label", over.alias("over"), F.transform(
        scaled, lambda c: F.floor(F.least(F.greatest(c, F.lit(-2.0 * LIMIT)), F.lit(2.0 * LIMIT)))).alias("x")), "lloyd-rows")
    if kept.where("over").limit(1).count():
        raise ValueError(f"components over {LIMIT} after scaling by {SCALE} are not supported")
    first = kept.orderBy(F.asc_nulls_last("id"), "x").select("x").limit(entries).collect()
    start = np.array([r["x"] for r in first], np.int64)
    spans = cuts(length, parts)
    books = [start[:, s].copy() for s in spans]
    for _ in range(rounds):
        books = moved(kept, books, length, chunk)
    shared = spark.sparkContext.broadcast(books)

    def codes(batches):
        for table in chunks(batches, chunk):
            x = matrix(table.column("x"), np.int64)
            code, error = np.zeros((len(x), parts), np.int32), np.zeros(len(x), np.int64)
            for i, span in enumerate(spans):
                if span.stop > span.start:
                    found = assign(tree(x[:, span], LEAF), shared.value[i]).entry
                    gap = x[:, span] - shared.value[i][found]
                    code[:, i] = found
                    error += (gap * gap).sum(axis=1)
            out = pa.table({"id": table.column("id"), "label": table.column("label"), "code": lists(code, pa.int32()),
                            "error": pa.array(error)})
            yield from out.to_batches()

    schema = T.StructType([*fields, T.StructField("code", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())])
    coded = written(kept.select("id", "label", "x").mapInArrow(codes, schema), "lloyd-codes")
    discard(kept)
    return with_label_error(coded), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds each label's sum of errors. Labels on over 1 / HOT of all rows, HOT
    at most, are broadcast; rows of the others meet their sum by a shuffle in
    which no label weighs more than that."""
    sums = written(coded.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "lloyd-labels")
    total = sums.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * HOT > total
    hot, rest = F.broadcast(sums.where(often).drop("n")), sums.where(~often).drop("n")
    same = F.col("label").eqNullSafe(F.col("l"))
    return coded.join(hot, same).drop("l").unionByName(coded.join(hot, same, "left_anti").join(rest, same).drop("l"))


def hex_code(code: str = "code"):
    """Entry numbers as two hex digits each."""
    return F.array_join(F.transform(code, lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
