"""Whitening of vectors by an incremental eigendecomposition.

Every component c becomes x = floor(SCALE * c) + SHIFT. The covariance V of all
distinct x vectors is never built. A task holds the spectrum (eigenvalues and
eigenvectors) of the scatter of the rows it has seen, centred on their mean, and
takes in each further row as one rank-one update, n / (n + 1) of the row's
deviation from that mean: components of the update that vanish and eigenvalues
that coincide are deflated, the other eigenvalues are the roots of the secular
equation (one between each two old ones; two-pole rational steps kept in a
bracket), and the eigenvectors follow from the update that has exactly those
roots (Gu and Eisenstat), which keeps them orthogonal. Spectra of tasks are
combined FAN at a time, level by level, each eigenpair of one being a rank-one
update of the other, and the difference of their means one more. The leading
components and EXTRA others then span the subspace of a Rayleigh-Ritz step over
all rows: tasks multiply their rows, centred by exact sums, with the basis; the
small projected problem gives Ritz pairs and their residuals, and while those
exceed TOLERANCE the residuals join the basis for another pass.

What leaves a task is one spectrum (d x d numbers), or d x m sums; rows are only
shuffled to find the distinct ones and to spread them evenly.

Cases: vectors that are null, empty, or hold null or non-finite components are
dropped, as are those of another length than most; zero vectors and equal rows
stay in the result, the latter count once in the fit. Components without
variance cannot be whitened and are left out, so fewer than ``components`` (none
for one distinct vector) are returned where the rank is smaller. Ids may repeat
or be null and are not read otherwise. An empty table gives an empty result. A
deviation that does not fit a long is null. A component over LIMIT after scaling
raises ValueError. Only the id and vector columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from .common import discard, written
from .vectors import finite, lists, matrix, usual_length

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
EXTRA = 8
#: Rows of a task that updates a spectrum, about, and spectra combined at a time.
ROWS = 4096
FAN = 8
#: Greatest residual, by the greatest eigenvalue, and most passes to reach it.
TOLERANCE = 1e-12
PASSES = 6
LIMIT = 1 << 31
#: Variance of a component, by the greatest, that counts as none.
NONE = 1e-11

EPS = np.finfo(np.float64).eps


def roots(poles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(i, j) -> poles[j] - root[i] for all roots of 1 + sum(weights / (poles -
    root)) = 0; poles ascending and distinct, weights positive. Each root is
    found as its distance from the nearer pole, so differences keep all their
    digits."""
    k = len(poles)
    ends = np.append(poles[1:], poles[-1] + weights.sum())
    half = (ends - poles) / 2
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        middle = 1 + (weights / (poles - (poles + half)[:, None])).sum(axis=1)
        right = middle < 0  # the root is beyond the middle: measured from the pole after it
        right[-1] = False
        origin = np.where(right, ends, poles)
        gaps = poles - origin[:, None]
        start, end = poles - origin, ends - origin
        low, high = np.where(right, -half, 0.0), np.where(right, 0.0, half)
        if middle[-1] < 0:
            low[-1], high[-1] = half[-1], 2 * half[-1]
        at = (low + high) / 2
        below = np.tri(k)
        above = 1 - below
        for _ in range(60):
            left = gaps - at[:, None]
            term = weights / left
            slope = term / left
            psi, dpsi = np.einsum("ij,ij->i", term, below), np.einsum("ij,ij->i", slope, below)
            phi, dphi = np.einsum("ij,ij->i", term, above), np.einsum("ij,ij->i", slope, above)
            value = 1 + psi + phi
            low, high = np.where(value < 0, at, low), np.where(value < 0, high, at)
            a, b = start - at, end - at
            c = 1 + psi - a * dpsi + phi - b * dphi
            mid = c * (a + b) + a * a * dpsi + b * b * dphi
            rest = a * b * value
            radix = np.sqrt(np.maximum(mid * mid - 4 * c * rest, 0))
            step = np.where(mid <= 0, (mid - radix) / (2 * c), 2 * rest / (mid + radix))
            following = at + step
            following = np.where((following >= low) & (following <= high), following, (low + high) / 2)
            done = (np.abs(value) <= EPS * (1 + phi - psi)) | (np.abs(following - at) <= EPS * np.abs(at))
            if done.all():
                break
            at = np.where(done, at, following)
    return gaps - at[:, None]


@dataclass
class Spectrum:
    """Eigenvalues (ascending) and eigenvectors (columns) of the scatter of ``n``
    vectors about their mean; ``total`` is their sum."""

    n: int
    total: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def nothing(cls, length: int) -> Spectrum:
        return cls(0, np.zeros(length), np.zeros(length), np.eye(length))

    def update(self, v: np.ndarray, rho: float) -> None:
        """Adds rho * v v' to the scatter."""
        size = np.sqrt(v @ v)
        if rho <= 0 or size == 0:
            return
        d, q = self.values, self.vectors
        rho, z = rho * size * size, q.T @ (v / size)
        tolerance = 8 * EPS * max(abs(d[0]), abs(d[-1]), np.abs(z).max())
        live = np.flatnonzero(rho * np.abs(z) > tolerance)
        if not len(live):
            return
        gap, zz = np.diff(d[live]), z[live]
        if (gap * np.abs(zz[1:] * zz[:-1]) <= tolerance * (zz[1:] ** 2 + zz[:-1] ** 2)).any():
            # turn eigenvectors of (nearly) one eigenvalue until one of them takes the whole update
            kept = [live[0]]
            for j in live[1:]:
                i = kept[-1]
                r = np.hypot(z[i], z[j])
                c, s = z[j] / r, z[i] / r
                if abs((d[j] - d[i]) * c * s) <= tolerance:
                    first, second = q[:, i].copy(), q[:, j].copy()
                    q[:, i], q[:, j] = c * first - s * second, s * first + c * second
                    d[i], d[j] = d[i] * c * c + d[j] * s * s, d[i] * s * s + d[j] * c * c
                    z[i], z[j] = 0.0, r
                    kept[-1] = j
                else:
                    kept.append(j)
            live = np.array(kept)
        poles, z = d[live], z[live]
        away = roots(poles, rho * z * z)  # poles[j] - root[i]
        k = len(live)
        spans = poles[:, None] - poles
        under = np.zeros((k, k))
        under[:-1] = spans[1:]
        under[-1] = 1.0
        under = np.where(np.arange(k)[:, None] < np.arange(k), spans, under)
        exact = np.sqrt(np.abs(np.prod(-away / under, axis=0)))  # the update that has these roots
        turn = (np.where(z < 0, -exact, exact) / away).T
        turn /= np.sqrt((turn * turn).sum(axis=0))
        near = np.abs(away).argmin(axis=1)
        d[live] = poles[near] - away[np.arange(k), near]
        q[:, live] = q[:, live] @ turn
        if (d[1:] < d[:-1]).any():
            order = np.argsort(d, kind="stable")
            self.values, self.vectors = d[order], q[:, order]

    def add(self, row: np.ndarray) -> None:
        if self.n:
            self.update(row - self.total / self.n, self.n / (self.n + 1))
        self.n, self.total = self.n + 1, self.total + row

    def merge(self, other: Spectrum) -> None:
        if self.n and other.n:
            self.update(other.total / other.n - self.total / self.n, self.n * other.n / (self.n + other.n))
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            self.update(vector, value)
        self.n, self.total = self.n + other.n, self.total + other.total

    FIELDS = "n long, total array<double>, spectrum array<double>, basis array<double>"

    def record(self, slot: int) -> pa.RecordBatch:
        kind = pa.list_(pa.float64())
        return pa.RecordBatch.from_arrays(
            [pa.array([slot], pa.int64()), pa.array([self.n], pa.int64()),
             *(pa.array([x.ravel().tolist()], kind) for x in (self.total, self.values, self.vectors))],
            ["slot", "n", "total", "spectrum", "basis"])

    @classmethod
    def of(cls, row) -> Spectrum:
        return cls(row["n"], np.array(row["total"]), np.array(row["spectrum"]),
                   np.array(row["basis"]).reshape(len(row["total"]), -1))


def spectrum(fit: DataFrame, centre: np.ndarray) -> Spectrum:
    """The spectrum of all rows of ``fit`` (x), less ``centre``: one update a
    row within tasks, then FAN spectra combined at a time."""
    length = len(centre)

    def updates(batches) -> Iterator[pa.RecordBatch]:
        own = Spectrum.nothing(length)
        for batch in batches:
            for row in (matrix(batch.column(0), np.int64) - centre).astype(np.float64) if batch.num_rows else ():
                own.add(row)
        if own.n:
            yield own.record(TaskContext.get().partitionId())

    def combined(keys, table):
        out = Spectrum.nothing(length)
        for row in sorted(table.to_pylist(), key=lambda r: r["slot"]):
            out.merge(Spectrum.of(row))
        return pa.Table.from_batches([out.record(keys[0].as_py())])

    schema = f"slot long, {Spectrum.FIELDS}"
    level = written(fit.select("x").mapInArrow(updates, schema), "white-spectra")
    first = level
    slots = level.agg(F.max("slot")).first()[0]
    while slots:
        level = level.groupBy(F.floor(F.col("slot") / FAN).alias("up")).applyInArrow(combined, schema)
        slots //= FAN
    out = Spectrum.of(level.first())
    discard(first)
    return out


def _sums(fit: DataFrame, product, rows: int, columns: int) -> np.ndarray:
    """The sum over tasks of ``product`` (x as integers -> rows x columns)."""
    def partial(batches):
        out = np.zeros((rows, columns))
        for batch in batches:
            if batch.num_rows:
                out += product(matrix(batch.column(0), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows, dtype=np.int32)), lists(out, pa.float64())], ["i", "s"])

    found = fit.select("x").mapInArrow(partial, "i int, s array<double>").groupBy("i").agg(
        F.array(*[F.sum(F.col("s")[j]) for j in range(columns)]).alias("s")).orderBy("i").collect()
    return np.array([r["s"] for r in found]).reshape(-1, columns)


def refined(fit: DataFrame, n: int, sums: np.ndarray, basis: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues (falling), unit eigenvectors and the greatest residual of the
    Ritz pairs of V in the span of ``basis``, which residuals widen where need be."""
    for _ in range(PASSES):
        shared = fit.sparkSession.sparkContext.broadcast(basis)

        def product(x: np.ndarray, shared=shared) -> np.ndarray:
            a = (n * x - sums) / n
            return a.T @ (a @ shared.value)

        image = _sums(fit, product, *basis.shape) / n
        h = basis.T @ image
        values, turn = np.linalg.eigh((h + h.T) / 2)
        order = np.argsort(-values)[:components]
        values, turn = values[order], turn[:, order]
        vectors, image = basis @ turn, image @ turn
        rest = image - vectors * values
        worst = float(np.abs(rest).max(initial=0.0)) / max(float(values[0]), np.finfo(float).tiny)
        if worst <= TOLERANCE or basis.shape[1] == len(sums):
            break
        basis = np.linalg.qr(np.hstack([basis, rest]))[0][:, :len(sums)]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values, vectors * signs, worst


@dataclass(frozen=True)
class Fit:
    """What whitening needs: the number of distinct vectors, their sums, the
    trace of V, eigenvalues (falling) and unit eigenvectors."""

    n: int
    sums: np.ndarray
    trace: float
    values: np.ndarray
    vectors: np.ndarray

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (self.n * x - self.sums) / self.n @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        off = x * self.n - self.sums
        big = max(1, int(np.abs(off).max(initial=1)))
        if big * big * x.shape[1] < 1 << 63:
            return (off * off).sum(axis=1).tolist()
        exact = [sum(int(o) ** 2 for o in row) for row in off.tolist()]
        return [e if e < 1 << 63 else None for e in exact]


def fitted(kept: DataFrame, length: int, components: int = COMPONENTS, extra: int = EXTRA, rows: int = ROWS) -> tuple[Fit, float]:
    """The fit of ``kept`` (x), and its identity error: the largest entry of the
    whitened rows' covariance less the identity, measured over all of them."""
    tasks = max(1, -(-kept.count() // rows))
    fit = written(kept.select("x").dropDuplicates().repartition(tasks, F.xxhash64("x")), "white-fit")
    wide = T.DecimalType(38, 0)
    total = fit.agg(F.count("*").alias("n"), F.array(*[F.sum(F.col("x")[j].cast(wide)) for j in range(length)]).alias("s"),
                    F.sum(F.aggregate("x", F.lit(0).cast(wide), lambda t, c: (t + c.cast(wide) * c.cast(wide)).cast(wide))).alias("q")).first()
    n, exact = total["n"], [int(s) for s in total["s"]]
    sums = np.array(exact, np.int64)
    trace = (n * int(total["q"]) - sum(s * s for s in exact)) / (n * n)
    centre = np.array([s // n for s in exact], np.int64)
    start = spectrum(fit, centre)
    m = min(length, components + extra)
    values, vectors, _ = refined(fit, n, sums, start.vectors[:, ::-1][:, :m], components)
    sound = (values > NONE * max(values[0], 0)) & (values > 0)
    out = Fit(n, sums, trace, values[sound], vectors[:, sound])
    k = int(sound.sum())
    error = 0.0
    if k:
        shared = fit.sparkSession.sparkContext.broadcast(out)

        def square(x: np.ndarray) -> np.ndarray:
            z = shared.value.whiten(x)
            return z.T @ z

        error = float(np.abs(_sums(fit, square, k, k) / n - np.eye(k)).max())
    discard(fit)
    return out, error


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row
    for each kept row and component, numbered from 1 by falling variance."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(finite(F.col("v")))
    schema = T.StructType([rows.schema["id"], *(T.StructField(name, kind()) for name, kind in (
        ("component", T.IntegerType), ("n", T.LongType), ("deviation", T.LongType), ("whitened", T.DoubleType),
        ("explained", T.DoubleType), ("identity_error", T.DoubleType)))])
    length = usual_length(rows, "v")
    if not length:
        return spark.createDataFrame([], schema)
    scaled = F.transform("v", lambda c: F.lit(float(SCALE)) * c.cast("double"))
    over = F.exists(scaled, lambda c: F.abs(c) > float(LIMIT))
    kept = written(rows.where(F.size("v") == length).select("id", over.alias("over"), F.transform(
        scaled, lambda c: F.floor(F.least(F.greatest(c, F.lit(-2.0 * LIMIT)), F.lit(2.0 * LIMIT))) + SHIFT).alias("x")), "white-rows")
    if kept.where("over").limit(1).count():
        raise ValueError(f"components over {LIMIT} after scaling by {SCALE} are not supported")
    fit, error = fitted(kept, length, components)
    shared = spark.sparkContext.broadcast(fit)
    k = len(fit.values)

    def project(batches):
        f = shared.value
        explained = f.values / f.trace if f.trace else f.values
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            x = matrix(batch.column(1), np.int64)
            again = pa.array(np.repeat(np.arange(len(x)), k))
            size = len(x) * k
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                 pa.array(np.full(size, f.n)), pa.array(f.deviations(x), pa.int64()).take(again),
                 pa.array(f.whiten(x).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(size, error))],
                schema.names)

    return kept.select("id", "x").mapInArrow(project, schema)
