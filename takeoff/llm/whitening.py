"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

An entry c becomes the whole number x = floor(1024 c) + 100000. Over all vectors, the sums S and then the products Xc'Xc Q of the
centred x-vectors with a block Q are taken in passes: each task multiplies its rows and gives one row a dimension, which Spark
adds up, so the driver gets as many rows as a vector has entries. A block of Q is filtered by a Chebyshev polynomial, one pass a
degree, which is small on the unwanted part of the spectrum and grows fast above it; QR and Rayleigh-Ritz follow, until the
residuals of the wanted eigenpairs are at the rounding level and fresh random columns show nothing larger that was missed.
No d x d matrix is formed unless the block spans the whole space (few dimensions).

Whole numbers stay exact: sums and deviations are exact integers, and rows are centred on the whole part of the mean first.

Dropped are rows whose vector is null or empty, holds null or non-finite entries, or has another length than most vectors (at a
tie the longer length stays), and those with an entry of 2^52 or more, whose x no long holds with its sums. Components without variance, those
below 1e-12 of the largest eigenvalue, can't be whitened and give no rows; so one vector alone, or an empty table, gives none.
Repeated rows and null ids are rows of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from takeoff.llm.common import documents, shipped, staged

SCALE, SHIFT, LARGEST = 1024, 100_000, 1 << 52
COMPONENTS, GUARDS, PROBES, DEGREE, ROUNDS, SEED = 8, 24, 2, 10, 40, 11
#: Residuals of the wanted pairs, as a share of the largest eigenvalue: rounding level of the passes.
TOLERANCE = 1e-13
#: Components with less than this share of the largest eigenvalue have no variance.
NO_VARIANCE = 1e-12
SLICE_BYTES = 4 << 20
LOW_BITS = 31


def vectors(table: DataFrame, keep: tuple[str, ...] = ("vec_id",), vector: str = "embedding") -> DataFrame:
    """The kept columns and `x`, the whole numbers of each vector that counts."""
    c = F.col(vector).cast("array<double>")
    whole = F.transform(c, lambda v: F.floor(v * SCALE) + SHIFT)
    rows = table.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(c, lambda v: v.isNotNull() & (F.abs(v) < LARGEST)))
    sizes = rows.groupBy(F.size(vector).alias("d")).count()
    most = sizes.orderBy(F.desc("count"), F.desc("d")).limit(1).select("d").collect()
    return rows.where(F.size(vector) == (most[0]["d"] if most else 0)).select(*keep, whole.alias("x"))


def slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray]]:
    """First row and the x-vectors of slices of about SLICE_BYTES, as a matrix of int64."""
    lists = batch.column(column)
    n = len(lists)
    if not n:
        return
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    d = len(flat) // n
    step = max(1, SLICE_BYTES // (8 * d))
    for start in range(0, n, step):
        yield start, flat[start * d : (start + step) * d].reshape(-1, d)


def added(rows: DataFrame, part: Callable[[np.ndarray], dict[int, np.ndarray]], width: int, kind: str) -> dict[int, list]:
    """Sums over all vectors of what `part` gives for a matrix of them, {row number: `width` numbers}; of `kind` bigint they are exact."""
    shipped(rows.sparkSession)
    numpy_kind, arrow = (np.int64, pa.int64()) if kind == "bigint" else (np.float64, pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in slices(batch, 0):
                for i, v in part(x).items():
                    total[i] = total[i] + v if i in total else np.asarray(v, numpy_kind)
        if total:
            table = np.stack([total[i] for i in total])
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), *(pa.array(np.ascontiguousarray(table[:, j]), arrow) for j in range(width))], names=["i", *(f"y{j}" for j in range(width))])

    schema = ", ".join(["i bigint", *(f"y{j} {kind}" for j in range(width))])
    each = [F.sum(F.col(f"y{j}").cast("decimal(38,0)") if kind == "bigint" else F.col(f"y{j}")).alias(f"y{j}") for j in range(width)]
    out = rows.select("x").mapInArrow(run, schema).groupBy("i").agg(*each)
    return {r["i"]: [r[f"y{j}"] for j in range(width)] for r in out.collect()}


@dataclass
class Moments:
    """Number of vectors, and the sums of each dimension as n * whole + rest."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n


def moments(rows: DataFrame) -> Moments:
    def part(x: np.ndarray) -> dict[int, np.ndarray]:
        high = x >> LOW_BITS
        low = x - (high << LOW_BITS)
        return dict(enumerate(np.column_stack([high.sum(axis=0), low.sum(axis=0), np.full(x.shape[1], len(x))])))

    got = added(rows, part, 3, "bigint")
    sums = [(int(got[i][0]) << LOW_BITS) + int(got[i][1]) for i in range(len(got))]
    n = int(got[0][2]) if got else 0
    return Moments(n, np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64))


def product(rows: DataFrame, at: Moments, q: np.ndarray) -> tuple[np.ndarray, float]:
    """V q and the trace of V, the covariance, in one pass over the vectors."""
    d, width = q.shape

    def part(x: np.ndarray) -> dict[int, np.ndarray]:
        c = at.centred(x)
        y = c.T @ (c @ q)
        trace = np.zeros(width)
        trace[0] = (c * c).sum()
        return {-1: trace, **dict(enumerate(y))}

    got = added(rows, part, width, "double")
    return np.array([got[i] for i in range(d)]) / at.n, got[-1][0] / at.n


@dataclass
class Spectrum:
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # unit eigenvectors, a column each
    trace: float
    residual: float  # largest residual as a share of the largest eigenvalue
    passes: int


def spectrum(rows: DataFrame, at: Moments, components: int = COMPONENTS, guards: int = GUARDS, degree: int = DEGREE, tolerance: float = TOLERANCE) -> Spectrum:
    """The largest eigenpairs of the covariance, certified by their residuals and by fresh random columns."""
    d = len(at.whole)
    wanted, rng, passes = min(components, d), np.random.default_rng(SEED), 0
    width = min(d, wanted + guards)

    def times(q: np.ndarray) -> np.ndarray:
        nonlocal passes, trace
        passes += 1
        y, trace = product(rows, at, q)
        return y

    trace, best, stalled = 0.0, np.inf, 0
    q = np.linalg.qr(rng.standard_normal((d, width)))[0]
    for _ in range(ROUNDS):
        y = times(q)
        small = q.T @ y
        theta, u = np.linalg.eigh((small + small.T) / 2)
        theta, u = theta[::-1], u[:, ::-1]
        q, y = q @ u, y @ u
        top = max(theta[0], 0.0)
        residual = np.linalg.norm(y[:, :wanted] - q[:, :wanted] * theta[:wanted], axis=0).max() / top if top else 0.0
        stalled = stalled + 1 if residual > best / 2 else 0
        best = min(best, residual)
        # the last columns were random before this round's filter: they'd hold a larger pair that the others miss
        if width == d or top == 0 or residual <= tolerance or (stalled >= 2 and residual <= 10 * tolerance):
            return Spectrum(theta[:wanted], q[:, :wanted], trace, residual, passes)
        # the filter damps [0, cut]; what lies above grows with the polynomial's degree
        cut = max(theta[-1], top * 1e-12)
        half = cut / 2
        sigma = first = half / (top - half) if top > half else 1.0
        block = np.column_stack([q[:, : width - PROBES], np.linalg.qr(rng.standard_normal((d, PROBES)))[0]]) if width > wanted + PROBES else q
        y = times(block)
        before, now = block, (y - half * block) * (sigma / half)
        for _ in range(degree - 1):
            after = 1 / (2 / first - sigma)
            before, now = now, (times(now) - half * now) * (2 * after / half) - before * (sigma * after)
            sigma = after
        q = np.linalg.qr(now)[0]
    raise RuntimeError(f"the residual is still {best:.1e} after {passes} passes")


def projected(at: Moments, found: Spectrum) -> np.ndarray:
    """The matrix that whitens centred vectors; components without variance are left out."""
    some = found.values > NO_VARIANCE * found.values[0] if len(found.values) and found.values[0] > 0 else np.zeros(len(found.values), bool)
    return found.vectors[:, some] / np.sqrt(found.values[some])


def identity_error(rows: DataFrame, at: Moments, by: np.ndarray) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    k = by.shape[1]

    def part(x: np.ndarray) -> dict[int, np.ndarray]:
        w = at.centred(x) @ by
        return {-1: w.sum(axis=0), **dict(enumerate(w.T @ w))}

    got = added(rows, part, k, "double")
    mean = np.array(got[-1]) / at.n
    return float(np.abs(np.array([got[i] for i in range(k)]) / at.n - np.outer(mean, mean) - np.eye(k)).max())


def deviations(x: np.ndarray, at: Moments) -> pa.Array:
    """Exact sums of (n x - S)^2 as decimals; null beyond 38 digits."""
    about = np.abs(at.n * (x - at.whole).astype(float) - at.rest)
    if not len(x) or float((about * about).sum(axis=1).max()) < 2**62:
        y = at.n * (x - at.whole) - at.rest
        return pa.array((y * y).sum(axis=1), pa.int64()).cast(pa.decimal128(38, 0))
    y = at.n * (x - at.whole).astype(object) - at.rest.astype(object)
    sums = [int(s) for s in (y * y).sum(axis=1)]
    return pa.array([s if s < 10**38 else None for s in sums], pa.decimal128(38, 0))


def whitened(table: DataFrame, keep: tuple[str, ...] = ("vec_id",), vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """The kept columns, n, deviation decimal(38,0), whitened array<double>, explained array<double> and identity_error of each vector that counts."""
    spark = table.sparkSession
    aliases = tuple(f"_{i}" for i in range(len(keep)))
    rows = staged(vectors(table.select(*[F.col(k).alias(a) for k, a in zip(keep, aliases, strict=True)], F.col(vector).alias("_v")), aliases, "_v"), "vectors")
    schema = T.StructType([*(T.StructField(k, rows.schema[a].dataType) for k, a in zip(keep, aliases, strict=True)), *T.StructType.fromDDL(
        "n bigint, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double").fields])
    at = moments(rows) if not rows.isEmpty() else None
    found = spectrum(rows, at, components) if at else None
    by = projected(at, found) if found else np.zeros((0, 0))
    k = by.shape[1]
    if not k:
        return spark.createDataFrame([], schema)
    error, explained, width = identity_error(rows, at, by), (found.values[:k] / found.trace).tolist(), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, x in slices(batch, width):
                m = len(x)
                w = (at.centred(x) @ by).reshape(-1)
                ends = pa.array(np.arange(m + 1, dtype=np.int32) * k)
                share = pa.ListArray.from_arrays(ends, pa.array(np.tile(explained, m)))
                kept = batch.slice(start, m).columns[:width]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.full(m, at.n)), deviations(x, at), pa.ListArray.from_arrays(ends, pa.array(w)), share, pa.array(np.full(m, error))], names=schema.names)

    return rows.select(*aliases, "x").mapInArrow(run, schema)


def op11_chebyshev_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitened(documents(spark, sf_dir, "embeddings"))
    one = rows.select("*", F.posexplode(F.arrays_zip("whitened", "explained")).alias("k", "pair"))
    return one.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"),
                      F.col("pair.whitened").alias("whitened"), F.col("pair.explained").alias("explained"), "identity_error")
