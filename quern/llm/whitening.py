"""Whitening of vectors: counts, means and centred scatters of partitions, merged in pairs; eigenvectors on the driver; a second pass that verifies."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.tables import materialize

#: Entries are counted in steps of one over this number.
STEPS = 256
#: Eigenvalues up to this share of the greatest are rounding: there is nothing to whiten along their vectors.
NOISE = 1e-12


class Moments(NamedTuple):
    """Of some vectors: their number, exact sums, mean, and the sum of the outer products of what is left without the mean."""

    n: int
    sums: list[int]
    mean: np.ndarray
    scatter: np.ndarray


class Whitening(NamedTuple):
    """A fit: number and exact sums of its vectors, their mean, components (rows, by falling eigenvalue), eigenvalues, the trace, and the greatest error of the covariance of what is whitened."""

    n: int
    sums: list[int]
    mean: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float
    error: float


def moments(x: np.ndarray) -> Moments:
    """Of the rows of x, whole or floating-point numbers. Sums of whole numbers are exact, by halves of 32 bits; others have none."""
    whole = x.dtype.kind == "i"
    sums = [int(a) * (1 << 32) + int(b) for a, b in zip((x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0), strict=True)] if whole else []
    mean = np.array([s / len(x) for s in sums]) if whole else x.mean(axis=0)
    rest = x - mean
    return Moments(len(x), sums, mean, rest.T @ rest)


def merged(a: Moments, b: Moments) -> Moments:
    """Chan's formula: the scatters add up, and with them the outer product of the difference of means by n_a n_b / n."""
    n = a.n + b.n
    apart = b.mean - a.mean
    sums = [s + t for s, t in zip(a.sums, b.sums, strict=True)]
    mean = np.array([s / n for s in sums]) if sums else a.mean + apart * (b.n / n)
    return Moments(n, sums, mean, a.scatter + b.scatter + np.outer(apart, apart) * (a.n * b.n / n))


def merged_by_length(a: dict[int, Moments], b: dict[int, Moments]) -> dict[int, Moments]:
    return {d: merged(a[d], b[d]) if d in a and d in b else a.get(d) or b[d] for d in a.keys() | b.keys()}


def matrix(column: pa.Array, length: int) -> np.ndarray:
    """A list column, all of one length, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), length)


def by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The lengths of the vectors of a list column, which rows have each, and their matrix."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        yield int(d), rows, matrix(column.take(pa.array(rows)), int(d))


def total(vectors: DataFrame, of: Callable[[int, np.ndarray], np.ndarray]) -> dict[int, Moments]:
    """The moments of of(length, matrix) over all rows of vectors (x), by length: each partition's, merged in a tree of tasks. The driver gets one matrix for each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, Moments] = {}
        for batch in batches:
            for d, _, x in by_length(batch.column("x")):
                own = merged_by_length(own, {d: moments(of(d, x))})
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(own)], pa.binary())], ["state"])

    states = vectors.mapInArrow(run, "state binary").rdd.map(lambda r: pickle.loads(r.state))
    return states.union(vectors.sparkSession.sparkContext.parallelize([{}], 1)).treeReduce(merged_by_length, 3)


def whole_steps(vector: Column) -> Column:
    """The entries of a vector as whole numbers of steps, in double precision and rounded down; null if one is null, isn't finite or has no place in 64 bits."""
    scaled = F.transform(vector, lambda c: c.cast("double") * STEPS)
    sound = F.forall(scaled, lambda c: F.coalesce(F.abs(c) < float(1 << 63), F.lit(False)))
    return F.when(sound, F.transform(scaled, lambda c: F.floor(c)))


def projected(fit: Whitening, x: np.ndarray, k: int) -> np.ndarray:
    """Rows of x without the mean, along the first k components, over the roots of their eigenvalues; NaN where there is nothing to whiten."""
    flat = fit.values[:k] <= NOISE * (fit.values[0] if len(fit.values) else 0)
    return ((x - fit.mean) @ fit.components[:k].T) / np.where(flat, np.nan, np.sqrt(np.maximum(fit.values[:k], 0)))


def fitted(vectors: DataFrame, k: int) -> dict[int, Whitening]:
    """The fit of each length of vectors (x), whole numbers, all distinct. The second pass whitens them and compares their covariance with the identity."""
    fits = {}
    for d, m in total(vectors, lambda _, x: x).items():
        values, columns = np.linalg.eigh(m.scatter / m.n)
        rows = columns.T[::-1]
        greatest = np.abs(rows).argmax(axis=1) if d else np.zeros(0, np.int64)
        rows = rows * np.sign(rows[np.arange(d), greatest])[:, None]
        fits[d] = Whitening(m.n, m.sums, m.mean, rows[:k], values[::-1][:k], float(np.trace(m.scatter)) / m.n, 0.0)
    for d, m in total(vectors, lambda d, x: projected(fits[d], x, k)).items():
        apart = np.abs(m.scatter / m.n - np.eye(len(m.mean)))
        fits[d] = fits[d]._replace(error=float(np.nanmax(apart)) if apart.size and not np.isnan(apart).all() else 0.0)
    return fits


def deviations(fit: Whitening, x: np.ndarray) -> list[int]:
    """The sum of (n x - sum)**2 of each row, exact: in 64 bits where no sum can exceed them, else in whole numbers of any size; one over 64 bits raises OverflowError."""
    bound = max(max(abs(int(x.min())), abs(int(x.max()))) * fit.n + max(map(abs, fit.sums)), 1) if x.size else 1
    if bound < 1 << 62 and bound * bound * max(1, x.shape[1]) < 1 << 63:
        return ((x * fit.n - np.array(fit.sums, np.int64)) ** 2).sum(axis=1).tolist()
    out = [sum((fit.n * int(v) - s) ** 2 for v, s in zip(row, fit.sums, strict=True)) for row in x]
    if max(out, default=0) >= 1 << 63:
        raise OverflowError("a deviation takes more than 64 bits")
    return out


def whiten(df: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each sound vector of df and each of its first k components, numbered from 1: id_col, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null, or hold entries that are null, not finite or over 64 bits in steps, are left out. The fit takes each distinct vector
    once. Vectors of each length have a fit of their own; those of fewer than k entries have as many components. Along a component without
    variance whitened is null; of vectors all equal explained is null too. Repeated rows and null ids come back each; an empty table gives an
    empty one. Components have either sign, the same for all rows: their greatest entry is positive. The driver has a matrix for each length."""
    rows = materialize(df.select(F.col(id_col).alias("id"), whole_steps(F.col(vector_col)).alias("x")).where("x IS NOT NULL"))
    fits = fitted(materialize(rows.select("x").distinct()), k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at, x in by_length(batch.column("x")):
                fit, m = fits[d], min(k, d)
                white = projected(fit, x, k).reshape(-1)
                ids = batch.column("id").take(pa.array(np.repeat(at, m)))
                shares = np.tile(fit.values / fit.trace if fit.trace > 0 else np.full(m, np.nan), len(x))
                columns = [np.tile(np.arange(1, m + 1, dtype=np.int32), len(x)), np.full(len(x) * m, fit.n), np.repeat(np.array(deviations(fit, x), np.int64), m)]
                doubles = [pa.array(c, pa.float64(), mask=np.isnan(c)) for c in (white, shares)]
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, columns), *doubles, pa.array(np.full(len(x) * m, fit.error))], names)

    names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double").withColumnRenamed("id", id_col)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 4)
