"""Embedding whitening by mixed-precision eigenvectors of a distributed covariance.

Entries become whole numbers, ``floor(scale * c)``. The fit takes each distinct
vector once. Its sums come first; then each task multiplies its rows, centred at
the rounded means, and adds up whole numbers, so that the covariance is exact,
rounded once, and the same however the rows are dealt. Its eigenvectors start in
float32 and are corrected by Ogita-Aishima iterations, which are matrix products
in extended precision. Eigenvalues too close to be told apart by an iteration
form clusters, whose basis comes from a small eigenproblem of its own, shifted to
the cluster's mean.

Only tables of d x d numbers reach the driver, a few from each of a bounded
number of tasks; d is the vectors' length.

Defined results: vectors that are null, empty, or hold a null or non-finite entry
take no part, nor do vectors of another length than the most frequent one among
the distinct vectors (ties: the shorter); entries and deviations beyond a long
become its nearest end; components without variance are left out, so that a table
of one distinct vector, or of none, gives no rows; repeated rows and rows with
null ids are whitened each; other columns do not matter.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_folder

_LONG = (-(1 << 63), (1 << 63) - 1)
#: Whole doubles up to here add up exactly.
_EXACT = 1 << 53
#: Tasks whose sums meet in the driver.
TASKS = 64


def whole(vec_col: str, scale: int) -> Column:
    """floor(scale * c) of each entry as a long, or null if the vector takes no part."""
    v = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return F.when((F.size(v) > 0) & ~bad, F.transform(v, lambda c: F.floor(F.lit(float(scale)) * c).cast("long")))


# Eigenvectors


def clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Places of neighbouring values, in rising order, that lie closer than ``gap`` one by one."""
    order = np.argsort(values)
    return np.split(order, 1 + np.flatnonzero(np.diff(values[order]) > gap))


def refined(matrix: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix in extended precision."""
    size = np.abs(matrix).max(initial=0)
    if not size > 0:
        return np.zeros(len(matrix)), np.eye(len(matrix))
    a = (matrix / size).astype(np.longdouble)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    eye, norm = np.eye(len(a), dtype=np.longdouble), np.sqrt((a * a).sum())
    finest = 4 * len(a) * np.finfo(np.longdouble).eps
    last = np.inf
    for _ in range(rounds):
        r, s = eye - x.T @ x, x.T @ a @ x
        s = (s + s.T) / 2  # rounding apart from symmetry would come back over the gaps
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(np.diag(s))
        # Zero off the diagonal where two vectors are as far apart as the matrix wants them.
        turn = off + (values[None, :] + values[:, None]) / 2 * (r - np.diag(np.diag(r)))
        left = np.abs(turn).max() / norm + np.abs(r).max()
        if left <= finest or (left < 1e-15 and left >= last):
            break
        last = left
        # Below this gap an iteration can't tell two values apart, nor is there anything to turn below the matrix's own rounding.
        delta = max(2 * (np.sqrt((off * off).sum()) + norm * np.sqrt((r * r).sum())), finest * norm)
        distance = values[None, :] - values[:, None]
        apart = (np.abs(distance) > delta) & (np.abs(turn) > finest * norm)
        x = x + x @ (r / 2 + np.where(apart, turn / np.where(apart, distance, 1), 0))
        for group in clusters(values, float(delta)):
            if len(group) > 1:  # a small problem of the cluster's own, whose entries are as small as its spread
                part = x[:, group]
                inner = part.T @ ((a - values[group].mean() * eye) @ part)
                spread = np.abs(inner).max()
                if spread > finest * norm:
                    x[:, group] = part @ np.linalg.eigh(((inner + inner.T) / (2 * spread)).astype(np.float64))[1]
    else:
        raise RuntimeError("eigenvectors have not settled")
    x /= np.sqrt((x * x).sum(axis=0))
    values = (x * (a @ x)).sum(axis=0) * size
    order = np.argsort(-values, kind="stable")
    return values[order], x[:, order]


# Sums over all rows


def _matrix(rows: pd.Series, dims: int) -> np.ndarray:
    return np.array(rows.tolist(), dtype=np.int64).reshape(len(rows), dims)


def _as_is(x: np.ndarray) -> np.ndarray:
    """The same whole numbers without a bound on their size."""
    return x.astype(object)


def _magnitude(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def centred(x: np.ndarray, centre: list[int]) -> np.ndarray:
    """x less whole numbers, as longs, or without a bound where longs can't hold it."""
    bound = _magnitude(x) + max(map(abs, centre), default=0)
    return x - np.array(centre, np.int64) if bound < 1 << 62 else _as_is(x) - np.array(centre, object)


def products(y: np.ndarray) -> np.ndarray:
    """y' y in whole numbers: in doubles while these are exact."""
    if y.dtype != object and _magnitude(y) ** 2 * max(1, len(y)) < _EXACT:
        f = y.astype(np.float64)
        return _as_is((f.T @ f).astype(np.int64))
    return _as_is(y).T @ _as_is(y)


def totals(rows: DataFrame, of, tasks: int = TASKS) -> list[int]:
    """Sums of the whole numbers that ``of`` makes of each batch of rows, as strings between tasks; one row a task, added up in ``tasks`` of them."""

    def summed(batches: Iterator[pd.DataFrame], make) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            for part in make(pdf):
                total = part if total is None else [a + b for a, b in zip(total, part, strict=True)]
        if total is not None:
            yield pd.DataFrame({"sums": [list(map(str, total))]})

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return summed(batches, lambda pdf: [of(pdf)] if len(pdf) else [])

    def then(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return summed(batches, lambda pdf: ([int(v) for v in row] for row in pdf["sums"]))

    found = rows.mapInPandas(first, "sums array<string>").repartition(tasks).mapInPandas(then, "sums array<string>")
    parts = [[int(v) for v in r["sums"]] for r in found.collect()]
    return [sum(column) for column in zip(*parts, strict=True)]


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors with sums; components (rows) with eigenvalues; trace of the covariance; largest departure from whiteness."""

    scale: int
    n: int
    sums: tuple[int, ...]
    components: tuple[tuple[float, ...], ...]
    values: tuple[float, ...]
    trace: float
    identity_error: float = 0.0

    @property
    def centre(self) -> list[int]:
        """The rounded means."""
        return [(2 * s + self.n) // (2 * self.n) for s in self.sums]

    def project(self, x: np.ndarray) -> np.ndarray:
        """(x - mean) on each component over the root of its eigenvalue; x minus the rounded mean is exact."""
        rest = np.array([float(Fraction(s - self.n * c, self.n)) for s, c in zip(self.sums, self.centre, strict=True)])
        y = centred(x, self.centre).astype(np.float64) - rest
        # Summed row by row, so that equal rows get equal numbers wherever they stand.
        return np.stack([(y * np.array(c)).sum(axis=1) / math.sqrt(e) for c, e in zip(self.components, self.values, strict=True)], axis=1)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Sums over entries of (n * x - S)**2 in whole numbers; beyond a long its largest."""
        y = centred(x, self.centre)
        rest = [s - self.n * c for s, c in zip(self.sums, self.centre, strict=True)]
        most = self.n * _magnitude(y) + max(map(abs, rest))
        if y.dtype != object and most * most * len(rest) < _LONG[1]:
            z = self.n * y - np.array(rest, np.int64)
            return (z * z).sum(axis=1)
        z = self.n * _as_is(y) - np.array(rest, object)
        return np.array([min(int(v), _LONG[1]) for v in (z * z).sum(axis=1)], np.int64)


def fit(vectors: DataFrame, k: int = 4, scale: int = 256, vec_col: str = "embedding") -> Whitening | None:
    """Learn from each distinct vector once; None if no component has variance."""
    spark = vectors.sparkSession
    folder = f"{shared_folder(spark)}/whitening-{uuid.uuid4().hex}"
    vectors.select(whole(vec_col, scale).alias("x")).where("x is not null").distinct().write.parquet(folder)
    distinct = spark.read.parquet(folder)
    lengths = distinct.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if lengths is None:
        return None
    dims, n = lengths["d"], lengths["n"]
    rows = distinct.where(F.size("x") == dims)

    def add(pdf: pd.DataFrame) -> list[int]:
        x = _matrix(pdf["x"], dims)
        return [int(v) for v in (x if _magnitude(x) * len(x) < _LONG[1] else _as_is(x)).sum(axis=0)]

    sums = tuple(totals(rows, add))
    model = Whitening(scale, n, sums, (), (), 0.0)
    centre, upper = model.centre, np.triu_indices(dims)

    def multiply(pdf: pd.DataFrame) -> list[int]:
        return products(centred(_matrix(pdf["x"], dims), centre))[upper].tolist()

    # n * sum(y y') - t t' over n * n, of whole y = x - centre with sums t: exact until the one rounding.
    rest = [s - n * c for s, c in zip(sums, centre, strict=True)]
    gram = totals(rows, multiply)
    v = np.zeros((dims, dims), np.longdouble)
    for i, j, g in zip(*upper, gram, strict=True):
        v[i, j] = v[j, i] = _extended(Fraction(n * g - rest[i] * rest[j], n * n))
    trace = float(np.trace(v))
    values, basis = refined(v)
    kept = [i for i in range(min(k, dims)) if values[i] > 1e-12 * trace]
    if not kept:
        return None
    model = Whitening(scale, n, sums, tuple(tuple(map(float, basis[:, i])) for i in kept), tuple(float(values[i]) for i in kept), trace)
    return replace(model, identity_error=identity_error(rows, model))


def _extended(x: Fraction) -> np.longdouble:
    high = float(x)
    return np.longdouble(high) + np.longdouble(float(x - Fraction(high)))


def _joined(a: tuple, b: tuple) -> tuple:
    """Count, mean and centred products of two parts together."""
    (n, p, s), (m, q, t) = a, b
    d = q - p
    return n + m, p + d * (m / (n + m)), s + t + np.outer(d, d) * (n * m / (n + m))


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance, centred part by part, less the identity."""
    k, dims = len(model.values), len(model.sums)

    def merged(parts: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        total = None
        for part in parts:
            total = part if total is None else _joined(total, part)
        if total is not None:
            yield pd.DataFrame({"n": [total[0]], "mean": [total[1].tolist()], "products": [total[2].ravel().tolist()]})

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def parts() -> Iterator[tuple]:
            for pdf in batches:
                if len(pdf):
                    w = model.project(_matrix(pdf["x"], dims))
                    mean = w.mean(axis=0)
                    yield len(w), mean, (w - mean).T @ (w - mean)

        return merged(parts())

    def read(pdf: pd.DataFrame) -> Iterator[tuple]:
        for n, mean, p in zip(pdf["n"], pdf["mean"], pdf["products"], strict=True):
            yield int(n), np.array(mean), np.array(p).reshape(k, k)

    def together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return merged(part for pdf in batches for part in read(pdf))

    schema = "n long, mean array<double>, products array<double>"
    found = rows.mapInPandas(measure, schema).repartition(TASKS).mapInPandas(together, schema).toPandas()
    n, _, p = next(read(next(merged(read(found)))))
    return float(np.abs(p / n - np.eye(k)).max())


def whiten(vectors: DataFrame, model: Whitening | None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per row that takes part and component: id, component (from 1), n, deviation, whitened, explained, identity_error."""
    # Ids travel as text, so that a null beside them leaves long ones whole.
    given = vectors.select(F.col(id_col).cast("string").alias("id"), whole(vec_col, model.scale if model else 1).alias("x")).where("x is not null")
    dims, k = (len(model.sums), len(model.values)) if model else (0, 0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = _matrix(pdf["x"], dims)
            out = pd.DataFrame({"id": np.repeat(pdf["id"].to_numpy(), k), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))})
            yield out.assign(n=model.n, deviation=np.repeat(model.deviations(x), k), whitened=model.project(x).ravel(), explained=np.tile(np.array(model.values) / model.trace, len(x)), identity_error=model.identity_error)

    found = given.where(F.size("x") == dims).mapInPandas(run, "id string, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return found.select(F.col("id").cast(vectors.schema[id_col].dataType).alias(id_col), *found.columns[1:])
