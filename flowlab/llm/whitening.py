"""Embedding whitening from an incremental eigendecomposition.

1. Every partition keeps the spectrum of the vectors seen so far: count, mean,
   eigenvalues and eigenvectors of their scatter matrix. ``BATCH`` vectors are
   centred and reduced to the rows of their triangular factor, which have the
   same scatter in no more rows than dimensions. Each such row, and the
   difference of the means, is a centred rank-one update: in the eigenbasis a
   diagonal plus one outer product, whose eigenvalues are the roots of a secular
   equation. Coordinates without weight and equal eigenvalues are deflated first.
2. Spectra combine by successive rank-one updates: one for every eigenpair of
   the other spectrum and one for the difference of the means. ``FAN`` spectra
   meet in a group; levels follow until one is left.
3. A distributed Rayleigh-Ritz pass projects the centred fit list on that basis
   and diagonalises the projected covariance, which takes out what rounding the
   many updates gathered and leaves double precision.

The driver holds one spectrum (dimension squared numbers) and sums per
dimension; sums are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlab.llm.common import cut_lineage, table

SCALE = 256
COMPONENTS = 4
UNIT = 8192  # fit vectors of a partition
BATCH = 1024  # vectors reduced to one triangular factor
FAN = 16  # spectra combined in a group
EPS = np.finfo(float).eps
SPECTRUM = "unit long, n long, mean array<double>, val array<double>, vec array<double>, total array<decimal(38,0)>"


def secular(d: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum_j w_j / (d_j - x) = 0 for ascending d and positive w: x_i = d[origin_i] + shift_i.

    Root i lies between d_i and d_i+1 (the last: up to sum of w further). The
    shift is counted from the nearer pole, so differences to all poles stay
    accurate. Each step fits one pole on either side to value and slope and
    falls back to halving the bracket.
    """
    k = len(d)
    gap = np.append(np.diff(d), w.sum())
    upper = np.append(d[1:], d[-1] + gap[-1])
    rows = np.arange(k)
    middle = 1 + (w / ((d[None, :] - d[:, None]) - (gap / 2)[:, None])).sum(1)
    origin = np.where((middle >= 0) | (rows == k - 1), rows, rows + 1)
    right = origin > rows
    delta = d[None, :] - d[origin][:, None]
    lo = np.where(right, -gap / 2, 0.0)
    hi = np.where(right, 0.0, np.where(rows == k - 1, np.where(middle >= 0, gap / 2, gap), gap / 2))
    lo = np.where((rows == k - 1) & (middle < 0), gap / 2, lo)
    x = (lo + hi) / 2
    below = rows[None, :] <= rows[:, None]
    left, after = d - d[origin], upper - d[origin]
    open_ = np.ones(k, bool)
    for _ in range(80):
        a = np.flatnonzero(open_)
        inv = 1 / (delta[a] - x[a, None])
        term = w * inv
        low = np.where(below[a], term, 0.0)
        psi, phi = low.sum(1), (term - low).sum(1)
        slope = term * inv
        part = np.where(below[a], slope, 0.0)
        dpsi, dphi = part.sum(1), (slope - part).sum(1)
        f = 1 + psi + phi
        lo[a], hi[a] = np.where(f < 0, x[a], lo[a]), np.where(f < 0, hi[a], x[a])
        done = (np.abs(f) <= 4 * EPS * (1 + np.abs(psi) + np.abs(phi))) | (hi[a] - lo[a] <= 2 * EPS * np.maximum(np.abs(lo[a]), np.abs(hi[a])))
        l, r = left[a] - x[a], after[a] - x[a]
        s, t = dpsi * l * l, dphi * r * r
        c = 1 + (psi - dpsi * l) + (phi - dphi * r)
        # c + s / (l - e) + t / (r - e) = 0 for the step e
        p, q = c * (l + r) + s + t, c * l * r + s * r + t * l
        root = np.sqrt(np.maximum(p * p - 4 * c * q, 0))
        with np.errstate(all="ignore"):
            e = np.where(p > 0, 2 * q / (p + root), (p - root) / (2 * c))
        new = x[a] + e
        bad = ~((new > lo[a]) & (new < hi[a]))
        x[a] = np.where(done, x[a], np.where(bad, (lo[a] + hi[a]) / 2, new))
        open_[a] = ~done
        if not open_.any():
            break
    return origin, x


def rank_one(val: np.ndarray, vec: np.ndarray, rho: float, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending eigenvalues and eigenvectors of vec diag(val) vec' + rho v v', for rho >= 0 and an orthonormal vec."""
    z = vec.T @ v
    norm = float(np.sqrt(z @ z))
    tol = 8 * EPS * max(float(np.abs(val).max(initial=0)), rho * norm * norm)
    live = rho * norm * np.abs(z) > tol
    if not live.any():
        return val, vec
    val, at = val.copy(), np.flatnonzero(live)
    a, b = z[at[:-1]], z[at[1:]]
    if (np.abs((val[at[1:]] - val[at[:-1]]) * a * b) <= tol * (a * a + b * b)).any():
        vec = vec.copy()
        last = at[0]
        for i in at[1:]:
            tau = float(np.hypot(z[last], z[i]))
            c, s = z[i] / tau, -z[last] / tau
            if abs((val[i] - val[last]) * c * s) <= tol:  # equal values: turn all weight to one of the pair
                p, q = vec[:, last].copy(), vec[:, i]
                vec[:, last], vec[:, i] = c * p + s * q, -s * p + c * q
                low, high = val[last], val[i]
                val[last], val[i] = low * c * c + high * s * s, low * s * s + high * c * c
                z[i], z[last], live[last] = tau, 0.0, False
            last = i
        at = np.flatnonzero(live)
        at = at[np.argsort(val[at], kind="stable")]
    d, w = val[at], rho * z[at] ** 2
    k = len(at)
    if k == 1:
        val[at] = d + w
        turned = vec[:, at]
    else:
        origin, shift = secular(d, w)
        diff = (d[None, :] - d[origin][:, None]) - shift[:, None]  # d_j - x_i
        # weights for which the computed roots are exact: keeps the vectors orthogonal
        poles = d[:, None] - d[None, :]
        np.fill_diagonal(poles, 1.0)
        z2 = np.abs(np.prod(diff / poles, axis=0))
        turn = (np.sqrt(z2) * np.sign(z[at]))[:, None] / diff.T
        turn /= np.sqrt((turn * turn).sum(0))
        turned = vec[:, at] @ turn
        val[at] = d[origin] + shift
    out = vec.copy()
    out[:, at] = turned
    order = np.argsort(val, kind="stable")
    return val[order], out[:, order]


class Spectrum:
    """Count, mean and eigen-decomposed scatter of a set of vectors."""

    def __init__(self, dim: int):
        self.n, self.mean, self.val, self.vec = 0, np.zeros(dim), np.zeros(dim), np.eye(dim)

    def add(self, v: np.ndarray) -> None:
        step = v - self.mean
        if self.n:
            self.val, self.vec = rank_one(self.val, self.vec, self.n / (self.n + 1), step)
        self.n += 1
        self.mean = self.mean + step / self.n

    def add_all(self, x: np.ndarray) -> None:
        """Adds the rows of x: rank-one updates by their centred triangular factor, which has the rows' scatter in at most dim rows."""
        if not len(x):
            return
        mean = x.mean(0)
        factor = x - mean
        if len(factor) > len(mean):
            factor = np.linalg.qr(factor, mode="r")
        for v in factor:
            self.val, self.vec = rank_one(self.val, self.vec, 1.0, v)
        step, n = mean - self.mean, self.n + len(x)
        if self.n:
            self.val, self.vec = rank_one(self.val, self.vec, self.n * len(x) / n, step)
        self.mean, self.n = self.mean + step * (len(x) / n), n

    def merge(self, other: Spectrum) -> None:
        if not (self.n and other.n):
            if other.n:
                self.__dict__.update(other.__dict__)
            return
        for value, v in zip(other.val, other.vec.T):
            if value > 0:
                self.val, self.vec = rank_one(self.val, self.vec, float(value), v)
        step, n = other.mean - self.mean, self.n + other.n
        self.val, self.vec = rank_one(self.val, self.vec, self.n * other.n / n, step)
        self.mean, self.n = self.mean + step * (other.n / n), n

    def row(self, unit: int, total: list) -> dict:
        return {"unit": unit, "n": self.n, "mean": self.mean, "val": self.val, "vec": self.vec.ravel(), "total": total}

    @staticmethod
    def of(row) -> Spectrum:
        out = Spectrum(len(row.mean))
        out.n, out.mean, out.val = int(row.n), np.asarray(row.mean), np.asarray(row.val)
        out.vec = np.asarray(row.vec).reshape(len(out.val), -1)
        return out


def quantised(c: Column) -> Column:
    """floor(256 * c) of every entry as long; null if the vector is null or holds null or non-finite entries."""
    bad = F.exists(c, lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) == float("inf")))
    return F.when(~bad, F.transform(c, lambda e: F.floor(F.lit(SCALE) * e.cast("double")).cast("long")))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def exact_sums(x: np.ndarray) -> list[int]:
    """Column sums of long integers, exact."""
    if float(np.abs(x.astype(float)).max(initial=0)) * len(x) >= 2.0**62:
        return [sum(map(int, col)) for col in x.T]
    return [int(s) for s in x.sum(0)]


def spectra(fit: DataFrame, dim: int) -> DataFrame:
    """One spectrum for every partition of the fit list, with the exact sums of its vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, state, total = 0, Spectrum(dim), [0] * dim
        for batch in batches:
            x = matrix(batch.column(0))
            if len(x):
                unit = batch.column(1)[0].as_py()
                total = [a + b for a, b in zip(total, exact_sums(x))]
                for at in range(0, len(x), BATCH):
                    state.add_all(x[at:at + BATCH].astype(float))
        if state.n:
            out = state.row(unit, [Decimal(t) for t in total])
            kinds = {"unit": pa.int64(), "n": pa.int64(), "total": pa.list_(pa.decimal128(38, 0))}
            yield pa.RecordBatch.from_arrays([pa.array([v], kinds.get(k, pa.list_(pa.float64()))) for k, v in out.items()], list(out))

    return fit.select("x", F.spark_partition_id().cast("long").alias("unit")).mapInArrow(run, SPECTRUM)


def combined(parts: DataFrame) -> DataFrame:
    """One spectrum from all: groups of ``FAN`` neighbours meet, level by level."""
    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("unit")
        state, total = None, None
        for row in rows.itertuples():
            one = Spectrum.of(row)
            if state is None:
                state, total = one, list(row.total)
            else:
                state.merge(one)
                total = [Decimal(int(a) + int(b)) for a, b in zip(total, row.total)]
        return pd.DataFrame([state.row(int(rows["unit"].iloc[0]) // FAN, total)])

    parts = cut_lineage(parts)
    while parts.agg(F.max("unit")).first()[0]:
        parts = cut_lineage(parts.groupBy(F.floor(F.col("unit") / FAN).alias("g")).applyInPandas(meet, SPECTRUM))
    return parts


def projected_covariance(fit: DataFrame, mean: np.ndarray, basis: np.ndarray, n: int) -> np.ndarray:
    """Covariance (divisor n) of the centred fit vectors in an orthonormal basis; summed in Spark by entry."""
    k = basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            y = (matrix(batch.column(0)) - mean) @ basis
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["h"])

    parts = fit.select("x").mapInArrow(run, "h array<double>").select(F.posexplode("h").alias("at", "v"))
    h = np.zeros(k * k)
    for r in parts.groupBy("at").agg(F.sum("v").alias("v")).collect():  # dimension squared numbers
        h[r["at"]] = r["v"]
    return h.reshape(k, k) / n


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for every valid row and component.

    Rows whose vector is null or holds null or non-finite entries are dropped.
    Entries become x = floor(256 c). The fit list holds every distinct x vector
    once; n, the mean, and the covariance (divisor n, centred first) are over
    it. Components are numbered from 1 by falling eigenvalue; each points to
    the side of its largest entry. ``deviation`` is the exact sum of
    (n x - S)^2; null above 2^63 - 1, which no long holds. Components without
    variance (beyond the rank, or of a single vector) have no rows, as dividing
    by their zero deviation has no result. Only vectors of the most common
    length (the longest of equally common ones) take part; others, and empty
    vectors, are dropped like invalid ones. Repeated rows and null ids stay;
    other columns are ignored; an empty table gives an empty table.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = vectors.select(F.col(id_col).alias("id"), quantised(F.col(vector_col)).alias("x")).where("size(x) > 0")
    common = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if common is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dim = common["dim"]
    rows = rows.where(F.size("x") == dim)
    distinct = rows.select("x").groupBy("x").agg(F.count("*").alias("copies")).select("x").persist()
    n = distinct.count()
    fit = distinct.repartition(-(-n // UNIT), "x").persist()
    try:
        one = combined(spectra(fit, dim)).first()
        sums = [int(t) for t in one["total"]]
        mean = np.array([s / n for s in sums])
        basis, _ = np.linalg.qr(Spectrum.of(one).vec)
        h = projected_covariance(fit, mean, basis, n)
        value, turn = np.linalg.eigh((h + h.T) / 2)
        trace = float(np.trace(h))
        order = np.argsort(-value)[:components]
        order = order[value[order] > dim * EPS * max(trace, 0.0)]
        axes = basis @ turn[:, order]
        axes *= np.sign(axes[np.abs(axes).argmax(0), np.arange(len(order))]) if len(order) else 1
        scaled, explained = axes / np.sqrt(value[order]), [float(v / trace) for v in value[order]]
        error = identity_error(project(fit.withColumn("id", F.lit(0)), "int", n, sums, mean, scaled), len(order))
    finally:
        fit.unpersist()
        distinct.unpersist()
    if not len(order):
        return vectors.sparkSession.createDataFrame([], schema)
    each = project(rows, kind, n, sums, mean, scaled).select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                       F.get(F.array(*map(F.lit, explained)), F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))


def project(rows: DataFrame, kind: str, n: int, sums: list[int], mean: np.ndarray, scaled: np.ndarray) -> DataFrame:
    """(id, deviation, whitened): the exact deviation and the whitened coordinates of every row of x."""
    largest = max(map(abs, sums))
    whole = np.array(sums, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1))
            if not len(x):
                continue
            reach = n * max(abs(int(x.max())), abs(int(x.min()))) + largest
            if reach * reach * x.shape[1] < 2**63:
                off = n * x - whole.astype(np.int64)
                deviation = pa.array((off * off).sum(1))
            else:
                exact = [int(((n * v - whole) ** 2).sum()) for v in x.astype(object)]
                deviation = pa.array([e if e < 2**63 else None for e in exact], pa.int64())
            y = (x - mean) @ scaled
            lists = pa.ListArray.from_arrays(np.arange(0, y.size + 1, max(y.shape[1], 1), dtype=np.int32) if y.shape[1] else np.zeros(len(x) + 1, np.int32),
                                             pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), deviation, lists], ["id", "deviation", "whitened"])

    return rows.select("id", "x").mapInArrow(run, f"id {kind}, deviation long, whitened array<double>")


def identity_error(fit: DataFrame, k: int) -> float:
    """Largest absolute entry of the fit list's whitened covariance minus the identity (0 without components)."""
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    if not pairs:
        return 0.0
    got = fit.agg(*[F.covar_pop(F.get("whitened", F.lit(i)), F.get("whitened", F.lit(j))).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(got[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of every valid vector of ``embeddings``."""
    return whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
