"""Empirical characteristic functions and cosine-series densities, d <= 2."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Numbers in a task's largest matrix of one chunk, whatever the grid.
CHUNK_CELLS = 1 << 22
SLAB_ROWS = 1 << 16

# Rows are spread onto a grid of twice the wanted frequencies with a kernel of WIDTH cells;
# the relative error of the sums is then some 1e-12 of the number of rows.
WIDTH = 15
SHAPE = 2.3 * WIDTH
SPREAD_ROWS = 1 << 16
# From this many frequencies a column the transform is cheaper than the direct sums.
FFT_FROM = 16


def _kernel(z: np.ndarray) -> np.ndarray:
    return np.exp(SHAPE * (np.sqrt(np.clip(1.0 - z * z, 0.0, None)) - 1.0))


def _kernel_transform(m: int, modes: np.ndarray) -> np.ndarray:
    """Fourier transform of the spreading kernel on a grid of m cells, by Gauss-Legendre nodes."""
    z, w = np.polynomial.legendre.leggauss(4 * WIDTH)
    half = WIDTH / 2
    return half * np.cos(np.outer(2 * math.pi * modes * half / m, z)) @ (w * _kernel(z))


class Spectrum:
    """Sums of exp(i k'theta) over rows, for 0 <= k1 < k and |k2| < k, by a non-uniform FFT.

    `add` spreads rows onto an oversampled grid at a cost per row that does not depend on k;
    `modes` transforms the grid once and divides the kernel out. Holds (4k + 2 * WIDTH)^d
    numbers. A value that is not finite makes all sums NaN, as in direct sums."""

    def __init__(self, k: int, d: int):
        self.k, self.d = k, d
        self.m = max(4 * k, 2 * WIDTH)
        self.grid = np.zeros((self.m + WIDTH,) * d)

    def add(self, theta: np.ndarray) -> None:
        """theta: (rows, d) angles in radians."""
        for lo in range(0, len(theta), SPREAD_ROWS):
            self._add(theta[lo : lo + SPREAD_ROWS])

    def _add(self, theta: np.ndarray) -> None:
        fine = np.isfinite(theta).all(axis=1)
        if not fine.all():
            self.grid.flat[0] = np.nan
            theta = theta[fine]
        at = np.mod(theta / (2 * math.pi), 1.0) * self.m
        first = np.ceil(at - WIDTH / 2).astype(np.int64)
        weights = [
            _kernel((first[:, i, None] + np.arange(WIDTH) - at[:, i, None]) / (WIDTH / 2)) for i in range(self.d)
        ]
        # Cells are counted from the first one of the row; the border is folded back at the end.
        first = np.mod(first, self.m)
        side, size = self.m + WIDTH, self.grid.size
        flat = self.grid.reshape(-1)
        if self.d == 1:
            for a in range(WIDTH):
                flat += np.bincount(first[:, 0] + a, weights[0][:, a], size)
            return
        base = first[:, 0] * side + first[:, 1]
        for a in range(WIDTH):
            for b in range(WIDTH):
                flat += np.bincount(base + a * side + b, weights[0][:, a] * weights[1][:, b], size)

    def modes(self) -> np.ndarray:
        """(k,) or (k, 2k - 1) sums; the second axis runs from -(k - 1) to k - 1."""
        g = self.grid
        for axis in range(self.d):
            g = np.moveaxis(g, axis, 0).copy()
            g[:WIDTH] += g[self.m :]
            g = np.moveaxis(g[: self.m], 0, axis)
        f = np.fft.ifftn(g) * float(self.m) ** self.d
        up = np.arange(self.k)
        if self.d == 1:
            return f[up] / _kernel_transform(self.m, up)
        both = np.arange(1 - self.k, self.k)
        return f[np.ix_(up, both)] / np.outer(_kernel_transform(self.m, up), _kernel_transform(self.m, both))


def _grid_check(k: int, d: int, method: str) -> bool:
    """Whether to go by the transform."""
    if not 1 <= d <= 2:
        raise ValueError("one or two columns")
    if method not in ("auto", "sums", "fft"):
        raise ValueError("method is auto, sums or fft")
    return method == "fft" or (method == "auto" and k >= FFT_FROM)


class _Direct:
    """The same sums as Spectrum by products of rows x k numbers."""

    def __init__(self, k: int, d: int):
        self.k, self.d, self.total = k, d, 0.0
        self.rows = max(1, CHUNK_CELLS // max(k, 1))

    def add(self, theta: np.ndarray) -> None:
        for lo in range(0, len(theta), self.rows):
            self.total = self.total + self._part(theta[lo : lo + self.rows])

    def _part(self, theta: np.ndarray) -> np.ndarray:
        e1 = np.exp(1j * np.outer(theta[:, 0], np.arange(self.k)))
        if self.d == 1:
            return e1.sum(axis=0)
        e2 = np.exp(1j * np.outer(theta[:, 1], np.arange(self.k)))
        plus, minus = e1.T @ e2, e1.T @ e2.conj()
        return np.concatenate([minus[:, :0:-1], plus], axis=1)

    def modes(self) -> np.ndarray:
        return self.total


def _partial_sums(df: DataFrame, cols: list[str], shift, span, k: int, fft: bool, finish, schema: str) -> DataFrame:
    """Each task reduces its rows to one row per frequency; only those rows are shuffled and
    added, in slabs. The transform is linear, so every task transforms its own grid."""
    clean = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).na.drop()

    def run(batches):
        sums, n = (Spectrum if fft else _Direct)(k, len(cols)), 0
        held = []
        # Arrow batches are gathered, so that a grid is not walked over for a few rows.
        for pdf in batches:
            held.append((pdf.to_numpy(dtype=float) - shift) * (math.pi / span))
            n += len(pdf)
            if sum(map(len, held)) >= SPREAD_ROWS:
                sums.add(np.concatenate(held))
                held = []
        if held:
            sums.add(np.concatenate(held))
        if n:
            found = finish(sums.modes())
            size = len(next(iter(found.values())))
            for lo in range(0, size, SLAB_ROWS):
                yield pd.DataFrame({c: v[lo : lo + SLAB_ROWS] for c, v in found.items()}).assign(n=float(n))

    return clean.mapInPandas(run, schema)


def _mean(c: str):
    """Sum over the rows. A part that is not a number leaves pandas as null, and must not drop out."""
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c) / F.sum("n")).otherwise(F.lit(float("nan")))


def cos_coefficients(
    df: DataFrame, cols: list[str], a: list[float], b: list[float], k: int, method: str = "auto"
) -> DataFrame:
    """A_k = 2^d / prod(b-a) * mean(prod cos(k pi (x-a)/(b-a))) for every k vector.

    method: "sums" (rows x frequencies), "fft" (a grid per task), or the cheaper one."""
    d = len(cols)
    fft = _grid_check(k, d, method)
    lo, span = np.array(a, float), np.array(b, float) - np.array(a, float)
    names = [f"k{i + 1}" for i in range(d)]

    def finish(z):
        # A product of two cosines is half the cosine of the sum and of the difference.
        s = z.real if d == 1 else (z[:, k - 1 :] + z[:, k - 1 :: -1]).real / 2
        idx = np.indices((k,) * d).reshape(d, -1)
        return {**{name: idx[i] for i, name in enumerate(names)}, "s": s.ravel()}

    schema = ", ".join(f"{n} int" for n in names) + ", s double, n double"
    parts = _partial_sums(df, cols, lo, span, k, fft, finish, schema)
    scale = 2.0**d / float(np.prod(span))
    return parts.groupBy(*names).agg((_mean("s") * scale).alias("coef"))


def ecf_grid(
    df: DataFrame, cols: list[str], a: list[float], b: list[float], k: int, method: str = "auto"
) -> DataFrame:
    """Mean of exp(i t'x) with t_j = s_j k_j pi / (b_j - a_j), for every k and each
    sign pattern of the second column (the first sign is +; the rest follow by
    conjugation). method: as in cos_coefficients."""
    d = len(cols)
    fft = _grid_check(k, d, method)
    span = np.array(b, float) - np.array(a, float)
    names = ["k1"] if d == 1 else ["sign2", "k1", "k2"]

    def finish(z):
        if d == 1:
            return {"k1": np.arange(k), "re": z.real, "im": z.imag}
        up, down = z[:, k - 1 :].ravel(), z[:, k - 1 :: -1].ravel()
        s, i, j = np.indices((2, k, k)).reshape(3, -1)
        both = np.concatenate([up, down])
        return {"sign2": 1 - 2 * s, "k1": i, "k2": j, "re": both.real, "im": both.imag}

    schema = ", ".join(f"{n} int" for n in names) + ", re double, im double, n double"
    parts = _partial_sums(df, cols, 0.0, span, k, fft, finish, schema)
    return parts.groupBy(*names).agg(_mean("re").alias("re"), _mean("im").alias("im"))


def density_from_coefficients(
    points: DataFrame, coefs: DataFrame, cols: list[str], a: list[float], b: list[float]
) -> DataFrame:
    """Series value at each point; the k=0 terms count half.

    The coefficients (one per frequency) become one array row that
    every point reads; no row is multiplied."""
    d = len(cols)
    names = [f"k{i + 1}" for i in range(d)]
    packed = coefs.agg(F.collect_list(F.struct(*names, "coef")).alias("_coefs"))
    at = points.withColumn("_coefs", packed.scalar())

    def term(e):
        t = e["coef"]
        for i, c in enumerate(cols):
            u = (F.col(c).cast("double") - a[i]) / (b[i] - a[i])
            t = t * F.cos(e[names[i]] * math.pi * u) * F.when(e[names[i]] == 0, 0.5).otherwise(1.0)
        return t

    value = F.aggregate("_coefs", F.lit(0.0), lambda acc, e: acc + term(e))
    return at.select(*points.columns, value.alias("density"))


def ecf_shrink_1d(grid: DataFrame, n: int) -> DataFrame:
    """Keeps a frequency while every smaller one exceeds the noise floor
    2 sqrt(n-1)/n, and shrinks what is kept. `grid` is one row per frequency."""
    floor = 2.0 * math.sqrt(n - 1) / n
    modulus = F.sqrt(F.col("re") ** 2 + F.col("im") ** 2)
    # The grid is at most MAX_GRID rows, so the one-partition window is bounded.
    w = W.orderBy("k1").rowsBetween(W.unboundedPreceding, W.currentRow)
    accepted = F.min((modulus >= floor).cast("int")).over(w) == 1
    inner = F.greatest(1.0 - 4.0 * (n - 1) / (float(n) ** 2 * modulus * modulus), F.lit(0.0))
    gain = F.when(F.col("_ok"), n / (2.0 * (n - 1)) * (1.0 + F.sqrt(inner))).otherwise(0.0)
    return (
        grid.withColumn("_ok", accepted)
        .withColumn("gain", gain)
        .select(
            "k1", F.col("_ok").alias("accepted"), "gain",
            (F.col("gain") * F.col("re")).alias("re"), (F.col("gain") * F.col("im")).alias("im"),
        )
    )
