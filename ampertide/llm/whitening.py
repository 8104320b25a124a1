"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Entries become integers (floor(64 c) + 1000000); the fit list holds each distinct vector once, as a
table of blocks of up to 4096 vectors in the narrowest integer type that holds them. Everything about
the covariance V comes from passes over these blocks: a task centres its vectors exactly (integers
less n-th parts of the integer sums), multiplies them by the current block of directions, and adds
up X'(XQ); the sums per dimension are an aggregate over tasks. V itself is never formed, and the
driver holds dimension x directions numbers.

A few Lanczos steps bound the spectrum from below. Each outer step then applies a Chebyshev
polynomial of V by its three-term recurrence, one pass per degree: small on the unwanted part of
the spectrum, steep above it. QR and Rayleigh-Ritz follow, with `GUARDS` directions beyond the wanted
ones. It ends when the residual |Vq - eq| of every wanted direction is at most `TOLERANCE` e1, or
has stopped falling at rounding level; an end above `CERTIFIED` e1 is an error.

Defined results: null vectors and such with null or non-finite entries take no part, nor do vectors of
another length than the commonest (the longest of several such; empty vectors never take part);
entries beyond the range of a long are held at +-2^62; repeated vectors and repeated rows are rows
of the result, but one vector of the fit list; directions without variance (under 1e-13 of the
largest) are left out, so one distinct vector, and an empty table, give no rows; a squared deviation
beyond a long is null; null identifiers stay; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampertide.session import cut

SCALE, SHIFT = 64, 1_000_000
EDGE = 1 << 62
COMPONENTS = 16
GUARDS = 16
BLOCK = 4096
LANCZOS = 12
DEGREE = 8
SPREAD = 1e6  # how far apart one filter may pull the directions of its block
TOLERANCE = 1e-14
CERTIFIED = 1e-10
OUTER = 60
FLAT = 1e-13
NARROW = "<i1", "<i2", "<i4", "<i8"


def pack_vector(x: np.ndarray) -> bytes:
    """One byte for the width, then the entries less SHIFT in the narrowest type: equal vectors have
    equal bytes."""
    for k, kind in enumerate(NARROW):
        if k == 3 or (x.min() >= np.iinfo(kind).min and x.max() <= np.iinfo(kind).max):
            return bytes([k]) + x.astype(kind).tobytes()
    raise AssertionError


def scaled(values: np.ndarray) -> np.ndarray:
    """floor(64 c), held within +-2^62."""
    return np.clip(np.floor(SCALE * values), -EDGE, EDGE).astype(np.int64)


def vectors_in(column, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of an Arrow list column take part, and their entries as a matrix of doubles."""
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    took = np.flatnonzero(lengths == dim)
    values = column.take(pa.array(took)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    fine = np.isfinite(values).all(1)
    return took[fine], values[fine]


def _listed(embeddings: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return embeddings.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))


def commonest_length(rows: DataFrame) -> int:
    """The length of most vectors that could take part; 0 where there is none."""
    sound = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < math.inf))
    sizes = rows.filter(F.col("v").isNotNull() & (F.size("v") > 0) & sound).groupBy(F.size("v").alias("d"))
    top = sizes.count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return top[0]["d"] if top else 0


def fit_blocks(rows: DataFrame, dim: int) -> DataFrame:
    """(width, m, data): the distinct vectors, less SHIFT, in blocks of one integer width."""

    def pack(batches):
        for batch in batches:
            _, values = vectors_in(batch.column(0), dim)
            yield pa.RecordBatch.from_arrays([pa.array([pack_vector(x) for x in scaled(values)], pa.binary())], names=["x"])

    def block(batches):
        held: list[list[bytes]] = [[] for _ in NARROW]

        def made(k):
            data, m = b"".join(held[k]), len(held[k])
            held[k] = []
            return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([m], pa.int32()), pa.array([data], pa.binary())], names=["width", "m", "data"])

        for batch in batches:
            for x in batch.column(0).to_pylist():
                held[x[0]].append(x[1:])
                if len(held[x[0]]) == BLOCK:
                    yield made(x[0])
        yield from (made(k) for k in range(len(NARROW)) if held[k])

    distinct = rows.select("v").mapInArrow(pack, "x binary").distinct()
    return cut(distinct.mapInArrow(block, "width int, m int, data binary"))


@dataclass(frozen=True)
class Fit:
    """The fit list and what is known of it. `sums` are exact; `centre` is their rounded n-th part."""

    blocks: DataFrame
    dim: int
    n: int
    sums: tuple[int, ...]

    @property
    def centre(self) -> np.ndarray:
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], dtype=np.int64)

    @property
    def rest(self) -> np.ndarray:
        """sums / n less centre: at most a half, right to the last digit."""
        return np.array([(s - self.n * int(c)) / self.n for s, c in zip(self.sums, self.centre)])


def add_up(blocks: DataFrame, dim: int, fn: Callable[[np.ndarray], np.ndarray], rows: int, width: int) -> np.ndarray:
    """The sum of fn(vectors) over all blocks, a matrix of rows x width. Vectors come as integers."""

    def run(batches):
        total = None
        for batch in batches:
            for k, m, data in zip(*(c.to_pylist() for c in batch.columns)):
                part = fn(np.frombuffer(data, NARROW[k]).reshape(m, dim).astype(np.int64))
                total = part if total is None else total + part
        if total is not None:
            cols = [pa.array(np.ascontiguousarray(total[:, j])) for j in range(width)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows, dtype=np.int32)), *cols], names=["i", *names])

    names = [f"c{j}" for j in range(width)]
    kind = "long" if fn(np.zeros((1, dim), np.int64)).dtype == np.int64 else "double"
    made = blocks.mapInArrow(run, "i int, " + ", ".join(f"{c} {kind}" for c in names))
    got = made.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).toArrow()  # rows x width numbers
    out = np.zeros((rows, width), np.int64 if kind == "long" else np.float64)
    for j, c in enumerate(names):
        out[got["i"].to_numpy(), j] = got[c].to_numpy()
    return out


def fit_list(rows: DataFrame, dim: int) -> Fit:
    blocks = fit_blocks(rows, dim)

    def halves(x):  # the two halves of a sum stay far from the range of a long
        return np.stack([(x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0), np.full(dim, len(x))], 1)

    high, low, n = add_up(blocks, dim, halves, dim, 3).T
    return Fit(blocks, dim, int(n[0]), tuple((int(h) << 32) + int(v) for h, v in zip(high, low)))


def centred_sums(fit: Fit, fn: Callable[[np.ndarray], np.ndarray], rows: int, width: int) -> np.ndarray:
    """The sum of fn(centred vectors) over the fit list."""
    centre, rest = fit.centre, fit.rest
    return add_up(fit.blocks, fit.dim, lambda x: fn((x - centre).astype(np.float64) - rest), rows, width)


def product(fit: Fit, q: np.ndarray) -> np.ndarray:
    """V q, by one pass."""
    return centred_sums(fit, lambda y: y.T @ (y @ q), fit.dim, q.shape[1]) / fit.n


def lowest_part(fit: Fit, apply: Callable[[np.ndarray], np.ndarray], rng) -> float:
    """An estimate of the lower end of the spectrum by Lanczos steps from one direction; less its
    residual, not below zero."""
    q = rng.standard_normal(fit.dim)
    basis = [q / np.linalg.norm(q)]
    alpha, beta = [], []
    for _ in range(min(LANCZOS, fit.dim)):
        w = apply(basis[-1][:, None])[:, 0]
        alpha.append(float(w @ basis[-1]))
        for _ in range(2):  # the whole basis is short, so it is kept orthogonal throughout
            for b in basis:
                w = w - (w @ b) * b
        beta.append(float(np.linalg.norm(w)))
        if beta[-1] <= FLAT * max(alpha):
            break
        basis.append(w / beta[-1])
    k = len(alpha)
    values, vectors = np.linalg.eigh(np.diag(alpha) + np.diag(beta[: k - 1], 1) + np.diag(beta[: k - 1], -1))
    return max(0.0, float(values[0] - abs(beta[-1] * vectors[-1, 0])))


def chebyshev(apply: Callable[[np.ndarray], np.ndarray], q: np.ndarray, vq: np.ndarray, low: float, high: float, top: float, degree: int) -> np.ndarray:
    """T_degree of V, mapped so that [low, high] becomes [-1, 1], applied to q and divided by its
    value at `top`, by the scaled three-term recurrence. vq is V q, known from Rayleigh-Ritz."""
    mid, half = (high + low) / 2, (high - low) / 2
    sigma = first = half / (top - mid)
    before, now = q, (vq - mid * q) * (sigma / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - sigma)
        before, now = now, (apply(now) - mid * now) * (2 * following / half) - before * (sigma * following)
        sigma = following
    return now


@dataclass(frozen=True)
class Spectrum:
    values: np.ndarray
    vectors: np.ndarray
    residual: float
    passes: int


def _log_gain(x: float, degree: int) -> float:
    """log of T_degree at x >= 1."""
    return degree * math.acosh(max(1.0, x))


def leading_components(fit: Fit, k: int, guards: int = GUARDS, seed: int = 7) -> Spectrum:
    """The k largest eigenvalues and eigenvectors of V. `residual` is the largest |Vq - eq| / e1."""
    dim, passes = fit.dim, 0

    def apply(q):
        nonlocal passes
        passes += 1
        return product(fit, q)

    rng = np.random.default_rng(seed)
    k, size = min(k, dim), min(dim, k + guards)
    q = np.linalg.qr(rng.standard_normal((dim, size)))[0]
    low = lowest_part(fit, apply, rng) if size < dim else 0.0
    best, stalled = math.inf, 0
    for _ in range(OUTER):
        vq = apply(q)
        values, turn = np.linalg.eigh((q.T @ vq + vq.T @ q) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        top = float(values[0])
        if top <= 0:
            return Spectrum(values[:k], q[:, :k], 0.0, passes)
        residual = float(np.linalg.norm(vq[:, :k] - q[:, :k] * values[:k], axis=0).max()) / top
        stalled = 0 if residual < best / 2 else stalled + 1
        if residual <= TOLERANCE or (residual <= CERTIFIED and stalled >= 2) or size == dim:
            return Spectrum(values[:k], q[:, :k], residual, passes)
        best = min(best, residual)
        # The filter damps what lies below the last guard.
        high = float(values[-1])
        low = min(low, high / 2 if high > 0 else 0.0) if low >= high else low
        mid, half = (high + low) / 2, max((high - low) / 2, FLAT * top)
        degree = DEGREE
        while degree > 2 and _log_gain((top - mid) / half, degree) - _log_gain((values[k - 1] - mid) / half, degree) > math.log(SPREAD):
            degree -= 1
        made = chebyshev(apply, q, vq, mid - half, mid + half, top, degree)
        q = np.linalg.qr(made / np.maximum(np.linalg.norm(made, axis=0), 1e-300))[0]
    raise ArithmeticError(f"subspace iteration ended with a residual of {best:.1e} of the largest eigenvalue")


def exact_deviation(d: np.ndarray, fit: Fit) -> list[int | None]:
    """sum of (n x - S)^2 per row, from x - centre."""
    left = [s - fit.n * int(c) for s, c in zip(fit.sums, fit.centre)]  # at most n / 2
    wide = np.ones(len(d), bool)
    out: list[int | None] = [None] * len(d)
    if int(np.abs(d).max(initial=0)) * fit.n + fit.n < EDGE:
        y = fit.n * d - np.array(left, dtype=np.int64)
        wide = (y.astype(np.float64) ** 2).sum(1) > 2.0**62
        out = (y * y).sum(1).tolist()
    for i in np.flatnonzero(wide).tolist():
        exact = sum((fit.n * int(x) - t) ** 2 for x, t in zip(d[i], left))
        out[i] = exact if exact < 1 << 63 else None
    return out


def whiten(embeddings: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per vector and component: identifier, component, n, deviation, whitened, explained,
    identity_error; then eigenvalue and the residual that certifies the components."""
    rows = _listed(embeddings, id_col, vec_col)
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double, eigenvalue double, residual double"
    dim = commonest_length(rows)
    nothing = rows.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    if dim == 0:
        return nothing
    fit = fit_list(rows, dim)
    found = leading_components(fit, components)
    kept = int((found.values > FLAT * max(found.values[0], 0)).sum())
    if kept == 0 or found.values[0] <= 0:
        return nothing
    values = found.values[:kept]
    turn = found.vectors[:, :kept] / np.sqrt(values)
    trace = float(centred_sums(fit, lambda y: (y * y).sum(0, keepdims=True), 1, dim).sum()) / fit.n

    def second(y):
        w = y @ turn
        return np.vstack([w.T @ w, w.sum(0)])

    sums = centred_sums(fit, second, kept + 1, kept) / fit.n
    error = float(np.abs(sums[:kept] - np.outer(sums[kept], sums[kept]) - np.eye(kept)).max())
    centre, rest = fit.centre, fit.rest
    # Plain values for the tasks: the fit holds a frame, which must not travel.
    known = Fit(None, dim, fit.n, fit.sums)

    def run(batches):
        for batch in batches:
            at, v = vectors_in(batch.column(1), dim)
            d = scaled(v) - centre
            m = len(at) * kept
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(at, kept))), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(m, known.n, np.int64)),
                    pa.array([x for x in exact_deviation(d, known) for _ in range(kept)], pa.int64()),
                    pa.array(((d.astype(np.float64) - rest) @ turn).reshape(-1)), pa.array(np.tile(values / trace, len(at))),
                    pa.array(np.full(m, error)), pa.array(np.tile(values, len(at))), pa.array(np.full(m, found.residual)),
                ],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error", "eigenvalue", "residual"],
            )

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
