import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ampertide.llm import whitening as W


def table_of(spark, rows):
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return d.withColumns({c: F.lit("x") for c in ["id", "v", "x", "n", "component", "width", "m", "data", "i", "c0"]})


def sound(v, dim):
    return v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)


def brute(rows, dim, k=16):
    """Integers, sums and distances in Python's whole numbers, eigenvectors by numpy."""
    taken = [(i, tuple(math.floor(64 * float(np.float32(x))) + 1_000_000 for x in v)) for i, v in rows if sound(v, dim)]
    fit = sorted({x for _, x in taken})
    n = len(fit)
    s = [sum(c) for c in zip(*fit)]
    y = np.array([[float(n * a - b) / n for a, b in zip(x, s)] for x in fit])
    e, q = np.linalg.eigh(y.T @ y / n)
    e, q = e[::-1], q[:, ::-1]
    out = {}
    for i, x in taken:
        dev = sum((n * a - b) ** 2 for a, b in zip(x, s))
        w = np.array([(n * a - b) / n for a, b in zip(x, s)]) @ q[:, :k] / np.sqrt(np.maximum(e[:k], 1e-300))
        out.setdefault(i, []).append((n, dev, w))
    return out, e, np.sum(e)


def check(spark, rows, dim, k=16, digits=1e-8):
    got = W.whiten(table_of(spark, rows).repartition(3)).collect()
    want, e, trace = brute(rows, dim, k)
    per = {}
    for r in got:
        per.setdefault(r.vec_id, []).append(r)
    k = min(k, dim)
    assert {i: len(x) for i, x in per.items()} == {i: k * len(x) for i, x in want.items()}
    signs = {}
    for r in got:
        devs = [d for _, d, _ in want[r.vec_id]]
        assert r.n == want[r.vec_id][0][0] and r.deviation in [d if d < 2**63 else None for d in devs]
        near = min((w[r.component - 1] for _, d, w in want[r.vec_id] if d == r.deviation or d >= 2**63), key=lambda x: abs(abs(x) - abs(r.whitened)))
        assert abs(abs(near) - abs(r.whitened)) < digits * max(1, abs(near))
        if abs(near) > 1e-3:
            signs.setdefault(r.component, set()).add(math.copysign(1, near * r.whitened))
        assert abs(r.explained - e[r.component - 1] / trace) < 1e-10
        assert r.identity_error < 1e-9 and r.residual < 1e-12
    assert all(len(x) == 1 for x in signs.values())
    return got


def test_whitening_equals_eigenvectors(spark):
    rng = np.random.default_rng(0)
    turn = np.linalg.qr(rng.standard_normal((64, 64)))[0] * np.linspace(3, 0.2, 64)
    data = (rng.standard_normal((700, 64)) @ turn).astype(np.float32).tolist()
    rows = list(enumerate(data)) + [(9000 + i, data[i % 3]) for i in range(400)]
    bad = list(data[0])
    rows += [(None, data[5]), (5, data[6]), (5, data[6]), (801, None), (802, []), (803, [1.0]), (804, bad[:-1] + [None]), (805, bad[:-1] + [math.nan]), (806, bad[:-1] + [math.inf])]
    check(spark, rows, 64)


def test_flat_spectrum_and_wide_integers(spark):
    rng = np.random.default_rng(1)
    rows = list(enumerate((rng.standard_normal((900, 48)) * 1000 + 5e5).astype(np.float32).tolist()))
    check(spark, rows, 48, digits=1e-7)


def test_few_dimensions_and_clusters(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((5, 3)) * 20
    rows = [(i, (centres[i % 5] + rng.standard_normal(3)).astype(np.float32).tolist()) for i in range(200)]
    check(spark, rows, 3)


def test_driver_embeddings(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    check(spark, rows, 64)


def test_fewer_vectors_than_directions(spark):
    rng = np.random.default_rng(3)
    rows = list(enumerate(rng.standard_normal((7, 40)).astype(np.float32).tolist()))
    got = W.whiten(table_of(spark, rows)).collect()
    assert {r.component for r in got} == set(range(1, 7)) and len(got) == 42
    assert max(r.identity_error for r in got) < 1e-9 and abs(sum(r.explained for r in got if r.vec_id == 0) - 1) < 1e-9


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [0.5, 1.0])], [(1, [2.0]), (2, [2.0])]])
def test_no_variance_gives_no_rows(spark, rows):
    assert W.whiten(table_of(spark, rows)).count() == 0


def test_entries_beyond_a_long(spark):
    rows = [(i, [float(i % 7), 3e38 if i == 0 else float(i)]) for i in range(30)]
    got = W.whiten(table_of(spark, rows)).collect()
    assert {r.component for r in got} == {1} and len(got) == 30 and all(r.deviation is None for r in got)
    assert all(math.isfinite(r.whitened) for r in got)


def test_passes_follow_the_polynomial(spark):
    rng = np.random.default_rng(4)
    rows = W._listed(table_of(spark, list(enumerate(rng.standard_normal((1500, 96)).astype(np.float32).tolist()))), "vec_id", "embedding")
    found = W.leading_components(W.fit_list(rows, 96), 16)
    assert found.residual < 1e-12 and found.passes < 120


def test_filter_damps_the_unwanted_part():
    values = np.linspace(0.1, 4, 40)
    q = np.eye(40)
    made = W.chebyshev(lambda x: values[:, None] * x, q, values[:, None] * q, 0.1, 2.0, 4.0, 8)
    gain = np.abs(np.diag(made))
    assert gain[values <= 2].max() < 1e-4 and abs(gain[-1] - 1) < 1e-12 and (np.diff(gain[values > 2]) > 0).all()
