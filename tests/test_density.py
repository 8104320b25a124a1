import math

import numpy as np
import pytest

from ampertide.operators import density as D


def angles(n, d, seed=3):
    rng = np.random.default_rng(seed)
    return rng.normal(scale=4.0, size=(n, d))


@pytest.mark.parametrize("d, k", [(1, 1), (1, 3), (1, 64), (1, 500), (2, 1), (2, 8), (2, 64)])
def test_transform_equals_direct_sums(d, k):
    x = angles(3000, d)
    fast, slow = D.Spectrum(k, d), D._Direct(k, d)
    for part in np.array_split(x, 3):
        fast.add(part)
        slow.add(part)
    assert np.abs(fast.modes() - slow.modes()).max() <= 1e-10 * len(x)
    assert fast.modes().shape == ((k,) if d == 1 else (k, 2 * k - 1))


def test_angles_at_the_seam_and_far_away():
    x = np.array([[0.0], [2 * math.pi], [-1e-18], [math.pi], [-math.pi], [2e5], [np.nextafter(2 * math.pi, 0)]])
    fast, slow = D.Spectrum(40, 1), D._Direct(40, 1)
    fast.add(x)
    slow.add(x)
    assert np.abs(fast.modes() - slow.modes()).max() < 1e-8


def test_work_of_a_row_does_not_grow_with_frequencies(monkeypatch):
    cells = []
    count = np.bincount
    monkeypatch.setattr(D.np, "bincount", lambda at, w, size: cells.append(len(at)) or count(at, w, size))
    work = {}
    for k in (16, 128):
        cells.clear()
        D.Spectrum(k, 2).add(angles(1000, 2))
        work[k] = sum(cells)
    assert work[16] == work[128] == 1000 * D.WIDTH**2


@pytest.mark.parametrize("cols", [["x"], ["x", "y"]])
def test_methods_agree_on_frames(spark, cols):
    x = angles(2000, 2, 5)
    rows = [(float(a), float(b)) for a, b in x] + [(None, 1.0), (2.0, None), (float("nan"), 0.0)]
    df = spark.createDataFrame(rows, "x double, y double").repartition(3)
    a, b = [-9.0, -3.0][: len(cols)], [7.0, 12.0][: len(cols)]
    for f in (D.ecf_grid, D.cos_coefficients):
        got = {m: f(df, cols, a, b, 24, method=m).toPandas() for m in ("fft", "sums")}
        keys = [c for c in got["fft"].columns if c.startswith(("k", "sign"))]
        one, two = (g.sort_values(keys, ignore_index=True) for g in got.values())
        assert len(one) == 24 ** len(cols) * (2 if "sign2" in keys else 1)
        assert np.abs(one.to_numpy(float) - two.to_numpy(float)).max() < 1e-10


def test_infinite_value_and_empty_frame(spark):
    df = spark.createDataFrame([(1.0,), (float("inf"),)], "x double")
    for m in ("fft", "sums"):
        assert all(math.isnan(r.re) for r in D.ecf_grid(df, ["x"], [-1.0], [1.0], 20, method=m).collect())
    assert D.ecf_grid(df.limit(0), ["x"], [-1.0], [1.0], 20).count() == 0
    with pytest.raises(ValueError):
        D.ecf_grid(df, ["x"], [-1.0], [1.0], 20, method="other")
