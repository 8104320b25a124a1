import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ampertide.functions import numeric as N
from ampertide.models import gamlss as G
from ampertide.models import special


def test_normal_cdf_on_the_whole_line(spark):
    x = [-38.0, -8.0, -5.7, -3.0, -1.0, -0.3, 0.0, 0.2, 0.66, 1.0, 2.5, 5.0, 9.0]
    d = spark.createDataFrame([(v,) for v in x], "x double")
    got = [r[0] for r in d.select(N.normal_cdf(F.col("x"))).collect()]
    want = [0.5 * math.erfc(-v / math.sqrt(2)) for v in x]
    assert np.allclose(got, want, rtol=1e-12, atol=1e-300)


def test_johnson_su_round_trip_and_mean(spark):
    d = spark.createDataFrame([(1.0, 2.0, 0.7, 1.3)], "mu double, sd double, nu double, tau double")
    c = [F.col(n) for n in ("mu", "sd", "nu", "tau")]
    d = d.withColumns({k: v for k, v in N.jsu_native(*c).items()})
    y = np.linspace(-400, 400, 400001)
    r = d.select("loc", "scale", "skew", "tail").head()
    z = (y - r.loc) / r["scale"]
    pdf = r.tail / (r["scale"] * np.sqrt(z * z + 1) * math.sqrt(2 * math.pi)) * np.exp(
        -0.5 * (r.skew + r.tail * np.arcsinh(z)) ** 2
    )
    step = y[1] - y[0]
    mean = (y * pdf).sum() * step
    assert abs(pdf.sum() * step - 1) < 1e-6
    assert abs(mean - 1.0) < 1e-3
    assert abs(math.sqrt((pdf * (y - mean) ** 2).sum() * step) - 2.0) < 1e-2
    p = [F.col(n) for n in ("loc", "scale", "skew", "tail")]
    back = d.select(*[v.alias(k) for k, v in N.jsu_meansd(*p).items()]).head()
    assert np.allclose(list(back), [1.0, 2.0, 0.7, 1.3])
    at = d.select(N.jsu_pdf(F.lit(0.5), *p), N.jsu_cdf(F.lit(0.5), *p)).head()
    assert abs(at[0] - np.interp(0.5, y, pdf)) < 1e-6
    assert abs(at[1] - (pdf[y <= 0.5]).sum() * step) < 1e-3


@pytest.mark.parametrize("name", ["identity", "log", "logident", "softplus"])
def test_link_derivatives(spark, name):
    d = spark.createDataFrame([(v,) for v in (0.2, 0.8, 1.5, 3.0)], "x double")
    h = 1e-5
    x = F.col("x")
    cols = [
        (N.link(name, x + h) - N.link(name, x - h)) / (2 * h), N.link_derivative(name, x),
        (N.link_inverse(name, x + h) - N.link_inverse(name, x - h)) / (2 * h), N.inverse_derivative(name, x),
        (N.inverse_derivative(name, x + h) - N.inverse_derivative(name, x - h)) / (2 * h),
        N.inverse_second_derivative(name, x),
        (N.link_derivative(name, x + h) - N.link_derivative(name, x - h)) / (2 * h),
        N.link_second_derivative(name, x), N.link_inverse(name, N.link(name, x)), x,
    ]
    for r in d.select(*[c.cast("double").alias(f"c{i}") for i, c in enumerate(cols)]).collect():
        assert np.allclose(r[0::2], r[1::2], atol=1e-5)


def _quadrature(cdf, y, lo=-80.0, hi=80.0):
    x = np.linspace(lo, hi, 800001)
    return (((cdf(x) - (x >= y)) ** 2).sum()) * (x[1] - x[0])


def test_gaussian_and_student_crps(spark):
    d = spark.createDataFrame([(1.7, 0.3, 2.0)], "y double, m double, v double")
    got = d.select(N.gaussian_crps(F.col("y"), F.col("m"), F.col("v"))).head()[0]
    erf = np.vectorize(math.erf)
    want = _quadrature(lambda x: 0.5 * (1 + erf((x - 0.3) / 2.0)), 1.7, -20, 20)
    assert abs(got - want) < 1e-4
    for nu, z in ((3.0, -1.2), (12.0, 0.4), (40.0, 2.0)):
        want = _quadrature(lambda x: special.student_cdf(x, np.full_like(x, nu)), z)
        assert abs(special.student_crps(np.array([z]), np.array([nu]))[0] - want) < 2e-3


def test_ensemble_crps_is_the_pairwise_one(spark):
    rng = np.random.default_rng(3)
    s = rng.normal(size=50)
    got = spark.createDataFrame([(s.tolist(), 0.4)], "s array<double>, y double").select(
        N.ensemble_crps(F.col("s"), F.col("y"))
    ).head()[0]
    want = np.abs(s - 0.4).mean() - 0.5 * np.abs(s[:, None] - s[None]).mean()
    assert abs(got - want) < 1e-12


def test_zero_inflated_crps_near_simulation(spark):
    rng = np.random.default_rng(4)
    pi, loc, scale, skew, tail, y = 0.6, 0.2, 1.5, -0.3, 1.4, 0.9
    x = np.where(rng.random(20000) < pi, loc + scale * np.sinh((rng.normal(size=20000) - skew) / tail), 0.0)
    xs = np.sort(x)
    n = len(xs)
    want = np.abs(x - y).mean() - ((2 * np.arange(1, n + 1) - n - 1) * xs).sum() / n**2
    def node(u):
        return loc + scale * F.sinh((u - skew) / tail)

    got = spark.range(1).select(G.zero_inflated_crps(F.lit(y), F.lit(pi), node, 400)).head()[0]
    assert abs(got - want) < 0.02
    same = spark.range(1).select(G.zero_inflated_crps(F.lit(y), F.lit(0.0), node, 50)).head()[0]
    assert abs(same - y) < 1e-12


def test_bad_log1p_raises(spark):
    d = spark.createDataFrame([(-2.0,)], "x double")
    with pytest.raises(Exception, match="log1p"):
        d.select(N.log1p_checked(F.col("x"), "x")).collect()
