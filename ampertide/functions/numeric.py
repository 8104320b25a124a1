"""Column expressions: guards, scaling, links, scores."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


# Quotients over less than TINY are not formed; LIMIT stands for them.
TINY, LIMIT = 1e-12, 1e12


def _guarded_quotient(num: Column, den: Column, instead: Column) -> Column:
    return F.coalesce(num / F.when(F.abs(den) >= TINY, den), instead)


def guarded_ratio(num: Column, den: Column) -> Column:
    """num / den; over a vanishing or missing den, LIMIT with the sign of num."""
    return _guarded_quotient(num, den, F.signum(num) * LIMIT)


def guarded_reciprocal(x: Column) -> Column:
    """1 / x; of a vanishing or missing x, LIMIT with its sign (zero and null count as positive)."""
    return _guarded_quotient(F.lit(1.0), x, F.when(x < 0, -LIMIT).otherwise(LIMIT))


def clean_number(c: Column) -> Column:
    """Null, NaN and infinities become 0."""
    c = c.cast("double")
    plain = F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))
    return F.when(F.abs(plain) == float("inf"), F.lit(0.0)).otherwise(plain)


def standardise(x: Column, mean: Column, var: Column) -> Column:
    return (x - mean) / F.sqrt(var)


def unstandardise(z: Column, mean: Column, var: Column) -> Column:
    return z * F.sqrt(var) + mean


def log1p_checked(x: Column, name: str) -> Column:
    """log(1+x); a value at or below -1 is an error, not a null."""
    return F.when(x > -1, F.log1p(x)).when(
        x.isNotNull(), F.raise_error(F.lit(f"log1p of {name}: value <= -1")).cast("double")
    )


def vwap(price: Column, qty: Column) -> Column:
    """Volume-weighted price; null unless the total volume is positive."""
    total = F.sum(qty)
    return F.when(total > 0, F.sum(price * qty) / total)


def row_sum(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


# --- link functions -----------------------------------------------------------


# least and greatest skip nulls; a bound must not turn a null into itself.
def _cap(x: Column, hi: float) -> Column:
    return F.when(x.isNotNull(), F.least(x, F.lit(hi)))


def _floor(x: Column, lo: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(x, F.lit(lo)))


def link(name: str, mu: Column) -> Column:
    # The bounds of the links, here and below.
    if name == "identity":
        return mu
    if name == "log":
        return F.log(_floor(mu, 1e-20))
    if name == "logident":
        return F.when(mu <= 1, F.log(_floor(mu, 1e-20))).otherwise(mu - 1)
    if name == "softplus":
        return F.log(F.expm1(_floor(mu, 1e-20)))
    raise ValueError(f"unknown link {name}")


def link_inverse(name: str, eta: Column) -> Column:
    if name == "identity":
        return eta
    if name == "log":
        return F.exp(_cap(eta, 100.0))
    if name == "logident":
        return F.when(eta <= 0, F.exp(_cap(eta, 80.0))).otherwise(eta + 1)
    if name == "softplus":
        return F.log1p(F.exp(_cap(eta, 40.0)))
    raise ValueError(f"unknown link {name}")


def link_derivative(name: str, mu: Column) -> Column:
    """d eta / d mu."""
    if name == "identity":
        return F.lit(1.0)
    if name == "log":
        return 1.0 / mu
    if name == "logident":
        return F.when(mu <= 1, 1.0 / _floor(mu, 1e-20)).otherwise(F.lit(1.0))
    if name == "softplus":
        return 1.0 / (1.0 - F.exp(-_floor(mu, 1e-12)))
    raise ValueError(f"unknown link {name}")


def inverse_derivative(name: str, eta: Column) -> Column:
    """d mu / d eta."""
    if name == "identity":
        return F.lit(1.0)
    if name == "log":
        return F.exp(_cap(eta, 100.0))
    if name == "logident":
        return F.when(eta <= 0, F.exp(_cap(eta, 80.0))).otherwise(F.lit(1.0))
    if name == "softplus":
        return 1.0 / (1.0 + F.exp(-_cap(eta, 40.0)))
    raise ValueError(f"unknown link {name}")


def inverse_second_derivative(name: str, eta: Column) -> Column:
    """d2 mu / d eta2."""
    if name == "identity":
        return F.lit(0.0)
    if name == "log":
        return F.exp(_cap(eta, 100.0))
    if name == "logident":
        return F.when(eta <= 0, F.exp(_cap(eta, 80.0))).otherwise(F.lit(0.0))
    if name == "softplus":
        s = inverse_derivative("softplus", eta)
        return s * (1.0 - s)
    raise ValueError(f"unknown link {name}")


def link_second_derivative(name: str, mu: Column) -> Column:
    """d2 eta / d mu2."""
    if name == "identity":
        return F.lit(0.0)
    if name == "log":
        return -1.0 / _floor(mu * mu, 1e-300)
    if name == "logident":
        return F.when(mu <= 1, -1.0 / F.pow(_floor(mu, 1e-20), F.lit(2.0))).otherwise(F.lit(0.0))
    if name == "softplus":
        e = F.exp(-_floor(mu, 1e-12))
        return -e / F.pow(1.0 - e, F.lit(2.0))
    raise ValueError(f"unknown link {name}")


# --- normal and Johnson-SU ------------------------------------------------------

# Cody's (1969) rational Chebyshev coefficients for erf and erfc,
# relative error below 1e-15 on the whole line.
_ERF_P = (3.20937758913846947e03, 3.77485237685302021e02, 1.13864154151050156e02,
          3.16112374387056560e00, 1.85777706184603153e-1)
_ERF_Q = (2.84423683343917062e03, 1.28261652607737228e03, 2.44024637934444173e02,
          2.36012909523441209e01, 1.0)
_ERFC_P = (1.23033935479799725e03, 2.05107837782607147e03, 1.71204761263407058e03,
           8.81952221241769090e02, 2.98635138197400131e02, 6.61191906371416295e01,
           8.88314979438837594e00, 5.64188496988670089e-1, 2.15311535474403846e-8)
_ERFC_Q = (1.23033935480374942e03, 3.43936767414372164e03, 4.36261909014324716e03,
           3.29079923573345963e03, 1.62138957456669019e03, 5.37181101862009858e02,
           1.17693950891312499e02, 1.57449261107098347e01, 1.0)
_TAIL_P = (-6.58749161529837803e-4, -1.60837851487422766e-2, -1.25781726111229246e-1,
           -3.60344899949804439e-1, -3.05326634961232344e-1, -1.63153871373020978e-2)
_TAIL_Q = (2.33520497626869185e-3, 6.05183413124413191e-2, 5.27905102951428412e-1,
           1.87295284992346725e00, 2.56852019228982242e00, 1.0)


def _poly(coefs, x):
    out = F.lit(coefs[-1])
    for c in reversed(coefs[:-1]):
        out = out * x + F.lit(c)
    return out


def erfc(x: Column) -> Column:
    a = F.abs(x)
    sq = x * x
    small = 1.0 - x * _poly(_ERF_P, sq) / _poly(_ERF_Q, sq)
    mid = F.exp(-sq) * _poly(_ERFC_P, a) / _poly(_ERFC_Q, a)
    inv = 1.0 / F.when(a > 4, sq).otherwise(F.lit(16.0))
    far = (
        F.exp(-sq)
        / F.when(a > 4, a).otherwise(F.lit(4.0))
        * (1.0 / math.sqrt(math.pi) + inv * _poly(_TAIL_P, inv) / _poly(_TAIL_Q, inv))
    )
    upper = F.when(a <= 4, mid).otherwise(far)
    return F.when(a <= 0.46875, small).otherwise(F.when(x < 0, 2.0 - upper).otherwise(upper))


def normal_pdf(x: Column, mean: Column | float = 0.0, sd: Column | float = 1.0) -> Column:
    z = (x - mean) / sd
    return F.exp(-0.5 * z * z) / (sd * math.sqrt(2 * math.pi))


def normal_cdf(x: Column, mean: Column | float = 0.0, sd: Column | float = 1.0) -> Column:
    return 0.5 * erfc(-((x - mean) / sd) / math.sqrt(2.0))


def normal_quantile(u: Column) -> Column:
    """Standard normal quantile: Newton steps on log cdf(z) = log u in the lower half, mirrored above.

    The start -sqrt(-2 log u) lies left of the root and log cdf is concave, so the steps approach
    from one side; eight reach rounding. Null outside (0, 1)."""
    low = F.least(u, 1.0 - u)

    def step(z, _):
        # A one-element array binds the cdf, which is a long expression, once.
        return F.transform(F.array(normal_cdf(z)), lambda c: z - (F.log(c) - F.log(low)) * c / normal_pdf(z))[0]

    z = F.aggregate(F.sequence(F.lit(1), F.lit(8)), -F.sqrt(-2.0 * F.log(low)), step)
    return F.when((u > 0) & (u < 1), F.when(u < 0.5, z).otherwise(-z))


_MIN_TAU = 0.07


def _jsu_constants(nu: Column, tau: Column):
    # Bounds far outside any useful shape keep the exponentials finite.
    tau = _floor(tau, _MIN_TAU)
    w = _floor(F.exp(_cap(1.0 / (tau * tau), 200.0)), 1.0 + 1e-7)
    shape = _cap(_floor(nu / tau, -100.0), 100.0)
    c = 1.0 / F.sqrt(0.5 * (w - 1.0) * (w * F.cosh(2.0 * shape) + 1.0))
    return c, w, shape


def jsu_native(mu: Column, sigma: Column, nu: Column, tau: Column) -> dict[str, Column]:
    """Mean/sd form -> location, scale, skew and tail of z = nu + tau*asinh((y-loc)/scale).

    The location is the one that gives the density the mean mu."""
    c, w, shape = _jsu_constants(nu, tau)
    return {
        "loc": mu - c * sigma * F.sqrt(w) * F.sinh(shape),
        "scale": c * sigma,
        "skew": -nu,
        "tail": _floor(tau, _MIN_TAU),
    }


def jsu_meansd(loc: Column, scale: Column, skew: Column, tail: Column) -> dict[str, Column]:
    """Inverse of jsu_native."""
    c, w, shape = _jsu_constants(-skew, tail)
    return {
        "mu": loc + scale * F.sqrt(w) * F.sinh(shape),
        "sigma": scale / c,
        "nu": -skew,
        "tau": tail,
    }


def jsu_pdf(y: Column, loc: Column, scale: Column, skew: Column, tail: Column) -> Column:
    z = F.try_divide(y - loc, scale)
    r = skew + tail * F.asinh(z)
    norm = scale * F.sqrt(z * z + 1.0) * math.sqrt(2 * math.pi)
    return F.try_divide(tail * F.exp(-0.5 * r * r), norm)


def jsu_cdf(y: Column, loc: Column, scale: Column, skew: Column, tail: Column) -> Column:
    return normal_cdf(skew + tail * F.asinh(F.try_divide(y - loc, scale)))


def jsu_moments(mu: Column, sigma: Column, nu: Column, tau: Column) -> dict[str, Column]:
    """Mean, sd, skewness and excess kurtosis of the mean/sd form."""
    c, w, s = _jsu_constants(nu, tau)
    skew = (
        0.25 * c**3 * F.sqrt(w) * (w - 1.0) ** 2
        * (w * (w + 2.0) * F.sinh(3.0 * s) + 3.0 * F.sinh(s))
    )
    fourth = 0.125 * c**4 * (w - 1.0) ** 2 * (
        w**2 * (w**4 + 2.0 * w**3 + 3.0 * w**2 - 3.0) * F.cosh(4.0 * s)
        + 4.0 * w**2 * (w + 2.0) * F.cosh(2.0 * s)
        + 3.0 * (2.0 * w + 1.0)
    )
    return {"mean": mu, "sd": sigma, "skewness": skew, "excess_kurtosis": fourth - 3.0}


# --- scores ---------------------------------------------------------------------


def gaussian_crps(y: Column, mean: Column, var: Column) -> Column:
    sd = F.sqrt(var)
    z = F.try_divide(y - mean, sd)
    score = sd * (z * (2.0 * normal_cdf(z) - 1.0) + 2.0 * normal_pdf(z) - 1.0 / math.sqrt(math.pi))
    # Without variance the score is the distance.
    return F.when(var > 0, score).otherwise(F.abs(y - mean))


def gaussian_log_score(y: Column, mean: Column, var: Column) -> Column:
    """Negative log density; null without variance."""
    return 0.5 * (
        math.log(2 * math.pi) + F.log(var) + F.try_divide((y - mean) * (y - mean), var)
    )


def mixture_moments(pi: Column, mu: Column, sd: Column) -> tuple[Column, Column]:
    """Mean and variance of alpha*Y with P(alpha=1)=pi."""
    return pi * mu, pi * sd * sd + pi * (1.0 - pi) * mu * mu


def zero_inflated_log_score(y: Column, pi: Column, density: Column) -> Column:
    """Log probability: point mass at zero, density elsewhere."""
    return F.when(F.abs(y) <= 1e-8, F.log(_floor(1.0 - pi, 1e-300))).when(
        y.isNotNull(), F.log(_floor(pi * density, 1e-300))
    )


def ensemble_crps(sample: Column, y: Column) -> Column:
    """CRPS of an array of draws against one observation, by sorting."""
    m = F.size(sample).cast("double")
    ordered = F.array_sort(F.transform(sample, lambda v: v.cast("double")))
    spread = F.aggregate(
        F.transform(ordered, lambda v, i: (2.0 * (i + 1) - m - 1.0) * v),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )
    distance = F.aggregate(sample, F.lit(0.0), lambda acc, v: acc + F.abs(v.cast("double") - y))
    return distance / m - spread / (m * m)


def forecast_errors(y: Column, forecast: Column) -> dict[str, Column]:
    err = y - forecast
    return {"error": err, "abs_error": F.abs(err), "sq_error": err * err}
