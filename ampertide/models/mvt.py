"""Multivariate Student-t models on trailing windows: fit, predict, score, study."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numeric as N
from ..operators import panel as P
from ..operators.reports import summarize
from ..schema import PARAMS
from ..session import cut, spread
from . import special

NU_RANGE = (0.1, 100.0)


def _loglik(d2, m, nu, logdet, p):
    n = m.sum(1)
    const = special.lgamma((nu + p) / 2) - special.lgamma(nu / 2) - 0.5 * p * np.log(nu * np.pi)
    return n * (const - 0.5 * logdet) - 0.5 * (nu + p) * (m * np.log1p(d2 / nu[:, None])).sum(1)


def _best_nu(d2, m, nu, p, reach, rounds):
    """Golden section on log nu within a factor `reach` of the last value, all fits at
    once."""
    g = (np.sqrt(5.0) - 1.0) / 2.0
    lo = np.log(np.clip(nu / reach, *NU_RANGE))
    hi = np.log(np.clip(nu * reach, *NU_RANGE))
    zero = np.zeros(len(nu))

    def f(t):
        return _loglik(d2, m, np.exp(t), zero, p)

    a, b = hi - g * (hi - lo), lo + g * (hi - lo)
    fa, fb = f(a), f(b)
    for _ in range(rounds):
        left = fa > fb
        lo, hi = np.where(left, lo, a), np.where(left, b, hi)
        na, nb = hi - g * (hi - lo), lo + g * (hi - lo)
        fresh = f(np.where(left, na, nb))
        fa, fb = np.where(left, fresh, fb), np.where(left, fa, fresh)
        a, b = na, nb
    return np.exp((lo + hi) / 2.0)


def _distance(z, mu, sigma):
    dev = z - mu[:, None, :]
    return dev, ((dev @ np.linalg.inv(sigma)) * dev).sum(-1)


def fit_windows(x: np.ndarray, m: np.ndarray, method: str, tol=1e-6, max_iter=200) -> dict:
    """Fits one t distribution per row of the 0/1 window matrix m (fits x rows) to the
    rows of x, all fits at once; each on its own standardised scale. `rounds` and
    `converged` say how each one ended."""
    p = x.shape[1]
    n = m.sum(1)
    center = x.mean(0)
    x = x - center
    mean = (m @ x) / n[:, None]
    z = x[None] - mean[:, None, :]
    sd = np.sqrt(np.einsum("br,brp->bp", m, z * z) / n[:, None])
    sd = np.where(sd > 0, sd, 1.0)
    z = z / sd[:, None, :]
    zm = z * m[:, :, None]
    s = (zm.transpose(0, 2, 1) @ z) / (n - 1)[:, None, None]
    dist = ((z @ np.linalg.pinv(s, hermitian=True)) * z).sum(-1)
    k = (m * dist**2).sum(1) / n / (p * (p + 2))
    nu = np.where(k > 1 + 1e-9, (4 * k - 2) / np.where(k > 1 + 1e-9, k - 1, 1.0), np.inf)
    mu = np.zeros((len(m), p))
    rounds, converged = np.zeros(len(m), int), np.ones(len(m), bool)
    if method == "mardia":
        shrink = np.where(np.isfinite(nu) & (nu > 2), (nu - 2) / np.where(np.isfinite(nu), nu, 1.0), 1.0)
        sigma = s * shrink[:, None, None]
    elif method == "ecm":
        eye = np.eye(p)

        def ridge(c):
            tr = np.trace(c, axis1=1, axis2=2)
            c = 0.5 * (c + c.transpose(0, 2, 1))
            return c + 1e-8 * (np.where(tr > 0, tr, 1.0) / p)[:, None, None] * eye

        nu = np.clip(np.where(np.isfinite(nu), nu, 30.0), 0.6, NU_RANGE[1])
        sigma = ridge(s)
        _, d2 = _distance(z, mu, sigma)
        prev = _loglik(d2, m, nu, np.linalg.slogdet(sigma)[1], p)
        live = np.arange(len(m))
        for it in range(max_iter):
            zl, ml, nl = z[live], m[live], n[live]
            _, d2 = _distance(zl, mu[live], sigma[live])
            w = ml * (nu[live][:, None] + p) / (nu[live][:, None] + d2)
            mu_l = np.einsum("br,brp->bp", w, zl) / w.sum(1)[:, None]
            dev = zl - mu_l[:, None, :]
            sig_l = ridge((dev * w[:, :, None]).transpose(0, 2, 1) @ dev / nl[:, None, None])
            _, d2 = _distance(zl, mu_l, sig_l)
            nu_l = _best_nu(d2, ml, nu[live], p, *((3.0, 16) if it < 4 else (1.3, 8)))
            ll = _loglik(d2, ml, nu_l, np.linalg.slogdet(sig_l)[1], p)
            mu[live], sigma[live], nu[live] = mu_l, sig_l, nu_l
            going = np.abs(ll - prev[live]) / (1.0 + np.abs(prev[live])) >= tol
            prev[live] = ll
            rounds[live] = it + 1
            live = live[going]
            if not len(live):
                break
        converged[live] = False
        _, d2 = _distance(z, mu, sigma)
        nu = _best_nu(d2, m, nu, p, 1.5, 28)
    else:
        raise ValueError("method is 'ecm' or 'mardia'")
    return {"n": n, "mu": mu, "sigma": sigma, "s": s, "nu": nu, "mean": mean + center, "sd": sd, "converged": converged, "rounds": rounds}


def _group_fit(names, lookback, block_days, method, first_day, last_day, max_iter):
    p = len(names)
    epoch = dt.date(1970, 1, 1)

    def row(day, hour, wh, n, err, fit=None, b=0):
        if fit is not None and not fit["converged"][b]:
            err = f"no convergence in {max_iter} rounds"
        base = [epoch + dt.timedelta(int(day)), int(hour), int(wh), method, err is None, err]
        if fit is None:
            return base + [None, int(n), p, names, None, None, None, None, None, None, None]
        return base + [
            float(fit["nu"][b]), int(n), p, names, fit["mu"][b].tolist(), fit["sigma"][b].tolist(),
            fit["s"][b].tolist(), fit["mean"][b].tolist(), fit["sd"][b].tolist(),
            bool(fit["converged"][b]), int(fit["rounds"][b]),
        ]

    def run(key, pdf):
        hour, wh, block = key
        d = pdf["d"].to_numpy()
        own = np.arange(block * block_days, (block + 1) * block_days)
        own = own[np.isin(own, d) & (own >= first_day) & (own <= last_day)]
        x = pdf[names].to_numpy(float)
        m = ((d[None] < own[:, None]) & (d[None] >= own[:, None] - lookback)).astype(float)
        enough = m.sum(1) >= p + 2
        out = [row(t, hour, wh, c, "too few samples") for t, c in zip(own[~enough], m[~enough].sum(1))]
        own, m = own[enough], m[enough]
        if len(own):
            try:
                fit = fit_windows(x, m, method, max_iter=max_iter)
                out += [row(t, hour, wh, m[b].sum(), None, fit, b) for b, t in enumerate(own)]
            except np.linalg.LinAlgError:
                # One singular window must not fail its neighbours.
                for b, t in enumerate(own):
                    try:
                        fit = fit_windows(x, m[b : b + 1], method, max_iter=max_iter)
                        out.append(row(t, hour, wh, m[b].sum(), None, fit, 0))
                    except np.linalg.LinAlgError as e:
                        out.append(row(t, hour, wh, m[b].sum(), str(e)))
        return pd.DataFrame(out, columns=[f.split()[0] for f in PARAMS.split(", ")])

    return run


def fit_mvt(
    rows: DataFrame,
    names: list[str],
    lookback: int = 90,
    method: str = "ecm",
    block_days: int = 30,
    extra_day: bool = False,
    first_day: str | None = None,
    last_day: str | None = None,
    max_iter: int = 200,
) -> DataFrame:
    """One fit per (date, hour, horizon) on the rows of the `lookback` days before.

    A fit that has not converged after `max_iter` rounds keeps its parameters, but is not
    ok and says so: forecasts do not use it.

    `rows` is unique on (delivery_date, delivery_hour, wh, ts), as mvt_features makes
    it, so a group of (hour, horizon, day block) holds at most (lookback +
    block_days) days of bins whatever the data volume."""
    span = lookback + (1 if extra_day else 0)
    blocks = P.trailing_groups(rows, lookback, block_days, extra_day=extra_day)
    epoch = dt.date(1970, 1, 1)
    lo = (dt.date.fromisoformat(first_day) - epoch).days if first_day else -(10**9)
    hi = (dt.date.fromisoformat(last_day) - epoch).days if last_day else 10**9
    fn = _group_fit(list(names), span, block_days, method, lo, hi, max_iter)
    pruned = blocks.select(
        "delivery_hour", "wh", "block", F.unix_date("delivery_date").alias("d"), *names
    )
    keys = ("delivery_hour", "wh", "block")
    return spread(pruned, *keys).groupBy(*keys).applyInPandas(fn, PARAMS)


_CONDITIONAL = (
    "date date, hour int, which_hour_before int, method string, nu double, mean_y double, "
    "scale_y double, center array<double>, spread array<double>, coef array<double>, "
    "inverse array<double>, schur double, df_cond double, log_norm double"
)


def _conditional(batches):
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            sig = np.array([np.asarray(v, float) for v in r.Sigma_scaled])
            mu, m, s = (np.asarray(v, float) for v in (r.mu_scaled, r.scaler_mean, r.scaler_scale))
            inv = np.linalg.pinv(sig[1:, 1:], hermitian=True)
            a = sig[0, 1:] @ inv
            q = len(a)
            nu = float(r.df)
            df = nu + q if np.isfinite(nu) else np.inf
            out.append(
                (
                    r.date, r.hour, r.which_hour_before, r.method, nu, mu[0] * s[0] + m[0], s[0],
                    (m[1:] + s[1:] * mu[1:]).tolist(), s[1:].tolist(), a.tolist(),
                    inv.ravel().tolist(), float(sig[0, 0] - a @ sig[1:, 0]), df,
                    float(special.student_log_norm(np.array([df]))[0]) if np.isfinite(df) else None,
                )
            )
        yield pd.DataFrame(
            out, columns=[f.split()[0] for f in _CONDITIONAL.split(", ")]
        )


def score_join(rows: DataFrame, params: DataFrame) -> DataFrame:
    """Rows with the parameters of their (date, hour, horizon); rows without a
    successful calibration drop out."""
    ok = params.filter("calibration_ok") if "calibration_ok" in params.columns else params
    return rows.withColumnsRenamed(
        {"delivery_date": "date", "delivery_hour": "hour", "wh": "which_hour_before"}
    ).join(ok, ["date", "hour", "which_hour_before"])


def conditional_params(params: DataFrame) -> DataFrame:
    """What predictions need of each successful fit: one row per (date, hour, horizon). Stored in
    buckets beside the panel (sources/buckets.py), predictions look it up without an exchange."""
    return params.filter("calibration_ok").mapInPandas(_conditional, _CONDITIONAL)


def predict_mvt(rows: DataFrame, params: DataFrame, names: list[str], compat: bool = False) -> DataFrame:
    """Conditional mean, variance and degrees of freedom of names[0] given the rest.

    The matrix work happens once per fit; each row then needs only arithmetic. `params` are fits
    or their conditional_params. compat=True keeps the doubled degrees-of-freedom factor of
    older results."""
    q = len(names) - 1
    ready = params if "coef" in params.columns else conditional_params(params)
    d = score_join(rows, ready)
    u = [(F.col(n) - F.col("center")[i]) / F.col("spread")[i] for i, n in enumerate(names[1:])]
    d = d.withColumn("_u", F.array(*u))
    lin, quad = F.lit(0.0), F.lit(0.0)
    for i in range(q):
        lin = lin + F.col("coef")[i] * F.col("_u")[i]
        for j in range(i, q):
            c = F.col("inverse")[i * q + j] * (1.0 if i == j else 2.0)
            quad = quad + c * F.col("_u")[i] * F.col("_u")[j]
    nu = F.col("nu")
    # The variance exists for nu + q > 2 only; the squared scale always does.
    factor = F.when(nu + q > 2, (nu + F.col("_quad")) / (nu + q - 2.0))
    if compat:
        factor = factor * F.when(nu + q > 2, (nu + q) / (nu + q - 2.0))
    finite = nu < float("inf")
    var = F.when(finite, factor * F.col("schur")).otherwise(F.col("schur"))
    if compat:
        scale2 = F.when(finite, var * (F.col("df_cond") - 2.0) / F.col("df_cond")).otherwise(var)
    else:
        scale2 = F.when(finite, (nu + F.col("_quad")) / (nu + q) * F.col("schur")).otherwise(F.col("schur"))
    d = d.withColumn("_quad", quad).withColumn("_lin", lin)
    return d.select(
        F.col("ts").alias("timestamp"), "date", "hour", "which_hour_before", "method",
        F.col(names[0]).alias("y_true"),
        (F.col("mean_y") + F.col("scale_y") * F.col("_lin")).alias("mu_cond"),
        (var * F.col("scale_y") * F.col("scale_y")).alias("var_cond"),
        (scale2 * F.col("scale_y") * F.col("scale_y")).alias("scale2"), "df_cond", "log_norm",
        F.array(*[F.lit(n) for n in names[1:]]).alias("used_features"),
    )


@F.pandas_udf(T.DoubleType())
def _student_crps(z: pd.Series, nu: pd.Series) -> pd.Series:
    ok = z.notna() & np.isfinite(nu) & (nu > 1)
    out = np.full(len(z), np.nan)
    if ok.any():
        out[ok] = special.student_crps(z[ok].to_numpy(), nu[ok].to_numpy())
    return pd.Series(out)


def score_density(preds: DataFrame) -> DataFrame:
    """Errors, negative log density and CRPS of Gaussian or t forecasts.

    The t CRPS is the exact expectation; it does not depend on draws or row order."""
    y, mu, var, nu = (F.col(c) for c in ("y_true", "mu_cond", "var_cond", "df_cond"))
    is_t = nu < float("inf")
    scale2 = F.col("scale2") if "scale2" in preds.columns else F.when(is_t, F.when(nu > 2, var * (nu - 2.0) / nu)).otherwise(var)
    # Rounding may leave a tiny negative; null stays null.
    scale2 = F.when(scale2 < 0, F.lit(0.0)).otherwise(scale2)
    scale = F.sqrt(scale2)
    z = F.try_divide(y - mu, F.col("_scale"))
    t_log = -(F.col("log_norm") - F.log("_scale") - 0.5 * (nu + 1.0) * F.log1p(z * z / nu))
    errs = N.forecast_errors(y, mu)
    d = preds.withColumn("_scale", scale)
    return d.select(
        *[c for c in preds.columns if c not in ("log_norm", "scale2", "used_features")],
        *[c.alias(k) for k, c in errs.items()],
        F.abs(y - mu).alias("rmse_point"),
        F.when(is_t, t_log).otherwise(N.gaussian_log_score(y, mu, scale2)).alias("log_score"),
        F.when(is_t & (F.col("_scale") == 0), F.abs(y - mu))
        .when(is_t, F.col("_scale") * F.nanvl(_student_crps(z, nu), F.lit(None).cast("double")))
        .otherwise(N.gaussian_crps(y, mu, scale2)).alias("crps"),
        "used_features",
    )


def conditional_moments(
    df: DataFrame, mean: str = "mu_cond", scale2: str = "scale2", nu: str = "df_cond"
) -> DataFrame:
    """Raw moments 1-4 of a Gaussian (infinite nu) or t target with squared scale
    scale2; null where a moment does not exist."""
    m, s2, v = F.col(mean), F.col(scale2), F.col(nu)
    e2 = F.when(v == float("inf"), F.lit(1.0)).when(v > 2, v / (v - 2.0))
    e4 = F.when(v == float("inf"), F.lit(3.0)).when(
        v > 4, 3.0 * v * v / ((v - 2.0) * (v - 4.0))
    )
    return df.select(
        "*",
        F.when(v > 1, m).alias("m1"),
        F.when(v > 2, m * m + s2 * e2).alias("m2"),
        F.when(v > 3, m * m * m + 3.0 * m * s2 * e2).alias("m3"),
        F.when(v > 4, m * m * m * m + 6.0 * m * m * s2 * e2 + s2 * s2 * e4).alias("m4"),
    )


def model_covariance(params: DataFrame) -> DataFrame:
    """nu/(nu-2) * Sigma in original units; null where it does not exist."""
    nu = F.col("df")
    factor = F.when(nu == float("inf"), F.lit(1.0)).when(nu > 2, nu / (nu - 2.0))
    sd = F.col("scaler_scale")
    cov = F.transform(
        "Sigma_scaled",
        lambda r, i: F.transform(r, lambda v, j: v * F.get(sd, i) * F.get(sd, j) * factor),
    )
    return params.filter("calibration_ok").select(
        "date", "hour", "which_hour_before", "feature_names", F.when(factor.isNotNull(), cov).alias("covariance")
    )


@dataclass
class StudyConfig:
    value: str = "da-id"
    alias: str = "daid"
    lookback_days: int = 90
    window_minutes: int = 60
    horizons: tuple[int, ...] = (4, 3, 2, 1)
    lag_minutes: int = 15
    lags: P.LagDesign = P.LagDesign()
    method: str = "ecm"
    block_days: int = 30
    first_day: str | None = None
    last_day: str | None = None
    extra_day: bool = False
    designs: dict[int, dict[int, list[int]]] = field(default_factory=dict)

    def design(self, wh: int) -> dict[int, list[int]]:
        return self.designs.get(wh) or self.lags.columns(wh)


def study_rows(df: DataFrame, cfg: StudyConfig) -> dict[int, tuple[list[str], DataFrame]]:
    """Feature names and rows per horizon; the lags of all horizons are joined once
    and kept in the checkpoint folder."""
    union: dict[int, set[int]] = {}
    for wh in cfg.horizons:
        for o, ks in cfg.design(wh).items():
            union.setdefault(o, set()).update(ks)
    base = df.select("delivery_date", "delivery_hour", "ts", F.col(f"`{cfg.value}`").alias("_v"))
    wide = P.lag_panel(base, "_v", cfg.alias, {o: sorted(k) for o, k in union.items()}, lag_minutes=cfg.lag_minutes)
    wide = cut(P.horizon_window(wide, cfg.horizons, cfg.window_minutes))
    out = {}
    for wh in cfg.horizons:
        names = P.feature_names(cfg.alias, cfg.design(wh))
        rows = wide.filter(F.col("wh") == wh).withColumnRenamed("_v", names[0])
        out[wh] = (names, rows.select("delivery_date", "delivery_hour", "wh", "ts", *names).na.drop(subset=names))
    return out


def effective_start(df: DataFrame, cfg: StudyConfig) -> dt.date:
    """First target day: the asked one, but not before a whole lookback of data lies behind it.

    Too little data is an error, not an empty study."""
    lo, hi = df.agg(F.min("delivery_date"), F.max("delivery_date")).head()
    if lo is None:
        raise ValueError("the study has no rows")
    first = lo + dt.timedelta(cfg.lookback_days)
    if cfg.first_day:
        first = max(first, dt.date.fromisoformat(cfg.first_day))
    last = min(hi, dt.date.fromisoformat(cfg.last_day)) if cfg.last_day else hi
    if first > last:
        raise ValueError(f"no target day: data from {lo} to {hi}, {cfg.lookback_days} days of lookback")
    return first


def run_study(df: DataFrame, cfg: StudyConfig) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(parameters, scored predictions, summary) of a rolling study over the panel
    df(delivery_date, delivery_hour, ts, value)."""
    params, preds = None, None
    first = effective_start(df, cfg)
    for names, rows in study_rows(df, cfg).values():
        fit = fit_mvt(
            rows, names, cfg.lookback_days, cfg.method, cfg.block_days, cfg.extra_day,
            first.isoformat(), cfg.last_day,
        )
        # Fits feed the output and the forecasts: computed once.
        fit = cut(fit)
        scored = score_density(predict_mvt(rows, fit, names))
        params = fit if params is None else params.unionByName(fit)
        preds = scored if preds is None else preds.unionByName(scored)
    return params, preds, summarize(preds)
