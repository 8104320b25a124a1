"""Scalar-function queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import numeric as N
from . import views as V
from .registry import query

_LINKS = {
    "identity": ("mu", "eta", "1", "1", "0", "0"),
    "log": ("ln(mu)", "exp(eta)", "1 / mu", "exp(eta)", "exp(eta)", "-1 / (mu * mu)"),
    "logident": (
        "CASE WHEN mu <= 1 THEN ln(mu) ELSE mu - 1 END",
        "CASE WHEN eta <= 0 THEN exp(eta) ELSE eta + 1 END",
        "CASE WHEN mu <= 1 THEN 1 / mu ELSE 1 END",
        "CASE WHEN eta <= 0 THEN exp(eta) ELSE 1 END",
        "CASE WHEN eta <= 0 THEN exp(eta) ELSE 0 END",
        "CASE WHEN mu <= 1 THEN -1 / (mu * mu) ELSE 0 END",
    ),
    "softplus": (
        "ln(exp(mu) - 1)",
        "ln(1 + exp(eta))",
        "1 / (1 - exp(-mu))",
        "1 / (1 + exp(-eta))",
        "exp(-eta) / ((1 + exp(-eta)) * (1 + exp(-eta)))",
        "-exp(-mu) / ((1 - exp(-mu)) * (1 - exp(-mu)))",
    ),
}
_PARTS = ("link", "inverse", "dlink", "dinverse", "d2inverse", "d2link")


@query(
    "f17_links",
    "SELECT trade_id, "
    + ", ".join(
        f"CAST({e} AS DOUBLE) AS {name}_{p}" for name, es in _LINKS.items() for p, e in zip(_PARTS, es)
    )
    + " FROM (SELECT trade_id, 0.1 + qty_mw / 50 AS mu, price / 200 - 0.5 AS eta FROM fx_trades) t",
    ("fx_trades",),
    tuple(f"{name}_{p}" for name in _LINKS for p in _PARTS),
)
def _f17(spark, sf):
    t = V.trades(spark, sf).select(
        "trade_id", (0.1 + F.col("qty_mw") / 50).alias("mu"), (F.col("price") / 200 - 0.5).alias("eta")
    )
    mu, eta = F.col("mu"), F.col("eta")
    cols = []
    for name in _LINKS:
        cols += [
            N.link(name, mu).alias(f"{name}_link"),
            N.link_inverse(name, eta).alias(f"{name}_inverse"),
            N.link_derivative(name, mu).alias(f"{name}_dlink"),
            N.inverse_derivative(name, eta).alias(f"{name}_dinverse"),
            N.inverse_second_derivative(name, eta).alias(f"{name}_d2inverse"),
            N.link_second_derivative(name, mu).alias(f"{name}_d2link"),
        ]
    return t.select("trade_id", *cols)


@query(
    "f14_ensemble_crps",
    """SELECT vec_id, avg(abs(v - label)) - sum((2 * rn - 65) * v) / 4096 AS crps FROM (SELECT vec_id, label, v,
       row_number() OVER (PARTITION BY vec_id ORDER BY v) AS rn FROM (SELECT vec_id, label,
       CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) u) r GROUP BY 1""",
    (),
    ("crps",),
)
def _f14e(spark, sf):
    e = V.table(spark, sf, "embeddings")
    return e.select("vec_id", N.ensemble_crps(F.col("embedding"), F.col("label").cast("double")).alias("crps"))


@query(
    "w9_ensemble_rank",
    """SELECT label, sum((2 * rn - n - 1) * v) / (CAST(n AS DOUBLE) * n) AS half_spread FROM (SELECT label, v,
       row_number() OVER (PARTITION BY label ORDER BY v) AS rn, count(*) OVER (PARTITION BY label) AS n
       FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) u) r GROUP BY label, n""",
    (),
    ("half_spread",),
)
def _w9(spark, sf):
    from ..operators.scores import pairwise_spread

    e = V.table(spark, sf, "embeddings").select(
        "label", F.explode("embedding").alias("v")
    ).withColumn("v", F.col("v").cast("double"))
    return pairwise_spread(e, ["label"], "v", F.floor(F.col("v") * 50)).drop("n")


def _cdf_sql(x):
    """Standard normal cdf in SQL: a series of positive terms, on |x| up to 9 (beyond it 0 or 1 to rounding)."""
    q = f"(least(abs({x}), 9.0) / sqrt(2))"
    series = f"list_sum(list_transform(range(160), lambda n: exp((2 * n + 1) * ln({q}) - {q} * {q} - lgamma(n + 1.5))))"
    return f"(0.5 + 0.5 * sign({x}) * CASE WHEN {x} = 0 THEN 0 ELSE {series} END)"


@query(
    "f14_gaussian_scores",
    f"""SELECT source, timestamp, CASE WHEN var_cond > 0 THEN sqrt(var_cond) * (z * (2 * {_cdf_sql("z")} - 1)
       + 2 * exp(-z * z / 2) / sqrt(2 * pi()) - 1 / sqrt(pi())) ELSE abs(y_true - mu_cond) END AS crps,
       CASE WHEN var_cond > 0 THEN 0.5 * (ln(2 * pi()) + ln(var_cond) + z * z) END AS log_score
       FROM (SELECT *, CASE WHEN var_cond > 0 THEN (y_true - mu_cond) / sqrt(var_cond) END AS z FROM fx_preds) p""",
    ("fx_preds",),
    ("crps", "log_score"),
    digits=5,
)
def _f14g(spark, sf):
    p = V.predictions(spark, sf)
    y, m, v = F.col("y_true"), F.col("mu_cond"), F.col("var_cond")
    return p.select(
        "source", "timestamp",
        N.gaussian_crps(y, m, v).alias("crps"), N.gaussian_log_score(y, m, v).alias("log_score"),
    )


@query(
    "f14_gaussian_log_score",
    """SELECT source, timestamp, CASE WHEN var_cond > 0 THEN 0.5 * (ln(2 * pi()) + ln(var_cond)
       + (y_true - mu_cond) ** 2 / var_cond) END AS log_score FROM fx_preds""",
    ("fx_preds",),
    ("log_score",),
    digits=5,
)
def _f14l(spark, sf):
    p = V.predictions(spark, sf)
    return p.select(
        "source", "timestamp",
        N.gaussian_log_score(F.col("y_true"), F.col("mu_cond"), F.col("var_cond")).alias("log_score"),
    )


_JSU = """SELECT trade_id, y, pi, mu, sd, nu, tau, c, w, s, mu - c * sd * sqrt(w) * sinh(s) AS loc, c * sd AS sc
    FROM (SELECT *, 1 / sqrt(0.5 * (w - 1) * (w * cosh(2 * s) + 1)) AS c FROM (SELECT *, exp(1 / (tau * tau)) AS w,
    nu / tau AS s FROM (SELECT trade_id, CASE WHEN side = 'BUY' THEN price / 50 - 1 ELSE 0 END AS y,
    0.2 + qty_mw / 200 AS pi, price / 100 - 0.5 AS mu, 0.5 + qty_mw / 50 AS sd, qty_mw / 100 - 0.5 AS nu,
    1 + qty_mw / 100 AS tau FROM fx_trades) a) b) d"""
_Z = "((y - loc) / sc)"
_R = f"(-nu + tau * asinh({_Z}))"
_PDF = f"(tau / (sc * sqrt({_Z} * {_Z} + 1) * sqrt(2 * pi())) * exp(-0.5 * {_R} * {_R}))"


def _jsu_rows(spark, sf):
    p, q = F.col("price"), F.col("qty_mw")
    t = V.trades(spark, sf).select(
        "trade_id",
        F.when(F.col("side") == "BUY", p / 50 - 1).otherwise(F.lit(0.0)).alias("y"),
        (0.2 + q / 200).alias("pi"), (p / 100 - 0.5).alias("mu"), (0.5 + q / 50).alias("sd"),
        (q / 100 - 0.5).alias("nu"), (1 + q / 100).alias("tau"),
    )
    native = N.jsu_native(F.col("mu"), F.col("sd"), F.col("nu"), F.col("tau"))
    return t.withColumns({k: v for k, v in native.items()})


@query(
    "f16_jsu",
    f"""WITH j AS ({_JSU}) SELECT trade_id, loc, sc AS scale, {_PDF} AS pdf,
        0.25 * c ** 3 * sqrt(w) * (w - 1) ** 2 * (w * (w + 2) * sinh(3 * s) + 3 * sinh(s)) AS skewness,
        mu AS mu_back, sd AS sigma_back FROM j""",
    ("fx_trades",),
    ("loc", "scale", "pdf", "skewness", "mu_back", "sigma_back"),
)
def _f16(spark, sf):
    d = _jsu_rows(spark, sf)
    back = N.jsu_meansd(F.col("loc"), F.col("scale"), F.col("skew"), F.col("tail"))
    mom = N.jsu_moments(F.col("mu"), F.col("sd"), F.col("nu"), F.col("tau"))
    pdf = N.jsu_pdf(F.col("y"), F.col("loc"), F.col("scale"), F.col("skew"), F.col("tail"))
    return d.select(
        "trade_id", "loc", "scale", pdf.alias("pdf"), mom["skewness"].alias("skewness"),
        back["mu"].alias("mu_back"), back["sigma"].alias("sigma_back"),
    )


@query(
    "f16_cdf",
    f"""WITH j AS ({_JSU}), u AS (SELECT trade_id, {_R} AS r, (y - mu) / sd AS z FROM j)
       SELECT trade_id, {_cdf_sql("r")} AS jsu_cdf, {_cdf_sql("z")} AS normal_cdf FROM u""",
    ("fx_trades",),
    ("jsu_cdf", "normal_cdf"),
    digits=7,
)
def _f16c(spark, sf):
    d = _jsu_rows(spark, sf)
    return d.select(
        "trade_id",
        N.jsu_cdf(F.col("y"), F.col("loc"), F.col("scale"), F.col("skew"), F.col("tail")).alias("jsu_cdf"),
        N.normal_cdf(F.col("y"), F.col("mu"), F.col("sd")).alias("normal_cdf"),
    )


@query(
    "f15_mixture_scores",
    f"""WITH j AS ({_JSU}) SELECT trade_id, pi * mu AS cond_mean, pi * sd * sd + pi * (1 - pi) * mu * mu AS cond_var,
        CASE WHEN abs(y) <= 1e-8 THEN ln(1 - pi) ELSE ln(greatest(pi * {_PDF}, 1e-300)) END AS log_score FROM j""",
    ("fx_trades",),
    ("cond_mean", "cond_var", "log_score"),
    digits=8,
)
def _f15(spark, sf):
    d = _jsu_rows(spark, sf)
    mean, var = N.mixture_moments(F.col("pi"), F.col("mu"), F.col("sd"))
    pdf = N.jsu_pdf(F.col("y"), F.col("loc"), F.col("scale"), F.col("skew"), F.col("tail"))
    return d.select(
        "trade_id", mean.alias("cond_mean"), var.alias("cond_var"),
        N.zero_inflated_log_score(F.col("y"), F.col("pi"), pdf).alias("log_score"),
    )


@query(
    "f19_forecast_errors",
    """SELECT source, timestamp, y_true - mu_cond AS error, abs(y_true - mu_cond) AS abs_error,
       (y_true - mu_cond) * (y_true - mu_cond) AS sq_error FROM fx_preds""",
    ("fx_preds",),
    ("error", "abs_error", "sq_error"),
)
def _f19(spark, sf):
    p = V.predictions(spark, sf)
    errs = N.forecast_errors(F.col("y_true"), F.col("mu_cond"))
    return p.select("source", "timestamp", *[c.alias(n) for n, c in errs.items()])
