"""Aggregation, density and rolling-statistic queries."""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

from pyspark.sql import functions as F

from ..operators import density as D
from ..operators import stats as S
from ..operators.ordered import running_total
from . import views as V
from .registry import query
from .views import VIEW_SQL

ITEM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
VIEW_SQL["fx_matrix"] = ((), """SELECT l_returnflag, l_quantity / 50 AS x0, l_extendedprice / 100000 AS x1,
    l_discount * 10 AS x2, l_tax * 10 AS x3 FROM lineitem""")
XS = ["x0", "x1", "x2", "x3"]


def matrix(spark, sf):
    return V.table(spark, sf, "lineitem").select(
        "l_returnflag",
        (F.col("l_quantity") / 50).alias("x0"),
        (F.col("l_extendedprice") / 100000).alias("x1"),
        (F.col("l_discount") * 10).alias("x2"),
        (F.col("l_tax") * 10).alias("x3"),
    )


_G = list(combinations_with_replacement(range(3), 2))


@query(
    "a16_gram",
    "SELECT l_returnflag, count(*) AS n, sum(x0) AS sum_w, "
    + ", ".join(f"sum(x0 * x{i + 1} * x{j + 1}) AS g_{i}_{j}" for i, j in _G)
    + ", " + ", ".join(f"sum(x0 * x{i + 1} * x0) AS xy_{i}" for i in range(3))
    + ", sum(x0 * x0 * x0) AS yy FROM fx_matrix GROUP BY 1",
    ("fx_matrix",),
    tuple(["sum_w", "yy"] + [f"g_{i}_{j}" for i, j in _G] + [f"xy_{i}" for i in range(3)]),
    digits=4,
)
def _a16(spark, sf):
    return S.gram(matrix(spark, sf), XS[1:], "x0", "x0", ["l_returnflag"])


@query(
    "a17_scaler_fit",
    "SELECT l_returnflag, count(*) AS n, "
    + ", ".join(f"avg({c}) AS mean_{c}, var_pop({c}) AS var_{c}" for c in XS)
    + " FROM fx_matrix GROUP BY 1",
    ("fx_matrix",),
    tuple(f"{m}_{c}" for c in XS for m in ("mean", "var")),
)
def _a17(spark, sf):
    return S.scaler_fit(matrix(spark, sf), XS, ["l_returnflag"])


@query(
    "f18_standardise",
    """SELECT trade_id, (price - (SELECT avg(price) FROM fx_trades)) / (SELECT stddev_pop(price) FROM fx_trades)
       AS price, (qty_mw - (SELECT avg(qty_mw) FROM fx_trades)) / (SELECT stddev_pop(qty_mw) FROM fx_trades)
       AS qty_mw FROM fx_trades""",
    ("fx_trades",),
    ("price", "qty_mw"),
)
def _f18(spark, sf):
    t = V.trades(spark, sf).select("trade_id", "price", "qty_mw")
    return S.scale(t, S.scaler_fit(t, ["price", "qty_mw"]), ["price", "qty_mw"])


@query(
    "a18_covariance",
    "SELECT l_returnflag, "
    + ", ".join(
        f"covar_samp({XS[i]}, {XS[j]}) AS cov_{i}_{j}" for i, j in combinations_with_replacement(range(4), 2)
    )
    + " FROM fx_matrix GROUP BY 1",
    ("fx_matrix",),
    tuple(f"cov_{i}_{j}" for i, j in combinations_with_replacement(range(4), 2)),
)
def _a18(spark, sf):
    return S.covariance(matrix(spark, sf), XS, ["l_returnflag"])


@query(
    "a26_truncation_box",
    "SELECT "
    + ", ".join(
        f"avg({c}) - 6 * sqrt(var_pop({c}) + sqrt(greatest(kurtosis_pop({c}) * var_pop({c}) ** 2, 0))) AS lo_{c}, "
        f"avg({c}) + 6 * sqrt(var_pop({c}) + sqrt(greatest(kurtosis_pop({c}) * var_pop({c}) ** 2, 0))) AS hi_{c}"
        for c in ("price", "qty_mw")
    )
    + " FROM fx_trades",
    ("fx_trades",),
    ("lo_price", "hi_price", "lo_qty_mw", "hi_qty_mw"),
)
def _a26(spark, sf):
    return S.truncation_box(V.trades(spark, sf), ["price", "qty_mw"], 6.0)


@query(
    "p11_trim",
    "SELECT delivery_date, delivery_hour, bin, vwap_changes FROM fx_bins WHERE vwap_changes BETWEEN -20 AND 20",
    ("fx_bins",),
    ("vwap_changes",),
)
def _p11(spark, sf):
    d = V.bins(spark, sf).select("delivery_date", "delivery_hour", "bin", "vwap_changes")
    return S.trim(d, "vwap_changes", -20, 20)


@query(
    "a8_delta_histogram",
    """WITH d AS (SELECT vwap_changes AS x, alpha FROM fx_bins WHERE vwap_changes IS NOT NULL),
       m AS (SELECT max(abs(x)) AS hi FROM d), e AS (SELECT -hi AS lo, (2 * hi) / 101 AS w FROM m)
       SELECT CAST(i AS INT) AS slot, lo + i * w AS left_edge, lo + i * w + w / 2 AS center,
       coalesce(n, 0) AS n, coalesce(n0, 0) AS n_alpha0, lo + i * w <= 0 AND lo + i * w + w > 0 AS is_zero_bin
       FROM e CROSS JOIN (SELECT unnest(range(101)) AS i) s LEFT JOIN (SELECT least(CAST(floor((x - lo) / w) AS INT), 100)
       AS k, count(*) AS n, count(*) FILTER (alpha = 0) AS n0 FROM d, e GROUP BY 1) c ON c.k = i""",
    ("fx_bins",),
    ("left_edge", "center"),
)
def _a8(spark, sf):
    return S.delta_histogram(V.bins(spark, sf), bins=100)


@query(
    "a8_fixed_histogram",
    """SELECT CAST(i AS INT) AS slot, -50 + i * 2.0::DOUBLE AS left_edge, -49 + i * 2.0::DOUBLE AS center,
       coalesce(n, 0) AS n, coalesce(n0, 0) AS n_alpha0, i = 25 AS is_zero_bin
       FROM (SELECT unnest(range(50)) AS i) s LEFT JOIN (SELECT least(CAST(floor((vwap_changes + 50) / 2) AS INT), 49)
       AS k, count(*) AS n, count(*) FILTER (alpha = 0) AS n0 FROM fx_bins WHERE vwap_changes BETWEEN -50 AND 50
       GROUP BY 1) c ON c.k = i""",
    ("fx_bins",),
    ("left_edge", "center"),
)
def _a8f(spark, sf):
    return S.delta_histogram(V.bins(spark, sf), bins=50, xlim=(-50.0, 50.0))


@query(
    "a9_hour_correlation",
    """WITH d AS (SELECT delivery_date, bin, delivery_hour, vwap_changes AS x FROM fx_bins WHERE
       vwap_changes IS NOT NULL AND NOT (extract(month FROM delivery_date) = 1 AND extract(day FROM delivery_date) = 1))
       SELECT a.delivery_hour AS h1, b.delivery_hour AS h2, count(*) AS n, corr(a.x, b.x) AS corr FROM d a JOIN d b
       ON a.delivery_date = b.delivery_date AND a.bin = b.bin GROUP BY 1, 2""",
    ("fx_bins",),
    ("corr",),
)
def _a9(spark, sf):
    return S.hour_correlation(V.bins(spark, sf))


@query(
    "a10_normal_moments",
    """SELECT delivery_hour, count(*) AS n, avg(vwap_changes) AS mean, stddev_pop(vwap_changes) AS sd
       FROM fx_bins WHERE alpha <> 0 GROUP BY 1""",
    ("fx_bins",),
    ("mean", "sd"),
)
def _a10n(spark, sf):
    d = V.bins(spark, sf).filter(F.col("alpha") != 0)
    return d.groupBy("delivery_hour").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("vwap_changes").alias("mean"),
        F.stddev_pop("vwap_changes").alias("sd"),
    )


@query(
    "w11_empirical_cdf",
    """SELECT side, price, count(*) AS n, sum(count(*)) OVER (PARTITION BY side ORDER BY price)::DOUBLE
       / sum(count(*)) OVER (PARTITION BY side)::DOUBLE AS ecdf FROM fx_trades GROUP BY 1, 2""",
    ("fx_trades",),
    ("ecdf",),
)
def _w11(spark, sf):
    ties = V.trades(spark, sf).groupBy("side", "price").agg(F.count(F.lit(1)).alias("n"))
    cum = running_total(ties, ["side"], ["price"], ["n"], F.floor(F.col("price") / 5))
    return cum.select("side", "price", "n", (F.col("cum_n") / F.col("tot_n")).alias("ecdf"))


@query("a20_mardia_nu")
def _a20(spark, sf):
    return S.mardia_nu(matrix(spark, sf), XS, ["l_returnflag"])


A, B, K = [-4.0, -4.0], [4.0, 4.0], 8
VIEW_SQL["fx_scaled"] = ((), """SELECT (l_quantity - (SELECT avg(l_quantity) FROM lineitem)) /
    (SELECT stddev_pop(l_quantity) FROM lineitem) AS u, (l_discount - (SELECT avg(l_discount) FROM lineitem)) /
    (SELECT stddev_pop(l_discount) FROM lineitem) AS v FROM lineitem""")


def scaled(spark, sf):
    d = V.table(spark, sf, "lineitem").select(F.col("l_quantity").alias("u"), F.col("l_discount").alias("v"))
    return S.scale(d, S.scaler_fit(d, ["u", "v"]), ["u", "v"])


_PI = "3.141592653589793"
VIEW_SQL["fx_coefs"] = (("fx_scaled",), f"""SELECT CAST(i AS INT) AS k1, CAST(j AS INT) AS k2,
    avg(cos(i * {_PI} * (u + 4) / 8) * cos(j * {_PI} * (v + 4) / 8)) * 4 / 64 AS coef FROM fx_scaled,
    (SELECT unnest(range(8)) AS i) a, (SELECT unnest(range(8)) AS j) b GROUP BY 1, 2""")


@query("a22_cos_coefficients", "SELECT * FROM fx_coefs", ("fx_coefs",), ("coef",), digits=9)
def _a22(spark, sf):
    return D.cos_coefficients(scaled(spark, sf), ["u", "v"], A, B, K)


@query(
    "a21_ecf_grid",
    f"""SELECT CAST(s AS INT) AS sign2, CAST(i AS INT) AS k1, CAST(j AS INT) AS k2,
        avg(cos({_PI} / 8 * (i * u + s * j * v))) AS re, avg(sin({_PI} / 8 * (i * u + s * j * v))) AS im
        FROM fx_scaled, (SELECT unnest(range(8)) AS i) a, (SELECT unnest(range(8)) AS j) b,
        (SELECT unnest([1, -1]) AS s) c GROUP BY 1, 2, 3""",
    ("fx_scaled",),
    ("re", "im"),
    digits=9,
)
def _a21(spark, sf):
    return D.ecf_grid(scaled(spark, sf), ["u", "v"], A, B, K)


@query(
    "a21_ecf_grid_fine",
    f"""SELECT CAST(s AS INT) AS sign2, CAST(i AS INT) AS k1, CAST(j AS INT) AS k2,
        avg(cos({_PI} / 8 * (i * u + s * j * v))) AS re, avg(sin({_PI} / 8 * (i * u + s * j * v))) AS im
        FROM fx_scaled, (SELECT unnest(range(32)) AS i) a, (SELECT unnest(range(32)) AS j) b,
        (SELECT unnest([1, -1]) AS s) c GROUP BY 1, 2, 3""",
    ("fx_scaled",),
    ("re", "im"),
    digits=9,
)
def _a21_fine(spark, sf):
    return D.ecf_grid(scaled(spark, sf), ["u", "v"], A, B, 32)


@query(
    "f21_density",
    f"""SELECT u, v, sum(coef * cos(k1 * {_PI} * (u + 4) / 8) * cos(k2 * {_PI} * (v + 4) / 8)
        * CASE WHEN k1 = 0 THEN 0.5 ELSE 1 END * CASE WHEN k2 = 0 THEN 0.5 ELSE 1 END) AS density
        FROM (SELECT DISTINCT round(u, 1) + 0.0 AS u, round(v, 1) + 0.0 AS v FROM fx_scaled) p, fx_coefs GROUP BY 1, 2""",
    ("fx_scaled", "fx_coefs"),
    ("density",),
)
def _f21(spark, sf):
    d = scaled(spark, sf)
    points = d.select(F.round("u", 1).alias("u"), F.round("v", 1).alias("v")).distinct()
    return D.density_from_coefficients(points, D.cos_coefficients(d, ["u", "v"], A, B, K), ["u", "v"], A, B)


@query(
    "w12_ecf_shrink",
    f"""WITH g AS (SELECT CAST(i AS INT) AS k1, avg(cos({_PI} / 8 * i * u)) AS re, avg(sin({_PI} / 8 * i * u)) AS im
        FROM fx_scaled, (SELECT unnest(range(64)) AS i) a GROUP BY 1),
        m AS (SELECT *, sqrt(re * re + im * im) AS r FROM g),
        z AS (SELECT count(*)::DOUBLE AS n FROM fx_scaled),
        k AS (SELECT *, min(CAST(r >= 2 * sqrt(n - 1) / n AS INT)) OVER (ORDER BY k1) = 1 AS accepted FROM m, z),
        s AS (SELECT *, CASE WHEN accepted THEN n / (2 * (n - 1)) * (1 + sqrt(greatest(1 - 4 * (n - 1) / (n * n * r * r), 0)))
          ELSE 0 END AS gain FROM k)
        SELECT k1, accepted, CAST(gain AS DOUBLE) AS gain, CAST(gain * re AS DOUBLE) AS re, CAST(gain * im AS DOUBLE) AS im FROM s""",
    ("fx_scaled",),
    ("gain", "re", "im"),
)
def _w12(spark, sf):
    d = scaled(spark, sf)
    return D.ecf_shrink_1d(D.ecf_grid(d, ["u"], A[:1], B[:1], 64), d.filter("u IS NOT NULL").count())


@query(
    "a20_mardia_nu_pair",
    """WITH m AS (SELECT l_returnflag, avg(x0) AS a, avg(x1) AS b, var_samp(x0) AS saa, var_samp(x1) AS sbb,
       covar_samp(x0, x1) AS sab FROM fx_matrix GROUP BY 1),
       q AS (SELECT f.l_returnflag, (sbb * (x0 - a) ** 2 - 2 * sab * (x0 - a) * (x1 - b) + saa * (x1 - b) ** 2)
       / (saa * sbb - sab * sab) AS d2 FROM fx_matrix f JOIN m ON m.l_returnflag = f.l_returnflag),
       k AS (SELECT l_returnflag, count(*) AS n, avg(d2 * d2) AS beta FROM q GROUP BY 1)
       SELECT *, CASE WHEN beta / 8 <= 1 + 1e-9 THEN CAST('inf' AS DOUBLE)
       ELSE (4 * beta / 8 - 2) / (beta / 8 - 1) END AS nu FROM k""",
    ("fx_matrix",),
    ("beta", "nu"),
    digits=5,
)
def _a20p(spark, sf):
    return S.mardia_nu(matrix(spark, sf), ["x0", "x1"], ["l_returnflag"])
