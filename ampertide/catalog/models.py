"""Model, streaming and parameter-store queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..models import gamlss as G
from ..models import linear as L
from ..models import marginals as A
from ..models import mvt as M
from ..models import resume as Z
from ..operators import features as X
from ..operators import panel as P
from ..operators import reports as R
from ..session import cut, scratch_path
from ..sources import buckets as B
from ..sources import sinks as O
from ..streaming import incremental as S
from ..streaming import keyed as K
from . import views as V
from .registry import query
from .stats import XS, matrix
from .views import VIEW_SQL

CFG = M.StudyConfig(lookback_days=14, block_days=7, lags=P.LagDesign(own=2, run=2, ahead=1))


def spread_panel(spark, sf):
    b = X.with_da_price(V.bins(spark, sf), V.day_ahead(spark, sf))
    return b.select(
        "delivery_date", "delivery_hour", F.col("bin_timestamp").alias("ts"),
        (F.col("da_price") - F.col("vwap")).alias("da-id"),
    ).na.drop()


def _horizons(spark, sf):
    """(feature names, rows) of every horizon."""
    return list(M.study_rows(spread_panel(spark, sf), CFG).values())


def _all(frames):
    return reduce(lambda a, b: a.unionByName(b), frames)


def _fits(spark, sf, method):
    return [(names, rows, M.fit_mvt(rows, names, 14, method, 7)) for names, rows in _horizons(spark, sf)]


@query(
    "m1_rolling_ols",
    """SELECT day, n, total, CASE WHEN count(*) OVER w = 90 THEN regr_intercept(total, n) OVER w
       + regr_slope(total, n) OVER w * n END AS prediction FROM (SELECT CAST(o_orderdate AS DATE) AS day,
       count(*) AS n, sum(o_totalprice) / 7000 AS total FROM orders GROUP BY 1) d
       WINDOW w AS (ORDER BY day ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING)""",
    (),
    ("total", "prediction"),
    digits=3,
)
def _m1(spark, sf):
    d = V.table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), (F.sum("o_totalprice") / 7000).alias("total")
    )
    return L.rolling_ols(d, "total", ["n"], 90, ["day"], F.year("day"), block=512).drop("_idx")


@query("m1_rolling_ols_quadratic")
def _m1q(spark, sf):
    d = V.table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean_price"),
        (F.sum("o_totalprice") / 1000).alias("total"),
    )
    out = L.rolling_ols(d, "total", ["n", "mean_price"], 180, ["day"], F.year("day"), 2, block=512)
    return out.drop("_idx")


def _flat(params):
    """Parameters without nested arrays, for a stable comparison of rows."""
    return params.select(
        "date", "hour", "which_hour_before", "method", "calibration_ok", "error", "df", "n", "p",
        F.get("mu_scaled", F.lit(0)).alias("mu_0"),
        F.get(F.get("Sigma_scaled", F.lit(0)), F.lit(0)).alias("sigma_00"),
        F.get("scaler_mean", F.lit(0)).alias("mean_0"), F.get("scaler_scale", F.lit(0)).alias("scale_0"),
        "converged", "rounds",
    )


@query("m5_fit_ecm")
def _m5(spark, sf):
    return _flat(_all(fit for _, _, fit in _fits(spark, sf, "ecm")))


@query("m6_fit_mardia")
def _m6(spark, sf):
    return _flat(_all(fit for _, _, fit in _fits(spark, sf, "mardia")))


VIEW_SQL["fx_spread"] = (("fx_bins", "fx_da"), """SELECT b.delivery_date, b.delivery_hour, b.bin_timestamp AS ts,
    a.price - b.vwap AS v FROM fx_bins b JOIN fx_da a ON a.delivery_date = b.delivery_date
    AND a.delivery_hour = b.delivery_hour WHERE vwap IS NOT NULL""")


def _study_view(wh):
    """Rows of one horizon with their lags, as SQL; the number of features beside."""
    design = CFG.design(wh)
    names = P.feature_names("daid", design)
    lags = [(o, k) for o, ks in design.items() for k in ks if (o, k) != (0, 0)]
    cols = ", ".join(f"j{i}.v AS {P.lag_name('daid', o, k)}" for i, (o, k) in enumerate(lags))
    joins = " ".join(
        f"JOIN fx_spread j{i} ON j{i}.ts = b.ts - to_minutes({15 * k}) AND j{i}.delivery_hour = (b.delivery_hour + {o} + 24) % 24"
        for i, (o, k) in enumerate(lags)
    )
    start = "CAST(b.delivery_date AS TIMESTAMP) + to_hours(b.delivery_hour)"
    VIEW_SQL[f"fx_study{wh}"] = (("fx_spread",), f"SELECT b.delivery_date, b.delivery_hour, b.ts, b.v AS {names[0]}, {cols} "
        f"FROM fx_spread b {joins} WHERE b.ts >= {start} - INTERVAL {wh} HOUR AND b.ts < {start} - INTERVAL {wh - 1} HOUR")
    return names


_STUDY = {wh: _study_view(wh) for wh in CFG.horizons}
_STUDY_VIEWS = tuple(f"fx_study{wh}" for wh in _STUDY)


def _per_horizon(sql):
    """One SELECT per horizon; {v}, {wh}, {p} and {y} stand for view, horizon, features, value."""
    return " UNION ALL ".join(sql.format(v=f"fx_study{wh}", wh=wh, p=len(n), y=n[0]) for wh, n in _STUDY.items())


_TARGETS = """(SELECT DISTINCT delivery_date, delivery_hour FROM {v}) t LEFT JOIN {v} r
    ON r.delivery_hour = t.delivery_hour AND r.delivery_date < t.delivery_date AND r.delivery_date >= t.delivery_date - 14"""


@query(
    "m2_study_rows",
    " UNION ALL ".join(
        f"SELECT CAST({wh} AS INT) AS wh, '{','.join(n)}' AS features, delivery_hour, count(*) AS n FROM fx_study{wh} GROUP BY 3"
        for wh, n in _STUDY.items()
    ),
    _STUDY_VIEWS,
)
def _m2(spark, sf):
    out = None
    for wh, (names, rows) in M.study_rows(spread_panel(spark, sf), CFG).items():
        part = rows.groupBy("delivery_hour").agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(wh).alias("wh"), F.lit(",".join(names)).alias("features"), "delivery_hour", "n"
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "a25_fit_status",
    _per_horizon(f"""SELECT t.delivery_date AS date, t.delivery_hour AS hour, CAST({{wh}} AS INT) AS which_hour_before,
        count(r.ts) AS n, CAST({{p}} AS INT) AS p, count(r.ts) >= {{p}} + 2 AS calibration_ok, CASE WHEN count(r.ts) < {{p}} + 2
        THEN 'too few samples' END AS error FROM {_TARGETS} GROUP BY 1, 2"""),
    _STUDY_VIEWS,
)
def _a25(spark, sf):
    fits = _all(fit for _, _, fit in _fits(spark, sf, "mardia"))
    return fits.select("date", "hour", "which_hour_before", "n", "p", "calibration_ok", "error")


_SCORE_JOIN = _per_horizon(f"""SELECT s.delivery_date AS date, s.delivery_hour AS hour, CAST({{wh}} AS INT) AS which_hour_before, s.ts,
    s.{{y}} AS y, k.n FROM {{v}} s JOIN (SELECT t.delivery_date, t.delivery_hour, count(r.ts) AS n FROM {_TARGETS}
    GROUP BY 1, 2 HAVING count(r.ts) >= {{p}} + 2) k ON k.delivery_date = s.delivery_date AND k.delivery_hour = s.delivery_hour""")


@query("j12_score_join", _SCORE_JOIN, _STUDY_VIEWS, ("y",))
def _j12(spark, sf):
    return _all(
        M.score_join(rows, fit).select("date", "hour", "which_hour_before", "ts", F.col(names[0]).alias("y"), "n")
        for names, rows, fit in _fits(spark, sf, "mardia")
    )


@query("j12_colocated_lookup", _SCORE_JOIN, _STUDY_VIEWS, ("y",))
def _j12_stored(spark, sf):
    """The lookup between a panel and parameters stored in equal buckets: no row is moved."""
    found = []
    fits = _fits(spark, sf, "mardia")
    at = scratch_path(spark, "params")
    B.store_params(_all(fit.select("date", "hour", "which_hour_before", "n", "calibration_ok") for _, _, fit in fits), at, 8)
    params = B.open_bucketed(spark, at)
    for names, rows, _ in fits:
        path = scratch_path(spark, "panel")
        B.store_panel(rows, path, 8)
        found.append(
            M.score_join(B.open_bucketed(spark, path), params).select(
                "date", "hour", "which_hour_before", "ts", F.col(names[0]).alias("y"), "n"
            )
        )
    return _all(found)


def _forecasts(spark, sf, method="mardia"):
    return _all(M.predict_mvt(rows, cut(fit), names) for names, rows, fit in _fits(spark, sf, method))


@query("m7_predict")
def _m7(spark, sf):
    return _forecasts(spark, sf).drop("used_features", "log_norm", "scale2")


@query("m8_score_density")
def _m8(spark, sf):
    return M.score_density(_forecasts(spark, sf, "ecm")).drop("used_features")


@query("m9_run_study")
def _m9(spark, sf):
    return M.run_study(spread_panel(spark, sf), CFG)[2]


@query("m9_resume_study")
def _m9r(spark, sf):
    # Stopped after one part, then taken up again from the manifest.
    folder, panel = scratch_path(spark, "study"), cut(spread_panel(spark, sf))
    Z.run_parts(panel, CFG, folder, blocks_per_part=1, at_most=1)
    Z.run_parts(panel, CFG, folder, blocks_per_part=1)
    return Z.study_results(spark, folder)[2]


@query("m10_model_covariance")
def _m10(spark, sf):
    cov = M.model_covariance(_all(fit for _, _, fit in _fits(spark, sf, "mardia")))
    return cov.select(
        "date", "hour", "which_hour_before", F.posexplode("covariance").alias("i", "row")
    ).select("date", "hour", "which_hour_before", F.col("i"), F.get("row", F.lit(0)).alias("with_target"))


@query("m11_marginal_curve")
def _m11c(spark, sf):
    from .stats import scaled

    return A.marginal_curve(scaled(spark, sf), "u", 0.0, 0.9, 8.0)


@query(
    "m11_nu_profile",
    """WITH x AS (SELECT delivery_hour, CAST(vwap_changes AS DOUBLE) AS x, alpha FROM fx_bins WHERE alpha <> 0),
       e AS (SELECT delivery_hour, avg(x) AS m, stddev_samp(x) AS s FROM x GROUP BY 1),
       k AS (SELECT delivery_hour, 'fitted' AS kind, 0.0::DOUBLE AS m, 10.0::DOUBLE AS s FROM e
       UNION ALL SELECT delivery_hour, 'empirical', m, s FROM e),
       v AS (SELECT 1.05::DOUBLE + 0.5::DOUBLE * unnest(range(40)) AS nu),
       g AS (SELECT delivery_hour, kind, nu, sum(lgamma((nu + 1) / 2) - lgamma(nu / 2) - 0.5 * ln(nu * pi()) - ln(s)
       - 0.5 * (nu + 1) * ln(1 + ((x - m) / s) ** 2 / nu)) AS log_lik FROM x JOIN k USING (delivery_hour), v
       WHERE x IS NOT NULL GROUP BY 1, 2, 3)
       SELECT *, log_lik = max(log_lik) OVER (PARTITION BY delivery_hour, kind) AS is_max FROM g""",
    ("fx_bins",),
    ("nu", "log_lik"),
    digits=4,
)
def _m11p(spark, sf):
    b = V.bins(spark, sf).filter(F.col("alpha") != 0)
    nus = [1.05 + 0.5 * i for i in range(40)]
    return A.nu_profile(b, "vwap_changes", nus, 0.0, 10.0, ["delivery_hour"])


@query("a10_fit_marginals")
def _a10(spark, sf):
    return A.fit_marginals(V.bins(spark, sf)).select(
        "delivery_hour", "distribution", "n", "ks", "p_value", F.get("params", F.lit(0)).alias("param_0"), "converged", "rounds"
    )


FEATURES = ["vwap_changes_lag1", "abs_vwap_changes_lag1", "alpha_lag1", "f_TTD"]


def model_rows(spark, sf):
    d = X.with_ttd(V.bins(spark, sf))
    d = X.add_abs(d, ["vwap_changes"])
    d = X.add_lags(d, {"vwap": [1], "vwap_changes": [1], "abs_vwap_changes": [1], "alpha": [1]})
    d = d.withColumn("ttd", 16 - F.col("bin"))
    d = X.neighbor_features(d)
    feats = [*FEATURES, "nb_dchg_m1", "nb_dchg_p1"]
    return X.design_columns(d, feats), feats


@query("m12_fit_gamlss")
def _m12(spark, sf):
    rows, feats = model_rows(spark, sf)
    fit = G.fit_gamlss(rows, "vwap_changes", feats, "jsu", 20, 10, 12)
    return fit.select("delivery_date", "delivery_hour", "n", "fit_ok", "error", "beta", "nll", "converged", "rounds")


@query("m12_fit_normal_lasso")
def _m12n(spark, sf):
    rows, feats = model_rows(spark, sf)
    fit = G.fit_gamlss(rows, "vwap_changes", feats, "normal", 20, 10, 12, "lasso_bic")
    return fit.select("delivery_date", "delivery_hour", "n", "fit_ok", "error", "beta", "nll", "converged", "rounds")


@query("m13_fit_trade_logit")
def _m13(spark, sf):
    rows, feats = model_rows(spark, sf)
    fit = G.fit_trade_logit(rows, feats, 20, 10)
    return fit.select("delivery_date", "delivery_hour", "n", "logit_ok", F.get("logit_beta", F.lit(0)).alias("b0"), "converged", "rounds")


@query("m14_logit_path_bic")
def _m14(spark, sf):
    d = V.trades(spark, sf).select(
        (F.col("side") == "BUY").cast("int").alias("y"), "price", "qty_mw",
        F.hour("delivery_start").cast("double").alias("hour"), "duration_min",
    )
    cs = [10.0 ** (-4 + 0.5 * i) for i in range(15)]
    path = L.logit_path_bic(d, "y", ["price", "qty_mw", "hour", "duration_min"], cs, ["duration_min"])
    return path.select("duration_min", "C", "n", "log_lik", "bic", F.get("beta", F.lit(1)).alias("b1"), "converged", "rounds")


@query("m15_lasso_path")
def _m15(spark, sf):
    path = L.lasso_path(matrix(spark, sf), "x0", XS[1:], ["l_returnflag"])
    return path.select("l_returnflag", "step", "lam", "rss", "bic", "n_active", "converged", "rounds")


@query(
    "m15_best_step_fit",
    """SELECT l_returnflag, regr_slope(x1, x0) AS b1, regr_intercept(x1, x0) AS b0 FROM fx_matrix GROUP BY 1""",
    ("fx_matrix",),
    ("b0", "b1"),
    digits=4,
)
def _m15b(spark, sf):
    # One feature and a vanishing penalty: the end of the path is least squares.
    path = L.lasso_path(matrix(spark, sf), "x1", ["x0"], ["l_returnflag"], eps=1e-9)
    end = path.groupBy("l_returnflag").agg(F.max_by("beta", "step").alias("b"))
    return end.select("l_returnflag", F.col("b")[1].alias("b1"), F.col("b")[0].alias("b0"))


@query("m16_one_step_forecast")
def _m16(spark, sf):
    rows, feats = model_rows(spark, sf)
    rows = cut(rows)
    gam = G.fit_gamlss(rows, "vwap_changes", feats, "jsu", 20, 10, 12)
    log = G.fit_trade_logit(rows, feats, 20, 10)
    nb = ["nb_dchg_m1", "nb_dchg_p1"]
    return G.one_step_forecast(rows, gam, log, feats, feats, nb).select(
        "day", "hour", "ttd", "pi_hat", "price_pred", "abs_err", "log_score", "crps", *nb
    )


@query(
    "m17_conditional_moments",
    """SELECT source, timestamp, m AS m1, CASE WHEN v > 2 THEN m * m + s * v / (v - 2) END AS m2,
       CASE WHEN v > 3 THEN m * m * m + 3 * m * s * v / (v - 2) END AS m3,
       CASE WHEN v > 4 THEN m * m * m * m + 6 * m * m * s * v / (v - 2) + s * s * 3 * v * v / ((v - 2) * (v - 4)) END
       AS m4 FROM (SELECT source, timestamp, mu_cond / 73.1 AS m, var_cond / 5343.7 AS s, which_hour_before + 1.5 AS v
       FROM fx_preds) t""",
    ("fx_preds",),
    ("m1", "m2", "m3", "m4"),
    digits=7,
)
def _m17(spark, sf):
    p = V.predictions(spark, sf).select(
        "source", "timestamp", (F.col("mu_cond") / 73.1).alias("mu_cond"),
        (F.col("var_cond") / 5343.7).alias("scale2"), (F.col("which_hour_before") + 1.5).alias("df_cond"),
    )
    return M.conditional_moments(p).select("source", "timestamp", "m1", "m2", "m3", "m4")


@query(
    "s10_params_store",
    _per_horizon(f"""SELECT t.delivery_date AS date, t.delivery_hour AS hour, CAST({{wh}} AS INT) AS which_hour_before,
        CASE WHEN count(r.ts) >= {{p}} + 2 THEN 'ok' ELSE 'failed' END AS status FROM {_TARGETS} GROUP BY 1, 2"""),
    _STUDY_VIEWS,
)
def _s10(spark, sf):
    path = scratch_path(spark, "params")
    fits = _fits(spark, sf, "mardia")
    O.save_params(_all(fit for _, _, fit in fits), path, {"lookback_days": 14})
    keys = _all(
        rows.select(
            F.col("delivery_date").alias("date"), F.col("delivery_hour").alias("hour"), F.col("wh").alias("which_hour_before")
        )
        for _, rows, _ in fits
    )
    return O.get_params(O.load_params(spark, path), keys).select("date", "hour", "which_hour_before", "status")


# --- streams: the events arrive as one file per day ------------------------------------


def _daily_stream(spark, sf, root):
    e = V.table(spark, sf, "events").select(
        "event_id", "ts", "event_type", F.col("value").alias("v"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias("k"), F.to_date("ts").alias("day"),
    )
    e.repartition("day").write.partitionBy("day").parquet(f"{root}/in")
    schema = spark.read.parquet(f"{root}/in").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 10).parquet(f"{root}/in")


VIEW_SQL["fx_stream"] = ((), """SELECT event_type, value AS v, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE)
    AS k FROM events""")


@query(
    "t1_stream_scaler",
    """SELECT event_type, count(*) AS n, avg(v) AS mean_v, var_pop(v) AS var_v, avg(k) AS mean_k, var_pop(k) AS var_k
       FROM fx_stream GROUP BY 1""",
    ("fx_stream",),
    ("mean_v", "var_v", "mean_k", "var_k"),
)
def _t1(spark, sf):
    root = scratch_path(spark, "t1")
    q = S.stream_scaler(
        _daily_stream(spark, sf, root), ["v", "k"], ["event_type"], f"{root}/state", f"{root}/ckpt"
    )
    q.awaitTermination()
    return S.read_scaler(spark, f"{root}/state", ["v", "k"], ["event_type"])


FORGET = 0.02

# Decay by the rows of the key that follow: the closed form of the sequential rule.
VIEW_SQL["fx_faded"] = ((), f"""SELECT *, CASE WHEN after + 1 = rows THEN 1.0 ELSE {FORGET} END * pow({1 - FORGET}, after) AS w,
      pow({1 - FORGET}, after) AS fade
    FROM (
      SELECT event_type, value AS v, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k,
        count(*) OVER (PARTITION BY event_type) AS rows,
        row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) - 1 AS after
      FROM events)""")


def _in_thirds(spark, sf, root, start):
    """The events land in three parts, in the order of time; the stream is stopped and started
    again between them."""
    e = V.table(spark, sf, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", F.col("value").alias("v"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias("k"),
    )
    bounds = e.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    third = F.floor(3 * F.try_divide(
        F.col("ts").cast("double") - bounds.select(F.col("lo").cast("double")).scalar(),
        bounds.select((F.col("hi").cast("double") - F.col("lo").cast("double"))).scalar()))
    e = cut(e.withColumn("third", F.least(F.coalesce(third, F.lit(0)), F.lit(2))))
    for i in range(3):
        e.filter(F.col("third") == i).drop("third").write.mode("append").parquet(f"{root}/in")
        start(spark.readStream.schema(e.drop("third").schema).parquet(f"{root}/in")).awaitTermination()


@query(
    "t1_stream_forgetting",
    """SELECT event_type, count(*) AS n, sum(w * v) AS mean_v, sum(w * v * v) - sum(w * v) ** 2 AS var_v,
         sum(w * k) AS mean_k, sum(w * k * k) - sum(w * k) ** 2 AS var_k
       FROM fx_faded GROUP BY 1""",
    ("fx_faded",),
    ("mean_v", "var_v", "mean_k", "var_k"),
    digits=5,
)
def _t1f(spark, sf):
    root = scratch_path(spark, "t1f")
    _in_thirds(spark, sf, root, lambda s: K.stream_forgetting(s, ["v", "k"], ["event_type"], "ts", f"{root}/ckpt", FORGET, tie="event_id"))
    return K.read_forgetting(spark, f"{root}/ckpt", ["v", "k"], ["event_type"], FORGET)


@query(
    "t2_stream_gram_forgetting",
    """SELECT event_type, count(*) AS n, sum(fade) AS sum_w, sum(fade * v * v) AS yy, sum(fade * k * v) AS xy_0,
       sum(fade * k * k) AS g_0_0 FROM fx_faded GROUP BY 1""",
    ("fx_faded",),
    ("sum_w", "yy", "xy_0", "g_0_0"),
    digits=4,
)
def _t2f(spark, sf):
    root = scratch_path(spark, "t2f")
    day = F.to_date("ts")
    _in_thirds(spark, sf, root, lambda s: S.stream_gram(
        s, ["k"], "v", ["event_type"], f"{root}/state", f"{root}/ckpt", None, FORGET, ["ts", "event_id"], day))
    return S.read_gram(spark, f"{root}/state", 1, ["event_type"], FORGET)


@query(
    "t2_stream_gram",
    """SELECT event_type, count(*) AS n, CAST(count(*) AS DOUBLE) AS sum_w, sum(v * v) AS yy, sum(k * v) AS xy_0,
       sum(k * k) AS g_0_0 FROM fx_stream GROUP BY 1""",
    ("fx_stream",),
    ("sum_w", "yy", "xy_0", "g_0_0"),
    digits=3,
)
def _t2(spark, sf):
    root = scratch_path(spark, "t2")
    q = S.stream_gram(
        _daily_stream(spark, sf, root), ["k"], "v", ["event_type"], f"{root}/state", f"{root}/ckpt"
    )
    q.awaitTermination()
    return S.read_gram(spark, f"{root}/state", 1, ["event_type"])


@query("t3_stream_lasso_refit")
def _t3(spark, sf):
    root = scratch_path(spark, "t3")
    q = S.stream_lasso_refit(
        _daily_stream(spark, sf, root), ["k"], "v", ["event_type"], f"{root}/state", f"{root}/ckpt"
    )
    q.awaitTermination()
    return S.latest_path(spark, f"{root}/state").select("event_type", "step", "lam", "rss", "n_active")
