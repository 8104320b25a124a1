"""Report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import reports as R
from ..operators import stats as S
from . import views as V
from .registry import query
from .views import VIEW_SQL

VIEW_SQL["fx_scored"] = (("fx_preds",), """SELECT CASE WHEN source IN ('view', 'click') THEN 'MVT ' || source
    ELSE source END AS source, hour, which_hour_before, timestamp, 'normal' AS method,
    abs(y_true - mu_cond) AS abs_error, (y_true - mu_cond) * (y_true - mu_cond) AS sq_error,
    0.5 * (ln(2 * pi()) + ln(var_cond + 1) + (y_true - mu_cond) ** 2 / (var_cond + 1)) AS log_score,
    abs(y_true - mu_cond) / 3 AS crps FROM fx_preds""")


def scored(spark, sf):
    p = V.predictions(spark, sf)
    errs = N.forecast_errors(F.col("y_true"), F.col("mu_cond"))
    label = F.when(
        F.col("source").isin("view", "click"), F.concat(F.lit("MVT "), F.col("source"))
    ).otherwise(F.col("source"))
    return p.select(
        label.alias("source"), "hour", "which_hour_before", "timestamp", F.lit("normal").alias("method"),
        errs["abs_error"].alias("abs_error"), errs["sq_error"].alias("sq_error"),
        N.gaussian_log_score(F.col("y_true"), F.col("mu_cond"), F.col("var_cond") + 1).alias("log_score"),
        (errs["abs_error"] / 3).alias("crps"),
    )


@query(
    "p12_normalize_mvt",
    """SELECT source, hour, which_hour_before, abs_error, sq_error, log_score, crps FROM fx_scored""",
    ("fx_scored",),
    ("abs_error", "sq_error", "log_score", "crps"),
)
def _p12m(spark, sf):
    d = scored(spark, sf)
    text = d.withColumn("hour", F.col("hour").cast("string")).withColumn(
        "abs_error", F.col("abs_error").cast("string")
    )
    return R.normalize_predictions(text)


@query(
    "p12_normalize_zero_inflated",
    """SELECT 'zi' AS source, least(hour, 23) AS hour, CAST(least(greatest(ceil(ttd / 4.0), 1), 4) AS INT)
       AS which_hour_before, abs_error, sq_error, -log_score AS log_score, CAST(NULL AS DOUBLE) AS crps
       FROM (SELECT *, extract(minute FROM timestamp) - 10 AS ttd FROM fx_scored) t""",
    ("fx_scored",),
    ("abs_error", "sq_error", "log_score", "crps"),
)
def _p12z(spark, sf):
    d = scored(spark, sf).select(
        "hour", (F.minute("timestamp") - 10).alias("ttd"), F.col("abs_error").alias("abs_err"),
        F.col("sq_error").alias("sq_err"), "log_score",
    )
    return R.normalize_predictions(d, "zi")


@query(
    "a11_error_by_hour",
    "SELECT source, hour, avg(abs_error) AS \"MAE\", sqrt(avg(sq_error)) AS \"RMSE\" FROM fx_scored GROUP BY 1, 2",
    ("fx_scored",),
    ("MAE", "RMSE"),
)
def _a11h(spark, sf):
    return R.error_by(R.normalize_predictions(scored(spark, sf)), ["source", "hour"])


@query(
    "a11_error_by_horizon",
    """SELECT source, which_hour_before, avg(abs_error) AS "MAE", sqrt(avg(sq_error)) AS "RMSE" FROM fx_scored
       GROUP BY 1, 2""",
    ("fx_scored",),
    ("MAE", "RMSE"),
)
def _a11w(spark, sf):
    return R.error_by(R.normalize_predictions(scored(spark, sf)), ["source", "which_hour_before"])


@query(
    "a11_error_levels",
    """SELECT CASE grouping_id(source, hour, which_hour_before) WHEN 1 THEN 'hour' WHEN 2 THEN 'horizon'
         WHEN 0 THEN 'cell' ELSE 'model' END AS level, source, hour, which_hour_before, count(*) AS n,
         avg(abs_error) AS "MAE", sqrt(avg(sq_error)) AS "RMSE"
       FROM (SELECT source, CAST(hour AS INT) AS hour, CAST(which_hour_before AS INT) AS which_hour_before,
         abs_error / 7.31 AS abs_error, sq_error / 7.31 AS sq_error FROM fx_scored)
       GROUP BY GROUPING SETS ((source, hour), (source, which_hour_before), (source, hour, which_hour_before), (source))""",
    ("fx_scored",),
    ("MAE", "RMSE"),
)
def _a11l(spark, sf):
    levels = {
        "hour": ["source", "hour"], "horizon": ["source", "which_hour_before"], "cell": ["source", "hour", "which_hour_before"],
        "model": ["source"],
    }
    # Divided, so that no mean ends on a rounding tie.
    d = R.normalize_predictions(scored(spark, sf)).withColumns({c: F.col(c) / 7.31 for c in ("abs_error", "sq_error")})
    return R.error_levels(d, levels)


@query(
    "a12_summary_table",
    """SELECT source, avg(abs_error) AS "MAE", sqrt(avg(sq_error)) AS "RMSE", avg(log_score) AS "LogScore",
       avg(crps) AS "CRPS" FROM fx_scored GROUP BY 1 ORDER BY NOT starts_with(source, 'MVT'), source""",
    ("fx_scored",),
    ("MAE", "RMSE", "LogScore", "CRPS"),
)
def _a12(spark, sf):
    return R.summary_table(R.normalize_predictions(scored(spark, sf)))


@query(
    "a13_summarize",
    """SELECT which_hour_before, hour, method, count(*) AS n, avg(abs_error) AS "MAE", sqrt(avg(sq_error)) AS "RMSE",
       avg(log_score) AS log_score, avg(crps) AS crps FROM fx_scored GROUP BY 1, 2, 3""",
    ("fx_scored",),
    ("MAE", "RMSE", "log_score", "crps"),
)
def _a13(spark, sf):
    return R.summarize(scored(spark, sf))


@query(
    "a14_complete_axis",
    """SELECT s.source, CAST(h AS INT) AS hour, e.mae AS "MAE", e.rmse AS "RMSE" FROM
       (SELECT DISTINCT source FROM fx_scored) s CROSS JOIN (SELECT unnest(range(24)) AS h) a LEFT JOIN
       (SELECT source, hour, avg(abs_error) AS mae, sqrt(avg(sq_error)) AS rmse FROM fx_scored
        GROUP BY 1, 2) e ON e.source = s.source AND e.hour = h""",
    ("fx_scored",),
    ("MAE", "RMSE"),
)
def _a14(spark, sf):
    n = R.normalize_predictions(scored(spark, sf))
    near = R.error_by(n, ["source", "hour"])
    axis = R.complete_axis(n.select("source", "hour").distinct(), "hour", list(range(24)), ["source"])
    return axis.join(near, ["source", "hour"], "left")


@query(
    "a15_describe_scores",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS metric, count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min,
        quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.75) AS p75,
        max({c}) AS max FROM fx_scored"""
        for c in ("abs_error", "log_score")
    ),
    ("fx_scored",),
    ("mean", "std", "min", "p25", "p50", "p75", "max"),
)
def _a15(spark, sf):
    return S.describe_scores(scored(spark, sf), ["abs_error", "log_score"])


@query(
    "a23_select_bic",
    """SELECT source, arg_min(hour, bic) AS hour, min(bic) AS bic FROM (SELECT source, hour,
       count(*) * ln(avg(sq_error)) + ln(count(*)) * hour AS bic FROM fx_scored GROUP BY 1, 2) t GROUP BY 1""",
    ("fx_scored",),
    ("bic",),
)
def _a23(spark, sf):
    n = F.count(F.lit(1)).cast("double")
    path = scored(spark, sf).groupBy("source", "hour").agg(
        (n * F.log(F.avg("sq_error")) + F.log(n) * F.col("hour")).alias("bic")
    )
    return S.select_best(path, ["source"], "bic", ["hour"])


@query(
    "o2_model_order",
    """SELECT source, row_number() OVER (ORDER BY NOT starts_with(source, 'MVT'), source) AS position
       FROM (SELECT DISTINCT source FROM fx_scored) t""",
    ("fx_scored",),
)
def _o2(spark, sf):
    from pyspark.sql import Window as W

    # One row per model source.
    d = scored(spark, sf).select("source").distinct()
    return d.select("source", F.row_number().over(W.orderBy(*R.model_order())).cast("long").alias("position"))


@query(
    "o3_first_per_key",
    """SELECT source, hour, timestamp, abs_error FROM (SELECT *, row_number() OVER (PARTITION BY source, hour
       ORDER BY abs_error, timestamp) AS rn FROM fx_scored) t WHERE rn = 1""",
    ("fx_scored",),
    ("abs_error",),
)
def _o3(spark, sf):
    from ..operators.ordered import first_per

    d = scored(spark, sf).select("source", "hour", "timestamp", "abs_error")
    return first_per(d, ["source", "hour"], [F.col("abs_error"), F.col("timestamp")])
