"""Lag panel, horizon window and trailing-moment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import panel as P
from ..operators import stats as S
from . import views as V
from .registry import query
from .views import VIEW_SQL

DESIGN = {0: [0, 1, 2], -1: [1], 1: [1]}
NAMES = P.feature_names("x", DESIGN)

VIEW_SQL["fx_panel"] = (("fx_bins",), """SELECT delivery_date, delivery_hour, bin_timestamp AS ts, vwap AS x
    FROM fx_bins WHERE vwap IS NOT NULL""")


def panel(spark, sf):
    return (
        V.bins(spark, sf)
        .filter(F.col("vwap").isNotNull())
        .select("delivery_date", "delivery_hour", F.col("bin_timestamp").alias("ts"), F.col("vwap").alias("x"))
    )


def _lag_sql(how: str) -> str:
    cols, joins = [], []
    for o, ks in sorted(DESIGN.items()):
        for k in ks:
            if (o, k) == (0, 0):
                continue
            n = P.lag_name("x", o, k)
            a = f"t_{n}"
            cols.append(f"{a}.x AS {n}")
            joins.append(
                f"{how} JOIN fx_panel {a} ON {a}.ts = b.ts - to_minutes({15 * k}) "
                f"AND {a}.delivery_hour = (b.delivery_hour + {o} + 24) % 24"
            )
    return (
        "SELECT b.delivery_date, b.delivery_hour, b.ts, b.x, "
        + ", ".join(cols) + " FROM fx_panel b " + " ".join(joins)
    )


@query("j5_lag_join", _lag_sql("INNER"), ("fx_panel",), ("x", *NAMES[1:]))
def _j5(spark, sf):
    return P.lag_join(panel(spark, sf), "x", "x", DESIGN)


@query("j6_lag_panel_time", _lag_sql("LEFT"), ("fx_panel",), ("x", *NAMES[1:]))
def _j6t(spark, sf):
    return P.lag_panel(panel(spark, sf), "x", "x", DESIGN)


def _row_sql() -> str:
    cols, joins = [], []
    for o, ks in sorted(DESIGN.items()):
        for k in ks:
            if (o, k) == (0, 0):
                continue
            n = P.lag_name("x", o, k)
            cols.append(f"r{o + 1}.x{k} AS {n}")
        joins.append(
            f"LEFT JOIN r r{o + 1} ON r{o + 1}.ts = b.ts AND r{o + 1}.delivery_hour = (b.delivery_hour + {o} + 24) % 24"
        )
    return (
        """WITH r AS (SELECT ts, delivery_hour, lag(x, 1) OVER w AS x1, lag(x, 2) OVER w AS x2 FROM fx_panel
        WINDOW w AS (PARTITION BY delivery_hour ORDER BY ts))
        SELECT b.delivery_date, b.delivery_hour, b.ts, b.x, """
        + ", ".join(cols) + " FROM fx_panel b " + " ".join(joins)
    )


@query("j6_lag_panel_rows", _row_sql(), ("fx_panel",), ("x", *NAMES[1:]))
def _j6r(spark, sf):
    return P.lag_panel(panel(spark, sf), "x", "x", DESIGN, mode="rows")


@query(
    "j7_delivery_day",
    """SELECT e.event_id, e.ts, e.delivery_hour, d.delivery_date FROM (SELECT event_id,
       date_trunc('hour', ts) AS ts, CAST(event_id % 24 AS INT) AS delivery_hour FROM events) e LEFT JOIN (
       SELECT date_trunc('hour', ts) AS ts, CAST(event_id % 24 AS INT) AS delivery_hour,
       min(CAST(ts AS DATE) + CAST(user_id % 3 AS INT)) AS delivery_date FROM events GROUP BY 1, 2) d
       ON d.ts = e.ts AND d.delivery_hour = e.delivery_hour""",
)
def _j7(spark, sf):
    from ..functions.clock import trunc_hour

    e = V.table(spark, sf, "events").select(
        "event_id",
        trunc_hour(F.col("ts")).alias("ts"),
        (F.col("event_id") % 24).cast("int").alias("delivery_hour"),
        F.date_add(F.to_date("ts"), (F.col("user_id") % 3).cast("int")).alias("delivery_date"),
    )
    days = e.select("ts", "delivery_hour", "delivery_date")
    return P.with_delivery_day(e.drop("delivery_date"), days)


_WINDOW = """SELECT delivery_date, delivery_hour, CAST(wh AS INT) AS wh, ts, x FROM fx_panel,
    (SELECT unnest([4, 3, 2, 1]) AS wh) h
    WHERE ts >= CAST(delivery_date AS TIMESTAMP) + to_hours(delivery_hour) - to_hours(CAST(wh AS INT))
    AND ts < CAST(delivery_date AS TIMESTAMP) + to_hours(delivery_hour) - to_hours(CAST(wh AS INT)) + INTERVAL 60 MINUTE"""
VIEW_SQL["fx_window"] = (("fx_panel",), _WINDOW)


@query("p6_horizon_window", "SELECT * FROM fx_window", ("fx_window",), ("x",))
def _p6(spark, sf):
    return P.horizon_window(panel(spark, sf)).select("delivery_date", "delivery_hour", "wh", "ts", "x")


@query(
    "p7_prefilter",
    """SELECT event_id, ts, value FROM events WHERE ts >= TIMESTAMP '2024-01-07' AND ts < TIMESTAMP '2024-01-16'""",
)
def _p7(spark, sf):
    e = V.table(spark, sf, "events")
    return P.prefilter(e, ["event_id", "ts", "value"], "2024-01-10", "2024-01-15", 2)


VIEW_SQL["fx_lagged"] = (("fx_panel",), _lag_sql("INNER"))
VIEW_SQL["fx_mvt"] = (("fx_window", "fx_lagged"), f"""SELECT w.delivery_date, w.delivery_hour, w.wh, w.ts,
    w.x AS {NAMES[0]}, {", ".join("l." + n for n in NAMES[1:])} FROM fx_window w JOIN fx_lagged l
    ON l.ts = w.ts AND l.delivery_hour = w.delivery_hour""")


def mvt_rows(spark, sf):
    return P.mvt_features(panel(spark, sf), "x", "x", DESIGN)


@query("m3_mvt_features", "SELECT * FROM fx_mvt", ("fx_mvt",), tuple(NAMES))
def _m3(spark, sf):
    return mvt_rows(spark, sf)


@query(
    "m4_trailing_groups",
    """SELECT delivery_hour, wh, CAST(b AS BIGINT) AS block, count(*) AS n, min(delivery_date) AS first_day,
       max(delivery_date) AS last_day FROM (SELECT *, unnest(range(CAST(floor(d / 5.0) AS INT),
       CAST(floor((d + 10) / 5.0) AS INT) + 1)) AS b FROM (SELECT *, delivery_date - DATE '1970-01-01' AS d
       FROM fx_window) t) u GROUP BY 1, 2, 3""",
    ("fx_window",),
)
def _m4(spark, sf):
    rows = P.trailing_groups(P.horizon_window(panel(spark, sf)), 10, 5)
    return rows.groupBy("delivery_hour", "wh", "block").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("delivery_date").alias("first_day"),
        F.max("delivery_date").alias("last_day"),
    )


_PAIRS = [(i, j) for i in range(3) for j in range(i, 3)]


@query(
    "a19_rolling_moments",
    f"""SELECT t.delivery_hour, t.wh, t.delivery_date, count(r.ts) AS n,
        {", ".join(f"avg(r.{NAMES[i]} / 7.31) AS mean_{i}" for i in range(3))},
        {", ".join(f"covar_samp(r.{NAMES[j]} / 7.31, r.{NAMES[i]} / 7.31) AS cov_{i}_{j}" for i, j in _PAIRS)}
        FROM (SELECT DISTINCT delivery_hour, wh, delivery_date FROM fx_mvt) t LEFT JOIN fx_mvt r
        ON r.delivery_hour = t.delivery_hour AND r.wh = t.wh AND r.delivery_date BETWEEN t.delivery_date - 10
        AND t.delivery_date - 1 GROUP BY 1, 2, 3""",
    ("fx_mvt",),
    tuple([f"mean_{i}" for i in range(3)] + [f"cov_{i}_{j}" for i, j in _PAIRS]),
)
def _a19(spark, sf):
    d = mvt_rows(spark, sf).withColumns({n: F.col(n) / 7.31 for n in NAMES[:3]})
    return S.rolling_moments(d, NAMES[:3], 10, ["delivery_hour", "wh"])
