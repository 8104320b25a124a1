import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ampertide.operators import features as X
from ampertide.operators import ordered as O
from ampertide.operators import tape as T
from ampertide.operators.interp import interp


@pytest.mark.parametrize("width", [None, 0.5, 7.0])
@pytest.mark.parametrize("outside", ["clamp", "zero"])
def test_interp_equals_numpy(spark, width, outside):
    rng = np.random.default_rng(1)
    rows, asks, want = [], [], {}
    for k in range(3):
        n = 400 if k == 0 else 5
        x = np.unique(np.round(rng.uniform(-50, 50, n), 2))
        y = np.cumsum(rng.uniform(0, 3, len(x)))
        q = np.unique(np.concatenate([rng.uniform(-60, 60, 80), x[:4], [x[0] - 1, x[-1] + 1]]))
        rows += [(k, float(a), float(b)) for a, b in zip(x, y)]
        asks += [(k, float(a)) for a in q]
        edge = {"left": 0.0, "right": 0.0} if outside == "zero" else {}
        want.update({(k, float(a)): b for a, b in zip(q, np.interp(q, x, y, **edge))})
    # Repeated knots keep the highest value, repeated queries one answer.
    rows += [(r[0], r[1], r[2] - 1) for r in rows[:50]]
    asks += asks[:50]
    got = interp(
        spark.createDataFrame(asks + [(9, 1.0)], "k int, x double"),
        spark.createDataFrame(rows, "k int, x double, y double"), ["k"], outside=outside, cell_width=width,
    ).collect()
    got = {(r.k, r.x): r.y for r in got}
    assert got.pop((9, 1.0)) is None
    assert got.keys() == want.keys()
    assert max(abs(got[i] - want[i]) for i in want) < 1e-9


def test_running_totals_and_lags_over_one_hot_key(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"t": np.arange(3000), "v": rng.normal(size=3000).round(3)})
    pdf["k"] = np.where(pdf.t % 5 == 0, 1, 0)
    d = spark.createDataFrame(pdf)
    got = O.running_total(d, ["k"], ["t"], ["v"], F.floor(F.col("t") / 70)).toPandas().sort_values("t")
    assert np.allclose(got.cum_v.to_numpy(), pdf.groupby("k").v.cumsum().to_numpy())
    lag = X.response_lags(d, "v", 3, ["t"], F.floor(F.col("t") / 70), block=100).toPandas().sort_values("t")
    assert len(lag) == 2997
    assert np.allclose(lag.v_lag3.to_numpy(), pdf.v.shift(3).dropna().to_numpy())


def test_dedupe_keeps_the_first_of_many_copies(spark):
    d = spark.range(5000).select(
        (F.col("id") % 7 * (F.col("id") % 3).cast("int")).alias("k"), F.col("id").alias("t"), (-F.col("id")).alias("v")
    )
    got = {r.k: r.t for r in T.dedupe(d, ["k"], [F.col("t")]).collect()}
    want = d.toPandas().groupby("k").t.min().to_dict()
    assert got == want


def test_lags_do_not_cross_contracts(spark):
    d = spark.createDataFrame(
        [("2024-01-01", h, b, float(10 * h + b)) for h in range(3) for b in range(4)],
        "delivery_date string, delivery_hour int, bin int, vwap double",
    )
    got = X.add_lags(d, {"vwap": [1]})
    assert got.columns == ["delivery_date", "delivery_hour", "bin", "vwap", "vwap_lag1"]
    assert got.filter("bin = 0 AND vwap_lag1 IS NOT NULL").count() == 0
    assert got.filter("bin > 0 AND vwap_lag1 <> vwap - 1").count() == 0
