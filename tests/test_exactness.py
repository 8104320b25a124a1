"""Values far from zero, null keys, missing moments, local clocks."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ampertide import session
from ampertide.functions import numeric as N
from ampertide.models import mvt as M
from ampertide.operators import density as D
from ampertide.operators import ordered as O
from ampertide.operators import stats as S
from ampertide.operators import tape as T
from ampertide.plans import features as P
from ampertide.streaming import incremental as I

LEVEL = 1e9


def test_correlation_far_from_zero(spark):
    rng = np.random.default_rng(1)
    rows = [(i, h, LEVEL + s * float(v)) for i, v in enumerate(rng.choice([-1.0, 1.0], 200)) for h, s in ((0, 1), (1, 1), (2, -1))]
    d = spark.createDataFrame(rows, "k int, h int, v double").repartition(5)
    got = {(r.a, r.b): r.corr for r in S.pairwise_correlation(d, ["k"], "h", "v", [0, 1, 2]).collect()}
    for a in range(3):
        for b in range(3):
            assert got[a, b] == pytest.approx(-1.0 if (a == 2) != (b == 2) else 1.0, abs=1e-9)


@pytest.mark.parametrize("lookback", [1, 14, 365])
def test_rolling_moments_equal_brute_force_and_grow_only(spark, lookback):
    rng = np.random.default_rng(lookback)
    days = np.datetime64("2020-01-01") + np.sort(rng.choice(900, 260, replace=False))
    d = pd.DataFrame({"k": rng.choice(["a", "b", None], 260), "delivery_date": days, "u": 1e9 + rng.normal(size=260), "v": rng.normal(size=260)})
    d = pd.concat([d, d.assign(u=d.u + rng.normal(size=260))], ignore_index=True)
    d.loc[rng.choice(len(d), 30), "v"] = None
    frame = spark.createDataFrame(d.astype({"delivery_date": str}), "k string, delivery_date string, u double, v double")
    frame = frame.withColumn("delivery_date", F.col("delivery_date").cast("date")).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    out = S.rolling_moments(frame, ["u", "v"], lookback, ["k"])
    # No frame slides: every window grows from its start, or looks at one row.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "RangeFrame" not in plan and f"-{lookback + 1}" not in plan
    got = {(r.k, np.datetime64(r.delivery_date)): r for r in out.collect()}
    assert len(got) == len({(a, b) for a, b in zip(d.k, d.delivery_date)})
    for (k, day), r in got.items():
        same = d.k.isna() if k is None else d.k == k
        w = d[same & (d.delivery_date < day) & (d.delivery_date >= day - np.timedelta64(lookback, "D"))].dropna(subset=["u", "v"])
        assert r.n == len(w)
        if len(w):
            assert r.mean_0 == pytest.approx(w.u.mean(), abs=1e-6) and r.mean_1 == pytest.approx(w.v.mean(), abs=1e-12)
        if len(w) > 1:
            c = np.cov(w.u - 1e9, w.v)
            assert np.allclose([r.cov_0_0, r.cov_0_1, r.cov_1_1], [c[0, 0], c[0, 1], c[1, 1]], atol=1e-6)
        else:
            assert r.cov_0_0 is None


def test_rolling_moments_far_from_zero(spark):
    rng = np.random.default_rng(2)
    day = dt.date(2024, 1, 1)
    rows = [(k, day + dt.timedelta(i), LEVEL + float(v)) for k in (1, None) for i in range(12) for v in rng.normal(size=20)]
    d = spark.createDataFrame(rows, "k int, delivery_date date, v double")
    got = S.rolling_moments(d, ["v"], 5, ["k"]).collect()
    assert len(got) == 24
    for r in got:
        part = [v - LEVEL for k, t, v in rows if k == r.k and 0 < (r.delivery_date - t).days <= 5]
        assert r.n == len(part)
        if part:
            assert r.mean_0 - LEVEL == pytest.approx(np.mean(part), abs=1e-6)
            assert r.cov_0_0 == pytest.approx(np.var(part, ddof=1), rel=1e-5)


@pytest.mark.parametrize("forget", [0.0, 0.05])
def test_merged_scaler_far_from_zero(spark, forget):
    rng = np.random.default_rng(3)
    x = LEVEL + rng.normal(size=300)
    parts = None
    for b in range(3):
        pdf = pd.DataFrame({"k": 1, "t": np.arange(100), "x": x[100 * b : 100 * b + 100]})
        part = I.scaler_part(spark.createDataFrame(pdf), ["x"], ["k"], forget, ["t"], F.floor(F.col("t") / 30))
        part = part.withColumn("batch", F.lit(b))
        parts = part if parts is None else parts.unionByName(part)
    r = I.merge_scaler(parts, ["x"], ["k"], forget).head()
    if forget == 0:
        mean, var = x.mean(), x.var()
    else:
        w = np.r_[(1 - forget) ** 299, forget * (1 - forget) ** np.arange(298, -1, -1)]
        w[0] += 0.0
        full = forget * (1 - forget) ** np.arange(299, -1, -1)
        full[0] += (1 - forget) ** 300
        mean = LEVEL + (full * (x - LEVEL)).sum()
        var = (full * (x - mean) ** 2).sum()
    assert r.n == 300
    assert r.mean_x - LEVEL == pytest.approx(mean - LEVEL, abs=1e-6)
    assert r.var_x == pytest.approx(var, rel=1e-5)


def test_null_stays_null_in_links_and_scores(spark):
    d = spark.createDataFrame([(None,)], "x double")
    x = F.col("x")
    cols = [f(n, x) for n in ("identity", "log", "logident", "softplus") for f in (N.link, N.link_inverse)]
    cols += [N.zero_inflated_log_score(F.lit(1.0), F.lit(0.5), x), N.zero_inflated_log_score(x, F.lit(0.5), F.lit(1.0))]
    cols += list(N.jsu_native(x, x, x, x).values())
    assert all(v is None for v in d.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).head())


def test_no_variance_at_few_degrees_of_freedom(spark):
    p = [(dt.date(2024, 1, 1), 1, 1, "ecm", True, 0.5, [0.0, 0.0], [[1.0, 0.3], [0.3, 1.0]], [0.0, 0.0], [1.0, 1.0])]
    params = spark.createDataFrame(
        p, "date date, hour int, which_hour_before int, method string, calibration_ok boolean, df double, mu_scaled array<double>, "
        "Sigma_scaled array<array<double>>, scaler_mean array<double>, scaler_scale array<double>",
    )
    rows = spark.createDataFrame([(dt.date(2024, 1, 1), 1, 1, dt.datetime(2024, 1, 1), 0.4, 0.2)],
                                 "delivery_date date, delivery_hour int, wh int, ts timestamp_ntz, y double, a double")
    pred = M.predict_mvt(rows, params, ["y", "a"])
    r = pred.head()
    assert r.var_cond is None and r.scale2 == pytest.approx((0.5 + 0.04) / 1.5 * (1 - 0.09))
    s = M.score_density(pred).head()
    assert np.isfinite(s.log_score) and np.isfinite(s.crps) and s.log_score > 0


def test_null_keys_and_orders_are_kept(spark):
    rows = [("a", 1.0, 1), (None, 2.0, 2), (None, 3.0, 3), ("a", None, 4)]
    d = spark.createDataFrame(rows, "k string, o double, v int")
    got = O.running_total(d, ["k"], ["o"], ["v"], F.floor("o")).collect()
    assert sorted((str(r.k), r.v, r.cum_v, r.tot_v) for r in got) == [("None", 2, 2, 5), ("None", 3, 5, 5), ("a", 1, 5, 5), ("a", 4, 4, 5)]
    near = O.nearest_known(d, ["k"], "o", "v", F.floor("o")).collect()
    assert len(near) == 4


def test_local_clock_of_hours_years_and_volumes(spark):
    # 02:00 and 04:00 in Amsterdam on a summer day are 00:00 and 02:00 UTC.
    at = [dt.datetime(2021, 7, 1, 0), dt.datetime(2021, 7, 1, 2), dt.datetime(2020, 12, 31, 23), dt.datetime(2021, 12, 31, 23)]
    d = spark.createDataFrame([(t, t + dt.timedelta(hours=1), 1.0) for t in at], "delivery_start timestamp_ntz, delivery_end timestamp_ntz, qty_mw double")
    zone = "Europe/Amsterdam"
    left = [r[0] for r in T.drop_hours(d, [2], zone=zone).select("delivery_start").collect()]
    assert left == at[1:]
    assert [r[0] for r in T.of_year(d, 2021, zone=zone).select("delivery_start").collect()] == at[:3]
    vol = {r.delivery_hour: r.hourly for r in T.volume_by_hour(T.with_duration(d), zone=zone).collect()}
    assert vol == {2: 1.0, 4: 1.0, 0: 2.0}


def test_year_reaches_the_scan(spark):
    path = session.scratch_path(spark, "tape")
    t = [dt.datetime(2020 + i, 6, 1, 12) for i in range(3)]
    spark.createDataFrame(
        [(i, x - dt.timedelta(hours=1), x, x + dt.timedelta(hours=1), 1.0, 1.0) for i, x in enumerate(t)],
        "trade_id long, exec_ts timestamp_ntz, delivery_start timestamp_ntz, delivery_end timestamp_ntz, price double, qty_mw double",
    ).write.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    clean = P.clean_trades(spark.read.parquet(path), P.FeatureConfig(year=2021, dropped_hours=(3,)))
    plan = clean._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: ")[1].split("]")[0]
    assert "GreaterThanOrEqual(delivery_start,2020-12-31T23:00)" in pushed and "LessThan(delivery_start,2021-12-31T23:00)" in pushed
    assert [r.trade_id for r in clean.collect()] == [1]


def test_large_grids_run_in_bounded_chunks(spark):
    x = np.random.default_rng(5).normal(size=3000)
    d = spark.createDataFrame(pd.DataFrame({"x": x})).repartition(2)
    k = 70_000
    got = D.ecf_grid(d, ["x"], [-5.0], [5.0], k).filter("k1 IN (0, 7, 69999)").collect()
    assert len(got) == 3
    for r in got:
        want = np.exp(1j * x * r.k1 * np.pi / 10).mean()
        assert r.re == pytest.approx(want.real, abs=1e-9) and r.im == pytest.approx(want.imag, abs=1e-9)


def test_keyless_forms_make_no_product(spark):
    d = spark.createDataFrame(pd.DataFrame(np.random.default_rng(6).normal(size=(50, 2)), columns=["a", "b"]))
    out = S.mardia_nu(d, ["a", "b"])
    assert "CartesianProduct" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 1


def test_shared_folder_is_needed_off_a_local_master():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default):
            return default

    class Spark:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="checkpoint"):
        session.ensure_checkpoint_dir(Spark())


def test_csv_features_come_back_typed_and_pruned(spark):
    from ampertide.sources import sinks

    path = session.scratch_path(spark, "features-csv")
    rows = [(dt.date(y, 5, 1), y % 24, 1.5 * y, None) for y in (2020, 2021, 2022)]
    d = spark.createDataFrame(rows, "delivery_date date, delivery_hour int, v double, note string")
    sinks.write_features(d, path, "csv")
    got = sinks.read_features(spark, path, [2021], "csv")
    assert dict(got.dtypes) == {"delivery_date": "date", "delivery_hour": "int", "v": "double", "note": "string", "year": "int"}
    assert [tuple(r)[:3] for r in got.collect()] == [rows[1][:3]]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "year" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_study_starts_after_the_lookback(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(10)]
    d = spark.createDataFrame([(x,) for x in days], "delivery_date date")
    assert M.effective_start(d, M.StudyConfig(lookback_days=4)) == days[4]
    assert M.effective_start(d, M.StudyConfig(lookback_days=4, first_day="2024-01-08")) == days[7]
    with pytest.raises(ValueError, match="no target day"):
        M.effective_start(d, M.StudyConfig(lookback_days=40))


def test_error_levels_in_one_scan_keep_null_keys_apart(spark):
    from ampertide.operators import reports as R

    rows = [("m", 1, 1, 1.0), ("m", None, 1, 3.0), ("m", None, None, 5.0), ("q", 2, 4, 2.0)]
    d = spark.createDataFrame(rows, "source string, hour int, which_hour_before int, abs_error double")
    d = d.withColumn("sq_error", F.col("abs_error") ** 2)
    levels = {"hour": ["source", "hour"], "horizon": ["source", "which_hour_before"], "model": ["source"], "all": []}
    out = R.error_levels(d, levels)
    got = {(r.level, r.source, r.hour, r.which_hour_before): (r.n, r.MAE) for r in out.collect()}
    assert got == {
        ("hour", "m", 1, None): (1, 1.0), ("hour", "m", None, None): (2, 4.0), ("hour", "q", 2, None): (1, 2.0),
        ("horizon", "m", None, 1): (2, 2.0), ("horizon", "m", None, None): (1, 5.0), ("horizon", "q", None, 4): (1, 2.0),
        ("model", "m", None, None): (3, 3.0), ("model", "q", None, None): (1, 2.0), ("all", None, None, None): (4, 2.75),
    }
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    with pytest.raises(ValueError):
        R.error_levels(d, {"a": ["source"], "b": ["source"]})


def test_lag_designs_are_one_run_of_deliveries():
    from ampertide.operators.panel import LagDesign

    design = LagDesign()
    assert design.columns(1) == {0: [0, 1, 2, 3], 1: [1], 2: [1], 3: [1], 4: [1]}
    assert design.columns(2) == {-1: [1], 0: [0, 1, 2, 3], 1: [1], 2: [1], 3: [1]}
    assert design.columns(4) == {-2: [1], -1: [1], 0: [0, 1, 2, 3], 1: [1], 2: [1]}
    assert LagDesign(own=0, run=1, ahead=2, steps=(3, 1, 3)).columns(9) == {-2: [1, 3], -1: [1, 3], 0: [0]}
    for steps in ((), (0, 1)):
        with pytest.raises(ValueError):
            LagDesign(steps=steps)
