import datetime as dt

import pytest
from pyspark.sql import functions as F

from ampertide.catalog.models import _fits
from ampertide.models import mvt as M
from ampertide.session import cut
from ampertide.sources import buckets as B
from ampertide.sources import sinks as O

SF = "/root/testdata/sf0.01"
KEYS = list(B.STUDY_KEYS)


@pytest.fixture
def no_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def study(spark, folder, params_buckets=4):
    names, rows, fit = _fits(spark, SF, "mardia")[-1]
    rows, fit = cut(rows), cut(fit)
    B.store_panel(rows, f"{folder}/panel", 4)
    B.store_params(M.conditional_params(fit), f"{folder}/ready", params_buckets)
    B.store_params(fit, f"{folder}/fits", params_buckets)
    return names, rows, fit


def test_predictions_from_stored_tables_move_no_rows(spark, tmp_path, no_broadcast):
    names, rows, fit = study(spark, str(tmp_path))
    panel, ready = (B.open_bucketed(spark, f"{tmp_path}/{n}") for n in ("panel", "ready"))
    got, want = M.predict_mvt(panel, ready, names), M.predict_mvt(rows, fit, names)
    assert "Exchange" not in plan(got) and "Exchange" in plan(want)
    cols = ["timestamp", *KEYS, "mu_cond", "var_cond"]
    assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, want.select(*cols).collect()))
    assert got.count() > 0


def test_status_of_keys_moves_no_rows(spark, tmp_path, no_broadcast):
    _, rows, fit = study(spark, str(tmp_path))
    panel, fits = (B.open_bucketed(spark, f"{tmp_path}/{n}") for n in ("panel", "fits"))
    got = O.get_params(fits, panel)
    assert "Exchange" not in plan(got)
    keys = rows.withColumnsRenamed({"delivery_date": "date", "delivery_hour": "hour", "wh": "which_hour_before"})
    want = O.get_params(fit, keys)
    cols = [*KEYS, "status"]
    assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, want.select(*cols).collect()))
    assert {"ok", "failed"} <= {r.status for r in got.collect()}


def test_unequal_bucket_numbers_still_give_the_rows(spark, tmp_path, no_broadcast):
    names, rows, fit = study(spark, str(tmp_path), 3)
    panel, ready = (B.open_bucketed(spark, f"{tmp_path}/{n}") for n in ("panel", "ready"))
    assert M.predict_mvt(panel, ready, names).count() == M.predict_mvt(rows, fit, names).count() > 0


def test_null_keys_empty_tables_odd_names_and_missing_keys(spark, tmp_path):
    day = dt.date(2024, 1, 1)
    df = spark.createDataFrame([(day, 1, 2, "a"), (None, None, None, "b"), (None, None, None, "b")], "date date, hour int, which_hour_before int, `a b-c` string")
    at = str(tmp_path / "it's")
    B.write_bucketed(df, at, buckets=3)
    got = B.open_bucketed(spark, at)
    assert got.columns == df.columns and sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
    empty = str(tmp_path / "empty")
    B.write_bucketed(df.limit(0), empty, buckets=3)
    assert B.open_bucketed(spark, empty).schema == df.schema and B.open_bucketed(spark, empty).count() == 0
    with pytest.raises(ValueError, match="hour"):
        B.write_bucketed(df.drop("hour"), str(tmp_path / "x"))


def test_one_key_filter_reads_one_bucket(spark, tmp_path):
    df = spark.range(1000).select(F.lit(dt.date(2024, 1, 1)).alias("date"), F.col("id").cast("int").alias("hour"), F.lit(1).alias("which_hour_before"))
    B.write_bucketed(df, str(tmp_path / "t"), ("hour",), 8)
    auto = "spark.sql.sources.bucketing.autoBucketedScan.enabled"  # otherwise the plan does not say
    spark.conf.set(auto, "false")
    got = B.open_bucketed(spark, str(tmp_path / "t")).filter("hour = 5")
    assert "SelectedBucketsCount: 1 out of 8" in plan(got) and got.count() == 1
    spark.conf.unset(auto)
