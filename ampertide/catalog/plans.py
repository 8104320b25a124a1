"""Whole-plan queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.features import FeatureConfig, prepare_features
from ..plans.zero_inflated import ZeroInflatedConfig, run_zero_inflated
from . import views as V
from .registry import query


def _features(spark, sf):
    curves = V.curves(spark, sf).select(
        # The item curves spread over the bin calendar: one curve per hour label.
        F.make_date(F.lit(2024), F.lit(1), 1 + F.year("curve_date") % 28).alias("curve_date"),
        F.col("curve_hour").alias("curve_hour"), "side", "price", "volume",
    )
    return prepare_features(
        spark, V.trades(spark, sf), V.day_ahead(spark, sf), curves, V.forecasts(spark, sf),
        FeatureConfig(zone=None, curve_points=500),
    )


@query("plan_prepare_features")
def _pf(spark, sf):
    return _features(spark, sf).drop("delivery_start", "bin_timestamp_real")


@query("plan_zero_inflated")
def _pz(spark, sf):
    cfg = ZeroInflatedConfig(window=20, block_days=10, min_rows=12)
    return run_zero_inflated(_features(spark, sf), cfg)[1]
