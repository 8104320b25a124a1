"""Rolling zero-inflated study: features to one-step forecasts and their summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..models import gamlss as G
from ..operators import features as X
from ..operators import reports as R
from ..session import cut

# The feature lists of the two models.
GAMLSS_FEATURES = [
    "vwap_changes_lag1", "vwap_changes_lag2", "vwap_changes_lag3",
    "abs_vwap_changes_lag1", "abs_vwap_changes_lag2", "abs_vwap_changes_lag3",
    "abs_vwap_changes_lag4", "abs_vwap_changes_lag5_8",
    "alpha_lag1", "alpha_lag2", "f_TTD", "MON", "SAT", "SUN",
    "mo_slope_500", "mo_slope_1000", "mo_slope_2000", "wind_forecast", "solar_forecast", "da-id",
]
LOGIT_FEATURES = [
    "vwap_changes_lag1", "vwap_changes_lag2", "vwap_changes_lag3",
    "abs_vwap_changes_lag1", "abs_vwap_changes_lag2", "abs_vwap_changes_lag3",
    "abs_vwap_changes_lag4", "abs_vwap_changes_lag5_8",
    "alpha_lag1", "alpha_lag2", "alpha_lag3", "alpha_lag4", "alpha_lag5", "alpha_lag6",
    "alpha_lag7", "alpha_lag8", "MON", "SAT", "SUN",
    "mo_slope_500", "mo_slope_1000", "mo_slope_2000", "wind_forecast", "solar_forecast", "da-id",
]
NEIGHBORS = ["nb_dchg_m2", "nb_dchg_m1", "nb_dchg_p1", "nb_dchg_p2"]


@dataclass
class ZeroInflatedConfig:
    window: int = 365
    block_days: int = 30
    ttd_max: int = 16
    dist: str = "jsu"
    penalty: str = "none"
    min_rows: int = 5
    nodes: int = 200


def design_rows(features: DataFrame, cfg: ZeroInflatedConfig) -> tuple[DataFrame, list[str], list[str]]:
    """Rows of the last ttd_max bins with neighbour features, all finite."""
    d = features.withColumn("ttd", F.floor("TTD_bins").cast("int"))
    d = X.lag_sum(d, "abs_vwap_changes", 5, 8)
    d = X.neighbor_features(d, ttd_max=cfg.ttd_max)
    hot = [f"TTD_bin_{k}" for k in range(1, cfg.ttd_max + 1)]
    xs, logit = GAMLSS_FEATURES + NEIGHBORS, LOGIT_FEATURES + hot + NEIGHBORS
    names = list(dict.fromkeys(xs + logit))
    clean = X.design_columns(d, names)
    keep = ["delivery_date", "delivery_hour", "ttd", "vwap", "vwap_lag1", "vwap_changes", "alpha"]
    # Feature names become plain identifiers for the solvers.
    plain = {"da-id": "da_id"}
    out = clean.select(*keep, *[F.col(f"`{c}`").alias(plain.get(c, c)) for c in names])
    return out, [plain.get(c, c) for c in xs], [plain.get(c, c) for c in logit]


def run_zero_inflated(
    features: DataFrame, cfg: ZeroInflatedConfig | None = None
) -> tuple[DataFrame, DataFrame]:
    """(forecast table, summary)."""
    cfg = cfg or ZeroInflatedConfig()
    rows, xs, logit_xs = design_rows(features, cfg)
    rows = cut(rows)
    gam = G.fit_gamlss(
        rows, "vwap_changes", xs, cfg.dist, cfg.window, cfg.block_days, cfg.min_rows, cfg.penalty
    )
    log = G.fit_trade_logit(rows, logit_xs, cfg.window, cfg.block_days, min_rows=cfg.min_rows)
    out = cut(G.one_step_forecast(rows, gam, log, xs, logit_xs, NEIGHBORS, cfg.nodes, cfg.dist))
    return out, R.summary_table(R.normalize_predictions(out, "zero-inflated"))
