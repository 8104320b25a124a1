"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8)."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "bin_series", "w7_dedupe", "a2_bin_vwap", "a3_tick_vwap", "w1_add_lags", "j8_neighbor_features",
    "w13_response_lags", "j5_lag_join", "m3_mvt_features", "a19_rolling_moments", "j10_interp_clamp",
    "c3_merit_order_slope", "a16_gram", "a9_hour_correlation", "a21_ecf_grid", "a22_cos_coefficients",
    "w9_ensemble_rank", "w11_empirical_cdf", "a12_summary_table", "m1_rolling_ols", "m6_fit_mardia",
    "m5_fit_ecm", "m7_predict", "m9_run_study", "m12_fit_gamlss", "m13_fit_trade_logit", "m14_logit_path_bic", "m15_lasso_path",
    "a10_fit_marginals", "plan_prepare_features",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    from ampertide.catalog import QUERIES
    from ampertide.session import local_session

    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    # The JVM and the Python workers start before the clock does.
    QUERIES["a5_side_volume"](spark, sf).collect()
    QUERIES["a22_cos_coefficients"](spark, sf).collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline query seconds", "value": round(sum(times.values()), 3),
                "unit": "sec", "queries": times, "sf": Path(sf).name,
            }
        )
    )


if __name__ == "__main__":
    main()
