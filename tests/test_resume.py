from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from ampertide.catalog.models import CFG, spread_panel
from ampertide.models import mvt as M
from ampertide.models import resume as R
from ampertide.session import cut

SF = "/root/testdata/sf0.001"
KEYS = ["date", "hour", "which_hour_before"]


def rows(d, cols):
    return sorted(map(str, d.select(*cols).collect()))


def test_a_stopped_study_fits_only_the_remainder(spark, tmp_path):
    folder, cfg = str(tmp_path / "study"), replace(CFG, horizons=(2, 1), method="mardia")
    panel = cut(spread_panel(spark, SF))
    hi = panel.agg(F.max("delivery_date").alias("d")).head().d
    early = panel.filter(F.col("delivery_date") < F.lit(hi))
    wanted = R.wanted_parts(early, cfg, 2)
    total = wanted.count()
    assert R.run_parts(early, cfg, folder, 2, at_most=1) == 1
    # Stopped between a part's tables and its manifest row: not finished, so not shown, and fitted again.
    one = R.finished_parts(spark, folder).head()
    other = wanted.filter((F.col("part") != one.part) | (F.col("wh") != one.wh)).head()
    spark.read.parquet(f"{folder}/params/wh={one.wh}/part={one.part}").write.parquet(f"{folder}/params/wh={other.wh}/part={other.part}")
    shown = R.study_results(spark, folder)[0]
    assert shown.select("which_hour_before").distinct().count() == 1
    assert R.run_parts(early, cfg, folder, 2) == total - 1
    assert R.run_parts(early, cfg, folder, 2) == 0
    # One more day: only the last part of each horizon is done again.
    assert R.run_parts(panel, cfg, folder, 2) == len(cfg.horizons)
    params, preds, summary = R.study_results(spark, folder)
    want_params, want_preds, want_summary = M.run_study(panel, cfg)
    assert rows(params, [*KEYS, "df", "n", "calibration_ok"]) == rows(want_params, [*KEYS, "df", "n", "calibration_ok"])
    cols = ["timestamp", *KEYS, F.round("mu_cond", 8), F.round("crps", 8)]
    assert rows(preds, cols) == rows(want_preds, cols)
    assert summary.count() == want_summary.count() > 0
    with pytest.raises(ValueError, match="another configuration"):
        R.run_parts(panel, replace(cfg, lookback_days=13), folder, 2)
