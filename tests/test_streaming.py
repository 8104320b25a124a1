import glob
import math
import os

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ampertide.session import scratch_path
from ampertide.streaming import incremental as S
from ampertide.streaming import keyed as K
from ampertide.streaming import tiers

SCHEMA = "k int, t long, x double, y double"


def _frames(parts=4, n=120, seed=13):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(parts):
        t = np.arange(i * n, (i + 1) * n)
        x = rng.normal(5, 2, n)
        out.append(pd.DataFrame({"k": (t % 3 == 0).astype("int32"), "t": t, "x": x, "y": 2 * x + rng.normal(size=n)}))
    return out


def _feed(spark, root, frame, start):
    # One call per file: arrival order is the order of time.
    spark.createDataFrame(frame, SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/in")
    q = start(spark.readStream.schema(SCHEMA).parquet(f"{root}/in"))
    q.awaitTermination()


def test_stream_scaler_equals_batch_and_replay_counts_once(spark):
    root = scratch_path(spark, "scaler")
    frames = _frames()
    for f in frames:
        _feed(spark, root, f, lambda s: S.stream_scaler(s, ["x"], ["k"], f"{root}/state", f"{root}/ckpt"))
    all_ = pd.concat(frames)
    want = all_.groupby("k").x.agg(["mean", lambda v: v.var(ddof=0)])

    def check():
        got = S.read_scaler(spark, f"{root}/state", ["x"], ["k"]).toPandas().set_index("k").sort_index()
        assert np.allclose(got.mean_x, want.iloc[:, 0]) and np.allclose(got.var_x, want.iloc[:, 1])
        assert got.n.sum() == len(all_)

    check()
    # The last batch comes again: its part and the folds that it completed are the same.
    again = S.scaler_part(spark.createDataFrame(frames[3], SCHEMA), ["x"], ["k"])
    tiers.absorb(again, f"{root}/state", 3, lambda parts: S.fold_scaler(parts, ["x"], ["k"]))
    check()


def test_forgetting_equals_the_sequential_rule(spark):
    root = scratch_path(spark, "forget")
    frames = _frames()
    f = 0.05
    for fr in frames:
        _feed(
            spark, root, fr,
            lambda s: S.stream_scaler(
                s, ["x"], ["k"], f"{root}/state", f"{root}/ckpt", f, ["t"], F.floor(F.col("t") / 50)
            ),
        )
    got = S.read_scaler(spark, f"{root}/state", ["x"], ["k"], f).toPandas().set_index("k")
    for k, part in pd.concat(frames).groupby("k"):
        v = part.sort_values("t").x.to_numpy()
        m, var = v[0], 0.0
        for x in v[1:]:
            d = x - m
            m, var = m + f * d, (1 - f) * (var + f * d * d)
        assert abs(got.mean_x[k] - m) < 1e-9 and abs(got.var_x[k] - var) < 1e-7


def test_stream_gram_and_refit(spark):
    root = scratch_path(spark, "gram")
    frames = _frames()
    for fr in frames:
        _feed(spark, root, fr, lambda s: S.stream_lasso_refit(s, ["x"], "y", ["k"], f"{root}/s", f"{root}/ckpt"))
    end = S.latest_path(spark, f"{root}/s").groupBy("k").agg(F.max_by("beta", "step").alias("b")).collect()
    all_ = pd.concat(frames)
    for r in end:
        p = all_[all_.k == r.k]
        slope, inter = np.polyfit(p.x, p.y, 1)
        assert abs(r.b[1] - slope) < 0.02 and abs(r.b[0] - inter) < 0.1
    tot = S.read_gram(spark, f"{root}/s/sums", 2, ["k"]).toPandas().set_index("k")
    assert np.allclose(tot.g_1_1.sort_index(), (all_.x**2).groupby(all_.k).sum())


def test_tiers_read_a_logarithm_of_the_batches(spark):
    for b in range(300):
        parts = tiers.covering(b)
        assert len(parts) <= math.log2(b + 2)
        held = [x for level, i in parts for x in range(i << level, (i + 1) << level)]
        assert held == list(range(b + 1))


def test_tiers_equal_one_pass_after_every_batch(spark):
    root = scratch_path(spark, "tiers")
    rng = np.random.default_rng(3)
    frames = [pd.DataFrame({"k": rng.integers(0, 3, 20), "t": np.arange(20) + 20 * b, "x": rng.normal(1e6, 1, 20), "y": rng.normal(size=20)}) for b in range(7)]
    f = 0.03
    for b, frame in enumerate(frames):
        d = spark.createDataFrame(frame, "k int, t long, x double, y double")
        part = S.gram_part(d, ["x"], "y", ["k"], None, f, ["t"], F.floor(F.col("t") / 8))
        fold = lambda parts: S.merge_gram(parts, 1, ["k"], f)
        tiers.absorb(part, f"{root}/g", b, fold)
        if b in (3, 4):  # replayed batches change nothing
            tiers.absorb(part, f"{root}/g", b, fold)
        assert tiers.newest(spark, f"{root}/g") == b
        files = tiers.state(spark, f"{root}/g").inputFiles()
        assert len({os.path.dirname(x) for x in files}) == bin(b + 1).count("1")
        got = S.read_gram(spark, f"{root}/g", 1, ["k"], f).toPandas().set_index("k")
        for k, p in pd.concat(frames[: b + 1]).groupby("k"):
            w = (1 - f) ** np.arange(len(p) - 1, -1, -1)
            assert got.n[k] == len(p) and np.isclose(got.xy_0[k], (w * p.x * p.y).sum(), rtol=1e-9, atol=1e-6)
            assert np.isclose(got.g_0_0[k], (w * p.x * p.x).sum(), rtol=1e-12)


def _sequential(values, f):
    m, var = values[0], 0.0
    for i, x in enumerate(values[1:], 2):
        d = x - m
        m, var = (m + f * d, (1 - f) * (var + f * d * d)) if f else (m + d / i, var + (d * (x - m - d / i) - var) / i)
    return m, var


def _keyed_check(spark, ckpt, all_, f, columns=("x", "y")):
    got = K.read_forgetting(spark, ckpt, list(columns), ["k"], f).toPandas().set_index("k")
    for k, part in all_.groupby("k"):
        part = part.sort_values(["ts", "id"])
        assert got.n[k] == len(part)
        for c in columns:
            m, var = _sequential(part[c].dropna().to_numpy(), f)
            assert abs(got[f"mean_{c}"][k] - m) < 1e-7 and abs(got[f"var_{c}"][k] - var) < 1e-6


def _keyed_rows(n=400):
    rng = np.random.default_rng(8)
    at = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 100_000, n)), "s")
    y = rng.normal(1e5, 1, n)
    y[rng.random(n) < 0.1] = np.nan
    return pd.DataFrame({"k": rng.integers(0, 4, n), "id": np.arange(n), "ts": at, "x": rng.normal(5, 2, n), "y": y})


KEYED = "k int, id long, ts timestamp, x double, y double"


def _feed_keyed(spark, root, frame, f, delay, **more):
    spark.createDataFrame(frame, KEYED).repartition(2).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(KEYED).parquet(f"{root}/in")
    q = K.stream_forgetting(stream, ["x", "y"], ["k"], "ts", f"{root}/ckpt", f, delay, "id", **more)
    q.awaitTermination()


def test_keyed_forgetting_equals_the_sequential_rule_over_restarts(spark):
    f = 0.05
    for delay, shuffled in (("0 seconds", 0), ("6 hours", 5 * 3600)):
        root = scratch_path(spark, "keyed")
        rows = _keyed_rows()
        rng = np.random.default_rng(1)
        # Rows come out of order by less than the delay.
        order = np.argsort((rows.ts.astype("int64") / 1e9 + rng.random(len(rows)) * shuffled).to_numpy() if shuffled else np.arange(len(rows)), kind="stable")
        parts = [rows.iloc[i] for i in np.array_split(order, 5)]
        if not shuffled:  # a batch starts after the last time of the one before
            parts = [g for _, g in rows.groupby(pd.cut(rows.ts.astype("int64"), 5, labels=False))]
        for part in parts:
            _feed_keyed(spark, root, part, f, delay)
        _keyed_check(spark, f"{root}/ckpt", rows, f)


def test_keyed_replay_counts_once_and_late_rows_stay_out(spark):
    root = scratch_path(spark, "replay")
    rows = _keyed_rows(300)
    first, second, third = rows[:100], rows[100:200], rows[200:]
    updates = []
    note = {"on_update": lambda d, b: updates.append((b, d.collect()))}
    _feed_keyed(spark, root, first, 0.1, "1 hour", **note)
    _feed_keyed(spark, root, second, 0.1, "1 hour", **note)
    # The commits after the first are lost: the second part's batches run again from the state before.
    commits = f"{root}/ckpt/commits".removeprefix("file:")
    done = sorted(glob.glob(f"{commits}/[0-9]*"), key=lambda p: int(os.path.basename(p)))
    before = len(updates)
    os.remove(done[-1])
    for crc in glob.glob(f"{commits}/.{os.path.basename(done[-1])}.crc"):
        os.remove(crc)
    late = third.assign(ts=pd.Timestamp("2023-12-31"), x=1e9)
    _feed_keyed(spark, root, pd.concat([third, late]), 0.1, "1 hour", **note)
    ids = [b for b, _ in updates]
    assert len(ids) > before and len(ids) > len(set(ids))  # one batch came twice
    _keyed_check(spark, f"{root}/ckpt", rows, 0.1)


def test_keyed_state_stays_small(spark):
    root = scratch_path(spark, "small")
    rows = _keyed_rows(600)
    seen = []
    for _, part in rows.groupby(pd.cut(rows.ts.astype("int64"), 4, labels=False)):
        _feed_keyed(spark, root, part, 0.0, "10 minutes", on_update=lambda d, b: seen.extend(d.collect()))
        held = spark.read.format("statestore").option("stateVarName", "waiting").load(f"{root}/ckpt").collect()
        newest = part.ts.max() - pd.Timedelta("10 minutes")
        waiting = {r.key.k: len(r.value.held) // 32 for r in held}
        # What waits is what the watermark has not passed.
        assert sum(waiting.values()) <= (part.ts >= newest).sum() + 1
        assert all(len(r.value.moments) == 48 for r in spark.read.format("statestore").option("stateVarName", "moments").load(f"{root}/ckpt").collect())
    assert seen and all(r.mean_x is not None for r in seen)
    _keyed_check(spark, f"{root}/ckpt", rows, 0.0)
