"""Forgetting moments as keyed state: mean and variance that follow a stream.

Each row of a key moves its mean by `forget` times the deviation and fades its variance by 1 - forget, in
the order of event time. The state store holds per key the moments (a fixed number of values)
and the rows that the watermark has not passed yet, so rows may come in any order within `delay`; later
ones are left out. When the watermark passes a row, it is absorbed in its place. A replayed
batch starts from the state version before it, so every row counts once.

A null or NaN leaves its column as it is; rows without a time take no part. Rows of one time follow in the order of `tie`. A key's rows of
one micro-batch meet in one task, so bound the batch (maxFilesPerTrigger, or the source's own option)
where one key holds most rows; `incremental.stream_scaler` reduces such keys in parallel instead and
asks for batches in order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def absorb_rows(moments: np.ndarray, x: np.ndarray, forget: float) -> np.ndarray:
    """(count, mean, variance) per column after the rows x, in order; the sequential rule in closed form.

    moments: columns x 3. forget 0 gives the plain mean and population variance."""
    out = moments.copy()
    for c in range(x.shape[1]):
        v = x[:, c]
        v = v[~np.isnan(v)]
        if not len(v):
            continue
        n, mean, var = out[c]
        if n == 0:
            mean = v[0]
        dev = v - mean
        m = len(v)
        if forget > 0:
            if n == 0:
                dev = dev[1:]
            w = forget * (1.0 - forget) ** np.arange(len(dev) - 1, -1, -1.0)
            shift = w @ dev
            var = (1.0 - forget) ** len(dev) * var + w @ (dev * dev) - shift * shift
        else:
            shift = dev.sum() / (n + m)
            var = (n * var + (dev * dev).sum()) / (n + m) - shift * shift
        out[c] = n + m, mean + shift, max(var, 0.0)
    return out


def _packed(held: np.ndarray) -> bytes:
    return np.ascontiguousarray(held).tobytes()


def _unpacked(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, "<f8").reshape(-1, width)


def _sorted(held: np.ndarray) -> np.ndarray:
    """Rows (time, tie, values) in order; equal ones by their values, so that arrival does not matter."""
    return held[np.lexsort(held.T[::-1])]


class Forgetting(StatefulProcessor):
    """Moments and waiting rows of one key. Times are whole microseconds, exact as doubles until 2255."""

    def __init__(self, cols: list[str], by: list[str], time: str, tie: str | None, forget: float):
        self.cols, self.by, self.time, self.tie, self.forget = cols, by, time, tie, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.moments = handle.getValueState("moments", "rows long, moments binary")
        self.waiting = handle.getValueState("waiting", "held binary")

    def _advance(self, key, fresh: np.ndarray, watermark_ms: int):
        k = len(self.cols)
        rows, now = (self.moments.get() if self.moments.exists() else (0, _packed(np.zeros((k, 3)))))
        held = _unpacked(self.waiting.get()[0], k + 2) if self.waiting.exists() else np.zeros((0, k + 2))
        held = _sorted(np.vstack([held, fresh]))
        passed = held[:, 0] <= 1000 * watermark_ms
        state = absorb_rows(_unpacked(now, 3), held[passed][:, 2:], self.forget)
        rows += int(passed.sum())
        rest = held[~passed]
        self.moments.update((rows, _packed(state)))
        self.waiting.update((_packed(rest),))
        if len(rest):
            self.handle.registerTimer(int(-(-rest[0, 0] // 1000)))  # when the watermark passes the first
        made = dict(zip(self.by, key)) | {"rows": rows, "waiting": len(rest)}
        for c, (_, mean, var) in zip(self.cols, state):
            made |= {f"mean_{c}": mean, f"var_{c}": var}
        yield pd.DataFrame([made])

    def handleInputRows(self, key, rows, timerValues):
        parts = []
        for pdf in rows:
            at = pdf[self.time].astype("datetime64[us]").astype("int64").to_numpy(float)
            tie = pdf[self.tie].to_numpy(float) if self.tie else np.zeros(len(pdf))
            parts.append(np.column_stack([at, tie, *[pd.to_numeric(pdf[c]).to_numpy(float, na_value=np.nan) for c in self.cols]]))
        yield from self._advance(key, np.vstack(parts), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._advance(key, np.zeros((0, len(self.cols) + 2)), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def stream_forgetting(
    stream: DataFrame, cols: list[str], by: list[str], time: str, checkpoint: str, forget: float,
    delay: str = "0 seconds", tie: str | None = None, on_update=None, available_now: bool = True,
) -> StreamingQuery:
    """Keeps decayed mean and variance of `cols` per key in the state store of `checkpoint`.

    on_update(frame, batch_id) gets the keys that a batch changed: by, rows absorbed, rows waiting,
    mean_<c>, var_<c>."""
    spark = stream.sparkSession
    by, cols = list(by), list(cols)
    key_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.select(*by).schema)
    ddl = f"{key_ddl}, rows long, waiting long, " + ", ".join(f"`mean_{c}` double, `var_{c}` double" for c in cols)
    needed = stream.select(*by, time, *([tie] if tie else []), *cols).filter(F.col(time).isNotNull()).withWatermark(time, delay)
    made = needed.groupBy(*by).transformWithStateInPandas(Forgetting(cols, by, time, tie, forget), ddl, "Update", "EventTime")
    writer = made.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(on_update) if on_update else writer.format("noop")
    # The query keeps the store it started with; the session's own choice comes back.
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STORE)
    try:
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def read_forgetting(spark: SparkSession, checkpoint: str, cols: list[str], by: list[str], forget: float) -> DataFrame:
    """by, n, mean_<c>, var_<c> from the newest state: all rows that have come in time, those still waiting for
    the watermark included."""
    by, cols = list(by), list(cols)

    def held(name: str) -> DataFrame:
        return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)

    moments = held("moments").select("key", F.col("value.rows").alias("rows"), F.col("value.moments").alias("moments"))
    both = moments.join(held("waiting").select("key", F.col("value.held").alias("held")), "key")
    key_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in both.schema["key"].dataType)
    k = len(cols)

    def finish(batches):
        for pdf in batches:
            out = pdf[by].copy()
            states, counts = [], []
            for rows, now, rest in zip(pdf["rows"], pdf["moments"], pdf["held"]):
                waiting = _unpacked(rest, k + 2)
                states.append(absorb_rows(_unpacked(now, 3), waiting[:, 2:], forget))
                counts.append(rows + len(waiting))
            out["n"] = counts
            for i, c in enumerate(cols):
                seen = [s[i][0] > 0 for s in states]
                out[f"mean_{c}"] = [s[i][1] if ok else None for s, ok in zip(states, seen)]
                out[f"var_{c}"] = [s[i][2] if ok else None for s, ok in zip(states, seen)]
            yield out

    ddl = f"{key_ddl}, n long, " + ", ".join(f"`mean_{c}` double, `var_{c}` double" for c in cols)
    return both.select("key.*", "rows", "moments", "held").mapInPandas(finish, ddl)
