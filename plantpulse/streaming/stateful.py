"""Keyed stateful stream operators: T2 and T5 by ``applyInPandasWithState``, T3
by ``transformWithState``.

Readings arrive in micro-batches in any order within the watermark's delay.
They wait until the watermark passes them and are then taken in event-time
order, so the result does not depend on how the input was cut into
micro-batches; later readings than that are late and dropped by Spark. State
per key is bounded: the last ``size - 1`` readings or the time of the last
alert, and the readings inside the delay.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.windows import EPOCH_NTZ, micros_of


# ------------------------------------------------------------------ T2 / T5: bounded buffer


def frame_stats(x: np.ndarray, size: int, start: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(count, mean, population std) of every trailing ``size``-row frame,
    evaluated like Spark's window aggregates (each frame summed from its first
    row; moments by the same running update) so streaming and batch results
    are bit-identical. Vectorised across rows (the last axis, from row ``start``
    on) and columns, ``size`` steps."""
    n = x.shape[-1]
    padded = np.concatenate([np.zeros((*x.shape[:-1], size - 1)), x], axis=-1)
    frames = np.lib.stride_tricks.sliding_window_view(padded, size, axis=-1)[..., start:, :]
    first_valid = np.maximum(0, size - 1 - np.arange(start, n))
    cnt = np.zeros(n - start)
    tot, avg, m2 = (np.zeros(frames.shape[:-1]) for _ in range(3))
    for j in range(size):
        v = frames[..., j]
        ok = j >= first_valid
        c1 = cnt + 1.0
        delta = v - avg
        dn = delta / c1
        tot = np.where(ok, tot + v, tot)
        avg = np.where(ok, avg + dn, avg)
        m2 = np.where(ok, m2 + delta * (delta - dn), m2)
        cnt = np.where(ok, c1, cnt)
    return cnt, tot / cnt, np.sqrt(m2 / cnt)


def buffer_features(stream: DataFrame, key: str, ts: str, seq: str, *, ripple: str,
                    temperature: str, load: str, size: int = 20, delay: str = "1 day",
                    watermarked: str | None = None, idle_seconds: float | None = None) -> DataFrame:
    """Per device keep the last ``size - 1`` readings in state; for every
    reading that the watermark (``delay`` behind the newest) has passed emit
    the trailing-window features over (buffer + reading), marked
    ``insufficient`` until ``size`` readings exist -- the streaming form of W2.
    ``watermarked`` names an event-time column that has its watermark already.
    With ``idle_seconds`` a device's buffer is dropped when it has been silent
    that long; its next reading starts anew."""
    cols = ["_us", "_seq", "_t", "_r", "_l"]
    if watermarked is None:
        stream = stream.withColumn("_pp_ets", F.col(ts).cast("timestamp")).withWatermark("_pp_ets", delay)
    src = (stream.select(F.col(key).alias("_key"), micros_of(stream, ts).alias("_us"),
                   F.col(seq).cast("long").alias("_seq"),
                   F.col(temperature).cast("double").alias("_t"),
                   F.col(ripple).cast("double").alias("_r"),
                   F.col(load).cast("double").alias("_l"), watermarked or "_pp_ets"))
    out_schema = T.StructType([
        T.StructField(key, stream.schema[key].dataType), T.StructField(seq, T.LongType()),
        T.StructField("n_window", T.LongType()), T.StructField("mean_ripple", T.DoubleType()),
        T.StructField("std_ripple", T.DoubleType()), T.StructField("mean_temp", T.DoubleType()),
        T.StructField("temp_rise", T.DoubleType()), T.StructField("mean_load", T.DoubleType()),
        T.StructField("temp_range", T.DoubleType()), T.StructField("window_status", T.StringType())])
    state_schema = T.StructType([
        T.StructField("us", T.ArrayType(T.LongType())), T.StructField("seq", T.ArrayType(T.LongType())),
        T.StructField("t", T.ArrayType(T.DoubleType())), T.StructField("r", T.ArrayType(T.DoubleType())),
        T.StructField("l", T.ArrayType(T.DoubleType())), T.StructField("emitted", T.IntegerType())])

    kinds = [np.int64, np.int64, np.float64, np.float64, np.float64]

    def fn(k, pdfs, state: GroupState):
        # arrays, no frames: a device has a few readings in a micro-batch, and
        # there are as many calls as devices
        held, nb = [np.empty(0, kind) for kind in kinds], 0
        if state.exists:
            *lists, nb = state.get
            held = [np.array(v, dtype=kind) for v, kind in zip(lists, kinds)]
        parts = [held]
        if not state.hasTimedOut:
            parts += [[p[c].astype(kind, copy=False).to_numpy() for c, kind in zip(cols, kinds)] for p in pdfs]
        held = [np.concatenate(x) for x in zip(*parts)]
        # the first nb rows are the emitted ones; the rest waits in time order
        order = np.concatenate([np.arange(nb), nb + np.lexsort((held[1][nb:], held[0][nb:]))])
        us, ids, tv, rv, lv = held = [x[order] for x in held]
        passed_us = state.getCurrentWatermarkMs() * 1000
        due = nb + int((us[nb:] <= passed_us).sum())
        if due == nb and state.hasTimedOut and len(us) == nb:
            state.remove()  # silent for idle_seconds
            return
        n_kept = min(due, size - 1)
        state.update((*[x[due - n_kept:].tolist() for x in held], n_kept))
        if len(us) > due:
            wake_ms = int(-(-us[due] // 1000))
        elif idle_seconds is not None:
            wake_ms = int(us[-1] // 1000 + idle_seconds * 1000)
        else:
            wake_ms = None
        if wake_ms is not None:
            state.setTimeoutTimestamp(max(wake_ms, state.getCurrentWatermarkMs() + 1))
        if due == nb:
            return
        tv = tv[:due]
        start = np.maximum(0, np.arange(nb, due) - size + 1)
        n, mean, std = frame_stats(np.stack([rv[:due], tv, lv[:due]]), size, nb)
        yield pd.DataFrame({
            key: k[0], seq: ids[nb:due], "n_window": n.astype("int64"),
            "mean_ripple": mean[0], "std_ripple": std[0],
            "mean_temp": mean[1], "temp_rise": tv[nb:] - tv[start],
            "mean_load": mean[2], "temp_range": frame_range(tv, size, nb),
            "window_status": np.where(n < size, "insufficient", "ready")})

    return (src.groupBy("_key")
               .applyInPandasWithState(fn, out_schema, state_schema, "append",
                                       GroupStateTimeout.EventTimeTimeout))


def frame_range(x: np.ndarray, size: int, start: int = 0) -> np.ndarray:
    """Largest less smallest number of every trailing ``size``-row frame from row
    ``start`` on; values that are missing or infinite do not count."""
    padded = np.concatenate([np.full(size - 1, np.nan), np.where(np.isinf(x), np.nan, x)])
    frames = np.lib.stride_tricks.sliding_window_view(padded, size)[start:]
    return np.fmax.reduce(frames, axis=1) - np.fmin.reduce(frames, axis=1)


# ------------------------------------------------------------------ T3: cool-down


class CooldownProcessor(StatefulProcessor):
    """The alert clock of one key. Rows wait in a list until the watermark has
    passed them and are then taken in order of (time, id), so neither the cut
    into micro-batches nor the order inside the delay matters. A timer at the
    earliest waiting row wakes the key; when nothing waits, one at the end of
    the cool-down drops its state, after which any on-time row fires anyway."""

    def __init__(self, gap_us: int, waiting: T.StructType, out: T.StructType):
        self.gap_us, self.schema, self.out = gap_us, waiting, [f.name for f in out.fields]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.fired = handle.getValueState("fired", T.StructType([T.StructField("us", T.LongType())]))
        self.wake = handle.getValueState("wake", T.StructType([T.StructField("ms", T.LongType())]))

    def _sleep(self, ms: int) -> None:
        """The key's only timer goes to ``ms``."""
        if self.wake.exists():
            self.handle.deleteTimer(self.wake.get()[0])
        self.handle.registerTimer(ms)
        self.wake.update((ms,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [tuple(r[len(key):len(key) + len(self.schema)]) for r in rows]
        idle = not self.waiting.exists()
        self.waiting.appendList(new)
        wake = max(-(-min(r[0] for r in new) // 1000), timerValues.getCurrentWatermarkInMs() + 1)
        if idle or not self.wake.exists() or wake < self.wake.get()[0]:
            self._sleep(wake)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.wake.exists() and self.wake.get()[0] != expiredTimerInfo.getExpiryTimeInMs():
            return  # set again meanwhile
        self.wake.clear()
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        due, later = [], []
        for row in self.waiting.get():
            (due if row[0] <= passed else later).append(tuple(row))
        last = self.fired.get()[0] if self.fired.exists() else None
        for row in sorted(due, key=lambda r: r[:2]):
            if last is None or row[0] - last > self.gap_us:
                last = row[0]
                yield Row(**dict(zip(self.out, (*key, *row))))
        if later:
            self.waiting.put(later)
            self._sleep(-(-min(r[0] for r in later) // 1000))
        else:
            self.waiting.clear()
        if last is None or (not later and passed >= last + self.gap_us):
            self.fired.clear()
            return
        self.fired.update((last,))
        if not later:
            self._sleep(-(-(last + self.gap_us) // 1000))


def cooldown(stream: DataFrame, keys: Sequence[str], ts: str, row_id: str,
             cooldown_seconds: float, extra: Sequence[str] = (),
             watermark_delay: str | None = "10 minutes") -> DataFrame:
    """Emit a row when its key never fired or more than ``cooldown``
    seconds (strict) passed since the key's last emit. Equal to the batch
    cool-down for all rows that arrive within the watermark's delay: a row is
    decided when the watermark has passed it. NULL keys are keys, an empty key
    list is one global clock, and rows without a time always fire and move no
    clock. With ``watermark_delay=None`` a column of ``stream`` other than those
    named here has the watermark. Rows behind it are late and dropped by Spark."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    gap_us = int(round(cooldown_seconds * 1_000_000))
    src, clocks = stream, [c for c in stream.columns if c not in {*keys, ts, row_id, *extra}]
    if watermark_delay:
        src, clocks = src.withColumn("_pp_ets", F.col(ts).cast("timestamp")).withWatermark("_pp_ets", watermark_delay), ["_pp_ets"]
    kinds = {f.name: f.dataType for f in stream.schema.fields}
    names = [f"_k{i}" for i in range(len(keys))] or ["_k"]
    key_fields = [T.StructField(n, kinds[k] if keys else T.IntegerType()) for n, k in zip(names, keys or ["_k"])]
    rest = [T.StructField("_us", T.LongType()), T.StructField("_seq", T.LongType())]
    rest += [T.StructField(f"_x{i}", kinds[c]) for i, c in enumerate(extra)]
    kept = [F.col(k).alias(n) for k, n in zip(keys, names)] or [F.lit(0).alias("_k")]
    kept += [micros_of(stream, ts).alias("_us"), F.col(row_id).cast("long").alias("_seq")]
    kept += [F.col(c).alias(f"_x{i}") for i, c in enumerate(extra)]
    out = T.StructType(key_fields + rest)
    fired = src.filter(F.col(ts).isNotNull()).select(*kept, *clocks)
    fired = fired.groupBy(*names).transformWithState(
        CooldownProcessor(gap_us, T.StructType(rest), out), out, "append", "eventTime")
    fired = fired.unionByName(src.filter(F.col(ts).isNull()).select(*kept))
    return fired.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], time_of(kinds[ts], "_us").alias(ts),
                        F.col("_seq").alias(row_id), *[F.col(f"_x{i}").alias(c) for i, c in enumerate(extra)])


def time_of(kind: T.DataType, us: str):
    """A column of epoch microseconds as ``kind`` again."""
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(us)
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(f"{EPOCH_NTZ} + make_dt_interval(0, 0, 0, cast({us} AS decimal(20, 0)) / 1000000)")
    return F.col(us).cast(kind)
