"""Streaming twins of the replayed decisions: the same answers, kept as state per key.

Streams need event time and a declared lateness. Rows that come later than the watermark are dropped by the
engine; decisions already put out are not revised. State expires when a key has been silent for longer
than it matters.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gristmill.operators.replay import UNITS, Breaker, _limit
from gristmill.session import ship


def sliding_window(events: DataFrame, unit: str, limit: int, window: int = 1, lateness: str = "1 minute") -> DataFrame:
    """(key, ts_ms, id, allowed) of a stream (key string, ts timestamp, id long); the state of a key is its allowed
    times within the window, `limit` at most."""
    length = _limit(unit, limit, window)

    def decide(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["ts_ms", "id"])
        out = []
        for t in rows["ts_ms"]:
            kept = [k for k in kept if k >= t - length]
            ok = len(kept) < limit
            if ok:
                kept.append(int(t))
            out.append(ok)
        state.update((kept,))
        until = max([*kept, int(rows["ts_ms"].max())]) + length + 1
        state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        yield rows.assign(key=key[0], allowed=out)[["key", "ts_ms", "id", "allowed"]]

    ship(events.sparkSession)
    timed = events.withWatermark("ts", lateness).withColumn("ts_ms", F.unix_millis("ts"))
    return timed.select("key", "ts", "ts_ms", "id").groupBy("key").applyInPandasWithState(
        decide, "key string, ts_ms long, id long, allowed boolean", "kept array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )


def breaker(calls: DataFrame, rate: float, duration: int, probes: int) -> DataFrame:
    """(key, ts_s, id, executed, state) of a stream (key string, ts_s long, id long, ok boolean); the state of a key is its
    breaker, which never expires. Rows of a batch are taken in order of time; batches must come in order."""
    Breaker(rate, duration, probes)
    fields = ["state", "errors", "total", "p_errors", "p_total", "opened"]

    def decide(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        b = Breaker(rate, duration, probes)
        if state.exists:
            for name, value in zip(fields, state.get):
                setattr(b, name, value)
        rows = pd.concat(list(frames)).sort_values(["ts_s", "id"])
        done = [(b.call(int(s), bool(ok)), b.state) for s, ok in zip(rows["ts_s"], rows["ok"])]
        state.update(tuple(getattr(b, f) for f in fields))
        yield rows.assign(key=key[0], executed=[x for x, _ in done], state=[x for _, x in done])[["key", "ts_s", "id", "executed", "state"]]

    ship(calls.sparkSession)
    return calls.select("key", "ts_s", "id", "ok").groupBy("key").applyInPandasWithState(
        decide, "key string, ts_s long, id long, executed boolean, state string",
        "state string, errors long, total long, p_errors long, p_total long, opened long", "append", GroupStateTimeout.NoTimeout,
    )


def aligned_window(events: DataFrame, unit: str, limit: int, lateness: str = "1 minute") -> DataFrame:
    """(window, key, calls, allowed, denied) per calendar window: the native counterpart of the shared window, whose
    starts are fixed instead of set by the first call."""
    span = f"{_limit(unit, limit) // UNITS[unit]} {unit}"
    g = events.withWatermark("ts", lateness).groupBy(F.window("ts", span).alias("window"), "key").agg(F.count(F.lit(1)).alias("calls"))
    return g.select("window", "key", "calls", F.least("calls", F.lit(limit)).alias("allowed"), F.greatest(F.col("calls") - limit, F.lit(0)).alias("denied"))


def idempotent(calls: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """The first call of each key (key, ts, ...) within the lateness; native state, dropped by the watermark."""
    return calls.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["key"])


def route(events: DataFrame, handlers: dict, checkpoint: str, **trigger):
    """Starts a query that hands each batch's events (seq, name, action) to handlers[name](rows) by name, in order of seq.
    Handlers get a DataFrame; names without a handler are left alone."""

    def each(batch: DataFrame, _: int) -> None:
        held = batch.persist()
        try:
            for name, handler in handlers.items():
                handler(held.where(F.col("name") == name).orderBy("seq"))
        finally:
            held.unpersist()

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
