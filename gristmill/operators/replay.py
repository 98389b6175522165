"""Decisions replayed over event logs: rate limiters, circuit breakers, balancers, queues, histories."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.plans.ranking import positions, running, small
from gristmill.session import cut, ship

UNITS = {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}


def fold(df: DataFrame, key: list[str], order: list[str], schema: str, start: Callable, step: Callable) -> DataFrame:
    """Replays the rows of each key in order: state = start(), then step(state, row) gives the row's output dict.

    A task streams its sorted rows and holds one key's state at a time, so a key of any length needs no
    more memory than its state; rows of one key are replayed by one task, since each depends on the last.
    """
    ship(df.sparkSession)
    names = [part.split(" ")[0] for part in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, first = None, None, True
        for batch in batches:
            out: dict[str, list] = {n: [] for n in names}
            for row in batch.to_pylist():
                now = tuple(row[k] for k in key)
                if first or now != last:
                    last, state, first = now, start(), False
                made = row | step(state, row)
                for n in names:
                    out[n].append(made[n])
            yield pa.RecordBatch.from_pydict(out, schema=kind)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_schema(_parse_datatype_string(schema))
    return df.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(work, schema)


# --- rate limiters -----------------------------------------------------------------------------------


def _limit(unit: str, limit: int, window: int = 1) -> int:
    """The window in milliseconds; ValueError for a bad unit, limit or window."""
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {sorted(UNITS)}")
    if not isinstance(limit, int) or limit <= 0:
        raise ValueError("limit must be a positive integer")
    if not isinstance(window, int) or not 1 <= window <= 10**7:
        raise ValueError("window must be an integer from 1 to 10^7")
    return UNITS[unit] * window


def _flagged(events: DataFrame, blacklist: list | None) -> DataFrame:
    bad = F.col("key").isin(list(blacklist)) if blacklist else F.lit(False)
    return events.withColumn("blacklisted", bad)


def anchors(times: DataFrame, length: int) -> DataFrame:
    """(anchor): the starts of the windows that one clock shares: the first time, then each first time more than
    `length` after an anchor. times has distinct `t`.

    Each time points to the first one beyond its window (a bounded look-ahead in buckets of `length`); the
    anchors are what the first time reaches, found by doubling pointers, log2 of the anchors rounds.
    """
    t = times.select("t", F.expr(f"t div {length}").alias("bucket"))
    probes = t.select((F.col("t") + length).alias("v"), F.lit(None).cast("bigint").alias("p"), "t")
    points = t.select(F.col("t").alias("v"), F.col("t").alias("p"), F.lit(None).cast("bigint").alias("t"))
    both = probes.union(points).withColumn("bucket", F.expr(f"v div {length}"))
    # From the latest on, a probe before a point of its time: the least point so far is the first after the probe.
    passed = Window.partitionBy("bucket").orderBy(F.desc("v"), F.col("p").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("near", F.min("p").over(passed)).where("t IS NOT NULL").select("t", "bucket", "near")
    firsts = t.groupBy("bucket").agg(F.min("t").alias("first")).union(near.select("bucket", F.lit(None).cast("bigint")).distinct())
    firsts = firsts.groupBy("bucket").agg(F.min("first").alias("first")).withColumn("back", -F.col("bucket"))
    # A bucket's own first is no later one: its successor in time comes just before it in this order.
    after = running(firsts, ["back"], [], least={"upto": F.col("first")})
    rank = positions(after.select("back", "bucket", "upto"), ["back"], name="k")
    before = rank.select((F.col("k") + 1).alias("k"), F.col("upto").alias("after"))
    after = rank.select("k", F.col("bucket").alias("b")).join(before, "k").select("b", "after")
    jump = cut(near.join(after, F.col("bucket") == F.col("b"), "left").select("t", F.coalesce("near", "after").alias("to")).where("to IS NOT NULL"))
    reach = cut(times.agg(F.min("t").alias("anchor")).where("anchor IS NOT NULL"))
    while not jump.isEmpty():
        # reach holds the first 2^k anchors, and jump leads 2^k anchors on.
        more = reach.join(jump, F.col("anchor") == F.col("t")).select(F.col("to").alias("anchor"))
        reach = cut(reach.union(more))
        j2 = jump.select(F.col("t").alias("t2"), F.col("to").alias("to2"))
        jump = cut(jump.join(j2, F.col("to") == F.col("t2")).select("t", F.col("to2").alias("to")))
    return reach


def fixed_window(events: DataFrame, unit: str, limit: int, blacklist: list | None = None) -> DataFrame:
    """events (key, ts_ms, id) with blacklisted, anchor, allowed, remaining.

    At most `limit` calls of a key in a window; all keys share the window, which begins anew at the first
    call that is not blacklisted after more than its length (equality stays inside). Calls of
    blacklisted keys are denied and begin nothing.
    """
    length = _limit(unit, limit)
    e = _flagged(events, blacklist)
    good = e.where("NOT blacklisted")
    starts = anchors(good.select(F.col("ts_ms").alias("t")).distinct(), length)
    by_bucket = starts.select("anchor", F.explode(F.array(F.expr(f"anchor div {length}"), F.expr(f"anchor div {length} + 1"))).alias("bk"))
    by_bucket = by_bucket.groupBy("bk").agg(F.collect_list("anchor").alias("starts"))  # four at most: starts lie over a length apart
    met = good.withColumn("gm_b", F.expr(f"ts_ms div {length}")).join(small(by_bucket), F.col("gm_b") == F.col("bk"))
    met = met.withColumn("anchor", F.array_max(F.filter("starts", lambda a: a <= F.col("ts_ms")))).drop("gm_b", "bk", "starts")
    rank = F.row_number().over(Window.partitionBy("anchor", "key").orderBy("ts_ms", "id"))
    decided = met.withColumn("gm_r", rank).withColumn("allowed", F.col("gm_r") <= limit)
    decided = decided.withColumn("remaining", F.greatest(F.lit(0), limit - F.col("gm_r"))).drop("gm_r")
    denied = e.where("blacklisted").withColumns(
        {"anchor": F.lit(None).cast("bigint"), "allowed": F.lit(False), "remaining": F.lit(None).cast("int")}
    )
    return decided.unionByName(denied)


def until_reset(decided: DataFrame, unit: str) -> DataFrame:
    """Adds reset_ms: milliseconds from each call to the end of its window."""
    return decided.withColumn("reset_ms", F.col("anchor") + UNITS[unit] - F.col("ts_ms"))


def sliding_window(events: DataFrame, unit: str, limit: int, window: int = 1, blacklist: list | None = None) -> DataFrame:
    """(key, ts_ms, id, allowed, remaining): a call is allowed while fewer than `limit` allowed calls of its key are
    as young as the window (its edge included); denied calls do not count. Calls of blacklisted keys are
    denied with remaining null and leave no trace."""
    length = _limit(unit, limit, window)

    def step(kept: deque, row: dict) -> dict:
        if row["blacklisted"]:
            return {"allowed": False, "remaining": None}
        while kept and kept[0] < row["ts_ms"] - length:
            kept.popleft()
        ok = len(kept) < limit
        if ok:
            kept.append(row["ts_ms"])
        return {"allowed": ok, "remaining": limit - len(kept)}

    rows = _flagged(events, blacklist).select("key", "ts_ms", "id", "blacklisted")
    kind = rows.schema["key"].dataType.simpleString()
    return fold(rows, ["key"], ["ts_ms", "id"], f"key {kind}, ts_ms bigint, id bigint, blacklisted boolean, allowed boolean, remaining int", deque, step)


def limiter_metrics(decided: DataFrame, blacklisted: bool = True) -> DataFrame:
    """(key, allowed, denied); blacklisted: whether calls of blacklisted keys are counted as denied."""
    d = decided if blacklisted else decided.where("NOT blacklisted")
    return d.groupBy("key").agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("denied"))


def bad_actors(metrics: DataFrame) -> DataFrame:
    return metrics.where("denied > allowed").select("key")


# --- circuit breaker -----------------------------------------------------------------------------------


class Breaker:
    """One key's breaker: closed, open, half_open, on whole seconds."""

    def __init__(self, rate: float, duration: int, probes: int):
        if not 0 < rate <= 1 or duration <= 0 or probes <= 0:
            raise ValueError("rate must be in (0, 1], duration and probes positive")
        self.rate, self.duration, self.probes = rate, duration, probes
        self.reset()

    def reset(self) -> None:
        """Closed, with all counts at 0."""
        self.state, self.errors, self.total, self.p_errors, self.p_total, self.opened = "closed", 0, 0, 0, 0, 0

    @staticmethod
    def _rate(errors: int, total: int) -> float:
        return round(errors / total, 4) if total else 0.0

    def call(self, second: int, ok: bool) -> bool:
        """Whether the call is executed; ok is what it would return."""
        if self.state == "closed" and self.total and self._rate(self.errors, self.total) >= self.rate:
            self.state, self.opened = "open", second
            return False
        if self.state == "open":
            if second - self.opened < self.duration:
                return False
            self.state, self.p_errors, self.p_total = "half_open", 0, 0
        elif self.state == "half_open" and self.p_total >= self.probes:
            if self.p_errors / self.p_total > self.rate:
                self.state, self.opened = "open", second
                return False
            self.state, self.errors, self.total = "closed", 0, 0
        if self.state == "half_open":
            self.p_total, self.p_errors = self.p_total + 1, self.p_errors + (not ok)
        else:
            self.total, self.errors = self.total + 1, self.errors + (not ok)
        return True


def breaker(calls: DataFrame, rate: float, duration: int, probes: int) -> DataFrame:
    """(key, ts_s, id, ok, executed, state, failure_rate, half_open_in) of calls (key, ts_s, id, ok) replayed per key:
    the state after each call, the failures among the calls it counts, and the seconds until it may probe. Where calls
    have a column reset, a row in which it is true resets the breaker before its call."""
    Breaker(rate, duration, probes)

    def step(b: Breaker, row: dict) -> dict:
        if row.get("reset"):
            b.reset()
        done = b.call(row["ts_s"], row["ok"])
        wait = max(0, b.duration - (row["ts_s"] - b.opened)) if b.state == "open" else 0
        return {"executed": done, "state": b.state, "failure_rate": b._rate(b.errors, b.total), "half_open_in": wait}

    kind = calls.schema["key"].dataType.simpleString()
    schema = f"key {kind}, ts_s bigint, id bigint, ok boolean, executed boolean, state string, failure_rate double, half_open_in bigint"
    given = ["key", "ts_s", "id", "ok", *(["reset"] if "reset" in calls.columns else [])]
    return fold(calls.select(*given), ["key"], ["ts_s", "id"], schema, lambda: Breaker(rate, duration, probes), step)


def breaker_metrics(trace: DataFrame) -> DataFrame:
    """(key, calls, executed, rejected, failed, last_state)."""
    return trace.groupBy("key").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if("executed").alias("executed"), F.count_if(~F.col("executed")).alias("rejected"),
        F.count_if(F.col("executed") & ~F.col("ok")).alias("failed"), F.max_by("state", F.struct("ts_s", "id")).alias("last_state"),
    )


def with_fallback(trace: DataFrame, result: str, fallback: Column) -> DataFrame:
    """The result of executed calls that succeeded, else the fallback."""
    return trace.withColumn(result, F.when(F.col("executed") & F.col("ok"), F.col(result)).otherwise(fallback))


# --- balancers -----------------------------------------------------------------------------------------


def _healthy(servers: DataFrame) -> DataFrame:
    return servers.where("healthy AND active_connections < max_connections")


def _dealt(requests: DataFrame, slots: DataFrame, start: int) -> DataFrame:
    """Requests (id, ts_ms) to slots (slot, server) in turn."""
    n = slots.count()
    if not n:
        raise RuntimeError("no healthy servers")
    turn = positions(requests.select("id", "ts_ms"), ["ts_ms", "id"], name="gm_turn")
    at = F.pmod(F.col("gm_turn") + start, F.lit(n)).cast("int")
    return turn.withColumn("gm_at", at).join(small(slots), F.col("gm_at") == F.col("slot")).select("id", "ts_ms", "server")


def round_robin(requests: DataFrame, servers: DataFrame, start: int = 0) -> DataFrame:
    """(id, ts_ms, server): healthy servers below capacity in the order of ord, in turn. RuntimeError if none."""
    w = Window.orderBy("ord")
    return _dealt(requests, _healthy(servers).select((F.row_number().over(w) - 1).alias("slot"), "server"), start)


def weighted_round_robin(requests: DataFrame, servers: DataFrame, start: int = 0) -> DataFrame:
    """As round_robin, each server with weight // least weight turns a round. ValueError for a weight under 1."""
    up = _healthy(servers)
    least = up.agg(F.min("weight")).first()[0]
    if least is not None and least < 1:
        raise ValueError("weights must be positive")
    turns = up.select("ord", "server", F.explode(F.sequence(F.lit(1), F.expr(f"cast(weight div {least or 1} as int)"))).alias("k"))
    return _dealt(requests, turns.select((F.row_number().over(Window.orderBy("ord", "k")) - 1).alias("slot"), "server"), start)


def next_in_turn(previous: int, n: int) -> int:
    return (previous + 1) % n


def least_connections(servers: DataFrame) -> DataFrame:
    """(server): the healthy server of fewest active connections, the first of equals, if it is below capacity."""
    return _healthy(servers).agg(F.min_by("server", F.struct("active_connections", "ord")).alias("server"))


def replay_least_connections(requests: DataFrame, servers: list[tuple[str, int]]) -> DataFrame:
    """(pool, id, ts_ms, hold_ms, server): requests (pool, id, ts_ms, hold_ms) replayed per pool; each takes the server
    (name, capacity) of fewest requests still held, the first of equals; null where all are full."""

    def start():
        return [deque() for _ in servers]

    def step(held, row):
        for h in held:
            for end in [x for x in h if x <= row["ts_ms"]]:
                h.remove(end)
        free = [i for i, h in enumerate(held) if len(h) < servers[i][1]]
        if not free:
            return {"server": None}
        i = min(free, key=lambda i: (len(held[i]), i))
        held[i].append(row["ts_ms"] + row["hold_ms"])
        return {"server": servers[i][0]}

    kind = requests.schema["pool"].dataType.simpleString()
    return fold(requests, ["pool"], ["ts_ms", "id"], f"pool {kind}, id bigint, ts_ms bigint, hold_ms bigint, server string", start, step)


def least_time(log: DataFrame) -> DataFrame:
    """(pool, id, ts_ms, server, average, best): after each request (pool, id, ts_ms, server, elapsed) its server's
    average so far, and the server whose average was ever the lowest, the earliest of equals: it stays
    the choice when it slows."""
    order = ["ts_ms", "id"]
    x = running(log, order, ["pool", "server"], {"gm_sum": F.col("elapsed"), "gm_n": F.when(F.col("elapsed").isNotNull(), 1).otherwise(0)})
    x = x.withColumn("average", F.round(F.col("gm_sum") / F.nullif("gm_n", F.lit(0)), 5))
    x = running(x, order, ["pool"], least={"gm_best": F.struct("average", "ts_ms", "id", "server")})
    return x.select("pool", "id", "ts_ms", "server", "average", F.col("gm_best.server").alias("best"))


def server_metrics(log: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(server, requests, success, failure, success_rate, latency, healthy) of a log (server, ok, elapsed); rates to 5 places,
    halves to even. ValueError unless 0 < threshold < 1."""
    if not 0 < threshold < 1:
        raise ValueError("threshold must be between 0 and 1")
    g = log.groupBy("server").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if("ok").alias("success"), F.count_if(~F.col("ok")).alias("failure"), F.sum("elapsed").alias("total"),
    )
    return g.select(
        "server", "requests", "success", "failure", F.bround(F.col("success") / F.col("requests"), 5).alias("success_rate"),
        F.bround(F.col("total") / F.col("requests"), 5).alias("latency"), (F.col("success") / F.col("requests") > threshold).alias("healthy"),
    )


def health_report(servers: DataFrame, log: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(server, active_connections, max_connections, requests, success_rate, latency, healthy) of every server, those
    without a request included: they are as healthy as they say."""
    m = server_metrics(log, threshold).select(F.col("server").alias("s"), "requests", "success_rate", "latency", F.col("healthy").alias("served"))
    met = servers.join(m, F.col("server") == F.col("s"), "left")
    return met.select(
        "server", "active_connections", "max_connections", F.coalesce("requests", F.lit(0)).alias("requests"), "success_rate", "latency",
        F.coalesce("served", "healthy").alias("healthy"),
    )


def dispatch(strategy: str, requests: DataFrame, servers: DataFrame, start: int = 0) -> DataFrame:
    """Requests dealt by the strategy of that name; ValueError for another name. least_connections gives all of a batch to
    the server that is least busy as it arrives."""
    if strategy == "round_robin":
        return round_robin(requests, servers, start)
    if strategy == "weighted_round_robin":
        return weighted_round_robin(requests, servers, start)
    if strategy == "least_connections":
        return requests.select("id", "ts_ms").join(F.broadcast(least_connections(servers)))
    raise ValueError(f"unknown strategy {strategy!r}")


def traffic(log: DataFrame) -> DataFrame:
    """(server, requests, per_second): requests over the seconds from the first to the last of the server."""
    span = (F.max("ts_ms") - F.min("ts_ms")) / 1000
    return log.groupBy("server").agg(F.count(F.lit(1)).alias("requests"), F.round(F.count(F.lit(1)) / F.nullif(span, F.lit(0.0)), 6).alias("per_second"))


# --- queues, retries, hedges ---------------------------------------------------------------------------


def queue_order(tasks: DataFrame, levels: int | None = None) -> DataFrame:
    """tasks (priority, seq, ...) with turn, from 0: lowest priority number first, then by seq. A priority out of
    [0, levels) fails the query."""
    if levels is not None:
        bad = F.when((F.col("priority") < 0) | (F.col("priority") >= levels), F.raise_error(F.lit("priority out of range")).cast("int"))
        tasks = tasks.withColumn("priority", F.coalesce(bad, F.col("priority")))
    return positions(tasks, ["priority", "seq"], name="turn")


def dequeue(tasks: DataFrame, n: int = 1) -> DataFrame:
    """The next n tasks; none from an empty queue."""
    return tasks.orderBy("priority", "seq").limit(n)


def failed(tasks: DataFrame) -> DataFrame:
    """The failed tasks, first in, first out."""
    return tasks.where("status = 'failed'").orderBy("seq")


def latest_results(results: DataFrame, keep: int, by: list[str]) -> DataFrame:
    """The last `keep` results (by completed_at, then seq) of each group."""
    w = Window.partitionBy(*by).orderBy(F.desc("completed_at"), F.desc("seq"))
    return results.withColumn("gm_r", F.row_number().over(w)).where(F.col("gm_r") <= keep).drop("gm_r")


def last_result(results: DataFrame, by: list[str]) -> DataFrame:
    return results.groupBy(*by).agg(F.max_by("result", F.struct("completed_at", "seq")).alias("result"))


def retry_schedule(jobs: DataFrame, max_retries: int, delay: float = 1.0, exponential: bool = True) -> DataFrame:
    """(job, attempt, delay, at): attempt 0 at once, then up to max_retries more, each after delay, doubling."""
    k = F.explode(F.sequence(F.lit(0), F.lit(max_retries)))
    wait = F.when(F.col("attempt") == 0, 0.0).otherwise(F.lit(float(delay)) * (F.pow(F.lit(2.0), F.col("attempt") - 1) if exponential else F.lit(1.0)))
    at = F.lit(float(delay)) * ((F.pow(F.lit(2.0), F.col("attempt")) - 1) if exponential else F.col("attempt"))
    return jobs.select("job", k.alias("attempt")).select("job", "attempt", wait.alias("delay"), at.alias("at"))


def retried(attempts: DataFrame, max_retries: int, retryable: list[str]) -> DataFrame:
    """(job, attempts, ok): of logged attempts (job, attempt, ok, error) those that a retry rule would make: up to the first
    success, the first error that is not retryable, or max_retries + 1."""
    stop = F.col("ok") | ~F.coalesce(F.col("error").isin(retryable), F.lit(False))
    w = Window.partitionBy("job").orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)
    made = attempts.where(F.col("attempt") <= max_retries).withColumn("stopped", F.coalesce(F.max(stop).over(w), F.lit(False))).where("NOT stopped")
    return made.groupBy("job").agg(F.count(F.lit(1)).alias("attempts"), F.bool_or("ok").alias("ok"))


def timed(calls: DataFrame, limit: float | None, fallback: Column) -> DataFrame:
    """calls (elapsed, result) with timed_out, and the fallback as the result of those over the limit; None: no limit."""
    late = F.col("elapsed") > limit if limit is not None else F.lit(False)
    return calls.withColumn("timed_out", late).withColumn("result", F.when(F.col("timed_out"), fallback).otherwise(F.col("result")))


def hedged(calls: DataFrame, delay: float) -> DataFrame:
    """calls (t1, t2) with elapsed and winner: the second request leaves after delay if the first is not back. ValueError
    unless delay is positive."""
    if delay <= 0:
        raise ValueError("delay must be positive")
    second = (F.col("t1") > delay) & (F.col("t2") + delay < F.col("t1"))
    return calls.withColumns({"elapsed": F.least("t1", F.col("t2") + delay), "winner": F.when(second, 2).otherwise(1), "sent": F.when(F.col("t1") > delay, 2).otherwise(1)})


# --- histories, events, idempotency ----------------------------------------------------------------------


class History:
    """Undo and redo stacks, the oldest state dropped at capacity."""

    def __init__(self, capacity: int = 128, edit: Callable | None = None):
        self.undo, self.redo, self.state = deque(maxlen=capacity), deque(maxlen=capacity), None
        self.edit, self.evicted = edit or (lambda state: state), False

    def apply(self, op: str, state, n: int | None = None) -> None:
        """save takes edit(state) as the state and pushes it; replace starts anew from state, unedited; undo_n undoes n
        times, IndexError beyond what is saved. The first undo after a save that dropped a state leaves the state as it is."""
        if op == "save":
            self.evicted = len(self.undo) == self.undo.maxlen
            self.state = self.edit(state)
            self.undo.append(self.state)
            self.redo.clear()
        elif op == "undo" and self.undo:
            self.redo.append(self.undo.pop())
            if self.undo and not self.evicted:
                self.state = self.undo[-1]
            self.evicted = False
        elif op == "undo_n":
            if not 0 <= (n or 0) <= len(self.undo):
                raise IndexError(f"cannot undo {n} of {len(self.undo)} states")
            for _ in range(n or 0):
                self.apply("undo", None)
        elif op == "redo" and self.redo:
            self.undo.append(self.redo.pop())
            self.state, self.evicted = self.undo[-1], False
        elif op == "replace":
            self.undo.clear()
            self.redo.clear()
            self.state, self.evicted = state, False


def history(commands: DataFrame, capacity: int = 128, edit: Callable | None = None) -> DataFrame:
    """(key, seq, op, state_after, n_undo, n_redo) of commands (key, seq, op, state, and n for undo_n): op save, undo,
    undo_n, redo or replace. edit: what a state goes through when it is set, but not when it is restored."""

    def step(h: History, row: dict) -> dict:
        h.apply(row["op"], row["state"], row.get("n"))
        return {"state_after": h.state, "n_undo": len(h.undo), "n_redo": len(h.redo)}

    kind = commands.schema["key"].dataType.simpleString()
    return fold(commands, ["key"], ["seq"], f"key {kind}, seq bigint, op string, state_after string, n_undo int, n_redo int", lambda: History(capacity, edit), step)


def retained(versions: DataFrame, capacity: int = 128) -> DataFrame:
    """The last `capacity` versions (key, seq, ...) of each key."""
    w = Window.partitionBy("key").orderBy(F.desc("seq"))
    return versions.withColumn("gm_r", F.row_number().over(w)).where(F.col("gm_r") <= capacity).drop("gm_r")


def topic_fifo(events: DataFrame) -> DataFrame:
    """events (seq, name, action) with turn, the place in the queue of their name, and place, that in the queue of all, from 1."""
    named = positions(events, ["seq"], ["name"], "gm_turn")
    every = positions(named, ["seq"], name="gm_place")
    return every.select(*events.columns, (F.col("gm_turn") + 1).cast("int").alias("turn"), (F.col("gm_place") + 1).alias("place"))


def idempotent_first(calls: DataFrame) -> DataFrame:
    """(key, ts, result) of each key's first call (key, ts, id, result): later calls get this result."""
    return calls.groupBy("key").agg(F.min(F.struct("ts", "id", "result")).alias("c")).select("key", "c.ts", "c.result")


def http_key(method: str, path: str, body: str, user: str) -> Column:
    return F.sha2(F.concat_ws("|", F.col(method), F.col(path), F.coalesce(F.col(body), F.lit("")), F.coalesce(F.col(user), F.lit(""))), 256)
