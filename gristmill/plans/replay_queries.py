"""Queries over limiters, breakers, balancers, queues, histories, elections, districts and pixels, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.operators import elections, pixels, replay
from gristmill.sources.tables import servers_from_config, table

MS = "timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"
BLACK = [7, 11]


def _events(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("key"), F.expr(MS).alias("ts_ms"), F.col("event_id").alias("id"))


# --- limiters ----------------------------------------------------------------------------------------


def fixed_window_decisions(spark, d):
    return replay.fixed_window(_events(spark, d), "hour", 1, BLACK)


def fixed_window_reset(spark, d):
    out = replay.until_reset(replay.fixed_window(_events(spark, d), "day", 2), "day")
    return out.select("id", "anchor", "allowed", "reset_ms")


def limiter_metrics(spark, d):
    return replay.limiter_metrics(replay.fixed_window(_events(spark, d), "day", 1, BLACK))


def bad_actors(spark, d):
    return replay.bad_actors(limiter_metrics(spark, d))


def sliding_window_decisions(spark, d):
    return replay.sliding_window(_events(spark, d), "hour", 2, 20, BLACK).drop("blacklisted")


def sliding_metrics(spark, d):
    return replay.limiter_metrics(replay.sliding_window(_events(spark, d), "hour", 2, 20, BLACK), blacklisted=False)


_E = "e AS (SELECT user_id AS key, (epoch_us(ts) // 1000) AS ts_ms, event_id AS id FROM events)"


def _fixed(length: int, limit: int, black: list) -> str:
    good = f"WHERE key NOT IN ({', '.join(map(str, black))})" if black else ""
    bad = f"UNION ALL SELECT key, ts_ms, id, true, NULL, false, NULL FROM e WHERE key IN ({', '.join(map(str, black))})" if black else ""
    return f"""{_E}, good AS (SELECT * FROM e {good}),
a(anchor) AS (SELECT min(ts_ms) FROM good UNION ALL SELECT (SELECT min(ts_ms) FROM good WHERE ts_ms > a.anchor + {length}) FROM a WHERE a.anchor IS NOT NULL),
m AS (SELECT good.*, a.anchor FROM good ASOF JOIN (SELECT * FROM a WHERE anchor IS NOT NULL) a ON good.ts_ms >= a.anchor),
r AS (SELECT *, row_number() OVER (PARTITION BY anchor, key ORDER BY ts_ms, id) AS k FROM m),
d AS (SELECT key, ts_ms, id, false AS blacklisted, anchor, k <= {limit} AS allowed, greatest(0, {limit} - k)::INT AS remaining FROM r {bad})"""


def _sliding(length: int, limit: int, black: list) -> str:
    return f"""{_E}, good AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts_ms, id) AS k FROM e WHERE key NOT IN ({', '.join(map(str, black))})),
s(key, k, ts_ms, id, kept, allowed) AS (SELECT key, k, ts_ms, id, [ts_ms], true FROM good WHERE k = 1 UNION ALL
SELECT g.key, g.k, g.ts_ms, g.id, CASE WHEN len(list_filter(s.kept, lambda x: x >= g.ts_ms - {length})) < {limit}
  THEN list_append(list_filter(s.kept, lambda x: x >= g.ts_ms - {length}), g.ts_ms) ELSE list_filter(s.kept, lambda x: x >= g.ts_ms - {length}) END,
  len(list_filter(s.kept, lambda x: x >= g.ts_ms - {length})) < {limit} FROM s JOIN good g ON g.key = s.key AND g.k = s.k + 1),
d AS (SELECT key, ts_ms, id, allowed, ({limit} - len(kept))::INT AS remaining FROM s)"""


_H = 3_600_000
_D = 24 * _H

# --- breaker -----------------------------------------------------------------------------------------

RATE, DURATION, PROBES = 0.3, 100_000, 2


def _calls(spark, d):
    return table(spark, d, "events").select(
        F.col("user_id").alias("key"), F.expr(f"{MS} div 1000").alias("ts_s"), F.col("event_id").alias("id"), (F.col("event_type") != "error").alias("ok")
    )


def breaker_trace(spark, d):
    return replay.breaker(_calls(spark, d), RATE, DURATION, PROBES).select("key", "id", "executed", "state")


def breaker_metrics(spark, d):
    return replay.breaker_metrics(replay.breaker(_calls(spark, d), RATE, DURATION, PROBES))


def breaker_fallback(spark, d):
    values = table(spark, d, "events").select(F.col("event_id").alias("eid"), F.round("value", 2).alias("value"))
    trace = replay.breaker(_calls(spark, d), RATE, DURATION, PROBES).join(values, F.col("id") == F.col("eid"))
    return replay.with_fallback(trace, "value", F.lit(-1.0)).select("id", "value")


_OPENS = f"b.state = 'closed' AND b.total > 0 AND round_even(b.err::DOUBLE / b.total, 4) >= {RATE}"
_WAITS = f"b.state = 'open' AND c.ts_s - b.opened < {DURATION}"
_DECIDES = f"b.state = 'half_open' AND b.pt >= {PROBES}"
_BAD = f"b.pe::DOUBLE / b.pt > {RATE}"
_STATE = f"""CASE WHEN {_OPENS} THEN 'open' WHEN {_WAITS} THEN 'open' WHEN b.state = 'open' THEN 'half_open'
 WHEN {_DECIDES} THEN CASE WHEN {_BAD} THEN 'open' ELSE 'closed' END ELSE b.state END"""
_RUNS = f"NOT (({_OPENS}) OR ({_WAITS}) OR ({_DECIDES} AND {_BAD}))"
_BREAKER = f"""c AS (SELECT user_id AS key, (epoch_us(ts) // 1000) // 1000 AS ts_s, event_id AS id, event_type <> 'error' AS ok, round(value, 2) AS value,
  row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000) // 1000, event_id) AS k FROM events),
b(key, k, id, ts_s, ok, value, state, err, total, pe, pt, opened, executed) AS (
 SELECT key, k, id, ts_s, ok, value, 'closed', CASE WHEN ok THEN 0 ELSE 1 END, 1, 0, 0, 0::BIGINT, true FROM c WHERE k = 1
 UNION ALL SELECT c.key, c.k, c.id, c.ts_s, c.ok, c.value, {_STATE},
  CASE WHEN {_OPENS} THEN b.err WHEN b.state = 'closed' THEN b.err + (NOT c.ok)::INT WHEN {_DECIDES} AND NOT {_BAD} THEN (NOT c.ok)::INT ELSE b.err END,
  CASE WHEN {_OPENS} THEN b.total WHEN b.state = 'closed' THEN b.total + 1 WHEN {_DECIDES} AND NOT {_BAD} THEN 1 ELSE b.total END,
  CASE WHEN b.state = 'open' AND NOT ({_WAITS}) THEN (NOT c.ok)::INT WHEN b.state = 'half_open' AND NOT ({_DECIDES}) THEN b.pe + (NOT c.ok)::INT ELSE b.pe END,
  CASE WHEN b.state = 'open' AND NOT ({_WAITS}) THEN 1 WHEN b.state = 'half_open' AND NOT ({_DECIDES}) THEN b.pt + 1 ELSE b.pt END,
  CASE WHEN ({_OPENS}) OR ({_DECIDES} AND {_BAD}) THEN c.ts_s ELSE b.opened END, {_RUNS}
 FROM b JOIN c ON c.key = b.key AND c.k = b.k + 1)"""

# --- balancers ---------------------------------------------------------------------------------------


def _servers(spark, d):
    return table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("ord"), F.col("s_name").alias("server"), (F.col("s_suppkey") % 5 != 0).alias("healthy"),
        (F.col("s_suppkey") % 4).cast("int").alias("active_connections"), F.when(F.col("s_suppkey") == 3, 3).otherwise(100).alias("max_connections"),
        (F.col("s_suppkey") % 3 + 2).cast("int").alias("weight"),
    )


def _requests(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.expr(MS).alias("ts_ms"))


def _log(spark, d):
    return table(spark, d, "events").select(
        F.col("event_type").alias("pool"), F.col("event_id").alias("id"), F.expr(MS).alias("ts_ms"), (F.col("user_id") % 10).alias("server"),
        F.floor("value").cast("bigint").alias("elapsed"), (F.col("event_type") != "error").alias("ok"),
    )


def assign_round_robin(spark, d):
    return replay.round_robin(_requests(spark, d), _servers(spark, d), 2)


def assign_weighted(spark, d):
    return replay.weighted_round_robin(_requests(spark, d), _servers(spark, d))


def assign_least_conn(spark, d):
    return replay.least_connections(_servers(spark, d))


def replay_least_conn(spark, d):
    rows = table(spark, d, "events").select(
        F.col("event_type").alias("pool"), F.col("event_id").alias("id"), F.expr(MS).alias("ts_ms"), (F.floor("value") * 60_000).cast("bigint").alias("hold_ms")
    )
    return replay.replay_least_connections(rows, [("a", 4), ("b", 4), ("c", 2)])


def assign_least_time(spark, d):
    return replay.least_time(_log(spark, d)).select("pool", "id", "average", "best")


def server_health(spark, d):
    servers = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("server"), (F.col("s_suppkey") % 4).cast("int").alias("active_connections"), F.lit(100).alias("max_connections"),
        (F.col("s_suppkey") % 5 != 0).alias("healthy"),
    )
    return replay.health_report(servers, _log(spark, d)).select("server", "active_connections", "requests", "success_rate", "healthy")


def dispatch_by_name(spark, d):
    return replay.dispatch("least_connections", _requests(spark, d), _servers(spark, d))


def next_in_turn(spark, d):
    """The turn after each supplier's, of all of them."""
    n = table(spark, d, "supplier").count()
    return spark.createDataFrame([(i, replay.next_in_turn(i, n)) for i in range(n)], "turn long, next long")


def configured_servers(spark, d):
    config = {"strategy": "least_time", "servers": [{"name": "a", "url": "http://a", "weight": 3}, {"name": "b", "url": "http://b", "healthy": False, "max_connections": 7}]}
    return servers_from_config(spark, config).select("name", "url", "active_connections", "healthy", "weight", "max_connections", "metadata.total_requests")


def _tried(spark, calls):
    """(rule, arguments, ok): whether a constructor takes its arguments."""

    def ok(f, args):
        try:
            f(*args)
        except (ValueError, AssertionError):
            return False
        return True

    return spark.createDataFrame([(name, str(args), ok(f, args)) for name, f, *args in calls], "rule string, arguments string, ok boolean")


def validated_limits(spark, d):
    rows = [("second", 1, 1), ("year", 1, 1), ("hour", 0, 1), ("hour", 1, 0), ("day", 3, 10**7), ("day", 3, 10**7 + 1)]
    return _tried(spark, [("limit", replay._limit, *r) for r in rows])


def validated_breakers(spark, d):
    rows = [(0.5, 1, 1), (0.0, 1, 1), (1.0, 1, 1), (1.1, 1, 1), (0.5, 0, 1), (0.5, 1, 0)]
    return _tried(spark, [("breaker", replay.Breaker, *r) for r in rows])


def validated_thresholds(spark, d):
    one = spark.createDataFrame([(0, 0, 0, 1, 2, 3)], "image_id int, y int, x int, r int, g int, b int")
    return _tried(spark, [("threshold", lambda t: pixels.threshold(one, t), t) for t in (-1, 0, 255, 256, True, 1.5)])


def server_metrics(spark, d):
    return replay.server_metrics(_log(spark, d))


def server_traffic(spark, d):
    return replay.traffic(_log(spark, d))


_SERVERS = """sv AS (SELECT s_suppkey AS ord, s_name AS server, (s_suppkey % 4)::INT AS active, (s_suppkey % 3 + 2)::INT AS weight FROM supplier
 WHERE s_suppkey % 5 <> 0 AND s_suppkey % 4 < CASE WHEN s_suppkey = 3 THEN 3 ELSE 100 END)"""
_TURNS = "q AS (SELECT event_id AS id, (epoch_us(ts) // 1000) AS ts_ms, row_number() OVER (ORDER BY ts, event_id) - 1 AS k FROM events)"
_LOG = "l AS (SELECT event_type AS pool, event_id AS id, (epoch_us(ts) // 1000) AS ts_ms, user_id % 10 AS server, floor(value)::BIGINT AS elapsed, event_type <> 'error' AS ok FROM events)"

# --- queues, retries, histories ----------------------------------------------------------------------


def _tasks(spark, d):
    return table(spark, d, "orders").select(
        F.left("o_orderpriority", F.lit(1)).cast("int").alias("priority"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("done").alias("status")
    )


def queue_order(spark, d):
    return replay.queue_order(_tasks(spark, d), 10).select("priority", "seq", "turn")


def queue_next(spark, d):
    return replay.dequeue(_tasks(spark, d), 5).select("priority", "seq")


def queue_failed(spark, d):
    return replay.failed(_tasks(spark, d)).select("seq")


def _results(spark, d):
    return table(spark, d, "events").select(
        "event_type", F.col("ts").alias("completed_at"), F.col("event_id").alias("seq"), F.concat(F.lit("r"), "event_id").alias("result")
    )


def latest_results(spark, d):
    return replay.latest_results(_results(spark, d), 3, ["event_type"]).select("event_type", "seq")


def last_result(spark, d):
    return replay.last_result(_results(spark, d), ["event_type"])


def retry_schedule(spark, d):
    return replay.retry_schedule(table(spark, d, "region").select(F.col("r_regionkey").alias("job")), 5, 0.5)


def retry_log(spark, d):
    x = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("job"), (F.col("l_linenumber") - 1).alias("attempt"), (F.col("l_quantity") > 40).alias("ok"),
        F.when(F.col("l_quantity") < 10, "fatal").otherwise("timeout").alias("error"),
    )
    x = x.groupBy("job", "attempt").agg(F.bool_or("ok").alias("ok"), F.min("error").alias("error"))
    return replay.retried(x, 3, ["timeout"])


def timeout_log(spark, d):
    x = table(spark, d, "events").select("event_id", F.round("value", 2).alias("elapsed"), F.col("event_type").alias("result"))
    return replay.timed(x, 50.0, F.lit("fallback")).select("event_id", "timed_out", "result")


def hedge_log(spark, d):
    x = table(spark, d, "events").select("event_id", F.floor("value").cast("double").alias("t1"), (F.col("user_id") % 30).cast("double").alias("t2"))
    return replay.hedged(x, 20.0)


def _commands(spark, d):
    op = F.when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "view", "redo").otherwise("save")
    return table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), op.alias("op"), F.concat(F.lit("s"), "event_id").alias("state"))


def undo_redo(spark, d):
    return replay.history(_commands(spark, d), 4)


def version_retention(spark, d):
    return replay.retained(_commands(spark, d).where("op = 'save'"), 5).select("key", "seq")


def topic_fifo(spark, d):
    x = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("name"), F.col("props").alias("action"))
    return replay.topic_fifo(x).select("seq", "name", "turn", "place")


def idempotent_first(spark, d):
    x = table(spark, d, "events").select(F.expr("user_id * 10 + event_id % 10").alias("key"), F.expr(MS).alias("ts"), F.col("event_id").alias("id"), F.col("event_type").alias("result"))
    return replay.idempotent_first(x)


def http_keys(spark, d):
    x = table(spark, d, "pages").select("page_id", F.lit("GET").alias("m"), F.col("url").alias("u"), F.lit(None).cast("string").alias("b"), F.lit("me").alias("w"))
    return x.select("page_id", replay.http_key("m", "u", "b", "w").alias("key"))


# --- elections and districts -------------------------------------------------------------------------

TYPES = ["click", "error", "purchase", "signup", "view"]


def _ballots(spark, d):
    """A ballot for each user: event types by how often the user has them, then by name."""
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "event_type")))
    return n.groupBy(F.col("user_id").alias("ballot_id")).agg(F.transform(ranked, lambda x: x["event_type"]).alias("prefs"))


def plurality(spark, d):
    return elections.plurality(_ballots(spark, d))


def approval(spark, d):
    return elections.approval(_ballots(spark, d).withColumn("prefs", F.slice("prefs", 1, 2)))


def approval_running(spark, d):
    return elections.running_counts(_ballots(spark, d).withColumn("prefs", F.slice("prefs", 1, 2)))


def borda(spark, d):
    return elections.borda(_ballots(spark, d)).select("candidate", "points")


def borda_points(spark, d):
    full = _ballots(spark, d).where(F.size("prefs") == 5)
    return elections.borda_winner(full, [10, 5, 3, 1, 0])


def condorcet_pairs(spark, d):
    return elections.pairwise(_ballots(spark, d), TYPES)


def condorcet(spark, d):
    return elections.condorcet(_ballots(spark, d), TYPES)


def ranked_choice(spark, d):
    return elections.ranked_choice(_ballots(spark, d), TYPES).where("winner OR eliminated").select("round", "candidate", "votes", "winner")


_BALLOTS = """n AS (SELECT user_id AS ballot, event_type AS c, count(*) AS n FROM events GROUP BY ALL),
v AS (SELECT ballot, c, row_number() OVER (PARTITION BY ballot ORDER BY n DESC, c) - 1 AS pos, count(*) OVER (PARTITION BY ballot) AS size FROM n)"""


def _rcv() -> str:
    """Each round over the candidates of the last, unrolled for five."""
    parts = ["l1 AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS c)"]
    for k in range(1, 6):
        parts.append(
            f"f{k} AS (SELECT min_by(v.c, pos) AS c FROM v JOIN l{k} ON v.c = l{k}.c GROUP BY ballot), t{k} AS (SELECT l{k}.c, count(f{k}.c) AS n FROM l{k} LEFT JOIN f{k} ON l{k}.c = f{k}.c GROUP BY 1), "
            f"w{k} AS (SELECT c FROM t{k} WHERE 2 * n > (SELECT sum(n) FROM t{k}) OR (SELECT count(*) FROM t{k}) = 1), "
            f"o{k} AS (SELECT c FROM t{k} WHERE NOT EXISTS (FROM w{k}) ORDER BY n, c DESC LIMIT 1), "
            f"l{k + 1} AS (SELECT c FROM l{k} WHERE NOT EXISTS (FROM w{k}) AND c NOT IN (SELECT c FROM o{k}))"
        )
    rows = " UNION ALL ".join(f"SELECT {k}::INT AS round, c AS candidate, n AS votes, c IN (FROM w{k}) AS winner FROM t{k} WHERE c IN (FROM w{k}) OR c IN (FROM o{k})" for k in range(1, 6))
    return ", ".join(parts) + " " + rows


def compactness(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("s"), F.col("p_retailprice").alias("c"))
    return p.select(
        "p_partkey",
        F.round(elections.polsby_popper(F.col("s"), F.col("c")), 9).alias("polsby_popper"),
        F.round(elections.reock(F.col("s"), F.col("c")), 9).alias("reock"),
        F.round(elections.population_hull(F.col("s"), F.col("c") + 1), 9).alias("hull"),
    )


# --- pixels ------------------------------------------------------------------------------------------


def _pixels(spark, d):
    """1,000 images of all lines: a row of pixels for each line number, a column for each thousand orders; channels from the line's numbers."""
    x = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 1000).alias("image_id"), (F.col("l_linenumber") - 1).alias("y"), F.expr("cast(l_orderkey div 1000 as int)").alias("x"))
    return x.agg(*[F.max(e).cast("int").alias(c) for c, e in (("r", F.col("l_partkey") % 256), ("g", F.col("l_suppkey") * 7 % 256), ("b", F.col("l_orderkey") * 31 % 256))])


_PX = """px AS (SELECT l_orderkey % 1000 AS image_id, l_linenumber - 1 AS y, (l_orderkey // 1000)::INT AS x, max(l_partkey % 256)::INT AS r,
 max(l_suppkey * 7 % 256)::INT AS g, max(l_orderkey * 31 % 256)::INT AS b FROM lineitem GROUP BY ALL)"""


def _px_sql(f: str) -> str:
    return f"WITH {_PX} SELECT image_id, y, x, " + ", ".join(f"({f.replace('$', c)})::INT AS {c}" for c in "rgb") + " FROM px"


def threshold_simple(spark, d):
    return pixels.threshold(pixels.checked(_pixels(spark, d)), 128)


def threshold_inverted(spark, d):
    return pixels.threshold(_pixels(spark, d), 100, True)


def threshold_truncate(spark, d):
    return pixels.truncate(_pixels(spark, d), 150)


def threshold_to_zero(spark, d):
    return pixels.to_zero(_pixels(spark, d), 90)


def nn_upscale(spark, d):
    return pixels.upscale(_pixels(spark, d), 3)


def flip_vertical(spark, d):
    return pixels.flip(_pixels(spark, d), "vertical")


def flip_horizontal(spark, d):
    return pixels.flip(_pixels(spark, d), "horizontal")


def rotate(spark, d):
    return pixels.rotate(_pixels(spark, d))


def rgb_to_hsv(spark, d):
    out = pixels.to_hsv(_pixels(spark, d))
    return out.select("image_id", "y", "x", *[F.round(c, 6).alias(c) for c in "hsv"])


def _grey(method):
    def query(spark, d):
        return pixels.greyscale(_pixels(spark, d), method).withColumn("grey", F.round("grey", 6))

    query.__name__ = f"greyscale_{method}"
    return query


def brightness(spark, d):
    return pixels.brightness(_pixels(spark, d), 40)


def gamma(spark, d):
    return pixels.gamma(_pixels(spark, d), 2.0)


def pixel_histogram(spark, d):
    return pixels.histogram(_pixels(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        fixed_window_decisions, fixed_window_reset, limiter_metrics, bad_actors, sliding_window_decisions, sliding_metrics, breaker_trace,
        breaker_metrics, breaker_fallback, assign_round_robin, assign_weighted, assign_least_conn, replay_least_conn, assign_least_time,
        server_metrics, server_health, dispatch_by_name, next_in_turn, configured_servers, validated_limits, validated_breakers, validated_thresholds, server_traffic, queue_order, queue_next, queue_failed, latest_results, last_result, retry_schedule, retry_log, timeout_log,
        hedge_log, undo_redo, version_retention, topic_fifo, idempotent_first, http_keys, plurality, approval, approval_running, borda, borda_points,
        condorcet_pairs, condorcet, ranked_choice, compactness, threshold_simple, threshold_inverted, threshold_truncate, threshold_to_zero,
        nn_upscale, flip_vertical, flip_horizontal, rotate, rgb_to_hsv, _grey("mean"), _grey("luminosity"), _grey("lightness"), _grey("maximum"),
        brightness, gamma, pixel_histogram,
    )
}

_GREY = {"mean": "(r + g + b) / 3", "luminosity": "r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE", "lightness": "(greatest(r, g, b) + least(r, g, b)) / 2", "maximum": "greatest(r, g, b)::DOUBLE"}
ORACLE = {
    "fixed_window_decisions": "WITH RECURSIVE " + _fixed(_H, 1, BLACK) + " SELECT * FROM d",
    "fixed_window_reset": "WITH RECURSIVE " + _fixed(_D, 2, []) + f" SELECT id, anchor, allowed, anchor + {_D} - ts_ms AS reset_ms FROM d",
    "limiter_metrics": "WITH RECURSIVE " + _fixed(_D, 1, BLACK) + " SELECT key, count(*) FILTER (allowed) AS allowed, count(*) FILTER (NOT allowed) AS denied FROM d GROUP BY 1",
    "bad_actors": "WITH RECURSIVE " + _fixed(_D, 1, BLACK) + " SELECT key FROM d GROUP BY 1 HAVING count(*) FILTER (NOT allowed) > count(*) FILTER (allowed)",
    "sliding_window_decisions": "WITH RECURSIVE " + _sliding(20 * _H, 2, BLACK) + f" SELECT * FROM d UNION ALL SELECT key, ts_ms, id, false, NULL FROM e WHERE key IN ({', '.join(map(str, BLACK))})",
    "sliding_metrics": "WITH RECURSIVE " + _sliding(20 * _H, 2, BLACK) + " SELECT key, count(*) FILTER (allowed) AS allowed, count(*) FILTER (NOT allowed) AS denied FROM d GROUP BY 1",
    "breaker_trace": f"WITH RECURSIVE {_BREAKER} SELECT key, id, executed, state FROM b",
    "breaker_metrics": f"""WITH RECURSIVE {_BREAKER} SELECT key, count(*) AS calls, count(*) FILTER (executed) AS executed, count(*) FILTER (NOT executed) AS rejected,
 count(*) FILTER (executed AND NOT ok) AS failed, max_by(state, k) AS last_state FROM b GROUP BY 1""",
    "breaker_fallback": f"WITH RECURSIVE {_BREAKER} SELECT id, CASE WHEN executed AND ok THEN value ELSE -1.0 END AS value FROM b",
    "assign_round_robin": f"WITH {_SERVERS}, s AS (SELECT server, row_number() OVER (ORDER BY ord) - 1 AS slot, count(*) OVER () AS n FROM sv), {_TURNS} SELECT id, ts_ms, server FROM q JOIN s ON (k + 2) % n = slot",
    "assign_weighted": f"""WITH {_SERVERS}, x AS (SELECT ord, server, unnest(range((weight // (SELECT min(weight) FROM sv))::BIGINT)) AS j FROM sv),
s AS (SELECT server, row_number() OVER (ORDER BY ord, j) - 1 AS slot, count(*) OVER () AS n FROM x), {_TURNS} SELECT id, ts_ms, server FROM q JOIN s ON k % n = slot""",
    "assign_least_conn": f"WITH {_SERVERS} SELECT server FROM sv ORDER BY active, ord LIMIT 1",
    "assign_least_time": f"""WITH {_LOG}, a AS (SELECT *, round(sum(elapsed) OVER w / count(*) OVER w, 5) AS average FROM l
 WINDOW w AS (PARTITION BY pool, server ORDER BY ts_ms, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT pool, id, average, (min((average, ts_ms, id, server)) OVER (PARTITION BY pool ORDER BY ts_ms, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))[4] AS best FROM a""",
    "server_metrics": f"""WITH {_LOG} SELECT server, count(*) AS requests, count(*) FILTER (ok) AS success, count(*) FILTER (NOT ok) AS failure,
 round_even(count(*) FILTER (ok) / count(*), 5) AS success_rate, round_even(sum(elapsed) / count(*), 5) AS latency, count(*) FILTER (ok) / count(*) > 0.5 AS healthy FROM l GROUP BY 1""",
    "server_traffic": f"WITH {_LOG} SELECT server, count(*) AS requests, round(count(*) / nullif((max(ts_ms) - min(ts_ms)) / 1000, 0), 6) AS per_second FROM l GROUP BY 1",
    "queue_order": "SELECT left(o_orderpriority, 1)::INT AS priority, o_orderkey AS seq, row_number() OVER (ORDER BY left(o_orderpriority, 1)::INT, o_orderkey) - 1 AS turn FROM orders",
    "queue_next": "SELECT left(o_orderpriority, 1)::INT AS priority, o_orderkey AS seq FROM orders ORDER BY 1, 2 LIMIT 5",
    "queue_failed": "SELECT o_orderkey AS seq FROM orders WHERE o_orderstatus = 'F'",
    "latest_results": "SELECT event_type, event_id AS seq FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 3",
    "last_result": "SELECT event_type, 'r' || arg_max(event_id, (ts, event_id)) AS result FROM events GROUP BY 1",
    "retry_schedule": "SELECT r_regionkey AS job, a::INT AS attempt, CASE WHEN a = 0 THEN 0.0 ELSE 0.5 * pow(2, a - 1) END AS delay, 0.5 * (pow(2, a) - 1) AS at FROM region, range(6) t(a)",
    "retry_log": """WITH x AS (SELECT l_orderkey AS job, l_linenumber - 1 AS attempt, bool_or(l_quantity > 40) AS ok, min(CASE WHEN l_quantity < 10 THEN 'fatal' ELSE 'timeout' END) AS error FROM lineitem GROUP BY ALL),
y AS (SELECT *, coalesce(max(ok OR error <> 'timeout') OVER (PARTITION BY job ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stopped FROM x WHERE attempt <= 3)
SELECT job, count(*) AS attempts, bool_or(ok) AS ok FROM y WHERE NOT stopped GROUP BY 1""",
    "timeout_log": "SELECT event_id, round(value, 2) > 50 AS timed_out, CASE WHEN round(value, 2) > 50 THEN 'fallback' ELSE event_type END AS result FROM events",
    "hedge_log": """WITH x AS (SELECT event_id, floor(value) AS t1, (user_id % 30)::DOUBLE AS t2 FROM events) SELECT *, least(t1, t2 + 20) AS elapsed,
 CASE WHEN t1 > 20 AND t2 + 20 < t1 THEN 2 ELSE 1 END AS winner, CASE WHEN t1 > 20 THEN 2 ELSE 1 END AS sent FROM x""",
    "undo_redo": """WITH RECURSIVE c AS (SELECT user_id AS key, event_id AS seq, CASE event_type WHEN 'error' THEN 'undo' WHEN 'view' THEN 'redo' ELSE 'save' END AS op, 's' || event_id AS state,
 row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
h(key, k, seq, op, u, r, s, p) AS (SELECT key, 0::BIGINT, 0::BIGINT, '', []::VARCHAR[], []::VARCHAR[], NULL::VARCHAR, false FROM c WHERE k = 1 UNION ALL
SELECT c.key, c.k, c.seq, c.op,
 CASE c.op WHEN 'save' THEN list_append(h.u, c.state)[-4:] WHEN 'undo' THEN h.u[:-2] ELSE CASE WHEN len(h.r) > 0 THEN list_append(h.u, h.r[-1])[-4:] ELSE h.u END END,
 CASE c.op WHEN 'save' THEN []::VARCHAR[] WHEN 'undo' THEN CASE WHEN len(h.u) > 0 THEN list_append(h.r, h.u[-1])[-4:] ELSE h.r END ELSE h.r[:-2] END,
 CASE c.op WHEN 'save' THEN c.state WHEN 'undo' THEN CASE WHEN len(h.u) > 1 AND NOT h.p THEN h.u[-2] ELSE h.s END ELSE CASE WHEN len(h.r) > 0 THEN h.r[-1] ELSE h.s END END,
 CASE c.op WHEN 'save' THEN len(h.u) >= 4 WHEN 'undo' THEN len(h.u) = 0 AND h.p ELSE len(h.r) = 0 AND h.p END
FROM h JOIN c ON c.key = h.key AND c.k = h.k + 1)
SELECT key, seq, op, s AS state_after, len(u)::INT AS n_undo, len(r)::INT AS n_redo FROM h WHERE k > 0""",
    "version_retention": "SELECT user_id AS key, event_id AS seq FROM events WHERE event_type NOT IN ('error', 'view') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5",
    "topic_fifo": "SELECT event_id AS seq, event_type AS name, row_number() OVER (PARTITION BY event_type ORDER BY event_id)::INT AS turn, row_number() OVER (ORDER BY event_id) AS place FROM events",
    "idempotent_first": "SELECT user_id * 10 + event_id % 10 AS key, min((epoch_us(ts) // 1000)) AS ts, arg_min(event_type, (ts, event_id)) AS result FROM events GROUP BY 1",
    "http_keys": "SELECT page_id, sha256('GET|' || url || '||me') AS key FROM pages",
    "plurality": f"WITH {_BALLOTS} SELECT c AS winner, count(*) AS votes FROM v WHERE pos = 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1",
    "approval": f"WITH {_BALLOTS}, s AS (SELECT c, row_number() OVER (ORDER BY ballot, pos) AS k FROM v WHERE pos < 2) SELECT c AS winner, count(*) AS votes FROM s GROUP BY 1 ORDER BY 2 DESC, max(k) LIMIT 1",
    "approval_running": f"WITH {_BALLOTS} SELECT ballot AS ballot_id, pos::INT AS pos, c AS candidate, row_number() OVER (PARTITION BY c ORDER BY ballot, pos) AS so_far FROM v WHERE pos < 2",
    "borda": f"WITH {_BALLOTS} SELECT c AS candidate, sum(size - 1 - pos)::BIGINT AS points FROM v GROUP BY 1",
    "borda_points": f"WITH {_BALLOTS} SELECT c AS winner, sum([10, 5, 3, 1, 0][pos + 1])::BIGINT AS points FROM v WHERE size = 5 GROUP BY 1 ORDER BY 2 DESC, min((ballot, pos)) LIMIT 1",
    "condorcet_pairs": f"""WITH {_BALLOTS}, l AS (SELECT unnest({TYPES}) AS c), p AS (SELECT x.c AS a, y.c AS b FROM l x JOIN l y ON x.c <> y.c),
u AS (SELECT DISTINCT ballot FROM v), m AS (SELECT a, b, coalesce(va.pos, 1000000) AS pa, coalesce(vb.pos, 1000000) AS pb FROM p CROSS JOIN u LEFT JOIN v va ON va.ballot = u.ballot AND va.c = a LEFT JOIN v vb ON vb.ballot = u.ballot AND vb.c = b)
SELECT a, b, count(*) FILTER (pa < pb) AS a_votes, count(*) FILTER (pb < pa) AS b_votes, count(*) FILTER (pa < pb) >= count(*) FILTER (pb < pa) AS wins FROM m GROUP BY 1, 2""",
    "ranked_choice": f"WITH {_BALLOTS}, " + _rcv(),
    "compactness": "SELECT p_partkey, round(4 * pi() * p_size / pow(p_retailprice, 2), 9) AS polsby_popper, round(p_size / p_retailprice, 9) AS reock, round(p_size / (p_retailprice + 1), 9) AS hull FROM part",
    "threshold_simple": _px_sql("CASE WHEN $ >= 128 THEN 255 ELSE 0 END"),
    "threshold_inverted": _px_sql("CASE WHEN $ >= 100 THEN 0 ELSE 255 END"),
    "threshold_truncate": _px_sql("least($, 150)"),
    "threshold_to_zero": _px_sql("CASE WHEN $ <= 90 THEN 0 ELSE $ END"),
    "nn_upscale": f"WITH {_PX} SELECT image_id, (y * 3 + i)::INT AS y, (x * 3 + j)::INT AS x, r, g, b FROM px, range(3) a(i), range(3) c(j)",
    "flip_vertical": f"WITH {_PX} SELECT image_id, (max(y) OVER (PARTITION BY image_id) - y)::INT AS y, x, r, g, b FROM px",
    "flip_horizontal": f"WITH {_PX} SELECT image_id, y, (max(x) OVER (PARTITION BY image_id) - x)::INT AS x, r, g, b FROM px",
    "rotate": f"WITH {_PX} SELECT image_id, x AS y, (max(y) OVER (PARTITION BY image_id) - y)::INT AS x, r, g, b FROM px",
    "rgb_to_hsv": f"""WITH {_PX}, n AS (SELECT image_id, y, x, r / 255.0::DOUBLE AS r, g / 255.0::DOUBLE AS g, b / 255.0::DOUBLE AS b FROM px),
m AS (SELECT *, greatest(r, g, b) AS hi, greatest(r, g, b) - least(r, g, b) AS d FROM n)
SELECT image_id, y, x, round(CASE WHEN d = 0 THEN 0 WHEN hi = r THEN ((((g - b) / d) % 6) + 6) % 6 * 60 WHEN hi = g THEN ((b - r) / d + 2) * 60 ELSE ((r - g) / d + 4) * 60 END, 6) AS h,
 round(CASE WHEN hi = 0 THEN 0 ELSE d / hi END, 6) AS s, round(hi, 6) AS v FROM m""",
    **{f"greyscale_{k}": f"WITH {_PX} SELECT image_id, y, x, round({e}, 6) AS grey FROM px" for k, e in _GREY.items()},
    "brightness": _px_sql("greatest(0, least(255, $ + 40))"),
    "gamma": _px_sql("round(pow($ / 255.0::DOUBLE, 2) * 255)"),
    "pixel_histogram": f"WITH {_PX}, u AS (SELECT image_id, 'r' AS channel, r AS level FROM px UNION ALL SELECT image_id, 'g', g FROM px UNION ALL SELECT image_id, 'b', b FROM px) SELECT *, count(*) AS n FROM u GROUP BY ALL",
}
ORACLE |= {
    "server_health": f"""WITH {_LOG}, m AS (SELECT server, count(*) AS requests, round_even(count(*) FILTER (ok) / count(*), 5) AS success_rate, count(*) FILTER (ok) / count(*) > 0.5 AS served FROM l GROUP BY 1)
SELECT s_suppkey AS server, (s_suppkey % 4)::INT AS active_connections, coalesce(requests, 0) AS requests, success_rate, coalesce(served, s_suppkey % 5 <> 0) AS healthy FROM supplier LEFT JOIN m ON m.server = s_suppkey""",
    "dispatch_by_name": f"WITH {_SERVERS}, {_TURNS} SELECT id, ts_ms, (SELECT server FROM sv ORDER BY active, ord LIMIT 1) AS server FROM q",
    "next_in_turn": "SELECT range AS turn, (range + 1) % (SELECT count(*) FROM supplier) AS next FROM range((SELECT count(*) FROM supplier))",
    "configured_servers": "SELECT * FROM (VALUES ('a', 'http://a', 0, true, 3, 100, 0), ('b', 'http://b', 0, false, 1, 7, 0)) t(name, url, active_connections, healthy, weight, max_connections, total_requests)",
    "validated_limits": """SELECT 'limit' AS rule, a AS arguments, ok FROM (VALUES ('[''second'', 1, 1]', true), ('[''year'', 1, 1]', false), ('[''hour'', 0, 1]', false), ('[''hour'', 1, 0]', false),
 ('[''day'', 3, 10000000]', true), ('[''day'', 3, 10000001]', false)) t(a, ok)""",
    "validated_breakers": """SELECT 'breaker' AS rule, a AS arguments, ok FROM (VALUES ('[0.5, 1, 1]', true), ('[0.0, 1, 1]', false), ('[1.0, 1, 1]', true), ('[1.1, 1, 1]', false), ('[0.5, 0, 1]', false), ('[0.5, 1, 0]', false)) t(a, ok)""",
    "validated_thresholds": """SELECT 'threshold' AS rule, a AS arguments, ok FROM (VALUES ('[-1]', false), ('[0]', true), ('[255]', true), ('[256]', false), ('[True]', false), ('[1.5]', false)) t(a, ok)""",
    "replay_least_conn": """WITH RECURSIVE r AS (SELECT event_type AS pool, event_id AS id, epoch_us(ts) // 1000 AS ts_ms, (floor(value) * 60000)::BIGINT AS hold_ms,
  row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000, event_id) AS k FROM events),
s(pool, k, id, ts_ms, hold_ms, a, b, c, server) AS (SELECT pool, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, []::BIGINT[], []::BIGINT[], []::BIGINT[], NULL::VARCHAR FROM r WHERE k = 1 UNION ALL
SELECT pool, k, id, ts_ms, hold_ms, CASE WHEN pick = 'a' THEN list_append(a, ts_ms + hold_ms) ELSE a END, CASE WHEN pick = 'b' THEN list_append(b, ts_ms + hold_ms) ELSE b END,
 CASE WHEN pick = 'c' THEN list_append(c, ts_ms + hold_ms) ELSE c END, pick FROM (SELECT *, CASE WHEN len(a) < 4 AND (len(b) >= 4 OR len(a) <= len(b)) AND (len(c) >= 2 OR len(a) <= len(c)) THEN 'a'
  WHEN len(b) < 4 AND (len(c) >= 2 OR len(b) <= len(c)) THEN 'b' WHEN len(c) < 2 THEN 'c' END AS pick
 FROM (SELECT r.pool, r.k, r.id, r.ts_ms, r.hold_ms, list_filter(s.a, lambda x: x > r.ts_ms) AS a, list_filter(s.b, lambda x: x > r.ts_ms) AS b, list_filter(s.c, lambda x: x > r.ts_ms) AS c
  FROM s JOIN r ON r.pool = s.pool AND r.k = s.k + 1)))
SELECT pool, id, ts_ms, hold_ms, server FROM s WHERE k > 0""",
}
ORACLE["condorcet"] = f"WITH g AS ({ORACLE['condorcet_pairs']}) SELECT (SELECT a FROM g GROUP BY a HAVING bool_and(wins) ORDER BY list_position({TYPES}, a) LIMIT 1) AS winner"
