import random

import pytest
from pyspark.sql import functions as F

from gristmill.operators import replay
from gristmill.streaming import stateful


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    rng = random.Random(9)
    t, rows = 1_700_000_000_000, []
    for i in range(300):
        t += rng.choice([1, 200, 900, 3000])
        rows.append((rng.choice("abc"), t, i, rng.random() < 0.7))
    d = str(tmp_path_factory.mktemp("stream"))
    for k in range(3):  # three files, so three batches in order
        part = spark.createDataFrame(rows[k * 100 : (k + 1) * 100], "key string, ts_ms long, id long, ok boolean")
        part.withColumn("ts", F.timestamp_millis("ts_ms")).coalesce(1).write.mode("append").parquet(d)
    return rows, d


def run(spark, stream, name, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()
    return spark.table(name).collect()


def source(spark, d):
    kind = spark.read.parquet(d).schema
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(d)


def test_sliding_window_equals_the_replay(spark, log, tmp_path):
    rows, d = log
    got = {r.id: r.allowed for r in run(spark, stateful.sliding_window(source(spark, d), "second", 2, 3, "10 minutes"), "sliding", tmp_path)}
    batch = spark.createDataFrame([(k, t, i) for k, t, i, _ in rows], "key string, ts_ms long, id long")
    assert got == {r.id: r.allowed for r in replay.sliding_window(batch, "second", 2, 3).collect()}


def test_breaker_equals_the_replay(spark, log, tmp_path):
    rows, d = log
    calls = source(spark, d).withColumn("ts_s", F.expr("ts_ms div 1000"))
    got = {r.id: (r.executed, r.state) for r in run(spark, stateful.breaker(calls, 0.4, 5, 2), "breaker", tmp_path)}
    batch = spark.createDataFrame([(k, t // 1000, i, ok) for k, t, i, ok in rows], "key string, ts_s long, id long, ok boolean")
    assert got == {r.id: (r.executed, r.state) for r in replay.breaker(batch, 0.4, 5, 2).collect()}


def test_idempotent_and_aligned_windows(spark, log, tmp_path):
    rows, d = log
    got = run(spark, stateful.idempotent(source(spark, d), "10 days"), "once", tmp_path)
    assert sorted(r.key for r in got) == ["a", "b", "c"]
    stateful.aligned_window(source(spark, d), "minute", 2)


def test_routes_by_name(spark, tmp_path):
    rows = [(i, "xy"[i % 2], f"a{i}") for i in range(10)]
    spark.createDataFrame(rows, "seq long, name string, action string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("seq long, name string, action string").parquet(f"{tmp_path}/in")
    seen = {"x": [], "y": []}
    q = stateful.route(stream, {n: lambda df, n=n: seen[n].extend(r.seq for r in df.collect()) for n in seen}, f"{tmp_path}/c")
    q.awaitTermination(120)
    assert seen == {"x": [0, 2, 4, 6, 8], "y": [1, 3, 5, 7, 9]}
