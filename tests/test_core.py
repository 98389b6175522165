"""Edge cases of the operators that the SQL comparison of the registered queries does not reach."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gristmill.operators import crdt, distinct, elections, graph, membership, merkle, ordered, pixels, quadtree, quantiles, replay, ring
from gristmill.plans import ranking
from gristmill.plans.ranking import positions
from gristmill.sources import tables


def col(df, name):
    return sorted(r[name] for r in df.collect())


def ids(spark, values, name="idx"):
    return spark.createDataFrame([(v,) for v in values], f"{name} long")


def test_positions_of_skewed_groups(spark):
    rows = [("hot", i) for i in range(500)] + [("b", 3), ("b", 1), (None, 2)]
    random.Random(0).shuffle(rows)
    got = positions(spark.createDataFrame(rows, "g string, v long"), ["v"], ["g"]).collect()
    assert {(r.g, r.v): r.pos for r in got} == {**{("hot", i): i for i in range(500)}, ("b", 1): 0, ("b", 3): 1, (None, 2): 0}


def test_distinct_counts(spark):
    empty = distinct.registers(spark.createDataFrame([], "x long"), "x", "int", 10)
    assert distinct.estimate(empty, 10).first()[0] == 0
    for n, b in ((1, 10), (5000, 12), (100_000, 14)):
        df = spark.range(n).union(spark.range(n))
        e = distinct.estimate(distinct.registers(df, "id", "int", b), b).first()[0]
        assert abs(e - n) <= max(0.06, 4 * distinct.relative_error(b)) * n
    with pytest.raises(ValueError):
        distinct.alpha(0)
    with pytest.raises(ValueError):
        distinct.reciprocal(empty, 1024, 10)
    assert [distinct.alpha(b) for b in (4, 5, 6)] == [0.673, 0.697, 0.709]


def test_quantiles_and_digests(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(101)] + [("c", 42.0)] * 5 + [("n", None)], "k string, x double")
    got = {(r.k, r.q): r.value for r in quantiles.quantiles(df, "x", [0, 0.5, 1], ["k"]).collect()}
    assert got["a", 0] == 0 and got["a", 0.5] == 50 and got["a", 1] == 100 and got["c", 0.5] == 42
    rows = {r.k: r for r in quantiles.summary(df, "x", ["k"]).collect()}
    assert rows["n"]["count"] == 0 and rows["n"].p50 is None and rows["a"]["mean"] == 50
    with pytest.raises(AssertionError):
        quantiles.quantiles(df, "x", [1.5])
    d = quantiles.digest(df, "x", ["k"])
    r = {x.k: x for x in d.select("k", "total", quantiles.digest_quantile(0.5).alias("m"), quantiles.digest_quantile(0.0).alias("z")).collect()}
    assert r["a"].total == 101 and 45 <= r["a"].m <= 55 and r["a"].z == 0 and r["c"].m == 42
    many = spark.range(20_000).select(F.lit("x").alias("k"), F.col("id").cast("double").alias("x"))
    big = quantiles.digest(many, "x", ["k"]).select(F.size("centroids").alias("n"), *[quantiles.digest_quantile(q).alias(f"q{int(q * 100)}") for q in (0.01, 0.5, 0.99)]).first()
    assert big.n < 400 and abs(big.q50 - 10_000) < 400 and abs(big.q1 - 200) < 100 and abs(big.q99 - 19_800) < 100
    halves = [quantiles.digest(df.where(F.col("k") == "a").where(c), "x", ["k"]) for c in ("x < 50", "x >= 50")]
    whole = quantiles.merge(*halves, by=["k"]).select("total", "least", "most", quantiles.digest_quantile(0.5).alias("m")).first()
    assert (whole.total, whole.least, whole.most) == (101, 0, 100) and 45 <= whole.m <= 55
    assert quantiles.centre_quantile([5.0], [1.0], 0.3, 5.0, 5.0) == 5.0
    with pytest.raises(AssertionError):
        quantiles.digest(df, "x", ["k"], alpha=0)
    one = {r.x: r.cdf for r in quantiles.cdf(spark.createDataFrame([(5.0,)], "x double"), "x", [4.0, 5.0]).collect()}
    assert one == {4.0: 0.0, 5.0: 1.0}


def test_bloom(spark):
    assert membership.plan(100, 0.01) == (959, 7)
    with pytest.raises(ValueError):
        membership.plan(10, 1.0)
    m, k = membership.plan(1000, 0.01)
    keys = spark.range(100).select(F.col("id").cast("string").alias("key"))
    probes = spark.range(200).select(F.col("id").cast("string").alias("key"))
    got = {r.key: r.found for r in membership.probe(membership.build(keys, "key", m, k), probes, "key", m, k).collect()}
    assert all(got[str(i)] for i in range(100)) and sum(got[str(i)] for i in range(100, 200)) < 5
    with pytest.raises(ValueError):
        membership.union(keys, keys, (1, 1), (2, 1))


def test_bitmaps(spark):
    a = membership.set_range(membership.clear_range(ids(spark, [0, 1, 2, 3]), 1, 3, 3), 4, 6, 3)
    assert col(a, "idx") == [0, 3, 4, 5]
    b = ids(spark, [3, 4])
    assert col(membership.bit_intersect(a, b), "idx") == [3, 4] and col(membership.bit_xor(a, b), "idx") == [0, 5]
    assert col(membership.complement(ids(spark, [0, 3]), 3), "idx") == [1, 2, 4, 5, 6, 7]
    assert membership.contains_all(a, ids(spark, [0, 5])).first()[0] and not membership.contains_all(a, ids(spark, [0, 8])).first()[0]
    assert membership.contains_all(a, ids(spark, [])).first()[0]
    assert membership.cardinality(membership.packed(a)).first()[0] == 4 and membership.cardinality(membership.packed(ids(spark, []))).first()[0] == 0
    assert col(tables.bits_from_bytes(spark, bytes([0b10010001, 1]), 4), "idx") == [0, 4, 7, 8]
    for bad in (lambda: membership.complement(a, -1), lambda: membership.bit_union(a, b, 3, 4), lambda: membership.set_range(a, 5, 9, 3), lambda: tables.bits_from_bytes(spark, b"ab", 3)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(Exception, match="out of range"):
        membership.bits_of(ids(spark, [8]), "idx", 3).collect()
    assert membership.equals(a, a).first()[0] and not membership.equals(a, a, 3, 4).first()[0]


def test_ordered_and_prefixes(spark):
    keys = ordered.distinct_keys(spark.createDataFrame([(3,), (7,), (1,), (5,), (5,), (None,)], "k int"), "k")
    assert col(ordered.ceiling(keys, 4), "key") == [5, 7] and col(ordered.floor(keys, 3), "key") == [1, 3]
    assert ordered.search(keys, 6).first()[0] == 5 and ordered.search(keys, 0).first()[0] is None
    assert ordered.successor(keys, 7).first()[0] is None and ordered.predecessor(keys, 5).first()[0] == 3
    with pytest.raises(ValueError):
        ordered.exists(keys, 1, 2)
    words = spark.createDataFrame([("app",), ("apple",), ("bat",)], "key string")
    assert col(ordered.with_prefix(words, "app"), "key") == ["apple"] and col(ordered.with_prefix(words, ""), "key") == ["app", "apple", "bat"]
    assert ordered.with_prefix(words, "a", 0).count() == 0
    texts = spark.createDataFrame([("applepie",), ("ap",), ("",), ("bat",)], "text string")
    assert {r.text: r.prefix for r in ordered.longest_prefixes(words, texts).collect()} == {"applepie": "apple", "ap": "", "": "", "bat": "bat"}
    assert not ordered.starts_with(words, "").first()[0] and not ordered.has_key(words, "").first()[0]
    with pytest.raises(Exception, match="empty key"):
        ordered.add_keys(words, spark.createDataFrame([("",)], "key string")).collect()


def leaf_rows(spark, text):
    return spark.createDataFrame(list(enumerate(text)), "idx long, content string")


def test_merkle(spark):
    t = merkle.build(leaf_rows(spark, "abc"))
    assert t.agg(F.max("level")).first()[0] + 1 == 3 == merkle.height(3)
    changed = merkle.set_leaf(t, 1, "d")
    assert merkle.root(changed).first() == merkle.root(merkle.build(leaf_rows(spark, "adc"))).first()
    other = merkle.build(leaf_rows(spark, "adfe"))
    longer = merkle.append(leaf_rows(spark, "adc"), ["e"])
    assert [r.idx for r in merkle.diff_leaves(merkle.leaf_hashes(longer), merkle.leaf_hashes(other)).collect()] == [2]
    assert tuple(merkle.first_difference(t, t).first()) == (-1, -1) and merkle.equals(t, t).first()[0]
    nothing = merkle.build(spark.createDataFrame([], "idx long, content string"))
    assert nothing.count() == 0 and not merkle.equals(nothing, nothing).first()[0]
    assert merkle.diff_leaves(merkle.leaf_hashes(t), merkle.leaf_hashes(other), 0).count() == 0
    with pytest.raises(ValueError):
        merkle.set_leaf(t, 9, "x")


def test_ring(spark):
    r = ring.from_rows(spark, [(100, 0), (200, 1), (300, 0), (400, 1)])
    assert {x.server: x.capacity for x in ring.server_capacity(r).collect()} == {0: 200, 1: ring.SPACE - 300 + 100}
    gaps = ring.from_rows(spark, [(100, 0), (150, 0), (160, 1), (400, 1)])
    assert ring.biggest_gap(gaps).first()[0] == 3
    assert ring.node_capacity(ring.from_rows(spark, [(5, 0)]), 0).first()[0] == 0 and ring.node_capacity(r, 9).first()[0] == -1
    assert {x.server for x in ring.remove_server(r, 1).collect()} == {0}
    with pytest.raises(ValueError):
        ring.remove_server(ring.from_rows(spark, [(5, 0)]), 0)
    with pytest.raises(ValueError):
        ring.build(spark, 0, 3)
    keys = spark.range(2000).select(F.concat(F.lit("key-"), "id").alias("k"))
    n = ring.assign(ring.build(spark, 2, 2), keys, "k").where("server = 0").count()
    assert 600 < n < 1400


def test_graph(spark):
    g = graph.from_edges(spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), (None, "q")], "u string, v string"))
    assert graph.shortest_path(g, "a", "c").first()[0] == 2 and graph.shortest_path(g, "a", "y").first()[0] == -1
    assert graph.shortest_path(g, "zz", "zz").first()[0] == 0 and not graph.has_path(g, "zz", "a").first()[0]
    assert graph.remove_vertex(g, "b").count() == 2


def test_quadtree(spark):
    def pts(*xy):
        return spark.createDataFrame([(float(x), float(y)) for x, y in xy], "x double, y double")

    two = quadtree.leaves(pts((1, 1), (6, 6)), 8, 8, 1).collect()
    assert {(r.depth, r.cx, r.cy) for r in two} == {(1, 0, 0), (1, 1, 1)}
    three = pts((1, 1), (6, 1), (1, 6), (8, 1), (-1, 0))
    assert {r.depth for r in quadtree.leaves(three, 8, 8, 2).collect()} == {1} and quadtree.leaves(three, 8, 8, 2).count() == 3
    assert {r.depth for r in quadtree.leaves(quadtree.delete(three, 6, 1), 8, 8, 2).collect()} == {0}
    same = pts((1, 1), (1, 1), (1, 1))
    assert {r.depth for r in quadtree.leaves(same, 8, 8, 1, max_depth=3).collect()} == {3}
    assert quadtree.query(pts((2.5, 1.5), (6, 6)), 2, 1, 8, 8, 1).count() == 1 and quadtree.query(three, 9, 9, 8, 8, 1).count() == 0
    with pytest.raises(ValueError):
        quadtree.leaves(three, 0, 8, 1)


def atoms(spark, rows):
    return spark.createDataFrame(rows, "doc long, id string, value string, predecessor_id string, tombstone boolean, timestamp long, sequence int, site_id string")


def test_crdt(spark):
    a = atoms(spark, [(1, "1", "a", "ROOT", False, 1, 0, "s"), (1, "2", "b", "1", False, 2, 0, "s")])
    assert crdt.converge(a).first().text == "ab"
    gone = crdt.delete(a, spark.createDataFrame([(1, "1"), (1, "zz")], "doc long, id string"))
    assert crdt.converge(crdt.merge(a, gone)).first().text == "b"
    later = atoms(spark, [(1, "3", "c", "1", False, 3, 0, "t"), (1, "9", "q", "nowhere", False, 3, 0, "t"), (1, "7", "x", "8", False, 1, 0, "t"), (1, "8", "y", "7", False, 1, 0, "t")])
    assert crdt.converge(crdt.merge(a, later)).first().text == "acb"
    with pytest.raises(Exception, match="unknown predecessor"):
        crdt.insert(a, later).collect()
    chain = atoms(spark, [(2, str(i), chr(97 + i % 26), str(i - 1) if i else "ROOT", False, i, 0, "s") for i in range(200)])
    assert crdt.converge(chain).first().text == "".join(chr(97 + i % 26) for i in range(200))


def events(spark, rows):
    return spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(rows)], "key string, ts_ms long, id long")


def decisions(df):
    return [r.allowed for r in sorted(df.collect(), key=lambda r: r.id)]


def test_limiters(spark):
    assert decisions(replay.fixed_window(events(spark, [("u", 0)] * 3 + [("u", 1001)]), "second", 2)) == [True, True, False, True]
    assert decisions(replay.fixed_window(events(spark, [("u", 0), ("u", 59999), ("u", 60001)]), "minute", 1)) == [True, False, True]
    assert decisions(replay.fixed_window(events(spark, [("u", 0), ("u", 1000), ("v", 1000)]), "second", 1)) == [True, False, True]
    black = replay.fixed_window(events(spark, [("b", 0), ("u", 5)]), "second", 1, ["b"])
    assert decisions(black) == [False, True] and {r.key: (r.allowed, r.denied) for r in replay.limiter_metrics(black).collect()}["b"] == (0, 1)
    assert decisions(replay.sliding_window(events(spark, [("u", 0)] * 4 + [("u", 1001)]), "second", 3)) == [True, True, True, False, True]
    assert decisions(replay.sliding_window(events(spark, [("u", 1000), ("u", 2000)]), "second", 1)) == [True, False]
    assert decisions(replay.sliding_window(events(spark, [("u", t) for t in (0, 500, 900, 1600)]), "second", 2)) == [True, True, False, True]
    for bad in (("year", 1, 1), ("day", 0, 1), ("day", 1, 0)):
        with pytest.raises(ValueError):
            replay.sliding_window(events(spark, [("u", 0)]), *bad)


def test_fixed_windows_against_a_loop(spark):
    rng = random.Random(5)
    rows, t = [], 0
    for _ in range(400):
        t += rng.choice([0, 1, 300, 999, 1000, 1001, 5000])
        rows.append((rng.choice("abc"), t))
    start, counts, want = None, {}, []
    for k, at in rows:
        if start is None or at > start + 1000:
            start, counts = at, {}
        counts[k] = counts.get(k, 0) + 1
        want.append(counts[k] <= 2)
    assert decisions(replay.fixed_window(events(spark, rows), "second", 2)) == want


def test_breaker():
    b = replay.Breaker(0.5, 3, 1)
    assert [b.call(0, False), b.call(0, True), b.call(2, True), b.call(3, True), b.call(4, True)] == [True, False, False, True, True]
    assert b.state == "closed"
    b = replay.Breaker(0.3333, 1, 3)  # one failure of three probes is over the rate, which is not rounded
    assert [b.call(0, False), b.call(0, True)] == [True, False]
    assert [b.call(t, t != 2) for t in (1, 2, 3, 4)] == [True, True, True, False] and b.state == "open"
    b.reset()
    assert b.state == "closed" and b.call(4, True)
    for bad in ((0, 1, 1), (1.1, 1, 1), (0.5, 0, 1), (0.5, 1, 0)):
        with pytest.raises(ValueError):
            replay.Breaker(*bad)


def test_balancers(spark):
    servers = tables.servers_from_config(spark, {"servers": [{"name": n, "url": n, "weight": w} for n, w in (("a", 5), ("b", 3), ("c", 2))]})
    s = servers.select(F.col("name").alias("server"), F.col("name").alias("ord"), "healthy", "active_connections", "max_connections", "weight")
    calls = spark.range(10).select("id", F.col("id").alias("ts_ms"))
    got = [r.server for r in replay.weighted_round_robin(calls, s).orderBy("id").collect()]
    assert got == ["a", "a", "b", "c"] * 2 + ["a", "a"]
    with pytest.raises(RuntimeError):
        replay.round_robin(calls, s.where("false"))
    with pytest.raises(ValueError):
        tables.servers_from_config(spark, {"servers": [], "strategy": "round_robin"})
    with pytest.raises(ValueError):
        tables.servers_from_config(spark, {"servers": [{}], "strategy": "none"})
    rows = [("p", i, t, h) for i, (t, h) in enumerate([(0, 10), (1, 10), (2, 10), (3, 10), (11, 1)])]
    held = replay.replay_least_connections(spark.createDataFrame(rows, "pool string, id long, ts_ms long, hold_ms long"), [("a", 1), ("b", 2)])
    assert [r.server for r in held.orderBy("id").collect()] == ["a", "b", "b", None, "a"]


def test_histories():
    h = replay.History(2)
    for op, s in (("save", "1"), ("save", "2"), ("save", "3"), ("undo", None)):
        h.apply(op, s)
    assert h.state == "3"  # the save dropped a state, so the first undo leaves the state as it is
    h.apply("redo", None)
    assert h.state == "3"
    h.apply("undo", None)
    assert h.state == "2"
    h.apply("undo", None)
    assert h.state == "2" and len(h.undo) == 0
    h = replay.History(3, edit=str.upper)
    for s in "abc":
        h.apply("save", s)
    h.apply("undo_n", None, 2)
    assert h.state == "A" and (len(h.undo), len(h.redo)) == (1, 2)
    with pytest.raises(IndexError):
        h.apply("undo_n", None, 2)
    h.apply("replace", "z")
    assert h.state == "z" and not h.undo and not h.redo


def test_running_aggregates_against_a_loop(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), i, rng.randrange(100) if rng.random() < 0.9 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, i long, v long").repartition(5)
    got = {r.i: (r.total, r.least) for r in ranking.running(df, ["i"], ["g"], {"total": F.coalesce("v", F.lit(0))}, {"least": F.col("v")}).collect()}
    total, least = {}, {}
    for g, i, v in rows:
        total[g] = total.get(g, 0) + (v or 0)
        least[g] = min([x for x in (least.get(g), v) if x is not None], default=None)
        assert got[i] == (total[g], least[g])


def test_elections(spark):
    def ballots(*prefs):
        return spark.createDataFrame([(i, list(p)) for i, p in enumerate(prefs)], "ballot_id long, prefs array<string>")

    assert elections.plurality(ballots()).count() == 0 and elections.plurality(ballots("b", "a", "a", "b")).first().winner == "a"
    assert elections.approval(ballots("ab", "ba")).first().winner == "b"
    with pytest.raises(Exception, match="as many candidates"):
        elections.borda(ballots("ab", "a"), [1, 0]).collect()
    assert elections.condorcet(ballots("abc", "bca", "cab"), list("abc")).first().winner is None
    assert elections.condorcet(ballots("ab", "ba"), list("ab")).first().winner == "a"
    rounds = elections.ranked_choice(ballots("a", "a", "bc", "cb", "cb"), list("abcd")).where("eliminated OR winner").collect()
    assert [(r.round, r.candidate) for r in sorted(rounds)] == [(1, "d"), (2, "b"), (3, "c")]
    with pytest.raises(AssertionError):
        elections.condorcet(ballots("a"), ["a", "a"])
    one = spark.range(1).select(elections.polsby_popper(F.lit(math.pi), F.lit(2 * math.pi)).alias("p"), elections.reock(F.lit(1.0), F.lit(2.0)).alias("r")).first()
    assert abs(one.p - 1) < 1e-12 and one.r == 0.5
    with pytest.raises(Exception, match="must be positive"):
        spark.range(1).select(elections.polsby_popper(F.lit(0.0), F.lit(1.0))).collect()


def test_pixels(spark):
    def px(r, g, b):
        return spark.createDataFrame([(1, 0, 0, r, g, b)], "image_id long, y int, x int, r int, g int, b int")

    def rgb(df):
        return tuple(df.select("r", "g", "b").first())

    p = px(100, 150, 200)
    assert rgb(pixels.threshold(p, 128)) == (0, 255, 255) and rgb(pixels.threshold(p, 128, True)) == (255, 0, 0)
    assert rgb(pixels.truncate(px(50, 150, 250), 200)) == (50, 150, 200) and rgb(pixels.to_zero(p, 100)) == (0, 150, 200)
    hsv = {c: tuple(pixels.to_hsv(px(*c)).select("h", "s", "v").first()) for c in ((255, 0, 0), (0, 255, 0), (0, 0, 255), (128, 128, 128), (255, 0, 1), (0, 0, 0))}
    assert hsv[255, 0, 0] == (0, 1, 1) and hsv[0, 255, 0] == (120, 1, 1) and hsv[0, 0, 255] == (240, 1, 1) and hsv[0, 0, 0] == (0, 0, 0)
    assert hsv[128, 128, 128] == (0, 0, 128 / 255) and abs(hsv[255, 0, 1][0] - 359.7647) < 1e-4
    for bad in (-1, 256, 1.5, True):
        with pytest.raises(AssertionError):
            pixels.threshold(p, bad)
    with pytest.raises(ValueError):
        pixels.upscale(p, 1)
    with pytest.raises(ValueError):
        pixels.greyscale(p, "none")
    with pytest.raises(Exception, match="out of range"):
        pixels.checked(px(1, 2, 300)).collect()
    assert pixels.upscale(p, 2).count() == 4
    image = spark.createDataFrame([(1, [[(1, 2, 3), (4, 5, 6)]])], "image_id long, pixels array<array<struct<r:int,g:int,b:int>>>")
    assert {(r.y, r.x, r.r) for r in tables.pixels(image).collect()} == {(0, 0, 1), (0, 1, 4)}
