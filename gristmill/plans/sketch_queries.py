"""Queries over sketches, quantiles, filters and bitmaps, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.operators import distinct, membership, quantiles
from gristmill.plans.ranking import small
from gristmill.sources.tables import bits_from_bytes, table

B = 10
ALPHA = distinct.alpha(B)
M = 1 << B


def _hll_sql(source: str, item: str, kind: str, by: str) -> str:
    return f"""
h AS (SELECT {by}, ('0x' || substr(sha256('{kind}:' || {item}::VARCHAR), 1, 15))::BIGINT AS h FROM {source} WHERE {item} IS NOT NULL),
r AS (SELECT {by}, h >> {60 - B} AS bucket, max(CASE WHEN (h >> {60 - 2 * B}) & {M - 1} = 0 THEN {B + 1}
  ELSE {B + 1} - length(bin((h >> {60 - 2 * B}) & {M - 1})) END)::INT AS rho FROM h GROUP BY ALL)"""


_ESTIMATE = f"""count(*) AS n, (sum(CAST(1099511627776 AS DOUBLE) / pow(2.0, rho)) / 1099511627776.0::DOUBLE) + ({M} - count(*)) AS s"""
_ESTIMATED = f"""round(CASE WHEN {ALPHA * M * M}::DOUBLE / s <= {2.5 * M}::DOUBLE AND {M} - n > 0 THEN {float(M)}::DOUBLE * ln({float(M)}::DOUBLE / ({M} - n)::DOUBLE)
  ELSE {ALPHA * M * M}::DOUBLE / s END, 6) AS estimate"""


def hll_registers(spark, d):
    return distinct.registers(table(spark, d, "events"), "user_id", "int", B, ["event_type"]).withColumn("bucket", F.col("bucket").cast("bigint"))


def hll_estimate(spark, d):
    return distinct.estimate(distinct.registers(table(spark, d, "events"), "user_id", "int", B, ["event_type"]), B, ["event_type"])


def hll_estimate_parts(spark, d):
    return distinct.estimate(distinct.registers(table(spark, d, "lineitem"), "l_partkey", "int", B, ["l_returnflag"]), B, ["l_returnflag"])


def hll_union(spark, d):
    by_type = distinct.registers(table(spark, d, "events"), "user_id", "int", B, ["event_type"])
    return distinct.estimate(distinct.union(by_type.drop("event_type")), B)


def hll_typed_items(spark, d):
    ids = table(spark, d, "nation").select(F.col("n_nationkey").alias("i"))
    sketches = [distinct.registers(ids.withColumn("i", F.col("i").cast(t)), "i", k, B) for t, k in (("bigint", "int"), ("string", "str"))]
    return distinct.estimate(distinct.union(*sketches), B)


def hll_recip(spark, d):
    return distinct.reciprocal(distinct.registers(table(spark, d, "customer"), "c_custkey", "int", 4), 3, 4)


def hll_native(spark, d):
    return distinct.native_estimate(table(spark, d, "events"), "user_id", ["event_type"])


def _ranked(source: str, x: str, by: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    keep = f"{by}, " if by else ""
    return f"r AS (SELECT {keep}{x}::DOUBLE AS x, row_number() OVER ({part} ORDER BY {x}) AS i, count(*) OVER ({part}) AS n FROM {source} WHERE {x} IS NOT NULL)"


def _hazen(q: float) -> str:
    h = f"({q}::DOUBLE * n + 0.5::DOUBLE)"
    a, z = f"max(x) FILTER (i = greatest(1, least(n, floor({h}))))", f"max(x) FILTER (i = least(n, floor({h}) + 1))"
    return f"CASE WHEN max({h}) <= 1 THEN min(x) WHEN max({h}) >= max(n) THEN max(x) ELSE {a} + (max({h}) - floor(max({h}))) * ({z} - {a}) END"


def digest_summary(spark, d):
    out = quantiles.summary(table(spark, d, "events"), "value", ["event_type"])
    return out.select("event_type", "count", *[F.round(c, 6).alias(c) for c in ("min", "max", "mean", "p50", "p90", "p95", "p99")])


QS = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]
PROBES = [-1.0, 1000.0, 50000.0, 123456.78, 200000.0, 1e9]


def quantile_hazen(spark, d):
    return quantiles.quantiles(table(spark, d, "orders"), "o_totalprice", QS).select("q", F.round("value", 6).alias("value"))


def cdf_at(spark, d):
    return quantiles.cdf(table(spark, d, "orders"), "o_totalprice", PROBES).select("x", F.round("cdf", 9).alias("cdf"))


def rank_at(spark, d):
    return quantiles.cdf(table(spark, d, "orders"), "o_totalprice", PROBES).select("x", F.round("rank", 6).alias("rank"))


def digest_quantiles(spark, d):
    """Weight and ends of each group's digest, and whether the share of values up to each of its quantiles is within 0.01."""
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice")
    dig = quantiles.digest(rows, "l_extendedprice", ["l_returnflag"])
    at = {f"p{int(q * 100)}": q for q in (0.05, 0.5, 0.95)}
    dig = dig.select(F.col("l_returnflag").alias("flag"), "total", "least", "most", *[quantiles.digest_quantile(q).alias(c) for c, q in at.items()])
    met = rows.join(small(dig), F.col("l_returnflag") == F.col("flag")).groupBy("l_returnflag", "total", "least", "most")
    share = lambda c: F.avg((F.col("l_extendedprice") <= F.col(c)).cast("double"))
    return met.agg(*[(F.abs(share(c) - q) <= 0.01).alias(f"{c}_ok") for c, q in at.items()])


def hll_error(spark, d):
    return spark.createDataFrame([(b, round(distinct.relative_error(b), 12)) for b in (4, 10, 14)], "b long, error double")


def bitmap_from_bytes(spark, d):
    return bits_from_bytes(spark, bytes([0b10110001, 0b10000000]), 4)


N_FILTER, P_FILTER = 2000, 0.01
BM, BK = membership.plan(N_FILTER, P_FILTER)


def _parts(spark, d, r):
    return table(spark, d, "part").where(F.col("p_partkey") % 4 == r).select("p_partkey")


def _filter(spark, d, r):
    return membership.build(_parts(spark, d, r), "p_partkey", BM, BK)


def bloom_plan(spark, d):
    rows = [(n, p, *membership.plan(n, p)) for n, p in ((100, 0.01), (1000, 0.01), (1, 0.5), (12345, 0.1))]
    return spark.createDataFrame(rows, "n long, p double, m long, k long")


def bloom_bits(spark, d):
    return _filter(spark, d, 0)


def bloom_count(spark, d):
    return membership.count_set(_filter(spark, d, 0))


def bloom_probe(spark, d):
    return membership.probe(_filter(spark, d, 0), table(spark, d, "part"), "p_partkey", BM, BK)


def bloom_fpr(spark, d):
    got = bloom_probe(spark, d).where(F.col("key") % 4 != 0)
    return got.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("found"), 1)).alias("false_positives"))


def bloom_union(spark, d):
    return membership.union(_filter(spark, d, 0), _filter(spark, d, 1), (BM, BK), (BM, BK))


def bloom_intersect(spark, d):
    return membership.intersect(_filter(spark, d, 0), _filter(spark, d, 1), (BM, BK), (BM, BK))


def _bloom_sql(name: str, r: int) -> str:
    x = "p_partkey::VARCHAR"
    h1 = f"(('0x' || substr(sha256({x}), 1, 16))::UBIGINT % {BM})::BIGINT"
    h2 = f"(CASE WHEN ('0x' || substr(md5({x}), 1, 16))::UBIGINT = 0 THEN 1 ELSE ('0x' || substr(md5({x}), 1, 16))::UBIGINT % {BM} END)::BIGINT"
    where = f"WHERE p_partkey % 4 = {r}" if r >= 0 else ""
    return f"{name} AS (SELECT DISTINCT p_partkey AS key, ({h1} + i * {h2}) % {BM} AS pos FROM part, (SELECT unnest(range({BK})) AS i) {where})"


USED_B = 12


def _supp(spark, d, flag):
    """The suppliers of a flag, however many the table has; USED_B bounds only what a query asks of them."""
    return membership.bits_of(table(spark, d, "lineitem").where(F.col("l_returnflag") == flag), "l_suppkey", None)


def bitmap_union(spark, d):
    return membership.bit_union(_supp(spark, d, "A"), _supp(spark, d, "R"))


def bitmap_intersect(spark, d):
    return membership.bit_intersect(_supp(spark, d, "A"), _supp(spark, d, "R"))


def _nations(spark, d, name):
    return membership.bits_of(table(spark, d, name[0]), name[1], 5)


def bitmap_xor(spark, d):
    x = membership.bits_of(table(spark, d, "customer").where("c_acctbal < 0"), "c_custkey", None)
    y = membership.bits_of(table(spark, d, "orders").where("o_orderstatus = 'F'"), "o_custkey", None)
    return membership.bit_xor(x, y)


def bitmap_complement(spark, d):
    return membership.complement(_supp(spark, d, "A"), USED_B)


def bitmap_delete(spark, d):
    return membership.delete(_supp(spark, d, "A"), _supp(spark, d, "R"))


def bitmap_contains(spark, d):
    return membership.contains_all(_supp(spark, d, "A"), table(spark, d, "supplier").select(F.col("s_suppkey").alias("idx")))


def bitmap_range(spark, d):
    return membership.clear_range(membership.set_range(_supp(spark, d, "A"), 2, 300, USED_B), 10, 20, USED_B)


def bitmap_cardinality(spark, d):
    return membership.cardinality(membership.packed(membership.bits_of(table(spark, d, "lineitem"), "l_orderkey", 25)))


def bitmap_packed(spark, d):
    maps = membership.packed(membership.bits_of(table(spark, d, "orders"), "o_custkey", 20))
    return maps.select("bucket", F.bitmap_count("map").alias("n"))


def bitmap_equals(spark, d):
    return membership.equals(_supp(spark, d, "A"), _supp(spark, d, "R"))


_A = "a AS (SELECT DISTINCT l_suppkey AS idx FROM lineitem WHERE l_returnflag = 'A')"
_R = "r AS (SELECT DISTINCT l_suppkey AS idx FROM lineitem WHERE l_returnflag = 'R')"

QUERIES = {
    f.__name__: f
    for f in (
        hll_registers, hll_estimate, hll_estimate_parts, hll_union, hll_typed_items, hll_recip, hll_native, digest_summary, quantile_hazen,
        cdf_at, rank_at, digest_quantiles, bloom_plan, bloom_bits, bloom_count, bloom_probe, bloom_fpr, bloom_union, bloom_intersect,
        bitmap_union, bitmap_intersect, bitmap_xor, bitmap_complement, bitmap_delete, bitmap_contains, bitmap_range, bitmap_cardinality,
        bitmap_packed, bitmap_equals, bitmap_from_bytes, hll_error,
    )
}

_X = "o_totalprice"
ORACLE = {
    "hll_registers": "WITH " + _hll_sql("events", "user_id", "int", "event_type") + " SELECT event_type, bucket, rho FROM r",
    "hll_estimate": "WITH " + _hll_sql("events", "user_id", "int", "event_type") + f", e AS (SELECT event_type, {_ESTIMATE} FROM r GROUP BY 1) SELECT event_type, {_ESTIMATED} FROM e",
    "hll_estimate_parts": "WITH " + _hll_sql("lineitem", "l_partkey", "int", "l_returnflag") + f", e AS (SELECT l_returnflag, {_ESTIMATE} FROM r GROUP BY 1) SELECT l_returnflag, {_ESTIMATED} FROM e",
    "hll_union": "WITH " + _hll_sql("events", "user_id", "int", "event_type") + f", u AS (SELECT bucket, max(rho) AS rho FROM r GROUP BY 1), e AS (SELECT {_ESTIMATE} FROM u) SELECT {_ESTIMATED} FROM e",
    "hll_typed_items": "WITH t AS (SELECT 1 AS one, 'int:' || n_nationkey AS i FROM nation UNION ALL SELECT 1, 'str:' || n_nationkey FROM nation), "
    + _hll_sql("t", "i", "x", "one").replace("'x:' || ", "") + f", e AS (SELECT {_ESTIMATE} FROM r) SELECT {_ESTIMATED} FROM e",
    "hll_recip": """WITH h AS (SELECT ('0x' || substr(sha256('int:' || c_custkey), 1, 15))::BIGINT AS h FROM customer)
SELECT coalesce(pow(2.0, -max(CASE WHEN (h >> 52) & 15 = 0 THEN 5 ELSE 5 - length(bin((h >> 52) & 15)) END)), 1.0) AS recip FROM h WHERE h >> 56 = 3""",
    "digest_summary": "WITH " + _ranked("events", "value", "event_type") + f""" SELECT event_type, count(*) AS count, round(min(x), 6) AS min, round(max(x), 6) AS max,
round(avg(x), 6) AS mean, {", ".join(f"round({_hazen(q)}, 6) AS {n}" for n, q in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99)))} FROM r GROUP BY event_type""",
    "quantile_hazen": "WITH " + _ranked("orders", _X, "") + " " + " UNION ALL ".join(f"SELECT {q}::DOUBLE AS q, round({_hazen(q)}, 6) AS value FROM r" for q in QS),
    "bloom_plan": "SELECT n::BIGINT AS n, p::DOUBLE AS p, ceil(-n * ln(p) / pow(ln(2), 2))::BIGINT AS m, greatest(1, round_even(ceil(-n * ln(p) / pow(ln(2), 2)) / n * ln(2), 0))::BIGINT AS k FROM (VALUES (100, 0.01), (1000, 0.01), (1, 0.5), (12345, 0.1)) t(n, p)",
    "bloom_bits": "WITH " + _bloom_sql("f", 0) + " SELECT DISTINCT pos FROM f",
    "bloom_count": "WITH " + _bloom_sql("f", 0) + " SELECT count(DISTINCT pos) AS n_set FROM f",
    "bloom_probe": "WITH " + _bloom_sql("f", 0) + ", " + _bloom_sql("p", -1) + " SELECT key, bool_and(pos IN (SELECT pos FROM f)) AS found FROM p GROUP BY key",
    "bloom_fpr": "WITH " + _bloom_sql("f", 0) + ", " + _bloom_sql("p", -1) + ", g AS (SELECT key, bool_and(pos IN (SELECT pos FROM f)) AS found FROM p GROUP BY key) SELECT count(*) AS n, count(*) FILTER (found) AS false_positives FROM g WHERE key % 4 <> 0",
    "bloom_union": "WITH " + _bloom_sql("f", 0) + ", " + _bloom_sql("g", 1) + " SELECT pos FROM f UNION SELECT pos FROM g",
    "bloom_intersect": "WITH " + _bloom_sql("f", 0) + ", " + _bloom_sql("g", 1) + " SELECT pos FROM f INTERSECT SELECT pos FROM g",
    "bitmap_union": f"WITH {_A}, {_R} SELECT idx FROM a UNION SELECT idx FROM r",
    "bitmap_intersect": f"WITH {_A}, {_R} SELECT idx FROM a INTERSECT SELECT idx FROM r",
    "bitmap_xor": """WITH x AS (SELECT DISTINCT c_custkey AS idx FROM customer WHERE c_acctbal < 0), y AS (SELECT DISTINCT o_custkey AS idx FROM orders WHERE o_orderstatus = 'F')
(SELECT idx FROM x EXCEPT SELECT idx FROM y) UNION ALL (SELECT idx FROM y EXCEPT SELECT idx FROM x)""",
    "bitmap_complement": f"WITH {_A} SELECT range AS idx FROM range({1 << USED_B}) WHERE range NOT IN (SELECT idx FROM a)",
    "bitmap_delete": f"WITH {_A}, {_R} SELECT idx FROM a EXCEPT SELECT idx FROM r",
    "bitmap_contains": f"WITH {_A} SELECT coalesce(bool_and(s_suppkey IN (SELECT idx FROM a)), true) AS found FROM supplier",
    "bitmap_range": f"WITH {_A} SELECT idx FROM (SELECT idx FROM a UNION SELECT range FROM range(2, 300)) WHERE idx < 10 OR idx >= 20",
    "bitmap_cardinality": "SELECT count(DISTINCT l_orderkey) AS n FROM lineitem",
    "bitmap_packed": "SELECT o_custkey // 32768 + 1 AS bucket, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1",
    "bitmap_from_bytes": "SELECT unnest([0, 4, 5, 7, 15])::BIGINT AS idx",
    "hll_error": "SELECT b::BIGINT AS b, round(1.04::DOUBLE / sqrt((1 << b)::DOUBLE), 12) AS error FROM (VALUES (4), (10), (14)) t(b)",
    "digest_quantiles": "SELECT l_returnflag, count(*)::DOUBLE AS total, min(l_extendedprice) AS least, max(l_extendedprice) AS most, true AS p5_ok, true AS p50_ok, true AS p95_ok FROM lineitem GROUP BY 1",
    "bitmap_equals": f"WITH {_A}, {_R} SELECT NOT EXISTS ((SELECT idx FROM a EXCEPT SELECT idx FROM r) UNION ALL (SELECT idx FROM r EXCEPT SELECT idx FROM a)) AS equal",
}

_CDF = """p AS (SELECT unnest([-1.0, 1000.0, 50000.0, 123456.78, 200000.0, 1e9])::DOUBLE AS x),
s AS (SELECT p.x, count(o_totalprice) AS n, min(o_totalprice) AS least, max(o_totalprice) AS most, count(*) FILTER (o_totalprice <= p.x) AS le,
  max(o_totalprice) FILTER (o_totalprice <= p.x) AS lo, min(o_totalprice) FILTER (o_totalprice > p.x) AS hi FROM p, orders GROUP BY p.x),
c AS (SELECT x, n, CASE WHEN x < least THEN 0.0::DOUBLE WHEN x >= most THEN 1.0::DOUBLE ELSE (le - 0.5::DOUBLE + (x - lo) / (hi - lo)) / n END AS cdf FROM s)"""
ORACLE["cdf_at"] = f"WITH {_CDF} SELECT x, round(cdf, 9) AS cdf FROM c"
ORACLE["rank_at"] = f"WITH {_CDF} SELECT x, round(cdf * n, 6) AS rank FROM c"
