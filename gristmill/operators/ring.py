"""Hash rings as rows (ring_idx, pos, server). A ring is small: servers times virtual nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.functions.hashing import sha_int
from gristmill.plans.ranking import small

SPACE = 1 << 32


def _indexed(nodes: DataFrame) -> DataFrame:
    w = Window.orderBy("pos", "server")
    return nodes.select((F.row_number().over(w) - 1).alias("ring_idx"), F.col("pos").cast("bigint").alias("pos"), F.col("server").cast("int").alias("server"))


def build(spark: SparkSession, servers: int, vnodes: int, seed: int = 0) -> DataFrame:
    """A ring of hashed positions. ValueError without servers or virtual nodes."""
    if servers < 1 or vnodes < 1:
        raise ValueError("servers and vnodes must be positive")
    pos = F.conv(F.right(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), F.lit(8)), 16, 10).cast("bigint")
    return _indexed(spark.range(servers * vnodes).select(pos.alias("pos"), F.expr(f"id div {vnodes}").alias("server")))


def from_rows(spark: SparkSession, rows: list[tuple[int, int]]) -> DataFrame:
    """A ring of given (pos, server)."""
    return _indexed(spark.createDataFrame(rows, "pos long, server int"))


def key_hash(key: Column) -> Column:
    """SHA-256 of the key modulo 2^32: its last 8 hex digits."""
    return sha_int(key.cast("string"), 8, 57)


def assign(ring: DataFrame, keys: DataFrame, key: str, mode: str = "index") -> DataFrame:
    """Adds server to keys. mode index: the hash modulo the ring's size picks a node; mode clockwise: the first
    node at or after the hash, wrapping around."""
    if mode not in ("index", "clockwise"):
        raise ValueError("mode must be index or clockwise")
    n = ring.count()
    if not n:
        raise ValueError("the ring must have nodes")
    h = key_hash(F.col(key))
    if mode == "index":
        at = F.pmod(h, F.lit(n))
    else:
        return _clockwise(ring, keys, h)
    nodes = small(ring.select(F.col("ring_idx").alias("gm_node"), "server"))
    return keys.withColumn("gm_at", at.cast("int")).join(nodes, F.col("gm_at") == F.col("gm_node")).drop("gm_at", "gm_node")


#: Parts of the ring's space within which a key looks for the next node.
PARTS = 4096


def _clockwise(ring: DataFrame, keys: DataFrame, h: Column) -> DataFrame:
    """Keys meet the nodes of their part of the space, and the first node after it, by an equi-join on the part."""
    width = SPACE // PARTS
    nodes = ring.select("pos", "server", F.expr(f"cast(pos div {width} as int)").alias("gm_p"))
    held = nodes.groupBy("gm_p").agg(F.array_sort(F.collect_list(F.struct("pos", "server"))).alias("gm_own"))
    every = ring.sparkSession.range(PARTS).select(F.col("id").cast("int").alias("gm_part")).join(held, F.col("gm_part") == F.col("gm_p"), "left")
    back = Window.orderBy(F.desc("gm_part")).rowsBetween(Window.unboundedPreceding, -1)  # PARTS rows
    first = F.get("gm_own", F.lit(0))
    after = F.coalesce(F.last(first, True).over(back), F.min(first).over(Window.partitionBy(F.lit(0))))
    parts = every.select("gm_part", F.concat(F.coalesce("gm_own", F.array().cast("array<struct<pos:bigint,server:int>>")), F.array(after.cast("struct<pos:bigint,server:int>"))).alias("gm_nodes"))
    met = keys.withColumn("gm_h", h).withColumn("gm_at", F.expr(f"cast(gm_h div {width} as int)")).join(small(parts), F.col("gm_at") == F.col("gm_part"))
    hit = F.filter(F.slice("gm_nodes", 1, F.size("gm_nodes") - 1), lambda n: n["pos"] >= F.col("gm_h"))
    found = F.coalesce(F.get(hit, F.lit(0)), F.element_at("gm_nodes", -1))
    return met.select(*[F.col(f"`{c}`") for c in keys.columns], found["server"].alias("server"))


def arcs(ring: DataFrame) -> DataFrame:
    """(ring_idx, pos, server, arc): the space from each node to the next, around the end; 0 for a ring of one."""
    w = Window.orderBy("ring_idx")
    first = F.first("pos").over(w)
    return ring.withColumn("arc", F.pmod(F.coalesce(F.lead("pos").over(w), first) - F.col("pos"), F.lit(SPACE)))


def server_capacity(ring: DataFrame) -> DataFrame:
    return arcs(ring).groupBy("server").agg(F.sum("arc").alias("capacity"))


def node_capacity(ring: DataFrame, index: int) -> DataFrame:
    """(arc) of one node, -1 for an index out of range."""
    return arcs(ring).where(F.col("ring_idx") == index).agg(F.coalesce(F.max("arc"), F.lit(-1).cast("bigint")).alias("arc"))


def biggest_gap(ring: DataFrame) -> DataFrame:
    """(ring_idx) of the node that the biggest arc follows, the first of equals."""
    return arcs(ring).agg(F.min(F.struct((-F.col("arc")).alias("a"), "ring_idx"))["ring_idx"].alias("ring_idx"))


def add_node(ring: DataFrame, server: int) -> DataFrame:
    """The ring with a node of the server in the middle of its biggest gap."""
    rows = [(r["pos"], r["server"], r["arc"]) for r in arcs(ring).orderBy("ring_idx").collect()]  # servers times virtual nodes
    pos, _, arc = max(rows, key=lambda r: r[2])
    arc = arc or SPACE
    return from_rows(ring.sparkSession, [(p, s) for p, s, _ in rows] + [((pos + arc // 2) % SPACE, server)])


def add_server(ring: DataFrame, server: int, vnodes: int) -> DataFrame:
    for _ in range(vnodes):
        ring = add_node(ring, server)
    return ring


def remove_server(ring: DataFrame, server: int) -> DataFrame:
    """The server's nodes go to the next owner on the ring that is another server. ValueError if there is none."""
    rows = [(r["pos"], r["server"]) for r in ring.orderBy("ring_idx").collect()]  # servers times virtual nodes
    n = len(rows)
    if all(s == server for _, s in rows):
        raise ValueError("the last server cannot go")
    heirs = [next(rows[(i + k) % n][1] for k in range(n) if rows[(i + k) % n][1] != server) for i in range(n)]
    return from_rows(ring.sparkSession, [(p, h) for (p, _), h in zip(rows, heirs)])
