"""Queries over ordered sets, prefixes, Merkle trees, rings, graphs, quadtrees and replicated sequences, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.operators import crdt, graph, merkle, ordered, quadtree, ring
from gristmill.plans.ranking import positions
from gristmill.sources.tables import table

# --- ordered sets and prefixes ---------------------------------------------------------------------


def _orders(spark, d):
    return ordered.distinct_keys(table(spark, d, "orders"), "o_orderkey")


def _cust(spark, d):
    return ordered.distinct_keys(table(spark, d, "orders"), "o_custkey")


def ordered_ceiling(spark, d):
    return ordered.ceiling(_orders(spark, d), 1200)


def ordered_floor(spark, d):
    return ordered.floor(_orders(spark, d), 100)


def ordered_search(spark, d):
    return ordered.search(_cust(spark, d), 77)


def ordered_successor(spark, d):
    return ordered.successor(_cust(spark, d), 50)


def ordered_predecessor(spark, d):
    return ordered.predecessor(_cust(spark, d), 50)


def ordered_neighbours(spark, d):
    keys = table(spark, d, "customer").select("c_nationkey", F.col("c_custkey").alias("key"))
    return ordered.neighbours(keys, ["c_nationkey"])


def ordered_contains(spark, d):
    return ordered.contains(_cust(spark, d), table(spark, d, "customer").select(F.col("c_custkey").alias("key")))


def ordered_merge_delete(spark, d):
    some = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("key"))
    return ordered.delete(ordered.merge(_cust(spark, d), some), table(spark, d, "supplier").select(F.col("s_suppkey").alias("key")))


def ordered_extent(spark, d):
    return ordered.extent(_cust(spark, d))


def ordered_point(spark, d):
    return ordered.exists(_orders(spark, d), 42)


def _names(spark, d):
    return ordered.distinct_keys(table(spark, d, "part"), "p_name")


def prefix_scan(spark, d):
    return ordered.with_prefix(_names(spark, d), "red w")


def prefix_scan_limited(spark, d):
    return ordered.with_prefix(_names(spark, d), "b", 3)


def prefix_exists(spark, d):
    return ordered.starts_with(_names(spark, d), "blue")


def prefix_has_key(spark, d):
    return ordered.has_key(_names(spark, d), "red w")


def prefix_count_new(spark, d):
    new = table(spark, d, "customer").select(F.col("c_name").alias("key"))
    return ordered.count_new(_names(spark, d), new)


def prefix_update_delete(spark, d):
    keys = ordered.add_keys(_names(spark, d), table(spark, d, "supplier").select(F.col("s_name").alias("key")))
    return ordered.delete(keys, table(spark, d, "part").where("p_partkey % 2 = 0").select(F.col("p_name").alias("key")))


def longest_prefix(spark, d):
    keys = table(spark, d, "pages").select(F.expr("left(url, 14)").alias("key")).union(table(spark, d, "pages").select(F.expr("left(url, 22)").alias("key"))).distinct()
    return ordered.longest_prefixes(keys, table(spark, d, "pages"), "url")


def inverted_index(spark, d):
    return ordered.postings(table(spark, d, "documents"), "doc_id", "text")


def index_search(spark, d):
    docs = table(spark, d, "documents")
    found = ordered.tf_idf(ordered.postings(docs, "doc_id", "text"), docs.count(), ["eres", "inin", "haha", "thth"])
    return found.select("doc_id", F.round("score", 6).alias("score"))


# --- Merkle ----------------------------------------------------------------------------------------


def _nations(spark, d, edited=False):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("idx"), F.col("n_name").alias("content"))
    return n.withColumn("content", F.when(F.col("idx").isin(3, 17), F.concat("content", F.lit("!"))).otherwise(F.col("content"))) if edited else n


def merkle_levels(spark, d):
    return merkle.build(_nations(spark, d))


def merkle_root(spark, d):
    return merkle.root(merkle.build(_nations(spark, d)))


def merkle_widths(spark, d):
    return merkle.widths(merkle.build(_nations(spark, d)))


def merkle_set_leaf(spark, d):
    return merkle.set_leaf(merkle.build(_nations(spark, d)), 24, "ATLANTIS")


def merkle_append(spark, d):
    return merkle.root(merkle.append(_nations(spark, d), ["ATLANTIS", "LEMURIA"]))


def merkle_diff(spark, d):
    return merkle.diff_nodes(merkle.build(_nations(spark, d)), merkle.build(_nations(spark, d, True)))


def merkle_first_difference(spark, d):
    return merkle.first_difference(merkle.build(_nations(spark, d)), merkle.build(_nations(spark, d, True)))


def merkle_equals(spark, d):
    return merkle.equals(merkle.build(_nations(spark, d)), merkle.build(_nations(spark, d)))


def merkle_diff_leaves(spark, d):
    o = positions(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), ["o_orderkey"], name="idx")
    a = merkle.leaves(o.withColumn("content", F.concat("o_orderstatus", "o_orderpriority")))
    b = merkle.leaves(
        o.where("o_orderkey % 1000 <> 7").withColumn("content", F.when(F.col("o_orderkey") % 97 == 0, "x").otherwise(F.concat("o_orderstatus", "o_orderpriority")))
    )
    return merkle.diff_leaves(a, b, 50)


_EDIT = "CASE WHEN n_nationkey IN (3, 17) THEN n_name || '!' ELSE n_name END"
_SET = "CASE WHEN n_nationkey = 24 THEN 'ATLANTIS' ELSE n_name END"


def _tree(name: str, content: str, levels: int = 6, more: str = "") -> str:
    out = [f"{name}{levels - 1} AS (SELECT n_nationkey::BIGINT AS idx, sha256({content}) AS hash FROM nation{more})"]
    for k in range(levels - 2, -1, -1):
        out.append(f"{name}{k} AS (SELECT idx // 2 AS idx, sha256(min_by(hash, idx) || max_by(hash, idx)) AS hash FROM {name}{k + 1} GROUP BY 1)")
    return ", ".join(out) + f", {name} AS (" + " UNION ALL ".join(f"SELECT {k}::INT AS level, idx, hash FROM {name}{k}" for k in range(levels)) + ")"


# --- ring ------------------------------------------------------------------------------------------

SERVERS, VNODES, SEED = 5, 8, 3


def _ring(spark):
    return ring.build(spark, SERVERS, VNODES, SEED)


def ring_nodes(spark, d):
    return _ring(spark)


def ring_assign(spark, d):
    return ring.assign(_ring(spark), table(spark, d, "customer").select("c_custkey"), "c_custkey")


def ring_clockwise(spark, d):
    return ring.assign(_ring(spark), table(spark, d, "customer").select("c_custkey"), "c_custkey", "clockwise")


def ring_store_sizes(spark, d):
    return ring_assign(spark, d).groupBy("server").agg(F.count(F.lit(1)).alias("n"))


def ring_capacity(spark, d):
    return ring.server_capacity(_ring(spark))


def ring_node_capacity(spark, d):
    return ring.node_capacity(_ring(spark), 5)


def ring_biggest_gap(spark, d):
    return ring.biggest_gap(_ring(spark))


def ring_add_server(spark, d):
    return ring.server_capacity(ring.add_server(_ring(spark), SERVERS, 1))


def ring_remove_server(spark, d):
    return ring.remove_server(_ring(spark), 2)


_RING = f"""ring AS (SELECT (row_number() OVER (ORDER BY pos, server) - 1)::INT AS ring_idx, pos, server FROM
  (SELECT ('0x' || right(sha256('{SEED}:' || range), 8))::BIGINT AS pos, (range // {VNODES})::INT AS server FROM range({SERVERS * VNODES})))"""
_ARCS = f"""{_RING}, arcs AS (SELECT *, (coalesce(lead(pos) OVER (ORDER BY ring_idx), first(pos) OVER (ORDER BY ring_idx)) - pos + {ring.SPACE}) % {ring.SPACE} AS arc FROM ring)"""
_KEY = "('0x' || right(sha256(c_custkey::VARCHAR), 8))::BIGINT"

# --- graph -----------------------------------------------------------------------------------------


def _supplies(spark, d):
    e = table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("u"), F.concat(F.lit("p"), "l_partkey").alias("v"))
    return graph.from_edges(e)


def graph_degree(spark, d):
    return graph.degree(_supplies(spark, d))


def bfs_hops(spark, d):
    return graph.hops(_supplies(spark, d), "s1")


def shortest_path(spark, d):
    return graph.shortest_path(_supplies(spark, d), "s1", "s5")


def has_path(spark, d):
    return graph.has_path(_supplies(spark, d), "s1", "nowhere")


def graph_edit(spark, d):
    return graph.remove_edge(graph.remove_vertex(_supplies(spark, d), "s2"), "s1", "p1")


def graph_neighbours(spark, d):
    return graph.neighbours(_supplies(spark, d), "s3")


def graph_vertices(spark, d):
    return graph.vertices(_supplies(spark, d), table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("v")))


def graph_edge_exists(spark, d):
    return graph.edge_exists(_supplies(spark, d), "s1", "p2")


_EDGES = """e AS (SELECT DISTINCT 's' || l_suppkey AS u, 'p' || l_partkey AS v FROM lineitem),
g AS (SELECT u, v FROM e UNION SELECT v, u FROM e)"""
_HOPS = f"""WITH RECURSIVE {_EDGES}, reach(v, hops) USING KEY (v) AS (SELECT 's1', 0::BIGINT UNION
SELECT g.v, min(reach.hops) + 1 FROM reach JOIN g ON reach.v = g.u WHERE NOT EXISTS (FROM recurring.reach r WHERE r.v = g.v) GROUP BY g.v)"""

# --- quadtree --------------------------------------------------------------------------------------

CAP, DEPTH = 20, 5


def _points(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", F.col("l_quantity").alias("x"), (F.round(F.col("l_discount") * 100) * 6).alias("y")
    )


def quadtree_leaves(spark, d):
    found = quadtree.leaves(_points(spark, d), 64.0, 64.0, CAP, DEPTH)
    return found.groupBy("depth", "cx", "cy").agg(F.count(F.lit(1)).alias("n"))


def quadtree_query(spark, d):
    return quadtree.query(_points(spark, d), 20.0, 12.0, 64.0, 64.0, CAP, DEPTH).select("l_orderkey")


def quadtree_delete(spark, d):
    found = quadtree.leaves(quadtree.delete(_points(spark, d), 10.0, 18.0), 64.0, 64.0, CAP, DEPTH)
    return found.groupBy("depth", "cx", "cy").agg(F.count(F.lit(1)).alias("n"))


def _quad(where: str = "") -> str:
    p = f"p0 AS (SELECT l_orderkey, l_quantity AS x, round(l_discount * 100) * 6 AS y FROM lineitem), pts AS (SELECT * FROM p0 WHERE x >= 0 AND y >= 0 AND x < 64 AND y < 64 {where})"
    parts, out = [p], []
    for k in range(DEPTH + 1):
        source = "pts" if k == 0 else f"m{k - 1} WHERE n > {CAP}"
        side = 64.0 / (1 << k)
        parts.append(
            f"c{k} AS (SELECT l_orderkey, x, y, floor(x / {side})::BIGINT AS cx, floor(y / {side})::BIGINT AS cy FROM {source}), "
            f"m{k} AS (SELECT *, count(*) OVER (PARTITION BY cx, cy) AS n FROM c{k})"
        )
        out.append(f"SELECT {k}::INT AS depth, cx, cy, l_orderkey FROM m{k}" + (f" WHERE n <= {CAP}" if k < DEPTH else ""))
    return ", ".join(parts) + ", lv AS (" + " UNION ALL ".join(out) + ")"


# --- replicated sequences --------------------------------------------------------------------------


def _atoms(spark, d):
    """Each turn an atom after the one of half its number; odd documents lose their third turn."""
    c = table(spark, d, "conversations")
    return c.select(
        F.col("conv_id").alias("doc"),
        F.concat(F.lit("t"), "turn").alias("id"),
        F.concat(F.lit("["), "text", F.lit("]")).alias("value"),
        F.when(F.col("turn") == 0, "ROOT").otherwise(F.concat(F.lit("t"), F.expr("(turn - 1) div 2"))).alias("predecessor_id"),
        ((F.col("conv_id") % 2 == 1) & (F.col("turn") == 2)).alias("tombstone"),
        (F.lit(1000).cast("bigint") + F.col("turn") % 3).alias("timestamp"),
        F.col("turn").cast("int").alias("sequence"),
        F.lit("site").alias("site_id"),
    )


def crdt_merge(spark, d):
    a = _atoms(spark, d)
    late = crdt.delete(a.where("sequence < 4"), a.where("doc % 5 = 0 AND sequence = 1").select("doc", "id"))
    return crdt.merge(a, late).select("doc", "id", "tombstone")


def crdt_insert(spark, d):
    """A new atom after the first of every document."""
    a = _atoms(spark, d)
    new = a.where("sequence = 0").withColumns({"id": F.lit("new"), "predecessor_id": F.col("id"), "sequence": F.lit(-1)})
    return crdt.insert(a, new).select("doc", "id", "predecessor_id", "tombstone")


def crdt_visible(spark, d):
    return crdt.visible(_atoms(spark, d)).select("doc", "id", "pos")


def crdt_converge(spark, d):
    return crdt.converge(_atoms(spark, d)).select("doc", "text")


_ATOMS = """a AS (SELECT conv_id AS doc, 't' || turn AS id, '[' || text || ']' AS value,
  CASE WHEN turn = 0 THEN 'ROOT' ELSE 't' || ((turn - 1) // 2) END AS parent, conv_id % 2 = 1 AND turn = 2 AS gone,
  1000 + turn % 3 AS ts, turn::INT AS seq FROM conversations),
w(doc, id, value, gone, path) AS (SELECT doc, id, value, gone, [(-ts, -seq, id)] FROM a WHERE parent = 'ROOT'
  UNION ALL SELECT a.doc, a.id, a.value, a.gone, list_append(w.path, (-a.ts, -a.seq, a.id)) FROM a JOIN w ON a.doc = w.doc AND a.parent = w.id)"""

QUERIES = {
    f.__name__: f
    for f in (
        ordered_ceiling, ordered_floor, ordered_search, ordered_successor, ordered_predecessor, ordered_neighbours, ordered_contains,
        ordered_merge_delete, ordered_extent, ordered_point, prefix_scan, prefix_scan_limited, prefix_exists, prefix_has_key, prefix_count_new,
        prefix_update_delete, longest_prefix, inverted_index, index_search, merkle_levels, merkle_root, merkle_widths, merkle_set_leaf,
        merkle_append, merkle_diff, merkle_first_difference, merkle_equals, merkle_diff_leaves, ring_nodes, ring_assign, ring_clockwise,
        ring_store_sizes, ring_capacity, ring_node_capacity, ring_biggest_gap, ring_add_server, ring_remove_server, graph_degree, bfs_hops,
        shortest_path, has_path, graph_edit, graph_neighbours, graph_vertices, graph_edge_exists, quadtree_leaves, quadtree_query,
        quadtree_delete, crdt_merge, crdt_insert, crdt_visible, crdt_converge,
    )
}

_STOP = ", ".join(f"'{w}'" for w in ordered.STOP_WORDS)
_POSTINGS = f"t AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS term FROM documents), post AS (SELECT term, doc_id, count(*) AS tf FROM t WHERE term <> '' AND term NOT IN ({_STOP}) GROUP BY ALL)"

ORACLE = {
    "ordered_ceiling": "SELECT DISTINCT o_orderkey AS key FROM orders WHERE o_orderkey >= 1200",
    "ordered_floor": "SELECT DISTINCT o_orderkey AS key FROM orders WHERE o_orderkey <= 100",
    "ordered_search": "SELECT max(o_custkey) AS key FROM orders WHERE o_custkey <= 77",
    "ordered_successor": "SELECT min(o_custkey) AS key FROM orders WHERE o_custkey > 50",
    "ordered_predecessor": "SELECT max(o_custkey) AS key FROM orders WHERE o_custkey < 50",
    "ordered_neighbours": "SELECT c_nationkey, c_custkey AS key, lag(c_custkey) OVER w AS prev, lead(c_custkey) OVER w AS next FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)",
    "ordered_contains": "SELECT DISTINCT c_custkey AS key, c_custkey IN (SELECT o_custkey FROM orders) AS found FROM customer",
    "ordered_merge_delete": "(SELECT o_custkey AS key FROM orders UNION SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) EXCEPT SELECT s_suppkey FROM supplier",
    "ordered_extent": "SELECT count(DISTINCT o_custkey) AS size, min(o_custkey) AS first, max(o_custkey) AS last FROM orders",
    "ordered_point": "SELECT count(*) > 0 AS found FROM orders WHERE o_orderkey = 42",
    "prefix_scan": "SELECT DISTINCT p_name AS key FROM part WHERE starts_with(p_name, 'red w') AND p_name <> 'red w'",
    "prefix_scan_limited": "SELECT DISTINCT p_name AS key FROM part WHERE starts_with(p_name, 'b') AND p_name <> 'b' ORDER BY 1 LIMIT 3",
    "prefix_exists": "SELECT count(*) > 0 AS found FROM part WHERE starts_with(p_name, 'blue')",
    "prefix_has_key": "SELECT count(*) > 0 AS found FROM part WHERE p_name = 'red w'",
    "prefix_count_new": "SELECT count(DISTINCT c_name) AS n_new FROM customer WHERE c_name NOT IN (SELECT p_name FROM part)",
    "prefix_update_delete": "(SELECT p_name AS key FROM part UNION SELECT s_name FROM supplier) EXCEPT SELECT p_name FROM part WHERE p_partkey % 2 = 0",
    "longest_prefix": """WITH k AS (SELECT left(url, 14) AS key FROM pages UNION SELECT left(url, 22) FROM pages), t AS (SELECT DISTINCT url AS text FROM pages)
SELECT text, coalesce(max_by(key, length(key)), '') AS prefix FROM t LEFT JOIN k ON starts_with(text, key) GROUP BY text""",
    "inverted_index": f"WITH {_POSTINGS} SELECT * FROM post",
    "index_search": f"WITH {_POSTINGS}, q AS (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM post WHERE term IN ('eres', 'inin', 'haha', 'thth')) SELECT doc_id, round(sum(tf * ln((SELECT count(*) FROM documents)::DOUBLE / df)), 6) AS score FROM q GROUP BY 1",
    "merkle_levels": "WITH " + _tree("t", "n_name") + " SELECT * FROM t",
    "merkle_root": "WITH " + _tree("t", "n_name") + " SELECT hash FROM t WHERE level = 0",
    "merkle_widths": "WITH " + _tree("t", "n_name") + " SELECT level, count(*) AS width FROM t GROUP BY 1",
    "merkle_set_leaf": "WITH " + _tree("t", _SET) + " SELECT * FROM t",
    "merkle_append": "WITH " + _tree("t", "n_name", 6, " UNION ALL SELECT 25, sha256('ATLANTIS') UNION ALL SELECT 26, sha256('LEMURIA')") + " SELECT hash FROM t WHERE level = 0",
    "merkle_diff": "WITH " + _tree("t", "n_name") + ", " + _tree("u", _EDIT) + " SELECT t.level, t.idx FROM t JOIN u ON t.level = u.level AND t.idx = u.idx WHERE t.hash <> u.hash",
    "merkle_first_difference": "WITH " + _tree("t", "n_name") + ", " + _tree("u", _EDIT) + " SELECT t.level, t.idx FROM t JOIN u ON t.level = u.level AND t.idx = u.idx WHERE t.hash <> u.hash ORDER BY 1, 2 LIMIT 1",
    "merkle_equals": "SELECT true AS equal",
    "merkle_diff_leaves": """WITH o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, o_orderkey AS k, o_orderstatus || o_orderpriority AS c FROM orders)
SELECT idx FROM o WHERE k % 1000 = 7 OR k % 97 = 0 ORDER BY 1 LIMIT 50""",
    "ring_nodes": f"WITH {_RING} SELECT * FROM ring",
    "ring_assign": f"WITH {_RING} SELECT c_custkey, server FROM customer JOIN ring ON {_KEY} % {SERVERS * VNODES} = ring_idx",
    "ring_clockwise": f"WITH {_RING} SELECT c_custkey, coalesce((SELECT min_by(server, ring_idx) FROM ring WHERE pos >= {_KEY}), (SELECT server FROM ring WHERE ring_idx = 0)) AS server FROM customer",
    "ring_store_sizes": f"WITH {_RING} SELECT server, count(*) AS n FROM customer JOIN ring ON {_KEY} % {SERVERS * VNODES} = ring_idx GROUP BY 1",
    "ring_capacity": f"WITH {_ARCS} SELECT server, sum(arc)::BIGINT AS capacity FROM arcs GROUP BY 1",
    "ring_node_capacity": f"WITH {_ARCS} SELECT arc FROM arcs WHERE ring_idx = 5",
    "ring_biggest_gap": f"WITH {_ARCS} SELECT ring_idx FROM arcs ORDER BY arc DESC, ring_idx LIMIT 1",
    "ring_add_server": f"""WITH {_ARCS}, big AS (SELECT server, arc FROM arcs ORDER BY arc DESC, ring_idx LIMIT 1)
SELECT a.server, (sum(a.arc) - CASE WHEN a.server = any_value(big.server) THEN any_value(big.arc) - any_value(big.arc) // 2 ELSE 0 END)::BIGINT AS capacity
FROM arcs a, big GROUP BY a.server UNION ALL SELECT {SERVERS}, arc - arc // 2 FROM big""",
    "ring_remove_server": f"""WITH {_RING}, twice AS (SELECT ring_idx, server FROM ring UNION ALL SELECT ring_idx + {SERVERS * VNODES}, server FROM ring)
SELECT ring_idx, pos, (SELECT min_by(t.server, t.ring_idx) FROM twice t WHERE t.ring_idx >= ring.ring_idx AND t.server <> 2) AS server FROM ring""",
    "graph_degree": f"WITH {_EDGES} SELECT u, count(*) AS degree FROM g GROUP BY 1",
    "graph_edit": f"WITH {_EDGES} SELECT u, v FROM g WHERE u <> 's2' AND v <> 's2' AND NOT (u = 's1' AND v = 'p1') AND NOT (u = 'p1' AND v = 's1')",
    "graph_neighbours": f"WITH {_EDGES} SELECT DISTINCT v FROM g WHERE u = 's3'",
    "graph_vertices": f"WITH {_EDGES} SELECT u AS v FROM g UNION SELECT 's' || s_suppkey FROM supplier",
    "graph_edge_exists": f"WITH {_EDGES} SELECT count(*) > 0 AS found FROM g WHERE u = 's1' AND v = 'p2'",
    "bfs_hops": _HOPS + " SELECT v, hops FROM reach",
    "shortest_path": _HOPS + " SELECT coalesce(max(hops), -1) AS hops FROM reach WHERE v = 's5'",
    "has_path": "SELECT false AS found",
    "quadtree_leaves": "WITH " + _quad() + " SELECT depth, cx, cy, count(*) AS n FROM lv GROUP BY ALL",
    "quadtree_delete": "WITH " + _quad("AND NOT (x = 10 AND y = 18)") + " SELECT depth, cx, cy, count(*) AS n FROM lv GROUP BY ALL",
    "quadtree_query": "WITH " + _quad() + f", asked AS (SELECT max(depth) AS depth FROM lv WHERE cx = floor(20.0 / (64.0 / (1 << depth))) AND cy = floor(12.0 / (64.0 / (1 << depth)))) SELECT l_orderkey FROM lv WHERE cx = floor(20.0 / (64.0 / (1 << depth))) AND cy = floor(12.0 / (64.0 / (1 << depth)))",
    "crdt_merge": "SELECT conv_id AS doc, 't' || turn AS id, bool_or((conv_id % 2 = 1 AND turn = 2) OR (conv_id % 5 = 0 AND turn = 1)) AS tombstone FROM conversations GROUP BY ALL",
    "crdt_insert": f"WITH RECURSIVE {_ATOMS} SELECT doc, id, parent AS predecessor_id, gone AS tombstone FROM a UNION ALL SELECT doc, 'new', 't0', gone FROM a WHERE id = 't0'",
    "crdt_converge": f"WITH RECURSIVE {_ATOMS} SELECT doc, coalesce(string_agg(value, '' ORDER BY path) FILTER (NOT gone), '') AS text FROM w GROUP BY doc",
    "crdt_visible": f"WITH RECURSIVE {_ATOMS}, n AS (SELECT doc, id, gone, row_number() OVER (PARTITION BY doc ORDER BY path) - 1 AS pos FROM w) SELECT doc, id, pos FROM n WHERE NOT gone",
}
