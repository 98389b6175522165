"""Exact Jaccard similarity of shingle sets: verification of candidate pairs, and a prefix filter for what fingerprints miss.

The shingles of all sets are put in one order. Of two sets whose similarity is t at least, the first
n - ceil(t * n) + 1 shingles of either (n: its size) share one, so the pairs that meet at a shared prefix shingle are all
that can link. At the first one they share, sizes and positions bound their overlap. The same bound, with the least size
at a shingle in place of a partner's, takes out the sets that have no partner there before any pair is made. Pairs that
pass are held against each other by counts of their shingles in cells, which bound the difference from below, and the rest
by the sets themselves. No bound drops a pair of similarity t.

Shingles that many documents hold come last in the order, which keeps the groups small; any order gives the same links.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import KEY, ROW, cut, keyed, small
from gristmill.llm.components import components
from gristmill.llm.shingles import SEED, shingles

#: One text of EVERY is looked at for the order; a shingle that COMMON of them hold comes late, MOST such at most.
EVERY, COMMON, MOST = 25, 4, 1 << 20
#: Room for rounding in the bounds on sizes and overlaps, which are integers.
SLACK = 1e-6
#: Repeats of a document within so many of a task are sent once.
SEEN = 100_000
#: Sets whose sizes lie within this ratio have one hub at a shingle. It decides which pairs come first, not what links.
BAND = 1.25


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct shingle hashes in rising order."""
    return np.unique(shingles(text, shingle))


def _node(s: np.ndarray) -> bytes:
    return xxhash.xxh128_digest(s.tobytes(), SEED)


def _ids(nodes: list[bytes]) -> pa.Array:
    """The first 8 bytes of nodes, as the numbers that candidate pairs are made of. Nodes that agree in them by chance are
    all looked up when a pair is verified."""
    return pa.array(np.frombuffer(b"".join(n[:8] for n in nodes), ">i8").astype(np.int64))


def nodes(docs: DataFrame, shingle: int, prints: Callable[[np.ndarray], bytes]) -> DataFrame:
    """One row for each distinct shingle set: node (a digest of it), id, gm_least (the KEY of its least document, a null
    doc_id last), size, cells (counts of shingles in 128 cells, up to 255) and fp (prints of the set)."""

    @F.arrow_udf("struct<node:binary,id:bigint,size:int,cells:binary,fp:binary>")
    def profile(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts:
            s = shingle_set(t.as_py(), shingle)
            cells = np.bincount((s >> np.uint64(57)).astype(np.int64), minlength=128)
            rows.append((_node(s), len(s), np.minimum(cells, 255).astype(np.uint8).tobytes(), prints(s)))
        node, size, cells, fp = zip(*rows) if rows else ((), (), (), ())
        columns = [pa.array(node, pa.binary()), _ids(node), pa.array(size, pa.int32()), pa.array(cells, pa.binary()), pa.array(fp, pa.binary())]
        return pa.StructArray.from_arrays(columns, ["node", "id", "size", "cells", "fp"])

    each = keyed(docs).select(*KEY, profile(F.col(ROW)["text"]).alias("p")).select(*KEY, "p.*")
    least = F.min(F.struct(F.col("gm_id").isNull().alias("gm_null"), *KEY)).alias("gm_least")
    return cut(each.groupBy("node").agg(least, *[F.min(c).alias(c) for c in ("id", "size", "cells", "fp")]))


def _common(docs: DataFrame, shingle: int) -> np.ndarray:
    """Shingles that come late in the order, rising."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.as_py(), shingle).view(np.int64))], ["token"])

    looked = docs.select("text").where(f"pmod(xxhash64(text), {EVERY}) = 0").distinct()
    held = looked.mapInArrow(tokens, "token long").groupBy("token").count().where(f"count >= {COMMON}")
    # At most MOST numbers.
    found = held.orderBy(F.desc("count")).limit(MOST).select("token").toArrow().column("token").to_numpy()
    return np.sort(found.astype(np.int64).view(np.uint64))


def _prefixes(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(token, id, span): the prefix shingles of every set; span has the size of the set and the place in the order."""
    late = docs.sparkSession.sparkContext.broadcast(_common(docs, shingle))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                tokens, nodes, sizes = [], [], []
                for t in batch.column(0).slice(at, 500):
                    s = shingle_set(t.as_py(), shingle)
                    if not len(s) or (node := _node(s)) in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(node)
                    last = np.isin(s, late.value, assume_unique=True)
                    take = len(s) - math.ceil(similarity * len(s) - SLACK) + 1
                    tokens.append(np.concatenate([s[~last], s[last]])[:take])
                    nodes.append(node)
                    sizes.append(len(s))
                if not nodes:
                    continue
                n = [len(x) for x in tokens]
                place = np.concatenate([np.arange(k) for k in n])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(tokens).view(np.int64)),
                        _ids(nodes).take(pa.array(np.repeat(np.arange(len(n)), n))),
                        pa.array(np.repeat(np.array(sizes, np.int64), n) << 32 | place),
                    ],
                    ["token", "id", "span"],
                )

    return docs.select("text").mapInArrow(spread, "token long, id long, span long")


def _size(span: Column) -> Column:
    return F.shiftright(span, 32)


def _rest(span: Column) -> Column:
    """Shingles of a set from its place in the order on."""
    return _size(span) - span.bitwiseAND(F.lit((1 << 32) - 1))


def _overlap(similarity: float, a: Column, b: Column) -> Column:
    """The least overlap of two sets of sizes a and b that makes up the similarity."""
    return similarity / (1 + similarity) * (a + b) - SLACK


def _possible(similarity: float, a: Column, b: Column) -> Column:
    """Whether sizes and positions leave room for the similarity, at the first shared shingle."""
    size = [_size(x) for x in (a, b)]
    return (F.least(*size) >= similarity * F.greatest(*size) - SLACK) & (F.least(_rest(a), _rest(b)) >= _overlap(similarity, *size))


def _several(df: DataFrame, name: str) -> DataFrame:
    """The rows of shingles at which several values of a column meet."""
    at = Window.partitionBy("token")
    ends = df.withColumns({"gm_lo": F.min(name).over(at), "gm_hi": F.max(name).over(at)})
    return ends.where("gm_lo <> gm_hi").drop("gm_lo", "gm_hi")


def _roomy(met: DataFrame, similarity: float) -> DataFrame:
    """The rows whose set has room for the similarity with a set of the least size at the shingle: _possible is false for
    the others, whomever they meet there."""
    size, least = _size(F.col("span")), F.min(_size(F.col("span"))).over(Window.partitionBy("token"))
    partner = F.greatest(least, similarity * size - SLACK)
    room = met.withColumn("gm_room", _rest(F.col("span")) >= _overlap(similarity, size, partner) - SLACK)
    return room.where("gm_room").drop("gm_room")


def _with_hubs(apart: DataFrame, similarity: float) -> DataFrame:
    """(a, b): every set with the hub of its band of sizes at each shingle, if they are not connected: the set that has
    most left there, as the one that edits have changed least does. These are no more pairs than rows."""
    banded = apart.withColumn("band", F.floor(F.log(BAND, _size(F.col("span")))))
    first = F.max(F.struct(_rest(F.col("span")).alias("rest"), "id", "span", "root"))
    hubs = banded.groupBy(F.col("token").alias("h_token"), F.col("band").alias("h_band")).agg(first.alias("hub"))
    met = banded.join(hubs, (F.col("token") == F.col("h_token")) & (F.col("band") == F.col("h_band")))
    met = met.where((F.col("root") != F.col("hub.root")) & _possible(similarity, F.col("span"), F.col("hub.span")))
    return met.select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")).distinct()


def _all_pairs(apart: DataFrame, similarity: float) -> DataFrame:
    """(a, b), once for each shingle that they share: all pairs that can link and are not connected."""
    x, y = (apart.select("token", *[F.col(c).alias(n) for c, n in (("id", k), ("root", f"{k}_root"), ("span", f"{k}_span"))]) for k in "ab")
    can = (F.col("a") < F.col("b")) & (F.col("a_root") != F.col("b_root")) & _possible(similarity, F.col("a_span"), F.col("b_span"))
    return x.join(y, "token").where(can).select("a", "b")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b): the nodes of those pairs of ids whose sets have the similarity."""

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, 128).astype(np.int16) for c in ("a_cells", "b_cells"))
            total = batch.column("a_size").to_numpy().astype(np.int64) + batch.column("b_size").to_numpy()
            apart = np.abs(x - y).sum(axis=1, dtype=np.int64)
            ok = apart <= (1 - similarity) / (1 + similarity) * total + SLACK
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for a, b in zip(batch.column("a_set"), batch.column("b_set")):
                x, y = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both / (len(x) + len(y) - both) >= similarity)
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    @F.arrow_udf("binary")
    def whole(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_set(t.as_py(), shingle).tobytes() for t in texts], pa.binary())

    def side(table: DataFrame, name: str) -> DataFrame:
        return table.select(*[F.col(c).alias(name if c == "node" else f"{name}_{c}") for c in table.columns])

    light = nodes.where("size > 0").select("node", "id", "size", "cells")
    asked = pairs.select(F.col("a").alias("p"), F.col("b").alias("q"))
    met = asked.join(side(light, "a"), F.col("p") == F.col("a_id")).join(side(light, "b"), F.col("q") == F.col("b_id"))
    left = cut(met.mapInArrow(close, "a binary, b binary"))
    wanted = left.select(F.explode(F.array("a", "b")).alias("w")).distinct()
    keys = wanted.join(nodes, F.col("w") == F.col("node")).select("node", *[F.col(f"gm_least.{c}").alias(f"k_{c}") for c in KEY[1:]])
    on = (F.col(KEY[1]) == F.col(f"k_{KEY[1]}")) & (F.col(KEY[2]) == F.col(f"k_{KEY[2]}"))
    texts = keyed(docs).select(*KEY[1:], F.col(ROW)["text"].alias("text")).join(small(keys), on).select("node", "text").dropDuplicates(["node"])
    sets = cut(texts.select("node", whole("text").alias("set")))
    return cut(left.join(side(sets, "a"), "a").join(side(sets, "b"), "b").mapInArrow(alike, "a binary, b binary"))


def missing(docs: DataFrame, nodes: DataFrame, links: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(node, root): for every node that pairs of the similarity connect to another, the least node that it reaches.
    links (a, b): verified links of any part of these pairs, such as those that fingerprints find.

    Nodes that share prefix shingles and that no link connects yet are held against each other: first, in a number of
    pairs that grows with the rows, against hubs, to which most of a large group of near copies links; then the nodes
    that are not connected even so, in all pairs that the bounds leave.
    """
    ids = cut(nodes.select(F.col("node").alias("n"), "id"))

    def apart(met: DataFrame, roots: DataFrame) -> DataFrame:
        named = cut(roots.join(ids, F.col("a") == F.col("n")).select(F.col("id").alias("i"), F.xxhash64("b").alias("r")))
        known = met.join(named, F.col("id") == F.col("i"), "left")
        return cut(_several(known.select("token", "id", "span", F.coalesce("r", F.xxhash64("id")).alias("root")), "root"))

    def connected(links: DataFrame) -> DataFrame:
        return cut(components(links)).select(F.col("node").alias("a"), F.col("root").alias("b"))

    roots = connected(links)
    met = apart(cut(_roomy(_several(_prefixes(docs, shingle, similarity), "id"), similarity).distinct()), roots)
    roots = connected(roots.union(verified(cut(_with_hubs(met, similarity)), nodes, docs, shingle, similarity)))
    met = apart(met.drop("root"), roots)
    more = verified(cut(_all_pairs(met, similarity).distinct()), nodes, docs, shingle, similarity)
    return components(cut(roots.union(more)))
