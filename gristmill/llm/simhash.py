"""SimHash near-duplicates, joined by anchor points of a covering code.

Fingerprints are cut into blocks, and a key is some of the blocks. By the pigeonhole two fingerprints that differ in
few bits agree up to one bit in some key (see sure). The anchors of a key are the words of a
covering code: a perfect Hamming code of length 15 (covering radius 1) on its first 15 bits, and every
word on the rest (radius 0). A fingerprint has its home at its nearest anchor and is replicated to the
anchors within covering radius plus threshold whose cell comes within one bit of it: 7 + (bits - 15) at
most. Of two fingerprints that differ in one bit of a key, the one that has the bit set visits the other,
so only flips of set bits are followed. Fingerprints are compared only at anchors: homes with homes and
with visitors. Keys widen with the number of fingerprints, so an anchor stays small at any scale.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import jaccard
from gristmill.llm.common import KEY, ROW, cut, rejoin, ship, small, table
from gristmill.llm.components import components
from gristmill.llm.shingles import shingles

#: Homes that one task compares at an anchor; anchors with more are split by a salt of the homes.
HOMES = 4096
#: Pairs that are compared in one vectorised step.
STEP = 1 << 20
#: Bits of the salt in an anchor's number, and the widest key, so that all of them fit 63 bits.
SALT, WIDEST = 20, 36
#: What sending one row to an anchor costs, in comparisons.
ROW_WORK = 200
#: Near copies: what the keys are sure to find, and the bits that their candidates may differ in.
SURE, NEAR = 5, 10


def _bit_table() -> np.ndarray:
    return (np.arange(256)[:, None] >> np.arange(8)) & 1


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th word of bits of a shingle's hash: h itself, then SplitMix64 steps from it."""
    if not k:
        return h
    z = h + np.uint64((k * 0x9E3779B97F4A7C15) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def votes(h: np.ndarray, words: int = 1) -> list[int]:
    """The fingerprint of shingle hashes: a bit is 1 if it is set in over half of them; without any, all zero."""
    if not len(h):
        return [0] * words
    out = []
    for k in range(words):
        octets = _mixed(h, k).view(np.uint8).reshape(-1, 8)
        counts = np.concatenate([np.bincount(octets[:, j], minlength=256) @ _BITS for j in range(8)])
        out.append(int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0]))
    return out


def fingerprint(text: str | None, shingle: int, words: int = 1) -> list[int]:
    """Lower-cased (A-Z) words, shingles with repeats, XXH64 of each, and their votes.

    words: how many 64-bit words the fingerprint has. No text or no word: all zero. Fewer words than a
    shingle: one shingle of all of them.
    """
    return votes(shingles(text, shingle), words)


_BITS = _bit_table()


def fingerprints(docs: DataFrame, keep: list[str], shingle: int, words: int = 1, text: str = "text") -> DataFrame:
    """keep, and fp: the fingerprint as a binary of 8 * words bytes."""

    @F.arrow_udf("binary")
    def fp(texts: pa.Array) -> pa.Array:
        rows = [np.array(fingerprint(t.as_py(), shingle, words), ">u8").tobytes() for t in texts]
        return pa.array(rows, pa.binary())

    return docs.select(*keep, fp(F.col(text)).alias("fp"))


def sure(blocks: int, take: int) -> int:
    """Bits that two fingerprints may differ in while some `take` of `blocks` blocks hold one of them at most."""
    alone = 2 * (blocks - take + 1)
    return (min(alone, blocks - take + 2) if take > 1 else alone) - 1


def keys_of(bits: int, blocks: int, take: int) -> list[list[tuple[int, int]]]:
    """For each choice of `take` blocks the (first bit, bits) of these blocks; a key has 15 to WIDEST bits."""
    cuts = [bits * k // blocks for k in range(blocks + 1)]
    out = [list(c) for c in itertools.combinations([(a, b - a) for a, b in zip(cuts, cuts[1:])], take)]
    width = [sum(n for _, n in key) for key in out]
    if min(width) < 15 or max(width) > WIDEST:
        raise ValueError(f"a key needs 15 to {WIDEST} bits")
    return out


def layout(bits: int, distance: int, n: int) -> list[list[tuple[int, int]]]:
    """The keys of least expected work for n fingerprints among those that are sure to find links of `distance` bits.

    Wider keys send a fingerprint to more anchors and compare it with fewer others there: the pairs at an anchor
    grow with n over 2^(width - 4), so the width follows the logarithm of n and the work stays about linear.
    """
    best = None
    for blocks in range(1, 13):
        for take in range(1, blocks + 1):
            low, high = bits // blocks * take, -(-bits // blocks) * take
            if low < 15 or high > WIDEST or sure(blocks, take) < distance:
                continue
            keys, width = math.comb(blocks, take), bits * take // blocks
            work = keys * (1 + 3.3 + (width - 15) / 2) * (ROW_WORK + n / 2 ** (width - 4))
            if best is None or work < best[0]:
                best = work, blocks, take
    if best is None:
        raise ValueError("no keys are sure to find links of so many bits")
    return keys_of(bits, *best[1:])


@functools.cache
def _hamming() -> tuple[np.ndarray, np.ndarray]:
    """For each word of 15 bits the number of its nearest code word, and the numbers of the other code words whose
    cell is one set bit away (7 at most; the rest -1)."""
    x = np.arange(1 << 15)
    syndrome = np.zeros_like(x)
    for bit in range(15):
        syndrome ^= np.where(x >> bit & 1, bit + 1, 0)
    nearest = x ^ np.where(syndrome > 0, 1 << np.maximum(syndrome - 1, 0), 0)
    number = np.full(1 << 15, -1)
    code = x[syndrome == 0]
    number[code] = np.arange(len(code))
    others = np.full((1 << 15, 7), -1)
    fill = np.zeros(1 << 15, np.int64)
    for i in range(15):
        for j in range(i):
            y = x ^ (1 << i) ^ (1 << j)
            at = np.flatnonzero((syndrome[y] == 0) & (syndrome > 0) & ((x >> i | x >> j) & 1 > 0))
            others[at, fill[at]] = number[y[at]]
            fill[at] += 1
    return number[nearest], others


def _field(fps: np.ndarray, first: int, bits: int) -> np.ndarray:
    """bits of the fingerprints (n, words) from bit `first` on, as integers."""
    k, off = divmod(first, 64)
    x = fps[:, k] >> np.uint64(off)
    if off + bits > 64:
        x = x | (fps[:, k + 1] << np.uint64(64 - off))
    return (x & np.uint64((1 << bits) - 1)).astype(np.int64)


def anchors(fps: np.ndarray, key: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home anchors of the fingerprints for a key, and (row, anchor) of every visit elsewhere."""
    home15, near15 = _hamming()
    x, bits = np.zeros(len(fps), np.int64), 0
    for first, n in key:
        x |= _field(fps, first, n) << bits
        bits += n
    low, rest = x & 0x7FFF, x >> 15
    rows, cells = [], []
    for j in range(7):
        other = near15[low, j]
        at = np.flatnonzero(other >= 0)
        rows.append(at)
        cells.append(rest[at] << 11 | other[at])
    for j in range(bits - 15):
        at = np.flatnonzero(rest >> j & 1)
        rows.append(at)
        cells.append((rest[at] ^ (1 << j)) << 11 | home15[low[at]])
    return rest << 11 | home15[low], np.concatenate(rows), np.concatenate(cells)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of n nodes reaches over the pairs a, b."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which of the edges a, b over n nodes make up a spanning forest: every component, in rounds, takes its first edge
    that leads to another one."""
    label, taken, open_ = np.arange(n), np.zeros(0, np.int64), np.arange(len(a))
    while True:
        open_ = open_[label[a[open_]] != label[b[open_]]]
        if not len(open_):
            return taken
        first = np.full(n, len(a))
        np.minimum.at(first, label[a[open_]], open_)
        np.minimum.at(first, label[b[open_]], open_)
        taken = np.concatenate([taken, np.unique(first[first < len(a)])])
        label = forest(a[taken], b[taken], n)


def _limbs(column: pa.Array, words: int) -> np.ndarray:
    chunk = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(chunk.to_pylist()), ">u8").astype(np.uint64).reshape(-1, words)


def _near(fps: np.ndarray, hi: np.ndarray, vi: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, ...]]:
    d = np.zeros(len(hi), np.int64)
    for k in range(fps.shape[1]):
        d += np.bitwise_count(fps[hi, k] ^ fps[vi, k])
    ok = (d <= distance) & (vi > hi)
    if ok.any():
        yield hi[ok], vi[ok], d[ok]


def _matches(fps: np.ndarray, h_at: np.ndarray, h_n: np.ndarray, v_at: np.ndarray, v_n: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Linked (home, other, differing bits) of groups: group g compares rows h_at[g] + 0..h_n[g] with rows v_at[g] + 0..v_n[g] that
    come after them, in steps of about STEP pairs."""
    total = h_n * v_n
    g, group_ends = 0, np.cumsum(total)
    while g < len(total):
        done = group_ends[g - 1] if g else 0
        end = max(g + 1, int(np.searchsorted(group_ends, done + STEP, "right")))
        if end == g + 1 and total[g] > STEP:
            per = max(1, STEP // max(1, int(v_n[g])))
            for k in range(0, int(h_n[g]), per):
                m = min(per, int(h_n[g]) - k)
                hi = np.repeat(np.arange(h_at[g] + k, h_at[g] + k + m), v_n[g])
                yield from _near(fps, hi, np.tile(np.arange(v_at[g], v_at[g] + v_n[g]), m), distance)
        else:
            t = total[g:end]
            which = np.repeat(np.arange(g, end), t)
            off = np.arange(int(t.sum())) - np.repeat(np.cumsum(t) - t, t)
            yield from _near(fps, h_at[which] + off // v_n[which], v_at[which] + off % v_n[which], distance)
        g = end


def links(prints: DataFrame, bits: int, keys: list[list[tuple[int, int]]], distance: int) -> DataFrame:
    """Pairs (a, b) of fingerprints of at most `distance` differing bits that connect the same fingerprints as all such
    pairs that differ in one bit of some key at most.

    prints: (fp binary), distinct. Each comparing task returns a spanning forest of the links that it
    found, the closest first, so a dense group of n near copies gives about n edges, not n squared. Anchors with over HOMES
    homes are split: homes are salted, and visit the lower salts; visitors go to every salt.
    """
    words = bits // 64

    def spread(batches: Iterator[pa.RecordBatch], homes_only: bool = False) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                piece = batch.slice(at, 2000)
                fps, base = _limbs(piece.column("fp"), words), 0
                for key in keys:
                    home, rows, cells = anchors(fps, key)
                    if homes_only:
                        yield pa.RecordBatch.from_arrays([pa.array(base + home)], ["cell"])
                    else:
                        # place: the anchor, SALT bits for a salt, and 1 for a visitor, so that homes sort first
                        place = np.concatenate([(base + home) << SALT + 1, (base + cells) << SALT + 1 | 1])
                        who = pa.array(np.concatenate([np.arange(len(home)), rows]))
                        yield pa.RecordBatch.from_arrays([pa.array(place), piece.column("fp").take(who)], ["place", "fp"])
                    base += 1 << (sum(n for _, n in key) - 4)

    crowded = cut(
        prints.mapInArrow(lambda it: spread(it, True), "cell long")
        .groupBy("cell").count().where(f"count > {HOMES}")
        .select(F.col("cell").alias("crowded"), F.ceil(F.col("count") / HOMES).cast("int").alias("salts"))
    )
    dealt = prints.mapInArrow(spread, "place long, fp binary")
    if not crowded.isEmpty():
        met = dealt.join(small(crowded), F.shiftright("place", SALT + 1) == F.col("crowded"), "left")
        salted = F.expr(
            """CASE WHEN salts IS NULL THEN array(place)
            WHEN place % 2 = 1 THEN transform(sequence(0, salts - 1), s -> place + 2 * s)
            ELSE transform(sequence(0, pmod(xxhash64(fp), salts)), s -> place + 2 * s + IF(s < pmod(xxhash64(fp), salts), 1, 0)) END"""
        )
        dealt = met.select(F.explode(salted).alias("place"), "fp")
    dealt = dealt.repartition(F.shiftright("place", 1)).sortWithinPartitions("place")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, np.zeros((0, words), np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            place, fps = batch.column("place").to_numpy(), _limbs(batch.column("fp"), words)
            key, home = place >> 1, place % 2 == 0
            old = 0
            if last == key[0]:  # the homes of the group that the last batch ended in
                old = len(carried)
                key = np.concatenate([np.full(old, last), key])
                home = np.concatenate([np.ones(old, bool), home])
                fps = np.concatenate([carried, fps])
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(starts, len(key)))
            h_n = np.add.reduceat(home.astype(np.int64), starts)
            last, carried = key[-1], fps[starts[-1] : starts[-1] + h_n[-1]].copy()
            v_at, v_n = starts.copy(), size.copy()
            v_at[0], v_n[0] = v_at[0] + old, v_n[0] - old  # the carried homes have met one another
            found = list(_matches(fps, starts, h_n, v_at, v_n, distance))
            if found:
                a, b, apart = (np.concatenate(side) for side in zip(*found))
                closest = np.argsort(apart, kind="stable")
                rows, at = np.unique(np.concatenate([a[closest], b[closest]]), return_inverse=True)
                names, one = np.unique(fps[rows].byteswap().view(f"V{8 * words}").ravel(), return_inverse=True)
                a, b = one[at].reshape(2, -1)
                keep = spanning(a, b, len(names))
                if len(keep):
                    sides = [pa.array([x.tobytes() for x in names[end[keep]]], pa.binary()) for end in (np.minimum(a, b), np.maximum(a, b))]
                    yield pa.RecordBatch.from_arrays(sides, ["a", "b"])

    return dealt.mapInArrow(compare, "a binary, b binary").distinct()


def near_duplicates(printed: DataFrame, id_col: str, bits: int, distance: int) -> DataFrame:
    """Adds component_id, the least id_col reachable over links, to (id_col, fp, ...).

    Equal fingerprints meet first, in a partial aggregate; only distinct ones are joined, by keys chosen from their
    number, and every link is found. An id_col that is null never names a component unless all of it are null.
    """
    ship(printed.sparkSession)
    printed = cut(printed)
    nodes = cut(printed.groupBy("fp").agg(F.min(id_col).alias("gm_least")))
    roots = components(links(nodes.select("fp"), bits, layout(bits, distance, nodes.count()), distance))
    linked = cut(nodes.join(roots, F.col("fp") == F.col("node"), "left").withColumn("gm_root", F.coalesce("root", "fp")))
    least = cut(linked.groupBy("gm_root").agg(F.min("gm_least").alias("component_id")).withColumnRenamed("gm_root", "gm_r"))
    named = linked.join(least, F.col("gm_root") == F.col("gm_r")).select(F.col("fp").alias("gm_fp"), "component_id")
    return printed.join(named, F.col("fp") == F.col("gm_fp")).select(*printed.columns, "component_id")


def near_copies(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """KEY of the least document of each component over links of a Jaccard similarity of `similarity` or more.

    Documents with the same shingle set are one node (all without a word, too). Nodes whose fingerprints meet at an
    anchor and differ in NEAR bits at most are held against each other by their sets, exactly; fingerprints of 64
    bits miss some pairs of that similarity, so jaccard.missing then searches the pairs that are not yet connected.
    """
    ship(docs.sparkSession)

    def prints(s: np.ndarray) -> bytes:
        return np.array(votes(s, 1), ">u8").tobytes()

    nodes = jaccard.nodes(docs, shingle, prints)
    same = nodes.groupBy("fp").agg(F.min("id").alias("first"))
    same = cut(same)
    least = same.select(F.col("fp").alias("f"), "first")
    equal = nodes.join(least, F.col("fp") == F.col("f")).where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    near = links(same.select("fp"), 64, layout(64, SURE, same.count()), NEAR)
    x, y = (same.select(F.col("fp").alias(f"f{side}"), F.col("first").alias(f"i{side}")) for side in "ab")
    met = near.join(x, F.col("a") == F.col("fa")).join(y, F.col("b") == F.col("fb")).select(F.col("ia").alias("a"), F.col("ib").alias("b"))
    found = jaccard.verified(cut(equal.union(met)), nodes, docs, shingle, similarity)
    roots = jaccard.missing(docs, nodes, found, shingle, similarity).withColumnRenamed("node", "gm_node")
    grouped = nodes.join(roots, F.col("node") == F.col("gm_node"), "left").groupBy(F.coalesce("root", "node").alias("gm_root"))
    return grouped.agg(F.min("gm_least").alias("gm_least")).select(*[F.col(f"gm_least.{c}") for c in KEY])


def dedup_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each near-duplicate group of docs: the one of least doc_id (then least row hash; a null doc_id last).

    Documents link when their sets of shingles of `shingle` words have a Jaccard similarity of `similarity` or more;
    every such pair does, and no other. Null, empty and wordless texts are a group of their own; a text of fewer
    words than a shingle is one shingle; texts of any length are compared whole; repeated rows are one document.
    Without rows the result is empty; further columns pass through, whatever their names and types.
    """
    return rejoin(docs, near_copies(docs, shingle, similarity)).select(f"{ROW}.*")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document: 4-word shingles, links at 4 differing bits or fewer.

    A null, empty or wordless text has fingerprint 0, which links like any other. Ties and repeated rows
    share a component; a null doc_id keeps its row and never names a component that has a known one. Texts are
    read whole, at any length; other columns are not read; without rows the result is empty.
    """
    printed = fingerprints(table(spark, sf_dir, "documents"), ["doc_id"], 4)
    return near_duplicates(printed, "doc_id", 64, 4).select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
