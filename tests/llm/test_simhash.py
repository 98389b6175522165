import random

import numpy as np
import pytest
import xxhash

from gristmill.llm import simhash
from gristmill.llm.components import components


def plain(text, k):
    w = [x for x in (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ").split(" ") if x]
    if not w:
        return 0
    hs = [xxhash.xxh64(" ".join(w[i : i + k]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def roots(nodes, pairs):
    at = {n: n for n in nodes}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        at[b] = a
    return {n: find(n) for n in nodes}


def test_fingerprint_is_the_majority_of_shingle_hashes():
    rng = random.Random(1)
    for n in (0, 1, 3, 4, 5, 60):
        text = " \n".join(rng.choice(["Aa", "éÉ", "c", "DD"]) + str(rng.randrange(9)) for _ in range(n))
        assert simhash.fingerprint(text, 4) == [plain(text, 4)]
    assert simhash.fingerprint(None, 4) == [0]


def test_anchors_cover_every_word_within_one_bit():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2**63, 300).astype(np.uint64).reshape(-1, 1)
    for bit in range(21):
        y = x | np.uint64(1 << bit)
        x0 = y ^ np.uint64(1 << bit)
        home, _, _ = simhash.anchors(x0, [(0, 21)])
        own, rows, cells = simhash.anchors(y, [(0, 21)])
        seen = set(zip(rows.tolist(), cells.tolist()))
        assert len(seen) == len(rows)
        assert all(own[i] == h or (i, int(h)) in seen for i, h in enumerate(home))


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(50)]
    texts = [None, "", "  \n", "one", "One", "a b c d"]
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([30, 300]))]
        texts.append(" ".join(base))
        for _ in range(12):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2])):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w))
    rows = [(i, t, 1.5) for i, t in enumerate(texts)] + [(3, "one", 2.5)]
    spark.createDataFrame(rows, "doc_id long, text string, fingerprint double").write.parquet(f"{tmp_path}/documents.parquet")
    got = simhash.op3_simhash(spark, str(tmp_path)).collect()
    fps = {i: plain(t, 4) for i, t, _ in rows}
    pairs = [(a, b) for a in fps for b in fps if a < b and bin(fps[a] ^ fps[b]).count("1") <= 4]
    want = roots(fps, pairs)
    assert len(got) == len(rows)
    assert {(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in got} == {(i, fps[i], want[i]) for i in fps}
    assert all(len(r.fingerprint) == 16 for r in got)


@pytest.mark.parametrize("blocks,take", [(3, 1), (5, 2), (6, 3)])
def test_split_anchors_lose_no_link(spark, monkeypatch, blocks, take):
    monkeypatch.setattr(simhash, "HOMES", 2)
    base = 0x123456789ABCDEF0
    fps = sorted({base ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(12)})
    nodes = spark.createDataFrame([(bytearray(f.to_bytes(8, "big")),) for f in fps], "fp binary")
    found = simhash.links(nodes, 64, simhash.keys_of(64, blocks, take), 4)
    got = {int.from_bytes(r.node): int.from_bytes(r.root) for r in components(found).collect()}
    pairs = [(a, b) for a in fps for b in fps if a < b and bin(a ^ b).count("1") <= 4]
    assert got == roots(fps, pairs)
    assert len(pairs) > 5 * found.count()


def test_keys_widen_with_the_data_and_stay_sure():
    widths = []
    for n in (10**3, 10**6, 10**9, 10**11):
        keys = simhash.layout(64, 4, n)
        widths.append(sum(size for _, size in keys[0]))
        for trial in range(200):
            bits = random.Random(trial).sample(range(64), 4)
            assert min(sum(first <= b < first + size for b in bits for first, size in key) for key in keys) <= 1
    assert widths == sorted(widths) and widths[0] < widths[-1]
    assert [simhash.sure(3, 1), simhash.sure(5, 2), simhash.sure(6, 3)] == [5, 4, 4]


def test_spanning_forest_takes_the_first_edges():
    a, b = np.array([0, 1, 0, 3, 4]), np.array([1, 2, 2, 4, 5])
    assert sorted(simhash.spanning(a, b, 7).tolist()) == [0, 1, 3, 4]


def test_groups_over_many_batches(spark):
    base = 0x0F0F0F0F12345678
    fps = sorted({base ^ (1 << i) ^ (1 << j) ^ (1 << k) for i in range(30, 52) for j in range(30, 52) for k in range(30, 52)})
    nodes = spark.createDataFrame([(bytearray(f.to_bytes(8, "big")),) for f in fps], "fp binary").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = components(simhash.links(nodes, 64, simhash.keys_of(64, 3, 1), 2)).select("root").distinct().count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pairs = [(f, f ^ (1 << i) ^ (1 << j)) for f in fps for i in range(30, 52) for j in range(30, i)]
    known = set(fps)
    assert got == len(set(roots(fps, [p for p in pairs if p[1] in known]).values()))


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    pairs += [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    real = [(a, b) for a, b in pairs if a is not None and a != b]
    assert got == roots({x for p in real for x in p}, real)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_dedup_keeps_one_of_each_group(spark):
    rng = random.Random(5)
    base = [str(rng.randrange(10**6)) for _ in range(400)]
    near = base[:200] + ["x"] + base[201:]
    other = [str(rng.randrange(10**6)) for _ in range(400)]
    rows = [(1, " ".join(base), 1), (2, " ".join(base), 2), (3, " ".join(near), 3), (4, " ".join(other), 4), (4, " ".join(other), 4), (None, None, 5), (9, "", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int")
    out = simhash.dedup_documents(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.id) for r in out.collect()) == [(1, 1), (4, 4), (9, 6)]
    assert simhash.dedup_documents(docs.limit(0)).count() == 0
