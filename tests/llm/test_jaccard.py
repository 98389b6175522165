import random

from gristmill.llm import jaccard, simhash


def grams(text):
    w = text.lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def survivors(texts):
    """Brute force: the least id of each component over all pairs with a Jaccard of 0.8 or more."""
    sets, at = [grams(t) for t in texts], list(range(len(texts)))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for b in range(len(sets)):
        for a in range(b):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                at[y] = x
    return {i for i in range(len(texts)) if find(i) == i}


def corpus():
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(5000)}"
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rng.choice([5, 40, 120, 300]))]
        texts.append(base)
        for _ in range(8):
            w = list(base)
            for _ in range(rng.randrange(1, max(2, len(w) // 30))):
                w[rng.randrange(len(w))] = word()
            texts.append(w)
        texts.append(passage + [word() for _ in range(rng.randrange(5, 60))])
    texts.append(texts[0] + texts[0])
    return [" ".join(w) for w in texts]


def test_dedup_against_brute_force(spark):
    texts = corpus()
    want = survivors(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert {r.doc_id for r in simhash.dedup_documents(docs).collect()} == want
    assert len(texts) // 4 < len(want) < len(texts) * 3 // 4


def test_boundary_of_the_similarity(spark):
    base = [f"a{i}" for i in range(94)]
    at = base[:84] + [f"b{i}" for i in range(10)]  # 80 shingles shared, 10 apart on either side: 0.8
    under = [f"c{i}" for i in range(11)] + base[11:]  # 79 shared, 11 apart: below 0.8
    rows = [(1, " ".join(base)), (2, " ".join(at)), (3, " ".join(under))]
    out = simhash.dedup_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in out.collect()} == {1, 3}


def near_copies(n):
    """Copies of one text with 0 to 9 words of their own: those of few link, the others are near but link to none."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for k in range(n):
        w = list(base)
        for at in rng.sample(range(150), rng.randrange(10) if k else 0):
            w[at] = f"own{rng.randrange(10**9)}"
        texts.append(" ".join(w))
    return texts


def test_pairs_of_a_group_of_near_copies(spark, monkeypatch):
    texts, asked, verified = near_copies(400), [], jaccard.verified

    def counted(pairs, *rest):
        asked.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(jaccard, "verified", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = survivors(texts)
    assert {r.doc_id for r in simhash.dedup_documents(docs).collect()} == want
    assert 100 < len(want) < 300
    assert sum(asked[1:]) < 4 * len(texts)  # what the prefix filter asks for; all pairs are 79,800
