import random
import re

import numpy as np
import pyarrow as pa

from gristmill.llm import quality


def plain(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)]


def texts(n=300):
    rng = random.Random(1)
    bits = ["the", "a", "é😀", "x%", "\n", "\n\n", " ", "\t", "same line here\n", "a b c", "|", "\x0b", " ", "\x85", "WORD"]
    out = [" ".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(n)]
    return out + [None, "", "\n", " ", "one", "a a a a a", "a\na\na \n a", "x" * 5000 + " y", "end\n"]


def test_features_against_python(monkeypatch):
    from gristmill.llm import wordarrays

    for step in (64, 1 << 20):
        monkeypatch.setattr(wordarrays, "STEP", step)
        got = quality.measure(pa.array(texts(), pa.string()))
        for i, t in enumerate(texts()):
            assert [int(got[f][i]) for f in quality.FEATURES[:5]] == plain(t), repr(t)


def test_sliced_arrays():
    a = pa.array(["zero", "one two", None, "x y z"])
    assert quality.measure(a[1:])["n_words"].tolist() == [2, 0, 3]
    assert len(quality.measure(pa.array([], pa.string()))["n_words"]) == 0


def test_em_finds_accuracies():
    rng = np.random.default_rng(0)
    acc, n = [0.95, 0.85, 0.7, 0.6], 20000
    good = rng.random(n) < 0.8
    counts = {}
    right = rng.random((n, 4)) < acc
    speaks = rng.random((n, 4)) < 0.7
    for g, r, s in zip(good, right, speaks):
        p = "".join("0" if not s[k] else "2" if r[k] == g else "1" for k in range(4))
        counts[p] = counts.get(p, 0) + 1
    post = quality.estimate(counts, 4)
    pick = lambda g, r, s: "".join("0" if not s[k] else "2" if r[k] == g else "1" for k in range(4))
    told = np.array([post[pick(*x)] >= 0.5 for x in zip(good, right, speaks)])
    assert (told == good).mean() > 0.9
    assert post["2222"] > 0.99 and post["1111"] < 0.1
    assert quality.estimate({}, 4) == {}


def test_query_and_filter(spark, tmp_path):
    rng = random.Random(2)
    prose = [" ".join(rng.choice("abcdefgh") * rng.randrange(2, 8) + str(rng.randrange(300)) for _ in range(120)) + ".\nEnd." for _ in range(150)]
    junk = [" ".join(rng.choice("abc") * 4 + str(rng.randrange(300)) + "%%%" for _ in range(120)) for _ in range(15)]
    rows = [(i, t, True) for i, t in enumerate(prose + junk + [None, "", "short"])] + [(0, prose[0], True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept boolean")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = quality.op5_quality(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        t = rows[r.doc_id][1]
        n = plain(t)
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert r.kept == (r.doc_id < 150)
    out = quality.keep_documents(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted([0, *range(150)])
    assert quality.keep_documents(docs.limit(0)).count() == 0


def plain_em(counts, n_rules, prior=0.9, strength=20.0, rounds=200):
    """The same model by loops over documents' patterns, rules and votes."""
    total = sum(counts.values())
    share = [[sum(n for p, n in counts.items() if p[r] == str(k)) / total for k in range(3)] for r in range(n_rules)]

    def start(bad):
        return [[strength * share[r][0], strength * (1 - share[r][0]) * bad, strength * (1 - share[r][0]) * (1 - bad)] for r in range(n_rules)]

    pseudo = [start(quality.RECALL), start(quality.FALSE_ALARM)]
    theta = [[[x / sum(v) for x in v] for v in c] for c in pseudo]
    p_good, good = prior, {}
    for _ in range(rounds):
        for p in counts:
            like = [1 - p_good, p_good]
            for c in (0, 1):
                for r in range(n_rules):
                    like[c] *= max(theta[c][r][int(p[r])], 1e-9)
            good[p] = like[1] / sum(like)
        weight = [{p: n * (1 - good[p]) for p, n in counts.items()}, {p: n * good[p] for p, n in counts.items()}]
        for c in (0, 1):
            for r in range(n_rules):
                votes = [pseudo[c][r][k] + sum(w for p, w in weight[c].items() if p[r] == str(k)) for k in range(3)]
                theta[c][r] = [v / sum(votes) for v in votes]
        p_good = (sum(weight[1].values()) + prior * strength) / (total + strength)
    return good


def test_estimate_against_a_plain_version():
    rng = random.Random(3)
    counts = {}
    for _ in range(3000):
        bad = rng.random() < 0.3
        p = "".join("0" if rng.random() < 0.2 else "1" if rng.random() < (0.6 if bad else 0.05) else "2" for _ in range(5))
        counts[p] = counts.get(p, 0) + 1
    got, want = quality.estimate(counts, 5), plain_em(counts, 5)
    assert all(abs(got[p] - want[p]) < 1e-6 for p in counts)
