import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from gristmill.llm import langid


def plain_kn(counts, order, uniform):
    """Interpolated Kneser-Ney by dictionaries."""
    raw = [Counter() for _ in range(order + 1)]
    left = defaultdict(set)
    for w, times in counts.items():
        s = "\x02" + w + "\x03"
        for i in range(1, len(s)):
            for n in range(1, order + 1):
                if i - n + 1 >= 0:
                    raw[n][s[i - n + 1 : i + 1]] += times
                    if i - n >= 0:
                        left[s[i - n + 1 : i + 1]].add(s[i - n])
    adj = [None] + [{g: (c if n == order or g[0] == "\x02" else len(left[g])) for g, c in raw[n].items()} for n in range(1, order + 1)]
    disc, tot, kinds = [0], [None], [None]
    for n in range(1, order + 1):
        v = list(adj[n].values())
        disc.append(min(max(v.count(1) / max(v.count(1) + 2 * v.count(2), 1), 0.1), 0.95))
        t, k = Counter(), Counter()
        for g, c in adj[n].items():
            t[g[:-1]] += c
            k[g[:-1]] += 1
        tot.append(t)
        kinds.append(k)

    def p(context, c):
        out = uniform
        for n in range(1, order + 1):
            if n - 1 > len(context):
                break
            h = context[len(context) - n + 1 :]
            if h in tot[n]:
                out = max(adj[n].get(h + c, 0) - disc[n], 0) / tot[n][h] + min(1, disc[n] * kinds[n][h] / tot[n][h]) * out
        return out

    return lambda w: sum(math.log(p(s[:i], s[i])) for s in ["\x02" + w + "\x03"] for i in range(1, len(s)))


def test_scores_equal_a_plain_model():
    rng = random.Random(1)
    counts = {k: Counter("".join(rng.choice(a) for _ in range(rng.randrange(1, 7))) for _ in range(200)) for k, a in (("x", "abcdé"), ("y", "cdef"))}
    model = langid.train(counts, 4)
    probe = ["abc", "fed", "zzz", "a", "cd", "éé", "abcdefgh"]
    got = langid.word_scores(model, probe)
    for j, k in enumerate("xy"):
        want = plain_kn(counts[k], 4, model.uniform)
        assert np.allclose(got[:, j], [want(w) for w in probe])
    assert got[:, -1].tolist() == [len(w) + 1 for w in probe]


def test_probabilities_sum_to_one():
    counts = {"x": Counter({"ab": 3, "abc": 1, "ba": 2, "c": 1})}
    model = langid.train(counts, 3)
    one = langid.word_scores(model, [""])  # END right after START
    p = math.exp(one[0, 0])
    want = plain_kn(counts["x"], 3, model.uniform)
    assert abs(p - math.exp(want(""))) < 1e-12


def test_texts_without_letters_and_chunks(monkeypatch):
    from gristmill.llm import wordarrays

    model = langid.train({"x": Counter({"aa": 5, "ab": 2}), "y": Counter({"ññ": 5, "ñz": 2})})
    texts = pa.array([None, "", "12 % …", "aa ab AA", "ÑÑ ñz", "aa" * 1000])
    for step in (8, 1 << 20):
        monkeypatch.setattr(wordarrays, "STEP", step)
        langid._KEPT.clear()
        ce, n = langid.entropies(model, texts)
        assert (n == 0).tolist() == [True, True, True, False, False, False]
        assert ce.argmin(1)[3:].tolist() == [0, 1, 0]


def test_query_on_held_out_documents(spark, tmp_path):
    rng = random.Random(3)
    parts = {"en": ["th", "ing", "er", "on", "the"], "de": ["sch", "ung", "ei", "der", "ü"], "es": ["ción", "os", "que", "ñ", "la"]}
    rows = []
    for i in range(400):
        lang = rng.choice(list(parts))
        t = " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 60)))
        rows.append((i, t.title() if i % 5 == 0 else t, lang if i % 7 else None, "s", lang))
    rows += [(1000, None, "en", "s", "und"), (1001, "123 !", "de", "s", "und"), (None, "the thing", None, "s", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, truth string").write.parquet(f"{tmp_path}/documents.parquet")
    got = langid.op7_langid(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[4] for r in rows}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (truth[r.doc_id] == "und")
    out = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) >= 0.97 * len(out)
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/e/documents.parquet")
    assert langid.op7_langid(spark, f"{tmp_path}/e").count() == 0


def test_languages_beyond_a_hundred_are_learned(spark, tmp_path):
    rng = random.Random(8)
    rows = []
    for j in range(120):
        letters = [chr(0x4E00 + 12 * j + i) for i in range(12)]
        for _ in range(24 if j < 100 else 16):
            text = " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 6))) for _ in range(30))
            rows.append((len(rows), text, f"l{j:03}"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.lang_pred for r in langid.op7_langid(spark, str(tmp_path)).collect()}
    assert got == {i: lang for i, _, lang in rows}


def test_blocks_of_languages_give_the_same_scores(monkeypatch):
    rng = random.Random(9)
    counts = {f"k{j}": Counter("".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 6))) for _ in range(60)) for j in range(7)}
    probe = ["abc", "fed", "zz", "a", ""]
    whole = langid.word_scores(langid.train(counts), probe)
    monkeypatch.setattr(langid, "BLOCK", 3)
    assert np.array_equal(langid.word_scores(langid.train(counts), probe), whole)


def test_training_and_prediction_split_alike(spark):
    text = "हिन्दी भाषा, don\u2019t stop—now Straße 12ab"
    want = [w for run in text.replace(",", " ").split() for w in langid.split(run.encode())]
    assert "हिन्दी" in want and {"don", "t", "now", "straße", "ab"} <= set(want)
    got = langid.word_counts(spark.createDataFrame([("x", text), ("x", text)], "lang string, text string"))
    assert {(r.lang, r.word): r.n for r in got.collect()} == {("x", w): 2 * want.count(w) for w in want}
    model = langid.train({"x": {w: 1 for w in want}, "y": {"abc": 1}})
    ce, n = langid.entropies(model, pa.array([text, "१२ 12", None, "\u093f"]))
    assert n.tolist() == [sum(len(w) + 1 for w in want), 0, 0, 0]
    assert np.isclose(ce[0, 0] * n[0], -langid.word_scores(model, want)[:, 0].sum())


def test_samples_are_bounded_by_distinct_texts(spark):
    rows = [(None, "same text", "en")] * 3000 + [(i, f"text {i}", "en") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.labelled_sample(docs, sample_docs=100)
    assert got.count() < 200 and got.groupBy("text").count().where("count > 1").isEmpty()
