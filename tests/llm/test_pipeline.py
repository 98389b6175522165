import random
from collections import Counter

import corpus_pipeline
from gristmill.llm import decontam, mixing, quality


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) + rng.choice(["", "", "", ".", ","])
    item = " ".join(word().strip(".,") for _ in range(25))
    rows, copies, leaks, junk, clean = [], {}, set(), set(), set()
    for i in range(260):
        text = "\n".join(" ".join(word() for _ in range(30)) for _ in range(rng.randrange(3, 9)))
        kind = rng.random()
        if kind < 0.08:
            text, _ = " ".join(w + "%%%" for w in text.split()), junk.add(i)
        elif kind < 0.16:
            text, _ = f"{text} {item} {text[::-1]}", leaks.add(i)
        elif kind < 0.3 and clean:
            of = rng.choice(sorted(clean))
            w = rows[of][1].split(" ")
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = word()
            text, copies[i] = " ".join(w), of
        else:
            clean.add(i)
        rows.append((i, text, "en", f"src{rng.choice([0, 0, 0, 1, 2])}", len(text)))
    rows += [(900, None, None, None, None), (901, "too short", "en", "src1", 9), (902, "", "en", "src1", 0)]
    return rows, item, copies, leaks, junk, clean


def test_pipeline_against_planted_cases(spark, tmp_path):
    rows, item, copies, leaks, junk, clean = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append({r.doc_id for r in docs.collect()})
    assert kept[0] == clean | leaks | set(copies)
    assert kept[1] == clean | leaks
    assert kept[2] == clean
    by = {r[0]: r for r in rows}
    mixed = Counter(tuple(r) for r in corpus_pipeline.mix(spark, docs, str(tmp_path)).collect())
    assert all(by[r[0]] == r and n <= mixing.MAX_REPEAT for r, n in mixed.items())
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = out.collect()
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"]
    assert Counter(tuple(r)[:5] for r in got) == mixed
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1
    assert len({(r.shard, r.slot) for r in got}) == len(got)


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert quality.RULES and decontam.SIMILARITY == 0.8


def test_stages_keep_odd_columns_and_rows(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(90)) + ".\nSecond line here.\nThird line."
    long = " ".join(f"term{i}" for i in range(60_000))
    rows = [(1, text, "en", "a", 1, "x", "y", None), (1, text, "en", "a", 1, "x", "y", None), (2, long, None, None, 2, "x", None, 1), (None, None, None, None, None, None, None, None), (None, text + " more", "en", "a", 3, "z", "y", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size long, shard string, fp string, copies int")
    spark.createDataFrame([(1, "no such words"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        names = docs.columns if name != "shard" else [c for c in docs.columns if c != "shard"] + ["shard", "slot"]
        assert out.columns == names
        n = out.count()
        assert n == {"quality_rules": 4, "near_duplicates": 3, "decontamination": 5, "shard": 5}.get(name, n)
