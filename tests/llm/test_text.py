import random

import numpy as np
import pyarrow as pa
import pytest

from gristmill.llm import decontam, tokens


def edit(pattern, text):
    """Least distance of the pattern to any part of the text, by the plain recurrence."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != c), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_myers_against_the_recurrence():
    rng = random.Random(0)
    for _ in range(300):
        p = [rng.randrange(4) for _ in range(rng.randrange(1, 90))]
        t = [rng.randrange(4) for _ in range(rng.randrange(0, 120))]
        d, end = decontam.myers(p, t)
        assert d == edit(p, t)
        assert edit(p, t[:end]) == d


def test_matches_against_brute_force(monkeypatch):
    from gristmill.llm import wordarrays

    rng = random.Random(1)
    vocabulary = [f"w{i}é" for i in range(25)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(n))) for k, n in enumerate([1, 3, 5, 8, 15, 20, 30, 40, 15])]
    items += [(20, items[6][1].upper() + "!"), (21, None), (22, " - ")]
    texts = [None, "", "..."]
    for _ in range(150):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))]
        if rng.random() < 0.7:
            x = rng.choice(items[:9])[1].split()
            for _ in range(rng.randrange(0, 10)):
                at = rng.randrange(len(x)) if x else 0
                x[at : at + 1] = rng.choice([[], [rng.choice(vocabulary)], [rng.choice(vocabulary)] * 2])
            at = rng.randrange(len(w) + 1)
            w[at:at] = x
        texts.append(", ".join(w).title())
    norm = lambda s: [x for x in "".join(c if c.isalnum() else " " for c in (s or "").lower()).split()]
    prepared = decontam.prepare(items)
    for step in (100, 1 << 20):
        monkeypatch.setattr(wordarrays, "STEP", step)
        got = decontam.match(prepared, pa.array(texts, pa.string()))
        for t, hits in zip(texts, got):
            want = {i: edit(norm(x), norm(t)) for i, x in items if norm(x)}
            want = {i: d for i, d in want.items() if d <= int(0.2 * len(norm(dict(items)[i])) + 1e-9)}
            assert {h[0]: h[1] for h in hits} == want
            for i, d, a, b in hits:
                assert edit(norm(dict(items)[i]), norm(t)[a:b]) == d


def test_decontamination_query(spark, tmp_path):
    item = " ".join(f"q{i}" for i in range(30))
    edited = item.replace("q3 ", "z ").replace("q17 ", "").upper()
    rows = [(1, f"a b {item} c", 0), (2, f"x. {edited}, y", 0), (3, "clean", 0), (3, "clean", 0), (None, None, 0), (5, " ".join(item.split()[:20]), 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hits int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench = spark.createDataFrame([(7, item), (8, item + "!"), (9, "other words that never occur"), (None, "clean")], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = decontam.op2_decontamination(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.contaminated, tuple(r.item_ids), tuple(r.distances)) for r in got) == [
        (0, False, (), ()), (1, True, (7, 8), (0, 0)), (2, True, (7, 8), (2, 2)), (3, False, (), ()), (3, False, (), ()), (5, False, (), ()),
    ]
    out = decontam.clean_documents(docs, bench)
    assert out.columns == docs.columns and sorted(r.doc_id or 0 for r in out.collect()) == [0, 3, 3, 5]
    one, many = (sorted(map(str, decontam.with_hits(docs, bench, block_words=n).collect())) for n in (decontam.BLOCK_WORDS, 5))
    assert one == many
    assert sorted(map(str, decontam.clean_documents(docs, bench, block_words=5).collect())) == sorted(map(str, out.collect()))
    assert decontam.clean_documents(docs, bench.limit(0)).count() == len(rows)
    assert decontam.clean_documents(docs.limit(0), bench).count() == 0


@pytest.fixture(scope="module")
def enc():
    return tokens.encoder(tokens.load())


def sections(text, enc, rule):
    """By the byte: which line and which token each byte belongs to."""
    e, _ = enc
    data = text.encode()
    line, n = [], 0
    for b in data:
        line.append(n)
        n += b == 10
    out, at, crossing = [0] * (max(line) + 1 if line else 0), 0, 0
    for t in e.encode_ordinary(text):
        own = line[at : at + len(e.decode_single_token_bytes(t))]
        at += len(own)
        crossing += own[0] != own[-1]
        pick = {"first": own[0], "last": own[-1], "longest": max(sorted(set(own)), key=own.count)}[rule]
        out[pick] += 1
    return out, crossing


def test_line_tokens_against_bytes(enc):
    rng = random.Random(2)
    bits = ["the", " cat", "\n", "\n\n", "\n\n\n ", "é😀", "  ", "\t\n", "123", ".\n", "x"]
    for _ in range(200):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(30)))
        for rule in tokens.RULES:
            got, crossing = tokens.count_text(text, *enc, rule=rule)
            assert (got.tolist(), crossing) == sections(text, enc, rule)
    with pytest.raises(ValueError):
        tokens.attribute(np.array([1]), np.array([0, 1]), "none")


def test_long_runs_of_space_are_encoded_as_the_pattern_would(enc):
    e, size = enc
    for run in (" " * 1500, "\n" * 1200, " \t\u2003" * 700, "\n" * 999 + " " * 500):
        for text in (run, f"a{run}", f"{run}b", f"a{run}b{run}!{run}", f"{run}\x1c{run}9"):
            assert tokens.encode(text, e) == e.encode_ordinary(text)
    counts, crossing = tokens.count_text(" " * 5_000_000 + "a", e, size)
    assert counts.tolist() == [5_000_000] and crossing == 0
    assert tokens.count_text("a" * 5_000_000, e, size)[0].sum() < 5_000_000


def test_token_query_and_fields(spark, tmp_path, enc):
    rows = [(1, "one two\nthree", "t"), (2, None, None), (3, "", "x"), (4, "a " * 3000, "y"), (4, "a " * 3000, "y"), (None, "\n", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = tokens.op4_token_counts(spark, str(tmp_path)).collect()
    assert len(got) == 6
    for r in got:
        text = next(t for i, t, _ in rows if i == r.doc_id) or ""
        assert r.n_tokens == len(enc[0].encode_ordinary(text)) == sum(r.line_tokens)
        assert r.n_lines == len(r.line_tokens) == len(text.splitlines())
    fields = tokens.field_counts(docs, ["n_tokens", "text"], tokens.load()).collect()
    for r in fields:
        assert sum(r.field_tokens) == len(enc[0].encode_ordinary((r.n_tokens or "") + "\n" + (r.text or "")))
    assert tokens.field_counts(docs.limit(0), ["text"], tokens.load()).count() == 0
