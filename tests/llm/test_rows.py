"""Whole rows through the stages: nulls in different columns, columns of any type, names that are used inside."""

from collections import Counter

import pytest

from gristmill.llm import mixing, sharding, simhash
from gristmill.llm.common import keyed

KIND = "doc_id long, text string, lang string, source string, gm_id string, gm_row string, gm_copies int, tags map<string,int>, deep struct<a:int,b:array<string>>, x double"
TEXT = " ".join(f"word{i}" for i in range(60))


def rows():
    one = lambda i, text, lang, source, tags=None, deep=None, x=None, gm=None: (i, text, lang, source, gm, "g", 3, tags, deep, x)
    return [
        one(1, TEXT, None, "x"), one(1, TEXT, "x", None), one(1, TEXT, None, None, gm="x"),
        one(2, TEXT + " a", "en", "s", {"k": 1, "l": None}), one(2, TEXT + " a", "en", "s", {"k": None, "l": 1}), one(2, TEXT + " a", "en", "s", {"l": None, "k": 1}),
        one(3, TEXT[:99], "en", "s", None, (None, ["p", None])), one(3, TEXT[:99], "en", "s", None, (None, [None, "p"])), one(3, TEXT[:99], "en", "s", None, None),
        one(4, TEXT[50:], "en", "s", x=0.0), one(4, TEXT[50:], "en", "s", x=-0.0), one(4, TEXT[50:], "en", "s", x=float("nan")),
        one(None, None, None, None), one(None, "", None, None), one(5, TEXT[7:], "en", "s"), one(5, TEXT[7:], "en", "s"),
    ]


def shown(r):
    """A row as text; entries of a map in any order."""
    return str([sorted(v.items(), key=str) if isinstance(v, dict) else tuple(v) if isinstance(v, tuple) else v for v in r])


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame(rows(), KIND).repartition(3)


def test_keys_tell_all_different_rows_apart(docs):
    keys = Counter((r.gm_one, r.gm_two) for r in keyed(docs).collect())
    assert sorted(keys.values()) == [1] * 12 + [2, 2]  # the map in another order, and the repeated row


def test_shards_hold_exactly_the_rows(docs):
    out = sharding.shard_documents(docs, 4)
    assert Counter(shown(tuple(r)[:10]) for r in out.collect()) == Counter(shown(r) for r in rows())


def test_the_mixture_repeats_whole_rows(docs):
    even = lambda sizes: sizes.selectExpr("*", "1 AS weight")
    known = Counter(shown(r) for r in rows())
    got = Counter(shown(r) for r in mixing.mix_documents(docs, weights=even).collect())
    assert set(got) <= set(known) and sum(got.values()) >= 12
    assert all(n <= 3 * known[r] for r, n in got.items())


def test_near_duplicates_keep_a_whole_row(docs):
    out = simhash.dedup_documents(docs)
    assert out.columns == docs.columns
    got = Counter(shown(r) for r in out.collect())
    assert set(got) <= {shown(r) for r in rows()} and max(got.values()) == 1
