import itertools
import random
from collections import defaultdict

import pytest

from gristmill.llm import chat


def least(roles):
    """Least repair cost by trying every legal output, every way of merging and inserting."""
    best = {(0,): 0}
    frontier = {0: 0}
    for role in roles:
        own = chat.ROLES.index(role) + 1 if role in chat.ROLES else 0
        new = {}

        def reach(s, cost):
            new[s] = min(cost, new.get(s, 10**9))

        for s, c in frontier.items():
            if s:
                reach(s, c + (chat.MERGE if s == own else chat.MERGE_OTHER))
            for k in range(5):
                for path in itertools.product((1, 2, 3), repeat=k):
                    states = (s, *path)
                    if all(b in chat.LEGAL[a] for a, b in zip(states, states[1:])):
                        for q in chat.LEGAL[states[-1]]:
                            reach(q, c + k * chat.INSERT + (0 if q == own else chat.RELABEL))
        frontier = new
    assert best
    return min(c + {0: 0, 1: 2 * chat.INSERT, 2: chat.INSERT, 3: 0}[s] for s, c in frontier.items())


def price(rows, roles):
    known = {i: r for i, r in enumerate(roles)}
    last, cost = None, 0
    for r in rows:
        if r["action"] == "insert":
            cost += chat.INSERT
        elif r["action"] == "merge":
            cost += chat.MERGE if known[r["turn"]] == last else chat.MERGE_OTHER
        else:
            cost += 0 if known[r["turn"]] == r["role"] else chat.RELABEL
            assert (r["action"] == "keep") == (known[r["turn"]] == r["role"])
        last = r["role"]
    return cost


def legal(roles):
    body = roles[1:] if roles[:1] == ["system"] else roles
    return all(r == ("user", "assistant")[i % 2] for i, r in enumerate(body)) and (not roles or len(body) % 2 == 0 and body)


def test_repairs_are_legal_and_least():
    rng = random.Random(0)
    kinds = ["system", "user", "assistant", "tool", None]
    cases = [list(c) for n in range(5) for c in itertools.product(kinds[:3], repeat=n)]
    cases += [[rng.choice(kinds) for _ in range(rng.randrange(5, 12))] for _ in range(60)]
    for roles in cases:
        rows = chat.repaired([{"turn": i, "role": r, "text": "t"} for i, r in enumerate(roles)], chat.Fragment()) if roles else []
        out = [r["role"] for r in rows if r["action"] != "merge"]
        assert legal(out), (roles, out)
        assert price(rows, roles) == least(roles), roles
        assert [r["turn"] for r in rows if r["turn"] is not None] == list(range(len(roles)))


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(1)
    rows = [(7, i, rng.choice(["user", "assistant", "assistant", "system"]), f"hot {i}") for i in range(600)]
    for c in range(100, 160):
        rows += [(c, i, rng.choice(["system", "user", "assistant", "tool", None]), rng.choice([None, "", "é", "x" * 50])) for i in range(rng.randrange(1, 9))]
    return rows + [(None, 0, "user", "null id"), (None, None, None, None), (100, 0, "user", "tie")]


def test_query_spans_tasks(spark, tmp_path, turns):
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = defaultdict(list)
    for r in chat.op6_chat(spark, str(tmp_path)).collect():
        got[r.conv_id].append(r)
    last = lambda x: (x is None, x if x is not None else 0)
    text = lambda x: (x is None, x or "")
    by = defaultdict(list)
    for c, t, role, x in sorted(turns, key=lambda r: (last(r[1]), text(r[2]), text(r[3]))):
        by[c].append({"turn": t, "role": role, "text": x})
    assert set(got) == set(by)
    for c, ts in by.items():
        want = chat.repaired(ts, chat.Fragment())
        assert len(got[c]) == len(want)
        assert sum(r.action != "merge" for r in got[c]) == len({r.seq for r in got[c]}) == max(r.seq for r in got[c]) + 1
        roles = [r.role for r in sorted(got[c], key=lambda r: r.seq) if r.action != "merge"]
        assert legal(roles)
        if c not in (None, 100):
            assert price([r.asDict() for r in sorted(got[c], key=lambda r: (r.seq, r.turn is not None, r.turn or 0))], [t["role"] for t in ts]) == price(want, [t["role"] for t in ts])
    whole = {r.conv_id: r.text for r in chat.rendered(spark.read.parquet(f"{tmp_path}/conversations.parquet")).collect()}
    assert whole[7].startswith("<|") and whole[7].endswith("<|end|>\n")
    assert all(whole[c].count("<|end|>\n") == max(r.seq for r in got[c]) + 1 for c in by)
    assert all(f"hot {i}" in whole[7] for i in range(600))


def test_a_conversation_over_many_tasks_is_one(spark, turns):
    hot = [r for r in turns if r[0] == 7]
    df = spark.createDataFrame(hot, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        rows = sorted((r.asDict() for r in chat.repair(df).collect()), key=lambda r: (r["seq"], r["turn"] is not None, r["turn"] or 0))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    roles = [r[2] for r in hot]
    assert price(rows, roles) == least(roles)
    assert legal([r["role"] for r in rows if r["action"] != "merge"])
    assert chat.repair(df.limit(0)).count() == 0
