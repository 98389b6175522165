"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant in turn, ending with the
assistant. Dynamic programming over that automaton chooses for each turn to keep it, relabel it, merge it
into the turn before, or insert empty turns before it, at the least total cost; the repaired sequence is
then rendered. A turn is a min-plus matrix over the automaton's states, and matrices compose, so a
conversation that is dealt over many tasks is repaired exactly: each task sends one matrix for its
first and its last conversation, the driver composes these few, and every task then works alone.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import cut, ship, table

ROLES = ("system", "user", "assistant")
#: States: nothing yet, then the role of the last turn. LEGAL[s] are the roles that may follow.
START, SYSTEM, USER, ASSISTANT = range(4)
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
RELABEL, MERGE, MERGE_OTHER, INSERT = 30, 10, 45, 25
FAR = 1 << 40

TURN_OPEN, TURN_CLOSE, MERGED = "<|{role}|>\n", "<|end|>\n", "\n"


@functools.cache
def _inserts() -> dict[int, list[tuple[int, ...]]]:
    """From each state the sequences of empty turns that may be inserted, none included; more than two never pay."""
    out = {}
    for s in range(4):
        paths = [()]
        for _ in range(2):
            paths += [p + (q,) for p in paths for q in LEGAL[p[-1] if p else s] if len(p) < 2]
        out[s] = sorted(set(paths), key=lambda p: (len(p), p))
    return out


@functools.cache
def steps(role: str | None) -> dict[tuple[int, int], tuple[int, str, tuple[int, ...]]]:
    """(state before, state after) to the least (cost, action, inserted roles) of one turn of the role; of equal
    costs fewer insertions, then keep, merge, relabel."""
    own = ROLES.index(role) + 1 if role in ROLES else 0
    out: dict = {}

    def offer(a, b, cost, rank, action, inserted):
        key = (cost, len(inserted), rank, inserted)
        if (a, b) not in out or key < out[a, b][0]:
            out[a, b] = key, (cost, action, inserted)

    for s in range(4):
        if s != START:
            offer(s, s, MERGE if s == own else MERGE_OTHER, 1, "merge", ())
        for path in _inserts()[s]:
            at = path[-1] if path else s
            for q in LEGAL[at]:
                offer(s, q, len(path) * INSERT + (0 if q == own else RELABEL), 0 if q == own else 2, "keep" if q == own else "relabel", path)
    return {k: v[1] for k, v in out.items()}


@functools.cache
def finish() -> dict[int, tuple[int, tuple[int, ...]]]:
    """From each state the least (cost, inserted roles) to end at the assistant; nothing at all may stay nothing."""
    out = {START: (0, ())}
    for s in range(1, 4):
        out[s] = min((len(p) * INSERT, p) for p in _inserts()[s] if (p[-1] if p else s) == ASSISTANT)
    return out


def matrix(roles: list[str | None]) -> np.ndarray:
    """Least cost from state to state over a run of turns."""
    m = np.full((4, 4), FAR, np.int64)
    np.fill_diagonal(m, 0)
    for role in roles:
        t = np.full((4, 4), FAR, np.int64)
        for (a, b), (cost, _, _) in steps(role).items():
            t[a, b] = cost
        m = np.minimum((m[:, :, None] + t[None]).min(1), FAR)
    return m


def trace(roles: list[str | None], entry: int, exit_: int) -> list[tuple[str, int, tuple[int, ...]]]:
    """(action, state after, inserted roles) of each turn on a least path from entry to exit_; of equal costs the
    lower state."""
    cost = np.full((len(roles) + 1, 4), FAR, np.int64)
    cost[0, entry] = 0
    for i, role in enumerate(roles):
        for (a, b), (c, _, _) in steps(role).items():
            cost[i + 1, b] = min(cost[i + 1, b], cost[i, a] + c)
    out, state = [], exit_
    for i in range(len(roles) - 1, -1, -1):
        options = steps(roles[i])
        before = min(a for a in range(4) if (a, state) in options and cost[i, a] + options[a, state][0] == cost[i + 1, state])
        _, action, inserted = options[before, state]
        out.append((action, state, inserted))
        state = before
    return out[::-1]


@dataclass
class Fragment:
    """A run of a conversation's turns within a task, with what lies outside it: states, and turns put out so far."""

    entry: int = START
    exit_: int | None = None
    seq: int = 0
    opened: bool = False
    ends: bool = True


def repaired(turns: list[dict], f: Fragment) -> list[dict]:
    """Rows of the output for a fragment: one for each turn and each inserted turn."""
    roles = [t["role"] for t in turns]
    if f.exit_ is None:
        total = matrix(roles)[f.entry]
        f.exit_ = min(range(4), key=lambda s: (total[s] + finish()[s][0], s))
    out, seq, opened = [], f.seq, f.opened

    def put(turn, role, action, text, merge=False):
        nonlocal seq, opened
        head = MERGED if merge else (TURN_CLOSE if opened else "") + TURN_OPEN.format(role=ROLES[role - 1])
        seq, opened = seq + (not merge), True
        out.append({"turn": turn, "seq": seq - 1, "role": ROLES[role - 1], "action": action, "rendered": head + text})

    for t, (action, state, inserted) in zip(turns, trace(roles, f.entry, f.exit_)):
        for q in inserted:
            put(None, q, "insert", "")
        put(t["turn"], state, action, t["text"] or "", action == "merge")
    if f.ends:
        for q in finish()[f.exit_][1]:
            put(None, q, "insert", "")
        if out:
            out[-1]["rendered"] += TURN_CLOSE
    return out


@dataclass
class Plan:
    """Fragments of the conversations that more than one task holds, by (task, conversation)."""

    fragments: dict[tuple[int, int | None], Fragment] = field(default_factory=dict)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int | None, list[dict]]]:
    """(task, conversation, turns) of each run; a run is held whole, and is no more than the task's share."""
    key, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["gm_part"], row["conv_id"]) != key:
                yield *key, held
                held = []
            key = row["gm_part"], row["conv_id"]
            held.append(row)
    if held:
        yield *key, held


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The matrices of a task's first and last conversation, and how many turns these fragments put out from each
    entry state to each exit state."""
    first = last = None
    for run in _runs(batches):
        first, last = first or run, run
    for part, conv, turns in [first, last][: 0 if first is None else 1 if first is last else 2]:
        roles = [t["role"] for t in turns]
        m = matrix(roles)
        n = [
            sum((action != "merge") + len(inserted) for action, _, inserted in trace(roles, a, b)) if m[a, b] < FAR else 0
            for a in range(4) for b in range(4)
        ]
        yield pa.RecordBatch.from_pylist(
            [{"part": part, "conv_id": conv, "costs": m.ravel().tolist(), "puts": n}],
            pa.schema([("part", pa.int32()), ("conv_id", pa.int64()), ("costs", pa.list_(pa.int64())), ("puts", pa.list_(pa.int64()))]),
        )


def plan(edges: list) -> Plan:
    """Entry and exit states of every fragment of the conversations that span tasks, by a dynamic programme
    over the fragments' matrices. edges: two rows of each task at most."""
    out, by = Plan(), {}
    for e in sorted(edges, key=lambda e: e["part"]):
        by.setdefault(e["conv_id"], []).append(e)
    for conv, run in by.items():
        if len(run) < 2:
            continue
        cost = [np.array([0, FAR, FAR, FAR])]
        mats = [np.array(e["costs"]).reshape(4, 4) for e in run]
        for m in mats:
            cost.append(np.minimum((cost[-1][:, None] + m).min(0), FAR))
        state = min(range(4), key=lambda s: (cost[-1][s] + finish()[s][0], s))
        states = [state]
        for i in range(len(run) - 1, -1, -1):
            state = min(a for a in range(4) if cost[i][a] + mats[i][a, state] == cost[i + 1][state])
            states.append(state)
        states.reverse()
        seq = 0
        for i, e in enumerate(run):
            out.fragments[e["part"], conv] = Fragment(states[i], states[i + 1], seq, i > 0, i == len(run) - 1)
            seq += e["puts"][states[i] * 4 + states[i + 1]]
    return out


SCHEMA = "conv_id long, turn long, seq long, role string, action string, rendered string"


def repair(turns: DataFrame) -> DataFrame:
    """SCHEMA: a row for every turn of (conv_id, turn, role, text) and every inserted one.

    seq numbers the repaired turns of a conversation; merged turns share the seq of the one they join.
    The rendered texts of a conversation, in order of seq, then turn, make up the whole rendering.
    Turns are ordered by turn, then role (nulls last) and a hash of the text, so that no text is a bound between tasks; an
    unknown or null role fits no state and is relabelled or merged; a null text is empty; a null conv_id is a
    conversation of its own; repeated rows are turns of their own; texts of any length pass through whole. Without
    rows the result is empty; other columns are not read.
    """
    ship(turns.sparkSession)
    order = [F.col(c).asc_nulls_last() for c in ("conv_id", "turn", "role")] + [F.xxhash64("text")]
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    dealt = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("gm_part", F.spark_partition_id()))
    edges = dealt.select("conv_id", "role", "gm_part").mapInArrow(_edges, "part int, conv_id long, costs array<long>, puts array<long>").collect()
    resolved = plan(edges)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("seq", pa.int64()), ("role", pa.string()), ("action", pa.string()), ("rendered", pa.string())])
        held = []
        for part, conv, run in _runs(batches):
            f = resolved.fragments.get((part, conv))
            held += [{"conv_id": conv, **r} for r in repaired(run, f or Fragment())]
            if len(held) >= 2000:
                yield pa.RecordBatch.from_pylist(held, schema)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    return dealt.mapInArrow(work, SCHEMA)


def rendered(turns: DataFrame) -> DataFrame:
    """(conv_id, text): each conversation's rendering in one string, for conversations that fit a row."""
    parts = F.array_sort(F.collect_list(F.struct("seq", F.col("turn").isNotNull().alias("own"), "turn", "rendered")))
    return repair(turns).groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["rendered"]), "").alias("text"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, seq, role, action, rendered of all conversations, repaired (see repair)."""
    return repair(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
