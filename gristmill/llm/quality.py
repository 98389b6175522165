"""Quality rules as weak supervision.

Every rule votes good, bad or abstains on a document. A latent quality is estimated by
expectation-maximisation over the counts of vote patterns of the whole corpus (a rule's accuracy is how
often its votes agree with the latent class), and a document's posterior probability of being good
replaces the test that all rules must pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import cut, ship, table
from gristmill.llm.wordarrays import ASCII_SPACE, chunks, hashes, mixed, words

FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_distinct", "n_marked"]
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def _windows(word: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which words stand in a 3-word window that its text holds twice or more."""
    out = np.zeros(len(word), bool)
    if len(word) < 3:
        return out
    inside = np.flatnonzero(text[2:] == text[:-2])
    key = mixed(word[inside] * np.uint64(0x9E3779B97F4A7C15) ^ mixed(word[inside + 1] + np.uint64(1)) * np.uint64(3) ^ mixed(word[inside + 2] + mixed(text[inside].astype(np.uint64) + np.uint64(7))))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    at = inside[twice]
    for k in range(3):
        out[at + k] = True
    return out


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """FEATURES of each text, whole; words are runs of other than space and \\t to \\r."""
    n = len(texts)
    out = {f: np.zeros(n, np.int64) for f in FEATURES}
    for first, data, offsets in chunks(texts):
        m = len(offsets) - 1
        rows = slice(first, first + m)
        starts, ends, text = words(data, offsets, ASCII_SPACE)
        hit = lambda mask: np.concatenate([[0], np.cumsum(mask)])
        between = lambda c: c[offsets[1:]] - c[offsets[:-1]]
        count = lambda mask: np.bincount(text[mask], minlength=m)
        space = ASCII_SPACE[data]
        upper = (data >= 65) & (data <= 90)
        symbol = SYMBOLS[data]
        out["n_words"][rows] = np.bincount(text, minlength=m)
        out["word_chars"][rows] = between(hit(~space & ((data & 0xC0) != 0x80)))
        out["n_symbols"][rows] = between(hit(symbol))
        out["n_upper"][rows] = between(hit(upper))
        out["n_letters"][rows] = between(hit(upper | (data >= 97) & (data <= 122) | (data >= 0xC0)))
        word = hashes(data, starts, ends)
        out["n_repeat_words"][rows] = count(_windows(word, text))
        own = mixed(word ^ mixed(text.astype(np.uint64) + np.uint64(3)))
        out["n_distinct"][rows] = count(np.unique(own, return_index=True)[1])
        marked = hit(symbol | (data == 33))
        out["n_marked"][rows] = count(marked[ends] > marked[starts])
        # Lines: from one \n to the next, within a text; equal lines have equal bytes, spaces included.
        brk = np.flatnonzero(data == 10)
        a = np.unique(np.concatenate([offsets[:-1], brk + 1]))
        a = a[a < len(data)]
        if len(a):
            stop = np.concatenate([a[1:], [len(data)]])
            b = stop - ((data[stop - 1] == 10) & (stop > a))
            full = hit(~space)
            has = full[b] > full[a]
            a, b = a[has], b[has]
            of = np.searchsorted(offsets, a, "right") - 1
            line = mixed(hashes(data, a, b) ^ mixed(of.astype(np.uint64) + np.uint64(5)))
            new = np.zeros(len(a), bool)
            new[np.unique(line, return_index=True)[1]] = True
            out["n_lines"][rows] = np.bincount(of, minlength=m)
            out["n_dup_lines"][rows] = np.bincount(of[~new], minlength=m)
    return out


def features(text: Column) -> Column:
    """struct of FEATURES; a null text counts as empty."""

    @F.arrow_udf("struct<" + ",".join(f"{f}:bigint" for f in FEATURES) + ">")
    def run(texts: pa.Array) -> pa.Array:
        x = measure(texts)
        return pa.StructArray.from_arrays([pa.array(x[f]) for f in FEATURES], FEATURES)

    return run(text)


@dataclass(frozen=True)
class Rule:
    """SQL conditions over FEATURES: votes good where `good` holds, else bad where `bad` holds, else abstains."""

    name: str
    good: str
    bad: str


RULES = [
    Rule("length", "n_words >= 80", "n_words < 50"),
    Rule("word_length", "word_chars BETWEEN 3 * n_words AND 9 * n_words", "word_chars < 2.5 * n_words OR word_chars > 12 * n_words"),
    Rule("symbols", "n_symbols * 200 <= n_words", "n_symbols * 10 > n_words"),
    Rule("marked_words", "n_marked * 50 <= n_words", "n_marked * 4 > n_words"),
    Rule("shouting", "n_upper * 8 <= n_letters", "n_upper * 2 > n_letters"),
    Rule("duplicate_lines", "n_lines >= 3 AND n_dup_lines = 0", "n_dup_lines * 2 > n_lines"),
    Rule("repeated_windows", "n_words >= 3 AND n_repeat_words * 20 <= n_words", "n_repeat_words * 3 > n_words"),
    Rule("distinct_words", "n_words >= 20 AND n_distinct * 3 >= n_words", "n_words >= 100 AND n_distinct * 8 < n_words"),
]


#: Prior shares of bad among the votes of a rule, on bad and on good documents.
RECALL, FALSE_ALARM = 0.4, 0.02


def votes(rules: list[Rule] = RULES, of: str = "f") -> Column:
    """The vote pattern: a digit for each rule, 2 good, 1 bad, 0 abstains."""
    names = sorted(FEATURES, key=len, reverse=True)

    def inside(sql: str) -> str:
        return " ".join(f"{of}.{t.strip('()')}" if t.strip("()") in names else t for t in sql.split(" "))

    return F.concat(*[F.expr(f"CASE WHEN {inside(r.good)} THEN '2' WHEN {inside(r.bad)} THEN '1' ELSE '0' END") for r in rules])


def estimate(counts: dict[str, int], n_rules: int, prior: float = 0.9, strength: float = 20.0, rounds: int = 200) -> dict[str, float]:
    """Posterior probability of good for each vote pattern, by expectation-maximisation.

    Per class and rule a distribution over (abstains, bad, good), with a Dirichlet prior of `strength`
    votes that says: a good document seldom draws a bad vote (FALSE_ALARM), a bad one draws it from those
    rules alone that know its fault (RECALL). The prior also names the classes.
    """
    patterns = sorted(counts)
    if not patterns:
        return {}
    v = np.array([[int(c) for c in p] for p in patterns])
    n = np.array([counts[p] for p in patterns], float)
    hot = np.stack([v == k for k in range(3)], -1).astype(float)
    share = np.einsum("p,prk->rk", n, hot) / n.sum()
    voted = 1 - share[:, :1]
    pseudo = strength * np.stack([np.concatenate([share[:, :1], voted * bad, voted * (1 - bad)], 1) for bad in (RECALL, FALSE_ALARM)])
    theta, p_good = pseudo / pseudo.sum(-1, keepdims=True), prior
    for _ in range(rounds):
        logs = np.einsum("prk,crk->cp", hot, np.log(np.maximum(theta, 1e-9))) + np.log([[1 - p_good], [p_good]])
        good = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))
        weight = np.stack([n * (1 - good), n * good])
        theta_new = np.einsum("cp,prk->crk", weight, hot) + pseudo
        theta_new /= theta_new.sum(-1, keepdims=True)
        p_new = float((weight[1].sum() + prior * strength) / (n.sum() + strength))
        done = np.abs(theta_new - theta).max() < 1e-9 and abs(p_new - p_good) < 1e-9
        theta, p_good = theta_new, p_new
        if done:
            break
    return dict(zip(patterns, good.tolist()))


def posterior(measured: DataFrame, rules: list[Rule] = RULES, of: str = "f") -> Column:
    """An expression for the posterior, from the counts of vote patterns over all of `measured` (at most 3 to
    the number of rules, whatever the corpus)."""
    counts = {p: n for p, n in measured.groupBy(votes(rules, of).alias("p")).count().collect()}
    known = estimate(counts, len(rules))
    if not known:
        return F.lit(0.5)
    pairs = F.from_json(F.lit("{" + ",".join(f'"{p}":{x!r}' for p, x in known.items()) + "}"), "map<string,double>")
    return F.element_at(pairs, votes(rules, of))


def base_failed(of: str = "f") -> Column:
    return F.expr(f"{of}.n_words < 50 OR 100 * {of}.n_repeat_words > 50 * {of}.n_words")


def keep_documents(docs: DataFrame, rules: list[Rule] = RULES, least: float = 0.5) -> DataFrame:
    """The documents of docs that the base limits pass and whose posterior is `least` or more.

    The texts are measured twice, once for the votes of the whole corpus and once to filter: nothing of
    the size of the corpus is stored between. Null and empty texts have no words and go; texts of any length are
    measured whole; repeated rows vote and stay, or go, alike. Without rows the result is empty; further columns pass
    through, whatever their types; names that begin with gm_ are this library's.
    """
    ship(docs.sparkSession)
    measured = docs.withColumn("gm_f", features(F.col("text")))
    likely = posterior(measured.select("gm_f"), rules, "gm_f")
    return measured.where(~base_failed("gm_f") & (likely >= least)).drop("gm_f")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, posterior.

    A null or empty text has no words and fails the base limits. Repeated rows vote once each. Counts of
    equal lines and windows compare 64-bit hashes within one text. Texts of any length are measured whole; without
    rows the result is empty; other columns are not read.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", features(F.col("text")).alias("f"))
    docs = cut(docs)
    likely = posterior(docs.select("f"))
    return docs.select(
        "doc_id", *[F.col(f"f.{c}") for c in FEATURES[:5]], base_failed().alias("base_failed"),
        (~base_failed() & (likely >= 0.5)).alias("kept"), likely.alias("posterior"),
    )
