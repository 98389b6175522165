"""Secret scans (native): fixed patterns, and character Markov models for the rest.

Two bigram models over 63 character classes, one of random strings and one of ordinary identifiers, are
trained from labelled samples; a candidate token is a secret when its log-likelihood ratio exceeds the
prior log-odds against a token being one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import cut, table

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_GATE = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
#: Runs that would fail the length limits can't hide a longer one, so the limits stand in the patterns.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: What the Markov models judge.
LEAST = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"
KINDS = ["assign", "access", "hex", "markov"]

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
CLASSES = len(ALPHABET) + 1
#: Bound of the labelled sample: so many documents, picked by a hash of doc_id, and so many random strings.
SAMPLE_DOCS = 2000
SAMPLE_RANDOM = 6000
#: Prior probability that a candidate token is a secret.
PRIOR = 1e-4
SEED = 41


SPANS = "array<struct<s:int,k:int,e:int>>"
#: Items of an array that are folded at a time. Every step of a fold copies what it has gathered, so results are
#: gathered by block, and no state holds an array that grows.
FOLDED = 128


def _none() -> Column:
    return F.array().cast(SPANS)


def _once(value: Column, f) -> Column:
    """f(value), with value made only once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _fold(items: Column, start: dict[str, int], step, kind: str) -> Column:
    """What step puts out over the items in order, as an array<kind>. step: from (state, item) to (new state, a value
    or null). start: the state's fields, all integers. One pass takes the state at the start of each block of items,
    another the results block by block, so the work is about linear."""
    state_kind = "struct<" + ",".join(f"{f}:int" for f in start) + ">"
    # Casts to the very types of the arrays: with any other, each append converts the whole array.
    after = lambda s, x: F.struct(*[v.alias(f) for f, v in step(s, x)[0].items()]).cast(state_kind)
    first = F.struct(*[F.lit(v).alias(f) for f, v in start.items()]).cast(state_kind)

    def one(acc: Column, x: Column) -> Column:
        out = step(acc["s"], x)[1].cast(kind)
        return F.struct(after(acc["s"], x).alias("s"), F.when(out.isNotNull(), F.array_append(acc["out"], out)).otherwise(acc["out"]).alias("out"))

    def whole(blocks: Column) -> Column:
        zero = F.struct(first.alias("s"), F.array().cast(f"array<{state_kind}>").alias("all"))
        begins = lambda acc, b: F.struct(F.aggregate(b, acc["s"], after).alias("s"), F.array_append(acc["all"], acc["s"]).alias("all"))
        states = F.aggregate(blocks, zero, begins, lambda acc: acc["all"])
        results = lambda b, s: F.aggregate(b, F.struct(s.alias("s"), F.array().cast(f"array<{kind}>").alias("out")), one, lambda acc: acc["out"])
        return F.flatten(F.zip_with(blocks, states, results))

    at = lambda x: F.sequence(F.lit(1), F.greatest(F.size(x), F.lit(1)), F.lit(FOLDED))
    return _once(_once(items, lambda x: F.transform(at(x), lambda i: F.slice(x, i, F.lit(FOLDED)))), whole)


def _spans(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """array<struct<s, k, e>> of the pattern's matches by code points: lengths of what stands between them add up.

    keep: (group, least length) of matches that count; the others still consume their text.
    """
    lengths = lambda x: F.transform(x, F.length)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(keep[0])) if keep else whole
    parts = F.arrays_zip(lengths(F.split(text, pattern, -1)).alias("gap"), lengths(whole).alias("all"), lengths(value).alias("own"))

    def step(state: Column, x: Column) -> tuple[dict, Column]:
        s = state["at"] + x["gap"]
        e = s + F.coalesce(x["all"], F.lit(0))
        own = F.struct(s.alias("s"), F.lit(kind).alias("k"), e.alias("e"))
        return {"at": e}, F.when(x["own"] >= (keep[1] if keep else 0), own)

    return _fold(parts, {"at": 0}, step, "struct<s:int,k:int,e:int>")


def _gated(gate: Column, spans: Column) -> Column:
    return F.when(gate, spans).otherwise(_none())


def base_spans(text: Column) -> list[Column]:
    return [
        _gated(text.rlike(ASSIGN_GATE), _spans(text, ASSIGN, 0, (2, 8))),
        _gated(text.contains("AKIA"), _spans(text, ACCESS, 1)),
        _gated(text.rlike(HEX), _spans(text, HEX, 2)),
    ]


def samples(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_random: int = SAMPLE_RANDOM, seed: int = SEED) -> DataFrame:
    """(label, token): label 1 random, 0 ordinary.

    Random strings are digests in hexadecimal, base64 and upper case letters and digits; ordinary ones
    are the words of the sampled documents, and their pairs of words joined as identifiers.
    Tokens of ordinary text that hold a pattern's match are left out. The draw goes by doc_id and text, and equal texts
    count once: neither null ids nor groups of copies make the sample larger.
    """
    n = docs.count()
    keep = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), F.lit(1_000_000)) < math.ceil(1e6 * min(1.0, sample_docs / max(n, 1)))
    drawn = docs.where(keep).select("text").distinct()
    words = drawn.select(F.regexp_extract_all(F.regexp_replace("text", HEX + "|" + ACCESS, " "), F.lit("[A-Za-z]{2,}"), F.lit(0)).alias("w"))
    pairs = lambda f: F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.size("w")), f)
    snake = pairs(lambda a, b: F.concat(a, F.lit("_"), F.lower(b), F.lit("_"), a))
    camel = pairs(lambda a, b: F.concat(F.lower(a), F.initcap(b), F.initcap(a)))
    ordinary = words.select(F.explode(F.concat("w", snake, camel)).alias("token")).where(F.length("token") >= 4).select(F.lit(0).alias("label"), "token")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    random = docs.sparkSession.range(sample_random).select(
        F.lit(1).alias("label"),
        F.when(F.col("id") % 3 == 0, F.substring(digest, 1, 40))
        .when(F.col("id") % 3 == 1, F.base64(F.unhex(digest)))
        .otherwise(F.upper(F.regexp_replace(F.base64(F.unhex(digest)), "[+/=]", "")))
        .alias("token"),
    )
    return ordinary.union(random)


#: The class of a character by its code up to 127; the last class is that of all others.
_CLASS_OF = [ALPHABET.find(chr(c)) if chr(c) in ALPHABET else CLASSES - 1 for c in range(128)]


def _states(token: Column) -> Column:
    """The classes of a token's characters; the token is taken apart once."""
    known = F.expr("array(" + ",".join(map(str, _CLASS_OF)) + ")")
    return F.transform(F.split(token, ""), lambda c: F.element_at(known, F.least(F.ascii(c), F.lit(127)) + 1))


def _bigrams(states: Column) -> Column:
    """The pairs of neighbouring classes, as one number each."""
    pair = lambda x: F.zip_with(F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))), F.slice(x, 2, F.size(x)), lambda a, b: a * CLASSES + b)
    return F.flatten(F.transform(F.array(states), pair))


def fit(labelled: DataFrame, smooth: float = 0.5) -> list[float]:
    """The CLASSES squared log-likelihood ratios of bigrams, from (label, token). Only the counts, bounded by
    the alphabet, reach the driver."""
    counts = [[smooth] * CLASSES**2 for _ in range(2)]
    tokens = labelled.where(F.length("token") > 1).groupBy("label", "token").agg(F.count(F.lit(1)).alias("n"))
    grams = tokens.select("label", "n", F.explode(_bigrams(_states(F.col("token")))).alias("g"))
    for label, g, n in grams.groupBy("label", "g").agg(F.sum("n").alias("n")).collect():
        counts[label][g] += n
    logs = []
    for c in counts:
        totals = [sum(c[a * CLASSES : (a + 1) * CLASSES]) for a in range(CLASSES)]
        logs.append([math.log(c[k] / totals[k // CLASSES]) for k in range(CLASSES**2)])
    return [round(a - b, 4) for a, b in zip(logs[1], logs[0])]


def found(text: Column, model: list[float], prior: float = PRIOR) -> Column:
    """struct<base, markov> of spans (s, k, e) in code points, end exclusive, k an index of KINDS; null texts have none.

    A candidate is a run of 20 or more of [A-Za-z0-9+/_=-], or what base spans leave of one in such a length. Runs and
    base spans are swept together in order of their starts; what is left of a run is judged where it ends. The work
    grows about in proportion to the text, whatever its runs and spans.
    """
    t = F.coalesce(text, F.lit(""))
    classes = F.transform(F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(0)), _states)
    runs = F.zip_with(_spans(t, CANDIDATE, len(KINDS) - 1), classes, lambda x, c: F.struct(x["s"].alias("s"), x["e"].alias("e"), c.alias("c")))
    runs = F.when(t.rlike(CANDIDATE), runs).otherwise(F.array().cast("array<struct<s:int,e:int,c:array<int>>>"))
    both = F.struct(F.array_sort(F.concat(*base_spans(t))).alias("base"), runs.alias("runs"))
    return _once(both, lambda x: F.struct(x["base"].alias("base"), _markov(x["base"], x["runs"], model, prior).alias("markov")))


def _markov(base: Column, runs: Column, model: list[float], prior: float) -> Column:
    limit = math.log((1 - prior) / prior)
    ratios = F.expr("cast(split('" + ",".join(map(repr, model)) + "', ',') as array<double>)")
    event = lambda s, r, e: F.struct(s.alias("s"), r.alias("r"), e.alias("e"))
    spans = F.transform(base, lambda x: event(x["s"], F.lit(-1), x["e"]))
    begun = F.transform(runs, lambda x, i: event(x["s"], i, x["e"]))
    last = F.lit(2**31 - 1)
    events = F.array_sort(F.concat(spans, begun, F.array(event(last, F.lit(-1), last))))

    def step(state: Column, x: Column) -> tuple[dict, Column]:
        """state: run `r`, up to `stop`, is free from `at` on; the base spans so far end at `past`."""
        stop, run = F.least(state["stop"], x["s"]), x["r"] >= 0
        out = F.when(stop - state["at"] >= LEAST, F.struct(state["at"].alias("s"), stop.alias("e"), state["r"].alias("r")))
        return {
            "r": F.when(run, x["r"]).otherwise(state["r"]),
            "stop": F.when(run, x["e"]).otherwise(state["stop"]),
            "at": F.when(run, F.greatest(x["s"], state["past"])).otherwise(F.greatest(state["at"], x["e"])),
            "past": F.when(run, state["past"]).otherwise(F.greatest(state["past"], x["e"])),
        }, out

    pieces = _fold(events, {"r": 0, "stop": 0, "at": 0, "past": 0}, step, "struct<s:int,e:int,r:int>")

    def random(p: Column) -> Column:
        of = F.get(runs, p["r"])
        return F.aggregate(_bigrams(F.slice(of["c"], p["s"] - of["s"] + 1, p["e"] - p["s"])), F.lit(0.0), lambda a, g: a + F.element_at(ratios, g + 1)) > limit

    judged = F.transform(F.filter(pieces, random), lambda p: F.struct(p["s"].alias("s"), F.lit(len(KINDS) - 1).alias("k"), p["e"].alias("e")))
    return F.when(F.size(runs) > 0, judged).otherwise(_none())


def scan(docs: DataFrame, model: list[float], text: str = "text", prior: float = PRIOR, name: str = "secrets") -> DataFrame:
    """Adds a column `name`, in place of one of that name: found(text)."""
    return docs.withColumn(name, found(F.col(f"`{text}`"), model, prior))


def shown(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["s"], x["e"])), ",")


def redact(docs: DataFrame, model: list[float], mark: str = "[secret]", text: str = "text") -> DataFrame:
    """docs with every span of text replaced by mark; overlapping spans become one. Columns are kept, whatever their names."""
    t = F.col(f"`{text}`")
    spans = _once(found(t, model), lambda f: F.array_sort(F.concat(f["base"], f["markov"])))

    def clean(h: Column) -> Column:
        size = F.size(h["chars"])

        def step(state: Column, x: Column) -> tuple[dict, Column]:
            kept = F.when(x["s"] >= state["at"], F.struct(state["at"].alias("s"), x["s"].alias("e")))
            return {"at": F.greatest(state["at"], x["e"])}, kept

        end = F.array(F.struct(size.alias("s"), F.lit(0).alias("k"), size.alias("e")))
        gaps = _fold(F.concat(h["spans"], end), {"at": 0}, step, "struct<s:int,e:int>")
        return F.array_join(F.transform(gaps, lambda g: F.array_join(F.slice(h["chars"], g["s"] + 1, g["e"] - g["s"]), "")), mark)

    out = _once(spans, lambda x: F.when(F.size(x) > 0, _once(F.struct(F.split(t, "").alias("chars"), x.alias("spans")), clean)))
    return docs.withColumn(text, F.coalesce(out, t)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document.

    A null or empty text has no spans: counts 0, the digest of the empty string, spans empty. Spans of
    different kinds may overlap; those of one kind don't. Texts of any length are scanned whole, in work about in
    proportion to it. Repeated rows are scanned alike; without rows the result is empty; other columns are not read.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = cut(scan(docs, fit(samples(docs))).select("doc_id", "secrets.base", "secrets.markov"))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return judged.select(
        "doc_id", count(0), count(1), count(2),
        F.sha2(shown(F.col("base")), 256).alias("base_sha256"),
        shown(F.array_sort(F.concat("base", "markov"))).alias("spans"),
    )
