"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

One model per language predicts each character of a word, and the word's end, from up to ORDER - 1
characters before it, the word's start included. n-grams are 64-bit hashes in one sorted array per
order, with a column per language; a text's language is the one of lowest cross-entropy per predicted
character. A temperature fitted on labelled texts that the models have not seen turns the differences
into a score; texts whose cross-entropy lies beyond nearly all of those are marked as rejected.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import cut, ship, small, table
from gristmill.llm.wordarrays import chunks, hashes, mixed, words

ORDER = 5
#: Bound of the labelled sample: so many documents of a language, by a hash of doc_id; half train, half calibrate.
SAMPLE_DOCS = 1200
#: Languages whose n-grams share sorted arrays; more languages make more blocks.
BLOCK = 16
#: Words whose scores a worker keeps.
CACHED_WORDS = 300_000
#: Bound of all those scores, with many languages.
CACHED_SCORES = 100 * CACHED_WORDS
UNKNOWN = "und"
START, END = 2, 3

#: A word to the models, in training and in prediction alike: a letter and the letters and marks after it.
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
NO_LETTER = np.zeros(256, bool)
NO_LETTER[:128] = [not chr(i).isalpha() for i in range(128)]
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _codes(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of START word END for all words, the start of each character's word, and its word."""
    joined = "".join(f"{chr(START)}{w}{chr(END)}" for w in vocabulary)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.fromiter(map(len, vocabulary), np.int64, len(vocabulary)) + 2
    return code, np.repeat(np.cumsum(size) - size, size), np.repeat(np.arange(len(size)), size)


def _keys(code: np.ndarray, start: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For n = 1 to order: (position, hash of the n characters up to it, hash of the n - 1 before it), where
    the n characters lie in one word and the last of them is no START."""
    at = np.arange(len(code))
    out, run = [], np.zeros(len(code), np.uint64)
    before = np.zeros(len(code), np.uint64)
    power = 1
    for n in range(1, order + 1):
        ok = at - n + 1 >= start
        shifted = np.zeros_like(code)
        shifted[n - 1 :] = code[: len(code) - n + 1]
        run = run + mixed(shifted + np.uint64(n)) * np.uint64(power)
        power = power * 0x9E3779B97F4A7C15 & (2**64 - 1)
        here = np.flatnonzero(ok & (at > start))
        full = mixed(run + np.uint64(n))
        out.append((here, full[here], before[here - 1] if n > 1 else np.zeros(len(here), np.uint64)))
        before = full
    return out


@dataclass
class Model:
    languages: list[str]
    #: By order and block of languages: sorted n-gram hashes with discounted probabilities (n, languages); sorted contexts
    #: with back-off weights.
    grams: list[list[tuple[np.ndarray, np.ndarray]]]
    contexts: list[list[tuple[np.ndarray, np.ndarray]]]
    uniform: float
    temperature: float = 1.0
    ceiling: float = float("inf")
    name: str = ""
    order: int = field(default=ORDER)


def _blocks(parts: list[tuple[np.ndarray, np.ndarray]], empty: float) -> list[tuple[np.ndarray, np.ndarray]]:
    return [_aligned(parts[at : at + BLOCK], empty) for at in range(0, len(parts), BLOCK)]


def _aligned(parts: list[tuple[np.ndarray, np.ndarray]], empty: float) -> tuple[np.ndarray, np.ndarray]:
    keys = np.unique(np.concatenate([k for k, _ in parts]))
    out = np.full((len(keys), len(parts)), empty)
    for j, (k, v) in enumerate(parts):
        out[np.searchsorted(keys, k), j] = v
    return keys, out


def train(counts: dict[str, dict[str, int]], order: int = ORDER) -> Model:
    """counts: for each language its words (lower-case letters) and how often each occurs."""
    languages = sorted(counts)
    grams: list[list] = [[] for _ in range(order)]
    contexts: list[list] = [[] for _ in range(order)]
    alphabet = {c for w in counts.values() for x in w for c in x}
    for language in languages:
        vocabulary = sorted(counts[language])
        times = np.array([counts[language][w] for w in vocabulary], float)
        code, start, of = _codes(vocabulary)
        keyed = _keys(code, start, order)
        for n in range(order, 0, -1):
            here, key, context = keyed[n - 1]
            unique, first, inverse = np.unique(key, return_index=True, return_inverse=True)
            count = np.bincount(inverse, times[of[here]], len(unique))
            if n < order:  # continuation counts, but for n-grams that begin a word
                longer_at, longer, _ = keyed[n]
                at = longer_at[np.unique(longer, return_index=True)[1]]
                place = np.searchsorted(here, at)
                followed = np.bincount(np.searchsorted(unique, key[place]), minlength=len(unique))
                begins = here[first] - n + 1 == start[here[first]]
                count = np.where(begins, count, followed)
            once, twice = (count == 1).sum(), (count == 2).sum()
            discount = min(max(once / max(once + 2 * twice, 1), 0.1), 0.95)
            ctx, ctx_of = np.unique(context[first], return_inverse=True)
            total = np.bincount(ctx_of, count, len(ctx))
            kinds = np.bincount(ctx_of, count > 0, len(ctx))
            total = np.maximum(total, 1e-12)
            grams[n - 1].append((unique, np.maximum(count - discount, 0) / total[ctx_of]))
            contexts[n - 1].append((ctx, np.minimum(1.0, np.where(kinds > 0, discount * kinds / total, 1.0))))
    if not languages:
        return Model([], [], [], 1.0, order=order)
    model = Model(languages, [_blocks(g, 0.0) for g in grams], [_blocks(c, 1.0) for c in contexts], 1 / (len(alphabet) + 2), order=order)
    model.name = hashlib.sha256(b"".join(x.tobytes() for blocks in model.grams for pair in blocks for x in pair)).hexdigest()
    return model


def _found(blocks: list[tuple[np.ndarray, np.ndarray]], asked: np.ndarray, empty: float) -> np.ndarray:
    if len(blocks) > 1:
        return np.concatenate([_found([b], asked, empty) for b in blocks], axis=1)
    keys, values = blocks[0]
    if not len(keys):
        return np.full((len(asked), values.shape[1]), empty)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where((keys[at] == asked)[:, None], values[at], empty)


def word_scores(model: Model, vocabulary: list[str]) -> np.ndarray:
    """(words, languages + 1): log-probability of each word under each language, and the characters predicted."""
    out = np.zeros((len(vocabulary), len(model.languages) + 1))
    if not vocabulary:
        return out
    code, start, of = _codes(vocabulary)
    p = np.full((len(code), len(model.languages)), model.uniform)
    for n, (here, key, context) in enumerate(_keys(code, start, model.order)):
        p[here] = _found(model.grams[n], key, 0.0) + _found(model.contexts[n], context, 1.0) * p[here]
    spoken = np.flatnonzero(np.arange(len(code)) > start)
    for j in range(len(model.languages)):
        out[:, j] = np.bincount(of[spoken], np.log(p[spoken, j]), len(vocabulary))
    out[:, -1] = np.bincount(of[spoken], minlength=len(vocabulary))
    return out


def split(run: bytes) -> list[str]:
    """The words in a run of bytes between two ASCII characters that are no letters."""
    return WORD.findall(run.decode("utf-8", "replace").lower())


class _Scores:
    """Scores of words by hash, kept for a model over the tasks of a worker."""

    def __init__(self, model: Model):
        self.model, self.at, self.rows = model, {}, np.zeros((1024, len(model.languages) + 1))

    def of(self, key: np.ndarray, word) -> np.ndarray:
        """Rows for distinct hashes; word(i) gives the bytes of the i-th."""
        if len(self.at) > min(CACHED_WORDS, CACHED_SCORES // self.rows.shape[1]):
            self.at.clear()
            self.rows = self.rows[:1024].copy()
        at = [self.at.get(k) for k in key.tolist()]
        new = [i for i, x in enumerate(at) if x is None]
        if new:
            parts = [split(word(i)) for i in new]
            each = word_scores(self.model, [w for p in parts for w in p])
            ends = np.cumsum([0, *map(len, parts)])
            total = np.concatenate([np.zeros((1, each.shape[1])), np.cumsum(each, axis=0)])
            rows = total[ends[1:]] - total[ends[:-1]]
            base = len(self.at)
            while base + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[base : base + len(new)] = rows
            for j, i in enumerate(new):
                at[i] = base + j
                self.at[int(key[i])] = base + j
        return self.rows[np.array(at, np.int64)]


_KEPT: dict[str, _Scores] = {}


def entropies(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy per predicted character of each text under each language, and the characters (0: no letter)."""
    if model.name not in _KEPT:
        _KEPT.clear()
        _KEPT[model.name] = _Scores(model)
    scores = _KEPT[model.name]
    out = np.zeros((len(texts), len(model.languages) + 1))
    for first, data, offsets in chunks(texts):
        data = _FOLD[data]
        starts, ends, text = words(data, offsets, NO_LETTER)
        if not len(starts):
            continue
        key, index, inverse = np.unique(hashes(data, starts, ends), return_index=True, return_inverse=True)
        rows = scores.of(key, lambda i: data[starts[index[i]] : ends[index[i]]].tobytes())
        m = len(offsets) - 1
        for j in range(rows.shape[1]):
            out[first : first + m, j] = np.bincount(text, rows[inverse, j], m)
    return -out[:, :-1] / np.maximum(out[:, -1:], 1), out[:, -1]


def posteriors(ce: np.ndarray, n: np.ndarray, temperature: float) -> np.ndarray:
    x = -(ce - ce.min(1, keepdims=True)) * n[:, None] * temperature
    e = np.exp(np.maximum(x, -700))
    return e / e.sum(1, keepdims=True)


def calibrate(model: Model, ce: np.ndarray, n: np.ndarray, truth: np.ndarray, beyond: float = 0.999) -> None:
    """Sets the temperature of least log-loss on labelled texts and the cross-entropy that `beyond` of the
    texts that the model gets right stay under."""
    ok = n > 0
    ce, n, truth = ce[ok], n[ok], truth[ok]
    if not len(n):
        return
    losses = {t: -np.log(np.maximum(posteriors(ce, n, t)[np.arange(len(n)), truth], 1e-12)).mean() for t in np.geomspace(0.005, 1, 24)}
    model.temperature = float(min(losses, key=losses.get))
    right = ce.argmin(1) == truth
    if right.any():
        model.ceiling = float(np.quantile(ce[right].min(1), beyond))


def labelled_sample(docs: DataFrame, seed: int = 7, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(lang, text, half) of about sample_docs distinct texts a language that may be learned from: lang known,
    crc32 of doc_id modulo 4 other than 2 (a null doc_id has none, and may). The draw goes by doc_id and text, and
    equal texts count once: neither null ids nor groups of copies make the sample larger."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    n = known.groupBy("lang").count().select("lang", (1e6 * F.least(F.lit(1.0), F.lit(sample_docs) / F.col("count"))).cast("int").alias("gm_limit"))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), F.lit(1_000_000))
    half = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("text")), F.lit(2))
    return known.join(small(n), "lang").where(draw < F.col("gm_limit")).select("lang", "text").distinct().select("lang", "text", half.alias("half"))


def word_counts(sample: DataFrame) -> DataFrame:
    """(lang, word, n) over the texts of a sample, split as for prediction."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for first, data, offsets in chunks(texts):
                data = _FOLD[data]
                starts, ends, text = words(data, offsets, NO_LETTER)
                held: Counter = Counter()
                for a, b, i in zip(starts.tolist(), ends.tolist(), text.tolist()):
                    held[batch.column("lang")[first + i].as_py(), data[a:b].tobytes()] += 1
                rows = [(lang, w, n) for (lang, run), n in held.items() for w in split(run)]
                lang, word, n = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.string()), pa.array(n, pa.int64())], ["lang", "word", "n"])

    return sample.select("lang", "text").mapInArrow(counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame) -> Model:
    """A calibrated model from a bounded sample of the labelled documents; only word counts and scores of the
    sample reach the driver."""
    ship(docs.sparkSession)
    sample = cut(labelled_sample(docs))
    counts: dict[str, dict[str, int]] = {}
    for lang, word, n in word_counts(sample.where("half = 0")).toLocalIterator():
        counts.setdefault(lang, {})[word] = n
    model = train(counts)
    if not model.languages:
        return model
    rows = sample.where("half = 1").where(F.col("lang").isin(model.languages)).select("lang", _scored(model, F.col("text")).alias("s")).collect()
    if rows:
        ce, n = np.array([r.s.ce for r in rows]), np.array([r.s.n for r in rows], float)
        calibrate(model, ce, n, np.array([model.languages.index(r.lang) for r in rows]))
    return model


def _scored(model: Model, text: Column) -> Column:
    @F.arrow_udf("struct<ce:array<double>,n:bigint>")
    def run(texts: pa.Array) -> pa.Array:
        ce, n = entropies(model, texts)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * ce.shape[1], pa.int32()), pa.array(ce.ravel()))
        return pa.StructArray.from_arrays([flat, pa.array(n.astype(np.int64))], ["ce", "n"])

    return run(text)


def predict(model: Model, text: Column) -> Column:
    """struct<lang_pred, score, cross_entropy, rejected>; UNKNOWN with score 0 for a null text or one without a letter.
    The model, of the size of the bounded sample, goes to the workers once, as a broadcast variable."""
    sent = SparkSession.active().sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double,cross_entropy:double,rejected:boolean>")
    def run(texts: pa.Array) -> pa.Array:
        model = sent.value
        if not model.languages:
            lang, score, low, bad = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool)
        else:
            ce, n = entropies(model, texts)
            low, score = ce.min(1), posteriors(ce, n, model.temperature).max(1) * (n > 0)
            lang = np.where(n > 0, np.array(model.languages, object)[ce.argmin(1)], UNKNOWN).tolist()
            bad = (n == 0) | (low > model.ceiling) | (score < 0.5)
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score), pa.array(low), pa.array(bad)], ["lang_pred", "score", "cross_entropy", "rejected"])

    return run(text)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, rejected of every document.

    A null doc_id is not held out, and may be learned from. Repeated rows and ties are scored alike; of
    equal cross-entropies the language first by name wins. Texts of any length are scored whole. Without labelled
    documents every prediction is und; without rows the result is empty; other columns are not read.
    """
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.select("doc_id", "text", "lang"))
    return docs.select("doc_id", held_out().alias("held_out"), predict(model, F.col("text")).alias("p")).select("doc_id", "held_out", "p.*")
