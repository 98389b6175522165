"""Benchmark decontamination by pigeonhole edit matching.

A test item of m normalised words may be matched with k = floor((1 - similarity) * m) word edits. It is cut
into k + 1 pieces, so an occurrence within k edits holds some piece unchanged; piece hits are found by
hash in one pass over the words of the corpus, and each is verified around its place by Myers's
bit-parallel edit distance with words as symbols.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import KEY, ROW, cut, keyed, ship, table
from gristmill.llm.wordarrays import chunks, hashes, mixed, words

SIMILARITY = 0.8
#: Words of test items that are matched by one pass over the texts; more items make more passes.
BLOCK_WORDS = 2_000_000

#: Words are runs of ASCII letters and digits and of any other character; case is folded.
BREAKS = np.zeros(256, bool)
BREAKS[:128] = [not chr(i).isalnum() for i in range(128)]


def word_hashes(texts: pa.Array):
    """(number of the first text, hashes, text numbers, number of texts) of runs of texts."""
    folded = pc.utf8_lower(texts.fill_null(""))
    for first, data, offsets in chunks(folded):
        starts, ends, text = words(data, offsets, BREAKS)
        yield first, hashes(data, starts, ends), text, len(offsets) - 1


def window_hashes(word: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words."""
    if len(word) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(word) - n + 1, n, np.uint64)
    for j in range(n):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + word[j : len(word) - n + 1 + j])
    return out


def myers(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """(least edit distance of the pattern to any part of the text, end of the first such part)."""
    m = len(pattern)
    peq: dict[int, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        peq[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = ((((eq & pv) + pv) ^ pv) | eq) & full
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


@dataclass
class Items:
    """Test items ready to be matched."""

    ids: list[list[int]] = field(default_factory=list)
    word: list[list[int]] = field(default_factory=list)
    budget: list[int] = field(default_factory=list)
    #: By piece length: sorted hashes, and for each its (item, offset) pairs.
    pieces: dict[int, tuple[np.ndarray, list[list[tuple[int, int]]]]] = field(default_factory=dict)


def prepare(rows: list[tuple[int, str | None]], similarity: float = SIMILARITY) -> Items:
    """Items without a word are left out; items of equal words are one, with all their ids."""
    out, seen = Items(), {}
    for i, text in rows:
        w = [int(h) for _, hs, _, _ in word_hashes(pa.array([text or ""])) for h in hs]
        if not w:
            continue
        if tuple(w) in seen:
            out.ids[seen[tuple(w)]].append(i)
            continue
        seen[tuple(w)] = len(out.word)
        out.ids.append([i])
        out.word.append(w)
        out.budget.append(int(len(w) * (1 - similarity) + 1e-9))
    by_length: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
    for t, (w, k) in enumerate(zip(out.word, out.budget)):
        cuts = [len(w) * j // (k + 1) for j in range(k + 2)]
        for a, b in zip(cuts, cuts[1:]):
            h = int(window_hashes(np.array(w[a:b], np.uint64), b - a)[0])
            by_length[b - a][h].append((t, a))
    for n, found in by_length.items():
        keys = sorted(found)
        out.pieces[n] = np.array(keys, np.uint64), [found[k] for k in keys]
    return out


def match(items: Items, texts: pa.Array) -> list[list[tuple[int, int, int, int]]]:
    """For each text its (item id, distance, first word, end word), the best occurrence of each item within
    budget, by item id. Texts are searched whole."""
    out: list[list] = [[] for _ in range(len(texts))]
    for first, word, text, m in word_hashes(texts):
        if not len(word):
            continue
        begin = np.searchsorted(text, np.arange(m + 1))
        near: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for n, (keys, owners) in items.pieces.items():
            h = window_hashes(word, n)
            if not len(h):
                continue
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            for i in np.flatnonzero((keys[at] == h) & (text[: len(h)] == text[n - 1 :])).tolist():
                d = int(text[i])
                for t, offset in owners[at[i]]:
                    k = items.budget[t]
                    a = max(int(begin[d]), i - offset - k)
                    b = min(int(begin[d + 1]), i - offset + len(items.word[t]) + k)
                    near[d, t].append((a, b))
        for (d, t), spans in near.items():
            best = None
            spans.sort()
            merged = [list(spans[0])]
            for a, b in spans[1:]:
                if a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            for a, b in merged:
                part = word[a:b].tolist()
                distance, end = myers(items.word[t], part)
                if distance <= items.budget[t] and (best is None or distance < best[0]):
                    start = end - myers(items.word[t][::-1], part[:end][::-1])[1]
                    best = distance, a + start - int(begin[d]), a + end - int(begin[d])
            if best:
                out[first + d] += [(i, *best) for i in items.ids[t]]
    return [sorted(x) for x in out]


HITS = "array<struct<item_id:bigint,distance:int,first_word:int,end_word:int>>"
_HIT = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("first_word", pa.int32()), ("end_word", pa.int32())]))


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[int, str | None]]]:
    """The items (item_id, text) in lists of at most block_words words, or of one item; those without an id are left out.
    The driver holds one list and one partition of the items at a time."""
    block, held = [], 0
    for row in benchmark.where("item_id IS NOT NULL").select("item_id", "text").toLocalIterator():
        n = len((row["text"] or "").split()) + 1
        if block and held + n > block_words:
            yield block
            block, held = [], 0
        block.append((row["item_id"], row["text"]))
        held += n
    if block:
        yield block


def held(text: Column, block: list[tuple[int, str | None]], similarity: float = SIMILARITY) -> Column:
    """The items of one block that text holds within the error budget."""
    items = prepare(block, similarity)

    @F.arrow_udf(HITS)
    def run(texts: pa.Array) -> pa.Array:
        names = ["item_id", "distance", "first_word", "end_word"]
        return pa.array([[dict(zip(names, h)) for h in row] for row in match(items, texts)], _HIT)

    return run(text)


def with_hits(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, block_words: int = BLOCK_WORDS) -> DataFrame:
    """ROW, all columns of docs, and gm_hits, the items that its text holds, by item_id.

    Items of one block are matched where the text is read. Further blocks are matched one after the other, each by a pass
    of its own whose hits alone are kept, so that a worker and the driver hold one block, however many items there are.
    """
    ship(docs.sparkSession)
    found = blocks(benchmark, block_words)
    first, second = next(found, None), next(found, None)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW)
    if second is None:
        some = F.array_sort(held(F.col("text"), first, similarity)) if first else F.array().cast(HITS)
        return docs.select(whole, some.alias("gm_hits"))
    rows, passes = keyed(docs), []
    for block in chain([first, second], found):
        hit = rows.select(*KEY[1:], held(F.col(f"{ROW}.text"), block, similarity).alias("gm_hits")).where(F.size("gm_hits") > 0)
        passes.append(cut(hit.dropDuplicates(KEY[1:])))
    every = reduce(DataFrame.unionAll, passes).groupBy(*KEY[1:]).agg(F.array_sort(F.flatten(F.collect_list("gm_hits"))).alias("gm_hits"))
    return rows.join(every, KEY[1:], "left").select(ROW, F.coalesce("gm_hits", F.array().cast(HITS)).alias("gm_hits"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents of docs that hold no test item."""
    return with_hits(docs, benchmark, similarity, block_words).where(F.size("gm_hits") == 0).select(f"{ROW}.*")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, contaminated, item_ids, distances, and hits with word spans, of every document.

    A null, empty or wordless text holds nothing, and such an item is held by nothing. Repeated rows and
    items of equal words are matched alike, each under its own id. Texts of any length are searched whole; without
    documents the result is empty, without items nothing is held; other columns are not read.
    """
    docs = with_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return docs.select(
        f"{ROW}.doc_id", (F.size("gm_hits") > 0).alias("contaminated"), F.col("gm_hits.item_id").alias("item_ids"),
        F.col("gm_hits.distance").alias("distances"), F.col("gm_hits").alias("hits"),
    )
